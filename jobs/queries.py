"""The jobs as queries over the given tables: each runs twice into a new folder of the shared one, and what stands there is returned."""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import catalogue_ingest, text_score_scan
from tremorlake.operators.tables import shared_path
from tremorlake.plans.catalogue import cell_sql
from tremorlake.plans.fixtures import TREMOR_SQL
from tremorlake.plans.matched import perm_sql


def config(name: str) -> dict[str, Any]:
    with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), f"{name}.json"), encoding="utf-8") as f:
        return json.load(f)


def job1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue after two starts (the second finds nothing new), each event with the count of its month, cell and family."""
    at = shared_path(spark, "job1")
    for _ in range(2):
        catalogue_ingest.ingest(spark, f"{sf_dir}/events.parquet", f"{at}/out", f"{at}/checkpoint", config("catalogue_ingest"))
    events, counts = catalogue_ingest.catalogue(spark, f"{at}/out"), catalogue_ingest.counts(spark, f"{at}/out")
    both = events.join(counts, ["month", "cell", "family"])
    return both.select("event_idx", F.round(F.col("day") * 86400e6).cast("long").alias("micros"), "month", "family", "cell", F.round("magnitude", 6).alias("magnitude"), "n", "n_sized", F.round("max_magnitude", 6).alias("max_magnitude"))


JOB1_SQL = f"""
WITH {TREMOR_SQL}, good AS (SELECT * FROM tremor WHERE event_idx IS NOT NULL AND day IS NOT NULL AND lat_deg IS NOT NULL AND lon_deg IS NOT NULL),
dated AS (SELECT *, DATE '2000-01-01' + floor(day)::INTEGER AS d FROM good),
named AS (SELECT event_idx, (year(d) * 100 + month(d))::INTEGER AS month, day, coalesce(family, '') AS family, CASE WHEN isfinite(magnitude) THEN magnitude END AS magnitude, lat_deg, lon_deg FROM dated),
one AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY event_idx, month ORDER BY day, family, magnitude NULLS FIRST, lat_deg, lon_deg) = 1),
{cell_sql(100.0, "one")}
SELECT event_idx, round(day * 86400e6::DOUBLE)::BIGINT AS micros, month, family, cell, round(magnitude, 6) AS magnitude, count(*) OVER w AS n, count(magnitude) OVER w AS n_sized, round(max(magnitude) OVER w, 6) AS max_magnitude
FROM celled WINDOW w AS (PARTITION BY month, cell, family)
"""


def job2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of toxic documents against their controls after two runs into the same folder."""
    at = shared_path(spark, "job2")
    for _ in range(2):
        text_score_scan.scan(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", at, config("text_score_scan"))
    out = text_score_scan.result(spark, at)
    return out.select("family", "feature", "n_strata", F.round("z", 5).alias("z"), F.round("p", 6).alias("p"), "survives", F.round("max_abs_z", 5).alias("max_abs_z"), F.round("family_wise_p", 6).alias("family_wise_p"), F.round("perm_threshold_95", 5).alias("perm_threshold_95"), "perms")


_FEATURES = {
    "n_chars": ("size", "length(t)"),
    "n_words": ("size", "len(w)"),
    "n_lines": ("size", "length(t) - length(replace(t, chr(10), '')) + 1"),
    "longest_word": ("size", "coalesce(list_max(list_transform(w, lambda x: length(x))), 0)"),
    "mean_word_length": ("lexical", "coalesce(list_sum(list_transform(w, lambda x: length(x))) / nullif(len(w), 0), 0)"),
    "distinct_share": ("lexical", "coalesce(len(list_distinct(w)) / nullif(len(w), 0), 0)"),
    "digit_share": ("style", "length(regexp_replace(t, '[^0-9]', '', 'g')) / greatest(length(t), 1)"),
    "capital_share": ("style", "length(regexp_replace(t, '[^A-Z]', '', 'g')) / greatest(length(t), 1)"),
    "exclamation_share": ("style", "length(regexp_replace(t, '[^!]', '', 'g')) / greatest(length(t), 1)"),
    "stop_share": ("style", "length(regexp_replace(t, '[^.,;:]', '', 'g')) / greatest(length(t), 1)"),
}
_K = 4
JOB2_SQL = rf"""
WITH marked AS (SELECT doc_id, max(toxic) > 0 AS is_case FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING max(toxic) IS NOT NULL),
texts AS (SELECT doc_id, is_case, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents JOIN marked USING (doc_id)),
rows AS (SELECT doc_id, is_case, lang, source, {", ".join(f"({e})::DOUBLE AS {n}" for n, (_, e) in _FEATURES.items())} FROM texts),
placed AS (SELECT *, row_number() OVER (ORDER BY lang, source, n_chars, doc_id) AS rn FROM rows),
cases AS (SELECT *, row_number() OVER (ORDER BY rn) AS stratum FROM placed WHERE is_case),
controls AS (SELECT *, row_number() OVER (ORDER BY rn) AS at FROM placed WHERE NOT is_case),
found AS (SELECT c.stratum, row_number() OVER (PARTITION BY c.stratum ORDER BY abs(k.n_chars - c.n_chars), k.doc_id) AS row_idx, k.doc_id
  FROM cases c JOIN controls k ON k.at BETWEEN c.rn - c.stratum - {_K - 1} AND c.rn - c.stratum + {_K} AND k.lang = c.lang AND k.source = c.source),
design AS (SELECT stratum, row_idx, doc_id FROM found WHERE row_idx <= {_K} UNION ALL SELECT stratum, 0, doc_id FROM cases WHERE stratum IN (SELECT stratum FROM found)),
long AS (SELECT stratum, row_idx, is_case, feature, x FROM design JOIN (UNPIVOT rows ON {", ".join(_FEATURES)} INTO NAME feature VALUE x) USING (doc_id)),
{perm_sql(200)},
tested AS (SELECT feature, sum(v) AS v, sum(u) AS u, count(*) AS n_strata FROM moments GROUP BY feature HAVING sum(v) > 1e-12),
o AS (SELECT feature, u / sqrt(v) AS z, n_strata FROM tested),
e AS (SELECT o.feature, any_value(o.z) AS z, any_value(n_strata) AS n_strata, (count(*) FILTER (abs(n.z) >= abs(o.z) - 1e-12) + 1)::DOUBLE / (count(*) + 1) AS p FROM o JOIN null_z n USING (feature) GROUP BY o.feature),
r AS (SELECT *, row_number() OVER (ORDER BY p, feature) AS rank, count(*) OVER () AS m FROM e),
top AS (SELECT max(abs(z)) AS obs FROM o),
w AS (SELECT round(obs, 5) AS max_abs_z, round((count(*) FILTER (m >= obs - 1e-12) + 1)::DOUBLE / (count(*) + 1), 6) AS family_wise_p, round(quantile_cont(m, 0.95), 5) AS perm_threshold_95, count(*) AS perms FROM maxes, top GROUP BY obs)
SELECT CASE {" ".join(f"WHEN feature = '{n}' THEN '{f}'" for n, (f, _) in _FEATURES.items())} END AS family, feature, n_strata, round(z, 5) AS z, round(p, 6) AS p,
  rank <= coalesce((SELECT max(rank) FROM r WHERE p <= 0.05 * rank / m), 0) AS survives, w.* FROM r, w
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_catalogue_ingest": job1, "job2_text_score_scan": job2}
SQL: dict[str, str] = {"job1_catalogue_ingest": JOB1_SQL, "job2_text_score_scan": JOB2_SQL}
