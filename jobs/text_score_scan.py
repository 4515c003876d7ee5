"""A matched case-control score scan over labelled texts: which measurable properties set the labelled ones apart?

    PYTHONPATH=. spark-submit jobs/text_score_scan.py --documents DIR --labels DIR --output DIR --config jobs/text_score_scan.json

Each document with the label is a case; its controls are the documents without it that are nearest in length among those of the
same language and source, found by rank: all labelled documents are numbered once over ranges, and a case asks for the controls just
before and after its own place. No group, however large, comes together in a task. The design, its features and the conditional
scores are those of the catalogue analyses; permutations within the strata give each feature's p and the family-wise threshold.

Written, and replaced as a whole by a further run, which gives the same: `features` (by language), `design` (by language), `scan` (by family of
features), `report` (JSON: the summary and the features by |z|).

Defined results: documents without a label row, and rows without an id, take no part; an id with several label rows has the largest label;
of several documents with an id the smallest by match, length and features is taken; a null text is empty, a null language or
source is the empty one. Ties in length go by id. A case without any control is left out. Without cases, or with features that
do not vary, the scan has no tested feature.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from jobs.common import arguments, session
from tremorlake.operators import circular, matrix, scores
from tremorlake.operators.tables import materialize, numbered
from tremorlake.sources.sinks import scan_report, write_design, write_json

log = logging.getLogger("jobs.text_score_scan")

MOST_LABELLED = 4_000_000  # ids that are broadcast, to measure no other text (some 100 MB); with more, every text is measured before the join


def measured(documents: DataFrame, labels: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """(doc_id, is_case, the columns to match by, a column for each feature) of labelled documents; texts go no further."""
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(config["label"]).alias("label")).where("label is not null")
    documents = documents.where("doc_id is not null")
    if marked.count() <= MOST_LABELLED:
        documents = documents.join(F.broadcast(marked.select("doc_id")), "doc_id", "left_semi")
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    match = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in config["match"]]
    rows = documents.select("doc_id", *match, text.alias("text"), words.alias("words"))
    rows = rows.select("doc_id", *config["match"], *[F.expr(f["sql"]).cast("double").alias(name) for name, f in config["features"].items()])
    rest = [c for c in rows.columns if c != "doc_id"]
    rows = rows.join(marked, "doc_id").groupBy("doc_id", (F.col("label") > 0).alias("is_case")).agg(F.min(F.struct(*rest)).alias("f"))
    return rows.select("doc_id", "is_case", "f.*")


def matched(rows: DataFrame, config: Mapping[str, Any]) -> DataFrame:
    """measured -> a row for each case (row_idx 0) and control (1 to k), with the stratum's number."""
    k, near, match = int(config["controls"]), config["nearest"], config["match"]
    order = [F.col(c) for c in (*match, near, "doc_id")]
    placed = numbered(rows, *order, name="rn")
    cases = numbered(placed.where("is_case"), *order, name="stratum")
    controls = numbered(placed.where("!is_case").drop("rn"), *order, name="at")
    before = F.col("rn") - F.col("stratum")  # controls that stand before the case
    asks = cases.select("stratum", *[F.col(c).alias(f"case_{c}") for c in (*match, near)], F.explode(F.sequence(before - k + 1, before + k)).alias("at"))
    same = [F.col(c) == F.col(f"case_{c}") for c in match]
    found = asks.join(controls, "at").where(F.lit(True) if not same else F.reduce(F.array(*same), F.lit(True), lambda a, b: a & b))
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(F.abs(F.col(near) - F.col(f"case_{near}")), "doc_id"))
    found = materialize(found.withColumn("row_idx", rank).where(F.col("row_idx") <= k).select("stratum", "row_idx", *rows.columns), "controls")
    kept = cases.join(found.select("stratum").distinct(), "stratum", "left_semi").withColumn("row_idx", F.lit(0))
    return kept.select("stratum", "row_idx", *rows.columns).unionByName(found)


def empirical_p(observed: DataFrame, null: DataFrame) -> DataFrame:
    """observed with p: the share of permutations with a |z| as large, the observed one among them."""
    both = null.select("feature", F.abs("z").alias("null_z")).join(observed.select("feature", F.abs("z").alias("abs_z")), "feature")
    p = both.groupBy("feature").agg(((F.count_if(F.col("null_z") >= F.col("abs_z") - 1e-12) + 1) / (F.count("*") + 1)).alias("p"))
    return observed.join(p, "feature")


def scan(spark: SparkSession, documents: str, labels: str, output: str, config: Mapping[str, Any]) -> dict[str, int]:
    """Reads both tables, writes the four outputs; -> numbers of rows read and written."""
    docs, marks = spark.read.parquet(documents), spark.read.parquet(labels)
    by = config["match"][:1]
    measured(docs, marks, config).write.mode("overwrite").partitionBy(*by).parquet(f"{output}/features")
    schema = ", ".join(["doc_id long", "is_case boolean", *[f"`{c}` string" for c in config["match"]], *[f"`{c}` double" for c in config["features"]]])
    rows = spark.read.schema(schema).parquet(f"{output}/features").fillna("", config["match"])
    write_design(matched(rows, config), f"{output}/design", *by)
    design = spark.read.schema(f"stratum long, row_idx int, {schema}").parquet(f"{output}/design").fillna("", config["match"])
    m = matrix.of(design, {c: F.col(f"`{c}`") for c in config["features"]})
    sums = matrix.scan_sums(m, int(config["permutations"]), int(config["seed"]))
    observed, null = matrix.observed(m, sums), matrix.null(m, sums)
    family = F.create_map(*[F.lit(x) for name, f in config["features"].items() for x in (name, f["family"])])
    tested = circular.benjamini_hochberg(empirical_p(observed.where("testable"), null), "p", float(config["rate"]), "feature")
    tested.withColumn("family", family[F.col("feature")]).write.mode("overwrite").partitionBy("family").parquet(f"{output}/scan")
    write_json(scan_report(scores.family_wise(observed, null), observed.where("testable")), f"{output}/report")
    done = {"documents": docs.count(), "labels": marks.count(), "features": rows.count(), "design": design.count(), "scan": tested.count()}
    log.info("%s, %s -> %s: %s rows", documents, labels, output, done)
    return done


def result(spark: SparkSession, output: str) -> DataFrame:
    """The scan beside the family-wise threshold, as written."""
    kinds = "feature string, u double, v double, z double, n_strata long, total_var double, leverage double, testable boolean, p double, rank int, survives boolean, family string"
    report = spark.read.schema("max_abs_z double, family_wise_p double, perm_threshold_95 double, perm_median double, perms long").json(f"{output}/report")
    return spark.read.schema(kinds).parquet(f"{output}/scan").crossJoin(F.broadcast(report))  # one row


def main(argv: list[str] | None = None) -> None:
    args, config = arguments("Scans the features of labelled texts against matched controls", "documents", "labels", "output", argv=argv)
    spark = session("text_score_scan")
    try:
        scan(spark, args.documents, args.labels, args.output, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
