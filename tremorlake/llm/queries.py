"""The thin queries over the driver's tables, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity, train

    common.workers_import(spark)
    docs, labels = common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "labels")
    held = common.crc_mod(F.col("doc_id"), 5) == 0
    out = toxicity(docs, train(docs, labels.where(~held)))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find

    common.workers_import(spark)
    return find(common.load(spark, sf_dir, "documents"), common.load(spark, sf_dir, "benchmark"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_codec import digests

    common.workers_import(spark)
    return digests(common.load(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data, trained

    common.workers_import(spark)
    return personal_data(common.load(spark, sf_dir, "documents"), trained())


def op5_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_zip import round_trip

    common.workers_import(spark)
    return round_trip(common.load(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
top AS (SELECT html, max(page_id) AS target FROM p WHERE strlen(html) >= 1000 GROUP BY html HAVING count(*) > 1)
SELECT p.page_id, strlen(p.html) AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN p.page_id < target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id < target THEN target END AS refers_to
FROM p LEFT JOIN top ON p.html = top.html
"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    common.workers_import(spark)
    return near_duplicates(common.load(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spotsigs import edited_fingerprints

    return edited_fingerprints(common.load(spark, sf_dir, "documents"))


def op8_cross_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .cross_parse import identify

    common.workers_import(spark)
    docs = common.load(spark, sf_dir, "documents")
    held = common.crc_mod(F.col("doc_id"), 4) == 2
    return identify(docs, ~held).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    common.workers_import(spark)
    return token_counts(common.load(spark, sf_dir, "documents"))


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score

    common.workers_import(spark)
    docs = common.load(spark, sf_dir, "documents")
    out = score(docs, common.crc_mod(F.col("doc_id"), 10) != 0)
    return out.select("doc_id", (common.crc_mod(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress, with_label_error

    common.workers_import(spark)
    coded, books = compress(common.load(spark, sf_dir, "embeddings"))
    digest = F.create_map(*[F.lit(x) for width, own in books.items() for x in (width, own.digest())]) if books else F.lit(None).cast("map<int,string>")
    return with_label_error(coded).select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.element_at(digest, F.col("width")).alias("codebooks_sha256"))


def op11_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of training one after the other, for vectors whose length is a multiple of the parts."""
    nearest = """SELECT id, p, x, arg_min(e, far * 256 + e) AS e, min(far) AS far FROM (
      SELECT k.id, k.p, k.x, b.e, list_sum(list_transform(list_zip(k.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS far FROM k JOIN {books} b ON k.p = b.p) GROUP BY id, p, x"""
    steps = [
        f"""v AS MATERIALIZED (SELECT vec_id AS id, label, list_transform(embedding, lambda y: floor(4096 * y::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)""",
        f"k AS MATERIALIZED (SELECT id, p, w[p * len(w) // {parts} + 1 : (p + 1) * len(w) // {parts}] AS x FROM v, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, e, x AS c FROM k JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS e FROM (SELECT id FROM v ORDER BY id LIMIT {entries})) USING (id))",
    ]
    for r in range(rounds):
        steps.append(f"n{r} AS MATERIALIZED ({nearest.format(books=f'b{r}')})")
        mean = "(sum(y)::BIGINT - ((sum(y)::BIGINT % count(*)) + count(*)) % count(*)) // count(*)"
        steps.append(f"m{r} AS MATERIALIZED (SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, e, i, {mean} AS m FROM (SELECT p, e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM n{r}) GROUP BY p, e, i) GROUP BY p, e)")
        steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{r} b LEFT JOIN m{r} m ON b.p = m.p AND b.e = m.e)")
    steps.append(f"f AS MATERIALIZED (SELECT id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(far)::BIGINT AS error FROM ({nearest.format(books=f'b{rounds}')}) GROUP BY id)")
    steps.append(f"s AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT id AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM f JOIN v USING (id), s"


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import digests

    common.workers_import(spark)
    return digests(common.load(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id < keeper) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM k LEFT JOIN h USING (key) GROUP BY doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_decontaminate": op2_decontaminate, "op3_sentencepiece": op3_sentencepiece, "op4_pii": op4_pii, "op5_warc_zip": op5_warc_zip, "op6_simhash": op6_simhash, "op7_spotsigs": op7_spotsigs, "op8_cross_parse": op8_cross_parse, "op9_token_counts": op9_token_counts, "op10_ppm": op10_ppm, "op11_vector_codes": op11_vector_codes, "op12_line_dedup": op12_line_dedup}


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_zip": OP5_SQL, "op11_vector_codes": op11_sql(), "op12_line_dedup": OP12_SQL}
