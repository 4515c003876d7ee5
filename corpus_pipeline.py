"""A cleaning pipeline over `documents`, made of operators of tremorlake.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of `documents`.
For all stages: texts of any length are handled whole; a row is judged by its own text, so rows that share an id are judged one
by one; nulls in the columns lang, source and n_chars change nothing; columns beyond those of `documents` go through to the
last stage but one, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremorlake.llm import common, decontaminate, pii, sentencepiece_codec, simhash, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 stay. Labels are learned from ids whose crc32 modulo 5 is not 0.

    Null and empty texts score as a text without known terms; equal texts score alike, so all or none of them stay. Without
    labels of both classes the score is the share of toxic ones."""
    common.workers_import(spark)
    labels = common.load(spark, sf_dir, "labels").where(common.crc_mod(F.col("doc_id"), 5) != 0)
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the smallest id: SimHash links, and similarity of 0.8 or more on five words.

    Null, empty and blank texts are copies of one another, so one of them stays; null ids come last in a group; of rows with
    equal id and text one stays; a tie of ids goes to the smaller text hash."""
    common.workers_import(spark)
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay.

    Null, empty and blank texts hold none and stay; items that are null or without words are never held."""
    common.workers_import(spark)
    return decontaminate.keep_clean(docs, common.load(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind in brackets; n_chars follows.

    Null texts stay null, and so does their n_chars; empty texts stay empty; no row goes."""
    common.workers_import(spark)
    return pii.redact(docs, pii.trained()).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """-> (doc_id, ids, decoded). Null and empty texts have no ids and decode to the empty text; every row gives a row."""
    common.workers_import(spark)
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("sentencepiece", tokenize),
]

#: No SQL says what the stages decide (learned models, SimHash components); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet in the shared folder and read again by the next."""
    docs = common.load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
