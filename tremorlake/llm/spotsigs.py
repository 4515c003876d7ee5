"""SpotSigs document fingerprints with DataFrame functions alone.

Words are runs of letters and digits in lower case; anchors are common words of the languages at hand, all others are
content words. A signature is an anchor and the chain of the CHAIN content words that follow it, later anchors skipped. A text's signatures form a set of 64-bit hashes. A text with
content gets one more signature that starts at its beginning, so that texts without anchors have one too. The fingerprint is the XXH64 of the sorted set in 16 hex digits, the likeness of
two texts the Jaccard similarity of their sets; of two empty sets it is 1 (no content word in either).

Pairs: `near_pairs` gives pairs of distinct sets whose Jaccard similarity reaches a threshold t, with the members of each set in
a second table. Sets are partitioned by length into classes of ratio t, so a set meets only its class and the next;
within these, sets meet through the |S| - ceil(t |S|) + 1 rarest signatures (a pair at t or more shares one of
these), and the length ratio prunes pairs before the exact test.

Nulls, empties: null texts count as empty (n_chars 0, edited text empty); null ids sort before all others; rows
with equal ids are ordered by their text's XXH64 and all of them kept; rows equal in id and that hash count as repeats of one row,
are computed once and written as often as they stand there. Texts of any length are read whole, as one row of arrays. An empty
table gives an empty table. Ids of any spread are ordered by range partitions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tremorlake.operators.tables import numbered

from . import common

# Common words of English, German, French and Spanish.
ANCHORS = (
    "the of and to in a is that for it on was with be as by this are at an from or "
    "der die das und den von mit ist des im ein eine für auf nicht auch "
    "le la les et un une dans est pour que du sur au par elle il pas "
    "el los las en por con una su se no es para y del"
).split()
CHAIN = 2
BLOCK_BITS = 10  # 1024 rows are looked at together for a row's successor


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The text's set of signature hashes: array<bigint>, distinct and sorted.

    The k-th anchor at word p is followed by the content word number p - k, so chains need no search."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    anchors = lambda w: F.filter(F.transform(w, lambda x, i: F.when(x.isin(ANCHORS), i)), lambda i: i.isNotNull())
    content = lambda w: F.filter(w, lambda x: ~x.isin(ANCHORS))
    follow = lambda c, at: [F.get(c, at + j) for j in range(chain)]
    start = lambda c: F.when(F.size(c) > 0, F.array(F.xxhash64(F.lit(""), *follow(c, F.lit(0))))).otherwise(F.array().cast("array<bigint>"))
    chains = lambda w, a, c: F.transform(a, lambda p, k: F.xxhash64(F.get(w, p), *follow(c, p - k)))
    # Arrays of one element give the parts names, so that each is made once.
    split = F.transform(F.array(words), lambda w: F.struct(w.alias("w"), anchors(w).alias("a"), content(w).alias("c")))
    hashes = F.transform(split, lambda s: F.concat(start(s["c"]), chains(s["w"], s["a"], s["c"])))
    return F.array_sort(F.array_distinct(hashes[0]))


def fingerprint(sigs: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.xxhash64(F.array_join(F.transform(sigs, lambda h: h.cast("string")), ",")))), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    common_ = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - common_
    return F.when(whole == 0, F.lit(1.0)).otherwise(common_ / whole)


def with_next(docs: DataFrame, extra: dict[str, Column]) -> DataFrame:
    """docs (id, text) with columns made of each row, all of these (next_<name>, next_text) from the next row, and n.

    Rows are ordered by id (nulls first) and the text's XXH64. Equal rows are one row here until the end: the last of them is
    followed by the next other row (n = 1), the n others by their like. Numbers come from range partitions of (id, hash) alone and
    are dense whatever the ids, so blocks of numbers are full; a block's last row takes the head of the next block (after the
    last, the first). Texts are shuffled to their number and to their block; `extra` is made after that, again for heads."""
    keyed = docs.select("id", "text", F.xxhash64("text").alias("h"))
    numbers = common.table(numbered(keyed.groupBy("id", "h").agg(F.count("*").alias("n")), F.col("id").asc_nulls_first(), F.col("h"), name="r").withColumn("r", F.col("r") - 1), "numbers")
    # A null id is joined as 0 beside its flag, so that the join finds it in the partitions of the aggregation.
    flat = lambda x: x.withColumns({"void": F.col("id").isNull(), "key": F.coalesce("id", F.lit(0))})
    texts = flat(keyed).groupBy("void", "key", "h").agg(F.first("text").alias("text"))
    rows = texts.join(flat(numbers), ["void", "key", "h"]).select("id", "text", "n", "r", F.shiftright("r", BLOCK_BITS).alias("b"))
    last = numbers.agg(F.shiftright(F.max("r"), BLOCK_BITS)).first()[0] or 0
    names = ["text", *extra]
    heads = rows.where(F.col("r") % (1 << BLOCK_BITS) == 0).withColumns(extra)
    tails = heads.select(F.when(F.col("b") == 0, F.lit(last)).otherwise(F.col("b") - 1).alias("b"), *[F.col(c).alias(f"head_{c}") for c in names])
    own = Window.partitionBy("b").orderBy("r")
    led = rows.repartition("b").withColumns(extra).withColumns({f"lead_{c}": F.lead(c).over(own) for c in names} | {"last": F.lead(F.lit(1)).over(own).isNull()})
    both = led.join(tails, "b").withColumn("like", F.explode(F.when(F.col("n") > 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    after = lambda c: F.when(F.col("like"), F.col(c)).when(F.col("last"), F.col(f"head_{c}")).otherwise(F.col(f"lead_{c}"))
    return both.select("id", *names, *[after(c).alias(f"next_{c}") for c in names], F.when(F.col("like"), F.col("n") - 1).otherwise(1).alias("n"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    x = with_next(source, {"sigs": signatures(F.col("text"))}).withColumn("n_chars", F.length("text").cast("long"))
    x = x.withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    x = x.select("id", "n", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.col("sigs").alias("a"), signatures(F.col("edited")).alias("b"), F.col("next_sigs").alias("c"))
    x = x.select("n", F.col("id").alias("doc_id"), "n_chars", "edited_sha256", fingerprint(F.col("a")).alias("fingerprint"), fingerprint(F.col("b")).alias("edited_fingerprint"), likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"))
    thousands = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 1000))).alias("k")
    x = x.select("*", thousands)
    return x.withColumn("k", F.explode(F.sequence(F.lit(1), F.least(F.lit(1000), F.col("n") - 1000 * F.col("k"))))).drop("n", "k")


def near_pairs(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """-> pairs (a, b, jaccard) of fingerprints, a < b, and members (doc_id, fingerprint)."""
    sets = docs.select(F.col(id_col).cast("long").alias("doc_id"), signatures(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("s"))
    sets = common.table(sets.select("doc_id", fingerprint(F.col("s")).alias("fingerprint"), "s"), "spotsigs")
    distinct = sets.groupBy("fingerprint").agg(F.first("s").alias("s")).where(F.size("s") > 0)
    count = distinct.select(F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    ranked = distinct.select("fingerprint", F.size("s").alias("m"), F.explode("s").alias("h")).join(count, "h")
    kept = F.col("m") - F.ceil(F.lit(threshold) * F.col("m") - 1e-9) + 1
    w = Window.partitionBy("fingerprint").orderBy("n", "h")
    prefix = ranked.withColumn("r", F.row_number().over(w)).where(F.col("r") <= kept)
    cls = F.floor(F.log(F.col("m").cast("double")) / -math.log(threshold) + 1e-9)
    left = prefix.select(F.col("fingerprint").alias("a"), F.col("m").alias("ma"), "h", cls.alias("k"))
    right = prefix.select(F.col("fingerprint").alias("b"), F.col("m").alias("mb"), "h", F.explode(F.array(cls, cls - 1, cls + 1)).alias("k"))
    met = left.join(right, ["h", "k"]).where("a < b").where(F.least("ma", "mb") >= F.lit(threshold) * F.greatest("ma", "mb")).select("a", "b").distinct()
    s = distinct.select("fingerprint", "s")
    both = met.join(s.select(F.col("fingerprint").alias("a"), F.col("s").alias("sa")), "a").join(s.select(F.col("fingerprint").alias("b"), F.col("s").alias("sb")), "b")
    pairs = both.select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("jaccard")).where(F.col("jaccard") >= threshold)
    return pairs, sets.select("doc_id", "fingerprint")
