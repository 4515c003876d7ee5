"""SimHash near-duplicates found through Golay-code fuzzy hashing.

Fingerprint. ASCII-lower-cased words (runs of anything but ASCII white space), shingles of `width` words joined by a
space (fewer words: the whole sequence; no word: fingerprint zero), XXH64 with seed 42 of each, repeats included; bit
b is 1 if it is set in more than half of the hashes.

Links. Two fingerprints link at 4 differing bits or fewer. The 64 bits are cut into segments of 23, 23 and 18 bits
(the last padded with zeros). The perfect binary Golay code (23, 12, 7) has covering radius 3, so take as Golay keys of a
segment the indices of all codewords within distance 4: one (if the nearest is within 2) or six. If x and y differ in 2
bits at most, the codeword nearest to a word between them is within 3 + 1 of both, so they share a key. Now count the
errors of the three segments, 4 together at most. If a segment has none, one of the others has 2 at most: the key is the
first segment as it stands and a Golay key of the other. Else one segment has 2 at most and the others 1 each: the key
is a Golay key of the one and an error-free half of each of the others. So linked pairs always share a key of 30 to 35
bits, and unrelated ones hardly ever. The distance check follows inside the joins.

Groups. All rows of equal fingerprints collapse to one vertex first. The (key, fingerprint) rows are dealt by ranges of
both, so that tasks get even shares and a bucket of any size is split over as many tasks as it fills. A task streams its
sorted buckets and compares all members of a bucket that are not yet joined, a whole array at a time; what leaves the task
is one edge for each fingerprint and group, whatever the number of buckets they share. Members of the few buckets
that a range boundary cuts, or that hold more than RUN members, are written out as well, and a join then compares those
still in different components: members outside a bucket's largest component against the rest. So a dense group of n near
copies neither meets pairwise nor stands in one task, and no link between different components is lost.

Nulls, empties: a null text counts as empty; a null id is kept, never chosen as component id unless alone (then the
component id is null). Repeated ids keep a row each. Texts of any length are hashed whole. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SEED, RADIUS = 42, 4
RUN = 512  # a bucket of up to this many members is settled inside one task
HELD = 1 << 16  # rows that a task handles at once
KEYS = 108  # bucket keys of a fingerprint at most
CHUNK = 512  # members of a bucket whose sketches are compared at once
GOLAY = 0b101011100011  # fixed value: generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, degree 11
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def shingle_hashes(text: str, width: int) -> list[int]:
    """XXH64 of each shingle of a text."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    n = len(words) - width + 1
    if n <= 1:
        return [h(b" ".join(words), SEED)]
    joined, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: n - 1])]
    return [h(joined[a:b], SEED) for a, b in zip(starts, ends[width - 1 :], strict=True)]


def majority(hashes: list[list[int]]) -> np.ndarray:
    """Fingerprints (uint64) of several texts' hashes. Bits are summed in a few passes over packed bytes."""
    counts = np.array([len(x) for x in hashes], np.int64)
    out = np.zeros(len(hashes), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    flat = np.fromiter((y for x in hashes for y in x), np.uint64, int(counts.sum()))
    starts = np.concatenate(([0], np.cumsum(counts[full])[:-1]))
    for b in range(64):
        ones = np.add.reduceat(((flat >> np.uint64(b)) & np.uint64(1)).astype(np.int32), starts)
        out[full] |= (2 * ones > counts[full]).astype(np.uint64) << np.uint64(b)
    return out


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """-> (doc_id, fp long): the 64 bits as a signed number; and the long columns `keep`."""

    def work(ids: list, texts: list) -> dict:
        return {"doc_id": ids, "fp": majority([shingle_hashes(t, width) for t in texts]).view(np.int64)}

    return common.map_texts(docs, "doc_id long, fp long", work, id_col, text_col, keep)


@functools.cache
def error_patterns() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: the error patterns of weight at most 3, and those of weight 4 where that weight is 3; and how many.

    The first is the coset's leader. Computed from the generator polynomial."""

    def remainder(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        for bit in range(22, 10, -1):
            x ^= ((x >> bit) & 1) * (GOLAY << (bit - 11))
        return x

    single = 1 << np.arange(23)
    patterns = np.zeros((2048, 6), np.int64)
    counts = np.zeros(2048, np.int64)
    from itertools import combinations

    for weight in range(5):
        every = np.array([sum(int(single[i]) for i in c) for c in combinations(range(23), weight)], np.int64)
        for e, s in zip(every, remainder(every), strict=True):
            if weight < 4 or int(patterns[s, 0]).bit_count() == 3:
                patterns[s, counts[s]] = e
                counts[s] += 1
    return patterns, counts


@functools.cache
def syndromes() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome contributions of the high 12 and the low 11 bits."""
    x = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        x ^= ((x >> bit) & 1) * (GOLAY << (bit - 11))
    return x & 2047, np.arange(2048, dtype=np.int64)


def segment_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codeword indices (12 bits) of 23-bit words: (n x 6, how many of the 6 hold)."""
    high, low = syndromes()
    patterns, counts = error_patterns()
    s = high[words >> 11] ^ low[words & 2047]
    return (words[:, None] ^ patterns[s]) >> 11, counts[s]


def bucket_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All bucket keys of fingerprints: (row, key); a key's high bits tell how it was made."""
    u = fps.view(np.uint64)
    words = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    golay = [segment_keys(w) for w in words]
    halves = [((w >> (n // 2)), (w & ((1 << n // 2) - 1))) for w, (_, n) in zip(words, SEGMENTS, strict=True)]
    rows, keys = [], []
    for j, (indices, counts) in enumerate(golay):
        a, b = (i for i in range(3) if i != j)
        rests = [words[a], words[b]] + [(x << 12) | y for x in halves[a] for y in halves[b]]
        for x in range(6):
            r = np.flatnonzero(counts > x)
            for kind, rest in enumerate(rests):
                rows.append(r)
                keys.append(((6 * j + kind) << 36) | (rest[r] << 12) | indices[r, x])
    return np.concatenate(rows), np.concatenate(keys)


def _buckets(fps: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                fp = batch.column(0).slice(at, 2000).to_numpy(zero_copy_only=False)
                rows, keys = bucket_keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[rows])], ["k", "fp"])

    return fps.select("fp").mapInArrow(run, "k long, fp long")


def close(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


class Forest:
    """Disjoint sets of numbers, of which the smallest is the root."""

    def __init__(self) -> None:
        self.above: dict[int, int] = {}

    def root(self, x: int) -> int:
        above = self.above
        while (y := above.get(x, x)) != x:
            above[x] = above.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[max(x, y)] = min(x, y)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        u = list(self.above)
        return np.array(u, np.int64), np.array([self.root(x) for x in u], np.int64)


def sorted_runs(batches):
    """Batches sorted by (k, member) -> arrays (k, member, cut, n) of about HELD rows: whole runs of equal k, with n, the size of
    each row's run, and cut: the run may go on outside these arrays (at an end of the range, or as it fills HELD rows)."""
    held, size, open_ = [], 0, None

    def ready(last: bool):
        nonlocal held, size, open_
        k, member = (np.concatenate(x) for x in zip(*held, strict=True))
        open_ = k[0] if open_ is None else open_
        begin = int(np.searchsorted(k, k[-1]))
        end = len(k) if last or begin == 0 else begin
        held, size = [(k[end:], member[end:])], len(k) - end
        cut = k[:end] == open_
        if end > begin:
            open_ = k[-1]
            cut |= k[:end] == open_
        _, run, n = np.unique(k[:end], return_inverse=True, return_counts=True)
        return k[:end], member[:end], cut, n[run]

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1)))
            size += batch.num_rows
        if size > HELD:
            yield ready(False)
    if size:
        yield ready(True)


def run_links(k: np.ndarray, fp: np.ndarray, most: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all linked members of each run of equal k: each with its run's first, then, where not joined yet, with
    the `most` members around it."""
    first = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(k) else np.zeros(0, np.int64)
    here = np.arange(len(k))
    near = (np.bitwise_count((fp ^ fp[lead]).view(np.uint64)) <= RADIUS) & (lead < here)
    of = np.where(near, lead, here)  # equal numbers: joined
    u, v = [fp[near]], [fp[lead[near]]]
    at, d = here[:-1], 1
    while len(at) and d <= most:
        at = at[at + d < len(k)]
        at = at[k[at] == k[at + d]]
        x = at[of[at] != of[at + d]]
        x = x[np.bitwise_count((fp[x] ^ fp[x + d]).view(np.uint64)) <= RADIUS]
        u.append(fp[x + d])
        v.append(fp[x])
        of[x + d] = of[x]
        d += 1
    return np.concatenate(u), np.concatenate(v)


def _links(batches, most: int):
    """Sorted (k, fp) of one range -> rows (kind, a, b): 0 an edge, 1 a member (k, fp) of a bucket that is not settled here."""
    import pyarrow as pa

    schema = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def rows(kind: int, a: np.ndarray, b: np.ndarray):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b)], schema=schema)

    forest = Forest()
    for k, fp, cut, n in sorted_runs(batches):
        out = cut | (n > most)
        yield rows(1, k[out], fp[out])
        for x, y in zip(*(z.tolist() for z in run_links(k, fp, most)), strict=True):
            forest.join(x, y)
        if len(forest.above) > 1 << 20:
            yield rows(0, *forest.edges())
            forest = Forest()
    if forest.above:
        yield rows(0, *forest.edges())


def by_range(rows: DataFrame, key: str, member: str, n: int) -> DataFrame:
    """n rows at most, dealt to even ranges of (key, member) and sorted there."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // 1_000_000))
    return rows.repartitionByRange(parts, key, member).sortWithinPartitions(key, member)


def linked(fps: DataFrame, most: int = RUN) -> DataFrame:
    """Distinct fingerprints (fp long) -> (fp, root long): the component of each fingerprint."""
    dealt = by_range(_buckets(fps), "k", "fp", fps.count() * KEYS)
    found = common.table(dealt.mapInArrow(lambda batches: _links(batches, most), "kind int, a long, b long"), "links")
    first = common.components(found.where("kind = 0").select(F.col("a").alias("u"), F.col("b").alias("v")))
    live = found.where("kind = 1").select(F.col("a").alias("k"), F.col("b").alias("fp"))
    merged = common.components(common.across(live, first, "fp", lambda a, b: close(a, b)))
    own = fps.select("fp").join(first.select(F.col("u").alias("fp"), F.col("root").alias("c")), "fp", "left").select("fp", F.coalesce("c", "fp").alias("c"))
    return own.join(merged.select(F.col("u").alias("c"), "root"), "c", "left").select("fp", F.coalesce("root", "c").alias("root"))


def near_duplicates(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, fp long, component_id): component_id is the smallest id reachable through links."""
    prints = common.table(fingerprints(docs, width, id_col, text_col), "fingerprints")
    least = common.table(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = common.table(linked(least), "linked")
    named = roots.join(least, "fp")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(ids, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


@functools.cache
def _mixers(n: int) -> np.ndarray:
    """Odd multipliers, fixed by a counter hash."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), SEED) | 1 for i in range(n)], np.uint64)


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """MinHash keys (texts x bands, int64) of non-empty sets of 64-bit hashes: a key joins the least values under `rows` hashes;
    and a sketch (texts x bands * rows, uint8): a byte of each least value."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(x) for x in sets[:-1])])
    out = np.zeros((len(sets), bands), np.uint64)
    sketch = np.zeros((len(sets), bands * rows), np.uint8)
    with np.errstate(over="ignore"):
        for i, m in enumerate(_mixers(bands * rows)):
            h = flat * m
            h ^= h >> np.uint64(32)
            h *= np.uint64(0xD6E8FEB86659FD93)
            least = np.minimum.reduceat(h, starts)
            b = i // rows
            out[:, b] = (out[:, b] ^ least) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b)
            sketch[:, i] = least & np.uint64(255)
    return out.view(np.int64), sketch


def _shared(batches):
    """Sorted (k, v) of one range -> (k, v, lead) of buckets with several members: lead is the first member at hand."""
    import pyarrow as pa

    for k, v, cut, n in sorted_runs(batches):
        first = np.concatenate(([True], k[1:] != k[:-1]))
        lead = v[np.flatnonzero(first)[np.cumsum(first) - 1]]
        out = cut | (n > 1)
        yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(v[out]), pa.array(lead[out])], ["k", "v", "lead"])


def _chunks(batches):
    """Sorted (k, main, v, c, sketch) -> (k, main, vs, cs, sketches): up to CHUNK members of a bucket in a row."""
    import pyarrow as pa
    from itertools import groupby

    for batch in batches:
        columns = [x.to_pylist() for x in batch.columns]
        out = []
        for _, group in groupby(range(batch.num_rows), key=lambda r: (columns[0][r], columns[1][r])):
            every = list(group)
            for at in range(0, len(every), CHUNK):
                some = every[at : at + CHUNK]
                out.append((columns[0][some[0]], columns[1][some[0]], *(np.array([columns[j][r] for r in some], np.int64).tobytes() for j in (2, 3)), b"".join(columns[4][r] for r in some)))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["k", "main", "vs", "cs", "sketches"])


def _close_pairs(batches, best: bool, least: float):
    """Chunks that met (xv, xc, xs, yv, yc, ys) -> pairs (a, b) of members of different components whose sketches agree as
    texts at a similarity of `least` hardly ever fail to; with best, for each a of x only the b that agrees most."""
    import pyarrow as pa

    for batch in batches:
        for row in batch.to_pylist():
            xv, xc, yv, yc = (np.frombuffer(row[n], np.int64) for n in ("xv", "xc", "yv", "yc"))
            xs, ys = np.frombuffer(row["xs"], np.uint8).reshape(len(xv), -1), np.frombuffer(row["ys"], np.uint8).reshape(len(yv), -1)
            n = xs.shape[1]
            floor = n * least - 4.6 * np.sqrt(n * least * (1 - least))
            a, b = [], []
            for v, c, sketch in zip(xv, xc, xs, strict=True):
                agree = np.where(yc == c, -1, np.count_nonzero(ys == sketch, axis=1))
                at = np.flatnonzero(agree >= floor)
                at = at[[agree[at].argmax()]] if best and len(at) else at
                a.append(np.full(len(at), v))
                b.append(yv[at])
            a, b = np.concatenate(a), np.concatenate(b)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _similar(words: DataFrame, text_of: Callable[[DataFrame], DataFrame], least: float, width: int) -> DataFrame:
    """words: the table (v long, keys array<long>, sketch binary); text_of: a table with a column v -> (v, text) of these. ->
    pairs (a, b) of v at a similarity of `least` or more that join all groups, not all pairs."""
    n = words.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    live = common.table(by_range(words.select(F.explode("keys").alias("k"), "v"), "k", "v", n).mapInArrow(_shared, "k long, v long, lead long"), "buckets")
    some = common.table(live.select("v").distinct(), "live")
    texts = common.table(text_of(some), "texts")
    sketches = words.select("v", "sketch")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        import pyarrow as pa

        a, b = (texts.select(F.col("v").alias(c), F.col("text").alias(f"t{c}")) for c in ("a", "b"))

        def run(batches):
            last, held = None, None
            for batch in batches:
                for part in common.slices(batch, batch.schema.get_field_index("tb")):
                    good = []
                    for x, ta, tb in zip(*(part.column(c).to_pylist() for c in ("a", "ta", "tb")), strict=True):
                        if x != last:
                            last, held = x, shingle_set(ta, width)
                        other = shingle_set(tb, width)
                        shared = len(np.intersect1d(held, other, assume_unique=True))
                        good.append(shared >= least * (len(held) + len(other) - shared) - 1e-9)
                    yield part.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        return common.table(pairs.join(b, "b").join(a, "a").mapInArrow(run, "a long, b long"), name)

    def open_pairs(found: DataFrame, best: bool) -> DataFrame:
        """Pairs to verify, of members of buckets that hold several components of the pairs found so far."""
        rest = common.open_members(live.select("k", "v"), common.components(found.toDF("u", "v")), "v")
        rest = rest.withColumnRenamed("a", "v").join(sketches, "v").select("k", "main", "v", "c", "sketch")
        parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        chunks = rest.repartitionByRange(parts, "k", "main", "v").sortWithinPartitions("k", "main", "v").mapInArrow(_chunks, "k long, main boolean, vs binary, cs binary, sketches binary")
        chunks = common.table(chunks, "chunks")
        x, y = (chunks.select(F.col("k").alias(f"{s}k"), F.col("main").alias(f"{s}main"), F.col("vs").alias(f"{s}v"), F.col("cs").alias(f"{s}c"), F.col("sketches").alias(f"{s}s")) for s in "xy")
        met = x.where("!xmain").join(y, F.col("xk") == F.col("yk")).select("xv", "xc", "xs", "yv", "yc", "ys")
        return met.mapInArrow(lambda batches: _close_pairs(batches, best, least), "a long, b long").distinct()

    stars = verified(live.where("v != lead").select(F.col("lead").alias("a"), F.col("v").alias("b")).distinct(), "stars")
    best = stars.unionByName(verified(open_pairs(stars, True), "best"))
    return best.unionByName(verified(open_pairs(best, False), "rest"))


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def _keyed(bands: int, rows: int, width: int) -> Callable[[list, list], dict]:
    """texts -> MinHash keys and sketches; none for a text without words."""

    def work(ids: list, texts: list) -> dict:
        sets = [shingle_set(t, width) for t in texts]
        full = [i for i, s in enumerate(sets) if len(s)]
        made = dict(zip(full, zip(*band_keys([sets[i] for i in full], bands, rows), strict=True), strict=True)) if full else {}
        return {"v": ids, "keys": [made[i][0] if i in made else [] for i in range(len(ids))], "sketch": [made[i][1].tobytes() if i in made else b"" for i in range(len(ids))]}

    return work


def similar_pairs(docs: DataFrame, least: float = 0.8, width: int = 5, bands: int = 32, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs (a, b) of ids whose sets of `width`-word shingles have a Jaccard similarity of `least` or more: pairs that
    connect groups, not all pairs. Ids are unique here; rows with a null id or without a word are in no pair.

    Candidates share a MinHash key of the shingle sets themselves, so what counts is the similarity, whatever the edit:
    with 32 keys of 6 hashes a pair at similarity 0.8 shares one with probability 1 - (1 - 0.8^6)^32 = 0.99994. In each
    bucket every member meets the first; exact similarity of the texts decides, and stars give first components. In buckets
    that still hold several components, the members outside the largest then compare sketches with those of other components
    (a byte of each of the 192 least hashes, by chunks of CHUNK members): first each is verified with the one that agrees
    most, and of what is still apart all that agree as pairs at `least` do but for 4.6 standard deviations. So no candidate
    that would join two groups is left out, and what is verified grows with the members, not with their pairs, unless a
    group's texts are all just below `least`. Buckets are dealt by ranges, as in linked()."""
    source = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("v"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    words = common.table(common.map_texts(source, "v long, keys array<long>, sketch binary", _keyed(bands, rows, width), "v"), "words")
    return _similar(words, lambda some: common.without(source, some, ["v"], "left_semi"), least, width)


def one_of_each(docs: DataFrame, width: int = 4, least: float = 0.8, shingle: int = 5, bands: int = 32, rows: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that stay when one row of each group of near copies is kept: that with the smallest id
    (null ids last; of equal ids that with the smallest text hash).

    First the groups of near_duplicates() give way to one row each. Among those that stay, texts with a similarity of `least`
    or more on `shingle` words are linked (similar_pairs), and again one row of each group stays. What counts is a row's own
    text: rows that share an id but not a near copy of their text all stay. Of rows with equal id and text one stays. Null
    texts are empty texts, and all texts without a word are copies of one another."""
    tag = uuid.uuid4().hex  # no column of the caller's has these names
    i, h = f"id_{tag}", f"h_{tag}"
    none = -(2**63)  # stands for a null id
    named = docs.withColumns({i: F.coalesce(F.col(id_col).cast("long"), F.lit(none)), h: F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))})
    source = named.select(F.col(i).alias("i"), F.col(h).alias("h"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = F.struct(F.col("i") == none, "i", "h")

    def rest(groups: DataFrame) -> DataFrame:
        """groups (g, i, h) -> (i, h) of all but the first of each."""
        first = groups.groupBy("g").agg(F.min(order).alias("first"))
        return groups.join(first, "g").where(order != F.col("first")).select("i", "h").distinct()

    prints = common.table(fingerprints(source, width, "i", keep=("h",)).withColumnRenamed("doc_id", "i"), "fingerprints")
    roots = linked(prints.select("fp").distinct())
    gone = common.table(rest(prints.join(roots, "fp").select(F.col("root").alias("g"), "i", "h")), "gone")
    repeated = not prints.groupBy("i", "h").count().where("count > 1").isEmpty()
    left = common.without(source.dropDuplicates(["i", "h"]) if repeated else source, gone, ["i", "h"])
    words = common.map_texts(left, "v long, keys array<long>, sketch binary", _keyed(bands, rows, shingle), "i", keep=("i", "h"))
    words = common.table(words.withColumn("v", F.monotonically_increasing_id()), "words")
    names = words.select("v", "i", "h")
    texts_of = lambda some: common.without(left, common.table(names.join(some, "v"), "names"), ["i", "h"], "inner").select("v", "text")
    groups = common.components(_similar(words.select("v", "keys", "sketch"), texts_of, least, shingle).toDF("u", "v"))
    members = groups.unionByName(groups.select(F.col("root").alias("u"), "root").distinct())
    more = rest(members.join(names, F.col("u") == F.col("v")).select(F.col("root").alias("g"), "i", "h"))
    kept = common.without(named, common.table(gone.unionByName(more), "gone").toDF(i, h), [i, h])
    return (kept.dropDuplicates([i, h]) if repeated else kept).select(*docs.columns)
