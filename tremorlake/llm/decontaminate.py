"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Words are runs of letters, digits and underscores in lower case; a shingle is WIDTH words (an item or window with
fewer words is one shingle), and its weight in a window or item is how often it stands there. The similarity of a window
and an item is the weighted Jaccard of these weights: sum of minima over sum of maxima. A text holds an item if one of its
windows of as many words (the whole text if it is shorter) has a similarity of `least` or more.

Search. Windows that share no shingle with any item of their size have similarity 0, so SimHashes (64 bits, sums of
signed bits weighted as above) are made only of windows around a shared shingle. Items of a size are indexed by the
eight bytes of their SimHash, each entered under every byte value within two bits: of RADIUS = 23 differing bits in
eight bytes one byte has two at most, so a lookup finds all items within the radius. At similarity 0.8 two windows of one size
are expected to differ in 9.7 bits with standard deviation 2.9. Found pairs are then compared exactly, on their words.

Only the benchmark is sent to the executors, in blocks of at most about BLOCK_ITEMS items and BLOCK_BYTES bytes, with a pass over the
texts for each block; nothing is shuffled.

Nulls, empties: null texts and texts without words hold nothing; items that are null or without words are never
held. Null and repeated ids keep their rows; equal items match each. Texts of any length are read whole, window by window. Ties: every
item that reaches `least` is found, in no order. An empty table of texts or items gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH, LEAST, RADIUS = 5, 0.8, 23
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32_000_000
GATE_BITS = 22

_words = re.compile(r"\w+").findall
_mix = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _words(text.lower())


def codes_of(words: list[str]) -> np.ndarray:
    """A 64-bit code for each word."""
    x = np.fromiter(map(zlib.crc32, "\n".join(words).encode("utf-8", "surrogatepass").split(b"\n")), np.uint64, len(words)) if words else np.zeros(0, np.uint64)
    x = (x + np.uint64(1)) * _mix
    return x ^ (x >> np.uint64(29))


def shingles_of(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit code for each run of `width` words."""
    n = len(codes) - width + 1
    out = np.zeros(max(0, n), np.uint64)
    for j in range(width if n > 0 else 0):
        out = (out ^ codes[j : j + n]) * _mix
        out ^= out >> np.uint64(32)
    return out


def signs(shingles: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int32) * 2 - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view(np.uint64)[:, 0]


def weights(words: list[str]) -> Counter:
    width = min(WIDTH, len(words))
    return Counter(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def similarity(a: Counter, b: Counter) -> float:
    low = sum(min(n, b[k]) for k, n in a.items() if k in b)
    return low / (sum(a.values()) + sum(b.values()) - low) if a or b else 0.0


class Index:
    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids, self.weights, self.prints, sizes, gates = [], [], [], defaultdict(list), defaultdict(list)
        for item_id, text in items:
            words = words_of(text or "")
            if not words:
                continue
            i = len(self.ids)
            shingles = shingles_of(codes_of(words), min(WIDTH, len(words)))
            self.ids.append(item_id)
            self.weights.append(weights(words))
            self.prints.append(simhash(signs(shingles).sum(0, keepdims=True))[0])
            sizes[len(words)].append(i)
            gates[min(WIDTH, len(words))].append((shingles, len(words)))
        self.gates = {}
        for width, held in gates.items():
            sizes_at: dict[int, set[int]] = defaultdict(set)
            for shingles, size in held:
                for s in shingles.tolist():
                    sizes_at[s].add(size)
            bits = np.zeros(1 << GATE_BITS, bool)
            bits[np.fromiter(sizes_at, np.uint64, len(sizes_at)) >> np.uint64(64 - GATE_BITS)] = True
            self.gates[width] = bits, dict(sizes_at)
        near = [[v for v in range(256) if (v ^ u).bit_count() <= 2] for u in range(256)]
        self.tables = {}
        for size, held in sizes.items():
            table: dict[tuple[int, int], list[int]] = defaultdict(list)
            for i in held:
                for b, byte in enumerate(int(self.prints[i]).to_bytes(8, "little")):
                    for v in near[byte]:
                        table[b, v].append(i)
            self.tables[size] = dict(table)

    def within(self, print_: int, size: int) -> set[int]:
        """All items of a size whose SimHash differs in RADIUS bits at most."""
        table = self.tables[size]
        found = {i for b, byte in enumerate(print_.to_bytes(8, "little")) for i in table.get((b, byte), ())}
        return {i for i in found if (int(self.prints[i]) ^ print_).bit_count() <= RADIUS}

    def held(self, text: str, least: float = LEAST) -> list[tuple[int, float, int, int]]:
        """(item_id, best similarity, first word, words) of each item that the text holds."""
        words = words_of(text)
        if not words or not self.ids:
            return []
        codes = codes_of(words)
        spans: dict[int, list[tuple[int, int]]] = defaultdict(list)  # by window size: ranges of first words
        made = {}
        for width, (gate, sizes_at) in self.gates.items():
            made[width] = s = shingles_of(codes, width)
            for p in np.flatnonzero(gate[s >> np.uint64(64 - GATE_BITS)]).tolist():
                for size in sizes_at.get(int(s[p]), ()):
                    last = max(0, len(words) - size)
                    spans[size].append((min(last, max(0, p - size + width)), min(last, p)))
        best: dict[int, tuple[float, int, int]] = {}
        for size, ranges in spans.items():
            s = made[min(WIDTH, size)]
            per = min(size, len(words)) - min(WIDTH, size) + 1
            at = -1
            for a, b in sorted(ranges):
                a = max(a, at + 1)
                if a > b:
                    continue
                at = b
                for a in range(a, b + 1, 4096):
                    sums = np.zeros((min(b + 1, a + 4096) - a + per, 64), np.int32)
                    np.cumsum(signs(s[a : a + len(sums) - 1]), axis=0, out=sums[1:])
                    for k, print_ in enumerate(simhash(sums[per:] - sums[:-per]).tolist()):
                        found = self.within(print_, size)
                        if found:
                            w = weights(words[a + k : a + k + size])
                            for i in found:
                                x = similarity(w, self.weights[i])
                                if x >= least - 1e-12 and (i not in best or x > best[i][0]):
                                    best[i] = x, a + k, min(size, len(words))
        return [(self.ids[i], *v) for i, v in sorted(best.items())]


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> list:
    """Broadcast handles of the benchmark's blocks; workers build the index of a block once."""
    items = benchmark.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    k = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    dealt = items.withColumn("b", F.pmod(F.xxhash64("id", "text"), F.lit(k)))
    sc = benchmark.sparkSession.sparkContext
    return [sc.broadcast(sorted(((r.id, r.text) for r in dealt.where(F.col("b") == b).collect()), key=lambda x: (x[0] is None, x))) for b in range(k)]


_built: dict[int, Index] = {}


def index_of(handle) -> Index:
    if handle.id not in _built:
        if len(_built) >= 2:
            _built.clear()
        _built[handle.id] = Index(handle.value)
    return _built[handle.id]


class _Handle:
    """A broadcast with a name that workers can remember an index by."""

    def __init__(self, broadcast, id_: str) -> None:
        self.broadcast, self.id = broadcast, id_

    @property
    def value(self):
        return self.broadcast.value


def _handles(benchmark: DataFrame, id_col: str, text_col: str) -> list[_Handle]:
    import uuid

    return [_Handle(b, uuid.uuid4().hex) for b in blocks(benchmark, id_col, text_col)]


def find(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """-> (doc_id, item_id, similarity, first_word, n_words): each item that a text holds, with its best window."""
    out = None
    for handle in _handles(benchmark, item_col, item_text_col):

        def work(ids: list, texts: list, handle=handle) -> dict:
            index = index_of(handle)
            rows = [(i, *h) for i, t in zip(ids, texts, strict=True) for h in index.held(t, least)]
            return {k: [r[j] for r in rows] for j, k in enumerate(("doc_id", "item_id", "similarity", "first_word", "n_words"))}

        part = common.map_texts(docs, "doc_id long, item_id long, similarity double, first_word long, n_words long", work, id_col, text_col)
        out = part if out is None else out.unionByName(part)
    return out


def keep_clean(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text holds no item of the benchmark."""

    def good(handle: _Handle) -> Callable[[list], list]:
        return lambda texts: [not index_of(handle).held(t, least) for t in texts]

    for handle in _handles(benchmark, item_col, item_text_col):
        docs = common.keep_rows(docs, good(handle), text_col)
    return docs
