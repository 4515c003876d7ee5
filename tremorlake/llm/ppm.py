"""Language-model scoring: prediction by partial matching over bytes, with word counts as a base.

Model. A trie of byte contexts up to `order` bytes, with the symbols that followed each context in the training texts
(257 symbols: the bytes and the end of a text; a text begins with `order` start marks). Every context of the training
texts has a node, however rare, so the model grows with the corpus; `share` above 0 drops contexts before less than that
share of all training symbols. Escapes are estimated by method C (as many escapes as distinct symbols seen), and a
symbol seen in a longer context is excluded in the shorter one. As every symbol of a context was also seen in its
suffix, one level of exclusion is all that is needed. Below the empty context all unseen symbols are equally likely.

Scoring. The model never is in one place. Texts are dealt to blocks of about 3.5 MB; a block's distinct windows (context
and symbol) with their training counts go, sorted and packed, to buckets of contexts that end in the same two symbols.
A bucket sums the counts of all blocks, holds the whole of every node of two or more symbols in it, and returns the
log probability of each block's windows in their order; nodes of no and one symbol are a broadcast table of at most
257 x 257 counts. A second pass over the blocks' texts looks their windows up. What is shuffled are the distinct windows
of blocks. `Model` is the same as an automaton for training texts that fit in memory; tests hold the two together.

Hot endings. An ending that holds more than HOT times a bucket's even share of the windows is taken apart: its windows are
dealt by the ending of three symbols, where that is hot as well by four, and so on up to the whole context, which has 257
windows a block at most. A part no longer holds the whole nodes of the hot endings themselves; their counts are summed
level by level and broadcast. Of each length at most buckets / HOT endings can be hot, each with 257 symbols at most.

Base. Exact counts of all training words, found the same way: a block asks once for each of its distinct words. Their
XXH64 only says which bucket they go to and in which order; words are compared as they stand.

Nulls, empties: a null text counts as empty (one token, the end). Null ids count as the empty text for the crc32 and
stay null; repeated ids give a row each. No training text: c = N = V = 0, the base then is log10(0.1 / 0.1) = 0 a token, and
every symbol has probability 1/257. Texts of any length are read whole, a block being one text at least. An empty table gives an
empty table.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

END, START = 256, 257
ORDER, SHARE = 5, 0.0
BLOCK = 512
BLOCK_BYTES = 7 << 19  # of text whose distinct windows are asked for together
HOT = 2  # times a bucket's even share of the windows: an ending with more is dealt by longer endings


def symbols(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts as one array, each with `order` start marks before and the end mark behind it; and the first places."""
    sizes = np.array([len(t) for t in texts], np.int64) + order + 1
    first = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(int(first[-1]), np.int16)
    mask = np.ones(len(out), bool)
    for j in range(order):
        mask[first[:-1] + j] = False
        out[first[:-1] + j] = START
    mask[first[1:] - 1] = False
    out[first[1:] - 1] = END
    out[mask] = np.frombuffer(b"".join(texts), np.uint8)
    return out, first


def windows(texts: list[bytes], order: int) -> np.ndarray:
    """The (context, symbol) windows of all texts in their order, 9 bits a symbol; a text of n bytes has n + 1."""
    s, _ = symbols(texts, order)
    size = max(0, len(s) - order)
    key = np.zeros(size, np.int64)
    for j in range(order + 1):
        key <<= 9
        key |= s[j : j + size]
    return key[s[order:] != START]


def ending(keys: np.ndarray, k: int) -> np.ndarray:
    """The last k symbols of each window's context."""
    return (keys >> 9) & ((1 << 9 * k) - 1)


def bucket_of(keys: np.ndarray, buckets: int, k: int = 2) -> np.ndarray:
    """A bucket for each window, by the last k symbols of its context."""
    with np.errstate(over="ignore"):
        return (ending(keys, k).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets


def among(x: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which of x stand in the sorted array `held`."""
    at = np.searchsorted(held, x)
    return held[np.minimum(at, len(held) - 1)] == x if len(held) else np.zeros(len(x), bool)


def place_of(keys: np.ndarray, buckets: int, hot: list[Ending]) -> np.ndarray:
    """The place of each window: bucket * 2 * buckets + task, where tasks from `buckets` on take the windows of hot endings.

    A row of a block holds the windows of one place, so that its keys keep their order."""
    own = bucket_of(keys, buckets)
    task, at = own.copy(), np.arange(len(keys))
    for k, level in enumerate(hot, 2):
        at = at[among(ending(keys[at], k), level.endings)]
        task[at] = buckets + bucket_of(keys[at], buckets, k + 1)
    return own * (2 * buckets) + task


def by_place(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of sorted distinct keys -> the keys' order by place, the distinct places, and where each begins in the order."""
    by = np.argsort(at, kind="stable")
    places, starts = np.unique(at[by], return_index=True)
    return by, places, np.append(starts, len(by))


class Ending:
    """The whole nodes of the hot endings of one length: sorted endings and (ending, symbol) with training counts above 0.

    shorter: (keys, counts) of the same endings less their first symbol, and more."""

    def __init__(self, endings: np.ndarray, keys: np.ndarray, counts: np.ndarray, k: int, shorter: tuple[np.ndarray, np.ndarray]) -> None:
        self.endings, self.keys, self.counts = endings, keys, counts.astype(np.float64)
        node = np.searchsorted(endings, keys >> 9)
        above = shorter[1][np.searchsorted(shorter[0], keys & ((1 << 9 * k) - 1))] if len(keys) else np.zeros(0)
        self.total, self.kinds, self.under = (np.bincount(node, w, len(endings)) for w in (self.counts, np.ones(len(keys)), above))

    def count(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], 0.0)


def window_costs(keys: np.ndarray, n: np.ndarray, order: int, short: np.ndarray, least: float, hot: list[Ending] = ()) -> np.ndarray:
    """log10 probability of each of the sorted distinct windows, n being their training counts.

    All windows whose contexts end in the same two symbols must be here, or in the same longer ending where shorter ones are
    hot; short[context, symbol] counts all windows by contexts of one symbol (row 0 if the order is 0). Contexts with fewer
    than `least` counts have no node."""
    entries, up, counts = [keys] * (order + 1), [keys] * (order + 1), [n.astype(np.float64)] * (order + 1)
    for j in range(order, 0, -1):
        entries[j - 1], up[j] = np.unique(entries[j] & ((1 << 9 * j) - 1), return_inverse=True)
        counts[j - 1] = np.bincount(up[j], counts[j], len(entries[j - 1]))
    single = short.sum(0).astype(np.float64)
    counts[0] = single[entries[0]]
    total, kinds = single.sum(), int((single > 0).sum())
    escapes = 0 if kinds == 257 else kinds
    low = np.full(len(entries[0]), 1 / max(1, 257 - kinds))
    cost = np.where(counts[0] > 0, counts[0] / max(1.0, total + escapes), (escapes / max(1.0, total + escapes) if escapes else 1.0) * low)
    sums, seen = np.full(len(low), total), np.full(len(low), float(kinds))
    for j in range(1, order + 1):
        context, c = entries[j] >> 9, counts[j]
        if j == 1:
            c = counts[1] = short[context, entries[1] & 511].astype(np.float64)
            n_all, n_seen, under = short.sum(1)[context].astype(np.float64), (short > 0).sum(1)[context].astype(np.float64), np.where(short > 0, single, 0.0).sum(1)[context]
        else:
            if 0 <= j - 2 < len(hot) and len(context):
                level = hot[j - 2]
                split = np.flatnonzero(among(context, level.endings))
                c = counts[j] = c.copy()
                c[split] = level.count(entries[j][split])
            first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1]))) if len(context) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(first, len(context)))
            n_all, n_seen, under = (np.repeat(np.add.reduceat(x, first), sizes) if len(first) else x for x in (c, (c > 0).astype(np.float64), np.where(c > 0, counts[j - 1][up[j]], 0.0)))
            if 0 <= j - 2 < len(hot) and len(context):
                node = np.searchsorted(level.endings, context[split])
                n_all[split], n_seen[split], under[split] = level.total[node], level.kinds[node], level.under[node]
        above = counts[j - 1][up[j]]
        left_n, left_d = sums[up[j]] - under, seen[up[j]] - n_seen
        whole = np.maximum(left_n + left_d, 1)
        low = np.where(left_d == 0, low[up[j]], np.where(above > 0, above / whole, left_d / whole * low[up[j]]))
        here = np.maximum(n_all + n_seen, 1)
        cost = np.where((n_all > 0) & (n_all >= least), np.where(c > 0, c / here, n_seen / here * low), cost[up[j]])
        sums, seen = n_all, n_seen
    return np.log10(np.maximum(cost, 1e-300)).astype(np.float32)


class Model:
    """The automaton made of nodes: {context: {symbol: count}}, a context being a tuple of symbols."""

    def __init__(self, nodes: dict[tuple, dict[int, int]], order: int) -> None:
        nodes.setdefault((), {})
        used = sorted({x for c, after in nodes.items() for x in (*c, *after)} | {START})
        self.order, self.classes = order, np.zeros(258, np.int16)
        for i, x in enumerate(used):
            self.classes[x] = i + 1  # class 0: never seen
        width = len(used) + 1
        seen_at_all = len(nodes[()])
        contexts = sorted(nodes, key=lambda c: (len(c), c))
        state = {c: i for i, c in enumerate(contexts)}
        cost = np.zeros((len(contexts), width))
        low = np.zeros((len(contexts), width))
        self.next = np.zeros((len(contexts), width), np.int32)
        counts = np.zeros((len(contexts), width))
        for c, i in state.items():
            for x, n in nodes[c].items():
                counts[i, self.classes[x]] = n
        seen = counts > 0
        lengths = np.array([len(c) for c in contexts])
        parent = np.array([state[c[1:]] if c else 0 for c in contexts])
        for level in range(order + 1):
            at = np.flatnonzero(lengths == level)
            if level == 0:
                low[0, :] = 1 / max(1, 257 - seen_at_all)
            else:
                p = parent[at]
                self.next[at] = self.next[p]
                left = np.where(seen[at], 0, counts[p])
                n, d = left.sum(1, keepdims=True), (left > 0).sum(1, keepdims=True)
                whole = np.maximum(n + d, 1)
                low[at] = np.where(d == 0, low[p], np.where(left > 0, left / whole, d / whole * low[p]))
            n, d = counts[at].sum(1, keepdims=True), seen[at].sum(1, keepdims=True)
            if level == 0 and seen_at_all == 257:
                d = d * 0
            whole = np.maximum(n + d, 1)
            cost[at] = np.where(d == 0, np.where(n > 0, counts[at] / whole, low[at]), np.where(seen[at], counts[at] / whole, d / whole * low[at]))
            if level < order:
                for c in contexts:
                    if len(c) == level + 1:
                        self.next[state[c[:-1]], self.classes[c[-1]]] = state[c]
        with np.errstate(divide="ignore"):
            self.cost = np.log10(np.maximum(cost, 1e-300)).astype(np.float32)
        self.width = width
        self.next *= width

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each text, its end included."""
        s, first = symbols(texts, self.order)
        codes = self.classes[s].astype(np.int32)
        body = np.diff(first) - self.order
        blocks = -(-body // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        begin = first[owner] + k * BLOCK
        length = np.minimum(BLOCK, body[owner] - k * BLOCK)
        by = np.argsort(-length, kind="stable")
        owner, begin, length = owner[by], begin[by], length[by]
        state, total = np.zeros(len(owner), np.int32), np.zeros(len(owner))
        cost, step = self.cost.ravel(), self.next.ravel()
        for t in range(self.order):
            state = step[state + codes[begin + t]]
        ends = len(length) - np.searchsorted(length[::-1], np.arange(BLOCK), side="right")
        for t in range(int(length[0]) if len(length) else 0):
            m = int(ends[t])
            at = state[:m] + codes[begin[:m] + (self.order + t)]
            total[:m] += cost[at]
            state = step[at]
        return np.bincount(owner, total, len(texts))


PASS = "kind int, block long, bucket int, gram long, n long, keys binary, counts binary, texts binary"
ASK = "block long, place long, n long, keys binary, counts binary"


def _block_pass(docs: DataFrame, order: int, buckets: int) -> DataFrame:
    """(id, text, train) -> rows of four kinds: 0 a block's windows in a bucket, 1 its words, 2 documents of a
    block, packed, 3 counts by contexts of one symbol."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PASS))

    def rows(kind: int, count: int, **columns):
        arrays = {"kind": np.full(count, kind, np.int32)} | columns
        return pa.RecordBatch.from_arrays([pa.array(arrays[f.name], f.type) if f.name in arrays else pa.nulls(count, f.type) for f in schema], schema=schema)

    def run(batches):
        import uuid

        fresh = lambda: int(uuid.uuid4()) & ((1 << 62) - 1)
        block, held, other, size = fresh(), [], [], 0
        short = np.zeros(1 << 18)

        def emit(kind, keys, n, at):
            by, held_in, starts = by_place(at)
            parts = [(b, keys[x], n[x]) for b, x in zip(held_in.tolist(), np.split(by, starts[1:-1]), strict=True)]
            return rows(kind, len(parts), block=np.full(len(parts), block), bucket=np.array([b for b, _, _ in parts], np.int32), n=np.array([len(k) for _, k, _ in parts], np.int64), keys=[common.pack(k, True) for _, k, _ in parts], counts=[common.pack(m) for _, _, m in parts])

        def emit_words():
            counts = dict.fromkeys((w for t in other for w in t.lower().split()), 0) | Counter(w for t in held for w in t.lower().split())
            words, n = list(counts), np.fromiter(counts.values(), np.int64, len(counts))
            by, starts = common.by_word(words, buckets)
            parts = [(b, x) for b in range(buckets) if len(x := by[starts[b] : starts[b + 1]])]
            return rows(1, len(parts), block=np.full(len(parts), block), bucket=np.array([b for b, _ in parts], np.int32), n=np.array([len(x) for _, x in parts], np.int64), keys=[common.streamed(pa.array([words[i] for i in x], pa.binary())) for _, x in parts], counts=[common.pack(n[x]) for _, x in parts])

        def emit_block():
            nonlocal short
            keys, n = np.unique(windows(held, order), return_counts=True)
            more = np.unique(windows(other, order))
            short += np.bincount(keys & ((1 << 9 * min(2, order + 1)) - 1), n, 1 << 18)
            keys, where = np.unique(np.concatenate((keys, more)), return_inverse=True)
            n = np.bincount(where[: len(n)], n, len(keys)).astype(np.int64)
            return emit(0, keys, n, bucket_of(keys, buckets))

        for batch in batches:
            for part in common.slices(batch, 1):
                texts, train = [t.encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()], part.column(2).to_pylist()
                yield rows(2, 1, block=[block], texts=[common.streamed(part.column(0), pa.array(texts, pa.binary()))])
                for t, learned in zip(texts, train, strict=True):
                    (held if learned else other).append(t)
                    size += len(t) + 1
                if size > BLOCK_BYTES:
                    yield emit_block()
                    yield emit_words()
                    block, held, other, size = fresh(), [], [], 0
        if size:
            yield emit_block()
            yield emit_words()
        some = np.flatnonzero(short)
        yield rows(3, len(some), gram=some, n=short[some].astype(np.int64))

    return docs.mapInArrow(run, PASS)


def _hot_endings(asks: DataFrame, order: int, buckets: int, short: np.ndarray) -> list[Ending]:
    """The endings of 2, 3 .. symbols that hold more than HOT times a bucket's even share of all blocks' windows.

    Only buckets with more than that are read, and a level only below the hot endings of the one before."""
    import pyarrow as pa

    sizes = asks.groupBy("bucket").agg(F.sum("n").alias("n"))
    whole = sizes.agg(F.sum("n")).first()[0] or 0
    most = HOT * whole / buckets
    full = np.array(sorted(r.bucket for r in sizes.where(F.col("n") > most).collect()), np.int64)  # buckets / HOT at most
    out: list[Ending] = []
    grams = np.flatnonzero(short)
    shorter = grams.astype(np.int64), short.ravel()[grams].astype(np.float64)
    for k in range(2, order):
        if not len(full):
            break
        above = out[-1].endings if out else None

        def counted(batches, k=k, above=above):
            def summed(held):
                grams, at = np.unique(np.concatenate([g for g, _, _ in held]), return_inverse=True)
                return grams, *(np.bincount(at, np.concatenate([h[j] for h in held]), len(grams)).astype(np.int64) for j in (1, 2))

            held, waiting = [], 0
            emit = lambda x: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in x], ["gram", "windows", "n"])
            for batch in batches:
                for b, n, keys, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "n", "keys", "counts")), strict=True):
                    keys, counts = unpack_keys(keys, n), common.unpack(counts, n, np.int64)
                    if above is not None:
                        under = among(ending(keys, k - 1), above)
                        keys, counts = keys[under], counts[under]
                    held.append((keys & ((1 << 9 * (k + 1)) - 1), np.ones(len(keys), np.int64), counts))
                    waiting += len(keys)
                    if waiting > 1_000_000:
                        held = [summed(held)]
                        waiting = len(held[0][0])
                        if waiting > 500_000:
                            yield emit(held[0])
                            held, waiting = [], 0
            if waiting:
                yield emit(summed(held))

        rows = asks.where(F.col("bucket").isin(full.tolist())).select("bucket", "n", "keys", "counts")
        level = common.table(rows.mapInArrow(counted, "gram long, windows long, n long").groupBy("gram").agg(F.sum("windows").alias("windows"), F.sum("n").alias("n")), "endings")
        found = level.groupBy(F.shiftright("gram", 9).alias("ending")).agg(F.sum("windows").alias("windows")).where(F.col("windows") > most).select("ending")
        endings = np.sort(found.toArrow().column(0).to_numpy()).astype(np.int64)
        if not len(endings):
            break
        nodes = level.join(F.broadcast(found), F.shiftright("gram", 9) == F.col("ending")).where("n > 0").select("gram", "n").toArrow()
        by = np.argsort(nodes.column(0).to_numpy())
        out.append(Ending(endings, nodes.column(0).to_numpy()[by], nodes.column(1).to_numpy()[by], k, shorter))
        shorter = out[-1].keys, out[-1].counts
    return out


def unpack_keys(data: bytes, n: int) -> np.ndarray:
    return common.unpack(data, n, np.int64, True)


def _dealt(asks: DataFrame, hot, buckets: int) -> DataFrame:
    """(block, bucket, n, keys, counts) -> (block, place, n, keys, counts): rows with windows of hot endings are cut by place."""
    import pyarrow as pa

    if hot is None:
        return asks.select("block", (F.col("bucket") * F.lit(2 * buckets).cast("long") + F.col("bucket")).alias("place"), "n", "keys", "counts")

    def run(batches):
        full = np.unique(bucket_of(hot.value[0].endings << 9, buckets))
        for batch in batches:
            bucket = batch.column("bucket").to_numpy().astype(np.int64)
            cut = among(bucket, full)
            rest = batch.filter(pa.array(~cut))
            yield pa.RecordBatch.from_arrays([rest.column("block"), pa.array(bucket[~cut] * (2 * buckets + 1)), *(rest.column(c) for c in ("n", "keys", "counts"))], ["block", "place", "n", "keys", "counts"])
            for row in batch.filter(pa.array(cut)).to_pylist():
                keys, counts = unpack_keys(row["keys"], row["n"]), common.unpack(row["counts"], row["n"], np.int64)
                by, places, starts = by_place(place_of(keys, buckets, hot.value))
                parts = np.split(by, starts[1:-1])
                arrays = pa.array([row["block"]] * len(parts), pa.int64()), pa.array(places, pa.int64()), pa.array([len(x) for x in parts], pa.int64()), pa.array([common.pack(keys[x], True) for x in parts], pa.binary()), pa.array([common.pack(counts[x]) for x in parts], pa.binary())
                yield pa.RecordBatch.from_arrays(list(arrays), ["block", "place", "n", "keys", "counts"])

    return asks.mapInArrow(run, ASK)


def _look_up_pass(passed: DataFrame, order: int, share: float, buckets: int) -> DataFrame:
    """What _block_pass made -> (doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    counted = passed.where("kind = 3").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    short = np.zeros(1 << 18, np.int64)
    short[counted.column(0).to_numpy()] = counted.column(1).to_numpy()
    least = share * int(short.sum())
    sc, windows_asked = passed.sparkSession.sparkContext, passed.where("kind = 0").select("block", "bucket", "n", "keys", "counts")
    table = sc.broadcast(short.reshape(512, 512))
    endings = _hot_endings(windows_asked, order, buckets, short)
    hot = sc.broadcast(endings) if endings else None
    nodes = lambda: hot.value if hot else []

    def merged(keys, n):
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        return [distinct], [np.bincount(where, np.concatenate(n), len(distinct)).astype(np.int64)]

    def summed(part: pa.Table) -> tuple[np.ndarray, np.ndarray, list]:
        """A bucket's distinct keys, their counts over all blocks, and how to read each block's keys."""
        asked = list(zip(part.column("keys").to_pylist(), part.column("n").to_pylist(), strict=True))
        keys, n, waiting = [], [], 0
        for (k, size), c in zip(asked, part.column("counts").to_pylist(), strict=True):
            keys.append(unpack_keys(k, size))
            n.append(common.unpack(c, size, np.int64))
            waiting += size
            if waiting > 2_000_000:
                keys, n = merged(keys, n)
                waiting = 0
        (keys,), (n,) = merged(keys, n)
        return keys, n, asked

    def answers(part: pa.Table, keys: np.ndarray, values: np.ndarray, asked: list) -> list:
        return [part.column("block"), part.column("place"), part.column("n"), pa.array([common.pack(values[np.searchsorted(keys, unpack_keys(k, size))]) for k, size in asked], pa.binary())]

    def price(part: pa.Table) -> pa.Table:
        keys, n, asked = summed(part)
        return pa.table(answers(part, keys, window_costs(keys, n, order, table.value, least, nodes()), asked), ["block", "place", "n", "found"])

    def count(part: pa.Table) -> pa.Table:
        words = pa.chunked_array([c for x in part.column("keys").to_pylist() for c in pa.ipc.open_stream(x).read_all().column(0).chunks], pa.binary())
        which = words.combine_chunks().dictionary_encode().indices.to_numpy()
        sizes = part.column("n").to_pylist()
        n = np.bincount(which, np.concatenate([common.unpack(c, size, np.int64) for c, size in zip(part.column("counts").to_pylist(), sizes, strict=True)])).astype(np.int64)
        found = [common.pack(x) for x in np.split(n[which], np.cumsum(sizes)[:-1])]
        once = np.arange(len(sizes)) == 0  # a bucket's sums stand in one of its rows
        return pa.table([part.column("block"), part.column("place"), part.column("n"), pa.array(found, pa.binary()), pa.array(once * n.sum()), pa.array(once * np.count_nonzero(n))], ["block", "place", "n", "found", "total", "kinds"])

    answer = "block long, place long, n long, found binary"
    asked_words = passed.where("kind = 1").select("block", F.col("bucket").cast("long").alias("place"), "n", "keys", "counts")
    words = common.table(asked_words.groupBy("place").applyInArrow(count, answer + ", total long, kinds long"), "words")
    n_words, v_words = words.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    n_train = int(short[np.arange(len(short)) & 511 == END].sum())
    n_all = n_words + n_train
    scale = n_all + 0.1 * (v_words + (n_train > 0) + 1)

    def read(found: pa.Table, by: np.ndarray, places: np.ndarray, starts: np.ndarray, kind: type) -> np.ndarray:
        """The answers to a block's keys, which stand in the places in the order `by`."""
        out = np.zeros(len(by), kind)
        at = np.searchsorted(places, found.column("place").to_numpy()).tolist()
        for b, n, x in zip(at, found.column("n").to_pylist(), found.column("found").to_pylist(), strict=True):
            out[by[starts[b] : starts[b + 1]]] = common.unpack(x, n, kind)
        return out

    def words_at(owned: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        by, starts = common.by_word(owned, buckets)
        return by, np.arange(buckets), starts

    def look_up(docs: pa.Table, found: pa.Table) -> pa.Table:
        parts = [pa.ipc.open_stream(x).read_all() for x in docs.column("texts").to_pylist()]
        ids = [i for p in parts for i in p.column(0).to_pylist()]
        texts = [t for p in parts for t in p.column(1).to_pylist()]
        owned = list({w: 0 for t in texts for w in t.lower().split()})
        held = dict(zip(owned, read(found.filter(pc.equal(found.column("kind"), 1)), *words_at(owned), np.int64).tolist(), strict=True))
        tokens, known, base = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        for i, t in enumerate(texts):
            own = t.lower().split()
            c = np.fromiter(map(held.__getitem__, own), np.float64, len(own))
            tokens[i], known[i] = len(own) + 1, np.count_nonzero(c) + (n_train > 0)
            base[i] = (np.log10(c + 0.1).sum() + math.log10(n_train + 0.1)) - (len(own) + 1) * math.log10(scale)
        distinct, where = np.unique(windows(texts, order), return_inverse=True)
        cost = read(found.filter(pc.equal(found.column("kind"), 0)), *by_place(place_of(distinct, buckets, nodes())), np.float32)
        sizes = np.array([len(t) for t in texts], np.int64)
        scores = np.add.reduceat(cost[where].astype(np.float64), np.cumsum(sizes + 1) - sizes - 1)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": tokens, "n_known": known, "train_tokens": np.full(len(texts), n_all), "base_score": base, "score": scores, "n_bytes": sizes})

    dealt = _dealt(windows_asked, hot, buckets)
    priced = dealt.groupBy(F.pmod("place", F.lit(2 * buckets)).alias("task")).applyInArrow(price, answer).withColumn("kind", F.lit(0))
    found = priced.unionByName(words.drop("total", "kinds").withColumn("kind", F.lit(1)))
    texts = passed.where("kind = 2").select("block", "texts")
    return texts.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(look_up, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long")


def score(docs: DataFrame, train: F.Column, order: int = ORDER, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes); train: which rows the model learns from."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text) + 1)).first()[0] or 0
    buckets = max(8, min(1 << 14, -(-size // (1 << 23))))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return _look_up_pass(common.table(_block_pass(rows, order, buckets), "counts"), order, share, buckets)
