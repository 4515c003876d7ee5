"""Vector codes and line dedup against plain loops."""

import hashlib
import math
import random

import numpy as np
import pytest
from conftest import DOCS

from tremorlake.llm import line_dedup as L
from tremorlake.llm import queries
from tremorlake.llm import vector_codes as V

VECTORS = "vec_id long, embedding array<double>, label int"


def codes_of(rows, parts=8, entries=16, rounds=6, scale=4096):
    """[(vec_id, vector, label)] of one length -> ([(vec_id, code, error, label_error)], digest), by plain loops over Python's integers."""
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(x * scale) for x in r[1]] for r in good]
    n, at = len(whole[0]), [0]
    for p in range(parts):
        at.append(at[-1] + n // parts + (p < n % parts))
    cut = [[w[at[p] : at[p + 1]] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (dist(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            own = [near(p, c[p]) for c in cut]
            books[p] = [[sum(z) // len(z) for z in zip(*g, strict=True)] if (g := [c[p] for c, o in zip(cut, own, strict=True) if o == e]) else books[p][e] for e in range(len(books[p]))]
    out, by_label = [], {}
    for r, c in zip(good, cut, strict=True):
        own = [near(p, c[p]) for p in range(parts)]
        error = sum(dist(c[p], books[p][own[p]]) for p in range(parts))
        out.append((r[0], "".join(f"{o:02x}" for o in own), error, r[2]))
        by_label[r[2]] = by_label.get(r[2], 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[label]) for i, c, e, label in out), key=str), digest


def coded(df, **options):
    out, books = V.compress(df, **options)
    rows = V.with_label_error(out).collect()
    return sorted(((r.id, r.code.hex(), r.error, r.label_error) for r in rows), key=str), {w: b.digest() for w, b in books.items()}


def test_codes_are_those_of_plain_loops(spark):
    draw = random.Random(5)
    rows = [(i, [draw.gauss(0, 0.3) for _ in range(16)], draw.choice([0, 1, None])) for i in range(120)]
    rows += [(200, None, 1), (201, [0.1] * 15 + [None], 1), (202, [math.nan] * 16, None), (203, [math.inf] + [0.0] * 15, 0), (3, [0.5] * 16, 2), (None, [-0.25] * 16, 2), (7, rows[7][1], 0)]
    want, digest = codes_of(rows)
    df = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS id", "2 AS code", "3 AS vector", "4 AS width", "5 AS `of`")
    for parts in (1, 5):
        got, digests = coded(df.repartition(parts))
        assert got == want and digests == {16: digest}


def test_few_rows_and_odd_lengths(spark):
    rows = [(i, [0.001 * i, -0.5 * i, 1 / (i + 1)] * 3 + [2.0], 1) for i in range(5)]
    want, digest = codes_of(rows)
    assert coded(spark.createDataFrame(rows, VECTORS)) == (want, {10: digest})
    mixed = [*rows, (9, [], None), (10, [0.25] * 8, None)]
    got, digests = coded(spark.createDataFrame(mixed, VECTORS))
    assert [r[:3] for r in got if r[0] in range(5)] == [r[:3] for r in want] and digests[10] == digest and set(digests) == {0, 8, 10}
    assert (9, "00" * 8, 0, 0) in got and (10, "00" * 8, 0, 0) in got


def test_large_components_stay_exact(spark):
    rows = [(i, [float(i) * 30000.5, -(10.0**4) * i, 0.1 * i, 5e-324] * 2, None) for i in range(24)]
    want, digest = codes_of(rows, entries=4)
    assert coded(spark.createDataFrame(rows, VECTORS), entries=4) == (want, {8: digest})
    edge = [1e300, -1e300, 2.0**52 + 1, -(2.0**51) - 0.5, 1e-320, -1e-320, 0.3, -0.3]
    assert V.whole(np.array([edge]), 4096).tolist() == [[math.floor(x * 4096) if abs(x) < 1e290 else math.floor(x) * 4096 for x in edge]]


def test_decoded_vectors_are_near(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(4, 32))
    rows = [(i, (centres[i % 4] + 0.01 * draw.normal(size=32)).tolist(), i % 4) for i in range(200)]
    out, books = V.compress(spark.createDataFrame(rows, VECTORS))
    for r in out.collect():
        assert abs(V.decode(r.code, books[32]) / 4096 - np.array(rows[r.id][1])).max() < 0.2


def test_no_vectors(spark):
    for rows in ([], [(1, None, 2)]):
        assert coded(spark.createDataFrame(rows, VECTORS)) == ([], {})


def kept_of(rows, min_chars=20, min_docs=3):
    """[(doc_id, text)] -> [(doc_id, n_lines, n_dropped, sha256)] by sets."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    holders: dict[str, set] = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        goes = [len(h := holders.get(key(x), ())) >= min_docs and doc != max(d for d in h if d is not None) for x in lines]
        kept = "\n".join(x for x, g in zip(lines, goes, strict=True) if not g)
        out.append((doc, len(lines), sum(goes), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def deduped(df, **options):
    return sorted((tuple(r) for r in L.digests(df, **options).collect()), key=str)


def test_lines_are_those_of_sets(spark, odd):
    draw = random.Random(2)
    pool = [f"line number {i} that several documents share {'é' * (i % 3)}" for i in range(12)]
    hot = "  The Line That Nearly Every Document Holds \t"
    rows = [(i if i % 17 else None, "\n".join([draw.choice(pool) for _ in range(draw.randrange(6))] + [f"own line of the document {i}", hot.upper() if i % 2 else hot, "short"])) for i in range(150)]
    rows += [(5, "İstanbul İstanbul İSTANBUL"), (500, ""), (501, None), (502, "\n\n"), (503, hot), (503, hot), (504, hot + "\n" + hot), (505, "é" * 19), (506, "é" * 20), (507, "É" * 20), (508, "é" * 20), (509, "é" * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS doc", "2 AS pos", "3 AS `row`", "4 AS n_lines", "5 AS keep")
    want = kept_of(rows)
    assert sum(r[2] for r in want) > 200
    assert deduped(df.repartition(7)) == want
    few = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert deduped(df.repartition(3), min_chars=5, min_docs=2) == kept_of(rows, 5, 2)
        assert deduped(df, min_docs=5) == kept_of(rows, min_docs=5)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", few)
    both = [(r.doc_id, r.text) for r in odd.collect()]
    assert deduped(odd) == kept_of(both)
    assert deduped(odd, min_chars=1, min_docs=2) == kept_of(both, 1, 2)


def test_any_cut_into_ranges_gives_the_same(spark):
    """Ranges that end anywhere within a hash or a document, and batches of any size."""
    draw = random.Random(9)
    for case in range(300):
        least = draw.choice([2, 3, 4])
        rows = sorted({(draw.randrange(4), 0, int((d := draw.randrange(7)) > 0), d, 0, draw.randrange(3)) for _ in range(draw.randrange(1, 40))}, key=lambda r: (r[0], -r[2], -r[3], r[5]))
        gone, late, seen = set(), [], []
        cuts = sorted(draw.sample(range(len(rows) + 1), min(len(rows), draw.randrange(4))))
        for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
            state, made, at = L.Ranges(least), [], a
            while at < b:
                step = draw.randrange(1, 6)
                made += list(state.take(np.array(rows[at : min(b, at + step)], np.int64)))
                at += step
            for kind, found in [*made, *state.end()]:
                found = [tuple(map(int, r)) for r in found]
                gone |= set(found) if kind == L.DROPPED else set()
                late += found if kind == L.OPEN else []
                seen += found if kind == L.SEEN else []
        docs = {h: {r[2:4] for r in seen if r[0] == h} for h in range(4)}
        gone |= {r for r in late if len(docs[r[0]]) >= least and r[2:4] != max(docs[r[0]])}
        holders = {h: {r[2:4] for r in rows if r[0] == h} for h in range(4)}
        assert gone == {r for r in rows if len(holders[r[0]]) >= least and r[2:4] != max(holders[r[0]])}, case


def test_bitmaps(spark):
    rows = [(i, f"the same line in all documents\nown {i}", "en", "a", 0) for i in range(4)]
    got = {r.doc: r for r in L.keep_bitmaps(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[3].keep is None and [L.unpack_bits(got[i].keep, 2).tolist() for i in range(3)] == [[False, True]] * 3
    assert deduped(spark.createDataFrame([], DOCS)) == []


@pytest.mark.parametrize("name", ["op11_vector_codes", "op12_line_dedup"])
def test_sql_twins(spark, name):
    import oracle

    sf = "/root/testdata/sf0.001"
    assert oracle.difference(queries.queries()[name](spark, sf), oracle.connect(sf), queries.oracle_sql()[name]) is None
