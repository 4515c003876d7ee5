"""The jobs on small copies: growing input, repeated and interrupted runs, odd rows; and their queries against SQL."""

import datetime
import json
import os
import random

import oracle
import pytest
from pyspark.sql import functions as F

from jobs import catalogue_ingest as C
from jobs import queries as Q
from jobs import text_score_scan as T

SF = "/root/testdata/sf0.001"
EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
COLUMNS = {"event_idx": "event_id", "day": "unix_micros(ts) / 86400e6 - 10957", "family": "event_type", "magnitude": "value", "lat_deg": "try_cast(get_json_object(props, '$.lat') AS DOUBLE)", "lon_deg": "user_id"}
CONFIG = {"columns": COLUMNS, "grid_km": 500.0, "files_per_batch": 2}


def event(i, month=1, value=1.0, lat="10", kind="a", user=20):
    return (i, datetime.datetime(2024, month, 1 + i % 28, 12), user, kind, value, json.dumps({"lat": lat}))


def arrive(spark, rows, folder):
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def state(spark, out):
    """All that the output says, without the batches' numbers."""
    events = sorted((tuple(r) for r in C.catalogue(spark, out).drop("batch").collect()), key=str)
    counts = sorted((tuple(r) for r in C.counts(spark, out).collect()), key=str)
    bad = sorted((tuple(r) for r in C.rejected(spark, out).drop("batch").collect()), key=str)
    return events, counts, bad


ARRIVALS = [
    [event(i, 1 + i % 3) for i in range(40)] + [event(3, 1), event(5, 3, value=0.5)],
    [event(i, 1 + i % 3) for i in range(30, 60)] + [event(7, 2, value=9.0), event(7, 5)],
    [event(90, lat="none"), event(91, lat="95"), event(92, value=float("nan")), (None, *event(1)[1:]), (93, None, 1, "a", 1.0, "{}"), event(94, user=None), event(95, kind=None, value=None)],
]


def test_ingest_takes_only_what_is_new(spark, tmp_path):
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    arrive(spark, ARRIVALS[0], src)
    assert C.ingest(spark, src, out, mark, CONFIG) == {"batches": 1, "read": 42, "added": 40, "rejected": 0}
    first = state(spark, out)
    assert C.ingest(spark, src, out, mark, CONFIG) == {"batches": 0, "read": 0, "added": 0, "rejected": 0}
    assert state(spark, out) == first
    arrive(spark, ARRIVALS[1], src)
    arrive(spark, ARRIVALS[2], src)
    got = C.ingest(spark, src, out, mark, CONFIG)
    assert got == {"batches": 1, "read": 39, "added": 20 + 1 + 2 + 0, "rejected": 5}
    events, counts, bad = state(spark, out)
    assert {(e[0], e[7]) for e in events} == {(i, 202401 + i % 3) for i in range(60)} | {(7, 202405), (92, 202401), (95, 202401)}
    assert next(e[3] for e in events if e[0] == 5) == 0.5 and next(e[3] for e in events if e[:1] == (7,) and e[7] == 202402) == 1.0
    assert next(e[2:4] for e in events if e[0] == 95) == ("", None) and next(e[3] for e in events if e[0] == 92) is None
    assert sorted((b[0] is None, b[0] or 0, b[-1]) for b in bad) == [(False, 90, "no place"), (False, 91, "no place"), (False, 93, "no time"), (False, 94, "no place"), (True, 0, "no id")]
    want = {}
    for e in events:
        n, sized, top = want.get((e[7], e[6], e[2]), (0, 0, None))
        want[e[7], e[6], e[2]] = (n + 1, sized + (e[3] is not None), max((x for x in (top, e[3]) if x is not None), default=None))
    assert {c[:3]: c[3:] for c in counts} == want


def test_ingest_after_a_failure_gives_the_same(spark, tmp_path, monkeypatch):
    src = f"file://{tmp_path}/in"
    for rows in ARRIVALS:
        arrive(spark, rows, src)
    one = {**CONFIG, "files_per_batch": 1}
    C.ingest(spark, src, f"file://{tmp_path}/whole", f"file://{tmp_path}/whole-mark", one)
    real, broken = C.counted, []

    def fails(rows):
        if len(broken) < 2:
            broken.append(1)
            raise RuntimeError("an executor was lost")
        return real(rows)

    monkeypatch.setattr(C, "counted", fails)
    for _ in range(2):  # the events of the batch are written, its counts are not
        with pytest.raises(Exception, match="an executor was lost"):
            C.ingest(spark, src, f"file://{tmp_path}/out", f"file://{tmp_path}/mark", one)
    C.ingest(spark, src, f"file://{tmp_path}/out", f"file://{tmp_path}/mark", one)
    assert state(spark, f"file://{tmp_path}/out") == state(spark, f"file://{tmp_path}/whole")


def test_ingest_without_rows(spark, tmp_path):
    src, out, mark = (f"file://{tmp_path}/{x}" for x in ("in", "out", "mark"))
    arrive(spark, [], src)
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    C.ingest(spark, src, out, mark, CONFIG)
    assert state(spark, out) == ([], [], [])
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SCAN = {"label": "toxic", "match": ["lang", "source"], "nearest": "n_chars", "controls": 2, "permutations": 50, "seed": 7, "rate": 0.05, "features": {"n_chars": {"family": "size", "sql": "length(text)"}, "loud": {"family": "style", "sql": "length(regexp_replace(text, '[^!]', ''))"}, "flat": {"family": "style", "sql": "1"}}}


def corpus(n=120):
    draw = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        toxic = draw.random() < 0.3
        text = "x" * draw.randrange(30) + "!" * (draw.randrange(3) + 4 * toxic)
        rows.append((i, text, draw.choice(["en", "en", "de", None]), draw.choice(["a", "b"]), 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def pairs_of(rows, labels, k):
    """case id -> its controls' ids, by a loop over the sorted documents."""
    toxic = {}
    for i, _, t in labels:
        if i is not None and t is not None:
            toxic[i] = max(t, toxic.get(i, 0))
    placed = sorted((lang or "", source or "", len(text or ""), i) for i, text, lang, source, _ in rows if i in toxic)
    out = {}
    for at, (lang, source, size, i) in enumerate(placed):
        if toxic[i]:
            near = [p for p in placed[:at] if not toxic[p[3]]][-k:] + [p for p in placed[at:] if not toxic[p[3]]][:k]
            near = sorted((abs(p[2] - size), p[3]) for p in near if p[:2] == (lang, source))[:k]
            if near:
                out[i] = [p[1] for p in near]
    return out


def run_scan(spark, rows, labels, at, config=SCAN):
    spark.createDataFrame(rows, DOCS).selectExpr("*", "'clash' AS label", "1 AS stratum", "2 AS words", "true AS is_case").write.mode("overwrite").parquet(f"{at}/documents")
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.mode("overwrite").parquet(f"{at}/labels")
    done = T.scan(spark, f"{at}/documents", f"{at}/labels", f"{at}/out", config)
    design = {}
    kinds = "stratum long, row_idx int, doc_id long, is_case boolean"
    for r in spark.read.schema(kinds).parquet(f"{at}/out/design").orderBy("stratum", "row_idx").collect():
        design.setdefault(r.stratum, []).append((r.doc_id, r.is_case))
    return done, design, sorted((r.asDict() for r in T.result(spark, f"{at}/out").collect()), key=str)


def test_scan_matches_by_length_and_finds_what_differs(spark, tmp_path):
    rows, labels = corpus()
    at = f"file://{tmp_path}"
    done, design, found = run_scan(spark, rows, labels, at)
    want = pairs_of(rows, labels, 2)
    assert {d[0][0]: [c for c, _ in d[1:]] for d in design.values()} == want
    assert all(d[0][1] and not any(case for _, case in d[1:]) for d in design.values())
    assert {r["feature"]: r["survives"] for r in found} == {"loud": True, "n_chars": found[0]["survives"] if found[0]["feature"] == "n_chars" else found[1]["survives"]}
    loud = next(r for r in found if r["feature"] == "loud")
    assert loud["z"] > 4 and loud["p"] == pytest.approx(1 / 51) and loud["perms"] == 50
    texts = {r[0]: r[1] for r in rows}
    count = lambda i: texts[i].count("!")
    u = v = 0.0
    for case, controls in want.items():
        x = [count(case), *map(count, controls)]
        mean = sum(x) / len(x)
        u, v = u + x[0] - mean, v + sum((y - mean) ** 2 for y in x) / len(x)
    assert loud["z"] == pytest.approx(u / v**0.5)
    assert os.path.exists(f"{tmp_path}/out/scan/family=style")
    assert run_scan(spark, rows, labels, at) == (done, design, found)


def test_scan_with_odd_rows(spark, tmp_path):
    rows, labels = corpus(40)
    odd = [(None, "null id", "en", "a", 1), (200, None, None, None, None), (201, "", "en", "a", 0), (1, rows[1][1], *rows[1][2:]), (202, "no label!!", "en", "a", 1), (203, "y" * 200_000, "en", "a", 1)]
    more = [(200, 0, 1), (201, 0, 0), (203, 0, 1), (203, 1, 0), (None, 1, 1), (2, 0, None), (999, 1, 1)]
    _, design, _ = run_scan(spark, rows + odd, labels + more, f"file://{tmp_path}")
    assert {d[0][0]: [c for c, _ in d[1:]] for d in design.values()} == pairs_of(rows + odd, labels + more, 2)
    for docs, marks in (([], []), (rows, []), (rows, [(i, 1, 0) for i in range(40)]), (rows, [(i, 1, 1) for i in range(40)])):
        _, design, found = run_scan(spark, docs, marks, f"file://{tmp_path}")
        assert design == {} and found == []


def test_only_labelled_texts_are_measured(spark, monkeypatch):
    rows, labels = corpus(20)
    docs = spark.createDataFrame([*rows, (500, "unlabelled", "en", "a", 1), (501, "of null label", "en", "a", 1)], DOCS)
    marks = spark.createDataFrame([*labels, (501, 1, None)], "doc_id long, quality long, toxic long")
    size = {"n_chars": {"family": "size", "sql": "length(text)"}}
    careful = {"n_chars": {"family": "size", "sql": "if(text in ('unlabelled', 'of null label'), raise_error('measured'), length(text))"}}
    few = sorted(T.measured(docs, marks, SCAN | {"features": careful}).collect())
    assert few == sorted(T.measured(docs, marks, SCAN | {"features": size}).collect())
    monkeypatch.setattr(T, "MOST_LABELLED", 0)
    assert few == sorted(T.measured(docs, marks, SCAN | {"features": size}).collect())


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_queries(spark, name):
    assert oracle.difference(Q.QUERIES[name](spark, SF), oracle.connect(SF), Q.SQL[name]) is None


def test_command_lines(spark, tmp_path, monkeypatch):
    """The command line reads the config beside the job and hands over plain paths; the session is the caller's here."""
    from pyspark.sql import SparkSession

    monkeypatch.setattr(SparkSession, "stop", lambda self: None)
    here = os.path.dirname(C.__file__)
    src = f"file://{tmp_path}/events"
    spark.read.parquet(f"{SF}/events.parquet").where("event_id < 50").write.parquet(src)
    C.main(["--input", src, "--output", f"file://{tmp_path}/o", "--checkpoint", f"file://{tmp_path}/c", "--config", f"{here}/catalogue_ingest.json"])
    assert C.catalogue(spark, f"file://{tmp_path}/o").count() == spark.read.parquet(src).where(F.col("event_id").isNotNull()).count()
    T.main(["--documents", f"{SF}/documents.parquet", "--labels", f"{SF}/labels.parquet", "--output", f"file://{tmp_path}/s", "--config", f"{here}/text_score_scan.json"])
    assert T.result(spark, f"file://{tmp_path}/s").count() > 0
