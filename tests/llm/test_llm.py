"""The ten operators against brute force, exact round trips and held-out accuracy, and on odd tables."""

import hashlib
import io
import math
import random
import re
import zipfile
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tremorlake.llm import common, cross_parse, decontaminate, pii, ppm, sentencepiece_codec, simhash, spotsigs, token_counts, toxicity, warc_zip

SYLLABLES = {"en": "the of an er on th ing re nd es".split(), "de": "der die sch ein ich ge ung en ber chen".split()}


def words(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


# 6 SimHash


def test_golay_code():
    patterns, counts = simhash.error_patterns()
    assert set(counts.tolist()) == {1, 6} and (counts == 1).sum() == 277
    r = np.random.default_rng(0)
    x = r.integers(0, 1 << 23, 2000)
    for flips in (1, 2):
        y = x.copy()
        for row in range(len(y)):
            for b in r.choice(23, flips, replace=False):
                y[row] ^= 1 << int(b)
        (a, na), (b, nb) = simhash.segment_keys(x), simhash.segment_keys(y)
        assert all(set(a[i, : na[i]]) & set(b[i, : nb[i]]) for i in range(len(x)))


def test_every_linked_pair_shares_a_key():
    r = random.Random(1)
    for flips in range(5):
        x = np.array([r.getrandbits(64) for _ in range(1500)], np.uint64)
        y = np.array([int(v) ^ sum(1 << b for b in r.sample(range(64), flips)) for v in x], np.uint64)
        pairs = [set(zip(*(a.tolist() for a in simhash.bucket_keys(v.view(np.int64))))) for v in (x, y)]
        assert {row for row, _ in pairs[0] & pairs[1]} == set(range(1500))


def brute_fingerprint(text):
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum((2 * sum((x >> b) & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(prints, ids):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    groups = {}
    for i, d in enumerate(ids):
        groups.setdefault(find(i), []).append(d)
    return {d: min(g) for g in groups.values() for d in g}


def test_near_duplicates_against_brute_force(spark):
    r = random.Random(4)
    texts = [words(r, "en", r.randint(0, 40)) for _ in range(60)]
    for i in range(40):
        w = texts[i % 10].split()
        if len(w) > 5:
            w[r.randrange(len(w))] = "changed"
        texts.append(" ".join(w) if i % 3 else texts[i % 10].upper())
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    r.shuffle(rows)
    got = {x.doc_id: (x.fp % 2**64, x.component_id) for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: brute_fingerprint(t) for i, t in rows} == {i: p for i, (p, _) in got.items()}
    ids = [i for i, _ in rows]
    assert brute_components([got[i][0] for i in ids], ids) == {i: c for i, (_, c) in got.items()}


def test_chains_of_links(spark):
    """Fingerprints that link only through others, and a dense ball around one, come out as one component each."""
    r = random.Random(9)
    base, ball = r.getrandbits(64), r.getrandbits(64)
    chain = [base ^ sum(1 << b for b in range(4 * k)) for k in range(12)]
    dense = [ball ^ sum(1 << b for b in r.sample(range(64), 3)) for _ in range(80)]
    alone = [r.getrandbits(64) for _ in range(200)]
    prints = list(dict.fromkeys([*chain, *dense, *alone]))
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    got = {x.fp % 2**64: x.root for x in simhash.linked(spark.createDataFrame(signed, "fp long")).collect()}
    want = brute_components(prints, prints)
    assert len(got) == len(prints)
    same = {}
    for p in prints:
        same.setdefault(got[p], set()).add(want[p])
    assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(want.values()))


def test_buckets_larger_than_a_run(spark, monkeypatch):
    """Buckets of more than RUN members, and ranges that cut buckets, lose no link: exact components of a dense ball and chains."""
    monkeypatch.setattr(simhash, "by_range", lambda rows, key, member, n: rows.repartitionByRange(23, key, member).sortWithinPartitions(key, member))
    r = random.Random(12)
    ball = r.getrandbits(64)
    prints = {ball ^ sum(1 << b for b in r.sample(range(64), r.choice([3, 4, 5, 6]))) for _ in range(700)}
    prints |= {r.getrandbits(64) for _ in range(100)}
    prints = sorted(prints)
    want = brute_components(prints, prints)
    df = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in prints], "fp long")
    for most in (simhash.RUN, 5):
        got = {x.fp % 2**64: x.root for x in simhash.linked(df, most).collect()}
        same = {}
        for p in prints:
            same.setdefault(got[p], set()).add(want[p])
        assert all(len(v) == 1 for v in same.values()) and len(same) == len(set(want.values())) < len(prints) - 100


def test_rows_of_one_id_are_judged_by_their_own_texts(spark):
    r = random.Random(3)
    a, b, c = (words(r, "en", 60) for _ in range(3))
    rows = [(1, a), (1, b), (2, a + " more"), (None, c), (None, c), (3, c), (4, None), (5, " ")]
    kept = {(x.doc_id, x.text) for x in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {(1, a), (1, b), (3, c), (4, None)}


def test_one_of_each(spark):
    r = random.Random(2)
    a, b = words(r, "en", 50), words(r, "en", 50)
    df = spark.createDataFrame([(5, a, 1), (3, a, 2), (9, b, 3), (9, b, 4), (11, a.upper(), 5)], "doc_id long, text string, extra int")
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and sorted(x.doc_id for x in kept.collect()) == [3, 9]


# 10 PPM


def brute_ppm(train, text, order, share):
    total = sum(len(t) + 1 for t in train)
    seen = {}
    for t in train:
        s = [ppm.START] * order + list(t) + [ppm.END]
        for i in range(order, len(s)):
            for j in range(order + 1):
                seen.setdefault(tuple(s[i - j : i]), Counter())[s[i]] += 1
    nodes = {c: n for c, n in seen.items() if not c or sum(n.values()) >= share * total}

    def prob(context, x, excluded):
        if context is None:
            return 1 / (257 - len(excluded))
        n = {k: v for k, v in nodes.get(context, {}).items() if k not in excluded}
        below = context[1:] if context else None
        if not n:
            return prob(below, x, excluded)
        d, whole = len(n), sum(n.values()) + len(n)
        return n[x] / whole if x in n else d / whole * prob(below, x, excluded | set(n))

    s, out = [ppm.START] * order + list(text) + [ppm.END], 0.0
    for i in range(order, len(s)):
        c = next(tuple(s[i - j : i]) for j in range(order, -1, -1) if tuple(s[i - j : i]) in nodes or j == 0)
        out += math.log10(prob(c, s[i], set()))
    return out


@pytest.mark.parametrize("share", [0.0, 0.01])
def test_ppm_against_brute_force(spark, share):
    r = random.Random(7)
    rows = [(i, words(r, "en", r.randint(0, 30)) + r.choice(["", " ÄÖ", "."])) for i in range(40)] + [(40, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    train = common.crc_mod(F.col("doc_id"), 10) != 0
    got = {x.doc_id: x for x in ppm.score(df, train, order=3, share=share).collect()}
    learned = [(t or "").encode() for i, t in rows if common.crc_mod_py(i, 10)]
    c = Counter(w for t in learned for w in t.lower().split())
    c[None] = len(learned)
    n, v = sum(c.values()), len(c)
    for i, t in rows:
        b = (t or "").encode()
        tokens = [*b.lower().split(), None]
        assert abs(got[i].score - brute_ppm(learned, b, 3, share)) < 1e-3 * (1 + len(b))
        assert abs(got[i].base_score - sum(math.log10((c.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)) < 1e-8
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(w in c for w in tokens), n)


def test_ppm_keeps_rare_contexts_of_large_corpora(spark):
    """Contexts that stand before less than 2^-16 of all training symbols count too."""
    r = random.Random(11)
    rows = [(0, "zqxjkv wvbzqj"), (1, "zqxjkv wvbzqj")] + [(i, words(r, "en", 60)) for i in range(2, 700)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.score for x in ppm.score(df, F.lit(True)).collect()}
    learned = [t.encode() for _, t in rows]
    assert sum(map(len, learned)) > 3 * 2**16 and len(got) == len(rows)
    for i in (0, 1, 5):
        assert abs(got[i] - brute_ppm(learned, rows[i][1].encode(), ppm.ORDER, 0.0)) < 1e-3 * (1 + len(rows[i][1]))


@pytest.mark.parametrize("order", [3, 5])
def test_ppm_hot_endings_against_brute_force(spark, monkeypatch, order):
    """Endings of two and more symbols are taken apart into tasks; the scores stay those of the whole trie."""
    monkeypatch.setattr(ppm, "HOT", 0.05)
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 300)
    r = random.Random(5)
    rows = [(i, "".join("th" + r.choice("eaionr ") for _ in range(r.randint(0, 25))) + r.choice(["", "e cat", "Ä."])) for i in range(60)] + [(60, None), (61, "the" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = ppm._hot_endings
    seen = []
    monkeypatch.setattr(ppm, "_hot_endings", lambda *a: seen.append(found(*a)) or seen[-1])
    got = {x.doc_id: x.score for x in ppm.score(df, common.crc_mod(F.col("doc_id"), 10) != 0, order=order).collect()}
    assert len(seen[0]) == order - 2 and (ord("t") << 9) + ord("h") in seen[0][0].endings.tolist()
    learned = [(t or "").encode() for i, t in rows if common.crc_mod_py(i, 10)]
    for i, t in rows:
        b = (t or "").encode()
        assert abs(got[i] - brute_ppm(learned, b, order, 0.0)) < 1e-3 * (1 + len(b))


def test_ppm_hot_ending_is_shared_out(spark):
    """A fifth of all windows end in the same two symbols: no task has more than a few times its even share."""
    r = random.Random(6)
    text = "".join("".join(r.choices("abcdefghijklmnop", k=3)) + "zz" for _ in range(60_000))
    buckets = 64
    passed = common.table(ppm._block_pass(spark.createDataFrame([(1, text, True)], "id long, text string, train boolean"), 5, buckets), "counts")
    short = np.zeros(1 << 18, np.int64)
    for x in passed.where("kind = 3").collect():
        short[x.gram] = x.n
    hot = ppm._hot_endings(passed.where("kind = 0"), 5, buckets, short)
    keys = np.unique(ppm.windows([text.encode()], 5))
    before, after = np.bincount(ppm.bucket_of(keys, buckets)), np.bincount(ppm.place_of(keys, buckets, hot) % (2 * buckets))
    share = len(keys) / buckets
    assert before.max() > 10 * share and after.max() < 4 * share and after.sum() == len(keys)


def test_ppm_probabilities_sum_to_one():
    model = ppm.Model({(): {97: 5, 98: 2, ppm.END: 1}, (97,): {98: 2}, (98,): {ppm.END: 1, 97: 1}}, 1)
    for s in range(model.cost.shape[0]):
        total = sum(10 ** float(model.cost[s, model.classes[x]]) for x in range(257))
        assert abs(total - 1) < 1e-5


def test_ppm_without_training(spark):
    df = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    x = ppm.score(df, F.lit(False)).first()
    assert abs(x.score - 4 * math.log10(1 / 257)) < 1e-5 and x.n_known == 0 and x.train_tokens == 0 and abs(x.base_score) < 1e-12


# 9 and 3 tokens

TEXTS = ["", " ", "Hello  world", "it's we're I'M", "a\n\n b\t\tc  ", "<|endoftext|>x<|endoftext|>", "ünïcode 東京 \U0001f600\U0001f1e9", "12345 67,890.12", "x" * 500, "  leading", "trailing  ", " nbsp line", "٣٤ ½ Ⅷ", "<s> </s> ▁ ▁▁x"]


def test_token_counts_parity(spark, monkeypatch):
    """Equal to the library on whole texts, over several blocks and partitions; each distinct pre-token is encoded once."""
    from tokenizers import Tokenizer

    path = token_counts.tokenizer_path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("abc '\n\t.,;0159éß東́‍") for _ in range(80)) for _ in range(300)] + [words(r, "en", 3000), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {x.doc_id: x for x in token_counts.token_counts(df).collect()}
    for i, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512), t
    asked = token_counts.frequencies(df, "byte_bpe_50k.json", 8).where("tokens is not null").select("bucket", "tokens").collect()
    tokens = {(w, x.bucket) for x in asked for w in pa.ipc.open_stream(x.tokens).read_all().column(0).to_pylist()}
    split = token_counts.pre_tokens(path).split
    assert sorted(w for w, _ in tokens) == sorted({w for t in texts for w in split(t or "")[0]})  # no token is in two buckets


def test_sentencepiece_parity():
    path = sentencepiece_codec.model_path("piece_bpe_32k.model")
    codec = sentencepiece_codec.build(path)
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("abcdetion  the\n.,0159éß東́") for _ in range(120)) for _ in range(300)]
    assert codec.verify(path, texts) == []
    broken = np.array([3 + 0xC3, 3 + 0x28, 300], "<i4")
    assert codec.decode([broken]) == [codec.tokenizer.decode(broken.tolist(), skip_special_tokens=False)]


def test_unigram_models_are_read(tmp_path):
    """A hand-made unigram model file, as the format has it, gives sentencepiece's own ids."""
    import struct

    def field(n, v):
        tag = lambda k: bytes([n << 3 | k]) if n < 16 else bytes([(n << 3 | k) & 127 | 128, n >> 4])
        if isinstance(v, bytes):
            return tag(2) + bytes([len(v)]) + v if len(v) < 128 else tag(2) + bytes([len(v) & 127 | 128, len(v) >> 7]) + v
        return tag(5) + struct.pack("<f", v) if isinstance(v, float) else tag(0) + bytes([v])

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("▁a", -1.5, 1), ("a", -3.0, 1), ("b", -3.0, 1), ("ab", -2.5, 1), ("▁ab", -2.2, 1)]
    data = b"".join(field(1, field(1, p.encode()) + field(2, s) + field(3, k)) for p, s, k in pieces)
    data += field(2, field(3, 1) + field(40, 0) + field(41, 1) + field(42, 2)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 1) + field(5, 1))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    codec = sentencepiece_codec.Codec(str(path))
    import sentencepiece

    theirs = sentencepiece.SentencePieceProcessor(model_file=str(path))
    for t in ("ab a b", "  abab  a ", "", "ba"):
        assert codec.encode([t])[0].tolist() == theirs.encode(t)


def test_unigram_of_a_whole_vocabulary(tmp_path):
    """The 32,000 pieces of the public model as a unigram model with byte fallback, on whole documents: sentencepiece's own ids
    and texts. No tokenizer is trained: the scores are a rule."""
    import glob
    import struct

    import pyarrow.parquet as pq

    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    def field(n, v):
        if isinstance(v, bytes):
            return varint(n << 3 | 2) + varint(len(v)) + v
        return varint(n << 3 | 5) + struct.pack("<f", v) if isinstance(v, float) else varint(n << 3) + varint(v)

    with open(sentencepiece_codec.model_path("piece_bpe_32k.model"), "rb") as f:
        spec = sentencepiece_codec.Spec(f.read())
    pieces = [(p, 0.0 if kind != 1 else round((-4.0 - 1.7 * math.log(i + 1)) * 256) / 256, kind) for i, (p, _, kind) in enumerate(spec.pieces)]  # sums are exact
    data = b"".join(field(1, field(1, p.encode()) + field(2, float(np.float32(x))) + field(3, kind)) for p, x, kind in pieces)
    data += field(2, field(3, 1) + field(35, 1)) + field(3, field(1, b"identity") + field(3, 1) + field(4, 0) + field(5, 1))
    path = tmp_path / "u.model"
    path.write_bytes(data)
    codec = sentencepiece_codec.Codec(str(path))
    r = random.Random(2)
    texts = TEXTS + [words(r, "en", 400)]
    for at in sorted(glob.glob("/root/testdata/sf0.001/documents.parquet")):
        texts += [t for t in pq.read_table(at).column("text").to_pylist() if t]
    wrong = codec.verify(str(path), texts)
    assert wrong == [] and len(texts) > 14, [texts[i][:80] for i in wrong[:3]]


# 5 WARC


def test_zip_round_trip(spark, tmp_path):
    long = "<html>" + "y" * 1200
    rows = [(1, "http://a", long), (2, "http://b", long), (3, None, "short"), (4, "http://d", "short"), (5, "http://e", None), (None, "http://f", "x"), (6, "http://g\n x", long), (7, "http://h", "ü" * 600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for zip64 in (False, True):
        packages = warc_zip.write(df.repartition(2), f"file://{tmp_path}/{zip64}", zip64=zip64)
        got = {r.page_id: r for r in warc_zip.read(packages, payloads=True).collect()}
        assert len(got) == 8 and [got[i].refers_to for i in (1, 2, 6)] == [6, 6, None]
        assert [got[i].record_type for i in (1, 2, 3, 4, 6, 7)] == ["revisit", "revisit", "response", "response", "response", "response"]
        for i, _, html in rows:
            b = (html or "").encode()
            assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), hashlib.sha1(b).hexdigest())
            assert bytes(got[i].payload) == (b"" if got[i].record_type == "revisit" else b)
        for r in packages.where("n > 0").collect():
            with zipfile.ZipFile(r.path.removeprefix("file://")) as z:
                assert z.testzip() is None and z.namelist() == [warc_zip.DATA, warc_zip.INDEX]
                assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_reader_takes_other_writers_files():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("archive/data.warc.gz", b"12345")
        z.writestr("packed.txt", "z" * 100, zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 inside"
    r = warc_zip.ZipReader(b, len(b.getvalue()))
    at, n = r.locate("archive/data.warc.gz")
    assert r.range(at, n) == b"12345"
    with pytest.raises(ValueError):
        r.locate("packed.txt")
    with pytest.raises(ValueError):
        warc_zip.ZipReader(io.BytesIO(b"nothing"), 7)


# 7 SpotSigs


def brute_signatures(text):
    w = [x for x in re.sub(r"[^\w]|_", " ", text.lower()).split() if x]
    content = [x for x in w if x not in spotsigs.ANCHORS]
    out, k = set(), 0
    if content:
        out.add(("", *content[: spotsigs.CHAIN]))
    for p, x in enumerate(w):
        if x in spotsigs.ANCHORS:
            out.add((x, *content[p - k : p - k + spotsigs.CHAIN]))
            k += 1
    return out


def test_spotsigs_against_brute_force(spark):
    r = random.Random(5)
    texts = [words(r, "en", r.randint(0, 60)) for _ in range(30)] + ["", None, "the of", "word"]
    rows = [(i * 700, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {x.doc_id: x for x in spotsigs.edited_fingerprints(df).collect()}
    plain = [t or "" for t in texts]
    for i, t in enumerate(plain):
        n, nxt = len(t), plain[(i + 1) % len(plain)]
        edited = t[: n - n // 2] + nxt[: n // 2]
        x = got[i * 700]
        assert x.n_chars == n and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = map(brute_signatures, (t, edited, nxt))
        like = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
        assert abs(x.near_edited - like(a, b)) < 1e-12 and abs(x.near_next - like(a, c)) < 1e-12
    assert got[0].fingerprint != got[700].fingerprint


@pytest.mark.parametrize("kind", ["dense", "spread", "null", "equal"])
def test_spotsigs_next_row(spark, monkeypatch, kind):
    """Dense ids, random 64-bit ids, null ids and equal rows: each row has one successor, and blocks are full whatever the ids."""
    monkeypatch.setattr(spotsigs, "BLOCK_BITS", 3)
    r = random.Random(8)
    ids = {"dense": range(300), "spread": [r.getrandbits(64) - 2**63 for _ in range(300)], "null": [None] * 200 + list(range(100)), "equal": [5] * 300}[kind]
    rows = [(i, "same" if kind == "equal" else f"text {k}") for k, i in enumerate(ids)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, text string").repartition(7)
    got = [x for x in spotsigs.with_next(df, {"size": F.length("text")}).collect() for _ in range(x.n)]
    assert sorted(((x.id is not None, x.id or 0), x.text) for x in got) == sorted(((i is not None, i or 0), t) for i, t in rows)
    assert Counter(x.next_text for x in got) == Counter(t for _, t in rows) and all(x.next_size == len(x.next_text) for x in got)
    if kind in ("dense", "spread"):
        by = sorted(rows)
        follows = {t: by[(k + 1) % len(by)][1] for k, (_, t) in enumerate(by)}
        assert all(x.next_text == follows[x.text] for x in got)
    elif kind == "null":
        order, at = {x.text: x.next_text for x in got}, rows[0][1]
        for n in range(1, len(rows) + 1):  # one ring through all rows
            at = order[at]
            assert (at == rows[0][1]) == (n == len(rows))


def test_spotsigs_pairs(spark):
    r = random.Random(6)
    base = words(r, "en", 400)
    near = " ".join([*base.split()[:200], *["other"] * 25, *base.split()[225:]])
    assert 0.6 <= len(brute_signatures(base) & brute_signatures(near)) / len(brute_signatures(base) | brute_signatures(near)) < 1
    df = spark.createDataFrame([(1, base), (2, near), (3, words(r, "en", 400)), (4, base), (5, None)], "doc_id long, text string")
    pairs, members = spotsigs.near_pairs(df, 0.6)
    m = {x.doc_id: x.fingerprint for x in members.collect()}
    sets = {i: brute_signatures(t or "") for i, t in ((1, base), (2, near))}
    got = pairs.collect()
    assert m[1] == m[4] and len(got) == 1 and {got[0].a, got[0].b} == {m[1], m[2]}
    assert abs(got[0].jaccard - len(sets[1] & sets[2]) / len(sets[1] | sets[2])) < 1e-12


# 8 language


def brute_phrases(train, text):
    """Longest matches from left to right."""
    n = at = 0
    while at < len(text):
        k = at + 1
        while k <= len(text) and text[at:k] in train:
            k += 1
        at = max(at + 1, k - 1)
        n += 1
    return n


def same_phrases(samples, texts):
    p = cross_parse.Parser(samples)
    norm = lambda t: "".join(map(chr, cross_parse.normalised(t)))
    n, sizes = p.phrases(texts)
    for i, t in enumerate(texts):
        assert n[i].tolist() == [brute_phrases(norm(samples[k]), norm(t)) if sizes[i] else 0 for k in p.langs]
    return p


@pytest.mark.parametrize("dense", [1, cross_parse.DENSE])
def test_cross_parsing_against_brute_force(monkeypatch, dense):
    """Short and long texts, copies of the training text, unknown letters; with tables and without."""
    monkeypatch.setattr(cross_parse, "DENSE", dense)
    r = random.Random(8)
    samples = {"en": words(r, "en", 300), "de": words(r, "de", 200)}
    texts = [words(r, r.choice(["en", "de"]), r.choice([3, 60, 1500])) for _ in range(20)] + ["zzz", "A!!b", "ß Ä qqq", "", "12", "x" * 3000, samples["en"] * 3, samples["de"] + samples["en"]]
    assert max(map(len, texts)) > 5000
    same_phrases(samples, texts)


@pytest.mark.parametrize("block", [3, 7, 50])
def test_cross_parsing_in_short_blocks(monkeypatch, block):
    monkeypatch.setattr(cross_parse, "BLOCK", block)
    r = random.Random(block)
    for _ in range(25):
        samples = {"a": "".join(r.choice("ab ") for _ in range(r.randint(1, 60))), "b": "".join(r.choice("abc") for _ in range(r.randint(1, 80)))}
        same_phrases(samples, ["".join(r.choice("abcd ") if r.random() < 0.1 else r.choice("ab") for _ in range(r.randint(0, 200))) for _ in range(6)] + [samples["a"] * 4, samples["b"] * 3 + "zz" + samples["a"]])


def test_three_large_alphabets():
    r = random.Random(4)
    samples = {f"l{j}": "".join(chr(0x4E00 + 6500 * j + r.randrange(6000)) for _ in range(24_000)) for j in range(3)}
    texts = [samples["l1"][5000:9000] + "".join(chr(0x4E00 + 6500 + r.randrange(6000)) for _ in range(2000)), samples["l2"][:50]]
    assert same_phrases(samples, texts).predict(texts)[0] == ["l1", "l2"]


def test_little_training_text_is_no_disadvantage():
    """Of two languages of one kind, that with a tenth of the other's training text still wins its own texts."""
    r = random.Random(3)
    p = cross_parse.Parser({"en": words(r, "en", 3000), "de": words(r, "de", 300)})
    texts = [words(r, "de", 40) for _ in range(100)] + [words(r, "en", 40) for _ in range(100)]
    got = p.predict(texts)[0]
    assert got[:100].count("de") >= 97 and got[100:].count("en") >= 97


def test_language_held_out(spark):
    r = random.Random(1)
    rows = [(i, words(r, k, 30), k) for i in range(200) for k in [r.choice(["en", "de"])]] + [(200, "123 !!", "en"), (201, None, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = common.crc_mod(F.col("doc_id"), 4) == 2
    got = {x.doc_id: x for x in cross_parse.identify(df, ~held).collect()}
    assert got[200].lang_pred == got[201].lang_pred == "und"
    test = [(i, k) for i, _, k in rows[:200] if common.crc_mod_py(i, 4) == 2]
    assert sum(got[i].lang_pred == k for i, k in test) >= 0.97 * len(test) and len(test) > 20


# 4 personal data


def brute_base(text):
    out = []
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    for k, (name, pattern) in enumerate(kinds.items()):
        for m in re.finditer(pattern, text):
            d = re.sub(r"\D", "", m[0])
            if name == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if name == "card":
                digits = [int(x) for x in d[::-1]]
                if not 12 <= len(d) <= 19 or sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(digits)) % 10:
                    continue
            if name == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_against_the_patterns():
    r = random.Random(12)
    alphabet = "0123456789..@@  --+()aZ_%é\n"
    for _ in range(4000):
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
        assert pii.base_spans(t) == brute_base(t), t
    for _ in range(1500):
        t = " ".join(r.choice(["4111 1111 1111 1111", "4111111111111111", "1.2.3.4", "1.2.3.4.5", "256.1.1.1", "a.b@c.d.e", "x@y@z.com", "+1 (212) 555-0100", "+49-30-123456", "12", "@"]) for _ in range(r.randint(1, 5)))
        assert pii.base_spans(t) == brute_base(t), t


def brute_decode(model, text):
    """All segmentations of a short text."""
    lattice = pii.Lattice(text, 0, len(text))
    n = len(lattice.places) - 1

    def best(j, before_entity):
        if j == 0:
            return (0.0, []) if not before_entity else (-math.inf, [])
        if not before_entity:
            return max((best(j - 1, b) for b in (False, True)), key=lambda x: x[0])
        options = [(-math.inf, [])]
        for i, f, kinds in lattice.ends[j]:
            for k in kinds:
                for b in (False, True):
                    v, spans = best(i, b)
                    options.append((v + model.score(f, k) + (model.weights.get(("after", k), 0.0) if b else 0.0), [*spans, (lattice.places[i], k, lattice.places[j])]))
        return max(options, key=lambda x: x[0])

    return max(best(n, False), best(n, True), key=lambda x: x[0])[1]


def test_long_tables_of_figures_are_decoded_in_bounded_memory():
    import tracemalloc

    model, r = pii.trained(), random.Random(4)
    text = "\n".join(" ".join(f"{r.randrange(10**4)}.{r.randrange(100)}" for _ in range(8)) for _ in range(1500))
    tracemalloc.start()
    pii.find(text, model)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(text) > 80_000 and peak < 100 * len(text)


def test_span_model():
    model = pii.trained()
    data = pii.sentences(300, seed=77)
    hit = sum(set(model.decode(t, 0, len(t))) == gold for t, gold in data)
    assert hit >= 0.97 * len(data)
    for t, _ in [x for x in data if len(x[0]) < 40][:15]:
        assert model.decode(t, 0, len(t)) == brute_decode(model, t)
    base, spans = pii.find("write to jo.doe [at] mail [dot] example [dot] com or call (212) 555-0100 today", model)
    assert base == [] and [k for _, k, _ in spans] == [0, 3]
    assert pii.redacted("a b@c.de f", pii.find("a b@c.de f", model)[1]) == "a [EMAIL] f"


def log_likelihood(model, text, gold):
    """Over all segmentations, by brute force."""
    lattice = pii.Lattice(text, 0, len(text))
    n = len(lattice.places) - 1
    weights = {}

    def walk(i, before, score, spans):
        if i == n:
            weights[frozenset(spans)] = score
            return
        walk(i + 1, False, score, spans)
        for j in range(i + 1, n + 1):
            for at, f, kinds in lattice.ends[j]:
                if at == i:
                    for k in kinds:
                        walk(j, True, score + model.score(f, k) + (model.weights.get(("after", k), 0.0) if before else 0.0), [*spans, (lattice.places[i], k, lattice.places[j])])

    walk(0, False, 0.0, [])
    return weights[frozenset(gold)] - math.log(sum(map(math.exp, weights.values())))


def test_gradient_is_that_of_the_likelihood():
    r = random.Random(3)
    text, gold = "a 10.0.0.1+4915112345678 b", {(2, 1, 10), (10, 3, 24)}
    model, lattice = pii.Model(), pii.Lattice(text, 0, len(text))
    for x in {y for ends in lattice.ends for _, f, kinds in ends for k in kinds for y in [*((z, k) for z in f), ("bias", k), ("after", k)]}:
        model.weights[x] = r.uniform(-0.3, 0.3)
    g = model.gradient(lattice, gold)
    for key in sorted(model.weights, key=str)[::7] + [("after", 3), ("bias", 1), ("after", 1)]:
        at, step = model.weights[key], 1e-5
        model.weights[key] = at + step
        high = log_likelihood(model, text, gold)
        model.weights[key] = at - step
        low = log_likelihood(model, text, gold)
        model.weights[key] = at
        assert abs((high - low) / (2 * step) - g.get(key, 0.0)) < 1e-5, key


def test_stretches_give_what_the_whole_text_gives():
    model, r = pii.trained(), random.Random(3)
    data = pii.sentences(200, seed=5)
    for _ in range(60):
        t = (" " + words(r, "en", 40) + " ").join(r.choice(data)[0] for _ in range(5))
        assert [e for a, b in pii.windows(t) for e in model.decode(t, a, b)] == model.decode(t, 0, len(t))
    t = "x" * 70 + " [at] example [dot] com"
    assert pii.find(t, model)[1] == [(0, 0, len(t))]
    for t in ("567.89 12345678901", "order 1234567890 shipped", "1234567812345678 units"):
        assert pii.find(t, model)[1] == []


# 1 toxicity


def toxic_rows(n, seed):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        w = words(r, "en", r.randint(5, 60)).split()
        bad = r.random() < 0.3
        if bad:
            for _ in range(r.randint(1, 3)):
                w.insert(r.randrange(len(w)), r.choice(["badword", "vilestem" + r.choice("abcdefgh") + "x"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_held_out(spark):
    rows, labels = toxic_rows(900, 3)
    docs, lab = spark.createDataFrame([*rows, (900, ""), (901, None)], "doc_id long, text string"), spark.createDataFrame([*labels, (5000, 1), (None, 1)], "doc_id long, toxic int")
    machine = toxicity.train(docs, lab.where(common.crc_mod(F.col("doc_id"), 5) != 0))
    got = {x.doc_id: x.score for x in toxicity.toxicity(docs, machine).collect()}
    held = [(i, y) for i, y in labels if common.crc_mod_py(i, 5) == 0]
    assert sum((got[i] >= 0.5) == y for i, y in held) >= 0.97 * len(held) and 0 <= got[900] < 0.5 and got[900] == got[901]


def fitted(labels, held):
    return toxicity.fit(np.array(labels), np.array([len(h) for h in held]), np.array([p for h in held for p in h]), (labels.count(0), labels.count(1)))


@pytest.mark.parametrize("rule", ["both", "both or neither"])
def test_factors_learn_what_single_terms_cannot(rule):
    """Only the pair of two terms tells; under the second rule neither term goes with the label at all by itself."""
    r = random.Random(1)
    labels, held = [], []
    for _ in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        labels.append(int(a and b if rule == "both" else a == b))
        held.append(sorted([*([10] if a else []), *([20] if b else []), 1000 + r.randrange(50)]))
    m = fitted(labels, held)
    at = lambda *p: m.logit(sorted(m.index[x] for x in p))
    assert at(10, 20) > 0 > max(at(10), at(20)) and (at() > 0) == (rule != "both")


def test_score_is_the_sum_over_all_pairs():
    r = random.Random(2)
    n = 12
    places = np.array(sorted({p for w in ("alpha", "bravo", "charlie", "delta") for p in toxicity.places(w)}))
    m = toxicity.Machine(-0.4, places, np.array([r.uniform(-1, 1) for _ in places]), np.array([[r.uniform(-1, 1) for _ in range(4)] for _ in places]))
    for _ in range(n):
        text = " ".join(r.sample(["alpha", "Bravo", "charlie", "delta", "unknown"], 3))
        held = [list(places).index(p) for p in toxicity.terms(text) if p in places]
        x = -0.4 + sum(m.w[i] for i in held) + sum(float(m.v[i] @ m.v[j]) for i in held for j in held if i < j)
        assert abs(m.score(text) - 1 / (1 + math.exp(-x))) < 1e-12


# 2 decontamination


def brute_held(text, item, least=0.8):
    w, b = re.findall(r"\w+", text.lower()), re.findall(r"\w+", item.lower())
    size = len(b)
    best = 0.0
    for s in range(max(1, len(w) - size + 1)):
        x = w[s : s + size]
        k = lambda v: Counter(tuple(v[i : i + min(5, len(v))]) for i in range(len(v) - min(5, len(v)) + 1))
        p, q = k(x), k(b)
        low = sum((p & q).values())
        best = max(best, low / (sum(p.values()) + sum(q.values()) - low) if p or q else 0.0)
    return best if best >= least - 1e-12 and b and w else None


def test_decontamination_against_brute_force(spark):
    r = random.Random(6)
    items = [(i, words(r, "en", r.choice([3, 8, 20, 40, 60]))) for i in range(12)] + [(12, ""), (13, None)]
    docs = []
    for i in range(80):
        body = words(r, "en", r.randint(0, 80)).split()
        if i % 2:
            passage = items[r.randrange(12)][1].split()
            if i % 4 == 1 and len(passage) > 20:
                passage[r.choice([0, -1, len(passage) // 2])] = "edited"
            at = r.randint(0, len(body))
            body[at:at] = [w.upper() for w in passage]
        docs.append((i, ", ".join(body)))
    got = {(x.doc_id, x.item_id): x.similarity for x in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(i, j): s for i, t in docs for j, b in items if b and (s := brute_held(t, b)) is not None}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-12 for k in want) and len(want) > 30


def test_hamming_blocks_find_all_within_the_radius():
    r = random.Random(2)
    index = decontaminate.Index([(i, words(r, "en", 30)) for i in range(40)])
    for _ in range(300):
        i = r.randrange(40)
        p = int(index.prints[i]) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 26)))
        assert index.within(p, 30) == {j for j in range(40) if (int(index.prints[j]) ^ p).bit_count() <= decontaminate.RADIUS}


def test_index_alone_finds_similar_windows():
    """Without the gate of shared shingles: items and windows at a similarity of 0.8 or more meet in the index."""
    r = random.Random(9)
    items = [(i, words(r, "en", r.choice([20, 40, 60, 90]))) for i in range(400)]
    index = decontaminate.Index(items)
    tried = met = other = 0
    for i, text in items:
        w = decontaminate.words_of(text)
        for edits in (0, 1, 2, 3):
            x = list(w)
            for _ in range(edits):
                x[r.choice([0, len(x) - 1, r.randrange(len(x))])] = f"edit{r.random()}"
            if decontaminate.similarity(decontaminate.weights(x), index.weights[i]) >= 0.8:
                print_ = int(decontaminate.simhash(decontaminate.signs(decontaminate.shingles_of(decontaminate.codes_of(x), 5)).sum(0, keepdims=True))[0])
                found = index.within(print_, len(x))
                tried, met, other = tried + 1, met + (i in found), other + len(found - {i})
    assert tried > 600 and met >= 0.999 * tried and other < 0.05 * tried * len(items) / 4


# Odd tables, for every operator


def every(spark, docs):
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "quick brown fox of the north jumps"), (None, None), (2, "")], "item_id long, text string")
    ok = common.crc_mod(F.col("doc_id"), 5) != 0
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"), F.col("root"))
    return {
        "toxicity": lambda: toxicity.toxicity(docs, toxicity.train(docs, labels)),
        "decontaminate": lambda: decontaminate.find(docs, items),
        "sentencepiece": lambda: sentencepiece_codec.encode(docs),
        "digests": lambda: sentencepiece_codec.digests(docs),
        "pii": lambda: pii.personal_data(docs, pii.trained()),
        "warc": lambda: warc_zip.round_trip(pages),
        "simhash": lambda: simhash.near_duplicates(docs),
        "spotsigs": lambda: spotsigs.edited_fingerprints(docs),
        "language": lambda: cross_parse.identify(docs, ok),
        "tokens": lambda: token_counts.token_counts(docs),
        "ppm": lambda: ppm.score(docs, ok),
    }


NAMES = ["toxicity", "decontaminate", "sentencepiece", "digests", "pii", "warc", "simhash", "spotsigs", "language", "tokens", "ppm"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_tables(spark, odd, none, name):
    got = every(spark, odd)[name]().collect()
    assert len(got) == (odd.count() if name != "decontaminate" else len({tuple(x) for x in got}) + 1)
    assert every(spark, none)[name]().count() == 0


def test_values_on_odd_tables(spark, odd):
    """What null, empty, very long and repeated texts give, for the operators whose own tests do not say so."""
    run = {k: [x.asDict() for x in v().collect()] for k, v in every(spark, odd).items() if k in ("sentencepiece", "digests", "pii", "simhash", "tokens", "decontaminate", "ppm", "language")}
    at = lambda name, i: [x for x in run[name] if x["doc_id"] == i]
    assert [(list(x["ids"]), x["decoded"]) for i in (3, 4) for x in at("sentencepiece", i)] == [([], ""), ([], "")]
    assert len(at("sentencepiece", 1)) == 2 and at("sentencepiece", 1)[0] == at("sentencepiece", 1)[1] and at("sentencepiece", 6)[0]["decoded"].count("word") == 60_000
    assert all(x["n_ids"] == 0 and x["round_trip"] for i in (3, 4) for x in at("digests", i))
    assert [x["spans"] for i in (3, 4, 5, 8) for x in at("pii", i)] == [""] * 4 and sum(x["n_ip"] for x in run["pii"]) == 1 and len(at("pii", None)) == 2
    same = {x["component_id"] for i in (1, 2) for x in at("simhash", i)} | {x["fp"] for i in (3, 4, 5) for x in at("simhash", i)}
    assert 1 in same and {x["component_id"] for i in (3, 4, 5) for x in at("simhash", i)} == {3} and {x["fp"] for i in (3, 4, 5) for x in at("simhash", i)} == {0}
    assert [(x["n_tokens"], x["n_bytes"], x["over_limit"]) for i in (3, 4) for x in at("tokens", i)] == [(0, 0, False)] * 2 and at("tokens", 6)[0]["n_tokens"] > 180_000
    assert len({(x["n_tokens"], x["n_bytes"]) for x in at("tokens", 1)}) == 1 and sorted(x["n_tokens"] for x in at("tokens", None))[0] == 0
    assert sorted((x["doc_id"], x["item_id"]) for x in run["decontaminate"]) == [(1, 1), (1, 1), (2, 1)] and len({x["similarity"] for x in run["decontaminate"]}) == 1
    assert [x["n_tokens"] for i in (3, 4, 5) for x in at("ppm", i)] == [1, 1, 1] and at("ppm", 6)[0]["n_tokens"] == 180_001
    assert [x["lang_pred"] for i in (3, 4, 5, 9) for x in at("language", i)] == ["und"] * 4


def test_pipeline_on_odd_tables(spark, odd, none, tmp_path):
    import corpus_pipeline as p

    d = f"{tmp_path}/sf"
    spark.createDataFrame([(1, 0, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "words of a benchmark item that no text holds")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for df in (odd, none):
        docs = df
        for i, (_, stage) in enumerate(p.STAGES):
            out = stage(spark, docs, d)
            assert i == len(p.STAGES) - 1 or out.columns == df.columns
            docs = common.table(out, "stage")
    assert docs.count() == 0


def test_pipeline_stages_against_their_operators(spark, tmp_path):
    import corpus_pipeline as p

    rows, labels = toxic_rows(300, 8)
    r = random.Random(5)
    item = words(r, "en", 30)
    rows += [(300, rows[0][1]), (301, words(r, "en", 20) + " " + item), (302, "mail me at jo@ex.org now " + words(r, "en", 20))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d = f"{tmp_path}/sf"
    df.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    got = {x.doc_id: x for x in p.run(spark, d).collect()}
    clean = [i for i, y in labels if not y]
    assert sum(i in got for i in clean) >= 0.97 * len(clean) and sum(i in got for i, y in labels if y) <= 0.05 * len(labels)
    assert 300 not in got and 301 not in got and "[EMAIL]" in got[302].decoded
    groups = {x.doc_id: x.component_id for x in simhash.near_duplicates(df).collect()}
    stay = {x.doc_id for x in simhash.one_of_each(df).collect()}
    assert all(groups[i] == i for i in stay) and len(stay) >= 0.98 * len(set(groups.values()))


def test_queries_are_registered():
    import __spark_entry__ as e

    names = [n for n in e.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 13)) and "pipeline" in e.queries()
    assert zlib.crc32(b"7") % 5 == common.crc_mod_py(7, 5)


def test_similar_pairs_against_brute_force(spark):
    """Copies with a few words changed: no false pair, and groups as brute force has them."""
    r = random.Random(21)
    texts = {}
    for i in range(40):
        base = words(r, "en", r.randint(60, 200)).split()
        for k in range(3):
            w = list(base)
            for _ in range(k * len(w) // 100):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            texts[len(texts)] = " ".join(w)
    texts[len(texts)] = texts[0]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in texts.items()}
    true = {(i, j) for i in sets for j in sets if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    got = {(max(x.a, x.b), min(x.a, x.b)) for x in simhash.similar_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got <= true
    root = {i: i for i in sets}
    for i, j in sorted(got):
        a, b = root[i], root[j]
        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert sum(root[i] == root[j] for i, j in true) >= 0.97 * len(true) and len(true) > 60


def groups_of(pairs, ids):
    root = {i: i for i in ids}
    for i, j in pairs:
        a, b = root[i], root[j]
        root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    return root


def test_similar_pairs_of_one_template(spark):
    """Two copies each of pages that share most words: a bucket's smallest page is no partner of most members."""
    r = random.Random(5)
    shared, rows = words(r, "en", 300).split(), []
    for g in range(120):
        page = list(shared)
        for k in range(20):
            page[r.randrange(15) + 15 * k] = f"own{g}x{k}"
        rows += [(2 * g, " ".join(page)), (2 * g + 1, " ".join([*page[:-3], "one", "more"]))]
    got = {(x.a, x.b) for x in simhash.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = groups_of(got, range(len(rows)))
    assert sum(root[2 * g] == root[2 * g + 1] for g in range(120)) == 120 and len(set(root.values())) > 100


def test_similar_pairs_whatever_the_edit(spark):
    """Copies with a block appended or cut off, at a similarity of 0.80 to 0.85."""
    r, rows = random.Random(6), []
    for i in range(150):
        base = [f"{w}{r.randrange(3)}" for w in words(r, "en", 200).split()]
        n = len(base)
        other = base + [f"{w}{r.randrange(3)}" for w in words(r, "de", 200).split()][: n // 5] if i % 2 else base[: n * 83 // 100]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    got = {(max(x.a, x.b), min(x.a, x.b)) for x in simhash.similar_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    true = {(2 * i + 1, 2 * i) for i in range(150) if len(sets[2 * i] & sets[2 * i + 1]) >= 0.8 * len(sets[2 * i] | sets[2 * i + 1])}
    assert len(true) > 100 and len(got & true) >= 0.99 * len(true)
