"""Encoding and decoding with a SentencePiece model on the `tokenizers` library.

The model's protobuf is parsed here, and its normaliser (precompiled character map, white-space folding, dummy
prefix), the metaspace marker, the scores (of a unigram model as they are, of a BPE model as the order of its merges)
and byte fallback are rebuilt from it. Batches are encoded on several threads. Where no piece holds the
metaspace marker after another character, no piece crosses the place before a marker: normalised texts are cut there,
the parts that a worker has not met yet are encoded as one batch, and a text's ids are those of its parts in turn.
Otherwise whole texts are encoded. The table of known parts is bounded; past KNOWN it starts anew, which changes no id.

`verify` compares with the sentencepiece library on given texts; `build` does so on PROBES before a model is used,
and raises if any id differs.

Segmentations of a unigram model whose scores are equal but for the rounding of their sums (the libraries add in single and
in double precision) are the one case in which ids may differ.

Nulls, empties: a null text counts as empty and has no ids; null and repeated ids keep a row each. Control symbols inside
a text are ordinary characters, as SentencePiece has it. Texts of any length are encoded whole; where no cut is possible, as one piece of
work. Ties between segmentations go as in the libraries. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
import struct
from array import array
from itertools import filterfalse

import numpy as np
from pyspark.sql import DataFrame

from . import common

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)  # fixed values: piece types of the format
UNIGRAM, BPE = 1, 2  # fixed values: model types of the format
KNOWN, THREADS = 200_000, 2
PROBES = ("", " ", "a", "  two  spaces ", "Ünïcode — 你好 \U0001f600", "tab\tand\nnew line", "<s> </s> <unk>", "1234567890", "▁marked", "é ﬁ   x")


def fields(data: bytes):
    """(field number, value) of a protobuf message: varints and fixed numbers as int, the rest as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: int | bytes = varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value = data[at : at + n]
            at += n
        yield tag >> 3, value


class Spec:
    """What a model file says."""

    def __init__(self, data: bytes) -> None:
        self.pieces: list[tuple[str, float, int]] = []
        trainer, normaliser = {}, {}
        for number, value in fields(data):
            if number == 1:
                p = dict(fields(value))
                self.pieces.append((p[1].decode(), struct.unpack("<f", p[2])[0] if 2 in p else 0.0, p.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normaliser = dict(fields(value))
        self.model_type = trainer.get(3, UNIGRAM)
        self.suffix_space, self.byte_fallback = bool(trainer.get(24, 0)), bool(trainer.get(35, 0))
        self.charsmap = normaliser.get(2, b"")
        self.dummy_prefix, self.fold_spaces, self.escape = (bool(normaliser.get(k, 1)) for k in (3, 4, 5))
        self.unknown = next(i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN)


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Every way to make a piece from two others, best score first."""
    ids = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind == NORMAL}
    out = []
    for p, score, kind in spec.pieces:
        if kind == NORMAL and len(p) > 1:
            out += [(-score, ids[p[:k]], ids[p[k:]], p[:k], p[k:]) for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    return [(a, b) for *_, a, b in sorted(out)]


class Codec:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        with open(path, "rb") as f:
            self.spec = spec = Spec(f.read())
        if spec.suffix_space or not spec.escape or spec.model_type not in (UNIGRAM, BPE):
            raise ValueError(f"{path}: only unigram and BPE models with a leading metaspace marker are read")
        unknown = spec.pieces[spec.unknown][0]
        if spec.model_type == UNIGRAM:
            # Only normal pieces stand in texts. Bytes keep their names, which the fallback asks for, at a score that never wins.
            never = min((s for _, s, kind in spec.pieces if kind == NORMAL), default=0.0) - 1e4
            named = {NORMAL: lambda p, s: (p, s), USER: lambda p, s: (p, s), BYTE: lambda p, s: (p, never)}
            model = models.Unigram([named.get(kind, lambda p, s: (f"\U0010ffff{p}", never))(p, s) for p, s, kind in spec.pieces], spec.unknown, spec.byte_fallback)
        else:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges(spec), unk_token=unknown, fuse_unk=True, byte_fallback=spec.byte_fallback)
        self.tokenizer = Tokenizer(model)
        steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
        if spec.fold_spaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(MARK)] * spec.dummy_prefix + [normalizers.Replace(" ", MARK)]
        self.tokenizer.normalizer = normalizers.Sequence(steps)
        self.plain = not spec.charsmap and not spec.fold_spaces  # then normalising is marking alone
        self.cut = None
        self.known: dict[str, bytes] = {}  # ids as 32-bit numbers: nothing that Python's garbage collector visits
        if not any(MARK in p.lstrip(MARK) for p, _, kind in spec.pieces if kind == NORMAL) and not any(kind == USER for *_, kind in spec.pieces):
            self.cut = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+").findall
            self.parts = Tokenizer(model)
        if users := [p for p, _, kind in spec.pieces if kind == USER]:
            self.tokenizer.add_tokens([AddedToken(p, normalized=True) for p in users])
        steps = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()] + [decoders.Strip(" ", 1, 0)] * spec.dummy_prefix
        self.tokenizer.decoder = decoders.Sequence(steps)
        self.raw = [bytes([int(p[3:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in spec.pieces]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.cut:
            return [np.array(e.ids, "<i4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        prefix, known = MARK if self.spec.dummy_prefix else "", self.known
        split = [self.cut(prefix + t.replace(" ", MARK) if self.plain else self.tokenizer.normalizer.normalize_str(t)) if t else [] for t in texts]
        if len(known) > KNOWN:
            known.clear()
        new: set[str] = set()
        for s in split:
            new.update(filterfalse(known.__contains__, s))
        parts = list(new)
        for at in range(0, len(parts), 10_000):
            some = parts[at : at + 10_000]
            known.update(zip(some, (array("i", e.ids).tobytes() for e in self.parts.encode_batch_fast(some, add_special_tokens=False)), strict=True))
        get = known.__getitem__
        return [np.frombuffer(b"".join(map(get, s)), "<i4") for s in split]

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """Pieces are joined as bytes; where byte pieces do not make UTF-8, the library's decoder says what stands for them."""
        out = []
        for x in ids:
            try:
                t = b"".join(map(self.raw.__getitem__, x.tolist())).decode()
            except UnicodeDecodeError:
                out.append(self.tokenizer.decode(x.tolist(), skip_special_tokens=False))
            else:
                out.append(t[1:] if self.spec.dummy_prefix and t[:1] == " " else t)
        return out

    def verify(self, path: str, texts: list[str]) -> list[int]:
        """The places of texts whose ids or whose decoded text differ from the sentencepiece library's."""
        import sentencepiece

        theirs = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = self.encode(texts)
        return [i for i, (t, a, b) in enumerate(zip(texts, ids, self.decode(ids), strict=True)) if theirs.encode(t) != a.tolist() or theirs.decode(a.tolist()) != b]


@functools.lru_cache(2)
def build(path: str) -> Codec:
    codec = Codec(path)
    if wrong := codec.verify(path, list(PROBES)):
        raise ValueError(f"{path}: ids differ from SentencePiece's for {[PROBES[i] for i in wrong]}")
    return codec


def model_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, ids array<int>, decoded): decoded is the text made from the ids again."""

    def work(ids: list, texts: list) -> dict:
        codec = build(model_path(model))
        made = codec.encode(texts)
        return {"doc_id": ids, "ids": made, "decoded": codec.decode(made)}

    return common.map_texts(docs, "doc_id long, ids array<int>, decoded string", work, id_col, text_col)


def digests(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, n_ids, ids_sha256, decoded_sha256, round_trip): encode() with short results.

    ids_sha256 is of the ids as 32-bit little-endian numbers; round_trip tells whether the decoded text is the text."""

    def work(ids: list, texts: list) -> dict:
        codec = build(model_path(model))
        made = codec.encode(texts)
        back = codec.decode(made)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return {"doc_id": ids, "n_ids": [len(x) for x in made], "ids_sha256": [sha(x.tobytes()) for x in made], "decoded_sha256": [sha(t.encode()) for t in back], "round_trip": [a == b for a, b in zip(texts, back, strict=True)]}

    return common.map_texts(docs, "doc_id long, n_ids long, ids_sha256 string, decoded_sha256 string, round_trip boolean", work, id_col, text_col)
