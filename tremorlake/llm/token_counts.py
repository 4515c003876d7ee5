"""Token counts of a byte-level BPE without making ids of the texts.

Pieces never cross a pre-token, so a text's count is the sum over its distinct pre-tokens of frequency times pieces.

1. One pass over the texts splits them by the tokenizer's own pattern, in blocks of about BLOCK_BYTES. A block gives its
   documents' frequencies of pre-tokens, packed, and its distinct pre-tokens, packed by buckets of their hashes: what is
   frequent is combined here, before any shuffle, so the most frequent pre-token of all stands once in a block.
2. A bucket has all blocks' pre-tokens of its hashes. There each distinct one is encoded exactly once, and the pieces are
   joined to the blocks that asked. Buckets grow in number with the text, up to MOST_BUCKETS; beyond that in size.
3. The answers are joined to the blocks, and a block's documents sum frequency times pieces.

Special strings inside texts are found first, as the library does by default, and count as one token each.
Nulls, empties: a null text counts as empty (0 tokens); null or repeated ids keep a row each; a text of any length is in
one block. An empty table gives an empty result; further columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import json
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK_BYTES = 8_000_000  # of text whose distinct pre-tokens are asked for together
BUCKET_BYTES, MOST_BUCKETS = 1 << 24, 1 << 14  # text for each bucket of distinct pre-tokens


class PreTokens:
    """Splits and encodes as `tokenizers` would for a file of a byte-level BPE with the usual pattern and plain special tokens."""

    def __init__(self, path: str) -> None:
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        added = spec["added_tokens"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: only byte-level BPE without a normaliser or prefix space can be counted by pre-token")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError(f"{path}: an added token takes in its surroundings")
        self.special = regex.compile("|".join(regex.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"])))) if added else None
        self.find = regex.compile(PATTERN).findall
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def split(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of a text and how many special strings stand in it."""
        parts = self.special.split(text) if self.special else [text]
        return self.find(text) if len(parts) == 1 else [w for p in parts for w in self.find(p)], len(parts) - 1

    def pieces(self, tokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(tokens, add_special_tokens=False)]


@functools.lru_cache(2)
def pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


def tokenizer_path(name: str) -> str:
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


PASS = "block long, bucket int, n long, tokens binary, ids array<long>, n_bytes array<long>, special array<int>, kinds array<int>, which binary, times binary, buckets binary"


def frequencies(docs: DataFrame, tokenizer: str, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of two sorts. With tokens: the n distinct pre-tokens of a block that belong to a bucket, in the order of their numbers.
    Without: a block's documents, each with its bytes, special strings and number of distinct pre-tokens (kinds), for all
    of them in turn which these are and how often, and the bucket of each of the block's n pre-tokens."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PASS))
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def batch_of(count: int, **columns):
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)

    def run(batches):
        import uuid

        import xxhash

        split = pre_tokens(tokenizer_path(tokenizer)).split

        def fresh():
            number: dict[str, int] = defaultdict()
            number.default_factory = number.__len__  # a new pre-token gets the next number
            return int(uuid.uuid4()) & ((1 << 62) - 1), number, {"ids": [], "n_bytes": [], "special": [], "kinds": []}, [], [], 0

        def block_rows():
            tokens = np.array(list(number), object)
            at = np.fromiter((xxhash.xxh64_intdigest(t, 42) % buckets for t in number), np.int32, len(number))
            order = np.argsort(at, kind="stable")
            ends = np.flatnonzero(np.diff(at[order])) + 1
            all_parts = [(int(at[x[0]]), x) for x in np.split(order, ends) if len(x)]
            for b in range(0, len(all_parts), 64):
                parts = all_parts[b : b + 64]
                yield batch_of(len(parts), block=np.full(len(parts), block), bucket=[i for i, _ in parts], n=[len(x) for _, x in parts], tokens=[common.streamed(pa.array(tokens[x], pa.large_string())) for _, x in parts])
            yield batch_of(1, block=[block], n=[len(at)], buckets=[common.pack(at)], which=[common.pack(np.concatenate(which), True)], times=[common.pack(np.concatenate(times))], **{k: [v] for k, v in held.items()})

        block, number, held, which, times, size = fresh()
        for batch in batches:
            for part in common.slices(batch, 1):
                found, lengths = [], []
                for t in part.column(1).to_pylist():
                    words, special = split(t)
                    found.extend(map(number.__getitem__, words))
                    lengths.append(len(words))
                    held["n_bytes"].append(len(t.encode()))
                    held["special"].append(special)
                    size += held["n_bytes"][-1] + 1
                held["ids"] += part.column(0).to_pylist()
                row = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
                pairs, n = np.unique(row << 32 | np.array(found, np.int64), return_counts=True)
                held["kinds"] += np.bincount(pairs >> 32, minlength=len(lengths)).tolist()
                which.append((pairs & 0xFFFFFFFF).astype(np.int32))
                times.append(n.astype(np.int32))
                if size > BLOCK_BYTES:
                    yield from block_rows()
                    block, number, held, which, times, size = fresh()
        if held["ids"]:
            yield from block_rows()

    return source.mapInArrow(run, PASS)


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, n_bytes, n_tokens, over_limit). tokenizer: a path, or the name of a file in public_tokenizers."""
    import pyarrow as pa

    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    buckets = max(8, min(MOST_BUCKETS, -(-size // BUCKET_BYTES)))
    made = common.table(frequencies(docs, tokenizer, buckets, id_col, text_col), "frequencies")

    def count(part: pa.Table) -> pa.Table:
        """A bucket's pre-tokens: each distinct one is encoded once, and every block is told the pieces of its own."""
        asked = pa.chunked_array([c for x in part.column("tokens").to_pylist() for c in pa.ipc.open_stream(x).read_all().column(0).chunks], pa.large_string())
        coded = asked.combine_chunks().dictionary_encode()
        of_distinct, encode = [], pre_tokens(tokenizer_path(tokenizer)).pieces
        for at in range(0, len(coded.dictionary), 20_000):
            of_distinct += encode(coded.dictionary[at : at + 20_000].to_pylist())
        n = np.array(of_distinct, np.int32)[coded.indices.to_numpy()]
        sizes = np.cumsum(part.column("n").to_numpy())
        return pa.table([part.column("block"), part.column("bucket"), part.column("n"), pa.array([common.pack(x) for x in np.split(n, sizes[:-1])], pa.binary())], ["of_block", "bucket", "n", "found"])

    answers = made.where("tokens is not null").select("block", "bucket", "n", "tokens").groupBy("bucket").applyInArrow(count, "of_block long, bucket int, n long, found binary")
    blocks = made.where("tokens is null").drop("bucket", "tokens")

    def total(rows: pa.Table, answers: pa.Table) -> pa.Table:
        out = {"doc_id": [], "n_bytes": [], "n_tokens": []}
        for r in rows.to_pylist():
            at = common.unpack(r["buckets"], r["n"], np.int32)
            found = sorted(zip(*(answers.column(c).to_pylist() for c in ("bucket", "n", "found")), strict=True))
            n = np.zeros(r["n"], np.int64)
            n[np.argsort(at, kind="stable")] = np.concatenate([np.zeros(0, np.int64), *(common.unpack(x, k, np.int32) for _, k, x in found)])
            kinds = np.array(r["kinds"], np.int64)
            size = int(kinds.sum())
            sums = np.concatenate(([0], np.cumsum(n[common.unpack(r["which"], size, np.int32, True)] * common.unpack(r["times"], size, np.int32))))
            ends = np.cumsum(kinds)
            out["doc_id"] += r["ids"]
            out["n_bytes"] += r["n_bytes"]
            out["n_tokens"] += (sums[ends] - sums[ends - kinds] + np.array(r["special"], np.int64)).tolist()
        return pa.table({"doc_id": pa.array(out["doc_id"], pa.int64()), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "n_tokens": pa.array(out["n_tokens"], pa.int64()), "over_limit": pa.array([x > limit for x in out["n_tokens"]], pa.bool_())})

    return blocks.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
