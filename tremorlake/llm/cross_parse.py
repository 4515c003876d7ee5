"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text gives, from any place of another text, the longest match with the
training text. A text is parsed into such longest matches from left to right. With c phrases, a language whose training text
has n characters gives the text c * log2(n + 2) bits (a phrase is a pointer into the training text), so that a language with
little labelled text, whose matches are shorter for that alone, is not at a loss; the language of the fewest bits wins.
Normalisation: lower case, every run of non-letters is one space.

The automata are learned from a bounded sample: of each language, the rows with the least hash of their id, at most
SAMPLE_DOCS rows, read whole until SAMPLE_CHARS characters are reached (the row that passes the bound is cut there). Every text
is parsed whole, exactly as from its first character on. To work on arrays, all blocks of BLOCK characters of all texts first
advance together, each as if a phrase began with it. Then each block but a text's first runs again from the state that the block
before has ended in, until both runs stand in the same state; from there on they agree. A block that never meets its first run
(a phrase longer than a block) sends its own end on to the next block, which runs once more.

An automaton has a table of all its states and letters where that takes at most DENSE entries, and else sorted pairs of
state and letter, so alphabets of any size do.

Nulls, empties: null texts and texts without a letter give `und` and score 0; null ids stay; repeated ids keep a row
each. Rows with a null language teach nothing. With no training rows at all every text is `und`. Ties go to the language
first in alphabetical order. score = r2 / (r1 + r2) of the best and second-best bits: 0.5 for a tie, 1 with one language.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

SAMPLE_DOCS, SAMPLE_CHARS, BLOCK = 64, 24_000, 1024
DENSE = 1 << 24  # entries of a table, 4 bytes each
SPACE, OTHER = 0, 1  # codes: white space and the like, and letters that no training text has


@functools.cache
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def normalised(text: str) -> np.ndarray:
    """Code points, lower case, a single 32 for each run of non-letters."""
    x = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    x[~letters()[x]] = 32
    return x[~((x == 32) & (np.concatenate(([0], x[:-1])) == 32))]


def automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of one sequence, state 0 being the empty match."""
    after: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        now = len(after)
        after.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in after[p]:
            after[p][c] = now
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(after)
                after.append(dict(after[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return after


class Steps:
    """The automaton of one language: after(state, code) = 4 * (next state) + phrases that end there. State 0: no match yet."""

    def __init__(self, codes: np.ndarray, letters_: int) -> None:
        after = automaton(codes.tolist())
        self.width = letters_
        root = np.full(letters_, -1, np.int64)
        root[list(after[0])] = list(after[0].values())
        begun = np.maximum(root, 0)  # where a new match stands after one character
        self.fresh = (4 * begun + np.where(root >= 0, 1, 2)).astype(np.int32)  # a match ends, and an unknown letter is one of its own
        self.start = (4 * begun + np.where(root >= 0, 0, 1)).astype(np.int32)
        self.table = None
        if len(after) * letters_ <= DENSE:
            self.table = np.tile(self.fresh, (len(after), 1))
            for i, d in enumerate(after):
                self.table[i, list(d)] = 4 * np.fromiter(d.values(), np.int64, len(d))
            self.table[0] = self.start
            self.table = self.table.ravel()
        else:
            pairs = [(i * letters_ + c, to) for i, d in enumerate(after) if i for c, to in d.items()]
            pairs.sort()
            self.keys = np.array([k for k, _ in pairs] + [2**62], np.int64)
            self.to = np.array([4 * to for _, to in pairs] + [0], np.int32)

    def after(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[state * self.width + code]
        key = state.astype(np.int64) * self.width + code
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.to[at], np.where(state == 0, self.start[code], self.fresh[code]))


class Parser:
    """Automata of several languages over letters that are numbered for each language by itself."""

    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        self.known, self.steps, self.bits = [], [], []
        for lang in self.langs:
            text = normalised(samples[lang])
            known = np.unique(text[text != 32])
            self.known.append(known)
            self.steps.append(Steps(self._codes(text, known), len(known) + 2))
            self.bits.append(float(np.log2(len(text) + 2)))

    @staticmethod
    def _codes(text: np.ndarray, known: np.ndarray) -> np.ndarray:
        at = np.searchsorted(known, text)
        hit = known[np.minimum(at, len(known) - 1)] == text if len(known) else np.zeros(len(text), bool)
        return np.where(hit, at + 2, np.where(text == 32, SPACE, OTHER)).astype(np.int32)

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases needed (text x language) and normalised lengths; length 0 where no letter stands."""
        plain = [normalised(t) for t in texts]
        sizes = np.array([len(c) if (c != 32).any() else 0 for c in plain], np.int64)
        flat = np.concatenate([*(c for c, n in zip(plain, sizes, strict=True) if n), np.zeros(0, np.int64)])
        first = np.cumsum(sizes) - sizes
        letters_, letter = np.unique(flat, return_inverse=True)
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        for i, (known, steps) in enumerate(zip(self.known, self.steps, strict=True)):
            total[:, i] = _parse(steps, self._codes(letters_, known)[letter], first, sizes)
        return total, sizes

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        n, sizes = self.phrases(texts)
        n = n * np.array(self.bits)
        best = n.argmin(1)
        ranked = np.sort(n, 1)
        one, two = ranked[:, 0], ranked[:, 1] if len(self.langs) > 1 else np.full(len(texts), np.inf)
        with np.errstate(invalid="ignore"):
            score = np.where(sizes == 0, 0.0, np.where(np.isinf(two), 1.0, two / np.maximum(one + two, 1)))
        return [self.langs[b] if s else "und" for b, s in zip(best, sizes, strict=True)], score.tolist()


def _parse(steps: Steps, codes: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Phrases of each text codes[first : first + size], by blocks that advance together."""
    blocks = -(-sizes // BLOCK)
    owner = np.repeat(np.arange(len(sizes)), blocks)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin, length = first[owner] + k * BLOCK, np.minimum(BLOCK, sizes[owner] - k * BLOCK)
    by = np.argsort(-length, kind="stable")
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))  # where block number j of all texts in turn stands among the sorted ones
    lanes = np.searchsorted(-length[by], -np.arange(1, BLOCK + 1), side="right")  # blocks with a character number t
    most = int(length[by[0]]) if len(by) else 0
    begin, length = begin[by], length[by]
    state, n = np.zeros(len(by), np.int32), np.zeros(len(by), np.int64)
    trail = np.zeros(len(codes), np.int32)  # what the first run makes of each character
    for t in range(most):
        m = int(lanes[t])
        x = steps.after(state[:m], codes[begin[:m] + t])
        trail[begin[:m] + t] = x
        n[:m] += x & 3
        state[:m] = x >> 2
    # Again, from the end of the block before, until the runs meet; a block that ends apart sends on its own end.
    gain = np.zeros(len(by), np.int64)  # phrases that the true run has more than the first one
    live = np.flatnonzero(k[by] > 0)
    now = state[place[by[live] - 1]]
    live, now = live[now != 0], now[now != 0]
    alone = state.copy()  # ends of the first runs
    while len(live):
        gain[live], ended = 0, []
        for t in range(most):
            inside = length[live] > t
            if not inside.all():
                ended.append((live[~inside], now[~inside]))
                live, now = live[inside], now[inside]
            if not len(live):
                break
            x, was = steps.after(now, codes[begin[live] + t]), trail[begin[live] + t]
            gain[live] += (x & 3) - (was & 3)
            now = x >> 2
            apart = now != was >> 2
            ended.append((live[~apart], alone[live[~apart]]))
            live, now = live[apart], now[apart]
        ended.append((live, now))
        live, now = (np.concatenate(z) for z in zip(*ended, strict=True))
        news = now != state[live]
        live, now = live[news], now[news]
        state[live] = now
        following = by[live] + 1
        goes_on = following < np.searchsorted(owner, owner[by[live]], side="right")
        live, now = place[following[goes_on]], now[goes_on]
    out = np.bincount(owner[by], n + gain, len(sizes)).astype(np.int64)
    ends = np.cumsum(blocks)[blocks > 0] - 1
    out[np.flatnonzero(blocks)] += state[place[ends]] != 0  # the match that the text's end cuts
    return out


def sample(docs: DataFrame, docs_each: int = SAMPLE_DOCS, chars_each: int = SAMPLE_CHARS) -> dict[str, str]:
    """docs (id, text, lang) -> training text by language; a map-side group limit leaves few rows to shuffle."""
    rows = docs.where("lang is not null and text is not null").select("id", "lang", F.xxhash64("id").alias("h"))
    w = Window.partitionBy("lang").orderBy("h", "id")
    some = rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= docs_each).select("id", "lang", "r").distinct()
    ids = [r.id for r in some.select("id").distinct().collect()]  # docs_each for each language at most
    text = docs.where(F.col("id").isin(ids)).groupBy("id", "lang").agg(F.min(F.substring("text", 1, chars_each)).alias("text"))
    out: dict[str, str] = {}
    for r in some.join(text, ["id", "lang"]).orderBy("lang", "r").collect():
        room = chars_each - len(out.get(r.lang, ""))
        if room > 0:
            out[r.lang] = out.get(r.lang, "") + (r.text + " ")[:room]
    return out


def identify(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """-> (doc_id, lang_pred, score); train: which rows' language may be learned from."""
    taught = docs.where(train).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    parser = docs.sparkSession.sparkContext.broadcast(Parser(sample(taught)))

    def work(ids: list, texts: list) -> dict:
        lang, score = parser.value.predict(texts)
        return {"doc_id": ids, "lang_pred": lang, "score": score}

    return common.map_texts(docs, "doc_id long, lang_pred string, score double", work, id_col, text_col)
