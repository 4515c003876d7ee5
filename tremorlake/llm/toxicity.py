"""Toxicity: a factorization machine over hashed terms.

Terms of a text: its words (runs of letters, lower case) and their first four and five letters, each once, hashed to
2**22 places by CRC-32. The score is the logistic function of bias + sum of w over the text's terms + half the sum over
factors of (sum of v)**2 - sum of v**2, so that pairs of terms (an insult with a group's name) count beyond their single weights.

Learning takes a bounded, documented sample of the labelled rows: of each class the rows with the least hash of their
id, at most SAMPLE[0] toxic and SAMPLE[1] others, and of these, in that order, as many as have MOST_TERMS terms together;
they are weighted back to the classes' shares among all labelled rows. Every place that a sampled text has gets a weight and factors: nothing is
screened by what it does alone, so pairs whose members say nothing by themselves are learned too. Adam, on batches of the
sample in a fixed order, first fits all weights, then all weights and factors together, under an L1 penalty as large as
chance makes their gradients, which keeps most at zero; those that have left zero are then fitted once more without it.

Nulls, empties: a null text counts as empty and scores as a text without known terms. Labels that are null, or whose id
is null or matches no text, teach nothing; of several labels of an id the larger counts; of several texts of an id each is
a row. Without labels of both classes the score is the share of toxic ones (0 if there is none). Null ids and repeated ids
keep a row each; a text of any length counts each of its terms once. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, MOST_TERMS = (2500, 6000), 12_000_000
PLACES, FACTORS = 1 << 22, 4
STEPS, BATCH, RATE = 200, 1024, 0.05
DECAY = 1e-5, 1e-4  # L2 penalties of weights and of factors
SIGMAS = 3.0  # a weight or factor leaves zero where its gradient passes so many standard deviations of chance
PART = 1 << 20  # terms of the sample that are renumbered at once
KNOWN = 120_000  # words a worker remembers the places of; beyond that it starts anew

_words = re.compile(r"[^\W\d_]+").findall


def places(word: str) -> tuple[int, ...]:
    b = word.encode("utf-8", "surrogatepass")
    out = [zlib.crc32(b) % PLACES]
    for n in (4, 5):
        if len(word) > n:
            out.append(zlib.crc32(b"%d:" % n + word[:n].encode("utf-8", "surrogatepass")) % PLACES)
        elif len(word) == n:
            out.append(zlib.crc32(b"%d:" % n + b) % PLACES)
    return tuple(out)


def terms(text: str) -> list[int]:
    return sorted({p for w in set(_words(text.lower())) for p in places(w)})


class Machine:
    def __init__(self, bias: float, places_: np.ndarray, w: np.ndarray, v: np.ndarray) -> None:
        self.bias, self.places, self.w, self.v = bias, places_, w, v
        self._index: dict[int, int] = {}
        self.known: dict[str, tuple[int, ...]] = {}

    @property
    def index(self) -> dict[int, int]:
        """Made once in each worker from the array that was sent."""
        if not self._index:
            self._index = dict(zip(self.places.tolist(), range(len(self.places)), strict=True))
        return self._index

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "_index": {}}

    def logit(self, held: list[int]) -> float:
        v = self.v[held]
        return float(self.bias + self.w[held].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v**2).sum()))

    def score(self, text: str) -> float:
        known, index = self.known, self.index
        if len(known) > KNOWN:
            known.clear()
        held: set[int] = set()
        for word in set(_words(text.lower())):
            at = known.get(word)
            if at is None:
                at = known[word] = tuple(index[p] for p in places(word) if p in index)
            if at:
                held.update(at)
        x = self.logit(sorted(held)) if held else self.bias
        return 1 / (1 + np.exp(-max(-40.0, min(40.0, x))))


def fit(labels: np.ndarray, sizes: np.ndarray, flat: np.ndarray, totals: tuple[int, int]) -> Machine:
    """labels of the sample, how many terms each has, all their terms in turn; totals: how many rows of class 0 and 1 there
    are beyond the sample."""
    y = np.asarray(labels, float)
    share = totals[1] / max(1, sum(totals))
    if y.sum() in (0, len(y)):
        bias = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
        return Machine(bias, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    present = np.zeros(PLACES, bool)
    present[flat] = True
    place, col = np.flatnonzero(present), np.empty(len(flat), np.int32)
    number, rows_of = np.cumsum(present, dtype=np.int32) - 1, np.zeros(len(place), np.int64)
    for i in range(0, len(flat), PART):  # in parts: an index is widened to eight bytes a term while it is used
        col[i : i + PART] = number[flat[i : i + PART]]
        rows_of += np.bincount(col[i : i + PART], minlength=len(place))
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (len(y) - y.sum()))
    weight /= weight.mean()
    chance = SIGMAS * np.sqrt(rows_of / len(y) * np.mean((weight * (y - share)) ** 2) / min(BATCH, len(y)))  # of a batch's mean gradient
    random = np.random.default_rng(7)  # a fixed start and order
    alone = _descend(np.concatenate(([np.log(share / (1 - share))], np.zeros(len(place)))), y, weight, sizes, col, chance, random)
    p = _descend(np.concatenate((alone, random.normal(0, 0.2 / np.sqrt(sizes.mean() + 1), FACTORS * len(place)))), y, weight, sizes, col, chance, random)
    w, v = p[1 : len(place) + 1], p[len(place) + 1 :].reshape(FACTORS, -1)
    used = np.flatnonzero((w != 0) | v.any(0))
    # The penalties have chosen places; weights and factors of these are now fitted without them.
    number = np.full(len(place), -1, np.int32)
    number[used] = np.arange(len(used))
    for i in range(0, len(col), PART):
        col[i : i + PART] = number[col[i : i + PART]]
    before = np.concatenate(([0], np.cumsum(col >= 0, dtype=np.int32)))  # held terms before each term
    ends = np.cumsum(sizes)
    sizes = before[ends] - before[ends - sizes]
    p = _descend(np.concatenate((p[:1], w[used], v[:, used].ravel())), y, weight, sizes, col[col >= 0], np.zeros(len(used)), random)
    return Machine(float(p[0]), place[used].astype(np.int64), p[1 : len(used) + 1], p[len(used) + 1 :].reshape(FACTORS, -1).T)


def _descend(p: np.ndarray, y: np.ndarray, weight: np.ndarray, sizes: np.ndarray, col: np.ndarray, chance: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """STEPS steps of Adam on batches; p, which is changed: bias, weights of the places, and maybe their factors. chance: the L1 penalty of
    each weight, and of each factor as a multiple of what its gradient is made of, the usual sum of the factors of a row."""
    m = len(chance)
    factors = (len(p) - 1) // max(1, m) - 1 if m else 0
    starts = np.concatenate(([0], np.cumsum(sizes)))
    m1, m2, grad, spare, order = np.zeros_like(p), np.zeros_like(p), np.empty_like(p), np.empty_like(p), np.zeros(0, np.int64)
    w, v = p[1 : m + 1], p[m + 1 :].reshape(factors, m)
    for t in range(1, STEPS + 1):
        if not len(order):
            order = random.permutation(len(y))
        batch, order = np.sort(order[:BATCH]), order[BATCH:]
        n = sizes[batch]
        rows = np.repeat(np.arange(len(batch)), n)
        c = col[np.repeat(starts[batch] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        x = p[0] + np.bincount(rows, w[c], len(batch))
        sums = [np.bincount(rows, f[c], len(batch)) for f in v]
        for f, s in zip(v, sums, strict=True):
            x += 0.5 * (s * s - np.bincount(rows, f[c] ** 2, len(batch)))
        g = weight[batch] * (1 / (1 + np.exp(-np.clip(x, -40, 40))) - y[batch]) / len(batch)
        far = g[rows]
        grad[0], grad[1 : m + 1] = g.sum(), np.bincount(c, far, m)
        grad[1 : m + 1] += DECAY[0] * w
        for f, s, to in zip(v, sums, grad[m + 1 :].reshape(factors, m), strict=True):
            to[:] = np.bincount(c, far * (s[rows] - f[c]), m)
            to += DECAY[1] * f
        # In place: there are five arrays of the length of p, however the steps are made.
        np.subtract(grad, m1, out=spare)
        spare *= 0.1
        m1 += spare
        np.multiply(grad, grad, out=spare)
        spare -= m2
        spare *= 0.001
        m2 += spare
        step = np.divide(m2, 1 - 0.999**t, out=grad)  # the gradient is not needed any more
        np.sqrt(step, out=step)
        step += 1e-7
        np.divide(RATE * (1 - (t - 1) / STEPS), step, out=step)
        np.divide(m1, 1 - 0.9**t, out=spare)
        spare *= step
        p -= spare
        step[0] = 0
        step[1 : m + 1] *= chance
        for s, pull in zip(sums, step[m + 1 :].reshape(factors, m), strict=True):
            pull *= 2 * chance * max(0.1, np.sqrt(np.mean(s * s)))
        np.abs(p, out=spare)
        spare -= step
        np.maximum(spare, 0, out=spare)
        np.sign(p, out=p)
        p *= spare
    return p


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: tuple[int, int] = SAMPLE, most_terms: int = MOST_TERMS) -> Machine:
    """docs and the labels that may be learned from -> machine. Texts stay on the executors; terms of the sample come here."""
    each = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    each = common.table(each, "labels")
    counts = {r.y: r.n for r in each.groupBy("y").agg(F.count("*").alias("n")).collect()}
    least = [each.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, sample[0]), (0, sample[1]))]  # each task sends its own least rows
    some = common.table(least[0].unionByName(least[1]), "sample")
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    joined = text.join(F.broadcast(some.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")  # sum(sample) rows at most
    held = common.map_texts(joined, "id long, n int, terms array<int>", lambda ids, texts: {"id": ids, "terms": (t := [terms(x) for x in texts]), "n": [len(x) for x in t]})
    held = common.table(held.join(F.broadcast(some), "id").withColumn("h", F.xxhash64("terms")), "terms")
    order = (F.xxhash64("id"), "id", "h")
    sizes = np.cumsum([r.n for r in held.select("id", "h", "n").orderBy(*order).limit(2 * sum(sample)).select("n").collect()])
    got = held.orderBy(*order).limit(int(np.searchsorted(sizes, most_terms, side="right"))).select("y", "n", "terms").toArrow()
    return fit(got.column("y").to_numpy(), got.column("n").to_numpy(), got.column("terms").combine_chunks().flatten().to_numpy(), (counts.get(0, 0), counts.get(1, 0)))


def toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, score)."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    return common.map_texts(docs, "doc_id long, score double", lambda ids, texts: {"doc_id": ids, "score": [model.value.score(t) for t in texts]}, id_col, text_col)


def keep_clean(docs: DataFrame, machine: Machine, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is under the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(machine)
    return common.keep_rows(docs, lambda texts: [model.value.score(t) < threshold for t in texts], text_col)
