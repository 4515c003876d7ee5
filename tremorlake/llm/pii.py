"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans to them.

Base. Kinds email, ip, card and phone, leftmost non-overlapping matches of each kind's pattern; matches that fail the kind's
test (address parts up to 255; 12 to 19 digits with a Luhn checksum; 9 to 15 digits) are dropped and not retried.

Method. A text is cut into tokens (letters, digits, white space, single other characters), and stretches of them around
digits, @ and bracketed "at", in which every possible entity lies whole, are segmented; this gives the same as segmenting the whole text. A segmentation gives each token to an outside segment of one token or to an entity segment of at most
MOST_TOKENS tokens; an entity segment scores by features of the whole span (its groups of digits and separators, checks such as
Luhn, address parts and domain form, what stands on either side) and by whether an entity stands right before it. Dynamic
programming over all segmentations chooses boundaries and kinds together. The weights are fitted once on the driver by
the likelihood of synthetic sentences made here, with misleading numbers, versions, dates, keys and hex strings among them.
Entities that overlap no base span are added; base spans always stay.

Nulls, empties: a null text counts as empty and has no spans; null and repeated ids keep a row each. Offsets are code points. Ties between
segmentations go to the first. An empty table gives an empty table. Texts of any length are read whole; a stretch that is all figures
is segmented as a stream that holds the segments of MOST_TOKENS tokens, and a few tens of bytes for each token.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from array import array
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame

from . import common

KINDS = ("email", "ip", "card", "phone")
MOST_TOKENS = 28

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_ip = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").finditer
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]").finditer
_cue = re.compile(r"[0-9@]|[\[({] ?at ?[\])}]", re.I)
_token = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S).finditer
_digits = re.compile(r"[0-9]+").findall
_other = re.compile(r"[^0-9]").sub


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    even = sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return (odd + even) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), by start and then kind."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        # A match's local part is all that stands before the @ since the last match.
        low = at
        while low > done and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "._%+-")):
            low -= 1
        m = _domain(text, at + 1) if low < at else None
        if m:
            out.append((low, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _ip(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _card(text):
        d = _other("", m[0]) if len(m[0]) < 64 else ""
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _phone(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def features(text: str, start: int, end: int) -> tuple[list[str], tuple[int, ...]]:
    """Features of a whole span, and the kinds it may have; no kind if it cannot be an entity."""
    s = text[start:end]
    if not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum():
        return [], ()
    left, right = text[start - 1 : start], text[end : end + 1]
    side = lambda c, more: "edge" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else "joint" if c in more else "other"
    around = [f"left={side(left, '.-_/@+=')}", f"right={side(right, '-_/@+=')}"]
    if right == "." and text[end + 1 : end + 2].isalnum():
        around.append("right=.x")
    if any(c.isalpha() for c in s):
        low = s.lower()
        plain = re.sub(r" ?[\[({] ?at ?[\])}] ?", "@", low)
        hidden = plain != low
        plain = re.sub(r" ?[\[({] ?dot ?[\])}] ?", ".", plain)
        if plain.count("@") != 1 or " " in plain.strip():
            return [], ()
        name, _, host = plain.partition("@")
        if not name or not host:
            return [], ()
        out = ["mail", f"hidden={hidden}", f"dots={min(3, host.count('.'))}", f"name={bool(re.fullmatch(r'[a-z0-9._%+-]+', name))}", f"host={bool(re.fullmatch(r'[a-z0-9-]+(?:[.][a-z0-9-]+)+', host))}", f"top={bool(re.search(r'[.][a-z]{2,12}$', host))}"]
        return out + around, (0,)
    groups = _digits(s)
    n = sum(map(len, groups))
    if not 4 <= n <= 20 or len(groups) > 8 or not re.fullmatch(r"\+?[0-9 ().-]+", s) or re.search(r"[ .-]{3}|[.]{2}", s):
        return [], ()
    seps = "".join(sorted(set(s) - set("0123456789")))
    shape = "-".join(str(len(g)) for g in groups)
    quads = len(groups) == 4 and seps == "." and all(int(g) < 256 and len(g) < 4 for g in groups)
    out = ["num", f"n={n}", f"seps={seps}", f"plus={s[0] == '+'}", f"groups={len(groups)}", f"shape={shape}", f"quads={quads}", f"paren={s.count('(') == s.count(')') and '(' in s}", f"fair={s.count('(') == s.count(')')}", f"luhn={n >= 12 and luhn(''.join(groups))}", f"even={len(set(map(len, groups))) == 1 and len(groups) > 1}", f"long={12 <= n <= 19}", f"dial={9 <= n <= 15}", f"lead={s[0] if n >= 12 else ''}", f"n={n},groups={len(groups)}", f"n={n},plus={s[0] == '+'}"]
    return out + around, (1, 2, 3)


def windows(text: str) -> list[tuple[int, int]]:
    """Stretches of whole tokens around cues, so wide that every segment of MOST_TOKENS tokens with a cue in it lies in one."""
    cues = array("q", (m.start() for m in _cue.finditer(text)))
    if not cues:
        return []
    places = token_places(text, 0, len(text))
    out: list[list[int]] = []
    for c in cues:
        i = bisect_right(places, c) - 1
        low, high = max(0, i - MOST_TOKENS + 1), min(len(places) - 1, i + MOST_TOKENS)
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    return [(places[a], places[b]) for a, b in out]


def token_places(text: str, a: int, b: int) -> array:
    """Where the tokens of a stretch begin, and its end."""
    return array("q", chain((m.start() + a for m in _token(text[a:b])), (b,)))


def segments_from(text: str, places: array, i: int) -> Iterator[tuple[int, list[str], tuple[int, ...]]]:
    """The possible entity segments that begin with token i: (end, features, kinds), ends rising."""
    c = text[places[i]]
    if not (c.isalnum() or c in "+("):
        return
    digits = letters = 0
    for j in range(i + 1, min(len(places) - 1, i + MOST_TOKENS) + 1):
        t = text[places[j - 1]]
        digits += (places[j] - places[j - 1]) * t.isdigit()
        letters += t.isalpha()
        if t == "\n" or (digits > 20 and not letters):
            return
        if not t.isspace() and (digits >= 4 or letters >= 2):
            f, kinds = features(text, places[i], places[j])
            if kinds:
                yield j, f, kinds


class Lattice:
    """Tokens of a stretch, and all its possible entity segments with their features; for training."""

    def __init__(self, text: str, a: int, b: int) -> None:
        self.places = token_places(text, a, b)
        n = len(self.places) - 1
        self.ends: list[list[tuple[int, list[str], tuple[int, ...]]]] = [[] for _ in range(n + 1)]  # by end: (begin, features, kinds)
        for i in range(n):
            for j, f, kinds in segments_from(text, self.places, i):
                self.ends[j].append((i, f, kinds))


class Model:
    def __init__(self) -> None:
        self.weights: dict[tuple[str, int], float] = defaultdict(float)

    def score(self, f: list[str], kind: int) -> float:
        w = self.weights
        return w.get(("bias", kind), 0.0) + sum(w.get((x, kind), 0.0) for x in f)

    def decode(self, text: str, a: int, b: int) -> list[tuple[int, int, int]]:
        """The best segmentation's entities (start, kind, end). States: 0 after an outside token, 1 after an entity.

        A segment has MOST_TOKENS tokens at most, so only the segments and values of as many tokens are held; what stays for
        every token is its place and four bytes of the way back."""
        places = token_places(text, a, b)
        n, ring = len(places) - 1, MOST_TOKENS + 1
        best = [[0.0, -math.inf]] + [[-math.inf, -math.inf]] * (ring - 1)  # token j's values stand at j % ring
        open_: list[list[tuple[int, int, float]]] = [[] for _ in range(ring)]  # by end: (begin, kind, score)
        outside, length, kinds_at, before_at = bytearray(n + 1), bytearray(n + 1), bytearray(n + 1), bytearray(n + 1)
        after = [self.weights.get(("after", k), 0.0) for k in range(len(KINDS))]
        for j in range(1, n + 1):
            for end, f, kinds in segments_from(text, places, j - 1):
                open_[end % ring].extend((j - 1, kind, self.score(f, kind)) for kind in kinds)
            last = best[(j - 1) % ring]
            outside[j] = state = 0 if last[0] >= last[1] else 1
            value = -math.inf
            for i, kind, s in open_[j % ring]:
                for before in (0, 1):
                    x = best[i % ring][before] + s + (after[kind] if before else 0.0)
                    if x > value:
                        value, length[j], kinds_at[j], before_at[j] = x, j - i, kind, before
            open_[j % ring] = []
            best[j % ring] = [last[state], value]
        out, j, state = [], n, 0 if best[n % ring][0] >= best[n % ring][1] else 1
        while j > 0:
            if state:
                i = j - length[j]
                out.append((places[i], kinds_at[j], places[j]))
                j, state = i, before_at[j]
            else:
                j, state = j - 1, outside[j]
        return out[::-1]

    def gradient(self, lattice: Lattice, gold: set[tuple[int, int, int]]) -> dict[tuple[str, int], float]:
        """Of the log likelihood: features of the true segmentation less their expectation (forward and backward sums)."""
        n = len(lattice.places) - 1
        after = [self.weights.get(("after", k), 0.0) for k in range(len(KINDS))]
        add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y))) if x > -math.inf and y > -math.inf else max(x, y)
        segments = [(i, j, k, self.score(f, k), f) for j in range(n + 1) for i, f, kinds in lattice.ends[j] for k in kinds]
        by_end, by_begin = defaultdict(list), defaultdict(list)
        for s in segments:
            by_end[s[1]].append(s)
            by_begin[s[0]].append(s)
        fore, aft = [[0.0, -math.inf]], [[0.0, 0.0] for _ in range(n + 1)]
        for j in range(1, n + 1):
            e = -math.inf
            for i, _, k, s, _ in by_end[j]:
                e = add(e, s + add(fore[i][0], fore[i][1] + after[k]))
            fore.append([add(*fore[j - 1]), e])
        for i in range(n - 1, -1, -1):
            for before in (0, 1):
                x = aft[i + 1][0]
                for _, j, k, s, _ in by_begin[i]:
                    x = add(x, s + (after[k] if before else 0) + aft[j][1])
                aft[i][before] = x
        whole = add(*fore[n])
        out: dict[tuple[str, int], float] = defaultdict(float)
        marks = {(lattice.places[i], k, lattice.places[j]): (i, j, k, s, f) for i, j, k, s, f in segments}
        ends = {e for _, _, e in gold}
        for g in gold:
            i, j, k, s, f = marks[g]
            for x in (*f, "bias"):
                out[x, k] += 1
            if g[0] in ends:
                out["after", k] += 1
        for i, j, k, s, f in segments:
            for before in (0, 1):
                p = fore[i][before] + s + (after[k] if before else 0) + aft[j][1] - whole
                if p > -12:
                    p = math.exp(min(0.0, p))
                    for x in (*f, "bias"):
                        out[x, k] -= p
                    if before:
                        out["after", k] -= p
        return out


def sentences(n: int, seed: int = 11) -> list[tuple[str, set[tuple[int, int, int]]]]:
    """Synthetic sentences with their entities."""
    r = random.Random(seed)
    pick, digits = r.choice, lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(pick(("an", "the", "ri", "or", "so", "ne", "la", "ver", "ti", "mo")) for _ in range(r.randint(1, 3)))

    def email() -> str:
        name = pick((word(), f"{word()}.{digits(2)}", f"{word()}_{word()}", f"{word()}{digits(r.randint(1, 3))}", f"{word()}.{word()}+{word()}"))
        host = f"{word()}{pick(('', digits(1)))}.{pick(('', word() + '.'))}{pick(('com', 'org', 'net', 'de', 'fr', 'io'))}"
        if r.random() < 0.35:
            return name + pick((" [at] ", "(at)", " (at) ", "[at]")) + host.replace(".", pick((".", " [dot] ", "(dot)")))
        return f"{name}@{host}"

    def checked(d: str) -> str:
        """The digits with a last one that makes the Luhn sum right."""
        return next(d + c for c in "0123456789" if luhn(d + c))

    def card() -> str:
        d = checked(pick("3456") + digits(pick((13, 14, 14, 14))))
        sep = pick(("", "", "", " ", "-"))
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if sep and len(d) == 16 else d

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick((f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)}-{a}-{b}{c}", f"+{digits(2)}{a}{b}{c}", f"+1 {a} {b} {c}", f"{a}.{b}.{c}"))

    def ip() -> str:
        return ".".join(str(r.randint(0, 255)) for _ in range(4))

    def unchecked(d: str, sep: str = "") -> str:
        """The digits in fours, with a wrong Luhn sum."""
        if luhn(d):
            d = d[:-1] + str((int(d[-1]) + 1) % 10)
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)) if sep else d

    def misleading() -> str:
        return pick((
            f"version {r.randint(1, 9)}.{r.randint(0, 9)}.", f"{r.randint(1900, 2099)}-{digits(2)}-{digits(2)}", f"{r.randint(1900, 2099)}", digits(r.randint(5, 11)), digits(r.randint(20, 30)),
            "".join(pick("0123456789abcdef") for _ in range(40)), "AKIA" + "".join(pick("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)), f"password={''.join(pick('0123456789abcdef') for _ in range(18))}",
            unchecked(pick("123456789") + digits(pick((11, 14, 15, 15, 15, 17)))), unchecked(pick("3456") + digits(15), " "), digits(10), f"order {digits(10)}", f"{digits(3)}.{digits(2)} {digits(11)}", f"no. {digits(12)}",
            f"{digits(2)}.{digits(2)}", f"{r.randint(256, 999)}.{digits(2)}.{r.randint(300, 999)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(2)}", f"@{word()}", f"{word()} @ {word()}", f"${digits(3)},{digits(3)}.{digits(2)}", f"{digits(4)} {digits(4)}", f"page={digits(1)}&ref={digits(5)}", f"{digits(3)}-{digits(2)}", f"{word()}{digits(9)}", f"0x{digits(12)}", f"{digits(3)} {digits(3)}", f"ISBN 978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"{digits(2)}:{digits(2)}:{digits(2)}",
        ))

    out = []
    makers = (email, ip, card, phone)
    for _ in range(n):
        text, gold = " ".join(word() for _ in range(r.randint(0, 3))), set()
        for _ in range(r.randint(1, 3)):
            text += pick((" ", " ", " ", ": ", "\n", " (", "; ")) if text else ""
            if r.random() < 0.55:
                kind = r.randrange(4)
                s = makers[kind]()
                gold.add((len(text), kind, len(text) + len(s)))
            else:
                s = misleading()
            text += s + pick(("", "", ".", ",", ")")) + pick((" ", " ", "\n")) + " ".join(word() for _ in range(r.randint(1, 3)))
        out.append((text, gold))
    return out


@functools.cache
def trained(n: int = 1000, rounds: int = 6) -> Model:
    """The model of the synthetic sentences: AdaGrad on the likelihood, sentence by sentence."""
    model, seen = Model(), defaultdict(float)
    data = []
    for text, gold in sentences(n):
        lattice = Lattice(text, 0, len(text))
        held = {(lattice.places[i], k, lattice.places[j]) for j in range(len(lattice.ends)) for i, _, kinds in lattice.ends[j] for k in kinds}
        if gold <= held:
            data.append((lattice, gold))
    for _ in range(rounds):
        for lattice, gold in data:
            for key, g in model.gradient(lattice, gold).items():
                g -= 1e-4 * model.weights[key]
                seen[key] += g * g
                model.weights[key] += 0.4 * g / (math.sqrt(seen[key]) + 1e-6)
    model.weights = dict(model.weights)
    return model


def find(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each (start, kind, end) in order."""
    if not _cue.search(text):
        return [], []
    base = base_spans(text)
    more = [e for a, b in windows(text) for e in model.decode(text, a, b)]
    free, i = [], 0
    by_start = sorted(base)
    reach = []
    top = 0
    for s, _, e in by_start:
        top = max(top, e)
        reach.append(top)
    for s, kind, e in sorted(more):
        while i < len(by_start) and by_start[i][0] < e:
            i += 1
        if i == 0 or reach[i - 1] <= s:
            free.append((s, kind, e))
    return base, sorted(base + free)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with [KIND] in place of each span; overlapping spans become one, named by the first."""
    out, at = [], 0
    merged: list[list[int]] = []
    for s, k, e in spans:
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([s, k, e])
    for s, k, e in merged:
        out += [text[at:s], f"[{KINDS[k].upper()}]"]
        at = e
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (doc_id, n_email, n_ip, n_card, n_phone: base spans; base_sha256, spans: all, n_added)."""
    handle = docs.sparkSession.sparkContext.broadcast(model)

    def work(ids: list, texts: list) -> dict:
        found = [find(t, handle.value) for t in texts]
        out = {f"n_{name}": [sum(s[1] == k for s in base) for base, _ in found] for k, name in enumerate(KINDS)}
        return out | {"doc_id": ids, "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in found], "spans": [joined(x) for _, x in found], "n_added": [len(x) - len(b) for b, x in found]}

    return common.map_texts(docs, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", work, id_col, text_col)


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, each span of their text replaced by its kind in brackets."""
    handle = docs.sparkSession.sparkContext.broadcast(model)
    return common.rewrite_texts(docs, lambda texts: [redacted(t, find(t, handle.value)[1]) for t in texts], text_col)
