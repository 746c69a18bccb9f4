"""Personal data: patterns, then boosted trees over high-recall candidates.

Four patterns give the base spans. Loose generators propose more: anything around an @
(also written [at] or (at)), addresses with [.] for a point, numbers of min_digits digits
or more between the usual separators as ip, card and phone at once, the long groups of
digits inside them, and long strings of letters and digits as secrets. So candidates
overlap. Boosted trees score each candidate that touches no base span by its format
(length, groups of digits, separators, checksum, entropy) and its context (neighbouring
characters, words that announce a kind). A calibrated threshold for each kind selects
those that are redacted beside the base spans, best first, where they don't overlap one
already taken.

The trees are trained here. The tables have no labels for spans, so their truth is
planted: into surroundings of a bounded sample of documents (at most train_docs, drawn by
a hash over the whole table) go planted items of known truth, personal data in forms that
the base patterns miss and look-alikes that are none (numbers that fail the checksum,
dates, orders, versions, digests). A candidate on an item is positive if it is exactly
the item's span and kind. The threshold of a kind is the lowest score above which
held-out candidates have at least the wanted precision, MIN_SCORE at least; without such
a score nothing of the kind is added. Boosted.report has precision and recall by kind on the held-out items.

Nulls and ties: a null or empty text has no spans; a null id is kept; rows that repeat are
judged alike; long texts are searched whole, in time linear in them but for the sort of
their candidates; an empty table trains no trees and gives no rows; other columns pass in
_row and can't clash. Of equal scores the candidate that comes first in the text, then in
the order of kinds, is taken. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchlake.llm._common import packed

#: The kinds in their order, of which the first four have base patterns.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
#: Most documents whose surroundings are used for training, and items planted in all.
TRAIN_DOCS, PLANTED = 4_000, 12_000
#: A kind's threshold keeps this precision on held-out items, MIN_HELD of them at least, and is never under MIN_SCORE.
PRECISION, MIN_HELD, MIN_SCORE = 0.98, 25, 0.5
MIN_DIGITS = 7
ROUNDS, DEPTH, RATE, BINS = 60, 3, 0.3, 32

#: The base patterns. The local part of an e-mail is found backwards from its @.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Loose forms.
AT = re.compile(r"@|\[at\]|\(at\)", re.I)
NAME_END, HOST = re.compile(r"[\w.%+-]{1,64}\s?$"), re.compile(r"\s?[\w-]+(?:(?:\.|\s?\[dot\]\s?)[\w-]+)*")
FANGLESS = re.compile(r"(?<![0-9])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?![0-9])")
NUMBER = re.compile(r"[+(]?[0-9][0-9().\x20/-]*[0-9]")
LONG = re.compile(r"[0-9]{12,19}")
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9+/_-]{14,}[A-Za-z0-9=]{1,3}")
WORD = re.compile(r"\w+")
#: Words that announce each kind, and some that announce none.
HINTS = {
    "email": frozenset("mail email contact address write adresse correo courriel".split()),
    "ip": frozenset("ip host server addr gateway node".split()),
    "card": frozenset("card visa credit mastercard carte tarjeta karte payment".split()),
    "phone": frozenset("tel phone call mobile fax telefon teléfono téléphone cell".split()),
    "secret": frozenset("token secret key password passwd apikey auth bearer credential api_key access_key".split()),
    "none": frozenset("order version invoice item isbn date commit sha256 sha1 md5 digest build ticket page chapter id".split()),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base spans, sorted."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in LOCAL:
            begin -= 1
        m = DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            found.append((begin, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= sum(map(str.isdecimal, m.group())) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def candidates(text: str, min_digits: int = MIN_DIGITS) -> Iterator[tuple[int, int, int]]:
    """(start, index of kind, end) of what may be personal data; spans of several kinds overlap."""
    for m in AT.finditer(text):
        left, right = NAME_END.search(text, max(0, m.start() - 66), m.start()), HOST.match(text, m.end())
        if left and right:
            yield left.start(), 0, right.end()
    for m in FANGLESS.finditer(text):
        yield m.start(), 1, m.end()
    for m in NUMBER.finditer(text):
        if sum(map(str.isdecimal, m.group())) >= min_digits:
            for kind in (1, 2, 3):
                yield m.start(), kind, m.end()
            for part in LONG.finditer(text, m.start(), m.end()):
                if part.span() != m.span():
                    yield part.start(), 2, part.end()
    for m in TOKEN.finditer(text):
        s = m.group()
        if any(map(str.isdigit, s)) and any(map(str.isalpha, s)):
            yield m.start(), 4, m.end()


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    s = text[start:end]
    groups = [len(x) for x in re.findall("[0-9]+", s)] or [0]
    digits, letters = sum(groups), sum(map(str.isalpha, s))
    plain = "".join(x for x in s if "0" <= x <= "9")
    before, after = WORD.findall(text[max(0, start - 40) : start].lower())[-4:], WORD.findall(text[end : end + 24])
    prev, following = text[start - 1 : start] if start else "", text[end : end + 1]
    said = set(before)
    ranges = [int(x) for x in re.findall("[0-9]{1,3}", s)[:4]] if kind == 1 else []
    chars = Counter(s)
    entropy = -sum(n / len(s) * math.log2(n / len(s)) for n in chars.values())
    form = [len(s), digits, len(groups), max(groups), min(groups), letters, digits / len(s), entropy, sum(x in "0123456789abcdef" for x in s) / len(s)]
    form += [s.count(x) for x in (".", "-", " ", "(", "/", "[", "_")] + [s[0] == "+", s[0] == "(", "@" in s, " " in s.strip(), "dot" in s.lower() or "." in s]
    form += [kind == 2 and 12 <= digits <= 19 and luhn(plain), len(ranges) == 4 and max(ranges) <= 255, sum(map(str.isupper, s)) / len(s), groups[0], groups[-1]]
    around = [prev.isalnum(), following.isalnum(), prev in ("", " ", "\n"), following in ("", " ", "\n", ".", ","), prev in ("\"", "'", "=", ":"), following in ("\"", "'"), "=" in text[max(0, start - 4) : start], ":" in text[max(0, start - 4) : start]]
    context = [bool(said & words) for words in HINTS.values()] + [bool(said & HINTS[KINDS[kind]]), any(x.isdecimal() for x in before[-1:] + after[:1])]
    return [kind, *form, *around, *context]


def _personal(r: random.Random) -> tuple[str, str, int]:
    """What comes before it, personal data in a form that the base patterns miss, and its kind."""
    number = lambda *n: r.choice(("-", " ", ".")).join("".join(str(r.randrange(10)) for _ in range(k)) for k in n)
    word = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    kind = r.randrange(len(KINDS))
    hint = r.choice(sorted(HINTS[KINDS[kind]])) + r.choice(("", ":", " is")) + " "
    if kind == 0:
        at, dot = r.choice((" [at] ", "[at]", " (at) ", "(at)")), r.choice((".", " [dot] ", "[dot]"))
        name = word(3, 9) + r.choice(("", f".{word(2, 6)}", str(r.randrange(100))))
        return r.choice((hint, "")), name + at + word(3, 9) + dot + r.choice(("com", "org", "net", "de", "fr", "es")), kind
    if kind == 1:
        parts = [str(r.randrange(1, 256)) for _ in range(4)]
        return r.choice((hint, "")), r.choice(("[.]".join(parts), ".".join(parts[:3]) + "[.]" + parts[3])), kind
    if kind == 2:
        digits = str(r.choice((4, 5, 37, 6))) + "".join(str(r.randrange(10)) for _ in range(14))
        digits = next(digits[:15] + str(x) for x in range(10) if luhn(digits[:15] + str(x)))
        if r.random() < 0.5:
            other = "".join(str(r.randrange(10)) for _ in range(r.randint(5, 16)))
            return r.choice((f"{hint}{other} ", f"{other} ")), digits, kind
        return r.choice((hint, "")), r.choice(("/", ".", "--")).join(digits[i : i + 4] for i in range(0, 16, 4)), kind
    if kind == 3:
        return r.choice(((hint, number(3, 3, 4)), (hint, f"0{number(2, 7)}"), (hint, f"00{number(2, 2, 7)}"), (r.choice((hint, "")), f"({number(3)}) {number(3)}-{number(4)}"))) + (kind,)
    made = r.choice((
        "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64)))),
        "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(20, 44))) + "7",
        r.choice(("ghp_", "sk-", "AKIA")) + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(r.randint(16, 36))) + "7K",
    ))
    return r.choice(sorted(HINTS["secret"])) + r.choice((" = \"", "=", ": ", "='", ": \"", " ")), made, kind


def _harmless(r: random.Random) -> tuple[str, str, None]:
    """A look-alike that is no personal data."""
    digits = lambda n: "".join(str(r.randrange(10)) for _ in range(n))
    word = lambda a, b: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice((32, 40, 64))))
    hint = r.choice(sorted(HINTS["none"])) + r.choice((" ", ": ", " no. "))
    failing = lambda: next(x for x in iter(lambda: digits(16), "") if not luhn(x))
    day = f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}"
    return r.choice((
        ("", failing()), ("", failing()), (f"{digits(6)} ", failing()), (r.choice((hint, "")), r.choice((".", "/", "--")).join(digits(4) for _ in range(4))),
        (hint, digits(r.randint(7, 12))), ("", digits(r.randint(7, 11))), ("", f"{day} {r.randint(10, 23)}:{r.randint(10, 59)}"), ("", f"{day}/{r.randint(10, 28)}"),
        (hint, f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}"), (hint, ".".join(digits(3) for _ in range(5))), (hint, f"{r.randint(300, 999)}.{digits(3)}.{digits(2)}.{digits(2)}"),
        ("", " ".join(digits(2) for _ in range(r.randint(4, 9)))), ("", f"{digits(4)} - {digits(4)}"), ("", f"{digits(2)}.{digits(4)} {digits(2)}.{digits(4)}"),
        (r.choice(("commit ", "sha256:", "sha1 ", "digest ", "md5: ", "")), hexes), ("", "-".join(word(3, 8) for _ in range(4)) + digits(2)), ("", f"/{word(4, 9)}/{word(4, 9)}_{digits(4)}"),
        ("", f"@{word(4, 9)}"), ("", f"{word(3, 8)}@{word(3, 8)}"), ("", f"{word(3, 8)} @ {digits(2)}"), ("", f"{word(3, 8)} (at) {word(3, 8)}"), ("", word(20, 30) + digits(1)),
    )) + (None,)


def planted(text: str, n: int, seed: int) -> Iterator[tuple[str, int, int, int | None]]:
    """n snippets of a text with an item between its words: snippet, the item's start and end, its kind or None."""
    r = random.Random(seed)
    for _ in range(n):
        at = r.randrange(len(text) + 1)
        at = text.find(" ", at) if " " in text[at:] else len(text)
        before, item, kind = _personal(r) if r.random() < 0.5 else _harmless(r)
        left = f"{text[max(0, at - 80) : at]} {before}"
        right = r.choice(("\"", "'")) if left[-1:] in "\"'" else r.choice(("", "", ",", "."))
        yield f"{left}{item}{right}{text[at : at + 60]}", len(left), len(left) + len(item), kind


class Boosted:
    """Boosted trees of one depth for a yes-or-no label, as arrays: node i has the children 2i + 1 and 2i + 2."""

    def __init__(self, rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE):
        self.rounds, self.depth, self.rate = rounds, depth, rate
        self.base, self.trees, self.thresholds, self.report = 0.0, [], [2.0] * len(KINDS), {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        """Splits are chosen on histograms of the columns' quantiles."""
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(t, c, "left") for t, c in zip(cuts, x.T)], 1)
        score, inner, leaves = np.full(len(y), self.base), 2**self.depth - 1, 2**self.depth
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            gradient, weight = y - p, p * (1 - p)
            column, cut, node = np.zeros(inner, int), np.full(inner, np.inf), np.zeros(len(y), int)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                gain, at = np.full(count, 1e-6), [None] * count
                for c, t in enumerate(cuts):
                    key = (node - first) * (BINS + 1) + binned[:, c]
                    g, w = (np.bincount(key, v, count * (BINS + 1)).reshape(count, -1) for v in (gradient, weight))
                    left_g, left_w, all_g, all_w = g.cumsum(1)[:, : len(t)], w.cumsum(1)[:, : len(t)], g.sum(1, keepdims=True), w.sum(1, keepdims=True)
                    won = left_g**2 / (left_w + 1) + (all_g - left_g) ** 2 / (all_w - left_w + 1) - all_g**2 / (all_w + 1)
                    for i, j in enumerate(won.argmax(1).tolist()):
                        if won[i, j] > gain[i]:
                            gain[i], at[i] = won[i, j], (c, j)
                for i, found in enumerate(at):
                    if found:
                        column[first + i], cut[first + i] = found[0], cuts[found[0]][found[1]]
                node = 2 * node + 1 + (x[np.arange(len(y)), column[node]] > cut[node])
            total_g, total_w = np.bincount(node - inner, gradient, leaves), np.bincount(node - inner, weight, leaves)
            value = self.rate * total_g / (total_w + 1.0)
            self.trees.append((column, cut, value))
            score += value[node - inner]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        score, rows, inner = np.full(len(x), self.base), np.arange(len(x)), 2**self.depth - 1
        for column, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, column[node]] > cut[node])
            score += value[node - inner]
        return 1 / (1 + np.exp(-score))

    def calibrate(self, x: np.ndarray, y: np.ndarray, precision: float = PRECISION, least: int = MIN_HELD) -> Boosted:
        """For each kind the lowest score from MIN_SCORE on that keeps the precision on held-out rows, at least `least` of them."""
        p = self.predict(x)
        for k, kind in enumerate(KINDS):
            own = x[:, 0] == k
            if not own.any():
                continue
            order = np.argsort(-p[own], kind="stable")
            scores, right = p[own][order], np.cumsum(y[own][order])
            n = np.arange(1, len(order) + 1)
            good = np.flatnonzero((right / n >= precision) & (n >= least) & (scores > np.append(scores[1:], -1)))
            self.thresholds[k] = max(MIN_SCORE, float(scores[good[-1]])) if len(good) else 2.0
            chosen = p[own] >= self.thresholds[k]
            held = y[own] > 0
            share = lambda a, b: round(float((a & b).sum() / max(1, a.sum())), 4)
            self.report[kind] = {"rows": int(own.sum()), "positive": int(held.sum()), "precision": share(chosen, held), "recall": share(held, chosen)}
        return self


def _touches(taken: list[tuple[int, int, int]], start: int, end: int) -> bool:
    """taken: spans in order that don't overlap each other (base spans of several kinds may)."""
    i = bisect.bisect_left(taken, (start,))
    return i < len(taken) and taken[i][0] < end or i > 0 and taken[i - 1][2] > start


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans in order as runs that don't overlap."""
    out = []
    for s, k, e in sorted(spans):
        if out and s < out[-1][2]:
            out[-1] = (out[-1][0], k, max(e, out[-1][2]))
        else:
            out.append((s, k, e))
    return out


def _labelled(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, labels = [], []
            for text, seed in zip(b.column("_text").to_pylist(), b.column("seed").to_pylist()):
                for snippet, start, end, kind in planted(text or "", n, seed):
                    base = _joined(base_spans(snippet))
                    for c in candidates(snippet):
                        if c[0] < end and start < c[2] and not _touches(base, c[0], c[2]):
                            rows.append([float(v) for v in features(snippet, *c)])
                            labels.append(int(c == (start, kind, end)))
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int32())], ["x", "y"])

    return run


def train(
    docs: DataFrame,
    train_docs: int = TRAIN_DOCS,
    items: int = PLANTED,
    precision: float = PRECISION,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Boosted:
    """Trees fitted and calibrated on candidates of about `items` planted items in about train_docs documents.

    At most 8 * items candidates reach the driver.
    """
    model, n = Boosted(), docs.count()
    share = min(1 << 20, -(-(train_docs << 20) // max(n, 1)))
    seed = F.xxhash64(id_col, text_col)
    drawn = docs.where(seed.bitwiseAND(F.lit((1 << 20) - 1)) < share).select(F.col(text_col).alias("_text"), seed.alias("seed"))
    each = -(-items // max(1, min(n, train_docs)))
    rows = drawn.mapInArrow(_labelled(each), "x array<double>, y int").orderBy(F.xxhash64("x", "y")).limit(8 * items).toArrow()
    if not rows.num_rows or not 0 < sum(rows.column("y").to_pylist()) < rows.num_rows:
        return model
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    y = rows.column("y").to_numpy().astype(float)
    held = np.arange(len(y)) % 4 == 0
    return model.fit(x[~held], y[~held]).calibrate(x[held], y[held], precision)


def added_spans(model: Boosted, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """For each text the spans that the trees add to its base spans."""
    asked, x, taken = [], [], [_joined(s) for s in base]
    for i, text in enumerate(texts):
        for c in candidates(text):
            if model.thresholds[c[1]] <= 1 and not _touches(taken[i], c[0], c[2]):
                asked.append((i, c))
                x.append(features(text, *c))
    added = [[] for _ in texts]
    if asked:
        score = model.predict(np.array(x, float))
        for j in sorted(range(len(asked)), key=lambda j: (-score[j], asked[j])):
            i, c = asked[j]
            if score[j] >= model.thresholds[c[1]] and not _touches(taken[i], c[0], c[2]):
                bisect.insort(taken[i], c)
                added[i].append(c)
    return added


COUNTS = tuple(f"n_{k}" for k in BASE_KINDS)


def _finder(model: Boosted):
    said = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("_text").to_pylist()]
            base = [base_spans(t) for t in texts]
            added = added_spans(model, texts, base)
            count = [[sum(k == i for _, k, _ in s) for i in range(len(BASE_KINDS))] for s in base]
            cols = [pa.array([c[i] for c in count], pa.int64()) for i in range(len(BASE_KINDS))]
            digests = pa.array([hashlib.sha256(said(s).encode()).hexdigest() for s in base], pa.string())
            spans = pa.array([said([*x, *y]) for x, y in zip(base, added)], pa.string())
            n_spans = pa.array([len(x) + len(y) for x, y in zip(base, added)], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_row"), *cols, digests, spans, n_spans], ["_row", *COUNTS, "base_sha256", "spans", "n_spans"])

    return run


def find(docs: DataFrame, model: Boosted, text_col: str = "text") -> DataFrame:
    """_row (a struct of all columns), the number of base spans of each kind, base_sha256, spans (all, those that the trees add included) and n_spans."""
    rows = packed(docs, text_col).withColumnRenamed(f"_{text_col}", "_text")
    row = rows.schema["_row"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in COUNTS)
    return rows.mapInArrow(_finder(model), f"_row {row}, {counts}, base_sha256 string, spans string, n_spans bigint")


def redact(text: str, spans: str) -> str:
    """text with every span replaced by its kind."""
    out, at = [], 0
    for x in spans.split(",") if spans else []:
        kind, start, end = x.split(":")
        if int(end) > at:
            out += [text[at : max(at, int(start))], f"[{kind}]"] if int(start) >= at else []
            at = int(end)
    return "".join(out) + text[at:]
