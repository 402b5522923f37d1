"""Personal data: candidates, boosted trees, calibrated thresholds.

Base spans follow fixed patterns and always stay. Beyond them, generators of high recall propose spans of
the four kinds in other writings (spelled-out or defanged addresses, other separators, no plus sign), which
may overlap. Boosted trees score each candidate by its format and the words around it; a candidate counts
from the probability at which held-out candidates of its kind reach the wanted precision, and of overlapping
ones the most probable stays. The trees are fitted to sentences made from a seed, never to the corpus.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

KINDS = ("email", "ip", "card", "phone")
#: The base patterns (fixed values).
BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same matches, without a second look at a run of digits or of an address's characters.
LINEAR = BASE | {"ip": re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")}
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Cheap tests without which a kind can't match.
NEEDS = {"ip": re.compile(r"[0-9]\.[0-9]"), "card": re.compile(r"[0-9][\x20-]?[0-9]"), "phone": re.compile(r"\+[0-9]")}
AT = r"\s?(?:@|\(at\)|\[at\]|\{at\}|\sat\s)\s?"
DOT = r"\s?(?:\.|\(dot\)|\[dot\]|\{dot\}|\[\.\]|\sdot\s)\s?"
#: Generators of addresses: a test that is quick to fail, and a pattern that is tried from each place on. Lengths of local parts and labels are those of the standard.
CANDIDATES = {
    "email": (re.compile(rf"(?i)@|[({{\[]at[)}}\]]|\sat\s\s?[a-z0-9-]+{DOT}"), re.compile(rf"(?i)(?<![a-z0-9._%+-])(?=([a-z0-9._%+-]{{1,64}}{AT}[a-z0-9-]{{1,63}}(?:{DOT}[a-z0-9-]{{2,63}})+))")),
    "ip": (re.compile(r"[0-9]\s?(?:\[\.\]|\(\.\)|\.|\[dot\]|\(dot\)|,)\s?[0-9]"), re.compile(r"(?<![0-9])(?=([0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\.|\[dot\]|\(dot\)|,)\s?[0-9]{1,3}){3})(?![0-9]))")),
}
#: What may stand between the groups of digits of a number, and the digits that it has.
GAPS = {"card": re.compile(r"[\s./_·-]{0,3}"), "phone": re.compile(r"[\s()./-]{0,3}")}
DIGITS = {"card": (12, 19), "phone": (9, 15)}
GROUP = re.compile("[0-9]+")
#: A phone number has so many groups of digits at most.
PHONE_GROUPS = 6
DIGIT = re.compile("[0-9]")
#: Words that speak for a kind or against all, in the text before a span.
CUES = {
    "email": ("mail", "contact", "write", "reach", "address", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "login", "client", "logged", "connection"),
    "card": ("card", "visa", "pay", "credit", "debit", "karte", "carte", "tarjeta", "charged"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "ring", "text", "number", "whatsapp"),
    "not": ("version", "order", "isbn", "section", "invoice", "build", "release", "total", "serial", "ticket", "date", "score", "id", "page"),
}
WORD = re.compile(r"[a-z]+")
#: More digits before or after a span, as if it were a part of something longer.
TAIL, HEAD = re.compile(r"[0-9][\s()./_·-]{0,3}$"), re.compile(r"[\s()./_·-]{0,3}[0-9]")
ROUNDS, DEPTH, RATE, BINS = 60, 3, 0.2, 32
SENTENCES = 6000
PRECISION = 0.98


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else x * 2 - 9 * (x > 4)
    return total % 10 == 0


def is_valid(kind: str, span: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in span.split(".")))
    digits = "".join(DIGIT.findall(span))
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 9 <= len(digits) <= 15


def emails(text: str) -> list[tuple[str, int, int]]:
    """Matches of the base pattern, found from each @ outwards: linear in the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns: leftmost, not overlapping within a kind; matches that fail their test go, without a retry."""
    return emails(text) + [(k, m.start(), m.end()) for k in KINDS[1:] if NEEDS[k].search(text) for m in LINEAR[k].finditer(text) if is_valid(k, m[0])]


def numbers(text: str, free) -> list[tuple[str, int, int]]:
    """Cards and phones: from each group of digits to each later one with which the number has the right size. A card passes Luhn's test; a phone takes the bracket, plus sign or both before it."""
    out = []
    groups = [(m.start(), m.end()) for m in GROUP.finditer(text)]
    for i, (start, _) in enumerate(groups):
        n, fits = 0, {"card": True, "phone": start == 0 or not text[start - 1].isalpha()}
        for j in range(i, len(groups)):
            a, end = groups[j]
            n += end - a
            if j > i:
                gap = text[groups[j - 1][1] : a]
                fits = {k: ok and len(gap) <= 3 and GAPS[k].fullmatch(gap) is not None for k, ok in fits.items()}
            if n > DIGITS["card"][1] or not any(fits.values()):
                break
            if fits["card"] and n >= DIGITS["card"][0] and luhn("".join(text[x:y] for x, y in groups[i : j + 1])) and free(start, end):
                out.append(("card", start, end))
            if fits["phone"] and DIGITS["phone"][0] <= n <= DIGITS["phone"][1] and j - i < PHONE_GROUPS:
                first = start
                while first > 0 and start - first < 2 and text[first - 1] in "+(":
                    first -= 1
                if first < start and text[first] == "(" and ")" not in text[first:end]:
                    first = start
                if free(first, end):
                    out.append(("phone", first, end))
    return out


def proposals(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates of all kinds, which may overlap, but share no character with a base span."""
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end)  # spans that begin before the end
        return not k or reach[k - 1] <= start

    digits = DIGIT.search(text) is not None
    out = []
    for kind, (test, pattern) in CANDIDATES.items():
        if (kind == "email" or digits) and test.search(text):
            out += [(kind, m.start(1), m.end(1)) for m in pattern.finditer(text) if free(m.start(1), m.end(1))]
    return out + (numbers(text, free) if digits else [])


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a span."""
    span = text[start:end]
    digits = "".join(DIGIT.findall(span))
    groups = re.findall("[0-9]+", span)
    seps = re.findall(r"[^0-9A-Za-z]+", span)
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 16].lower()
    words = WORD.findall(before)[-4:]
    octets = len(groups) == 4 and all(int(g) <= 255 for g in groups if len(g) < 5)
    return [
        *[float(kind == k) for k in KINDS],
        len(span), len(digits), len(groups), len(seps), len(set(seps)), len(set(digits)),
        max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        float(bool(digits) and luhn(digits)), float(octets),
        float(span[:1] in "+("), float(span.startswith("00")), float("(" in span), float("[" in span or "{" in span), float("@" in span),
        float(bool(re.search(r"(?i)\bat\b", span))), float(bool(re.search(r"(?i)\bdot\b|\[\.\]", span))), float(any(c.isspace() for c in span)), float("," in span), float("/" in span), float("." in span),
        float(bool(re.search(r"(?i)(com|org|net|edu|io|de|fr|es)$", span))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(bool(TAIL.search(before))), float(bool(HEAD.match(after))), float(before[-1:] in "#$€v="), float(after[:1] in "%€$"),
        *[float(any(w.startswith(c) for w in words for c in CUES[k])) for k in (*KINDS, "not")],
        float(any(w.startswith(c) for w in words for c in CUES[kind])),
    ]


class Trees:
    """Boosted regression trees of a fixed depth on binned features, for a 0/1 target."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        bins = self.binned(x)
        self.start = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score = np.full(len(y), self.start)
        self.trees: list[tuple[list[int], list[int], np.ndarray]] = []
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            split: list[tuple[int, int]] = []
            for level in range(DEPTH):  # one split for all nodes of a level
                best, choice = -1.0, (0, BINS)
                for j in range(x.shape[1]):
                    cell = node * BINS + bins[:, j]
                    g, h = (np.bincount(cell, v, (1 << level) * BINS).reshape(-1, BINS).cumsum(1) for v in (grad, hess))
                    gain = (g**2 / (h + 1) + (g[:, -1:] - g) ** 2 / (h[:, -1:] - h + 1)).sum(0)
                    if gain[:-1].max() > best:
                        best, choice = float(gain[:-1].max()), (j, int(gain[:-1].argmax()))
                split.append(choice)
                node = node * 2 + (bins[:, choice[0]] > choice[1])
            g, h = (np.bincount(node, v, 1 << DEPTH) for v in (grad, hess))
            leaf = RATE * g / (h + 1)
            score += leaf[node]
            self.trees.append(([j for j, _ in split], [c for _, c in split], leaf))

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(self.cuts)], 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = self.binned(x)
        out = np.full(len(x), self.start)
        for js, cs, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for j, c in zip(js, cs, strict=True):
                node = node * 2 + (bins[:, j] > c)
            out += leaf[node]
        return out


def made_sentences(n: int, seed: int) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with the spans of personal data in them, and look-alikes without."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    syllables = ("an", "ber", "to", "ri", "le", "mon", "sa", "ki", "dor", "el", "un", "the", "of", "ver", "ou", "ti")
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    words = lambda k: " ".join(word() for _ in range(rng.randint(0, k)))

    def card(good: bool) -> str:
        while True:
            d = rng.choice("3456") + digits(15)
            if luhn(d) == good:
                break
        sep = rng.choice((".", "  ", "/", "_", "·", " - ")) if good else rng.choice(("", " ", "-", "."))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{digits(2)} {a} {b} {c}", f"0{digits(2)} {digits(4)} {digits(4)}"))

    def mail() -> str:
        at, dot = rng.choice(((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", " . "), ("(at)", "."), ("@", "[.]"), ("{at}", "{dot}")))
        return f"{word()}{rng.choice(('', digits(2)))}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de', 'fr', 'example'))}"

    def address() -> str:
        sep = rng.choice(("[.]", "(.)", " . ", "[dot]"))
        return sep.join(str(rng.randint(0, 255)) for _ in range(4))

    def unlike() -> tuple[str, str]:
        return rng.choice((
            ("version", ".".join(str(rng.randint(0, 40)) for _ in range(4)) + "." + digits(3)), ("order", digits(rng.choice((8, 10, 12, 14)))), ("isbn", f"978-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}"),
            ("order", card(False)), ("", card(False)), ("on", f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)} 1{digits(1)}:{digits(2)}:{digits(2)}"), ("", digits(rng.choice((9, 10, 11, 13)))),
            ("values", ", ".join(digits(rng.randint(1, 3)) for _ in range(rng.randint(4, 8)))), ("look", f"{word()} at {word()}. {word().title()} {word()}"), ("met", f"{word()} at {word()} {word()}"),
            ("list", " ".join(digits(rng.randint(1, 4)) for _ in range(rng.randint(4, 9)))), ("total", f"{digits(3)}.{digits(3)}.{digits(3)}"), ("serial", f"{digits(3)}-{digits(3)}-{digits(4)}"), ("ticket", digits(16)),
            ("score", f"{digits(2)}.{digits(2)} {digits(2)}.{digits(2)} {digits(2)}.{digits(2)}"), ("", f"{rng.randint(256, 999)}[.]{digits(2)}[.]{digits(2)}[.]{digits(1)}"),
        ))

    out = []
    for _ in range(n):
        if rng.random() < 0.45:
            kind = rng.choice(KINDS)
            span = {"card": lambda: card(True), "phone": phone, "email": mail, "ip": address}[kind]()
            cue = rng.choice(CUES[kind]) if rng.random() < (0.6 if kind in ("email", "ip") else 0.9) else ""
            labels = [kind]
        else:
            cue, span = unlike()
            labels = []
        lead = " ".join(x for x in (words(8), cue, rng.choice(("", "is", "me", ":", "on"))) if x)
        parts = [lead, span]
        if labels and kind in ("card", "phone") and rng.random() < 0.25:  # another number beside it
            parts.insert(rng.choice((1, 2)), digits(rng.randint(1, 4)))
        elif labels == ["phone"] and rng.random() < 0.15:
            parts.append(phone())
            labels.append("phone")
        spans, text = [], ""
        for part in parts:
            text += " " * bool(text)
            if labels and part is not lead and len(part) > 4:
                spans.append((labels[len(spans)], len(text), len(text) + len(part)))
            text += part
        out.append((text + rng.choice(("", ".", ",", " " + words(6))), spans))
    return out


class Detector:
    """The trees, and the score from which a candidate of each kind counts."""

    def __init__(self, sentences: int = SENTENCES, precision: float = PRECISION, seed: int = 11):
        rows = []
        for s, (text, truth) in enumerate(made_sentences(sentences, seed)):
            rows += [(s, k, features(text, k, a, b), (k, a, b) in truth) for k, a, b in proposals(text, base_spans(text))]
        x, y = np.array([r[2] for r in rows], float), np.array([r[3] for r in rows], float)
        fit = np.array([r[0] % 3 != 0 for r in rows])
        self.trees = Trees(x[fit], y[fit])
        score, truth, kind = self.trees.score(x[~fit]), y[~fit] > 0, np.array([r[1] for r in rows])[~fit]
        # Platt's scaling on the held-out third turns scores into probabilities
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * score + b)))
            w = p * (1 - p) + 1e-9
            h = np.array([[(w * score * score).sum() + 1e-3, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-3]])
            a, b = np.array([a, b]) + np.linalg.solve(h, [((truth - p) * score).sum(), (truth - p).sum()])
        self.scale = float(a), float(b)
        p = self.probability(score)
        self.least = {}
        for k in KINDS:
            ok = [t for t in np.unique(p[(kind == k) & truth]) if t >= 0.5 and truth[(kind == k) & (p >= t)].mean() >= precision]
            self.least[k] = float(min(ok, default=math.inf))

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale[0] * score + self.scale[1])))

    def select(self, texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
        """The candidates of each text that count."""
        found = [(i, c) for i, t in enumerate(texts) for c in proposals(t, base[i])]
        out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        if not found:
            return out
        p = self.probability(self.trees.score(np.array([features(texts[i], *c) for i, c in found], float)))
        ends: list[list[int]] = [[] for _ in texts]  # starts and ends of what counts, in order: both ends of a free span lie in one gap
        for _, (i, (k, a, b)) in sorted(((q, c) for q, c in zip(p.tolist(), found, strict=True) if q >= self.least[c[1][0]]), key=lambda z: (-z[0], z[1][0], z[1][1][1] - z[1][1][2], z[1][1])):
            at = bisect_right(ends[i], a)
            if at % 2 == 0 and (at == len(ends[i]) or ends[i][at] >= b):
                out[i].append((k, a, b))
                ends[i][at:at] = [a, b]
        return out


@lru_cache(maxsize=2)
def detector(sentences: int = SENTENCES, precision: float = PRECISION) -> Detector:
    return Detector(sentences, precision)


def in_line(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each run of overlapping spans replaced by the name of its first kind in brackets."""
    out, at = [], 0
    for k, a, b in in_line(spans):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(df: DataFrame, text: str = "text", names: tuple[str, str, str] = ("base_spans", "pii_spans", "redacted"), with_text: bool = True) -> DataFrame:
    """Adds the base spans, all spans (both by start, then kind) and, if asked for, the redacted text.

    Offsets are code points, ends exclusive. A null text has no spans and stays null when redacted. Columns of these names are replaced.
    """
    names = names[: 2 + with_text]
    df = df.drop(*names)
    at = df.columns.index(text)
    kind = "array<struct<kind:string,start:int,end:int>>"
    schema = df.select("*", *[F.lit(None).cast(kind).alias(n) for n in names[:2]], *[F.lit("").alias(n) for n in names[2:]]).schema
    for f in schema.fields[len(df.columns) :]:
        f.nullable = True
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    model = detector()  # some tens of small trees

    def run(batches):
        as_rows = lambda spans: pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], arrow)
        for b in slices(batches):
            given = b.column(at).to_pylist()
            texts = [t or "" for t in given]
            base = [in_line(base_spans(t)) for t in texts]
            more = [in_line([*x, *y]) for x, y in zip(base, model.select(texts, base), strict=True)]
            new = [as_rows(base), as_rows(more)]
            if with_text:
                new.append(pa.array([t and redact(t, s) for t, s in zip(given, more, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, *names])

    return df.mapInArrow(run, schema)
