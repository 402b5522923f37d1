"""Toxicity by a support vector machine on a subsequence string kernel, with Nystroem landmarks.

The kernel of two words counts the subsequences of four letters that they have in common, gaps allowed: one that
spans s letters weighs DECAY**s, up to SPAN of them, so that inserted letters lower the kernel without destroying it. A mark before each word counts as a letter, so that beginnings differ from middles. A word is a run
between white space, its letters alone ("i.d-i*o.t" is one word), and single letters in a row make one word ("i d i o t").
Letters that stand for Latin ones (full-width, mathematical) count as these.

The machine learns from labelled sentences, of which each is as toxic as its worst word. A sentence of a toxic document is
toxic if it has a telling fragment, one that tells toxic from other documents beyond chance; its other sentences say nothing;
those of other documents are clean. Clean sentences ask that none of their words is over the margin: words are taken in until
no clean word outside is, so that the machine is that of all of them. Landmarks are telling fragments and frequent harmless
words. Since the kernel has an explicit form, the decision folds into one weight for each four letters. A document's score comes
from its worst word and from all words beyond the margin, by a logistic fit to labelled documents that were set aside.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter
from functools import cached_property, lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fold, lanes_of, slices
from .windows import spread

DECAY = 0.6
ORDER = 4
SPAN = 2 * ORDER - 1
BITS = 6
#: The mark that stands before a word.
BEGIN = 63
#: Labelled documents that the model sees at most, about, of either label; chosen by a hash of the id.
TRAINING_DOCS = 2000
#: Bytes of text of either label that the driver holds at most; a single text may be longer.
TRAINING_BYTES = 64 << 20
#: Landmarks, and frequent harmless words among them, at least; telling fragments are landmarks whatever their number.
LANDMARKS = 96
HARMLESS = 32
#: Telling fragments: least length with the mark, least odds against other documents, least number of toxic documents, and the false ones that are accepted.
FRAGMENT = 5
ODDS = 4
LEAST = 2
FALSE = 0.05
#: Fragments that are taken where none is told from chance.
FALLBACK = 256
#: A harmless word weighs by its number of clean documents, to this power.
POWER = 0.5
#: Clean words that are taken in at first and in each further round, and rounds at most.
STEP, ROUNDS = 1000, 25
#: How often harmless words that are taken for toxic ones become landmarks.
TURNS = 3
#: Where the further letters of a subsequence stand, from its first one.
OFFSETS = list(combinations(range(1, SPAN), ORDER - 1))
SENTENCE = re.compile(r"[.!?]+\s|[\n\r]+")


@lru_cache(maxsize=1)
def letter_codes() -> np.ndarray:
    """A code below BEGIN for each character: 1 to 26 for Latin letters and what stands for one, up to 62 for others, 0 for what isn't a letter, -1 for white space."""
    out = np.zeros(0x110000, np.int8)
    for c in range(0x110000):
        x = chr(c)
        if x.isspace():
            out[c] = -1
        elif x.isalpha():
            first = x if c < 128 else unicodedata.normalize("NFKC", x).lower()[:1]
            out[c] = ord(first) - 96 if "a" <= first <= "z" else 27 + c % 36
    return out


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The letters of all texts in a row, each word after its mark, the place of each word's mark, and the first word of each text."""
    lower = [t.lower() for t in texts]
    raw = np.frombuffer(" ".join(lower).encode("utf-32-le", "surrogatepass"), "<u4")
    code = letter_codes()[raw]
    text_ends = np.cumsum([len(t) + 1 for t in lower])
    at = np.flatnonzero(code > 0)
    if not len(at):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    token = np.cumsum(code < 0)[at]
    first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
    text = np.searchsorted(text_ends, at[first], "right")
    single = np.diff(np.append(first, len(at))) == 1
    joins = np.concatenate([[False], single[1:] & single[:-1] & (text[1:] == text[:-1]) & (token[first[1:]] == token[first[:-1]] + 1)])
    first, text = first[~joins], text[~joins]
    return np.insert(code[at].astype(np.uint8), first, BEGIN), first + np.arange(len(first)), np.searchsorted(text, np.arange(len(texts)))


def cut(letters: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Each word as bytes, its mark included."""
    data, ends = letters.tobytes(), [*first[1:].tolist(), len(letters)]
    return [data[a:b] for a, b in zip(first.tolist(), ends, strict=True)] if len(first) else []


def joined(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of words in a row, and where each begins."""
    size = np.array([len(w) for w in words], np.int64)
    return np.frombuffer(b"".join(words), np.uint8), np.cumsum(size) - size


def sentences(text: str) -> list[list[bytes]]:
    """The words of each sentence that has one."""
    parts = [cut(*words_of([s])[:2]) for s in SENTENCE.split(text)]
    return [p for p in parts if p]


def subsequences(letters: np.ndarray, first: np.ndarray):
    """(codes, span) for each pattern of offsets, by the first letter's place; the code of a subsequence that leaves its word is 0."""
    word = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(letters))))
    letters = letters.astype(np.int32)
    n = len(letters)
    for offsets in OFFSETS:
        m = n - offsets[-1]
        if m > 0:
            code = letters[:m]
            for o in offsets:
                code = (code << BITS) | letters[o : o + m]
            yield np.where(word[:m] == word[offsets[-1] :], code, 0), offsets[-1] + 1


def norms(letters: np.ndarray, first: np.ndarray, step: int = 1 << 17) -> np.ndarray:
    """The norm of each word's features, those that come several times added up; a word without any has a tiny one. Some letters at a time."""
    out = np.full(len(first), 1e-12)
    ends = np.append(first[1:], len(letters))
    a = 0
    while a < len(first):
        b = max(a + 1, int(np.searchsorted(ends, first[a] + step, "right")))
        own, begin = letters[first[a] : ends[b - 1]], first[a:b] - first[a]
        word = np.repeat(np.arange(b - a, dtype=np.int64), ends[a:b] - first[a:b])
        keys = []
        for codes, span in subsequences(own, begin):
            some = np.flatnonzero(codes)
            keys.append((word[some] << np.int64(ORDER * BITS + 2)) | (codes[some].astype(np.int64) << np.int64(2)) | np.int64(span - ORDER))
        key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        if len(key):
            weight = (DECAY ** np.arange(ORDER, ORDER + 4))[key & 3]
            at = np.flatnonzero(np.concatenate([[True], key[1:] >> 2 != key[:-1] >> 2]))
            total = np.add.reduceat(weight, at)
            out[a:b] += np.bincount(key[at] >> (ORDER * BITS + 2), total * total, b - a)
        a = b
    return np.sqrt(out)


class Landmarks:
    """Landmark words by their normalised features: a row for each code that one of them has."""

    def __init__(self, words: list[bytes]):
        letters, first = joined(words)
        word = np.repeat(np.arange(len(words)), np.diff(np.append(first, len(letters))))
        found = [(codes, word[: len(codes)], DECAY**span) for codes, span in subsequences(letters, first)]
        every = np.concatenate([c for c, _, _ in found]) if found else np.zeros(0, np.int32)
        self.codes = np.unique(every[every > 0])
        self.features = np.zeros((len(self.codes), len(words)))
        for codes, owner, weight in found:
            some = np.flatnonzero(codes)
            np.add.at(self.features, (np.searchsorted(self.codes, codes[some]), owner[some]), weight)
        self.features /= norms(letters, first)

    def kernel(self, words: list[bytes], step: int = 256) -> np.ndarray:
        """The kernel of each word with each landmark."""
        out = np.zeros((len(words), self.features.shape[1]))
        n = len(self.codes)
        for at in range(0, len(words) if n else 0, step):
            letters, first = joined(words[at : at + step])
            word = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(letters))))
            counts = np.zeros(len(first) * n)
            for codes, span in subsequences(letters, first):
                place = np.minimum(np.searchsorted(self.codes, codes), n - 1)
                some = np.flatnonzero(self.codes[place] == codes)
                np.add.at(counts, word[some] * n + place[some], DECAY**span)
            out[at : at + step] = counts.reshape(len(first), n) @ self.features / norms(letters, first)[:, None]
        return out


def separate(x: np.ndarray, y: np.ndarray, size: np.ndarray, c: float = 100.0, rounds: int = 60, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss, by Newton steps from `start`; y is -1 or 1. Both classes weigh the same, an example within its class by its size."""
    x = np.hstack([x, np.ones((len(x), 1))])
    total = {side: max(size[y == side].sum(), 1e-12) for side in (-1, 1)}
    cost = c * 0.5 * size / np.where(y > 0, total[1], total[-1]) * len(y)
    w = np.zeros(x.shape[1]) if start is None else start
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    loss = lambda w: 0.5 * w @ ridge @ w + 0.5 * cost @ np.maximum(0, 1 - y * (x @ w)) ** 2
    for _ in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ w))
        on = slack > 0
        grad = ridge @ w - x.T @ (cost * slack * y)
        step = np.linalg.solve(ridge + (x[on].T * cost[on]) @ x[on], grad)
        now = loss(w)
        while loss(w - step) > now and np.abs(step).max() >= 1e-6:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-4:
            break
    return w[:-1], float(w[-1])


class Model:
    """One weight for each four letters, a bias, and the logistic weights of a document's measures."""

    def __init__(self, codes: np.ndarray, weights: np.ndarray, bias: float, logistic: np.ndarray):
        self.codes, self.weights, self.bias, self.logistic = codes, weights.astype(np.float32), bias, logistic

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "table"}  # the table is made where it is used

    @cached_property
    def table(self) -> np.ndarray:
        """The weights by code: 64 MB."""
        out = np.zeros(1 << (ORDER * BITS), np.float32)
        out[self.codes] = self.weights
        return out

    def word_margins(self, letters: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Each word's margin; words that come several times are looked at once."""
        ends = np.append(first[1:], len(letters))
        _, at, own = np.unique(lanes_of(letters.tobytes(), first, ends)[0], return_index=True, return_inverse=True)
        size = (ends - first)[at]
        some, begin = letters[spread(first[at], size)], np.cumsum(size) - size
        total = np.zeros(len(some))
        for codes, span in subsequences(some, begin):
            total[: len(codes)] += DECAY**span * self.table[codes]
        return (np.add.reduceat(total, begin) / norms(some, begin) + self.bias)[own]

    def measures(self, texts: list[str]) -> np.ndarray:
        """For each text the worst word's margin (the bias if there is no word), the sum of margins above 0 on a log scale and against
        the text's length, and 1."""
        letters, first, docs = words_of(texts)
        out = np.tile([self.bias, 0.0, 0.0, 1.0], (len(texts), 1))
        if len(first):
            value = self.word_margins(letters, first)
            n = np.append(docs[1:], len(first)) - docs
            full = np.flatnonzero(n)
            over = np.add.reduceat(np.maximum(value, 0), docs[full])
            out[full, 0] = np.maximum(self.bias, np.maximum.reduceat(value, docs[full]))
            out[full, 1] = np.log1p(over)
            out[full, 2] = np.minimum(over / np.sqrt(n[full]), 2)
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.measures(texts) @ self.logistic, -30, 30)))


def logistic_fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic weights for targets a little off 0 and 1, by Newton steps that are halved until they gain."""
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    loss = lambda w: (np.logaddexp(0, x @ w) - target * (x @ w)).sum() + 0.025 * w @ w
    w = np.zeros(x.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x.T * (p * (1 - p) + 1e-6)) @ x + 0.05 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (target - p) - 0.05 * w)
        while loss(w + step) > loss(w) and np.abs(step).max() >= 1e-6:
            step /= 2
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fragments(words: set[bytes]) -> set[bytes]:
    """Beginnings of words of four letters or more, with their mark."""
    return {w[:k] for w in words for k in range(FRAGMENT, min(len(w), 13) + 1)}


def chance(k: int, n: int, q: float) -> float:
    """The probability of k or more of n draws, each of which succeeds with probability q."""
    base = math.lgamma(n + 1)
    return sum(math.exp(base - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(q) + (n - x) * math.log1p(-q)) for x in range(k, n + 1))


def telling(toxic: list[set[bytes]], other: list[set[bytes]]) -> tuple[list[bytes], set[bytes]]:
    """Landmarks, and all fragments that tell toxic from other documents.

    A telling fragment has odds of ODDS at least and stands in LEAST toxic documents at least, more than chance explains: of those that no
    other document has, a share of FALSE at most is false, as expected; of the others, FALSE at most in number. Without any, the FALLBACK best ones by the odds alone count, else of what no other document has, else of all.
    Landmarks are telling fragments by falling number of toxic documents; none is the beginning of another, and each telling fragment begins with one
    or is the beginning of one.
    """
    sets, others = ([fragments(w) | w for w in docs] for docs in (toxic, other))
    count, harmless = (Counter(f for s in x for f in s) for x in (sets, others))
    ratio = len(toxic) / max(1, len(other))
    q = len(toxic) / (len(toxic) + len(other))
    odd = [f for f, n in count.items() if n >= ODDS * ratio * (harmless[f] + 0.5)]
    known = {(n, n + m): chance(n, n + m, q) for n, m in {(count[f], harmless[f]) for f in odd}}
    tested = sorted((known[count[f], count[f] + harmless[f]], f) for f in odd)
    least = np.sort([q ** (count[f] + harmless[f]) for f in count.keys() | harmless.keys()])  # the lowest probability that each can have
    last, found, good = 0.0, set(), set()  # fragments of the same beginning count as one
    for p, f in tested:
        found.add(f[:FRAGMENT])
        expected = p * np.searchsorted(least, p * (1 + 1e-9), "right")
        if expected <= FALSE:
            good.add(f)
        if expected <= FALSE * len(found):
            last = p
    good = {f for p, f in tested if count[f] >= LEAST and (f in good or p <= last and not harmless[f])}
    value = lambda f: (0.5 * ratio * harmless[f] - count[f], -len(f), f)
    if not good:
        good = set(sorted([f for f in odd if count[f] >= LEAST] or [f for f in count if f not in harmless] or count, key=value)[:FALLBACK])
    chosen: list[bytes] = []
    whole: set[bytes] = set()
    taken: set[bytes] = set()  # all beginnings of the chosen ones
    for f in sorted(good, key=value):
        if f not in taken and not any(f[:k] in whole for k in range(1, len(f))):
            chosen.append(f)
            whole.add(f)
            taken.update(f[:k] for k in range(1, len(f) + 1))
    return chosen, good


def fresh(docs: list[list[list[bytes]]]) -> list[set[bytes]]:
    """Of each document's sentences the words that stand between other words than in all documents before, at least once.

    What near copies of one text, or documents with a passage in common, have in common tells nothing about others: it counts once.
    """
    seen: set[int] = set()
    out = []
    for sents in docs:
        words, own = set(), set()
        for s in sents:
            for before, w, after in zip([b"", *s], s, [*s[1:], b""], strict=False):
                key = xxhash.xxh3_64_intdigest(b"\0".join((before, w, after)))
                own.add(key)
                if key not in seen:
                    words.add(w)
        seen |= own
        out.append(words)
    return out


def inserted(word: bytes, rng: random.Random) -> bytes:
    at = rng.randint(2, max(2, len(word) - 1))
    return word[:at] + bytes([rng.randint(1, 26)]) + word[at:]


def as_text(words: list[bytes]) -> str:
    """Words that words_of() reads back, in Latin letters and some others."""
    return " ".join("".join(chr(96 + c) if c <= 26 else next(x for x in OTHERS if 27 + ord(x) % 36 == c) for c in w[1:]) for w in words)


#: A letter for each code beyond the Latin ones.
OTHERS = [chr(c) for c in range(0x4E00, 0x4E00 + 36)]


def separating(good: list[bytes], harmless: list[bytes], count: Counter, marks: Landmarks, root: np.ndarray) -> tuple[np.ndarray, float]:
    """The machine that puts toxic sentences' words over the margin and all harmless ones below: weights of the landmarks, and the bias.

    Harmless words are taken in by turns, at first the frequent ones, then those over the margin that are worst, until none is left over it outside.
    """
    size = np.array([count[h] for h in harmless], float) ** POWER
    inside = set(np.lexsort((np.arange(len(size)), -size))[:STEP].tolist())
    plus = marks.kernel(good) @ root
    rows: dict[int, np.ndarray] = {}
    w, bias = np.zeros(plus.shape[1]), 0.0
    for _ in range(ROUNDS):
        new = sorted(inside - rows.keys())
        rows.update(zip(new, marks.kernel([harmless[i] for i in new]) @ root, strict=True))
        known = sorted(inside)
        x = np.vstack([plus, *[rows[i] for i in known]])
        # what all harmless words weigh together is the same from the start, whichever are inside
        w, bias = separate(x, np.array([1] * len(plus) + [-1] * len(known)), np.concatenate([np.ones(len(plus)), size[known]]), start=np.append(w, bias))
        model = Model(marks.codes, marks.features @ (root @ w), bias, np.zeros(4))
        value = model.word_margins(*joined(harmless)) if harmless else np.zeros(0)
        over = [i for i in np.argsort(-value).tolist() if value[i] > -1 and i not in inside][:STEP]
        if not over:
            break
        inside |= set(over)
    return root @ w, bias


def fit(docs: list[tuple[str, int]], seed: int = 5) -> Model | None:
    """The model of (text, label) of labelled documents; None unless both labels are there. Every third document is set aside for
    calibration, the toxic ones also with letters inserted into their telling words, all of them or the first alone."""
    rng = random.Random(seed)
    docs = sorted(docs)
    own = [d for k, d in enumerate(docs) if k % 3] or docs
    if len({y for _, y in own}) < 2:
        own = docs
    cases = [(sentences(t), y) for t, y in own]
    toxic, other = (fresh([c for c, y in cases if y == label]) for label in (1, 0))
    if not toxic or not other:
        return None
    chosen, good_fragments = telling(toxic, other)
    tells = lambda w: any(w[:k] in good_fragments for k in range(1, len(w) + 1))
    count = Counter(w for d in other for w in d)
    harmless = sorted({w for c, y in cases if not y for s in c for w in s})
    frequent = sorted((w for w in harmless if len(w) >= ORDER), key=lambda w: (-count[w], w))[: max(HARMLESS, LANDMARKS - len(chosen))]
    # sentences of toxic documents with a telling fragment are toxic by these words
    good = sorted({w for c, y in cases if y for s in c for w in s if tells(w)} | set(chosen))
    good = [w for w in good if len(w) >= ORDER]
    good += [inserted(w, rng) for w in good for _ in range(2) if len(w) > 5]
    model = Model(np.zeros(0, np.int64), np.zeros(0), 0.0, np.zeros(4))
    landmarks = [w for w in [*chosen, *frequent] if len(w) >= ORDER]
    for _ in range(TURNS if good and landmarks else 0):  # else the documents' sizes and the labels' shares are left
        marks = Landmarks(landmarks)
        values, vectors = np.linalg.eigh(marks.features.T @ marks.features)
        root = vectors * np.where(values > 1e-6, 1 / np.sqrt(np.maximum(values, 1e-6)), 0) @ vectors.T
        w, bias = separating(good, harmless, count, marks, root)
        model = Model(marks.codes, marks.features @ w, bias, np.zeros(4))
        # harmless words on the wrong side are beyond what these landmarks can tell: the most frequent ones become landmarks too
        value = model.word_margins(*joined(harmless)) if harmless else np.zeros(0)
        known = set(landmarks)
        wrong = sorted((h for h, v in zip(harmless, value.tolist(), strict=True) if v > 0 and len(h) >= ORDER and h not in known), key=lambda h: (-count[h], h))[:LANDMARKS]
        if not wrong:
            break
        landmarks += wrong
    aside = [d for k, d in enumerate(docs) if not k % 3]
    if len({y for _, y in aside}) < 2:
        aside = docs
    hidden = []
    for n, t in enumerate(t for t, y in aside if y):  # all telling words with a letter more; in every fourth text the first such word alone
        words = cut(*words_of([t])[:2])
        told = [tells(w) for w in words]
        one = told.index(True) if any(told) else -1
        hidden.append(as_text([inserted(w, rng) if yes else w for k, (w, yes) in enumerate(zip(words, told, strict=True)) if n % 4 or k == one or not yes]))
    model.logistic = logistic_fit(model.measures([*(t for t, _ in aside), *hidden]), np.array([*(y for _, y in aside), *[1] * len(hidden)]))
    return model


def held_out(doc_id: str = "doc_id"):
    return fold(doc_id) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic", training_docs: int = TRAINING_DOCS, training_bytes: int = TRAINING_BYTES) -> Model | None:
    """The model of a bounded sample of the labelled documents, whole texts; each distinct text counts once. None unless both labels occur.

    Rows without an id, a text or a label are left out; a document with several labels is toxic if one of them says so.
    """
    marks = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    at = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    n = {r.y: r.n for r in marks.groupBy((F.col("y") > 0).alias("y")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    limit = {y: (1 << 30) if c <= training_docs else int(training_docs / c * (1 << 30)) for y, c in n.items()}
    # about 2 x training_docs ids, whatever the corpus: the texts are read where they lie, and as many reach the driver as training_bytes allow
    some = marks.where(at < F.when(F.col("y") > 0, limit[True]).otherwise(limit[False]))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(some), "id").dropDuplicates(["text", "y"])
    line = Window.partitionBy(F.col("y") > 0).orderBy(F.xxhash64("text"), "text")
    room = F.sum(F.octet_length("text").cast("long")).over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)) <= training_bytes
    rows = rows.select("text", "y", room.alias("room"), F.row_number().over(line).alias("place")).where("room or place = 1").select("text", "y").collect()
    seen: dict[str, int] = {}
    for r in rows:
        seen[r.text] = max(seen.get(r.text, 0), int(r.y > 0))
    return fit(list(seen.items()))


def score(df: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the score of each whole text, 0 to 1, and whether it reaches 0.5. A null text counts as empty; without a model all scores are 0. Columns of these names are replaced."""
    df = df.drop(*names)
    at = df.columns.index(text)
    shared = df.sparkSession.sparkContext.broadcast(model)  # a weight for each code of a landmark, whatever the corpus

    def run(batches):
        for b in slices(batches, 1 << 22):
            texts = [t or "" for t in b.column(at).to_pylist()]
            s = shared.value.scores(texts) if shared.value and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], [*b.schema.names, *names])

    return df.mapInArrow(run, df.withColumns({names[0]: F.lit(0.0), names[1]: F.lit(0)}).schema)
