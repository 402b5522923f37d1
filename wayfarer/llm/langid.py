"""Languages of a document as a mixture.

Each language has a distribution of hashed byte 4-grams of lower-cased words. A document's words are draws
from a mixture of languages: expectation-maximisation estimates the proportions from the words' n-gram
likelihoods, first over all languages, then over the nested sets of the most frequent ones; the set is the
one of the highest likelihood after a penalty for each further language. Words of no learned language are
drawn from a background, in which all grams are equally likely; it joins if it pays as a language must, and its
proportion lowers the score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices

GRAM_BITS = 16
SMOOTHING = 0.5
ROUNDS = 15
TOLERANCE = 1e-3
#: Languages of a document at most are as many as are learned; each beyond the first must add this much log-likelihood, besides half the log of the number of words.
PENALTY = 6.0
#: The model is fitted on at most about so many labelled documents, as many of each language as there are or an equal share, by a hash of id and text.
TRAINING_DOCS = 20_000
UNDETERMINED = "und"
#: What isn't a letter of a lower-cased text separates words: ASCII but a to z.
SPACE = np.arange(256) < 128
SPACE[97:123] = False


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed 4-grams of all texts, the first gram of each word, and the first word of each text (each has one at least)."""
    raw = [b" " + t.lower().encode() + b"a   " * (not t) + b"   " for t in texts]
    b = np.frombuffer(b"".join(raw) + b"    ", np.uint8)
    space = SPACE[b]
    c = np.where(space, np.uint8(32), b).astype(np.uint32)
    n = len(b) - 4
    codes = (c[:n] | (c[1 : n + 1] << np.uint32(8)) | (c[2 : n + 2] << np.uint32(16)) | (c[3 : n + 3] << np.uint32(24))) * np.uint32(0x9E3779B1)
    codes >>= np.uint32(32 - GRAM_BITS)
    own = ~space[1 : n + 1]  # grams whose second byte is a letter belong to that letter's word
    first = own & space[:n]
    at = np.flatnonzero(own)
    words = np.flatnonzero(first[at])
    ends = np.cumsum([len(x) for x in raw])
    starts = np.concatenate([[0], ends[:-1]])
    docs = np.searchsorted(at[words], starts)
    return codes[at].astype(np.int32), words, docs


class Model:
    """Log-probabilities of the grams in each language, languages sorted by name."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        p = counts + SMOOTHING
        self.logs = np.log(p / p.sum(1, keepdims=True)).astype(np.float32)  # language, gram

    def predict(self, texts: list[str]) -> list[tuple[list[int], list[float], float]]:
        """For each text, which must have a letter: its languages by falling proportion, the proportions, and a score in 0 to 1.

        A document's rounds end once no proportion moves by TOLERANCE, whatever documents stand beside it.
        """
        codes, words, docs = grams(texts)
        n_docs, n_langs = len(texts), len(self.langs)
        sums = np.stack([np.add.reduceat(row[codes], words) for row in self.logs])  # language, word
        size = np.diff(np.append(docs, sums.shape[1]))
        top = sums.max(0)
        like = np.exp(sums - top)
        base = np.add.reduceat(top.astype(np.float64), docs)

        def fit(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Proportions (language, document) and log-likelihoods over the allowed languages."""
            share = (allowed / allowed.sum(0)).astype(np.float32)
            left, x, n = np.arange(n_docs), like, size
            for _ in range(ROUNDS):
                at = np.cumsum(n) - n
                r = np.repeat(share[:, left], n, axis=1) * x
                r /= r.sum(0) + np.float32(1e-30)
                new = np.add.reduceat(r, at, axis=1) / n
                moves = np.abs(new - share[:, left]).max(0) > TOLERANCE
                share[:, left] = new
                if not moves.any():
                    break
                if not moves.all():
                    x, left, n = x[:, np.repeat(moves, n)], left[moves], n[moves]
            level = np.log((np.repeat(share, size, axis=1) * like).sum(0) + np.float32(1e-30))
            return share, np.add.reduceat(level.astype(np.float64), docs) + base

        share, _ = fit(np.ones((n_langs, n_docs)))
        single = np.stack([np.add.reduceat(row.astype(np.float64), docs) for row in sums])
        order = np.argsort(-share, axis=0, kind="stable")
        best = single.max(0)
        chosen = np.zeros((n_langs, n_docs))
        chosen[single.argmax(0), np.arange(n_docs)] = 1
        better = np.ones(n_docs, bool)  # a set grows as long as each further language pays
        for k in range(2, n_langs + 1):
            allowed = np.zeros((n_langs, n_docs))
            np.put_along_axis(allowed, order[:k], 1, axis=0)
            s, level = fit(allowed)
            level -= (k - 1) * (PENALTY + 0.5 * np.log(size))
            better &= level > best
            best[better], chosen[:, better] = level[better], s[:, better]
            if not better.any():
                break
        sure = 1 / np.exp(single - single.max(0)).sum(0)
        # what the background takes from the chosen mixture, as the log-odds of each word
        level = np.log((np.repeat(chosen.astype(np.float32), size, axis=1) * like).sum(0) + np.float32(1e-30)) + top
        odds = np.clip(-np.diff(np.append(words, len(codes))) * GRAM_BITS * np.log(2.0) - level, -500, 500)
        other, share = np.exp(odds - np.maximum(odds, 0)), np.exp(-np.maximum(odds, 0))  # background and mixture, the larger one 1
        unknown = np.full(n_docs, 0.5)
        for _ in range(ROUNDS):
            u = np.repeat(unknown, size)
            unknown = np.add.reduceat(u * other / (u * other + (1 - u) * share + 1e-300), docs) / size
        u = np.repeat(unknown, size)
        gain = np.add.reduceat(np.log(u * other + (1 - u) * share + 1e-300) + np.maximum(odds, 0), docs)
        unknown[gain <= PENALTY + 0.5 * np.log(size)] = 0
        out = []
        for d in range(n_docs):
            rank = [int(i) for i in np.argsort(-chosen[:, d], kind="stable") if chosen[i, d] > 0]
            out.append((rank, [float(chosen[i, d]) for i in rank], float(min(1.0, (1 - unknown[d]) * chosen[rank[0], d] * (sure[d] if len(rank) == 1 else 1.0)))))
        return out


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", training_docs: int = TRAINING_DOCS) -> Model | None:
    """The model of all rows with a text and a language, or of a sample of about training_docs whole texts of them. None without such rows.

    The sample is drawn for each language, so that a rare one is learned in a large corpus as in a small one.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("id")).where("text is not null and lang is not null")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a number a language
    quota, left, open_ = 0, training_docs, sorted(sizes.values())
    while open_ and open_[0] <= left // len(open_):  # small languages whole, the others share what is left
        left -= open_.pop(0)
    quota = max(1, left // len(open_)) if open_ else 0
    if open_:
        share = {x: 1.0 if n <= quota else quota / n for x, n in sizes.items()}
        limits = rows.sparkSession.createDataFrame([(x, int(p * (1 << 30))) for x, p in share.items()], "lang string, low long")
        rows = rows.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.col("low")).drop("low")
    parts = max(1, min(training_docs, sum(sizes.values())) // 500)

    def count(batches):
        found: dict[str, np.ndarray] = {}
        for b in slices(batches):
            for t, x in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                found.setdefault(x, np.zeros(1 << GRAM_BITS, np.int64))
                found[x] += np.bincount(grams([t])[0], minlength=1 << GRAM_BITS)
        for x, c in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([x]), pa.array([c.tobytes()], pa.binary())], ["lang", "counts"])

    def add(key, table):
        return pa.table({"lang": [key[0].as_py()], "counts": [sum(np.frombuffer(c, np.int64) for c in table["counts"].to_pylist()).tobytes()]})

    shape = "lang string, counts binary"
    # one row of 512 KB for each language, whatever the corpus
    sums = rows.repartition(parts).mapInArrow(count, shape).groupBy("lang").applyInArrow(add, shape).collect()
    if not sums:
        return None
    sums = sorted((r.lang, np.frombuffer(r.counts, np.int64)) for r in sums)
    return Model([x for x, _ in sums], np.stack([c for _, c in sums]))


def identify(df: DataFrame, model: Model | None, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "lang_shares")) -> DataFrame:
    """Adds the main language of each whole text, a score in 0 to 1, and the proportions of its languages.

    The score is the main language's proportion of all words, those of no learned language included; of a single language, times its probability.
    Null texts, texts without a letter, and all texts without a model get 'und', 0.0 and no proportions. Columns of these names are replaced.
    """
    df = df.drop(*names)
    at = df.columns.index(text)
    shares = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    keep = [f"`{c}`" for c in df.columns]
    schema = df.select(*keep, F.lit("").alias(names[0]), F.lit(0.0).alias(names[1]), F.lit(None).cast("array<struct<lang:string,share:double>>").alias(names[2])).schema
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x 65536 floats: 256 KB a language

    def run(batches):
        m = shared.value
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            found = [i for i, t in enumerate(texts) if m and t and any(map(str.isalpha, t))]
            rows: list[tuple] = [(UNDETERMINED, 0.0, [])] * len(texts)
            for i, (rank, share, score) in zip(found, m.predict([texts[i] for i in found]) if found else [], strict=True):
                rows[i] = (m.langs[rank[0]], score, [{"lang": m.langs[k], "share": s} for k, s in zip(rank, share, strict=True)])
            cols = list(zip(*rows, strict=True)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], shares)], [*b.schema.names, *names])

    return df.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return fold(doc_id) % 4 == 2


def train_on_folds(df: DataFrame) -> Model | None:
    """The model of the documents that aren't held out."""
    return train(df.where(~held_out()))


def accepted(df: DataFrame, least: float = 0.5, names: tuple[str, str, str] = ("lang_pred", "score", "lang_shares")) -> DataFrame:
    """The rows of identify()'s result whose language is determined and makes up `least` of the text."""
    return df.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= least))
