"""Visual words of descriptors: the nearest of a vocabulary, exactly or by hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A part of the vocabulary that goes to each executor; a larger one is passed in several parts.
PART_BYTES = 64 << 20
#: Distances that are worked out at once, at most: 16 MB of doubles.
DISTANCES = 1 << 21


def _nearest(df: DataFrame, ids: np.ndarray, centers: np.ndarray, k: int, descriptor: str) -> DataFrame:
    """One part of the vocabulary: best_words and best_distances are kept up to date."""
    at, words, distances = (df.columns.index(c) for c in (descriptor, "best_words", "best_distances"))
    shared = df.sparkSession.sparkContext.broadcast((ids, centers, (centers**2).sum(1)))

    def run(batches):
        own, c, square = shared.value
        step = max(1, DISTANCES // len(own))
        for whole in batches:
            for s in range(0, whole.num_rows, step):
                b = whole.slice(s, step)
                x = np.asarray(b.column(at).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(b.num_rows, -1)
                d = (x**2).sum(1)[:, None] - 2 * x @ c.T + square
                near = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)
                limit = np.take_along_axis(d, near[:, min(k, d.shape[1]) - 1 : min(k, d.shape[1])], 1)
                old_w, old_d = b.column(words).to_pylist(), b.column(distances).to_pylist()
                rows = []
                for i in range(len(x)):
                    some = np.flatnonzero(d[i] <= limit[i])  # with all that tie with the last
                    rows.append(sorted([*zip(old_d[i], old_w[i], strict=True), *zip(d[i, some].tolist(), own[some].tolist(), strict=True)])[:k])
                new = {words: pa.array([[w for _, w in r] for r in rows], pa.list_(pa.int64())), distances: pa.array([[v for v, _ in r] for r in rows], pa.list_(pa.float64()))}
                yield pa.RecordBatch.from_arrays([new.get(j, b.column(j)) for j in range(b.num_columns)], b.schema.names)

    return df.mapInArrow(run, df.schema)


def _checked(vocabulary: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and centers in order of word_id. Every descriptor must have k neighbours, and every neighbour be a word of an index: 0 to n - 1, each once."""
    rows = vocabulary.orderBy("word_id").collect()
    if not rows:
        raise ValueError("the vocabulary is empty")
    ids, centers = np.array([r.word_id for r in rows]), np.array([r.center for r in rows], np.float64)
    if len(ids) < k:
        raise ValueError(f"{k} neighbours of {len(ids)} words")
    if not np.array_equal(ids, np.arange(len(ids))):
        raise ValueError("invalid word: ids must be 0 to the number of words less 1, each once")
    return ids, centers


def assign_words(df: DataFrame, vocabulary: DataFrame, k: int, descriptor: str = "descriptor", out: str = "words") -> DataFrame:
    """Adds each descriptor's k nearest words by Euclidean distance, nearest first, ties to the smaller id.

    The vocabulary (word_id, center) is collected, it is a parameter: 200,000 words of 128 bytes as a rule. It travels in parts of
    PART_BYTES at most, each part one pass over the Arrow batches.
    """
    ids, centers = _checked(vocabulary, k)
    step = max(1, PART_BYTES // max(1, centers[0].nbytes))
    schema = T.StructType([*df.schema.fields])
    best = df.withColumns({"best_words": F.array().cast("array<long>"), "best_distances": F.array().cast("array<double>")})
    for a in range(0, len(ids), step):
        best = _nearest(best, ids[a : a + step], centers[a : a + step], k, descriptor)
    return best.select(*schema.fieldNames(), F.col("best_words").alias(out))


def bucket_length(centers: np.ndarray, k: int, seed: int = 1, sample: int = 200) -> float:
    """The median distance of some words, `sample` at most, from their k-th nearest other word: descriptors lie about as far from theirs, whatever the scale."""
    some = centers[np.random.default_rng(seed).permutation(len(centers))[:sample]]
    d = np.sqrt(np.maximum((some**2).sum(1)[:, None] - 2 * some @ centers.T + (centers**2).sum(1), 0))
    return float(np.median(np.sort(d, axis=1)[:, min(k, len(centers) - 1)])) or 1.0


def assign_words_lsh(df: DataFrame, vocabulary: DataFrame, k: int, key: str, descriptor: str = "descriptor", bucket: float | None = None, tables: int = 8, seed: int = 1) -> DataFrame:
    """(key, words): the same among the words that share a hash bucket with the descriptor, which finds most of them.

    The buckets' length follows the vocabulary's distances. A descriptor that meets fewer than k words is searched exactly, so that each row of df with
    a key and a descriptor comes out, and with k words.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    _, centers = _checked(vocabulary, k)
    own = df.select(F.col(key).alias("key"), F.col(descriptor).alias("descriptor"))
    vectors = own.select("key", array_to_vector(F.col("descriptor").cast("array<double>")).alias("v"))
    words = vocabulary.select("word_id", array_to_vector(F.col("center").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=bucket or bucket_length(centers, k, seed), numHashTables=tables, seed=seed).fit(words)
    pairs = model.approxSimilarityJoin(vectors, words, float("inf"), "d").select(F.col("datasetA.key").alias("key"), F.col("datasetB.word_id").alias("word_id"), "d")
    best = pairs.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("d", "word_id"))).where(F.col("r") <= k)
    met = best.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "word_id"))), lambda s: s["word_id"]).alias("words")).where(F.size("words") == k)
    rest = assign_words(own.join(met.select("key"), "key", "left_anti"), vocabulary, k).select("key", "words")
    return met.unionByName(rest).withColumnRenamed("key", key)
