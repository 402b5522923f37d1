"""Features on the way to codes: projection, binarisation, thresholds, profiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import columns as C
from ..sources.store import Steps

DESCRIPTORS_PER_WORD = 10_000
#: Digits by which an entry's place among the floats is found, from the highest: four of eight bits.
DIGITS = (24, 16, 8, 0)
#: Up to so many words, of 512 bytes, are sent to the rows instead of the rows to them.
NEAR_WORDS = 10_000
#: The place of a null entry in that order: after all floats, NaN too.
NULL = (1 << 32) - 1


def project(df: DataFrame, matrix: np.ndarray, descriptor: str = "descriptor", out: str = "proj") -> DataFrame:
    """Adds matrix x descriptor in single precision, one multiplication an Arrow batch. The matrix, 64 x 128 as a rule, goes with the task."""
    matrix = np.asarray(matrix, np.float32)
    at = df.columns.index(descriptor)
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches):
        for b in batches:
            x = np.asarray(b.column(at).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(b.num_rows, -1)
            y = (x @ matrix.T).astype(np.float32)
            rows = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, rows], [*b.schema.names, out])

    return df.mapInArrow(run, schema)


def cap_per_word(df: DataFrame, cap: int = DESCRIPTORS_PER_WORD, seed: int = 0, image: str = "image_id", feature: str = "feature_id") -> DataFrame:
    """At most `cap` descriptors a word, images in a random but fixed order. Spark limits each word before the shuffle too."""
    order = Window.partitionBy("word_id").orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(image)).cast("binary")), image, feature)
    return df.withColumn("rank_in_word", F.row_number().over(order)).where(F.col("rank_in_word") <= cap)


def hamming_thresholds(df: DataFrame, n_bits: int = C.BITS, cap: int = DESCRIPTORS_PER_WORD, least: int = 1, whole: bool = False) -> DataFrame:
    """(word_id, thresholds): for each bit the entry at place n div 2 of the word's sorted values, from 0. Words of fewer than `least` are left out.
    Entries that are null or missing come last, also those of a null vector.

    A word has at most `cap` descriptors here, as in the tool, so its list is bounded. With `whole` all descriptors count: words of more than `cap`
    have no list, their entries are found by digits. The table is written then.
    """
    entries = F.transform(F.sequence(F.lit(0), F.lit(n_bits - 1)), lambda b: F.get("proj", b))
    df = df.withColumn("proj", F.when(F.size("proj") == n_bits, F.col("proj")).otherwise(entries))
    if not whole:
        return _middle_of_lists(cap_per_word(df, cap), n_bits, least)
    steps = Steps(df.sparkSession, "thresholds")
    long = steps.write(df.groupBy("word_id").agg(F.count("*").alias("n")).where((F.col("n") > cap) & (F.col("n") >= least)))
    if long.isEmpty():  # as in most vocabularies
        return steps.write(_middle_of_lists(df, n_bits, least))
    lists = _middle_of_lists(df.join(long, "word_id", "left_anti"), n_bits, least)
    return steps.write(lists.unionByName(_middle_by_digits(df.select("word_id", "proj").join(long.select("word_id"), "word_id"), long, n_bits, steps)))


def _middle_of_lists(df: DataFrame, n_bits: int, least: int) -> DataFrame:
    lists = df.groupBy("word_id").agg(F.collect_list("proj").alias("rows")).where(F.size("rows") >= least)
    middle = lambda b: F.get(F.sort_array(F.array_compact(F.transform("rows", lambda r: F.element_at(r, b)))), F.floor(F.size("rows") / 2).cast("int"))
    return lists.select("word_id", F.transform(F.sequence(F.lit(1), F.lit(n_bits)), middle).alias("thresholds"))


def _middle_by_digits(rows: DataFrame, sizes: DataFrame, n_bits: int, steps: Steps) -> DataFrame:
    """The middle entries of words of any size, exactly: each pass over the rows counts the next digit of the entries that begin as the middle one does.

    `sizes` has word_id and n. A word has n_bits x 256 counts at most, however many rows; floats are taken as whole numbers of the same order.
    """
    near = F.broadcast if sizes.count() <= NEAR_WORDS else lambda x: x
    rows = steps.write(rows)
    found = steps.write(sizes.select("word_id", F.explode(F.sequence(F.lit(0), F.lit(n_bits - 1))).alias("bit"), F.floor(F.col("n") / 2).alias("place"), F.lit(0).cast("long").alias("begin")))
    running = Window.partitionBy("word_id", "bit").orderBy("digit")
    for shift in DIGITS:
        begins = found.groupBy("word_id").agg(F.sort_array(F.collect_list(F.struct("bit", "begin"))).getField("begin").alias("begins"))
        counts = rows.join(near(begins), "word_id").mapInArrow(_digits(shift, n_bits), "word_id long, bit int, digit long, n long").groupBy("word_id", "bit", "digit").agg(F.sum("n").alias("n"))
        placed = counts.withColumn("before", F.sum("n").over(running) - F.col("n")).join(found, ["word_id", "bit"])
        here = placed.where((F.col("before") <= F.col("place")) & (F.col("place") < F.col("before") + F.col("n")))
        last, found = found, steps.write(here.select("word_id", "bit", (F.col("place") - F.col("before")).alias("place"), (F.col("begin") * 256 + F.col("digit")).alias("begin")))
        steps.drop(last)
    steps.drop(rows)

    def each(key, table):
        out = np.empty(n_bits, np.int64)
        out[table["bit"].to_numpy()] = table["begin"].to_numpy()
        entries = pa.array(_from_order(out), pa.float32(), mask=out == NULL)
        return pa.table({"word_id": key[:1], "thresholds": pa.ListArray.from_arrays(pa.array([0, n_bits], pa.int32()), entries)})

    return found.select("word_id", "bit", "begin").groupBy("word_id").applyInArrow(each, "word_id long, thresholds array<float>")


def _in_order(x: np.ndarray) -> np.ndarray:
    """Whole numbers below 2^32 in the order of the floats, NaN last; both zeros are one."""
    u = np.where(np.isnan(x), np.float32(np.nan), x + np.float32(0)).view(np.uint32)
    return np.where(u >> 31, ~u, u | np.uint32(1 << 31)).astype(np.int64)


def _from_order(k: np.ndarray) -> np.ndarray:
    u = k.astype(np.uint32)
    return np.where(u >> 31, u & np.uint32((1 << 31) - 1), ~u).view(np.float32)


def _digits(shift: int, n_bits: int):
    """Counts (word_id, bit, digit, n) of the entries that begin as asked for, an Arrow batch at a time."""

    def run(batches):
        for b in batches:
            word, at = np.unique(b.column("word_id").to_numpy(), return_inverse=True)
            x, begins = (b.column(c).flatten() for c in ("proj", "begins"))
            k = _in_order(np.asarray(x.to_numpy(zero_copy_only=False), np.float32))
            if x.null_count:
                k[x.is_null().to_numpy(zero_copy_only=False)] = NULL
            k, begins = k.reshape(b.num_rows, n_bits) >> shift, begins.to_numpy(zero_copy_only=False).reshape(b.num_rows, n_bits)
            place = ((at[:, None] * n_bits + np.arange(n_bits)) * 256 + (k & 255))[k >> 8 == begins]
            place, n = np.unique(place, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word[place // 256 // n_bits], pa.int64()), pa.array(place // 256 % n_bits, pa.int32()), pa.array(place % 256, pa.int64()), pa.array(n, pa.int64())], ["word_id", "bit", "digit", "n"])

    return run


def word_model(thresholds: DataFrame, words: DataFrame, n_bits: int = C.BITS, unused: DataFrame | None = None) -> DataFrame:
    """One row for each word: its thresholds, zeros if it had no descriptor, and whether it is in use. All are, an empty word too, but those of `unused` (word_id)."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), n_bits)
    out = words.join(thresholds, "word_id", "left").select("word_id", F.coalesce("thresholds", zeros).alias("thresholds"))
    if unused is None:
        return out.withColumn("initialized", F.lit(True))
    return out.join(unused.select("word_id", F.lit(False).alias("initialized")).distinct(), "word_id", "left").withColumn("initialized", F.coalesce("initialized", F.lit(True)))


def binarize(df: DataFrame, model: DataFrame) -> DataFrame:
    """Adds the code of each descriptor under its word's thresholds."""
    return df.join(model.where("initialized").select("word_id", "thresholds"), "word_id").withColumn("code", C.binarize("proj", "thresholds")).drop("thresholds")


def bit_balance(postings: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """(word_id, bit, ones, skewed): each bit's share of ones among a word's codes, and whether it is off one half by more than the tolerance."""
    bits = postings.select("word_id", F.posexplode(C.sub_bytes("code")).alias("s", "byte")).select("word_id", "s", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"), "byte")
    one = F.floor(F.col("byte") / F.pow(F.lit(2), "k")).cast("int") % 2
    shares = bits.groupBy("word_id", (F.col("s") * 8 + F.col("k")).alias("bit")).agg(F.avg(one).alias("ones"))
    return shares.withColumn("skewed", F.abs(F.col("ones") - 0.5) > tolerance)


def soft_assignments(features: DataFrame) -> DataFrame:
    """One row for each of a feature's words, nearest first; a word that a feature names twice counts twice."""
    return features.select("*", F.posexplode("words").alias("nn_rank", "word_id")).drop("words")
