"""Local densities of codes: how far from a code its word's neighbours lie, byte by byte."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C

#: Bytes closer than this many bits are neighbours of a byte.
NEAR = 2


def occurrences(postings: DataFrame) -> DataFrame:
    """(word_id, s, byte, n): how many postings of a word have a byte at place s."""
    return postings.select("word_id", F.posexplode(C.sub_bytes("code")).alias("s", "byte")).groupBy("word_id", "s", "byte").agg(F.count("*").alias("n"))


def neighbour_counts(occ: DataFrame, bytes_of: DataFrame) -> DataFrame:
    """(word_id, s, byte, d, n): postings of the word whose byte lies d bits from each byte asked for; at most 256 x 256 pairs a place."""
    own = bytes_of.select("word_id", "s", "byte")
    other = occ.select("word_id", "s", F.col("byte").alias("other"), "n")
    pairs = own.join(other, ["word_id", "s"]).withColumn("d", F.bit_count(F.col("byte").bitwiseXOR(F.col("other"))))
    return pairs.groupBy("word_id", "s", "byte", "d").agg(F.sum("n").alias("n"))


def average_neighbours(occ: DataFrame) -> DataFrame:
    """(word_id, s, p): the mean number of near neighbours of a posting, rounded; words of fewer than two postings have none."""
    near = neighbour_counts(occ, occ).where(F.col("d") < NEAR).groupBy("word_id", "s", "byte").agg(F.sum("n").alias("near"))
    sums = occ.join(near, ["word_id", "s", "byte"]).groupBy("word_id", "s").agg(F.sum(F.col("n") * (F.col("near") - 1)).alias("pairs"), F.sum("n").alias("n"))
    return sums.where("n >= 2").select("word_id", "s", F.floor(F.col("pairs") / F.col("n") + 0.5).cast("int").alias("p"))


def sigma_table(occ: DataFrame, p: DataFrame, every_byte: bool = False) -> DataFrame:
    """(word_id, s, byte, sigma): the least distance within which p other postings lie; for the bytes that occur, or for all 256."""
    places = p.select("word_id", "s")
    asked = places.select("*", F.explode(F.sequence(F.lit(0), F.lit(255))).alias("byte")) if every_byte else occ.join(places, ["word_id", "s"], "left_semi")
    running = Window.partitionBy("word_id", "s", "byte").orderBy("d")
    counts = neighbour_counts(occ, asked).withColumn("within", F.sum("n").over(running)).join(p, ["word_id", "s"])
    return counts.where(F.col("within") - 1 >= F.col("p")).groupBy("word_id", "s", "byte").agg(F.min("d").alias("sigma"))


def normalizers(occ: DataFrame, sigma: DataFrame) -> DataFrame:
    """(word_id, v): 16 less the mean summed sigma of a word's postings."""
    sums = occ.join(sigma, ["word_id", "s", "byte"]).groupBy("word_id", "s").agg(F.sum(F.col("sigma") * F.col("n")).alias("total"), F.sum("n").alias("n"))
    return sums.groupBy("word_id").agg((C.BITS / 4 - F.sum("total") / F.max("n")).alias("v"))


def learn(postings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sigmas of the bytes that occur and each word's normaliser."""
    occ = occurrences(postings)
    sigma = sigma_table(occ, average_neighbours(occ))
    return sigma, normalizers(occ, sigma)


def sigma_arrays(sigma: DataFrame) -> DataFrame:
    """(word_id, sigmas): each word's densities as one array, that of place s and byte b at 256 s + b + 1; 0 where none is known. A word has 2,048 at most."""

    def each(key, table):
        out = np.zeros(256 * C.BITS // 8, np.int8)
        out[table["s"].to_numpy() * 256 + table["byte"].to_numpy()] = table["sigma"].to_numpy()
        return pa.table({"word_id": key[:1], "sigmas": pa.array([out], pa.list_(pa.int8()))})

    return sigma.select("word_id", "s", "byte", "sigma").groupBy("word_id").applyInArrow(each, "word_id long, sigmas array<tinyint>")


def with_sigma(postings: DataFrame, arrays: DataFrame, v: DataFrame, max_hamming: int = C.MAX_HAMMING) -> DataFrame:
    """Postings with their final sigma, worked out once here and not at each vote; postings of words without densities get 0.

    A posting looks up its eight bytes in its word's array: one join by word, which adaptive execution splits where a word is hot, and no row is taken apart.
    """
    known = arrays.join(v, "word_id", "left")
    at = lambda s: F.element_at("sigmas", C.sub_byte("code", s) + F.lit(256 * s + 1)).cast("int")
    raw = reduce(lambda x, y: x + y, [at(s) for s in range(C.BITS // 8)])
    final = C.final_sigma(F.coalesce(raw, F.lit(0)), F.coalesce("v", F.lit(0.0)), max_hamming)
    return postings.join(known, "word_id", "left").withColumn("sigma_final", final).drop("sigmas", "v")
