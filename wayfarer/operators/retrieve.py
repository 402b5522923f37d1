"""Voting: query features meet the postings of their words; votes become image scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from .features import soft_assignments
from .index import Index

TOP = 200
DIGITS = 12
#: Query sides of up to so many rows go to every executor, so that the postings needn't move.
BROADCAST_ROWS = 200_000


def query_rows(query: DataFrame, model: DataFrame) -> DataFrame:
    """A row for each feature and each of its words, with its code under the word's thresholds."""
    return soft_assignments(query).join(model.where("initialized").select("word_id", "thresholds"), "word_id").withColumn("q_code", C.binarize("proj", "thresholds")).drop("thresholds", "proj")


def votes(query: DataFrame, index: Index, max_hamming: int = C.MAX_HAMMING) -> DataFrame:
    """A row for each query feature, word and posting that votes, with its weight.

    The distance is tested before the exponential. A query side that is small by its count is broadcast: then the postings,
    however long a common word's list, stay where they are. Beyond that both sides are shuffled, and adaptive execution splits hot words.
    """
    rows = query_rows(query, index.word_model).withColumnsRenamed({n: f"q_{n}" for n in ("x", "y", "a", "b", "c") if n in query.columns})
    side = F.broadcast(rows) if (query.agg(F.sum(F.size("words")).alias("n")).first().n or 0) <= BROADCAST_ROWS else rows
    h = C.hamming("q_code", "code")
    near = index.postings.join(side, "word_id").where((F.col("sigma_final") > 0) & (h <= max_hamming) & (h <= 1.5 * F.col("sigma_final")))
    return near.withColumn("h", h).withColumn("weight", C.vote_weight("h", "sigma_final"))


def burst_normalized(voted: DataFrame) -> DataFrame:
    """(query_id, feature_id, word_id, image_id, vote, n): a feature's votes for an image under a word, divided by the root of their number."""
    sums = voted.groupBy("query_id", "feature_id", "word_id", "image_id").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    return sums.select("query_id", "feature_id", "word_id", "image_id", (F.col("w") / F.sqrt("n")).alias("vote"), "n")


def self_similarity(query: DataFrame, weights: DataFrame) -> DataFrame:
    """(query_id, s): the summed squared idf of a query's words."""
    return soft_assignments(query).join(weights, "word_id").groupBy("query_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("s"))


def image_scores(bursts: DataFrame, query: DataFrame, index: Index) -> DataFrame:
    """(query_id, image_id, score, n_matches): normalised scores. Images that only words of idf 0 vote for stay, with 0."""
    sums = bursts.join(index.idf, "word_id").groupBy("query_id", "image_id").agg(F.sum(F.col("idf") * F.col("idf") * F.col("vote")).alias("raw"), F.sum("n").alias("n_matches"))
    own = F.when(F.col("s") > 0, 1 / F.sqrt(F.when(F.col("s") > 0, F.col("s")))).otherwise(1.0)
    scored = sums.join(self_similarity(query, index.idf), "query_id", "left").join(index.image_norm, "image_id", "left")
    return scored.select("query_id", "image_id", (F.col("raw") * own * F.coalesce("norm", F.lit(0.0))).alias("score"), "n_matches")


def top_images(scores: DataFrame, k: int = TOP) -> DataFrame:
    """The k best images of each query, ranked from 1; ties go to the smaller id. Scores that agree in DIGITS digits tie: sums differ beyond by their order."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), "image_id")
    return scores.withColumn("retrieval_rank", F.row_number().over(order)).where(F.col("retrieval_rank") <= k)


def best(voted: DataFrame, query: DataFrame, index: Index, k: int = TOP) -> DataFrame:
    """The k best images of each query by its votes."""
    return top_images(image_scores(burst_normalized(voted), query, index), k)
