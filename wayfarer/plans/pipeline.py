"""The six tools, one function each, and a query from features to rankings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features as O
from ..operators import index as I
from ..operators import rank, retrieve, verify, vocab
from ..sources import features as S
from ..sources.store import Steps

NEAREST = 5


def convert_features(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Text features as quantised square-root descriptors."""
    return S.root_sift(S.read_text(spark, path, mode))


def compute_word_assignments(features: DataFrame, vocabulary: DataFrame, nearest: int = NEAREST, lsh: bool = False) -> DataFrame:
    """Features with their nearest words."""
    if not lsh:
        return vocab.assign_words(features.drop("words"), vocabulary, nearest)
    keyed = features.drop("words").withColumn("row", F.concat_ws(":", *[F.col(c).cast("string") for c in ("file", "image_id", "feature_id") if c in features.columns]))
    return keyed.join(vocab.assign_words_lsh(keyed, vocabulary, nearest, "row"), "row").drop("row")


def compute_hamming_thresholds(features: DataFrame, projection: np.ndarray, cap: int = O.DESCRIPTORS_PER_WORD) -> DataFrame:
    """Thresholds of all words from database features under their first word."""
    rows = O.project(features.select("image_id", "feature_id", F.element_at("words", 1).alias("word_id"), "descriptor"), projection)
    return O.hamming_thresholds(rows, len(projection), cap)


def build_index(features: DataFrame, projection: np.ndarray, thresholds: DataFrame, words: int) -> I.Index:
    return I.build(O.project(features, projection), thresholds, words)


def compute_index_weights(index: I.Index) -> tuple[DataFrame, DataFrame]:
    """idf and norms, worked out anew from the postings."""
    weights = I.idf(index.postings, index.word_model.select("word_id"))
    return weights, I.image_norms(index.postings, weights)


def query(index: I.Index, queries: DataFrame, positions: DataFrame, k: int = retrieve.TOP, model: str = "affine", matching: str = "all") -> DataFrame:
    """All six rankings of query features (query_id, feature_id, x, y, a, b, c, proj, words)."""
    steps = Steps(queries.sparkSession, "query")
    voted = steps.write(retrieve.votes(queries, index))
    top = steps.write(retrieve.best(voted, queries, index, k))
    verified = steps.write(verify.verify(verify.matches_of(top, voted, index.idf), model, matching))
    steps.drop(voted)
    return rank.rankings(top, verified, positions)
