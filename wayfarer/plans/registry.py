"""Registered queries of the retrieval engine: one for each operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import density as D
from ..operators import features as O
from ..operators import index as I
from ..operators import rank, retrieve, verify, vocab
from ..sources import lists
from . import testbed as T
from .oracles import ORACLES
from .pipeline import query

__all__ = ["ORACLES", "QUERIES", "flagship"]

_six = lambda c: (F.round(c, 6) + F.lit(0.0)).alias(c)  # noqa: E731  no negative zero


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval_topk(spark, sf)


def root_sift_quantize(spark, sf):
    d = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x.cast("double")) * 100)).alias("d"))
    return d.select("vec_id", F.array_join(C.root_sift(F.col("d")).cast("array<string>"), ",").alias("descriptor"))


def canonical_ellipse(spark, sf):
    v = T.vectors(spark, sf)
    plain = C.canonical_ellipse("a", "b", "c", False)
    inverse = C.canonical_ellipse(*(F.col(c).cast("double") for c in "abc"), True)
    return v.select("vec_id", F.round(plain[1].cast("double"), 6).alias("b_full"), *[(F.round(e, 6) + F.lit(0.0)).alias(f"{n}_inverse") for n, e in zip("abc", inverse, strict=True)])


def hamming_thresholds_upper_median(spark, sf):
    return T.thresholds(spark, sf).select("word_id", F.posexplode("thresholds").alias("bit", "threshold"))


def binarize_codes(spark, sf):
    return T.postings(spark, sf).select("posting_id", "word_id", F.posexplode(C.sub_bytes("code")).alias("s", "byte"))


def hamming_histogram(spark, sf):
    rows = retrieve.query_rows(T.queries(spark, sf), T.model(spark, sf)).select("word_id", "q_code")
    pairs = T.postings(spark, sf).select("word_id", "code").join(rows, "word_id")
    return pairs.groupBy(C.hamming("q_code", "code").alias("h")).agg(F.count("*").alias("n"))


def _occurrences(spark, sf):
    return D.occurrences(T.postings(spark, sf))


def subbyte_occurrence(spark, sf):
    return _occurrences(spark, sf)


def density_p(spark, sf):
    return D.average_neighbours(_occurrences(spark, sf))


def sigma_table(spark, sf):
    occ = _occurrences(spark, sf)
    return D.sigma_table(occ, D.average_neighbours(occ), every_byte=True)


def density_norm(spark, sf):
    return D.learn(T.postings(spark, sf))[1].select("word_id", _six("v"))


def sigma_final(spark, sf):
    return T.index(spark, sf).postings.select("posting_id", "sigma_final")


def idf_weights(spark, sf):
    return I.idf(T.postings(spark, sf)).select("word_id", _six("idf"))


def image_norms(spark, sf):
    rows = T.postings(spark, sf)
    return I.image_norms(rows, I.idf(rows)).select("image_id", _six("norm"))


def query_self_similarity(spark, sf):
    return retrieve.self_similarity(T.queries(spark, sf), I.idf(T.postings(spark, sf))).select("query_id", _six("s"))


def vote_pairs(spark, sf):
    return T.votes(spark, sf)[2].select("query_id", "feature_id", "word_id", "posting_id", "h", _six("weight"))


def burst_normalized_votes(spark, sf):
    return retrieve.burst_normalized(T.votes(spark, sf)[2]).withColumn("vote", F.round("vote", 6))


def image_scores(spark, sf):
    own, asked, voted = T.votes(spark, sf)
    return retrieve.image_scores(retrieve.burst_normalized(voted), asked, own).withColumn("score", F.round("score", 6))


def retrieval_topk(spark, sf):
    return T.top(spark, sf).select("query_id", "image_id", "retrieval_rank", _six("score"))


def _vocabulary(spark, sf):
    return spark.read.parquet(f"{sf}/embeddings.parquet").groupBy(F.col("label").cast("long").alias("word_id")).agg(F.min_by("embedding", "vec_id").alias("center"))


def knn_words_exact(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return vocab.assign_words(v, _vocabulary(spark, sf), 5, "embedding").select("vec_id", F.array_join(F.col("words").cast("array<string>"), ",").alias("words"))


def knn_words_lsh(spark, sf):
    v = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    return vocab.assign_words_lsh(v, _vocabulary(spark, sf), 5, "vec_id", "embedding")


def soft_assignment(spark, sf):
    return O.soft_assignments(T.queries(spark, sf)).select("feature_id", "word_id", "nn_rank")


def dedup_consecutive_lines(spark, sf):
    return lists.without_repeats(spark.read.parquet(f"{sf}/events.parquet"), "event_id", "event_type", by=("user_id",))


def descriptor_cap_per_word(spark, sf):
    rows = T.database(spark, sf).withColumn("word_id", F.element_at("words", 1))
    return O.cap_per_word(rows, 20).select("image_id", "feature_id", "word_id", "rank_in_word")


def _near_pairs(spark, sf):
    """Each vector's keypoint with the next one's."""
    v = T.vectors(spark, sf).drop("proj", "label")
    v = v.select("vec_id", *[F.col(c).cast("double").alias(c) for c in "xyabc"])
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(c).alias(f"{c}2") for c in "xyabc"])
    return v.join(after, "vec_id")


def ellipse_area_scale_test(spark, sf):
    p = _near_pairs(spark, sf).withColumn("r", C.ellipse_area(F.col("a"), F.col("b"), F.col("c")) / C.ellipse_area(F.col("a2"), F.col("b2"), F.col("c2")))
    return p.select("vec_id", F.round("r", 6).alias("ratio"), (F.greatest("r", 1 / F.col("r")) < verify.SCALE_CHANGE).alias("passes"))


def _maps(spark, sf):
    p = _near_pairs(spark, sf)
    maps = C.upright_affine(tuple(F.col(c) for c in "xyabc"), tuple(F.col(f"{c}2") for c in "xyabc"))
    return p.select("*", *[m.alias(n) for m, n in zip(maps, ("a11", "a21", "a22", "t1", "t2"), strict=True)])


def affine_hypotheses(spark, sf):
    return _maps(spark, sf).select("vec_id", *map(_six, ("a11", "a21", "a22", "t1", "t2")))


def hypothesis_inliers_sql(spark, sf):
    """Each map against the pairs of its group of ten, one way."""
    m = _maps(spark, sf).withColumn("g", F.expr("vec_id div 10"))
    other = m.select("g", *[F.col(c).alias(f"{c}_") for c in ("x", "y", "x2", "y2")])
    dx, dy = F.expr("a11 * x_ + t1 - x2_"), F.expr("a21 * x_ + a22 * y_ + t2 - y2_")
    return m.join(other, "g").groupBy("vec_id").agg(F.count_if(dx * dx + dy * dy < 40000).alias("n_inliers"))


def _effective(spark, sf):
    rows = rank.inlier_rows(T.verified(spark, sf))
    at = T.queries(spark, sf).select("query_id", "feature_id", F.col("x").alias("q_x"), F.col("y").alias("q_y"))
    return rank.effective_inliers(rows.join(at, ["query_id", "feature_id"]))


def effective_inlier_area(spark, sf):
    return _effective(spark, sf).withColumn("eff", F.round("eff", 6))


def rank_inlier_count(spark, sf):
    return rank.ranked(T.verified(spark, sf).withColumn("score", F.col("num_inliers")), "inlier_count", "retrieval_rank").drop("scheme")


def rank_effective(spark, sf):
    rows = T.verified(spark, sf).drop("score", "eff").join(_effective(spark, sf), ["query_id", "image_id"]).withColumn("score", F.col("eff"))
    return rank.ranked(rows, "effective", "retrieval_rank").drop("scheme").withColumn("score", F.round("score", 6))


def rank_inter_image(spark, sf):
    return rank.inter_image(rank.inlier_rows(T.verified(spark, sf))).withColumn("score", F.round("score", 6))


def _placed(spark, sf):
    return rank.assign_places(T.verified(spark, sf), T.positions(spark, sf))


def place_assignment(spark, sf):
    first = F.min("image_id").over(Window.partitionBy("query_id", "place_id"))
    return _placed(spark, sf).select("query_id", "image_id", first.alias("first_of_place"))


def rank_inter_place(spark, sf):
    return rank.inter_place(rank.inlier_rows(_placed(spark, sf)))[0].withColumn("score", F.round("score", 6))


def rank_inter_place_popularity(spark, sf):
    return rank.inter_place(rank.inlier_rows(_placed(spark, sf)))[1].withColumn("score", F.round("score", 6))


def bit_balance(spark, sf):
    return O.bit_balance(T.postings(spark, sf)).select("word_id", "bit", _six("ones"))


def image_postings_lookup(spark, sf):
    return T.postings(spark, sf).groupBy("image_id").agg(F.count("*").alias("n_postings"), F.count_distinct("word_id").alias("n_words"))


def list_lengths(spark, sf):
    return I.list_lengths(T.postings(spark, sf))


def index_counters(spark, sf):
    return I.counters(T.index(spark, sf))


def text_idf(spark, sf):
    """The same weights for the words of documents."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null")
    words = docs.select(F.col("doc_id").alias("image_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0))).alias("word_id"))
    return I.idf(words).select(F.col("word_id").alias("word"), _six("idf"))


def order_norms(spark, sf):
    """The same norms for orders, whose parts are their words."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("word_id"))
    return I.image_norms(rows, I.idf(rows)).select(F.col("image_id").alias("l_orderkey"), _six("norm"))


def best_hypothesis(spark, sf):
    """The support of each pair's best map before any refinement: both ways and with the change of scale."""
    return verify.hypothesis_support(T.matches(spark, sf)).groupBy("query_id", "image_id").agg(F.count("*").cast("int").alias("num_hypotheses"), F.max("support").cast("int").alias("best_support"))


def _with_inliers_as_text(verified):
    return verified.select("query_id", "image_id", "num_matches", "num_inliers", _six("eff"), F.array_join(F.col("inlier_feature_ids").cast("array<string>"), ",").alias("inlier_feature_ids"))


def verify_lo(spark, sf):
    return _with_inliers_as_text(T.verified(spark, sf))


def one_to_one_matches(spark, sf):
    return _with_inliers_as_text(verify.verify(T.matches(spark, sf), matching="one_to_one"))


def all_rankings(spark, sf):
    """The whole query: top images, verification, six rankings."""
    return query(T.index(spark, sf), T.queries(spark, sf), T.positions(spark, sf)).withColumn("score", F.round("score", 6))


QUERIES = {
    f.__name__: f
    for f in (
        root_sift_quantize, canonical_ellipse, hamming_thresholds_upper_median, binarize_codes, hamming_histogram, subbyte_occurrence, density_p, sigma_table, density_norm,
        sigma_final, idf_weights, image_norms, query_self_similarity, vote_pairs, burst_normalized_votes, image_scores, retrieval_topk, knn_words_exact, knn_words_lsh,
        soft_assignment, dedup_consecutive_lines, descriptor_cap_per_word, ellipse_area_scale_test, affine_hypotheses, hypothesis_inliers_sql, effective_inlier_area,
        rank_inlier_count, rank_effective, rank_inter_image, place_assignment, rank_inter_place, rank_inter_place_popularity, bit_balance, image_postings_lookup, list_lengths, index_counters,
        text_idf, order_norms, best_hypothesis, verify_lo, one_to_one_matches, all_rankings,
    )
}
