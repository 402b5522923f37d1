"""The inverted index as a set of tables: building, growing, weighing, saving, looking up."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..sources.store import Steps
from . import density
from .features import binarize, word_model


@dataclass
class Index:
    """postings: word_id, posting_id, image_id, x, y, a, b, c, code, sigma_final; word_model: word_id, thresholds, initialized, v; sigma: word_id, sigmas
    (2,048 densities, place by place); idf: word_id, idf; image_norm: image_id, norm."""

    postings: DataFrame
    word_model: DataFrame
    sigma: DataFrame
    idf: DataFrame
    image_norm: DataFrame


TABLES = ("postings", "word_model", "sigma", "idf", "image_norm")


def idf(postings: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(word_id, idf): ln(images in the index / images with the word); words without a posting, if named, have 0."""
    images = postings.agg(F.count_distinct("image_id").alias("n")).first().n
    own = postings.groupBy("word_id").agg(F.ln(F.lit(float(images)) / F.count_distinct("image_id")).alias("idf"))
    return own if words is None else words.join(own, "word_id", "left").select("word_id", F.coalesce("idf", F.lit(0.0)).alias("idf"))


def image_norms(postings: DataFrame, weights: DataFrame) -> DataFrame:
    """(image_id, norm): 1 / sqrt of the summed squared idf of an image's postings, 0 where that is 0."""
    sums = postings.join(weights, "word_id").groupBy("image_id").agg(F.sum(F.col("idf") * F.col("idf")).alias("s"))
    return sums.select("image_id", F.when(F.col("s") > 0, 1 / F.sqrt(F.when(F.col("s") > 0, F.col("s")))).otherwise(0.0).alias("norm"))


def posting_rows(features: DataFrame, model: DataFrame) -> DataFrame:
    """A posting for each feature, under its first word. The id comes from the feature's, so a task that runs again gives the same."""
    first = features.withColumn("word_id", F.element_at("words", 1))
    coded = binarize(first, model)
    posting = (F.col("image_id").cast("long") * F.lit(2**31)) + F.col("feature_id")
    return coded.select("word_id", posting.alias("posting_id"), "image_id", "x", "y", "a", "b", "c", "code")


def checked(features: DataFrame, words: int) -> DataFrame:
    """The features; a word outside of 0 to words - 1 fails the job."""
    bad = F.exists("words", lambda w: w.isNull() | (w < 0) | (w >= words))
    return features.withColumn("words", F.when(bad, F.raise_error(F.lit("a word lies outside of the vocabulary"))).otherwise(F.col("words")))


def finalize(postings: DataFrame, model: DataFrame) -> Index:
    """Densities, idf and norms depend on all postings and are worked out anew after each change. All tables are written to the shared folder."""
    steps = Steps(postings.sparkSession, "index")
    coded = steps.write(postings.drop("sigma_final"))
    sigma, v = density.learn(coded)
    sigma = steps.write(sigma)
    v = steps.write(density.normalizers(density.occurrences(coded), sigma))
    arrays = steps.write(density.sigma_arrays(sigma))
    whole = steps.write(density.with_sigma(coded, arrays, v))
    words = steps.write(model.drop("v").join(v, "word_id", "left").fillna(0.0, ["v"]))
    weights = steps.write(idf(whole, words.select("word_id")))
    norms = steps.write(image_norms(whole, weights))
    steps.drop(coded, sigma, v)
    return Index(whole, words, arrays, weights, norms)


def fitting(thresholds: DataFrame, words: int, whole: bool) -> DataFrame:
    """The thresholds, if they are those of a vocabulary of so many words: each word once, none beyond, and, with `whole`, none missing."""
    n, distinct, least, most = thresholds.agg(F.count("*"), F.count_distinct("word_id"), F.min("word_id"), F.max("word_id")).first()
    if distinct < n or n and (least < 0 or most >= words) or whole and n != words:
        raise ValueError(f"thresholds of {n} words, {least} to {most}, for a vocabulary of {words}")
    return thresholds


def build(features: DataFrame, thresholds: DataFrame, words: int, whole: bool = False, unused: DataFrame | None = None) -> Index:
    """The index of database features under the thresholds of a vocabulary of so many words.

    Words without thresholds get zeros, unless `whole` asks for all, as in a file. Words of `unused` (word_id) aren't initialised: their features
    are left out, and no query feature votes by them.
    """
    model = word_model(fitting(thresholds, words, whole), features.sparkSession.range(words).withColumnRenamed("id", "word_id"), unused=unused)
    return finalize(posting_rows(checked(features, words), model), model)


def empty(spark: SparkSession, words: int) -> Index:
    """The index of a vocabulary of so many words before anything is known: no postings, and no word initialised. No words give empty tables."""
    ids = spark.range(max(words, 0)).withColumnRenamed("id", "word_id")
    zeros = F.array_repeat(F.lit(0.0).cast("float"), C.BITS)
    model = ids.select("word_id", zeros.alias("thresholds"), F.lit(False).alias("initialized"), F.lit(0.0).alias("v"))
    postings = spark.createDataFrame([], "word_id long, posting_id long, image_id int, x float, y float, a float, b float, c float, code long, sigma_final int")
    return Index(postings, model, spark.createDataFrame([], "word_id long, sigmas array<tinyint>"), ids.withColumn("idf", F.lit(0.0)), spark.createDataFrame([], "image_id int, norm double"))


def set_thresholds(index: Index, thresholds: DataFrame, words: int) -> Index:
    """The index with thresholds for all its words, which makes them all initialised; refused if there aren't exactly as many."""
    ids = index.word_model.select("word_id", "v")
    return replace(index, word_model=word_model(fitting(thresholds, words, True), ids.select("word_id")).join(ids, "word_id"))


def counters(index: Index) -> DataFrame:
    """(words, words_in_use, images, postings, longest_list): one row, what a build reports on the way."""
    lists = list_lengths(index.postings).agg(F.count("*").alias("words_in_use"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"), F.coalesce(F.max("n"), F.lit(0)).alias("longest_list"))
    words, images = index.word_model.agg(F.count("*").alias("words")), index.postings.agg(F.count_distinct("image_id").alias("images"))
    rows = words.unionByName(lists, allowMissingColumns=True).unionByName(images, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in ("words", "words_in_use", "images", "postings", "longest_list")])


def add(index: Index, features: DataFrame, words: int) -> Index:
    """The index with more features; postings are only ever added."""
    more = posting_rows(checked(features, words), index.word_model)
    return finalize(index.postings.drop("sigma_final").unionByName(more), index.word_model)


def save(index: Index, path: str, buckets: int = 0, table: str = "wayfarer_postings") -> None:
    """The index as Parquet; with buckets also as a table whose postings lie by word, so that a join by word needs no shuffle of them."""
    for name in TABLES[1:]:
        getattr(index, name).write.mode("overwrite").parquet(f"{path}/{name}")
    n = int(index.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index.postings.repartition(n, "word_id").sortWithinPartitions("word_id", "image_id", "posting_id").write.mode("overwrite").parquet(f"{path}/postings")
    if buckets:
        index.postings.sparkSession.read.parquet(f"{path}/postings").write.mode("overwrite").bucketBy(buckets, "word_id").sortBy("word_id", "image_id").saveAsTable(table)


def load(spark: SparkSession, path: str) -> Index:
    tables = {n: spark.read.parquet(f"{path}/{n}") for n in TABLES}
    words = tables["word_model"].count()
    if words == 0 or tables["idf"].count() != words:
        raise ValueError("the weights don't fit the index")
    return Index(**tables)


def postings_of_image(postings: DataFrame, image_id: int) -> DataFrame:
    return postings.where(F.col("image_id") == image_id)


def images_in(postings: DataFrame) -> DataFrame:
    return postings.select("image_id").distinct()


def list_lengths(postings: DataFrame) -> DataFrame:
    """(word_id, n): the length of each word's list."""
    return postings.groupBy("word_id").agg(F.count("*").alias("n"))
