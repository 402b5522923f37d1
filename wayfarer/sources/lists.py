"""Lists of names and positions; a line's place is the id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def tokens(spark: SparkSession, path: str) -> DataFrame:
    """(pos, token) of a text file's words, in order. The list itself is read whole; it names images and has no pixels."""
    words = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), r"\s+")).alias("pos", "token"))
    return words.where("token <> ''")


def without_repeats(lines: DataFrame, order: str = "pos", name: str = "token", by: tuple = ()) -> DataFrame:
    """Lines that differ from the one before, numbered from 0 in order: (*by, id, name). One list is one partition; many lists go by their key."""
    line = Window.partitionBy(*by).orderBy(order)
    kept = lines.withColumn("line", F.row_number().over(line)).withColumn("before", F.lag(name).over(line)).where((F.col("line") == 1) | ~F.col(name).eqNullSafe(F.col("before")))
    return kept.select(*by, (F.row_number().over(line) - 1).alias("id"), F.col(name).alias("name"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(id, name) of an image or query list, names that repeat the one before left out."""
    return without_repeats(tokens(spark, path))


def read_positions(spark: SparkSession, path: str, images: int) -> DataFrame:
    """(image_id, px, py) from pairs of numbers; fewer or more than `images` raise an error."""
    pairs = tokens(spark, path).groupBy(F.floor(F.col("pos") / 2).cast("int").alias("image_id")).agg(F.min(F.when(F.col("pos") % 2 == 0, F.col("token").cast("double"))).alias("px"), F.min(F.when(F.col("pos") % 2 == 1, F.col("token").cast("double"))).alias("py"))
    n, whole = pairs.agg(F.count("*"), F.count("py")).first()
    if n != images or whole != images:
        raise ValueError(f"{n} positions for {images} images")
    return pairs
