"""Six rankings of the verified images of each query."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .retrieve import DIGITS
from .verify import PATCH

#: The six rankings, in the order of their tables and files.
SCHEMES = ("retrieval", "inlier_count", "effective_inlier_count", "inter_image", "inter_place", "inter_place_popularity")
#: Images beyond the square root of this many square metres from each other's place are different places.
PLACE_RADIUS_SQUARED = 625.0


def places(positions: np.ndarray, radius_squared: float = PLACE_RADIUS_SQUARED) -> np.ndarray:
    """The place of each image, images in order: the first image is a place, and the image farthest from all places becomes
    one, as long as it lies beyond the radius. Images move to a new place that is strictly closer, but the first never does."""
    at = np.zeros(len(positions), int)
    if not len(positions):
        return at
    distance = ((positions - positions[0]) ** 2).sum(1)
    n = 1
    while distance[far := int(distance.argmax())] > radius_squared:
        new = ((positions - positions[far]) ** 2).sum(1)
        closer = new < distance
        closer[0] = False
        at[closer], distance = n, np.where(closer, new, distance)
        n += 1
    return at


def assign_places(verified: DataFrame, positions: DataFrame, radius_squared: float = PLACE_RADIUS_SQUARED) -> DataFrame:
    """Adds place_id: clusters of a query's images, most inliers first. A group holds the verified images of a query, 200 at most.

    An image without a position fails the job.
    """
    placed = verified.join(positions, "image_id", "left").withColumn("px", F.when(F.col("px").isNull() | F.col("py").isNull(), F.raise_error(F.lit("an image has no position"))).otherwise(F.col("px")))

    def each(pdf):
        pdf = pdf.sort_values(["num_inliers", "retrieval_rank"], ascending=[False, True])
        return pdf[["query_id", "image_id"]].assign(place_id=places(pdf[["px", "py"]].to_numpy(float), radius_squared))

    found = placed.select("query_id", "image_id", "num_inliers", "retrieval_rank", "px", "py").groupBy("query_id").applyInPandas(each, "query_id int, image_id int, place_id int")
    return verified.join(found, ["query_id", "image_id"])


def effective_inliers(inliers: DataFrame, patch: int = PATCH) -> DataFrame:
    """(query_id, image_id, eff) from inlier positions q_x, q_y, pixel by pixel: the relational form of verify.effective_inliers."""
    line = F.sequence(F.lit(0), F.lit(patch - 1))
    corner = inliers.select("query_id", "image_id", F.floor(F.col("q_x") + 0.5).alias("x"), F.floor(F.col("q_y") + 0.5).alias("y")).distinct()
    rows = corner.withColumn("j", F.explode(line)).select("query_id", "image_id", "x", (F.col("y") + F.col("j")).alias("v")).distinct()
    pixels = rows.withColumn("i", F.explode(line)).select("query_id", "image_id", "v", (F.col("x") + F.col("i")).alias("u"))
    return pixels.groupBy("query_id", "image_id").agg((F.count_distinct("u", "v") / float(patch**2)).alias("eff"))


def inlier_rows(verified: DataFrame) -> DataFrame:
    return verified.select("*", F.explode("inlier_feature_ids").alias("feature_id")).drop("inlier_feature_ids")


def inter_image(inliers: DataFrame) -> DataFrame:
    """(query_id, image_id, score): each inlier counts 1 / sqrt(images in which its feature is one)."""
    images = F.count("*").over(Window.partitionBy("query_id", "feature_id"))
    return inliers.withColumn("w", 1 / F.sqrt(images)).groupBy("query_id", "image_id").agg(F.sum("w").alias("score"))


def inter_place(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same with 1 / places in which a feature is an inlier, and this times the popularity of the image's place: its features among the most of any."""
    by_feature = placed.groupBy("query_id", "feature_id").agg(F.count_distinct("place_id").alias("places"))
    scores = placed.join(by_feature, ["query_id", "feature_id"]).groupBy("query_id", "image_id", "place_id").agg(F.sum(1 / F.col("places")).alias("score"))
    size = placed.groupBy("query_id", "place_id").agg(F.count_distinct("feature_id").alias("size"))
    share = size.withColumn("popularity", F.col("size") / F.max("size").over(Window.partitionBy("query_id")))
    popular = scores.join(share, ["query_id", "place_id"]).select("query_id", "image_id", (F.col("score") * F.col("popularity")).alias("score"))
    return scores.select("query_id", "image_id", "score"), popular


def ranked(scores: DataFrame, scheme: str, *ties: str) -> DataFrame:
    """One scheme's ranking: by score, equal ones as the stage before had them."""
    order = Window.partitionBy("query_id").orderBy(F.round("score", DIGITS).desc(), *ties, "image_id")
    return scores.select("query_id", F.lit(scheme).alias("scheme"), F.row_number().over(order).alias("rank"), "image_id", F.col("score").cast("double").alias("score"))


def rankings(top: DataFrame, verified: DataFrame, positions: DataFrame) -> DataFrame:
    """All six rankings: `top` with score and retrieval_rank has all retrieved images, the other five only verified ones."""
    known = verified.join(top.select("query_id", "image_id", "retrieval_rank"), ["query_id", "image_id"])
    keys = known.select("query_id", "image_id", "retrieval_rank", "num_inliers")
    back = lambda s: s.join(keys, ["query_id", "image_id"])
    placed = inlier_rows(assign_places(known, positions))
    by_place, popular = inter_place(placed)
    inliers_first = (F.desc("num_inliers"), "retrieval_rank")
    parts = [
        top.select("query_id", F.lit(SCHEMES[0]).alias("scheme"), F.col("retrieval_rank").alias("rank"), "image_id", "score"),
        ranked(known.withColumn("score", F.col("num_inliers")), SCHEMES[1], "retrieval_rank"),
        ranked(known.withColumn("score", F.col("eff")), SCHEMES[2], "retrieval_rank"),
        ranked(back(inter_image(inlier_rows(known))), SCHEMES[3], "retrieval_rank"),
        ranked(back(by_place), SCHEMES[4], *inliers_first),
        ranked(back(popular), SCHEMES[5], *inliers_first),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
