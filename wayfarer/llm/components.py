"""Connected components by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Steps, salted


def components(edges: DataFrame, steps: Steps) -> DataFrame:
    """(node, label) for each end of an edge (a, b): the label is the smallest node that links reach.

    An edge is kept as (u, v) with u > v. In a round every u is linked to the smallest neighbour of v in place of v, and then, of all that u is
    linked to, everything to the smallest. That halves the depth or so; it ends as soon as all edges are stars, which is looked at before a round
    and not after another one. A hub is the v of many edges: their join is salted by u, and only nodes with a smaller neighbour take part as the
    other side. Each round is written to the shared folder. Loops and repeated edges do no harm; nulls are left out.
    """
    e = steps.write(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct())
    while True:
        low = steps.write(e.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        deep = e.select("v").distinct().join(low.select(F.col("u").alias("v")).hint("merge"), "v", "left_semi")
        if not low.where("n > 1").limit(1).count() and not deep.limit(1).count():
            steps.drop(low)
            return e.select(F.col("u").alias("node"), F.col("v").alias("label")).union(e.select("v", "v").distinct())
        large = salted(e, low.select(F.col("u").alias("v"), "m"), ["v"], "u", how="left").select("u", F.coalesce("m", "v").alias("w"))
        small = large.withColumn("m", F.min("w").over(Window.partitionBy("u")))
        new = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("w").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = steps.write(new.where("u <> v").distinct())
        steps.drop(e, low)
        e = after
