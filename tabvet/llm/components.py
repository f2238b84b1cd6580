"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabvet.session import materialize, release


def star_forest(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges(u, v) that is not the smallest of its component.

    Each round points neighbours at the smallest node seen; all steps are joins and minimum aggregates, and a round's
    edges are stored, so a lost executor costs one round."""
    e = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        n, mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not n or (n, mark) == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = (n, mark)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        after = materialize(small.where("u <> v").distinct())
        release(e)
        e = after
