"""Connected components over a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """links(a long, b long) -> (node, component): the smallest node that each node of a link can reach, itself included.

    Large-star and small-star steps in turn: every step takes the minimum of each node's neighbours with a map-side
    combine and joins it back to the links, so no node's neighbours meet in one place. A written table ends each round.
    """
    one_way = lambda df: df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    edges = store.written(one_way(links), name)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        edges = store.written(one_way(small), name)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v")), F.max("v")).first())
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
