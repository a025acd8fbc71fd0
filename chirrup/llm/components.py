"""Connected components of an edge table, by shrinking it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chirrup.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternates two steps on narrow rows until nothing moves: every node links
    its larger neighbours to the smallest one, then its smaller ones (large-star
    and small-star).  That takes about log2 of the number of nodes rounds.  Each
    round groups by node with a map-side minimum and never gathers a node's
    neighbours, so a node with any number of edges is no hot group.  Self loops
    and repeated edges are harmless; an empty table gives an empty one.
    """
    links = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    links = materialize(links)
    if links.isEmpty():
        return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large)
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u")
        small = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = materialize(small.where("u <> v").distinct())
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.countDistinct("u")).first()
        if state == before or (state[0] == state[2] and links.join(links.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty()):
            break
        before = state
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
