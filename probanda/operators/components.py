"""Connected components of a table of links, by alternating large and small stars on tables; nothing is gathered on the driver but one count a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import replaced


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (u, v) with u > v. Large: each node's greater neighbours point to the least of its neighbourhood. Small: its lesser ones do."""
    sides = edges.union(edges.select("v", "u")).toDF("u", "v") if large else edges
    least = sides.groupBy("u").agg(F.min("v").alias("m"))
    if large:
        least = least.withColumn("m", F.least("m", "u"))
        joined = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return joined.where("u > v").distinct()
    joined = sides.join(least, "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (least node reachable) of every node of the links (a, b); nodes without links are not listed."""
    edges, path = replaced(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges", None)
    state = None
    while True:
        edges, path = replaced(_stars(_stars(edges, True), False), "edges", path)
        now = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        state = now
