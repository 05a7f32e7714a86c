"""Connected components of a link table by alternating large-star and small-star steps.

Each step is a grouped minimum and an equi-join; no component is gathered. Rounds grow with the logarithm of the
largest component and are written to shared storage, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.session import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, one: str, two: str) -> DataFrame:
    """member, root (the least member of its component) for every end of a link. Values must be orderable and not null."""
    pairs = links.select(F.col(one).alias("u"), F.col(two).alias("v")).filter(F.col("u") != F.col("v"))
    edges = materialize(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter(F.col("u") != F.col("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = materialize(small.filter(F.col("u") != F.col("v")).distinct())
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("u").alias("member"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("member"), F.col("v").alias("root")).distinct())
