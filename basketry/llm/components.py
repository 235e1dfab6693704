"""Connected components of a link table, wholly on Spark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import materialize


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) of every node of ``edges``
    (u, v: longs, no self links needed). Alternating large-star and small-star
    steps. Every aggregate is written to the shared folder before it is joined
    back, so a hub's links are split like any skewed join."""
    e = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), name)
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        # large star: every larger neighbour of u is linked to u's smallest
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), name)
        large = materialize(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        # small star: every smaller neighbour of u, and u, to the smallest
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("a"), F.col("m").alias("b")), F.struct(F.col("v").alias("a"), F.col("m").alias("b")))).alias("x"))
        nxt = materialize(small.select(F.col("x.a").alias("u"), F.col("x.b").alias("v")).filter("u <> v").distinct(), name)
        # a forest of stars: every node has one smaller neighbour, which has none
        stars = nxt.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        deep = nxt.select(F.col("v").alias("u")).distinct().join(nxt.select("u"), "u", "left_semi")
        if stars.filter("n > 1").isEmpty() and deep.isEmpty():
            break
        e = nxt
    roots = nxt.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return nxt.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
