"""Connected components of a link table, by alternating stars.

Each round points every node's larger neighbours, then its smaller ones, to the
smallest node it knows (Kiveris et al., 2014). A round is one job: two
aggregations with a map-side step and two joins, whose skewed side Spark can
split, so a node with very many links is no hot group. Every round is written to
the shared folder, and its row count and checksum come with the write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sigclass.session import materialize


def _written(edges: DataFrame, name: str):
    """The edges, written once, with their number and a checksum that ignores their order."""
    seen = Observation()
    edges = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"),
                                      F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
    return edges, (seen.get["n"], seen.get["h"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp (the smallest node reachable) for every node that has a link to another."""
    edges = (links.where(F.col(a) != F.col(b))
             .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    edges, before = _written(edges, "links")
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges, after = _written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "stars")
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(
        roots.withColumn("comp", F.col("node")))


def joined_with(comps: DataFrame, links: DataFrame) -> DataFrame:
    """The components after more links: those found so far count as one link for each node."""
    if links.isEmpty():
        return comps
    known = comps.where("node <> comp").select(F.col("comp").alias("a"), F.col("node").alias("b"))
    return components(known.unionByName(links.select("a", "b")))
