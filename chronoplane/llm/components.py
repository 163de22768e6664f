"""Connected components of an edge table, by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoplane.llm.common import drop_stored, store


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that is reachable; nodes without an edge are absent.

    edges: two columns of one orderable type, in any order and with repeats; rows with a null are no edges. Large-star and
    small-star steps (Kiveris et al., 2014) alternate until the edges are stars around their smallest node. A step takes
    the smallest neighbour of each node by an aggregate that combines before the shuffle, and joins it back; a node with
    very many edges is a skewed join key, which adaptive execution splits. Each round is written to the shared folder,
    which cuts the lineage, and the round before is deleted.
    """
    a, b = edges.columns
    spark = edges.sparkSession
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") > F.col("v")).distinct()
    now, path = store(pairs, "edges")
    seen = None
    while True:
        state = tuple(now.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first())
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least).distinct()
        after, path_after = store(small, "edges")
        drop_stored(spark, path)
        now, path = after, path_after
