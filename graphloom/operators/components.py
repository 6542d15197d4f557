"""Connected components by alternating large-star and small-star rounds.

Every round is two aggregations and two equi-joins over the edge table, so the work is distributed and a node
with very many edges is only the skewed key of a join, which adaptive execution splits. Each round's edges are
written to the shared folder: lineage stays flat and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.scratch import delete, new_path


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node on an edge; component is the smallest node reachable.

    Self-loops, repeated edges and null ends are ignored; an empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    star = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    before, last = None, None
    while True:
        path = new_path(spark, "components")
        _small_star(_large_star(star)).write.parquet(path)
        star = spark.read.parquet(path)
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_033)).first()
        if last:
            delete(spark, last)
        last = path
        if now == before:
            break
        before = now
    roots = star.select(F.col("v").alias("node")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    linked = both.where("v > u").join(least, "u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
