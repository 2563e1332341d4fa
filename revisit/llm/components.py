"""Connected components of an edge table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revisit.plans.durable import durable_at, forget


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge; root is the component's smallest node.

    Alternating large-star and small-star steps: every step links a node's neighbours to its
    smallest neighbour, so paths shrink by a factor per step and no step makes more rows than
    there are edges. Each step is written to the shared folder, where the lineage ends.
    Self loops and null ends link nothing.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v <> u").distinct()
    pairs, path = durable_at(pairs, "edges")
    before = None
    while True:
        starred, new_path = durable_at(_small_star(_large_star(pairs)), "edges")
        forget(spark, path)
        path, pairs = new_path, starred
        now = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(v, u))")).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    nodes = pairs.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return nodes.union(nodes.select("root", "root").distinct())


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select("u", "v"))
    least = both.groupBy("v").agg(F.min("u").alias("m")).withColumn("m", F.least("v", "m"))
    return (
        both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
    ).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    down = pairs.select(F.greatest("v", "u").alias("v"), F.least("v", "u").alias("u"))
    least = down.groupBy("v").agg(F.min("u").alias("m"))
    linked = down.join(least, "v").where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
    return linked.union(least.select("v", F.col("m").alias("u"))).distinct()
