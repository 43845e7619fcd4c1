"""Connected components by alternating stars, each round written in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heightline.staging import apart, discard, staged


def components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) of every node in edges (a, b)."""
    spark = edges.sparkSession
    first = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    edges = apart(spark, 2 * first.count()).read.schema(first.schema).parquet(first.staged_at)
    edges.staged_at = first.staged_at
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written, so that the join with it can split a node with very many neighbours.
        lows = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "lows")
        # Each larger neighbour of a node goes to the smallest of them all.
        large = both.where("b > a").join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # The smaller neighbours of a node go to the smallest, and so does the node.
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        last, edges = edges, staged(small, "edges")
        discard(last, lows)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    edges = spark.read.schema(edges.schema).parquet(edges.staged_at)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
