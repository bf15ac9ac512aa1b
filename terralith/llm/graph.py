"""Connected components over a distributed edge table, by alternating large-star and small-star steps.

A node may be the centre of a third of all edges: its neighbours are met with its smallest one under SALTS salts.

Cases: edges may repeat, point either way and join a node to itself; nodes are any 64-bit numbers, not null. An edge
table without edges gives an empty table. Only the columns a and b are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, release

ROUNDS = 60
SALTS = 16


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's neighbours (large: the greater ones; small: the smaller ones and itself) to the smallest node around it."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    dealt = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    linked = both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int")).join(dealt, ["a", "salt"]).drop("salt")
    if large:
        out = linked.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge table (a, b): root is the smallest node of its component. Nodes without edges are absent."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    edges = checkpoint(edges)
    before = None
    for _ in range(ROUNDS):
        edges = checkpoint(_star(_star(edges, True), False))
        # the sum tells whether a step changed anything: every node's link only ever moves to a smaller node
        now = edges.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        release(edges.sparkSession)
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
