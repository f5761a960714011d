"""Connected components of tables of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.storage import checkpointed


def _hung(edges: DataFrame, all_round: bool) -> DataFrame:
    """One star step over edges (high, low): what lies round a node is hung on the least node there.

    ``all_round`` moves a node's higher neighbours, else its lower ones move, and itself. Neither changes a component.
    """
    seen = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))) if all_round else edges
    least = seen.groupBy("high").agg(F.min("low").alias("_least")).withColumn("_least", F.least("_least", "high"))
    met = seen.join(least, "high")
    if all_round:
        moved = met.where("low > high").select(F.col("low").alias("high"), F.col("_least").alias("low"))
    else:
        moved = met.select(F.col("low").alias("high"), F.col("_least").alias("low")).unionByName(met.select("high", F.col("_least").alias("low")))
    return moved.where("high <> low").distinct()


def components(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, least) of all nodes of the edges (a, b), least being the least node of its component; and the rounds it took.

    Large and small star steps in turn. Every round halves the way to the least node at least, so that the rounds grow
    with the logarithm of the longest chain; nodes are compared, never added. An edge from a node to itself is a
    component of one.
    """
    ends = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null")
    nodes = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct()
    now = checkpointed(ends.where("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).distinct())
    told = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("high", "low"))).head())
    state, rounds = told(now), 0
    while state[0]:
        now = checkpointed(_hung(_hung(now, True), False))
        state, before = told(now), state
        rounds += 1
        if state == before:
            break
    return nodes.join(now.withColumnRenamed("high", "node"), "node", "left").select("node", F.coalesce("low", "node").alias("least")), rounds
