"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatemap.llm.common import cut_lineage

MOST_ROUNDS = 60
#: Links of two numbers that one task handles at least.
LINKS_PER_TASK = 100_000


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("least"))
    # The other side has one row per node; adaptive execution splits a node with very many neighbours.
    return (both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("least").alias("dst"))
            .coalesce(tasks).distinct().coalesce(tasks))


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    least = edges.groupBy("src").agg(F.min("dst").alias("least")).coalesce(tasks)
    moved = (edges.join(least, "src").filter("dst != least")
             .select(F.col("dst").alias("src"), F.col("least").alias("dst"))).coalesce(tasks)
    return least.withColumnRenamed("least", "dst").unionByName(moved).distinct().coalesce(tasks)


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node of ``edges`` (``src, dst``) but the roots; a root is its component's least node.

    Self-links, repeated and reversed links are allowed. Only a count and a checksum reach the driver in a round.
    The count also says how many tasks a round needs: few links in many tasks leave mostly empty files behind.
    """
    current = cut_lineage(edges.filter("src != dst").select(
        F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    state = _state(current)
    tasks = -(-state[0] // LINKS_PER_TASK) or 1
    current = current.coalesce(tasks)
    for _ in range(MOST_ROUNDS):
        current = cut_lineage(_small_star(_large_star(current, tasks), tasks))
        now = _state(current)
        if now == state:
            return current.select(F.col("src").alias("node"), F.col("dst").alias("root"))
        state = now
    raise RuntimeError("the components did not settle")
