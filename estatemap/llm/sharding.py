"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``NODES`` points of a ring of 2^32 places; a row belongs to the first point clockwise of its own
place. A shard takes no more rows than its quota; what overflows continues clockwise to the next point whose
shard has room. Only the counts of the arcs between points (shards x nodes, whatever the table's size) reach the
driver, which walks them round by round; rows find their shard from the arc and their number in it.

Law ``rows``: the quotas add up to the number of rows and differ by one at most, so every shard is exactly full.

Defined cases: a null text has size 1; rows with a null id take their place from the text; equal rows are
placed one by one; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatemap.llm.common import cut_lineage, ranked

NODES = 128


def ring_points(shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """Sorted (place, shard). A shard's points do not depend on the number of shards."""
    points = []
    for shard in range(shards):
        for node in range(nodes):
            place = hashlib.blake2b(f"{shard}/{node}".encode(), digest_size=4).digest()
            points.append((int.from_bytes(place, "little"), shard))
    return sorted(points)


def arc_of(place: int, points: list[tuple[int, int]]) -> int:
    return bisect_left(points, (place,)) % len(points)


def quotas(rows: int, shards: int) -> list[int]:
    return [rows // shards + (shard < rows % shards) for shard in range(shards)]


def walk(counts: dict[int, int], points: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Intervals (arc, low, high, shard, first slot) of the rows' numbers in each arc.

    Round by round every arc offers what is left of it to the next point clockwise; at most one interval is cut
    for each shard that fills up, so there are at most arcs + shards of them.
    """
    free, used = quotas(sum(counts.values()), shards), [0] * shards
    waiting = [(arc, 0, count, arc) for arc, count in sorted(counts.items()) if count]
    placed = []
    while waiting:
        later = []
        for arc, low, high, point in waiting:
            shard = points[point][1]
            taken = min(free[shard], high - low)
            if taken:
                placed.append((arc, low, low + taken, shard, used[shard]))
                free[shard] -= taken
                used[shard] += taken
            if low + taken < high:
                later.append((arc, low + taken, high, (point + 1) % len(points)))
        waiting = later
    return placed


def shard_rows(docs: DataFrame, shards: int = 16, nodes: int = NODES, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """``id_column, size, text_crc32, law, shard, slot, grown_shard, home_shard`` of every row of ``docs``."""
    spark: SparkSession = docs.sparkSession
    points = ring_points(shards, nodes)
    places = np.array([place for place, _ in points], np.int64)

    @F.pandas_udf("int")
    def arc(place: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(places, place.to_numpy()) % len(places)).astype(np.int32))

    text = F.coalesce(F.col(text_column), F.lit("")).cast("binary")
    key = F.when(F.col(id_column).isNull(), F.xxhash64(F.lit("text"), text)).otherwise(F.xxhash64(F.col(id_column)))
    rows = cut_lineage(docs.select(
        F.col(id_column).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), key.alias("key"))
        .withColumn("arc", arc(F.shiftrightunsigned("key", 32))))
    counts = {row.arc: row.n for row in rows.groupBy("arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    placed = walk(counts, points, shards)
    intervals = spark.createDataFrame(placed, "arc int, low long, high long, shard int, first long")
    homes = spark.createDataFrame([(arc, shard) for arc, (_, shard) in enumerate(points)], "arc int, home_shard int")
    numbered = ranked(rows, "arc", ["key", "id", "text_crc32", "size"], "number")
    # Both small sides have one row for each arc and shard at most.
    return (numbered.join(F.broadcast(intervals), "arc").filter("number >= low and number < high")
            .join(F.broadcast(homes), "arc")
            .select(F.col("id").alias(id_column), "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                    (F.col("first") + F.col("number") - F.col("low")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "home_shard"))
