"""Exact deduplication with a heavy-hitter split.

Misra-Gries summaries of the digests find every digest with more than one ``1 / (COUNTERS + 1)`` of all rows.
An exact count verifies them, and the verified winners, ``COUNTERS`` rows at most, are broadcast: their rows
are decided where they are read. All other digests have few rows each and use an ordinary shuffle.

Defined cases: a null text counts as empty; a null id is smaller than any other; of rows equal in text and id
exactly one is kept; an empty table gives an empty result; other columns are carried by ``drop_copies`` only.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatemap.llm.common import cut_lineage

COUNTERS = 1024


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def merge_summaries(summary: pa.Table, counters: int) -> pa.Table:
    """Add up equal digests, then take the (counters + 1)-th largest count off all; those at zero go."""
    total = summary.group_by("digest").aggregate([("weight", "sum")]).rename_columns(["digest", "weight"])
    if total.num_rows <= counters:
        return total
    weights = total["weight"].to_numpy()
    off = int(sorted(weights, reverse=True)[counters])
    total = total.set_column(1, "weight", pc.subtract(total["weight"], off))
    return total.filter(pc.greater(total["weight"], 0))


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("digest", pa.binary()), ("weight", pa.int64())])
        summary = schema.empty_table()
        for batch in batches:
            ones = pa.array([1] * batch.num_rows, pa.int64())
            fresh = pa.table({"digest": batch.column(0).cast(pa.binary()), "weight": ones}, schema)
            summary = merge_summaries(pa.concat_tables([summary, fresh]), counters)
        yield from summary.cast(schema).to_batches()
    return run


def heavy_winners(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """``digest, keep, size`` of the digests with more than rows / (counters + 1) rows: ``counters`` rows at most.

    ``digests`` has ``digest`` and ``keep`` (a struct whose maximum is the row that stays) and is read twice.
    """
    rows = digests.count()
    parts = digests.select("digest").mapInArrow(_summaries(counters), "digest binary, weight long")
    # A digest above the bound keeps a positive count in the merged summary, which has ``counters`` entries at most.
    found = (parts.groupBy("digest").agg(F.sum("weight").alias("weight"))
             .orderBy(F.desc("weight"), "digest").limit(counters).select("digest"))
    exact = (digests.join(F.broadcast(found), "digest")
             .groupBy("digest").agg(F.max("keep").alias("keep"), F.count(F.lit(1)).alias("size")))
    return cut_lineage(exact.filter(F.col("size") * (counters + 1) > rows))


def duplicate_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                     counters: int = COUNTERS) -> DataFrame:
    """One row per row of ``docs``: ``id_column, keep_id, group_size, kept, text_sha256``."""
    rows = cut_lineage(docs.select(F.col(id_column).alias("id"), _digest(F.col(text_column)).alias("digest"))
                       .withColumn("keep", F.struct("id", F.monotonically_increasing_id().alias("row"))))
    winners = heavy_winners(rows.select("digest", "keep"), counters)
    marked = rows.join(F.broadcast(winners.withColumnRenamed("keep", "winner")), "digest", "left")
    heavy = marked.filter(F.col("size").isNotNull()).select("id", "digest", "keep", "winner", "size")
    group = Window.partitionBy("digest")
    light = (marked.filter(F.col("size").isNull())
             .select("id", "digest", "keep", F.max("keep").over(group).alias("winner"),
                     F.count(F.lit(1)).over(group).alias("size")))
    return heavy.unionByName(light).select(
        F.col("id").alias(id_column), F.col("winner.id").alias("keep_id"), F.col("size").alias("group_size"),
        (F.col("keep") == F.col("winner")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                counters: int = COUNTERS) -> DataFrame:
    """``docs`` with one row per text, the one of the largest id, all columns as they were.

    Rows of heavy digests that do not stay are removed before the shuffle; the others meet by digest, already
    thinned to one row per task and digest.
    """
    columns = [F.col(f"row.`{name}`").alias(name) for name in docs.columns]
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("id"), _digest(F.col(text_column)).alias("digest"))
    light = cut_lineage(rows.select("digest", F.struct("id").alias("keep")))
    winners = heavy_winners(light, counters).select("digest", F.col("keep.id").alias("keep_id"), F.lit(True).alias("heavy"))
    thinned = (rows.join(F.broadcast(winners), "digest", "left")
               .filter(F.col("heavy").isNull() | F.col("id").eqNullSafe(F.col("keep_id"))))
    first = Window.partitionBy("digest").orderBy(F.desc_nulls_last("id"))
    return thinned.withColumn("place", F.row_number().over(first)).filter("place = 1").select(*columns)
