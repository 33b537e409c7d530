"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatemap.session import checkpoint_folder, cut_lineage

#: Rows that one task numbers at most, apart from fully equal rows.
ROWS_PER_SLICE = 50_000
#: Rows of a few numbers each that may be broadcast, about 20 MB.
BROADCAST_ROWS = 500_000
#: Slices that a group is dealt into at least.
SLICES = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ranked(rows: DataFrame, group: str, order: Sequence[str], name: str, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Number the rows of each ``group`` from 0 as column ``name``, in any order that ``order`` decides.

    A group is dealt into slices by a hash of ``order``; each slice is numbered by itself and shifted by the
    rows of the slices before it. So a group with a third of all rows never meets in one task. ``rows`` is
    read twice and should be cut from its lineage. Rows equal in ``order`` get neighbouring numbers.
    """
    slices = max(SLICES, -(-rows.count() // rows_per_slice))
    dealt = rows.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    sizes = dealt.groupBy(group, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(group, "_slice", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy(group, "_slice").orderBy(*order)
    return (dealt.withColumn(name, F.row_number().over(inside).cast("long") - 1)
            .join(shifts, [group, "_slice"])
            .withColumn(name, F.col(name) + F.col("_shift")).drop("_slice", "_shift"))


def bounded_sample(rows: DataFrame, group: str, per_group: int, keys: Sequence[str]) -> DataFrame:
    """About ``per_group`` rows of each ``group`` and never more, chosen by a hash of ``keys``.

    The groups are counted first; only rows whose hash lies below the share that is wanted are shuffled.
    ``group`` must have few values (labels, languages): their counts reach the driver.
    """
    many = {row[0]: row[1] for row in rows.groupBy(group).agg(F.count(F.lit(1))).collect()}
    if not many:
        return rows.limit(0)
    share = F.lit(None).cast("double")
    for value, n in sorted(many.items(), key=lambda item: str(item[0])):
        share = F.when(F.col(group) == F.lit(value), F.lit(min(1.0, (per_group + 4 * per_group ** 0.5) / n))).otherwise(share)
    place = F.shiftrightunsigned(F.xxhash64(*keys), 11) / F.lit(float(1 << 53))
    near = rows.withColumn("_place", place).filter(F.col("_place") < share)
    first = Window.partitionBy(group).orderBy("_place", *keys)
    return (near.withColumn("_turn", F.row_number().over(first)).filter(F.col("_turn") <= per_group).drop("_turn", "_place"))


def small_or_shuffled(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``rows`` with a broadcast hint if a count shows at most ``most``; read twice, so cut its lineage before."""
    return F.broadcast(rows) if rows.count() <= most else rows


def without(docs: DataFrame, dropped: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``docs`` less the rows whose id and XXH64 of the text are in ``dropped`` (``id, hash``; null ids are equal)."""
    columns = [F.col(f"row.`{name}`").alias(name) for name in docs.columns]
    rows = docs.select(F.struct("*").alias("row"), F.col(id_column).alias("id"), F.xxhash64(text_column).alias("hash")).alias("r")
    gone = small_or_shuffled(dropped).alias("d")
    return rows.join(gone, F.col("r.id").eqNullSafe(F.col("d.id")) & (F.col("r.hash") == F.col("d.hash")), "left_anti").select(*columns)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared folder of ``spark.checkpoint.dir`` and read again.

    Such a table is read few times and may hold the texts of all rows, so it is compressed for size.
    """
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def held_out(id_column: str, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, equals ``part``; false for a null id."""
    remainder = F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(parts)
    return F.coalesce(remainder == F.lit(part), F.lit(False))


__all__ = ["bounded_sample", "cut_lineage", "held_out", "ranked", "small_or_shuffled", "stored", "table", "without"]
