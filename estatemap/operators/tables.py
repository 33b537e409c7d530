"""Table idioms the maintenance operators share.

Ordered "first wins" and "last wins" rules are aggregates (``min_by``/``max_by`` over an explicit
ordinal) instead of row-number windows: they combine on the map side, so a key that holds a large
share of all rows still sends one row per task to the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _kept(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [column for column in df.columns if column not in keys]


def _pick(df: DataFrame, keys: Sequence[str], chooser, order: Sequence[Column]) -> DataFrame:
    rest = _kept(df, keys)
    if not rest:
        return df.distinct()
    chosen = df.groupBy(*keys).agg(chooser(F.struct(*rest), F.struct(*order)).alias("_row"))
    return chosen.select(*keys, *[F.col("_row")[column].alias(column) for column in rest]).select(*df.columns)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the smallest ``order`` per key."""
    return _pick(df, keys, F.min_by, order)


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The row with the greatest ``order`` per key."""
    return _pick(df, keys, F.max_by, order)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of ``schema``, missing ones as null."""
    present = set(df.columns)
    return df.select(*[
        (F.col(field.name).cast(field.dataType) if field.name in present else F.lit(None).cast(field.dataType))
        .alias(field.name)
        for field in schema
    ])


def overwrite(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """MERGE: incoming rows set ``columns`` of the row with the same key, or are added.

    ``incoming`` has unique keys. Rows of ``existing`` with a null key are left alone.
    """
    marked = incoming.select(
        *keys, *[F.col(column).alias(f"_new_{column}") for column in existing.columns if column not in keys],
        F.lit(True).alias("_hit"))
    joined = existing.join(marked, list(keys), "full_outer")
    result = []
    for column in existing.columns:
        if column in keys:
            result.append(F.col(column))
        elif column in columns:
            result.append(F.when(F.col("_hit"), F.col(f"_new_{column}")).otherwise(F.col(column)).alias(column))
        else:
            result.append(F.coalesce(F.col(column), F.col(f"_new_{column}")).alias(column))
    return joined.select(*result)


def insert_missing(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MERGE without SET: only rows whose key is not there yet are added."""
    fresh = incoming.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def replace_scope(existing: DataFrame, scope: DataFrame, keys: Sequence[str], fresh: DataFrame) -> DataFrame:
    """Delete the rows whose keys are in ``scope`` and add ``fresh``."""
    kept = existing.join(scope.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(fresh.select(*existing.columns))


def require(df: DataFrame, message: str) -> None:
    """Raise when ``df`` has a row; reads at most one."""
    if df.limit(1).take(1):
        raise ValueError(message)
