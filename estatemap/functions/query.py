"""Expressions of the pattern API whose rules differ from Spark's own functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(value: Column, pattern: str) -> Column:
    """Regular expression over the whole text."""
    return value.rlike(f"^(?:{pattern})$")


def xor(left: Column, right: Column) -> Column:
    return left != right


def int_divide(left: Column, right: Column) -> Column:
    """Integer division truncates toward zero."""
    return F.call_function("div", left, right)


def total(value: Column) -> Column:
    """Sum, 0 over nothing."""
    return F.coalesce(F.sum(value), F.lit(0))


def to_integer(value: Column) -> Column:
    """Whole number of a text or number; decimals are cut, other text gives null."""
    return value.cast("string").try_cast("double").cast("long")


def to_float(value: Column) -> Column:
    return value.cast("string").try_cast("double")


def round_half_up(value: Column) -> Column:
    """Ties go to positive infinity."""
    return F.floor(value + 0.5).cast("double")


def substring(value: Column, start: Column | int, length: Column | int | None = None) -> Column:
    """Zero-based; without a length up to the end."""
    first = F.lit(start) if isinstance(start, int) else start
    count = F.char_length(value) if length is None else (F.lit(length) if isinstance(length, int) else length)
    return F.substring(value, first + 1, count)


def split(value: Column, separator: str) -> Column:
    return F.split(value, "\\Q" + separator + "\\E")


def head(items: Column) -> Column:
    return F.try_element_at(items, F.lit(1))


def last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def list_size(items: Column) -> Column:
    return F.when(items.isNotNull(), F.size(items))


def text_size(value: Column) -> Column:
    return F.char_length(value)


def case(*branches: tuple[Column, object], default: object = None) -> Column:
    """Searched CASE; null without a default."""
    chain = F
    for condition, value in branches:
        chain = chain.when(condition, value)
    return chain.otherwise(default)


def case_of(subject: Column, *branches: tuple[object, object], default: object = None) -> Column:
    """Simple CASE: compare ``subject`` with each value."""
    return case(*[(subject == value, result) for value, result in branches], default=default)
