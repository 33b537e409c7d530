"""Typed JSON of property values that plain JSON cannot carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_date(value: Column) -> Column:
    return F.to_json(F.struct(F.lit("Date").alias("type"), value.cast("string").alias("value")))


def encode_timestamp(value: Column) -> Column:
    text = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return F.to_json(F.struct(F.lit("DateTime").alias("type"), text.alias("value")))


def encode_bytes(value: Column) -> Column:
    return F.to_json(F.struct(F.lit("Bytes").alias("type"), F.base64(value).alias("value")))


def encode_duration(months: Column, days: Column, seconds: Column, nanos: Column) -> Column:
    parts = F.array(*[part.cast("bigint") for part in (months, days, seconds, nanos)])
    return F.to_json(F.struct(F.lit("Duration").alias("type"), parts.alias("value")))


def encode_point(srid: Column, coords: Column) -> Column:
    return F.to_json(F.struct(F.lit("Point").alias("type"), srid.alias("srid"), coords.alias("value")))


def _body(text: Column, kind: str, schema: str) -> Column:
    parsed = F.from_json(text, f"type string, srid int, value {schema}")
    return F.when(parsed["type"] == kind, parsed["value"])


def decode_date(text: Column) -> Column:
    return _body(text, "Date", "string").cast("date")


def decode_timestamp(text: Column) -> Column:
    return F.to_timestamp(_body(text, "DateTime", "string"))


def decode_bytes(text: Column) -> Column:
    return F.unbase64(_body(text, "Bytes", "string"))


def decode_duration(text: Column) -> Column:
    """struct(months, days, seconds, nanoseconds) of an encoded duration."""
    parts = _body(text, "Duration", "array<bigint>")
    names = ("months", "days", "seconds", "nanoseconds")
    return F.when(parts.isNotNull(), F.struct(*[parts[i].alias(name) for i, name in enumerate(names)]))


def decode_point(text: Column) -> Column:
    parsed = F.from_json(text, "type string, srid int, value array<double>")
    return F.when(parsed["type"] == "Point", F.struct(parsed["srid"].alias("srid"), parsed["value"].alias("coords")))
