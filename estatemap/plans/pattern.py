"""Fixed-length graph patterns as joins.

A pattern binds variables. Each bound node contributes the columns ``<variable>__<property>``, so that
Catalyst prunes what a query does not use and pushes filters into the scan of one label::

    match(graph, "a:Application").hop("a", "RUNS_ON", "s:Server")
        .where(lambda c: c("s.name") == "srv-1")
        .select(application="a.name")
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatemap import model
from estatemap.graph import Graph

_NODE_COLUMNS = [name for name in model.NODE_SCHEMA.names if name != "label"]
_EDGE_COLUMNS = ["confidence", "source", "raw_name", "score", "source_kind", "archimate_rel_type", "props"]

Getter = Callable[[str], Column]


def _parse(spec: str) -> tuple[str, str | None]:
    name, _, label = spec.partition(":")
    if label and label not in model.LABEL_PROPERTIES:
        raise ValueError(f"unknown label {label}")
    return name, label or None


def column(name: str) -> Column:
    """``a.name`` as a column of a pattern; plain names stay plain."""
    return F.col(name.replace(".", "__"))


def _nodes(graph: Graph, variable: str, label: str, properties: dict) -> DataFrame:
    nodes = graph.label(label)
    for key, value in properties.items():
        nodes = nodes.filter(F.col(key) == value)
    return nodes.select(*[F.col(name).alias(f"{variable}__{name}") for name in _NODE_COLUMNS])


def match(graph: Graph, spec: str, **properties) -> Pattern:
    """Start with the nodes of one label, optionally with property equality."""
    variable, label = _parse(spec)
    return Pattern(graph, _nodes(graph, variable, label, properties), {variable: label})


def edge(graph: Graph, left: str, rel_type: str, right: str, **properties) -> Pattern:
    """Start with the edges of one type; binds the ids of both ends and loads the right node."""
    left_name, left_label = _parse(left)
    rows = _edges(graph, rel_type, left_label, _parse(right)[1], None).select(
        F.col("src_id").alias(f"{left_name}__node_id"), F.col("dst_id").alias("_end"))
    return Pattern(graph, rows, {left_name: left_label})._attach(right, properties)


def _edges(graph: Graph, rel_type: str, src: str, dst: str, variable: str | None) -> DataFrame:
    if rel_type not in model.RELATION_TYPES:
        raise ValueError(f"unknown relationship type {rel_type}")
    if not model.pattern_allowed(rel_type, src, dst):
        raise ValueError(f"{rel_type} does not connect {src} to {dst}")
    edges = graph.relation(rel_type, src, dst)
    named = [F.col(name).alias(f"{variable}__{name}") for name in ["rel_type", *_EDGE_COLUMNS]] if variable else []
    return edges.select("src_id", "dst_id", *named)


class Pattern:
    """Rows of variable bindings."""

    def __init__(self, graph: Graph, df: DataFrame, labels: dict[str, str]) -> None:
        self.graph = graph
        self.df = df
        self.labels = labels

    def _with(self, df: DataFrame, labels: dict[str, str] | None = None) -> Pattern:
        return Pattern(self.graph, df, labels or self.labels)

    def _attach(self, right: str, properties: dict) -> Pattern:
        """Bind the column ``_end`` to the right variable."""
        name, label = _parse(right)
        if name in self.labels:
            return self._with(self.df.filter(F.col("_end") == F.col(f"{name}__node_id")).drop("_end"))
        nodes = _nodes(self.graph, name, label, properties)
        joined = self.df.join(nodes, F.col("_end") == F.col(f"{name}__node_id")).drop("_end")
        return self._with(joined, {**self.labels, name: label})

    def hop(self, left: str, rel_type: str, right: str, *, reverse: bool = False, rel: str | None = None,
            **properties) -> Pattern:
        """Follow edges of one type from a bound variable; ``reverse`` walks against their direction.

        ``rel`` names a variable for the edge, so that ``rel.score`` and ``rel.rel_type`` can be used.
        """
        right_name, right_label = _parse(right)
        right_label = right_label or self.labels[right_name]
        ends = (right_label, self.labels[left]) if reverse else (self.labels[left], right_label)
        start, end = ("dst_id", "src_id") if reverse else ("src_id", "dst_id")
        edges = _edges(self.graph, rel_type, *ends, rel).withColumnRenamed(end, "_end")
        joined = self.df.join(edges, F.col(f"{left}__node_id") == F.col(start)).drop(start)
        return self._with(joined)._attach(right, properties)

    def _shared(self, other: Pattern) -> list[str]:
        return [f"{name}__node_id" for name in self.labels if name in other.labels]

    def _without_doubles(self, other: Pattern, shared: list[str]) -> DataFrame:
        doubled = [name for name in other.df.columns if name in self.df.columns and name not in shared]
        return other.df.drop(*doubled)

    def also(self, other: Pattern) -> Pattern:
        """Second pattern of the same match; both must share a variable.

        Patterns without one would be a product of all rows. Compare totals with :func:`side_by_side`.
        """
        shared = self._shared(other)
        if not shared:
            raise ValueError("the patterns share no variable")
        return self._with(self.df.join(self._without_doubles(other, shared), shared), {**other.labels, **self.labels})

    def optional(self, other: Pattern) -> Pattern:
        """Left join; conditions set on ``other`` belong to the optional part and never drop rows."""
        shared = self._shared(other)
        return self._with(self.df.join(self._without_doubles(other, shared), shared, "left"), {**other.labels, **self.labels})

    def exists(self, other: Pattern) -> Pattern:
        shared = self._shared(other)
        return self._with(self.df.join(other.df.select(*shared), shared, "left_semi"))

    def not_exists(self, other: Pattern) -> Pattern:
        shared = self._shared(other)
        return self._with(self.df.join(other.df.select(*shared), shared, "left_anti"))

    def flag(self, name: str, other: Pattern) -> Pattern:
        """Existence as a boolean column, for use inside CASE."""
        shared = self._shared(other)
        hits = other.df.select(*shared).distinct().withColumn(name, F.lit(True))
        return self._with(self.df.join(hits, shared, "left").withColumn(name, F.coalesce(name, F.lit(False))))

    def where(self, condition: Callable[[Getter], Column]) -> Pattern:
        return self._with(self.df.filter(condition(column)))

    def _value(self, value: str | Column | Callable[[Getter], Column]) -> Column:
        if isinstance(value, str):
            if value in self.labels:
                raise ValueError(f"{value} is a whole node; select its properties")
            return column(value)
        return value if isinstance(value, Column) else value(column)

    def select(self, *, distinct: bool = False, **outputs) -> DataFrame:
        """Final projection to named scalar columns."""
        rows = self.df.select(*[self._value(value).alias(name) for name, value in outputs.items()])
        return rows.distinct() if distinct else rows

    def group(self, keys: dict | None = None, **aggregates) -> DataFrame:
        """Aggregate; every output that is not an aggregate is a grouping key."""
        named = [self._value(value).alias(name) for name, value in (keys or {}).items()]
        columns = [self._value(value).alias(name) for name, value in aggregates.items()]
        return self.df.groupBy(*named).agg(*columns)

    def with_(self, *carried: str, **aggregates) -> Pattern:
        """Barrier: carry variables on, grouping by them when there are aggregates."""
        columns = [name for name in self.df.columns if name.split("__")[0] in carried or name in carried]
        kept = {name: label for name, label in self.labels.items() if name in carried}
        if not aggregates:
            return self._with(self.df.select(*columns).distinct(), kept)
        # Maps cannot be grouping keys; a carried node keeps its id and its typed properties.
        keys = [name for name in columns if not name.endswith("__props")]
        values = [self._value(value).alias(name) for name, value in aggregates.items()]
        return self._with(self.df.groupBy(*keys).agg(*values), kept)

    def count(self, variable: str, *, distinct: bool = False) -> Column:
        """Number of bound nodes of a variable as an aggregate."""
        ident = F.col(f"{variable}__node_id")
        return F.count_distinct(ident) if distinct else F.count(ident)


def order_by(df: DataFrame, *keys: str) -> DataFrame:
    """Sort by ``name`` or ``-name``: nulls last ascending, first descending."""
    return df.orderBy(*[
        F.col(key[1:]).desc_nulls_first() if key.startswith("-") else F.col(key).asc_nulls_last() for key in keys
    ])


def page(df: DataFrame, skip: int = 0, limit: int | None = None) -> DataFrame:
    df = df.offset(skip) if skip else df
    return df if limit is None else df.limit(limit)


def union_all(*branches: DataFrame) -> DataFrame:
    """Branches must have the same column names in the same order."""
    first = branches[0].columns
    if any(branch.columns != first for branch in branches):
        raise ValueError("union branches need the same column names")
    return reduce(DataFrame.unionByName, branches)


def union(*branches: DataFrame) -> DataFrame:
    return union_all(*branches).distinct()


def side_by_side(*totals: DataFrame) -> DataFrame:
    """Global aggregates, one row each, as one row; built as a union of rows, not as a product."""
    names = [name for total in totals for name in total.columns]
    padded = [
        total.select(*[F.col(name) if name in total.columns else F.lit(None).alias(name) for name in names])
        for total in totals
    ]
    return reduce(DataFrame.unionByName, padded).agg(*[F.max(name).alias(name) for name in names])
