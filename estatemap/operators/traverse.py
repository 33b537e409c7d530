"""Bounded traversal around the objects of an answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatemap import model
from estatemap.functions import text
from estatemap.functions.naming import display_name
from estatemap.graph import Graph
from estatemap.operators.tables import first_by
from estatemap.session import cut_lineage

# Limits of a readable picture, and schema words that are no object names.
NODE_BUDGET = 30
ANSWER_LIMIT = 25
FALLBACK_HOPS = 2
SCHEMA_WORDS = (
    "application", "process", "interface", "server", "orgunit", "role", "capability", "goal", "dataobject",
    "resource", "infrastructure", "risk",
)


@dataclass(frozen=True)
class Subgraph:
    """Nodes (node_id, label, name, depth) and edges (src_id, dst_id, rel_type)."""

    nodes: DataFrame
    edges: DataFrame


def named_values(rows: DataFrame, order: str | None = None) -> DataFrame:
    """Distinct trimmed texts of all string columns with the place they were first seen.

    ``order`` names the row number column; without it the place is the column alone.
    """
    columns = [field.name for field in rows.schema if field.dataType.simpleString() == "string" and field.name != order]
    if not columns:
        return rows.select(F.lit("").alias("value"), F.lit(0).alias("row"), F.lit(0).alias("position")).limit(0)
    row = F.col(order) if order else F.lit(0)
    cells = rows.select(row.alias("row"), F.posexplode(F.array(*columns)).alias("position", "cell")).select(
        text.strip(F.col("cell")).alias("value"), F.struct("row", "position").alias("seen"))
    kept = cells.filter((F.coalesce("value", F.lit("")) != "") & ~text.casefold(F.col("value")).isin(*SCHEMA_WORDS))
    return kept.groupBy("value").agg(F.min("seen").alias("seen")).select("value", "seen.row", "seen.position")


def is_renderable(rows: DataFrame) -> DataFrame:
    """One row: number of named objects and whether a picture of them is readable."""
    return named_values(rows).agg(F.count(F.lit(1)).alias("objects")).withColumn(
        "renderable", F.col("objects").between(2, ANSWER_LIMIT))


def resolve_seeds(graph: Graph, values: DataFrame) -> DataFrame:
    """Values that are the exact name of one single visible node, one row per node.

    Names are counted before the join, so that a name borne by many nodes is dropped unexpanded.
    """
    visible = graph.nodes.filter(F.col("label").isin(*model.VISUAL_LABELS))
    wanted = values.select("value").distinct()
    unique = (
        visible.join(wanted, visible["name"] == wanted["value"], "left_semi")
        .groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("node_id"), F.min("label").alias("label"))
        .filter("n = 1")
    )
    return unique.select("node_id", "label", "name")


def expand(graph: Graph, seeds: DataFrame, rel_types: list[str] | None = None, *, max_hops: int | None = None,
           budget: int | None = None) -> Subgraph:
    """Rings around the seeds along undirected edges.

    Without types: every confirmed type, two hops unless ``max_hops`` says otherwise. With types: until nothing new is
    found or ``max_hops``. A ``budget`` of nodes, such as ``NODE_BUDGET`` for a picture, ends it earlier. A ring is never cut in here, see :func:`ring_budget`. Each ring is
    checkpointed, so neither the plan nor the recomputation after a lost executor grows with the depth.
    """
    types = rel_types or list(model.CONFIRMED_RELATIONS)
    if rel_types is None and max_hops is None:
        max_hops = FALLBACK_HOPS
    visible = list(model.VISUAL_LABELS)
    links = graph.edges.filter(
        F.col("rel_type").isin(*types) & F.col("src_label").isin(*visible) & F.col("dst_label").isin(*visible))
    both = F.array(
        F.struct(F.col("src_id").alias("node_id"), F.col("dst_id").alias("next_id")),
        F.struct(F.col("dst_id").alias("node_id"), F.col("src_id").alias("next_id")))
    # Every ring reads the links; they are computed once.
    links = cut_lineage(links.select("src_id", "dst_id", "rel_type"))
    steps = links.select(F.explode(both).alias("s")).select("s.*")
    reached = cut_lineage(seeds.select("node_id").distinct().withColumn("depth", F.lit(0)))
    total = reached.count()
    depth = 0
    expanded = 0
    while max_hops is None or depth < max_hops:
        frontier = reached.filter(F.col("depth") == depth).select("node_id")
        ring = (
            steps.join(frontier, "node_id", "left_semi").select(F.col("next_id").alias("node_id")).distinct()
            .join(reached.select("node_id"), "node_id", "left_anti")
        )
        ring = cut_lineage(ring.withColumn("depth", F.lit(depth + 1)))
        found = ring.count()
        expanded = depth + 1
        if not found:
            break
        reached = reached.unionByName(ring)
        total += found
        depth += 1
        if budget is not None and total > budget:
            break
    # The edges that were walked: at least one end was expanded.
    inner = reached.filter(F.col("depth") < expanded).select("node_id")
    seen = links.join(inner.select(F.col("node_id").alias("src_id")), "src_id", "left_semi").select(
        "src_id", "dst_id", "rel_type").unionByName(
        links.join(inner.select(F.col("node_id").alias("dst_id")), "dst_id", "left_semi").select(
            "src_id", "dst_id", "rel_type")).distinct()
    nodes = graph.nodes.join(reached, "node_id").select(
        "node_id", "label", display_name(F.col("name"), F.col("node_id")).alias("name"), "depth")
    return Subgraph(nodes, seen.unionByName(weak_edges(graph, nodes)).distinct())


def edges_among(graph: Graph, nodes: DataFrame, rel_types: list[str]) -> DataFrame:
    """Edges of the given types whose both ends are among ``nodes``."""
    edges = graph.edges.filter(F.col("rel_type").isin(*rel_types))
    for side in ("src_id", "dst_id"):
        edges = edges.join(nodes.select(F.col("node_id").alias(side)), side, "left_semi")
    return edges.select("src_id", "dst_id", "rel_type").distinct()


def weak_edges(graph: Graph, nodes: DataFrame) -> DataFrame:
    """Unconfirmed candidates among nodes that are there anyway; they never open a path."""
    return edges_among(graph, nodes, ["MAY_SERVE"])


def answer_subgraph(graph: Graph, seeds: DataFrame, rel_types: list[str] | None = None) -> Subgraph:
    """Only the answer's own objects and the direct relationships between them."""
    nodes = seeds.select("node_id", "label", "name", F.lit(0).alias("depth"))
    return Subgraph(nodes, edges_among(graph, nodes, rel_types or list(model.CONFIRMED_RELATIONS)))


def ring_sizes(nodes: DataFrame) -> DataFrame:
    """Nodes per depth and their running total; as many rows as there are rings."""
    counts = nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("ring_size"))
    running = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return counts.withColumn("reached", F.sum("ring_size").over(running))


def ring_budget(subgraph: Subgraph, budget: int = NODE_BUDGET) -> tuple[Subgraph, DataFrame]:
    """Whole rings only: the first ring that passes the budget and all after it are left out.

    Returns the kept part and one row with ``truncated``.
    """
    rings = ring_sizes(subgraph.nodes)
    fitting = rings.filter(F.col("reached") <= budget).select("depth")
    nodes = subgraph.nodes.join(F.broadcast(fitting), "depth", "left_semi").select(*subgraph.nodes.columns)
    edges = subgraph.edges
    for side in ("src_id", "dst_id"):
        edges = edges.join(nodes.select(F.col("node_id").alias(side)), side, "left_semi")
    truncated = rings.agg(F.coalesce(F.max("reached") > budget, F.lit(False)).alias("truncated"))
    return Subgraph(nodes, edges.select("src_id", "dst_id", "rel_type")), truncated


def expansion_order(nodes: DataFrame, rel_type: str = "rel_type") -> DataFrame:
    """Deterministic order of expansion rows."""
    return nodes.orderBy("label", "name", "node_id", *([rel_type] if rel_type in nodes.columns else []))


def first_seen(values: DataFrame) -> DataFrame:
    return first_by(values, ["value"], [F.col("row"), F.col("position")])
