"""Merging duplicate units or processes, with a before and after state that makes the merge reversible."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatemap import model
from estatemap.functions import text
from estatemap.functions.naming import reference_of, relationship_key
from estatemap.graph import Graph
from estatemap.operators.aliases import _distinct_names, put_aliases
from estatemap.operators.quality import undo_payload_issues
from estatemap.operators.tables import conform, require
from estatemap.operators.upserts import EDGE_KEY
from estatemap.session import cut_lineage

_EDGE_PROPERTIES = ("confidence", "source", "raw_name", "score", "source_kind", "archimate_rel_type")


@dataclass(frozen=True)
class State:
    """Some nodes with all their edges and the aliases that refer to them."""

    nodes: DataFrame
    edges: DataFrame
    alias_edges: DataFrame
    aliases: DataFrame


@dataclass(frozen=True)
class MergeRecord:
    """What a merge changed; kept until it is undone."""

    focus: DataFrame
    before: State
    after: State


def incident_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with at least one end in ``ids`` (node_id), each once."""
    return _at_ends(_with_ends(edges, ids.select("node_id", F.col("node_id").alias("target_id")).distinct()))


def _with_ends(edges: DataFrame, places: DataFrame) -> DataFrame:
    """``edges`` with ``src_to`` and ``dst_to``, the target_id of ``places`` (node_id once each) for either end, else null.

    All edges go through one join per side; cut the lineage before both the edges at the places and the others are read.
    """
    for side in ("src", "dst"):
        edges = edges.join(places.select(F.col("node_id").alias(f"{side}_id"), F.col("target_id").alias(f"{side}_to")), f"{side}_id", "left")
    return edges.select(*model.EDGE_SCHEMA.names, "src_to", "dst_to")


def _at_ends(marked: DataFrame) -> DataFrame:
    return marked.filter("src_to IS NOT NULL OR dst_to IS NOT NULL").select(*model.EDGE_SCHEMA.names)


def _elsewhere(marked: DataFrame) -> DataFrame:
    return marked.filter("src_to IS NULL AND dst_to IS NULL").select(*model.EDGE_SCHEMA.names)


def capture(graph: Graph, focus: DataFrame) -> State:
    """Focus nodes, their edges, and the alias rows of the focus nodes and focus alias names."""
    ids = focus.filter(F.col("node_id").isNotNull())
    return _captured(graph, focus, incident_edges(graph.edges, ids))


def _captured(graph: Graph, focus: DataFrame, edges: DataFrame) -> State:
    ids = focus.filter(F.col("node_id").isNotNull())
    return State(
        graph.nodes.join(ids.select("node_id"), "node_id", "left_semi").select(*model.NODE_SCHEMA.names),
        edges, *_focus_aliases(graph, focus))


def _focus_aliases(graph: Graph, focus: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Alias edges and aliases of the focus nodes and focus alias names."""
    ids = focus.filter(F.col("node_id").isNotNull())
    names = focus.filter(F.col("normalized_name").isNotNull()).select("normalized_name").distinct()
    by_target = graph.alias_edges.join(ids.select(F.col("node_id").alias("target_id")), "target_id", "left_semi")
    by_name = graph.alias_edges.join(names, "normalized_name", "left_semi")
    columns = model.ALIAS_EDGE_SCHEMA.names
    return (by_target.select(*columns).unionByName(by_name.select(*columns)).distinct(),
            graph.aliases.join(names, "normalized_name", "left_semi").select(*model.ALIAS_SCHEMA.names))


def _strength() -> Column:
    manual = F.col("source").isin(model.SERVES_MANUAL, model.SERVES_CONFIRMED)
    return F.when(manual, 3).when(F.col("confidence").isin(model.STRONG, "strong"), 2).otherwise(1)


def combine_edges(edges: DataFrame) -> DataFrame:
    """One edge per (type, source, target): per property the strongest evidence wins, then the lowest ``moved``, at last the least value.

    Identity and provenance properties ignore the strength. All of it is min-by aggregation, so any number
    of edges may fall onto one pair.
    """
    ranked = edges.withColumn("_weak", -_strength()).withColumn("_order", F.struct("moved", "raw_name"))
    picks = []
    for name in _EDGE_PROPERTIES:
        protected = name.endswith("_id") or name.startswith("archimate_")
        order = F.struct(F.lit(0) if protected else F.col("_weak"), F.col("_order"), F.col(name))
        picks.append(F.min_by(name, F.when(F.col(name).isNotNull(), order)).alias(name))
    flat = ranked.groupBy(*EDGE_KEY, "src_label", "dst_label").agg(*picks)
    keep = F.col("key").endswith("_id") | F.col("key").startswith("archimate_")
    props = (
        ranked.select(*EDGE_KEY, "_weak", "_order", F.explode("props").alias("key", "value"))
        .groupBy(*EDGE_KEY, "key")
        .agg(F.min_by("value", F.struct(F.when(keep, F.lit(0)).otherwise(F.col("_weak")), F.col("_order"), F.col("value"))).alias("value"))
        .groupBy(*EDGE_KEY).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("props"))
    )
    return conform(flat.join(props, EDGE_KEY, "left"), model.EDGE_SCHEMA)


def merge_entities(graph: Graph, label: str, pairs: DataFrame, today: str) -> tuple[Graph, MergeRecord]:
    """Move everything of each source to its target and delete the source.

    ``pairs`` has source_id and target_id (node ids) of one label, OrgUnit or Process. Nothing happens
    unless all pairs are valid and every edge type is known.
    """
    if label not in ("OrgUnit", "Process"):
        raise ValueError(f"{label} nodes cannot be merged")
    pairs = cut_lineage(pairs.select("source_id", "target_id").distinct())
    ids = graph.label(label).select("node_id")
    require(pairs.filter("source_id = target_id"), "source and target are the same node")
    require(pairs.groupBy("source_id").count().filter("count > 1"), "a source has several targets")
    require(pairs.join(pairs.select(F.col("source_id").alias("target_id")), "target_id", "left_semi"),
            "a target is itself merged away")
    for side in ("source_id", "target_id"):
        require(pairs.join(ids.select(F.col("node_id").alias(side)), side, "left_anti"), f"{side} does not exist")

    sources = pairs.select(F.col("source_id").alias("node_id"))
    ends = sources.unionByName(pairs.select(F.col("target_id").alias("node_id"))).distinct()
    names = graph.label(label).join(sources, "node_id", "left_semi").select(
        F.lit(None).cast("string").alias("node_id"), text.fold_key(F.col("name")).alias("normalized_name"))
    focus = cut_lineage(ends.withColumn("normalized_name", F.lit(None).cast("string")).unionByName(names).distinct())
    # A source stands for its target, a target for itself. The edges are computed and stored once, those at no end with them.
    places = pairs.unionByName(pairs.select(F.col("target_id").alias("source_id"), "target_id").distinct()).withColumnRenamed("source_id", "node_id")
    marked = cut_lineage(_with_ends(graph.edges, places))
    found = _captured(graph, focus, _at_ends(marked))
    before = State(cut_lineage(found.nodes), found.edges, cut_lineage(found.alias_edges), cut_lineage(found.aliases))
    moves = F.coalesce(F.col("src_to") != F.col("src_id"), F.lit(False)) | F.coalesce(F.col("dst_to") != F.col("dst_id"), F.lit(False))
    require(marked.filter(moves & ~F.col("rel_type").isin(*model.RELATION_TYPES)),
            "the source has relationships of an unknown type")

    edges = marked.filter("src_to IS NOT NULL OR dst_to IS NOT NULL").withColumn("moved", moves.cast("int")).withColumns({
        f"{side}_id": F.coalesce(f"{side}_to", f"{side}_id") for side in ("src", "dst")}).drop("src_to", "dst_to")
    # Every edge at a source or target is among these, before and after; the graph and the record take them from one computation.
    combined = cut_lineage(combine_edges(edges))

    merged_nodes = cut_lineage(_merge_nodes(before.nodes, pairs))
    rest = graph.nodes.join(ends, "node_id", "left_anti").select(*model.NODE_SCHEMA.names)
    alias_edges = graph.alias_edges.join(
        pairs.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("_to")), "target_id", "left"
    ).withColumn("target_id", F.coalesce("_to", "target_id")).select(*model.ALIAS_EDGE_SCHEMA.names)
    alias_edges = alias_edges.groupBy("normalized_name", "target_label", "target_id").agg(
        F.min("source_kind").alias("source_kind"))
    result = graph.with_(nodes=rest.unionByName(merged_nodes), edges=_elsewhere(marked).unionByName(combined), alias_edges=alias_edges)

    named = before.nodes.select("node_id", "name")
    aliases = pairs.join(named.toDF("source_id", "alias_name"), "source_id").join(
        named.toDF("target_id", "target_name"), "target_id")
    wanted = _distinct_names(aliases, "alias_name", "target_name") if label == "OrgUnit" else aliases.filter(
        text.optional(F.col("alias_name")).isNotNull())
    result = put_aliases(result, wanted.select("alias_name", F.lit(label).alias("target_label"), "target_id"),
                         model.ALIAS_MERGED, today)
    return result, MergeRecord(focus, before, State(
        merged_nodes, combined, *[cut_lineage(table) for table in _focus_aliases(result, focus)]))


def _merge_nodes(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Target nodes; values they lack come from their sources, in id order."""
    owner = nodes.join(pairs.select(F.col("source_id").alias("node_id"), "target_id"), "node_id", "left")
    ranked = owner.withColumn("_order", F.struct(F.col("target_id").isNotNull(), F.col("node_id"))).withColumn(
        "node_id", F.coalesce("target_id", "node_id"))
    picks = [
        F.min_by(field.name, F.when(F.col(field.name).isNotNull(), F.struct("_order", field.name))).alias(field.name)
        for field in model.NODE_SCHEMA if field.name not in ("node_id", "props")
    ]
    flat = ranked.groupBy("node_id").agg(*picks)
    props = ranked.select("node_id", "_order", F.explode("props").alias("key", "value")).groupBy("node_id", "key").agg(
        F.min_by("value", F.struct("_order", "value")).alias("value")).groupBy("node_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("props"))
    return conform(flat.join(props, "node_id", "left"), model.NODE_SCHEMA)


def _comparable(df: DataFrame) -> DataFrame:
    return df.select(*[
        F.to_json(F.array_sort(F.map_entries(F.col(field.name)))).alias(field.name)
        if isinstance(field.dataType, T.MapType) else F.col(field.name)
        for field in df.schema
    ])


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """Equal as multisets of rows."""
    a, b = _comparable(left), _comparable(right.select(*left.columns))
    # Counted up and down in one aggregation, so that each row is shuffled once at most and equal rows of a task together.
    both = a.withColumn("_n", F.lit(1)).unionAll(b.withColumn("_n", F.lit(-1)))
    return not both.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).filter("_n != 0").limit(1).take(1)


def check_record(record: MergeRecord) -> DataFrame:
    """Problems of a stored merge record."""
    focus = record.focus.filter(F.col("node_id").isNotNull()).select("node_id")
    states = {"before": record.before, "after": record.after}
    nodes = edges = None
    for name, state in states.items():
        n = state.nodes.select(F.lit(name).alias("state"), "node_id")
        e = state.edges.select(F.lit(name).alias("state"), "src_id", "dst_id")
        nodes = n if nodes is None else nodes.unionByName(n)
        edges = e if edges is None else edges.unionByName(e)
    return undo_payload_issues(focus, nodes, edges)


def undo_merge(graph: Graph, record: MergeRecord) -> Graph:
    """Restore the state before the merge, provided nothing in it changed since."""
    require(check_record(record), "the stored merge record is incomplete or inconsistent")
    ids = record.focus.filter(F.col("node_id").isNotNull()).select("node_id")
    marked = cut_lineage(_with_ends(graph.edges, ids.select("node_id", F.col("node_id").alias("target_id")).distinct()))
    now = _captured(graph, record.focus, _at_ends(marked))
    for found, stored in ((now.nodes, record.after.nodes), (now.edges, record.after.edges),
                          (now.alias_edges, record.after.alias_edges), (now.aliases, record.after.aliases)):
        if not same_rows(found, stored):
            raise ValueError("the merged objects were changed since; undo stopped")
    names = record.focus.filter(F.col("normalized_name").isNotNull()).select("normalized_name").distinct()
    kept_nodes = graph.nodes.join(ids, "node_id", "left_anti").select(*model.NODE_SCHEMA.names)
    nodes = kept_nodes.unionByName(record.before.nodes)
    # Few nodes have many edges: their ids are made distinct before they are looked up.
    ends = record.before.edges.select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).distinct()
    require(ends.join(nodes.select("node_id"), "node_id", "left_anti"), "an endpoint of a former relationship is gone; undo stopped")
    alias_edges = graph.alias_edges.join(ids.select(F.col("node_id").alias("target_id")), "target_id", "left_anti").join(
        names, "normalized_name", "left_anti").select(*model.ALIAS_EDGE_SCHEMA.names)
    aliases = graph.aliases.join(names, "normalized_name", "left_anti").select(*model.ALIAS_SCHEMA.names)
    return graph.with_(
        nodes=nodes,
        edges=_elsewhere(marked).unionByName(record.before.edges),
        alias_edges=alias_edges.unionByName(record.before.alias_edges),
        aliases=aliases.unionByName(record.before.aliases))


# Stored records --------------------------------------------------------------------------------------

FOCUS_SCHEMA = T.StructType([T.StructField("node_id", T.StringType()), T.StructField("normalized_name", T.StringType())])
_PARTS = {"nodes": model.NODE_SCHEMA, "edges": model.EDGE_SCHEMA, "alias_edges": model.ALIAS_EDGE_SCHEMA, "aliases": model.ALIAS_SCHEMA}


def record_rows(record: MergeRecord, decision_id: Column) -> DataFrame:
    """A merge record as rows of the graph's ``merge_states``."""
    def rows(table: DataFrame, part: str, state: str, schema: T.StructType) -> DataFrame:
        return table.select(decision_id.alias("decision_id"), F.lit(part).alias("part"), F.lit(state).alias("state"),
                            F.to_json(F.struct(*schema.names)).alias("row_json"))

    result = rows(record.focus, "focus", "both", FOCUS_SCHEMA)
    for name, state in (("before", record.before), ("after", record.after)):
        for part, schema in _PARTS.items():
            result = result.unionByName(rows(getattr(state, part), part, name, schema))
    return result


def stored_record(graph: Graph, decision_id: str) -> MergeRecord:
    """The record that :func:`record_rows` put into the graph."""
    own = graph.merge_states.filter(F.col("decision_id") == decision_id)

    def table(part: str, state: str, schema: T.StructType) -> DataFrame:
        return own.filter((F.col("part") == part) & (F.col("state") == state)).select(
            F.from_json("row_json", schema).alias("row")).select("row.*")

    before, after = (State(**{part: table(part, state, schema) for part, schema in _PARTS.items()}) for state in ("before", "after"))
    # The focus meets every other part; the rows of all parts need not be read again for it.
    return MergeRecord(cut_lineage(table("focus", "both", FOCUS_SCHEMA)), before, after)


# Preview ---------------------------------------------------------------------------------------------

def _relationships(graph: Graph, pairs: DataFrame, side: str) -> DataFrame:
    """Relationship rows at each pair's ``side`` node: direction, rel_type, other_label, other_ref, rel_key."""
    other = graph.nodes.select(
        F.col("node_id").alias("other_id"), F.col("label").alias("other_label"),
        reference_of(F.col("label"), F.col("name"), F.col("process_id"), F.col("cmdb_id"), F.col("id"),
                     F.col("node_id")).alias("other_ref"))
    wanted = pairs.select("source_id", "target_id", F.col(side).alias("at_id"))
    parts = []
    for direction, here, there in (("out", "src_id", "dst_id"), ("in", "dst_id", "src_id")):
        edges = graph.edges.select(F.col(here).alias("at_id"), F.col(there).alias("other_id"), "rel_type")
        parts.append(wanted.join(edges, "at_id").withColumn("direction", F.lit(direction)))
    return parts[0].unionByName(parts[1]).join(other, "other_id").select(
        "source_id", "target_id", "direction", "rel_type", "other_label", "other_ref",
        relationship_key(F.col("rel_type"), F.col("other_label"), F.col("other_ref")).alias("rel_key"))


def merge_preview(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Relationships the source would hand over, with ``at_target`` when the target has the same one already."""
    ours = _relationships(graph, pairs, "source_id")
    # What stands at a target is the same for all its sources.
    targets = pairs.select(F.lit(None).cast("string").alias("source_id"), "target_id").distinct()
    theirs = _relationships(graph, targets, "target_id").select("target_id", "direction", "rel_key").distinct()
    keys = ["target_id", "direction", "rel_key"]
    return ours.join(theirs.withColumn("_hit", F.lit(True)), keys, "left").select(
        "source_id", "target_id", "direction", "rel_type", "other_label", "other_ref",
        F.coalesce("_hit", F.lit(False)).alias("at_target"))


def merge_alias_names(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Alias names at source and target of each pair."""
    names = graph.alias_edges.select("normalized_name", F.col("target_id").alias("at_id")).join(
        graph.aliases.select("normalized_name", F.col("name").alias("alias_name")), "normalized_name")
    parts = [
        pairs.select("source_id", "target_id", F.col(side).alias("at_id"), F.lit(side[:-3]).alias("side")).join(names, "at_id")
        for side in ("source_id", "target_id")
    ]
    return parts[0].unionByName(parts[1]).select("source_id", "target_id", "side", "alias_name")


def merge_conflicts(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Properties both nodes fill differently; the merge keeps the target's value."""
    columns = [field.name for field in model.NODE_SCHEMA if field.name not in ("label", "node_id", "props")]
    entries = F.array(*[F.struct(F.lit(name).alias("property"), F.col(name).cast("string").alias("value")) for name in columns])
    flat = graph.nodes.select("node_id", F.explode(F.concat(entries, F.coalesce(
        F.transform(F.map_entries("props"), lambda e: F.struct(e["key"].alias("property"), e["value"].alias("value"))),
        F.array().cast("array<struct<property:string,value:string>>")))).alias("e")).select("node_id", "e.*")
    filled = flat.filter(F.col("value").isNotNull() & ~F.col("value").isin("", "false") & (F.col("property") != "created_at"))
    source = filled.select(F.col("node_id").alias("source_id"), "property", F.col("value").alias("source_value"))
    target = filled.select(F.col("node_id").alias("target_id"), "property", F.col("value").alias("target_value"))
    return pairs.join(source, "source_id").join(target, ["target_id", "property"]).filter(
        "source_value <> target_value").select("source_id", "target_id", "property", "source_value", "target_value")


def merge_summary(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Per pair: outgoing and incoming relationships, duplicates at the target, aliases taken over."""
    rows = merge_preview(graph, pairs)
    counts = rows.groupBy("source_id", "target_id").agg(
        F.count_if(F.col("direction") == "out").alias("outgoing"),
        F.count_if(F.col("direction") == "in").alias("incoming"),
        F.count_if(F.col("at_target")).alias("duplicates"))
    aliases = merge_alias_names(graph, pairs).filter(F.col("side") == "source").groupBy("source_id", "target_id").agg(
        F.count(F.lit(1)).alias("aliases"))
    joined = pairs.join(counts, ["source_id", "target_id"], "left").join(aliases, ["source_id", "target_id"], "left")
    zero = F.lit(0).cast("long")
    return joined.select("source_id", "target_id", *[F.coalesce(name, zero).alias(name)
                                                     for name in ("outgoing", "incoming", "duplicates", "aliases")])
