"""Alias maintenance and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatemap import model
from estatemap.functions import text
from estatemap.graph import Graph
from estatemap.operators.tables import conform, first_by
from estatemap.operators.upserts import ensure_org_units

EDGE = ["normalized_name", "target_label", "target_id"]


def _distinct_names(rows: DataFrame, alias: str, target: str) -> DataFrame:
    """Rows whose alias and target are not blank and differ when folded."""
    ours, theirs = text.fold_key(F.col(alias)), text.fold_key(F.col(target))
    return rows.filter((F.coalesce(ours, F.lit("")) != "") & (F.coalesce(theirs, F.lit("")) != "") & (ours != theirs))


def put_aliases(graph: Graph, rows: DataFrame, source_kind: str, today: str) -> Graph:
    """Merge (alias_name, target_label, target_id); an edge that exists takes the new source kind."""
    keyed = rows.select(text.strip(F.col("alias_name")).alias("name"), "target_label", "target_id",
                        text.fold_key(F.col("alias_name")).alias("normalized_name")).filter(F.col("normalized_name") != "")
    names = first_by(keyed.select("normalized_name", "name").distinct(), ["normalized_name"], [F.col("name")])
    fresh = names.join(graph.aliases.select("normalized_name"), "normalized_name", "left_anti").withColumns({
        "source_kind": F.lit(source_kind), "created_at": F.lit(today).cast("date")})
    edges = keyed.select(*EDGE).distinct().withColumn("source_kind", F.lit(source_kind))
    kept = graph.alias_edges.join(edges.select(*EDGE), EDGE, "left_anti")
    return graph.with_(
        aliases=graph.aliases.unionByName(conform(fresh, model.ALIAS_SCHEMA)),
        alias_edges=kept.select(*model.ALIAS_EDGE_SCHEMA.names).unionByName(conform(edges, model.ALIAS_EDGE_SCHEMA)))


def drop_orphans(graph: Graph) -> Graph:
    return graph.with_(aliases=graph.aliases.join(
        graph.alias_edges.select("normalized_name"), "normalized_name", "left_semi"))


def _application_ids(graph: Graph) -> DataFrame:
    return graph.label("Application").filter(F.col("cmdb_id").isNotNull()).select(
        "cmdb_id", F.col("node_id").alias("target_id"))


def add_application_aliases(graph: Graph, rows: DataFrame, source_kind: str, today: str) -> Graph:
    """``rows`` has alias_name, matched_name and cmdb_id; identity aliases are skipped."""
    wanted = _distinct_names(rows, "alias_name", "matched_name").join(_application_ids(graph), "cmdb_id").withColumn(
        "target_label", F.lit("Application"))
    return put_aliases(graph, wanted, source_kind, today)


def add_org_aliases(graph: Graph, rows: DataFrame, source_kind: str, today: str) -> Graph:
    """``rows`` has candidate_name and target; the unit is created when missing."""
    wanted = _distinct_names(rows, "candidate_name", "target").select(
        F.col("candidate_name").alias("alias_name"), text.strip(F.col("target")).alias("name"))
    graph, units = ensure_org_units(graph, wanted)
    placed = wanted.join(units, "name").select(
        "alias_name", F.lit("OrgUnit").alias("target_label"), F.col("org_id").alias("target_id"))
    return put_aliases(graph, placed, source_kind, today)


def add_process_aliases(graph: Graph, rows: DataFrame, source_kind: str, today: str) -> Graph:
    """``rows`` has alias_name and target_id."""
    return put_aliases(graph, rows.filter(text.optional(F.col("alias_name")).isNotNull()).withColumn(
        "target_label", F.lit("Process")), source_kind, today)


def delete_aliases(graph: Graph, rows: DataFrame) -> Graph:
    """Remove exactly (alias_name, target_label, target_id, source_kind), then aliases that refer to nothing."""
    gone = rows.select(text.fold_key(F.col("alias_name")).alias("normalized_name"), "target_label", "target_id",
                       "source_kind").distinct()
    kept = graph.alias_edges.join(gone, [*EDGE, "source_kind"], "left_anti")
    return drop_orphans(graph.with_(alias_edges=kept.select(*model.ALIAS_EDGE_SCHEMA.names)))


def curated_aliases(confirmed: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct aliases that confirmed links and mapped candidates stand for."""
    links = _distinct_names(confirmed, "anwendung_name", "resolved_to").filter(
        F.coalesce("cmdb_id", F.lit("")) != "").select(
        F.col("anwendung_name").alias("alias_name"), F.col("resolved_to").alias("matched_name"), "cmdb_id",
        text.fold_key(F.col("anwendung_name")).alias("_key"))
    links = first_by(links, ["_key", "cmdb_id"], [F.col("alias_name")]).drop("_key")
    mapped = _distinct_names(candidates.filter(F.col("status") == "mapped"), "candidate_name", "mapped_org_unit").select(
        "candidate_name", F.col("mapped_org_unit").alias("target"),
        text.fold_key(F.col("candidate_name")).alias("_key"), text.fold_key(F.col("mapped_org_unit")).alias("_unit"))
    mapped = first_by(mapped, ["_key", "_unit"], [F.col("candidate_name"), F.col("target")]).drop("_key", "_unit")
    return links, mapped


def sync_aliases(graph: Graph, confirmed: DataFrame, today: str) -> Graph:
    """Rebuild the derived aliases; those of other origin stay."""
    links, mapped = curated_aliases(confirmed, graph.candidates)
    graph = graph.with_(alias_edges=graph.alias_edges.filter(F.col("source_kind") != model.ALIAS_KNOWLEDGE))
    graph = add_application_aliases(graph, links, model.ALIAS_KNOWLEDGE, today)
    graph = add_org_aliases(graph, mapped, model.ALIAS_KNOWLEDGE, today)
    return drop_orphans(graph)


def alias_lookup(graph: Graph, terms: DataFrame) -> DataFrame:
    """Targets of each ``term``: entity_type, entity_name, entity_id, alias_name, in that order."""
    keyed = terms.select("term", text.fold_key(F.col("term")).alias("normalized_name")).filter(
        F.col("normalized_name") != "").distinct()
    ident = (
        F.when(F.col("label") == "Application", F.col("cmdb_id"))
        .when(F.col("label") == "Process", F.col("process_id")).otherwise(F.col("name"))
    )
    targets = graph.nodes.filter(F.col("label").isin("Application", "Process", "OrgUnit")).select(
        F.col("node_id").alias("target_id"), F.col("label").alias("entity_type"),
        text.strip(F.col("name")).alias("entity_name"), F.coalesce(text.strip(ident), F.lit("")).alias("entity_id"))
    names = graph.aliases.select("normalized_name", text.strip(F.col("name")).alias("alias_name"))
    return (
        keyed.join(graph.alias_edges.select("normalized_name", "target_id"), "normalized_name")
        .join(names, "normalized_name").join(targets, "target_id")
        .filter(F.coalesce("entity_name", F.lit("")) != "")
        .select("term", "entity_type", "entity_name", "entity_id", "alias_name")
        .orderBy("term", "entity_type", "entity_name", "entity_id")
    )


def alias_hints(graph: Graph, terms: DataFrame) -> DataFrame:
    """One hint row per entity an alias of the terms may mean."""
    hits = alias_lookup(graph, terms.filter(F.char_length("term") >= 2)).select("term", "entity_type", "entity_name")
    return first_by(hits, ["entity_type", "entity_name"], [F.col("term")]).select("term", "entity_type", "entity_name")


def ambiguous_aliases(graph: Graph) -> DataFrame:
    """Aliases without one clear target."""
    return graph.alias_edges.groupBy("normalized_name").agg(
        F.count_distinct("target_id").alias("targets")).filter(F.col("targets") > 1)
