"""Organization names: resolution, canonical spelling, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatemap import model
from estatemap.functions import text
from estatemap.functions.naming import node_id
from estatemap.graph import Graph
from estatemap.operators.tables import first_by


def alias_targets(graph: Graph) -> DataFrame:
    """(normalized_name, target) of every alias of an organization unit, distinct."""
    units = graph.label("OrgUnit").select(F.col("node_id").alias("target_id"), text.optional(F.col("name")).alias("target"))
    return (
        graph.alias_edges.filter(F.col("target_label") == "OrgUnit").join(units, "target_id")
        .select(text.optional(F.col("normalized_name")).alias("normalized_name"), "target").dropna().distinct()
    )


def _lookup(graph: Graph) -> DataFrame:
    """One row per folded name: the unit of that name, and how many units an alias of it means."""
    units = graph.label("OrgUnit").select(text.optional(F.col("name")).alias("unit")).dropna().select(
        text.fold_key(F.col("unit")).alias("org_key"), "unit", F.lit(None).cast("string").alias("target"))
    aliases = alias_targets(graph).select(
        F.col("normalized_name").alias("org_key"), F.lit(None).cast("string").alias("unit"), "target")
    return units.unionByName(aliases).groupBy("org_key").agg(
        F.min("unit").alias("unit"), F.count_distinct("target").alias("targets"), F.min("target").alias("target"))


def resolve_org(names: DataFrame, column: str, graph: Graph) -> DataFrame:
    """Add org_status (unique, ambiguous, missing) and org_name for the names in ``column``.

    An exact folded unit name wins; otherwise an alias decides when all its targets agree.
    """
    keyed = names.withColumn("org_key", text.fold_key(F.coalesce(F.col(column), F.lit(""))))
    status = (
        F.when(F.col("org_key") == "", "missing")
        .when(F.col("unit").isNotNull() | (F.col("targets") == 1), "unique")
        .when(F.col("targets") > 1, "ambiguous")
        .otherwise("missing")
    )
    name = F.when(F.col("org_status") == "unique", F.coalesce("unit", "target"))
    return (
        keyed.join(_lookup(graph), "org_key", "left")
        .withColumn("org_status", status).withColumn("org_name", name)
        .drop("org_key", "unit", "target", "targets")
    )


def apply_org_mapping(documents: DataFrame, graph: Graph) -> DataFrame:
    """Resolve the organization candidates and the owner of each document.

    Adds org_units (resolved, distinct, in order) and org_unit (when there is exactly one); resolved
    candidates leave ``org_unit_candidates``. Regrouping happens within one document's own list.
    """
    key = F.xxhash64("source_path", "process_id", F.coalesce("process_name", F.lit("")))
    keyed = documents.withColumn("_doc", F.struct("source_path", "process_id", key.alias("h")))
    items = keyed.select("_doc", F.posexplode("org_unit_candidates").alias("pos", "candidate"))
    grouped = (
        resolve_org(items, "candidate", graph).groupBy("_doc")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "candidate", "org_name"))).alias("_items"))
    )
    named = F.filter("_items", lambda item: item["org_name"].isNotNull())
    open_items = F.filter("_items", lambda item: item["org_name"].isNull())
    none = F.array().cast("array<string>")
    mapped = keyed.join(grouped, "_doc", "left").withColumns({
        "org_units": F.coalesce(F.array_distinct(F.transform(named, lambda item: item["org_name"])), none),
        "org_unit_candidates": F.coalesce(F.transform(open_items, lambda item: item["candidate"]), none),
    })
    mapped = mapped.withColumn("org_unit", F.when(F.size("org_units") == 1, F.col("org_units")[0]).otherwise(""))
    resolved = resolve_org(mapped, "process_owner_candidate", graph)
    return resolved.withColumn("process_owner_candidate", F.coalesce("org_name", "process_owner_candidate")).drop(
        "_doc", "_items", "org_status", "org_name")


def owner_assignments(entities: DataFrame, graph: Graph) -> DataFrame:
    """(entity_id, org_unit_name) for entities whose owner resolves to one unit."""
    owned = entities.select("entity_id", text.squeeze(F.col("owner_name")).alias("owner")).filter(F.col("owner") != "")
    return resolve_org(owned, "owner", graph).filter(F.col("org_status") == "unique").select(
        "entity_id", F.col("org_name").alias("org_unit_name"))


def owner_candidates(entities: DataFrame, graph: Graph, source_path: str = "cmdb_sync") -> DataFrame:
    """Owners that are no known unit, as rows for the candidate upsert."""
    owners = entities.select(text.squeeze(F.col("owner_name")).alias("candidate_name")).filter(
        F.col("candidate_name") != "").distinct()
    return resolve_org(owners, "candidate_name", graph).filter(F.col("org_status") != "unique").select(
        "candidate_name", F.lit(source_path).alias("source_path"), F.lit("").alias("process_name"),
        F.lit("").alias("role_name"))


def canonical_org_names(names: DataFrame, column: str, graph: Graph) -> DataFrame:
    """Add ``canonical``: the stored unit of the same name in any case, else the trimmed name.

    New names that differ only in case share the first spelling in sort order.
    """
    stored = graph.label("OrgUnit").filter(F.col("name").isNotNull()).select(
        F.lower("name").alias("_lower"), F.struct(F.lit(0), "name").alias("_entry"))
    wanted = names.select(text.strip(F.col(column)).alias("_name")).distinct()
    fresh = wanted.select(F.lower("_name").alias("_lower"), F.struct(F.lit(1), F.col("_name").alias("name")).alias("_entry"))
    best = stored.unionByName(fresh.toDF("_lower", "_entry")).groupBy("_lower").agg(F.min("_entry").alias("_entry"))
    return (
        names.withColumn("_lower", F.lower(text.strip(F.col(column))))
        .join(best.select("_lower", F.col("_entry.name").alias("canonical")), "_lower", "left").drop("_lower")
    )


def role_suggestions(roles: DataFrame, graph: Graph) -> DataFrame:
    """Per role: the role's own name as a new unit, or empty when a unit of that name exists."""
    units = graph.label("OrgUnit").select(text.fold_key(F.col("name")).alias("_key"), F.lit(True).alias("_exists")).distinct()
    return (
        roles.withColumn("_key", text.fold_key(F.col("role"))).join(units, "_key", "left")
        .select("role", F.when(F.col("_exists"), "").otherwise(F.col("role")).alias("suggested_unit"))
    )


def role_unit_options(role: str, graph: Graph) -> DataFrame:
    """Units a role may be assigned to: all but the one of the same name."""
    return graph.label("OrgUnit").filter(
        (F.coalesce("name", F.lit("")) != "") & (text.fold_key(F.col("name")) != text.fold_key(F.lit(role)))).select("name")


def org_units(graph: Graph) -> DataFrame:
    return graph.label("OrgUnit").select("name").orderBy(F.lower("name"))


def processes_with_owner(graph: Graph) -> DataFrame:
    owners = graph.relation("RESPONSIBLE_FOR", "OrgUnit", "Process").join(
        graph.label("OrgUnit").select(F.col("node_id").alias("src_id"), F.col("name").alias("owner")), "src_id").select(
        F.col("dst_id").alias("node_id"), "owner")
    real = graph.label("Process").filter(~F.coalesce("placeholder", F.lit(False)))
    return real.join(owners, "node_id", "left").select("process_id", F.col("name").alias("process"), "owner").orderBy("process")


def merge_candidates(graph: Graph) -> DataFrame:
    """Processes that may be merged, in case-insensitive order."""
    return (
        graph.label("Process").filter(~F.coalesce("placeholder", F.lit(False)))
        .select("node_id", F.coalesce("process_id", F.lit("")).alias("process_id"),
                F.coalesce("name", F.lit("")).alias("process_name"))
        .orderBy(F.lower("process_name"), F.lower("process_id"))
    )


# Candidate queue ------------------------------------------------------------------------------------

def upsert_org_candidates(graph: Graph, seen: DataFrame, today: str) -> Graph:
    """Record unresolved names with where they were seen.

    ``seen`` has candidate_name, source_path, process_name and role_name. first_seen stays; last_seen
    moves only while the candidate is open.
    """
    cleaned = seen.withColumn("candidate_name", text.squeeze(F.col("candidate_name"))).filter(
        F.col("candidate_name") != "").withColumn("normalized_name", text.fold_key(F.col("candidate_name")))
    day = F.lit(today).cast("date")
    # The spelling seen first wins; sort order stands in where rows have none.
    names = cleaned.groupBy("normalized_name").agg(F.min("candidate_name").alias("_name"))
    candidates = graph.candidates.join(names, "normalized_name", "full_outer").select(
        "normalized_name",
        F.coalesce("candidate_name", "_name").alias("candidate_name"),
        F.coalesce("status", F.lit("open")).alias("status"),
        F.coalesce("mapped_org_unit", F.lit("")).alias("mapped_org_unit"),
        F.coalesce("first_seen", day).alias("first_seen"),
        F.when(F.col("_name").isNotNull() & (F.coalesce("status", F.lit("open")) == "open"), day)
        .otherwise(F.col("last_seen")).alias("last_seen"),
    )
    kinds = {"path": "source_path", "process": "process_name", "role": "role_name"}
    entries = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(column).alias("value")) for kind, column in kinds.items()])
    sources = cleaned.select("normalized_name", F.explode(entries).alias("e")).select(
        "normalized_name", "e.kind", "e.value").filter(F.coalesce("value", F.lit("")) != "")
    return graph.with_(candidates=candidates, candidate_sources=graph.candidate_sources.unionByName(sources).distinct())


def org_candidates(graph: Graph, status: str | None = None) -> DataFrame:
    return graph.candidates.filter(F.col("status") == status) if status else graph.candidates


def _set_candidates(graph: Graph, decided: DataFrame, today: str) -> Graph:
    chosen = first_by(decided.select(text.fold_key(F.col("candidate_name")).alias("normalized_name"), "_status", "_target"),
                      ["normalized_name"], [F.col("_target")])
    updated = graph.candidates.join(chosen, "normalized_name", "left").select(
        "normalized_name", "candidate_name",
        F.coalesce("_status", "status").alias("status"),
        F.when(F.col("_status").isNotNull(), F.col("_target")).otherwise(F.col("mapped_org_unit")).alias("mapped_org_unit"),
        "first_seen",
        F.when(F.col("_status").isNotNull(), F.lit(today).cast("date")).otherwise(F.col("last_seen")).alias("last_seen"),
    )
    return graph.with_(candidates=updated)


def map_org_candidates(graph: Graph, mapping: DataFrame, today: str) -> Graph:
    """``mapping`` has candidate_name and target; the candidate counts as decided."""
    return _set_candidates(graph, mapping.select(
        "candidate_name", F.lit("mapped").alias("_status"), text.strip(F.col("target")).alias("_target")), today)


def accept_org_candidates(graph: Graph, accepted: DataFrame, today: str) -> Graph:
    """Candidates become units of their own, under ``proposed_name`` when given; alias included."""
    from estatemap.operators.aliases import add_org_aliases
    from estatemap.operators.upserts import register_org_units

    rows = accepted.select("candidate_name", F.coalesce(text.optional(F.col("proposed_name")), "candidate_name").alias("target"))
    graph = register_org_units(map_org_candidates(graph, rows, today), rows.select(F.col("target").alias("name")))
    return add_org_aliases(graph, rows, model.ALIAS_CANDIDATE, today)


def reject_org_candidates(graph: Graph, rejected: DataFrame, today: str) -> Graph:
    return _set_candidates(graph, rejected.select(
        "candidate_name", F.lit("rejected").alias("_status"), F.lit("").alias("_target")), today)


def process_owner_candidates(documents: DataFrame, graph: Graph) -> DataFrame:
    """Owner suggestions of the last run whose process exists, has no owner and is undecided."""
    processes = graph.label("Process").filter(F.col("process_id").isNotNull()).select("node_id", "process_id")
    owned = graph.relation("RESPONSIBLE_FOR", "OrgUnit", "Process").select(F.col("dst_id").alias("node_id"))
    free = processes.join(owned, "node_id", "left_anti").select("process_id")
    decided = F.coalesce("process_owner_candidate_status", F.lit("")).isin("accepted", "rejected")
    return (
        documents.filter(text.optional(F.col("process_owner_candidate")).isNotNull() & ~decided)
        .join(free, "process_id", "left_semi")
        .select("process_id", "process_name", text.strip(F.col("process_owner_candidate")).alias("candidate_org_unit"),
                "source_path")
    )


def decide_owner_candidates(documents: DataFrame, decided: DataFrame, status: str) -> DataFrame:
    """Mark the owner suggestion of the given processes as accepted or rejected."""
    hit = decided.select("process_id").distinct().withColumn("_hit", F.lit(True))
    return documents.join(hit, "process_id", "left").withColumn(
        "process_owner_candidate_status",
        F.when(F.col("_hit"), F.lit(status)).otherwise(F.col("process_owner_candidate_status"))).drop("_hit")


def process_owner_counts(graph: Graph) -> DataFrame:
    """Owners per process, 0 included."""
    counts = graph.relation("RESPONSIBLE_FOR", "OrgUnit", "Process").groupBy(F.col("dst_id").alias("node_id")).agg(
        F.count(F.lit(1)).alias("owner_count"))
    return graph.label("Process").join(counts, "node_id", "left").select(
        "process_id", F.coalesce("owner_count", F.lit(0)).alias("owner_count"))


def unassigned_roles(graph: Graph) -> DataFrame:
    """(role, process) of roles nobody can assume: no unit assumes them, none is named like them, not role-only."""
    assumed = graph.relation("CAN_ASSUME", "OrgUnit", "Role").select(F.col("dst_id").alias("node_id"))
    units = graph.label("OrgUnit").select(F.lower("name").alias("_lower"))
    roles = (
        graph.label("Role").filter(~F.coalesce("role_only", F.lit(False)) & (F.coalesce("name", F.lit("")) != ""))
        .join(assumed, "node_id", "left_anti")
        .withColumn("_lower", F.lower("name")).join(units, "_lower", "left_anti")
        .select(F.col("node_id").alias("src_id"), F.col("name").alias("role"))
    )
    processes = graph.label("Process").select(F.col("node_id").alias("dst_id"), F.col("name").alias("process"))
    return graph.relation("PARTICIPATES_IN", "Role", "Process").join(roles, "src_id").join(processes, "dst_id").select(
        "role", "process")


def org_node_ids(names: DataFrame) -> DataFrame:
    return names.withColumn("node_id", node_id("OrgUnit", F.col("name")))
