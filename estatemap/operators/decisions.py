"""Decision log and the edge changes that follow from manual decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatemap import model
from estatemap.functions import text
from estatemap.functions.naming import node_id
from estatemap.graph import Graph
from estatemap.operators import merging
from estatemap.operators.aliases import add_application_aliases, delete_aliases
from estatemap.operators.tables import conform, first_by, last_by
from estatemap.operators.upserts import EDGE_KEY, _of_types, _put_edges, _upsert, assign_roles, edge_rows, set_process_owners
from estatemap.session import cut_lineage


def decision_rows(rows: DataFrame, decision_type: str, payload: list[str], created_at: str, *, status: str = "active",
                  supersedes: Column | None = None) -> DataFrame:
    """Log rows with the payload columns as JSON, keys in order.

    The id is a hash of type, payload and time, so that a task that runs twice logs one decision.
    """
    body = F.to_json(F.struct(*[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in sorted(payload)]))
    logged = rows.select(body.alias("payload_json"), (supersedes if supersedes is not None else F.lit(None).cast("string"))
                         .alias("supersedes_decision_id")).distinct()
    return conform(logged.withColumns({
        "decision_id": F.sha2(F.concat_ws("||", F.lit(decision_type), "payload_json", F.lit(created_at)), 256),
        "decision_type": F.lit(decision_type), "status": F.lit(status), "created_at": F.lit(created_at),
    }), model.DECISION_SCHEMA)


def record(graph: Graph, rows: DataFrame) -> Graph:
    return graph.with_(decisions=graph.decisions.unionByName(rows))


def current_decisions(graph: Graph) -> DataFrame:
    """The log with each decision in its latest state."""
    return last_by(graph.decisions, ["decision_id"], [
        F.coalesce("reverted_at", "created_at"), (F.col("status") != "active").cast("int")])


def get_decision(graph: Graph, decision_id: str) -> DataFrame:
    return current_decisions(graph.with_(decisions=graph.decisions.filter(F.col("decision_id") == decision_id)))


def recent_decisions(graph: Graph, limit: int = 20) -> DataFrame:
    return current_decisions(graph).orderBy(F.desc("created_at"), "decision_id").limit(limit)


def mark_reverted(graph: Graph, decisions: DataFrame, reverted_at: str) -> Graph:
    """Append the reverted state of the given current decisions; nothing is rewritten."""
    return record(graph, decisions.withColumns({"status": F.lit("reverted"), "reverted_at": F.lit(reverted_at)}).select(
        *model.DECISION_SCHEMA.names))


LINK_PAYLOAD = ["process_name", "process_id", "application_name", "matched_name", "cmdb_id", "source_path"]


def _link_rows(rows: DataFrame) -> DataFrame:
    """Review rows in payload form; the matched name falls back to the term."""
    matched = F.coalesce(F.nullif(F.nullif(text.strip(F.col("anwendung_in_cmdb")), F.lit("")), F.lit("-")),
                         F.col("anwendung_im_prozess"))
    return rows.select(
        F.col("process").alias("process_name"), "process_id", F.col("anwendung_im_prozess").alias("application_name"),
        matched.alias("matched_name"), "cmdb_id", "source_path")


def _write_links(graph: Graph, links: DataFrame, source: str) -> Graph:
    names = links.groupBy(F.col("cmdb_id").alias("key")).agg(F.max("matched_name").alias("name"), F.lit(0).alias("ordinal"))
    graph, applications = _upsert(graph, "Application", "cmdb_id", names, {"cmdb_id": F.col("key"), "name": F.col("name")})
    wanted = links.groupBy(F.col("process_id").alias("key")).agg(F.max("process_name").alias("name"), F.lit(0).alias("ordinal"))
    known = graph.label("Process").filter(F.col("process_id").isNotNull()).select(F.col("process_id").alias("key"))
    graph, _ = _upsert(graph, "Process", "process_id", wanted.join(known, "key", "left_anti"),
                       {"process_id": F.col("key"), "name": F.col("name")})
    processes = graph.label("Process").filter(F.col("process_id").isNotNull()).select("process_id", F.col("node_id").alias("dst_id"))
    pairs = links.join(applications.select(F.col("key").alias("cmdb_id"), F.col("node_id").alias("src_id")), "cmdb_id").join(
        processes, "process_id").select("src_id", "dst_id", F.col("application_name").alias("raw_name"),
                                        F.lit(model.STRONG).alias("confidence"), F.lit(source).alias("source"))
    fresh = edge_rows(last_by(pairs, ["src_id", "dst_id"], [F.col("raw_name")]), "SERVES", "Application", "Process")
    kept = graph.relation("SERVES").join(fresh.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    return _put_edges(graph, ["SERVES"], kept.unionByName(fresh))


def _drop_candidates(graph: Graph, links: DataFrame) -> Graph:
    """Delete MAY_SERVE between the given applications and processes."""
    applications = graph.label("Application").select("cmdb_id", F.col("node_id").alias("src_id"))
    processes = graph.label("Process").select("process_id", F.col("node_id").alias("dst_id"))
    gone = links.join(applications, "cmdb_id").join(processes, "process_id").select("src_id", "dst_id").distinct()
    kept = graph.relation("MAY_SERVE").join(gone, ["src_id", "dst_id"], "left_anti")
    return _put_edges(graph, ["MAY_SERVE"], kept.select(*model.EDGE_SCHEMA.names))


def confirm_links(graph: Graph, rows: DataFrame, now: str) -> Graph:
    """Confirm review rows: candidate edge out, confirmed edge in, alias when names differ, decision logged."""
    links = _link_rows(rows)
    graph = _write_links(_drop_candidates(graph, links), links, model.SERVES_CONFIRMED)
    graph = add_application_aliases(
        graph, links.select(F.col("application_name").alias("alias_name"), "matched_name", "cmdb_id"),
        model.ALIAS_CONFIRMED, now[:10])
    return record(graph, decision_rows(links, "confirmed_candidate_link", LINK_PAYLOAD, now))


def reject_links(graph: Graph, rows: DataFrame) -> Graph:
    """Reject review rows: candidate edge out, one rejection per (process, term)."""
    links = _link_rows(rows)
    graph = _drop_candidates(graph, links.filter(F.coalesce("cmdb_id", F.lit("")) != ""))
    fresh = first_by(links.select("process_id", F.col("process_name").alias("prozess_name"),
                                  F.col("application_name").alias("anwendung_name")),
                     ["process_id", "anwendung_name"], [F.col("prozess_name")])
    kept = graph.rejections.join(fresh.select("process_id", "anwendung_name"), ["process_id", "anwendung_name"], "left_anti")
    return graph.with_(rejections=kept.select(*model.REJECTION_SCHEMA.names).unionByName(
        conform(fresh, model.REJECTION_SCHEMA)))


def manual_links(graph: Graph, rows: DataFrame, now: str) -> Graph:
    """Links entered by hand."""
    links = _link_rows(rows)
    return record(_write_links(graph, links, model.SERVES_MANUAL), decision_rows(links, "manual_link", LINK_PAYLOAD, now))


def assign_owners(graph: Graph, rows: DataFrame, now: str) -> Graph:
    """Manual owners for (process_id, process_name, org_unit_name), logged."""
    cleaned = rows.withColumn("org_unit_name", text.squeeze(F.col("org_unit_name")))
    graph = set_process_owners(graph, cleaned)
    return record(graph, decision_rows(
        cleaned, "manual_process_owner_assignment", ["process_id", "process_name", "org_unit_name"], now))


def assign_roles_logged(graph: Graph, rows: DataFrame, now: str) -> Graph:
    cleaned = rows.withColumn("org_unit_name", text.squeeze(F.col("org_unit_name")))
    return record(assign_roles(graph, cleaned), decision_rows(
        cleaned, "manual_role_assignment", ["role_name", "org_unit_name"], now))


def merge_logged(graph: Graph, label: str, pairs: DataFrame, now: str) -> Graph:
    """Merge ``pairs`` as one logged decision that any later session can take back."""
    named = graph.label(label).select("node_id", "name")
    names = pairs.join(named.toDF("source_id", "source"), "source_id").join(named.toDF("target_id", "target"), "target_id").agg(
        F.min("source").alias("source_name"), F.min("target").alias("target_name"), F.count(F.lit(1)).alias("merged_count"),
        F.bit_xor(F.xxhash64("source_id", "target_id")).alias("pairs_hash"))
    rows = cut_lineage(decision_rows(names.withColumn("entity_type", F.lit(label)), "entity_merge",
                                     ["entity_type", "source_name", "target_name", "merged_count", "pairs_hash"], now))
    merged, kept = merging.merge_entities(graph, label, pairs, now[:10])
    logged = record(merged, rows)
    states = merging.record_rows(kept, F.lit(rows.first()["decision_id"]))
    return logged.with_(merge_states=logged.merge_states.unionByName(states))


def _undo_merges(graph: Graph, merges: DataFrame) -> Graph:
    """Take back the merges that the caller listed, the newest first."""
    for row in merges.orderBy(F.desc("created_at"), F.desc("decision_id")).collect():
        graph = merging.undo_merge(graph, merging.stored_record(graph, row["decision_id"]))
    return graph


_PAYLOAD = ("process_id string, cmdb_id string, application_name string, matched_name string, org_unit_name string, "
            "role_name string, source_path string")


def _serves_to_drop(graph: Graph, payloads: DataFrame) -> DataFrame:
    applications = graph.label("Application").select("cmdb_id", F.col("node_id").alias("src_id"))
    processes = graph.label("Process").select("process_id", F.col("node_id").alias("dst_id"))
    source = F.when(F.col("decision_type") == "manual_link", model.SERVES_MANUAL).otherwise(model.SERVES_CONFIRMED)
    links = payloads.filter(F.col("decision_type").isin("manual_link", "confirmed_candidate_link"))
    return links.join(applications, "cmdb_id").join(processes, "process_id").select(
        F.lit("SERVES").alias("rel_type"), "src_id", "dst_id", F.col("application_name").alias("raw_name"),
        source.alias("source"))


def revert_decisions(graph: Graph, ids: DataFrame, now: str) -> tuple[Graph, DataFrame]:
    """Undo active decisions and log it. Exactly the edge of a decision goes; a merge gets its stored state back.

    A merge whose objects were changed since stops everything with an error. Returns the graph and (decision_id, outcome): reverted,
    inactive, unsupported or unknown.
    """
    wanted = ids.select("decision_id").distinct()
    found = wanted.join(current_decisions(graph), "decision_id", "left")
    outcome = (
        F.when(F.col("decision_type").isNull(), "unknown")
        .when(F.col("status") != "active", "inactive")
        .when(~F.col("decision_type").isin(*model.REVERTIBLE_TYPES), "unsupported")
        .otherwise("reverted")
    )
    judged = found.withColumn("outcome", outcome)
    active = judged.filter(F.col("outcome") == "reverted")
    graph = _undo_merges(graph, active.filter(F.col("decision_type") == "entity_merge"))
    payloads = active.select("decision_id", "decision_type", F.from_json("payload_json", _PAYLOAD).alias("p")).select(
        "decision_id", "decision_type", "p.*")

    edge = [*EDGE_KEY, "raw_name", "source"]
    serves = graph.relation("SERVES").join(_serves_to_drop(graph, payloads), edge, "left_anti")
    units = graph.label("OrgUnit").select(F.col("name").alias("org_unit_name"), F.col("node_id").alias("src_id"))
    processes = graph.label("Process").select("process_id", F.col("node_id").alias("dst_id"))
    roles = graph.label("Role").select(F.col("name").alias("role_name"), F.col("node_id").alias("dst_id"))
    owned = payloads.filter(F.col("decision_type") == "manual_process_owner_assignment").join(units, "org_unit_name").join(
        processes, "process_id").select(F.lit("RESPONSIBLE_FOR").alias("rel_type"), "src_id", "dst_id")
    assumed = payloads.filter(F.col("decision_type") == "manual_role_assignment").join(units, "org_unit_name").join(
        roles, "role_name").select(F.lit("CAN_ASSUME").alias("rel_type"), "src_id", "dst_id")
    plain = _of_types(graph, ["RESPONSIBLE_FOR", "CAN_ASSUME"]).join(owned.unionByName(assumed), EDGE_KEY, "left_anti")
    aliases = payloads.filter(
        (F.col("decision_type") == "confirmed_candidate_link")
        & (text.fold_key(F.col("application_name")) != text.fold_key(F.col("matched_name")))
    ).join(graph.label("Application").select("cmdb_id", F.col("node_id").alias("target_id")), "cmdb_id").select(
        F.col("application_name").alias("alias_name"), F.lit("Application").alias("target_label"), "target_id",
        F.lit(model.ALIAS_CONFIRMED).alias("source_kind"))

    changed = serves.select(*model.EDGE_SCHEMA.names).unionByName(plain.select(*model.EDGE_SCHEMA.names))
    result = delete_aliases(_put_edges(graph, ["SERVES", "RESPONSIBLE_FOR", "CAN_ASSUME"], changed), aliases)
    audit = decision_rows(
        active.select(F.col("decision_id").alias("reverted_decision_id"), F.col("decision_type").alias("reverted_type")),
        model.AUDIT_TYPE, ["reverted_decision_id", "reverted_type"], now, status="reverted",
        supersedes=F.col("reverted_decision_id"))
    result = record(mark_reverted(result, active.drop("outcome"), now), audit)
    return result, judged.select("decision_id", "outcome")


def affected_paths(decisions: DataFrame) -> DataFrame:
    """Documents to match again after the given decisions were undone."""
    return decisions.select(F.get_json_object("payload_json", "$.source_path").alias("source_path")).filter(
        F.coalesce("source_path", F.lit("")) != "").distinct()
