"""Reports over runs, matches and the review queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatemap import model
from estatemap.functions import text
from estatemap.functions.naming import row_id, text_or
from estatemap.graph import Graph
from estatemap.sources.documents import dedup_documents


def _filled(name: str) -> Column:
    return text_or(F.col(name)) != ""


def run_summary(documents: DataFrame) -> DataFrame:
    """One row of counts over the distinct documents of a run."""
    return dedup_documents(documents).agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(F.col("process_name").isNotNull()).alias("identified_processes"),
        F.count_if(F.col("process_write_action") == model.INSERTED).alias("new_processes"),
        F.count_if(F.col("process_write_action") == model.UPDATED).alias("existing_processes"),
        F.count_if(F.col("status") == model.STATUS_NO_MATCHES).alias("no_matches"),
        F.count_if(F.col("status") == model.STATUS_ERROR).alias("errors"))


def document_status_rows(documents: DataFrame, matches: DataFrame, review: DataFrame | None = None) -> DataFrame:
    """Applications, matches and open items per document; ``matches`` has a row per match."""
    zero = F.lit(0).cast("long")
    keyed = lambda rows: rows.withColumn("_process", text_or(F.col("process_id")))
    counts = keyed(matches).groupBy("source_path", "_process").agg(
        F.count_if(_filled("cmdb_id")).alias("matched"), F.count_if(~_filled("cmdb_id")).alias("unmatched"))
    rows = keyed(documents).join(counts, ["source_path", "_process"], "left")
    if review is not None:
        items = keyed(review).groupBy("source_path", "_process").agg(F.count(F.lit(1)).alias("review_items"))
        rows = rows.join(items, ["source_path", "_process"], "left")
    else:
        rows = rows.withColumn("review_items", F.lit(None).cast("long"))
    return rows.select(
        "source_path", "status", text_or(F.col("process_name")).alias("process_name"),
        F.col("_process").alias("process_id"), F.coalesce(F.array_size("applications"), F.lit(0)).alias("applications"),
        F.coalesce("matched", zero).alias("matched"), F.coalesce("unmatched", zero).alias("unmatched"),
        F.coalesce("review_items", zero).alias("review_items"), text_or(F.col("error_message")).alias("error_message"))


def review_rows(matches: DataFrame, items: DataFrame) -> DataFrame:
    """Open review items as flat rows with a stable id; ``items`` come from ``matching.review_items``."""
    return items.select(
        row_id(F.col("source_path"), text_or(F.col("file_hash")) if "file_hash" in items.columns else F.lit(""),
               F.col("position"), F.col("application_name"), text_or(F.col("matched_name")), text_or(F.col("cmdb_id"))).alias("row_id"),
        "source_path", "process", "process_id", F.col("application_name").alias("anwendung_im_prozess"),
        F.coalesce(F.nullif("matched_name", F.lit("")), F.lit("-")).alias("anwendung_in_cmdb"), "confidence",
        F.col("source").alias("quelle"), "cmdb_id")


def review_sort(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.lower("anwendung_im_prozess"), F.lower("process"))


def review_summary(matches: DataFrame) -> DataFrame:
    """Exact and open application matches; rejected ones count for neither."""
    known = _filled("cmdb_id")
    exact = known & ((F.col("confidence") == model.STRONG) | F.col("source").isin(model.KNOWN, model.KNOWN_MANUAL))
    open_match = ~exact & ((F.col("confidence") == model.WEAK) | ~known)
    return matches.filter(F.col("source") != model.REJECTED).agg(
        F.count_if(exact).alias("exact_application_matches"), F.count_if(open_match).alias("review_application_matches"))


def exact_org_units(documents: DataFrame) -> DataFrame:
    return documents.agg(F.coalesce(F.sum(F.array_size("org_units")), F.lit(0).cast("long")).alias("exact_org_unit_matches"))


def candidate_scope(graph: Graph, documents: DataFrame) -> DataFrame:
    """Open candidates seen in the given documents (by path or process name) and elsewhere."""
    scope = documents.select(F.explode(F.array(
        F.struct(F.lit("path").alias("kind"), F.col("source_path").alias("value")),
        F.struct(F.lit("process").alias("kind"), F.col("process_name").alias("value")))).alias("s")).select("s.*").filter(
        _filled("value")).distinct()
    inside = graph.candidate_sources.join(scope, ["kind", "value"], "left_semi").select("normalized_name").distinct()
    open_ones = graph.candidates.filter(F.coalesce("status", F.lit("open")) == "open")
    return open_ones.join(inside.withColumn("_in", F.lit(True)), "normalized_name", "left").agg(
        F.count_if(F.col("_in")).alias("scoped_open_candidates"),
        F.count_if(F.col("_in").isNull()).alias("external_open_candidates"))


def duplicate_terms(mentions: DataFrame) -> DataFrame:
    """Spellings per process that share a display key with another spelling: process, key, variant.

    One row per spelling: a process that names one application in very many ways gives many rows, not
    one huge one.
    """
    spelled = mentions.select("process", text.display_key(F.col("application_name")).alias("normalized"),
                              F.col("application_name").alias("variant")).filter(_filled("normalized")).distinct()
    repeated = spelled.groupBy("process", "normalized").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return spelled.join(repeated, ["process", "normalized"], "left_semi")


def document_details(documents: DataFrame) -> DataFrame:
    """Detail projection with a stable id and a title."""
    return documents.select(
        row_id(F.col("source_path"), F.col("file_hash"), text_or(F.col("process_name")), F.col("ordinal")).alias("detail_id"),
        F.concat(F.coalesce("status", F.lit("unknown")), F.lit(": "), text_or(F.col("source_path"))).alias("title"),
        *[name for name in documents.columns if name not in ("detail_id", "title")])


def import_outcome(documents: DataFrame) -> DataFrame:
    """Imported, without matches and failed documents as one row."""
    return documents.agg(
        F.count_if(F.col("status").isin(model.STATUS_PROCESSED, model.STATUS_NO_MATCHES)).alias("imported"),
        F.count_if(F.col("status") == model.STATUS_NO_MATCHES).alias("no_matches"),
        F.count_if(F.col("status") == model.STATUS_ERROR).alias("errors"))


def import_failures(documents: DataFrame) -> DataFrame:
    failed = ~F.col("status").isin(model.STATUS_PROCESSED, model.STATUS_NO_MATCHES)
    return documents.filter(failed).select("display_path", "status", text_or(F.col("error_message")).alias("reason"))


def sync_report(entities: DataFrame, relations: DataFrame, owners: DataFrame, graph: Graph, refreshed: int = 0) -> DataFrame:
    """Counts of one master data sync as one row."""
    parts = {
        "entity_count": entities, "relation_count": relations, "owner_assignment_count": owners,
        "owner_candidate_count": graph.candidates.filter(F.col("status") == "open"),
    }
    counted = None
    for name, table in parts.items():
        row = table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        counted = row if counted is None else counted.unionByName(row)
    return counted.agg(*[F.sum(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in parts]).withColumn(
        "refreshed_document_count", F.lit(refreshed).cast("long"))


def graph_counts(graph: Graph) -> DataFrame:
    nodes = graph.nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("node_count").alias("name"), "n")
    edges = graph.edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("relationship_count").alias("name"), "n")
    return nodes.unionByName(edges).agg(*[
        F.sum(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in ("node_count", "relationship_count")])
