"""Validation, reports, ranking and review over rows derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatemap import model
from estatemap.functions.text import match_key  # noqa: F401  (re-exported for tests)
from estatemap.operators import decisions, matching, org, quality, reports
from estatemap.operators.org import merge_candidates, org_units, processes_with_owner, unassigned_roles
from estatemap.sources import documents as docs
from estatemap.sources import master_data
from workload.registry import graph_query, register
from workload.scalars import LINES, lines, sql_clean_app, sql_match_key, sql_camel, sql_tokens
from workload.star import graph, plain, query, table

# Master data rows -----------------------------------------------------------------------------------

ENTITIES = (
    "SELECT event_id + 2 AS line_number, CASE WHEN value < 2 THEN ' ' ELSE CAST(user_id AS STRING) END AS id, "
    "CASE WHEN value > 100 THEN '' ELSE event_type END AS name, CASE event_type WHEN 'error' THEN 'Server ' WHEN 'view' THEN '' "
    "WHEN 'click' THEN 'Interface' WHEN 'signup' THEN 'widget' ELSE 'process' END AS entity_type, "
    "CASE WHEN value > 40 THEN 'cloud' WHEN value > 20 THEN 'Virtual' ELSE '' END AS server_type, props AS owner_name FROM {events}")
_JUDGED = (
    f"SELECT line_number, nullif(trim(id), '') AS entity_id, CASE WHEN trim(id) = '' THEN 'id_missing' "
    f"WHEN row_number() OVER (PARTITION BY trim(id) ORDER BY line_number) > 1 THEN 'duplicate_id' WHEN trim(name) = '' THEN 'name_missing' "
    f"WHEN lower(trim(entity_type)) NOT IN ('', 'application', 'interface', 'process', 'server') THEN 'unknown_type' "
    f"WHEN lower(trim(entity_type)) = 'server' AND lower(trim(server_type)) NOT IN ('', 'physical', 'virtual') THEN 'unknown_server_type' "
    f"END AS code FROM ({plain(ENTITIES)})")

register("entity_validation", f"SELECT * FROM ({_JUDGED}) WHERE code IS NOT NULL")(
    lambda spark, folder: quality.validate_entities(query(spark, folder, ENTITIES)))
register("normalized_entities",
         f"SELECT trim(e.id) AS entity_id, trim(e.name) AS name, coalesce(nullif(lower(trim(e.entity_type)), ''), 'application') AS entity_type, "
         f"nullif(lower(trim(e.server_type)), '') AS server_type, nullif(trim(e.owner_name), '') AS owner_name, e.line_number "
         f"FROM ({plain(ENTITIES)}) e JOIN ({_JUDGED}) j USING (line_number) WHERE j.code IS NULL")(
    lambda spark, folder: quality.normalize_entities(query(spark, folder, ENTITIES), strict=False).drop("raw_row"))

register("csv_shape",
         f"WITH l AS (SELECT doc_id, pos, line, CAST(len(string_split(regexp_replace(line, '\"([^\"]|\"\")*\"', '', 'g'), ',')) AS INT) AS n FROM ({LINES})) "
         f"SELECT l.doc_id AS file, l.pos AS line_number, 'column_count' AS code, concat(l.n, ' statt ', h.n, ' Spalten') AS message "
         f"FROM l JOIN l h ON h.doc_id = l.doc_id AND h.pos = 1 WHERE l.pos > 1 AND l.line <> '' AND l.n <> h.n")(
    lambda spark, folder: quality.csv_shape_issues(lines(spark, folder).select(
        F.col("doc_id").alias("file"), F.col("pos").alias("line_number"), F.col("line").alias("value")), ","))

register("relation_columns",
         "SELECT CAST(p_partkey AS VARCHAR) AS source_id, 'RUNS_ON' AS relation_type, trim(t) AS target_id FROM "
         "(SELECT p_partkey, unnest(string_split(concat(p_brand, '| ', p_type, '|'), '|')) AS t FROM part) WHERE trim(t) <> '' UNION ALL "
         "SELECT CAST(p_partkey AS VARCHAR), 'USES_INTERFACE', trim(t) FROM (SELECT p_partkey, unnest(string_split(p_name, '|')) AS t FROM part) "
         "WHERE trim(t) <> ''")(
    lambda spark, folder: master_data.relation_columns(table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("entity_id"), F.concat("p_brand", F.lit("| "), "p_type", F.lit("|")).alias("runs_on"),
        F.col("p_name").alias("uses_interfaces"))))

# Graph checks ---------------------------------------------------------------------------------------

graph_query("uniqueness_violations",
            "SELECT 'Process' AS label, name AS key, count(*) AS copies FROM nodes WHERE label = 'Process' GROUP BY name HAVING count(*) > 1")(
    lambda g: quality.uniqueness_violations(g.with_(nodes=g.label("Process").withColumn("process_id", F.col("name")))))
graph_query("graph_references",
            "SELECT 'dst_id_unknown' AS code, dst_id AS ref FROM edges x WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.node_id = x.dst_id "
            "AND n.label <> 'Goal')")(
    lambda g: quality.graph_reference_issues(g.nodes.filter("label <> 'Goal'"), g.edges))
graph_query("edge_conformance",
            "SELECT rel_type, dst_label AS src_label, src_label AS dst_label, count(*) AS edge_count, 'pair_not_allowed' AS code "
            "FROM edges WHERE src_label <> dst_label GROUP BY 1, 2, 3")(
    lambda g: quality.edge_conformance(g.edges.select(
        "rel_type", F.col("dst_label").alias("src_label"), F.col("src_label").alias("dst_label"))))
graph_query("untyped_nodes",
            "SELECT label, name, CASE label WHEN 'Process' THEN 'BusinessProcess' ELSE 'Device' END AS proposed_type FROM nodes "
            "WHERE label IN ('Process', 'Server')")(
    lambda g: quality.untyped_nodes(g.nodes, g.nodes.sparkSession.createDataFrame(
        [("Process", "BusinessProcess"), ("Server", "Device"), ("Risk", "Risk")], "label string, element_type string")))
graph_query("merge_candidates",
            "SELECT node_id, process_id, name AS process_name FROM nodes WHERE label = 'Process' AND NOT placeholder")(merge_candidates)
graph_query("org_unit_list", "SELECT name FROM nodes WHERE label = 'OrgUnit'")(org_units)
graph_query("processes_with_owner",
            "SELECT p.process_id, p.name AS process, o.name AS owner FROM nodes p LEFT JOIN (edges w JOIN nodes o ON o.node_id = w.src_id "
            "AND w.rel_type = 'RESPONSIBLE_FOR') ON w.dst_id = p.node_id WHERE p.label = 'Process'")(processes_with_owner)
graph_query("process_owner_counts",
            "SELECT process_id, (SELECT count(*) FROM edges w WHERE w.rel_type = 'RESPONSIBLE_FOR' AND w.dst_id = p.node_id) AS owner_count "
            "FROM nodes p WHERE label = 'Process'")(org.process_owner_counts)
graph_query("unassigned_roles",
            "SELECT r.name AS role, p.name AS process FROM nodes r JOIN edges x ON x.src_id = r.node_id AND x.rel_type = 'PARTICIPATES_IN' "
            "JOIN nodes p ON p.node_id = x.dst_id WHERE r.label = 'Role' AND NOT r.role_only AND NOT EXISTS (SELECT 1 FROM edges c "
            "WHERE c.rel_type = 'CAN_ASSUME' AND c.dst_id = r.node_id) AND NOT EXISTS (SELECT 1 FROM nodes o WHERE o.label = 'OrgUnit' "
            "AND lower(o.name) = lower(r.name))")(unassigned_roles)
graph_query("role_suggestions",
            "SELECT name AS role, CASE WHEN upper(name) IN (SELECT name FROM nodes WHERE label = 'OrgUnit') THEN '' ELSE name END AS suggested_unit "
            "FROM nodes WHERE label IN ('Role', 'OrgUnit')")(
    lambda g: org.role_suggestions(g.nodes.filter("label in ('Role', 'OrgUnit')").select(F.col("name").alias("role")), g))
graph_query("graph_counts",
            "SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS relationship_count")(reports.graph_counts)

# Runs ------------------------------------------------------------------------------------------------

RUN = (
    "SELECT concat('doc-', user_id) AS source_path, concat('in/doc-', user_id) AS display_path, props AS file_hash, "
    "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'no_matches' ELSE 'processed' END AS status, "
    "CASE WHEN event_type <> 'error' THEN concat('process ', user_id) END AS process_name, CAST(user_id AS STRING) AS process_id, "
    "CASE event_type WHEN 'click' THEN 'inserted' WHEN 'purchase' THEN 'updated' END AS process_write_action, "
    "CASE WHEN event_type = 'error' THEN props END AS error_message, event_id AS ordinal FROM {events}")
_FIRST = (f"(SELECT * FROM ({plain(RUN)}) QUALIFY row_number() OVER (PARTITION BY source_path, file_hash, status ORDER BY ordinal) = 1)")


def run(spark, folder):
    return query(spark, folder, RUN)


register("run_summary",
         f"SELECT count(*) AS documents, count(process_name) AS identified_processes, count(*) FILTER (process_write_action = 'inserted') AS new_processes, "
         f"count(*) FILTER (process_write_action = 'updated') AS existing_processes, count(*) FILTER (status = 'no_matches') AS no_matches, "
         f"count(*) FILTER (status = 'error') AS errors FROM {_FIRST}")(lambda spark, folder: reports.run_summary(run(spark, folder)))
register("first_documents", f"SELECT * FROM {_FIRST}")(lambda spark, folder: docs.dedup_documents(run(spark, folder)))
register("status_filter",
         f"SELECT * FROM ({plain(RUN)}) WHERE status IN ('error', 'no_matches') AND source_path IN (SELECT concat('doc-', s_suppkey) FROM supplier)")(
    lambda spark, folder: quality.status_filter(run(spark, folder), ["error", "no_matches"], table(spark, folder, "supplier").select(
        F.concat(F.lit("doc-"), "s_suppkey").alias("source_path"))))
register("import_outcome",
         f"SELECT count(*) FILTER (status <> 'error') AS imported, count(*) FILTER (status = 'no_matches') AS no_matches, "
         f"count(*) FILTER (status = 'error') AS errors FROM ({plain(RUN)})")(lambda spark, folder: reports.import_outcome(run(spark, folder)))
register("import_failures",
         f"SELECT display_path, status, coalesce(error_message, '') AS reason FROM ({plain(RUN)}) WHERE status = 'error'")(
    lambda spark, folder: reports.import_failures(run(spark, folder)))
register("document_details",
         f"SELECT sha256(concat(source_path, '||', file_hash, '||', coalesce(process_name, ''), '||', ordinal)) AS detail_id, "
         f"concat(status, ': ', source_path) AS title, * FROM ({plain(RUN)})")(
    lambda spark, folder: reports.document_details(run(spark, folder)))
register("changed_documents",
         f"SELECT * FROM ({plain(RUN)}) WHERE (source_path, file_hash) NOT IN (SELECT concat('doc-', user_id), props FROM events WHERE event_type = 'click')")(
    lambda spark, folder: docs.changed_documents(run(spark, folder), run(spark, folder).filter("process_write_action = 'inserted'")))

WORDS = "SELECT doc_id, source, string_split(text, ' ') AS words FROM documents"


def word_lists(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "source", F.split("text", " ").alias("words"))


def _status_rows(spark, folder):
    rows = word_lists(spark, folder).select(
        F.col("doc_id").alias("source_path"), F.lit("processed").alias("status"), F.col("source").alias("process_name"),
        F.lit(None).cast("string").alias("process_id"), F.col("words").alias("applications"), F.lit(None).cast("string").alias("error_message"))
    matches = word_mentions(spark, folder).withColumn(
        "cmdb_id", F.when(F.lower("application_name") != F.col("application_name"), F.col("application_name")))
    return reports.document_status_rows(rows, matches).withColumn("applications", F.col("applications").cast("long"))


register("document_status_rows",
         f"SELECT doc_id AS source_path, 'processed' AS status, source AS process_name, '' AS process_id, CAST(len(words) AS BIGINT) AS applications, "
         f"CAST(len(list_filter(words, lambda w: lower(w) <> w)) AS BIGINT) AS matched, CAST(len(list_filter(words, lambda w: lower(w) = w)) AS BIGINT) AS unmatched, "
         f"0::BIGINT AS review_items, '' AS error_message FROM ({WORDS})")(_status_rows)


def word_mentions(spark, folder):
    return word_lists(spark, folder).select(
        F.col("doc_id").alias("source_path"), F.col("source").alias("process"), F.lit("").alias("process_id"),
        F.posexplode("words").alias("position", "application_name"))


_SPELLED = (f"SELECT DISTINCT process, {sql_match_key('variant')} AS normalized, variant FROM (SELECT DISTINCT source AS process, "
            f"unnest(words) AS variant FROM ({WORDS}))").replace(
    "regexp_replace(variant, '\\([^)]*\\)'",
    "regexp_replace(regexp_replace(variant, '\\b(?:[a-z][A-Za-z0-9_]*\\.)+([A-Za-z][A-Za-z0-9_]*)\\b', '\\1', 'g'), '\\([^)]*\\)'")
register("duplicate_terms",
         f"SELECT process, normalized, variant FROM ({_SPELLED}) WHERE normalized <> '' QUALIFY count(*) OVER (PARTITION BY process, normalized) > 1")(
    lambda spark, folder: reports.duplicate_terms(word_mentions(spark, folder)))
register("mentions",
         f"SELECT doc_id AS source_path, source AS process, '' AS process_id, unnest(words) AS application_name, "
         f"CAST(generate_subscripts(words, 1) - 1 AS INT) AS position FROM ({WORDS})")(
    lambda spark, folder: matching.mentions_of(word_lists(spark, folder).select(
        F.col("doc_id").alias("source_path"), F.col("source").alias("process_name"), F.lit("").alias("process_id"),
        F.transform("words", lambda word: F.struct(word.alias("name"))).alias("applications"))))


def _dedup(spark, folder):
    raw = F.transform("words", lambda word: F.struct(word.alias("name"), F.when(word.endswith("."), "stark").otherwise("schwach").alias("confidence")))
    rows = docs.dedup_applications(word_lists(spark, folder).select("doc_id", raw.alias("raw_applications")))
    # Outer, because a plain explode is preceded by a filter that computes the whole list a first time.
    return rows.select("doc_id", F.posexplode_outer("applications").alias("pos", "a")).filter("pos IS NOT NULL").select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "a.name", "a.confidence")


_CLEAN = (f"SELECT doc_id, i, name, confidence, {sql_tokens(sql_camel('name'), ('interface', 'system', 'service', 'application', 'participant', 'processref', 'participantref'))} AS k "
          f"FROM (SELECT doc_id, i, {sql_clean_app('w')} AS name, CASE WHEN ends_with(w, '.') THEN 'stark' ELSE 'schwach' END AS confidence "
          f"FROM (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM ({WORDS})))")
register("deduplicated_applications",
         f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1 AS pos, name, confidence FROM (SELECT *, min(i) OVER (PARTITION BY doc_id, k) AS first, "
         f"row_number() OVER (PARTITION BY doc_id, k ORDER BY confidence = 'stark' DESC, contains(name, ' ') DESC, contains(name, '.'), length(name), i) AS place "
         f"FROM ({_CLEAN}) WHERE k <> '' AND NOT ends_with(lower(name), 'operation')) WHERE place = 1")(_dedup)

# Matches ---------------------------------------------------------------------------------------------

MATCHES = (
    "SELECT CAST(l_orderkey AS STRING) AS source_path, l_linestatus AS process, CAST(l_partkey AS STRING) AS process_id, "
    "concat('term ', l_suppkey) AS application_name, l_linenumber AS position, CASE WHEN l_tax < 0.07 THEN CAST(l_suppkey AS STRING) END AS cmdb_id, "
    "concat('name ', l_partkey) AS matched_name, CASE WHEN l_discount > 0.05 THEN 'stark' ELSE 'schwach' END AS confidence, "
    "CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'knowledge_base' ELSE 'fuzzy' END AS source, l_discount AS score, "
    "CAST(round(l_extendedprice) AS BIGINT) AS ordinal FROM {lineitem}")
_M = f"({plain(MATCHES)})"


def matches(spark, folder):
    return query(spark, folder, MATCHES)


register("best_candidates",
         f"SELECT * FROM {_M} QUALIFY row_number() OVER (PARTITION BY source_path, process, process_id, application_name, position "
         f"ORDER BY score DESC, ordinal) = 1")(lambda spark, folder: matching.best_candidate(matches(spark, folder)))
register("ranked_candidates",
         f"SELECT *, CAST(row_number() OVER (PARTITION BY source_path, process, process_id, application_name, position ORDER BY score DESC, ordinal) AS INT) "
         f"AS rank FROM {_M}")(lambda spark, folder: matching.rank_candidates(matches(spark, folder)))
_OPEN = (f"SELECT * FROM {_M} m WHERE source <> 'rejected' AND (confidence = 'schwach' OR cmdb_id IS NULL) AND NOT EXISTS (SELECT 1 FROM {_M} s "
         f"WHERE s.source_path = m.source_path AND s.process = m.process AND s.process_id = m.process_id AND s.application_name = m.application_name "
         f"AND s.confidence <> 'schwach' AND s.cmdb_id IS NOT NULL AND s.source <> 'rejected')")
register("review_items", _OPEN)(lambda spark, folder: matching.review_items(matches(spark, folder)))
register("review_rows",
         f"SELECT sha256(concat(source_path, '||', '', '||', position, '||', application_name, '||', matched_name, '||', coalesce(cmdb_id, ''))) AS row_id, "
         f"source_path, process, process_id, application_name AS anwendung_im_prozess, matched_name AS anwendung_in_cmdb, confidence, source AS quelle, cmdb_id "
         f"FROM ({_OPEN})")(
    lambda spark, folder: reports.review_sort(reports.review_rows(matches(spark, folder), matching.review_items(matches(spark, folder)))))
register("review_summary",
         f"SELECT count(*) FILTER (cmdb_id IS NOT NULL AND (confidence = 'stark' OR source = 'knowledge_base')) AS exact_application_matches, "
         f"count(*) FILTER (NOT coalesce(cmdb_id IS NOT NULL AND (confidence = 'stark' OR source = 'knowledge_base'), false) AND "
         f"(confidence = 'schwach' OR cmdb_id IS NULL)) AS review_application_matches FROM {_M} WHERE source <> 'rejected'")(
    lambda spark, folder: reports.review_summary(matches(spark, folder)))
register("batch_confirmable",
         f"SELECT count(*) AS selected, count(DISTINCT replace(lower(application_name), ' ', '')) AS terms, count(DISTINCT cmdb_id) AS targets, "
         f"count(*) FILTER (cmdb_id IS NULL) AS open, 'invalid' AS state FROM {_M}")(
    lambda spark, folder: quality.batch_confirmable(matches(spark, folder), "application_name"))

# Decisions -------------------------------------------------------------------------------------------

LOG = (
    "SELECT concat('d-', user_id) AS decision_id, CASE WHEN user_id < 20 THEN 'decision_revert' ELSE 'manual_link' END AS decision_type, "
    "CASE WHEN event_type = 'error' THEN 'reverted' ELSE 'active' END AS status, CAST(ts AS STRING) AS created_at, props AS payload_json, "
    "CAST(NULL AS STRING) AS supersedes_decision_id, CASE WHEN event_type = 'error' THEN CAST(ts AS STRING) END AS reverted_at, "
    "event_type AS notes FROM {events}")
_CURRENT = (f"(SELECT * FROM ({plain(LOG)}) QUALIFY row_number() OVER (PARTITION BY decision_id ORDER BY created_at DESC) = 1)")


def log_graph(spark, folder):
    return graph(spark, folder).with_(decisions=query(spark, folder, LOG))


register("current_decisions", f"SELECT * FROM {_CURRENT}")(
    lambda spark, folder: decisions.current_decisions(log_graph(spark, folder)))
register("recent_decisions", f"SELECT * FROM {_CURRENT} ORDER BY created_at DESC, decision_id LIMIT 20")(
    lambda spark, folder: decisions.recent_decisions(log_graph(spark, folder)))
register("revertable_decisions", f"SELECT * FROM {_CURRENT} WHERE status = 'active' AND decision_type <> 'decision_revert'")(
    lambda spark, folder: quality.revertable(decisions.current_decisions(log_graph(spark, folder))))
register("decision_issues",
         f"SELECT * FROM {_M} WHERE cmdb_id IS NULL")(
    lambda spark, folder: quality.decision_issues(matches(spark, folder).withColumns({
        "anwendung_name": F.col("application_name"), "quelle": F.col("source")}), confirmed=True).drop("anwendung_name", "quelle"))

# Extraction answers ----------------------------------------------------------------------------------

def _answers(spark, folder):
    quoted = lambda column: F.concat(F.lit('"'), F.col(column).cast("string"), F.lit('"'))
    return table(spark, folder, "events").select("event_id", F.concat(
        F.lit('Here it is: {"process": '), quoted("event_type"), F.lit(', "process_id": '), quoted("user_id"),
        F.lit(', "roles": ["r"], "process_owner": null, '), F.when(F.col("value") > 5, '"org_unit_candidates": [], ').otherwise(""),
        F.lit('"applications": [{"name": '), quoted("event_id"), F.lit(', "confidence": "stark"}], "props": '), "props",
        F.lit("} and {more}")).alias("answer"))


register("extractions",
         "SELECT event_id, event_type AS process, CAST(user_id AS VARCHAR) AS process_id, CAST(event_id AS VARCHAR) AS application FROM events WHERE value > 5")(
    lambda spark, folder: docs.read_extractions(_answers(spark, folder), "answer")[0].select(
        "event_id", "payload.process", "payload.process_id", F.col("payload.applications")[0]["name"].alias("application")))
register("rejected_extractions",
         "SELECT event_id, 'missing: org_unit_candidates' AS reason FROM events WHERE value <= 5")(
    lambda spark, folder: docs.read_extractions(_answers(spark, folder), "answer")[1].select("event_id", "reason"))
register("event_payloads", "SELECT event_id, 'missing: process' AS reason FROM events")(
    lambda spark, folder: docs.read_extractions(table(spark, folder, "events"), "props", ("process",))[1].select("event_id", "reason"))
register("conversation_answers",
         "SELECT conv_id, turn, CASE WHEN contains(text, '{') THEN 'invalid_json' ELSE 'no_object' END AS reason FROM conversations")(
    lambda spark, folder: docs.read_extractions(table(spark, folder, "conversations"), "text")[1].select("conv_id", "turn", "reason"))

STATUS_VALUES = (model.STATUS_PROCESSED, model.STATUS_NO_MATCHES, model.STATUS_ERROR)
