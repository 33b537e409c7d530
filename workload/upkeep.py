"""Maintenance of the graph: upserts, documents, decisions, merges, exchange files, process models."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from estatemap.operators import aliases, decisions, exchange, merging, modelgen, upserts
from estatemap.sources import bpmn
from estatemap.session import cut_lineage
from estatemap.sources import exchange as exchange_source
from workload.registry import graph_query, register
from workload.star import graph, graph_sql, plain, query, table

_COLUMNS = ["label", "node_id", "name", "process_id", "cmdb_id", "id", "server_type"]

# Master data -----------------------------------------------------------------------------------------

# Suppliers again under a new name, and customers as applications, interfaces, servers and processes that are new.
EXPORT = (
    "SELECT CAST(s_suppkey AS STRING) AS entity_id, upper(s_name) AS name, 'application' AS entity_type, CAST(NULL AS STRING) AS server_type, "
    "s_suppkey AS line_number FROM {supplier} UNION ALL "
    "SELECT concat('C', c_custkey), c_name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'server' WHEN c_mktsegment = 'MACHINERY' THEN 'interface' "
    "WHEN c_mktsegment = 'FURNITURE' THEN 'process' ELSE 'application' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'virtual' END, c_custkey FROM {customer}")
_NEW = (f"SELECT CASE entity_type WHEN 'server' THEN 'Server' WHEN 'interface' THEN 'Interface' WHEN 'process' THEN 'Process' ELSE 'Application' END AS label, "
        f"* FROM ({plain(EXPORT)})")
register("entity_upsert",
         f"{graph_sql()} SELECT n.label, n.node_id, CASE WHEN n.label = 'Application' THEN upper(n.name) ELSE n.name END AS name, n.process_id, n.cmdb_id, n.id, n.server_type FROM nodes n "
         f"UNION ALL SELECT label, concat(label, ':', entity_id), name, CASE WHEN label = 'Process' THEN entity_id END, CASE WHEN label = 'Application' THEN entity_id END, "
         f"CASE WHEN label <> 'Process' THEN entity_id END, server_type FROM ({_NEW}) WHERE entity_id LIKE 'C%'")(
    lambda spark, folder: upserts.upsert_entities(graph(spark, folder), query(spark, folder, EXPORT)).nodes.select(*_COLUMNS))


def _sync(spark, folder):
    g = graph(spark, folder)
    relations = query(spark, folder, "SELECT CAST(s_suppkey AS STRING) AS source_id, 'RUNS_ON' AS relation_type, CAST(s_nationkey + 5 AS STRING) AS target_id FROM {supplier}")
    owners = query(spark, folder, "SELECT CAST(s_suppkey AS STRING) AS entity_id, CASE WHEN s_acctbal > 5000 THEN 'asia' ELSE 'New Unit' END AS org_unit_name FROM {supplier}")
    return upserts.sync_master_data(g, query(spark, folder, EXPORT), relations, owners)


register("master_data_sync",
         f"{graph_sql()} SELECT rel_type, src_id, dst_id FROM edges WHERE src_label || rel_type NOT IN ('ApplicationRUNS_ON', 'ApplicationUSES_INTERFACE') "
         "AND NOT (rel_type = 'RESPONSIBLE_FOR' AND dst_label = 'Application') UNION ALL SELECT 'RUNS_ON', concat('Application:', s_suppkey), concat('Server:', s_nationkey + 5) "
         "FROM supplier WHERE s_nationkey + 5 IN (SELECT n_nationkey FROM nation) UNION ALL SELECT 'RESPONSIBLE_FOR', "
         "CASE WHEN s_acctbal > 5000 THEN 'OrgUnit:ASIA' ELSE 'OrgUnit:New Unit' END, concat('Application:', s_suppkey) FROM supplier")(
    lambda spark, folder: _sync(spark, folder).edges.select("rel_type", "src_id", "dst_id"))

# Processes and documents -------------------------------------------------------------------------------

INCOMING = ("SELECT CAST(l_partkey AS STRING) AS process_id, concat('renamed ', l_partkey) AS process_name, l_orderkey AS ordinal FROM {lineitem} UNION ALL "
            "SELECT concat('N', o_custkey), o_orderpriority, o_orderkey FROM {orders}")
_LAST = f"(SELECT process_id, max_by(process_name, ordinal) AS process_name FROM ({plain(INCOMING)}) GROUP BY 1)"
register("process_upsert",
         f"{graph_sql()} SELECT n.node_id, n.process_id, coalesce(i.process_name, n.name) AS name FROM nodes n LEFT JOIN {_LAST} i USING (process_id) WHERE n.label = 'Process' "
         f"UNION ALL SELECT concat('Process:', process_id), process_id, process_name FROM {_LAST} WHERE process_id LIKE 'N%'")(
    lambda spark, folder: upserts.upsert_processes(graph(spark, folder), query(spark, folder, INCOMING))[0].label("Process").select(
        "node_id", "process_id", "name"))
register("process_actions",
         f"SELECT process_id, CASE WHEN process_id LIKE 'N%' THEN 'inserted' ELSE 'updated' END AS action FROM {_LAST}")(
    lambda spark, folder: upserts.upsert_processes(graph(spark, folder), query(spark, folder, INCOMING))[1].select("process_id", "action"))

DOCUMENTS = ("SELECT CAST(p_partkey AS STRING) AS process_id, p_name AS process_name, concat('doc ', p_partkey) AS source_path, p_partkey AS ordinal, "
             "array(p_type, p_brand) AS roles, array(concat('after ', p_type)) AS follows_after FROM {part} UNION ALL "
             # An earlier document of the same process: its roles, predecessors and applications stay as nodes.
             "SELECT CAST(p_partkey AS STRING), concat('early ', p_name), concat('old ', p_partkey), -1 - p_partkey, "
             "array(concat('early ', p_brand)), array(concat('before ', p_type)) FROM {part}")
# The keys are made distinct before the texts are made from them, so that the shuffle holds numbers.
WRITTEN = ("SELECT CAST(l_partkey AS STRING) AS process_id, concat('doc ', l_partkey) AS source_path, CAST(l_suppkey AS STRING) AS cmdb_id, "
           "concat('raw ', l_suppkey) AS application_name, concat('App ', l_suppkey) AS matched_name, CASE WHEN strong THEN 'stark' ELSE 'schwach' END AS confidence, "
           "'fuzzy' AS source, CAST(0.9 AS DOUBLE) AS score, l_suppkey AS position, CAST(0 AS BIGINT) AS ordinal FROM "
           "(SELECT DISTINCT l_partkey, l_suppkey, coalesce(l_returnflag = 'A', false) AS strong FROM {lineitem}) AS pairs UNION ALL "
           "SELECT CAST(p_partkey AS STRING), concat('old ', p_partkey), concat('E', p_size), concat('raw ', p_size), concat('Early ', p_size), 'stark', 'fuzzy', "
           "CAST(0.9 AS DOUBLE), CAST(p_size AS BIGINT), CAST(0 AS BIGINT) FROM {part}")


def _written(spark, folder):
    return upserts.write_documents(graph(spark, folder), query(spark, folder, DOCUMENTS), query(spark, folder, WRITTEN))[0]


_PAIR = "SELECT DISTINCT concat('Application:', l_suppkey) AS src_id, concat('Process:', l_partkey) AS dst_id FROM lineitem WHERE l_returnflag"
register("document_edges",
         f"{graph_sql()} SELECT rel_type, src_id, dst_id, NULL AS confidence, NULL::DOUBLE AS score FROM edges WHERE rel_type NOT IN ('SERVES', 'MAY_SERVE', 'PARTICIPATES_IN') "
         f"UNION ALL SELECT 'SERVES', src_id, dst_id, 'stark', NULL FROM ({_PAIR} = 'A') UNION ALL SELECT 'MAY_SERVE', src_id, dst_id, NULL, 0.9 FROM ({_PAIR} <> 'A') "
         "UNION ALL SELECT 'PARTICIPATES_IN', concat('Role:', r), concat('Process:', p_partkey), NULL, NULL FROM (SELECT DISTINCT p_partkey, unnest([p_type, p_brand]) AS r FROM part) "
         "UNION ALL SELECT 'FOLLOWS', concat('Process:', p_partkey), concat('Process:', sha256(concat('Process||placeholder||after ', p_type))), NULL, NULL FROM part "
         "UNION ALL SELECT 'FOLLOWS', concat('Process:', p_partkey), concat('Process:', sha256(concat('Process||placeholder||before ', p_type))), NULL, NULL FROM part")(
    lambda spark, folder: _written(spark, folder).edges.select(
        "rel_type", "src_id", "dst_id", F.when(F.col("rel_type") == "SERVES", F.col("confidence")).alias("confidence"),
        F.when(F.col("rel_type") == "MAY_SERVE", F.col("score")).alias("score")))
register("document_nodes_after_cleanup",
         f"{graph_sql()} SELECT label, node_id, CASE WHEN label = 'Application' AND node_id IN (SELECT src_id FROM ({_PAIR} = 'A')) THEN replace(node_id, 'Application:', 'App ') "
         "ELSE name END AS name FROM nodes UNION ALL SELECT DISTINCT 'Role', concat('Role:', r), r FROM (SELECT unnest([p_type, p_brand, concat('early ', p_brand)]) AS r FROM part) "
         "UNION ALL SELECT DISTINCT 'Application', concat('Application:E', p_size), concat('Early ', p_size) FROM part")(
    lambda spark, folder: upserts.cleanup_placeholders(_written(spark, folder)).nodes.select("label", "node_id", "name"))

# Owners, roles, units ----------------------------------------------------------------------------------

register("owner_replacement",
         f"{graph_sql()} SELECT src_id, dst_id FROM edges WHERE rel_type = 'RESPONSIBLE_FOR' AND dst_label <> 'Process' UNION ALL "
         "SELECT concat('OrgUnit:', p_brand), concat('Process:', p_partkey) FROM part")(
    lambda spark, folder: upserts.set_process_owners(graph(spark, folder), table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("process_id"), F.concat(F.lit(" "), "p_brand").alias("org_unit_name"))).relation(
        "RESPONSIBLE_FOR").select("src_id", "dst_id"))
register("owner_removal",
         f"{graph_sql()} SELECT src_id, dst_id FROM edges WHERE rel_type = 'RESPONSIBLE_FOR' AND dst_label <> 'Process'")(
    lambda spark, folder: upserts.clear_process_owners(graph(spark, folder), table(spark, folder, "part").select(
        F.col("p_partkey").cast("string").alias("process_id"))).relation("RESPONSIBLE_FOR").select("src_id", "dst_id"))
register("role_assignment",
         f"{graph_sql()} SELECT src_id, dst_id FROM edges WHERE rel_type = 'CAN_ASSUME' UNION SELECT concat('OrgUnit:', r_name), concat('Role:', p_type) FROM region, "
         "(SELECT DISTINCT p_type, p_size FROM part) WHERE p_size = r_regionkey")(
    lambda spark, folder: upserts.assign_roles(graph(spark, folder), query(
        spark, folder, "SELECT lower(r_name) AS org_unit_name, p_type AS role_name FROM {region} JOIN {part} ON p_size = r_regionkey")).relation(
        "CAN_ASSUME").select("src_id", "dst_id"))
graph_query("role_only_marks", "SELECT name, node_id, true AS role_only FROM nodes WHERE label = 'Role'")(
    lambda g: upserts.mark_role_only(g, g.label("Role").select(F.col("name").alias("role_name"))).label("Role").select("name", "node_id", "role_only"))
register("registered_units",
         "SELECT r_name AS name FROM region UNION SELECT n_name FROM nation")(
    lambda spark, folder: upserts.register_org_units(graph(spark, folder), query(
        spark, folder, "SELECT concat(' ', n_name, '  ') AS name FROM {nation} UNION ALL SELECT lower(r_name) FROM {region}")).label("OrgUnit").select("name"))

# Decisions ---------------------------------------------------------------------------------------------

REVIEW = ("SELECT DISTINCT CAST(l_partkey AS STRING) AS process_id, p_name AS process, concat('raw ', l_suppkey) AS anwendung_im_prozess, '-' AS anwendung_in_cmdb, "
          "CAST(l_suppkey AS STRING) AS cmdb_id, concat('doc ', l_partkey) AS source_path FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WHERE l_returnflag = 'R'")
_R = f"({plain(REVIEW)})"
_RP = f"(SELECT concat('Application:', cmdb_id) AS src_id, concat('Process:', process_id) AS dst_id, anwendung_im_prozess AS raw_name FROM {_R})"
NOW = "2024-05-01T00:00:00Z"


def review(spark, folder):
    return query(spark, folder, REVIEW)


register("confirmed_edges",
         f"{graph_sql()} SELECT src_id, dst_id, source, raw_name FROM edges WHERE rel_type = 'SERVES' AND (src_id, dst_id) NOT IN (SELECT src_id, dst_id FROM {_RP}) "
         f"UNION ALL SELECT src_id, dst_id, 'manuell_bestaetigt', raw_name FROM {_RP}")(
    lambda spark, folder: decisions.confirm_links(graph(spark, folder), review(spark, folder), NOW).relation("SERVES").select(
        "src_id", "dst_id", "source", "raw_name"))
register("rejected_terms",
         f"SELECT process_id, process AS prozess_name, anwendung_im_prozess AS anwendung_name FROM {_R}")(
    lambda spark, folder: decisions.reject_links(graph(spark, folder), review(spark, folder)).rejections)
register("manual_edges_and_log",
         f"SELECT 'manual_link' AS decision_type, 'active' AS status, process_id, cmdb_id, anwendung_im_prozess AS application_name FROM {_R}")(
    lambda spark, folder: decisions.current_decisions(decisions.manual_links(graph(spark, folder), review(spark, folder), NOW)).select(
        "decision_type", "status", *[F.get_json_object("payload_json", f"$.{name}").alias(name) for name in ("process_id", "cmdb_id", "application_name")]))


def _reverted(spark, folder):
    g = decisions.manual_links(graph(spark, folder), review(spark, folder), NOW)
    logged = decisions.current_decisions(g).select("decision_id")
    return decisions.revert_decisions(g, logged, "2024-06-01T00:00:00Z")


register("reverted_edges",
         f"{graph_sql()} SELECT src_id, dst_id, source, raw_name FROM edges WHERE rel_type = 'SERVES' AND (src_id, dst_id) NOT IN (SELECT src_id, dst_id FROM {_RP})")(
    lambda spark, folder: _reverted(spark, folder)[0].relation("SERVES").select("src_id", "dst_id", "source", "raw_name"))
register("revert_log",
         f"SELECT decision_type, 'reverted' AS status, count(*) AS decisions FROM (SELECT unnest(['manual_link', 'decision_revert']) AS decision_type, * FROM {_R}) GROUP BY 1")(
    lambda spark, folder: decisions.current_decisions(_reverted(spark, folder)[0]).groupBy("decision_type", "status").agg(F.count(F.lit(1)).alias("decisions")))
register("confirmed_links",
         f"{graph_sql()} SELECT p.name AS process, p.process_id, x.raw_name AS anwendung_name, a.cmdb_id, a.name AS resolved_to, x.source AS quelle FROM edges x "
         "JOIN nodes a ON a.node_id = x.src_id JOIN nodes p ON p.node_id = x.dst_id WHERE x.rel_type = 'SERVES' AND x.source = 'manuell_bestaetigt'")(
    lambda spark, folder: _links(graph(spark, folder)))


def _links(g):
    from estatemap.operators.matching import confirmed_links

    return confirmed_links(g)


register("bound_rejections",
         "SELECT CASE WHEN n = 1 THEN i END AS process_id, c_name AS prozess_name, 'term' AS anwendung_name, coalesce(n, 0) AS candidates FROM customer LEFT JOIN "
         "(SELECT c_name AS k, count(DISTINCT c_custkey) AS n, min(CAST(c_custkey AS VARCHAR)) AS i FROM customer WHERE c_acctbal > 5000 GROUP BY 1) ON k = c_name")(
    lambda spark, folder: _bound(table(spark, folder, "customer")))


def _bound(customer):
    from estatemap.operators.matching import bind_rejections

    return bind_rejections(
        customer.select(F.lit(None).cast("string").alias("process_id"), F.col("c_name").alias("prozess_name"), F.lit("term").alias("anwendung_name")),
        customer.filter("c_acctbal > 5000").select(F.col("c_custkey").cast("string").alias("process_id"), F.col("c_name").alias("name")))


# Aliases -----------------------------------------------------------------------------------------------

register("derived_aliases",
         f"{graph_sql()} SELECT DISTINCT x.raw_name AS normalized_name, 'Application' AS target_label, x.src_id AS target_id, 'knowledge_base' AS source_kind FROM edges x "
         "WHERE x.rel_type = 'SERVES' AND x.source = 'manuell_bestaetigt' UNION ALL SELECT normalized_name, target_label, target_id, source_kind FROM alias_edges")(
    lambda spark, folder: aliases.sync_aliases(graph(spark, folder), _links(graph(spark, folder)), "2024-05-01").alias_edges)
register("deleted_aliases",
         "SELECT lower(p_name) AS normalized_name, concat('Process:', p_partkey) AS target_id FROM part WHERE p_size > 10")(
    lambda spark, folder: aliases.delete_aliases(graph(spark, folder), table(spark, folder, "part").filter("p_size <= 10").select(
        F.upper("p_name").alias("alias_name"), F.lit("Process").alias("target_label"), F.concat(F.lit("Process:"), "p_partkey").alias("target_id"),
        F.lit("merged_entity").alias("source_kind"))).alias_edges.select("normalized_name", "target_id"))

# Merging -----------------------------------------------------------------------------------------------

# Every process name keeps its process of the lowest number; the others are merged into it.
PAIRS = ("SELECT concat('Process:', p_partkey) AS source_id, concat('Process:', first) AS target_id FROM "
         "(SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_name) AS first FROM {part}) AS grouped WHERE p_partkey <> first")
_MAP = f"(SELECT node_id, coalesce(target_id, node_id) AS to_id FROM nodes LEFT JOIN ({plain(PAIRS)}) ON source_id = node_id)"


def pairs(spark, folder):
    return query(spark, folder, PAIRS)


register("merged_edges",
         f"{graph_sql()} SELECT DISTINCT x.rel_type, a.to_id AS src_id, b.to_id AS dst_id FROM edges x JOIN {_MAP} a ON a.node_id = x.src_id JOIN {_MAP} b ON b.node_id = x.dst_id")(
    lambda spark, folder: merging.merge_entities(graph(spark, folder), "Process", pairs(spark, folder), "2024-05-01")[0].edges.select(
        "rel_type", "src_id", "dst_id"))
register("merged_nodes",
         f"{graph_sql()} SELECT node_id, label, name FROM nodes WHERE node_id NOT IN (SELECT source_id FROM ({plain(PAIRS)}))")(
    lambda spark, folder: merging.merge_entities(graph(spark, folder), "Process", pairs(spark, folder), "2024-05-01")[0].nodes.select(
        "node_id", "label", "name"))


def _undone(spark, folder):
    merged, record = merging.merge_entities(graph(spark, folder), "Process", pairs(spark, folder), "2024-05-01")
    return merging.undo_merge(merged, record)


register("undone_merge", f"{graph_sql()} SELECT rel_type, src_id, dst_id, source, score FROM edges")(
    lambda spark, folder: _undone(spark, folder).edges.select("rel_type", "src_id", "dst_id", "source", "score"))


def _logged(spark, folder):
    return decisions.merge_logged(graph(spark, folder), "Process", pairs(spark, folder), NOW)


def _taken_back(spark, folder):
    """The merge taken back by a later session, which finds the tables written."""
    logged = _logged(spark, folder)
    logged = logged.with_(**{name: cut_lineage(table) for name, table in logged.tables().items()})
    merges = logged.decisions.filter("decision_type = 'entity_merge'").select("decision_id")
    return decisions.revert_decisions(logged, merges, "2024-05-02T00:00:00Z")[0]


register("merge_log",
         f"WITH w AS ({plain(PAIRS)}) SELECT 'entity_merge' AS decision_type, 'active' AS status, CAST(count(*) AS VARCHAR) AS merged_count, 'Process' AS entity_type, "
         "(SELECT min(p_name) FROM part JOIN w ON source_id = 'Process:' || p_partkey) AS source_name FROM w")(
    lambda spark, folder: decisions.current_decisions(_logged(spark, folder)).select(
        "decision_type", "status", *[F.get_json_object("payload_json", f"$.{name}").alias(name) for name in ("merged_count", "entity_type", "source_name")]))
register("reverted_merge", f"{graph_sql()} SELECT rel_type, src_id, dst_id, source, score FROM edges")(
    lambda spark, folder: _taken_back(spark, folder).edges.select("rel_type", "src_id", "dst_id", "source", "score"))
register("reverted_merge_log",
         "SELECT unnest(['entity_merge', 'decision_revert']) AS decision_type, 'reverted' AS status")(
    lambda spark, folder: decisions.current_decisions(_taken_back(spark, folder)).select("decision_type", "status"))
register("merge_summary",
         f"{graph_sql()}, w AS ({plain(PAIRS)}), k AS (SELECT src_id AS at_id, 'o' || rel_type || dst_id AS k, 'o' AS d FROM edges UNION ALL SELECT dst_id, 'i' || rel_type || src_id, 'i' FROM edges) "
         "SELECT w.source_id, w.target_id, count(*) FILTER (k.d = 'o') AS outgoing, count(*) FILTER (k.d = 'i') AS incoming, "
         "count(*) FILTER (EXISTS (SELECT 1 FROM k t WHERE t.at_id = w.target_id AND t.k = k.k)) AS duplicates, 1::BIGINT AS aliases "
         "FROM w LEFT JOIN k ON k.at_id = w.source_id GROUP BY 1, 2")(
    lambda spark, folder: merging.merge_summary(_by_node(graph(spark, folder)), pairs(spark, folder)))


def _by_node(g):
    """References by node id, so that nodes of one name count as different neighbours."""
    return g.with_(nodes=g.nodes.withColumns({name: F.col("node_id") for name in ("process_id", "cmdb_id", "id", "name")}))


register("merge_conflicts",
         f"SELECT source_id, target_id, 'process_id' AS property, replace(source_id, 'Process:', '') AS source_value, replace(target_id, 'Process:', '') AS target_value FROM ({plain(PAIRS)})")(
    lambda spark, folder: merging.merge_conflicts(graph(spark, folder), pairs(spark, folder)))

# Exchange files ----------------------------------------------------------------------------------------

ELEMENTS = (
    "SELECT concat('e', p_partkey) AS archimate_id, CASE WHEN p_size > 25 THEN 'BusinessProcess' WHEN p_size > 20 THEN 'Grouping' WHEN p_size > 15 THEN 'Thing' "
    "ELSE 'ApplicationComponent' END AS archimate_type, concat('element ', p_partkey) AS name, 'model.xml' AS archimate_source, p_partkey AS ordinal FROM {part}")
LINKS = (
    "SELECT concat('r', l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) AS archimate_id, CASE l_returnflag WHEN 'A' THEN 'Serving' WHEN 'R' THEN 'Association' ELSE 'Access' END "
    "AS archimate_rel_type, concat('e', l_suppkey) AS source_archimate_id, concat('e', l_partkey) AS target_archimate_id, 'model.xml' AS archimate_source, l_orderkey AS ordinal FROM {lineitem}")
_KIND = "CASE WHEN p_size > 25 THEN 'Process' WHEN p_size > 15 THEN NULL ELSE 'Application' END"


def _mapping(spark):
    """The default with one element type that is left out without a report."""
    return replace(exchange_source.default_mapping(spark), ignored=spark.createDataFrame([("Grouping",)], "element_type string"))


def _judged(spark, folder):
    mapping = _mapping(spark)
    labelled, _ = exchange.classify_elements(query(spark, folder, ELEMENTS), mapping)
    resolved = labelled.withColumns({
        "outcome": F.lit("new"), "node_id": F.concat("label", F.lit(":"), "archimate_id"), "resolved_name": F.col("name")})
    return exchange.judge_relations(query(spark, folder, LINKS), resolved, mapping)


register("judged_relations",
         f"WITH k AS (SELECT concat('e', p_partkey) AS i, {_KIND} AS l FROM part) SELECT r.archimate_id, r.archimate_rel_type, a.l AS src_label, b.l AS dst_label, "
         "CASE WHEN a.l IS NULL OR b.l IS NULL THEN 'unresolvable_endpoint' WHEN r.archimate_rel_type = 'Association' OR (r.archimate_rel_type = 'Serving' AND a.l = 'Application' AND b.l = 'Process') "
         f"THEN 'imported' ELSE 'type_not_accepted' END AS outcome FROM ({plain(LINKS)}) r LEFT JOIN k a ON a.i = r.source_archimate_id LEFT JOIN k b ON b.i = r.target_archimate_id")(
    lambda spark, folder: _judged(spark, folder).select("archimate_id", "archimate_rel_type", "src_label", "dst_label", "outcome"))
register("skipped_element_types",
         "SELECT 'Thing' AS element_type, count(*) AS count FROM part WHERE p_size > 15 AND p_size <= 20 HAVING count(*) > 0")(
    lambda spark, folder: exchange.classify_elements(query(spark, folder, ELEMENTS), _mapping(spark))[1])


@register("exchange_import")
def exchange_import(spark, folder):
    """Nodes after importing every part as an element next to the graph; similar names wait for review."""
    outcome = exchange.import_exchange(graph(spark, folder), query(spark, folder, ELEMENTS), query(spark, folder, LINKS), _mapping(spark))
    return exchange.import_report(outcome)


_TYPES = "CASE label WHEN 'Process' THEN 'BusinessProcess' WHEN 'Application' THEN 'ApplicationComponent' WHEN 'Interface' THEN 'ApplicationInterface' WHEN 'Server' THEN 'Node' WHEN 'OrgUnit' THEN 'BusinessActor' ELSE 'BusinessRole' END"
_EXPORTED = "('Process', 'Application', 'Interface', 'Server', 'OrgUnit', 'Role')"
graph_query("exported_elements",
            f"SELECT node_id, label, name, concat('id-', substring(sha1(node_id), 1, 12)) AS identifier, {_TYPES} AS element_type FROM nodes WHERE label IN {_EXPORTED}")(
    lambda g: exchange.export_elements(g, exchange_source.default_mapping(g.nodes.sparkSession)))
graph_query("exported_relations",
            f"SELECT rel_type, src_id, dst_id, CASE rel_type WHEN 'SERVES' THEN 'Serving' WHEN 'FOLLOWS' THEN 'Triggering' WHEN 'USES_INTERFACE' THEN 'Composition' WHEN 'RUNS_ON' THEN 'Realization' "
            f"ELSE 'Assignment' END AS relation_type FROM edges WHERE rel_type IN ('SERVES', 'PARTICIPATES_IN', 'CAN_ASSUME', 'FOLLOWS', 'USES_INTERFACE', 'RUNS_ON', 'RESPONSIBLE_FOR') AND dst_label IN {_EXPORTED}")(
    lambda g: exchange.export_relations(g, exchange_source.default_mapping(g.nodes.sparkSession)).select("rel_type", "src_id", "dst_id", "relation_type"))
graph_query("element_type_overrides",
            "SELECT node_id, CASE WHEN label = 'Server' THEN 'Node' END AS archimate_type FROM nodes")(
    lambda g: exchange.set_element_types(g, g.label("Server").select("label", "name", F.lit("Node").alias("archimate_type"))).nodes.select("node_id", "archimate_type"))

# Process models ----------------------------------------------------------------------------------------


def _models(spark, folder):
    """One process model per part, half of them with namespace prefixes."""
    # Small rows that make long texts: dealt over all cores before.
    part = table(spark, folder, "part").repartition(2 * spark.sparkContext.defaultParallelism, "p_partkey")
    x = F.when(F.col("p_size") > 25, F.lit("bpmn:")).otherwise(F.lit(""))

    def tag(name, *attributes, closed=True):
        parts = [F.lit("<"), x, F.lit(name)]
        for key, value in attributes:
            parts += [F.lit(f' {key}="'), value, F.lit('"')]
        return F.concat(*parts, F.lit("/>" if closed else ">"))

    body = F.concat(
        F.lit('<?xml version="1.0"?>'), tag("definitions", ("xmlns:bpmn", F.lit("http://www.omg.org/spec/BPMN/20100524/MODEL")), closed=False),
        tag("collaboration", closed=False), tag("participant", ("name", F.concat("p_name", F.lit("Pool"))), ("processRef", F.concat(F.lit("P"), "p_partkey"))),
        tag("participant", ("name", F.lit("Participant 2")), ("processRef", F.concat(F.lit("P"), "p_partkey"))), F.lit("</"), x, F.lit("collaboration>"),
        tag("process", ("id", F.concat(F.lit("P"), "p_partkey")), ("name", F.col("p_name")), closed=False),
        tag("lane", ("name", F.col("p_type"))), tag("serviceTask", ("name", F.concat(F.lit("call "), "p_brand", F.lit(" Service")))), tag("task", ("name", F.lit("SAP"))),
        F.lit("</"), x, F.lit("process>"), tag("process", ("id", F.concat(F.lit("Q"), "p_partkey"))), F.lit("</"), x, F.lit("definitions>"))
    return part.select(F.concat(F.lit("f"), "p_partkey").alias("path"), body.alias("text"))


def _entries(spark, folder):
    entries = bpmn.process_entries(bpmn.read_processes(_models(spark, folder))[0])
    return entries.select("path", "structural_id", "process_name", F.array_join("lanes", "|").alias("lanes"), F.array_join("applications", "|").alias("applications"))


register("process_models",
         "SELECT concat('f', p_partkey) AS path, concat('P', p_partkey) AS structural_id, p_name AS process_name, p_type AS lanes, "
         "array_to_string(list_sort([regexp_replace(concat(p_name, 'Pool'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), concat('call ', p_brand, ' Service')]), '|') AS applications FROM part UNION ALL "
         "SELECT concat('f', p_partkey), concat('Q', p_partkey), concat('Q', p_partkey), '', '' FROM part")(_entries)
register("unreadable_models",
         "SELECT CAST(page_id AS VARCHAR) AS path, 'error' AS status FROM pages")(
    lambda spark, folder: bpmn.read_processes(table(spark, folder, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text")))[1].select(
        "path", "status"))

register("capabilities_by_department",
         "SELECT DISTINCT CAST(a.p_partkey AS VARCHAR) AS process_id, b.p_type AS capability FROM part a JOIN part b USING (p_brand)")(
    lambda spark, folder: modelgen.capabilities_by_department(
        table(spark, folder, "part").select(F.col("p_partkey").cast("string").alias("process_id"), F.col("p_brand").alias("department")),
        table(spark, folder, "part").select(F.col("p_brand").alias("department"), F.col("p_type").alias("capability")).distinct()))

