"""Property checks and reports that are asked beside the graph's questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatemap.operators import quality, reports, traverse
from workload.registry import graph_query, register
from workload.star import graph, query

# Nodes and edges with properties of their own, declared and not.
graph_query("node_property_conformance",
            "SELECT label, 'owner' AS key, count(*) AS node_count FROM nodes WHERE label IN ('Server', 'Process') GROUP BY 1 UNION ALL "
            "SELECT 'Process', concat('k', length(name) % 3), count(*) FROM nodes WHERE label = 'Process' GROUP BY 2")(
    lambda g: quality.property_conformance(g.nodes.withColumn("props", F.when(F.col("label") == "Server", F.create_map(F.lit("owner"), "name", F.lit("server_type"), "name")).when(
        F.col("label") == "Process", F.create_map(F.lit("owner"), "name", F.lit("process_id"), "name", F.concat(F.lit("k"), F.length("name") % 3), "name")))))
graph_query("edge_property_conformance",
            "SELECT rel_type, 'raw_name' AS key, count(*) AS edge_count FROM edges WHERE raw_name IS NOT NULL GROUP BY 1 UNION ALL "
            "SELECT rel_type, 'since', count(*) FROM edges WHERE rel_type IN ('RUNS_ON', 'MAY_SERVE') GROUP BY 1")(
    lambda g: quality.edge_property_conformance(g.edges.withColumn(
        "props", F.when(F.col("rel_type").isin("RUNS_ON", "MAY_SERVE"), F.create_map(F.lit("since"), "src_id")))))


def _sync_report(spark, folder):
    g = graph(spark, folder)
    candidates = query(spark, folder, "SELECT lower(c_name) AS normalized_name, c_name AS candidate_name, CASE WHEN c_acctbal > 0 THEN 'open' ELSE 'mapped' END AS status FROM {customer}")
    return reports.sync_report(query(spark, folder, "SELECT * FROM {part}"), query(spark, folder, "SELECT * FROM {lineitem}"), query(spark, folder, "SELECT * FROM {supplier}"),
                               g.with_(candidates=candidates), 7)


register("sync_report",
         "SELECT (SELECT count(*) FROM part) AS entity_count, (SELECT count(*) FROM lineitem) AS relation_count, (SELECT count(*) FROM supplier) AS owner_assignment_count, "
         "(SELECT count(*) FROM customer WHERE c_acctbal > 0) AS owner_candidate_count, 7::BIGINT AS refreshed_document_count")(_sync_report)
register("exact_org_units", "SELECT sum(len(string_split(p_type, ' ')))::BIGINT AS exact_org_unit_matches FROM part")(
    lambda spark, folder: reports.exact_org_units(query(spark, folder, "SELECT split(p_type, ' ') AS org_units FROM {part}")))
register("renderable_answer", "SELECT count(DISTINCT p_brand) AS objects, count(DISTINCT p_brand) BETWEEN 2 AND 25 AS renderable FROM part")(
    lambda spark, folder: traverse.is_renderable(query(spark, folder, "SELECT p_brand FROM {part}")))
register("result_within_budget", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey = r_regionkey")(
    lambda spark, folder: quality.within_budget(query(spark, folder, "SELECT r_name, n_name FROM {region} JOIN {nation} ON n_regionkey = r_regionkey")))
register("values_first_seen", "SELECT p_brand AS value, min(p_partkey) AS row FROM part GROUP BY 1")(
    lambda spark, folder: traverse.first_seen(query(spark, folder, "SELECT p_brand AS value, p_partkey AS row, 0 AS position FROM {part}")).select("value", "row"))
