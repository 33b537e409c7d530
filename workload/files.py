"""Files as rows: the given tables written as CSV and XML exports below the checkpoint folder, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatemap.operators import exchange
from estatemap.sources import exchange as exchange_source
from estatemap.sources import master_data
from workload.intake import scratch
from workload.registry import register
from workload.star import graph, graph_sql, query

# One export per entity type; the application file has a very long header and names with line breaks, quotes and separators.
LONG = "note " + "x" * 7000
APPLICATIONS = ("SELECT CAST(s_suppkey AS STRING) AS id, concat(s_name, '\\n', 'second; \"line\", ', s_suppkey) AS name, "
                "CASE WHEN s_acctbal > 0 THEN concat(' Unit ', s_nationkey, ' ') END AS owner_name, concat('S', s_nationkey, '| S', s_nationkey + 1, '|') AS runs_on, "
                "concat('I', s_suppkey % 9) AS uses_interfaces, CAST(s_acctbal AS STRING) AS `{long}` FROM {{supplier}}").format(long=LONG)
SERVERS = ("SELECT concat('S', n_nationkey) AS id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN ' Physical' ELSE 'virtual' END AS server_type, "
           "CAST(NULL AS STRING) AS owner_name FROM {nation}")
INTERFACES = "SELECT DISTINCT concat('I', p_size) AS id, concat('Interface ', p_size) AS name, 'x' AS owner_name FROM {part}"
MIXED = ("SELECT CAST(p_partkey % 100 AS STRING) AS id, concat(p_name, ', part') AS name, p_brand AS entity_type, p_type AS owner_name, CAST(NULL AS STRING) AS server_type "
         "FROM {part} ORDER BY p_partkey")
LINKED = "SELECT concat(' ', l_suppkey) AS source_id, l_returnflag AS relation_type, concat(l_partkey, ' ') AS target_id FROM {lineitem}"
INVENTORY = ("SELECT concat('P_', p_partkey) AS process_id, p_name AS process_name, p_brand AS department, p_type AS role, ' Owner' AS owner, "
             "CASE WHEN p_partkey % 2 = 0 THEN concat('text ', p_partkey, '.txt') ELSE 'absent.txt' END AS txt_file, concat(p_brand, ', ', p_type, ',') AS mentioned_applications FROM {part}")
TEXTS = ("SELECT CASE WHEN p_partkey % 2 = 0 THEN concat('in/text ', p_partkey, '.txt') ELSE concat('in/p_', p_partkey, '_', p_name, '.txt') END AS path, "
         "concat('Prozessname: ', p_name) AS text FROM {part} UNION ALL SELECT concat('in/p_', p_partkey, '_zz later.txt'), 'later' FROM {part} WHERE p_partkey % 2 = 1")


def save(rows, path: str, separator: str) -> str:
    rows.write.option("header", "true").option("sep", separator).option("quoteAll", "true").option("escape", '"').csv(path)
    return path


def exports(spark, folder) -> dict[str, str]:
    root = scratch(spark, "csv")
    return {
        "application": save(query(spark, folder, APPLICATIONS), f"{root}/application", ";"),
        "server": save(query(spark, folder, SERVERS), f"{root}/server", ","),
        "interface": save(query(spark, folder, INTERFACES), f"{root}/interface", ";"),
        "process": f"{root}/process"}


_APPLICATION_ROWS = ("SELECT 'application' AS entity_type, s_suppkey::VARCHAR AS entity_id, concat(s_name, chr(10), 'second; \"line\", ', s_suppkey) AS name, NULL::VARCHAR AS server_type, "
                     "CASE WHEN s_acctbal > 0 THEN concat('Unit ', s_nationkey) END AS owner_name FROM supplier")
_OTHER_ROWS = ("SELECT 'server' AS entity_type, concat('S', n_nationkey) AS entity_id, n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'physical' ELSE 'virtual' END AS server_type, "
               "NULL AS owner_name FROM nation UNION ALL SELECT DISTINCT 'interface', concat('I', p_size), concat('Interface ', p_size), NULL, 'x' FROM part")
register("csv_entities", f"{_APPLICATION_ROWS} UNION ALL {_OTHER_ROWS}")(
    lambda spark, folder: master_data.read_master_types(spark, exports(spark, folder))[0].select("entity_type", "entity_id", "name", "server_type", "owner_name"))
register("csv_relations",
         "SELECT s_suppkey::VARCHAR AS source_id, 'RUNS_ON' AS relation_type, concat('S', s_nationkey + i) AS target_id FROM supplier, range(0, 2) r(i) UNION ALL "
         "SELECT s_suppkey::VARCHAR, 'USES_INTERFACE', concat('I', s_suppkey % 9) FROM supplier")(
    lambda spark, folder: master_data.read_master_types(spark, exports(spark, folder))[1])
register("csv_application_rows",
         "SELECT s_suppkey::VARCHAR AS id, concat(s_name, chr(10), 'second; \"line\", ', s_suppkey) AS name, concat('S', s_nationkey, '| S', s_nationkey + 1, '|') AS runs_on, "
         "s_acctbal AS note FROM supplier")(
    lambda spark, folder: master_data.application_rows(spark, exports(spark, folder)).select("id", "name", "runs_on", F.col(f"`{LONG}`").cast("double").alias("note")))
register("csv_files",
         "SELECT * FROM (VALUES ('application', ';'), ('interface', ';'), ('server', ',')) v(kind, separator)")(
    lambda spark, folder: master_data.files_with_columns(spark, exports(spark, folder)["process"].rsplit("/", 1)[0], ["id", "name", "owner_name"]).select(
        F.regexp_extract("path", "/([a-z]+)/[^/]*$", 1).alias("kind"), "separator").distinct())
register("csv_folder_rows",
         "SELECT 'application' AS kind, s_suppkey::VARCHAR AS id, concat(s_name, chr(10), 'second; \"line\", ', s_suppkey) AS name FROM supplier UNION ALL "
         "SELECT 'server', concat('S', n_nationkey), n_name FROM nation UNION ALL SELECT DISTINCT 'interface', concat('I', p_size), concat('Interface ', p_size) FROM part")(
    lambda spark, folder: master_data.read_master_folder(spark, exports(spark, folder)["process"].rsplit("/", 1)[0]).select(
        F.regexp_extract("path", "/([a-z]+)/[^/]*$", 1).alias("kind"), "id", "name"))
register("mixed_entities",
         "SELECT (k % 100)::VARCHAR AS source_id, concat(p_name, ', part') AS name, p_brand AS entity_type, p_type AS owner_name, '' AS server_type FROM "
         "(SELECT max(p_partkey) AS k FROM part GROUP BY p_partkey % 100) JOIN part ON p_partkey = k")(
    lambda spark, folder: master_data.read_entities(spark, save(query(spark, folder, MIXED).coalesce(1), scratch(spark, "csv"), ",")).drop("line_number"))
register("mixed_relations",
         "SELECT l_suppkey::VARCHAR AS source_id, l_returnflag AS relation_type, l_partkey::VARCHAR AS target_id FROM lineitem")(
    lambda spark, folder: master_data.read_relations(spark, save(query(spark, folder, LINKED), scratch(spark, "csv"), ";")))
register("process_inventory",
         "SELECT concat('P_', p_partkey) AS process_id, p_name AS process_name, p_brand AS department, 'Owner' AS owner, concat(p_brand, '|', p_type) AS mentioned, "
         "CASE WHEN p_partkey % 2 = 0 THEN concat('text ', p_partkey, '.txt') ELSE concat('p_', p_partkey, '_', p_name, '.txt') END AS txt_file FROM part")(
    lambda spark, folder: master_data.read_inventory(spark, save(query(spark, folder, INVENTORY), scratch(spark, "csv"), ","), query(spark, folder, TEXTS)).select(
        "process_id", "process_name", "department", "owner", F.array_join("mentioned_applications", "|").alias("mentioned"), "txt_file"))


def exchange_files(spark, folder):
    """The exported graph as exchange XML, read back."""
    mapping, path = exchange_source.default_mapping(spark), scratch(spark, "xml")
    g = graph(spark, folder)
    elements = exchange.export_elements(g, mapping)
    exchange_source.write_exchange(elements, exchange.export_relations(g, mapping, elements), path, "gzip")
    return exchange_source.read_exchange(spark, f"{path}/*")


_LABELS = "('Process', 'Application', 'Interface', 'Server', 'OrgUnit', 'Role')"
register("exchange_file_elements",
         f"{graph_sql('nodes')} SELECT concat('id-', substring(sha1(node_id), 1, 12)) AS archimate_id, CASE label WHEN 'Process' THEN 'BusinessProcess' WHEN 'Application' THEN 'ApplicationComponent' "
         f"WHEN 'Interface' THEN 'ApplicationInterface' WHEN 'Server' THEN 'Node' WHEN 'OrgUnit' THEN 'BusinessActor' ELSE 'BusinessRole' END AS archimate_type, name FROM nodes WHERE label IN {_LABELS}")(
    lambda spark, folder: exchange_files(spark, folder)[0].select("archimate_id", "archimate_type", "name"))
register("exchange_file_relations",
         f"{graph_sql('edges')} SELECT concat('id-', substring(sha1(concat(src_id, '|', rel_type, '|', dst_id)), 1, 12)) AS archimate_id, CASE rel_type WHEN 'SERVES' THEN 'Serving' "
         "WHEN 'FOLLOWS' THEN 'Triggering' WHEN 'USES_INTERFACE' THEN 'Composition' WHEN 'RUNS_ON' THEN 'Realization' ELSE 'Assignment' END AS archimate_rel_type, "
         "concat('id-', substring(sha1(src_id), 1, 12)) AS source_archimate_id, concat('id-', substring(sha1(dst_id), 1, 12)) AS target_archimate_id FROM edges WHERE rel_type IN "
         f"('SERVES', 'PARTICIPATES_IN', 'CAN_ASSUME', 'FOLLOWS', 'USES_INTERFACE', 'RUNS_ON', 'RESPONSIBLE_FOR') AND dst_label IN {_LABELS}")(
    lambda spark, folder: exchange_files(spark, folder)[1].select("archimate_id", "archimate_rel_type", "source_archimate_id", "target_archimate_id"))
