"""The star-schema tables seen as an architecture graph.

The selects below are plain SQL that Spark and DuckDB read alike; both sides of every comparison start
from the same projection, and the operators under test are expressed independently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatemap import model
from estatemap.graph import Graph
from estatemap.operators.tables import conform

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

NODES = {
    "Application": "SELECT concat('Application:', s_suppkey) AS node_id, s_name AS name, CAST(s_suppkey AS STRING) AS cmdb_id, "
                   "CAST(s_suppkey AS STRING) AS id FROM {supplier}",
    "Server": "SELECT concat('Server:', n_nationkey) AS node_id, n_name AS name, CAST(n_nationkey AS STRING) AS id, "
              "CASE WHEN n_nationkey % 2 = 0 THEN 'physical' ELSE 'virtual' END AS server_type FROM {nation}",
    "Interface": "SELECT DISTINCT concat('Interface:', p_brand) AS node_id, p_brand AS name, p_brand AS id FROM {part}",
    "OrgUnit": "SELECT concat('OrgUnit:', r_name) AS node_id, r_name AS name FROM {region}",
    "Process": "SELECT concat('Process:', p_partkey) AS node_id, p_name AS name, CAST(p_partkey AS STRING) AS process_id, "
               "false AS placeholder FROM {part}",
    "Role": "SELECT DISTINCT concat('Role:', c_mktsegment) AS node_id, c_mktsegment AS name, "
            "c_mktsegment = 'MACHINERY' AS role_only FROM {customer}",
    "Risk": "SELECT DISTINCT concat('Risk:', event_type) AS node_id, event_type AS name FROM {events}",
    "Goal": "SELECT DISTINCT concat('Goal:', p_type) AS node_id, p_type AS name FROM {part}",
    "Capability": "SELECT DISTINCT concat('Capability:', role) AS node_id, role AS name FROM {conversations}",
    "DataObject": "SELECT DISTINCT concat('DataObject:', source) AS node_id, source AS name FROM {documents}",
    "Infrastructure": "SELECT DISTINCT concat('Infrastructure:', lang) AS node_id, lang AS name FROM {documents}",
    "Resource": "SELECT DISTINCT concat('Resource:', o_orderpriority) AS node_id, o_orderpriority AS name FROM {orders}",
}

# (relationship type, source label, target label): select with src_id, dst_id and properties.
EDGES = {
    ("SERVES", "Application", "Process"):
        "SELECT concat('Application:', l_suppkey) AS src_id, concat('Process:', l_partkey) AS dst_id, 'stark' AS confidence, "
        "CASE WHEN min(l_linestatus) = 'F' THEN 'manuell_bestaetigt' ELSE 'strong' END AS source, "
        "concat('term ', l_suppkey) AS raw_name FROM {lineitem} WHERE l_returnflag <> 'R' GROUP BY l_suppkey, l_partkey",
    ("MAY_SERVE", "Application", "Process"):
        "SELECT concat('Application:', l_suppkey) AS src_id, concat('Process:', l_partkey) AS dst_id, "
        "max(l_discount) + 0.8 AS score FROM {lineitem} WHERE l_returnflag = 'R' GROUP BY l_suppkey, l_partkey",
    ("RUNS_ON", "Application", "Server"):
        "SELECT concat('Application:', s_suppkey) AS src_id, concat('Server:', s_nationkey) AS dst_id FROM {supplier}",
    ("RUNS_ON", "Interface", "Server"):
        "SELECT DISTINCT concat('Interface:', p_brand) AS src_id, "
        "concat('Server:', CAST(substring(p_brand, 7) AS INT) - 1) AS dst_id FROM {part}",
    ("RUNS_ON", "Application", "Infrastructure"):
        "SELECT concat('Application:', doc_id) AS src_id, concat('Infrastructure:', lang) AS dst_id FROM {documents} "
        "WHERE doc_id IN (SELECT s_suppkey FROM {supplier}) AND lang <> 'en'",
    ("USES_INTERFACE", "Application", "Interface"):
        "SELECT DISTINCT concat('Application:', l_suppkey) AS src_id, concat('Interface:', p_brand) AS dst_id "
        "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    ("RESPONSIBLE_FOR", "OrgUnit", "Server"):
        "SELECT concat('OrgUnit:', r_name) AS src_id, concat('Server:', n_nationkey) AS dst_id "
        "FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    ("RESPONSIBLE_FOR", "OrgUnit", "Process"):
        "SELECT concat('OrgUnit:', r_name) AS src_id, concat('Process:', p_partkey) AS dst_id "
        "FROM {part} JOIN {region} ON p_size = r_regionkey",
    ("RESPONSIBLE_FOR", "OrgUnit", "Application"):
        "SELECT concat('OrgUnit:', r_name) AS src_id, concat('Application:', s_suppkey) AS dst_id "
        "FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey "
        "WHERE s_acctbal >= 2000",
    ("PARTICIPATES_IN", "Role", "Process"):
        "SELECT DISTINCT concat('Role:', c_mktsegment) AS src_id, concat('Process:', l_partkey) AS dst_id "
        "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey",
    ("CAN_ASSUME", "OrgUnit", "Role"):
        "SELECT DISTINCT concat('OrgUnit:', r_name) AS src_id, concat('Role:', c_mktsegment) AS dst_id "
        "FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey "
        "WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')",
    ("FOLLOWS", "Process", "Process"):
        "SELECT DISTINCT concat('Process:', l_partkey) AS src_id, concat('Process:', follower) AS dst_id FROM ("
        "SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS follower "
        "FROM {lineitem}) AS chained WHERE follower IS NOT NULL",
    ("AFFECTS", "Risk", "Application"):
        "SELECT DISTINCT concat('Risk:', event_type) AS src_id, concat('Application:', user_id) AS dst_id "
        "FROM {events} JOIN {supplier} ON user_id = s_suppkey",
    ("AFFECTS", "Risk", "Process"):
        "SELECT DISTINCT concat('Risk:', event_type) AS src_id, concat('Process:', p_partkey) AS dst_id "
        "FROM {events} JOIN {part} ON event_id = p_partkey",
    ("MITIGATES", "Capability", "Risk"):
        "SELECT DISTINCT concat('Capability:', role) AS src_id, concat('Risk:', event_type) AS dst_id "
        "FROM {conversations} JOIN {events} ON conv_id = event_id",
    ("SUPPORTS", "Application", "Goal"):
        "SELECT DISTINCT concat('Application:', l_suppkey) AS src_id, concat('Goal:', p_type) AS dst_id "
        "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    ("PROCESSES", "Application", "DataObject"):
        "SELECT concat('Application:', doc_id) AS src_id, concat('DataObject:', source) AS dst_id FROM {documents} "
        "WHERE doc_id IN (SELECT s_suppkey FROM {supplier})",
    ("REQUIRES", "Process", "Resource"):
        "SELECT DISTINCT concat('Process:', l_partkey) AS src_id, concat('Resource:', o_orderpriority) AS dst_id "
        "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey",
}

ALIASES = "SELECT DISTINCT lower(p_name) AS normalized_name, p_name AS name, 'merged_entity' AS source_kind FROM {part}"
ALIAS_EDGES = ("SELECT lower(p_name) AS normalized_name, 'Process' AS target_label, concat('Process:', p_partkey) AS target_id, "
               "'merged_entity' AS source_kind FROM {part}")


_TABLES: dict[tuple[str, str, str], DataFrame] = {}
_GRAPHS: dict[tuple[str, str], Graph] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The scan of one table. Only the plan is kept, which saves reading the footers again per query."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _TABLES:
        _TABLES[key] = spark.read.parquet(f"{folder}/{name}.parquet")
    return _TABLES[key]


def query(spark: SparkSession, folder: str, sql: str) -> DataFrame:
    used = {name: table(spark, folder, name) for name in TABLES if "{" + name + "}" in sql}
    return spark.sql(sql, **used)


def graph(spark: SparkSession, folder: str) -> Graph:
    """The projection as a graph; only its plan is kept between queries."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _GRAPHS:
        by_label = {
            label: conform(query(spark, folder, sql).withColumn("label", F.lit(label)), model.NODE_SCHEMA)
            for label, sql in NODES.items()
        }
        by_type: dict[str, DataFrame] = {}
        for shape, sql in EDGES.items():
            part = conform(query(spark, folder, sql).withColumns(dict(zip(
                ("rel_type", "src_label", "dst_label"), map(F.lit, shape)))), model.EDGE_SCHEMA)
            by_type[shape[0]] = by_type[shape[0]].unionByName(part) if shape[0] in by_type else part
        result = Graph(
            model.empty(spark, model.NODE_SCHEMA), model.empty(spark, model.EDGE_SCHEMA),
            node_parts=by_label, edge_parts=by_type,
            aliases=conform(query(spark, folder, ALIASES), model.ALIAS_SCHEMA),
            alias_edges=conform(query(spark, folder, ALIAS_EDGES), model.ALIAS_EDGE_SCHEMA))
        _GRAPHS[key] = result
    return _GRAPHS[key]


def plain(sql: str) -> str:
    """The select with bare table names, as DuckDB reads it."""
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


def node_sql(label: str) -> str:
    """The nodes of one label for the SQL side, without the others but with their columns."""
    strings = ", ".join(f"NULL::VARCHAR AS {name}" for name in ("process_id", "cmdb_id", "id", "server_type"))
    return (f"(SELECT '{label}' AS label, * FROM ({plain(NODES[label])}) UNION ALL BY NAME "
            f"SELECT {strings}, NULL::BOOLEAN AS placeholder, NULL::BOOLEAN AS role_only WHERE false)")


def edge_sql(rel_type: str, src_label: str | None = None, dst_label: str | None = None) -> str:
    """The edges of one type (and shape) for the SQL side, without the others."""
    return "(" + " UNION ALL BY NAME ".join(
        f"SELECT '{rel}' AS rel_type, '{src}' AS src_label, '{dst}' AS dst_label, * FROM ({plain(sql)})"
        for (rel, src, dst), sql in EDGES.items()
        if rel == rel_type and src_label in (None, src) and dst_label in (None, dst)) + ")"


def graph_sql(query: str | None = None) -> str:
    """``WITH`` and the table expressions ``nodes``, ``edges``, ``aliases`` and ``alias_edges``, each computed once.

    Of ``query`` only those it names are given, and nothing where it names none.
    """
    parts = {
        "nodes": " UNION ALL BY NAME ".join(f"SELECT * FROM {node_sql(label)}" for label in NODES),
        "edges": " UNION ALL BY NAME ".join(f"SELECT * FROM {edge_sql(*shape)}" for shape in EDGES),
        "aliases": plain(ALIASES), "alias_edges": plain(ALIAS_EDGES),
    }
    used = [name for name in parts if query is None or re.search(rf"\b{name}\b", query)]
    return "WITH " + ", ".join(f"{name} AS MATERIALIZED ({parts[name]})" for name in used) if used else ""
