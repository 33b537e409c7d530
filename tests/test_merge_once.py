"""A merge computes the graph's edges once, and taking it back compares each table in one aggregation."""

from pyspark.sql import functions as F

from estatemap import model
from estatemap.graph import Graph
from estatemap.operators import merging
from estatemap.operators.tables import conform

NODES = [("Process", "Process:1", "a"), ("Process", "Process:2", "a"), ("Process", "Process:3", "b"), ("Application", "Application:1", "app")]
EDGES = [
    ("SERVES", "Application:1", "Process:1", "Application", "Process"), ("SERVES", "Application:1", "Process:2", "Application", "Process"),
    ("FOLLOWS", "Process:1", "Process:2", "Process", "Process"), ("FOLLOWS", "Process:3", "Process:2", "Process", "Process"),
    ("FOLLOWS", "Process:3", "Process:3", "Process", "Process"), ("FOLLOWS", "Process:3", None, "Process", "Process"),
    ("FOLLOWS", None, "Process:3", "Process", "Process"), ("SERVES", "Application:1", "Process:3", "Application", "Process")]


def graph_of(spark):
    return Graph(
        conform(spark.createDataFrame(NODES, "label string, node_id string, name string"), model.NODE_SCHEMA),
        conform(spark.createDataFrame(EDGES, "rel_type string, src_id string, dst_id string, src_label string, dst_label string"), model.EDGE_SCHEMA))


def found(edges):
    return sorted((row.rel_type, row.src_id or "", row.dst_id or "") for row in edges.collect())


def test_a_merge_computes_the_edges_once_and_can_be_taken_back(spark):
    computed = spark.sparkContext.accumulator(0)

    def seen(value):
        computed.add(1)
        return value

    g = graph_of(spark)
    counted = g.with_(edges=conform(g.edges.withColumn("raw_name", F.udf(seen).asNondeterministic()("rel_type")), model.EDGE_SCHEMA))
    pairs = spark.createDataFrame([("Process:2", "Process:1")], "source_id string, target_id string")
    merged, record = merging.merge_entities(counted, "Process", pairs, "2024-05-01")
    assert found(merged.edges) == [
        ("FOLLOWS", "", "Process:3"), ("FOLLOWS", "Process:1", "Process:1"), ("FOLLOWS", "Process:3", ""),
        ("FOLLOWS", "Process:3", "Process:1"), ("FOLLOWS", "Process:3", "Process:3"),
        ("SERVES", "Application:1", "Process:1"), ("SERVES", "Application:1", "Process:3")]
    assert record.before.edges.count() == 4
    assert computed.value == len(EDGES)
    assert found(merging.undo_merge(merged, record).edges) == sorted((rel, src or "", dst or "") for rel, src, dst, *_ in EDGES)


def test_rows_are_compared_as_multisets(spark, monkeypatch):
    rows = lambda *values: spark.createDataFrame([(v, {"k": str(v)}) for v in values], "v int, m map<string, string>")
    # Each difference would shuffle both tables once more.
    monkeypatch.setattr(type(rows(1)), "exceptAll", None)
    assert merging.same_rows(rows(1, 1, None), rows(None, 1, 1))
    assert not merging.same_rows(rows(1, 1, 2), rows(1, 2, 2))
    assert not merging.same_rows(rows(1), rows(1, 1))
