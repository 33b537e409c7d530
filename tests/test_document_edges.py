"""Writing documents: stored edges are compared with new ones only where both may be the same."""

import io
from contextlib import redirect_stdout

import pytest

from estatemap import model
from estatemap.graph import Graph
from estatemap.operators import upserts
from estatemap.operators.tables import conform


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def written(spark):
    nodes = spark.createDataFrame([
        ("Process", "Process:1", "one", "1", None, False), ("Process", "Process:2", "two", "2", None, False),
        ("Process", "Process:x", "three", None, None, True), ("Process", None, "none", None, None, False),
        ("Application", "Application:a", "App a", None, "a", None), ("Role", "Role:r", "r", None, None, None)],
        "label string, node_id string, name string, process_id string, cmdb_id string, placeholder boolean")
    edges = spark.createDataFrame([
        ("SERVES", "Application:a", "Process:1", "old"), ("SERVES", "Application:a", "Process:2", "kept"), ("SERVES", "Application:a", None, "no end"),
        ("MAY_SERVE", "Application:a", "Process:1", "old"), ("PARTICIPATES_IN", "Role:r", "Process:1", "old"), ("PARTICIPATES_IN", "Role:r", "Process:2", "kept"),
        ("FOLLOWS", "Process:1", "Process:2", "stored"), ("FOLLOWS", "Process:2", "Process:x", "moved"), ("FOLLOWS", "Process:2", "Process:1", "twice"),
        ("FOLLOWS", "Process:2", "Process:1", "twice"), ("FOLLOWS", "Process:1", None, "no end")],
        "rel_type string, src_id string, dst_id string, raw_name string")
    graph = Graph(conform(nodes, model.NODE_SCHEMA), conform(edges, model.EDGE_SCHEMA))
    documents = spark.createDataFrame([
        ("1", "one", "late", 2, ["r", "new"], ["two", "none", "later"]), ("1", "one", "tied", 2, ["r"], []), ("1", "early", "early", 1, ["gone"], ["two"]),
        ("3", "three", "third", 1, [], [])],
        "process_id string, process_name string, source_path string, ordinal long, roles array<string>, follows_after array<string>")
    matches = spark.createDataFrame([
        ("1", "late", "a", "stark", 0.9, 0), ("1", "late", "b", "stark", 0.9, 1), ("1", "tied", "a", "schwach", 0.8, 0), ("1", "tied", "c", "schwach", 0.7, 1),
        ("1", "early", "d", "stark", 0.9, 0), ("1", "late", "a", "schwach", 0.6, 2), ("3", "other", "a", "stark", 0.9, 0), (None, "late", "a", "stark", 0.9, 0)],
        "process_id string, source_path string, cmdb_id string, confidence string, score double, position long").selectExpr(
        "*", "concat('raw ', cmdb_id) AS application_name", "CAST(NULL AS STRING) AS matched_name", "'fuzzy' AS source", "0L AS ordinal")
    return upserts.write_documents(graph, documents, matches)[0]


def test_edges_of_documents(written):
    rows = [row for rel_type in ("SERVES", "MAY_SERVE", "PARTICIPATES_IN", "FOLLOWS") for row in written.relation(rel_type).collect()]
    found = sorted((r.rel_type, r.src_id, str(r.dst_id), r.raw_name or "", r.score or 0) for r in rows)
    new = written.label("Process").filter("name = 'later'").first().node_id
    assert found == sorted([
        ("SERVES", "Application:a", "Process:1", "raw a", 0), ("SERVES", "Application:b", "Process:1", "raw b", 0),
        ("SERVES", "Application:a", "Process:2", "kept", 0), ("SERVES", "Application:a", "None", "no end", 0),
        ("MAY_SERVE", "Application:a", "Process:1", "", 0.6),
        ("PARTICIPATES_IN", "Role:r", "Process:1", "", 0), ("PARTICIPATES_IN", "Role:new", "Process:1", "", 0), ("PARTICIPATES_IN", "Role:r", "Process:2", "kept", 0),
        ("FOLLOWS", "Process:1", "Process:2", "stored", 0), ("FOLLOWS", "Process:2", "Process:x", "moved", 0), ("FOLLOWS", "Process:2", "Process:1", "twice", 0),
        ("FOLLOWS", "Process:1", "None", "no end", 0), ("FOLLOWS", "Process:1", "None", "", 0), ("FOLLOWS", "Process:1", new, "", 0)])


def test_cleared_edges_are_not_compared_again(written):
    for rel_type in ("SERVES", "MAY_SERVE", "PARTICIPATES_IN"):
        assert plan(written.relation(rel_type)).count("LeftAnti") <= 1
    stored = [line for line in plan(written.relation("FOLLOWS")).splitlines() if "LeftAnti" in line and "dst_id" in line]
    assert not stored
