"""Links to every node of a name: the same edges as an upsert of the written out ones, which are not shuffled."""

import io
import itertools
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from estatemap import model
from estatemap.graph import Graph
from estatemap.operators import exchange
from estatemap.operators.tables import conform

# A node under two names, one name with many nodes, one without an id, and a pair of rows that are alike.
NAMES = [("P", f"name {i % 3}", f"P:{i}") for i in range(40)] + [
    ("P", "name 1", "P:0"), ("P", "name 2", None), ("P", "name 2", "P:2"), ("A", "app", "A:1"), ("A", "app", "A:2"), ("A", "other", "A:3")]
# rel_type, node_id, out, other_label, other_name, src_label, dst_label, archimate_rel_type
LINKS = [
    ("SERVES", "A:1", True, "P", "name 0", "A", "P", "Serving"), ("SERVES", "A:1", True, "P", "name 0", "A", "P", "Access"),
    ("SERVES", "A:2", True, "P", "name 1", "A", "P", "Serving"), ("SERVES", "P:4", False, "A", "app", "A", "P", "Zoned"),
    ("SERVES", "P:0", False, "A", "app", "A", "P", "Serving"), ("SERVES", None, True, "P", "name 2", "A", "P", "Serving"),
    ("RUNS_ON", "A:3", True, "P", "name 2", "A", "P", None), ("SERVES", "A:3", True, "P", "no such name", "A", "P", "Serving")]
STORED = [("SERVES", "A:1", "P:3", "strong"), ("SERVES", "A:1", "P:3", "twice"), ("SERVES", "A:2", "P:4", "x"), ("SERVES", "A:9", "P:9", "kept"),
          ("SERVES", None, "P:3", "no end"), ("RUNS_ON", "A:3", "P:5", "r"), ("FOLLOWS", "A:1", "P:3", "other type")]


def merged(spark):
    edges = conform(spark.createDataFrame(STORED, "rel_type string, src_id string, dst_id string, source string"), model.EDGE_SCHEMA)
    graph = Graph(model.empty(spark, model.NODE_SCHEMA), edges)
    links = spark.createDataFrame(LINKS, "rel_type string, node_id string, out boolean, other_label string, other_name string, "
                                         "src_label string, dst_label string, archimate_rel_type string")
    return exchange.merge_links(graph, links, spark.createDataFrame(NAMES, "label string, name string, node_id string"))


@pytest.mark.parametrize("block", [1, 500])
def test_same_edges_as_written_out(spark, block, monkeypatch):
    monkeypatch.setattr(exchange, "NODES_IN_A_BLOCK", block)
    wanted = {}
    for (kind, node, out, label, name, _, _, archimate), (l, n, other) in itertools.product(LINKS, NAMES):
        if (label, name) == (l, n):
            key = (kind, node, other) if out else (kind, other, node)
            wanted[key] = max(wanted.get(key, ""), archimate or "")
    rows = [(kind, src, dst, source, wanted.get((kind, src, dst), "") if src and dst else "") for kind, src, dst, source in STORED]
    there = {row[:3] for row in STORED if row[1] and row[2]}
    rows += [(*key, None, archimate) for key, archimate in wanted.items() if key not in there]
    found = [(r.rel_type, r.src_id, r.dst_id, r.source, r.archimate_rel_type or "") for r in merged(spark).edges.collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, rows))


def test_edges_are_not_shuffled(spark):
    out = io.StringIO()
    with redirect_stdout(out):
        merged(spark).relation("SERVES").filter(F.col("archimate_rel_type").isNotNull()).explain()
    lines = out.getvalue().splitlines()
    depth = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    made = [i for i, line in enumerate(lines) if "Generate explode" in line and "array_except" in line]
    assert made
    for i in made:
        above = depth[i]
        for j in range(i, -1, -1):
            if depth[j] < above:
                above = depth[j]
                assert "Exchange" not in lines[j]
