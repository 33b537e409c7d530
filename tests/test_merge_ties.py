"""A merge of edges that tie in strength and origin, and what a review computes."""

from pyspark.sql import functions as F

from estatemap import model
from estatemap.graph import Graph
from estatemap.operators import exchange, merging
from estatemap.operators.tables import conform
from estatemap.sources.exchange import default_mapping

PROCESSES = 40


def graph_of(spark, order=0):
    """Processes of one name; an application may serve each, with a score of its own. ``order`` turns the rows' order."""
    numbers = [(i * 7 + order) % PROCESSES for i in range(PROCESSES)] if order % 2 else list(range(PROCESSES))
    nodes = [("Process", f"Process:{i}", "one name") for i in numbers] + [("Application", "Application:1", "app")]
    edges = [("MAY_SERVE", "Application:1", f"Process:{i}", "Application", "Process", 0.5 + i / 100) for i in numbers]
    return Graph(
        conform(spark.createDataFrame(nodes, "label string, node_id string, name string"), model.NODE_SCHEMA),
        conform(spark.createDataFrame(edges, "rel_type string, src_id string, dst_id string, src_label string, dst_label string, score double"),
                model.EDGE_SCHEMA))


def pairs_of(spark):
    return spark.createDataFrame([(f"Process:{i}", "Process:0") for i in range(2, PROCESSES)], "source_id string, target_id string")


def test_ties_do_not_depend_on_the_order_of_rows(spark):
    """Process 1 stays apart; of the others the target's own score counts, and without it the least one."""
    found = set()
    for order in (0, 1, 3, 5):
        g = graph_of(spark, order)
        g = g.with_(edges=g.edges.filter("dst_id != 'Process:0'").repartition(5 + order))
        merged, _ = merging.merge_entities(g, "Process", pairs_of(spark), "2024-05-01")
        found.add(tuple(sorted((row.dst_id, row.score) for row in merged.edges.collect())))
    assert found == {(("Process:0", 0.52), ("Process:1", 0.51))}


def test_record_and_graph_are_one_computation(spark):
    g = graph_of(spark)
    # Scores that differ each time they are computed stand for rows that arrive in another order.
    g = g.with_(edges=conform(g.edges.withColumn("score", F.rand()), model.EDGE_SCHEMA))
    merged, record = merging.merge_entities(g, "Process", pairs_of(spark), "2024-05-01")
    at_target = merged.edges.filter("dst_id = 'Process:0'")
    assert [row.score for row in at_target.collect()] == [row.score for row in record.after.edges.filter("dst_id = 'Process:0'").collect()]
    assert [row.score for row in at_target.collect()] == [row.score for row in at_target.collect()]
    assert merging.same_rows(merging.capture(merged, record.focus).nodes, record.after.nodes)
    assert merging.same_rows(merging.capture(merged, record.focus).alias_edges, record.after.alias_edges)


def test_confirming_does_not_write_the_relations(spark, monkeypatch):
    """The nodes of a name may be many: their relations are computed when something reads them."""
    g = graph_of(spark)
    written = []
    cut = exchange.cut_lineage
    monkeypatch.setattr(exchange, "cut_lineage", lambda df: written.append(set(df.columns)) or cut(df))
    chosen = spark.createDataFrame([("e1", "m.xml", "ApplicationComponent", "Application", "app")],
                                   "archimate_id string, archimate_source string, archimate_type string, label string, suggested_match string")
    evidence = spark.createDataFrame([("e1", "m.xml", "outgoing", "Serving", "Process", "one name")],
                                     "archimate_id string, archimate_source string, direction string, relation_type string, other_label string, other_name string")
    result = exchange.confirm_pending(g, chosen, evidence, default_mapping(spark))
    assert not any({"src_id", "dst_id"} <= columns for columns in written)
    assert result.relation("SERVES").filter("archimate_rel_type = 'Serving'").count() == PROCESSES
