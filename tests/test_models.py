"""Exchange files, process models, traversal, the inbox stream, plan shapes."""

from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from estatemap.graph import Graph
from estatemap.operators import exchange, traverse, upserts
from estatemap.plans.pattern import edge, match, union_all
from estatemap.sources import bpmn
from estatemap.sources import documents as docs
from estatemap.sources import exchange as source
from estatemap.sources.runs import read_import_state
from estatemap.streaming.inbox import process_inbox

XML = """<?xml version="1.0" encoding="UTF-8"?>
<model xmlns="http://www.opengroup.org/xsd/archimate/3.1/" xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance" identifier="m">
<elements>
<element identifier="e1" xsi:type="ApplicationComponent"><name xml:lang="en">Ledger</name><name xml:lang="german">Hauptbuch</name></element>
<element identifier="e2" xsi:type="BusinessProcess"><name>Booking</name></element>
<element identifier="e3" xsi:type="ApplicationComponent"><name>Paymnt Gateway</name></element>
<element identifier="e4" xsi:type="Oddity"><name>Odd</name></element>
<element identifier="e5" xsi:type="BusinessProcess"></element>
</elements>
<relationships>
<relationship identifier="r1" xsi:type="Serving" source="e1" target="e2"/>
<relationship identifier="r2" xsi:type="Serving" source="e3" target="e2"/>
<relationship identifier="r3" xsi:type="Access" source="e1" target="e2"/>
<relationship identifier="r4" source="e1" target="e2"/>
</relationships></model>"""


def entities(spark, rows):
    return spark.createDataFrame([(i, n, t, None, k) for k, (i, n, t) in enumerate(rows)],
                                 "entity_id string, name string, entity_type string, server_type string, line_number long")


@pytest.fixture(scope="module")
def base(spark):
    return upserts.upsert_entities(Graph.empty(spark), entities(spark, [
        ("A1", "Payment Gateway", "application"), ("A2", "Payments", "application"), ("P1", "Booking", "process")]))


def test_exchange_import(spark, base, tmp_path):
    (tmp_path / "m.xml").write_text(XML, encoding="utf-8")
    path = str(tmp_path / "m.xml")
    assert source.exchange_version(spark, path).first().version == "3.1"
    elements, relations = source.read_exchange(spark, path)
    assert {r.archimate_id: r.name for r in elements.collect()} == {"e1": "Hauptbuch", "e2": "Booking", "e3": "Paymnt Gateway", "e4": "Odd"}
    assert relations.count() == 3
    mapping = source.default_mapping(spark)
    result = exchange.import_exchange(base, elements, relations, mapping)
    report = exchange.import_report(result).first()
    assert (report.elements_imported, report.elements_as_candidates, report.relations_imported, report.relations_skipped,
            report.elements_skipped) == (2, 1, 1, 2, 1)
    pending = result.pending.first()
    assert (pending.suggested_match, pending.score) == ("Payment Gateway", round(SequenceMatcher(None, "paymnt gateway", "payment gateway").ratio(), 3))
    booking = result.graph.label("Process").collect()
    assert [(r.process_id, r.archimate_id) for r in booking] == [("P1", "e2")]
    confirmed = exchange.confirm_pending(result.graph, result.pending, result.pending_relations, mapping)
    assert {(r.src_id, r.dst_id, r.archimate_rel_type) for r in confirmed.relation("SERVES").collect()} >= {
        ("Application:A1", "Process:P1", "Serving")}
    exported = exchange.export_elements(confirmed, mapping)
    source.write_exchange(exported, exchange.export_relations(confirmed, mapping, exported), str(tmp_path / "out"))
    back, back_relations = source.read_exchange(spark, str(tmp_path / "out" / "*"))
    assert back.count() == exported.count() and back_relations.count() == 2


def test_process_models(spark):
    text = """<bpmn:definitions xmlns:bpmn="x"><bpmn:collaboration>
      <bpmn:participant name="shipperPortal" processRef="P1"/><bpmn:participant name="Participant 2" processRef="P2"/></bpmn:collaboration>
      <bpmn:process id="P1" name="Ship"><bpmn:lane name="Clerk"/><bpmn:dataStoreReference name="Salesforce"/></bpmn:process>
      <bpmn:process id="P2"/></bpmn:definitions>"""
    rows = spark.createDataFrame([("a.bpmn", text), ("b.bpmn", "<process id='x'>"), ("c.xml", "<a/>")], "path string, text string")
    processes, errors = bpmn.read_processes(rows)
    found = {r.structural_id: (r.process_name, r.lanes, r.applications) for r in bpmn.process_entries(processes).collect()}
    assert found == {"P1": ("Ship", ["Clerk"], ["Salesforce", "shipper Portal"]), "P2": ("P2", [], [])}
    assert sorted(r.path for r in errors.collect()) == ["b.bpmn", "c.xml"]


def test_pattern_api_rejects(base):
    with pytest.raises(ValueError):
        match(base, "x:Nonsense")
    with pytest.raises(ValueError):
        match(base, "a:Application").hop("a", "RUNS_ON", "p:Process")
    with pytest.raises(ValueError):
        match(base, "a:Application").select(a="a")
    with pytest.raises(ValueError):
        match(base, "a:Application").also(match(base, "p:Process"))
    with pytest.raises(ValueError):
        union_all(match(base, "a:Application").select(x="a.name"), match(base, "a:Application").select(y="a.name"))
    assert edge(base, "a:Application", "SERVES", "p:Process").df.count() == 0


def test_expansion_and_budget(spark, base):
    chain = spark.createDataFrame([(f"Process:{i}", f"Process:{i + 1}") for i in range(6)] + [("Process:0", f"Process:x{i}") for i in range(5)],
                                  "src_id string, dst_id string")
    ids = [f"{i}" for i in range(7)] + [f"x{i}" for i in range(5)]
    graph = upserts.upsert_entities(Graph.empty(spark), entities(spark, [(i, f"n{i}", "process") for i in ids]))
    graph = upserts.merge_edges(graph, "FOLLOWS", upserts.edge_rows(chain, "FOLLOWS", "Process", "Process"))
    seeds = graph.label("Process").filter("process_id = '3'")
    full = traverse.expand(graph, seeds, ["FOLLOWS"], budget=None)
    assert {r.depth: r.ring_size for r in traverse.ring_sizes(full.nodes).collect()} == {0: 1, 1: 2, 2: 2, 3: 2, 4: 5}
    assert full.edges.count() == 11
    assert traverse.expand(graph, seeds).nodes.count() == 5
    kept, truncated = traverse.ring_budget(full, 8)
    assert kept.nodes.count() == 7 and truncated.first().truncated and kept.edges.count() == 6


def test_inbox_processes_each_document_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.txt").write_text("one")
    (inbox / "skip.md").write_text("no")
    seen = []

    def handle(batch, number):
        rows = batch.select("source_path", "file_hash", F.lit("P").alias("process_id"))
        seen.extend(r.source_path.rsplit("/", 1)[-1] for r in rows.collect())
        return rows

    def run():
        process_inbox(spark, str(inbox), str(tmp_path / "cp"), str(tmp_path / "state"), handle).awaitTermination()

    run()
    (inbox / "b.txt").write_text("two")
    run()
    assert seen == ["a.txt", "b.txt"]
    assert read_import_state(spark, str(tmp_path / "state")).count() == 2


def test_bad_bytes_are_an_error_row(spark, tmp_path):
    (tmp_path / "ok.txt").write_text("gut")
    (tmp_path / "bad.TXT").write_bytes(b"\xff\xfe\xfa")
    rows = {r.display_path: r.status for r in docs.read_texts(docs.scan_documents(spark, str(tmp_path))).collect()}
    assert rows == {"ok.txt": None, "bad.TXT": "error"}
