"""From files to graph: CSV exports, documents, decisions, re-import, merge and undo, storage."""

import json

import pytest
from pyspark.sql import functions as F

from estatemap import model
from estatemap.graph import Graph, GraphStore
from estatemap.operators import decisions, matching, merging, quality, upserts
from estatemap.operators.tables import conform
from estatemap.plans import catalogue, import_run, refresh
from estatemap.sources import documents as docs
from estatemap.session import cut_lineage
from estatemap.sources import master_data

TODAY, NOW = "2024-05-01", "2024-05-01T10:00:00Z"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    root = tmp_path_factory.mktemp("export")
    return {
        "application": write(root / "apps.csv", "id;name;owner_name;runs_on;uses_interfaces\nA1;Ledger Suite FI;Finance;S1;I1|I2\n"
                             "A2;Banking Gateway;finance;S1| S2;\nA3;Adobe Reader;;S9;\nA4;\"Seller; Service\";Sales;;I1\n"),
        "interface": write(root / "interfaces.csv", "id;name;owner_name\nI1;Payments API;\nI2;Orders API;Sales\n"),
        "server": write(root / "servers.csv", "id,name,server_type,owner_name\nS1,srv-1,Physical,Ops\nS2,srv-2,virtual,\n"),
        "process": str(root / "missing.csv"),
    }


@pytest.fixture(scope="module")
def master(spark, files):
    return master_data.as_master(master_data.application_rows(spark, files).drop("entity_type"))


def documents(spark, rows):
    schema = ("source_path string, file_hash string, process_id string, process_name string, roles array<string>, "
              "process_owner_candidate string, org_unit_candidates array<string>, follows_after array<string>, "
              "raw_applications array<struct<name:string,confidence:string>>, ordinal long")
    full = [(f"{pid}.txt", f"h-{pid}", pid, name, ["Clerk"], "Finance", ["Finance", "Legal"], after, [(app, "stark") for app in apps], n)
            for n, (pid, name, after, apps) in enumerate(rows)]
    return docs.dedup_applications(spark.createDataFrame(full, schema)).withColumn("status", F.lit("processed"))


def edges_of(graph, rel):
    return sorted((r.src_id, r.dst_id, r.source) for r in graph.relation(rel).collect())


@pytest.fixture(scope="module")
def imported(spark, files, master, tmp_path_factory):
    """The result of an import as a later session finds it: committed and read again."""
    entities, relations, issues = master_data.read_master_types(spark, files)
    assert issues.count() == 0
    graph = upserts.register_org_units(Graph.empty(spark), spark.createDataFrame([("Finance",), ("Sales",)], "name string"))
    graph, owners = import_run.sync_master_data(graph, entities, relations, TODAY)
    assert owners.count() == 4
    rows = documents(spark, [
        ("P1", "Booking", ["Unknown"], ["banking gateway", "Ledger Suite FI Core", "Adobe", "CRM"]),
        ("P2", "Closing", ["Booking"], ["BankingGateway (transfer)", "banking gateway"]),
    ])
    result = import_run.import_documents(graph, rows, master, TODAY)
    store = GraphStore(spark, str(tmp_path_factory.mktemp("imported")))
    store.commit(result.graph.tables(), trigger="test", operation="import")
    return import_run.ImportResult(store.read(), cut_lineage(result.documents), result.matches), rows


def test_csv_reading(spark, files, tmp_path):
    rows = master_data.read_master_csv(spark, files["application"])
    assert [r.name for r in rows.orderBy("line_number").collect()][3] == "Seller; Service"
    with pytest.raises(master_data.MasterDataError):
        master_data.read_master_csv(spark, files["process"])
    with pytest.raises(master_data.MasterDataError):
        master_data.read_master_csv(spark, files["application"], "nope")
    broken = write(tmp_path / "deep" / "x.CSV", 'id,name\n1,"a, b"\n2,c,d\n3\n')
    issues = quality.csv_shape_issues(master_data.raw_lines(spark, broken), ",").orderBy("line_number").collect()
    assert [(r.line_number, r.message) for r in issues] == [(3, "3 statt 2 Spalten"), (4, "1 statt 2 Spalten")]
    assert master_data.files_with_columns(spark, str(tmp_path), ["id", "name"]).count() == 1
    assert master_data.files_with_columns(spark, str(tmp_path), ["id", "other"]).count() == 0
    wide = write(tmp_path / "wide.csv", ";".join(["id", "name", *[f"column_{n:04d}" for n in range(500)]]) + "\n1;x\n")
    assert [r.path.split("/")[-1] for r in master_data.files_with_columns(spark, str(tmp_path), ["id", "name", "column_0499"]).collect()] == ["wide.csv"]
    assert master_data.read_master_csv(spark, wide).count() == 1
    broken = write(tmp_path / "breaks.csv", 'id,name\n1,"19"" rack\nsecond line"\n2,y\n')
    assert [r.name for r in master_data.read_master_csv(spark, broken).orderBy("line_number").collect()] == ['19" rack\nsecond line', "y"]


def test_inventory_ids_with_underscores(spark, tmp_path):
    path = write(tmp_path / "inventory.csv", 'process_id,process_name,department,role,owner,mentioned_applications,txt_file\n'
                 'FIN_01,"Book",Finance,Clerk,Ann,"A, B",\nFIN,"Close",Finance,Clerk,Ann,,given.txt\n')
    texts = spark.createDataFrame([("/x/fin_01_book.txt", "t1"), ("/x/given.txt", "t2"), ("/x/other.txt", "t3")], "path string, text string")
    found = {r.process_id: r.txt_file for r in master_data.read_inventory(spark, path, texts).collect()}
    assert found == {"FIN_01": "fin_01_book.txt", "FIN": "given.txt"}
    with pytest.raises(ValueError):
        master_data.read_inventory(spark, path, texts.filter("text <> 't1'")).count()


def test_governance_gaps(imported):
    graph = imported[0].graph
    rows = catalogue.governance_gaps(graph).collect()
    assert [(r.server, r.application_count) for r in rows] == [("srv-1", 2), ("srv-2", 1)]
    assert (rows[0].ownerless_process_count, rows[0].ownerless_application_count, rows[0].ownerless_interface_count,
            rows[0].ownerless_server_count) == (2, 1, 1, 2)
    empty = catalogue.governance_gaps(Graph.empty(graph.nodes.sparkSession)).collect()
    assert len(empty) == 1 and empty[0].ownerless_server_count == 0


def test_import_matches_and_edges(imported):
    result, _ = imported
    found = {(r.process_id, r.application_name): (r.cmdb_id, r.confidence, r.source) for r in result.matches.collect()}
    assert found[("P1", "banking gateway")] == ("A2", "stark", "fuzzy")
    assert found[("P1", "Ledger Suite FI Core")] == ("A1", "schwach", "fuzzy")
    assert found[("P1", "Adobe")] == (None, "schwach", "unmatched")
    assert edges_of(result.graph, "SERVES") == [("Application:A2", "Process:P1", "strong"), ("Application:A2", "Process:P2", "strong")]
    assert [e[:2] for e in edges_of(result.graph, "MAY_SERVE")] == [("Application:A1", "Process:P1")]
    # The unknown predecessor was a placeholder and is gone, the known one stays.
    assert [e[:2] for e in edges_of(result.graph, "FOLLOWS")] == [("Process:P2", "Process:P1")]
    document = result.documents.filter("process_id = 'P1'").first()
    assert document.org_units == ["Finance"] and document.org_unit_candidates == ["Legal"]
    assert result.matches.filter("process_id = 'P1'").count() == 4
    assert {r.normalized_name for r in result.graph.candidates.collect()} == {"legal", "ops"}
    review = matching.review_items(result.matches).select("application_name").collect()
    assert sorted(r.application_name for r in review) == ["Adobe", "CRM", "Ledger Suite FI Core"]


def test_import_is_idempotent(spark, imported, master):
    result, rows = imported
    again = import_run.import_documents(result.graph, rows, master, TODAY)
    for rel in ("SERVES", "MAY_SERVE", "FOLLOWS", "PARTICIPATES_IN", "RUNS_ON", "RESPONSIBLE_FOR"):
        assert edges_of(again.graph, rel) == edges_of(result.graph, rel), rel
    assert merging.same_rows(again.graph.nodes, result.graph.nodes)
    assert {r.process_write_action for r in again.documents.collect()} == {"updated"}


def test_affected_refresh_equals_full_refresh(spark, imported, master):
    """One renamed row, one that came and a decision taken back touch a process; the other keeps its edges unread."""
    result, _ = imported
    run = result.documents.drop("process_write_action")
    third = run.filter("process_id = 'P1'").withColumns({
        "process_id": F.lit("P3"), "process_name": F.lit("Other"), "source_path": F.lit("P3.txt"), "ordinal": F.lit(9),
        "applications": F.array(F.struct(F.lit("Adobe Photo").alias("name"), F.lit("stark").alias("confidence")))})
    run = cut_lineage(run.unionByName(third))
    base = import_run.refresh_documents(result.graph, run, master)
    graph, matches = Graph(cut_lineage(base.graph.nodes), cut_lineage(base.graph.edges)), cut_lineage(base.matches)
    after = master.filter("cmdb_id != 'A2'").unionByName(spark.createDataFrame([("A2", "Adobe Foto", 9), ("A8", "Unlike All", 10)], "cmdb_id string, name string, ordinal long"), allowMissingColumns=True)
    change = refresh.Change(master_before=master, master_after=after)
    assert {r.process_id for r in refresh.touched_processes(run, matches, change).collect()} == {"P1", "P2", "P3"}
    renamed = master.withColumn("name", F.when(F.col("cmdb_id") == "A3", "Adobe Photos").otherwise(F.col("name")))
    change = refresh.Change(master_before=master, master_after=renamed)
    part, touched = refresh.refresh_affected(graph, run, matches, renamed, change)
    whole = import_run.refresh_documents(graph, run, renamed)
    assert [r.process_id for r in touched.collect()] == ["P3"]
    for rel in ("SERVES", "MAY_SERVE", "PARTICIPATES_IN", "FOLLOWS"):
        assert edges_of(part.graph, rel) == edges_of(whole.graph, rel), rel
    removed, added = refresh.replaced_edges(graph, part.graph, touched)
    assert removed.count() == 0 and [(r.src_id, r.dst_id) for r in added.collect()] == [("Application:A3", "Process:P3")]
    decided = spark.createDataFrame([("P2", "Closing", "BANKING gateway")], "process_id string, process string, anwendung_name string")
    alias = spark.createDataFrame([("crm",)], "normalized_name string")
    assert [r.process_id for r in refresh.touched_processes(run, matches, refresh.Change(decisions=decided)).collect()] == ["P2"]
    assert [r.process_id for r in refresh.touched_processes(run, matches, refresh.Change(alias_keys=alias)).collect()] == ["P1"]
    assert refresh.touched_processes(run, matches, refresh.Change()).count() == 0


def test_decisions_survive_reimport_and_revert(spark, imported, master):
    result, rows = imported
    columns = "process string, process_id string, anwendung_im_prozess string, anwendung_in_cmdb string, cmdb_id string, source_path string"
    graph = decisions.confirm_links(result.graph, spark.createDataFrame(
        [("Booking", "P1", "Ledger Suite FI Core", "Ledger Suite FI", "A1", "P1.txt")], columns), NOW)
    graph = decisions.reject_links(graph, spark.createDataFrame([("Booking", "P1", "Adobe", "-", None, "P1.txt")], columns))
    again = import_run.import_documents(graph, rows, master, TODAY)
    assert ("Application:A1", "Process:P1", "manuell_bestaetigt") in edges_of(again.graph, "SERVES")
    assert again.matches.filter("application_name = 'Adobe'").first().source == "rejected"
    assert graph.aliases.first().normalized_name == "ledger suite fi core"
    logged = decisions.current_decisions(graph)
    undone, outcome = decisions.revert_decisions(graph, logged.select("decision_id"), "2024-06-01T00:00:00Z")
    assert [r.outcome for r in outcome.collect()] == ["reverted"]
    assert ("Application:A1", "Process:P1", "manuell_bestaetigt") not in edges_of(undone, "SERVES")
    assert undone.aliases.count() == 0
    twice = decisions.revert_decisions(undone, logged.select("decision_id"), "2024-06-02T00:00:00Z")[1]
    assert [r.outcome for r in twice.collect()] == ["inactive"]


def test_merge_and_undo(spark, imported):
    graph = imported[0].graph
    before = graph
    pairs = spark.createDataFrame([("Process:P2", "Process:P1")], "source_id string, target_id string")
    merged, record = merging.merge_entities(graph, "Process", pairs, TODAY)
    assert [e[:2] for e in edges_of(merged, "SERVES")] == [("Application:A2", "Process:P1")]
    assert [e[:2] for e in edges_of(merged, "FOLLOWS")] == [("Process:P1", "Process:P1")]
    assert merged.aliases.first().normalized_name == "closing"
    restored = merging.undo_merge(merged, record)
    assert merging.same_rows(restored.nodes, before.nodes) and merging.same_rows(restored.edges, before.edges)
    assert merging.same_rows(restored.aliases, before.aliases)
    changed = merged.with_label("Process", merged.label("Process").withColumn("name", F.lit("other")))
    with pytest.raises(ValueError):
        merging.undo_merge(changed, record)
    with pytest.raises(ValueError):
        merging.merge_entities(graph, "Process", spark.createDataFrame([("Process:P1", "Process:P1")], pairs.schema), TODAY)


def test_store_snapshot_restore(spark, imported, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    graph = imported[0].graph
    assert store.read().nodes.count() == 0
    first = store.commit(graph.tables(), trigger="test", operation="first")
    saved = store.snapshot(trigger="test", operation="save")
    second = store.commit({"edges": graph.edges.limit(0)}, trigger="test", operation="drop edges")
    assert (first, saved, second) == (1, 2, 3)
    assert store.read().edges.count() == 0 and merging.same_rows(store.read().nodes, graph.nodes)
    store.restore(saved)
    assert merging.same_rows(store.read().edges, graph.edges) and store.validate(saved) == []
    assert store.versions().count() == 5 and store.prunable(1).count() == 1
    path = [r.path for r in store.manifest().filter("version = 1 and table = 'edges'").collect()][0]
    spark.createDataFrame([("X", "X:1")], "label string, node_id string").write.mode("append").parquet(path)
    assert store.validate(1)


def test_store_sees_files_and_prunes(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path / "store"))
    node = spark.createDataFrame([("Process", "Process:1", "One")], "label string, node_id string, name string")
    graph = Graph(conform(node, model.NODE_SCHEMA), model.empty(spark, model.EDGE_SCHEMA))
    first = store.commit(graph.tables(), trigger="test", operation="first")
    path = [r.path for r in store.manifest().filter("table = 'nodes'").collect()][0]
    kept = [store.snapshot(trigger="test", operation=f"keep {i}") for i in range(3)]
    # Snapshots of an unchanged graph point to the same files.
    assert store.manifest().select("path").distinct().count() == store.manifest().filter("version = 1").count()
    changed = store.commit({"nodes": graph.nodes.limit(0)}, trigger="test", operation="drop")
    other = store.snapshot(trigger="test", operation="other")
    assert store.prune(2) == kept[:2] and store.prune(2) == [] and store.validate(kept[2]) == [] and store.validate(first) == []
    assert store.prune(1, protected=[kept[2]]) == [] and store.read().nodes.count() == 0 and store.read(other).nodes.count() == 0
    restored = store.restore(kept[2])
    assert store.read(restored).nodes.count() == 1 and store.validate(changed) == []
    conform(node, model.NODE_SCHEMA).drop("label").write.mode("append").parquet(f"{path}/label=Process")
    assert store.validate(first) == ["nodes: files differ", "nodes: row count differs"] and store.validate(changed) == []


def test_match_cascade_cases(spark):
    mention = "source_path string, process string, process_id string, application_name string, position int"
    mentions = spark.createDataFrame([
        ("d", "Proc", "", "Known Thing", 0), ("d", "Proc", "P", "Known Thing", 1), ("d", "Proc", "", "Refused", 2),
        ("d", "Proc", "", "shipperServiceInterface (requestShippingOp)", 3)], mention)
    master = spark.createDataFrame([("1", "Shipper Service", 0), ("2", "Seller Service", 1), ("3", "Known Thing", 2)],
                                   "cmdb_id string, name string, ordinal long")
    confirmed = spark.createDataFrame([("Proc", "", "Known Thing", "9", "Target", "manueller_link")], model.CONFIRMED_SCHEMA)
    rejected = spark.createDataFrame([("Proc", "", "Refused", None)], model.REJECTED_SCHEMA)
    rows = {r.position: (r.cmdb_id, r.source, r.confidence) for r in matching.match_terms(mentions, master, confirmed, rejected).collect()}
    assert rows == {0: ("9", "knowledge_base_manual", "stark"), 1: ("3", "fuzzy", "stark"), 2: (None, "rejected", "schwach"),
                    3: ("1", "fuzzy", "schwach")}


def test_extraction_answers(spark):
    good = {"process": "p", "roles": ["a; B, a"], "process_owner": " x  y ", "org_unit_candidates": ["U1;U2"],
            "applications": [{"name": "SAP (x)", "confidence": "stark"}, {"name": "SAP System", "confidence": "schwach"}]}
    answers = spark.createDataFrame([
        ("a.txt", "h", "Process ID: P-7\n", "Sure:\n```" + json.dumps(good) + "``` done }"), ("b.txt", "h", "", "[{}]"),
        ("c.txt", "h", "", "{\"process\": 1"), ("d.txt", "h", "", "nothing"), ("e.txt", "h", "", "{\"process\": \"x\"}")],
        "path string, file_hash string, text string, answer string")
    records, bad = docs.read_extractions(answers, "answer")
    row = docs.extracted_documents(records).first()
    assert (row.process_id, row.roles, row.process_owner_candidate, row.org_unit_candidates) == ("P-7", ["a", "B"], "x y", ["U1", "U2"])
    assert [(a.name, a.confidence) for a in row.applications] == [("SAP", "stark")]
    assert {r.path: r.reason.split(":")[0] for r in bad.collect()} == {
        "b.txt": "no_object", "c.txt": "invalid_json", "d.txt": "no_object", "e.txt": "missing"}
