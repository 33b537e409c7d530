"""Steps that must not repeat or hold more work than their rows need."""

import io
import os
from contextlib import redirect_stdout

from estatemap.sources import bpmn, documents, master_data
from estatemap.sources import exchange as exchange_source
from workload import checks


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_applications_are_computed_once(spark, tmp_path):
    rows = spark.createDataFrame([
        (1, "Order.System Ship ship.  Pay"), (2, ""), (3, None), (4, "a.operation"), (5, "Pay (old) Pay. Zed"), (6, "b b. B B.")],
        "doc_id long, text string").selectExpr("*", "'s' AS source")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = checks._dedup(spark, str(tmp_path))
    assert "array_sort" not in plan(found)
    assert not [line for line in plan(found).splitlines() if "Filter" in line and "transform" in line]
    kept = {}
    for row in sorted(found.collect()):
        kept.setdefault(row.doc_id, []).append((row.pos, row.name, row.confidence))
    assert kept == {
        1: [(0, "Order.System", "schwach"), (1, "ship.", "stark"), (2, "Pay", "schwach")],
        5: [(0, "Pay.", "stark"), (1, "Zed", "schwach")], 6: [(0, "b.", "stark")]}
    assert documents.dedup_applications(spark.createDataFrame([(None,)], "raw_applications array<struct<name:string,confidence:string>>")).first().applications is None


def test_exchange_files_may_be_compressed(spark, tmp_path):
    elements = spark.createDataFrame([("e1", "Node", "Müller & <Söhne>"), ("e2", "Node", "b")], "identifier string, element_type string, name string")
    relations = spark.createDataFrame([("r1", "Serving", "e1", "e2")], "identifier string, relation_type string, source string, target string")
    exchange_source.write_exchange(elements, relations, f"{tmp_path}/x", "gzip")
    files = [name for _, _, names in os.walk(f"{tmp_path}/x") for name in names if name.startswith("part-")]
    assert files and all(name.endswith(".gz") for name in files)
    found, linked = exchange_source.read_exchange(spark, f"{tmp_path}/x/*")
    assert sorted((r.archimate_id, r.archimate_type, r.name) for r in found.collect()) == [("e1", "Node", "Müller & <Söhne>"), ("e2", "Node", "b")]
    assert [r.archimate_id for r in linked.collect()] == ["r1"]


def test_heads_of_files_sort_no_lines(spark, tmp_path):
    for name, lines in (("a.csv", "\n  \na;b\n1;2\n"), ("b.csv", "﻿x,y;z,w\n" + "1,2\n" * 500), ("c.csv", "\n\n")):
        (tmp_path / name).write_text(lines, encoding="utf-8")
    heads = master_data.file_heads(spark, str(tmp_path))
    assert "Sort" not in plan(heads) and "Window" not in plan(heads)
    assert {r.path.rsplit("/", 1)[1]: (r.header, r.separator) for r in heads.collect()} == {"a.csv": ("a;b", ";"), "b.csv": ("x,y;z,w", ",")}


def test_models_are_parsed_once(spark):
    text = ("<d><participant name='PoolOne' processRef='x:P1'/><participant name='Two' processRef='P1'/>"
            "<process id='P1'><lane name='L'/></process><process id='P2'/></d>")
    other = "<d><participant name='Three' processRef='P1'/><process id='P9'/></d>"
    rows = spark.createDataFrame([("f", text), ("f", text), ("f", other), (None, text), ("n", None)], "path string, text string")
    processes, errors = bpmn.read_processes(rows)
    # Removing comments is the first step of the parse.
    assert plan(processes).count("<!--") == 1
    found = sorted((r.path or "", r.structural_id, r.lanes, r.applications) for r in bpmn.process_entries(processes).collect())
    one = ["Pool One", "Three", "Two"]
    assert found == [("", "P1", ["L"], []), ("", "P2", [], []), ("f", "P1", ["L"], one), ("f", "P1", ["L"], one), ("f", "P2", [], []), ("f", "P2", [], []), ("f", "P9", [], [])]
    assert sorted((r.path, r.structural_id, r.participant) for r in bpmn.participants(processes).collect() if r.path) == [("f", "P1", name) for name in one]
    assert [r.path for r in errors.collect()] == ["n"]
