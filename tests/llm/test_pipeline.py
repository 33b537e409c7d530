"""Registered queries against SQL, and the pipeline's stages against brute force."""

import hashlib
from pathlib import Path

import pytest

import corpus_pipeline
from estatemap.llm.queries import ORACLES, QUERIES
from .test_similar_texts import brute_kept
from .test_text_tables import brute_contamination
from workload.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert difference(QUERIES[name](spark, FOLDER), connect(FOLDER), ORACLES[name]) is None


def test_every_operator_has_a_query():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, items = docs.columns, [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    before = {row.doc_id: row.text for row in docs.collect()}
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        rows = docs.collect()
        assert number + 1 == len(corpus_pipeline.STAGES) or docs.columns == columns
        kept[name] = {row.doc_id for row in rows}
        texts = {key: before[key] for key in kept[name]}
        if name == "quality":
            found = {row.doc_id for row in QUERIES["op1_quality_classifier"](spark, FOLDER).filter("predicted = 1").collect()}
            assert kept[name] == found
        elif name == "exact_copies":
            groups = {}
            for key in kept["quality"]:
                groups.setdefault(before[key], []).append(key)
            assert kept[name] == {max(keys) for keys in groups.values()}
        elif name == "near_copies":
            assert kept[name] == brute_kept([(key, before[key]) for key in sorted(kept["exact_copies"])])[1]
        elif name == "benchmark_passages":
            assert kept[name] == {key for key in kept["near_copies"] if not brute_contamination(before[key], items)[1]}
        else:
            assert kept[name] == kept["benchmark_passages"] and len({hashlib.sha256(t.encode()).digest() for t in texts.values()}) == len(texts)
            assert sum(row.length for row in rows) == sum(max(row.start + row.length for row in rows if row.doc_id == key) for key in texts)
    assert [tuple(r) for r in corpus_pipeline.run(spark, FOLDER).select("doc_id", "piece", "length").orderBy("doc_id", "piece").collect()] == sorted(
        (row.doc_id, row.piece, row.length) for row in rows)
