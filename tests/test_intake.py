"""Streams that break off and runs that are written again."""

import pytest
from pyspark.sql import functions as F

from estatemap.sources import runs
from estatemap.streaming.inbox import batch_name, process_stream, table_stream

COLUMNS = ("source_path", "file_hash", "process_id", "size")


def documents(spark, keys):
    return spark.createDataFrame([(f"p{key % 7}", f"h{key}", "x" * key) for key in keys], "source_path string, file_hash string, content string")


def handle(batch, number):
    return batch.select("source_path", "file_hash", F.concat(F.lit("P-"), "source_path").alias("process_id"), F.length("content").cast("long").alias("size"))


@pytest.fixture
def inbox(spark, tmp_path):
    """Four files; the third repeats documents of the first, the last one within itself."""
    for n, keys in enumerate((range(0, 10), range(10, 20), range(5, 12), [20, 20, 21])):
        documents(spark, keys).coalesce(1).write.parquet(str(tmp_path / f"part-{n}"))
    return f"{tmp_path}/part-*"


def expected(spark):
    return sorted(tuple(row) for row in handle(documents(spark, range(22)), 0).collect())


def stored(spark, path):
    return sorted(tuple(row) for row in spark.read.parquet(path).select(*COLUMNS).collect())


def test_batches_and_a_batch_that_breaks_off(spark, inbox, tmp_path, monkeypatch):
    """The stream dies after a batch was written and before it was committed, then inside of a batch; both are repeated."""
    import estatemap.streaming.inbox as module

    calls, put = [], runs.put_partition

    def broken(rows, path, key, value):
        calls.append(value)
        if len(calls) == 2:
            put(rows.limit(1), path, key, value)  # half of a batch has reached the table
            raise RuntimeError("before the write was done")
        n = put(rows, path, key, value)
        if len(calls) == 4:
            raise RuntimeError("after the write, before its commit")
        return n

    monkeypatch.setattr(module, "put_partition", broken)
    table, checkpoint = str(tmp_path / "table"), str(tmp_path / "checkpoint")
    start = lambda: process_stream(table_stream(spark, inbox, max_files=1), checkpoint, table, handle).awaitTermination()
    for _ in range(2):
        with pytest.raises(Exception, match="the write"):
            start()
    start()
    assert calls == [batch_name(n) for n in (0, 1, 1, 2, 2, 3)]
    assert stored(spark, table) == expected(spark)
    start()
    assert len(calls) == 6 and stored(spark, table) == expected(spark)


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert runs.read_latest_run(spark, path).count() == 0 and runs.read_runs(spark, path).count() == 0
    docs = documents(spark, range(6)).select("source_path", "file_hash", F.lit("P").alias("process_id"))
    matches = docs.select("source_path", "file_hash", "process_id", F.lit(1).alias("position"), F.lit("App").alias("application_name"))
    runs.write_run(docs, matches, path, "b", "full", "2024-01-02")
    runs.write_run(docs.limit(3), matches.limit(0), path, "a", "part", "2024-01-01")
    assert runs.read_latest_run(spark, path).count() == 6 and runs.read_latest_candidates(spark, path).count() == 6
    runs.write_run(docs.limit(2), matches.limit(4), path, "b", "again", "2024-01-03")
    assert runs.read_latest_run(spark, path).count() == 2 and runs.read_latest_candidates(spark, path).count() == 4
    assert {(row.run_id, row.run_mode, row.documents, row.candidates) for row in runs.read_runs(spark, path).collect()} == {("a", "part", 3, 0), ("b", "again", 2, 4)}
    runs.write_run(docs.limit(0), matches.limit(0), path, "b", "empty", "2024-01-04")
    assert runs.read_latest_run(spark, path).count() == 0 and runs.read_latest_candidates(spark, path).count() == 0
    runs.write_run(docs, matches, path, "c", "last", "2024-01-05")
    plan = runs.read_latest_run(spark, path)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan and runs.last_import_selection(spark, path).first().run_mode == "last"
