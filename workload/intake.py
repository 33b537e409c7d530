"""Runs and the stream of documents: what is written, written again, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from estatemap.session import checkpoint_folder
from estatemap.sources import runs
from estatemap.streaming.inbox import process_stream, table_stream
from workload.registry import register
from workload.star import plain, query


def scratch(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


# Three runs over the orders: the second is written twice, the last to finish is not the last to be written.
DONE = ("SELECT concat('doc-', o_orderkey) AS source_path, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('in/', o_orderkey) END AS display_path, "
        "sha2(concat(o_orderkey, '-', {run}), 256) AS file_hash, o_orderstatus AS status, CAST(o_custkey AS STRING) AS process_id, "
        "array(o_orderpriority, o_orderstatus) AS roles, o_orderkey AS ordinal FROM {{orders}} WHERE o_orderkey % {parts} <> 0")
FOUND = ("SELECT concat('doc-', l_orderkey) AS source_path, concat('h', l_orderkey) AS file_hash, CAST(l_suppkey AS STRING) AS cmdb_id, concat('App ', l_suppkey) AS application_name, "
         "l_discount + 0.85 AS score, CAST(l_linenumber AS BIGINT) AS position, CAST(0 AS BIGINT) AS ordinal FROM {{lineitem}} WHERE l_linenumber > {run}")


def written_runs(spark, folder) -> str:
    path = scratch(spark, "runs")
    for run, parts, finished in ((1, 5, "2024-05-01"), (2, 2, "2024-05-09"), (2, 7, "2024-05-10"), (3, 3, "2024-05-02")):
        runs.write_run(query(spark, folder, DONE.format(run=run, parts=parts)), query(spark, folder, FOUND.format(run=run)), path, f"run-{run}", f"mode {run}", finished)
    return path


_DONE = plain(DONE.format(run=2, parts=7)).replace("sha2(concat(o_orderkey, '-', 2), 256)", "sha256(concat(o_orderkey, '-', 2))").replace("array(o_orderpriority, o_orderstatus)", "[o_orderpriority, o_orderstatus]")
_FOUND = plain(FOUND.format(run=2))
register("run_documents",
         f"SELECT 'run-2' AS run_id, 'mode 2' AS run_mode, source_path, display_path, file_hash, status, process_id, roles, ordinal FROM ({_DONE})")(
    lambda spark, folder: runs.read_latest_run(spark, written_runs(spark, folder)).select(
        "run_id", "run_mode", "source_path", "display_path", "file_hash", "status", "process_id", "roles", "ordinal"))
register("run_candidates",
         f"SELECT 'run-2' AS run_id, source_path, file_hash, cmdb_id, application_name, score, position, ordinal FROM ({_FOUND})")(
    lambda spark, folder: runs.read_latest_candidates(spark, written_runs(spark, folder)).select(
        "run_id", "source_path", "file_hash", "cmdb_id", "application_name", "score", "position", "ordinal"))
register("run_list",
         f"SELECT 'run-' || r AS run_id, 'mode ' || r AS run_mode, (SELECT count(*) FROM orders WHERE o_orderkey % p <> 0) AS documents, "
         "(SELECT count(*) FROM lineitem WHERE l_linenumber > r) AS candidates FROM (VALUES (1, 5), (2, 7), (3, 3)) v(r, p)")(
    lambda spark, folder: runs.read_runs(spark, written_runs(spark, folder)).drop("finished_at"))
register("last_selection",
         f"SELECT DISTINCT source_path, coalesce(display_path, source_path) AS display_path, 'mode 2' AS run_mode FROM ({_DONE})")(
    lambda spark, folder: runs.last_import_selection(spark, written_runs(spark, folder)))


def streamed(spark, folder):
    """The documents as a stream of files; a path has several versions, of which each is processed once."""
    path = scratch(spark, "stream")
    rows = table_stream(spark, f"{folder}/documents.parquet", max_files=8).select(
        F.concat_ws("/", "source", "lang", F.col("doc_id") % 50).alias("source_path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("file_hash"), "text")

    def handle(batch, number):
        return batch.select("source_path", "file_hash", F.substring("file_hash", 1, 8).alias("process_id"), F.length("text").cast("long").alias("size"))

    process_stream(rows, f"{path}/checkpoint", f"{path}/table", handle).awaitTermination()
    return spark.read.parquet(f"{path}/table").select("source_path", "file_hash", "process_id", "size")


register("streamed_documents",
         "SELECT DISTINCT concat_ws('/', source, lang, doc_id % 50) AS source_path, sha256(coalesce(text, '')) AS file_hash, sha256(coalesce(text, ''))[1:8] AS process_id, "
         "length(text) AS size FROM documents")(streamed)
