"""Inbox folder as a file stream: every new document is processed once, then archived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from estatemap.sources.documents import SUFFIXES, changed_documents
from estatemap.sources.runs import known_documents, put_partition

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def inbox_stream(spark: SparkSession, inbox: str, archive: str | None = None, *, max_files: int | None = None) -> DataFrame:
    """Documents as they arrive: path, content, file_hash.

    With ``archive`` Spark moves a file there after a later batch has completed, never before its own
    batch is committed.
    """
    reader = spark.readStream.format("binaryFile").schema(_BINARY).option("recursiveFileLookup", "true")
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1))
    return reader.load(inbox).filter(suffix.isin(*SUFFIXES)).select(
        F.col("path").alias("source_path"), "content", F.sha2("content", 256).alias("file_hash"))


def batch_name(number: int) -> str:
    return f"batch-{number:012d}"


def process_stream(stream: DataFrame, checkpoint: str, table: str, handle: Callable[[DataFrame, int], DataFrame]) -> StreamingQuery:
    """Run ``handle`` on the new documents of each batch; its rows become the batch's partition of ``table``.

    ``stream`` has ``source_path, file_hash`` and whatever ``handle`` reads. ``handle`` gets each (path, hash) once that no
    earlier batch had, and returns rows with ``source_path, file_hash, process_id``. These
    rows are the import state as well, so result and state are committed by one write. A batch that is repeated after
    a failure looks at earlier batches only and exchanges its own partition: its rows are there once, whatever broke off.
    """
    def batch(documents: DataFrame, number: int) -> None:
        session, name = documents.sparkSession, batch_name(number)
        known = known_documents(session, table, name)
        fresh = changed_documents(documents.dropDuplicates(["source_path", "file_hash"]), known)
        put_partition(handle(fresh, number).withColumn("finished_at", F.current_timestamp()), table, "run_id", name)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_inbox(spark: SparkSession, inbox: str, checkpoint: str, table: str,
                  handle: Callable[[DataFrame, int], DataFrame], *, archive: str | None = None,
                  max_files: int | None = None) -> StreamingQuery:
    """``process_stream`` on the documents of an inbox folder."""
    return process_stream(inbox_stream(spark, inbox, archive, max_files=max_files), checkpoint, table, handle)


def table_stream(spark: SparkSession, path: str, *, max_files: int | None = None) -> DataFrame:
    """The Parquet files at ``path`` (a file, a folder or a pattern) as they arrive."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    # A pattern, since a stream does not take the path of a single file.
    return reader.parquet(path if "*" in path else f"{path}*")
