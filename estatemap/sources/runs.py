"""Run artifacts and import state as partitioned tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatemap import model

_MATCH = T.StructType([
    T.StructField(name, T.StringType()) for name in ("application_name", "cmdb_id", "matched_name", "confidence", "source")
] + [T.StructField("score", T.DoubleType())])
_STRINGS = T.ArrayType(T.StringType())
_REFERENCES = T.ArrayType(model.APPLICATION_REF)

DOCUMENT_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in (
        "run_id", "source_path", "display_path", "file_hash", "status", "error_message", "process_id",
        "process_name", "org_unit", "process_owner_candidate", "process_owner_candidate_status", "process_write_action")]
    + [T.StructField(name, _STRINGS) for name in ("roles", "org_units", "org_unit_candidates", "follows_after")]
    + [T.StructField(name, _REFERENCES) for name in ("raw_applications", "applications")]
    + [T.StructField("ordinal", T.LongType())])
#: One row per match of a document, in the order of position and ordinal.
CANDIDATE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in ("run_id", "source_path", "file_hash", "process_id", "process")]
    + [T.StructField("position", T.LongType()), *_MATCH.fields, T.StructField("ordinal", T.LongType())])
RUN_SCHEMA = "run_id string, run_mode string, finished_at timestamp, documents long, candidates long"
STATE_SCHEMA = "run_id string, source_path string, file_hash string, process_id string, finished_at timestamp"


def _exists(spark: SparkSession, path: str) -> bool:
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle.getFileSystem(spark._jsc.hadoopConfiguration()).exists(handle)


def put_partition(rows: DataFrame, path: str, key: str, value: str) -> int:
    """Exchange the partition ``key = value`` of the table at ``path``; returns the number of rows, counted as they are written."""
    counted = Observation()
    (rows.drop(key).observe(counted, F.count(F.lit(1)).alias("n")).withColumn(key, F.lit(value))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path))
    return counted.get["n"]


def _shaped(rows: DataFrame, schema: T.StructType) -> DataFrame:
    present = set(rows.columns)
    return rows.select(*[(F.col(field.name) if field.name in present else F.lit(None)).cast(field.dataType).alias(field.name) for field in schema])


def write_run(documents: DataFrame, matches: DataFrame, path: str, run_id: str, run_mode: str, finished_at: str) -> None:
    """Write one run: its documents, its match rows, then the row that makes it visible.

    A run that is written again exchanges its partitions. Readers know runs by the table ``runs`` only, so they see
    whole runs; one that broke off is not among them and is overwritten by its repetition.
    """
    spark = documents.sparkSession
    n = put_partition(_shaped(documents, DOCUMENT_SCHEMA), f"{path}/documents", "run_id", run_id)
    m = put_partition(_shaped(matches, CANDIDATE_SCHEMA), f"{path}/candidates", "run_id", run_id)
    run = spark.createDataFrame([(run_id, run_mode, n, m)], "run_id string, run_mode string, documents long, candidates long")
    put_partition(run.withColumn("finished_at", F.lit(finished_at).cast("timestamp")).coalesce(1), f"{path}/runs", "run_id", run_id)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, run_mode, finished_at, documents, candidates`` of every finished run."""
    if not _exists(spark, f"{path}/runs"):
        return spark.createDataFrame([], RUN_SCHEMA)
    return spark.read.schema(RUN_SCHEMA).parquet(f"{path}/runs")


def _latest(spark: SparkSession, path: str, name: str, schema: T.StructType) -> DataFrame:
    run = read_runs(spark, path).agg(F.max_by(F.struct("run_id", "run_mode", F.col(name).alias("n")), F.struct("finished_at", "run_id")).alias("run")).first().run
    if run is None or not run.n:  # nothing was written, what lies in the partition is older
        return spark.createDataFrame([], schema).withColumn("run_mode", F.lit(None).cast("string"))
    rows = spark.read.schema(schema).parquet(f"{path}/{name}").filter(F.col("run_id") == F.lit(run.run_id))
    return rows.select(*schema.names, F.lit(run.run_mode).alias("run_mode"))


def read_latest_run(spark: SparkSession, path: str) -> DataFrame:
    """Documents of the run that finished last; other partitions are not read."""
    return _latest(spark, path, "documents", DOCUMENT_SCHEMA)


def read_latest_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Match rows of the run that finished last; other partitions are not read."""
    return _latest(spark, path, "candidates", CANDIDATE_SCHEMA).drop("run_mode")


def last_import_selection(spark: SparkSession, path: str) -> DataFrame:
    """Source and display paths and the mode of the last run."""
    return read_latest_run(spark, path).select(
        "source_path", F.coalesce("display_path", "source_path").alias("display_path"), "run_mode").distinct()


def import_state(documents: DataFrame) -> DataFrame:
    return documents.select("source_path", "file_hash", F.coalesce("process_id", F.lit("")).alias("process_id"))


def write_import_state(documents: DataFrame, path: str, run_id: str, finished_at: str) -> None:
    """The state rows of one run; writing them again exchanges them."""
    put_partition(import_state(documents).withColumn("finished_at", F.lit(finished_at).cast("timestamp")), path, "run_id", run_id)


def read_import_state(spark: SparkSession, path: str) -> DataFrame:
    """Latest known hash per source path."""
    if not _exists(spark, path):
        return spark.createDataFrame([], STATE_SCHEMA).select("source_path", "file_hash", "process_id")
    rows = spark.read.schema(STATE_SCHEMA).parquet(path)
    return rows.groupBy("source_path").agg(
        F.max_by(F.struct("file_hash", "process_id"), F.struct("finished_at", "run_id")).alias("s")).select("source_path", "s.*")


def known_documents(spark: SparkSession, path: str, before: str) -> DataFrame:
    """Every (source_path, file_hash) of the runs with an id smaller than ``before``."""
    if not _exists(spark, path):
        return spark.createDataFrame([], STATE_SCHEMA).select("source_path", "file_hash")
    return spark.read.schema(STATE_SCHEMA).parquet(path).filter(F.col("run_id") < before).select("source_path", "file_hash")
