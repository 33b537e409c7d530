"""The property graph as tables, and its versioned storage."""

from __future__ import annotations

from datetime import datetime, timezone
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatemap import model

TABLE_SCHEMAS = {
    "nodes": model.NODE_SCHEMA,
    "edges": model.EDGE_SCHEMA,
    "aliases": model.ALIAS_SCHEMA,
    "alias_edges": model.ALIAS_EDGE_SCHEMA,
    "rejections": model.REJECTION_SCHEMA,
    "candidates": model.CANDIDATE_SCHEMA,
    "candidate_sources": model.CANDIDATE_SOURCE_SCHEMA,
    "decisions": model.DECISION_SCHEMA,
    "merge_states": model.MERGE_STATE_SCHEMA,
    "queue_events": model.QUEUE_EVENT_SCHEMA,
    "queue_evidence": model.QUEUE_EVIDENCE_SCHEMA,
}
PARTITION_COLUMN = {"nodes": "label", "edges": "rel_type"}


class Graph:
    """Node and edge tables plus the operational tables around them.

    Changed labels and relationship types are kept as parts beside the base tables. A step that touches
    one label then neither rewrites nor re-plans the others, and the plan of a long sequence of steps
    stays as small as the parts it really changed.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, *, node_parts: dict[str, DataFrame] | None = None,
                 edge_parts: dict[str, DataFrame] | None = None, **tables: DataFrame) -> None:
        self._nodes = nodes
        self._edges = edges
        self._node_parts = dict(node_parts or {})
        self._edge_parts = dict(edge_parts or {})
        spark = nodes.sparkSession
        for name, schema in TABLE_SCHEMAS.items():
            if name not in ("nodes", "edges"):
                given = tables.get(name)
                setattr(self, name, given if given is not None else model.empty(spark, schema))

    @staticmethod
    def empty(spark: SparkSession) -> Graph:
        return Graph(model.empty(spark, model.NODE_SCHEMA), model.empty(spark, model.EDGE_SCHEMA))

    @staticmethod
    def _whole(base: DataFrame, key: str, parts: dict[str, DataFrame]) -> DataFrame:
        result = base.filter(~F.col(key).isin(*parts)) if parts else base
        # One table may stand for several types; it enters the union once.
        for part in {id(part): part for part in parts.values()}.values():
            result = result.unionByName(part)
        return result

    @property
    def nodes(self) -> DataFrame:
        return self._whole(self._nodes, "label", self._node_parts)

    @property
    def edges(self) -> DataFrame:
        return self._whole(self._edges, "rel_type", self._edge_parts)

    def with_(self, **tables: DataFrame) -> Graph:
        """The graph with whole tables exchanged."""
        named = {name: tables.get(name, getattr(self, name)) for name in TABLE_SCHEMAS if name not in ("nodes", "edges")}
        return Graph(
            tables.get("nodes", self._nodes), tables.get("edges", self._edges),
            node_parts=None if "nodes" in tables else self._node_parts,
            edge_parts=None if "edges" in tables else self._edge_parts, **named)

    def with_label(self, label: str, nodes: DataFrame) -> Graph:
        """The graph with the nodes of one label exchanged."""
        result = self.with_()
        result._node_parts[label] = nodes
        return result

    def with_types(self, types: list[str], edges: DataFrame) -> Graph:
        """The graph with the edges of some types exchanged; ``edges`` holds no other type."""
        result = self.with_()
        result._edge_parts.update({rel_type: edges for rel_type in types})
        return result

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in TABLE_SCHEMAS}

    def label(self, label: str) -> DataFrame:
        if label in self._node_parts:
            return self._node_parts[label]
        return self._nodes.filter(F.col("label") == label)

    def relation(self, rel_type: str, src_label: str | None = None, dst_label: str | None = None) -> DataFrame:
        edges = self._edge_parts.get(rel_type, self._edges).filter(F.col("rel_type") == rel_type)
        if src_label:
            edges = edges.filter(F.col("src_label") == src_label)
        if dst_label:
            edges = edges.filter(F.col("dst_label") == dst_label)
        return edges


def fingerprint(df: DataFrame) -> list[Column]:
    """Row count and order-free checksum as aggregate columns; maps enter as sorted entries.

    The 64-bit row hashes are combined by xor and by sum, so that a row stored twice is seen too.
    """
    parts = []
    for field in df.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, T.MapType):
            column = F.array_sort(F.map_entries(column))
        parts.append(F.coalesce(column.isNull().cast("int"), F.lit(0)))
        parts.append(column)
    row_hash = F.xxhash64(*parts)
    return [
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.bit_xor(row_hash), F.lit(0)).alias("checksum_xor"),
        F.coalesce(F.sum(F.pmod(row_hash, F.lit(1_000_003))), F.lit(0)).alias("checksum_sum"),
    ]


_MANIFEST = ("version long, table string, path string, row_count long, checksum_xor long, checksum_sum long, "
             "file_count long, file_checksum long, created_at string, trigger string, operation string, schema_version int, "
             "is_snapshot boolean")
SCHEMA_VERSION = 3
#: Snapshots that retention keeps.
KEPT_SNAPSHOTS = 10


class GraphStore:
    """Immutable table versions below one root folder.

    A commit writes only the tables given to it, each into a folder of its own, and then appends its
    manifest rows in one small file; readers follow the newest manifest version. A failed or repeated
    task attempt can therefore never change a version somebody reads. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def _exists(self, path: str) -> bool:
        handle = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return handle.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(handle)

    def manifest(self) -> DataFrame:
        """Every (version, table) that was committed and not pruned."""
        path, pruned = f"{self.root}/manifest", f"{self.root}/pruned"
        if not self._exists(path):
            return self.spark.createDataFrame([], _MANIFEST)
        rows = self.spark.read.schema(_MANIFEST).parquet(path)
        if not self._exists(pruned):
            return rows
        return rows.join(self.spark.read.schema("version long").parquet(pruned), "version", "left_anti")

    def _files(self, path: str) -> dict[str, int]:
        """Number of files of a table folder, whatever their folder below it, and a checksum of their names and sizes."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
            F.substring_index("path", path, -1).alias("name"), "length")
        return files.agg(
            F.count(F.lit(1)).alias("file_count"),
            F.coalesce(F.sum(F.pmod(F.xxhash64("name", "length"), F.lit(1_000_003))), F.lit(0)).alias("file_checksum")).first().asDict()

    def latest_version(self) -> int:
        return self.manifest().agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def commit(self, tables: dict[str, DataFrame], *, trigger: str, operation: str, is_snapshot: bool = False,
               created_at: str | None = None) -> int:
        """Write ``tables`` as the next version; tables left out stay as they are."""
        previous = {row["table"]: row.asDict() for row in self._entries(self.latest_version())}
        version = max((row["version"] for row in previous.values()), default=0) + 1
        created = created_at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        rows = []
        for name, schema in TABLE_SCHEMAS.items():
            if name in tables:
                path = f"{self.root}/tables/{name}/{version:08d}_{uuid4().hex[:8]}"
                if name in PARTITION_COLUMN:
                    # Rebalancing keeps files large and still splits a label that holds most rows.
                    table = tables[name].hint("rebalance", PARTITION_COLUMN[name])
                    writer = table.write.partitionBy(PARTITION_COLUMN[name])
                else:
                    writer = tables[name].write
                writer.mode("errorifexists").parquet(path)
                stats = self._read(path, name).agg(*fingerprint(model.empty(self.spark, schema))).first()
                entry = {"table": name, "path": path, **stats.asDict(), **self._files(path)}
            elif name in previous:
                entry = previous[name]
            else:
                continue
            rows.append(entry)
        self._append(rows, version, created, trigger, operation, is_snapshot)
        return version

    def _append(self, entries: list[dict], version: int, created: str, trigger: str, operation: str, is_snapshot: bool) -> None:
        rows = [{**entry, "version": version, "created_at": created, "trigger": trigger, "operation": operation,
                 "schema_version": SCHEMA_VERSION, "is_snapshot": is_snapshot} for entry in entries]
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifest")

    def _repeat(self, version: int, *, trigger: str, operation: str, is_snapshot: bool = False) -> int:
        """A new version that points to the files of a stored one; table folders never change, so nothing is copied."""
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        latest = self.latest_version()
        self._append([row.asDict() for row in self._entries(version)], latest + 1, now, trigger, operation, is_snapshot)
        return latest + 1

    def _entries(self, version: int) -> list:
        """At most one row per table name."""
        return self.manifest().filter(F.col("version") == version).collect()

    def _read(self, path: str, name: str) -> DataFrame:
        schema = TABLE_SCHEMAS[name]
        return self.spark.read.schema(schema).parquet(path).select(*schema.names)

    def read(self, version: int | None = None) -> Graph:
        entries = {row["table"]: row for row in self._entries(version or self.latest_version())}
        if not entries:
            if version:
                raise ValueError(f"no version {version} below {self.root}")
            return Graph.empty(self.spark)
        spark = self.spark
        return Graph(**{
            name: self._read(entries[name]["path"], name) if name in entries else model.empty(spark, schema)
            for name, schema in TABLE_SCHEMAS.items()
        })

    def snapshot(self, graph: Graph | None = None, *, trigger: str, operation: str) -> int:
        """A validated version that retention counts: of ``graph``, or of the newest version without copying it."""
        latest = self.latest_version()
        if graph is None and latest:
            version = self._repeat(latest, trigger=trigger, operation=operation, is_snapshot=True)
        else:
            version = self.commit((graph or self.read()).tables(), trigger=trigger, operation=operation, is_snapshot=True)
        issues = self.validate(version)
        if issues:
            raise ValueError(f"snapshot {version} is not valid: {issues}")
        return version

    def validate(self, version: int) -> list[str]:
        """Problems of a stored version: schema version, files, row counts, checksums. Reports, never raises."""
        issues = []
        entries = self._entries(version)
        if not entries:
            return [f"version {version}: manifest missing"]
        for entry in entries:
            name = entry["table"]
            if entry["schema_version"] != SCHEMA_VERSION:
                issues.append(f"{name}: schema version {entry['schema_version']}")
                continue
            if not self._exists(entry["path"]):
                issues.append(f"{name}: files missing")
                continue
            if self._files(entry["path"]) != {key: entry[key] for key in ("file_count", "file_checksum")}:
                issues.append(f"{name}: files differ")
            found = self._read(entry["path"], name).agg(
                *fingerprint(model.empty(self.spark, TABLE_SCHEMAS[name]))).first()
            if found["row_count"] != entry["row_count"]:
                issues.append(f"{name}: row count differs")
            elif (found["checksum_xor"], found["checksum_sum"]) != (entry["checksum_xor"], entry["checksum_sum"]):
                issues.append(f"{name}: checksum differs")
        return issues

    def restore(self, version: int) -> int:
        """Make a stored version current again, after keeping the present state as a snapshot."""
        issues = self.validate(version)
        if issues:
            raise ValueError(f"version {version} cannot be restored: {issues}")
        self.snapshot(trigger="restore", operation=f"pre_restore:{version}")
        restored = self._repeat(version, trigger="restore", operation=f"restore:{version}")
        old = {row["table"]: row["row_count"] for row in self._entries(version)}
        new = {row["table"]: row["row_count"] for row in self._entries(restored)}
        if old != new:
            raise ValueError("restored row counts differ from the stored version")
        return restored

    def versions(self) -> DataFrame:
        """One row per stored version, newest first."""
        counts = {"node_count": "nodes", "relationship_count": "edges"}
        return (
            self.manifest()
            .groupBy("version")
            .agg(
                *[F.max(column).alias(column) for column in ("created_at", "trigger", "operation", "is_snapshot")],
                *[F.max(F.when(F.col("table") == table, F.col("row_count"))).alias(alias)
                  for alias, table in counts.items()],
            )
            .orderBy(F.desc("created_at"), F.desc("version"))
        )

    def prunable(self, keep: int, protected: list[int] | None = None) -> DataFrame:
        """Snapshots beyond the ``keep`` newest that are not protected; the newest version is none of them."""
        snapshots = self.manifest().filter(F.col("is_snapshot")).select("version", "created_at").distinct()
        newest = snapshots.orderBy(F.desc("created_at"), F.desc("version")).limit(max(1, keep))
        old = snapshots.join(newest.select("version"), "version", "left_anti").filter(F.col("version") != self.latest_version())
        return old.filter(~F.col("version").isin(*protected)) if protected else old

    def prune(self, keep: int = KEPT_SNAPSHOTS, protected: list[int] | None = None) -> list[int]:
        """Take the prunable snapshots out of the manifest and delete the table folders that no version points to."""
        gone = sorted(row["version"] for row in self.prunable(keep, protected).collect())
        if not gone:
            return []
        before = {row["path"] for row in self.manifest().select("path").distinct().collect()}
        self.spark.createDataFrame([(version,) for version in gone], "version long").coalesce(1).write.mode("append").parquet(f"{self.root}/pruned")
        after = {row["path"] for row in self.manifest().select("path").distinct().collect()}
        for path in before - after:
            handle = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            handle.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(handle, True)
        return gone
