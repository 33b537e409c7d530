"""CSV exports of master data: separator detection, typed files, relation columns, inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estatemap import model
from estatemap.functions import text
from estatemap.functions.naming import base_name, text_or
from estatemap.operators.tables import last_by, require

# Canonical column -> column of the export; callers pass their own names.
DEFAULT_COLUMNS = {
    "id": "id", "name": "name", "entity_type": "entity_type", "server_type": "server_type", "owner_name": "owner_name",
    "runs_on": "runs_on", "uses_interfaces": "uses_interfaces",
}


class MasterDataError(ValueError):
    """A master data file cannot be used."""


def file_heads(spark: SparkSession, path: str, *, recursive: bool = False, glob: str | None = None) -> DataFrame:
    """(path, header, separator) per file that has a line; the header is the first one that is not blank.

    The separator is the one of comma and semicolon that is more frequent in the header, outside of quotes.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = (
        reader.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"),
                                 F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
        .filter((F.col("block") == 0) & (F.trim("value") != "")))
    # A doubled quote ends one quoted part and begins the next; alternatives in a loop would overflow the stack on long headers.
    outside = F.regexp_replace(F.col("header"), '"[^"]*+"', "")
    commas = F.char_length(F.regexp_replace(outside, "[^,]", ""))
    semicolons = F.char_length(F.regexp_replace(outside, "[^;]", ""))
    # A least number per file needs no sorted lines; the lines are read again for the one row of each file that it names.
    first = lines.groupBy("path").agg(F.min("at").alias("at"))
    return (
        lines.join(F.broadcast(first), ["path", "at"]).select("path", F.col("value").alias("header"))
        .withColumn("separator", F.when(semicolons > commas, ";").otherwise(","))
    )


def header_fields(header: Column, separator: Column) -> Column:
    parts = F.split(header, F.concat(F.lit("\\Q"), separator, F.lit("\\E")))
    return F.transform(parts, lambda part: F.regexp_replace(text.strip(part), '^"|"$', ""))


def files_with_columns(spark: SparkSession, root: str, columns: list[str]) -> DataFrame:
    """CSV files below ``root`` whose header has all ``columns``."""
    heads = file_heads(spark, root, recursive=True, glob="*.[cC][sS][vV]")
    wanted = F.array(*[F.lit(name) for name in columns])
    missing = F.array_except(wanted, header_fields(F.col("header"), F.col("separator")))
    return heads.filter(F.size(missing) == 0).select("path", "separator").orderBy("path")


def _exists(spark: SparkSession, path: str) -> bool:
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    return handle.getFileSystem(spark._jsc.hadoopConfiguration()).exists(handle)


def read_master_folder(spark: SparkSession, root: str, id_column: str = "id", name_column: str = "name", *, multi_line: bool = True) -> DataFrame:
    """All-string rows of every export below ``root`` that has both columns, with ``path``.

    Files may have different separators and headers; those that share both are read by one scan. The driver sees the
    paths, as it does when it lists a folder.
    """
    heads = file_heads(spark, root, recursive=True, glob="*.[cC][sS][vV]")
    wanted = F.array(F.lit(id_column), F.lit(name_column))
    usable = heads.filter(F.size(F.array_except(wanted, header_fields(F.col("header"), F.col("separator")))) == 0)
    shapes: dict[tuple[str, str], list[str]] = {}
    for row in usable.collect():
        shapes.setdefault((row.header, row.separator), []).append(row.path)
    parts = []
    for (_, separator), paths in sorted(shapes.items()):
        reader = (spark.read.option("header", "true").option("sep", separator).option("encoding", "UTF-8").option("escape", '"')
                  .option("multiLine", str(multi_line).lower()))
        rows = reader.csv(sorted(paths))
        strings = [F.col(f"`{name}`").cast("string").alias(name) for name in rows.columns]
        parts.append(rows.select(*strings, F.col("_metadata.file_path").alias("path")))
    if not parts:
        raise MasterDataError(f"no export with {id_column} and {name_column} below {root}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_master_csv(spark: SparkSession, path: str, id_column: str = "id", name_column: str = "name", *,
                    multi_line: bool = True) -> DataFrame:
    """All-string rows of one export, with ``line_number``.

    With ``multi_line`` quoted fields may hold line breaks and a file is parsed by one task; without it a large
    file is read in several splits. Line numbers follow the order of the rows in the file and are not gapless.
    """
    if not _exists(spark, path):
        raise MasterDataError(f"master data file not found: {path}")
    head = file_heads(spark, path).first()
    if head is None or not text_of(head["header"]):
        raise MasterDataError(f"master data file has no header: {path}")
    reader = (
        spark.read.option("header", "true").option("sep", head["separator"]).option("encoding", "UTF-8")
        .option("escape", '"').option("multiLine", str(multi_line).lower()))
    rows = reader.csv(path)
    missing = [name for name in (id_column, name_column) if name not in rows.columns]
    if missing:
        raise MasterDataError(f"master data file lacks required columns: {', '.join(missing)}")
    strings = [F.col(f"`{name}`").cast("string").alias(name) for name in rows.columns]
    return rows.select(*strings, (F.monotonically_increasing_id() + 2).alias("line_number"))


def text_of(value: str | None) -> str:
    return (value or "").strip()


def rename_columns(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Canonical names for the export's columns; absent optional columns become null."""
    present = set(rows.columns)
    named = [
        (F.col(f"`{source}`") if source in present else F.lit(None).cast("string")).alias(target)
        for target, source in columns.items()
    ]
    rest = [F.col(f"`{name}`") for name in rows.columns if name not in columns.values() and name not in columns]
    return rows.select(*named, *rest)


def raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_number, value) of text files, line 1 being the header.

    Lines are counted per file split; a running sum over the splits of a file, of which there are few,
    gives each split its first number.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("_at"), "value")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    offsets = blocks.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return lines.join(offsets, ["file", "block"]).select(
        "file", (F.col("_offset") + F.col("_at") - F.col("_first") + 1).alias("line_number"), "value")


def read_master_types(spark: SparkSession, files: dict[str, str], columns: dict[str, str] | None = None, *,
                      separator: str = "|", strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities, relations and issues of one file per entity type.

    Missing files are skipped. The type comes from the file; relation columns count only in the
    application file. Of rows with one id the last wins, earlier ones are reported. A row without id or
    name raises in strict mode.
    """
    columns = {**DEFAULT_COLUMNS, **(columns or {})}
    parts = []
    for position, (kind, path) in enumerate(files.items()):
        if not _exists(spark, path):
            continue
        rows = rename_columns(read_master_csv(spark, path, columns["id"], columns["name"]), columns)
        parts.append(rows.select(
            F.lit(kind).alias("entity_type"), F.lit(position).alias("file_order"), "line_number",
            text_or(text.strip(F.col("id"))).alias("entity_id"), text_or(text.strip(F.col("name"))).alias("name"),
            text.server_type(F.col("server_type")).alias("server_type"),
            text.optional(F.col("owner_name")).alias("owner_name"), "runs_on", "uses_interfaces"))
    if not parts:
        empty = spark.createDataFrame([], "entity_id string, name string, entity_type string, server_type string, "
                                          "owner_name string, line_number long")
        return (empty, spark.createDataFrame([], "source_id string, relation_type string, target_id string"),
                spark.createDataFrame([], "entity_type string, line_number long, entity_id string, code string"))
    rows = reduce(DataFrame.unionByName, parts)
    broken = rows.filter((F.col("entity_id") == "") | (F.col("name") == ""))
    bad_server = (F.col("entity_type") == "server") & F.col("server_type").isNotNull() & ~F.col("server_type").isin(
        *model.SERVER_TYPES)
    if strict:
        require(broken, "a master data file has a row without id or name")
        require(rows.filter(bad_server), "a master data file has an unknown server type")
    good = rows.filter((F.col("entity_id") != "") & (F.col("name") != "") & ~F.coalesce(bad_server, F.lit(False)))
    latest = good.groupBy("entity_type", "entity_id").agg(F.max("line_number").alias("_last"))
    repeated = good.join(latest, ["entity_type", "entity_id"]).filter(F.col("line_number") < F.col("_last"))
    issues = reduce(DataFrame.unionByName, [
        broken.select("entity_type", "line_number", "entity_id", F.when(F.col("entity_id") == "", "id_missing")
                      .otherwise("name_missing").alias("code")),
        rows.filter(bad_server).select("entity_type", "line_number", "entity_id", F.lit("unknown_server_type").alias("code")),
        repeated.select("entity_type", "line_number", "entity_id", F.lit("duplicate_id").alias("code")),
    ])
    entities = last_by(
        good.select("entity_id", "name", "entity_type", "server_type", "owner_name", "line_number"),
        ["entity_type", "entity_id"], [F.col("line_number")])
    relations = relation_columns(good.filter(F.col("entity_type") == "application"), separator)
    return entities, relations, issues


def relation_columns(rows: DataFrame, separator: str = "|", id_column: str = "entity_id") -> DataFrame:
    """Multi-value columns of application rows as (source_id, relation_type, target_id); columns may be absent."""
    entries = [
        F.struct(F.lit(rel).alias("relation_type"), text.list_items(F.col(column), separator).alias("targets"))
        for column, rel in (("runs_on", "RUNS_ON"), ("uses_interfaces", "USES_INTERFACE")) if column in rows.columns
    ]
    if not entries:
        return rows.select(F.col(id_column).alias("source_id"), F.lit("").alias("relation_type"),
                           F.lit("").alias("target_id")).limit(0)
    lists = rows.select(F.col(id_column).alias("source_id"), F.explode(F.array(*entries)).alias("e"))
    return lists.select("source_id", F.col("e.relation_type").alias("relation_type"), F.explode("e.targets").alias("target_id"))


def all_master_rows(spark: SparkSession, files: dict[str, str], columns: dict[str, str] | None = None) -> DataFrame | None:
    """Raw rows of every readable type file; unreadable files count as empty."""
    columns = {**DEFAULT_COLUMNS, **(columns or {})}
    parts = []
    for position, path in enumerate(files.values()):
        try:
            rows = read_master_csv(spark, path, columns["id"], columns["name"])
        except MasterDataError:
            continue
        parts.append(rename_columns(rows, columns).withColumn("file_order", F.lit(position)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else None


def application_rows(spark: SparkSession, files: dict[str, str], columns: dict[str, str] | None = None) -> DataFrame | None:
    return all_master_rows(spark, {"application": files["application"]}, columns) if "application" in files else None


def as_master(rows: DataFrame) -> DataFrame:
    """Raw rows in the shape the matching reads: cmdb_id, name, entity_type when the files carry it, ordinal."""
    columns = [F.col("id").alias("cmdb_id"), text_or(F.col("name")).alias("name")]
    if "entity_type" in rows.columns:
        columns.append(F.col("entity_type"))
    order = F.coalesce(F.col("file_order"), F.lit(0)).cast("long") if "file_order" in rows.columns else F.lit(0).cast("long")
    return rows.select(*columns, (order * F.lit(1 << 48) + F.col("line_number")).alias("ordinal"))


# Mixed files -----------------------------------------------------------------------------------------

def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """Mixed entity file; the last row of an id wins."""
    rows = read_master_csv(spark, path)
    typed = rows.select(*[text_or(text.strip(F.col(name))).alias(alias) for name, alias in (
        ("id", "source_id"), ("name", "name"), ("entity_type", "entity_type"), ("owner_name", "owner_name"),
        ("server_type", "server_type"))], "line_number")
    return last_by(typed, ["source_id"], [F.col("line_number")])


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    rows = read_master_csv(spark, path, "source_id", "target_id")
    return rows.select(*[text.strip(F.col(name)).alias(name) for name in ("source_id", "relation_type", "target_id")])


def read_inventory(spark: SparkSession, path: str, texts: DataFrame) -> DataFrame:
    """Process inventory with the text of each process.

    ``texts`` has path and text. The declared file name counts; otherwise the first file, by path, that
    starts with the process id. A process without any text file is an error.
    """
    rows = read_master_csv(spark, path, "process_id", "process_name")
    records = rows.select(
        *[text_or(text.strip(F.col(name))).alias(name) for name in (
            "process_id", "process_name", "department", "role", "owner", "txt_file")],
        text.list_items(F.col("mentioned_applications")).alias("mentioned_applications"), "line_number")
    files = texts.select("path", "text", base_name(F.col("path")).alias("file"))
    declared = files.select(F.col("file").alias("txt_file"), F.col("path").alias("_declared"))
    # Every start of the file name that ends before an underscore may be the id.
    pieces = F.split(F.lower("file"), "_")
    starts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), lambda n: F.array_join(F.slice(pieces, 1, n), "_"))
    prefixed = (files.filter(F.contains("file", F.lit("_"))).select("path", F.explode(starts).alias("_id"))
                .groupBy("_id").agg(F.min("path").alias("_guess")))
    placed = (
        records.join(declared, "txt_file", "left")
        .join(prefixed, F.lower("process_id") == F.col("_id"), "left")
        .withColumn("path", F.coalesce("_declared", "_guess"))
    )
    require(placed.filter(F.col("path").isNull()), "a process of the inventory has no text file")
    return placed.drop("txt_file", "_declared", "_guess", "_id").join(files, "path").select(
        "process_id", "process_name", "department", "role", "owner", "mentioned_applications",
        F.col("file").alias("txt_file"), text.documentation_section(F.col("text")).alias("documentation"), "line_number")
