"""Architecture exchange files (XML) and their mapping configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from estatemap.functions.naming import LANGUAGE_PREFERENCE, base_name, pick_name, strip_type_prefix
from estatemap.functions.scoring import FUZZY_THRESHOLD

_NAME = T.ArrayType(T.StructType([T.StructField("_VALUE", T.StringType()), T.StructField("_xml:lang", T.StringType())]))
ELEMENT_XML = T.StructType([
    T.StructField("_identifier", T.StringType()), T.StructField("_xsi:type", T.StringType()), T.StructField("name", _NAME)])
RELATIONSHIP_XML = T.StructType([
    T.StructField(name, T.StringType()) for name in ("_identifier", "_xsi:type", "_source", "_target")])

# What holds without a mapping file. Element types of an import file and the label each becomes.
ELEMENT_LABELS = (
    ("BusinessProcess", "Process"), ("ApplicationComponent", "Application"), ("ApplicationInterface", "Interface"),
    ("Node", "Server"), ("BusinessActor", "OrgUnit"), ("BusinessRole", "Role"),
)
# Label and the element type it is exported as.
LABEL_ELEMENTS = tuple((label, element_type) for element_type, label in ELEMENT_LABELS)
# Source label, target label and an accepted relationship type of an import file.
ACCEPTED = (
    ("Application", "Process", "Serving"), ("Application", "Process", "Realization"), ("Role", "Process", "Assignment"),
    ("OrgUnit", "Role", "Assignment"), ("Process", "Process", "Triggering"), ("Process", "Process", "Flow"),
    ("Application", "Interface", "Composition"), ("Application", "Interface", "Aggregation"),
    ("Application", "Server", "Realization"), ("Application", "Server", "Assignment"),
    ("Interface", "Server", "Realization"), ("OrgUnit", "Application", "Association"),
    ("OrgUnit", "Application", "Assignment"), ("OrgUnit", "Interface", "Association"),
    ("OrgUnit", "Interface", "Assignment"), ("OrgUnit", "Server", "Association"), ("OrgUnit", "Server", "Assignment"),
    ("OrgUnit", "Process", "Assignment"),
)
# Source label, target label and the relationship type of an export.
EXPORTED = (
    ("Application", "Process", "Serving"), ("Role", "Process", "Assignment"), ("OrgUnit", "Role", "Assignment"),
    ("Process", "Process", "Triggering"), ("Application", "Interface", "Composition"),
    ("Application", "Server", "Realization"), ("Interface", "Server", "Realization"),
    ("OrgUnit", "Application", "Assignment"), ("OrgUnit", "Interface", "Assignment"), ("OrgUnit", "Server", "Assignment"),
    ("OrgUnit", "Process", "Assignment"),
)
# Source label, target label and the relationship type in the graph.
GRAPH_RELATIONS = (
    ("Application", "Process", "SERVES"), ("Role", "Process", "PARTICIPATES_IN"), ("OrgUnit", "Role", "CAN_ASSUME"),
    ("Process", "Process", "FOLLOWS"), ("Application", "Interface", "USES_INTERFACE"), ("Application", "Server", "RUNS_ON"),
    ("Interface", "Server", "RUNS_ON"), ("OrgUnit", "Application", "RESPONSIBLE_FOR"),
    ("OrgUnit", "Interface", "RESPONSIBLE_FOR"), ("OrgUnit", "Server", "RESPONSIBLE_FOR"),
    ("OrgUnit", "Process", "RESPONSIBLE_FOR"),
)


@dataclass(frozen=True)
class Mapping:
    """Mapping dimensions; each has at most a few dozen rows and may be broadcast."""

    element_labels: DataFrame      # element_type, label
    ignored: DataFrame             # element_type
    label_elements: DataFrame      # label, element_type
    accepted: DataFrame            # src_label, dst_label, relation_type
    export_relations: DataFrame    # src_label, dst_label, relation_type
    graph_relations: DataFrame     # src_label, dst_label, rel_type
    association: str = "ASSOCIATED_WITH"
    threshold: float = FUZZY_THRESHOLD
    languages: tuple[str, ...] = LANGUAGE_PREFERENCE


def default_mapping(spark: SparkSession) -> Mapping:
    """What holds without a mapping file; no element type is ignored silently."""
    pair = "src_label string, dst_label string"
    return Mapping(
        spark.createDataFrame(ELEMENT_LABELS, "element_type string, label string"),
        spark.createDataFrame([], "element_type string"),
        spark.createDataFrame(LABEL_ELEMENTS, "label string, element_type string"),
        spark.createDataFrame(ACCEPTED, f"{pair}, relation_type string"),
        spark.createDataFrame(EXPORTED, f"{pair}, relation_type string"),
        spark.createDataFrame(GRAPH_RELATIONS, f"{pair}, rel_type string"),
    )


def read_mapping(spark: SparkSession, path: str, relation_key: str = "graph_relation") -> Mapping:
    """Mapping dimensions from a JSON configuration; the defaults when the file is missing.

    ``relation_key`` names the object that maps label pairs to graph relations, and the
    ``association_<relation_key>`` entry beside it.
    """
    handle = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not handle.getFileSystem(spark._jsc.hadoopConfiguration()).exists(handle):
        return default_mapping(spark)
    strings, lists = "map<string,string>", "map<string,array<string>>"
    schema = (
        f"language_preference array<string>, fuzzy_match_threshold double, "
        f"elements struct<`import`:{strings},`export`:{strings},`ignore`:array<string>>, "
        f"relationships struct<`import`:{lists},`export`:{strings},`{relation_key}`:{strings},"
        f"`association_{relation_key}`:string>")
    config = spark.read.schema(schema).option("multiLine", "true").json(path)
    scalars = config.select(
        "language_preference", "fuzzy_match_threshold",
        F.col(f"relationships.association_{relation_key}").alias("association")).first()

    def entries(column: str, key: str, value: str) -> DataFrame:
        return config.select(F.explode(column).alias(key, value))

    def pairs(column: str, value: str) -> DataFrame:
        split = F.split("pair", "->")
        return entries(column, "pair", value).select(split[0].alias("src_label"), split[1].alias("dst_label"), value)

    accepted = pairs("relationships.import", "kinds").select("src_label", "dst_label", F.explode("kinds").alias("relation_type"))
    return Mapping(
        entries("elements.import", "element_type", "label"),
        config.select(F.explode("elements.ignore").alias("element_type")),
        entries("elements.export", "label", "element_type"),
        accepted,
        pairs("relationships.export", "relation_type"),
        pairs(f"relationships.{relation_key}", "rel_type"),
        scalars["association"] or "ASSOCIATED_WITH",
        scalars["fuzzy_match_threshold"] if scalars["fuzzy_match_threshold"] is not None else FUZZY_THRESHOLD,
        tuple(scalars["language_preference"] or LANGUAGE_PREFERENCE),
    )


def exchange_version(spark: SparkSession, path: str) -> DataFrame:
    """(path, version) per file: 3.1 when the root namespace says so, else 3.0."""
    # The root element stands in the file's first lines; later splits are not read.
    first = (spark.read.text(path).filter(F.col("_metadata.file_block_start") == 0)
             .select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at"))
             .filter(F.col("value").rlike(r"<(?:[A-Za-z_][\w.-]*:)?model(?:\s|>|$)|xmlns")))
    heads = first.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda line: line["value"]), "\n").alias("head"))
    head = F.col("head")
    prefix = F.regexp_extract(head, r"<(?:([A-Za-z_][\w.-]*):)?model[\s>]", 1)
    namespace = F.when(prefix == "", F.regexp_extract(head, r"""\sxmlns\s*=\s*["']([^"']*)["']""", 1)).otherwise(
        F.regexp_extract(head, r"""\sxmlns:[A-Za-z_][\w.-]*\s*=\s*["'](http://www\.opengroup\.org/xsd/archimate/[^"']*)["']""", 1))
    return heads.select(
        "path", F.when(F.contains(namespace, F.lit("/archimate/3.1/")), "3.1").otherwise("3.0").alias("version"))


def elements_from(rows: DataFrame, languages: tuple[str, ...] = LANGUAGE_PREFERENCE) -> DataFrame:
    """Typed elements of parsed element records; those without id or name are dropped."""
    names = F.transform("name", lambda name: F.struct(name["_VALUE"].alias("text"), name["_xml:lang"].alias("lang")))
    return rows.select(
        F.coalesce("_identifier", F.lit("")).alias("archimate_id"),
        strip_type_prefix(F.col("`_xsi:type`")).alias("archimate_type"),
        pick_name(names, languages).alias("name"), "archimate_source", "ordinal",
    ).filter((F.col("archimate_id") != "") & (F.col("name") != ""))


def read_exchange(spark: SparkSession, path: str, languages: tuple[str, ...] = LANGUAGE_PREFERENCE) -> tuple[DataFrame, DataFrame]:
    """Elements and relationships of exchange files; rows without their required attributes are dropped."""
    def records(tag: str, schema: T.StructType) -> DataFrame:
        reader = spark.read.format("xml").option("rowTag", tag).option("mode", "FAILFAST").schema(schema)
        return reader.load(path).select(
            "*", base_name(F.col("_metadata.file_path")).alias("archimate_source"),
            F.monotonically_increasing_id().alias("ordinal"))

    relationships = records("relationship", RELATIONSHIP_XML).select(
        F.col("_identifier").alias("archimate_id"), strip_type_prefix(F.col("`_xsi:type`")).alias("archimate_rel_type"),
        F.col("_source").alias("source_archimate_id"), F.col("_target").alias("target_archimate_id"),
        "archimate_source", "ordinal")
    required = ("archimate_id", "archimate_rel_type", "source_archimate_id", "target_archimate_id")
    complete = F.lit(True)
    for name in required:
        complete = complete & (F.coalesce(name, F.lit("")) != "")
    return elements_from(records("element", ELEMENT_XML), languages), relationships.filter(complete)


def write_exchange(elements: DataFrame, relations: DataFrame, path: str, compression: str | None = None) -> None:
    """Element and relationship records as XML part files below ``path``, plain or in a ``compression`` that readers know by the file name."""
    space = 'xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance"'

    def save(records: DataFrame, root: str, row: str) -> None:
        # Name validation would refuse the colon of prefixed attributes.
        records.write.format("xml").option("rootTag", f"{root} {space}").option("rowTag", row).option(
            "validateName", "false").option("compression", compression or "none").save(f"{path}/{root}")

    save(elements.select(
        F.col("identifier").alias("_identifier"), F.col("element_type").alias("_xsi:type"),
        F.struct(F.col("name").alias("_VALUE"), F.lit("de").alias("_xml:lang")).alias("name")), "elements", "element")
    save(relations.select(
        F.col("identifier").alias("_identifier"), F.col("relation_type").alias("_xsi:type"),
        F.col("source").alias("_source"), F.col("target").alias("_target")), "relationships", "relationship")
