"""Validation and data-quality checks. Findings are rows; strict callers raise on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatemap import model
from estatemap.functions import text
from estatemap.graph import Graph
from estatemap.operators.tables import first_by, require

# Known types of the exchange format.
ELEMENT_TYPES = (
    "ApplicationCollaboration", "ApplicationComponent", "ApplicationEvent", "ApplicationFunction",
    "ApplicationInteraction", "ApplicationInterface", "ApplicationProcess", "ApplicationService", "Artifact",
    "Assessment", "BusinessActor", "BusinessCollaboration", "BusinessEvent", "BusinessFunction",
    "BusinessInteraction", "BusinessInterface", "BusinessObject", "BusinessProcess", "BusinessRole",
    "BusinessService", "Capability", "CommunicationNetwork", "Constraint", "Contract", "CourseOfAction",
    "DataObject", "Device", "Driver", "Goal", "Grouping", "Location", "Meaning", "Node", "Outcome", "Path",
    "Principle", "Product", "Representation", "Requirement", "Resource", "Risk", "Stakeholder", "SystemSoftware",
    "TechnologyCollaboration", "TechnologyEvent", "TechnologyFunction", "TechnologyInteraction",
    "TechnologyInterface", "TechnologyProcess", "TechnologyService", "Value", "ValueStream",
)
RELATIONSHIP_TYPES = (
    "Association", "Assignment", "Aggregation", "Composition", "Realization", "Serving", "Access", "Influence",
    "Triggering", "Flow", "Specialization",
)

RESULT_ROWS = 500
RESULT_CHARACTERS = 100_000


def field_count(line: Column, separator: str) -> Column:
    """Fields of one CSV line; separators inside double quotes do not count."""
    unquoted = F.regexp_replace(line, '"(?:[^"]|"")*"', "")
    return F.size(F.split(unquoted, "\\Q" + separator + "\\E", -1))


def csv_shape_issues(lines: DataFrame, separator: str) -> DataFrame:
    """Rows with another field count than the header; ``lines`` has file, line_number, value."""
    header = lines.filter(F.col("line_number") == 1).select("file", field_count(F.col("value"), separator).alias("wanted"))
    rows = lines.filter((F.col("line_number") > 1) & (F.col("value") != ""))
    counted = rows.select("file", "line_number", field_count(F.col("value"), separator).alias("found"))
    return (
        counted.join(header, "file").filter(F.col("found") != F.col("wanted"))
        .select("file", "line_number", F.lit("column_count").alias("code"),
                F.format_string("%d statt %d Spalten", "found", "wanted").alias("message"))
    )


def validate_entities(rows: DataFrame, id_column: str = "id", name_column: str = "name",
                      line: str = "line_number") -> DataFrame:
    """First failed check per row: id missing, duplicate id, name missing, unknown type, unknown server type.

    Of several rows with one id the first line is good. It is found by aggregation, so an id that fills
    a third of the file is one row per task in that shuffle.
    """
    ident = text.optional(F.col(id_column))
    prepared = rows.select(
        F.col(line).alias("line_number"),
        ident.alias("_id"),
        text.optional(F.col(name_column)).alias("_name"),
        text.entity_type(_column(rows, "entity_type")).alias("_type"),
        text.server_type(_column(rows, "server_type")).alias("_server"),
    )
    # Rows without id are decided by themselves; together they would be one key of the join.
    without = prepared.filter(F.col("_id").isNull()).select("line_number", F.col("_id").alias("entity_id"), F.lit("id_missing").alias("code"))
    identified = prepared.filter(F.col("_id").isNotNull())
    firsts = identified.groupBy("_id").agg(F.min("line_number").alias("_first"))
    code = (
        F.when(F.col("line_number") > F.col("_first"), "duplicate_id")
        .when(F.col("_name").isNull(), "name_missing")
        .when(~F.col("_type").isin(*model.ENTITY_TYPES), "unknown_type")
        .when((F.col("_type") == "server") & F.col("_server").isNotNull()
              & ~F.col("_server").isin(*model.SERVER_TYPES), "unknown_server_type")
    )
    return (
        identified.join(firsts, "_id").withColumn("code", code).filter(F.col("code").isNotNull())
        .select("line_number", F.col("_id").alias("entity_id"), "code").unionByName(without)
    )


def _column(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def normalize_entities(rows: DataFrame, id_column: str = "id", name_column: str = "name", *, strict: bool = True,
                       line: str = "line_number") -> DataFrame:
    """Typed entities. Strict raises on the first issue; otherwise bad rows are left out."""
    issues = validate_entities(rows, id_column, name_column, line)
    if strict:
        require(issues, "master data rows do not pass validation")
        good = rows
    else:
        good = rows.join(issues.select(F.col("line_number").alias(line)), line, "left_anti")
    raw = F.create_map(*[part for name in rows.columns if name != line for part in (F.lit(name), F.col(name))])
    return good.select(
        text.strip(F.col(id_column)).alias("entity_id"),
        text.strip(F.col(name_column)).alias("name"),
        text.entity_type(_column(rows, "entity_type")).alias("entity_type"),
        text.server_type(_column(rows, "server_type")).alias("server_type"),
        text.optional(_column(rows, "owner_name")).alias("owner_name"),
        raw.alias("raw_row"),
        F.col(line).alias("line_number"),
    )


def decision_issues(decisions: DataFrame, *, confirmed: bool) -> DataFrame:
    """Decision rows without their required fields."""
    wanted = ("process_id", "anwendung_name", "cmdb_id", "quelle") if confirmed else ("process_id", "anwendung_name")
    blank = F.lit(False)
    for name in wanted:
        blank = blank | text.optional(F.col(name)).isNull()
    return decisions.filter(blank)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; rows with a null key part do not count."""
    present = df.select(*keys).dropna()
    return present.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


# Natural key per label.
NATURAL_KEYS = {"Process": "process_id", "Application": "cmdb_id", "Interface": "id", "Server": "id", "OrgUnit": "name"}


def uniqueness_violations(graph: Graph) -> DataFrame:
    """(label, key, copies) for every natural key that is not unique, aliases and candidates included."""
    chain = F
    for label, column in NATURAL_KEYS.items():
        chain = chain.when(F.col("label") == label, F.col(column))
    nodes = graph.nodes.select("label", chain.otherwise(None).alias("key"))
    others = graph.aliases.select(F.lit("Alias").alias("label"), F.col("normalized_name").alias("key")).unionByName(
        graph.candidates.select(F.lit("OrgCandidate").alias("label"), F.col("normalized_name").alias("key")))
    return duplicate_keys(nodes.unionByName(others), ["label", "key"])


def graph_reference_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Structural problems of a graph export as (code, ref) rows."""
    name = "(?U)^[\\p{L}_]\\w*$"
    bad_id = nodes.filter(F.coalesce(F.col("node_id"), F.lit("")) == "").select(
        F.lit("node_id_empty").alias("code"), F.col("name").alias("ref"))
    twice = duplicate_keys(nodes, ["node_id"]).select(F.lit("node_id_duplicate").alias("code"), F.col("node_id").alias("ref"))
    label = nodes.filter(~F.coalesce(F.col("label").rlike(name), F.lit(False))).select(
        F.lit("label_invalid").alias("code"), F.col("node_id").alias("ref"))
    rel = edges.filter(~F.coalesce(F.col("rel_type").rlike(name), F.lit(False))).select(
        F.lit("type_invalid").alias("code"), F.col("src_id").alias("ref"))
    known = nodes.select("node_id")
    ends = [
        edges.join(known, edges[side] == known["node_id"], "left_anti").select(
            F.lit(f"{side}_unknown").alias("code"), F.col(side).alias("ref"))
        for side in ("src_id", "dst_id")
    ]
    result = bad_id
    for part in (twice, label, rel, *ends):
        result = result.unionByName(part)
    return result


def edge_conformance(edges: DataFrame) -> DataFrame:
    """Edge shapes outside the allowed pattern list, with their number.

    The shape is tested against literals, so parts of the edges whose type and labels are constant are
    decided when the plan is made.
    """
    def shape_in(shapes: list[tuple[str, str, str]]) -> Column:
        return F.struct("rel_type", "src_label", "dst_label").isin(*[
            F.struct(*[F.lit(part).alias(name) for name, part in zip(("rel_type", "src_label", "dst_label"), shape)])
            for shape in shapes])

    labels = list(model.LABEL_PROPERTIES)
    known_labels = F.coalesce(F.col("src_label").isin(*labels) & F.col("dst_label").isin(*labels), F.lit(False))
    allowed = [(rel, *pair) for rel, pairs in model.EDGE_PATTERNS.items() for pair in pairs]
    free = F.coalesce(F.col("rel_type").isin(*model.FREE_RELATIONS), F.lit(False)) & known_labels
    code = (
        F.when(~F.coalesce(F.col("rel_type").isin(*model.RELATION_TYPES), F.lit(False)), "unknown_type")
        .when(~known_labels, "unknown_label")
        .otherwise("pair_not_allowed")
    )
    return (
        edges.filter(~shape_in(allowed) & ~free)
        .groupBy("rel_type", "src_label", "dst_label").agg(F.count(F.lit(1)).alias("edge_count"))
        .withColumn("code", code))


def property_conformance(nodes: DataFrame) -> DataFrame:
    """Property keys in ``props`` that the label does not declare, with the number of nodes."""
    allowed = nodes.sparkSession.createDataFrame(
        [(label, key) for label, keys in model.LABEL_PROPERTIES.items() for key in keys], "label string, key string")
    used = nodes.select("label", F.explode(F.map_keys("props")).alias("key")).groupBy("label", "key").agg(
        F.count(F.lit(1)).alias("node_count"))
    return used.join(F.broadcast(allowed), ["label", "key"], "left_anti")


#: Columns of an edge that hold properties; all other properties are in ``props``.
EDGE_PROPERTY_COLUMNS = ("confidence", "source", "raw_name", "score", "source_kind", "archimate_rel_type")


def edge_property_conformance(edges: DataFrame) -> DataFrame:
    """Properties that a relationship type carries without declaring them, with the number of edges.

    Keys are counted per type before they meet the declaration, so only (type, key) rows are compared.
    """
    rows = [(rel_type, key) for rel_type, keys in model.EDGE_PROPERTIES.items() for key in keys]
    allowed = edges.sparkSession.createDataFrame(rows, "rel_type string, key string")
    filled = F.array_compact(F.array(*[F.when(F.col(name).isNotNull(), F.lit(name)) for name in EDGE_PROPERTY_COLUMNS]))
    keys = F.concat(filled, F.coalesce(F.map_keys("props"), F.array().cast("array<string>")))
    used = edges.select("rel_type", F.explode(F.array_distinct(keys)).alias("key")).groupBy("rel_type", "key").agg(
        F.count(F.lit(1)).alias("edge_count"))
    return used.join(F.broadcast(allowed), ["rel_type", "key"], "left_anti")


def unclassified_element_types(spark: SparkSession, imported: list[str], ignored: list[str]) -> DataFrame:
    known = spark.createDataFrame([(kind,) for kind in ELEMENT_TYPES], "element_type string")
    return known.filter(~F.col("element_type").isin(*imported, *ignored)).orderBy("element_type")


def untyped_nodes(nodes: DataFrame, export_types: DataFrame) -> DataFrame:
    """Exportable nodes without a stored element type, with the type the export would use."""
    return (
        nodes.filter(F.col("label").isin(*model.EXPORT_LABELS) & F.col("name").isNotNull()
                     & F.col("archimate_type").isNull())
        .join(F.broadcast(export_types.select("label", F.col("element_type").alias("proposed_type"))), "label")
        .select("label", "name", "proposed_type").orderBy("label", "name")
    )


def status_filter(documents: DataFrame, statuses: list[str] | None = None, paths: DataFrame | None = None) -> DataFrame:
    """Documents with one of the statuses (all when none is given), optionally limited to source paths."""
    chosen = documents.filter(F.col("status").isin(*statuses)) if statuses else documents
    return chosen.join(paths.select("source_path").distinct(), "source_path", "left_semi") if paths is not None else chosen


def within_budget(df: DataFrame, rows: int = RESULT_ROWS, characters: int = RESULT_CHARACTERS) -> DataFrame:
    """``df`` itself when it is small enough to show, else an error; a result is never cut short."""
    probe = df.limit(rows + 1).select(F.length(F.to_json(F.struct(*df.columns))).alias("size"))
    found = probe.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("characters")).first()
    if found["rows"] > rows or found["characters"] > characters:
        raise ValueError(f"result exceeds {rows} rows or {characters} characters; narrow the question")
    return df


def revertable(decisions: DataFrame) -> DataFrame:
    return decisions.filter((F.col("status") == "active") & (F.col("decision_type") != model.AUDIT_TYPE))


def batch_confirmable(rows: DataFrame, term: str = "anwendung_im_prozess", target: str = "cmdb_id") -> DataFrame:
    """One row: may the selected review rows be confirmed together?"""
    summary = rows.agg(
        F.count(F.lit(1)).alias("selected"),
        F.count_distinct(text.batch_key(F.coalesce(F.col(term), F.lit("")))).alias("terms"),
        F.count_distinct(F.col(target)).alias("targets"),
        F.count_if(F.coalesce(F.col(target), F.lit("")) == "").alias("open"),
    )
    valid = (F.col("terms") == 1) & (F.col("targets") == 1) & (F.col("open") == 0)
    state = F.when(F.col("selected") < 2, "none").when(valid, "valid").otherwise("invalid")
    return summary.withColumn("state", state)


def undo_payload_issues(focus: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Problems of a stored before or after state, as (code, ref) rows.

    ``focus`` (node_id) lists the affected nodes; ``nodes`` and ``edges`` carry a ``state`` column.
    """
    empty_id = focus.filter(F.coalesce(F.col("node_id"), F.lit("")) == "").select(
        F.lit("focus_empty").alias("code"), F.col("node_id").alias("ref"))
    twice = duplicate_keys(focus, ["node_id"]).select(F.lit("focus_duplicate").alias("code"), F.col("node_id").alias("ref"))
    outside = nodes.join(focus, "node_id", "left_anti").select(
        F.lit("node_outside_focus").alias("code"), F.col("node_id").alias("ref"))
    repeated = duplicate_keys(nodes, ["state", "node_id"]).select(
        F.lit("node_duplicate").alias("code"), F.col("node_id").alias("ref"))
    ids = focus.select(F.col("node_id").alias("src_id"))
    loose = edges.join(ids, "src_id", "left_anti").join(
        focus.select(F.col("node_id").alias("dst_id")), "dst_id", "left_anti").select(
        F.lit("edge_outside_focus").alias("code"), F.col("src_id").alias("ref"))
    result = empty_id
    for part in (twice, outside, repeated, loose):
        result = result.unionByName(part)
    return result


def find_by_label(rows: DataFrame, label: str, id_column: str = "id", name_column: str = "name") -> DataFrame:
    """The first row (by line) whose ``name [id]`` label is the given one."""
    from estatemap.functions.naming import option_label

    hits = rows.filter(option_label(F.col(name_column), F.col(id_column)) == label)
    return first_by(hits.withColumn("_one", F.lit(1)), ["_one"], [F.col("line_number")]).drop("_one")
