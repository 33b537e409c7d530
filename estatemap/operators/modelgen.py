"""Generated architecture model of an inventory: elements, relationships and assumptions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatemap.functions.naming import stable_id, text_or
from estatemap.functions.text import entity_key
from estatemap.operators.tables import first_by, last_by

# Element type and key prefix per entity type.
ENTITY_ELEMENTS = {"application": "ApplicationComponent", "interface": "ApplicationInterface", "server": "Node"}
SYNTHETIC_NOTE = "Application name is taken from process documentation and has no CMDB counterpart."


@dataclass(frozen=True)
class GeneratedModel:
    elements: DataFrame       # identifier, key, type, name, documentation
    relationships: DataFrame  # identifier, source, type, target
    assumptions: DataFrame    # assumption


def inventory_mentions(processes: DataFrame) -> DataFrame:
    return processes.select("process_id", F.explode("mentioned_applications").alias("mention"))


def resolve_mentions(mentions: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entity of each mention by alias or name; without one the mention stands for a synthetic application.

    ``aliases`` has alias and name. Columns: process_id, mention, entity_id (null when synthetic).
    """
    dictionary = last_by(aliases.select(entity_key(F.col("alias")).alias("_key"), F.col("name").alias("_target")),
                         ["_key"], [F.col("_target")])
    by_name = last_by(entities.select(entity_key(F.col("name")).alias("_name"), F.col("source_id").alias("entity_id"),
                                      "entity_type"), ["_name"], [F.col("entity_id")])
    named = mentions.withColumn("_key", entity_key(F.col("mention"))).join(dictionary, "_key", "left").withColumn(
        "_name", entity_key(F.coalesce("_target", "mention")))
    return named.join(by_name, "_name", "left").select("process_id", "mention", "entity_id", "entity_type")


def capabilities_by_department(processes: DataFrame, capabilities: DataFrame) -> DataFrame:
    """(process_id, capability) through the department dimension (department, capability)."""
    return processes.select("process_id", "department").join(capabilities, "department").select(
        "process_id", "capability").distinct()


def _element(df: DataFrame, key, kind, name, documentation=None) -> DataFrame:
    return df.select(stable_id("elem", key).alias("identifier"), key.alias("key"), kind.alias("type"), name.alias("name"),
                     (documentation if documentation is not None else F.lit("")).alias("documentation"))


def _edge(df: DataFrame, source, kind, target) -> DataFrame:
    rows = df.select(stable_id("elem", source).alias("source"), F.lit(kind).alias("type"),
                     stable_id("elem", target).alias("target"))
    return rows.select(stable_id("rel", F.concat_ws("|", "source", "type", "target")).alias("identifier"),
                       "source", "type", "target")


def _key(prefix: str, column):
    return F.concat(F.lit(f"{prefix}:"), column)


def build_model(processes: DataFrame, entities: DataFrame, relations: DataFrame, aliases: DataFrame,
                capabilities: DataFrame) -> GeneratedModel:
    """Elements and relationships, each once by identifier."""
    typed = entities.filter(F.col("entity_type").isin(*ENTITY_ELEMENTS))
    actor = F.coalesce(F.nullif("owner", F.lit("")), F.col("department"))
    actors = processes.select(actor.alias("name")).unionByName(
        entities.select(F.col("owner_name").alias("name"))).filter(text_or(F.col("name")) != "").distinct()
    kinds = F.create_map(*[F.lit(part) for item in ENTITY_ELEMENTS.items() for part in item])
    entity = F.concat_ws(":", "entity_type", "source_id")
    resolved = resolve_mentions(inventory_mentions(processes), entities, aliases)
    synthetic = resolved.filter(F.col("entity_id").isNull())
    covered = capabilities_by_department(processes, capabilities)
    process = _key("process", F.col("process_id"))
    elements = reduce(DataFrame.unionByName, [
        _element(actors, _key("actor", F.col("name")), F.lit("BusinessActor"), F.col("name")),
        _element(processes, _key("role", F.col("role")), F.lit("BusinessRole"), F.col("role")),
        _element(processes, process, F.lit("BusinessProcess"), F.col("process_name"), F.col("documentation")),
        _element(typed, entity, kinds[F.col("entity_type")], F.col("name")),
        _element(capabilities.select("capability").distinct(), _key("capability", F.col("capability")), F.lit("Capability"),
                 F.col("capability")),
        _element(synthetic, _key("synthetic-app", F.col("mention")), F.lit("ApplicationComponent"), F.col("mention"),
                 F.lit(SYNTHETIC_NOTE)),
    ])
    owner = _key("actor", actor)
    known = {kind: typed.filter(F.col("entity_type") == kind).select("source_id").distinct() for kind in ENTITY_ELEMENTS}

    def technical(rel: str, kind: str, edge_type: str) -> DataFrame:
        rows = relations.filter(F.col("relation_type") == rel)
        rows = rows.join(known["application"], "source_id", "left_semi").join(
            known[kind].select(F.col("source_id").alias("target_id")), "target_id", "left_semi")
        return _edge(rows, _key("application", F.col("source_id")), edge_type, _key(kind, F.col("target_id")))

    edges = reduce(DataFrame.unionByName, [
        _edge(processes, owner, "Assignment", process),
        _edge(processes, owner, "Assignment", _key("role", F.col("role"))),
        _edge(processes, _key("role", F.col("role")), "Assignment", process),
        _edge(typed.filter(text_or(F.col("owner_name")) != ""), _key("actor", F.col("owner_name")), "Assignment", entity),
        technical("RUNS_ON", "server", "Realization"),
        technical("USES_INTERFACE", "interface", "Composition"),
        _edge(covered, process, "Serving", _key("capability", F.col("capability"))),
        _edge(synthetic, _key("synthetic-app", F.col("mention")), "Serving", process),
        _edge(resolved.filter(F.col("entity_type") == "application"), _key("application", F.col("entity_id")), "Serving", process),
    ])
    texts = synthetic.select(F.format_string(
        "Application '%s' was modeled as a standalone ApplicationComponent because no CMDB entity matched it.",
        "mention").alias("assumption"))
    return GeneratedModel(
        first_by(elements, ["identifier"], [F.col("name"), F.col("documentation")]),
        edges.dropDuplicates(["identifier"]),
        texts.distinct().orderBy("assumption"))

