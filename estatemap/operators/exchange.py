"""Import and export of architecture models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatemap import model
from estatemap.functions import scoring
from estatemap.functions.naming import hashed_node_id, strip_relationship_suffix
from estatemap.graph import Graph
from estatemap.operators.org import canonical_org_names
from estatemap.operators.similar import ratio_candidates
from estatemap.operators.tables import conform, first_by, last_by, overwrite
from estatemap.operators.upserts import EDGE_KEY, _of_types
from estatemap.session import cut_lineage
from estatemap.sources.exchange import Mapping

IDENTITY = ["archimate_id", "archimate_source"]


@dataclass(frozen=True)
class ExchangeImport:
    """Result of an import: the new graph, the review queue and what was left out."""

    graph: Graph
    pending: DataFrame           # identity, name, label, suggested_match, score
    pending_relations: DataFrame  # identity, direction, relation_type, other_label, other_name
    elements: DataFrame          # identity, label, outcome imported | candidate
    relations: DataFrame         # relation rows with outcome
    skipped_types: DataFrame     # element_type, count


def classify_elements(elements: DataFrame, mapping: Mapping) -> tuple[DataFrame, DataFrame]:
    """Elements with their label, and a histogram of types that are neither imported nor ignored."""
    labels = F.broadcast(mapping.element_labels.withColumnRenamed("element_type", "archimate_type"))
    ignored = F.broadcast(mapping.ignored.withColumnRenamed("element_type", "archimate_type"))
    unknown = elements.join(labels, "archimate_type", "left_anti").join(ignored, "archimate_type", "left_anti")
    histogram = unknown.groupBy(F.col("archimate_type").alias("element_type")).agg(F.count(F.lit(1)).alias("count"))
    return elements.join(labels, "archimate_type"), histogram


def resolve_identity(elements: DataFrame, graph: Graph, threshold: float) -> DataFrame:
    """How each element relates to the graph before the import.

    Adds outcome (known, named, candidate, new), node_id, resolved_name, suggested_match and score: the
    node of the same identity, else of the same name, else the best similar name of the label, else none.
    """
    stored = graph.nodes.filter(F.col("archimate_id").isNotNull()).select(
        "label", *IDENTITY, F.col("node_id").alias("_known_id"), F.col("name").alias("_known_name"))
    stored = first_by(stored, ["label", *IDENTITY], [F.col("_known_id")])
    by_name = graph.nodes.filter(F.col("name").isNotNull()).groupBy("label", "name").agg(F.min("node_id").alias("_named_id"))
    placed = elements.join(stored, ["label", *IDENTITY], "left").join(by_name, ["label", "name"], "left")
    placed = cut_lineage(placed)
    open_rows = placed.filter(F.col("_known_id").isNull() & F.col("_named_id").isNull())
    best = best_similar(open_rows.select("label", "name"), graph, threshold)
    outcome = (
        F.when(F.col("_known_id").isNotNull(), "known").when(F.col("_named_id").isNotNull(), "named")
        .when(F.col("suggested_match").isNotNull(), "candidate").otherwise("new")
    )
    # Elements of one run that are new under one name become one node.
    fresh = hashed_node_id(F.col("label"), F.lit("exchange"), F.col("name"))
    return placed.join(best, ["label", "name"], "left").withColumn("outcome", outcome).select(
        *elements.columns, "outcome",
        F.when(F.col("outcome") != "candidate", F.coalesce("_known_id", "_named_id", fresh)).alias("node_id"),
        F.when(F.col("outcome") == "known", F.col("_known_name")).otherwise(F.col("name")).alias("resolved_name"),
        "suggested_match", "score")


def best_similar(names: DataFrame, graph: Graph, threshold: float) -> DataFrame:
    """(label, name, suggested_match, score): the most similar stored name of the label at or above the threshold."""
    ours = names.distinct().select(F.col("label").alias("grp"), "name", F.lower("name").alias("a"))
    theirs = graph.nodes.filter(F.col("name").isNotNull()).groupBy(
        F.col("label").alias("grp"), F.col("name").alias("other")).agg(F.min("node_id").alias("_order")).withColumn(
        "b", F.lower("other"))
    theirs = theirs.join(ours.select("grp").distinct(), "grp", "left_semi")
    pairs = ratio_candidates(
        ours.select("grp", F.col("a").alias("text")).distinct(),
        theirs.select("grp", F.col("b").alias("text")).distinct().withColumn("need", F.lit(threshold)), threshold)
    scored = pairs.withColumn("score", scoring.seq_ratio(F.col("a"), F.col("b"))).filter(F.col("score") >= threshold)
    hits = scored.join(ours, ["grp", "a"]).join(theirs, ["grp", "b"])
    return first_by(hits.select("grp", "name", "other", "score", "_order"), ["grp", "name"],
                    [-F.col("score"), F.col("_order")]).select(
        F.col("grp").alias("label"), "name", F.col("other").alias("suggested_match"), F.round("score", 3).alias("score"))


def _values(rows: DataFrame, column: str) -> list[str]:
    """The labels or relationship types at hand; the model has a few dozen."""
    return sorted(row[0] for row in rows.select(column).distinct().collect())


def merge_nodes(graph: Graph, rows: DataFrame) -> Graph:
    """Upsert imported elements; ``rows`` has label, node_id, name and the exchange columns."""
    columns = ["label", "name", "archimate_id", "archimate_source", "archimate_type"]
    fresh = cut_lineage(conform(last_by(rows.select("node_id", *columns), ["node_id"], [F.col("archimate_source"), F.col("archimate_id")]), model.NODE_SCHEMA))
    for label in _values(fresh, "label"):
        graph = graph.with_label(label, overwrite(graph.label(label), fresh.filter(F.col("label") == label), ["node_id"], columns))
    return graph


def merge_relations(graph: Graph, rows: DataFrame) -> Graph:
    """Upsert imported relations; an edge that exists takes the new exchange type."""
    fresh = cut_lineage(last_by(conform(rows, model.EDGE_SCHEMA), EDGE_KEY, [F.col("archimate_rel_type")]))
    for rel_type in _values(fresh, "rel_type"):
        graph = graph.with_types([rel_type], overwrite(
            graph.relation(rel_type), fresh.filter(F.col("rel_type") == rel_type), EDGE_KEY, ["archimate_rel_type"]))
    return graph


def judge_relations(relations: DataFrame, elements: DataFrame, mapping: Mapping) -> DataFrame:
    """Relations with both ends resolved and an outcome.

    imported, unresolvable_endpoint, type_not_accepted or no_graph_relation. An association is always
    imported under the neutral relation.
    """
    ends = elements.filter(F.col("outcome") != "candidate").select(
        "archimate_source", "archimate_id", "node_id", "label", F.col("resolved_name").alias("end_name"))
    names = first_by(elements.select("archimate_source", "archimate_id", F.col("name").alias("own_name")),
                     ["archimate_source", "archimate_id"], [F.col("own_name")])
    rows = relations
    for side, prefix in (("source", "src"), ("target", "dst")):
        key = f"{side}_archimate_id"
        end = last_by(ends, ["archimate_source", "archimate_id"], [F.col("node_id")]).select(
            "archimate_source", F.col("archimate_id").alias(key), F.col("node_id").alias(f"{prefix}_id"),
            F.col("label").alias(f"{prefix}_label"), F.col("end_name").alias(f"{prefix}_name"))
        own = names.select("archimate_source", F.col("archimate_id").alias(key), F.col("own_name").alias(f"{prefix}_own"))
        rows = rows.join(end, ["archimate_source", key], "left").join(own, ["archimate_source", key], "left")
    accepted = F.broadcast(mapping.accepted.select(
        "src_label", "dst_label", F.col("relation_type").alias("archimate_rel_type"), F.lit(True).alias("_accepted")))
    targets = F.broadcast(mapping.graph_relations.withColumnRenamed("rel_type", "_mapped"))
    rows = rows.join(accepted, ["src_label", "dst_label", "archimate_rel_type"], "left").join(
        targets, ["src_label", "dst_label"], "left")
    neutral = F.col("archimate_rel_type") == "Association"
    outcome = (
        F.when(F.col("src_id").isNull() | F.col("dst_id").isNull(), "unresolvable_endpoint")
        .when(~neutral & F.col("_accepted").isNull(), "type_not_accepted")
        .when(~neutral & F.col("_mapped").isNull(), "no_graph_relation").otherwise("imported")
    )

    def shown(prefix: str):
        own = F.concat(F.lit("~"), F.coalesce(f"{prefix}_own", F.lit("?")), F.lit(" (Kandidat)"))
        return F.coalesce(f"{prefix}_name", own)

    return rows.withColumn("outcome", outcome).select(
        *relations.columns, "src_id", "src_label", "src_name", "dst_id", "dst_label", "dst_name", "outcome",
        F.when(neutral, F.lit(mapping.association)).otherwise(F.col("_mapped")).alias("rel_type"),
        shown("src").alias("source_shown"), shown("dst").alias("target_shown"))


def pending_relations(judged: DataFrame, pending: DataFrame) -> DataFrame:
    """Skipped relations as evidence at their pending candidate, each once."""
    skipped = judged.filter(F.col("outcome") == "unresolvable_endpoint")
    from_source = F.col("src_id").isNull()
    evidence = skipped.select(
        "archimate_source",
        F.when(from_source, F.col("source_archimate_id")).otherwise(F.col("target_archimate_id")).alias("archimate_id"),
        F.when(from_source, "outgoing").otherwise("incoming").alias("direction"),
        F.col("archimate_rel_type").alias("relation_type"),
        F.when(from_source, F.col("dst_label")).otherwise(F.col("src_label")).alias("other_label"),
        F.when(from_source, F.col("dst_name")).otherwise(F.col("src_name")).alias("other_name"),
    ).filter(F.col("other_label").isNotNull() & F.col("other_name").isNotNull())
    return evidence.join(pending.select(*IDENTITY), IDENTITY, "left_semi").distinct()


def import_exchange(graph: Graph, elements: DataFrame, relations: DataFrame, mapping: Mapping) -> ExchangeImport:
    """One exchange import. Similar names wait for review and do not enter the graph."""
    labelled, skipped = classify_elements(elements, mapping)
    resolved = cut_lineage(resolve_identity(labelled, graph, mapping.threshold))
    landed = resolved.filter(F.col("outcome") != "candidate")
    units = canonical_org_names(landed.filter(F.col("label") == "OrgUnit"), "resolved_name", graph)
    named = landed.filter(F.col("label") != "OrgUnit").withColumn("canonical", F.col("resolved_name")).unionByName(
        units.select(*landed.columns, "canonical"))
    result = merge_nodes(graph, named.withColumn("name", F.col("canonical")))
    pending = first_by(
        resolved.filter(F.col("outcome") == "candidate").select(
            *IDENTITY, "archimate_type", F.col("name").alias("archimate_name"), "label", "suggested_match", "score", "ordinal"),
        IDENTITY, [F.col("ordinal")]).drop("ordinal")
    judged = cut_lineage(judge_relations(relations, resolved, mapping))
    result = merge_relations(result, judged.filter(F.col("outcome") == "imported").dropDuplicates(
        [*EDGE_KEY, "archimate_rel_type"]))
    return ExchangeImport(
        result, pending, pending_relations(judged, pending),
        resolved.select(*IDENTITY, "label", F.when(F.col("outcome") == "candidate", "candidate").otherwise("imported").alias("outcome")),
        judged, skipped)


def import_report(outcome: ExchangeImport) -> DataFrame:
    """One row of counts."""
    elements = outcome.elements.agg(
        F.count_if(F.col("outcome") == "imported").alias("elements_imported"),
        F.count_if(F.col("outcome") == "candidate").alias("elements_as_candidates")).withColumn("_k", F.lit(1))
    relations = outcome.relations.agg(
        F.count_if(F.col("outcome") == "imported").alias("relations_imported"),
        F.count_if(F.col("outcome") != "imported").alias("relations_skipped")).withColumn("_k", F.lit(1))
    skipped = outcome.skipped_types.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("elements_skipped")).withColumn("_k", F.lit(1))
    return elements.join(relations, "_k").join(skipped, "_k").drop("_k")


def skipped_histogram(outcome: ExchangeImport) -> DataFrame:
    """Skipped element types, and relation types that the label pair does not accept, with their number."""
    relations = outcome.relations.filter(F.col("outcome") == "type_not_accepted").groupBy(
        F.col("archimate_rel_type").alias("element_type")).agg(F.count(F.lit(1)).alias("count"))
    return outcome.skipped_types.unionByName(relations).groupBy("element_type").agg(F.sum("count").alias("count"))


# Review of pending candidates -------------------------------------------------------------------------

def confirm_pending(graph: Graph, chosen: DataFrame, evidence: DataFrame, mapping: Mapping) -> Graph:
    """Bind the identity of the chosen candidates to their suggested nodes and add their mapped relations."""
    names = graph.nodes.filter(F.col("name").isNotNull()).select("label", "name", "node_id")
    bound = chosen.join(names.withColumnRenamed("name", "suggested_match"), ["label", "suggested_match"])
    bound = cut_lineage(bound)
    one = first_by(bound.select("label", "node_id", *IDENTITY), ["label", "node_id"], [F.col("archimate_source"), F.col("archimate_id")])
    named = cut_lineage(one.select("label", "node_id", *[F.col(name).alias(f"_{name}") for name in IDENTITY]))
    for label in _values(named, "label"):
        nodes = graph.label(label).join(named.filter(F.col("label") == label).drop("label"), "node_id", "left")
        graph = graph.with_label(label, nodes.withColumns({name: F.coalesce(f"_{name}", name) for name in IDENTITY}).select(*model.NODE_SCHEMA.names))
    found = bound.select("label", "node_id", *IDENTITY).join(evidence, IDENTITY).withColumn(
        "out", F.coalesce(F.col("direction") == "outgoing", F.lit(False)))
    out = F.col("out")
    ends = found.select("out", "node_id", "other_label", "other_name", F.when(out, F.col("label")).otherwise(F.col("other_label")).alias("src_label"),
                        F.when(out, F.col("other_label")).otherwise(F.col("label")).alias("dst_label"), F.col("relation_type").alias("archimate_rel_type"))
    links = ends.join(F.broadcast(mapping.graph_relations), ["src_label", "dst_label"], "left").withColumn(
        "rel_type", F.when(F.col("archimate_rel_type") == "Association", mapping.association).otherwise(F.col("rel_type"))).filter(
        F.col("rel_type").isin(*model.RELATION_TYPES))
    return merge_links(graph, links, names)


#: Nodes of one name in a row while the links to them are paired; rows of the result are made from the pairs without a shuffle.
NODES_IN_A_BLOCK = 500


def merge_links(graph: Graph, links: DataFrame, names: DataFrame) -> Graph:
    """Upsert the edges between the node of each link and every node that has the link's other name.

    ``links`` has rel_type, node_id, out (the node is the source), other_label, other_name, src_label, dst_label and
    archimate_rel_type, ``names`` label, name and node_id. As an upsert of the written out edges, the greatest type of an edge
    wins; but there are as many as links times nodes of a name, so those that only one link can give are neither shuffled nor
    compared: per link and block of nodes, the edges that exist are taken from the block.
    """
    place = ["out", "other_label", "other_name"]
    links = links.groupBy("rel_type", "node_id", *place, "src_label", "dst_label").agg(F.max("archimate_rel_type").alias("archimate_rel_type"))
    links = cut_lineage(links)
    kinds = links.select("rel_type", "out").distinct().collect()
    types, directions = (sorted({row[at] for row in kinds}) for at in range(2))
    if not types:
        return graph
    each_side = F.explode(F.array(*map(F.lit, directions)))
    # An edge may come from several links where an end stands under several names, or where links of both directions meet.
    members = names.select(F.col("label").alias("other_label"), F.col("name").alias("other_name"), F.col("node_id").alias("other_id")).distinct()
    members = members.withColumn("many", F.col("other_id").isNull() | (F.count(F.lit(1)).over(Window.partitionBy("other_id")) > 1))
    met = links.groupBy(F.col("node_id").alias("other_id")).agg(F.max("out").alias("as_source"), F.max(~F.col("out")).alias("as_target"))
    members = cut_lineage(members.join(met, "other_id", "left"))
    several = members.filter("many").select(F.col("other_id").alias("node_id"), "many").distinct()
    links = links.join(several, "node_id", "left").withColumn("link_shared", F.col("node_id").isNull() | F.coalesce("many", F.lit(False))).drop("many")
    sides = members.withColumn("out", each_side)
    shared = F.col("many") | F.coalesce(F.when(F.col("out"), F.col("as_target")).otherwise(F.col("as_source")), F.lit(False))
    sides = sides.select(*place, "other_id", shared.alias("shared"))

    def edges(rows: DataFrame) -> DataFrame:
        out = F.col("out")
        return conform(rows.withColumns({
            "src_id": F.when(out, F.col("node_id")).otherwise(F.col("other_id")),
            "dst_id": F.when(out, F.col("other_id")).otherwise(F.col("node_id"))}), model.EDGE_SCHEMA)

    compared = edges(links.filter("link_shared").join(sides.drop("shared"), place)).unionByName(
        edges(links.filter("NOT link_shared").join(sides.filter("shared").drop("shared"), place)))
    compared = last_by(compared, EDGE_KEY, [F.col("archimate_rel_type")])

    single = sides.filter("NOT shared").drop("shared")
    blocks_of = single.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / NODES_IN_A_BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("other_id"), F.col("blocks"))
    own = links.filter("NOT link_shared").drop("link_shared").join(blocks_of, place)
    stored = _of_types(graph, types).select(*EDGE_KEY).distinct().withColumn("out", each_side).select(
        "rel_type", "out", F.when(F.col("out"), F.col("src_id")).otherwise(F.col("dst_id")).alias("node_id"),
        F.when(F.col("out"), F.col("dst_id")).otherwise(F.col("src_id")).alias("other_id"))
    link = ["rel_type", "node_id", *place]
    hits = stored.join(single, ["out", "other_id"]).join(own, link)
    known = hits.groupBy(*link, block.alias("block")).agg(F.collect_list("other_id").alias("known_ids"))
    # The partitions are numbered, since adaptive execution sees the blocks only and would put all their pairs into few tasks.
    partitions = int(graph.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = own.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(known, [*link, "block"], "left")
    blocks = single.join(blocks_of, place).groupBy(*place, block.alias("block")).agg(F.collect_list("other_id").alias("ids"))
    pairs = cells.repartition(partitions, *place, "block").join(blocks.repartition(partitions, *place, "block"), [*place, "block"])
    fresh = edges(pairs.withColumn("other_id", F.explode(
        F.when(F.col("known_ids").isNull(), F.col("ids")).otherwise(F.array_except("ids", "known_ids")))))
    changed = compared.unionByName(edges(hits))
    for rel_type in types:
        graph = graph.with_types([rel_type], overwrite(
            graph.relation(rel_type), changed.filter(F.col("rel_type") == rel_type), EDGE_KEY, ["archimate_rel_type"]).unionByName(
            fresh.filter(F.col("rel_type") == rel_type)))
    return graph


def set_element_types(graph: Graph, overrides: DataFrame) -> Graph:
    """Set only the element type of the nodes with (label, name)."""
    valid = overrides.filter(
        F.col("label").isin(*model.EXPORT_LABELS) & (F.coalesce("name", F.lit("")) != "")
        & (F.coalesce("archimate_type", F.lit("")) != ""))
    chosen = first_by(valid.select("label", "name", F.col("archimate_type").alias("_type")), ["label", "name"], [F.col("_type")])
    chosen = cut_lineage(chosen)
    for label in _values(chosen, "label"):
        own = chosen.filter(F.col("label") == label).drop("label")
        nodes = graph.label(label).join(own, "name", "left").withColumn("archimate_type", F.coalesce("_type", "archimate_type"))
        graph = graph.with_label(label, nodes.select(*model.NODE_SCHEMA.names))
    return graph


def export_elements(graph: Graph, mapping: Mapping) -> DataFrame:
    """(node_id, label, name, identifier, element_type) of every exportable node."""
    defaults = F.broadcast(mapping.label_elements.withColumnRenamed("element_type", "_default"))
    nodes = graph.nodes.filter(F.col("label").isin(*model.EXPORT_LABELS) & (F.coalesce("name", F.lit("")) != ""))
    fresh = F.concat(F.lit("id-"), F.substring(F.sha1(F.col("node_id").cast("binary")), 1, 12))
    return nodes.join(defaults, "label", "left").select(
        "node_id", "label", "name", F.coalesce("archimate_id", fresh).alias("identifier"),
        F.coalesce(F.nullif("archimate_type", F.lit("")), F.col("_default")).alias("element_type"),
    ).filter(F.coalesce("element_type", F.lit("")) != "")


def export_relations(graph: Graph, mapping: Mapping, elements: DataFrame | None = None) -> DataFrame:
    """(identifier, relation_type, source, target) between exported elements."""
    elements = export_elements(graph, mapping) if elements is None else elements
    rows = graph.edges.filter(F.col("rel_type").isin(*model.EXPORT_RELATIONS)).select(
        "rel_type", "src_id", "src_label", "dst_id", "dst_label", "archimate_rel_type")
    for side, name in (("src_id", "source"), ("dst_id", "target")):
        rows = rows.join(elements.select(F.col("node_id").alias(side), F.col("identifier").alias(name)), side)
    rows = rows.join(F.broadcast(mapping.export_relations), ["src_label", "dst_label"], "left")
    kind = F.coalesce(F.nullif("archimate_rel_type", F.lit("")), F.col("relation_type"))
    key = F.concat_ws("|", "src_id", "rel_type", "dst_id")
    return rows.withColumn("relation_type", strip_relationship_suffix(kind)).filter(
        F.coalesce("relation_type", F.lit("")) != "").select(
        F.concat(F.lit("id-"), F.substring(F.sha1(key.cast("binary")), 1, 12)).alias("identifier"),
        "relation_type", "source", "target", "src_id", "rel_type", "dst_id")


