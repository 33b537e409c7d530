"""MERGE-style maintenance of the node and edge tables.

Every function takes the graph and a table of changes and returns the new graph; a change of one
label or relationship type leaves the rows of all others untouched and unshuffled.

The change tables (who is updated, inserted, moved) are checkpointed: several later steps read them,
and without the cut each step would multiply the plan of the one before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatemap import model
from estatemap.functions import scoring, text
from estatemap.functions.naming import hashed_node_id, node_id
from estatemap.graph import Graph
from estatemap.operators.org import canonical_org_names
from estatemap.session import cut_lineage
from estatemap.operators.tables import conform, first_by, insert_missing, last_by, overwrite, replace_scope

EDGE_KEY = ["rel_type", "src_id", "dst_id"]
#: Moved placeholders (two ids) that may be broadcast, about 30 MB.
BROADCAST_ROWS = 300_000


def _put_nodes(graph: Graph, label: str, nodes: DataFrame) -> Graph:
    return graph.with_label(label, conform(nodes, model.NODE_SCHEMA))


def _put_edges(graph: Graph, types: list[str], edges: DataFrame) -> Graph:
    return graph.with_types(types, conform(edges, model.EDGE_SCHEMA))


def _of_types(graph: Graph, types: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [graph.relation(rel_type) for rel_type in types])


def edge_rows(pairs: DataFrame, rel_type: str, src_label: str, dst_label: str) -> DataFrame:
    """Full edge rows from src_id, dst_id and whatever property columns are there."""
    labelled = pairs.withColumns({
        "rel_type": F.lit(rel_type), "src_label": F.lit(src_label), "dst_label": F.lit(dst_label)})
    return conform(labelled, model.EDGE_SCHEMA)


def merge_edges(graph: Graph, rel_type: str, fresh: DataFrame) -> Graph:
    """Add the edges that are not there yet."""
    return _put_edges(graph, [rel_type], insert_missing(graph.relation(rel_type), fresh, EDGE_KEY))


def _adopt(incoming: DataFrame, nodes: DataFrame, incoming_name: Column, node_name: Column) -> DataFrame:
    """Pair the first incoming row of a name with the first node of that name: (key, node_id)."""
    free = nodes.withColumn("_n", node_name).groupBy("_n").agg(F.min("node_id").alias("node_id"))
    first = first_by(incoming.withColumn("_n", incoming_name).select("_n", "key", "ordinal"), ["_n"], [F.col("ordinal")])
    return first.join(free, "_n").select("key", "node_id")


def _upsert(graph: Graph, label: str, key_column: str, incoming: DataFrame, changes: dict[str, Column], *,
            by_name: bool = False, placeholders: bool = False) -> tuple[Graph, DataFrame]:
    """Bring ``incoming`` (unique key, name, ordinal, more) into one label.

    Order of identity: the natural key; a single placeholder of the name; a node of the name without a
    key; else a new node. Returns the graph and (key, node_id, action).
    """
    nodes = graph.label(label)
    known = nodes.filter(F.col(key_column).isNotNull()).select(F.col(key_column).alias("key"), "node_id")
    hits = incoming.select("key").join(known, "key")
    left = incoming.join(known, "key", "left_anti")
    if placeholders:
        marked = nodes.filter(F.coalesce("placeholder", F.lit(False)))
        single = marked.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("node_id")).filter("n = 1")
        taken = _adopt(left, single, F.col("name"), F.col("name"))
        hits = hits.unionByName(taken)
        left = left.join(taken, "key", "left_anti")
    if by_name:
        keyless = nodes.filter(F.col(key_column).isNull() & ~F.coalesce("placeholder", F.lit(False)))
        taken = _adopt(left, keyless, F.lower("name"), F.lower("name"))
        hits = hits.unionByName(taken)
        left = left.join(taken, "key", "left_anti")
    actions = hits.withColumn("action", F.lit(model.UPDATED)).unionByName(
        left.select("key", node_id(label, F.col("key")).alias("node_id"), F.lit(model.INSERTED).alias("action")))
    actions = cut_lineage(actions)
    fresh = actions.join(incoming, "key").select("node_id", F.lit(label).alias("label"), *[
        value.alias(column) for column, value in changes.items()])
    merged = overwrite(nodes, conform(fresh, model.NODE_SCHEMA), ["node_id"], list(changes) + ["label"])
    return _put_nodes(graph, label, merged), actions


def upsert_processes(graph: Graph, incoming: DataFrame, *, distinct: bool = True) -> tuple[Graph, DataFrame]:
    """Processes by id, by their only placeholder, by name, or new. Also returns (process_id, node_id, action).

    ``incoming`` has process_id, process_name and ordinal; the last row of an id counts. Old rejections
    are bound to an updated process before its name changes. ``distinct`` is that of ``resolve_placeholders``.
    """
    rows = last_by(incoming.select(F.col("process_id").alias("key"), F.col("process_name").alias("name"), "ordinal"),
                   ["key"], [F.col("ordinal")])
    before = graph.label("Process")
    old_names = before.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("process_id").alias("process_id")).filter(
        "n = 1").join(rows.select(F.col("key").alias("process_id")), "process_id", "left_semi")
    rejections = graph.rejections.join(
        old_names.select(F.col("name").alias("prozess_name"), F.col("process_id").alias("_bound")), "prozess_name", "left"
    ).select(F.coalesce("process_id", "_bound").alias("process_id"), "prozess_name", "anwendung_name")
    graph, actions = _upsert(
        graph.with_(rejections=rejections), "Process", "process_id", rows,
        {"process_id": F.col("key"), "name": F.col("name"), "placeholder": F.lit(False)},
        by_name=True, placeholders=True)
    named = actions.join(rows, "key").filter(F.col("action") == model.UPDATED).select("node_id", "name")
    return resolve_placeholders(graph, named, distinct=distinct), actions.withColumnRenamed("key", "process_id")


def resolve_placeholders(graph: Graph, real: DataFrame, *, distinct: bool = True) -> Graph:
    """Move FOLLOWS edges of placeholders to the real process of that name (node_id, name); drop the placeholders.

    Not ``distinct`` leaves it to the caller to drop the edges that are there twice.
    """
    stale = graph.label("Process").filter(F.coalesce("placeholder", F.lit(False))).select(
        F.col("node_id").alias("old_id"), "name")
    target = real.groupBy("name").agg(F.min("node_id").alias("new_id"))
    moves = cut_lineage(
        stale.join(target, "name").filter(F.col("old_id") != F.col("new_id")).select("old_id", "new_id"))
    follows = graph.relation("FOLLOWS")
    few = moves.count() <= BROADCAST_ROWS
    for side in ("src_id", "dst_id"):
        renamed = moves.select(F.col("old_id").alias(side), "new_id")
        renamed = F.broadcast(renamed) if few else renamed
        follows = follows.join(renamed, side, "left").withColumn(side, F.coalesce("new_id", side)).drop("new_id")
    follows = follows.select(*model.EDGE_SCHEMA.names)
    follows = follows.dropDuplicates(EDGE_KEY) if distinct else follows
    nodes = graph.label("Process").join(moves.select(F.col("old_id").alias("node_id")), "node_id", "left_anti")
    return _put_edges(_put_nodes(graph, "Process", nodes), ["FOLLOWS"], follows)


def cleanup_placeholders(graph: Graph) -> Graph:
    """Drop the remaining placeholders and every edge at them."""
    gone = graph.label("Process").filter(F.coalesce("placeholder", F.lit(False))).select("node_id")
    edges = graph.edges
    for side in ("src_id", "dst_id"):
        edges = edges.join(gone.select(F.col("node_id").alias(side)), side, "left_anti")
    kept = graph.label("Process").filter(~F.coalesce("placeholder", F.lit(False)))
    return _put_nodes(graph, "Process", kept).with_(edges=edges.select(*model.EDGE_SCHEMA.names))


def upsert_entities(graph: Graph, entities: DataFrame) -> Graph:
    """Master data into their labels: applications also by name, all others by id; the last row of an id counts."""
    rows = last_by(
        entities.select(F.col("entity_id").alias("key"), "name", "entity_type", "server_type",
                        F.col("line_number").alias("ordinal")),
        ["entity_type", "key"], [F.col("ordinal")])
    shapes = {
        "application": ("cmdb_id", {"cmdb_id": F.col("key"), "id": F.col("key"), "name": F.col("name")}, True),
        "interface": ("id", {"id": F.col("key"), "name": F.col("name")}, False),
        "server": ("id", {"id": F.col("key"), "name": F.col("name"), "server_type": F.col("server_type")}, False),
        "process": ("process_id",
                    {"process_id": F.col("key"), "name": F.col("name"), "placeholder": F.lit(False)}, False),
    }
    for kind, (key, changes, by_name) in shapes.items():
        part = rows.filter(F.col("entity_type") == kind)
        graph, _ = _upsert(graph, model.LABEL_OF_TYPE[kind], key, part, changes, by_name=by_name)
    return graph


# Labels a relation may end at; identifiers are looked up within them.
RELATION_ENDS = {
    "RUNS_ON": (("Application", "Interface"), ("Server", "Infrastructure")),
    "USES_INTERFACE": (("Application",), ("Interface",)),
}


def _identified(graph: Graph, labels: tuple[str, ...], *names: str) -> DataFrame:
    """(id, node_id, label) of the nodes of some labels under the given names."""
    nodes = reduce(DataFrame.unionByName, [graph.label(label).select("id", "node_id", "label") for label in labels])
    return nodes.filter(F.col("id").isNotNull()).toDF(*names)


def resolve_relations(graph: Graph, relations: DataFrame) -> DataFrame:
    """Edges for the (source_id, relation_type, target_id) rows whose both ends exist."""
    result = None
    for rel_type, (sources, targets) in RELATION_ENDS.items():
        rows = relations.filter(F.col("relation_type") == rel_type).select("source_id", "target_id").distinct()
        src = _identified(graph, sources, "source_id", "src_id", "src_label")
        dst = _identified(graph, targets, "target_id", "dst_id", "dst_label")
        edges = conform(rows.join(src, "source_id").join(dst, "target_id").withColumn("rel_type", F.lit(rel_type)),
                        model.EDGE_SCHEMA)
        result = edges if result is None else result.unionByName(edges)
    return result.dropDuplicates(EDGE_KEY)


def _entity_nodes(graph: Graph, entities: DataFrame) -> DataFrame:
    """(entity_id, node_id, label) of the listed entities; processes carry no ``id`` and stay out."""
    parts = []
    for kind in ("application", "interface", "server"):
        label = model.LABEL_OF_TYPE[kind]
        listed = entities.filter(F.col("entity_type") == kind).select("entity_id").distinct()
        nodes = graph.label(label).filter(F.col("id").isNotNull()).select(F.col("id").alias("entity_id"), "node_id")
        parts.append(nodes.join(listed, "entity_id", "left_semi").withColumn("label", F.lit(label)))
    return cut_lineage(reduce(DataFrame.unionByName, parts))


def ensure_org_units(graph: Graph, names: DataFrame) -> tuple[Graph, DataFrame]:
    """Units for ``names`` (column name); returns the graph and (name, org_id) of each requested spelling."""
    wanted = canonical_org_names(names.select("name").distinct(), "name", graph)
    stored = graph.label("OrgUnit").groupBy(F.col("name").alias("canonical")).agg(F.min("node_id").alias("_stored"))
    placed = wanted.join(stored, "canonical", "left").withColumn(
        "org_id", F.coalesce("_stored", node_id("OrgUnit", F.col("canonical"))))
    placed = cut_lineage(placed.select("name", "canonical", "_stored", "org_id"))
    fresh = placed.filter(F.col("_stored").isNull()).select(
        F.lit("OrgUnit").alias("label"), F.col("org_id").alias("node_id"), F.col("canonical").alias("name"))
    nodes = graph.label("OrgUnit").unionByName(conform(fresh.distinct(), model.NODE_SCHEMA))
    return _put_nodes(graph, "OrgUnit", nodes), placed.select("name", "org_id")


def register_org_units(graph: Graph, names: DataFrame) -> Graph:
    cleaned = names.select(text.squeeze(F.col("name")).alias("name")).filter(F.col("name") != "")
    return ensure_org_units(graph, cleaned)[0]


def sync_master_data(graph: Graph, entities: DataFrame, relations: DataFrame, owners: DataFrame) -> Graph:
    """Entities, their technical relations and owners, replaced per listed entity.

    Entities that vanished from the export stay; owners set by hand on a listed entity do not.
    """
    graph = upsert_entities(graph, entities)
    touched = _entity_nodes(graph, entities)
    technical = ["USES_INTERFACE", "RUNS_ON"]
    graph = _put_edges(graph, technical, replace_scope(
        _of_types(graph, technical), touched.select(F.col("node_id").alias("src_id")), ["src_id"],
        resolve_relations(graph, relations)).dropDuplicates(EDGE_KEY))
    graph, units = ensure_org_units(graph, owners.select(F.col("org_unit_name").alias("name")))
    owned = owners.join(units, owners["org_unit_name"] == units["name"]).join(touched, "entity_id").select(
        F.col("org_id").alias("src_id"), F.lit("OrgUnit").alias("src_label"), F.col("node_id").alias("dst_id"),
        F.col("label").alias("dst_label"), F.lit("RESPONSIBLE_FOR").alias("rel_type"))
    fresh = conform(owned, model.EDGE_SCHEMA).dropDuplicates(EDGE_KEY)
    return _put_edges(graph, ["RESPONSIBLE_FOR"], replace_scope(
        graph.relation("RESPONSIBLE_FOR"), touched.select(F.col("node_id").alias("dst_id")), ["dst_id"], fresh))


# Documents ------------------------------------------------------------------------------------------

def _ordered(matches: DataFrame) -> DataFrame:
    """Match rows in the order one document after the other would write them."""
    return matches.withColumn("_order", F.struct("doc_ordinal", "position", F.coalesce("ordinal", F.lit(-1))))


def serves_edges(graph: Graph, matches: DataFrame, last_matches: DataFrame, *, cleared: bool = False) -> Graph:
    """SERVES for strong matches and decisions; unknown applications are created.

    All ``matches`` name applications; edges come from ``last_matches``, those of the last document of a process.
    Per pair the first decision stays, otherwise the last strong match wins. Matches carry the node of their process (dst_id);
    ``cleared`` says that the graph holds no SERVES at any of these.
    """
    decided = F.col("source").isin(model.KNOWN, model.KNOWN_MANUAL)

    def strong(matches: DataFrame) -> DataFrame:
        return _ordered(matches).filter(
            (F.coalesce("cmdb_id", F.lit("")) != "") & ((F.col("confidence") == model.STRONG) | decided))

    rows = strong(matches).withColumn("_name", F.coalesce("matched_name", "application_name"))
    names = rows.groupBy(F.col("cmdb_id").alias("key")).agg(
        F.max_by("_name", "_order").alias("name"), F.lit(0).alias("ordinal"))
    graph, actions = _upsert(graph, "Application", "cmdb_id", names,
                             {"cmdb_id": F.col("key"), "id": F.col("key"), "name": F.col("name")})
    pairs = strong(last_matches).join(actions.select(F.col("key").alias("cmdb_id"), F.col("node_id").alias("src_id")), "cmdb_id").select(
        "src_id", "dst_id", "confidence", F.col("application_name").alias("raw_name"),
        scoring.serves_source(F.col("source")).alias("source"), decided.alias("_decided"),
        F.col("doc_ordinal").alias("_doc"), F.col("position").alias("_position"))
    sign = F.when(F.col("_decided"), F.lit(-1)).otherwise(F.lit(1))
    best = last_by(pairs, ["src_id", "dst_id"], [F.col("_decided"), sign * F.col("_doc"), sign * F.col("_position")])
    fresh = edge_rows(best.drop("_decided", "_doc", "_position"), "SERVES", "Application", "Process")
    stored = graph.relation("SERVES")
    kept = stored if cleared else stored.join(fresh.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    return _put_edges(graph, ["SERVES"], kept.unionByName(fresh))


def may_serve_edges(graph: Graph, matches: DataFrame, *, cleared: bool = False) -> Graph:
    """MAY_SERVE for weak matches, only to applications that exist; the last score per pair wins."""
    decided = F.col("source").isin(model.KNOWN, model.KNOWN_MANUAL)
    rows = _ordered(matches).filter(
        (F.coalesce("cmdb_id", F.lit("")) != "") & (F.col("confidence") != model.STRONG) & ~decided)
    applications = graph.label("Application").filter(F.col("cmdb_id").isNotNull()).select(
        "cmdb_id", F.col("node_id").alias("src_id"))
    scores = rows.join(applications, "cmdb_id").groupBy("src_id", "dst_id").agg(
        F.max_by("score", "_order").alias("score"))
    fresh = edge_rows(scores, "MAY_SERVE", "Application", "Process")
    stored = graph.relation("MAY_SERVE")
    kept = stored if cleared else stored.join(fresh.select(*EDGE_KEY), EDGE_KEY, "left_anti")
    return _put_edges(graph, ["MAY_SERVE"], kept.unionByName(fresh))


def role_edges(graph: Graph, documents: DataFrame, last_documents: DataFrame, processes: DataFrame, *, cleared: bool = False) -> Graph:
    """PARTICIPATES_IN for the roles of each process's last document; the roles of all are created by name."""
    last = last_documents.select("process_id", F.explode("roles").alias("name"), F.lit(True).alias("_last"))
    pairs = (documents.select("process_id", F.explode("roles").alias("name")).distinct()
             .join(last.distinct(), ["process_id", "name"], "left"))
    existing = graph.label("Role").groupBy("name").agg(F.min("node_id").alias("_stored"))
    placed = pairs.join(existing, "name", "left").withColumn("src_id", F.coalesce("_stored", node_id("Role", F.col("name"))))
    placed = cut_lineage(placed)
    fresh = placed.filter(F.col("_stored").isNull()).select(
        F.lit("Role").alias("label"), F.col("src_id").alias("node_id"), "name").distinct()
    graph = _put_nodes(graph, "Role", graph.label("Role").unionByName(conform(fresh, model.NODE_SCHEMA)))
    edges = edge_rows(placed.filter("_last").join(processes, "process_id").select("src_id", "dst_id").distinct(),
                      "PARTICIPATES_IN", "Role", "Process")
    if cleared:
        return _put_edges(graph, ["PARTICIPATES_IN"], graph.relation("PARTICIPATES_IN").unionByName(edges))
    return merge_edges(graph, "PARTICIPATES_IN", edges)


def follows_edges(graph: Graph, documents: DataFrame, processes: DataFrame, *, replace: bool = False) -> Graph:
    """FOLLOWS to every process of the predecessor's name; a name without a process gets a placeholder."""
    pairs = documents.select("process_id", F.explode("follows_after").alias("name")).distinct().join(
        processes.select("process_id", F.col("dst_id").alias("src_id")), "process_id")
    known = graph.label("Process").select("name", F.col("node_id").alias("dst_id"))
    missing = pairs.select("name").distinct().join(known, "name", "left_anti").select(
        F.lit("Process").alias("label"), "name", F.lit(True).alias("placeholder"),
        hashed_node_id(F.lit("Process"), F.lit("placeholder"), F.col("name")).alias("node_id"))
    missing = cut_lineage(missing)
    placed = known.unionByName(missing.select("name", F.col("node_id").alias("dst_id")))
    graph = _put_nodes(graph, "Process", graph.label("Process").unionByName(conform(missing, model.NODE_SCHEMA)))
    if replace:
        scope = processes.select(F.col("dst_id").alias("src_id")).distinct()
        graph = _put_edges(graph, ["FOLLOWS"], graph.relation("FOLLOWS").join(scope, "src_id", "left_anti"))
    edges = edge_rows(pairs.join(placed, "name").select("src_id", "dst_id").distinct(), "FOLLOWS", "Process", "Process")
    # Stored edges are made distinct and win over new ones in one aggregation; an edge without an end is like no other.
    both = graph.relation("FOLLOWS").withColumn("_new", F.lit(1)).unionByName(edges.withColumn("_new", F.lit(2))).withColumn(
        "_apart", F.when(F.col("src_id").isNull() | F.col("dst_id").isNull(), F.col("_new")).otherwise(F.lit(0)))
    return _put_edges(graph, ["FOLLOWS"], first_by(both, [*EDGE_KEY, "_apart"], [F.col("_new")]))


def write_documents(graph: Graph, documents: DataFrame, matches: DataFrame, *,
                    replace_follows: bool = False) -> tuple[Graph, DataFrame]:
    """Bring extracted documents and their matches into the graph; re-running changes nothing.

    ``documents`` has process_id, process_name, source_path, roles, follows_after and ordinal. Of several documents
    of a process each adds its roles, predecessors and applications as nodes; the last one alone decides the
    process name and the edges that a document replaces (SERVES, MAY_SERVE, PARTICIPATES_IN). Returns the graph
    and (process_id, node_id, action).
    """
    latest = documents.groupBy("process_id").agg(F.max("ordinal").alias("doc_ordinal"))
    last_documents = documents.join(latest, (documents["process_id"] == latest["process_id"]) & (F.col("ordinal") == F.col("doc_ordinal")), "left_semi")
    graph, actions = upsert_processes(graph, documents, distinct=False)
    processes = actions.select("process_id", F.col("node_id").alias("dst_id"))
    # The matches are many and meet all that is known of their documents at once.
    known = documents.select("process_id", "source_path", F.col("ordinal").alias("doc_ordinal")).join(
        latest.select("process_id", F.col("doc_ordinal").alias("_latest")), "process_id").join(processes, "process_id")
    numbered = matches.join(known, ["process_id", "source_path"])
    last_matches = numbered.filter(F.col("doc_ordinal") == F.col("_latest"))
    scope = ["SERVES", "MAY_SERVE", "PARTICIPATES_IN"]
    cleared = _of_types(graph, scope).join(processes.select("dst_id"), "dst_id", "left_anti")
    # Edges of the former relation name run from the process to the application.
    old = graph.relation("NUTZT").join(processes.select(F.col("dst_id").alias("src_id")), "src_id", "left_anti")
    graph = _put_edges(graph, [*scope, "NUTZT"], cleared.select(*model.EDGE_SCHEMA.names).unionByName(
        old.select(*model.EDGE_SCHEMA.names)))
    # New edges end at the processes, stored ones no longer do: they need not be compared.
    graph = role_edges(graph, documents, last_documents, processes, cleared=True)
    graph = follows_edges(graph, documents, processes, replace=replace_follows)
    graph = serves_edges(graph, numbered, last_matches, cleared=True)
    return may_serve_edges(graph, last_matches, cleared=True), actions


# Owners and roles -----------------------------------------------------------------------------------

def set_process_owners(graph: Graph, owners: DataFrame) -> Graph:
    """Exactly one RESPONSIBLE_FOR per listed process; ``owners`` has process_id and org_unit_name, unique per process."""
    cleaned = owners.select("process_id", text.squeeze(F.col("org_unit_name")).alias("name")).filter(F.col("name") != "")
    graph, units = ensure_org_units(graph, cleaned)
    processes = graph.label("Process").filter(F.col("process_id").isNotNull()).select(
        "process_id", F.col("node_id").alias("dst_id"))
    fresh = edge_rows(cleaned.join(units, "name").join(processes, "process_id").select(
        F.col("org_id").alias("src_id"), "dst_id").distinct(), "RESPONSIBLE_FOR", "OrgUnit", "Process")
    return _put_edges(graph, ["RESPONSIBLE_FOR"], replace_scope(
        graph.relation("RESPONSIBLE_FOR"), fresh.select("dst_id"), ["dst_id"], fresh))


def clear_process_owners(graph: Graph, process_ids: DataFrame) -> Graph:
    gone = graph.label("Process").join(process_ids.select("process_id"), "process_id", "left_semi").select(
        F.col("node_id").alias("dst_id"))
    return _put_edges(graph, ["RESPONSIBLE_FOR"], graph.relation("RESPONSIBLE_FOR").join(gone, "dst_id", "left_anti"))


def assign_roles(graph: Graph, rows: DataFrame) -> Graph:
    """CAN_ASSUME for (org_unit_name, role_name); both ends are created when missing."""
    cleaned = rows.select(text.squeeze(F.col("org_unit_name")).alias("name"), F.col("role_name")).filter(F.col("name") != "")
    graph, units = ensure_org_units(graph, cleaned)
    existing = graph.label("Role").groupBy(F.col("name").alias("role_name")).agg(F.min("node_id").alias("_stored"))
    placed = cleaned.join(existing, "role_name", "left").withColumn(
        "dst_id", F.coalesce("_stored", node_id("Role", F.col("role_name"))))
    placed = cut_lineage(placed)
    fresh = placed.filter(F.col("_stored").isNull()).select(
        F.lit("Role").alias("label"), F.col("dst_id").alias("node_id"), F.col("role_name").alias("name")).distinct()
    graph = _put_nodes(graph, "Role", graph.label("Role").unionByName(conform(fresh, model.NODE_SCHEMA)))
    edges = edge_rows(placed.join(units, "name").select(F.col("org_id").alias("src_id"), "dst_id").distinct(),
                      "CAN_ASSUME", "OrgUnit", "Role")
    return merge_edges(graph, "CAN_ASSUME", edges)


def mark_role_only(graph: Graph, roles: DataFrame) -> Graph:
    marked = roles.select(F.col("role_name").alias("name")).distinct().withColumn("_hit", F.lit(True))
    nodes = graph.label("Role").join(marked, "name", "left").withColumn(
        "role_only", F.when(F.col("_hit"), F.lit(True)).otherwise(F.col("role_only")))
    return _put_nodes(graph, "Role", nodes)
