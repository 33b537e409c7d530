"""The documented questions about an architecture as named queries.

Counts are independent aggregates: a label without nodes gives 0 instead of no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatemap.functions.naming import node_id
from estatemap.graph import Graph
from estatemap.plans.pattern import edge, match, order_by, side_by_side, union, union_all


def _contains(name: str, part: str):
    return lambda c: F.contains(F.lower(c(name)), F.lit(part.lower()))


def applications_of_process(graph: Graph, process: str) -> DataFrame:
    rows = match(graph, "p:Process", name=process).hop("p", "SERVES", "a:Application", reverse=True)
    return order_by(rows.select(application="a.name", distinct=True), "application")


def processes_of_unit(graph: Graph, unit: str) -> DataFrame:
    rows = match(graph, "o:OrgUnit", name=unit).hop("o", "RESPONSIBLE_FOR", "p:Process")
    return order_by(rows.select(process="p.name", distinct=True), "process")


def processes_of_application(graph: Graph, part: str) -> DataFrame:
    """Processes and applications for a part of the application name."""
    rows = match(graph, "a:Application").where(_contains("a.name", part)).hop("a", "SERVES", "p:Process")
    return order_by(rows.select(process="p.name", application="a.name", distinct=True), "process", "application")


def object_counts(graph: Graph) -> DataFrame:
    applications = graph.label("Application").agg(F.count(F.lit(1)).alias("application_count"))
    processes = graph.label("Process").agg(F.count(F.lit(1)).alias("process_count"))
    return side_by_side(applications, processes)


def units_without_process(graph: Graph) -> DataFrame:
    owning = edge(graph, "o:OrgUnit", "RESPONSIBLE_FOR", "p:Process")
    rows = match(graph, "o:OrgUnit").flag("owns", owning)
    return rows.group(
        org_unit_count=F.count(F.lit(1)), org_units_without_process_count=F.count_if(~F.col("owns")))


def ownerless_counts(graph: Graph) -> DataFrame:
    """How many processes, applications, interfaces and servers have no responsible unit, as one row."""
    labels = ["Process", "Application", "Interface", "Server"]

    def free(label: str) -> DataFrame:
        owned = graph.relation("RESPONSIBLE_FOR", "OrgUnit", label).select(F.col("dst_id").alias("node_id"))
        return graph.label(label).select("label", "node_id").join(owned, "node_id", "left_anti").groupBy("label").agg(
            F.count(F.lit(1)).alias("n"))

    counts = reduce(DataFrame.unionByName, [free(label) for label in labels])
    return counts.agg(*[
        F.coalesce(F.sum(F.when(F.col("label") == label, F.col("n"))), F.lit(0)).alias(f"ownerless_{label.lower()}_count")
        for label in labels
    ])


def server_concentration(graph: Graph, top: int | None = None) -> DataFrame:
    """Applications per server, most first; ``top`` keeps the head of the list."""
    rows = match(graph, "s:Server").hop("s", "RUNS_ON", "a:Application", reverse=True)
    ranked = order_by(rows.group({"server": "s.name"}, application_count=F.count_distinct("a__node_id")),
                      "-application_count", "server")
    return ranked.limit(top) if top else ranked


def governance_gaps(graph: Graph, top: int = 5) -> DataFrame:
    """Ownerless counts next to the servers that carry most applications.

    The counts repeat on every server row; with no server at all they still come back once.
    """
    key = F.lit(1).alias("_k")
    counts = ownerless_counts(graph).select("*", key)
    servers = server_concentration(graph, top).select("*", key)
    # Both sides are bounded: one row of counts and ``top`` servers.
    return order_by(counts.join(servers, "_k", "left").drop("_k"), "-application_count", "server")


def server_of_application(graph: Graph, part: str) -> DataFrame:
    rows = match(graph, "a:Application").where(_contains("a.name", part)).hop("a", "RUNS_ON", "s:Server")
    return rows.select(application="a.name", server="s.name", server_type="s.server_type")


def server_impact(graph: Graph, server: str | None = None) -> DataFrame:
    """What an outage touches: the technical chain is required, process and responsibility are optional."""
    start = match(graph, "s:Server", name=server) if server else match(graph, "s:Server")
    rows = (
        start.hop("s", "RUNS_ON", "a:Application", reverse=True)
        .optional(edge(graph, "a:Application", "SERVES", "p:Process"))
        .optional(match(graph, "o:OrgUnit").hop("o", "RESPONSIBLE_FOR", "p:Process"))
    )
    return rows.select(server="s.name", application="a.name", process="p.name", org_unit="o.name")


def affected_processes(graph: Graph, server: str) -> DataFrame:
    rows = match(graph, "s:Server", name=server).hop("s", "RUNS_ON", "a:Application", reverse=True).hop(
        "a", "SERVES", "p:Process")
    return order_by(rows.select(process="p.name", application="a.name", distinct=True), "process", "application")


def open_candidates_of_process(graph: Graph, process: str) -> DataFrame:
    rows = match(graph, "p:Process", name=process).hop("p", "MAY_SERVE", "a:Application", reverse=True, rel="r")
    return order_by(rows.select(application="a.name", score="r.score"), "-score")


def role_only_roles(graph: Graph) -> DataFrame:
    return order_by(match(graph, "r:Role", role_only=True).select(role="r.name"), "role")


def on_server(graph: Graph, server: str) -> DataFrame:
    """Applications and interfaces on a server."""
    branches = [
        match(graph, "s:Server", name=server).hop("s", "RUNS_ON", f"x:{label}", reverse=True).select(
            application="x.name", type=F.lit(label))
        for label in ("Application", "Interface")
    ]
    return order_by(union_all(*branches), "type", "application")


def documented_risks(graph: Graph) -> DataFrame:
    """Modeled risks and what they affect."""
    branches = [
        match(graph, "r:Risk").hop("r", "AFFECTS", f"t:{label}").select(
            risk="r.name", target_type=F.lit(label), target="t.name")
        for label in ("Application", "Process", "Server", "Interface")
    ]
    return order_by(union_all(*branches), "risk", "target_type", "target")


def capabilities_against_risk(graph: Graph, part: str) -> DataFrame:
    rows = match(graph, "r:Risk").where(_contains("r.name", part)).hop("r", "MITIGATES", "f:Capability", reverse=True)
    return order_by(rows.select(faehigkeit="f.name", risk="r.name"), "faehigkeit")


def goal_support(graph: Graph) -> DataFrame:
    rows = match(graph, "a:Application").hop("a", "SUPPORTS", "z:Goal")
    return order_by(rows.select(application="a.name", ziel="z.name"), "application", "ziel")


def data_and_infrastructure(graph: Graph) -> DataFrame:
    """Data objects of applications, with the infrastructure they run on if any."""
    rows = match(graph, "a:Application").hop("a", "PROCESSES", "d:DataObject").optional(
        edge(graph, "a:Application", "RUNS_ON", "i:Infrastructure"))
    return order_by(rows.select(application="a.name", datenobjekt="d.name", infrastruktur="i.name"),
                    "application", "datenobjekt")


def process_resources(graph: Graph) -> DataFrame:
    rows = match(graph, "p:Process").hop("p", "REQUIRES", "r:Resource")
    return order_by(rows.select(process="p.name", ressource="r.name"), "process", "ressource")


def people_of_process(graph: Graph, process: str | None = None) -> DataFrame:
    """Who is responsible and who takes part, with the units behind each role."""
    start = match(graph, "p:Process", name=process) if process else match(graph, "p:Process")
    none = F.lit(None).cast("string")
    responsible = start.hop("p", "RESPONSIBLE_FOR", "o:OrgUnit", reverse=True).select(
        process="p.name", kind=F.lit("responsible"), role=none, org_unit="o.name")
    taking_part = start.hop("p", "PARTICIPATES_IN", "r:Role", reverse=True).optional(
        match(graph, "o:OrgUnit").hop("o", "CAN_ASSUME", "r:Role")).select(
        process="p.name", kind=F.lit("participating"), role="r.name", org_unit="o.name")
    return order_by(union(responsible, taking_part), "process", "kind", "role", "org_unit")


# Complexity ------------------------------------------------------------------------------------------

def degrees(graph: Graph) -> DataFrame:
    """Fan-in and fan-out of every node; nodes without edges count 0. One aggregation over both ends."""
    ends = F.explode(F.array(
        F.struct(F.col("src_id").alias("node_id"), F.lit(1).alias("out"), F.lit(0).alias("in")),
        F.struct(F.col("dst_id").alias("node_id"), F.lit(0).alias("out"), F.lit(1).alias("in"))))
    counted = graph.edges.select(ends.alias("e")).groupBy("e.node_id").agg(
        F.sum("e.in").alias("fan_in"), F.sum("e.out").alias("fan_out"))
    zero = F.lit(0).cast("long")
    return graph.nodes.join(counted, "node_id", "left").select(
        "label", "node_id", "name", F.coalesce("fan_in", zero).alias("fan_in"), F.coalesce("fan_out", zero).alias("fan_out"))


def interfaces_per_application(graph: Graph) -> DataFrame:
    rows = match(graph, "a:Application").hop("a", "USES_INTERFACE", "i:Interface")
    return order_by(rows.group({"application_id": "a.node_id", "application": "a.name"},
                               interface_count=F.count_distinct("i__node_id")), "-interface_count", "application")


def process_density(graph: Graph) -> DataFrame:
    """Confirmed applications per process."""
    counts = graph.relation("SERVES", "Application", "Process").groupBy(F.col("dst_id").alias("node_id")).agg(
        F.count_distinct("src_id").alias("application_count"))
    return graph.label("Process").join(counts, "node_id").select(
        "node_id", F.col("name").alias("process"), "application_count")


def orphans(graph: Graph) -> DataFrame:
    """Nodes without any relationship; an anti join would be pushed into every label and repeat all edges there."""
    return degrees(graph).filter("fan_in = 0 AND fan_out = 0").select("label", "node_id", "name")


def process_node(process_id: str):
    return node_id("Process", F.lit(process_id))
