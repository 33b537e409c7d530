"""The documented questions and the pattern operations over the projected graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatemap.functions import query as fn
from estatemap.plans import catalogue
from estatemap.plans.pattern import edge, match, order_by, page, union, union_all
from workload.registry import graph_query
from workload.star import edge_sql, node_sql

A, P, S, I, O, R = "Application", "Process", "Server", "Interface", "OrgUnit", "Role"


n, e = node_sql, edge_sql

SERVED = f"{n(A)} a JOIN {e('SERVES')} r ON r.src_id = a.node_id JOIN {n(P)} p ON p.node_id = r.dst_id"
HOSTED = f"{n(A)} a JOIN {e('RUNS_ON', A, S)} h ON h.src_id = a.node_id JOIN {n(S)} s ON s.node_id = h.dst_id"
OWNED = f"{n(O)} o JOIN {e('RESPONSIBLE_FOR', O, P)} w ON w.src_id = o.node_id JOIN {n(P)} p ON p.node_id = w.dst_id"

# R1 - R18 --------------------------------------------------------------------------------------------

graph_query("applications_of_process",
            f"SELECT DISTINCT a.name AS application FROM {SERVED} WHERE p.name = 'red ring'")(
    lambda g: catalogue.applications_of_process(g, "red ring"))
graph_query("processes_of_unit", f"SELECT DISTINCT p.name AS process FROM {OWNED} WHERE o.name = 'ASIA'")(
    lambda g: catalogue.processes_of_unit(g, "ASIA"))
graph_query("processes_of_application",
            f"SELECT DISTINCT p.name AS process, a.name AS application FROM {SERVED} WHERE lower(a.name) LIKE '%00003%'")(
    lambda g: catalogue.processes_of_application(g, "00003"))
graph_query("object_counts",
            "SELECT count(*) FILTER (label = 'Application') AS application_count, "
            "count(*) FILTER (label = 'Process') AS process_count FROM nodes")(catalogue.object_counts)
graph_query("units_without_process",
            f"SELECT count(*) AS org_unit_count, count(*) FILTER (NOT EXISTS (SELECT 1 FROM {e('RESPONSIBLE_FOR', O, P)} w "
            f"WHERE w.src_id = o.node_id)) AS org_units_without_process_count FROM {n(O)} o")(catalogue.units_without_process)

_FREE = ", ".join(
    f"(SELECT count(*) FROM {n(label)} x WHERE NOT EXISTS (SELECT 1 FROM edges w WHERE w.rel_type = 'RESPONSIBLE_FOR' "
    f"AND w.dst_id = x.node_id)) AS ownerless_{label.lower()}_count" for label in (P, A, I, S))
graph_query("ownerless_counts", f"SELECT {_FREE}")(catalogue.ownerless_counts)
graph_query("governance_gaps",
            f"SELECT {_FREE}, server, application_count FROM (SELECT s.name AS server, count(DISTINCT a.node_id) AS "
            f"application_count FROM {HOSTED} GROUP BY s.name ORDER BY 2 DESC, 1 LIMIT 5)")(catalogue.governance_gaps)
graph_query("server_concentration",
            f"SELECT s.name AS server, count(DISTINCT a.node_id) AS application_count FROM {HOSTED} GROUP BY s.name")(
    catalogue.server_concentration)
graph_query("server_of_application",
            f"SELECT a.name AS application, s.name AS server, s.server_type FROM {HOSTED} WHERE lower(a.name) LIKE '%supplier#%5'")(
    lambda g: match(g, "a:Application").where(lambda c: c("a.name").endswith("5")).hop("a", "RUNS_ON", "s:Server").select(
        application="a.name", server="s.name", server_type="s.server_type"))
graph_query("server_of_named_application",
            f"SELECT a.name AS application, s.name AS server, s.server_type FROM {HOSTED} WHERE lower(a.name) LIKE '%0007%'")(
    lambda g: catalogue.server_of_application(g, "0007"))
graph_query("server_impact",
            f"SELECT s.name AS server, a.name AS application, p.name AS process, o.name AS org_unit FROM {HOSTED} "
            f"LEFT JOIN ({e('SERVES')} r JOIN {n(P)} p ON p.node_id = r.dst_id) ON r.src_id = a.node_id "
            f"LEFT JOIN ({e('RESPONSIBLE_FOR', O, P)} w JOIN {n(O)} o ON o.node_id = w.src_id) ON w.dst_id = p.node_id")(catalogue.server_impact)
graph_query("affected_processes",
            f"SELECT DISTINCT p.name AS process, a.name AS application FROM {HOSTED} JOIN {e('SERVES')} r ON r.src_id = a.node_id "
            f"JOIN {n(P)} p ON p.node_id = r.dst_id WHERE s.name = 'NATION_15'")(
    lambda g: catalogue.affected_processes(g, "NATION_15"))
graph_query("open_candidates_of_process",
            f"SELECT a.name AS application, r.score FROM {n(A)} a JOIN {e('MAY_SERVE')} r ON r.src_id = a.node_id "
            f"JOIN {n(P)} p ON p.node_id = r.dst_id WHERE p.name = 'blue bolt'")(
    lambda g: catalogue.open_candidates_of_process(g, "blue bolt"))
graph_query("role_only_roles", f"SELECT name AS role FROM {n(R)} WHERE role_only")(catalogue.role_only_roles)
graph_query("on_server",
            f"SELECT x.name AS application, x.label AS type FROM nodes x JOIN edges h ON h.src_id = x.node_id AND h.rel_type = 'RUNS_ON' "
            f"JOIN {n(S)} s ON s.node_id = h.dst_id WHERE s.name = 'NATION_3' AND x.label IN ('Application', 'Interface')")(
    lambda g: catalogue.on_server(g, "NATION_3"))
graph_query("documented_risks",
            f"SELECT r.name AS risk, t.label AS target_type, t.name AS target FROM {n('Risk')} r JOIN {e('AFFECTS')} x "
            f"ON x.src_id = r.node_id JOIN nodes t ON t.node_id = x.dst_id")(catalogue.documented_risks)
graph_query("capabilities_against_risk",
            f"SELECT f.name AS faehigkeit, r.name AS risk FROM {n('Risk')} r JOIN {e('MITIGATES')} m ON m.dst_id = r.node_id "
            f"JOIN {n('Capability')} f ON f.node_id = m.src_id WHERE lower(r.name) LIKE '%err%'")(
    lambda g: catalogue.capabilities_against_risk(g, "ERR"))
graph_query("goal_support",
            f"SELECT a.name AS application, z.name AS ziel FROM {n(A)} a JOIN {e('SUPPORTS')} x ON x.src_id = a.node_id "
            f"JOIN {n('Goal')} z ON z.node_id = x.dst_id")(catalogue.goal_support)
graph_query("data_and_infrastructure",
            f"SELECT a.name AS application, d.name AS datenobjekt, i.name AS infrastruktur FROM {n(A)} a JOIN {e('PROCESSES')} x "
            f"ON x.src_id = a.node_id JOIN {n('DataObject')} d ON d.node_id = x.dst_id LEFT JOIN "
            f"({e('RUNS_ON', A, 'Infrastructure')} y JOIN {n('Infrastructure')} i ON i.node_id = y.dst_id) ON y.src_id = a.node_id")(
    catalogue.data_and_infrastructure)
graph_query("process_resources",
            f"SELECT p.name AS process, r.name AS ressource FROM {n(P)} p JOIN {e('REQUIRES')} x ON x.src_id = p.node_id "
            f"JOIN {n('Resource')} r ON r.node_id = x.dst_id")(catalogue.process_resources)
_TAKING = (f"SELECT DISTINCT p.name AS process, 'participating' AS kind, r.name AS role, o.name AS org_unit FROM {n(P)} p "
           f"JOIN {e('PARTICIPATES_IN')} x ON x.dst_id = p.node_id JOIN {n(R)} r ON r.node_id = x.src_id LEFT JOIN "
           f"({e('CAN_ASSUME')} c JOIN {n(O)} o ON o.node_id = c.src_id) ON c.dst_id = r.node_id")
graph_query("people_of_process",
            f"SELECT DISTINCT p.name AS process, 'responsible' AS kind, CAST(NULL AS VARCHAR) AS role, o.name AS org_unit FROM {OWNED} "
            f"UNION {_TAKING}")(catalogue.people_of_process)
graph_query("node_degrees",
            "SELECT label, node_id, name, (SELECT count(*) FROM edges x WHERE x.dst_id = n.node_id) AS fan_in, "
            "(SELECT count(*) FROM edges x WHERE x.src_id = n.node_id) AS fan_out FROM nodes n")(catalogue.degrees)
graph_query("interfaces_per_application",
            f"SELECT a.node_id AS application_id, a.name AS application, count(DISTINCT i.node_id) AS interface_count FROM {n(A)} a "
            f"JOIN {e('USES_INTERFACE')} u ON u.src_id = a.node_id JOIN {n(I)} i ON i.node_id = u.dst_id GROUP BY 1, 2")(
    catalogue.interfaces_per_application)
graph_query("process_density",
            f"SELECT p.node_id, p.name AS process, count(DISTINCT a.node_id) AS application_count FROM {SERVED} GROUP BY 1, 2")(
    catalogue.process_density)
graph_query("orphaned_nodes",
            "SELECT label, node_id, name FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.src_id = n.node_id) "
            "AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.dst_id = n.node_id)")(catalogue.orphans)

# Pattern operations ----------------------------------------------------------------------------------

graph_query("node_lookup", f"SELECT node_id, process_id FROM {n(P)} WHERE name = 'old anvil'")(
    lambda g: match(g, "p:Process", name="old anvil").select(node_id="p.node_id", process_id="p.process_id"))
graph_query("hop_chain",
            f"SELECT a.name AS application, p.name AS process, o.name AS org_unit FROM {SERVED} JOIN {e('RESPONSIBLE_FOR', O, P)} w "
            f"ON w.dst_id = p.node_id JOIN {n(O)} o ON o.node_id = w.src_id WHERE o.name = 'EUROPE'")(
    lambda g: match(g, "a:Application").hop("a", "SERVES", "p:Process").hop(
        "p", "RESPONSIBLE_FOR", "o:OrgUnit", reverse=True, name="EUROPE").select(
        application="a.name", process="p.name", org_unit="o.name"))
graph_query("two_patterns_shared",
            f"SELECT a.name AS application, count(*) AS pairs FROM {SERVED} JOIN {e('USES_INTERFACE')} u ON u.src_id = a.node_id "
            f"GROUP BY a.name")(
    lambda g: edge(g, "a:Application", "SERVES", "p:Process").with_("a", processes=F.count(F.lit(1))).also(
        edge(g, "a:Application", "USES_INTERFACE", "i:Interface").with_("a", interfaces=F.count(F.lit(1)))).also(
        match(g, "a:Application")).select(application="a.name", pairs=F.col("processes") * F.col("interfaces")))
graph_query("optional_with_condition",
            f"SELECT p.name AS process, p.node_id, a.name AS application FROM {n(P)} p LEFT JOIN ({e('MAY_SERVE')} r JOIN {n(A)} a "
            f"ON a.node_id = r.src_id AND r.score > 0.89) ON r.dst_id = p.node_id")(
    lambda g: match(g, "p:Process").optional(
        match(g, "a:Application").hop("a", "MAY_SERVE", "p:Process", rel="r").where(lambda c: c("r.score") > 0.89)).select(
        process="p.name", node_id="p.node_id", application="a.name"))
graph_query("where_operators",
            f"SELECT a.node_id, a.name FROM {n(A)} a WHERE (a.name LIKE 'Supplier#%' AND a.name LIKE '%7') "
            f"<> (regexp_full_match(a.name, '.*#0+[1-4].*') OR contains(a.name, '99')) AND a.cmdb_id IS NOT NULL "
            f"AND CAST(a.cmdb_id AS BIGINT) % 3 IN (0, 1)")(
    lambda g: match(g, "a:Application").where(lambda c: fn.xor(
        c("a.name").startswith("Supplier#") & c("a.name").endswith("7"),
        fn.matches(c("a.name"), ".*#0+[1-4].*") | c("a.name").contains("99"))
        & c("a.cmdb_id").isNotNull() & (fn.to_integer(c("a.cmdb_id")) % 3).isin(0, 1)).select(node_id="a.node_id", name="a.name"))
graph_query("exists_pattern",
            f"SELECT p.node_id FROM {n(P)} p WHERE EXISTS (SELECT 1 FROM {e('MAY_SERVE')} r WHERE r.dst_id = p.node_id) "
            f"AND NOT EXISTS (SELECT 1 FROM {e('RESPONSIBLE_FOR', O, P)} w WHERE w.dst_id = p.node_id)")(
    lambda g: match(g, "p:Process").exists(edge(g, "a:Application", "MAY_SERVE", "p:Process")).not_exists(
        edge(g, "o:OrgUnit", "RESPONSIBLE_FOR", "p:Process")).select(node_id="p.node_id"))
graph_query("with_barrier",
            f"SELECT s.name AS server, c.apps, count(*) AS interfaces FROM (SELECT h.dst_id, count(*) AS apps FROM "
            f"{e('RUNS_ON', A, S)} h GROUP BY 1 HAVING count(*) >= 2) c JOIN {n(S)} s ON s.node_id = c.dst_id "
            f"JOIN {e('RUNS_ON', I, S)} j ON j.dst_id = s.node_id GROUP BY 1, 2")(
    lambda g: match(g, "s:Server").hop("s", "RUNS_ON", "a:Application", reverse=True).with_("s", apps=F.count(F.lit(1))).where(
        lambda c: c("apps") >= 2).hop("s", "RUNS_ON", "i:Interface", reverse=True).group(
        {"server": "s.name", "apps": "apps"}, interfaces=F.count(F.lit(1))))
graph_query("distinct_values",
            f"SELECT DISTINCT p.name AS process, r.source FROM {SERVED}")(
    lambda g: edge(g, "a:Application", "SERVES", "p:Process").hop("a", "SERVES", "p", rel="r").select(
        process="p.name", source="r.source", distinct=True))
graph_query("ordered_page",
            f"SELECT name, process_id FROM {n(P)} ORDER BY name DESC, CAST(process_id AS BIGINT) OFFSET 7 LIMIT 12")(
    lambda g: page(order_by(match(g, "p:Process").select(
        name="p.name", process_id="p.process_id", _number=lambda c: c("p.process_id").cast("long")), "-name", "_number"),
        7, 12).drop("_number"))
graph_query("union_of_branches",
            f"SELECT name AS item FROM {n(I)} UNION SELECT name AS item FROM {n(S)} UNION SELECT name FROM {n(P)}")(
    lambda g: union(*[match(g, f"x:{label}").select(item="x.name") for label in (I, S, P)]))
graph_query("union_all_of_branches",
            f"SELECT name AS item FROM {n(P)} UNION ALL SELECT name FROM {n(R)}")(
    lambda g: union_all(*[match(g, f"x:{label}").select(item="x.name") for label in (P, R)]))
graph_query("aggregates",
            f"SELECT a.name AS application, count(*) AS edges, count(r.score) AS scored, round(sum(r.score), 4) AS total, "
            f"round(avg(r.score), 6) AS mean, min(r.score) AS low, max(r.score) AS high, count(DISTINCT r.score) AS kinds "
            f"FROM {n(A)} a JOIN {e('MAY_SERVE')} r ON r.src_id = a.node_id GROUP BY a.name")(
    lambda g: match(g, "a:Application").hop("a", "MAY_SERVE", "p:Process", rel="r").group(
        {"application": "a.name"}, edges=F.count(F.lit(1)), scored=F.count("r__score"),
        total=F.round(fn.total(F.col("r__score")), 4), mean=F.round(F.avg("r__score"), 6), low=F.min("r__score"),
        high=F.max("r__score"), kinds=F.count_distinct("r__score")))
graph_query("string_functions",
            f"SELECT node_id, lower(name) AS low, upper(name) AS up, trim(concat('  ', name, ' ')) AS trimmed, "
            f"ltrim(concat('  ', name)) AS left_trimmed, rtrim(concat(name, '  ')) AS right_trimmed, "
            f"replace(name, ' ', '-') AS replaced, substring(name, 3, 4) AS part, substring(name, 6) AS tail, "
            f"reverse(name) AS backward, CAST(length(name) AS BIGINT) AS size, coalesce(cmdb_id, process_id, 'none') AS ident, "
            f"split_part(name, ' ', 1) AS first_word, CAST(CAST(process_id AS BIGINT) AS VARCHAR) AS as_text FROM {n(P)}")(
    lambda g: match(g, "p:Process").select(
        node_id="p.node_id", low=lambda c: F.lower(c("p.name")), up=lambda c: F.upper(c("p.name")),
        trimmed=lambda c: F.trim(F.concat(F.lit("  "), c("p.name"), F.lit(" "))),
        left_trimmed=lambda c: F.ltrim(F.concat(F.lit("  "), c("p.name"))),
        right_trimmed=lambda c: F.rtrim(F.concat(c("p.name"), F.lit("  "))),
        replaced=lambda c: F.replace(c("p.name"), F.lit(" "), F.lit("-")),
        part=lambda c: fn.substring(c("p.name"), 2, 4), tail=lambda c: fn.substring(c("p.name"), 5),
        backward=lambda c: F.reverse(c("p.name")), size=lambda c: fn.text_size(c("p.name")).cast("long"),
        ident=lambda c: F.coalesce(c("p.cmdb_id"), c("p.process_id"), F.lit("none")),
        first_word=lambda c: fn.head(fn.split(c("p.name"), " ")),
        as_text=lambda c: fn.to_integer(c("p.process_id")).cast("string")))
graph_query("numeric_functions",
            f"SELECT src_id, dst_id, CAST(floor(score * 100 - 85.5 + 0.5) AS DOUBLE) AS rounded, CAST(ceil(score * 10) AS BIGINT) AS up, "
            f"CAST(floor(score * 10) AS BIGINT) AS down, abs(0.85 - score) AS distance, TRY_CAST(replace(src_id, 'Application:', '') AS BIGINT) AS number, "
            f"TRY_CAST(dst_id AS DOUBLE) AS no_number, CAST(trunc((CAST(replace(src_id, 'Application:', '') AS BIGINT) - 50) / 7) AS BIGINT) AS div "
            f"FROM {e('MAY_SERVE')}")(
    lambda g: edge_values(g))
graph_query("list_functions",
            f"SELECT node_id, string_split(name, ' ')[1] AS first, string_split(name, ' ')[-1] AS last, "
            f"array_to_string(list_reverse(string_split(name, ' ')), '|') AS reversed, CAST(len(string_split(name, ' ')) AS BIGINT) AS size "
            f"FROM {n(P)}")(
    lambda g: match(g, "p:Process").select(
        node_id="p.node_id", first=lambda c: fn.head(fn.split(c("p.name"), " ")),
        last=lambda c: fn.last(fn.split(c("p.name"), " ")),
        reversed=lambda c: F.array_join(F.reverse(fn.split(c("p.name"), " ")), "|"),
        size=lambda c: fn.list_size(fn.split(c("p.name"), " ")).cast("long")))
graph_query("relationship_type",
            f"SELECT r.rel_type AS kind, count(*) AS edges FROM edges r WHERE src_label = 'Application' AND dst_label = 'Process' GROUP BY 1")(
    lambda g: union_all(*[
        match(g, "a:Application").hop("a", rel, "p:Process", rel="r").group({"kind": "r.rel_type"}, edges=F.count(F.lit(1)))
        for rel in ("SERVES", "MAY_SERVE")]))
graph_query("case_expressions",
            f"SELECT s.node_id, CASE s.server_type WHEN 'physical' THEN 'P' WHEN 'virtual' THEN 'V' END AS short, "
            f"CASE WHEN s.name LIKE '%1' THEN 'one' WHEN s.name LIKE '%2' THEN 'two' ELSE 'more' END AS tail FROM {n(S)} s")(
    lambda g: match(g, "s:Server").select(
        node_id="s.node_id", short=lambda c: fn.case_of(c("s.server_type"), ("physical", "P"), ("virtual", "V")),
        tail=lambda c: fn.case((c("s.name").endswith("1"), "one"), (c("s.name").endswith("2"), "two"), default="more")))


def edge_values(g):
    number = fn.to_integer(F.replace("src_id", F.lit("Application:"), F.lit("")))
    return g.relation("MAY_SERVE").select(
        "src_id", "dst_id", fn.round_half_up(F.col("score") * 100 - 85.5).alias("rounded"),
        F.ceil(F.col("score") * 10).alias("up"), F.floor(F.col("score") * 10).alias("down"),
        F.abs(0.85 - F.col("score")).alias("distance"), number.alias("number"), fn.to_float(F.col("dst_id")).alias("no_number"),
        fn.int_divide(number - 50, F.lit(7)).alias("div"))
