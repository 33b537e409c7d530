"""Resolution of names: decisions, similarity, organization units, aliases, relations."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatemap import model
from estatemap.operators import aliases, matching, modelgen, org, traverse, upserts
from workload.registry import graph_query, register
from workload.star import graph, graph_sql, plain, query, table

# Mentions and decisions ------------------------------------------------------------------------------

_PID = "CASE WHEN l_linestatus = 'O' THEN CAST(l_partkey AS STRING) ELSE '' END"
MENTIONS = (
    f"SELECT DISTINCT concat('doc ', l_orderkey) AS source_path, concat('process ', l_partkey) AS process, {_PID} AS process_id, "
    "concat('Supplier#', l_suppkey, ' Interface') AS application_name, l_linenumber AS position FROM {lineitem}")
_WHERE = "FROM {lineitem} WHERE l_returnflag = "
_LINK = f"concat('process ', l_partkey) AS process, {_PID} AS process_id, concat('Supplier#', l_suppkey, ' Interface') AS anwendung_name"
CONFIRMED = (f"SELECT DISTINCT {_LINK}, CAST(l_suppkey AS STRING) AS cmdb_id, concat('app ', l_suppkey) AS resolved_to, "
             f"CASE WHEN l_discount > 0.05 THEN 'manueller_link' ELSE 'manuell_bestaetigt' END AS quelle {_WHERE}'A'")
REJECTED = f"SELECT DISTINCT {_LINK}, CASE WHEN l_tax > 0.04 THEN CAST(l_suppkey AS STRING) END AS cmdb_id {_WHERE}'R'"
MASTER = ("SELECT CAST(s_suppkey AS STRING) AS cmdb_id, concat('SUPPLIER#', s_suppkey) AS name, s_suppkey AS ordinal FROM {supplier}")

_CTE = (f"WITH m AS ({plain(MENTIONS)}), c AS ({plain(CONFIRMED)}), x AS ({plain(REJECTED)}), a AS ({plain(MASTER)}), "
        "mm AS (SELECT *, CASE WHEN process_id <> '' THEN 'i' || process_id ELSE 'n' || process END AS scope FROM m), "
        "cc AS (SELECT *, CASE WHEN process_id <> '' THEN 'i' || process_id ELSE 'n' || process END AS scope FROM c), "
        "xx AS (SELECT *, CASE WHEN process_id <> '' THEN 'i' || process_id ELSE 'n' || process END AS scope FROM x), "
        "hit AS (SELECT DISTINCT mm.source_path, mm.process, mm.process_id, mm.application_name, mm.position, cc.cmdb_id, cc.resolved_to AS matched_name, "
        "'stark' AS confidence, CASE cc.quelle WHEN 'manueller_link' THEN 'knowledge_base_manual' ELSE 'knowledge_base' END AS source, 1.0::DOUBLE AS score "
        "FROM mm JOIN cc ON cc.scope = mm.scope AND cc.anwendung_name = mm.application_name), "
        "opn AS (SELECT * FROM mm WHERE NOT EXISTS (SELECT 1 FROM cc WHERE cc.scope = mm.scope AND cc.anwendung_name = mm.application_name)), "
        "ref AS (SELECT * FROM opn WHERE EXISTS (SELECT 1 FROM xx WHERE xx.scope = opn.scope AND xx.anwendung_name = opn.application_name AND xx.cmdb_id IS NULL)), "
        "rest AS (SELECT * FROM opn WHERE NOT EXISTS (SELECT 1 FROM xx WHERE xx.scope = opn.scope AND xx.anwendung_name = opn.application_name AND xx.cmdb_id IS NULL)), "
        # At threshold 1 two names match when they are equal in lower case or have the same key: here "supplier <number>".
        "sim AS (SELECT rest.source_path, rest.process, rest.process_id, rest.application_name, rest.position, a.cmdb_id, a.name AS matched_name, "
        "'schwach' AS confidence, 'fuzzy' AS source, 1.0::DOUBLE AS score, rest.scope FROM rest "
        "JOIN a ON lower(rest.application_name) = lower(a.name) || ' interface' WHERE NOT EXISTS (SELECT 1 FROM xx WHERE xx.scope = rest.scope "
        "AND xx.anwendung_name = rest.application_name AND xx.cmdb_id = a.cmdb_id)) ")
_NONE = "NULL::VARCHAR AS cmdb_id, NULL::VARCHAR AS matched_name, 'schwach' AS confidence"


def mentions(spark, folder):
    return query(spark, folder, MENTIONS)


register("confirmed_matches", _CTE + "SELECT * FROM hit")(
    lambda spark, folder: matching.match_confirmed(mentions(spark, folder), query(spark, folder, CONFIRMED)).drop("ordinal"))
register("rejected_matches",
         _CTE + f"SELECT source_path, process, process_id, application_name, position, {_NONE}, 'rejected' AS source, 0.0::DOUBLE AS score FROM mm "
         "WHERE EXISTS (SELECT 1 FROM xx WHERE xx.scope = mm.scope AND xx.anwendung_name = mm.application_name AND xx.cmdb_id IS NULL)")(
    lambda spark, folder: matching.match_rejected(mentions(spark, folder), query(spark, folder, REJECTED)).drop("ordinal"))
register("rejected_pairs",
         _CTE + "SELECT * FROM hit h WHERE NOT EXISTS (SELECT 1 FROM xx WHERE xx.scope = CASE WHEN h.process_id <> '' THEN 'i' || h.process_id "
         "ELSE 'n' || h.process END AND xx.anwendung_name = h.application_name AND xx.cmdb_id = h.cmdb_id)")(
    lambda spark, folder: matching.without_rejected_pairs(
        matching.match_confirmed(mentions(spark, folder), query(spark, folder, CONFIRMED)), query(spark, folder, REJECTED)).drop("ordinal"))
register("match_cascade",
         _CTE + f"SELECT * FROM hit UNION ALL SELECT source_path, process, process_id, application_name, position, {_NONE}, 'rejected', 0.0 FROM ref "
         "UNION ALL SELECT * EXCLUDE (scope) FROM sim "
         f"UNION ALL SELECT source_path, process, process_id, application_name, position, {_NONE}, 'unmatched', 0.0 FROM rest WHERE NOT EXISTS "
         "(SELECT 1 FROM sim WHERE sim.source_path = rest.source_path AND sim.application_name = rest.application_name AND sim.position = rest.position "
         "AND sim.scope = rest.scope AND sim.process = rest.process)")(
    lambda spark, folder: matching.match_terms(
        mentions(spark, folder), query(spark, folder, MASTER), query(spark, folder, CONFIRMED), query(spark, folder, REJECTED), 1.0).drop("ordinal"))
register("manual_matches",
         _CTE + "SELECT source_path, process, process_id, application_name, min(position) AS position, cmdb_id, matched_name, confidence, source, 0.0::DOUBLE AS score "
         "FROM hit GROUP BY ALL")(
    lambda spark, folder: matching.manual_matches(mentions(spark, folder), query(spark, folder, CONFIRMED)).drop("ordinal"))


# Digests of 64 letters against digests cut short by k: their ratio is 2(64 - k) / (128 - k), all other pairs stay far below.
DIGESTS = ("SELECT sha2(CAST(s_suppkey AS STRING), 256) AS name, substring(sha2(CAST(s_suppkey AS STRING), 256), 1, 64 - CAST(s_suppkey % 24 AS INT)) AS term, "
           "CAST(s_suppkey AS STRING) AS cmdb_id, s_suppkey AS ordinal FROM {supplier}")
_DIGESTS = ("(SELECT sha256(CAST(s_suppkey AS VARCHAR)) AS name, substring(sha256(CAST(s_suppkey AS VARCHAR)), 1, 64 - CAST(s_suppkey % 24 AS INT)) AS term, "
            "CAST(s_suppkey AS VARCHAR) AS cmdb_id, s_suppkey AS ordinal, 2 * (64 - s_suppkey % 24) / (128.0 - s_suppkey % 24)::DOUBLE AS score FROM supplier)")
_STRENGTH = "CASE WHEN score >= 0.95 THEN 'stark' ELSE 'schwach' END AS confidence"
register("fuzzy_digests", f"SELECT term, name, score, {_STRENGTH} FROM {_DIGESTS} WHERE score >= 0.85")(
    lambda spark, folder: matching.fuzzy_pairs(
        query(spark, folder, DIGESTS).select("term"), query(spark, folder, DIGESTS).select("name")).select("term", "name", "score", "confidence"))


@register("cascade_of_digests",
          f"SELECT 'doc ' || cmdb_id AS source_path, 'p' AS process, cmdb_id AS process_id, term AS application_name, ordinal AS position, "
          f"CASE WHEN score >= 0.85 THEN cmdb_id END AS cmdb_id, CASE WHEN score >= 0.85 THEN name END AS matched_name, {_STRENGTH}, "
          f"CASE WHEN score >= 0.85 THEN 'fuzzy' ELSE 'unmatched' END AS source, CASE WHEN score >= 0.85 THEN score ELSE 0 END AS score FROM {_DIGESTS}")
def cascade_of_digests(spark, folder):
    """The whole cascade at its default threshold, without decisions."""
    digests = query(spark, folder, DIGESTS)
    mentioned = digests.select(
        F.concat(F.lit("doc "), "cmdb_id").alias("source_path"), F.lit("p").alias("process"), F.col("cmdb_id").alias("process_id"),
        F.col("term").alias("application_name"), F.col("ordinal").alias("position"))
    return matching.match_terms(
        mentioned, digests.select("cmdb_id", "name", "ordinal"), model.empty(spark, model.CONFIRMED_SCHEMA),
        model.empty(spark, model.REJECTED_SCHEMA)).drop("ordinal")


# Names of three digests. By supplier: two of the three words (containment), a name cut short (ratio), a confirmed term, a rejected one.
_THREE = "concat(sha2(concat('a', s_suppkey), 256), ' ', sha2(concat('b', s_suppkey), 256), ' ', sha2(concat('c', s_suppkey), 256))"
_THREE_TERM = f"CASE s_suppkey % 4 WHEN 0 THEN substring({_THREE}, 1, 129) WHEN 1 THEN substring({_THREE}, 1, 194 - CAST(s_suppkey % 24 AS INT)) ELSE concat('term ', s_suppkey) END"
NAMED = (f"SELECT CAST(s_suppkey AS STRING) AS cmdb_id, {_THREE} AS name, {_THREE_TERM} AS term, concat('P', s_suppkey) AS process_id, concat('process ', s_suppkey) AS process, "
         "s_suppkey AS ordinal, s_suppkey % 4 AS kind, s_suppkey % 8 AS half FROM {supplier}")
_NAMED = plain(NAMED).replace("sha2(", "sha256(").replace(", 256)", ")").replace("AS STRING", "AS VARCHAR")


@register("decided_cascade", f"""
    WITH named AS ({_NAMED}), found AS (SELECT *, CASE WHEN kind = 0 THEN 0.9::DOUBLE WHEN kind = 1 AND half <> 5 THEN 2 * length(term) / (194.0 + length(term))::DOUBLE END AS score FROM named)
    SELECT 'doc ' || cmdb_id AS source_path, process, process_id, term AS application_name, ordinal AS position,
        CASE WHEN kind = 2 THEN 'X' || cmdb_id WHEN score IS NOT NULL THEN cmdb_id END AS cmdb_id, CASE WHEN kind = 2 THEN 'chosen' WHEN score IS NOT NULL THEN name END AS matched_name,
        CASE WHEN kind = 2 OR score >= 0.95 THEN 'stark' ELSE 'schwach' END AS confidence,
        CASE WHEN kind = 2 THEN 'knowledge_base_manual' WHEN kind = 3 THEN 'rejected' WHEN score IS NOT NULL THEN 'fuzzy' ELSE 'unmatched' END AS source,
        CASE WHEN kind = 2 THEN 1.0 ELSE coalesce(score, 0) END AS score FROM found""")
def decided_cascade(spark, folder):
    """Confirmed and rejected terms, a rejected pair, ratio and containment in one cascade at the default threshold."""
    named = query(spark, folder, NAMED)
    mentioned = named.select(
        F.concat(F.lit("doc "), "cmdb_id").alias("source_path"), "process", "process_id", F.col("term").alias("application_name"), F.col("ordinal").alias("position"))
    decision = ["process", "process_id", F.col("term").alias("anwendung_name")]
    confirmed = named.filter("kind = 2").select(*decision, F.concat(F.lit("X"), "cmdb_id").alias("cmdb_id"), F.lit("chosen").alias("resolved_to"), F.lit(model.SERVES_MANUAL).alias("quelle"))
    rejected = named.filter("kind = 3 OR half = 5").select(*decision, F.when(F.col("half") == 5, F.col("cmdb_id")).alias("cmdb_id"))
    return matching.match_terms(mentioned, named.select("cmdb_id", "name", "ordinal"), confirmed, rejected).drop("ordinal")


def words(spark, folder, name):
    """Distinct words of every text, the vocabulary that similarity is tried on."""
    return table(spark, folder, name).select(F.explode(F.split("text", r"[^\p{L}]+")).alias("word")).filter(
        "word != ''").distinct()


# The difflib ratio has no SQL counterpart; the tests compare the operator with brute force.
@register("fuzzy_terms")
def fuzzy_terms(spark, folder):
    """Words of all documents against the words of all benchmark texts."""
    return matching.fuzzy_pairs(
        words(spark, folder, "documents").withColumnRenamed("word", "term"),
        words(spark, folder, "benchmark").withColumnRenamed("word", "name")).select("term", "name", "score", "confidence")


@register("fuzzy_part_candidates")
def fuzzy_part_candidates(spark, folder):
    """Misspelled part names of every order line against the part list."""
    part = table(spark, folder, "part")
    # The file of the parts is small beside its rows; by its size alone all rows would be broadcast.
    mentions = table(spark, folder, "lineitem").join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").cast("string").alias("source_path"), "l_returnflag", F.col("p_partkey").cast("string").alias("process_id"),
        F.concat("p_name", F.lit("s "), "p_type").alias("application_name"), F.col("l_linenumber").alias("position")).withColumnRenamed(
        "l_returnflag", "process").distinct()
    master = part.groupBy(F.concat("p_name", F.lit(" "), "p_type").alias("name")).agg(F.min("p_partkey").alias("ordinal")).withColumn(
        "cmdb_id", F.col("ordinal").cast("string"))
    return matching.best_candidate(matching.fuzzy_candidates(mentions, master))


# Organization ----------------------------------------------------------------------------------------

ORG_ALIASES = (
    "SELECT DISTINCT lower(c_mktsegment) AS normalized_name, 'OrgUnit' AS target_label, concat('OrgUnit:', r_name) AS target_id, 'x' AS source_kind "
    "FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey UNION ALL "
    "SELECT lower(n_name), 'OrgUnit', concat('OrgUnit:', r_name), 'x' FROM {nation} JOIN {region} ON n_regionkey = r_regionkey")
_NAMES = ("SELECT c_custkey AS ref, n_name AS raw FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey UNION ALL "
          "SELECT c_custkey, concat(' ', lower(c_mktsegment)) FROM {customer} UNION ALL SELECT r_regionkey, lower(r_name) FROM {region} UNION ALL "
          "SELECT p_partkey, p_type FROM {part}")
_ALIAS_COUNT = (f"(SELECT normalized_name AS k, count(DISTINCT target_id) AS n, min(replace(target_id, 'OrgUnit:', '')) AS t FROM ({plain(ORG_ALIASES)}) GROUP BY 1)")


def org_graph(spark, folder):
    return graph(spark, folder).with_(alias_edges=query(spark, folder, ORG_ALIASES))


def _resolved(names_sql):
    return (f"SELECT z.*, CASE WHEN r.r_name IS NOT NULL OR al.n = 1 THEN 'unique' WHEN al.n > 1 THEN 'ambiguous' ELSE 'missing' END AS org_status, "
            f"CASE WHEN r.r_name IS NOT NULL THEN r.r_name WHEN al.n = 1 THEN al.t END AS org_name FROM ({names_sql}) z "
            f"LEFT JOIN region r ON lower(r.r_name) = lower(trim(z.raw)) LEFT JOIN {_ALIAS_COUNT} al ON al.k = lower(trim(z.raw))")


register("org_resolution", _resolved(plain(_NAMES)))(
    lambda spark, folder: org.resolve_org(query(spark, folder, _NAMES), "raw", org_graph(spark, folder)))
register("org_alias_targets",
         f"SELECT DISTINCT normalized_name, replace(target_id, 'OrgUnit:', '') AS target FROM ({plain(ORG_ALIASES)})")(
    lambda spark, folder: org.alias_targets(org_graph(spark, folder)))


def _org_mapping(spark, folder):
    rows = query(spark, folder, "SELECT CAST(c_custkey AS STRING) AS source_path, c_name AS process_name, '' AS process_id, "
                                "array(n_name, c_mktsegment, lower(n_name)) AS org_unit_candidates, n_name AS process_owner_candidate "
                                "FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")
    mapped = org.apply_org_mapping(rows, org_graph(spark, folder))
    return mapped.select("source_path", F.array_join("org_units", "|").alias("units"), "org_unit",
                         F.array_join("org_unit_candidates", "|").alias("open"), "process_owner_candidate")


register("org_mapping",
         "SELECT CAST(c_custkey AS VARCHAR) AS source_path, r_name AS units, r_name AS org_unit, c_mktsegment AS open, r_name AS process_owner_candidate "
         "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")(_org_mapping)

OWNED = ("SELECT CAST(c_custkey AS STRING) AS entity_id, c_name AS name, CASE WHEN c_acctbal > 5000 THEN n_name ELSE c_mktsegment END AS owner_name "
         "FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey")
register("owner_assignments",
         "SELECT CAST(c_custkey AS VARCHAR) AS entity_id, r_name AS org_unit_name FROM customer JOIN nation ON c_nationkey = n_nationkey "
         "JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 5000")(
    lambda spark, folder: org.owner_assignments(query(spark, folder, OWNED), org_graph(spark, folder)))
register("owner_candidates",
         "SELECT DISTINCT c_mktsegment AS candidate_name, 'cmdb_sync' AS source_path, '' AS process_name, '' AS role_name FROM customer WHERE c_acctbal <= 5000")(
    lambda spark, folder: org.owner_candidates(query(spark, folder, OWNED), org_graph(spark, folder)))
register("canonical_org_names",
         "SELECT c_custkey, lower(r_name) AS spelled, r_name AS canonical FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region "
         "ON n_regionkey = r_regionkey")(
    lambda spark, folder: org.canonical_org_names(query(
        spark, folder, "SELECT c_custkey, lower(r_name) AS spelled FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} "
                       "ON n_regionkey = r_regionkey"), "spelled", graph(spark, folder)))

_SEEN = ("SELECT DISTINCT concat(' ', text_source, ' ') AS candidate_name, CAST(doc_id AS STRING) AS source_path, lang AS process_name, '' AS role_name "
         "FROM (SELECT doc_id, lang, source AS text_source FROM {documents}) d")
register("org_candidates",
         "SELECT DISTINCT source AS normalized_name, source AS candidate_name, 'open' AS status, '' AS mapped_org_unit, DATE '2024-05-01' AS first_seen, "
         "DATE '2024-05-01' AS last_seen FROM documents")(
    lambda spark, folder: org.upsert_org_candidates(graph(spark, folder), query(spark, folder, _SEEN), "2024-05-01").candidates)
register("org_candidate_sources",
         "SELECT source AS normalized_name, 'path' AS kind, CAST(doc_id AS VARCHAR) AS value FROM documents UNION "
         "SELECT source, 'process', lang FROM documents")(
    lambda spark, folder: org.upsert_org_candidates(graph(spark, folder), query(spark, folder, _SEEN), "2024-05-01").candidate_sources)
register("decided_org_candidates",
         "SELECT DISTINCT source AS normalized_name, source AS candidate_name, CASE WHEN source IN (SELECT source FROM documents WHERE lang = 'de') "
         "THEN 'mapped' ELSE 'open' END AS status, CASE WHEN source IN (SELECT source FROM documents WHERE lang = 'de') THEN 'Unit' ELSE '' END "
         "AS mapped_org_unit, DATE '2024-05-01' AS first_seen, CASE WHEN source IN (SELECT source FROM documents WHERE lang = 'de') THEN DATE '2024-06-01' "
         "ELSE DATE '2024-05-01' END AS last_seen FROM documents")(
    lambda spark, folder: org.map_org_candidates(
        org.upsert_org_candidates(graph(spark, folder), query(spark, folder, _SEEN), "2024-05-01"),
        table(spark, folder, "documents").filter("lang = 'de'").select(F.upper("source").alias("candidate_name"), F.lit(" Unit ").alias("target")),
        "2024-06-01").candidates)

graph_query("process_owner_candidates",
            "SELECT process_id, name AS process_name, 'Some Unit' AS candidate_org_unit, node_id AS source_path FROM nodes p WHERE label = 'Process' "
            "AND NOT EXISTS (SELECT 1 FROM edges w WHERE w.rel_type = 'RESPONSIBLE_FOR' AND w.dst_id = p.node_id)")(
    lambda g: org.process_owner_candidates(g.label("Process").select(
        "process_id", F.col("name").alias("process_name"), F.col("node_id").alias("source_path"),
        F.lit(" Some Unit").alias("process_owner_candidate"), F.lit("").alias("process_owner_candidate_status")), g))

# Aliases ---------------------------------------------------------------------------------------------

_LOOKUP = ("SELECT t.term, 'Process' AS entity_type, p.name AS entity_name, p.process_id AS entity_id, a.name AS alias_name FROM "
           "(SELECT DISTINCT upper(p_name) AS term FROM part) t JOIN aliases a ON a.normalized_name = lower(t.term) "
           "JOIN alias_edges x ON x.normalized_name = a.normalized_name JOIN nodes p ON p.node_id = x.target_id")
register("alias_lookup", f"{graph_sql()} {_LOOKUP}")(
    lambda spark, folder: aliases.alias_lookup(graph(spark, folder), table(spark, folder, "part").select(F.upper("p_name").alias("term"))))
register("alias_hints", f"{graph_sql()} SELECT min(term) AS term, entity_type, entity_name FROM ({_LOOKUP}) GROUP BY 2, 3")(
    lambda spark, folder: aliases.alias_hints(graph(spark, folder), table(spark, folder, "part").select(F.upper("p_name").alias("term"))))
graph_query("ambiguous_aliases",
            "SELECT normalized_name, count(DISTINCT target_id) AS targets FROM alias_edges GROUP BY 1 HAVING count(DISTINCT target_id) > 1")(
    aliases.ambiguous_aliases)

# Relations and generated model ------------------------------------------------------------------------

RELATIONS = (
    "SELECT CAST(s_suppkey AS STRING) AS source_id, 'RUNS_ON' AS relation_type, CAST(s_nationkey + 10 AS STRING) AS target_id FROM {supplier} UNION ALL "
    "SELECT CAST(l_suppkey AS STRING), 'USES_INTERFACE', p_brand FROM {lineitem} JOIN {part} ON l_partkey = p_partkey")
register("resolved_relations",
         f"{graph_sql()} SELECT DISTINCT r.relation_type AS rel_type, s.node_id AS src_id, t.node_id AS dst_id FROM ({plain(RELATIONS)}) r "
         "JOIN nodes s ON s.id = r.source_id AND s.label = 'Application' JOIN nodes t ON t.id = r.target_id AND "
         "t.label = CASE r.relation_type WHEN 'RUNS_ON' THEN 'Server' ELSE 'Interface' END")(
    lambda spark, folder: upserts.resolve_relations(graph(spark, folder), query(spark, folder, RELATIONS)).select("rel_type", "src_id", "dst_id"))


def _model(spark, folder):
    part = table(spark, folder, "part")
    processes = part.select(
        F.col("p_partkey").cast("string").alias("process_id"), F.col("p_name").alias("process_name"), F.col("p_brand").alias("department"),
        F.col("p_type").alias("role"), F.lit("").alias("owner"), F.lit("").alias("documentation"),
        F.array("p_name", F.concat(F.lit("Supplier#"), "p_size")).alias("mentioned_applications"))
    entities = table(spark, folder, "supplier").select(
        F.col("s_suppkey").cast("string").alias("source_id"), F.concat(F.lit("supplier & "), "s_suppkey").alias("name"),
        F.lit("application").alias("entity_type"), F.lit("").alias("owner_name"), F.lit("").alias("server_type"))
    spellings = table(spark, folder, "supplier").select(
        F.concat(F.lit("Supplier#"), "s_suppkey").alias("alias"), F.concat(F.lit("SUPPLIER und "), "s_suppkey").alias("name"))
    capabilities = part.select(F.col("p_brand").alias("department"), F.col("p_type").alias("capability")).distinct()
    relations = spark.createDataFrame([], "source_id string, relation_type string, target_id string")
    return modelgen.build_model(processes, entities, relations, spellings, capabilities)


register("generated_elements",
         "SELECT DISTINCT type, name FROM (SELECT 'BusinessActor' AS type, p_brand AS name FROM part UNION ALL SELECT 'BusinessRole', p_type FROM part "
         "UNION ALL SELECT 'BusinessProcess', p_name FROM part UNION ALL SELECT 'Capability', p_type FROM part UNION ALL SELECT 'ApplicationComponent', p_name FROM part "
         "UNION ALL SELECT 'ApplicationComponent', concat('supplier & ', s_suppkey) FROM supplier UNION ALL SELECT 'ApplicationComponent', "
         "concat('Supplier#', p_size) FROM part WHERE p_size NOT IN (SELECT s_suppkey FROM supplier))")(
    lambda spark, folder: _model(spark, folder).elements.select("type", "name").distinct())
register("generated_relationships",
         "WITH e AS (SELECT DISTINCT concat('id-elem-', substring(sha1(concat('elem:actor:', p_brand)), 1, 16)) AS source, 'Assignment' AS type, "
         "concat('id-elem-', substring(sha1(concat('elem:process:', p_partkey)), 1, 16)) AS target FROM part UNION "
         "SELECT concat('id-elem-', substring(sha1(concat('elem:actor:', p_brand)), 1, 16)), 'Assignment', "
         "concat('id-elem-', substring(sha1(concat('elem:role:', p_type)), 1, 16)) FROM part UNION "
         "SELECT concat('id-elem-', substring(sha1(concat('elem:role:', p_type)), 1, 16)), 'Assignment', "
         "concat('id-elem-', substring(sha1(concat('elem:process:', p_partkey)), 1, 16)) FROM part UNION "
         "SELECT concat('id-elem-', substring(sha1(concat('elem:process:', a.p_partkey)), 1, 16)), 'Serving', "
         "concat('id-elem-', substring(sha1(concat('elem:capability:', b.p_type)), 1, 16)) FROM part a JOIN part b USING (p_brand) UNION "
         "SELECT concat('id-elem-', substring(sha1(concat('elem:synthetic-app:', p_name)), 1, 16)), 'Serving', "
         "concat('id-elem-', substring(sha1(concat('elem:process:', p_partkey)), 1, 16)) FROM part UNION "
         "SELECT concat('id-elem-', substring(sha1(concat(CASE WHEN s_suppkey IS NULL THEN 'elem:synthetic-app:Supplier#' ELSE 'elem:application:' END, p_size)), 1, 16)), "
         "'Serving', concat('id-elem-', substring(sha1(concat('elem:process:', p_partkey)), 1, 16)) FROM part LEFT JOIN supplier ON s_suppkey = p_size) "
         "SELECT concat('id-rel-', substring(sha1(concat('rel:', source, '|', type, '|', target)), 1, 16)) AS identifier, source, type, target FROM e")(
    lambda spark, folder: _model(spark, folder).relationships)
register("generated_assumptions",
         "SELECT DISTINCT concat('Application ''', m, ''' was modeled as a standalone ApplicationComponent because no CMDB entity matched it.') AS assumption "
         "FROM (SELECT p_name AS m FROM part UNION SELECT concat('Supplier#', p_size) FROM part WHERE p_size NOT IN (SELECT s_suppkey FROM supplier))")(
    lambda spark, folder: _model(spark, folder).assumptions)

# Traversal -------------------------------------------------------------------------------------------

graph_query("named_values",
            "SELECT DISTINCT v AS value FROM (SELECT unnest([trim(name), trim(label), process_id, cmdb_id]) AS v FROM nodes) WHERE v <> '' AND lower(v) NOT IN "
            "('application', 'process', 'interface', 'server', 'orgunit', 'role', 'capability', 'goal', 'dataobject', 'resource', 'infrastructure', 'risk')")(
    lambda g: traverse.named_values(g.nodes.select("name", "label", "process_id", "cmdb_id")).select("value"))
graph_query("seed_nodes",
            "SELECT min(node_id) AS node_id, min(label) AS label, name FROM nodes GROUP BY name HAVING count(*) = 1")(
    lambda g: traverse.resolve_seeds(g, g.nodes.select(F.col("name").alias("value"))))

_STEPS = (", s AS MATERIALIZED (SELECT src_id AS a, dst_id AS b FROM edges WHERE rel_type IN ('RUNS_ON', 'SUPPORTS') UNION SELECT dst_id, src_id FROM edges "
          "WHERE rel_type IN ('RUNS_ON', 'SUPPORTS')), d0 AS MATERIALIZED (SELECT node_id FROM nodes WHERE label = 'Server' AND name = 'NATION_15'), "
          "d1 AS MATERIALIZED (SELECT DISTINCT b AS node_id FROM s JOIN d0 ON a = node_id WHERE b NOT IN (SELECT node_id FROM d0)), "
          "d2 AS MATERIALIZED (SELECT DISTINCT b AS node_id FROM s JOIN d1 ON a = node_id WHERE b NOT IN (SELECT node_id FROM d0) AND b NOT IN (SELECT node_id FROM d1)), "
          "r AS MATERIALIZED (SELECT node_id, 0 AS depth FROM d0 UNION ALL SELECT node_id, 1 FROM d1 UNION ALL SELECT node_id, 2 FROM d2) ")


def _around(g):
    seeds = g.label("Server").filter("name = 'NATION_15'")
    return traverse.expand(g, seeds, ["RUNS_ON", "SUPPORTS"], max_hops=2, budget=None)


graph_query("expansion_nodes", _STEPS + "SELECT node_id, label, name, depth FROM r JOIN nodes USING (node_id)")(lambda g: _around(g).nodes)
graph_query("expansion_edges",
            _STEPS + "SELECT src_id, dst_id, rel_type FROM edges WHERE rel_type IN ('RUNS_ON', 'SUPPORTS') AND (src_id IN (SELECT node_id FROM r WHERE depth < 2) "
            "OR dst_id IN (SELECT node_id FROM r WHERE depth < 2)) UNION SELECT src_id, dst_id, rel_type FROM edges WHERE rel_type = 'MAY_SERVE' AND "
            "src_id IN (SELECT node_id FROM r) AND dst_id IN (SELECT node_id FROM r)")(lambda g: _around(g).edges)
graph_query("ring_sizes",
            _STEPS + "SELECT depth, count(*) AS ring_size, CAST(sum(count(*)) OVER (ORDER BY depth) AS BIGINT) AS reached FROM r GROUP BY depth")(
    lambda g: traverse.ring_sizes(_around(g).nodes))
graph_query("ring_budget",
            _STEPS + "SELECT node_id, depth FROM r WHERE (SELECT count(*) FROM r z WHERE z.depth <= r.depth) <= 30")(
    lambda g: traverse.ring_budget(_around(g))[0].nodes.select("node_id", "depth"))
graph_query("answer_subgraph",
            "SELECT src_id, dst_id, rel_type FROM edges WHERE src_label IN ('Application', 'Server') AND dst_label IN ('Application', 'Server')")(
    lambda g: traverse.answer_subgraph(g, g.nodes.filter("label in ('Application', 'Server')")).edges)
graph_query("weak_edges", "SELECT src_id, dst_id, rel_type FROM edges WHERE rel_type = 'MAY_SERVE'")(
    lambda g: traverse.weak_edges(g, g.nodes))
