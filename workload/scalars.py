"""Scalar functions over every line of the documents and the names of the master tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from estatemap.functions import naming, scoring, text, typed
from workload.registry import register
from workload.star import table

LINES = ("SELECT doc_id, unnest(string_split(text, chr(10))) AS line, "
         "generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents")


def lines(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("pos"), "line")


def _on_lines(name, expression, sql):
    register(name, f"SELECT doc_id, pos, {sql} AS result FROM ({LINES})")(
        lambda spark, folder: lines(spark, folder).select("doc_id", "pos", expression(F.col("line")).alias("result")))


SPACE = r"[\s\x{00a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}\x{0085}\x0b]"


def sql_squeeze(x):
    return f"trim(regexp_replace({x}, '{SPACE}+', ' ', 'g'))"


def sql_strip(x):
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def sql_casefold(x):
    return f"lower(replace(replace({x}, 'ß', 'ss'), 'ẞ', 'ss'))"


def sql_camel(x):
    return f"regexp_replace({x}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')"


def sql_tokens(x, stop):
    listed = ", ".join(f"'{word}'" for word in stop)
    return f"array_to_string(list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: t NOT IN ({listed})), ' ')"


def sql_match_key(x):
    bare = f"regexp_replace({x}, '\\([^)]*\\)', ' ', 'g')"
    bare = f"regexp_replace({bare}, '\\b[a-z]+:[A-Za-z0-9_.]+\\b', ' ', 'g')"
    return sql_tokens(f"regexp_replace({sql_camel(bare)}, '[_./-]+', ' ', 'g')", text.MATCH_STOP_WORDS)


def sql_clean_app(x):
    return sql_squeeze(f"regexp_replace({sql_strip(x)}, '{SPACE}*\\([^)]*\\){SPACE}*$', '')")


def sql_model_name(x):
    return f"trim({sql_camel(f'''replace(trim(regexp_replace({sql_squeeze(x)}, '^[^:]*:', '')), '_', ' ')''')})"


def sql_slug(x):
    joined = f"regexp_replace({sql_strip(x)}, '{SPACE}+', '_', 'g')"
    joined = f"regexp_replace(regexp_replace({joined}, '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g')"
    return f"coalesce(nullif(regexp_replace({joined}, '^_+|_+$', '', 'g'), ''), 'process')"


def sql_entity_key(x):
    return f"trim(regexp_replace(replace({sql_casefold(sql_strip(x))}, '&', ' und '), '[^a-z0-9]+', ' ', 'g'))"


_KEYWORDS = ", ".join(f"'{word}'" for word in text.APP_KEYWORDS)

_on_lines("match_key", text.match_key, sql_match_key("line"))
_on_lines("fold_key", text.fold_key, sql_squeeze(sql_casefold("line")))
_on_lines("clean_app_name", text.clean_app_name, sql_clean_app("line"))
_on_lines("app_key", lambda c: text.app_key(text.clean_app_name(c)), sql_tokens(sql_camel(sql_clean_app("line")), text.APP_STOP_WORDS))
_on_lines("display_key", text.display_key, sql_match_key(
    "regexp_replace(line, '\\b(?:[a-z][A-Za-z0-9_]*\\.)+([A-Za-z][A-Za-z0-9_]*)\\b', '\\1', 'g')"))
_on_lines("model_name", text.model_name, sql_model_name("line"))
_on_lines("process_ref", text.process_ref, sql_strip(f"string_split({sql_strip('line')}, ':')[-1]"))
_on_lines("is_generic_participant", text.is_generic_participant, f"regexp_matches({sql_strip('line')}, '(?i)^participant( \\d+)?$')")
_on_lines("is_application_like", text.is_application_like,
          f"line <> '' AND {sql_casefold('line')} NOT IN ('process', 'lane', 'start event', 'end event') AND "
          f"NOT ends_with({sql_casefold('line')}, 'operation') AND NOT regexp_matches({sql_strip('line')}, '(?i)^participant( \\d+)?$') "
          f"AND list_has_any(regexp_extract_all({sql_casefold('line')}, '[a-z0-9]+'), [{_KEYWORDS}])")
_on_lines("is_modeled_app", text.is_modeled_app, "NOT ends_with(lower(line), 'operation')")
_on_lines("slug", text.slug, sql_slug("line"))
_on_lines("entity_key", text.entity_key, sql_entity_key("line"))
_on_lines("batch_key", text.batch_key, f"regexp_replace({sql_casefold('line')}, '{SPACE}+', '', 'g')")
_on_lines("stable_id", lambda c: naming.stable_id("elem", c), "concat('id-elem-', substring(sha1(concat('elem:', line)), 1, 16))")
_on_lines("optional_text", text.optional, f"nullif({sql_strip('line')}, '')")
_on_lines("manual_name_issue", text.manual_name_issue,
          f"CASE WHEN {sql_squeeze('line')} = '' THEN 'blank' WHEN length({sql_squeeze('line')}) > 120 THEN 'too_long' "
          f"WHEN NOT regexp_full_match({sql_squeeze('line')}, '[A-Za-z0-9 _./()&,+-]+') THEN 'bad_character' END")
_PARTS = (f"list_filter(list_transform(list_concat(regexp_split_to_array(line, '[;,]+'), regexp_split_to_array(upper(line), '[;,]+')), "
          f"lambda x: {sql_squeeze('x')}), lambda x: x <> '')")
_on_lines("split_multi", lambda c: F.array_join(text.split_multi(F.array(c, F.upper(c))), "|"),
          f"array_to_string(list_filter({_PARTS}, lambda p, i: list_position(list_transform({_PARTS}, lambda q: {sql_casefold('q')}), "
          f"{sql_casefold('p')}) = i), '|')")

register("row_id",
         "SELECT event_id, sha256(concat(event_type, '||', CAST(user_id AS VARCHAR), '||', coalesce(CASE WHEN value > 10 THEN props END, 'None'))) "
         "AS row_id FROM events")(
    lambda spark, folder: table(spark, folder, "events").select("event_id", naming.row_id(
        F.col("event_type"), F.col("user_id"), F.when(F.col("value") > 10, F.col("props"))).alias("row_id")))

register("paths",
         "SELECT page_id, string_split(url, '/')[-1] AS base_name, CASE WHEN starts_with(url, 'http:/') THEN substring(url, 7) "
         "ELSE string_split(url, '/')[-1] END AS display_path, regexp_replace(string_split(url, '/')[-1], '^(.+)\\.[^.]*$', '\\1') AS stem FROM pages")(
    lambda spark, folder: table(spark, folder, "pages").select(
        "page_id", naming.base_name(F.col("url")).alias("base_name"), naming.display_path(F.col("url"), "http:/").alias("display_path"),
        naming.file_stem(F.col("url")).alias("stem")))

register("display_name",
         "SELECT p_partkey, coalesce(nullif(CASE WHEN p_size > 10 THEN p_name ELSE '' END, ''), CAST(p_partkey AS VARCHAR)) AS shown FROM part")(
    lambda spark, folder: table(spark, folder, "part").select("p_partkey", naming.display_name(
        F.when(F.col("p_size") > 10, F.col("p_name")).otherwise(" "), F.concat(F.lit("Process:"), "p_partkey")).alias("shown")))

register("option_labels", "SELECT concat(s_name, ' [', s_suppkey, ']') AS label FROM supplier ORDER BY 1")(
    lambda spark, folder: table(spark, folder, "supplier").select(
        naming.option_label(F.col("s_name"), F.col("s_suppkey").cast("string")).alias("label")).orderBy("label"))

register("pick_name",
         "SELECT doc_id, trim(CASE WHEN lang = 'de' THEN text WHEN lang = 'en' THEN text ELSE source END) AS name FROM documents")(
    lambda spark, folder: table(spark, folder, "documents").select("doc_id", F.trim(naming.pick_name(F.array(
        F.struct(F.col("source").alias("text"), F.lit("xx").alias("lang")),
        F.struct(F.lit(" ").alias("text"), F.lit("german").alias("lang")),
        F.struct(F.col("text").alias("text"), F.col("lang").alias("lang"))))).alias("name")))

register("strip_prefixes", "SELECT s_suppkey, regexp_replace(concat('x:', s_name, 'Relationship'), '^.*:|Relationship$', '', 'g') AS bare FROM supplier")(
    lambda spark, folder: table(spark, folder, "supplier").select("s_suppkey", naming.strip_relationship_suffix(
        naming.strip_type_prefix(F.concat(F.lit("x:"), "s_name", F.lit("Relationship")))).alias("bare")))

register("entity_and_server_types",
         "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(nullif(lower(trim(t)), ''), 'application') AS entity_type, "
         "nullif(lower(trim(s)), '') AS server_type FROM (SELECT *, CASE l_returnflag WHEN 'A' THEN ' Server' WHEN 'R' THEN ' ' ELSE l_returnflag END AS t, "
         "CASE l_linestatus WHEN 'O' THEN 'Virtual ' ELSE '' END AS s FROM lineitem)")(
    lambda spark, folder: table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        text.entity_type(F.when(F.col("l_returnflag") == "A", " Server").when(F.col("l_returnflag") == "R", " ").otherwise(
            F.col("l_returnflag"))).alias("entity_type"),
        text.server_type(F.when(F.col("l_linestatus") == "O", "Virtual ").otherwise("")).alias("server_type")))

register("containment_score",
         "SELECT a.p_name AS left_name, b.p_brand AS brand, CASE WHEN b.p_brand = 'Brand#1' OR b.p_brand = 'Brand#2' THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS score "
         "FROM (SELECT DISTINCT p_name, p_brand FROM part) a JOIN (SELECT DISTINCT p_name, p_brand FROM part) b USING (p_name, p_brand)")(
    lambda spark, folder: table(spark, folder, "part").select("p_name", "p_brand").distinct().select(
        F.col("p_name").alias("left_name"), F.col("p_brand").alias("brand"),
        scoring.containment(F.col("p_name"), F.concat_ws(" ", "p_name", F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), "brand")
                            .otherwise(F.lit(None)), F.when(~F.col("p_brand").isin("Brand#1", "Brand#2"), "x"))).alias("contained"),
        F.when(F.col("p_brand").isin("Brand#1", "Brand#2"), scoring.containment(
            F.col("p_name"), F.concat_ws(" ", F.lit("extra"), "p_name"))).otherwise(
            scoring.containment(F.col("p_name"), F.element_at(F.split("p_name", " "), 1))).alias("score")).drop("contained"))

register("match_rules",
         "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(l_discount * 10, l_tax * 10, 0.3) + "
         "CASE l_returnflag WHEN 'A' THEN 0.05 WHEN 'R' THEN -0.05 ELSE 0.0 END AS score, "
         "CASE WHEN l_discount * 10 >= 0.95 OR (l_discount * 10 >= 0.85 AND l_tax * 10 >= 0.95) THEN 'stark' ELSE 'schwach' END AS confidence, "
         "CASE l_returnflag WHEN 'A' THEN 'manueller_link' WHEN 'R' THEN 'manuell_bestaetigt' ELSE 'strong' END AS serves_source, "
         "CASE l_linestatus WHEN 'O' THEN 'knowledge_base_manual' ELSE 'knowledge_base' END AS match_source FROM lineitem")(
    lambda spark, folder: table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        scoring.match_score(F.col("l_discount") * 10, F.col("l_tax") * 10, F.lit(0.3), F.when(
            F.col("l_returnflag") == "A", "Application ").when(F.col("l_returnflag") == "R", "interface")).alias("score"),
        scoring.match_confidence(F.col("l_discount") * 10, F.col("l_tax") * 10).alias("confidence"),
        scoring.serves_source(F.when(F.col("l_returnflag") == "A", "knowledge_base_manual").when(
            F.col("l_returnflag") == "R", "knowledge_base").otherwise("fuzzy")).alias("serves_source"),
        scoring.confirmed_source(F.when(F.col("l_linestatus") == "O", "manueller_link").otherwise("x")).alias("match_source")))

register("merged_properties",
         "SELECT o_orderkey, coalesce(CASE WHEN o_orderstatus = 'F' THEN 'x' END, o_orderpriority) AS note, "
         "CASE WHEN o_orderstatus = 'O' THEN 'manueller_link' ELSE 'strong' END AS source, CAST(o_custkey AS VARCHAR) AS process_id, "
         "CASE WHEN o_orderstatus = 'O' THEN 3 ELSE 1 END AS strength FROM orders")(
    lambda spark, folder: _merged_properties(table(spark, folder, "orders")))


def _merged_properties(orders):
    existing = F.map_filter(F.create_map(
        F.lit("source"), F.lit("strong"), F.lit("process_id"), F.col("o_custkey").cast("string"),
        F.lit("note"), F.when(F.col("o_orderstatus") == "F", "x")), lambda _, value: value.isNotNull())
    incoming = F.create_map(
        F.lit("source"), F.when(F.col("o_orderstatus") == "O", "manueller_link").otherwise("weak"),
        F.lit("process_id"), F.lit("other"), F.lit("note"), F.col("o_orderpriority"))
    merged = scoring.merge_props(existing, incoming)
    return orders.select(
        "o_orderkey", merged["note"].alias("note"), merged["source"].alias("source"), merged["process_id"].alias("process_id"),
        scoring.evidence_strength(merged).alias("strength"))


register("typed_values",
         "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_orderdate AS at, o_orderpriority AS raw, CAST(o_custkey AS BIGINT) AS seconds, "
         "o_totalprice AS x FROM orders")(
    lambda spark, folder: table(spark, folder, "orders").select(
        "o_orderkey", typed.decode_date(typed.encode_date(F.to_date("o_orderdate"))).alias("day"),
        F.to_timestamp_ntz(typed.decode_timestamp(typed.encode_timestamp(F.col("o_orderdate").cast("timestamp"))).cast("string")).alias("at"),
        typed.decode_bytes(typed.encode_bytes(F.encode("o_orderpriority", "utf-8"))).cast("string").alias("raw"),
        typed.decode_duration(typed.encode_duration(F.lit(1), F.lit(2), F.col("o_custkey"), F.lit(0)))["seconds"].alias("seconds"),
        typed.decode_point(typed.encode_point(F.lit(4326), F.array("o_totalprice", F.lit(1.0))))["coords"][0].alias("x")))

register("decision_context",
         "SELECT event_id, CASE event_type WHEN 'error' THEN concat('Prozess: ', user_id, ' | Eigentümer: -') "
         "WHEN 'view' THEN concat('Rolle: ', event_type, ' | Organisationseinheit: ', user_id) "
         "WHEN 'click' THEN concat('Prozess: ', user_id, ' | Begriff: ', event_type, ' | Ziel: -') ELSE '' END AS line FROM events")(
    lambda spark, folder: _decision_context(table(spark, folder, "events")))


def _decision_context(events):
    kind = F.col("event_type")
    payload = F.to_json(F.struct(
        F.col("user_id").cast("string").alias("process_id"), F.lit(" ").alias("process_name"), kind.alias("role_name"),
        F.when(kind == "view", F.col("user_id").cast("string")).alias("org_unit_name"), kind.alias("application_name")))
    decision = F.when(kind == "error", "manual_process_owner_assignment").when(kind == "view", "manual_role_assignment").when(
        kind == "click", "manual_link").otherwise("other")
    return events.select("event_id", naming.decision_context(decision, payload).alias("line"))


register("documentation_sections",
         # Each document is read as a process text whose first line opens the description and whose last closes it.
         "SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), ' ') AS section FROM documents")(
    lambda spark, folder: table(spark, folder, "documents").select("doc_id", text.documentation_section(F.concat(
        F.lit("Owner: nobody\nZiel:\n"), "text", F.lit("\nRolle: somebody\nlost"))).alias("section")))

register("labelled_values",
         "SELECT doc_id, source AS process_id, lang AS lanes FROM documents")(
    lambda spark, folder: table(spark, folder, "documents").select(
        "doc_id", text.process_id_of(F.concat(F.lit("BPMN Transform\nProcess id: "), "source", F.lit("\n"), "text"), F.lit("other"),
                                     F.lit("stem")).alias("process_id"),
        F.array_join(text.roles_of(F.concat(F.lit("BPMN Transform\nLane Labels: none, "), "lang", F.lit(", "), F.upper("lang"),
                                            F.lit("\n"), "text"), F.array(F.lit("unused"))), "|").alias("lanes")))
