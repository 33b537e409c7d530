"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from estatemap.llm import (audit, decontaminate, exact_dedup, htmltext, langid, minhash, packing, preferences, quality, sharding, simhash,
                           turntree, urlfilter)
from estatemap.llm.common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def quality_model(spark: SparkSession, docs: DataFrame, folder: str) -> quality.Model:
    """Learned from rows whose crc32(doc_id) mod 5 is not 0."""
    return quality.fit(docs, table(spark, folder, "labels"), lambda column: ~held_out(column, 5, 0))


@_register("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = quality.score_documents(docs, quality_model(spark, docs, folder))
    return scored.withColumn("held_out", held_out("doc_id", 5, 0))


@_register("op2_decontamination", r"""
    WITH cut AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS own FROM documents),
    item AS (SELECT DISTINCT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS own FROM benchmark),
    win AS (SELECT DISTINCT item_id, own[s:s + 9] AS win FROM item, unnest(range(1, greatest(len(own) - 9, 1) + 1)) AS r(s)
            WHERE len(own) > 0),
    sizes AS (SELECT DISTINCT len(win) AS size FROM win),
    spot AS (SELECT doc_id, p, size, own[p:p + size - 1] AS win FROM cut, unnest(range(1, len(own) + 1)) AS r(p), sizes
             WHERE p + size - 1 <= len(own)),
    found AS (SELECT doc_id, p, size, item_id FROM spot JOIN win USING (win)),
    hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM found, unnest(range(p, p + size)) AS r(w) GROUP BY 1),
    named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                     array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS names FROM found GROUP BY 1)
    SELECT doc_id, coalesce(len(own), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM cut LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)""")
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@_register("op3_simhash_dedup")
def op3_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents"))


@_register("op4_html_extraction")
def op4_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extract(table(spark, folder, "pages"))


@_register("op5_exact_dedup", """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, folder, "documents"))


#: Captures are dated by their id, and list entries by the ids of the pages of a host: the tables have no dates.
FETCHED = "date_add(DATE '2024-01-01', CAST(page_id * 37 % 365 AS INT))"


@_register("op6_url_filter", r"""
    WITH capture AS (SELECT page_id AS id, url, DATE '2024-01-01' + CAST(page_id * 37 % 365 AS INT) AS fetched,
                            lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host FROM pages),
    entry AS (SELECT DISTINCT CASE WHEN id % 3 = 0 THEN regexp_replace(host, '^[^.]*\.', '') ELSE host END AS domain,
                     ['ads', 'malware', 'trusted'][CAST(id % 7 % 3 AS INT) + 1] AS list, id % 2 = 0 AS is_on,
                     DATE '2024-01-01' + CAST(id * 53 % 365 AS INT) AS since FROM capture WHERE host != ''),
    state AS (SELECT domain, list, since, bool_or(is_on) AS is_on FROM entry WHERE domain != '' GROUP BY ALL),
    change AS (SELECT * FROM (SELECT *, coalesce(lag(is_on) OVER (PARTITION BY domain, list ORDER BY since), false) AS was FROM state)
               WHERE is_on != was),
    valid AS (SELECT * FROM (SELECT *, lead(since) OVER (PARTITION BY domain, list ORDER BY since) AS until FROM change) WHERE is_on),
    hit AS (SELECT c.id, domain, length(domain) AS size, list FROM capture c JOIN valid v
            ON (c.host = domain OR ends_with(c.host, '.' || domain)) AND fetched >= since AND (until IS NULL OR fetched < until)),
    decided AS (SELECT id, domain, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists, NOT bool_or(list = 'trusted') AS blocked
                FROM hit WHERE size = (SELECT max(size) FROM hit h WHERE h.id = hit.id) GROUP BY id, domain)
    SELECT c.*, domain, lists, coalesce(blocked, false) AS blocked FROM capture c LEFT JOIN decided USING (id)""")
def op6_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Entries come from the pages themselves: every third page lists its parent domain, the others their host."""
    pages = table(spark, folder, "pages")
    captures = pages.select(F.col("page_id").alias("id"), "url", F.expr(FETCHED).alias("fetched"))
    host = urlfilter.url_host(F.col("url"))
    entries = captures.select(
        F.when(F.col("id") % 3 == 0, F.regexp_replace(host, r"^[^.]*\.", "")).otherwise(host).alias("domain"),
        F.element_at(F.array(*map(F.lit, ("ads", "malware", "trusted"))), (F.col("id") % 7 % 3 + 1).cast("int")).alias("list"),
        F.when(F.col("id") % 2 == 0, "add").otherwise("remove").alias("action"),
        F.expr("date_add(DATE '2024-01-01', CAST(id * 53 % 365 AS INT))").alias("time"))
    lists = spark.createDataFrame([("ads", "block"), ("malware", "block"), ("trusted", "allow")], "list string, kind string")
    return urlfilter.evaluate(captures, entries, lists)


@_register("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.train(langid.training_rows(docs, ~held_out("doc_id", 4, 2)))
    return langid.identify(docs, model).withColumn("held_out", held_out("doc_id", 4, 2))


@_register("op8_best_fit_packing")
def op8_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(packing.tokenised_pieces(table(spark, folder, "documents"), tokenizer_path()))


@_register("op9_sharding")
def op9_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_rows(table(spark, folder, "documents"))


@_register("op10_preference_formatting", """
    WITH pair AS (SELECT conv_id AS pair_id, 'chosen' AS side, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT conv_id, 'rejected', turn, coalesce(role, ''),
            CASE WHEN role = 'assistant' AND turn >= 1 + 2 * (conv_id % 3) THEN coalesce(text, '')[1:length(text) // 2] ELSE coalesce(text, '') END
        FROM conversations),
    shown AS (SELECT *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered FROM pair),
    apart AS (SELECT pair_id, min(turn) FILTER (WHERE chosen IS DISTINCT FROM rejected) AS apart FROM
        (SELECT pair_id, turn, list_sort(list(rendered) FILTER (WHERE side = 'chosen')) AS chosen,
                list_sort(list(rendered) FILTER (WHERE side = 'rejected')) AS rejected FROM shown GROUP BY ALL) GROUP BY 1),
    parted AS (SELECT *, CASE WHEN apart IS NULL OR turn < apart THEN 'prompt' ELSE side END AS part FROM shown JOIN apart USING (pair_id)
        WHERE side = 'chosen' OR turn >= apart),
    placed AS (SELECT *, row_number() OVER (PARTITION BY pair_id, side, turn ORDER BY role, text) - 1 AS place,
        coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, text
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM parted)
    SELECT pair_id, part, turn, place, role, rendered, start,
        CASE WHEN part != 'prompt' AND role = 'assistant' THEN start + length(role) + 5 END AS train_from,
        CASE WHEN part != 'prompt' AND role = 'assistant' THEN start + length(rendered) - 1 END AS train_to FROM placed""")
def op10_preference_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """The rejected side has the assistant's answers cut in half from turn 1, 3 or 5 on, by the conversation's id."""
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("pair_id"), "turn", "role", "text")
    from_here = (F.col("role") == "assistant") & (F.col("turn") >= 1 + 2 * (F.col("pair_id") % 3))
    half = F.expr("left(text, length(text) div 2)")
    rejected = turns.withColumn("text", F.when(from_here, half).otherwise(F.col("text"))).withColumn("side", F.lit("rejected"))
    return preferences.preference_rows(turns.withColumn("side", F.lit("chosen")).unionByName(rejected))


@_register("op11_minhash_dedup")
def op11_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_classes(table(spark, folder, "documents"))


@_register("op12_filter_audit", r"""
    WITH doc AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
    split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM doc),
    failed AS (SELECT doc_id, part, CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
            || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
            || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END
            || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
            || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails FROM split),
    label AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
    counted AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
                FROM failed LEFT JOIN label USING (doc_id) GROUP BY ALL),
    letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    ordered AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letter a, letter b, letter c, letter d, letter e
                WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    placed AS (SELECT filter_order, step, filter_order[step] AS own, string_split(filter_order[1:step - 1], '') AS before
               FROM ordered, unnest(range(1, 6)) AS r(step)),
    met AS (SELECT part, filter_order, step, n, good, toxic, length(fails) AS many, contains(fails, own) AS hit, fails = own AS alone,
                   len(list_intersect(string_split(fails, ''), before)) > 0 AND step > 1 AS earlier FROM counted, placed)
    SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (WHERE NOT hit AND NOT earlier), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (WHERE hit AND NOT earlier), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (WHERE hit AND earlier), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (WHERE alone), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (WHERE hit AND NOT earlier), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE hit AND NOT earlier), 0)::BIGINT AS toxic_lost,
        coalesce(sum(n * 120 // greatest(many, 1)) FILTER (WHERE hit), 0)::BIGINT AS shapley FROM met GROUP BY ALL""")
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


@_register("op13_conversation_trie", r"""
    WITH RECURSIVE turn AS (SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
               coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    coded AS (SELECT conv, pos, dense_rank() OVER (ORDER BY role, text) AS id, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM turn),
    conv AS (SELECT conv, count(*) AS many, conv - conv % 20 AS base, xor(4294967295, list_reduce(
                 list_prepend(4294967295::BIGINT, list_transform(string_split(conv::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                 lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                     lambda r, i: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END)))) % 4 AS shared FROM turn GROUP BY conv),
    based AS (SELECT c.*, least(c.shared, coalesce(b.many, 0)) AS taken FROM conv c LEFT JOIN conv b ON c.base = b.conv),
    built AS (SELECT b.conv, t.pos, t.id, t.words FROM based b JOIN coded t ON t.conv = b.base AND t.pos <= b.taken
        UNION ALL SELECT b.conv, t.pos - shared + taken, t.id, t.words FROM based b JOIN coded t ON t.conv = b.conv AND t.pos > shared),
    sequence AS (SELECT conv, coalesce(list(id ORDER BY pos) FILTER (WHERE id IS NOT NULL), []) AS ids, coalesce(list(words ORDER BY pos) FILTER (WHERE id IS NOT NULL), []) AS words
        FROM conv LEFT JOIN built USING (conv) GROUP BY conv),
    member AS (SELECT conv, d, ids[1:d] AS node, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, len(ids) = d AS ends FROM sequence, unnest(range(0, len(ids) + 1)) AS r(d)),
    node AS (SELECT node, d, min(conv) AS conv, count(*) AS n, max(words) AS words, coalesce(list(conv ORDER BY conv) FILTER (WHERE ends), []) AS ends FROM member GROUP BY node, d),
    fan AS (SELECT node[1:d - 1] AS node, count(*) AS children FROM node WHERE d > 0 GROUP BY 1),
    full_node AS (SELECT n.*, coalesce(children, 0) AS children FROM node n LEFT JOIN fan USING (node)),
    below AS (SELECT node[1:u] AS node, sum(CASE WHEN children = 0 THEN 1 ELSE 0 END) AS leaves, sum((n - 1) * words) AS saved
              FROM full_node, unnest(range(0, d + 1)) AS r(u) GROUP BY 1)
    SELECT n.conv AS conv_id, n.d AS depth, p.conv AS parent_conv_id, n.n AS n_convs, n.children::BIGINT AS n_children, b.leaves::BIGINT AS n_leaves,
           b.saved::BIGINT AS saved_tokens, sha256(array_to_string(n.ends, ',')) AS ends_sha256
    FROM full_node n JOIN below b USING (node) LEFT JOIN full_node p ON n.d > 0 AND p.node = n.node[1:n.d - 1]""")
def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return turntree.prefix_trie(table(spark, folder, "conversations"))
