"""Resolution of application mentions against master data: decisions, rejections, fuzzy, open.

A mention is one row with process, process_id, application_name and position; master rows have
cmdb_id, name, optionally entity_type, and an ordinal that stands for their file order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatemap import model
from estatemap.functions import scoring, text
from estatemap.graph import Graph
from estatemap.operators.quality import decision_issues
from estatemap.operators.similar import containment_candidates, ratio_candidates
from estatemap.operators.tables import first_by, require
from estatemap.session import cut_lineage

#: Terms or names that may be broadcast, about 20 MB.
BROADCAST_NAMES = 50_000
MENTION = ["source_path", "process", "process_id", "application_name", "position"]


def decision_scope(process_id: Column, process: Column) -> Column:
    """Identity that a decision and a mention must share: the process id if any, else the name.

    One key for both cases keeps the comparison an equi-join.
    """
    ident = F.coalesce(process_id, F.lit(""))
    return F.when(ident != "", F.concat(F.lit("id:"), ident)).otherwise(
        F.concat(F.lit("name:"), F.coalesce(process, F.lit(""))))


def _scoped(df: DataFrame) -> DataFrame:
    return df.withColumn("scope", decision_scope(F.col("process_id"), F.col("process")))


def _result(df: DataFrame, keys: list[str], **columns: Column) -> DataFrame:
    return df.select(*keys, *[column.alias(name) for name, column in columns.items()])


def _nothing(source: str) -> dict[str, Column]:
    none = F.lit(None).cast("string")
    return {"cmdb_id": none, "matched_name": none, "confidence": F.lit(model.WEAK), "source": F.lit(source),
            "score": F.lit(0.0), "ordinal": F.lit(None).cast("long")}


def match_confirmed(mentions: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Every confirmed target of the mention's exact term in its process."""
    links = _scoped(confirmed).select(
        "scope", F.col("anwendung_name").alias("application_name"), "cmdb_id", "resolved_to", "quelle").distinct()
    hits = _scoped(mentions).join(links, ["scope", "application_name"])
    return _result(
        hits, MENTION, cmdb_id=F.col("cmdb_id"), matched_name=F.coalesce("resolved_to", "application_name"),
        confidence=F.lit(model.STRONG), source=scoring.confirmed_source(F.col("quelle")), score=F.lit(1.0),
        ordinal=F.lit(None).cast("long"))


def _term_rejections(rejected: DataFrame) -> DataFrame:
    whole = F.coalesce(F.col("cmdb_id"), F.lit("")) == ""
    return _scoped(rejected.filter(whole)).select("scope", F.col("anwendung_name").alias("application_name")).distinct()


def match_rejected(mentions: DataFrame, rejected: DataFrame) -> DataFrame:
    """Mentions whose term was rejected for their process."""
    hits = _scoped(mentions).join(_term_rejections(rejected), ["scope", "application_name"], "left_semi")
    return _result(hits, MENTION, **_nothing(model.REJECTED))


def without_rejected_pairs(matches: DataFrame, rejected: DataFrame) -> DataFrame:
    """Drop exactly the rejected (process, term, target) combinations."""
    pairs = _scoped(rejected.filter(F.coalesce(F.col("cmdb_id"), F.lit("")) != "")).select(
        "scope", F.col("anwendung_name").alias("application_name"), "cmdb_id")
    return _scoped(matches).join(pairs, ["scope", "application_name", "cmdb_id"], "left_anti").drop("scope").select(
        *matches.columns)


def fuzzy_pairs(terms: DataFrame, master: DataFrame, threshold: float = scoring.FUZZY_THRESHOLD) -> DataFrame:
    """Scored (term, name, entity_type) with score >= threshold, for distinct terms and names.

    Works on distinct texts only; how often a term or a name occurs does not matter here.
    """
    typed = "entity_type" in master.columns
    kind = F.lower(F.trim(F.coalesce(F.col("entity_type"), F.lit("")))) if typed else F.lit("")
    # Terms and names may come out of whole documents and are met many times below.
    terms = cut_lineage(terms.select("term").distinct().select(
        "term", F.lower("term").alias("raw_a"), text.match_key(F.col("term")).alias("key_a")))
    names = cut_lineage(
        master.filter(F.col("name").isNotNull()).select("name", kind.alias("entity_type")).distinct()
        .select("name", "entity_type", F.lower("name").alias("raw_b"), text.match_key(F.col("name")).alias("key_b"),
                (F.lit(threshold) - scoring.type_offset(F.col("entity_type"))).alias("need"))
    )
    lowest = threshold - (scoring.APPLICATION_BONUS if typed else 0.0)

    def texts(df: DataFrame, raw: str, key: str, *more: str) -> DataFrame:
        """Raw texts and keys, which are mostly the same, so that equal ones are compared once."""
        keys = df.filter(F.col(key) != "").select(F.lit("").alias("grp"), F.col(key).alias("text"), *more)
        return df.select(F.lit("").alias("grp"), F.col(raw).alias("text"), *more).unionByName(keys)

    needs = texts(names, "raw_b", "key_b", "need").groupBy("grp", "text").agg(F.min("need").alias("need"))
    alike = cut_lineage(ratio_candidates(texts(terms, "raw_a", "key_a").distinct(), needs, lowest).select("a", "b"))
    # An empty key is like none.
    keyed = alike.filter("a != '' AND b != ''")
    if scoring.CONTAINMENT_SCORE + (scoring.APPLICATION_BONUS if typed else 0.0) >= threshold:
        keyed = keyed.unionByName(containment_candidates(
            terms.select(F.col("key_a").alias("key")).distinct(), names.select(F.col("key_b").alias("key")).distinct()))
    # By estimate a long list of long names is small; a broadcast would bring it to the driver.
    ours, theirs = [side.hint("merge") if side.count() > BROADCAST_NAMES else side for side in (terms, names)]
    by_raw = alike.join(ours, alike["a"] == ours["raw_a"]).join(theirs, alike["b"] == theirs["raw_b"])
    keyed = keyed.distinct()
    by_key = keyed.join(ours, keyed["a"] == ours["key_a"]).join(theirs, keyed["b"] == theirs["key_b"])
    columns = ["term", "name", "entity_type", "raw_a", "raw_b", "key_a", "key_b"]
    pairs = by_raw.select(*columns).unionByName(by_key.select(*columns)).dropDuplicates(["term", "name", "entity_type"])
    scored = pairs.select(
        "term", "name", "entity_type",
        scoring.seq_ratio(F.col("raw_a"), F.col("raw_b")).alias("raw"),
        scoring.similarity(F.col("key_a"), F.col("key_b")).alias("normalized"),
        scoring.containment(F.col("key_a"), F.col("key_b")).alias("contained"),
    )
    return (
        scored.withColumn("score", scoring.match_score(
            F.col("raw"), F.col("normalized"), F.col("contained"), F.col("entity_type")))
        .filter(F.col("score") >= threshold)
        .withColumn("confidence", scoring.match_confidence(F.col("raw"), F.col("normalized")))
    )


def fuzzy_candidates(mentions: DataFrame, master: DataFrame, rejected: DataFrame | None = None,
                     threshold: float = scoring.FUZZY_THRESHOLD) -> DataFrame:
    """All master rows similar enough to the mention's term, rejected pairs excluded.

    The scored pairs of distinct texts are checkpointed: the cascade reads them for the matches and again
    for the mentions without one, and must not compare the texts twice.
    """
    pairs = cut_lineage(fuzzy_pairs(mentions.select(F.col("application_name").alias("term")), master, threshold))
    rows = master.select(
        "cmdb_id", "name", "ordinal",
        *([F.lower(F.trim(F.coalesce("entity_type", F.lit("")))).alias("entity_type")]
          if "entity_type" in master.columns else [F.lit("").alias("entity_type")]))
    # The master rows are larger than their estimate, too.
    targets = pairs.join(rows.hint("merge"), ["name", "entity_type"]).select(
        F.col("term").alias("application_name"), "cmdb_id", F.col("name").alias("matched_name"), "confidence", "score",
        "ordinal")
    hits = _result(
        mentions.join(targets, "application_name"), MENTION, cmdb_id=F.col("cmdb_id"),
        matched_name=F.col("matched_name"), confidence=F.col("confidence"), source=F.lit(model.FUZZY),
        score=F.col("score"), ordinal=F.col("ordinal"))
    return hits if rejected is None else without_rejected_pairs(hits, rejected)


def alias_matches(mentions: DataFrame, graph: Graph) -> DataFrame:
    """Applications that an alias of the term refers to (the documented optional step)."""
    applications = graph.label("Application").select(
        F.col("node_id").alias("target_id"), "cmdb_id", F.col("name").alias("matched_name"))
    targets = graph.alias_edges.filter(F.col("target_label") == "Application").join(applications, "target_id").select(
        F.col("normalized_name").alias("_key"), "cmdb_id", "matched_name").distinct()
    keyed = mentions.withColumn("_key", text.fold_key(F.col("application_name")))
    return _result(
        keyed.join(targets, "_key"), MENTION, cmdb_id=F.col("cmdb_id"), matched_name=F.col("matched_name"),
        confidence=F.lit(model.STRONG), source=F.lit(model.KNOWN), score=F.lit(1.0), ordinal=F.lit(None).cast("long"))


def match_terms(mentions: DataFrame, master: DataFrame, confirmed: DataFrame, rejected: DataFrame,
                threshold: float = scoring.FUZZY_THRESHOLD, aliases: Graph | None = None) -> DataFrame:
    """The cascade: the first level with a result decides, per mention."""
    mentions = mentions.select(*MENTION)
    decided = match_confirmed(mentions, confirmed)
    open_terms = _scoped(mentions).join(
        _scoped(confirmed).select("scope", F.col("anwendung_name").alias("application_name")),
        ["scope", "application_name"], "left_anti")
    refused = _result(
        open_terms.join(_term_rejections(rejected), ["scope", "application_name"], "left_semi"), MENTION,
        **_nothing(model.REJECTED))
    left = open_terms.join(_term_rejections(rejected), ["scope", "application_name"], "left_anti").select(*MENTION)
    levels = [decided, refused]
    keys = ["source_path", "process_id", "process", "application_name", "position"]
    if aliases is not None:
        named = alias_matches(left, aliases)
        levels.append(named)
        left = _anti(left, named, keys)
    similar = fuzzy_candidates(left, master, rejected, threshold)
    levels += [similar, _result(_anti(left, similar, keys), MENTION, **_nothing(model.UNMATCHED))]
    result = levels[0]
    for level in levels[1:]:
        result = result.unionByName(level)
    return result


def _anti(mentions: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """Mentions without a row in ``matched``; null key parts compare as equal."""
    hit = matched.select(*[F.col(key).alias(f"_{key}") for key in keys]).distinct()
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return mentions.join(hit, condition, "left_anti")


def manual_matches(mentions: DataFrame, confirmed: DataFrame) -> DataFrame:
    """Persistent links whose folded term still occurs in the document."""
    links = _scoped(confirmed.filter(F.col("quelle").isin(model.SERVES_MANUAL, model.SERVES_CONFIRMED))).select(
        "scope", text.fold_key(F.col("anwendung_name")).alias("_key"), F.col("anwendung_name"), "cmdb_id",
        "resolved_to", "quelle").distinct()
    present = first_by(
        _scoped(mentions).withColumn("_key", text.fold_key(F.col("application_name"))),
        ["source_path", "process", "process_id", "scope", "_key"], [F.col("position")])
    hits = present.join(links, ["scope", "_key"]).withColumn("application_name", F.col("anwendung_name"))
    return _result(
        hits, MENTION, cmdb_id=F.col("cmdb_id"), matched_name=F.coalesce("resolved_to", "anwendung_name"),
        confidence=F.lit(model.STRONG), source=scoring.confirmed_source(F.col("quelle")), score=F.lit(0.0),
        ordinal=F.lit(None).cast("long"))


def match_documents(mentions: DataFrame, master: DataFrame, confirmed: DataFrame, rejected: DataFrame,
                    threshold: float = scoring.FUZZY_THRESHOLD, aliases: Graph | None = None) -> DataFrame:
    """Cascade plus persistent links; one row per (document, process, term, target), best score kept."""
    both = match_terms(mentions, master, confirmed, rejected, threshold, aliases).unionByName(
        manual_matches(mentions, confirmed))
    return first_by(
        both, ["source_path", "process", "process_id", "application_name", "cmdb_id"],
        [-F.col("score"), F.col("position"), F.coalesce("ordinal", F.lit(-1))])


_PER_MENTION = ["source_path", "process", "process_id", "application_name", "position"]


def rank_candidates(matches: DataFrame) -> DataFrame:
    """Candidates of each mention numbered by score, ties in master order."""
    order = Window.partitionBy(*_PER_MENTION).orderBy(F.desc("score"), F.asc_nulls_first("ordinal"))
    return matches.withColumn("rank", F.row_number().over(order))


def best_candidate(matches: DataFrame) -> DataFrame:
    return first_by(matches, _PER_MENTION, [-F.col("score"), F.coalesce("ordinal", F.lit(-1))])


def mentions_of(documents: DataFrame) -> DataFrame:
    """One row per application of each extracted document."""
    return documents.select(
        "source_path", F.col("process_name").alias("process"), "process_id",
        F.posexplode("applications").alias("position", "application"),
    ).select("source_path", "process", "process_id", F.col("application.name").alias("application_name"), "position")


def review_items(matches: DataFrame) -> DataFrame:
    """Weak or target-less matches; terms with a strong match and rejected terms are settled."""
    strong = F.coalesce(
        (F.col("confidence") != model.WEAK) & (F.coalesce(F.col("cmdb_id"), F.lit("")) != "")
        & (F.col("source") != model.REJECTED), F.lit(False))
    keys = ["source_path", "process", "process_id", "application_name"]
    open_rows = matches.filter(
        (F.col("source") != model.REJECTED)
        & ((F.col("confidence") == model.WEAK) | (F.coalesce(F.col("cmdb_id"), F.lit("")) == "")))
    return _anti(open_rows, matches.filter(strong), keys)


def confirmed_links(graph: Graph) -> DataFrame:
    """Decisions on SERVES edges as match input."""
    edges = graph.relation("SERVES").filter(
        F.col("raw_name").isNotNull() & F.col("source").isin(model.SERVES_CONFIRMED, model.SERVES_MANUAL))
    applications = graph.label("Application").select(F.col("node_id").alias("src_id"), "cmdb_id",
                                                     F.col("name").alias("resolved_to"))
    processes = graph.label("Process").select(F.col("node_id").alias("dst_id"), F.col("name").alias("process"),
                                              "process_id")
    links = edges.join(applications, "src_id").join(processes, "dst_id").select(
        "process", "process_id", F.col("raw_name").alias("anwendung_name"), "cmdb_id", "resolved_to",
        F.col("source").alias("quelle"))
    require(decision_issues(links, confirmed=True), "a stored confirmed link misses required fields")
    return links


def bind_rejections(rejections: DataFrame, processes: DataFrame) -> DataFrame:
    """Rejections stored without a process id get the only process of that name, else ``candidates`` <> 1."""
    old = rejections.filter(F.coalesce(F.col("process_id"), F.lit("")) == "")
    owners = processes.filter(F.coalesce(F.col("process_id"), F.lit("")) != "").groupBy(
        F.col("name").alias("prozess_name")).agg(
        F.min("process_id").alias("only_id"), F.count_distinct("process_id").alias("candidates"))
    bound = old.drop("process_id").join(owners, "prozess_name", "left").select(
        F.when(F.col("candidates") == 1, F.col("only_id")).alias("process_id"), "prozess_name", "anwendung_name",
        F.coalesce("candidates", F.lit(0)).alias("candidates"))
    kept = rejections.filter(F.coalesce(F.col("process_id"), F.lit("")) != "").select(
        "process_id", "prozess_name", "anwendung_name", F.lit(1).cast("long").alias("candidates"))
    return kept.unionByName(bound)


def rejected_links(graph: Graph) -> DataFrame:
    """Rejections as match input; an old one whose process is not certain is an error."""
    bound = bind_rejections(graph.rejections, graph.label("Process"))
    require(bound.filter(F.col("process_id").isNull()), "an old rejection has no or no unique process")
    links = bound.select(
        F.col("prozess_name").alias("process"), "process_id", "anwendung_name",
        F.lit(None).cast("string").alias("cmdb_id"))
    require(decision_issues(links, confirmed=False), "a stored rejection misses required fields")
    return links
