"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is ``WIDTH`` consecutive words of an item, or the whole item where it has fewer. A document contains a
window only if it contains every word of it, so the necessary prefix of a window in the order of rarity is its
rarest word (overlap 1.0, prefix length 1). The words of all documents are counted for the words that occur in
windows; each window is indexed by its rarest word and that word's offset; document words meet the index by
equality. A candidate must have room for the whole window before and after (length and position bounds) and is then
compared word by word with the document's words.

Only the index is broadcast, in blocks of ``BLOCK`` windows (and words) at most; a larger benchmark takes more
passes over the documents, not more memory.

Defined cases: null and empty texts have no words; an item without words has no window; an item without id counts
under the empty name; repeated items count once; rows equal in id and text get equal results, also with a null id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatemap.llm.common import cut_lineage, without

WIDTH = 10
BLOCK = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words once A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased; none for null."""
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), BETWEEN), "")


def item_windows(items: DataFrame, width: int, item_column: str, text_column: str) -> DataFrame:
    """``item, words``: the distinct windows of each item."""
    rows = items.select(F.coalesce(F.col(item_column).cast("string"), F.lit("")).alias("item"),
                        words_of(F.col(text_column)).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - F.lit(width - 1), F.lit(1)))
    return (rows.select("item", "all", F.explode(starts).alias("start"))
            .select("item", F.slice("all", F.col("start"), F.lit(width)).alias("words")).distinct())


def _blocks(rows: DataFrame, key: str, size: int) -> list[DataFrame]:
    """``rows`` in parts of about ``size`` rows, each fit for a broadcast."""
    blocks = -(-rows.count() // size)
    if blocks <= 1:
        return [rows]
    return [rows.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == block) for block in range(blocks)]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _rarest(words: DataFrame, windows: DataFrame, block: int) -> DataFrame:
    """``window, words, rare, at``: each window with its rarest word and where that first stands.

    ``words`` has one row for each word of the documents.
    """
    placed = windows.select("window", F.posexplode("words").alias("at", "word"))
    vocabulary = cut_lineage(placed.select("word").distinct())
    counts = _union([words.join(F.broadcast(part), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
                     for part in _blocks(vocabulary, "word", block)])
    known = placed.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = known.groupBy("window").agg(F.min(F.struct("n", "word", "at")).alias("rare"))
    # A word that no document has leaves nothing to find.
    return windows.join(rare.filter("rare.n > 0"), "window").select(
        "window", "words", F.col("rare.word").alias("rare"), F.col("rare.at").alias("at"))


def occurrences(docs: DataFrame, items: DataFrame, width: int = WIDTH, block: int = BLOCK, id_column: str = "doc_id",
                text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text"):
    """(found, items of windows): ``id, hash, window, start, length`` and ``window, item``.

    ``hash`` is the XXH64 of the text; with the id it names a document, or several equal ones.
    """
    owned = cut_lineage(item_windows(items, width, item_column, item_text_column))
    windows = cut_lineage(owned.select("words").distinct()).withColumn("window", F.monotonically_increasing_id())
    parsed = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("hash"),
                         words_of(F.col(text_column)).alias("own"))
    index = cut_lineage(_rarest(parsed.select(F.explode("own").alias("word")), windows, block))
    spread = parsed.select("id", "hash", "own", F.posexplode("own").alias("place", "word"))
    found = []
    for part in _blocks(index, "window", block):
        start, length = F.col("place") - F.col("at"), F.size("words")
        fits = (start >= 0) & (start + length <= F.size("own"))
        same = F.when(fits, F.slice("own", F.greatest(start, F.lit(0)) + 1, length) == F.col("words"))
        found.append(spread.join(F.broadcast(part), spread["word"] == part["rare"]).filter(same)
                     .select("id", "hash", "window", start.alias("start"), length.alias("length")))
    return _union(found), owned.join(windows, "words").select("window", "item")


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, block: int = BLOCK, id_column: str = "doc_id",
                  text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text") -> DataFrame:
    """``id, hash, n_hit, n_items, items`` of the documents with a window: words covered, item names sorted as strings."""
    found, owners = occurrences(docs, items, width, block, id_column, text_column, item_column, item_text_column)
    found = cut_lineage(found.distinct())
    key = ["id", "hash"]
    before = Window.partitionBy(*key).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    reached = F.coalesce(F.max(end).over(before), F.lit(0))
    hits = (found.select(*key, "start", "length").distinct().withColumn("reached", reached)
            .groupBy(*key).agg(F.sum(F.greatest(end - F.greatest("start", "reached"), F.lit(0))).cast("long").alias("n_hit")))
    named = (found.select(*key, "window").distinct().join(owners, "window")
             .groupBy(*key).agg(F.sort_array(F.collect_set("item")).alias("items")))
    both = hits.alias("h").join(named.alias("n"), F.col("h.id").eqNullSafe(F.col("n.id")) & (F.col("h.hash") == F.col("n.hash")))
    return both.select("h.id", "h.hash", "n_hit", F.size("items").cast("long").alias("n_items"), "items")


def contaminated_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_column: str = "doc_id",
                           text_column: str = "text") -> DataFrame:
    """``id_column, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``."""
    hits = contamination(docs, items, width, id_column=id_column, text_column=text_column).alias("h")
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("hash"),
                       F.size(words_of(F.col(text_column))).cast("long").alias("n_words")).alias("r")
    joined = rows.join(hits, F.col("r.id").eqNullSafe(F.col("h.id")) & (F.col("r.hash") == F.col("h.hash")), "left")
    names = F.array_join(F.coalesce("items", F.array().cast("array<string>")), ",")
    return joined.select(
        F.col("r.id").alias(id_column), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WIDTH, id_column: str = "doc_id",
                      text_column: str = "text") -> DataFrame:
    """``docs`` without the documents that contain a window, all columns as they were."""
    hits = contamination(docs, items, width, id_column=id_column, text_column=text_column).select("id", "hash")
    return without(docs, cut_lineage(hits), id_column, text_column)
