"""Near duplicates by MinHash signatures in a multi-index Hamming join.

A document's set is its distinct ``WIDTH``-word shingles (words are what ASCII white space separates, A-Z lower-cased;
fewer words make one shingle). Its signature has ``SYMBOLS`` symbols of ``BITS`` bits, each taken from the least of one
hash function over the set; two sets of Jaccard similarity s differ in about (1 - s) of the symbols.

* Two sets of similarity 0.8 differ in more than ``FARTHEST`` of 80 symbols with a chance of 1.1e-7. The join finds all
  pairs within that distance, by pigeonhole: with ``CHUNKS`` chunks of four symbols, at most ``FARTHEST // 2`` chunks hold two
  or more errors, so in ``SURE`` chunks or more there is one at most. The errors a chunk is allowed are enumerated: each
  of its four symbols is left out in turn, and rows meet on the chunk and the other three symbols.
* Sets that meet are first compared with the head of their bucket, the one that has most company over all its chunks.
  Then only sets of different components meet, and of these only sets that can reach the similarity with shingles of
  another component. A bucket with more than ``CROWD`` of them is split by the rarest shingles of its sets, as many as two
  sets of the similarity must share one of: near copies that are all alike but not alike enough then hardly meet.
* Pairs within ``FARTHEST`` symbols are confirmed by counting common shingles of the full sets.

Signatures are made once per document, and met once per distinct set. Entries are a few numbers each; texts are read a
second time only for sets that meet another. A passage that a third of all documents share does not make all their pairs.

Defined cases: null texts and texts without words have the empty set and are linked with nothing; rows of one id are
decided as one row each and link what their texts link; a component of rows without ids has a null component id and
keeps none; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatemap.llm.common import cut_lineage, small_or_shuffled, stored
from estatemap.llm.components import components
from estatemap.llm.jaccard import shingles

WIDTH = 4
SYMBOLS, BITS = 80, 14
CHUNKS = SYMBOLS // 4
#: Symbols in which two signatures may differ.
FARTHEST = 36
#: Chunks of a pair within that distance that have one error or none.
SURE = CHUNKS - FARTHEST // 2
#: Sets in a bucket of several components up to which they are paired there.
CROWD = 16
_LANE = BITS + 1
_dealt = np.random.default_rng(11)
_FACTORS = _dealt.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _dealt.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Hashes that are mixed at once.
STEP = 1 << 11


def signature(found: np.ndarray) -> np.ndarray:
    """The chunks of a set's signature: four symbols in one number each, with a free bit above every symbol."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), STEP):
        mixed = found[start:start + STEP, None] * _FACTORS
        mixed += _SHIFTS
        np.minimum(least, mixed.min(axis=0), out=least)
    symbols = (((least ^ (least >> np.uint64(32))) * _MIX) >> np.uint64(64 - BITS)).reshape(CHUNKS, 4)
    return (symbols << (np.arange(4, dtype=np.uint64) * np.uint64(_LANE))).sum(axis=1, dtype=np.uint64).view(np.int64)


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 11) - (1 << 63)


def _marks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, chunks = [], [], []
            for text in batch.column(2):
                found = shingles(text.as_py(), width)
                nodes.append(_node(found) if len(found) else None)
                sizes.append(len(found))
                chunks.append(signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(chunks, pa.list_(pa.int64()))],
                names=["id", "hash", "node", "n", "chunks"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                found = shingles(text.as_py(), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_node(found)], pa.int64()), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], names=["node", "grams"])
    return run


def _left_out(chunk: Column, symbol: int) -> Column:
    return chunk.bitwiseAND(F.lit(((1 << 4 * _LANE) - 1) ^ (((1 << _LANE) - 1) << (symbol * _LANE))))


def _keys(chunks: range, chunk) -> Column:
    """One (slot, key) for every chunk and allowed error; ``chunk`` gives the column of a chunk's number."""
    return F.array(*[F.struct(F.lit(4 * at + symbol).cast("byte").alias("slot"), _left_out(chunk(at), symbol).alias("key"))
                     for at in chunks for symbol in range(4)])


def _apart(a: str, b: str) -> Column:
    """The number of symbols in which the signatures of rows ``a`` and ``b`` differ (columns c0, c1, ...)."""
    lanes = lambda value: F.lit(sum(value << (symbol * _LANE) for symbol in range(4)))
    parts = [F.bit_count((F.col(f"{a}.c{at}").bitwiseXOR(F.col(f"{b}.c{at}")) + lanes((1 << BITS) - 1)).bitwiseAND(lanes(1 << BITS)))
             for at in range(CHUNKS)]
    return sum(parts[1:], parts[0])


def _wide(signatures: DataFrame) -> DataFrame:
    return signatures.select("node", *[F.col("chunks")[at].alias(f"c{at}") for at in range(CHUNKS)])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``src, dst`` of the pairs with 100 * common shingles >= ``percent`` * all shingles of both.

    Few pairs go to the sets, so that only the sets they name are shuffled: once for each pair and once as the other end.
    """
    pairs = cut_lineage(pairs)
    named = lambda end: sets.select(F.col("node").alias(end), F.col("grams").alias(f"{end}_grams"))
    ours = named("src").join(small_or_shuffled(pairs), "src")
    theirs = named("dst").join(small_or_shuffled(pairs.select("dst").distinct()), "dst", "left_semi")
    common = F.size(F.array_intersect("src_grams", "dst_grams"))
    return (ours.join(theirs, "dst")
            .filter((100 + percent) * common >= percent * (F.size("src_grams") + F.size("dst_grams"))).select("src", "dst"))


def met_entries(signatures: DataFrame) -> DataFrame:
    """``slot, key, node, n``: the entries of every signature whose bucket has ``n`` > 1 signatures.

    The entries are shuffled once: the sizes are counted from the same columns, so that both sides read one exchange.
    """
    entries = signatures.select("node", F.explode(_keys(range(CHUNKS), lambda at: F.col("chunks")[at])).alias("entry")).select("entry.*", "node")
    entries = entries.repartition("slot", "key")
    sizes = entries.groupBy("slot", "key").agg(F.count("node").alias("n")).filter("n > 1")
    return entries.join(sizes, ["slot", "key"])


def head_pairs(met: DataFrame, signatures: DataFrame, farthest: int) -> DataFrame:
    """``src, dst``: every met signature with the heads of its buckets, where they are within ``farthest`` symbols."""
    company = met.groupBy("node").agg(F.sum("n").alias("company"))
    # The set with most company is near the middle of its group, so that buckets of a group mostly have the same head.
    heads = (met.join(company, "node").groupBy("slot", "key")
             .agg(F.max(F.struct("company", "node")).getField("node").alias("head")))
    pairs = met.join(heads, ["slot", "key"]).filter("node != head").select("node", "head").distinct()
    wide = _wide(signatures)
    a, b = wide.withColumnRenamed("node", "src").alias("a"), wide.withColumnRenamed("node", "dst").alias("b")
    return (pairs.join(a, F.col("node") == F.col("a.src")).join(b, F.col("head") == F.col("b.dst"))
            .filter(_apart("a", "b") <= farthest).select("src", "dst"))


def _across(rows: DataFrame, farthest: int, also: str = "true") -> DataFrame:
    """Pairs of different roots within ``farthest`` symbols that meet in a bucket of ``rows`` (``bucket, node, root, c0, ...``)."""
    a, b = rows.alias("a"), rows.alias("b")
    return (a.join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root"))
                   & F.expr(also) & (_apart("a", "b") <= farthest))
            .select(F.col("a.node").alias("src"), F.col("b.node").alias("dst")))


def _mixed(rooted: DataFrame, crowd: int) -> DataFrame:
    """The rows of ``rooted`` whose bucket holds several roots, with ``crowded``."""
    mixed = (rooted.groupBy("slot", "key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("n"))
             .filter("low != high").select("slot", "key", (F.col("n") > crowd).alias("crowded")))
    return cut_lineage(rooted.drop("crowded").join(mixed, ["slot", "key"]))


def crossing_grams(rooted: DataFrame, sets: DataFrame) -> DataFrame:
    """``node, root, n, gram, many, used``: the shingles of the nodes of ``rooted`` that another root has as well.

    ``n`` is the size of the set, ``many`` the number of sets with the shingle, ``used`` how many such shingles the node has.
    """
    own = sets.join(small_or_shuffled(cut_lineage(rooted.select("node", "root").distinct())), "node")
    # Shuffled once, as in met_entries; the size of the set is looked up at the end instead of travelling with every shingle.
    grams = own.select("node", "root", F.explode("grams").alias("gram")).repartition("gram")
    common = (grams.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("node").alias("many"))
              .filter("low != high").select("gram", "many"))
    sizes = cut_lineage(own.select("node", F.size("grams").cast("long").alias("n")))
    return (grams.join(common, "gram").withColumn("used", F.count(F.lit(1)).over(Window.partitionBy("node")))
            .join(small_or_shuffled(sizes), "node").select("node", "root", "n", "gram", "many", "used"))


def rare_rows(crossing: DataFrame, percent: int) -> DataFrame:
    """The rows of ``crossing`` that two sets of different roots with ``percent`` percent in common must share one of.

    Shingles are ordered by rarity, those of one root only before all others; such sets meet in the first ones of both.
    """
    order = Window.partitionBy("node").orderBy("many", "gram")
    place = F.col("n") - F.col("used") + F.row_number().over(order) - 1
    return crossing.withColumn("place", place).filter(F.expr(f"place <= n - ({percent} * n + 99) div 100")).select("gram", "node", "root", "n", "place")


def may_reach(percent: int) -> str:
    """Whether rows a and b of one shingle can be the first that a pair of the similarity has in common: by length, place and the smaller set."""
    early = lambda row: f"{row}.place <= {row}.n - (2 * {percent} * {row}.n + {99 + percent}) div {100 + percent}"
    return (f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n) AND {100 + percent} * least(a.n - a.place, b.n - b.place) >= {percent} * (a.n + b.n) "
            f"AND CASE WHEN a.n <= b.n THEN {early('a')} ELSE {early('b')} END")


def cross_pairs(met: DataFrame, signatures: DataFrame, roots: DataFrame, farthest: int, crowd: int, sets: DataFrame | None = None,
                percent: int = 80) -> DataFrame:
    """``src, dst``: the pairs within ``farthest`` symbols whose ends are in different components of ``roots``; those that ``sets`` rule out may be missing."""
    rooted = met.select("slot", "key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rows, wide = _mixed(rooted, crowd), _wide(signatures)
    direct = lambda rows: _across(rows.select(F.xxhash64("slot", "key").alias("bucket"), "node", "root").join(wide, "node"), farthest)
    if sets is None:
        return direct(rows).distinct()
    crossing = crossing_grams(rows, sets).filter(100 * F.col("used") >= percent * F.col("n"))
    rare = cut_lineage(rare_rows(crossing, percent))
    rows = _mixed(rows.join(cut_lineage(rare.select("node").distinct()), "node", "left_semi"), crowd)
    pairs, crowded = direct(rows.filter("not crowded")), cut_lineage(rows.filter("crowded").select("node").distinct())
    if not crowded.isEmpty():
        ends = cut_lineage(rare.join(crowded, "node", "left_semi"))
        several = ends.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("gram")
        met_there = ends.join(several, "gram").select(F.col("gram").alias("bucket"), "node", "root", "n", "place").join(wide, "node")
        pairs = pairs.unionByName(_across(met_there, farthest, may_reach(percent)))
    return pairs.distinct()


def links(signatures: DataFrame, sets_of, percent: int = 80, farthest: int = FARTHEST, crowd: int = CROWD) -> DataFrame:
    """``src, dst``: links that join all sets within ``farthest`` symbols that share ``percent`` of their shingles.

    ``signatures`` has ``node, chunks``, once per distinct set; ``sets_of`` gives ``node, grams`` of a table of nodes.
    """
    met = cut_lineage(met_entries(signatures))
    nodes = cut_lineage(met.select("node").distinct())
    sets = cut_lineage(sets_of(nodes))
    # Signatures that meet no other stay out of all further joins.
    close = cut_lineage(signatures.join(small_or_shuffled(nodes), "node", "left_semi"))
    first = cut_lineage(confirmed(head_pairs(met, close, farthest), sets, percent))
    return first.unionByName(confirmed(cross_pairs(met, close, components(first), farthest, crowd, sets, percent), sets, percent))


def near_classes(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, percent: int = 80,
                 farthest: int = FARTHEST, crowd: int = CROWD) -> DataFrame:
    """``id_column, n_shingles, component_id, kept`` of every row: the least id reachable over links of ``percent`` percent or more."""
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("hash"), F.col(text_column).alias("text"))
    marks = stored(texts.mapInArrow(_marks(width), f"id {dict(texts.dtypes)['id']}, hash long, node long, n long, chunks array<long>"))
    signatures = cut_lineage(marks.filter("n > 0").groupBy("node").agg(F.first("chunks").alias("chunks"), F.min("hash").alias("hash")))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = cut_lineage(signatures.join(small_or_shuffled(nodes), "node", "left_semi").select("hash"))
        found = texts.join(small_or_shuffled(wanted), "hash", "left_semi").select("text").mapInArrow(_sets(width), "node long, grams array<long>")
        return found.groupBy("node").agg(F.first("grams").alias("grams"))

    roots = components(links(signatures.select("node", "chunks"), sets_of, percent, farthest, crowd))
    rooted = marks.select("id", "n", "node").join(roots, "node", "left").select("id", "n", "node", F.coalesce("root", "node").alias("root"))
    filled = cut_lineage(rooted.filter("node IS NOT NULL"))
    # Only components of several rows have to be looked up; a single row is its own.
    least = cut_lineage(filled.groupBy("root").agg(F.min("id").alias("component_id"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows")
                        .withColumn("several", F.lit(True)))
    named = filled.join(small_or_shuffled(least), "root", "left")
    found = named.select("id", "n", F.when(F.col("several"), F.col("component_id")).otherwise(F.col("id")).alias("component_id")).unionByName(
        rooted.filter("node IS NULL").select("id", "n", F.col("id").alias("component_id")))
    return found.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id",
                        F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
