"""Near duplicates by Jaccard similarity of word shingles: all pairs from 0.8 on, by exact counts.

Shingles: words as in ``simhash``; the set of ``WIDTH`` neighbouring words, fewer words make one shingle. Texts with the
same set are one node. Two nodes are linked when common shingles are at least 4/5 of all shingles of both.

* Bands of minima of ``ROWS`` hashes only decide who takes part: a text that shares none of ``BANDS`` bands with any
  other goes no further. A pair at 0.8 stays unmet with a chance of (1 - 0.8^4)^32, below 5e-8.
* Those left are joined by prefix filter: shingles are ordered by their number of texts, rarest first, and a pair from
  0.8 on meets in the first fifth of both orders (a ninth for the smaller set). Length and position bounds discard pairs
  that cannot reach 0.8; the rest is counted shingle by shingle. This part loses no pair.
* Where many meet, each is first compared with the one that has most shingles in common use. Pairs of texts that are
  in one component by then decide nothing and are left out; all others are compared.

Null and empty texts have no shingles and are one node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatemap.llm.common import cut_lineage, small_or_shuffled
from estatemap.llm.components import components
from estatemap.llm.simhash import CHUNK, SEED, keep_first

WIDTH = 5
BANDS = 32
ROWS = 4
_dealt = np.random.default_rng(SEED)
_FACTORS = _dealt.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _dealt.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of the distinct shingles, ascending."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = {b" ".join(words)} if len(words) <= width else set(map(b" ".join, zip(*[words[start:] for start in range(width)])))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(part, SEED) for part in parts), np.uint64, len(parts)))


def bands(found: np.ndarray) -> np.ndarray:
    """A key for each band of minima; none without shingles."""
    if not len(found):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(found), CHUNK >> 5):
        hashed = found[start:start + (CHUNK >> 5), None] * _FACTORS + _SHIFTS
        hashed = (hashed ^ (hashed >> np.uint64(32))) * _MIX
        least = np.minimum(least, (hashed ^ (hashed >> np.uint64(29))).min(axis=0))
    keys = [xxhash.xxh64_intdigest(least[ROWS * band:ROWS * (band + 1)].tobytes(), band) for band in range(BANDS)]
    return np.array(keys, np.uint64).view(np.int64)


def _node(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED) - (1 << 63)


def _marks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (shingles(text.as_py(), width) for text in batch.column(2))
            nodes, keys = zip(*[(_node(found), bands(found)) for found in sets]) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                names=["id", "hash", "node", "bands"])
    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                found = shingles(text.as_py(), width)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_node(found)], pa.int64()), pa.array([found.view(np.int64)], pa.list_(pa.int64()))], names=["node", "grams"])
    return run


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``src, dst`` of the pairs whose common shingles are 4/5 of all or more."""
    named = lambda end: sets.select(F.col("node").alias(end), F.col("grams").alias(f"{end}_grams"))
    both = pairs.join(named("src"), "src").join(named("dst"), "dst")
    common = F.size(F.array_intersect("src_grams", "dst_grams"))
    return both.filter(9 * common >= 4 * (F.size("src_grams") + F.size("dst_grams"))).select("src", "dst")


def _may_reach(a: str, b: str):
    """Whether rows ``a`` and ``b`` of one shingle can be a pair from 0.8 on that meets here first."""
    n = lambda row: F.col(f"{row}.n")
    left = lambda row: n(row) - F.col(f"{row}.pos")
    early = lambda row: F.col(f"{row}.pos") <= F.expr(f"{row}.n - (8 * {row}.n + 8) div 9")
    return ((5 * n(a) >= 4 * n(b)) & (5 * n(b) >= 4 * n(a)) & (9 * F.least(left(a), left(b)) >= 4 * (n(a) + n(b)))
            & F.when(n(a) <= n(b), early(a)).otherwise(early(b)))


def prefixes(sets: DataFrame) -> DataFrame:
    """``gram, node, n, pos, used``: the shingles of each node's prefix that others have too; ``used``: how many of all are."""
    items = sets.select("node", F.size("grams").cast("long").alias("n"), F.explode("grams").alias("gram"))
    common = items.groupBy("gram").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1")
    own = Window.partitionBy("node")
    return (items.join(common, "gram").withColumn("used", F.count(F.lit(1)).over(own))
            .withColumn("pos", F.col("n") - F.col("used") + F.row_number().over(own.orderBy("texts", "gram")) - 1)
            .filter("pos <= n - (4 * n + 4) div 5").select("gram", "node", "n", "pos", "used"))


def links(sets: DataFrame) -> DataFrame:
    """``src, dst``: links that join all nodes of ``sets`` (``node, grams``) with a similarity of 0.8 or more."""
    rows = cut_lineage(prefixes(sets))
    most = F.max(F.struct((F.col("used") / F.col("n")).alias("share"), "node", "n", "pos")).alias("head")
    heads = rows.groupBy("gram").agg(most, F.count(F.lit(1)).alias("many")).filter("many > 1").select("gram", "head.node", "head.n", "head.pos")
    ends = [F.least("a.node", "b.node").alias("src"), F.greatest("a.node", "b.node").alias("dst")]
    starred = (rows.alias("a").join(heads.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.node") != F.col("b.node")) & _may_reach("a", "b"))
               .select(*ends).distinct())
    first = cut_lineage(_verified(starred, sets))
    roots = components(first)
    known = cut_lineage(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    crossed = (known.alias("a").join(known.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.node") < F.col("b.node"))
                                     & (F.col("a.root") != F.col("b.root")) & _may_reach("a", "b"))
               .select(*ends).distinct())
    return first.unionByName(_verified(crossed, sets))


def _joined_groups(known: DataFrame, also: DataFrame) -> DataFrame:
    """``known`` (``id, hash, root``) with the groups that ``also`` (same columns; equal hashes are one group) has in common joined into one."""
    other = F.xxhash64(F.lit("also"), "other")
    both = known.select("hash", "root").distinct().join(also.select("hash", F.col("root").alias("other")).distinct(), "hash")
    both = cut_lineage(both.select("root", "other").distinct())
    wide = both.groupBy("other").agg(F.count_distinct("root").alias("n")).filter("n > 1").select("other")
    # Groups named by ``also`` get numbers of their own, so that both kinds can be nodes of one graph.
    links = both.join(wide, "other", "left_semi").select(F.xxhash64(F.lit("own"), "root").alias("src"), other.alias("dst"))
    whole = components(cut_lineage(links.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()))
    mine = known.withColumn("node", F.xxhash64(F.lit("own"), "root"))
    return mine.join(whole.withColumnRenamed("root", "whole"), "node", "left").select("id", "hash", F.coalesce("whole", "node").alias("root"))


def drop_similar(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH, also: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each group of similar texts, that of the least id, all columns as they were; of fully equal rows one stays.

    ``also``: ``id, hash, root`` of every row by another method, whose groups are joined with these.
    """
    texts = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("hash"), F.col(text_column).alias("text"))
    marks = cut_lineage(texts.mapInArrow(_marks(width), f"id {dict(texts.dtypes)['id']}, hash long, node long, bands array<long>"))
    entries = marks.select("node", F.explode("bands").alias("key"))
    shared = cut_lineage(entries.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low != high").select("key"))
    met = cut_lineage(entries.join(small_or_shuffled(shared), "key", "left_semi").select("node").distinct())
    hashes = cut_lineage(marks.join(met, "node", "left_semi").groupBy("node").agg(F.min("hash").alias("hash")).select("hash"))
    sets = cut_lineage(texts.join(small_or_shuffled(hashes), "hash", "left_semi").select("text")
                       .mapInArrow(_sets(width), "node long, grams array<long>").groupBy("node").agg(F.first("grams").alias("grams")))
    roots = components(links(sets))
    known = cut_lineage(marks.select("id", "hash", "node").join(roots, "node", "left")
                        .select("id", "hash", F.coalesce("root", "node").alias("root")))
    if also is not None:
        known = cut_lineage(_joined_groups(known, also))
    return keep_first(docs, known, id_column, text_column)
