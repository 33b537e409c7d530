"""Near duplicates by SimHash and pivot distance tables.

Fingerprint: words are what ASCII white space separates, A-Z lower-cased; each 3-word shingle, repeats included,
votes with the bits of its XXH64 (seed 42); a bit is set when over half the shingles set it.

Pivot table: the reference fingerprints are the 65 prefix masks (the lowest i bits set). Hamming distances of one
fingerprint to neighbouring masks differ by +1 or -1, and two fingerprints within ``bits`` bits have distances to
every pivot within ``bits`` of each other (triangle inequality). Cutting the table into ``bits + 2`` or more runs of
coordinates, at least two runs rise and fall alike in both fingerprints, which makes the table joinable: rows meet
on the runs they agree on, pairs with a larger coordinate difference are discarded, survivors are verified.

A bucket with more than ``CROWD`` fingerprints is not paired. For three bits, its fingerprints within one bit of a
common middle are linked to one of them, and so are those within two bits of a middle that has such ones. These are
all within three bits of it, and every pair within three bits has such a middle between its ends: no link is lost,
none is invented, and the work stays in proportion to the bucket.

Defined cases: null and empty texts have fingerprint 0 and are linked like any other; fewer than three words make one
shingle; rows with equal ids are decided as one row each; a component of rows without ids has a null component id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estatemap.llm.common import cut_lineage, without
from estatemap.llm.components import components

SEED = 42
BITS = 3
CROWD = 256
#: Shingles that are counted at once.
CHUNK = 1 << 15
#: Coordinates of the pivot table that travel with a row for discarding pairs.
CHECKED = (8, 16, 24, 32, 40, 48, 56, 64)


def fingerprint(text: str | None, width: int = 3, seed: int = SEED) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[start:] for start in range(width)])))
    hashed = np.fromiter((xxhash.xxh64_intdigest(shingle, seed) for shingle in shingles), np.uint64, len(shingles))
    votes = np.zeros(64, np.int64)
    for start in range(0, len(hashed), CHUNK):
        votes += np.unpackbits(hashed[start:start + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(hashed), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(text.as_py()) for text in batch.column(2)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["id", "hash", "fp"])


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, hash, fp`` of every row: the XXH64 of the text and, as a signed number, the 64 bits of its fingerprint."""
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(text_column).alias("hash"), F.col(text_column).alias("text"))
    return rows.mapInArrow(_fingerprints, f"id {dict(rows.dtypes)['id']}, hash long, fp long")


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to the 65 prefix masks."""
    masks = np.array([(1 << i) - 1 for i in range(65)], np.uint64)
    return np.bitwise_count(fps.view(np.uint64)[:, None] ^ masks[None, :]).astype(np.int16)


def _runs(runs: int) -> list[tuple[int, int]]:
    edges = [round(64 * i / runs) for i in range(runs + 1)]
    return list(zip(edges, edges[1:]))


def _entries(runs: int, bits: int):
    """Rows (runs that must agree, their rise and fall, fingerprint, checked distances) of each fingerprint."""
    parts = _runs(runs)
    kept = list(combinations(range(runs), runs - bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            table = pivot_table(fps)
            falls = (table[:, :-1] > table[:, 1:]).astype(np.uint8)  # the distance falls where the bit is set
            distances = [pa.array(table[:, at].astype(np.int8)) for at in CHECKED]
            for choice, members in enumerate(kept):
                bits_of = np.concatenate([falls[:, slice(*parts[member])] for member in members], axis=1)
                wide = np.zeros((len(fps), 64), np.uint8)
                wide[:, :bits_of.shape[1]] = bits_of
                key = np.packbits(wide, axis=1, bitorder="little").view(np.int64)[:, 0] if len(fps) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(fps), choice, np.int32)), pa.array(key), pa.array(fps), *distances],
                    names=["choice", "key", "fp", *[f"d{at}" for at in CHECKED]])
    return run, len(kept)


def _free_bits(runs: int, bits: int) -> list[list[int]]:
    parts = _runs(runs)
    return [[bit for run in range(runs) if run not in members for bit in range(*parts[run])]
            for members in combinations(range(runs), runs - bits)]


def _middles(runs: int, bits: int, flips: range):
    """Rows (choice, key, middle, fingerprint): every fingerprint with so many of the free bits flipped."""
    masks = [np.array([sum(1 << bit for bit in chosen) for n in flips for chosen in combinations(free, n)], np.uint64)
             for free in _free_bits(runs, bits)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for choice, key, fp in zip(*[column.to_pylist() for column in batch.columns]):
                flipped = (np.int64(fp).view(np.uint64) ^ masks[choice]).view(np.int64)
                n = len(flipped)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, choice, np.int32)), pa.array(np.full(n, key, np.int64)), pa.array(flipped),
                     pa.array(np.full(n, fp, np.int64))], names=["choice", "key", "middle", "fp"])
    return run


def _crowd_links(crowd: DataFrame, runs: int, bits: int) -> DataFrame:
    """Links of crowded buckets that join the same fingerprints as all their pairs within ``bits`` bits."""
    rows, where = crowd.select("choice", "key", "fp"), ["choice", "key", "middle"]
    shape = "choice int, key long, middle long, fp long"
    inner = bits // 2
    near = rows.mapInArrow(_middles(runs, bits, range(inner + 1)), shape)
    heads = near.groupBy(*where).agg(F.min("fp").alias("head"))
    wide = rows.mapInArrow(_middles(runs, bits, range(bits - inner + 1)), shape)
    return (wide.join(heads, where).filter("fp != head")
            .select(F.col("fp").alias("src"), F.col("head").alias("dst")).distinct())


def links(fps: DataFrame, bits: int = BITS, crowd: int = CROWD) -> DataFrame:
    """``src, dst``: links that join all distinct fingerprints of ``fps`` (column ``fp``) within ``bits`` bits."""
    many = fps.count()
    # Two agreeing runs of five tell about 2^25 buckets apart; more runs are taken before buckets fill up.
    runs = bits + (2 if many < 1 << 22 else 3 if many < 1 << 28 else 4 if many < 1 << 34 else 5)
    make, _ = _entries(runs, bits)
    shape = "choice int, key long, fp long, " + ", ".join(f"d{at} byte" for at in CHECKED)
    entries = fps.select("fp").mapInArrow(make, shape)
    sizes = entries.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sizes = cut_lineage(sizes.withColumn("crowded", F.col("n") > crowd).drop("n"))
    met = cut_lineage(entries.join(sizes, ["choice", "key"]))
    left, right = met.filter("not crowded").alias("a"), met.filter("not crowded").alias("b")
    apart = F.greatest(*[F.abs(F.col(f"a.d{at}") - F.col(f"b.d{at}")) for at in CHECKED])
    paired = (left.join(right, (F.col("a.choice") == F.col("b.choice")) & (F.col("a.key") == F.col("b.key"))
                        & (F.col("a.fp") < F.col("b.fp")) & (apart <= bits)
                        & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= bits))
              .select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst")))
    crowds = met.filter("crowded")
    if crowds.isEmpty():
        return paired
    return paired.unionByName(_crowd_links(crowds, runs, bits))


def _rooted(distinct: DataFrame, bits: int) -> DataFrame:
    """``fp, least_id, root`` of every distinct fingerprint."""
    roots = components(links(distinct, bits))
    return (distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
            .select("fp", "least_id", F.coalesce("root", "fp").alias("root")))


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS) -> DataFrame:
    """``id_column, fingerprint, component_id`` of every row: the least id reachable over links of ``bits`` bits or fewer."""
    rows = cut_lineage(fingerprints(docs, id_column, text_column))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    rooted = _rooted(distinct, bits)
    named = rooted.join(rooted.groupBy("root").agg(F.min("least_id").alias("component_id")), "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_column), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, known: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``docs`` with the row of the least id of each ``root`` of ``known`` (``id, hash, root``); of fully equal rows one stays."""
    known = cut_lineage(known.withColumn("turn", F.struct(F.col("id").isNull().alias("last"), "id", "hash")))
    groups = known.groupBy("root").agg(F.min("turn").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    losers = cut_lineage(known.join(groups, "root").filter("turn != first").select("id", "hash").distinct())
    kept = without(docs, losers, id_column, text_column)
    repeated = cut_lineage(known.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id", "hash"))
    if repeated.isEmpty():
        return kept
    columns = [F.col(f"row.`{name}`").alias(name) for name in docs.columns]
    marked = (kept.select(F.struct("*").alias("row"), F.col(id_column).alias("id"), F.xxhash64(text_column).alias("hash"))
              .withColumn("turn", F.row_number().over(Window.partitionBy("id", "hash").orderBy("hash"))))
    return marked.filter("turn = 1").select(*columns)


def rooted_rows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS) -> DataFrame:
    """``id, hash, root`` of every row; rows of one root are one group."""
    rows = cut_lineage(fingerprints(docs, id_column, text_column).select("id", "fp", "hash"))
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("least_id")))
    return rows.join(_rooted(distinct, bits).select("fp", "root"), "fp").select("id", "hash", "root")


def drop_near_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", bits: int = BITS) -> DataFrame:
    """``docs`` with one row of each group, that of the least id, all columns as they were; of fully equal rows one stays."""
    return keep_first(docs, rooted_rows(docs, id_column, text_column, bits), id_column, text_column)
