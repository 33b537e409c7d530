"""Prefix trie of conversations: which beginnings they share, and what rendering each once would save.

Turns are dictionary-encoded; a conversation is the array of its turn ids, and equal ones are one row with a count before
anything is dealt out. The sequences are range-partitioned, so that those with a common beginning are neighbours. Each
shard inserts its sequences, medians first, in a ternary search tree over turn ids; every node of it is a node of the
trie. A pass from the last created node to the first (children are created after their parents) accumulates members,
children, leaves and savings without recursion.

Only nodes on the path of a shard's first or last sequence can be in another shard as well. For these boundary nodes a
shard reports what hangs on them directly; they are merged by key, and their sums over subtrees are suffix sums along the
paths, each merged node being counted on one path. Conversations longer than ``LONGEST`` turns enter the trees with
their first ``LONGEST``; the nodes beyond are found by running checksums, a row per turn, so that no conversation has to
fit in a row, and their sums are added where they hang.

Defined cases: rows without a conversation id are left out; turns are ordered by turn (null first), then role and text;
null role and text are empty; a conversation whose base is absent starts with its own later turns, and may have none;
repeated rows are turns of their own; no conversations give no nodes; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from estatemap.llm.common import cut_lineage, small_or_shuffled

LONGEST = 2048
#: Turns numbered in one task: those of a conversation with the same turn number divided by this.
BUCKET = 1000
#: Turns of the sequences of one shard, about.
SHARD_TURNS = 100_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


class TurnTree:
    """A ternary search tree; nodes are numbered as they are created, a node's parent in the trie before it. Node 0 is the root."""

    def __init__(self):
        self.symbol, self.words, self.up, self.depth = [0], [0], [-1], [0]
        self.low, self.same, self.high = [0], [0], [0]
        self.count, self.least = [0], [None]

    def _created(self, symbol: int, words: int, up: int) -> int:
        for column, value in ((self.symbol, symbol), (self.words, words), (self.up, up), (self.depth, self.depth[up] + 1), (self.low, 0),
                              (self.same, 0), (self.high, 0), (self.count, 0), (self.least, None)):
            column.append(value)
        return len(self.symbol) - 1

    def _below(self, at: int, symbol: int, words: int) -> int:
        node = self.same[at]
        if not node:
            self.same[at] = self._created(symbol, words, at)
            return self.same[at]
        while symbol != self.symbol[node]:
            side = self.low if symbol < self.symbol[node] else self.high
            if not side[node]:
                side[node] = self._created(symbol, words, at)
            node = side[node]
        return node

    def insert(self, symbols: list[int], words: list[int], count: int, least: int) -> list[int]:
        """The nodes of a sequence that ``count`` conversations have, ``least`` the smallest of them."""
        path = [0]
        for symbol, n in zip(symbols, words):
            path.append(self._below(path[-1], symbol, n))
        for node in path:
            self.count[node] += count
            if self.least[node] is None or least < self.least[node]:
                self.least[node] = least
        return path


def medians_first(n: int) -> Iterator[int]:
    """0 to n - 1, the median of every open range first."""
    ranges = [(0, n)]
    while ranges:
        start, end = ranges.pop()
        if start < end:
            middle = (start + end) // 2
            yield middle
            ranges += [(middle + 1, end), (start, middle)]


NODES = ("path string, key binary, parent_key binary, depth long, conv long, parent_conv long, n long, children long, leaves long, saved long, "
         "words long, q1 long, q2 long, tail boolean")
_NODES = pa.schema([
    ("path", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("depth", pa.int64()), ("conv", pa.int64()), ("parent_conv", pa.int64()),
    ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("words", pa.int64()), ("q1", pa.int64()), ("q2", pa.int64()),
    ("tail", pa.bool_())])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie nodes of one shard; boundary nodes have a path and a key and count only what is not on a path."""
    rows = [row for batch in batches for row in batch.to_pylist()]
    if not rows:
        return
    rows.sort(key=lambda row: row["ids"])
    tree, ends, edges = TurnTree(), {}, {}
    for at in medians_first(len(rows)):
        row = rows[at]
        path = tree.insert(row["ids"], row["words"], row["n"], row["conv"])
        ends[path[-1]] = row
        if at in (0, len(rows) - 1):
            edges[at] = path
    on_path = {node for path in edges.values() for node in path}
    size = len(tree.symbol)
    children, leaves, saved = [0] * size, [0] * size, [0] * size
    for node in range(size - 1, -1, -1):
        tail = ends[node] if node in ends else None
        if tail is not None and tail["tail_children"]:
            children[node] += tail["tail_children"]
            leaves[node] += tail["tail_leaves"]
            saved[node] += tail["tail_saved"]
        if node not in on_path:
            leaves[node] += not children[node]
            saved[node] += (tree.count[node] - 1) * tree.words[node]
            up = tree.up[node]
            children[up] += 1
            leaves[up] += leaves[node]
            saved[up] += saved[node]
    keys = {0: b"root"}
    for node in sorted(on_path):
        if node:
            keys[node] = xxhash.xxh3_128_digest(keys[tree.up[node]] + tree.symbol[node].to_bytes(8, "little", signed=True))

    def record(node: int, path: str | None, whole: bool) -> tuple:
        up, row = tree.up[node], ends.get(node)
        ended = row is not None and whole and (row["q1"], row["q2"]) or (None, None)
        known = (tree.count[node], children[node], leaves[node], saved[node]) if whole else (0, 0, 0, 0)
        return (path, keys[node] if path else None, keys.get(up), tree.depth[node], tree.least[node], None if up in on_path or up < 0 else tree.least[up],
                *known, tree.words[node], *ended, row is not None and bool(row["tail_children"]))

    found = [record(node, None, True) for node in range(size) if node not in on_path]
    name, seen = xxhash.xxh3_128_hexdigest(repr(rows[0]["ids"]).encode()), set()
    for side, path in sorted(edges.items()):
        for node in path:
            found.append(record(node, f"{name}-{side}", node not in seen))
            seen.add(node)
    for start in range(0, len(found), 10_000):
        part = found[start:start + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*part), _NODES)], schema=_NODES)


def _hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per (q1, q2) over its ascending conversation ids; rows arrive sorted, so one is open at a time."""
    shape = pa.schema([("q1", pa.int64()), ("q2", pa.int64()), ("ends_sha256", pa.string())])
    of, state = None, None
    for batch in batches:
        done = []
        for q1, q2, conv in zip(*[column.to_pylist() for column in batch.columns]):
            if (q1, q2) != of:
                if of is not None:
                    done.append((*of, state.hexdigest()))
                of, state = (q1, q2), hashlib.sha256(str(conv).encode())
            else:
                state.update(f",{conv}".encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*done), shape)], schema=shape)
    if of is not None:
        yield pa.RecordBatch.from_arrays([pa.array([value], field.type) for value, field in zip((*of, state.hexdigest()), shape)], schema=shape)


def hashed_ends(ends: DataFrame) -> DataFrame:
    """``q1, q2, ends_sha256`` of ``ends`` (``q1, q2, conv``, one row per conversation)."""
    rows = ends.select("q1", "q2", "conv").repartition("q1", "q2").sortWithinPartitions("q1", "q2", "conv")
    return rows.mapInArrow(_hashed_ends, "q1 long, q2 long, ends_sha256 string")


def numbered_turns(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``conv, pos, d1, d2, words`` of ``rows`` (``conv, turn, role, text``): positions from 1, two digests of role and text."""
    rows = rows.withColumn("bucket", F.coalesce(F.floor(F.col("turn") / bucket), F.lit(-(1 << 62))))
    inside = Window.partitionBy("conv", "bucket").orderBy(F.asc_nulls_first("turn"), "role", "text")
    earlier = Window.partitionBy("conv").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy("conv", "bucket").agg(F.count(F.lit(1)).alias("many"))
              .select("conv", "bucket", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("before")))
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != ""))
    light = rows.select("conv", "bucket", F.row_number().over(inside).alias("place"), F.xxhash64("role", "text").alias("d1"),
                        F.xxhash64(F.lit(13), "text", "role").alias("d2"), words.cast("long").alias("words"))
    return light.join(before, ["conv", "bucket"]).select("conv", (F.col("place") + F.col("before")).alias("pos"), "d1", "d2", "words")


def rebuilt(conversations: DataFrame, group: int = 20, heads: int = 4) -> tuple[DataFrame, DataFrame]:
    """(``conv, pos, id, words``; ``conv, length``) of the rebuilt conversations: the first crc32(conv) % ``heads`` turns are those of conv - conv % ``group``."""
    empty = lambda name: F.coalesce(F.col(name), F.lit("")).alias(name)
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", empty("role"), empty("text"))
    turns = cut_lineage(numbered_turns(rows))
    dictionary = cut_lineage(turns.groupBy("d1", "d2").agg(F.max("words").alias("words")).withColumn("id", F.monotonically_increasing_id()))
    coded = cut_lineage(turns.select("conv", "pos", "d1", "d2").join(dictionary, ["d1", "d2"]).select("conv", "pos", "id", "words"))
    own = coded.groupBy("conv").agg(F.count(F.lit(1)).alias("many"))
    shared = F.crc32(F.col("conv").cast("string").cast("binary")) % heads
    bases = own.select(F.col("conv").alias("base"), F.col("many").alias("there"))
    convs = cut_lineage(own.select("conv", "many", shared.alias("shared"), (F.col("conv") - F.col("conv") % group).alias("base"))
                        .join(bases, "base", "left").withColumn("taken", F.least("shared", F.coalesce("there", F.lit(0)))))
    first = (coded.filter(F.col("pos") < heads).withColumnRenamed("conv", "base").join(convs.filter("taken > 0").select("base", "conv", "taken"), "base")
             .filter("pos <= taken").select("conv", "pos", "id", "words"))
    later = (coded.join(convs.select("conv", "shared", "taken"), "conv").filter("pos > shared")
             .select("conv", (F.col("pos") - F.col("shared") + F.col("taken")).alias("pos"), "id", "words"))
    lengths = convs.select("conv", (F.greatest(F.col("many") - F.col("shared"), F.lit(0)) + F.col("taken")).alias("length"))
    return first.unionByName(later), lengths


def _summed(rows: DataFrame, key: str, at: str, values: dict[str, str], bucket: int, after: bool = False) -> DataFrame:
    """``rows`` with running results over each ``key`` in the order of ``at`` (from the end if ``after``), over buckets and inside of them."""
    from_here = (F.desc if after else F.asc)
    rows = rows.withColumn("_bucket", F.floor(F.col(at) / bucket))
    function = lambda kind: {"xor": F.bit_xor, "sum": F.sum}[kind]
    over = Window.partitionBy(key).orderBy(from_here("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy(key, "_bucket").orderBy(from_here(at)).rowsBetween(Window.unboundedPreceding, 0)
    whole = rows.groupBy(key, "_bucket").agg(*[function(kind)(name).alias(name) for name, kind in values.items()])
    whole = whole.select(key, "_bucket", *[F.coalesce(function(kind)(name).over(over), F.lit(0)).alias(f"_before_{name}") for name, kind in values.items()])
    found = rows.select("*", *[function(kind)(name).over(inside).alias(f"_inside_{name}") for name, kind in values.items()]).join(whole, [key, "_bucket"])
    for name, kind in values.items():
        inner, outer = F.col(f"_inside_{name}"), F.col(f"_before_{name}")
        found = found.withColumn(f"run_{name}", inner.bitwiseXOR(outer) if kind == "xor" else inner + outer)
    return found.drop("_bucket", *[f"_{side}_{name}" for name in values for side in ("inside", "before")])


def tails(turns: DataFrame, longest: int, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes beyond ``longest`` turns, what they add to (``conv, tail_children, tail_leaves, tail_saved``), and who ends where.

    ``turns`` has all turns of the conversations longer than that. A node's key is a pair of checksums over its turns.
    """
    marked = turns.select("conv", "pos", "words", F.xxhash64("id", "pos").alias("f1"), F.xxhash64("pos", "id", F.lit(7)).alias("f2"))
    run = _summed(marked, "conv", "pos", {"f1": "xor", "f2": "xor"}, bucket)
    rows = cut_lineage(run.filter(F.col("pos") > longest).select(
        "conv", "pos", "words", F.col("run_f1").alias("k1"), F.col("run_f2").alias("k2"), F.col("run_f1").bitwiseXOR(F.col("f1")).alias("p1"),
        F.col("run_f2").bitwiseXOR(F.col("f2")).alias("p2")))
    nodes = rows.groupBy("pos", "k1", "k2").agg(F.min("conv").alias("least"), F.count(F.lit(1)).alias("n"), F.max("words").alias("words"),
                                                F.first("p1").alias("p1"), F.first("p2").alias("p2"))
    nodes = cut_lineage(nodes)
    fans = nodes.groupBy((F.col("pos") - 1).alias("pos"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("children"))
    known = cut_lineage(nodes.join(fans, ["pos", "k1", "k2"], "left").withColumn("children", F.coalesce("children", F.lit(0))))
    # A node's own leaf and saving are counted on its smallest member; what is below a node is what its members count from there on.
    own = rows.join(known.select("pos", "k1", "k2", "least", "n", "children"), ["pos", "k1", "k2"])
    mine = F.col("conv") == F.col("least")
    counted = (own.withColumn("leaf", F.when(mine & (F.col("children") == 0), 1).otherwise(0).cast("long"))
               .withColumn("gain", F.when(mine, (F.col("n") - 1) * F.col("words")).otherwise(0).cast("long")))
    summed = cut_lineage(_summed(counted.select("conv", "pos", "k1", "k2", "p1", "p2", "leaf", "gain"), "conv", "pos", {"leaf": "sum", "gain": "sum"}, bucket, after=True))
    below = summed.groupBy("pos", "k1", "k2").agg(F.sum("run_leaf").alias("leaves"), F.sum("run_gain").alias("saved"))
    parents = known.select((F.col("pos") + 1).alias("pos"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("least").alias("parent_conv"))
    found = (known.join(below, ["pos", "k1", "k2"]).join(parents, ["pos", "p1", "p2"], "left")
             .select(F.col("pos").alias("depth"), F.col("least").alias("conv"), "parent_conv", "n", "children", "leaves", "saved", F.col("k1").alias("q1"),
                     F.col("k2").alias("q2"), F.col("p1").alias("head1"), F.col("p2").alias("head2")))
    starts = summed.filter(F.col("pos") == longest + 1)
    fan = starts.groupBy("p1", "p2").agg(F.countDistinct("k1", "k2").alias("tail_children"))
    hung = starts.join(fan, ["p1", "p2"]).select("conv", "p1", "p2", "tail_children", F.col("run_leaf").alias("tail_leaves"), F.col("run_gain").alias("tail_saved"))
    last = rows.groupBy("conv").agg(F.max_by(F.struct("k1", "k2"), "pos").alias("last")).select(F.col("last.k1").alias("q1"), F.col("last.k2").alias("q2"), "conv")
    return found, hung, last


def merged_boundary(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """The boundary nodes of all shards as nodes of the whole trie, with their ``key``."""
    merged = cut_lineage(rows.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"),
        F.sum("children").alias("inner"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("words").alias("words"),
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("tail").alias("tail"), F.min("path").alias("counted_on")))
    fans = merged.groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("fan")).filter("key IS NOT NULL")
    full = cut_lineage(merged.join(fans, "key", "left").withColumn("children", F.col("inner") + F.coalesce("fan", F.lit(0))))
    own_leaf = F.col("leaves") + F.when(F.col("children") == 0, 1).otherwise(0)
    own_saved = F.col("saved") + (F.col("n") - 1) * F.col("words")
    along = (rows.select("path", "depth", "key").join(full.select("key", own_leaf.alias("leaf"), own_saved.alias("gain"), "counted_on"), "key")
             .withColumn("leaf", F.when(F.col("path") == F.col("counted_on"), F.col("leaf")).otherwise(0))
             .withColumn("gain", F.when(F.col("path") == F.col("counted_on"), F.col("gain")).otherwise(0)))
    below = (_summed(along, "path", "depth", {"leaf": "sum", "gain": "sum"}, bucket, after=True)
             .groupBy("key").agg(F.sum("run_leaf").alias("leaves"), F.sum("run_gain").alias("saved")))
    parents = full.select(F.col("key").alias("parent_key"), F.col("conv").alias("parent_conv"))
    return full.drop("leaves", "saved").join(below, "key").join(parents, "parent_key", "left").select(
        "key", "depth", "conv", "parent_conv", "n", "children", "leaves", "saved", "q1", "q2", "tail")


def prefix_trie(conversations: DataFrame, group: int = 20, heads: int = 4, longest: int = LONGEST, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of every distinct beginning."""
    turns, lengths = rebuilt(conversations, group, heads)
    turns, lengths = cut_lineage(turns), cut_lineage(lengths)
    arrays = turns.filter(F.col("pos") <= longest).groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("pos", "id", "words"))).alias("turns"))
    part = lambda name: F.coalesce(F.transform("turns", lambda turn: turn[name]), F.array().cast("array<long>")).alias(name if name == "words" else "ids")
    sequences = lengths.join(arrays, "conv", "left").select("conv", "length", part("id"), part("words"))
    sequences = sequences.select("*", F.xxhash64("ids").alias("q1"), F.xxhash64(F.lit(5), "ids").alias("q2"))
    long = lengths.filter(F.col("length") > longest).select("conv")
    none = F.lit(0).cast("long")
    beyond = None
    if long.isEmpty():
        sequences = cut_lineage(sequences.select("*", none.alias("tail_children"), none.alias("tail_leaves"), none.alias("tail_saved")))
        ends = sequences.select("q1", "q2", "conv")
    else:
        beyond, hung, last = tails(turns.join(long, "conv", "left_semi"), longest)
        sequences = cut_lineage(sequences.join(hung.drop("p1", "p2"), "conv", "left")
                                .select("conv", "length", "ids", "words", "q1", "q2", *[F.coalesce(name, none).alias(name) for name in ("tail_children", "tail_leaves", "tail_saved")]))
        ends = sequences.filter(F.col("length") <= longest).select("q1", "q2", "conv").unionByName(last)
    distinct = cut_lineage(sequences.groupBy("ids", "words", "q1", "q2").agg(
        F.count(F.lit(1)).alias("n"), F.min("conv").alias("conv"), F.max("tail_children").alias("tail_children"),
        F.sum("tail_leaves").alias("tail_leaves"), F.sum("tail_saved").alias("tail_saved")))
    total = distinct.agg(F.coalesce(F.sum(F.size("ids") + 1), F.lit(0))).first()[0]
    shards = max(1, -(-total // shard_turns))
    nodes = cut_lineage(distinct.repartitionByRange(shards, "ids").mapInArrow(_shard, NODES))
    boundary = cut_lineage(merged_boundary(nodes.filter("path IS NOT NULL")))
    inner = nodes.filter("path IS NULL")
    names = ["depth", "conv", "parent_conv", "n", "children", "leaves", "saved", "q1", "q2"]
    hanging = (inner.filter("parent_key IS NOT NULL").drop("parent_conv")
               .join(small_or_shuffled(boundary.select(F.col("key").alias("parent_key"), F.col("conv").alias("parent_conv"))), "parent_key"))
    found = inner.filter("parent_key IS NULL").select(*names).unionByName(hanging.select(*names)).unionByName(boundary.select(*names))
    if beyond is not None:
        # The first nodes beyond hang on the last of the trees, whose smallest member is the least of all with that beginning.
        tops = sequences.groupBy("q1", "q2").agg(F.min("conv").alias("top"))
        top = (hung.join(sequences.select("conv", "q1", "q2"), "conv").join(tops, ["q1", "q2"]).groupBy("p1", "p2").agg(F.min("top").alias("top"))
               .select(F.col("p1").alias("head1"), F.col("p2").alias("head2"), "top"))
        below = beyond.filter(F.col("depth") == longest + 1).drop("parent_conv").join(top.withColumnRenamed("top", "parent_conv"), ["head1", "head2"])
        found = found.unionByName(below.select(*names)).unionByName(beyond.filter(F.col("depth") > longest + 1).select(*names))
    hashes = hashed_ends(ends)
    ended = found.filter("q1 IS NOT NULL").join(hashes, ["q1", "q2"], "left")
    other = found.filter("q1 IS NULL").withColumn("ends_sha256", F.lit(None).cast("string"))
    return ended.unionByName(other).select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))
