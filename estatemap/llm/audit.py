"""Filter interaction audit: which of several filters removes what, in every order they may be applied in.

Each document gets a mask of the filters it fails; everything the audit reports follows from the number of documents
(all, good, toxic) by part and mask. Four filters look at the text alone. The fifth, "identical to the text of a smaller id",
comes from radix text tries:

1. Every task inserts its full texts in compressed tries that hold the least id at each terminal, and passes on one row
   per text; a trie that reaches ``TRIE_BYTES`` of text is emptied first. So copies meet before the shuffle.
2. Texts are range-partitioned by adaptive prefixes: a prefix with more than ``RANGE_BYTES`` of texts is replaced by four times
   longer ones, until every prefix is light or a whole text. A common beginning therefore spreads over many tasks.
3. Each range inserts its texts in a trie again; the traversal gives the id that is the least of its text.

Documents join these ids by (id, hash of the text); all others with an id fail the filter. Texts are shuffled once, after copies met.

Defined cases: a null text is empty; a null source is the part ''; rows without an id are neither smaller nor larger than
any and never fail the fifth filter; rows equal in id and text are decided alike; several labels of one id count if any
is set; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatemap.llm.common import small_or_shuffled, stored

FILTERS = "ABCDE"
#: Text that a trie of one task holds before it is emptied, and that a prefix holds before it is made longer.
TRIE_BYTES = 64 << 20
RANGE_BYTES = 16 << 20
FIRST_PREFIX, LONGER = 4, 4


class TextTrie:
    """A radix trie over byte strings; a terminal holds the least id of its text and what came with it."""

    __slots__ = ("children", "least", "size")

    def __init__(self):
        #: Root edges by first byte: [label, edges below, terminal or None].
        self.children: dict[int, list] = {}
        self.least: tuple | None = None
        self.size = 0

    def insert(self, text: bytes, entry: tuple) -> None:
        """``entry`` starts with the id; the entry with the least one stays."""
        if not text:
            self.least = entry if self.least is None or entry[0] < self.least[0] else self.least
            return
        edges, at = self.children, 0
        while True:
            edge = edges.get(text[at])
            if edge is None:
                edges[text[at]] = [text[at:], {}, entry]
                self.size += len(text) - at
                return
            label = edge[0]
            if not text.startswith(label, at):
                common = _common(label, text, at)
                # The edge is split where the texts part.
                edge[:] = [label[:common], {label[common]: [label[common:], edge[1], edge[2]]}, None]
            at += len(edge[0])
            if at == len(text):
                if edge[2] is None or entry[0] < edge[2][0]:
                    edge[2] = entry
                return
            edges = edge[1]

    def terminals(self) -> Iterator[tuple[bytes, tuple]]:
        """Every text with its entry, without recursion."""
        if self.least is not None:
            yield b"", self.least
        open_edges = [(b"", edge) for edge in self.children.values()]
        while open_edges:
            above, (label, below, entry) = open_edges.pop()
            text = above + label
            if entry is not None:
                yield text, entry
            open_edges += [(text, edge) for edge in below.values()]


def _common(label: bytes, text: bytes, at: int) -> int:
    """Length of the common beginning of ``label`` and ``text[at:]``, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if text.startswith(label[low:middle], at + low):
            low = middle
        else:
            high = middle - 1
    return low


def _batches(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for start in range(0, len(rows), 2000):
        part = rows[start:start + 2000]
        yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*part), schema)], schema=schema)


def _first_ids(trie_bytes: int):
    """One row (id, hash, text) per text of a task, with its least id there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, schema = TextTrie(), None
        drain = lambda: _batches([(*entry, text) for text, entry in trie.terminals()], schema)
        for batch in batches:
            schema = pa.schema([("id", batch.schema.field(0).type), ("hash", pa.int64()), ("text", pa.binary())])
            for key, hashed, text in zip(*[column.to_pylist() for column in batch.columns]):
                trie.insert(text, (key, hashed))
            if trie.size > trie_bytes:
                yield from drain()
                trie = TextTrie()
        if schema is not None:
            yield from drain()
    return run


def _least_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, hash) of the least id of every text of a range."""
    trie, schema = TextTrie(), None
    for batch in batches:
        schema = pa.schema([("id", batch.schema.field(0).type), ("hash", pa.int64())])
        for key, hashed, text in zip(*[column.to_pylist() for column in batch.columns[:3]]):
            trie.insert(text, (key, hashed))
    if schema is not None:
        yield from _batches([entry for _, entry in trie.terminals()], schema)


def with_ranges(texts: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``texts`` with ``range``: the shortest prefix of ``text`` (4, 16, 64, ... bytes) that is light or whole."""
    length, size = FIRST_PREFIX, F.octet_length("text")
    prefix = lambda n: F.substring("text", 1, n)
    rows = texts.withColumn("range", prefix(length))
    while True:
        heavy = (rows.filter(F.octet_length("range") == length).groupBy("range").agg(F.sum(size).alias("bytes"), F.max(size).alias("longest"))
                 .filter((F.col("bytes") > range_bytes) & (F.col("longest") > length)).select(F.col("range").alias("heavy")))
        found = [row.heavy for row in heavy.collect()]  # fewer than all bytes / range_bytes
        if not found:
            return rows
        length *= LONGER
        marked = F.broadcast(rows.sparkSession.createDataFrame([(bytes(value),) for value in found], "heavy binary"))
        rows = (rows.join(marked, F.col("range") == F.col("heavy"), "left")
                .withColumn("range", F.when(F.col("heavy").isNotNull(), prefix(length)).otherwise(F.col("range"))).drop("heavy"))


def least_ids(docs: DataFrame, trie_bytes: int = TRIE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``id, hash`` of the least id of every text of ``docs`` (``id, hash, text``)."""
    rows = docs.filter("id IS NOT NULL").select("id", "hash", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["id"]
    texts = stored(rows.mapInArrow(_first_ids(trie_bytes), f"id {kind}, hash long, text binary"))
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (2 * range_bytes)))
    ranged = with_ranges(texts, range_bytes).repartitionByRange(parts, "range")
    return ranged.select("id", "hash", "text").mapInArrow(_least_ids, f"id {kind}, hash long")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters A to D on a text that is not null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda word: word != "")
    count = F.size(words)
    return {
        "A": count < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * count,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 2 * F.length(text),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source",
          trie_bytes: int = TRIE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``id, part, mask`` of every row: bit i is set where it fails filter i of ``FILTERS``."""
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("hash"),
                       F.coalesce(F.col(text_column), F.lit("")).alias("text"), F.coalesce(F.col(part_column).cast("string"), F.lit("")).alias("part"))
    failures = text_failures(F.col("text"))
    bits = sum(((failure.cast("int") * (1 << FILTERS.index(name))) for name, failure in failures.items()), F.lit(0))
    light = rows.select("id", "hash", "part", bits.alias("bits"))
    least = least_ids(rows.select("id", "hash", "text"), trie_bytes, range_bytes).withColumn("first", F.lit(True))
    repeated = F.col("id").isNotNull() & F.col("first").isNull()
    return light.join(least, ["id", "hash"], "left").select("id", "part", (F.col("bits") + F.when(repeated, 16).otherwise(0)).alias("mask"))


def _orders() -> Column:
    """For every order and step of it: the filter's bit and the bits of the filters before it."""
    rows = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            rows.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")))
            before |= bit
    return F.array(*rows)


def audit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", part_column: str = "source",
          trie_bytes: int = TRIE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``; ``labels`` has the id, quality, toxic."""
    marked = masks(docs, id_column, text_column, part_column, trie_bytes, range_bytes)
    known = (labels.select(F.col(id_column).alias("id"), (F.col("quality") == 1).cast("long").alias("good"), (F.col("toxic") == 1).cast("long").alias("toxic"))
             .filter("id IS NOT NULL").groupBy("id").agg(F.max("good").alias("good"), F.max("toxic").alias("toxic")))
    counts = (marked.join(known, "id", "left").groupBy("part", "mask")
              .agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")))
    spread = counts.select("part", "mask", "n", "good", "toxic", F.explode(_orders()).alias("at")).select("*", "at.*")
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda condition, value: F.sum(F.when(condition, value).otherwise(F.lit(0))).cast("long")
    # A filter is the first of those that a document fails in 120 / (their number) orders.
    turns = (F.lit(120) / F.greatest(F.bit_count("mask"), F.lit(1))).cast("long")
    return spread.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~earlier, F.col("n")).alias("kept"), total(fails & ~earlier, F.col("n")).alias("removed"),
        total(fails & earlier, F.col("n")).alias("redundant"), total(F.col("mask") == F.col("bit"), F.col("n")).alias("unique_fails"),
        total(fails & ~earlier, F.col("good")).alias("good_lost"), total(fails & ~earlier, F.col("toxic")).alias("toxic_lost"),
        total(fails, F.col("n") * turns).alias("shapley"))
