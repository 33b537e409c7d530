"""Best-fit packing by linear grouping.

Tokenised documents are cut into pieces of at most ``capacity`` tokens. Packing is decided on the histogram of
piece lengths, which has ``capacity`` entries whatever the table's size:

1. lengths above ``small`` are sorted and divided into ``groups`` of equal cardinality, each rounded up to its
   longest member;
2. configurations of rounded lengths are chosen one after the other: the largest group left plus the knapsack
   filling that leaves least room, used as often as the counts allow;
3. actual documents take the places of the rounded ones, which frees the room that rounding had reserved;
4. small lengths, longest first, go where they leave least room; new sequences are opened only when none fits.

The plan is a list of runs (length, numbers from-to, first sequence, pieces per sequence, first offset). Rows find
their place from their length and their number among the pieces of that length.

Defined cases: a null or empty text is one piece that holds only the end id; repeated rows are packed one by
one; an empty table gives an empty result; extra columns are not read; texts of any length are tokenised whole.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatemap.llm.common import cut_lineage, ranked

CAPACITY = 2048
SMALL = 256
GROUPS = 96
END_ID = 0
#: Pieces of text whose ids one worker remembers (about 200 bytes each); a memory is emptied when it is full.
REMEMBERED = 350_000
#: Words longer than this are tokenised anew each time.
LONG_WORD = 64
#: White space of the tokenizer's own splitting rule (fixed values). ``str.split`` takes four control characters more.
WHITE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
NOT_WHITE = "\x1c\x1d\x1e\x1f"
#: What takes a text off the short way: letters beyond Latin, marks that join letters, controls, letters with odd lower case.
ODD = re.compile(r"[^\t-\r -~\x85\xa0-\u012f\u0131-\u0148\u014a-\u017f\u2000-\u200a\u2010-\u2029\u20ac]")
#: The tokenizer's split of a plain text in lower case: letters, single numbers, contractions, other marks (fixed values).
PARTS = re.compile(
    r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|'(?:s|t|re|ve|m|ll|d)"
    r"|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u017f0-9\xb2\xb3\xb9\xbc-\xbe\s]+")
_memory: dict[str, WordIds] = {}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else the next above 255."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in prints]
    return {byte: chr(byte) for byte in prints} | {byte: chr(256 + at) for at, byte in enumerate(others)}


class WordIds:
    """Ids of texts, part by part: the tokenizer never joins what it has split.

    A plain text (Latin letters, no special token) is lower-cased and split as the tokenizer would split it, and only
    new parts meet its merges; any other text goes through the tokenizer word by word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def split(text: str) -> list[str]:
        if any(mark in text for mark in NOT_WHITE):
            return WHITE.split(text)
        return text.split()

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
        return b"".join([token.id.to_bytes(4, "little") for token in self.model.tokenize(letters)])

    def _word(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        """Little-endian 32-bit ids of the text."""
        if "<|" not in text and not ODD.search(text):
            pieces, known, learn, most = PARTS.findall(text.lower()), self.parts, self._part, REMEMBERED
        else:
            pieces, known, learn, most = self.split(text), self.words, self._word, REMEMBERED // 4
        found = list(map(known.get, pieces))
        if None in found:
            if len(known) > most:
                known.clear()
            for at, ids in enumerate(found):
                if ids is None:
                    piece = pieces[at]
                    ids = known.get(piece)
                    if ids is None:
                        ids = learn(piece)
                        if len(piece) <= LONG_WORD:
                            known[piece] = ids
                    found[at] = ids
        return b"".join(found)


def _ids(path: str) -> WordIds:
    if path not in _memory:
        _memory[path] = WordIds(path)
    return _memory[path]


def _pieces(path: str, capacity: int):
    schema = pa.schema([("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])
    end, step = np.array([END_ID], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part, out = batch.slice(first, 256), []
                for key, text in zip(part.column(0).to_pylist(), part.column(1)):
                    whole = ids(text.as_py() or "") + end
                    for piece, at in enumerate(range(0, len(whole), step)):
                        cut = whole[at:at + step]
                        out.append((key, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, field.type) for column, field in zip(zip(*out), schema)], schema=schema)
    return run


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_column: str = "doc_id",
                     text_column: str = "text") -> DataFrame:
    """``id_column, piece, start, length, ids_crc32``: the pieces of every document."""
    return (docs.select(F.col(id_column).cast("long"), F.col(text_column))
            .mapInArrow(_pieces(tokenizer_path, capacity), "id long, piece int, start long, length long, ids_crc32 long")
            .withColumnRenamed("id", id_column))


def _filling(room: int, sizes: list[int], counts: list[int]) -> list[int]:
    """Group indexes whose sizes add up to the most that fits into ``room``; a group is used as often as it has members.

    The reachable sums are the bits of one number.
    """
    mask = (1 << (room + 1)) - 1
    layers, reached = [], 1
    for group, (size, count) in enumerate(zip(sizes, counts)):
        if not count or size > room:
            continue
        grown = reached
        for _ in range(min(count, room // size)):
            more = (grown | grown << size) & mask
            if more == grown:
                break
            grown = more
        layers.append((group, size, reached))
        reached = grown
    total, used = reached.bit_length() - 1, []
    for group, size, before in reversed(layers):
        while not before >> total & 1:
            used.append(group)
            total -= size
    return used


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """(how often, group indexes) until no group has members left. ``sizes`` descend."""
    left, found = list(counts), []
    for largest in range(len(sizes)):
        while left[largest]:
            left[largest] -= 1
            used = [largest, *_filling(capacity - sizes[largest], sizes, left)]
            left[largest] += 1
            often = min(left[group] // used.count(group) for group in set(used))
            for group in used:
                left[group] -= often
            found.append((often, used))
    return found


class Plan:
    """Runs of pieces of one length that fill a run of sequences in the same way."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS):
        self.capacity, self.sequences = capacity, 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.taken: dict[int, int] = defaultdict(int)
        self.rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # room -> (first sequence, how many)
        self._large({length: n for length, n in histogram.items() if length > small and n}, groups)
        for length in sorted((length for length, n in histogram.items() if length <= small and n), reverse=True):
            self._small(length, histogram[length])

    def _run(self, length: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        low = self.taken[length]
        self.runs.append((length, low, low + pieces, sequence, each, offset))
        self.taken[length] += pieces

    def _large(self, histogram: dict[int, int], groups: int) -> None:
        lengths, total = sorted(histogram, reverse=True), sum(histogram.values())
        if not total:
            return
        members: list[list[list[int]]] = []  # of each group: [length, pieces], longest first
        share, filled = -(-total // groups), 0
        for length in lengths:
            rest = histogram[length]
            while rest:
                if filled % share == 0:
                    members.append([])
                part = min(rest, share - filled % share)
                members[-1].append([length, part])
                filled, rest = filled + part, rest - part
        sizes, counts = [group[0][0] for group in members], [sum(n for _, n in group) for group in members]
        for often, used in configurations(sizes, counts, self.capacity):
            self._substitute(often, [members[group] for group in used])

    def _substitute(self, often: int, slots: list[list[list[int]]]) -> None:
        """Fill ``often`` sequences; each slot takes the longest pieces that its group still has."""
        taken = []
        for group in slots:
            need, runs = often, []
            while need:
                length, have = group[0]
                part = min(need, have)
                runs.append([length, part])
                need -= part
                group[0][1] -= part
                if not group[0][1]:
                    group.pop(0)
            taken.append(runs)
        while taken[0]:
            same, offset = min(runs[0][1] for runs in taken), 0
            for runs in taken:
                self._run(runs[0][0], same, self.sequences, 1, offset)
                offset += runs[0][0]
                runs[0][1] -= same
                if not runs[0][1]:
                    runs.pop(0)
            self._room(self.capacity - offset, self.sequences, same)
            self.sequences += same

    def _room(self, room: int, sequence: int, many: int) -> None:
        if room and many:
            self.rooms[room].append((sequence, many))

    def _fill(self, length: int, pieces: int, room: int, sequence: int, many: int) -> int:
        """Put pieces into ``many`` sequences with the same room; returns how many were placed."""
        each = room // length
        full = min(many, pieces // each)
        offset = self.capacity - room
        if full:
            self._run(length, full * each, sequence, each, offset)
            self._room(room - each * length, sequence, full)
        rest = pieces - full * each
        if full == many or not rest:
            self._room(room, sequence + full, many - full)
            return full * each
        self._run(length, rest, sequence + full, rest, offset)
        self._room(room - rest * length, sequence + full, 1)
        self._room(room, sequence + full + 1, many - full - 1)
        return pieces

    def _small(self, length: int, pieces: int) -> None:
        for room in range(length, self.capacity + 1):
            if self.rooms[room]:
                waiting, self.rooms[room] = self.rooms[room], []
                for at, (sequence, many) in enumerate(waiting):
                    pieces -= self._fill(length, pieces, room, sequence, many)
                    if not pieces:
                        self.rooms[room].extend(waiting[at + 1:])
                        return
        many = -(-pieces // (self.capacity // length))
        self._fill(length, pieces, self.capacity, self.sequences, many)
        self.sequences += many


def pack(pieces: DataFrame, capacity: int = CAPACITY, small: int = SMALL, groups: int = GROUPS,
         id_column: str = "doc_id") -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    ``pieces`` is cut from its lineage once and holds numbers only; the texts are tokenised a single time.
    """
    rows = cut_lineage(pieces)
    # At most ``capacity`` rows.
    histogram = {row.length: row.n for row in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    if any(not 0 < length <= capacity for length in histogram):
        raise ValueError("pieces must have 1 to capacity tokens")
    runs = sorted(Plan(histogram, capacity, small, groups).runs)
    length, low, high, first, each, offset = (np.array(column, np.int64) for column in zip(*runs)) if runs else [np.zeros(0, np.int64)] * 6
    key = (length << 44) + low

    @F.pandas_udf("sequence_id long, offset long")
    def place(of: pd.Series, number: pd.Series) -> pd.DataFrame:
        of, number = of.to_numpy(np.int64), number.to_numpy(np.int64)
        at = np.searchsorted(key, (of << 44) + number, side="right") - 1
        past = number - low[at]
        return pd.DataFrame({"sequence_id": first[at] + past // each[at], "offset": offset[at] + past % each[at] * of})

    numbered = ranked(rows, "length", [id_column, "piece", "ids_crc32"], "_number")
    return (numbered.withColumn("_place", place("length", "_number"))
            .select(*pieces.columns, "_place.sequence_id", "_place.offset"))
