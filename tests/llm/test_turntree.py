"""Conversation prefix trie against brute force."""

import hashlib
import random
import zlib

import pytest

from estatemap.llm import turntree


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {conv: [turn[2:] for turn in sorted(turns)] for conv, turns in own.items()}
    built = {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 4
        base = own.get(conv - (conv % 20 if conv >= 0 else -(-conv % 20)), [])
        built[conv] = tuple(base[:h] + turns[h:])
    nodes = {}
    for conv, turns in built.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(conv)
    children = {}
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for node, members in nodes.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += node not in children
            saved[node[:d]] += (len(members) - 1) * len(node[-1][1].encode().split()) if node else 0
    return sorted((min(members), len(node), min(nodes[node[:-1]]) if node else -1, len(members), len(children.get(node, [])), leaves[node], saved[node],
                   hashlib.sha256(",".join(map(str, sorted(c for c in members if built[c] == node))).encode()).hexdigest()) for node, members in nodes.items())


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*row, 1, "x", 2) for row in rows], "conv_id long, turn long, role string, text string, pos int, id string, key int")
    result = turntree.prefix_trie(frame, **options)
    assert result.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if value is None else value for value in row) for row in result.collect())


def dealt_rows(seed, convs=70, vocabulary=5, longest=9):
    dealt = random.Random(seed)
    texts = [" ".join(f"w{i}" for i in range(n)) for n in range(vocabulary)]
    rows = []
    for conv in range(convs):
        if conv % 11:
            for turn in range(dealt.randrange(1, longest)):
                rows.append((conv * 3 if conv % 2 else conv, turn, ("user", "assistant")[turn % 2], dealt.choice(texts)))
    copied = [row[1:] for row in rows if row[0] == 44]
    rows += [(1000 + 20 * i, *turn) for i in range(15) for turn in copied]
    rows += [(7, None, None, None), (7, None, "user", "first"), (None, 1, "user", "no one's"), (2001, 5, "user", ""), (-25, 1, "user", "below zero"), (-20, 1, "user", "base"),
             (3, 0, "user", "twice"), (3, 0, "user", "twice")]
    dealt.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"shard_turns": 40}, {"longest": 3, "shard_turns": 40}, {"longest": 1}])
def test_trie(spark, options):
    rows = dealt_rows(4)
    assert found(spark, rows, **options) == brute(rows)


def test_long_conversations(spark):
    """Longer than the trees hold: a hot conversation, copies of it and one that parts from them late."""
    long = [(0, turn, "user", f"t{turn % 7} and {turn}") for turn in range(400)]
    rows = long + [(20, *row[1:]) for row in long] + [(40, *row[1:3], "other" if row[1] == 350 else row[3]) for row in long] + [(60, *row[1:]) for row in long[:100]]
    expected = brute(rows)
    assert found(spark, rows, longest=50) == expected
    assert found(spark, rows) == expected


def test_no_conversations(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []


def test_tree_and_medians():
    assert sorted(turntree.medians_first(9)) == list(range(9)) and next(turntree.medians_first(9)) == 4
    tree = turntree.TurnTree()
    for start in range(0, 3000, 3):
        tree.insert([start, 1, 2], [1, 1, 1], 1, start)
    assert len(tree.symbol) == 1 + 3 * 1000 and tree.count[0] == 1000 and tree.least[0] == 0
