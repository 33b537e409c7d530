"""Exact and near copies against brute force."""

import hashlib
import random
import re

import pyarrow as pa
import pytest
import xxhash

from estatemap.llm import exact_dedup, simhash
from estatemap.llm.components import components

LONG = "very long text " * 20_000
TEXTS = ["a b c d", "a b c d", None, "", "x", "A B C D", LONG, LONG, "  ", "é", "é"]


def documents(spark, rows):
    """Documents with an extra column for every name the operators use inside."""
    return spark.createDataFrame([(*row, 1, 2, 3) for row in rows], "doc_id long, text string, keep int, digest int, row int")


def test_exact_groups(spark):
    rows = [(i, text) for i, text in enumerate(TEXTS)] + [(None, "x"), (3, ""), (3, ""), (None, None)]
    found = exact_dedup.duplicate_groups(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    groups = {}
    for key, text in rows:
        groups.setdefault(hashlib.sha256((text or "").encode()).hexdigest(), []).append(key)
    kept = {}
    for row in found:
        members = groups[row.text_sha256]
        assert row.keep_id == max((m for m in members if m is not None), default=None) and row.group_size == len(members)
        kept.setdefault(row.text_sha256, []).append(row.kept)
        assert not row.kept or row.doc_id == row.keep_id
    assert all(sum(flags) == 1 for flags in kept.values())


@pytest.mark.parametrize("counters", [1, 2, 1024])
def test_heavy_and_light_agree(spark, counters):
    dealt = random.Random(4)
    rows = [(i, "hot" if dealt.random() < 0.4 else f"t{dealt.randrange(40)}") for i in range(400)]
    found = {row.doc_id: row for row in exact_dedup.duplicate_groups(documents(spark, rows).repartition(5), counters=counters).collect()}
    for key, text in rows:
        members = [k for k, t in rows if t == text]
        assert (found[key].keep_id, found[key].group_size, found[key].kept) == (max(members), len(members), key == max(members))
    kept = exact_dedup.drop_copies(documents(spark, rows + rows[:50]), counters=counters)
    assert kept.columns == ["doc_id", "text", "keep", "digest", "row"]
    assert sorted(row.doc_id for row in kept.collect()) == sorted({max(k for k, t in rows if t == text) for _, text in rows})


def test_summaries_keep_frequent_digests():
    dealt = random.Random(2)
    values = [b"hot"] * 60 + [str(dealt.randrange(90)).encode() for _ in range(100)]
    dealt.shuffle(values)
    summary = pa.table({"digest": pa.array([], pa.binary()), "weight": pa.array([], pa.int64())})
    for start in range(0, len(values), 16):
        part = pa.table({"digest": pa.array(values[start:start + 16], pa.binary()), "weight": pa.array([1] * len(values[start:start + 16]), pa.int64())})
        summary = exact_dedup.merge_summaries(pa.concat_tables([summary, part]), 3)
        assert summary.num_rows <= 3
    assert b"hot" in summary["digest"].to_pylist()


def test_exact_empty(spark):
    assert exact_dedup.duplicate_groups(documents(spark, [])).count() == 0
    assert exact_dedup.drop_copies(documents(spark, [])).count() == 0


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def roots_of(links, nodes):
    parent = {node: node for node in nodes}

    def find(node):
        while parent[node] != node:
            node = parent[node]
        return node
    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {node: find(node) for node in nodes}


def test_fingerprint_matches_definition():
    for text in [*TEXTS[:6], "a", "a b", "A  B\tc\x0bd \xa0e", "Straße ÉÈ été", "one two three " * 30_000]:
        assert simhash.fingerprint(text) == brute_fingerprint(text)


@pytest.mark.parametrize("crowd,bits", [(1000, 3), (2, 3), (2, 2), (2, 1), (1000, 2)])
def test_links_join_what_brute_force_joins(spark, crowd, bits):
    dealt = random.Random(crowd + bits)
    fps = {0, (1 << 64) - 1}
    for _ in range(12):
        centre = dealt.getrandbits(64)
        for _ in range(14):
            moved = centre
            for _ in range(dealt.randrange(6)):
                moved ^= 1 << dealt.randrange(64)
            fps.add(moved)
    signed = sorted(fp - (1 << 64) if fp >> 63 else fp for fp in fps)
    frame = spark.createDataFrame([(fp,) for fp in signed], "fp long")
    found = {row.node: row.root for row in components(simhash.links(frame, bits, crowd)).collect()}
    mask = (1 << 64) - 1
    brute = roots_of([(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= bits], signed)
    assert {fp: found.get(fp, fp) for fp in signed} == brute


def test_coordinates_bound_the_distance():
    import numpy as np

    dealt = random.Random(8)
    fps = np.array([dealt.getrandbits(64) for _ in range(40)], np.uint64).view(np.int64)
    table = simhash.pivot_table(fps)
    for i in range(40):
        apart = np.abs(table - table[i]).max(axis=1)
        assert (apart <= np.bitwise_count(fps.view(np.uint64) ^ fps.view(np.uint64)[i])).all()


def near_documents():
    dealt = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(30):
        text = [dealt.choice(words) for _ in range(400)]
        rows.append((3 * i + 5, " ".join(text)))
        if i % 2:
            text[200] = "changed"
            rows.append((3 * i + 6, " ".join(text)))
    return rows + [(1, None), (2, ""), (200, "x"), (None, "x"), (201, LONG), (202, LONG)]


def test_near_groups(spark):
    rows = near_documents()
    found = simhash.near_groups(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    fps = [brute_fingerprint(text) for _, text in rows]
    root = roots_of([(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3], range(len(rows)))
    least = {}
    for at, (key, _) in enumerate(rows):
        if key is not None:
            least[root[at]] = min(key, least.get(root[at], key))
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found) == sorted(
        (str(key), f"{fps[at]:016x}", least.get(root[at])) for at, (key, _) in enumerate(rows))
    # Rows with the least id stay; a repeated row counts once.
    kept = simhash.drop_near_copies(documents(spark, rows + [(200, "x"), (5, rows[0][1])]))
    assert kept.columns == ["doc_id", "text", "keep", "digest", "row"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(key) for key in least.values())


def test_near_empty(spark):
    assert simhash.near_groups(documents(spark, [])).count() == 0
    assert simhash.drop_near_copies(documents(spark, [])).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (160, 100), (100, 160)]
    frame = spark.createDataFrame(chain, "src long, dst long")
    found = {row.node: row.root for row in components(frame).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 161)}


def test_few_links_take_few_tasks(spark):
    frame = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "src long, dst long").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = components(frame)
        assert found.rdd.getNumPartitions() == 1
        assert {row.node: row.root for row in found.collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
