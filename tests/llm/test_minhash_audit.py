"""MinHash classes and the filter audit against brute force."""

import random
import re
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest

from estatemap.llm import audit, minhash
from .test_dedup import LONG, documents, roots_of
from .test_similar_texts import edited

FOLDER = "/root/testdata/sf0.01"


def brute_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute_classes(rows):
    sets = {key: brute_set(text) for key, text in rows}
    distinct = {}
    for key in sorted(sets):
        if sets[key]:
            distinct.setdefault(frozenset(sets[key]), key)
    by_word = {}
    for members, key in distinct.items():
        for shingle in members:
            by_word.setdefault(shingle, []).append(key)
    common = {}
    for keys in by_word.values():
        for i, a in enumerate(keys):
            for b in keys[i + 1:]:
                common[a, b] = common.get((a, b), 0) + 1
    pairs = [(a, b) for (a, b), n in common.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    pairs += [(distinct[frozenset(sets[key])], key) for key in sets if sets[key]]
    roots = roots_of(pairs, sets)
    return {key: (len(sets[key]), roots[key], roots[key] == key) for key in sets}


def edited_documents(seed=3):
    dealt = random.Random(seed)
    common = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, "x"), (4, "X "), (5, "a b c d"), (6, "a b c d e"), (7, " \t"), (8, LONG), (9, LONG + "end")]
    for size in (30, 120, 300):
        for _ in range(8):
            text = [dealt.choice(common) for _ in range(size)]
            rows += [(len(rows) + 10 + i, " ".join(edited(dealt, text, dealt.randrange(1 + size // 20)))) for i in range(4)]
    text = [dealt.choice(common) for _ in range(150)]
    rows += [(len(rows) + 10 + i, " ".join(edited(dealt, text, dealt.randrange(9)))) for i in range(120)]
    passage = [dealt.choice(common) for _ in range(100)]
    rows += [(len(rows) + 10 + i, " ".join(passage + [dealt.choice(common) for _ in range(60)])) for i in range(60)]
    dealt.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowd", [256, 2])
def test_classes(spark, crowd):
    rows = edited_documents()
    expected = brute_classes(rows)
    assert sum(not kept for _, _, kept in expected.values()) > 60
    found = minhash.near_classes(documents(spark, rows), crowd=crowd).collect()
    assert {row.doc_id: (row.n_shingles, row.component_id, row.kept) for row in found} == expected and len(found) == len(rows)


def test_join_finds_all_pairs_within_the_distance(spark):
    """Signatures of given distances, without sets to confirm them: the join alone."""
    dealt = np.random.default_rng(5)
    symbols = dealt.integers(0, 1 << minhash.BITS, (40, minhash.SYMBOLS))
    for i in range(1, 40):
        if i % 4:
            symbols[i] = symbols[i - i % 4]
            at = dealt.choice(minhash.SYMBOLS, dealt.integers(1, 60), replace=False)
            symbols[i, at] = dealt.integers(0, 1 << minhash.BITS, len(at))
    pack = lambda row: [int(sum(int(v) << (15 * k) for k, v in enumerate(row[4 * c:4 * c + 4]))) for c in range(minhash.CHUNKS)]
    signatures = spark.createDataFrame([(i, pack(row)) for i, row in enumerate(symbols)], "node long, chunks array<long>")
    met = minhash.met_entries(signatures)
    alone = spark.createDataFrame([], "node long, root long")
    expected = {(a, b) for a in range(40) for b in range(a + 1, 40) if (symbols[a] != symbols[b]).sum() <= minhash.FARTHEST}
    assert {tuple(row) for row in minhash.cross_pairs(met, signatures, alone, minhash.FARTHEST, 1).collect()} == expected
    assert len(expected) > 10 and minhash.SURE >= 2


def test_entries_are_shuffled_once(spark, capsys):
    """Sizes of buckets and their entries are read from one exchange, not from two of the same rows."""
    signatures = spark.createDataFrame([(i, [i // 2 + at for at in range(minhash.CHUNKS)]) for i in range(40)], "node long, chunks array<long>")
    met = minhash.met_entries(signatures)
    assert {row.node for row in met.collect()} == set(range(40))
    met.explain()
    assert "ReusedExchange" in capsys.readouterr().out


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (None, "other words stand here"), (2, "q"), (2, None)]
    found = sorted(minhash.near_classes(documents(spark, rows)).collect(), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in found), key=str) == sorted(
        [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (None, 1, None, False), (2, 1, 2, True), (2, 0, 2, True)], key=str)
    assert minhash.near_classes(documents(spark, [])).count() == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")
def test_given_documents(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    expected = brute_classes([(row.doc_id, row.text) for row in docs.collect()])
    assert {row.doc_id: (row.n_shingles, row.component_id, row.kept) for row in minhash.near_classes(docs).collect()} == expected


def test_trie():
    dealt = random.Random(1)
    texts = ["", "a", "ab", "abc", "abd", "é", "x" * 50_000 + "1", "x" * 50_000 + "2", *["".join(dealt.choice("ab") for _ in range(dealt.randrange(9))) for _ in range(300)]]
    rows = [(dealt.randrange(1000), text.encode()) for text in texts * 2]
    trie, least = audit.TextTrie(), {}
    for key, text in rows:
        trie.insert(text, (key, 0))
        least[text] = min(key, least.get(text, key))
    found = [(text, entry[0]) for text, entry in trie.terminals()]
    assert len(found) == len(least) and dict(found) == least


def brute_audit(rows, labels):
    """rows: (id, text, source)."""
    counts = {}
    for key, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {name for name, failed in {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": key is not None and any(other is not None and other < key and (t or "") == text for other, t, _ in rows)}.items() if failed}
        counts.setdefault(source or "", []).append((fails, *labels.get(key, (0, 0))))
    result = {}
    for part, members in counts.items():
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = members
            for step, name in enumerate(order, 1):
                out = [m for m in left if name in m[0]]
                left = [m for m in left if name not in m[0]]
                total[name] += len(out)
                result[part, "".join(order), step] = [
                    len(left), len(out), sum(name in m[0] for m in members) - len(out), sum(m[0] == {name} for m in members), sum(m[1] for m in out),
                    sum(m[2] for m in out)]
        for (p, order, step), values in result.items():
            if p == part:
                values.append(total[order[step - 1]])
    return {key: tuple(values) for key, values in result.items()}


def audited(spark, rows, labels, **options):
    docs = spark.createDataFrame([(*row, "m", 1) for row in rows], "doc_id long, text string, source string, mask string, id int")
    known = spark.createDataFrame([(key, good, toxic) for key, (good, toxic) in labels.items()], "doc_id long, quality int, toxic int")
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(docs, known, **options).collect()}


@pytest.mark.parametrize("options", [{}, {"trie_bytes": 200, "range_bytes": 100}])
def test_audit(spark, options):
    dealt = random.Random(7)
    vocabulary = [f"w{i}" for i in range(600)] + ["BIG", "a$b", "É"]
    rows = [(i, " ".join(dealt.choice(vocabulary[:dealt.choice((20, 603))]) for _ in range(dealt.choice((3, 199, 200, 400)))), dealt.choice(("a", "b", None, "")))
            for i in range(60)]
    rows += [(100 + i, rows[dealt.randrange(60)][1], "b") for i in range(30)] + [(-1, rows[0][1], "a"), (200, None, "b"), (201, "", "c"), (None, "", "c")]
    rows += [(300 + i, "copied often " * 40, "hot") for i in range(60)] + [rows[3], rows[3], (3, "other text", "a"), (400, LONG, None), (401, LONG, None)]
    rows += [(500 + i, "the same beginning " * 10 + str(i % 20), "a") for i in range(40)]
    labels = {i: (i % 2, i % 3 == 0) for i in range(0, 400, 3)} | {3: (1, 1)}
    labels = {key: (int(good), int(toxic)) for key, (good, toxic) in labels.items()}
    assert audited(spark, rows, labels, **options) == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    assert audited(spark, [], {}) == {}
