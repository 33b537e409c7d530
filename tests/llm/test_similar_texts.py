"""Texts from a Jaccard similarity of 0.8 on against brute force."""

import random
from pathlib import Path

import pytest

import corpus_pipeline
from estatemap.llm import jaccard
from .test_dedup import documents, roots_of

FOLDER = "/root/testdata/sf0.01"


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Least id of each group of texts that share four fifths of their shingles; every pair is compared."""
    sets = {key: brute_shingles(text) for key, text in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and (sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))]
    return pairs, set(roots_of(pairs, sets).values())


def edited(dealt, words, edits):
    words = list(words)
    for _ in range(edits):
        words[dealt.randrange(len(words))] = f"e{dealt.getrandbits(40)}"
    return words


def test_edited_copies(spark):
    dealt = random.Random(3)
    common = [f"w{i}" for i in range(400)]
    rows = [(1, None), (2, ""), (3, "x"), (4, "X "), (5, "a b c d e"), (6, "a b c d e f")]
    for size in (30, 120, 300):
        for _ in range(8):
            text = [dealt.choice(common) for _ in range(size)]
            rows += [(len(rows) + 10 + i, " ".join(edited(dealt, text, dealt.randrange(1 + size // 25)))) for i in range(4)]
    text = [dealt.choice(common) for _ in range(150)]
    rows += [(len(rows) + 10 + i, " ".join(edited(dealt, text, dealt.randrange(9)))) for i in range(120)]
    dealt.shuffle(rows)
    pairs, kept = brute_kept(rows)
    assert len(pairs) > 300 and len(kept) < len(rows) - 50
    found = jaccard.drop_similar(documents(spark, [*rows, rows[0]]))
    assert found.columns == ["doc_id", "text", "keep", "digest", "row"]
    assert sorted(row.doc_id for row in found.collect()) == sorted(kept)


def test_no_documents(spark):
    assert jaccard.drop_similar(documents(spark, [])).count() == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="the driver's tables are not here")
def test_stage_drops_what_brute_force_drops(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").dropDuplicates(["text"])
    rows = [(row.doc_id, row.text) for row in docs.collect()]
    docs = docs.join(spark.createDataFrame([(key,) for key, _ in rows], "doc_id long"), "doc_id")
    pairs, kept = brute_kept(rows)
    assert pairs
    assert {row.doc_id for row in corpus_pipeline.near_copies(spark, docs, FOLDER).collect()} == kept
