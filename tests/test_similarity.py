"""The pruned similarity join against a brute-force comparison of every pair."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from estatemap.functions import text
from estatemap.operators.matching import fuzzy_pairs
from estatemap.operators.similar import ratio_candidates

WORDS = ["seller", "Service", "Portal", "SAP", "crm", "Data", "warehouse", "Gateway", "mail", "Archive", "über", "Time"]


def noisy_names(seed, count):
    rng = random.Random(seed)
    names = []
    for _ in range(count):
        name = " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 5)))
        letters = list(name)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(letters) + 1)
            action = rng.choice("ids")
            if action == "i":
                letters.insert(at, rng.choice("abcdeXYZ -_"))
            elif letters and at < len(letters):
                if action == "d":
                    del letters[at]
                else:
                    letters[at] = rng.choice("abcdefgh")
        names.append("".join(letters))
    return sorted(set(names))


@pytest.mark.parametrize("ratio", [0.6, 0.75, 0.8, 0.85, 0.95])
def test_candidates_lose_no_pair(spark, ratio):
    left, right = noisy_names(1, 90) + ["", "a", "ab"], noisy_names(2, 90) + ["a", "abc"]
    long_texts = [" ".join(noisy_names(5, 40)), " ".join(noisy_names(5, 41))[:300]]
    left, right = left + long_texts, right + [long_texts[0].replace("crm", "cmr")]
    a = spark.createDataFrame([("", value) for value in set(left)], "grp string, text string")
    b = spark.createDataFrame([("", value, ratio) for value in set(right)], "grp string, text string, need double")
    found = {(row.a, row.b) for row in ratio_candidates(a, b, ratio).collect()}
    wanted = {(x, y) for x in left for y in right if SequenceMatcher(None, x, y).ratio() >= ratio}
    assert wanted and wanted <= found
    assert len(found) < len(set(left)) * len(set(right)) / 2


def test_fuzzy_pairs_equal_brute_force(spark):
    terms = noisy_names(3, 80)
    kinds = ["application", "interface", "", "server"]
    master = [(f"ID-{i}", name, kinds[i % 4]) for i, name in enumerate(noisy_names(4, 80))]
    rows = spark.createDataFrame(master, "cmdb_id string, name string, entity_type string")
    found = {
        (row.term, row.name): (round(row.score, 9), row.confidence)
        for row in fuzzy_pairs(spark.createDataFrame([(t,) for t in terms], "term string"), rows).collect()
    }
    keys = {
        row.value: row.key
        for row in spark.createDataFrame([(v,) for v in {*terms, *[name for _, name, _ in master]}], "value string")
        .select("value", text.match_key(F.col("value")).alias("key")).collect()
    }
    wanted = {}
    for term in terms:
        for _, name, kind in master:
            raw = SequenceMatcher(None, term.lower(), name.lower()).ratio()
            a, b = keys[term], keys[name]
            norm = SequenceMatcher(None, a, b).ratio() if a and b else 0.0
            x, y = set(a.split()), set(b.split())
            inside = 0.9 if min(len(x), len(y)) >= 2 and (x <= y or y <= x) else 0.0
            score = max(raw, norm, inside) + {"application": 0.05, "interface": -0.05}.get(kind, 0.0)
            if score >= 0.85:
                strong = raw >= 0.95 or (raw >= 0.85 and norm >= 0.95)
                wanted[(term, name)] = (round(score, 9), "stark" if strong else "schwach")
    assert found == wanted and len(wanted) > 20


def digests(seed, count, letters="0123456789abcdef"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randint(20, 64))) for _ in range(count)]


@pytest.mark.parametrize("ratio", [0.8, 0.85, 1.0])
def test_texts_of_few_letters_lose_no_pair(spark, ratio):
    rng = random.Random(7)
    right = digests(6, 300)
    left = []
    for value in right:
        letters = list(value)
        for _ in range(rng.randint(0, len(letters) // 6)):
            at, action = rng.randrange(len(letters)), rng.choice("ids")
            letters[at:at + 1] = {"i": [letters[at], rng.choice("0123")], "d": [], "s": [rng.choice("abcdef")]}[action]
        left.append("".join(letters))
    left += [value[rng.randint(0, 9):] for value in right[:60]] + right[:5]
    a = spark.createDataFrame([("", value) for value in set(left)], "grp string, text string")
    b = spark.createDataFrame([("", value, ratio) for value in set(right)], "grp string, text string, need double")
    found = {(row.a, row.b) for row in ratio_candidates(a, b, ratio).collect()}
    wanted = {(x, y) for x in left for y in right if SequenceMatcher(None, x, y, autojunk=False).ratio() >= ratio}
    assert wanted and wanted <= found
    # By rare q-grams and common letters alone, far more pairs are left.
    assert ratio < 0.85 or len(found) < 2 * len(right)


def test_rows_made_from_texts_are_not_broadcast(spark):
    """Their number is far above what the planner expects of an explode."""
    rows = digests(8, 200)
    a = spark.createDataFrame([("", value) for value in rows], "grp string, text string")
    b = a.withColumn("need", F.lit(0.85))
    plan = ratio_candidates(a, b, 0.85)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=merge" in plan


def test_parts_of_the_mentions_are_not_broadcast(spark, tmp_path, capsys):
    """A small file of parts may hold very many rows."""
    from workload.resolution import fuzzy_part_candidates

    parts = [(i, f"steel pipe {i % 3}", f"LARGE {i % 2}") for i in range(12)]
    lines = [(i // 3, i % 12, i % 3, "A") for i in range(36)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string").write.parquet(str(tmp_path / "part.parquet"))
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber long, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = fuzzy_part_candidates(spark, str(tmp_path))
    found.explain()
    shown = capsys.readouterr().out
    assert "SortMergeJoin [l_partkey" in shown and "BroadcastHashJoin [l_partkey" not in shown
    assert found.count() == len(lines)
