"""Terms and names are computed once for all comparisons, and raw texts and keys are compared together."""

from pyspark.sql import functions as F

from estatemap.functions import scoring, text
from estatemap.operators import matching, similar

TERMS = ["", "System Interface", "Order Service", "orderServiceInterface", "Ordre Service", "Billing", "Bill", None]
NAMES = ["", "Interface", "Order Service", "Billling", "Order Service Gateway"]


def scored(spark):
    """All pairs of the texts above that reach the threshold, without any join."""
    pairs = [(a, b) for a in TERMS if a is not None for b in NAMES]
    rows = spark.createDataFrame(pairs, "term string, name string")
    a, b = text.match_key(F.col("term")), text.match_key(F.col("name"))
    raw = scoring.seq_ratio(F.lower("term"), F.lower("name"))
    score = scoring.match_score(raw, scoring.similarity(a, b), scoring.containment(a, b), F.lit(""))
    return rows.withColumn("score", score).filter(F.col("score") >= scoring.FUZZY_THRESHOLD)


def test_terms_are_computed_once_and_empty_keys_meet_nothing(spark):
    computed = spark.sparkContext.accumulator(0)

    def seen(value):
        computed.add(1)
        return value

    terms = spark.createDataFrame([(term,) for term in TERMS], "term string").withColumn("term", F.udf(seen).asNondeterministic()("term"))
    names = spark.createDataFrame([(name,) for name in NAMES], "name string")
    found = {(row.term, row.name, round(row.score, 6)) for row in matching.fuzzy_pairs(terms, names).collect()}
    assert found == {(row.term, row.name, round(row.score, 6)) for row in scored(spark).collect()}
    assert {("", "", 1.0), ("Order Service", "Order Service Gateway", 0.9)} <= found
    assert computed.value == len(TERMS)


def test_a_small_vocabulary_is_not_shuffled_to_a_large_one(spark, monkeypatch):
    left = spark.createDataFrame([("", "alpha"), ("", "beta")], "grp string, text string")
    right = spark.createDataFrame([("", "alpho", 0.85), ("", "betas", 0.85)], "grp string, text string, need double")
    rows = []
    for most in (similar.BROADCAST_PARTS, 0):
        monkeypatch.setattr(similar, "BROADCAST_PARTS", most)
        lengths = spark.createDataFrame([(5, 5, 1, 1, True), (4, 5, 0, 1, True)], "la int, lb int, lost_a int, lost_b int, whole boolean")
        met = similar._alike_but_few(left.withColumn("len", F.char_length("text")), right.withColumn("len", F.char_length("text")), lengths)
        assert ("SortMergeJoin" in met._jdf.queryExecution().sparkPlan().toString()) == (most == 0)
        rows.append(sorted(tuple(row) for row in met.distinct().collect()))
    assert rows[0] == rows[1] and len(rows[0]) == 2
