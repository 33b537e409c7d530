"""Language identification and the quality classifier: held-out accuracy and edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from estatemap.llm import langid, quality
from estatemap.llm.common import bounded_sample, held_out

SYLLABLES = {"aa": ["ka", "lo", "mi", "ta", "nu"], "bb": ["schr", "ei", "tz", "ung", "ber"], "cc": ["é", "ç", "eau", "oi", "que"]}


def text_of(dealt, lang, many):
    return " ".join("".join(dealt.choice(SYLLABLES[lang]) for _ in range(dealt.randrange(1, 4))) for _ in range(many))


def language_rows():
    dealt = random.Random(1)
    rows = []
    for i in range(360):
        lang = sorted(SYLLABLES)[i % 3]
        text = text_of(dealt, lang, dealt.randrange(4, 40))
        rows.append((i, text.upper() if i % 7 == 0 else text + " *** 123", lang, "src"))
    return rows + [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "12 !!", "cc", "s"), (None, "kalo mita", None, "s"), (1003, "lokami " * 60_000, "aa", "s")]


def test_language(spark):
    frame = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string, lang_pred string")
    model = langid.train(langid.training_rows(frame, ~held_out("doc_id", 4, 2), per_language=100))
    assert model.languages == ["aa", "bb", "cc"]
    found = {row.doc_id: row for row in langid.identify(frame, model).collect()}
    assert len(found) == 365 and all((found[key].lang_pred, found[key].score) == ("und", 0.0) for key in (1000, 1001, 1002))
    assert found[None].lang_pred == "aa" and found[1003].lang_pred == "aa"
    truth = {row[0]: row[2] for row in language_rows()[:360]}
    held = [row.doc_id for row in frame.filter(held_out("doc_id", 4, 2)).collect() if row.doc_id in truth]
    assert len(held) > 50 and np.mean([found[key].lang_pred == truth[key] for key in held]) > 0.97
    assert all(0 <= row.score <= 1 for row in found.values())


def test_language_without_labels(spark):
    frame = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    model = langid.train(langid.training_rows(frame, F.lit(True)))
    assert [row.lang_pred for row in langid.identify(frame, model).collect()] == ["und"]
    assert langid.identify(frame.limit(0), model).count() == 0


def test_pieces_hash_as_the_whole():
    text = text_of(random.Random(3), "cc", 500)
    whole = np.concatenate(list(langid.subwords(text)))
    piece, langid.PIECE = langid.PIECE, 97
    try:
        parts = np.concatenate(list(langid.subwords(text)))
    finally:
        langid.PIECE = piece
    assert (np.bincount(whole, minlength=langid.BUCKETS) == np.bincount(parts, minlength=langid.BUCKETS)).all()


def quality_rows():
    dealt = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        bad = dealt.random() < 0.2
        text = text_of(dealt, "aa", dealt.randrange(20, 120)).capitalize() + "."
        if bad:
            text = " ".join(word + dealt.choice(["***", "%%%"]) for word in text.split()) if i % 2 else " ".join([word] * 9)  if (word := text.split()[0]) else text
        rows.append((i, text, "en", "s", 1.0))
        if i % 3:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels + [(3000, 1, 0), (None, 1, 0), labels[0]]


def test_quality(spark):
    rows, labels = quality_rows()
    rows += [(2000, None, "en", "s", 0.0), (2001, "", "en", "s", 0.0), (None, "kalo", "en", "s", 0.0), (2002, "milo taka " * 50_000, "en", "s", 0.0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(frame, marks, lambda column: ~held_out(column, 5, 0))
    assert 0.7 < model.prior < 0.9
    scored = quality.score_documents(frame, model)
    found = {row.doc_id: row for row in scored.collect()}
    assert len(found) == len(rows) and all(0 <= row.score <= 1 and row.predicted == (row.score >= 0.3) for row in found.values())
    assert found[2000].score == found[2001].score
    held = {row.doc_id for row in frame.filter(held_out("doc_id", 5, 0)).collect()}
    pairs = [(found[key].predicted, label) for key, label, _ in labels[:-3] if key in held]
    assert len(pairs) > 80 and np.mean([a == b for a, b in pairs]) > 0.95
    kept = quality.keep_good(frame, model)
    assert kept.columns == frame.columns and kept.count() == sum(row.predicted for row in scored.collect())
    assert quality.score_documents(frame.limit(0), model).count() == 0


def test_quality_without_labels(spark):
    frame = spark.createDataFrame([(1, "abc")], "doc_id long, text string")
    model = quality.fit(frame, spark.createDataFrame([], "doc_id long, quality int"), lambda column: F.lit(True))
    assert [row.score for row in quality.score_documents(frame, model).collect()] == [0.5]


def test_prior_of_a_known_mixture():
    random_ = np.random.default_rng(3)
    positive, negative = random_.normal(2, 1, 4000), random_.normal(-3, 1, 1200)
    assert quality.class_prior(positive[:2000], np.concatenate([positive[2000:], negative])) == pytest.approx(2000 / 3200, abs=0.04)


def test_bounded_sample(spark):
    frame = spark.range(3000).withColumn("kind", F.col("id") % 2)
    found = bounded_sample(frame, "kind", 100, ["id"]).groupBy("kind").count().collect()
    assert {row.kind: row["count"] for row in found} == {0: 100, 1: 100}
    assert bounded_sample(frame.limit(0), "kind", 100, ["id"]).count() == 0
