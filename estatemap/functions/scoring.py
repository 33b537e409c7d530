"""Similarity of names and the rules built on it."""

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from estatemap import model

# Thresholds and offsets of the match score.
FUZZY_THRESHOLD = 0.85
APPLICATION_BONUS = 0.05
INTERFACE_PENALTY = 0.05
CONTAINMENT_SCORE = 0.9
CONTAINMENT_TOKENS = 2


def _ratio_udf():
    # Nested, so that executors get the function itself and need not import this package.
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        scores = [0.0] * len(left)
        matcher = SequenceMatcher(None)
        # Pairs are visited by right-hand text because the matcher indexes that side.
        last = None
        for row in sorted(range(len(right)), key=right.tolist().__getitem__):
            if right.iat[row] != last:
                last = right.iat[row]
                matcher.set_seq2(last)
            matcher.set_seq1(left.iat[row])
            scores[row] = matcher.ratio()
        return pd.Series(scores)

    return pandas_udf(ratio, T.DoubleType())


def seq_ratio(left: Column, right: Column) -> Column:
    """difflib ratio of two texts. The ratio depends on argument order, so ``left`` stays first."""
    return _ratio_udf()(F.coalesce(left, F.lit("")), F.coalesce(right, F.lit("")))


def similarity(left: Column, right: Column) -> Column:
    """Ratio of two normalized keys, 0 when one of them is empty."""
    return F.when((left == "") | (right == ""), F.lit(0.0)).otherwise(seq_ratio(left, right))


def tokens(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, " "), lambda token: token != ""))


def containment(left: Column, right: Column) -> Column:
    """0.9 when one token set holds the other and both have at least two tokens, else 0."""
    ours, theirs = tokens(left), tokens(right)
    inside = (F.size(F.array_except(ours, theirs)) == 0) | (F.size(F.array_except(theirs, ours)) == 0)
    enough = (F.size(ours) >= CONTAINMENT_TOKENS) & (F.size(theirs) >= CONTAINMENT_TOKENS)
    return F.when(enough & inside, F.lit(CONTAINMENT_SCORE)).otherwise(F.lit(0.0))


def type_offset(entity_type: Column) -> Column:
    kind = F.lower(F.trim(F.coalesce(entity_type, F.lit(""))))
    return (
        F.when(kind == "application", F.lit(APPLICATION_BONUS))
        .when(kind == "interface", F.lit(-INTERFACE_PENALTY))
        .otherwise(F.lit(0.0))
    )


def match_score(raw: Column, normalized: Column, contained: Column, entity_type: Column) -> Column:
    return F.greatest(raw, normalized, contained) + type_offset(entity_type)


def match_confidence(raw: Column, normalized: Column) -> Column:
    """Containment never makes a match strong."""
    strong = (raw >= 0.95) | ((raw >= 0.85) & (normalized >= 0.95))
    return F.when(strong, F.lit(model.STRONG)).otherwise(F.lit(model.WEAK))


def confirmed_source(source: Column) -> Column:
    return F.when(source == model.SERVES_MANUAL, F.lit(model.KNOWN_MANUAL)).otherwise(F.lit(model.KNOWN))


def serves_source(match_source: Column) -> Column:
    return (
        F.when(match_source == model.KNOWN_MANUAL, F.lit(model.SERVES_MANUAL))
        .when(match_source == model.KNOWN, F.lit(model.SERVES_CONFIRMED))
        .otherwise(F.lit(model.SERVES_STRONG))
    )


def evidence_strength(props: Column) -> Column:
    """3 manual decision, 2 strong match, 1 anything else."""
    return (
        F.when(props["source"].isin(model.SERVES_MANUAL, model.SERVES_CONFIRMED), F.lit(3))
        .when(props["confidence"].isin(model.STRONG, "strong"), F.lit(2))
        .otherwise(F.lit(1))
    )


def merge_props(existing: Column, incoming: Column) -> Column:
    """Existing values win per key, unless the incoming evidence is stronger.

    Identity and provenance keys (``*_id``, ``archimate_*``) of the existing side always stay.
    """
    stronger = evidence_strength(incoming) > evidence_strength(existing)

    def choose(key: Column, ours: Column, theirs: Column) -> Column:
        keeps = key.endswith("_id") | key.startswith("archimate_")
        return F.when(stronger & ~keeps, F.coalesce(theirs, ours)).otherwise(F.coalesce(ours, theirs))

    return F.map_zip_with(existing, incoming, choose)


def bag_overlap(left: Column, right: Column) -> Column:
    """Characters the two texts share, counted with multiplicity; bounds matched text from above."""

    def count(text: Column, char: Column) -> Column:
        return F.char_length(text) - F.char_length(F.replace(text, char, F.lit("")))

    chars = F.array_distinct(F.filter(F.split(left, ""), lambda char: char != ""))
    return F.aggregate(chars, F.lit(0), lambda total, char: total + F.least(count(left, char), count(right, char)))
