"""Lossless candidate pairs for the name similarity join.

The difflib ratio of texts with lengths a and b is 2M/(a+b), where M characters are matched in
order. A ratio of at least t therefore means M >= m = ceil(t(a+b)/2), so that at most a-m and b-m
characters stay unmatched. Both lengths being known, three equi-joins find all such pairs:

* Whole texts: where few characters may stay unmatched, both texts without them are the same.
* Rare q-grams: one unmatched character of a text destroys at most q of its own padded q-grams and q-1 of the
  other text's, so both texts share many. Ordered by rarity, the rarest ``destroyed + 1`` of each text
  must have one in common (prefix filtering). Frequent q-grams are at the end of that order and stay out of
  the join, so a word that is part of a third of all names forms no group.
* Segments: cut into more pieces than half of all characters that may stay unmatched, one piece at least has one
  unmatched character in or between its own, so it is found in the other text but for that character, and about
  where it stood. Letters of a small alphabet have no rare q-grams, but long pieces of them are rare.

The first takes the pairs of lengths it is made for; of the other two each text takes the one that meets fewer.
Rows made from texts are far more than their estimate, hence the hints: they must not be broadcast.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from estatemap.functions.scoring import bag_overlap, tokens
from estatemap.functions.text import bind
from estatemap.session import cut_lineage

# Texts longer than this use 3-grams, which are far more selective there but need t >= 0.8.
LONG_TEXT = 32
_EPS = 1e-9
#: Longest text that is compared whole without one character, and without two.
WHOLE_BUT_ONE, WHOLE_BUT_TWO = 200, 20
#: Parts of texts, two numbers each, that may be broadcast, about 20 MB.
BROADCAST_PARTS = 400_000
#: Meetings of a text by its rare q-grams from which on its segments are tried.
MANY = 100


def _needed(ratio: Column, a: Column, b: Column) -> Column:
    """Fewest matched characters that reach ``ratio``."""
    return F.ceil(ratio * (a + b) / 2 - F.lit(_EPS)).cast("int")


def _grams(text: Column, size: int) -> Column:
    """Padded q-grams, numbered per repetition so that the multiset becomes a set."""
    pad = "\x01" * (size - 1)
    padded = F.concat(F.lit(pad), text, F.lit(pad))
    grams = F.array_sort(F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(padded) - (size - 1), F.lit(1))),
        lambda i: F.substring(padded, i, F.lit(size))))
    return bind(grams, lambda ordered: F.transform(ordered, lambda gram, i: F.concat_ws(
        "\x02", F.lit(str(size)), gram, (i - F.array_position(ordered, gram)).cast("string"))))


def _explode_grams(df: DataFrame, ratio: float) -> DataFrame:
    """Texts with their grams; both sizes around the border, so that every pair shares one size."""
    none = F.array().cast("array<string>")
    short = F.lit(True) if ratio < 0.8 else F.col("len") <= LONG_TEXT * (2 - ratio) / ratio
    long = F.lit(False) if ratio < 0.8 else F.col("len") > LONG_TEXT
    sized = F.concat(_sized(short, 2, none), _sized(long, 3, none))
    return df.select("*", F.explode(sized).alias("g")).select(*df.columns, "g.size", "g.gram")


def _sized(chosen: Column, size: int, none: Column) -> Column:
    grams = F.when(chosen, _grams(F.col("text"), size)).otherwise(none)
    return F.transform(grams, lambda gram: F.struct(F.lit(size).alias("size"), gram.alias("gram")))


def _rare_grams(df: DataFrame, freq: DataFrame, ratio: float) -> DataFrame:
    """The rarest grams of each text that suffice for every partner at ``ratio``."""
    keep = F.floor(F.col("size") * 2 * (1 - ratio) / (2 - ratio) * F.col("len") + F.lit(_EPS)) + 1
    by_rarity = Window.partitionBy("grp", "text", "size").orderBy(F.coalesce("freq", F.lit(0)), "gram")
    return (
        _explode_grams(df, ratio).join(freq.hint("merge"), "gram", "left")
        .withColumn("rank", F.row_number().over(by_rarity)).filter(F.col("rank") <= keep)
    )


def _dealt(df: DataFrame) -> DataFrame:
    """Texts over all cores: few rows, of which each makes hundreds."""
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism, "text")


def _text_id() -> Column:
    """Stands for a text in the joins; texts are joined back by it, so that equal ids only add candidates."""
    return F.xxhash64("text")


def _without(text: Column, length: Column, lost: Column) -> Column:
    """The texts that are left without ``lost`` (0 to 2) characters."""
    def one(rest: Column, first: Column, last: Column) -> Column:
        return F.transform(F.sequence(first, last), lambda i: F.concat(F.substring(rest, F.lit(1), i - 1), F.substring(rest, i + 1, length)))

    # The later character goes first, then one before it.
    both = F.flatten(F.transform(F.sequence(F.lit(2), length), lambda j: one(
        F.concat(F.substring(text, F.lit(1), j - 1), F.substring(text, j + 1, length)), F.lit(1), j - 1)))
    return F.array_distinct(F.when(lost == 0, F.array(text)).when(lost == 1, one(text, F.lit(1), length)).otherwise(both))


def _may_be_whole(length: Column, lost: Column) -> Column:
    return (lost == 0) | ((lost == 1) & (length <= WHOLE_BUT_ONE)) | ((lost == 2) & (length <= WHOLE_BUT_TWO))


def _alike_but_few(left: DataFrame, right: DataFrame, lengths: DataFrame) -> DataFrame:
    """``ida, idb`` of texts that are the same without the characters that may stay unmatched."""
    def side(df: DataFrame, own: str, name: str) -> DataFrame:
        sized = _dealt(df.withColumnRenamed("len", f"l{own}").join(F.broadcast(lengths), f"l{own}"))
        parts = sized.select("grp", "la", "lb", _text_id().alias(name), F.explode(_without(
            F.col("text"), F.col(f"l{own}"), F.col(f"lost_{own}"))).alias("part"))
        return parts.select(F.xxhash64("grp", "la", "lb", "part").alias("key"), name)

    theirs = cut_lineage(side(right, "b", "idb"))
    # A small vocabulary meets the parts of a large one where they are made.
    theirs = F.broadcast(theirs) if theirs.count() <= BROADCAST_PARTS else theirs.hint("merge")
    return side(left, "a", "ida").join(theirs, "key").select("ida", "idb")


def _segments(left: DataFrame, right: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``ida, la, parts, at, key, meets`` of left-hand texts, ``idb, lb, at, key`` of right-hand ones), to be joined by key.

    A pair of lengths needs ``parts`` pieces of ``width`` characters; of more, the rarest are taken. ``meets``: rows a key meets.
    """
    width, text = F.col("width"), F.col("text")
    cut = _dealt(left.withColumnRenamed("len", "la").join(F.broadcast(lengths.select("la", "parts", "width").distinct()), "la"))
    cut = cut.select("grp", _text_id().alias("ida"), "la", "parts", "width", "text", F.explode(F.sequence(
        F.lit(0), F.floor(F.col("la") / width).cast("int") - 1)).alias("i"))
    at = (F.col("i") * width).cast("int")
    piece = F.substring(text, at + 1, width)
    less_one = F.transform(F.sequence(F.lit(1), width), lambda k: F.concat(
        F.substring(text, at + 1, k - 1), F.substring(text, at + 1 + k, width - k)))
    ours = cut.select("grp", "ida", "la", "parts", "width", at.alias("at"), F.explode(F.array_distinct(F.concat(F.array(piece), less_one))).alias("part")).select(
        "ida", "la", "parts", "width", "at", F.xxhash64("grp", "width", "part").alias("key"))

    own = _dealt(right.withColumnRenamed("len", "lb").join(F.broadcast(lengths.select("lb", "width").distinct()), "lb").filter(F.col("lb") >= width - 1))
    own = own.select("grp", _text_id().alias("idb"), "lb", "width", "text", F.explode(F.sequence(F.lit(0), F.col("lb") - width + 1)).alias("at"))
    # From each place: one character less than a piece, as many, and one more without one of those between its ends.
    none = F.array().cast("array<string>")
    found = F.concat(
        F.array(F.substring(text, F.col("at") + 1, width - 1)),
        F.when(F.col("at") + width <= F.col("lb"), F.array(F.substring(text, F.col("at") + 1, width))).otherwise(none),
        F.when(F.col("at") + width < F.col("lb"), F.transform(F.sequence(F.lit(1), width - 1), lambda k: F.concat(
            F.substring(text, F.col("at") + 1, k), F.substring(text, F.col("at") + k + 2, width - k)))).otherwise(none))
    theirs = own.select("grp", "idb", "lb", "width", "at", F.explode(F.array_distinct(found)).alias("part")).select(
        "idb", "lb", "at", F.xxhash64("grp", "width", "part").alias("key"))

    # Of the places only those that a piece meets are kept: they are made once, counted here and joined by the caller.
    theirs = cut_lineage(theirs.join(ours.select("key").distinct().hint("merge"), "key", "left_semi"))
    meets = theirs.groupBy("key").agg(F.count(F.lit(1)).alias("meets"))
    met = ours.join(meets.hint("merge"), "key")
    places = met.groupBy("ida", "la", "parts", "width", "at").agg(F.sum("meets").alias("n"))
    rarest = Window.partitionBy("ida", "la", "parts", "width").orderBy("n", "at")
    # Pieces that meet nothing are the rarest of all and are not among these rows.
    unmet = F.floor(F.col("la") / width) - F.count(F.lit(1)).over(Window.partitionBy("ida", "la", "parts", "width"))
    taken = places.withColumn("rank", F.row_number().over(rarest) + unmet).filter(F.col("rank") <= F.col("parts"))
    return met.join(taken.select("ida", "la", "parts", "at"), ["ida", "la", "parts", "at"]), theirs


def _sharing_segments(ours: DataFrame, theirs: DataFrame, lengths: DataFrame) -> DataFrame:
    """``ida, idb`` that share a segment but for one character, about where it stood."""
    pairs = ours.withColumnRenamed("at", "at_a").join(theirs.withColumnRenamed("at", "at_b").hint("merge"), "key")
    shift = F.col("at_b") - F.col("at_a")
    return pairs.join(F.broadcast(lengths.select("la", "lb", "parts", "lost_a", "lost_b")), ["la", "lb", "parts"]).filter(
        (shift >= -F.col("lost_a")) & (shift <= F.col("lost_b"))).select("ida", "idb")


def _sharing(left: DataFrame, right: DataFrame, lengths: DataFrame, ratio: float) -> DataFrame:
    """``ida, idb`` that share rare grams or segments; each left-hand text takes what meets fewer rows."""
    freq = _explode_grams(right, ratio).groupBy("gram").agg(F.count(F.lit(1)).alias("freq"))
    ours = _rare_grams(left, freq, ratio).select(
        "grp", "gram", "size", _text_id().alias("ida"), F.col("len").alias("la"), F.col("rank").alias("ra"), F.coalesce("freq", F.lit(0)).alias("freq"))
    theirs = _rare_grams(right, freq, ratio).select(
        "grp", "gram", _text_id().alias("idb"), F.col("len").alias("lb"), F.col("rank").alias("rb"), "need")

    def by_grams(ours: DataFrame) -> DataFrame:
        m = _needed(F.col("need"), F.col("la"), F.col("lb"))
        lost_a, lost_b, size = F.col("la") - m, F.col("lb") - m, F.col("size")
        return (
            ours.join(lengths.select("la", "lb"), "la")
            .join(theirs.hint("merge"), ["grp", "gram", "lb"])
            .filter((lost_a >= 0) & (lost_b >= 0)
                    & (F.col("ra") <= size * lost_a + (size - 1) * lost_b + 1)
                    & (F.col("rb") <= size * lost_b + (size - 1) * lost_a + 1))
            .select("ida", "idb")
        )

    if ratio < 0.8:  # the pieces would be short
        return by_grams(ours)
    ours = cut_lineage(ours)
    crowded = cut_lineage(ours.groupBy("ida", "la").agg(F.sum("freq").alias("n")).filter(F.col("n") > MANY))
    if crowded.isEmpty():
        return by_grams(ours)
    reached = lengths.join(crowded.select("la").distinct(), "la", "left_semi")
    heavy = left.join(crowded.select(F.col("ida").alias("_id")), _text_id() == F.col("_id"), "left_semi")
    pieces, found = _segments(heavy, right, reached)
    pieces = cut_lineage(pieces)
    # A text none of whose pieces meets anything has no partner.
    costs = crowded.join(pieces.groupBy("ida").agg(F.sum("meets").alias("meets")), "ida", "left").select(
        "ida", (F.coalesce("meets", F.lit(0)) < F.col("n")).alias("cut"))
    cut = cut_lineage(costs.filter("cut").select("ida"))
    segments = _sharing_segments(pieces.join(cut, "ida", "left_semi"), found, reached)
    return by_grams(ours.join(cut, "ida", "left_anti")).unionByName(segments)


def _few_grams_lost(a: Column, b: Column, shared: Column) -> Column:
    """Whether ``b`` holds the 3-grams of ``a`` but those that unmatched characters destroy."""
    # Nested, so that executors get the function itself and need not import this package.
    def held(left: pd.Series, right: pd.Series, fewest: pd.Series) -> pd.Series:
        known = {}

        def grams(text):
            if text not in known:
                if len(known) > 10_000:
                    known.clear()
                known[text] = {text[i:i + 3] for i in range(len(text) - 2)}
            return known[text]

        return pd.Series([
            len(grams(x) & grams(y)) >= len(grams(x)) - 3 * (len(x) - n) - 2 * (len(y) - n)
            for x, y, n in zip(left, right, fewest)], dtype=bool)

    return pandas_udf(held, T.BooleanType())(a, b, shared)


def ratio_candidates(left: DataFrame, right: DataFrame, ratio: float) -> DataFrame:
    """Distinct (grp, a, b) that hold every pair whose ratio reaches the need of its right-hand text.

    At two thirds and below q-grams promise nothing: only the lengths are joined, and the pairs grow with the product
    of the texts of fitting length. Such ratios are for small vocabularies.
    ``left`` has grp and text, ``right`` has grp, text and need (never below ``ratio``); both are distinct.
    """
    left = left.withColumn("len", F.char_length("text"))
    right = right.withColumn("len", F.char_length("text"))
    reach = F.sequence(
        F.ceil(F.col("la") * (ratio / (2 - ratio)) - F.lit(_EPS)).cast("int"),
        F.floor(F.col("la") * ((2 - ratio) / ratio) + F.lit(_EPS)).cast("int"))
    lengths = (
        left.select(F.col("len").alias("la")).distinct()
        .select("la", F.explode(reach).alias("lb"))
        .join(right.select(F.col("len").alias("lb")).distinct(), "lb")
        .select("la", "lb")
    )
    if ratio <= 2 / 3:
        # Texts without any partner of fitting length never reach the join.
        left = left.join(lengths.select(F.col("la").alias("len")).distinct(), "len", "left_semi")
        right = right.join(lengths.select(F.col("lb").alias("len")).distinct(), "len", "left_semi")
        a = left.select("grp", F.col("text").alias("a"), F.col("len").alias("la")).join(lengths, "la")
        pairs = a.join(right.select("grp", F.col("text").alias("b"), F.col("len").alias("lb"), "need"), ["grp", "lb"])
        pairs = pairs.select("grp", "a", "b", "need")
    else:
        m = _needed(F.lit(ratio), F.col("la"), F.col("lb"))
        lost = lengths.withColumns({"lost_a": F.col("la") - m, "lost_b": F.col("lb") - m}).filter("lost_a >= 0 AND lost_b >= 0")
        # Two unmatched characters spoil a piece, one does not.
        parts = (F.floor((F.col("lost_a") + F.col("lost_b")) / 2) + 1).cast("int")
        sized = lost.withColumn("parts", parts).withColumn("width", F.floor(F.col("la") / F.col("parts")).cast("int"))
        whole = _may_be_whole(F.col("la"), F.col("lost_a")) & _may_be_whole(F.col("lb"), F.col("lost_b"))
        sized = cut_lineage(sized.withColumn("whole", whole))

        def fitting(df: DataFrame, name: str, pairs: DataFrame) -> DataFrame:
            return df.join(pairs.select(F.col(name).alias("len")).distinct(), "len", "left_semi")

        others = sized.filter("not whole")
        met = _alike_but_few(left, right, sized.filter("whole"))
        if not others.isEmpty():
            met = met.unionByName(_sharing(fitting(left, "la", others), fitting(right, "lb", others), others, ratio))
        texts = left.select("grp", _text_id().alias("ida"), F.col("text").alias("a"))
        pairs = met.distinct().join(texts, "ida").join(
            right.select("grp", _text_id().alias("idb"), F.col("text").alias("b"), "need"), ["grp", "idb"]).select("grp", "a", "b", "need")
    shared = _needed(F.col("need"), F.char_length("a"), F.char_length("b"))
    if ratio > 2 / 3:
        pairs = pairs.filter(_few_grams_lost(F.col("a"), F.col("b"), shared))
    return (
        pairs.groupBy("grp", "a", "b").agg(F.min("need").alias("need"))
        .filter(bag_overlap(F.col("a"), F.col("b")) >= _needed(F.col("need"), F.char_length("a"), F.char_length("b")))
        .select("grp", "a", "b")
    )


def _by_rarest_tokens(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) key pairs where the outer key holds the two rarest tokens of the inner one.

    Both sides have two tokens at least. Joined on one token, names of a small vocabulary would meet in large groups.
    """
    freq = outer.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))
    ranked = (
        inner.select(F.col("key").alias("inner"), F.explode("tokens").alias("token")).join(freq, "token", "left")
        .withColumn("rank", F.row_number().over(Window.partitionBy("inner").orderBy(F.coalesce("freq", F.lit(0)), "token")))
        .filter("rank <= 2"))
    rarest = ranked.groupBy("inner").agg(F.min("token").alias("low"), F.max("token").alias("high"))
    each = outer.select(F.col("key").alias("outer"), F.array_sort("tokens").alias("sorted"))
    firsts = each.select("outer", "sorted", F.posexplode("sorted").alias("at", "low"))
    pairs = firsts.select("outer", "low", F.explode(F.expr("slice(sorted, at + 2, size(sorted))")).alias("high"))
    return rarest.join(pairs, ["low", "high"]).select("inner", "outer")


def containment_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct (a, b) of keys where one token set holds the other; both sides have a ``key`` column."""
    ours, theirs = [
        side.select("key", tokens(F.col("key")).alias("tokens")).filter(F.size("tokens") >= 2).distinct()
        for side in (left, right)
    ]
    inside = _by_rarest_tokens(ours, theirs).select(F.col("inner").alias("a"), F.col("outer").alias("b"))
    around = _by_rarest_tokens(theirs, ours).select(F.col("outer").alias("a"), F.col("inner").alias("b"))
    a, b = tokens(F.col("a")), tokens(F.col("b"))
    subset = (F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0)
    return inside.unionByName(around).filter(subset).distinct()
