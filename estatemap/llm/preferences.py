"""Preference formatting of chosen and rejected conversations, in DataFrame operations only.

The longest common turn prefix of the two sides is rendered once as the prompt; what follows on each side is its
completion. The result is one row per rendered turn with its place in the prompt or completion and the span that a
trainer learns from: the text and end mark of an assistant turn in a completion. All else is masked.

Turns are compared by count and two 64-bit checksums per (pair, side, turn); places are running sums over
``BUCKET`` turns and over the buckets. So no conversation is gathered in one row or task, however long it is, and
texts are shuffled once.

Defined cases: rows without pair, turn or side belong nowhere and are left out; a null role or text counts as empty;
several rows of one turn stand in the order of role and text, repeated rows repeat; a pair with one side only, or
different from the start, has no prompt; equal sides have no completions; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1000
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>"


def preference_rows(turns: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``pair_id, part, turn, place, role, rendered, start, train_from, train_to``.

    ``turns`` has ``pair_id, side`` (chosen or rejected), ``turn, role, text``. ``part`` is prompt, chosen or rejected;
    ``start``, ``train_from`` and ``train_to`` count characters from the beginning of the part.
    """
    empty = lambda name: F.coalesce(F.col(name), F.lit(""))
    rows = (turns.filter(F.col("pair_id").isNotNull() & F.col("turn").isNotNull() & F.col("side").isin("chosen", "rejected"))
            .select("pair_id", "side", "turn", empty("role").alias("role"), empty("text").alias("text"))
            .withColumn("rendered", F.concat(F.lit(OPEN), "role", F.lit(CLOSE), "text", F.lit(END + "\n"))))
    light = rows.groupBy("pair_id", "side", "turn").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("rendered")).alias("length"),
        F.bit_xor(F.xxhash64("role", "text")).alias("x"), F.sum(F.pmod(F.xxhash64("text", "role", F.lit(1)), F.lit(1 << 31))).alias("s"))
    one = lambda side, name: F.max(F.when(F.col("side") == side, F.col(name)))
    both = light.groupBy("pair_id", "turn").agg(*[one(side, name).alias(f"{side}_{name}") for side in ("chosen", "rejected") for name in "nxs"])
    same = F.lit(True)
    for name in "nxs":
        same = same & F.col(f"chosen_{name}").eqNullSafe(F.col(f"rejected_{name}"))
    apart = both.groupBy("pair_id").agg(F.min(F.when(~same, F.col("turn"))).alias("apart"))
    shared = F.col("apart").isNull() | (F.col("turn") < F.col("apart"))
    parted = (light.join(apart, "pair_id").filter(~shared | (F.col("side") == "chosen"))
              .withColumn("part", F.when(shared, "prompt").otherwise(F.col("side")))
              .withColumn("bucket", F.floor(F.col("turn") / bucket)))
    earlier = Window.unboundedPreceding, -1
    inside = Window.partitionBy("pair_id", "part", "bucket").orderBy("turn").rowsBetween(*earlier)
    over = Window.partitionBy("pair_id", "part").orderBy("bucket").rowsBetween(*earlier)
    buckets = (parted.groupBy("pair_id", "part", "bucket").agg(F.sum("length").alias("length"))
               .select("pair_id", "part", "bucket", F.coalesce(F.sum("length").over(over), F.lit(0)).alias("before")))
    based = (parted.withColumn("base", F.coalesce(F.sum("length").over(inside), F.lit(0))).join(buckets, ["pair_id", "part", "bucket"])
             .select("pair_id", "side", "turn", "part", (F.col("base") + F.col("before")).alias("base")))
    of_turn = Window.partitionBy("pair_id", "side", "turn").orderBy("role", "text")
    ahead = F.coalesce(F.sum(F.length("rendered")).over(of_turn.rowsBetween(*earlier)), F.lit(0))
    placed = (rows.withColumn("ahead", ahead).withColumn("place", F.row_number().over(of_turn) - 1)
              .join(based, ["pair_id", "side", "turn"]).withColumn("start", F.col("base") + F.col("ahead")))
    learned = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    head = F.length("role") + F.lit(len(OPEN) + len(CLOSE))
    return placed.select(
        "pair_id", "part", "turn", "place", "role", "rendered", "start",
        F.when(learned, F.col("start") + head).alias("train_from"),
        F.when(learned, F.col("start") + F.length("rendered") - 1).alias("train_to"))
