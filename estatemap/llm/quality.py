"""Quality classifier by positive-unlabelled learning.

Trusted positives (rows labelled 1) and unlabelled web text are all that the classifier learns from; labels 0 are
not used. An additive logistic model over surface features, each cut into bins at quantiles of the unlabelled rows,
minimises the non-negative risk estimate

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

with the sigmoid loss by gradient steps in numpy: where the second part falls below zero, the step raises it.
The class prior is estimated from the same two samples: the least ratio of the share of unlabelled to the share of
positive rows above a threshold of a first classifier that tells the two apart, over thresholds that keep 40 % of them.

The samples are bounded (``POSITIVES``, ``UNLABELLED`` rows, chosen by a hash); tasks send features, never texts.

Defined cases: null counts as empty; an empty text has all features 0 and is scored like any other; without positive
or unlabelled rows every score is the prior 0.5; texts are read whole; a label counts once per id, the largest one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from estatemap.llm.common import bounded_sample

POSITIVES = 5000
UNLABELLED = 10000
THRESHOLD = 0.3
#: Quantiles of the unlabelled rows at which a feature is cut.
CUTS = (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995)
_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[97:123] = 2
_CLASS[48:58] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[128:] = 5
_CLASS[[33, 63]] = 6
_CLASS[[44, 46, 59, 58, 39, 45, 34, 40, 41]] = 7
_CLASS[124] = 8
FEATURES = 22


def features(text: str | None) -> np.ndarray:
    """Numbers between 0 and about 1 that describe the surface of the whole text."""
    out = np.zeros(FEATURES, np.float32)
    text = text or ""
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    kinds = _CLASS[raw]
    share = np.bincount(kinds, minlength=9) / len(raw)
    words, lines = text.split(), text.split("\n")
    many = max(len(words), 1)
    upper = sum(map(str.isupper, words)) / many
    alphabetic = sum(map(str.isalpha, words)) / many
    out[:9] = share
    out[9] = upper
    out[10] = alphabetic
    out[11] = len(set(words)) / many
    out[12] = sum(map(eq, words, words[1:])) / many
    out[13] = min(len(raw) / many, 40) / 20
    out[14] = np.log1p(many) / 10
    out[15] = np.log1p(len(lines)) / 8
    out[16] = len(set(lines)) / len(lines)
    out[17] = min(many / len(lines), 200) / 200
    out[18] = sum(map(str.istitle, words)) / many
    out[19] = float(len(words) < 20)
    out[20] = sum(not word[-1].isalnum() for word in words) / many
    out[21] = min(many, 50) / 50
    return out


def _binned(rows: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """One column for each bin of each feature, 1 where the row's value lies in it."""
    out = np.zeros((len(rows), sum(len(cut) + 1 for cut in cuts)), np.float32)
    base, each = 0, np.arange(len(rows))
    for column, cut in enumerate(cuts):
        out[each, base + np.searchsorted(cut, rows[:, column], side="right")] = 1
        base += len(cut) + 1
    return out


class Model:
    def __init__(self, cuts: list[np.ndarray], weights: np.ndarray, bias: float, prior: float):
        self.cuts, self.weights, self.bias, self.prior = cuts, weights, bias, prior

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return _sigmoid(_binned(rows, self.cuts) @ self.weights + self.bias)


def _sigmoid(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _descend(gradient, wide: int, steps: int, rate: float, decay: float) -> np.ndarray:
    """Adam steps from zero; the last of the ``wide`` numbers is the bias and does not decay."""
    theta, first, second = np.zeros(wide), np.zeros(wide), np.zeros(wide)
    for step in range(1, steps + 1):
        now = gradient(theta)
        now[:-1] += decay * theta[:-1]
        first, second = 0.9 * first + 0.1 * now, 0.999 * second + 0.001 * now ** 2
        theta = theta - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
    return theta


def _tell_apart(positive: np.ndarray, unlabelled: np.ndarray):
    """Gradient of the logistic loss of positive against unlabelled rows."""
    def gradient(theta: np.ndarray) -> np.ndarray:
        above, below = _sigmoid(positive @ theta) - 1, _sigmoid(unlabelled @ theta)
        return positive.T @ above / len(positive) + unlabelled.T @ below / len(unlabelled)
    return gradient


def _risk(positive: np.ndarray, unlabelled: np.ndarray, prior: float):
    """Gradient of the non-negative risk with the sigmoid loss."""
    def gradient(theta: np.ndarray) -> np.ndarray:
        p, u = _sigmoid(positive @ theta), _sigmoid(unlabelled @ theta)
        by_p, by_u = positive.T @ (p * (1 - p)) / len(positive), unlabelled.T @ (u * (1 - u)) / len(unlabelled)
        rest = u.mean() - prior * p.mean()  # risk on negatives, without the positive part of the unlabelled rows
        return by_u - 2 * prior * by_p if rest >= 0 else prior * by_p - by_u
    return gradient


def class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of both: the ratio of the shares above a threshold,
    taken where it is least (its lowest tenth, against noise)."""
    ratios = [(unlabelled >= threshold).mean() / (positive >= threshold).mean()
              for threshold in np.quantile(positive, np.linspace(0, 0.6, 61))]
    return float(np.clip(np.quantile(ratios, 0.1), 0.02, 0.98))


def train(positive: np.ndarray, unlabelled: np.ndarray, steps: int = 200, rate: float = 0.05, decay: float = 1e-3) -> Model:
    """A first classifier tells positives from unlabelled rows and gives the prior; the second minimises the risk with it."""
    if len(positive) < 2 or len(unlabelled) < 2:
        return Model([np.zeros(0)] * FEATURES, np.zeros(FEATURES), 0.0, 0.5)
    cuts = [np.unique(np.quantile(unlabelled[:, column], CUTS)) for column in range(FEATURES)]
    p, u = (np.hstack([_binned(rows, cuts), np.ones((len(rows), 1), np.float32)]) for rows in (positive, unlabelled))
    first = _descend(_tell_apart(p[::2], u[::2]), p.shape[1], steps, rate, decay)
    prior = class_prior(p[1::2] @ first, u[1::2] @ first)
    theta = _descend(_risk(p, u, prior), p.shape[1], steps, rate, decay)
    return Model(cuts, theta[:-1], float(theta[-1]), prior)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(text.as_py()).tobytes() for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["kind", "numbers"])


def fit(docs: DataFrame, labels: DataFrame, allowed: Callable[[str], Column], id_column: str = "doc_id", text_column: str = "text",
        label_column: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Train on positives among the rows whose id is ``allowed``, and on a sample of all those rows without their labels."""
    rows = docs.filter(allowed(id_column)).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    good = (labels.groupBy(F.col(id_column).alias("id")).agg(F.max(label_column).alias("label"))
            .filter("label = 1").filter(allowed("id")).select("id", F.lit(1).alias("kind")))
    wanted = bounded_sample(good, "kind", positives, ["id"])
    trusted = rows.join(F.broadcast(wanted), "id").select("kind", "text")  # ``positives`` ids at most
    web = bounded_sample(rows.withColumn("kind", F.lit(0)), "kind", unlabelled, ["id", "text"]).select("kind", "text")
    measured = trusted.unionByName(web).mapInArrow(_measured, "kind int, numbers binary").collect()
    ordered = sorted((row.kind, bytes(row.numbers)) for row in measured)
    sides = [np.array([np.frombuffer(numbers, np.float32) for kind, numbers in ordered if kind == side]).reshape(-1, FEATURES)
             for side in (1, 0)]
    turn = [np.random.default_rng(5).permutation(len(side)) for side in sides]
    return train(sides[0][turn[0]], sides[1][turn[1]])


def scorer(spark: SparkSession, model: Model):
    """A column function: the score of a whole text, 0 to 1, higher where label 1 is likelier."""
    sent = spark.sparkContext.broadcast(model)  # a few hundred numbers

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            found = np.array([features(text) for text in batch]).reshape(-1, FEATURES)
            yield pd.Series(sent.value.scores(found))
    return score


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """``id_column, score, predicted`` of every row of ``docs``."""
    scored = docs.select(F.col(id_column), scorer(docs.sparkSession, model)(F.col(text_column)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_column: str = "text") -> DataFrame:
    """``docs`` whose score reaches the threshold, all columns as they were."""
    return docs.filter(scorer(docs.sparkSession, model)(F.col(text_column)) >= threshold)
