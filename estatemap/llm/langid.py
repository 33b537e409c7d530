"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the 1- to 4-byte sequences of the lower-cased UTF-8 text in which every run of bytes that are neither
ASCII letters nor part of a longer character counts as one blank. Each is hashed to one of ``BUCKETS`` embeddings of
``WIDTH`` numbers; a text is the mean of its embeddings, and a linear softmax maps the mean to languages. Both are
trained by stochastic gradient descent in numpy on ``PER_LANGUAGE`` labelled rows of each language at most; the tasks
send bucket counts, never texts. A fifth of the sample is kept apart: it sets the temperature of the softmax and the
score from which a prediction is accepted, the least one whose accepted predictions are right in ``PRECISION``.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any labelled row everything
is ``und``; every text is read whole, in pieces of bounded size; equal rows get equal results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from estatemap.llm.common import bounded_sample

BUCKETS = 1 << 15
WIDTH = 16
PER_LANGUAGE = 1500
EPOCHS = 6
PRECISION = 0.99
#: Bytes of one text that are hashed at once.
PIECE = 1 << 20
LETTER = regex.compile(r"\p{L}")
_FACTORS = (1, 0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35)

_kept = np.full(256, 32, np.uint8)
_kept[97:123] = np.arange(97, 123)
_kept[128:] = np.arange(128, 256)


def _clean(text: str) -> np.ndarray:
    """Bytes of the text between blanks, each run of other bytes as one blank."""
    raw = _kept[np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)]
    blank = raw == 32
    return np.concatenate([[32], raw[~(blank & np.concatenate([[True], blank[:-1]]))], [32]]).astype(np.uint32)


def subwords(text: str) -> Iterator[np.ndarray]:
    """Bucket numbers of all subwords of the text, piece by piece."""
    data = _clean(text)
    for start in range(0, len(data), PIECE):
        part = data[start:start + PIECE + 3]
        mixed = np.zeros(len(part), np.uint32)
        for length, factor in enumerate(_FACTORS, 1):
            many = len(part) - length + 1
            if many <= 0:
                break
            mixed = (mixed[:many] * np.uint32(31) + part[length - 1:] * np.uint32(factor)) ^ np.uint32(length)
            hashed = mixed * np.uint32(0x27D4EB2F)
            yield (hashed[:PIECE] >> np.uint32(17)).astype(np.int32)


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the text and how often each occurs."""
    total = np.zeros(BUCKETS, np.int64)
    for part in subwords(text):
        total += np.bincount(part, minlength=BUCKETS)
    used = np.flatnonzero(total)
    return used, total[used]


class Model:
    """Embeddings and softmax after training, folded into one table of logits per subword."""

    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, temperature: float, accept: float):
        self.languages, self.table, self.bias = languages, table, bias
        self.temperature, self.accept = temperature, accept

    def logits(self, text: str) -> np.ndarray:
        total, many = np.zeros(self.table.shape[1]), 0
        for part in subwords(text):
            total += self.table.take(part, axis=0).sum(axis=0, dtype=np.float64)
            many += len(part)
        return total / max(many, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages or not LETTER.search(text):
            return "und", 0.0
        odds = _softmax(self.logits(text) / self.temperature)
        best = int(odds.argmax())
        return self.languages[best], float(odds[best])


def _softmax(values: np.ndarray) -> np.ndarray:
    shifted = np.exp(values - values.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], width: int = WIDTH, epochs: int = EPOCHS, rate: float = 0.5,
          precision: float = PRECISION, seed: int = 7) -> Model:
    """Fit to rows of (language, buckets, counts); every fifth row of a language is kept for calibration."""
    languages = sorted({row[0] for row in rows})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 1.0)
    random = np.random.default_rng(seed)
    number = {language: i for i, language in enumerate(languages)}
    seen = dict.fromkeys(languages, 0)
    fit, held = [], []
    for language, used, many in rows:
        if not len(used):
            continue
        entry = (number[language], used, (many / many.sum()).astype(np.float32))
        (held if seen[language] % 5 == 4 else fit).append(entry)
        seen[language] += 1
    embeddings = random.normal(0, 1, (BUCKETS, width)).astype(np.float32) / np.float32(np.sqrt(width))
    softmax, bias = np.zeros((width, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for at in random.permutation(len(fit)):
            language, used, share = fit[at]
            now = np.float32(rate * (1 - done / steps))
            mean = share @ embeddings[used]
            error = _softmax(mean @ softmax + bias)
            error[language] -= 1
            back = softmax @ error
            softmax -= now * np.outer(mean, error)
            bias -= now * error
            # A subword has a small share of its text's mean, so its steps are scaled up.
            embeddings[used] -= now * 20 * share[:, None] * back[None, :]
            done += 1
    table = embeddings @ softmax
    held = held or fit
    logits = np.array([share @ table[used] + bias for _, used, share in held])
    truth = np.array([language for language, _, _ in held])
    temperature = min((float(t) for t in np.geomspace(0.05, 4, 60)),
                      key=lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())
    odds = _softmax(logits / temperature)
    score, right = odds.max(axis=1), odds.argmax(axis=1) == truth
    order = np.argsort(-score)
    share = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(share >= precision)
    accept = float(score[order][good[-1]]) if len(good) else 1.0
    return Model(languages, table, bias.astype(np.float64), temperature, accept)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counts(text.as_py()) for text in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([used.astype(np.int32).tobytes() for used, _ in found], pa.binary()),
             pa.array([many.astype(np.int32).tobytes() for _, many in found], pa.binary())], names=["lang", "used", "many"])


def training_rows(docs: DataFrame, allowed: Column, per_language: int = PER_LANGUAGE, id_column: str = "doc_id",
                  text_column: str = "text", lang_column: str = "lang") -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Bucket counts of at most ``per_language`` rows of each language for which ``allowed`` holds, chosen by a hash."""
    rows = docs.filter(allowed & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(
        F.col(lang_column).alias("lang"), F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    chosen = bounded_sample(rows, "lang", per_language, ["id", "text"]).filter(F.col("text").rlike(r"\p{L}"))
    # At most per_language x languages rows of at most BUCKETS pairs of small numbers.
    found = chosen.select("lang", "text").mapInArrow(_counted, "lang string, used binary, many binary").collect()
    ordered = sorted(found, key=lambda row: (row.lang, row.used, row.many))
    rows = [(row.lang, np.frombuffer(row.used, np.int32), np.frombuffer(row.many, np.int32)) for row in ordered]
    return [rows[at] for at in np.random.default_rng(1).permutation(len(rows))]


def identify(docs: DataFrame, model: Model, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column, lang_pred, score, accepted`` of every row of ``docs``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            found = [own.predict(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([lang for lang, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64()),
                 pa.array([lang != "und" and score >= own.accept for lang, score in found], pa.bool_())],
                names=["id", "lang_pred", "score", "accepted"])

    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    out = rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, lang_pred string, score double, accepted boolean")
    return out.withColumnRenamed("id", id_column)
