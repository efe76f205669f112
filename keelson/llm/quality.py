"""Quality rules: fixed base rules, then a hashed n-gram logistic regression trained on labelled rows.

Features are three groups of hashed n-grams: single words, word pairs, character triples; each group's
counts are divided by their sum, so a text's length doesn't matter. The regression is fitted on a bounded
sample of labelled rows, half of each class, whose features are made on the executors; a fifth of the
sample is held out to calibrate the score (Platt's sigmoid), which is then shifted to the share of good
rows among all labels. Every text is scored whole, in Arrow batches, against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, segment_sum, slices, texts_of
from .ngrams import Words, char_ngrams

BITS = 15  # buckets of a group
GROUPS = 3
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"
SYMBOLS = "#*$%&|<>"  # fixed values of the base rules
_SPACE = " \t\n\v\f\r"


def feature_groups(texts: list[str], words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    return [words.ngrams(1, BITS), words.ngrams(2, BITS), char_ngrams(texts, 3, BITS)]


@dataclass
class QualityModel:
    """weights: a row for each group; slope and shift calibrate. None: no verdict could be learned, all pass."""

    weights: np.ndarray | None
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def probability(self, texts: list[str], words: Words) -> np.ndarray:
        if self.weights is None:
            return np.ones(len(texts))
        margin = np.full(len(texts), self.bias)
        for w, (index, made) in zip(self.weights, feature_groups(texts, words), strict=True):
            margin += segment_sum(w[index], made) / np.maximum(made, 1)
        return _sigmoid(self.slope * margin + self.shift)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def base_counts(texts: list[str], words: Words) -> dict[str, np.ndarray]:
    n = len(texts)
    dup_lines, symbols = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i, text in enumerate(texts):
        lines = [x for x in text.split("\n") if x.strip(_SPACE)]
        dup_lines[i] = len(lines) - len(set(lines))
        symbols[i] = sum(map(text.count, SYMBOLS))
    chars = segment_sum(words.sizes(), words.counts).astype(np.int64)
    return {"n_words": words.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": words.repeated(3)}


def assess(texts: list[str], model: QualityModel) -> dict[str, np.ndarray]:
    words = Words(texts)
    out = base_counts(texts, words)
    failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    p = model.probability(texts, words)
    return out | {"base_failed": failed, "kept": ~failed & (p >= model.threshold), "probability": p}


# ---------------------------------------------------------------- training


def _sample(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Features of at most `rows` labelled texts, half of each class: the least by a hash of doc_id.

    The chosen ids (at most `rows`) are broadcast. Null labels and ids labelled both ways are left out.
    """
    clear = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).dropna().groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other")).where("label = other AND label IN (0, 1)")
    chosen = None
    for label in (0, 1):
        some = clear.where(F.col("label") == label).select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        chosen = some if chosen is None else chosen.unionAll(some)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part.column("text"))
                groups = feature_groups(texts, Words(texts))
                index, value = [[] for _ in texts], [[] for _ in texts]
                for g, (ids, made) in enumerate(groups):
                    for i, own in enumerate(np.split(ids, np.cumsum(made)[:-1])):
                        at, n = np.unique(own, return_counts=True)
                        index[i].append(at.astype(np.int32) + (g << BITS))
                        value[i].append((n / max(1, len(own))).astype(np.float32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("label"), part.column("order"), pa.array([np.concatenate(x) for x in index], pa.list_(pa.int32())), pa.array([np.concatenate(x) for x in value], pa.list_(pa.float32()))], names=["label", "order", "index", "value"]
                )

    hashed = texts.withColumn("order", F.xxhash64("doc_id", "text"))
    return hashed.mapInArrow(run, "label int, order long, index array<int>, value array<float>").orderBy("order").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 3000, steps: int = 150, rate: float = 2.0, decay: float = 1e-5, threshold: float = 0.5) -> QualityModel:
    """rows bounds the labelled sample that the driver gets. Fewer than 20 rows of either class: no model."""
    table = _sample(docs, labels, rows).toArrow()
    y = table["label"].to_numpy().astype(float)
    if min((y == 0).sum(), (y == 1).sum()) < 20:
        return QualityModel(None, threshold=threshold)
    index = table["index"].combine_chunks()
    row = np.repeat(np.arange(len(y)), pc.list_value_length(index).to_numpy(zero_copy_only=False))
    col, val = index.flatten().to_numpy(), table["value"].combine_chunks().flatten().to_numpy().astype(np.float64)
    held = np.arange(len(y)) % 5 == 0  # in order of a hash
    use = ~held[row]
    r, c, v, fit_y, size = row[use], col[use], val[use], y[~held], GROUPS << BITS
    r = (np.cumsum(~held) - 1)[r]
    w, bias, m, s = np.zeros(size), 0.0, np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):  # Adam on the whole sample
        error = (_sigmoid(np.bincount(r, v * w[c], len(fit_y)) + bias) - fit_y) / len(fit_y)
        g = np.bincount(c, v * error[r], size) + decay * w
        bias -= 2 * error.sum()
        m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
        w -= rate * m / (1 - 0.9**t) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
    margin = np.bincount(row, val * w[col], len(y)) + bias
    slope, shift = platt(margin[held], y[held])
    good, bad = (labels.select(F.sum((F.col("quality") == 1).cast("long")), F.sum((F.col("quality") == 0).cast("long"))).first())
    odds = np.log(max(good or 0, 1) / max(bad or 0, 1)) - np.log(y.sum() / (len(y) - y.sum()))
    return QualityModel(w.reshape(GROUPS, -1).astype(np.float32), bias, slope, shift + odds, threshold)


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and shift of the sigmoid that fits y to the margin, by Newton's method, with Platt's smoothed targets."""
    good, bad = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margin, np.ones_like(margin)], 1)
    a = np.array([1.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(x @ a)
        a -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (p - target))
    return (float(a[0]), float(a[1])) if np.isfinite(a).all() and a[0] > 0 else (1.0, 0.0)


# ---------------------------------------------------------------- use


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCHEMA for every row. Null text has no words and fails; null ids stay null; other columns aren't read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                out = assess(texts_of(part.column("text")), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, out.values())], names=["doc_id", *out])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that pass the base rules and the model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                yield part.filter(pa.array(assess(texts_of(part.column(text_col)), shared.value)["kept"]))

    return docs.mapInArrow(run, docs.schema)
