"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts are taken over every training text: each task adds up its texts in numpy and gives its non-zero
counts, Spark sums them, and the driver gets one row for each language and bucket, a number that doesn't
grow with the input. The matrix of log probabilities (languages x buckets) is broadcast; batches of texts
are scored as sparse rows: the n-grams' rows of the matrix are gathered and summed for each text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, segment_sum, slices, texts_of
from .ngrams import char_ngrams

UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]  # sorted, so that of equal scores the first wins
    log_prior: np.ndarray
    log_prob: np.ndarray  # buckets x languages
    sizes: tuple[int, ...]
    bits: int

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and posterior probability of each text; `und` and 0 where it has no letter or nothing was learned."""
        some = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if self.languages else []
        out, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if some:
            lower = [texts[i].lower() for i in some]
            total = np.tile(self.log_prior, (len(some), 1))
            for n in self.sizes:
                index, made = char_ngrams(lower, n, self.bits)
                for k in range(len(self.languages)):
                    total[:, k] += segment_sum(self.log_prob[:, k][index], made)
            best = total.argmax(1)
            score[some] = 1 / np.exp(total - total[np.arange(len(some)), best, None]).sum(1)
            for i, k in zip(some, best, strict=True):
                out[i] = self.languages[k]
        return out, score


def fit(docs: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), bits: int = 15, alpha: float = 0.5, most_languages: int = 500) -> LanguageModel:
    """Learns from text and lang of all rows of docs that have both.

    More than most_languages distinct values of lang raise an error, as the matrix, which every worker
    holds, grows with them (500: 64 MB). No labelled row: a model that answers `und`.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                at = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            for part in slices(batch, "text"):
                texts, langs = texts_of(part.column("text")), np.array(part.column("lang").to_pylist(), object)
                for lang in sorted(set(langs)):
                    own = [texts[i].lower() for i in np.flatnonzero(langs == lang)]
                    counts = held.setdefault(lang, np.zeros((1 << bits) + 1, np.int64))
                    counts[-1] += len(own)
                    for n in sizes:
                        counts[:-1] += np.bincount(char_ngrams(own, n, bits)[0], minlength=1 << bits)
                if len(held) > 64:
                    yield from flush()
        yield from flush()

    labelled = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    languages = sorted(r[0] for r in labelled.select("lang").distinct().limit(most_languages + 1).collect())
    if len(languages) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    counts = labelled.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.zeros(((1 << bits) + 1, len(languages)))
    table[counts["bucket"].to_numpy(int), [languages.index(x) for x in counts["lang"]]] = counts["n"].to_numpy(float)
    texts, table = table[-1], table[:-1]
    with np.errstate(divide="ignore"):
        return LanguageModel(languages, np.log(texts / max(texts.sum(), 1)), np.log((table + alpha) / (table.sum(0) + alpha * len(table))).astype(np.float32), sizes, bits)


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row. Null ids stay null; other columns aren't read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, "text", 2 << 20):
                langs, score = shared.value.predict(texts_of(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose text has a predicted language with a score of `least` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for part in slices(batch, text_col, 2 << 20):
                langs, score = shared.value.predict(texts_of(part.column(text_col)))
                yield part.filter(pa.array([x != UNKNOWN and s >= least for x, s in zip(langs, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def remainder(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % n
