"""Quality by compression: zstandard dictionaries built from good and from bad labelled texts.

A text is compressed with either dictionary; the difference of the two sizes over their sum says which class it
resembles. A logistic calibration, fitted on labelled texts that built no dictionary, turns that difference and how
far the text compresses at all (which exposes repetition) into a probability of label 1. Inputs are the text alone.

At most MAX_TRAINING labelled documents that are not held out are fitted on; every text is scored in its whole
length. Null texts count as empty and get the score of an empty text. A document with several labels counts by
their mean. With labels of one class only, or none, every score is the share of label 1 (1/2 without labels).
Of several texts with one id the one with the smallest hash is learned from. An empty table gives no rows; very long texts
are compressed whole, one at a time; equal texts have equal scores. Repeated rows give repeated results; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import batches, bounded_sample, held_out, one_each, table, texts

MAX_TRAINING = 2400
DICTIONARY = 16384  # bytes
LEVEL = 3
THRESHOLD = 0.3


class Classifier:
    """Two dictionaries and the calibration; dictionaries are bytes, so the object travels."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray, constant: float | None = None):
        self.good, self.bad, self.weights, self.constant = good, bad, weights, constant

    def _compressors(self):
        if not hasattr(self, "_pair"):
            self._pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (self.good, self.bad)]
        return self._pair

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair"}

    def features(self, docs: list[str]) -> np.ndarray:
        """Columns: 1, normalised difference, compression rate, their products, and the weight of short texts."""
        good, bad = self._compressors()
        raw = [t.encode("utf-8", "replace") for t in docs]
        x = np.array([len(good.compress(b)) for b in raw], dtype=float)
        y = np.array([len(bad.compress(b)) for b in raw], dtype=float)
        n = np.array([len(b) for b in raw], dtype=float)
        d = 10 * (y - x) / (x + y)
        rate = np.log((x + y + 8) / (2 * n + 8))
        short = 1 / np.sqrt(1 + n / 20)
        return np.stack([np.ones(len(d)), d, rate, d * rate, rate**2, d * np.abs(d), short, short * rate], axis=1)

    def score(self, docs: list[str]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(docs), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.features(docs) @ self.weights, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.01) -> np.ndarray:
    """Newton's method with a small ridge."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - ridge * w)
    return w


def _dictionary(samples: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples, k=64, d=8, f=18, accel=4, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples for its statistics: their bytes themselves are the dictionary
        return b"".join(samples)[-DICTIONARY:]


def fit(rows: list[tuple[str, int]]) -> Classifier:
    """Dictionaries from one half of the rows of a class, the calibration from the other; then the roles change, and the calibrations are averaged."""
    ones = sum(y for _, y in rows)
    if ones in (0, len(rows)):
        return Classifier(b"", b"", np.zeros(8), ones / len(rows) if rows else 0.5)
    half = [[[t.encode() for t, y in rows[k::2] if y == c] for c in (1, 0)] for k in (0, 1)]
    weights = []
    for k in (0, 1):
        if all(half[k]):
            part = Classifier(_dictionary(half[k][0]), _dictionary(half[k][1]), np.zeros(8))
            other = rows[1 - k :: 2]
            weights.append(logistic(part.features([t for t, _ in other]), np.array([y for _, y in other], dtype=float)))
    good, bad = ([t.encode() for t, y in rows if y == c] for c in (1, 0))
    return Classifier(_dictionary(good), _dictionary(bad), np.mean(weights, axis=0) if weights else np.array([2.0, 1, 0, 0, 0, 0, 0, 0]))


def learn(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> Classifier:
    """A classifier from at most `most` labelled documents that are not held out."""
    known = labels.where(F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.avg("quality").alias("y"))
    ids = bounded_sample(known, most, seed=2)
    if not ids:
        return fit([])
    own = known.where(F.col("doc_id").isin(ids))
    rows = docs.where(F.col("doc_id").isin(ids) & F.col("text").isNotNull()).select("doc_id", "text")
    rows = one_each(rows, "doc_id", "text").join(own, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    return fit([(r.text, int(r.y >= 0.5)) for r in rows])


def score(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(classifier)  # two dictionaries of a fixed size

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sent.value.score(texts(batch)))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
