"""Quality scores: hashed word n-grams, logistic regression fitted by FTRL-proximal updates.

Features of a text are its words, its word pairs and the pairs of its words' shapes (runs of
letters of one case, digits and signs become one mark each; a word that repeats the one before it
has a mark of its own), hashed to ``DIM`` places.  Each counts in proportion to the
text's length, so a score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import U64, hash_words, mix, steps, utf8, words

BITS = 18
DIM = 1 << BITS
#: Kinds of bytes: other signs keep their own code.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = 1
SHAPE[128:] = 1
SHAPE[65:91] = 2
SHAPE[48:58] = 3


def fold(doc_id: Column) -> Column:
    """0, 1 or 2; 1 is held out of training.  A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words x 3) hashed features, words before each document, words of each document."""
    starts, ends, before = words(data, offsets)
    if not len(starts):
        return np.zeros((0, 3), np.int64), before, np.diff(before)
    h = hash_words(data, starts, ends)
    kind = SHAPE[data]
    kept = np.ones(len(kind), bool)  # the first of each run of equal kinds
    kept[1:] = kind[1:] != kind[:-1]
    kept[starts] = True
    upto = np.r_[0, np.cumsum(kept)]
    shape = hash_words(kind[kept], upto[starts], upto[ends], seed=2)
    head = np.zeros(len(h), bool)
    head[before[:-1][np.diff(before) > 0]] = True
    with np.errstate(over="ignore"):
        last, last_shape = np.r_[U64(0), h[:-1]], np.r_[U64(0), shape[:-1]]
        last[head], last_shape[head] = U64(7), U64(7)
        pair = mix(h + last * U64(0x9E3779B97F4A7C15))
        shapes = mix(shape + last_shape * U64(0x9E3779B97F4A7C15) + (h == last).astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    return np.stack([x >> U64(64 - BITS) for x in (h, pair, shapes)], axis=1).astype(np.int64), before, np.diff(before)


def dot_products(weights: np.ndarray, bias: float, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The score of each text before the logistic function; each text is summed by itself, so equal texts get equal bits."""
    f, before, n = features(data, offsets)
    out, some = np.full(len(n), float(bias)), np.flatnonzero(n)
    if len(some):
        out[some] += np.add.reduceat(weights[f].sum(axis=1), before[some]) / n[some]
    return out


class Ftrl:
    """FTRL-proximal for the logistic loss; the last place is the bias."""

    def __init__(self, dim: int = DIM, alpha: float = 2.0, beta: float = 0.1, l1: float = 0.002, l2: float = 0.01):
        self.z, self.n = np.zeros(dim + 1), np.zeros(dim + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _train(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[np.ndarray, np.ndarray, float]] = []
        for whole in batches:
            for batch in steps(whole, "text"):
                f, before, n = features(*utf8(batch.column("text")))
                for i, y in enumerate(batch.column("label").to_pylist()):
                    at, count = np.unique(f[before[i] : before[i + 1]], return_counts=True)
                    rows.append((np.r_[at, DIM].astype(np.int32), np.r_[count / max(n[i], 1), 1.0].astype(np.float32), float(y)))
        model = Ftrl()
        for _ in range(epochs):
            for at, x, y in rows:
                model.update(at, x.astype(float), y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], names=["w"])

    return run


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 10_000, epochs: int = 3) -> np.ndarray:
    """Weights (the last is the bias) from about ``most`` labelled documents outside fold 1.

    ``labels`` has doc_id and label (0 or 1; other rows and null ids are passed over).  The documents
    whose id has a hash that is low enough are taken, whole; where ids repeat, twice ``most``
    rows in the order of the hash at the most.  No labels: all weights are zero, so every score is 0.5.
    """
    chosen = labels.where("label in (0, 1) and doc_id is not null").where(fold(F.col("doc_id")) != 1).select(F.col("doc_id").cast("long").alias("label_id"), F.col("label").cast("int").alias("label"))
    order = F.xxhash64("label_id")
    share = min(1.0, most / max(chosen.count(), 1))
    chosen = chosen.where(F.pmod(order, F.lit(1 << 30)) / float(1 << 30) < share)
    chosen = chosen.orderBy(order, "label").limit(2 * most)  # small rows, which are broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "label", order.alias("o"))
    found = rows.orderBy("o", "label", "text").limit(2 * most).repartition(1).sortWithinPartitions("o", "label", "text").mapInArrow(_train(epochs), "w binary").collect()
    return np.frombuffer(found[0][0], "<f4") if found else np.zeros(DIM + 1, np.float32)


def _score(model, into: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value.astype(float)
        for whole in batches:
            for batch in steps(whole, "text"):
                score = 1 / (1 + np.exp(-dot_products(w[:-1], w[-1], *utf8(batch.column("text")))))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, into])

    return run


def score_quality(docs: DataFrame, weights: np.ndarray, into: str = "score") -> DataFrame:
    """``docs`` (text and any others) with the probability of label 1 in the column ``into``.

    Null and empty texts get the bias alone.  A column of that name is replaced.
    """
    docs = docs.drop(into)
    schema = T.StructType([*docs.schema.fields, T.StructField(into, T.DoubleType())])
    return docs.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(weights), into), schema)


def quality(docs: DataFrame, labels: DataFrame, **options: int) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``; ``labels`` has doc_id and label."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_quality(docs, fit_quality(docs, labels, **options))
    return scored.select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
