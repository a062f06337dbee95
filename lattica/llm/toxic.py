"""Toxicity: a linear classifier over character n-grams, scaled by naive Bayes log-count ratios.

A text is lower-cased, its white space evened out, and the n-grams of its characters (across word ends) are hashed into
buckets; a feature is whether a bucket occurs. Of the labelled texts, a bucket's ratio is the log of its smoothed share of
the toxic documents over that of the others; logistic regression with an L2 penalty learns weights of the features times
their ratios. Each partition sums its own losses and gradients, and the driver takes L-BFGS steps.

Defined results: null and empty texts have no n-gram but that of the white space around them and are scored like any
other; without labels of both kinds every score is the one label that occurs, or 0; a row of ``labels`` without a document,
doc_id or label is not used, several labels of one doc_id are averaged; whole texts are read, in pieces of ``PIECE``
characters that overlap; repeated rows give repeated results; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import fold, written

#: Lengths of n-grams, hash buckets (a power of two), labelled rows that a bucket needs, penalty, evaluations of the loss.
ORDERS, BITS, SEEN, PENALTY, ROUNDS = (3, 4, 5, 6), 18, 3, 1e-4, 25
BUCKETS = 1 << BITS
#: About so many labelled rows are learned from, chosen by hash of the id where there are more.
SAMPLE = 8_192
#: Partitions that sum gradients (what the driver adds up is bounded by this and BUCKETS), and characters read at once.
SUMMING, PIECE = 8, 1 << 20
#: Ids of labelled rows that may be broadcast: 16 MB.
BROADCAST = 2_000_000


def buckets(text: str | None) -> np.ndarray:
    """The distinct buckets of a text's n-grams, ascending."""
    present = np.zeros(BUCKETS, dtype=bool)
    even = f" {' '.join((text or '').lower().split())} "
    for at in range(0, len(even), PIECE):
        x = np.frombuffer(even[at : at + PIECE + max(ORDERS) - 1].encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        h = np.zeros(len(x), dtype=np.uint64)
        for n in range(1, min(max(ORDERS), len(x)) + 1):
            h = h[: len(x) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + x[n - 1 :]
            if n in ORDERS:
                present[((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int64)] = True
    return np.flatnonzero(present).astype(np.int32)


HIGH = max(1, BUCKETS >> 16)


def packed(found: np.ndarray) -> bytes:
    """Two bytes a bucket: how many there are by their upper bits, and the lower bits of each."""
    return np.bincount(found >> 16, minlength=HIGH).astype(np.uint32).tobytes() + (found & 0xFFFF).astype(np.uint16).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    upper = np.repeat(np.arange(HIGH, dtype=np.int32) << 16, np.frombuffer(raw[: 4 * HIGH], dtype=np.uint32))
    return upper + np.frombuffer(raw[4 * HIGH :], dtype=np.uint16)


def log_count_ratios(positive: np.ndarray, negative: np.ndarray, positives: float, negatives: float) -> np.ndarray:
    """By bucket, from the labelled rows of each kind that hold it; rare buckets have none."""
    ratio = np.log((positive + 1) / (positives + 2)) - np.log((negative + 1) / (negatives + 2))
    return np.where(positive + negative >= SEEN, ratio, 0.0)


class Rows:
    """Buckets of several texts in one array."""

    def __init__(self, batch: pa.RecordBatch):
        parts = list(map(unpacked, batch.column(1).to_pylist()))
        self.y = batch.column(0).to_numpy(zero_copy_only=False)
        self.sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        self.at = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)

    def sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self.sizes)), self.sizes), weights=values[self.at], minlength=len(self.sizes))

    def spread(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=np.repeat(values, self.sizes), minlength=BUCKETS)


def loss(rows: Rows, weights: np.ndarray, bias: float) -> np.ndarray:
    """Summed log loss, gradients of the weights by bucket, and of the bias."""
    z = rows.sums(weights) + bias
    error = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - rows.y
    return np.concatenate([[np.sum(np.logaddexp(0, z) - rows.y * z)], rows.spread(error), [error.sum()]])


def summed(train: DataFrame, of: Callable[[Rows], np.ndarray]) -> np.ndarray:
    """The sum of a vector over all rows: one vector for each of the SUMMING partitions comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sum(of(Rows(batch)) for batch in batches if batch.num_rows)
        if not isinstance(total, int):
            yield pa.RecordBatch.from_pydict({"v": pa.array([total.tobytes()], pa.binary())})

    return sum((np.frombuffer(r.v) for r in train.mapInArrow(run, "v binary").collect()), np.zeros(1))


def descend(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, kept: int = 8) -> np.ndarray:
    """L-BFGS with steps that are shortened until the loss falls; f gives loss and gradient and is called ``rounds`` times."""
    value, g = f(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    while rounds > 0 and np.abs(g).max() > 1e-6:
        d, back = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            back.append(a)
            d -= a * y
        d *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else min(1.0, 1 / math.sqrt(np.abs(g).sum()))
        for (s, y), a in zip(pairs, reversed(back)):
            d += (a - (y @ d) / (s @ y)) * s
        step = 1.0
        while rounds > 0:
            rounds -= 1
            there, g_there = f(x - step * d)
            if there <= value - 1e-4 * step * (g @ d):
                break
            step /= 4
        else:
            return x
        if (g_there - g) @ d < 0:
            pairs = [*pairs[1 - kept :], (-step * d, g_there - g)]
        x, value, g = x - step * d, there, g_there
    return x


class Model:
    def __init__(self, weights: np.ndarray | None, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.bias
        return float(1 / (1 + np.exp(-np.clip(self.weights[buckets(text)].sum() + self.bias, -500, 500))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text. labels: doc_id, label (0 or 1); about SAMPLE rows take part."""
    known = written(labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.avg("label").alias("y")), "toxic-labels")
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < math.ceil(min(1.0, SAMPLE / max(1, n)) * (1 << 20)))
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen) if n <= BROADCAST else chosen, "doc_id").select("y", "text").repartition(SUMMING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"y": batch.column(0), "buckets": pa.array([packed(buckets(x)) for x in batch.column(1).to_pylist()], pa.binary())})

    train = written(labelled.mapInArrow(run, "y double, buckets binary"), "toxic-train").coalesce(SUMMING)
    counts = summed(train, lambda rows: np.concatenate([rows.spread(rows.y), rows.spread(1 - rows.y), [rows.y.sum(), len(rows.y)]]))
    positives, rows = (counts[-2], counts[-1]) if len(counts) > 1 else (0.0, 0.0)
    if positives in (0.0, rows):
        return Model(None, 1.0 if positives else 0.0)
    ratio = log_count_ratios(counts[:BUCKETS], counts[BUCKETS : 2 * BUCKETS], positives, rows - positives)

    def penalised(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, bias = x[:-1], float(x[-1])
        weights = w * ratio
        got = summed(train, lambda part: loss(part, weights, bias)) / rows
        return float(got[0] + PENALTY / 2 * (w @ w)), np.append(got[1:-1] * ratio + PENALTY * w, got[-1])

    x = descend(penalised, np.append(np.zeros(BUCKETS), math.log(positives / (rows - positives))), ROUNDS)
    return Model(x[:-1] * ratio, float(x[-1]))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels (doc_id, label) of the held-out quarter are not learned from."""
    model = fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array([model.score(x) for x in batch.column(1).to_pylist()], pa.float64())})

    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, score double")
    return rows.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
