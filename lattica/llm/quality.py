"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics of a text (byte classes, word and line shapes,
repetition). Each partition sums its own normal equations; the sums are added up and solved once. Raw scores are then
calibrated by pool-adjacent-violators over counts in ``BINS`` equal bins of the training rows' scores, and read off by
linear interpolation, so that a score is an estimate of the probability of label 1.

Defined results: null and empty texts have all-zero statistics and are scored like any other; without usable labels
every score is 0.5 (or the one label that occurs); a row of ``labels`` without a document, doc_id or label is not used;
repeated rows give repeated results; labels, lang, source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import fold, in_small_batches, written

#: Random features, kernel width in standard deviations, ridge penalty for each row, calibration bins.
FEATURES, WIDTH, RIDGE, BINS = 192, 3.0, 1e-4, 512
#: Partitions that sum normal equations: what the driver adds up is bounded by this and FEATURES.
SUMMING = 16
#: Ids of labelled rows that may be broadcast: 16 MB.
BROADCAST = 2_000_000

_CLASS = np.full(256, 6)
for _i, _of in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\x0b\x0c", "\n", ".,;:'-\"()")):
    _CLASS[list(_of.encode())] = _i
_CLASS[128:] = 7
NAMES = ["lower", "upper", "digit", "space", "newline", "common_punctuation", "other_symbol", "non_ascii", "entropy", "log_bytes", "log_words", "mean_word", "sd_word", "max_word", "distinct_words", "top_word", "repeated_neighbour", "distinct_lines", "mean_line", "upper_letters", "title_words", "words_with_symbols", "short_words", "distinct_pairs"]


def statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    if not raw:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n = len(raw)
    classes = np.bincount(_CLASS, weights=counts, minlength=8) / n
    p = counts[counts > 0] / n
    words = text.split()
    lines = text.split("\n")
    out = [*classes, float(-(p * np.log2(p)).sum()), math.log1p(n), math.log1p(len(words))]
    if words:
        sizes = np.fromiter(map(len, words), dtype=np.float64, count=len(words))
        many = Counter(words)
        pairs = list(zip(words, words[1:]))
        symbol = counts[[33, 35, 36, 37, 38, 42, 124, 60, 62, 123, 125, 64, 94, 126]].sum()
        out += [sizes.mean(), sizes.std(), math.log1p(sizes.max()), len(many) / len(words), max(many.values()) / len(words), sum(a == b for a, b in pairs) / len(words)]
        more = [sum(map(str.istitle, words)) / len(words), min(3.0, symbol / len(words)), float((sizes <= 3).mean()), len(set(pairs)) / max(1, len(pairs))]
    else:
        out += [0.0] * 6
        more = [0.0] * 4
    letters = classes[0] + classes[1]
    return [*out, len(set(lines)) / len(lines), math.log1p(n / len(lines)), classes[1] / letters if letters else 0.0, *more]


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array of double), in one pass over the texts."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "stats": pa.array([statistics(x) for x in batch.column(1).to_pylist()], pa.list_(pa.float64()))})

    return in_small_batches(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, stats array<double>")


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the points (mean x, mean y) of the blocks, both increasing."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [u + v for u, v in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class Scorer:
    """Plain arrays, so that it travels with a task."""

    def __init__(self, mean, sd, frequencies, phases, weights=None):
        self.mean, self.sd, self.frequencies, self.phases, self.weights = mean, sd, frequencies, phases, weights
        self.x, self.y = np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -6, 6)
        return np.hstack([math.sqrt(2 / len(self.phases)) * np.cos(z @ self.frequencies + self.phases), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(self.features(stats) @ self.weights, -1.0, 2.0)

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.y[0])
        return np.clip(np.interp(self.raw(stats), self.x, self.y), 0.0, 1.0)


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, len(NAMES)))


def fit(stats: DataFrame, labels: DataFrame, seed: int = 7) -> Scorer:
    """stats: doc_id, stats. labels: doc_id, label (0 or 1); all rows take part.

    The driver gets moments, SUMMING matrices of FEATURES + 1 squared and BINS counts, whatever the number of rows."""
    mean_label = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.avg("label").alias("y"))
    train = written(stats.join(mean_label, "doc_id").select("stats", "y").repartition(SUMMING), "quality-train")
    moments = train.select(F.posexplode("stats").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("k").collect()
    rng = np.random.default_rng(seed)
    k = len(NAMES)
    frequencies, phases = rng.normal(size=(k, FEATURES)) / WIDTH, rng.uniform(0, 2 * math.pi, FEATURES)
    model = Scorer(np.zeros(k), np.ones(k), frequencies, phases)
    if not moments:
        return model
    model.mean, model.sd = np.array([r.m for r in moments]), np.array([max(r.s, 1e-6) for r in moments])

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for frame in frames:
            z = model.features(_stack(frame["stats"]))
            a += z.T @ z
            b += z.T @ frame["y"].to_numpy(float)
            n += len(frame)
        yield pd.DataFrame({"a": [a.tobytes()], "b": [b.tobytes()], "n": [n]})

    parts = train.mapInPandas(sums, "a binary, b binary, n bigint").collect()
    a = sum(np.frombuffer(r.a) for r in parts).reshape(FEATURES + 1, FEATURES + 1)
    b, n = sum(np.frombuffer(r.b) for r in parts), sum(r.n for r in parts)
    penalty = np.full(FEATURES + 1, RIDGE * n)
    penalty[-1] = 1e-9
    weights = np.linalg.solve(a + np.diag(penalty), b)
    solved = Scorer(model.mean, model.sd, frequencies, phases, weights)

    def bins(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            raw = solved.raw(_stack(frame["stats"]))
            yield pd.DataFrame({"bin": np.floor((raw + 1) / 3 * BINS).astype(np.int64), "raw": raw, "y": frame["y"].to_numpy(float)})

    rows = train.mapInPandas(bins, "bin bigint, raw double, y double").groupBy("bin").agg(F.avg("raw").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").collect()
    solved.x, solved.y = isotonic(np.array([r.x for r in rows]), np.array([r.y for r in rows]), np.array([float(r.n) for r in rows]))
    return solved


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; labels (doc_id, label) of the held-out third are not learned from."""
    stats = written(with_statistics(docs), "quality-stats")
    model = fit(stats, labels.where(fold(F.col("doc_id"), 3) != 1))
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(model.score(values), pa.float64())})

    held_out = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    return stats.mapInArrow(run, f"doc_id {doc_id}, score double").select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, whose predicted label is 1; texts are scored where they are read, without a
    join, and only labelled ones are read for the training."""
    learnt = labels.where(fold(F.col("doc_id"), 3) != 1)
    ids = written(learnt.select("doc_id").distinct(), "quality-ids")
    labelled = docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST else docs
    model = fit(with_statistics(labelled), learnt)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([statistics(x) for x in batch.column(at).to_pylist()]).reshape(-1, len(NAMES))
            yield batch.filter(pa.array(model.score(values) >= 0.5))

    return in_small_batches(docs).mapInArrow(run, docs.schema)
