"""Target-distribution importance resampling: documents are drawn by how like the target's their hashed features are.

A byte automaton reads the texts of an Arrow batch at once: a lookup table folds A-Z and marks the bytes of words, words
begin and end where the marks differ from byte to byte, and a table-driven CRC advances over all words of the batch
simultaneously, byte by byte. Features are the runs of 1 to ``orders`` consecutive words, joined by a space: the CRC of a
run goes on where that of its beginning ended. A feature's bucket is its CRC modulo ``buckets``.

Counts of the buckets over all documents and all target texts give each bucket's gain (a scaled log ratio of smoothed
shares); a document's weight is the sum of its features' gains, and its score adds Gumbel noise that follows from its id:
the highest scores are a draw without replacement. Ranks come from a sort over ranges: no task holds all rows.

Defined results: null and empty texts have no feature, weight 0 and a score; a null doc_id draws its noise as an empty
id and comes last among ties; repeated rows are rows of their own and draw one noise; empty tables give an empty result,
an empty target counts as 0 in each bucket; words of any length are read whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import written

ORDERS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: Steps that all words take together; what is longer goes on by itself. Bytes of text that are read at once.
TOGETHER, AT_ONCE = 48, 1 << 24
#: Partitions of the sort for the draw grow with the rows.
ROWS = 500_000

_BYTES = np.arange(256, dtype=np.uint8)
#: Folded byte, 0 for a byte that is in no word.
FOLD = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES)
FOLD = np.where(((FOLD >= 48) & (FOLD <= 57)) | ((FOLD >= 97) & (FOLD <= 122)) | (FOLD >= 128), FOLD, 0).astype(np.uint8)


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = _crc_table()


def advanced(state: np.ndarray, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after ``length`` bytes from ``start``, of all rows at once: longest first, so that those that still run
    are the first of the array."""
    order = np.argsort(-length, kind="stable")
    state, start, length = state[order], start[order], length[order]
    for i in range(min(TOGETHER, int(length[0]) if len(length) else 0)):
        n = np.searchsorted(-length, -i)  # rows longer than i
        state[:n] = CRC[(state[:n] ^ data[start[:n] + i]) & 0xFF] ^ (state[:n] >> 8)
    for k in range(np.searchsorted(-length, -TOGETHER)):
        rest = data[start[k] + TOGETHER : start[k] + length[k]]
        state[k] = zlib.crc32(rest, int(state[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(state)
    out[order] = state
    return out


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Runs of rows of about AT_ONCE bytes: memory is bounded by that and the longest text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + AT_ONCE, side="right")))
        yield texts.slice(at, end - at)
        at = end


def features(texts: pa.Array, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows of a string array: the row and the unsigned CRC of each feature, and the words of each row."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, raw = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = FOLD[np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]] if raw is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    ends = offsets[1:] - offsets[0]
    inside = data != 0
    edges = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, stop = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    # A row's end cuts a word that runs on into the next row's text.
    cuts = np.unique(ends[:-1])
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[inside[cuts - 1] & inside[cuts]]
    start, stop = np.sort(np.concatenate([start, cuts])), np.sort(np.concatenate([stop, cuts]))
    row = np.searchsorted(ends, start, side="right")
    words = np.bincount(row, minlength=len(texts))
    state = advanced(np.full(len(start), 0xFFFFFFFF, dtype=np.uint32), data, start, stop - start)
    rows, crcs = [row], [state ^ np.uint32(0xFFFFFFFF)]
    first = np.arange(len(start))
    for n in range(1, orders):
        first = first[: len(start) - n]
        same = row[first] == row[first + n] if len(first) else np.zeros(0, bool)
        first, state = first[same], state[: len(same)][same]
        state = CRC[(state ^ 32) & 0xFF] ^ (state >> 8)
        state = advanced(state, data, start[first + n], (stop - start)[first + n])
        rows.append(row[first])
        crcs.append(state ^ np.uint32(0xFFFFFFFF))
        # The next order looks runs up by the place of their first word.
        kept = np.zeros(len(start), dtype=np.uint32)
        kept[first] = state
        state, first = kept, np.arange(len(start))
    return np.concatenate(rows), np.concatenate(crcs), words


def bucket_counts(texts: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how often each bucket occurs in the column ``text``; summed in each partition before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for part in _slices(batch.column(0)):
                total += np.bincount(features(part, orders)[1] % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})

    return texts.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share of the target over that of the documents."""
    both = [{r.bucket: r.n for r in bucket_counts(x, orders, buckets).collect()} for x in (docs, target)]
    s, t = (np.array([x.get(i, 0) for i in range(buckets)], dtype=np.float64) for x in both)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(docs: DataFrame, gain: np.ndarray, orders: int = ORDERS) -> DataFrame:
    """doc_id, n_features, n_words, weight of every row."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in _slices(batch.column(1)):
                row, crc, words = features(part, orders)
                n = np.bincount(row, minlength=len(part))
                total = np.zeros(len(part), dtype=np.int64)
                np.add.at(total, row, gain[crc % len(gain)])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(at, len(part)), "n_features": pa.array(n, pa.int64()), "n_words": pa.array(words, pa.int64()), "weight": pa.array(total, pa.int64())})
                at += len(part)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, n_features bigint, n_words bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 Gumbel), from the first 32 bits of the id's digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def drawn(rows: DataFrame, percent: int) -> DataFrame:
    """rows with rank: 1, 2, 3... of that share of the ``eligible`` rows with the highest scores, ties to the smaller
    doc_id; the others have none."""
    eligible = rows.where("eligible")
    many = eligible.count()
    n = percent * many // 100
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, many // ROWS + 1)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("place")]
    ordered = eligible.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The place in the range's partition is written with the row: later reads need no second sort.
    ordered = written(ordered.withColumn("at", F.monotonically_increasing_id()), "resample-order")
    part, at = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.part: r.n for r in ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before = np.cumsum([0, *[sizes.get(i, 0) for i in range(max(sizes, default=0) + 1)]]).tolist()
    rank = F.get(F.lit(before), part.cast("int")).cast("bigint") + at + 1
    ranked = ordered.withColumn("rank", rank).withColumn("rank", F.when(F.col("rank") <= n, F.col("rank")))
    return ranked.drop("at").unionByName(rows.where("NOT eligible").withColumn("rank", F.lit(None).cast("bigint")))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least: int = LEAST_WORDS, orders: int = ORDERS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank where it is drawn."""
    rows = weights(docs, gains(docs, target, orders, buckets), orders)
    rows = rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least).alias("eligible"))
    rows = written(rows.withColumn("place", F.monotonically_increasing_id()), "resample-scores")
    return drawn(rows, percent).select("doc_id", "n_features", "weight", "score", "rank")
