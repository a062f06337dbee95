"""Exact top-k search by norm-bucketed retrieval.

Vectors are made integer (floor of SCALE times each component) and dealt out by falling length into buckets of about
BUCKET rows. A bounded set of the longest vectors first gives each query a lower bound of its k-th score. In a bucket a
query needs a cosine of at least that bound over the product of its length and the bucket's greatest. If no cosine is
enough, the bucket is pruned by length at once; if the threshold is low, its rows are pruned by length; if it is high,
by coordinates: on the query's largest coordinates a candidate of that cosine must lie in a feasible interval. Products
of what remains are verified in integers, and each bucket's k best are merged.

Queries meet buckets in blocks of about BLOCK queries, so a task holds one block and one bucket. As lengths fall from
bucket to bucket, the buckets that are long enough for a query are the first so many; queries of like numbers share a
block, and neither queries nor vectors are sent to a meeting that lengths rule out. The driver holds one number for each
bucket and block (for 10^9 vectors, 2 MB). Pruning only drops rows strictly below a bound that k other rows reach, so
results are whole, ties included.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of different
dimensions are not compared; a query's own row, and any row of its vec_id, is no candidate; a vec_id given more than
once counts once, by its best score; ties go to the smaller vec_id; scores must fit 64 bits; null vec_ids take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import written

SCALE, BUCKET, BLOCK, LONGEST = 1024, 4_096, 4_096, 2_048
#: Queries of a cell whose products are taken at once.
AT_ONCE = 128
#: Local cosine threshold from which coordinates prune; coordinates looked at; slack for rounding.
HIGH, FOCUS, SLACK = 0.3, 5, 1e-6


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of long), norm, dim of the vectors that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e * SCALE).cast("bigint"))
    rows = vectors.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(F.coalesce(finite, F.lit(False))).select("vec_id", v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double")))
    return rows.select("vec_id", "v", norm.alias("norm"), F.size("v").alias("dim"))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integers: in doubles while every partial sum is below 2**53, else in 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return (a.astype(np.float64, copy=False) @ b.astype(np.float64, copy=False).T).astype(np.int64)
    return a.astype(np.int64, copy=False) @ b.astype(np.int64, copy=False).T


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64) if dim and len(column) else np.zeros((len(column), dim), np.int64)


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, each id once."""
    order = np.lexsort((ids, -scores))
    _, first = np.unique(ids[order], return_index=True)
    return order[np.sort(first)[:k]]


def long_enough(q_norm: float, bound: float, c_norm: np.ndarray) -> int:
    """How many of the bucket's rows, whose lengths fall, may reach the bound by their length."""
    if not bound > 0 or q_norm == 0:
        return len(c_norm)
    return int(np.searchsorted(-c_norm, -(bound / q_norm) * (1 - SLACK), side="right"))


def by_coordinates(q: np.ndarray, q_norm: float, bound: float, c: np.ndarray, c_norm: np.ndarray) -> np.ndarray:
    """Places of the rows that may reach the bound by the query's largest coordinates."""
    unit, ok = q / q_norm, np.ones(len(c), bool)
    t = bound / (q_norm * c_norm) * (1 - SLACK)
    for f in np.argsort(-np.abs(unit))[:FOCUS]:
        x = c[:, f] / c_norm
        reach = np.sqrt(np.maximum(0.0, 1 - t * t) * max(0.0, 1 - unit[f] ** 2)) + SLACK
        ok &= (x >= unit[f] * t - reach) if unit[f] > 0 else (x <= unit[f] * t + reach)
    return np.flatnonzero(ok)


def searched(asked: pd.DataFrame, own: pd.DataFrame, d: int, k: int) -> pd.DataFrame:
    """query_id, vec_id, score: the k best of a bucket's rows (own) for each query, where they may reach its bound."""
    own = own.sort_values(["norm", "vec_id"], ascending=[False, True])
    c, norms, ids = _matrix(own["v"], d), own["norm"].to_numpy(), own["vec_id"].to_numpy()
    q, q_ids, q_norms, bounds = _matrix(asked["v"], d), asked["vec_id"].to_numpy(), asked["norm"].to_numpy(), asked["bound"].to_numpy()
    if max(np.abs(q).max(initial=0), np.abs(c).max(initial=0)) < 2**53:
        q, c = q.astype(np.float64), c.astype(np.float64)
    n = np.array([long_enough(x, b, norms) for x, b in zip(q_norms, bounds)])
    # The local cosine threshold decides how the bucket is pruned for a query.
    need = np.where((bounds > 0) & (q_norms > 0), bounds / np.maximum(q_norms * norms[0], 1e-300), 0.0)
    found = []

    def take(i: int, at: np.ndarray, scores: np.ndarray) -> None:
        other = ids[at] != q_ids[i]
        at, scores = at[other], scores[other]
        if len(at):
            top = best(ids[at], scores, k)
            found.append(pd.DataFrame({"query_id": q_ids[i], "vec_id": ids[at][top], "score": scores[top]}))

    for i in np.flatnonzero((n > 0) & (need >= HIGH)):
        at = by_coordinates(q[i], q_norms[i], bounds[i], c[: n[i]], norms[: n[i]])
        take(i, at, products(q[i : i + 1], c[at])[0])
    rest = np.flatnonzero((n > 0) & (need < HIGH))
    rest = rest[np.argsort(n[rest], kind="stable")]
    for j in range(0, len(rest), AT_ONCE):
        some = rest[j : j + AT_ONCE]
        scores = products(q[some], c[: n[some[-1]]])
        for row, i in zip(scores, some):
            row = row[: n[i]]
            at = np.arange(len(row))
            if len(row) > 4 * (k + 1):
                # A few more than k, as the query's own id and ids given more than once may be among them.
                m = min(len(row), 4 * (k + 1))
                at = np.flatnonzero(row >= np.partition(row, len(row) - m)[len(row) - m])
                if len(np.unique(ids[at])) <= k + 1:
                    at = np.arange(len(row))
            take(i, at, row[at])
    return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")


def _blocks(numbers: list[tuple[int, int]]) -> tuple[list[tuple[int, int, int]], list[int]]:
    """From (buckets that are long enough, queries), rising: for each such number its first block and how many; and for
    each block the greatest number."""
    table, most, held = [], [], 0
    for last, n in numbers:
        if n > BLOCK:
            parts = -(-n // BLOCK)
            table.append((last, len(most), parts))
            most += [last] * parts
            held = 0
        elif held and held + n <= BLOCK:
            table.append((last, len(most) - 1, 1))
            most[-1] = last
            held += n
        else:
            table.append((last, len(most), 1))
            most.append(last)
            held = n
    return table, most


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of all vectors. Both have vec_id and embedding."""
    rows, asked = written(integers(vectors), "topk-rows"), integers(queries)
    n = max(1, rows.count())
    buckets = -(-n // BUCKET)
    longest = rows.orderBy(F.desc("norm"), "vec_id").limit(LONGEST).collect()
    seeds = {d: ([r.vec_id for r in longest if r.dim == d], [r.v for r in longest if r.dim == d]) for d in {r.dim for r in longest}}

    def bounds(frames):
        for frame in frames:
            out = np.full(len(frame), -np.inf)
            for d, own in frame.reset_index(drop=True).groupby("dim"):
                if d in seeds:
                    ids, seed = np.array(seeds[d][0]), np.array(seeds[d][1], dtype=np.int64).reshape(len(seeds[d][0]), d)
                    q = _matrix(own["v"], d)
                    scores = products(q, seed).astype(np.float64)
                    scores[own["vec_id"].to_numpy()[:, None] == ids] = -np.inf
                    _, first = np.unique(ids, return_index=True)
                    if len(first) == len(ids) >= k:
                        out[own.index] = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]
            yield frame.assign(bound=out)

    # A range of lengths for each bucket; equal lengths are told apart by id, so that one common vector fills many buckets.
    ranged = written(rows.repartitionByRange(buckets, F.desc("norm"), "vec_id").withColumn("bucket", F.spark_partition_id()), "topk-buckets")
    tops = {r.bucket: r.top for r in ranged.groupBy("bucket").agg(F.max("norm").alias("top")).collect()}
    last = max(tops, default=-1) + 1
    # Lengths at the top of each bucket, falling; an empty bucket has that of the next.
    top = np.maximum.accumulate(np.array([tops.get(j, 0.0) for j in range(last)])[::-1])[::-1]

    def reached(frames):
        for frame in bounds(frames):
            yield frame.assign(buckets=[long_enough(x, b, top) for x, b in zip(frame["norm"], frame["bound"])])

    schema = "vec_id bigint, v array<bigint>, norm double, dim int"
    queried = written(asked.select("vec_id", "v", "norm", "dim").mapInPandas(reached, f"{schema}, bound double, buckets int").where("buckets > 0"), "topk-queries")
    numbers = sorted((r.buckets, r.n) for r in queried.groupBy("buckets").agg(F.count("*").alias("n")).collect())
    table, most = _blocks(numbers)
    spark = vectors.sparkSession
    of_number = F.broadcast(spark.createDataFrame(table, "buckets int, first int, parts int"))
    # Blocks stand in the order of their numbers, so those that need a bucket are the last ones.
    of_bucket = F.broadcast(spark.createDataFrame([(j, int(np.searchsorted(most, j, side="right"))) for j in range(last)], "bucket int, first int"))
    cells_q = queried.join(of_number, "buckets").withColumn("block", F.col("first") + F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    cells_c = ranged.join(of_bucket.where(F.col("first") < len(most)), "bucket").withColumn("block", F.explode(F.sequence(F.col("first"), F.lit(len(most) - 1))))

    def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [searched(asked, right[right["dim"] == d], d, k) for d, asked in left.groupby("dim") if (right["dim"] == d).any()]
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")

    found = cells_q.select("block", "bucket", "vec_id", "v", "norm", "dim", "bound").groupBy("block", "bucket").cogroup(cells_c.select("block", "bucket", "vec_id", "v", "norm", "dim").groupBy("block", "bucket")).applyInPandas(cell, "query_id bigint, vec_id bigint, score bigint")
    # At most k rows of each bucket reach a query's list; ids in several buckets count once.
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
