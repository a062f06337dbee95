"""Fixpoints by driver-controlled rounds of joins: closure, bounded breadth-first search, connected components.

Each round joins only what the last one found (semi-naive), removes what is known by an anti-join and is written, so
that lineage stays short and lost executors cost one round. Frames are dealt out by hash of the key they are joined on;
hubs are left to adaptive skew joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.storage import Grown, cut

#: A closure of more rounds than this is taken for a mistake.
MAX_ROUNDS = 10_000


def closure(edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """a, b: every b that is reachable from a by one or more of edges (a, b); cycles end by themselves.

    With sources (a), only from those: then each round advances all their frontiers by one edge. Without, each round
    joins new pairs to all pairs, so that paths double and rounds grow with the logarithm of the depth."""
    edges = cut(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "edges")
    new = edges if sources is None else cut(edges.join(sources.select("a").distinct(), "a", "left_semi"), "closure")
    all_ = Grown(new, "closure")
    for _ in range(MAX_ROUNDS):
        known = all_.frame
        step = new.select("a", F.col("b").alias("m"))
        if sources is None:
            # New pairs on either side of known ones.
            right = step.join(known.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
            left = known.select("a", F.col("b").alias("m")).join(new.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
            found = right.union(left)
        else:
            found = step.join(edges.select(F.col("a").alias("m"), "b"), "m").select("a", "b")
        new = cut(found.distinct().join(known, ["a", "b"], "left_anti"), "closure")
        if new.isEmpty():
            return known
        all_.add(new)
    raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")


def reachable(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """node: the seeds (node) and all that can be reached from them."""
    edges = edges.select("a", "b").distinct()
    edges = cut(edges, "edges")
    new = cut(seeds.select("node").distinct(), "reach")
    all_ = Grown(new, "reach")
    for _ in range(MAX_ROUNDS):
        known = all_.frame
        found = new.join(edges, new["node"] == edges["a"]).select(F.col("b").alias("node")).distinct()
        new = cut(found.join(known, "node", "left_anti"), "reach")
        if new.isEmpty():
            return known
        all_.add(new)
    raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")


def bfs(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """node, depth: the least number of edges (source, target) from any root (node), up to ``depth``."""
    new = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    all_ = Grown(new, "bfs")
    for d in range(1, depth + 1):
        known = all_.frame
        found = new.join(edges, new["node"] == edges["source"]).select(F.col("target").alias("node")).distinct()
        new = cut(found.join(known, "node", "left_anti").withColumn("depth", F.lit(d)), "bfs")
        if new.isEmpty():
            break
        all_.add(new)
    return all_.frame


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of all nodes of undirected edges (a, b), by alternating star contractions."""

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now, before = cut(tidy(edges), "cc"), None
    for _ in range(MAX_ROUNDS):
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = tidy(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        joined = large.join(large.groupBy("a").agg(F.min("b").alias("m")), "a")
        now = cut(tidy(joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))), "cc")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == before:
            linked = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return nodes.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
        before = seen
    raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")
