"""MinHash near-duplicates by an inverted join on signature coordinates.

A text is lower-cased (A-Z) and cut at ASCII white space; its set holds the distinct shingles of WORDS words (the whole
sequence, if it has fewer). Texts with the same word sequence are one class, whose node is its smallest doc_id. Each
class has a signature of COORDINATES minima and is posted under its (coordinate, value) pairs.

Merging with prefixes: pairs must agree in ``least`` coordinates, six standard deviations below what a pair at the
threshold is expected to share. A value that only one class has can't agree, so a class with fewer than ``least``
shared values is skipped altogether, and others are posted only under the rarest of their values: as two classes that
agree often enough share a value within those prefixes, very common values (of passages in many documents) are never
merged. Merging with skips: under each value every class is first compared with one class chosen by hash, differently
in each round; the links found are contracted into components, and a list whose classes are in one component already
is skipped. What is left, pairs across components, is then looked at in cells of bounded size, each pair once; lengths
and collisions must allow a link. Every link is confirmed on the full sets of both texts.

A pair of similarity s agrees in each coordinate with probability s, so a pair at the threshold misses ``least`` with a
probability near 2e-7, and one above it with less; nothing else leaves a pair out.

Defined results: null, empty and blank texts have no set and are linked with nothing (n_shingles 0, kept); a row
without doc_id takes part in nothing (component_id null, kept); rows with one doc_id and different texts are linked by
their own texts, each row for itself; ties go to the smallest doc_id; ``unique`` keeps every column, whatever its name,
and of rows that share the smallest doc_id of a group one; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import in_small_batches, quoted, written

WORDS, COORDINATES, SEED, ROUNDS = 5, 64, 11, 1
#: Posting lists that a plain join pairs; classes in a block of a longer one (a cell compares two blocks);
#: candidates that are compared one by one; shingles hashed at once.
SHORT, BLOCK, FEW, AT_ONCE = 32, 2_048, 12, 8_192
#: Rows of two numbers that may be broadcast: 32 MB.
BROADCAST = 2_000_000

_rng = np.random.default_rng(SEED)
_MULTIPLY = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """bytes.lower() and bytes.split() know ASCII letters and ASCII white space only."""
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of the distinct shingles, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(WORDS, len(words))
    n = len(words) - k + 1
    out = np.full(n, k, dtype=np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Of each coordinate the least value of its hash, its upper 32 bits."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), AT_ONCE):
        np.minimum(least, (shingles[i : i + AT_ONCE, None] * _MULTIPLY + _ADD).min(0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def least_matches(threshold: float) -> int:
    return max(1, math.ceil(COORDINATES * threshold - 6 * math.sqrt(COORDINATES * threshold * (1 - threshold))))


def with_signatures(docs: DataFrame) -> DataFrame:
    """doc_id, digest (64 bits, of the text as it is), n_shingles, class (128 bits, of the word sequence; null without words), sig."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, classes, sigs = [], [], []
            for text in batch.column(2).to_pylist():
                words = words_of(text)
                shingles = shingle_set(words)
                n.append(len(shingles))
                classes.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                sigs.append(signature(shingles) if words else None)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "digest": batch.column(1), "n_shingles": pa.array(n, pa.int64()), "class": pa.array(classes, pa.binary()), "sig": pa.array(sigs, pa.list_(pa.int32()))})

    return in_small_batches(docs).select("doc_id", _digest(), "text").mapInArrow(run, f"doc_id {doc_id}, digest bigint, n_shingles bigint, class binary, sig array<int>")


def _digest() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")


def components(edges: DataFrame) -> DataFrame:
    """node, comp: the smallest node that is reachable, for all nodes of edges (a, b) but the roots themselves.

    Alternates large-star and small-star steps until nothing changes; each step is a minimum and a join by node."""

    def tidy(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    now, before = written(tidy(edges), "cc"), None
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = tidy(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        now = written(tidy(joined.select("a", F.col("m").alias("b")).union(joined.select(F.col("b").alias("a"), F.col("m").alias("b")))), "cc")
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if seen == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp"))
        before = seen


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose full sets have 100 * intersection >= percent * union."""
    with_b = pairs.select("a", "b").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "text_a", "b", "text_b")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for text_a, text_b in zip(batch.column(1), batch.column(3)):
                x = text_a.as_py()
                if x != last:
                    last, of_last = x, shingle_set(words_of(x))
                other = shingle_set(words_of(text_b.as_py()))
                shared = len(np.intersect1d(of_last, other, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= percent * (len(of_last) + len(other) - shared))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(kept), batch.column(2).filter(kept)], names=["a", "b"])

    return in_small_batches(both).mapInArrow(run, f"a {kind}, b {kind}")


def _cross_links(cells: DataFrame, least: int, percent: int) -> DataFrame:
    """Cells (token, i, j) of rows (own, node, comp, n, sig, prefix, text): links across components of the blocks i and j.

    Each pair is looked at where the smallest value that both prefixes hold is posted. What lengths and signatures allow
    is decided on the full sets, by merging the lists of the block's shingles; of the links only those are handed on that
    join components not yet joined in the cell, so its output is smaller than its input, however dense a group is."""
    kind = cells.schema["node"].dataType.simpleString()

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        token, i, j = int(cell["token"].iat[0]), int(cell["i"].iat[0]), int(cell["j"].iat[0])
        left, right = cell[cell["own"] == i], cell[cell["own"] == j]
        found = []
        if len(left) and len(right):
            nodes, sizes, sigs = right["node"].to_numpy(), right["n"].to_numpy(), np.stack(right["sig"].to_numpy())
            posted: dict[int, list[int]] = {}
            for k, prefix in enumerate(right["prefix"]):
                for value in prefix[prefix < token].tolist():
                    posted.setdefault(value, []).append(k)
            sets = [shingle_set(words_of(t)) for t in right["text"]]
            order = np.argsort(np.concatenate(sets), kind="stable")
            owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
            values, many = np.unique(np.concatenate(sets), return_counts=True)
            begin = np.cumsum(many) - many
            root: dict = {}

            def find(c):
                while (up := root.get(c, c)) != c:
                    root[c] = c = root.get(up, up)
                return c

            comps = right["comp"].to_numpy()
            for node, comp, n, sig, prefix, text in zip(left["node"], left["comp"], left["n"], left["sig"], left["prefix"], left["text"]):
                ok = (comps != comp) & (np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * percent)
                if i == j:
                    ok &= nodes > node
                for value in prefix[prefix < token].tolist():
                    if value in posted:
                        ok[posted[value]] = False
                at = np.flatnonzero(ok)
                at = at[(sigs[at] == sig).sum(1) >= least]
                if not len(at):
                    continue
                own = shingle_set(words_of(text))
                if len(at) <= FEW:
                    shared = np.array([len(np.intersect1d(own, sets[k], assume_unique=True)) for k in at])
                else:
                    where = np.searchsorted(values, own)
                    where = where[(where < len(values)) & (values[np.minimum(where, len(values) - 1)] == own)]
                    long = many[where]
                    take = np.repeat(begin[where] - (np.cumsum(long) - long), long) + np.arange(long.sum())
                    shared = np.bincount(owner[take], minlength=len(nodes))[at]
                for k in at[(shared > 0) & (100 * shared >= percent * (n + sizes[at] - shared))]:
                    x, y = find(comp), find(comps[k])
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        found.append((node, nodes[k]))
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return cells.groupBy("token", "i", "j").applyInPandas(run, f"a {kind}, b {kind}")


def linked(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    return _grouped(docs, percent).drop("digest", "group")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, digest, n_shingles, group (null without words or doc_id), component_id, kept of every row."""
    least = least_matches(percent / 100)
    base = written(with_signatures(docs), "minhash-base")
    named = base.where("doc_id IS NOT NULL AND class IS NOT NULL")
    # Numbered once, and written: rows of one class have one signature.
    reps = named.groupBy("class").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    reps = written(reps.withColumn("node", F.monotonically_increasing_id()), "minhash-reps")

    # Values that at least two classes have, then each class's rarest.
    tokens = reps.select("node", F.posexplode("sig").alias("k", "v")).select("node", (F.shiftleft(F.col("k").cast("bigint"), 32) + F.col("v").cast("bigint") - F.lit(-(1 << 31))).alias("token"))
    common = tokens.groupBy("token").agg(F.count("*").alias("posted")).where("posted > 1")
    per_class = tokens.join(common, "token").groupBy("node").agg(F.collect_list(F.struct("posted", "token")).alias("values")).where(F.size("values") >= least)
    prefix = F.array_sort(F.transform(F.slice(F.array_sort("values"), F.lit(1), F.size("values") - least + 1), lambda x: x["token"]))
    nodes = written(per_class.select("node", prefix.alias("prefix")).join(reps.drop("class"), "node"), "minhash-nodes")
    postings = written(nodes.select("node", F.explode("prefix").alias("token")), "minhash-postings")
    sample = _small(nodes.select("node", "first.*"))
    texts = written(docs.select("doc_id", "text", _digest()).join(sample, ["doc_id", "digest"]).select("node", "text").dropDuplicates(["node"]), "minhash-texts")

    links = comps = None

    def with_components(df: DataFrame) -> DataFrame:
        if comps is None:
            return df.withColumn("comp", F.col("node"))
        return df.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def alike(pairs: DataFrame, matching: int) -> DataFrame:
        """Pairs (a, b) whose sizes allow a link and whose signatures agree in so many coordinates."""
        of = lambda side: nodes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}"))
        matches = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)
        sizes = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        return pairs.join(of("a"), "a").join(of("b"), "b").where(sizes & (matches >= matching)).select("a", "b")

    def add(found: DataFrame) -> None:
        nonlocal links, comps
        found = written(found, "minhash-links")
        links = found if links is None else links.union(found)
        comps = components(links)

    for r in range(ROUNDS):
        now = with_components(postings)
        chosen = now.groupBy("token").agg(F.min(F.struct(F.xxhash64("node", "token", F.lit(r)).alias("h"), F.col("node").alias("b"), F.col("comp").alias("comp_b"))).alias("to"), F.count_distinct("comp").alias("d")).where("d > 1").select("token", "to.b", "to.comp_b")
        pairs = now.join(chosen, "token").where("comp <> comp_b").select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct()
        add(confirmed(alike(pairs, least + (COORDINATES - least) // 3), texts, percent))

    # The rest: lists that still hold several components. Short ones by a join, long ones in cells of two blocks.
    now = with_components(postings)
    lists = now.groupBy("token").agg(F.count("*").alias("g"), F.count_distinct("comp").alias("d")).where("d > 1").drop("d")
    rest = written(now.join(lists, "token"), "minhash-rest")
    short = rest.where(F.col("g") <= SHORT).select("token", F.col("node").alias("a"), F.col("comp").alias("comp_a"))
    short = short.join(rest.select("token", F.col("node").alias("b"), F.col("comp").alias("comp_b")), "token").where("a < b AND comp_a <> comp_b").select("a", "b").distinct()
    short = alike(short, least)
    blocks = F.ceil(F.col("g") / BLOCK).cast("int")
    long = rest.where(F.col("g") > SHORT).withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = long.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "comp").join(nodes.drop("first"), "node").join(texts, "node")
    add(confirmed(short, texts, percent).union(_cross_links(cells, least, percent)))

    groups = reps.select("class", "node", F.col("first.doc_id").alias("first")).join(comps, "node", "left").select("class", "first", F.coalesce("comp", "node").alias("group"))
    least_id = groups.groupBy("group").agg(F.min("first").alias("component_id"))
    out = base.drop("sig").join(groups.join(least_id, "group").drop("first"), "class", "left")
    smallest = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    group = F.when(F.col("doc_id").isNotNull(), F.col("group")).alias("group")
    return out.select("doc_id", "digest", "n_shingles", group, smallest.alias("component_id"), F.coalesce(F.col("doc_id") == smallest, F.lit(True)).alias("kept"))


def unique(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group, with all its columns: that of the smallest doc_id. Rows without doc_id stay.

    Rows that go are told by doc_id and a digest of the text, so texts are not shuffled where their ids are few enough
    to be broadcast. Among rows of a group that share its smallest doc_id the least digest stays, then one of the rest."""
    rows = written(_grouped(docs, percent), "minhash-rows")
    again = rows.where("kept AND group IS NOT NULL").groupBy("group").agg(F.count("*").alias("n"), F.min("digest").alias("least")).where("n > 1")
    again = rows.where("kept").join(again, "group").select("doc_id", "digest", (F.col("digest") == F.col("least")).alias("stays")).distinct()
    again = written(again, "minhash-again")
    gone = rows.where("NOT kept").select("doc_id", "digest").union(again.where("NOT stays").select("doc_id", "digest")).distinct()
    packed = docs.select("doc_id", _digest(), F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"))
    left = packed.join(_small(written(gone, "minhash-gone")), ["doc_id", "digest"], "left_anti")
    twice = _small(again.where("stays").select("doc_id", "digest"))
    order = Window.partitionBy("doc_id", "digest").orderBy(F.xxhash64(F.to_json("row")))
    one = left.join(twice, ["doc_id", "digest"], "left_semi").withColumn("at", F.row_number().over(order)).where("at = 1")
    return left.join(twice, ["doc_id", "digest"], "left_anti").select("row.*").union(one.select("row.*"))


def _small(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST else ids
