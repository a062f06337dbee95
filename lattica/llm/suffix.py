"""Exact removal of long repeated substrings with difference-cover suffix sorting.

Distribution: every string of LENGTH bytes has a content anchor, the least hash among its GRAM-byte substrings. Equal
strings have equal anchors, so a string whose anchor occurs once in the corpus can't repeat; the others, with the bytes
around them, are dealt out by anchor, and each shard holds whole groups. Within a shard the suffixes are sorted by the
difference cover {1, 2} modulo 3: sort the sampled triples, name them, recurse on the names, sort the remaining
suffixes by a byte and a rank, merge. Neighbours in the order that agree in LENGTH bytes repeat. Groups beyond HOT members (very common passages) are not brought together: their
128-bit hashes are counted with partial aggregation instead, first of cells of neighbouring strings, then of the strings
of those cells that agree in part.

Sorting the suffixes of the whole corpus in one order, three numbers a byte and round, would shuffle many times the
input; anchors leave the same answer on the few bytes that can matter.

Texts that are equal as a whole are handled once: with LENGTH bytes or more all copies go entirely.

Strings are of bytes; a passage of over 50 words may have fewer than LENGTH bytes, and stays. So that such passages can
be told, the same sort runs over the words of each text (64-bit codes), with strings of PASSAGE words: their number and
the words that they cover are reported beside what is removed.

Defined results: matches never cross documents; null text counts as empty; shorter texts lose nothing; strings that
overlap themselves count; rows that repeat are copies; doc_id may be null or repeated; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import written

#: Bytes of a string and of what anchors it; words of a passage and of what anchors it.
LENGTH, GRAM = 400, 64
PASSAGE, WORDS_GRAM = 51, 8
BYTES, WORDS = 0, 1
#: Members of a group that may meet in a task; bytes of a shard.
HOT, SHARD = 2_000, 1_200_000
#: Neighbouring strings of a hot group that are compared at once, of bytes and of words.
CELLS = (16, 8)

_rng = np.random.default_rng(23)
_BYTE = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64)
_BASE = _rng.integers(1, 1 << 63, 2, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the words (between ASCII white space) of UTF-8 bytes, sums of byte codes times powers of a base; first
    byte and one past the last of each."""
    inside = np.concatenate([[False], ~_BLANK[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    first, end = edge[::2], edge[1::2]
    if len(_powers[0]) <= len(raw):
        for k, base in enumerate((_BASE[0], _INVERSE)):
            _powers[k] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * len(raw) + 1, base)]))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_BYTE[0][raw] * _powers[0][: len(raw)], dtype=np.uint64)])
    code = (sums[end] - sums[first]) * _powers[1][first]
    code ^= code >> np.uint64(29)
    return code * _MIX, first, end


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_INVERSE = np.uint64(pow(int(_BASE[0]), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def rolling(x: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Polynomial hashes of all substrings of so many letters, by doubling."""
    power = h = None
    size, done = 1, 0
    step, base = _BYTE[which][x] if x.dtype == np.uint8 else x * _BYTE[which, 0], _BASE[which : which + 1].copy()
    while True:
        if length & size:
            if h is None:
                h, power = step, base.copy()
            else:
                n = len(x) - done - size + 1
                h = h[:n] * base + step[done : done + n]
                power = power * base
            done += size
        size *= 2
        if size > length:
            return h
        n = len(step) - size // 2
        step = step[:n] * base + step[size // 2 : size // 2 + n]
        base = base * base


def spans(x: np.ndarray, i: np.ndarray, j: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial hashes of the letters i to j - 1 of x, of any lengths."""
    if which not in _tables or len(_tables[which][0]) <= len(x):
        base = _BASE[which]
        _tables[which] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(2 * len(x) + 1, b)])) for b in (base, np.uint64(pow(int(base), -1, 1 << 64)))]
    powers, inverse = _tables[which]
    step = _BYTE[which][x] if x.dtype == np.uint8 else x * _BYTE[which, 0]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(step * powers[: len(x)], dtype=np.uint64)])
    return (sums[j] - sums[i]) * inverse[i]


_tables: dict[int, list[np.ndarray]] = {}


def sliding_minimum(a: np.ndarray, w: int) -> np.ndarray:
    size = 1
    while size * 2 <= w:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (w - size)], a[w - size :]) if size < w else a


def _grams(x: np.ndarray, gram: int) -> np.ndarray:
    h = rolling(x, gram) * _MIX
    h ^= h >> np.uint64(31)
    return h * _MIX


def anchors(x: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the strings of so many letters: anchor, first start, number of starts in a row, and occurrences of the anchor among them."""
    if len(x) < length:
        return (np.zeros(0, np.int64),) * 4
    h = _grams(x, gram)
    w = length - gram + 1
    m = sliding_minimum(h, w)
    first = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
    size = np.diff(np.append(first, len(m)))
    reach = size + w - 1
    begin = np.cumsum(reach) - reach
    same = h[np.repeat(first - begin, reach) + np.arange(reach.sum())] == np.repeat(m[first], reach)
    return m[first].view(np.int64), first, size, np.add.reduceat(same, begin, dtype=np.int64)


def _ranks(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the triples (of equal ones any, which is faster), and names from 1 by that order; equal triples have equal names."""
    if max(a.max(initial=0), b.max(initial=0), c.max(initial=0)) < 1 << 21:
        key = a << 42 | b << 21 | c
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
    else:
        order = np.lexsort((c, b, a))
        a, b, c = a[order], b[order], c[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (c[1:] != c[:-1])])
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return order, names


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number that orders as the pair; b below 2**31, a below 2**31."""
    return a << 31 | b


def suffix_order(s: np.ndarray) -> np.ndarray:
    """Starts of all suffixes of the positive integers s, in order."""
    n = len(s)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), dtype=np.int64)
    t = np.concatenate([s, np.zeros(3, np.int64)])
    one, two = np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)
    sample = np.concatenate([one, two])
    order, names = _ranks(t[sample], t[sample + 1], t[sample + 2])
    if names[order[-1]] < len(sample):
        order = suffix_order(names)
        names = np.empty(len(sample), np.int64)
        names[order] = np.arange(1, len(sample) + 1)
    rank = np.zeros(n + 4, np.int64)
    rank[sample] = names
    sorted_sample = sample[order]
    sorted_sample = sorted_sample[sorted_sample < n]
    zero = np.arange(0, n, 3)
    zero = zero[np.argsort(_pair(t[zero], rank[zero + 1]))]
    # Merge: how many sampled suffixes come before each of the rest.
    of_one, of_two = sorted_sample[sorted_sample % 3 == 1], sorted_sample[sorted_sample % 3 == 2]
    before = np.searchsorted(_pair(t[of_one], rank[of_one + 1]), _pair(t[zero], rank[zero + 1]))
    if t.max(initial=0) < 1 << 20 and rank.max() < 1 << 22:
        triple = lambda i: t[i] << 42 | t[i + 1] << 22 | rank[i + 2]
        before = before + np.searchsorted(triple(of_two), triple(zero))
    else:
        _, both = _ranks(*(np.concatenate([x(of_two), x(zero)]) for x in (lambda i: t[i], lambda i: t[i + 1], lambda i: rank[i + 2])))
        before = before + np.searchsorted(both[: len(of_two)], both[len(of_two) :])
    out = np.full(n, -1, np.int64)
    out[np.arange(len(zero)) + before] = zero
    out[out < 0] = sorted_sample
    return out


def repeated_starts(pieces: list[bytes], starts: np.ndarray, length: int = LENGTH, unit: int = BYTES) -> np.ndarray:
    """pieces side by side; piece k has starts[k] strings. Marks, of all their letters, where a string begins that occurs again."""
    x = _letters(b"".join(pieces) if unit == BYTES else b"\n".join(pieces), unit)
    size = starts + length - 1
    begin = np.cumsum(size) - size
    valid = np.zeros(len(x), bool)
    valid[np.repeat(begin - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())] = True
    order = suffix_order((x if unit == BYTES else np.unique(x, return_inverse=True)[1]).astype(np.int64) + 1)
    order = order[valid[order]]
    equal = np.ones(max(0, len(order) - 1), bool)
    for which in (0, 1):
        h = rolling(x, length, which)[order]
        equal &= h[1:] == h[:-1]
    out = np.zeros(len(x), bool)
    out[order[1:][equal]] = True
    out[order[:-1][equal]] = True
    return out


def _letters(piece: bytes, unit: int) -> np.ndarray:
    x = np.frombuffer(piece, np.uint8)
    return x if unit == BYTES else _words(x)[0]


def _runs(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return edge[::2], edge[1::2]


def covered(runs: list[tuple[int, int]], n: int) -> np.ndarray:
    change = np.zeros(n + 1, np.int64)
    for a, b in runs:
        change[a] += 1
        change[b] -= 1
    return np.cumsum(change[:-1]) > 0


def _described(docs: DataFrame, length: int, passage: int) -> DataFrame:
    """doc_id, class, n_bytes, n_words, sha (of the whole text), and the anchors of each row."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    fields = ("unit", "fp", "start", "starts", "times")
    kind = f"doc_id {doc_id}, class binary, n_bytes bigint, n_words bigint, sha string, anchors array<struct<{', '.join(f + ': bigint' for f in fields)}>>"
    item = pa.struct([(f, pa.int64()) for f in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2_000):
                batch = whole.slice(i, 2_000)
                n, words, sha, offsets, parts = [], [], [], [0], []
                for text in batch.column(2).to_pylist():
                    raw = np.frombuffer(text.encode(), np.uint8)
                    codes = _words(raw)[0]
                    n.append(len(raw))
                    words.append(len(codes))
                    sha.append(hashlib.sha256(raw).hexdigest())
                    for unit, found in ((BYTES, anchors(raw, length)), (WORDS, anchors(codes, passage, min(WORDS_GRAM, passage)))):
                        parts.append((np.full(len(found[0]), unit), *found))
                    offsets.append(offsets[-1] + len(parts[-1][0]) + len(parts[-2][0]))
                columns = [pa.array(np.concatenate([p[k] for p in parts])) for k in range(5)] if parts else [pa.array([], pa.int64())] * 5
                items = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(item)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(words, pa.int64()), pa.array(sha), items], names=["doc_id", "class", "n_bytes", "n_words", "sha", "anchors"])

    return _classed(docs).select("doc_id", "class", "text").mapInArrow(run, kind)


def _classed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("class"), text.alias("text"))


_PIECE = "class binary, unit bigint, fp bigint, start bigint, starts bigint, piece binary"


def _pieces(texts: DataFrame, lengths: tuple[int, int], hot: bool) -> DataFrame:
    """class, unit, fp, start, starts, piece of the anchors of groups that are hot or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 500):
                batch = whole.slice(i, 500).to_pydict()
                out: dict[str, list] = {"class": [], "unit": [], "fp": [], "start": [], "starts": [], "piece": []}
                for key, text, found in zip(batch["class"], batch["text"], batch["found"]):
                    raw = text.encode()
                    first = end = None
                    for a in found:
                        unit, i, j = a["unit"], a["start"], a["start"] + a["starts"] + lengths[a["unit"]] - 1
                        if unit == WORDS:
                            if first is None:
                                _, first, end = _words(np.frombuffer(raw, np.uint8))
                            i, j = int(first[i]), int(end[j - 1])
                        for k, v in zip(out, (key, unit, a["fp"], a["start"], a["starts"], raw[i:j])):
                            out[k].append(v)
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("class", pa.binary()), *[(c, pa.int64()) for c in ("unit", "fp", "start", "starts")], ("piece", pa.binary())]))

    wanted = F.filter("found", lambda x: x["members"] > HOT if hot else x["members"] <= HOT)
    return texts.select("class", "text", wanted.alias("found")).where(F.size("found") > 0).mapInArrow(run, _PIECE)


_RUN = "class binary, unit bigint, a bigint, b bigint"


def _sorted_runs(pieces: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """class, unit, a, b: letters a to b - 1 are covered by strings that repeat within their group."""
    schema = pa.schema([("class", pa.binary()), ("unit", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        unit = rows[0][1]
        starts = np.array([r[4] for r in rows])
        size = starts + lengths[unit] - 1
        a, b = _runs(repeated_starts([r[5] for r in rows], starts, lengths[unit], unit))
        begin = np.cumsum(size) - size
        k = np.searchsorted(begin, a, side="right") - 1
        shift = np.array([r[3] for r in rows])[k] - begin[k]
        return pa.RecordBatch.from_arrays([pa.array([rows[i][0] for i in k], pa.binary()), pa.array(np.full(len(a), unit), pa.int64()), pa.array(a + shift), pa.array(b + shift + lengths[unit] - 1)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for whole in batches:
            for i in range(0, whole.num_rows, 1_000):
                for row in zip(*whole.slice(i, 1_000).to_pydict().values()):
                    if rows and (row[1] != rows[-1][1] or held > SHARD and row[2] != rows[-1][2]):
                        yield shard(rows)
                        rows, held = [], 0
                    rows.append(row)
                    held += len(row[5])
        if rows:
            yield shard(rows)

    return pieces.repartition("fp").sortWithinPartitions("unit", "fp").mapInArrow(run, _RUN)


_NODE = "class binary, unit bigint, fp bigint, a bigint, n bigint, c bigint, d bigint, h bigint, g bigint, piece binary"


def _nodes(pieces: DataFrame, lengths: tuple[int, int], fine: bool) -> DataFrame:
    """The strings of each piece in cells: n strings from a on that have the anchor CELLS to CELLS places after their start
    (fine: one string each). c and d are hashes of what all strings of the whole cell hold, h and g of all letters of these
    strings, which piece has. Cells that repeat within a piece are one row, and a row without hashes for each run of them."""

    def cells(key: bytes, unit: int, fp: int, start: int, starts: int, piece: bytes) -> tuple:
        length, gram = lengths[unit], GRAM if unit == BYTES else min(WORDS_GRAM, lengths[WORDS])
        size = 1 if fine else min(CELLS[unit], length)
        raw = np.frombuffer(piece, np.uint8)
        x, first, end = (raw, np.arange(len(raw)), np.arange(1, len(raw) + 1)) if unit == BYTES else _words(raw)
        at = np.arange(starts)
        there = np.flatnonzero(_grams(x, gram).view(np.int64) == fp)
        anchor = there[np.searchsorted(there, at)]
        cell = (anchor - at) // size
        a = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (cell[1:] != cell[:-1])]))
        n = np.diff(np.append(a, starts))
        low = anchor[a] - cell[a] * size
        h, g = (spans(x, a, a + n - 1 + length, which) for which in (0, 1))
        _, one, same, times = np.unique(np.stack([n.astype(np.uint64), h, g]), axis=1, return_index=True, return_inverse=True, return_counts=True)
        mark = np.zeros(starts, bool)
        mark[np.repeat(times[same.ravel()] > 1, n)] = True
        runs = _runs(mark)
        a, n, low, h, g = a[one], n[one], low[one], h[one], g[one]
        c, d = (spans(x, low, low + length - size + 1, which) for which in (0, 1))
        return (key, unit, fp), np.concatenate([a, runs[0]]) + start, np.concatenate([n, runs[1] - runs[0]]), (c, d, h, g), [piece[i:j] for i, j in zip(first[a].tolist(), end[a + n - 2 + length].tolist())], len(runs[0])

    def out(found: list[tuple]) -> pa.RecordBatch:
        rows = [len(f[1]) for f in found]
        columns = [pa.array([f[0][0] for f, k in zip(found, rows) for _ in range(k)], pa.binary()), *[pa.array(np.repeat([f[0][i] for f in found], rows), pa.int64()) for i in (1, 2)], *[pa.array(np.concatenate([f[i] for f in found])) for i in (1, 2)]]
        none = np.concatenate([np.arange(k) >= len(f[4]) for f, k in zip(found, rows)])
        columns += [pa.array(np.concatenate([x for f in found for x in (f[3][i].view(np.int64), np.zeros(f[5], np.int64))]), mask=none) for i in range(4)]
        columns.append(pa.array([x for f in found for x in [*f[4], *[None] * f[5]]], pa.binary()))
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _NODE.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        held = 0
        for whole in batches:
            for i in range(0, whole.num_rows, 1_000):
                for row in zip(*whole.slice(i, 1_000).to_pydict().values()):
                    found.append(cells(*row))
                    held += sum(map(len, found[-1][4]))
                    if held > SHARD:
                        yield out(found)
                        found, held = [], 0
        if found:
            yield out(found)

    return pieces.mapInArrow(run, _NODE)


def _counted_runs(pieces: DataFrame, lengths: tuple[int, int]) -> DataFrame:
    """The same for groups of any size, by counting hashes of cells. Equal cells repeat with all their strings. Of each kind
    of cell one goes on, and only where another kind shares what all strings of the cell hold; its strings are counted one
    by one. Equal strings have their anchor at one place, so they are in cells of one place."""
    key, runs = ["unit", "n", "h", "g"], None
    length = F.when(F.col("unit") == BYTES, lengths[BYTES]).otherwise(lengths[WORDS])
    for fine in (False, True):
        nodes = written(_nodes(pieces, lengths, fine), "suffix-nodes", "zstd")
        kinds = nodes.where(F.col("h").isNotNull()).groupBy(*key)
        again = kinds.agg(F.count("*").alias("times")).where("times > 1").drop("times")
        found = nodes.where(F.col("h").isNull()).select("class", "unit", "a", "n").union(nodes.join(again, key).select("class", "unit", "a", "n"))
        found = found.select("class", "unit", "a", (F.col("a") + F.col("n") - 1 + length).alias("b"))
        runs = found if runs is None else runs.union(found)
        if not fine:
            kinds = kinds.agg(F.any_value(F.struct("class", "fp", "a", "c", "d", "piece")).alias("one")).select("unit", "n", "one.*")
            shared = kinds.groupBy("unit", "c", "d").agg(F.count("*").alias("kinds")).where("kinds > 1").drop("kinds")
            pieces = kinds.join(shared, ["unit", "c", "d"]).select("class", "unit", "fp", F.col("a").alias("start"), F.col("n").alias("starts"), "piece")
    return runs


def _kept(rows: DataFrame) -> DataFrame:
    """class, n_removed, n_spans, n_repeated_words, n_passages, kept_sha256, kept from rows (class, text, runs)."""
    counts = ("n_removed", "n_spans", "n_repeated_words", "n_passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"class": [], **{c: [] for c in counts}, "kept_sha256": [], "kept": []}
            for key, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = np.frombuffer(text.encode(), np.uint8)
                gone = covered([(r["a"], r["b"]) for r in runs if r["unit"] == BYTES], len(raw))
                of_words = [(r["a"], r["b"]) for r in runs if r["unit"] == WORDS]
                words = covered(of_words, max((b for _, b in of_words), default=0))
                left = raw[~gone].tobytes()
                for k, v in zip(out, (key, int(gone.sum()), len(_runs(gone)[0]), int(words.sum()), len(_runs(words)[0]), hashlib.sha256(left).hexdigest(), left)):
                    out[k].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("class", pa.binary()), *[(c, pa.int64()) for c in counts], ("kept_sha256", pa.string()), ("kept", pa.binary())]))

    return rows.select("class", "text", "runs").mapInArrow(run, f"class binary, {', '.join(c + ' bigint' for c in counts)}, kept_sha256 string, kept binary")


def deduplicated(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (what remains, where some but not all of a text is removed),
    n_repeated_words, n_passages (of strings of so many words that start anywhere else, too)."""
    lengths = (length, passage)
    base = written(_described(docs, length, passage), "suffix-base", "zstd")
    long = base.where((F.col("n_bytes") >= length) | (F.col("n_words") >= passage))
    copies = long.groupBy("class").agg(F.count("*").alias("copies"))
    distinct = long.select("class", "anchors").dropDuplicates(["class"])
    found = distinct.select("class", F.inline("anchors"))
    groups = found.groupBy("unit", "fp").agg(F.sum("times").alias("times"), F.count("*").alias("members")).where("times > 1").drop("times")
    per_class = found.join(groups, ["unit", "fp"]).groupBy("class").agg(F.collect_list(F.struct("unit", "fp", "start", "starts", "members")).alias("found"))
    texts = written(_classed(docs).select("class", "text").join(per_class, "class").dropDuplicates(["class"]), "suffix-texts", "zstd")

    runs = _sorted_runs(_pieces(texts, lengths, hot=False), lengths)
    # Asked of the written table: the groups aren't counted anew.
    if not texts.where(F.exists("found", lambda x: x["members"] > HOT)).isEmpty():
        runs = runs.union(_counted_runs(_pieces(texts, lengths, hot=True), lengths))
    per_class = runs.groupBy("class").agg(F.collect_set(F.struct("unit", "a", "b")).alias("runs"))
    kept = _kept(texts.select("class", "text").join(per_class, "class"))

    several = F.coalesce(F.col("copies") > 1, F.lit(False))
    whole, all_words = several & (F.col("n_bytes") >= length), several & (F.col("n_words") >= passage)
    none = F.lit(hashlib.sha256(b"").hexdigest())
    out = base.drop("anchors").join(copies, "class", "left").join(kept, "class", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(zero("n_removed")).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(zero("n_spans")).cast("bigint").alias("n_spans"),
        F.when(whole, none).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(~whole, F.col("kept")).alias("kept"),
        F.when(all_words, F.col("n_words")).otherwise(zero("n_repeated_words")).alias("n_repeated_words"),
        F.when(all_words, F.lit(1)).otherwise(zero("n_passages")).cast("bigint").alias("n_passages"),
    )
