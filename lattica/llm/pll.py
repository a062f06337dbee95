"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides.

Tokens are lower-case words and runs of symbols; their counts are taken over all documents. Words form groups by their
last two characters. In each group the most frequent words are leaves of their own and one leaf stands for the rest; the
number of groups, and of leaves in a group, is GROWTH times the fourth root of the number of distinct words, so what is
predicted grows with the input. The network sees the classes of WINDOW tokens to the left and to the right (never the
token itself): the OWN most frequent words, and SHARED classes for the others. It adds one learned vector for each place
and class, passes tanh units to a softmax over the groups, and to one over the leaves of the token's group. A word's
conditional probability is the product of the two, and for words of a rest its share of it by the counts of all documents.

Training is in numpy: in each round every partition starts from the shared parameters, learns from one in ROUNDS of all
its tokens (over all rounds from each token once), and the parameters are averaged by the number of tokens. Which tokens
meet in a partition is part of the result: another partitioning of the input gives slightly other parameters.

Defined results: null, empty or blank texts have no tokens, score 0 and mean 0; a token at an edge sees the padding
class; repeated rows give repeated results; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import written

#: Context classes of single words, and shared ones; words whose shares every worker holds (those of others are joined).
OWN, SHARED, KEPT = 191, 64, 100_000
CLASSES = OWN + SHARED
#: Groups, and leaves of each: GROWTH * words ** 0.25, LEAST at least.
GROWTH, LEAST = 3, 8
WINDOW, UNITS, ROUNDS, RATE, BATCH = 2, 24, 2, 0.2, 16_384
#: Distinct words that a task counts before it hands them on; words a worker remembers; tokens scored at once; tokens
#: whose windows are laid out at once.
COUNTING, CACHE, AT_ONCE, LAID = 300_000, 500_000, 65_536, 400_000
#: Rows of logits that are held at once, so that they stay in a core's cache.
BLOCK = 512
#: Parameters that travel as one value.
PIECE = 8_192
#: Bytes of texts that are cut into tokens at once (one text at least).
SLICE = 8_000_000
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_TOKEN_OR_BREAK = re.compile(r"\w+|[^\w\s]+|\n")


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


class Tokens:
    """The tokens of texts. Arrow cuts the texts at ASCII white space and numbers the different pieces; only these are cut
    into tokens, all by one search with a line break before each piece (none is inside). ``words`` are the different tokens."""

    def __init__(self, texts: list[str | None]):
        split = pc.ascii_split_whitespace(pa.array([(t or "").lower() for t in texts], pa.string()))
        pieces = split.flatten().dictionary_encode()
        self.piece, self.ends = pieces.indices.to_numpy(), split.offsets.to_numpy()
        several = pa.ListArray.from_arrays(pa.array([0, len(pieces.dictionary)], pa.int32()), pieces.dictionary)
        found = pa.array(_TOKEN_OR_BREAK.findall("\n" + pc.binary_join(several, "\n")[0].as_py()), pa.string()).dictionary_encode()
        # The line break comes first, so its number is 0.
        self.words, found = found.dictionary[1:], found.indices.to_numpy()
        breaks = np.flatnonzero(found == 0)
        #: Tokens of the different pieces; of each piece, where they begin there, and how many they are.
        self.inside = found[found != 0] - 1
        self.first = breaks - np.arange(len(breaks))
        self.number = np.diff(breaks, append=len(found)) - 1

    def counts(self) -> np.ndarray:
        """Of each word, how often it stands in the texts."""
        times = np.bincount(self.piece, minlength=len(self.number))
        return np.bincount(self.inside, np.repeat(times, self.number), len(self.words)).astype(np.int64)

    def in_order(self) -> tuple[np.ndarray, np.ndarray]:
        """All tokens, as places in ``words``, and where the tokens of each text begin, and at last where they end."""
        number = self.number[self.piece]
        upto = np.concatenate([[0], np.cumsum(number)])
        at = np.repeat(self.first[self.piece] - upto[:-1], number)
        at += np.arange(len(at))
        return self.inside[at], upto[self.ends]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    upto, i = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))]), 0
    while i < batch.num_rows:
        to = max(i + 1, int(np.searchsorted(upto, upto[i] + SLICE, "right")) - 1)
        yield batch.slice(i, to - i)
        i = to


def _added(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by("word", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"word": found["word"], "n": found["n_sum"]})


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents; each task counts before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            for part in _slices(batch, 0):
                tokens = Tokens(part.column(0).to_pylist())
                held.append(pa.table({"word": tokens.words, "n": tokens.counts()}))
                rows += len(tokens.words)
                if rows > 2 * COUNTING:
                    held = [_added(held)]
                    rows = len(held[0])
                if rows > COUNTING and len(held) == 1:
                    yield from held.pop().to_batches()
                    rows = 0
        if held:
            yield from _added(held).to_batches()

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def ending(word: str) -> int:
    return zlib.crc32(word[-2:].encode())


def _ending() -> Column:
    return F.crc32(F.right("word", F.lit(2)).cast("binary"))


class Shape(NamedTuple):
    """What the network needs of a vocabulary: the counts of the leaves, the classes they are seen as, the padding."""

    count: np.ndarray
    seen_as: np.ndarray
    pad: int


class Vocabulary(dict):
    """Word to its number, filled as words are met. By number, ``leaf`` has its leaf (group * side + place) and ``within``
    the log of its share of a rest, 0 for leaves of their own. Words that aren't among the frequent ones have the number
    of their group's rest, from ``met`` on, and the log of their share less that of their count, which is joined."""

    def __init__(self, side: int, own: list[tuple[str, int]], rest: list[int], frequent: list[tuple[str, int]]):
        """own: words that are leaves and their counts, most frequent first. rest: each group's sum of the other counts.
        frequent: other words and counts."""
        super().__init__()
        self.side, self.own, self.rest, self.frequent = side, own, rest, frequent
        self.known = {word: k for k, (word, _) in enumerate([*own, *frequent])}
        self.met, self.listed = len(self.known), None
        self.leaf, self.within = np.zeros(self.met + side, np.int32), np.zeros(self.met + side)
        self.leaf[self.met :] = np.arange(1, side + 1) * side - 1
        self.within[self.met :] = -np.log(np.maximum(rest, 1))
        self.count = np.zeros((side, side))
        self.count[:, -1] = rest
        #: Of each leaf, and of the padding, the class that the network sees.
        self.seen_as = np.append(OWN + np.repeat(np.arange(side), side) % SHARED, CLASSES).astype(np.uint8)
        places: Counter[int] = Counter()
        for i, (word, n) in enumerate(own):
            g = ending(word) % side
            self.leaf[i] = g * side + places[g]
            self.count[g, places[g]] = n
            if i < OWN:
                self.seen_as[g * side + places[g]] = i
            places[g] += 1
        for k, (word, n) in enumerate(frequent, len(own)):
            g = ending(word) % side
            self.leaf[k], self.within[k] = g * side + side - 1, math.log(n / rest[g])

    @property
    def pad(self) -> int:
        return self.side * self.side

    def shape(self) -> Shape:
        return Shape(self.count, self.seen_as, self.pad)

    def __reduce__(self):
        return Vocabulary, (self.side, self.own, self.rest, self.frequent)

    def __missing__(self, word: str) -> int:
        if (found := self.known.get(word)) is None:
            found = self.met + ending(word) % self.side
        self[word] = found
        return found

    def read(self, tokens: list[str]) -> tuple[bytes, float, Counter[str]]:
        """The leaves of tokens (32 bits each), the sum of what ``within`` has of them, and the counts of the words that
        aren't frequent."""
        if len(self) > CACHE:
            self.clear()
        numbers = np.fromiter(map(self.__getitem__, tokens), np.int32, len(tokens))
        return self.leaf[numbers].tobytes(), float(self.within[numbers].sum()), Counter([tokens[i] for i in np.flatnonzero(numbers >= self.met).tolist()])

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The numbers of different words."""
        if self.listed is None:
            self.listed = pa.array(self.known, pa.string())
        found = pc.fill_null(pc.index_in(words, self.listed), -1).to_numpy(zero_copy_only=False).copy()
        other = np.flatnonzero(found < 0)
        ends = pc.utf8_slice_codeunits(words.take(pa.array(other)), -2).dictionary_encode()
        of = np.array([self.met + ending(end) % self.side for end in ends.dictionary.to_pylist()], np.int32)
        found[other] = of[ends.indices.to_numpy()]
        return found

    def read_all(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray, pa.Array, pa.Array]:
        """The same of the tokens of many texts, with the other words and their counts as lists."""
        tokens = Tokens(texts)
        numbers = self.numbers(tokens.words)
        found, upto = tokens.in_order()
        text = np.repeat(np.arange(len(texts)), np.diff(upto))
        leaves = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * upto).astype(np.int32)), pa.py_buffer(self.leaf[numbers][found])])
        within = np.bincount(text, self.within[numbers][found], len(texts))
        other = np.flatnonzero((numbers >= self.met)[found])
        key, times = np.unique(text[other] * len(numbers) + found[other], return_counts=True)
        of, word = np.divmod(key, max(1, len(numbers)))
        upto = pa.array(np.searchsorted(of, np.arange(len(texts) + 1)), pa.int32())
        return leaves, within, pa.ListArray.from_arrays(upto, tokens.words.take(pa.array(word))), pa.ListArray.from_arrays(upto, pa.array(times, pa.int64()))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the counts of all words: the leaves, the shares of the KEPT most frequent other words, and the rests."""
    side = max(LEAST, math.ceil(GROWTH * counts.count() ** 0.25))
    grouped = counts.withColumn("g", (_ending() % side).cast("int"))
    rank = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "word"))
    own = [(r.word, r.n) for r in grouped.withColumn("rank", rank).where(F.col("rank") < side).orderBy(F.desc("n"), "word").collect()]
    rest = [0] * side
    for r in grouped.groupBy("g").agg(F.sum("n").alias("n")).collect():
        rest[r.g] = r.n
    leaves = set()
    for word, n in own:
        rest[ending(word) % side] -= n
        leaves.add(word)
    frequent = [(r.word, r.n) for r in counts.orderBy(F.desc("n"), "word").limit(KEPT).collect() if r.word not in leaves] if KEPT else []
    return Vocabulary(side, own, rest, frequent)


def as_leaves(docs: DataFrame, words: Vocabulary) -> DataFrame:
    """doc_id, id (of the row), leaves (32 bits for each token), within (sum of the logs of the tokens' shares, less those of
    the counts of the words that follow), words and times (words that aren't frequent, and how often they stand in the text)."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in _slices(whole, 1):
                leaves, within, others, times = words.read_all(batch.column(1).to_pylist())
                ids = pa.array(np.arange(first, first + len(leaves)), pa.int64())
                first += len(leaves)
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "id": ids, "leaves": leaves, "within": pa.array(within, pa.float64()), "words": others, "times": times})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, id bigint, leaves binary, within double, words array<string>, times array<bigint>")


def with_shares(leaves: DataFrame, counts: DataFrame, words: Vocabulary, rows: DataFrame | None = None) -> DataFrame:
    """rows (of doc_id, id, within; those of leaves if None) without id, where within has the counts of the words that
    aren't frequent, too."""
    rows = leaves.drop("words", "times") if rows is None else rows
    # The log of the count of a word that occurs once is 0, and no word that is joined is more frequent than the frequent ones.
    most = words.frequent[-1][1] if words.frequent else 2**63 - 1
    logs = counts.where(F.col("n").between(2, most)).select("word", F.log("n").alias("log"))
    met = leaves.select("id", F.inline(F.arrays_zip("words", "times"))).toDF("id", "word", "times")
    sums = met.join(logs, "word").groupBy("id").agg(F.sum(F.col("times") * F.col("log")).alias("rest"))
    return rows.join(sums, "id", "left").withColumn("within", F.col("within") + F.coalesce("rest", F.lit(0.0))).drop("id", "rest")


def _softmax(h: np.ndarray, weights: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """h: rows of units and a 1; at: each row's target. What the loss of the softmax gives back to the units, and the
    gradient of the weights without the targets' own part (less h, added up by target). Probabilities are never laid out:
    a column of ones among the weights gives their sums, and the units are divided instead.
    Units lie between -1 and 1 and weights are moderate, so exponentials stay far from the limits of 32 bits."""
    through = np.ones(weights.shape[::-1], np.float32)
    through[:, :-1] = weights[:-1].T
    z = h @ weights
    np.exp(z, out=z)
    back = z @ through
    inverse = 1 / back[:, -1:]
    back *= inverse
    back -= np.take(through, at, 0)
    return back, (h * inverse).T @ z


def _picked(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of rows of logits, the log-probability of one place each."""
    out = z[np.arange(len(at)), at]
    np.exp(z, out=z)
    return out - np.log(z @ np.ones(z.shape[1], np.float32))


def _first(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, int)


class Network:
    def __init__(self, count: np.ndarray, seed: int = 5):
        """count: of each leaf, a row for each group."""
        rng = np.random.default_rng(seed)
        side, of_group = len(count), count.sum(1)
        self.side = side
        self.places = (rng.normal(size=(2 * WINDOW, CLASSES + 1, UNITS)) * 0.3).astype(np.float32)
        self.hidden = np.zeros(UNITS, np.float32)
        # The last row of a softmax's weights is its bias.
        bias = np.log((of_group + 1) / (of_group.sum() + side))
        self.out = np.vstack([rng.normal(size=(UNITS, side)) * 0.05, bias]).astype(np.float32)
        bias = np.log((count + 0.01) / (of_group[:, None] + 0.01 * side))
        self.leaf = np.concatenate([rng.normal(size=(side, UNITS, side)) * 0.05, bias[:, None]], 1).astype(np.float32)
        self.squares = [np.full_like(p, 1e-2) for p in self.parameters()]

    def parameters(self) -> list[np.ndarray]:
        return [self.places, self.hidden, self.out, self.leaf]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parameters()])

    def set_flat(self, values: np.ndarray) -> None:
        i = 0
        for p in self.parameters():
            p[...] = values[i : i + p.size].reshape(p.shape)
            i += p.size

    def units(self, context: np.ndarray) -> np.ndarray:
        """tanh units of each context, and a 1 for the biases."""
        h = np.ones((context.shape[1], UNITS + 1), np.float32)
        for a in range(0, len(h), BLOCK):
            c = context[:, a : a + BLOCK].astype(np.intp)
            x = np.take(self.places[0], c[0], 0)
            for k in range(1, 2 * WINDOW):
                x += np.take(self.places[k], c[k], 0)
            x += self.hidden
            np.tanh(x, out=h[a : a + BLOCK, :UNITS])
        return h

    def _by_group(self, context: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        """The order by target; contexts, groups and places in it; first and one past the last of each group that occurs."""
        # Sorting is by radix where targets fit in 16 bits.
        order = np.argsort(target.astype(np.uint16) if self.side <= 256 else target, kind="stable")
        g, m = np.divmod(np.take(target, order), self.side)
        first = _first(g)
        return order, np.take(context, order, 1), g, m, list(zip(g[first].tolist(), first.tolist(), np.append(first[1:], len(g)).tolist()))

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """context: a row of classes for each place around the target; target: leaves."""
        order, context, g, m, runs = self._by_group(context, target)
        h = self.units(context)
        found = np.concatenate([_picked(h[a : a + BLOCK] @ self.out, g[a : a + BLOCK]) for a in range(0, max(1, len(h)), BLOCK)])
        for k, a, b in runs:
            found[a:b] += _picked(h[a:b] @ self.leaf[k], m[a:b])
        out = np.empty_like(found)
        out[order] = found
        return out

    def _step(self, parameter: np.ndarray, g: np.ndarray, squares: np.ndarray) -> None:
        squares += g * g
        parameter -= RATE * g / np.sqrt(squares)

    def learn(self, contexts: np.ndarray, targets: np.ndarray) -> None:
        """One pass of AdaGrad over the windows, in the order given."""
        for i in range(0, len(targets), BATCH):
            _, c, y, m, runs = self._by_group(contexts[:, i : i + BATCH], targets[i : i + BATCH])
            scale = np.float32(1 / math.sqrt(len(y)))
            h = self.units(c)
            back, out = np.empty_like(h), np.zeros_like(self.out)
            for a in range(0, len(y), BLOCK):
                back[a : a + BLOCK], g = _softmax(h[a : a + BLOCK], self.out, y[a : a + BLOCK])
                out += g
            # Units added up by leaf; where each group's leaves begin among these sums.
            first = _first(m + y * self.side)
            sums, place = np.add.reduceat(h, first), m[first]
            starts = np.searchsorted(first, [a for _, a, _ in runs])
            out[:, y[first[starts]]] -= np.add.reduceat(sums, starts).T
            for (k, a, b), u, v in zip(runs, starts.tolist(), [*starts[1:].tolist(), len(first)]):
                weights = np.zeros_like(self.leaf[k])
                for i in range(a, b, BLOCK):
                    j = min(i + BLOCK, b)
                    more, g = _softmax(h[i:j], self.leaf[k], m[i:j])
                    back[i:j] += more
                    weights += g
                weights[:, place[u:v]] -= sums[u:v].T
                self._step(self.leaf[k], weights * scale, self.squares[3][k])
            back = back[:, :UNITS] * (scale * (1 - h[:, :UNITS] ** 2))
            places = np.zeros_like(self.places)
            for k in range(2 * WINDOW):
                order = np.argsort(c[k], kind="stable")
                of = c[k][order]
                first = _first(of)
                places[k][of[first]] = np.add.reduceat(np.take(back, order, 0), first)
            for parameter, g, s in zip(self.parameters(), (places, back.sum(0), out * scale), self.squares):
                self._step(parameter, g, s)


def _windows(sequences: list[bytes], pad: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts in arrays with WINDOW paddings around each, LAID tokens or one text at a time: the first text's place in the
    list, the array, where tokens stand in it, and of which text each is."""
    gap, i = np.full(WINDOW, pad, np.int32), 0
    while i < len(sequences):
        parts, held, first = [gap], 0, i
        while i < len(sequences) and (i == first or held + len(sequences[i]) // 4 <= LAID):
            parts += [np.frombuffer(sequences[i], np.int32), gap]
            held += len(parts[-2])
            i += 1
        text = np.repeat(np.arange(i - first), [len(x) for x in parts[1::2]])
        yield first, np.concatenate(parts), np.arange(held) + WINDOW * (text + 1), text


def _contexts(x: np.ndarray, at: np.ndarray, seen_as: np.ndarray) -> np.ndarray:
    seen = np.take(seen_as, x)
    return np.stack([np.take(seen, at + d) for d in range(-WINDOW, WINDOW + 1) if d])


def targets(at: np.ndarray, r: int) -> np.ndarray:
    """The tokens that round r learns from: each token is in one round."""
    return at[(at + r) % ROUNDS == 0]


def _summed(rows: pa.Table) -> pa.Table:
    """One row of a piece of the parameters: the partitions' sums, added up."""
    total = sum(np.frombuffer(x) for x in rows["v"].to_pylist())
    return pa.table({"k": rows["k"][:1], "v": pa.array([total.tobytes()], pa.binary()), "n": pa.array([float(np.sum(rows["n"].to_numpy()))])})


def trained(leaves: DataFrame, words: Vocabulary) -> Network:
    """Rounds of local training and averaging; parameters travel in pieces, and the driver gets each piece once."""
    shape = words.shape()
    network = Network(shape.count)

    for r in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], start: Network = network, r: int = r) -> Iterator[pa.RecordBatch]:
            own = Network(shape.count)
            own.set_flat(start.flat())
            seen = 0
            for batch in batches:
                for _, x, at, _ in _windows([b or b"" for b in batch.column(0).to_pylist()], shape.pad):
                    at = np.random.default_rng(r).permutation(targets(at, r))
                    own.learn(_contexts(x, at, shape.seen_as), x[at])
                    seen += len(at)
            if seen:
                values = own.flat().astype(float) * seen
                pieces = [values[i : i + PIECE].tobytes() for i in range(0, len(values), PIECE)]
                yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(pieces)), pa.int32()), "v": pa.array(pieces, pa.binary()), "n": pa.array([float(seen)] * len(pieces), pa.float64())})

        sums = leaves.select("leaves").mapInArrow(run, "k int, v binary, n double").groupBy("k").applyInArrow(_summed, "k int, v binary, n double").toArrow()
        if sums.num_rows:
            by_piece = sorted(zip(sums["k"].to_pylist(), sums["v"].to_pylist(), sums["n"].to_pylist()))
            network = Network(shape.count)
            network.set_flat(np.concatenate([np.frombuffer(v) / n for _, v, n in by_piece]))
    return network


def score_sequences(network: Network, sequences: list[bytes], words: Vocabulary | Shape) -> np.ndarray:
    """Of each text, the sum of the log-probabilities of its tokens' leaves."""
    total = np.zeros(len(sequences))
    for first, x, at, text in _windows(sequences, words.pad):
        for i in range(0, len(at), AT_ONCE):
            here = at[i : i + AT_ONCE]
            found = network.log_probabilities(_contexts(x, here, words.seen_as), x[here]).astype(float)
            total[first : first + text[-1] + 1] += np.bincount(text[i : i + AT_ONCE], found, text[-1] + 1)
    return total


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, score (sum of conditional log-probabilities), mean_score, after training on the same documents."""
    counts = written(word_counts(docs), "pll-words")
    words = vocabulary(counts)
    leaves = written(as_leaves(docs, words), "pll-leaves")
    network, shape = trained(leaves, words), words.shape()
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = [b or b"" for b in batch.column(2).to_pylist()]
            n = np.array([len(s) // 4 for s in sequences], dtype=np.int64)
            score = score_sequences(network, sequences, shape) + batch.column(3).to_numpy()
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "id": batch.column(1), "n_tokens": pa.array(n, pa.int64()), "within": pa.array(score, pa.float64())})

    # Scores, not texts, are joined with the shares of rare words.
    sums = leaves.select("doc_id", "id", "leaves", "within").mapInArrow(run, f"doc_id {doc_id}, id bigint, n_tokens bigint, within double")
    score = with_shares(leaves, counts, words, sums).withColumnRenamed("within", "score")
    return score.select("doc_id", "n_tokens", "score", (F.col("score") / F.greatest("n_tokens", F.lit(1))).alias("mean_score"))
