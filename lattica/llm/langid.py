"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, character n-grams and, for frequent words, its entry in the lexicon; label pairs of
neighbouring words have learned transitions. Training sequences join passages of different documents, so that the
transitions see changes of language. Forward-backward over all words of a text gives each word's label probabilities; a
text has the label of the greatest sum, and the score is that sum over the number of words.

Defined results: null text, or text without a letter, is ``und`` with score 0; ties go to the label first in order;
without training rows every text is ``und``; repeated rows give repeated results; lang, source and doc_id are never
inputs of a prediction. Training takes about ``DOCS_PER_LABEL`` different whole documents of each label, chosen by hash
of doc_id and text; FEATURES and LEXICON bound what is learned from them. Texts are labelled whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import fold

#: Documents of each label that train, features and lexicon entries kept, words in a training sequence, passes, penalty.
DOCS_PER_LABEL, FEATURES, LEXICON, SEQUENCE, EPOCHS, PENALTY = 400, 60_000, 5_000, 64, 3, 1e-6
#: Words whose scores a worker keeps, and characters labelled at once (or one text).
CACHE, AT_ONCE = 600_000, 4_000_000
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def features_of(word: str, lexicon: frozenset[str] | set[str]) -> list[str]:
    n, padded = len(word), f"^{word}$"
    out = ["<" + word[:k] for k in (1, 2, 3) if k <= n]
    out += [">" + word[-k:] for k in (1, 2, 3) if k <= n]
    out += [padded[i : i + 2] for i in range(len(padded) - 1)]
    out += [padded[i : i + 3] for i in range(len(padded) - 2)]
    if word in lexicon:
        out.append("=" + word)
    return out


def _passages(documents: list[np.ndarray], labels: list[int], rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One stream of words and labels: passages of 8 to 47 words, in random order."""
    parts = []
    for words, label in zip(documents, labels):
        i = 0
        while i < len(words):
            k = int(rng.integers(8, 48))
            parts.append((words[i : i + k], label))
            i += k
    order = rng.permutation(len(parts))
    return np.concatenate([parts[i][0] for i in order]), np.concatenate([np.full(len(parts[i][0]), parts[i][1]) for i in order])


class Field:
    """The trained field: weights of features by label, and transitions."""

    def __init__(self, labels: Sequence[str]):
        self.labels = list(labels)
        self.index: dict[str, int] = {}
        self.lexicon: frozenset[str] = frozenset()
        self.weights = np.zeros((1, len(self.labels)))
        self.transitions = np.zeros((len(self.labels), len(self.labels)))

    def scores(self, words: Sequence[str]) -> np.ndarray:
        """Sums of the feature weights, a row for each word; the last weight row is of a feature that every word has."""
        get, last = self.index.get, len(self.index)
        flat, starts = [], []
        for word in words:
            starts.append(len(flat))
            flat.append(last)
            flat += [i for f in features_of(word, self.lexicon) if (i := get(f)) is not None]
        return np.add.reduceat(self.weights[flat], starts, axis=0) if starts else np.zeros((0, len(self.labels)))


def train(texts: Sequence[str], labels: Sequence[str], seed: int = 3) -> Field:
    """Stochastic gradient ascent (AdaGrad) on the conditional log-likelihood of the label sequences."""
    field = Field(sorted(set(labels)))
    k = len(field.labels)
    vocabulary: dict[str, int] = {}
    documents, own = [], []
    counts: Counter[str] = Counter()
    for text, label in zip(texts, labels):
        if words := words_of(text):
            counts.update(words)
            documents.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words]))
            own.append(field.labels.index(label))
    if not documents:
        return field
    field.lexicon = frozenset(w for w, n in counts.most_common(LEXICON) if n > 1)
    by_word = [features_of(w, field.lexicon) for w in vocabulary]
    found = Counter(f for fs in by_word for f in fs)
    field.index = {f: i for i, (f, _) in enumerate(found.most_common(FEATURES))}
    last = len(field.index)
    ids = [[last, *(field.index[f] for f in fs if f in field.index)] for fs in by_word]
    sizes = np.array([len(x) for x in ids])
    flat, starts = np.concatenate(ids), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    w, a = np.zeros((last + 1, k)), np.zeros((k, k))
    w2, a2 = np.full((last + 1, k), 1e-2), np.full((k, k), 1e-2)
    rng = np.random.default_rng(seed)
    words, tags = _passages(documents, own, rng)
    t = min(SEQUENCE, len(words))
    n = len(words) // t
    words, tags = words[: n * t].reshape(n, t), tags[: n * t].reshape(n, t)
    for epoch in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, 64):
            x, y = words[order[i : i + 64]], tags[order[i : i + 64]]
            unique, inverse = np.unique(x, return_inverse=True)
            size = sizes[unique]
            begin = np.cumsum(size) - size
            take = flat[np.repeat(starts[unique] - begin, size) + np.arange(size.sum())]
            emission = np.add.reduceat(w[take], begin, axis=0)[inverse.reshape(x.shape)]
            posterior, pairs = _expectations(emission, a)
            target = np.eye(k)[y]
            gradient = (target - posterior).reshape(-1, k) / len(x)
            of_word = np.stack([np.bincount(inverse.ravel(), gradient[:, j], len(unique)) for j in range(k)], 1)
            spread = np.repeat(of_word, size, axis=0)
            g = np.stack([np.bincount(take, spread[:, j], last + 1) for j in range(k)], 1) - PENALTY * w
            w2 += g * g
            w += 0.3 * g / np.sqrt(w2)
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            g = (seen - pairs) / len(x) - PENALTY * a
            a2 += g * g
            a += 0.3 * g / np.sqrt(a2)
    field.weights, field.transitions = w, a
    return field


def _expectations(emission: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sequences of equal length: each word's label probabilities, and expected counts of label pairs."""
    n, t, k = emission.shape
    e, a = np.exp(emission - emission.max(2, keepdims=True)), np.exp(transitions - transitions.max())
    forward, backward = np.empty_like(e), np.ones_like(e)
    forward[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    for i in range(1, t):
        f = (forward[:, i - 1] @ a) * e[:, i]
        forward[:, i] = f / f.sum(1, keepdims=True)
    for i in range(t - 2, -1, -1):
        b = (backward[:, i + 1] * e[:, i + 1]) @ a.T
        backward[:, i] = b / b.sum(1, keepdims=True)
    posterior = forward * backward
    posterior /= posterior.sum(2, keepdims=True)
    if t < 2:
        return posterior, np.zeros((k, k))
    joint = forward[:, :-1, :, None] * a * (e * backward)[:, 1:, None, :]
    joint /= joint.sum((2, 3), keepdims=True)
    return posterior, joint.sum((0, 1))


class Labeller:
    """A field with the scores of the words met so far."""

    def __init__(self, field: Field):
        self.field, self.rows, self.used = field, {}, 0
        self.table = np.zeros((1024, len(field.labels)), dtype=np.float32)
        self.step = np.exp(field.transitions - field.transitions.max(initial=-np.inf)).astype(np.float32)

    def _rows_of(self, words: list[str]) -> np.ndarray:
        rows = self.rows
        new = list({w for w in words if w not in rows})
        if new:
            s = self.field.scores(new)
            s = np.exp(s - s.max(1, keepdims=True)).astype(np.float32) + np.float32(1e-9)
            while self.used + len(new) > len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            self.table[self.used : self.used + len(new)] = s
            rows.update(zip(new, range(self.used, self.used + len(new))))
            self.used += len(new)
        return np.fromiter(map(rows.__getitem__, words), dtype=np.int32, count=len(words))

    def word_probabilities(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """Of each text, a row of label probabilities for each word."""
        if self.used > CACHE:
            self.rows, self.used = {}, 0
        documents = []
        for text in texts:
            words = words_of(text)
            documents.append(self._rows_of(words) if any(any(map(str.isalpha, w)) for w in words) else np.zeros(0, np.int32))
        sizes = np.array([len(d) for d in documents], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        begin = np.zeros(len(sizes), dtype=np.int64)
        begin[order] = np.cumsum(sizes[order]) - sizes[order]
        e = self.table[np.concatenate([documents[i] for i in order] or [np.zeros(0, np.int32)])]
        forward, backward = np.empty_like(e), np.empty_like(e)
        first, long = begin[order], sizes[order]
        last = first + long - 1
        active = np.searchsorted(-long, -np.arange(1, (long[0] if len(long) else 0) + 1), side="right").tolist()
        f = b = None
        for t, n in enumerate(active):
            at = first[:n] + t
            f = e[at] if f is None else (f[:n] @ self.step) * e[at]
            f /= f.sum(1, keepdims=True)
            forward[at] = f
        for t, n in enumerate(active):
            at = last[:n] - t
            b = np.ones((n, e.shape[1]), np.float32) if b is None else (b[:n] * e[at + 1]) @ self.step.T
            b /= b.sum(1, keepdims=True)
            backward[at] = b
        forward *= backward
        forward /= forward.sum(1, keepdims=True)
        return [forward[begin[i] : begin[i] + sizes[i]] for i in range(len(sizes))]

    def label(self, texts: Sequence[str | None]) -> tuple[list[str], list[float]]:
        if not self.field.labels:
            return ["und"] * len(texts), [0.0] * len(texts)
        labels, scores = [], []
        for p in self.word_probabilities(texts):
            if len(p):
                mean = p.mean(0, dtype=np.float64)
                best = int(mean.argmax())
                labels.append(self.field.labels[best])
                scores.append(float(min(1.0, max(0.0, mean[best]))))
            else:
                labels.append("und")
                scores.append(0.0)
        return labels, scores


def trained(docs: DataFrame, eligible: Column) -> Field:
    """A field from rows with text and lang where ``eligible`` holds. The driver gets about DOCS_PER_LABEL texts a label."""
    rows = docs.where(eligible & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Field([])
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(DOCS_PER_LABEL / n)) for lang, n in sorted(counts.items())])
    draw = F.xxhash64("doc_id", "text").bitwiseAND((1 << 24) - 1) / float(1 << 24)
    sample = rows.where(draw < share).select("lang", "text").distinct().collect()
    sample.sort(key=lambda r: (r.lang, r.text))
    return train([r.text for r in sample], [r.lang for r in sample])


def predicted(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, lang_pred, score of every document, where it is read."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(field)
        for whole in batches:
            ends = np.cumsum([len(t or "") for t in whole.column(1).to_pylist()])
            i = 0
            while i < whole.num_rows:
                done = int(ends[i - 1]) if i else 0
                n = max(1, int(np.searchsorted(ends, done + AT_ONCE, side="right")) - i)
                batch = whole.slice(i, n)
                i += n
                labels, scores = labeller.label(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(labels, pa.string()), "score": pa.array(scores, pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {doc_id}, lang_pred string, score double")


def identified(docs: DataFrame) -> DataFrame:
    """Learns from three of four folds of doc_id and labels every document: doc_id, held_out, lang_pred, score."""
    held_out = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    field = trained(docs, ~held_out)
    return predicted(docs, field).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
