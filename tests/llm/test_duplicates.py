"""MinHash near-duplicates and repeated substrings against brute force."""

import hashlib
import random

import numpy as np
import pytest

from lattica.llm import minhash, suffix


def documents(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((n, " ".join(w) if rng.random() < 0.7 else "\t".join(w).upper()))
            n += 1
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "ONE  two"), (905, "é x"), (906, "x " * 30_000), (907, "x " * 30_001), (None, rows[0][1]), (7, rows[7][1])]


def sets_of(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets, parent = {}, {}
    for i, t in rows:
        if i is not None:
            sets[i], parent[i] = sets_of(t), i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 85 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("short, block, few, rounds", [(32, 2048, 12, 1), (0, 8, 0, 0), (0, 2048, 3, 2)])
def test_components_equal_brute_force(spark, monkeypatch, short, block, few, rounds):
    for k, v in (("SHORT", short), ("BLOCK", block), ("FEW", few), ("ROUNDS", rounds)):
        monkeypatch.setattr(minhash, k, v)
    rows = documents()
    docs = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, n_shingles int, comp string")
    got = minhash.linked(docs, 85).collect()
    assert len(got) == len(rows)
    want = brute(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == want[r.doc_id]


def test_unique_keeps_one_of_each_group(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, comp string")
    kept = minhash.unique(docs, 85)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in kept.collect())
    assert ids == sorted([(True, i) for i, v in brute(rows).items() if v[2]] + [(False, 0)])
    assert minhash.linked(docs.where("false")).collect() == []


def test_rows_of_one_id_and_different_texts_are_rows_of_their_own(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(7, a, "x", 1), (7, b, "y", 1), (7, b, "y", 1), (8, a + " end", "z", 1), (9, b.upper(), "w", 1), (3, " ".join(f"c{i}" for i in range(9)), "v", 1), (7, " ".join(f"c{i}" for i in range(9)), "u", 1), (7, None, "n", 1), (7, "", "m", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, `group` int")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.linked(docs).collect())
    assert got == sorted([(7, 7, True)] * 5 + [(8, 7, False), (9, 7, False), (3, 3, True), (7, 3, False)])
    kept = minhash.unique(docs)
    assert kept.columns == docs.columns
    assert sorted(r.digest for r in kept.collect()) == ["m", "n", "v", "x", "y"]


def test_suffix_order():
    rng = random.Random(1)
    for _ in range(200):
        x = np.array([rng.randint(1, rng.choice([1, 2, 30])) for _ in range(rng.randint(0, 200))], dtype=np.int64)
        assert suffix.suffix_order(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


@pytest.mark.parametrize("hot", [2000, 1])
def test_removed_bytes_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, whole = text(450), text(700)
    rows = [(1, text(300) + passage + text(100)), (2, passage), (3, text(50) + passage[:410]), (4, whole), (4, whole), (5, None), (6, ""), (7, "a" * 2000), (8, "ab" * 250), (9, text(5000)), (None, passage[:399]), (10, passage[20:] + passage), (11, "short"), (11, "short")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, n_bytes int")
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.deduplicated(docs).collect())
    seen = {}
    raws = [(t or "").encode() for _, t in rows]
    for b in raws:
        for k in range(len(b) - 399):
            seen[b[k : k + 400]] = seen.get(b[k : k + 400], 0) + 1
    want = []
    for (i, _), b in zip(rows, raws):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 399):
            if seen[b[k : k + 400]] > 1:
                gone[k : k + 400] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1)
        want.append((str(i), len(b), int(gone.sum()), len(edges), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    assert got == sorted(want)
    assert suffix.deduplicated(docs.where("false")).collect() == []


def test_hot_groups_are_counted_by_cells(spark, monkeypatch):
    """The same as by sorting, from far fewer rows than there are strings."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(2, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(110)
    texts = [text(60) + passage[: rng.randint(len(passage) - 60, len(passage))] + text(60) for _ in range(60)]
    texts += [text(20) + passage[rng.randint(0, 90) :] for _ in range(30)] + ["ab" * 900, "x" + "ab" * 600, "a" * 3000, (passage + " ") * 3]
    for _ in range(40):
        k = rng.randint(0, 500)
        texts.append(texts[0][:k] + rng.choice("abcdé") + texts[0][k + 1 :])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got, rows, write = [], [], suffix.written

    def counting(df, name, compression="snappy"):
        out = write(df, name, compression)
        if name == "suffix-nodes":
            rows.append(out.count())
        return out

    monkeypatch.setattr(suffix, "written", counting)
    for hot in (10_000, 5):
        monkeypatch.setattr(suffix, "HOT", hot)
        got.append(sorted(map(tuple, suffix.deduplicated(docs).drop("kept").collect())))
    assert got[0] == got[1] and sum(r[2] for r in got[0]) > 50_000
    strings = 0
    for t in set(texts):
        raw = np.frombuffer(t.encode(), np.uint8)
        strings += max(0, len(raw) - 399)
    assert len(rows) == 2 and 0 < sum(rows) < strings / 3


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeated_passages_of_words_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix, "HOT", hot)
    rng = random.Random(4)
    words = lambda n: [rng.choice(["a", "be", "see", "dé", "efgh"]) + rng.choice("uvwxyz") for _ in range(n)]
    passage, short = words(60), words(51)
    texts = [words(20) + passage + words(9), words(70) + passage[3:56], short, words(5) + short, short[:50] + words(30), words(300), ["no"] * 120, words(60)]
    rows = [(i, rng.choice([" ", "\n ", "\t"]).join(t)) for i, t in enumerate(texts)] + [(20, " ".join(texts[7])), (21, "\n" + " ".join(texts[7])), (30, None), (31, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_repeated_words, r.n_passages) for r in suffix.deduplicated(docs).collect())
    seen, want = {}, []
    split = [(i, (t or "").split()) for i, t in rows]
    for _, w in split:
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])] = seen.get(tuple(w[k : k + 51]), 0) + 1
    for i, w in split:
        cover = [False] * len(w)
        for k in range(len(w) - 50):
            if seen[tuple(w[k : k + 51])] > 1:
                cover[k : k + 51] = [True] * 51
        want.append((i, sum(cover), sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))))
    assert got == sorted(want) and sum(n > 0 for _, n, _ in want) >= 8
