"""CRF language ID, quality classifier, masked LM and byte-level BPE."""

import base64
import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from lattica.llm import bpe, langid, pll, quality
from lattica.llm.common import fold

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "12 34 !!"), (5, "long " * 40_000), (6, "éà 𝒳   don't  stop\t\n\n x"), (6, "éà 𝒳   don't  stop\t\n\n x"), (None, "the end of it")]


def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", 9.0, "x") for i, t in ODD], "doc_id long, text string, lang string, source string, score double, lang_pred string")


def test_fold_is_crc32_of_the_text(spark):
    rows = spark.range(50).select("id", fold(F.col("id"), 4).alias("k")).collect()
    assert all(r.k == zlib.crc32(str(r.id).encode()) % 4 for r in rows)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_reference_and_round_trips(spark, reference):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").union(odd(spark).select("doc_id", "text"))
    texts = sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)
    rows = sorted(bpe.encoded(docs, PATH, public_tokenizers.PATTERN).collect(), key=lambda r: str((r.doc_id, None if r.decoded is None else r.decoded)))
    got = {(r.doc_id, r.decoded): r for r in rows}
    assert len(rows) == len(texts)
    for i, text in texts:
        ids = reference.encode_ordinary(text or "")
        r = got[i, text or ""]
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_bpe_random_bytes(reference):
    rng, c = random.Random(4), bpe.codec(PATH, public_tokenizers.PATTERN)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randint(32, 126), rng.randint(160, 0x7FF), rng.randint(0x4E00, 0x4F00), 10, 0x1F600])) for _ in range(rng.randint(0, 60)))
        assert list(np.frombuffer(c.encode(text), "<u4")) == reference.encode_ordinary(text)


def test_forward_backward_equals_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    e, a = rng.normal(size=(1, 4, 3)), rng.normal(size=(3, 3))
    post, pairs = langid._expectations(e, a)
    want, joint, total = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in itertools.product(range(3), repeat=4):
        p = np.exp(sum(e[0, i, k] for i, k in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:])))
        total += p
        for i, k in enumerate(path):
            want[i, k] += p
        for x, y in zip(path, path[1:]):
            joint[x, y] += p
    assert np.allclose(post[0], want / total) and np.allclose(pairs, joint / total)


def test_language_of_code_switched_words():
    en, de = "the cat sat with this thing and then that other", "der hund und die katze ist nicht auf dem tisch"
    field = langid.train([en] * 8 + [de] * 8, ["en"] * 8 + ["de"] * 8)
    labels, scores = langid.Labeller(field).label([en, de, None, "12", en + " " + de])
    assert labels[:4] == ["en", "de", "und", "und"] and scores[2] == 0
    probabilities = langid.Labeller(field).word_probabilities(["the cat and then der hund nicht"])[0]
    assert [field.labels[k] for k in probabilities.argmax(1)] == ["en"] * 4 + ["de"] * 3


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_defined_results(spark):
    rows = langid.identified(odd(spark)).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert len(rows) == len(ODD) and by[1][0].lang_pred == by[2][0].lang_pred == by[4][0].lang_pred == "und"
    assert by[6][0] == by[6][1] and by[None][0].held_out is False
    none = odd(spark).where("false")
    assert langid.identified(none).collect() == []
    assert {r.lang_pred for r in langid.identified(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    x = np.sort(rng.random(50))
    a, b = quality.isotonic(x, (rng.random(50) < x).astype(float), np.ones(50))
    assert (np.diff(a) > 0).all() and (np.diff(b) > 0).all()


def test_quality_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    rows = quality.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 500 and np.mean([r.predicted == r.label for r in rows]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)


def test_quality_defined_results(spark):
    labels = spark.createDataFrame([(1, 1), (None, 1), (3, None), (99, 0), (5, 0), (5, 0)], "doc_id long, label int")
    rows = quality.scored(odd(spark), labels).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    none = labels.where("false")
    assert {r.score for r in quality.scored(odd(spark), none).collect()} == {0.5}
    assert quality.scored(odd(spark).where("false"), labels).collect() == []
    kept = quality.accepted(odd(spark), none)
    assert kept.columns == odd(spark).columns and kept.count() == len(ODD)


def test_lm_scores_are_sums_of_conditionals(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    counts = pll.word_counts(docs)
    by_hand = {}
    for r in docs.collect():
        for w in pll.tokens_of(r.text):
            by_hand[w] = by_hand.get(w, 0) + 1
    assert {r.word: r.n for r in counts.collect()} == by_hand
    words = pll.vocabulary(counts)
    network = pll.Network(words.count)
    sequences = [words.read(pll.tokens_of(r.text))[0] for r in docs.limit(3).collect()]
    got = pll.score_sequences(network, sequences, words)
    for s, total in zip(sequences, got):
        leaves, want = np.frombuffer(s, np.int32), 0.0
        padded = [pll.CLASSES] * 2 + list(words.seen_as[leaves]) + [pll.CLASSES] * 2
        for i, leaf in enumerate(leaves):
            h = np.tanh(network.hidden + network.places[0][padded[i]] + network.places[1][padded[i + 1]] + network.places[2][padded[i + 3]] + network.places[3][padded[i + 4]])
            g, m = divmod(int(leaf), words.side)
            z, y = np.append(h, 1) @ network.out, np.append(h, 1) @ network.leaf[g]
            want += z[g] - np.log(np.exp(z).sum()) + y[m] - np.log(np.exp(y).sum())
        assert abs(total - want) < 1e-2 * max(1, abs(want) / 100)


def test_word_probabilities_equal_all_label_sequences():
    import itertools

    rng = np.random.default_rng(2)
    field = langid.train(["the cat and the dog ran home"] * 4 + ["der hund und die katze"] * 4, ["en"] * 4 + ["de"] * 4)
    field.labels.append("xx")
    field.weights = np.concatenate([field.weights, rng.normal(size=(len(field.weights), 1)) * 0.1], 1)
    field.transitions = rng.normal(size=(3, 3))
    texts = ["the hund", "cat", None, "12 !", "und the katze dog der", "cat " + "x" * 300]
    for text, got in zip(texts, langid.Labeller(field).word_probabilities(texts)):
        words = langid.words_of(text)
        assert len(got) == len(words)
        if not words:
            continue
        e, want = field.scores(words), np.zeros((len(words), 3))
        for path in itertools.product(range(3), repeat=len(words)):
            p = np.exp(sum(e[i, k] for i, k in enumerate(path)) + sum(field.transitions[a, b] for a, b in zip(path, path[1:])))
            for i, k in enumerate(path):
                want[i, k] += p
        assert np.abs(got - want / want.sum(1, keepdims=True)).max() < 1e-4


def test_long_words_have_features_to_their_end():
    word = "a" * 60 + "qzq"
    assert "zq$" in langid.features_of(word, set()) and langid.features_of(word, set()).count("zq") == 1


def test_labels_do_not_depend_on_how_texts_are_batched(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    field = langid.trained(docs, F.lit(True))
    rows = lambda: sorted((r.doc_id, r.lang_pred, round(r.score, 4)) for r in langid.predicted(docs, field).collect())
    once = rows()
    monkeypatch.setattr(langid, "AT_ONCE", 3_000)
    assert rows() == once


def test_isotonic_equals_the_minimax_of_means():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 40):
        x, y, w = np.sort(rng.normal(size=n)), rng.integers(0, 4, n) / 3, rng.integers(1, 5, n).astype(float)
        mean = lambda a, b: (y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        at, level = quality.isotonic(x, y, w)
        assert np.all(np.diff(at) > 0) and np.all(np.diff(level) > 0)
        assert np.allclose([level[np.abs(level - v).argmin()] for v in want], want) and len(level) == len({round(v, 9) for v in want})


def test_ridge_equals_the_solution_of_all_rows_at_once(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(quality.with_statistics(docs), labels)
    rows = docs.join(labels, "doc_id").select("text", "label").collect()
    x, y = np.array([quality.statistics(r.text) for r in rows]), np.array([float(r.label) for r in rows])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.sd, np.maximum(x.std(0), 1e-6))
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-6), -6, 6)
    f = np.hstack([np.sqrt(2 / quality.FEATURES) * np.cos(z @ model.frequencies + model.phases), np.ones((len(z), 1))])
    # Ridge as least squares over the rows and a row for each penalty.
    d = np.sqrt(np.append(np.full(quality.FEATURES, quality.RIDGE * len(y)), 1e-9))
    w = np.linalg.lstsq(np.vstack([f, np.diag(d)]), np.append(y, np.zeros(len(d))), rcond=None)[0]
    assert np.abs(f @ w - f @ model.weights).max() < 1e-5
    # The kernel that the features stand for.
    a, b = z[:150], z[150:300]
    exact = np.exp(-((a - b) ** 2).sum(1) / (2 * quality.WIDTH**2))
    assert np.abs((f[:150, :-1] * f[150:300, :-1]).sum(1) - exact).mean() < 0.1


def test_lm_training_lowers_the_loss_by_its_gradient():
    """learn() against numerical gradients: a step from a fresh network goes against the gradient of the loss."""
    rng = np.random.default_rng(1)
    count = rng.integers(0, 50, (9, 9)).astype(float)
    contexts, leaves = rng.integers(0, pll.CLASSES + 1, (2 * pll.WINDOW, 300)).astype(np.uint8), rng.integers(0, 81, 300).astype(np.int32)
    loss = lambda n: -float(n.log_probabilities(contexts, leaves).astype(float).sum()) / np.sqrt(len(leaves))
    trained = pll.Network(count)
    trained.learn(contexts, leaves)
    start = pll.Network(count)
    for k, (p, after) in enumerate(zip(start.parameters(), trained.parameters())):
        flat, moved = p.reshape(-1), (after - p).reshape(-1)
        for j in rng.choice(np.flatnonzero(np.abs(moved) > 1e-3), 5):
            kept, e = flat[j], np.float32(5e-2)
            flat[j] = kept + e
            up = loss(start)
            flat[j] = kept - e
            down = loss(start)
            flat[j] = kept
            g = (up - down) / (2 * float(e))
            assert abs(moved[j] + pll.RATE * g / np.sqrt(1e-2 + g * g)) < 5e-3, (k, j)
    assert loss(trained) < loss(start)


def test_lm_holds_few_rows_of_logits_at_once(monkeypatch):
    """Blocks that stay in a core's cache give what one block of all rows gives."""
    rng = np.random.default_rng(3)
    count = rng.integers(0, 50, (9, 9)).astype(float)
    contexts, leaves = rng.integers(0, pll.CLASSES + 1, (2 * pll.WINDOW, 700)).astype(np.uint8), np.repeat(np.arange(81), 9)[:700].astype(np.int32)
    got, rows = [], []
    for name in ("_softmax", "_picked"):
        monkeypatch.setattr(pll, name, lambda z, *at, f=getattr(pll, name): (rows.append(len(z)), f(z, *at))[1])
    for block in (1_000, 90):
        monkeypatch.setattr(pll, "BLOCK", block)
        rows.clear()
        network = pll.Network(count)
        network.learn(contexts, leaves)
        got.append((network.flat(), network.log_probabilities(contexts, leaves)))
        assert max(rows) == min(block, 700)
    for a, b in zip(*got):
        assert np.abs(a - b).max() < 1e-4


def test_lm_words_share_rests_by_count(spark):
    words = [w for i in range(40) for w in [f"w{i:02}xx"] * (i + 1)]
    docs = spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")
    counts = pll.word_counts(docs)
    found = pll.vocabulary(counts)
    side, last = found.side, pll.ending("w00xx") % found.side
    # All words have one ending: the side - 1 most frequent are leaves, the others share the last leaf by count.
    assert [w for w, _ in found.own] == [f"w{39 - i:02}xx" for i in range(side - 1)]
    rest = sum(i + 1 for i in range(40 - side + 1))
    assert found.rest[last] == rest and found.leaf[found["w00xx"]] == last * side + side - 1 and abs(found.within[found["w00xx"]] + np.log(rest)) < 1e-12


def test_lm_learns_and_defines_odd_rows(spark):
    docs = spark.createDataFrame([(i, "a b c d " * 200) for i in range(8)] + [(100, "d d b b a c a " * 100)], "doc_id long, text string")
    rows = {r.doc_id: r for r in pll.scored(docs).collect()}
    assert rows[0].mean_score > rows[100].mean_score
    rows = pll.scored(odd(spark)).collect()
    assert len(rows) == len(ODD)
    assert all(r.n_tokens == 0 and r.score == 0 and r.mean_score == 0 for r in rows if r.doc_id in (1, 2, 3))
    assert pll.scored(odd(spark).where("false")).collect() == []


def test_lm_cuts_each_piece_once_and_finds_all_tokens(monkeypatch):
    """Texts cut at white space, each different piece searched once, against one search of each text."""
    texts = ["", None, "  ", " a  b", "a\x1cb\x85c\xa0d e", "İSTANBUL ΑΣ ΑΣ. ΣΑ", "x\ny\r\n\tz ", "\n", "«¡hé!» don't a_b 12.5", "​z", "日本語 テキスト。", "éa", "b a a b a"]
    rng = np.random.default_rng(4)
    texts += ["".join(rng.choice(list("abÄß_1.,'́ \n\t\x0b\x1f "), 40)) for _ in range(60)]
    for batch in (texts, [], [None], [" \n"]):
        tokens = pll.Tokens(batch)
        words, (found, upto) = tokens.words.to_pylist(), tokens.in_order()
        want = [pll.tokens_of(t) for t in batch]
        assert [[words[i] for i in found[a:b]] for a, b in zip(upto, upto[1:])] == want
        assert dict(zip(words, tokens.counts())) == {w: sum(t.count(w) for t in want) for w in words} and set(words) == {w for t in want for w in t}
    count = {w: n + 1 for n, w in enumerate(sorted({w for t in texts for w in pll.tokens_of(t)}))}
    own, frequent = sorted(count.items())[:7], sorted(count.items())[7:20]
    vocabulary = pll.Vocabulary(16, own, [50_000] * 16, frequent)
    leaves, within, words, times = vocabulary.read_all(texts)
    for t, leaf, log, others, n in zip(texts, leaves.to_pylist(), within, words.to_pylist(), times.to_pylist()):
        want = vocabulary.read(pll.tokens_of(t))
        assert (leaf, dict(zip(others, n))) == (want[0], dict(want[2])) and abs(log - want[1]) < 1e-9
    cut, search = [], pll._TOKEN_OR_BREAK
    monkeypatch.setattr(pll, "_TOKEN_OR_BREAK", type("Seen", (), {"findall": staticmethod(lambda t: (cut.append(t), search.findall(t))[1])}))
    assert pll.Tokens(["the cat, the cat," + " the cat, the cat," * 999] * 5).counts().tolist() == [10_000] * 3 and cut == ["\nthe\ncat,"]


def test_lm_counts_are_added_up_before_they_are_handed_on(spark, monkeypatch):
    docs = spark.createDataFrame([(f"a b{i % 7} c{i}",) for i in range(200)] + [(None,), (" ",)], "text string")
    want = {"a": 200} | {f"b{k}": len(range(k, 200, 7)) for k in range(7)} | {f"c{i}": 1 for i in range(200)}
    for counting, size in ((300_000, 8_000_000), (20, 60), (3, 1)):
        monkeypatch.setattr(pll, "COUNTING", counting)
        monkeypatch.setattr(pll, "SLICE", size)
        assert {r.word: r.n for r in pll.word_counts(docs).collect()} == want


def test_lm_joins_scores_and_not_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    plan = pll.scored(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("MapInArrow")


def test_lm_orders_many_leaves_as_few():
    rng = np.random.default_rng(6)
    for side in (9, 256, 300):
        network = object.__new__(pll.Network)
        network.side, target = side, np.append(rng.integers(0, side * side, 500), [0, side * side - 1]).astype(np.int32)
        context = rng.integers(0, 256, (4, 502)).astype(np.uint8)
        order, c, g, m, runs = network._by_group(context, target)
        assert (order == np.argsort(target, kind="stable")).all() and (c == context[:, order]).all() and (g * side + m == target[order]).all()
        assert [k for k, _, _ in runs] == sorted(set(g.tolist())) and all((g[a:b] == k).all() for k, a, b in runs) and runs[-1][2] == 502
