"""Whole jobs: cases that earlier forms of the corpus operators passed over."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from lattica.llm import pii, pll


def test_dedup_stage_joins_documents_of_similarity_above_80(spark):
    base = [f"w{i}" for i in range(100)]
    near, far = list(base), list(base)
    for k in (20, 70):
        near[k] = "x"
    for k in (20, 50, 80):
        far[k] = f"y{k}"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # 86 of 106 shingles are shared by 1 and 2, 81 of 111 by 1 and 3.
    assert sorted(r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()) == [1, 3]


def test_rare_entities_have_revealing_terms(spark):
    rows = [(i, f"plain words number {i}") for i in range(2000)]
    rows += [(3000, "Zorblax wrote plain words to bob@corp.example.com"), (3001, "plain Quuxley knows ann@corp.example.com"), (3002, "plain Quuxley again met ann@corp.example.com")]
    # Copies are no evidence: the term is in one text of an entity, and in other texts too.
    rows += [(4000 + i, "plain Wibblet called cat@corp.example.com") for i in range(3)] + [(5000 + i, f"plain Wibblet {i}") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = pii.described(docs)
    got = {(r.entity, r.term) for r in pii.disclosures(base, pii.term_counts(docs), len(rows)).collect()}
    assert {("email:bob@corp.example.com", "zorblax"), ("email:ann@corp.example.com", "quuxley")} <= got
    assert not any(t in ("plain", "words", "wibblet") for _, t in got)


def test_terms_count_and_are_marked_in_whole_texts(spark):
    far = "little words between " * 20
    rows = [(i, f"plain words number {i}") for i in range(2000)]
    rows += [(3000 + i, f"Zorblax {i} {far}bob@corp.example.com and ZORBLAX") for i in range(8)] + [(3100, "they met Zorblax, not zorblaxes, twice: zorblax")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = pii.described(docs)
    got = {r.term for r in pii.disclosures(base, pii.term_counts(docs), len(rows)).collect()}
    assert got == {"zorblax", "little", "between"}
    spans = {r.doc_id: r.spans for r in pii.report(docs).where("doc_id >= 3100").collect()}
    assert spans == {3100: "term:9:16,term:40:47"}
    out = {r.doc_id: r.text for r in pii.redacted(docs).collect()}
    assert out[3100].lower().count("zorblax") == 1 and not any("zorblax" in out[3000 + i].lower() for i in range(8)) and out[5] == "plain words number 5"


def test_shares_of_all_words_are_by_their_counts(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40)
    seen = []
    for kept in (100_000, 0, 500):
        monkeypatch.setattr(pll, "KEPT", kept)
        counts = pll.word_counts(docs)
        words = pll.vocabulary(counts)
        rows = pll.with_shares(pll.as_leaves(docs, words).cache(), counts, words).collect()
        seen.append(sorted((r.doc_id, round(r.within, 6)) for r in rows))
    assert len(seen[0]) == 40 and seen[0] == seen[1] == seen[2]


def test_every_token_is_a_target_of_training_once(spark, monkeypatch):
    learnt = []
    monkeypatch.setattr(pll.Network, "learn", lambda self, contexts, targets: learnt.extend(zip(contexts.T.tolist(), targets.tolist())))
    monkeypatch.setattr(pll, "LAID", 60)

    class Local:
        """mapInArrow and what follows it, in this process."""

        select = groupBy = applyInArrow = lambda self, *_: self
        toArrow = lambda self: pa.table({"k": []})

        def mapInArrow(self, run, schema):
            leaves = [np.arange(a, b, dtype=np.int32).tobytes() for a, b in ((0, 100), (100, 130), (130, 150), (150, 200))]
            list(run(iter([pa.RecordBatch.from_pydict({"leaves": pa.array(leaves, pa.binary())})])))
            return self

    pll.trained(Local(), pll.Vocabulary(20, [], [1] * 20, []))
    assert sorted(y for _, y in learnt) == list(range(200))


def test_term_spans_equal_brute_force(spark):
    """Counts, shares, bounds and places of terms over a table of the test data, recounted row by row."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.where("doc_id % 70 = 0")).union(spark.createDataFrame([(900_001, None), (900_002, "")], docs.schema))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    base = {t: [(k, s.start, s.end, s.value) for k in pii.KINDS for s in f[k]] for t, f in ((r.text, r) for r in pii._with_spans(docs).collect())}
    masked, entities = {}, {}
    for t, found in base.items():
        x = list(t)
        for _, a, b, _ in found:
            x[a:b] = " " * (b - a)
        masked[t] = "".join(x)
        entities[t] = {f"{k}:{v.lower() if k == 'email' else v if k == 'ip' else re.sub('[^0-9]', '', v)}" for k, _, _, v in found}
    terms = {t: {w.lower() for w in re.findall(r"[^\W\d_]{4,}", m)} for t, m in masked.items()}
    n_t, n_e, n_et, texts = {}, {}, {}, {}
    for _, t in rows:
        for w in terms[t]:
            n_t[w] = n_t.get(w, 0) + 1
        for e in entities[t]:
            n_e[e] = n_e.get(e, 0) + 1
            for w in terms[t]:
                n_et[e, w] = n_et.get((e, w), 0) + 1
                texts.setdefault((e, w), set()).add(t)
    marked, total = {}, len(rows)
    for (e, w), n in n_et.items():
        p = n / n_t[w]
        m, z2 = len(texts[e, w]) / p, pii.Z**2
        low = (p + z2 / (2 * m) - pii.Z * np.sqrt(p * (1 - p) / m + z2 / (4 * m * m))) / (1 + z2 / m)
        score = lambda q, e=e: np.log(q * total / n_e[e]) / np.log(total / n_e[e])
        if low >= pii.SURE and score(low) >= pii.GENERALISE:
            marked[w] = max(marked.get(w, 0), score(p))
    want = sorted((str(i), ",".join(f"{s.start()}:{s.end()}" for s in re.finditer(r"[^\W\d_]{4,}", masked[t]) if s.group().lower() in marked)) for i, t in rows)
    got = sorted((str(r.doc_id), ",".join(s[5:] for s in r.spans.split(",") if s.startswith("term:"))) for r in pii.report(docs).collect())
    assert marked and sum(len(w) for _, w in want) > 100
    assert got == want


def test_columns_with_names_of_steps_pass_through(spark):
    docs = spark.createDataFrame([(1, "write to a@b.org", "k", "s", "n", 5), (2, "plain", "k", "s", "n", 5), (None, None, "k", "s", "n", None)], "doc_id long, text string, key string, spans string, new string, row int").withColumn("a.`b`", F.lit(1))
    out = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert out[1].text == "write to [EMAIL]" and out[2].text == "plain" and out[None].text is None
    assert all(r.key == "k" and r.spans == "s" and r.new == "n" for r in out.values()) and out[1]["row"] == 5
    items = spark.createDataFrame([(1, "no such passage stands in any of the texts above")], "item_id long, text string")
    from lattica.llm import decontam

    assert sorted(map(str, decontam.clean(docs, items).collect())) == sorted(map(str, docs.collect()))
    from lattica.llm import minhash

    assert minhash.unique(docs, 80).columns == docs.columns and minhash.unique(docs, 80).count() == 3
