"""Top-k search, PII, decontamination, licences and the pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.llm import common, decontam, licenses, pii, topk


def test_blocks_hold_like_queries(monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 10)
    table, most = topk._blocks([(1, 4), (2, 5), (3, 3), (7, 25), (9, 1)])
    assert table == [(1, 0, 1), (2, 0, 1), (3, 1, 1), (7, 2, 3), (9, 5, 1)] and most == [2, 3, 7, 7, 7, 9]
    assert topk._blocks([]) == ([], [])


def test_cells_of_one_common_vector_and_of_pruned_lengths(spark, monkeypatch):
    for k, v in (("BUCKET", 16), ("BLOCK", 8), ("LONGEST", 30), ("AT_ONCE", 3)):
        monkeypatch.setattr(topk, k, v)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 8)) * np.exp(rng.normal(size=(900, 1)) * 2)
    x[300:600] = x[300]
    df = spark.createDataFrame([(i % 880, [float(e) for e in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 20 = 0")).collect())
    v, ids, want = np.floor(x * 1024).astype(np.int64), np.arange(900) % 880, []
    for q in sorted(set(ids[ids % 20 == 0].tolist())):
        best = {}
        for row in np.flatnonzero(ids == q):
            for i, score in zip(ids.tolist(), (v @ v[row]).tolist()):
                if i != q:
                    best[i] = max(best.get(i, score), score)
        want += [(q, k + 1, i, s) for k, (s, i) in enumerate(sorted(((-s, i) for i, s in best.items()))[:10])]
    assert got == [(q, k, i, -s) for q, k, i, s in sorted(want)]


@pytest.mark.parametrize("bucket, block, longest", [(2048, 2048, 2048), (7, 3, 12), (5, 2, 3)])
def test_top_k_equals_brute_force(spark, monkeypatch, bucket, block, longest):
    for k, v in (("BUCKET", bucket), ("BLOCK", block), ("LONGEST", longest)):
        monkeypatch.setattr(topk, k, v)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 6)) * rng.choice([0.1, 1, 3], size=(120, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(base)] + [(200 + i, [0.5] * 6) for i in range(40)]
    rows += [(300, None), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (600, [float("inf")] * 6), (700, [1.0, 2.0]), (701, [2.0, 2.0]), (900, []), (1000, [0.0] * 6), (1100, [1e7] * 6), (1101, [1e7, -1e7, 0.0, 0.0, 0.0, 1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect())
    ok = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in ok:
        if q % 100 == 0:
            s = sorted(((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b)))[:10]
            want += [(q, k + 1, i, -v) for k, (v, i) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_k(df.where("false"), df.where("false")).collect() == []


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans(text):
    def luhn(d):
        return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_equal_the_patterns(spark):
    import random

    rng = random.Random(8)
    letters = "0123456789 -.+()@ab_é𝒳%"
    rows = [(i, "".join(rng.choice(letters[: rng.choice([12, 16, len(letters)])]) for _ in range(rng.randint(0, 100)))) for i in range(1500)]
    rows += [(9000, None), (9001, ""), (9002, "é a@b.c.d_x@y.org 4111 1111 1111 1111 1.2.3.4.5.6.7.8 +1 (202) 555-0101 0255.1.1.1 256.1.1.1"), (9003, "1" * 50_000 + "@" + "a." * 20_000), (9002, "x@y.zz"), (None, "q@y.zz")]
    docs = spark.createDataFrame([(i, t, "k", 3) for i, t in rows], "doc_id long, text string, key string, base int")
    got = sorted((str(r.doc_id), ",".join(s for s in r.spans.split(",") if not s.startswith("term"))) for r in pii.report(docs).collect())
    want = sorted((str(i), ",".join(spans(t)) if len(t or "") < 50_000 else f"email:0:{50_001 + 39_999}") for i, t in rows)
    assert got == want


def test_disclosure_by_hand_and_redaction(spark):
    rows = [(i, f"{i} Zorblax keeps box{i} near bob@corp.example.com thanks {'abcdefgh'[i % 8] * 6}") for i in range(12)]
    rows += [(100 + i, f"plain thanks number {i}") for i in range(30)] + [(200, "card 4111 1111 1111 1111 here")]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    base = pii.described(docs)
    got = {r.term: r.disclosure for r in pii.disclosures(base, pii.term_counts(docs), len(rows)).collect()}
    n, n_e = len(rows), 12
    assert set(got) == {"zorblax", "keeps", "near"}
    for t, v in got.items():
        assert abs(v - np.log(12 * n / (n_e * 12)) / np.log(n / n_e)) < 1e-9
    out = {r.doc_id: r for r in pii.redacted(docs).collect()}
    assert out[3].text == "3   box3  [EMAIL] thanks dddddd" and out[3].n_chars == len(out[3].text)
    assert out[100].text == "plain thanks number 0" and out[200].text == "card [CARD] here"
    assert pii.report(docs.where("false")).collect() == []


def test_decontamination(spark):
    item = "If Anna has 3 apples and gives 2 to Bob how many apples does Anna keep for the whole week"
    items = spark.createDataFrame([(1, item), (2, "too short here"), (3, None), (None, item)], "item_id long, text string")
    rows = [(1, "before. " + item.replace(" ", "\n") + " after words"), (2, "so " + item.replace("3", "17").replace("2", "5").replace("Anna", "Carla")), (3, item.replace("Anna keep", "Carla keep")), (4, "an unrelated text with 3 apples and nothing more to say about them"), (5, None), (6, ""), (7, "1 2 3 4 5 " * 5000), (1, "before. " + item.replace(" ", "\n") + " after words"), (None, item)]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, key string")
    got = sorted((str(r.doc_id), r.item_id, r.kind) for r in decontam.contaminated(docs, items).collect())
    assert got == [("1", 1, "verbatim"), ("1", 1, "verbatim"), ("2", 1, "re-parameterised"), ("None", 1, "verbatim")]
    clean = decontam.clean(docs, items)
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [3, 4, 5, 6, 7]
    assert decontam.contaminated(docs.where("false"), items).collect() == []
    assert decontam.contaminated(docs, items.where("false")).collect() == []


def test_decontamination_of_values_with_more_words(spark):
    item = "On the first day Anna drove 5 km from Rome to the old harbour and met the man whom Bob had seen there in 1999 when he was still at sea with his two sons and no money"
    longer = item.replace("Anna", "Mary Jane").replace("Rome", "New York").replace("5 km", "17km").replace("1999", "2003").replace("Bob", "Uncle Tom")
    inserted = item.replace("the old harbour", "the very old and quite famous harbour").replace("had seen", "had once or twice seen")
    left_out = item.replace("the first ", "").replace("the man whom ", "")
    mixed = item.replace("Anna", "Carla").replace("Bob", "Anna") + " and Anna drove 5 km from Rome"
    form = "On a bad day Carla drove 9 km from Oslo to her new office and read the book that Pia had sent her in 1987 when she was far from home with a friend and two dogs"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, longer), (2, "so: " + inserted), (3, left_out), (4, form), (5, mixed), (6, ("a b c d e f g h " * 9_000) + inserted)], "doc_id long, text string")
    got = {r.doc_id: r.kind for r in decontam.contaminated(docs, items).collect()}
    assert got == {1: "re-parameterised", 2: "verbatim", 3: "verbatim", 5: "re-parameterised", 6: "verbatim"}


def contamination(spark, docs, items):
    """(document, item, coverage, kind): every shift of every pair that shares a window, laid word by word."""
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} long, text string")
    read = lambda rows, c: {r[0]: (r.raw, r.words) for r in frame(rows, c).select(c, F.split(decontam.spaced(F.col("text")), " ").alias("raw"), decontam.template(decontam.spaced(F.col("text"))).alias("words")).collect()}

    def clean(w):
        w = re.sub(r"^[^\w]+|[^\w]+$", "", w)
        return re.match(r"[0-9]+", w).group() if w[:1].isdigit() else w.split(decontam.JOINT)[-1]

    want, windows = set(), {}
    split = read(docs, "doc_id")
    for d, (_, wd) in split.items():
        for a in range(0, len(wd) - 5, 3):
            windows.setdefault(tuple(wd[a : a + 6]), []).append((d, a))
    for i, (raw_i, wi) in read(items, "item_id").items():
        met = {}
        for b in range(len(wi) - 5 if len(wi) >= 8 else 0):
            if sum(not w.startswith("<") for w in wi[b : b + 6]) >= 3:
                for d, a in windows.get(tuple(wi[b : b + 6]), []):
                    met.setdefault(d, set()).add(a - b)
        for d, shifts in met.items():
            raw, wd = split[d]
            lays = {s: [p for p in range(len(wi)) if 0 <= p + s < len(wd) and wd[p + s] == wi[p]] for s in shifts}

            def judge(pairs, n):
                slots = {(clean(raw_i[p]), clean(raw[q])) for p, q in pairs if "<" in wi[p]}
                return n * 100 / len(wi), len(slots) == len({a for a, _ in slots}), all(a == b for a, b in slots)

            ranked = max(((*judge([(p, p + s) for p in at], len(at)), s) for s, at in lays.items()), default=None)
            if ranked is None:
                continue
            chain = {(p, p + s) for s, at in lays.items() if abs(s - ranked[3]) * 2 <= len(wi) for p in at if any(set(range(k, k + 6)) <= set(at) for k in range(p - 5, p + 1))}
            for c, ok, same in (ranked[:3], judge(chain, min(len({p for p, _ in chain}), len({q for _, q in chain})))):
                if c >= 50 and ok:
                    want.add((d, i, round(c, 2), "verbatim" if same else "re-parameterised"))
                    break
    return want


def test_lays_and_slots_equal_brute_force(spark):
    """Every shift of every pair, laid word by word in plain Python, for the pairs that share a window."""
    import random

    rng = random.Random(6)
    words = ["red", "sun", "3", "17", "Anna", "Bob", "tree", "of", "in", "stone", "walks", "5 km", "Old Tom"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, "x " + text(rng.randint(8, 30))) for i in range(12)]
    docs = []
    for i in range(60):
        base = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(base))
            base[k : k + rng.randint(0, 1)] = text(rng.randint(0, 2)).split()
        docs.append((i, text(rng.randint(0, 9)) + " " + " ".join(base) + " " + text(5)))
    frame = lambda rows, c: spark.createDataFrame(rows, f"{c} long, text string")
    want = contamination(spark, docs, items)
    got = {(r.doc_id, r.item_id, r.coverage, r.kind) for r in decontam.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == want and len(want) > 30 and len({k for *_, k in want}) == 2


def test_all_planted_items_are_found(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(docs, items).collect()}
    even = lambda t: " ".join((t or "").lower().split())
    texts = [(r.doc_id, even(r.text)) for r in docs.collect()]
    want = {(d, i.item_id) for i in items.collect() for d, t in texts if even(i.text)[4:-4] in t}
    assert want and want <= got and len(got) <= len(want) + 2


def test_licences(spark):
    rows = [(1, "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "Released under the MIT License. And text"), (3, "She lost her driving license on the way home."), (4, None), (5, ""), (6, "Licensed under CC BY-NC 4.0."), (7, "ALL RIGHTS RESERVED"), (8, "the word rights alone"), (9, ("x " * 50_000) + "\nThis work is licensed under the GNU General Public License, version 3."), (1, "Some prose.\nLicensed under the Apache License, Version 2.0.\nMore."), (None, "Released under the BSD license")]
    docs = spark.createDataFrame([(i, t, "f") for i, t in rows], "doc_id long, text string, family string")
    rows = licenses.scanned(docs).collect()
    assert sorted({r.doc_id for r in rows if r.family == "unknown"}) == [3, 8] and all(0 < r.probability <= 1 and r.similarity == 0 for r in rows if r.family == "unknown")
    got = sorted((str(r.doc_id), r.family) for r in rows if r.family != "unknown")
    assert got == [("1", "apache"), ("1", "apache"), ("2", "mit"), ("6", "cc-by-nc"), ("7", "proprietary"), ("9", "gpl"), ("None", "bsd")]
    assert licenses.scanned(docs.where("false")).collect() == []


def test_licences_wrapped_over_lines(spark):
    bsd = "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n * are met:\n *\n * Other words.\n */\nint main() {}\n"
    lgpl = "# This library is free software; you can redistribute it\n# and/or modify it under the terms of the GNU Lesser\n# General Public License as published\n"
    gpl = "This program is free software: you can redistribute it and/or\nmodify it under the terms of the GNU General Public License as\npublished by the Free Software Foundation.\n\nShe lost her driving license.\n"
    docs = spark.createDataFrame([(1, bsd), (2, lgpl), (3, gpl), (4, "no word of it " * 20_000)], "doc_id long, text string")
    got = sorted((r.doc_id, r.family, r.n_paragraphs) for r in licenses.scanned(docs).collect())
    assert got == [(1, "bsd", 1), (2, "lgpl", 1), (3, "gpl", 1), (3, "unknown", 1)]


def test_licences_leave_no_tables_between(spark, monkeypatch, tmp_path):
    """Each file of a table starts processes beside the JVM, which for a moment share and double its memory."""
    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    text = "Released under the MIT License.\nShe lost her driving license.\n\nPermission is needed.\n\nReleased under the BSD license. All rights reserved."
    got = sorted((r.family, r.n_paragraphs) for r in licenses.scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect())
    assert got == [("bsd", 1), ("mit", 1), ("proprietary", 1), ("unknown", 1)] and not list(tmp_path.iterdir())


def test_licence_probabilities_equal_the_model_by_hand(spark):
    """Every part's n-grams, sums, temperature and containment, computed in plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    families, weights, bias, t = licenses.model()
    want = {}
    for d in docs.collect():
        low = (d.text or "").lower()
        for k, paragraph in enumerate(re.split(r"\n\s*\n", low)):
            flat = re.sub(r"\s+", " ", paragraph)
            found, p_unknown = {}, []
            for part in dict.fromkeys(re.split(r"(?<=[.!?]) ", flat) + re.split(r"\n|(?<=[.!?])\s+", paragraph)):
                if not any(x in part for x in licenses.RAW) or not (words := re.findall(r"[^\W_]+", part)):
                    continue
                z = np.array(bias)
                for g in licenses.grams_of(part):
                    z = z + np.array(weights.get(g, [0] * len(families)))
                p = np.exp((z - z.max()) / t)
                p /= p.sum()
                p_unknown.append(p[-1])
                best = families[int(p.argmax())]
                like = max((len(set(x.split()) & set(words)) / len(set(x.split())) for x in licenses.TEMPLATES.get(best, [])), default=0)
                if best != "unknown" and p.max() >= licenses.MINIMUM and like >= licenses.CONFIRMED:
                    found[best] = max(found.get(best, 0), p.max())
            for f, p in (found or ({"unknown": max(p_unknown)} if p_unknown else {})).items():
                n, most = want.get((d.doc_id, f), (0, 0))
                want[d.doc_id, f] = n + 1, max(most, p)
    got = {(r.doc_id, r.family): (r.n_paragraphs, r.probability) for r in licenses.scanned(docs).collect()}
    assert got.keys() == want.keys() and len(got) > 20
    assert all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-3 for k in got)


def test_pipeline_applies_every_stage(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "MinHash near-dedup", "benchmark decontamination", "PII", "byte-level BPE"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        after = stage(spark, now, sf)
        assert after.columns == docs.columns, k
        now = spark.createDataFrame(after.collect(), docs.schema)
    ids = {r.doc_id for r in now.collect()}
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == ids and 0 < len(ids) < docs.count()
    texts = {r.doc_id: r.text for r in now.collect()}
    assert all(r.decoded == texts[r.doc_id] for r in out)
    assert not any(re.search(r"@mail\d+\.example\.com", t) for t in texts.values())


def test_pipeline_equals_plain_python_and_keeps_odd_rows(spark, tmp_path):
    """run() over a table with odd rows and columns named as those of steps: after the classifier (which has its own tests)
    every stage is done again in plain Python."""
    import base64
    import shutil

    import public_tokenizers
    import tiktoken

    import corpus_pipeline
    from lattica.llm.bpe import encoded
    from lattica.llm.quality import accepted
    from tests.llm.test_duplicates import sets_of

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = [r for r in accepted(docs, spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("quality").alias("label"))).orderBy("doc_id").collect()]
    a, b = good[0].text, good[1].text
    odd = [(900_001, None), (900_002, ""), (900_003, " \n"), (None, a), (None, None), (900_004, a), (900_004, a), (900_005, a + " end"), (900_006, b + " write to zed@mail.example.org or +1 (202) 555-0101 now"), (900_006, good[2].text), (900_007, (a + " ") * 300)]
    more = spark.createDataFrame([(i, t, None, "s", len(t) if t else None) for i, t in odd], docs.schema)
    names = ("key", "row", "digest", "group", "spans", "new", "words", "label", "stats", "class", "node")
    docs.union(more).select("*", *[F.lit(c).alias(c) for c in names]).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        shutil.copyfile(f"{sf}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    now = stages["quality classifier"](spark, docs, str(tmp_path)).collect()
    assert {r.key for r in now} == {"key"} and len(now) > 60

    # Near duplicates: the smallest id of each component, one row of it, and all rows without words or id.
    key = lambda r: (r.doc_id, r.text)
    sets = {key(r): sets_of(r.text) for r in now if r.doc_id is not None and sets_of(r.text)}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(sets)
    for n, x in enumerate(keys):
        for y in keys[:n]:
            if 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                p, q = sorted((find(x), find(y)))
                root[q] = p
    left, seen = [], set()
    for r in now:
        if key(r) not in sets:
            left.append(r)
        elif r.doc_id == find(key(r))[0]:
            left.append(r)
    groups = {}
    for r in left:
        if key(r) in sets:
            groups.setdefault(find(key(r)), []).append(r)
    one = {g: rows[0] for g, rows in groups.items()}
    assert all(len({x.text for x in rows}) == 1 for rows in groups.values())
    left = [r for r in left if key(r) not in sets] + list(one.values())
    got = stages["MinHash near-dedup"](spark, spark.createDataFrame(now, docs.schema), str(tmp_path)).collect()
    shown = lambda rows: sorted(map(str, rows))
    assert shown(got) == shown(left) and len(left) < len(now)

    # Benchmark items.
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    held = {d for d, *_ in contamination(spark, [(n, r.text) for n, r in enumerate(left) if r.text is not None], items)}
    left = [r for n, r in enumerate(left) if n not in held]
    assert held

    # Personal data; so small a table has no revealing terms.
    want = []
    for r in left:
        text, out, at = r.text, "", 0
        for start, end, kind in sorted((int(x), int(y), k) for k, x, y in (s.split(":") for s in spans(text or ""))):
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, end)
        want.append((r.doc_id, text if text is None else out + text[at:]))
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.decoded or "", list(r.ids or [])) for r in result) == sorted((str(i), t or "", reference.encode(t or "", disallowed_special=())) for i, t in want)
    assert any("[EMAIL]" in (t or "") for _, t in want)

    # Empty tables.
    for t, frame in (("documents", docs), ("labels", None), ("benchmark", None)):
        (frame if frame is not None else spark.read.parquet(f"{sf}/{t}.parquet")).where("false").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_texts_of_a_megabyte_take_seconds(spark):
    """Dotted digits, addresses and a repeated item: results are as they must be, in time that doesn't grow with the square."""
    import time

    item = "If Anna has 3 apples and gives 2 to Bob how many apples does Anna keep for the whole week"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    digits, mails, items_text = "see 1" + ".1" * 500_000 + " now", "ab@cd.ef " * 110_000, (item + ". ") * 11_000
    rows = [(1, digits), (2, mails), (3, items_text), (4, "plain")]
    for doc_id, text in rows:
        docs = spark.createDataFrame([(doc_id, text)], "doc_id long, text string")
        began = time.time()
        found = decontam.contaminated(docs, items).collect()
        assert [(r.item_id, r.kind) for r in found] == ([(1, "verbatim")] if doc_id == 3 else [])
        assert time.time() - began < 60
        began = time.time()
        report, redacted = pii.report(docs).first(), pii.redacted(docs).first().text
        assert time.time() - began < 120
        if doc_id == 2:
            assert report.n_email == 110_000 and report.spans == ",".join(f"email:{9 * k}:{9 * k + 8}" for k in range(110_000)) and redacted == "[EMAIL] " * 110_000
        elif doc_id == 1:
            assert report.n_ip == 125_000 and redacted == "see " + ".".join(["[IP]"] * 125_000) + ".1 now"
        else:
            assert redacted == text and report.spans == ""


def test_rewriting_equals_plain_python(spark):
    """Overlapping changes, over the ends of pieces, in texts of characters of any width."""
    import random

    rng, rows = random.Random(4), []
    for i in range(60):
        text = "".join(rng.choice("abé𝒳 ") for _ in range(rng.choice([0, 5, 40, 4095, 4096, 4097, 9000])))
        changes = sorted((a := rng.randint(0, len(text)), min(len(text), a + rng.choice([1, 2, 30, 5000])), f"<{k}>") for k in range(rng.choice([0, 1, 3, 60])))
        rows.append((i, text, [c for c in changes if c[0] < c[1]]))
    df = spark.createDataFrame(rows, "i int, text string, c array<struct<start: int, end: int, to: string>>")
    got = {r.i: r.x for r in df.select("i", pii.rewritten(F.col("text"), F.col("c"), lambda s, at: F.when(s["start"] < at, "").otherwise(s["to"])).alias("x")).collect()}
    blank = {r.i: r.x for r in df.select("i", pii._masked(F.col("text"), F.col("c")).alias("x")).collect()}
    for i, text, changes in rows:
        out, at, masked = "", 0, list(text)
        for start, end, to in changes:
            if start >= at:
                out += text[at:start] + to
            at = max(at, end)
            masked[start:end] = " " * (end - start)
        assert got[i] == out + text[at:] and blank[i] == "".join(masked)
