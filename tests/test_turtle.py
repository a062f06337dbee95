"""Turtle and TriG that many tasks read, against the parser of whole files."""

import random
from collections import defaultdict

import pytest

from lattica.sources import rdf, turtle

PIECES = [
    '<http://a/s{n}> <http://a/p> "x{n}" .', 'ex:s{n} a ex:C ; ex:p "a # b . [ (" , \'q"{n}\' ;\n   ex:q ex:o{n} .', 'ex:s{n} ex:t """long . \n # no comment\n [ ( { " "" end.\n. \\""" still\n""" .',
    "ex:s{n} ex:l ( 1 2.5 [ ex:in \"y\" ; ex:z ( ex:a\n ex:b ) ] ) . # done .", "# a comment with \"\"\" and ' and {n} .", "", "[] ex:p ex:o{n} .", "ex:a.b{n} ex:p 1.5 , -2 , 3e4 , true .", "_:b{m} ex:p _:b{n} .", "ex:s{n} ex:p ex:o\\. .", "ex:s{n}\n  ex:p\n  ex:o ;\n  .",
    "@prefix n{n}: <http://n{n}/> .\nn{n}:s n{n}:p n{n}:o .", "PREFIX m: <http://m{n}/>\nm:s m:p '''one\n'' two . \n''' .", "<s{n}> <p> <o> .", "ex:s{n} ex:p ex:o . ex:s{n} ex:p ex:o2 . ex:s{n} ex:p", "ex:o3 .", "ex:é{n} ex:p \"é𝒳\"@en-GB .", "@base <http://base{n}/> .",
]
GRAPHS = ["<http://g/{n}> {{ ex:s{n} ex:p ex:o .\n ex:s{n} ex:q \"}} .\" . }}", "GRAPH ex:g{n} {{\nex:a ex:p ex:b .\nex:c ex:p [ ex:q 1 ] .\n\nex:d ex:p ex:e\n}}", "{{ ex:x{n} ex:p ex:y . }}", "<http://g/n{n}>\n{{\n ex:a ex:p ex:b .\n ex:c ex:p ex:d .\n}}"]


def document(rng, n, graphs=False):
    out = ["@prefix ex: <http://ex/> .", "@base <http://start/> ."]
    while len(out) < n:
        k = rng.randrange(len(PIECES))
        if k == 15:
            continue
        out.append(PIECES[k].replace("{n}", str(rng.randint(0, 999))).replace("{m}", str(rng.randint(0, 9))))
        if k == 14:
            out.append(rng.choice(["", "# between"]))
            out.append(PIECES[15])
        if graphs and rng.random() < 0.3:
            out.append(rng.choice(GRAPHS).format(n=rng.randint(0, 999)))
    return "\n".join(out)


def same_but_blank_names(a, b):
    """Multisets of quads, with blank nodes told apart by what is around them."""

    def shape(quads):
        names = defaultdict(int)
        for _ in range(6):
            new = defaultdict(list)
            for s, sk, p, o, ok, dt, lang, g in quads:
                left, right = (names[s], "b") if sk == "bnode" else s, (names[o], "b") if ok == "bnode" else o
                if sk == "bnode":
                    new[s].append(hash(("s", p, right, ok, dt, lang, g)))
                if ok == "bnode":
                    new[o].append(hash(("o", p, left, g)))
            names = defaultdict(int, {k: hash(tuple(sorted(v))) for k, v in new.items()})
        return sorted(str(((names[s] if sk == "bnode" else s), sk, p, (names[o] if ok == "bnode" else o), ok, dt, lang, g)) for s, sk, p, o, ok, dt, lang, g in quads)

    return shape(a) == shape(b)


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", str(n))
    for k, v in old.items():
        spark.conf.set(k, v)


def read(spark, texts, folder):
    folder.mkdir()
    for name, text in texts.items():
        (folder / name).write_text(text, encoding="utf-8", newline="")
    quads, errors = turtle.read_turtle(spark, str(folder))
    got, bad = defaultdict(list), {}
    for r in quads.collect():
        got[r.doc_id.rpartition("/")[2]].append(tuple(r)[:8])
    for r in errors.collect():
        bad[r.doc_id.rpartition("/")[2]] = (r.message, r.line, r.column)
    return got, bad, quads


@pytest.mark.parametrize("size, chunk", [(300, 1 << 16), (900, 50)])
def test_split_files_give_the_quads_of_whole_ones(spark, small_splits, monkeypatch, tmp_path, size, chunk):
    small_splits(size)
    monkeypatch.setattr(turtle, "CHUNK", chunk)
    rng = random.Random(size)
    texts = {f"d{k}.ttl": document(rng, rng.choice([5, 40])) + rng.choice(["", "\n", "\n# end"]) for k in range(6)} | {f"g{k}.trig": document(rng, 40, graphs=True) + "\n" for k in range(5)}
    texts |= {"empty.ttl": "", "crlf.ttl": "@prefix ex: <http://ex/> .\r\nex:a ex:p \"\"\"x\r\ny\"\"\" .\r\n", "long.ttl": "<http://a/s> <http://a/p> <http://a/o0> ,\n" + " ,\n".join(f"  <http://a/o{k}>" for k in range(200)) + " .\n<http://a/t> <http://a/p> <http://a/o> ."}
    got, bad, _ = read(spark, texts, tmp_path / "t")
    assert bad == {}
    for name, text in texts.items():
        whole = rdf.parse_turtle(text)
        assert whole.error is None, (name, whole.error, whole.line)
        assert same_but_blank_names(got[name], whole.quads), name


def test_errors_keep_their_lines_and_end_the_file(spark, small_splits, tmp_path):
    small_splits(400)
    rng, texts = random.Random(3), {}
    for k, fault in enumerate(["ex:s ex:p .", "un:known ex:p ex:o .", 'ex:s ex:p "open .', "ex:s ex:p ex:o", "ex:s ex:p ( ex:a .", 'ex:s ex:p """never', "} .", "ex:s ex:p ex:o ]."]):
        lines = document(rng, 60).split("\n")
        at = [i for i, x in enumerate(lines) if x.startswith("<http://a/s")] or [3]
        texts[f"e{k}.ttl"] = "\n".join([*lines[: at[len(at) // 2]], fault, *lines[at[len(at) // 2] :]])
    got, bad, _ = read(spark, texts, tmp_path / "t")
    for name, text in texts.items():
        whole = rdf.parse_turtle(text)
        assert bad[name][1:] == (whole.line, whole.column) and bad[name][0] == whole.error, (name, bad[name], whole.error, whole.line)
        assert same_but_blank_names(got[name], whole.quads), name


def test_one_file_is_read_by_many_tasks(spark, small_splits, tmp_path):
    small_splits(1 << 17)
    text = "@prefix ex: <http://ex/> .\n" + "\n".join(f"ex:s{k} a ex:C ; ex:label \"\"\"thing\n{k} .\"\"\" ;\n  ex:next ex:s{k + 1} ." for k in range(30_000))
    got, bad, quads = read(spark, {"one.ttl": text}, tmp_path / "t")
    assert bad == {} and len(got["one.ttl"]) == 90_000 and len(text) > 1 << 20
    assert {q[0] for q in got["one.ttl"]} == {f"http://ex/s{k}" for k in range(30_000)}
    assert turtle._lines(spark, [str(tmp_path / "t")]).rdd.getNumPartitions() > 8
