"""Edits of Turtle sources: only what they are about changes, and the inverse gives the same bytes."""

import random

import pytest

from lattica.operators import edits
from lattica.sources import rdf
from lattica.sources.bridge import bridge

HEAD = "@prefix ex: <http://ex/> . # prefixes é𝒳\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n\n"
X, RDFS, OWL = "http://ex/", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"
BODY = '''# é before
ex:A   a owl:Class ;   # note "one" ; .
   rdfs:label "α" , "b"@en ,	"c" ; # labels
   rdfs:subClassOf ex:B , # first
      [ a owl:Restriction ; owl:onProperty ex:p ; owl:someValuesFrom ex:C ] ,
      ex:D ;;
   ex:q 1 , 2.5
.
ex:A ex:r "x;y.z" . ex:E ex:p ex:A .
<http://ex/F> rdfs:comment """long
ex:A . """ .
'''


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def files(spark, texts):
    return frame(spark, sorted(texts.items()), "path string, text string")


def changes(spark, rows):
    return frame(spark, [("f", *r, *[None] * (7 - len(r))) for r in rows], edits.CHANGE)


def facts(text):
    """Quads, with blank objects as expressions."""
    parsed = rdf.parse_turtle(text)
    assert parsed.error is None, (parsed.error, parsed.line, text)
    rows = bridge(parsed.quads)
    return {q[:1] + q[2:7] for q in parsed.quads if q[1] == "iri" and q[4] != "bnode"}, {a[:4] for a in rows.axioms}


def done(spark, text, rows):
    source = files(spark, {"f": text})
    made = edits.triple_edits(source, changes(spark, rows)).cache()
    after = {r.path: (r.text, r.state) for r in edits.apply(source, made).collect()}
    if not after:
        return text
    assert after["f"][1] == "ok"
    back = edits.apply(files(spark, {"f": after["f"][0]}), edits.invert(source, made)).collect()
    assert [r.text for r in back] == [text]
    return after["f"][0]


def test_adding_keeps_all_else(spark):
    out = done(spark, HEAD + BODY, [("add", X + "A", RDFS + "label", 'new "q"\n', "literal", None, "de"), ("add", X + "A", RDFS + "subClassOf", f"{X}p some ({X}C and {X}D)", "expression"), ("add", X + "New", RDFS + "subClassOf", "http://other/x y", "iri"), ("add", X + "A", RDFS + "subClassOf", X + "B", "iri")])
    assert out == HEAD + BODY.replace('ex:A ex:r "x;y.z" .', 'ex:A ex:r "x;y.z" ;\n    rdfs:label "new \\"q\\"\\n"@de ;\n    rdfs:subClassOf [ a owl:Restriction ; owl:onProperty ex:p ; owl:someValuesFrom [ a owl:Class ; owl:intersectionOf ( ex:C ex:D ) ] ] .') + "ex:New rdfs:subClassOf <http://other/x y> .\n"


def test_removing_keeps_comments(spark):
    out = done(spark, HEAD + BODY, [("remove", X + "A", RDFS + "label", "α", "literal"), ("remove", X + "A", RDFS + "label", "c", "literal"), ("remove", X + "A", RDFS + "subClassOf", f"{X}p some {X}C", "expression"), ("remove", X + "A", X + "q", "1", "literal", "http://www.w3.org/2001/XMLSchema#integer"), ("remove", X + "A", X + "q", "2.5", "literal"), ("remove", X + "E", X + "p", X + "A", "iri"), ("remove", X + "A", X + "r", "no", "literal")])
    before, after = facts(HEAD + BODY), facts(out)
    assert len(before[0] - after[0]) == 5 and after[0] <= before[0] and len(before[1] - after[1]) == 2
    assert all(x in out for x in ('# note "one" ; .', "# labels", "# first", "# é before", '"x;y.z" .', "# prefixes é𝒳"))
    gone = done(spark, HEAD + BODY, [("remove", s, p, o, k, dt, lang) for s, p, o, k, dt, lang in before[0]])
    assert facts(gone)[0] == set() and facts(gone)[1] == {("sub_class_of", X + "A", "", f"{X}p some {X}C")} and "# é before" in gone


def test_renaming_and_migration(spark):
    text = HEAD + BODY
    source = files(spark, {"f": text, "g": "<http://ex/A> <http://ex/p> <http://ex/AA> .", "bad": "ex:A ex:p"})
    made = edits.rename(source, X + "A", "http://ex/Renamed").cache()
    out = {r.path: r.text for r in edits.apply(source, made).collect()}
    assert out == {"f": text.replace("ex:A ", "ex:Renamed ", 1).replace("\nex:A ex:r", "\nex:Renamed ex:r").replace("ex:p ex:A .", "ex:p ex:Renamed ."), "g": "<http://ex/Renamed> <http://ex/p> <http://ex/AA> ."}
    assert {r.path: r.text for r in edits.apply(files(spark, out), edits.invert(source, made)).collect()} == {p: t for p, t in {"f": text, "g": "<http://ex/A> <http://ex/p> <http://ex/AA> ."}.items()}
    moved = {r.path: r.text for r in edits.apply(source, edits.migrate_namespace(source, X, "http://new/")).collect()}
    assert facts(moved["f"])[1] == {tuple(x.replace(X, "http://new/") for x in a) for a in facts(text)[1]} and moved["f"].count("ex:") == text.count("ex:")


def test_stale_files_and_overlaps_are_left_alone(spark):
    source = files(spark, {"f": HEAD + BODY, "g": "<http://a> <http://b> <http://c> ."})
    made = edits.rename(source, X + "A", X + "Z").cache()
    later = files(spark, {"f": HEAD + BODY + "\n", "g": "x"})
    assert {(r.path, r.state, r.text) for r in edits.apply(later, made).collect()} == {("f", "stale", HEAD + BODY + "\n")}
    twice = made.union(made.limit(1))
    assert {(r.state, r.text) for r in edits.apply(source, twice).collect()} == {("conflict", HEAD + BODY)}
    assert edits.invert(source, twice).collect() == [] and edits.apply(source, made.where("false")).collect() == []
    assert edits.statements(files(spark, {"bad": "<a> ("})).collect() == []


def test_spans_are_those_of_the_text(spark):
    raw = (HEAD + BODY).encode()
    rows = edits.terms(files(spark, {"f": HEAD + BODY})).collect()
    assert rows and all(raw[r.start : r.end].decode() == r.text for r in rows)
    found = {(r.p, raw[r.start : r.end].decode()) for r in edits.statements(files(spark, {"f": HEAD + BODY})).where(f"s = '{X}A'").collect()}
    assert {(RDFS + "label", '"b"@en'), (X + "q", "2.5"), (X + "r", '"x;y.z"')} <= found


def test_operations(spark):
    ops = [("add_label", X + "A", None, "more"), ("set_comment", "http://ex/F", None, "short"), ("remove_sub_class_of", X + "A", None, X + "B"), ("set_transitive", X + "p", None, "true"), ("set_deprecated", X + "A", None, "true"), ("add_annotation", X + "E", X + "note", "n"), ("remove_complex_sub_class_of", X + "A", None, f"{X}p some {X}C"), ("unknown_op", X + "A", None, "x")]
    source = files(spark, {"f": HEAD + BODY})
    table = frame(spark, [("f", *o) for o in ops], "path string, op string, subject string, predicate string, value string")
    after = edits.apply(source, edits.triple_edits(source, edits.operations(source, table))).first()
    a, b = facts(HEAD + BODY), facts(after.text)
    string = "http://www.w3.org/2001/XMLSchema#string"
    assert after.state == "ok" and b[0] - a[0] == {(X + "A", RDFS + "label", "more", "literal", string, None), ("http://ex/F", RDFS + "comment", "short", "literal", string, None), (X + "p", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", OWL + "TransitiveProperty", "iri", None, None), (X + "A", OWL + "deprecated", "true", "literal", "http://www.w3.org/2001/XMLSchema#boolean", None), (X + "E", X + "note", "n", "literal", string, None)}
    assert a[0] - b[0] == {("http://ex/F", RDFS + "comment", "long\nex:A . ", "literal", string, None), (X + "A", RDFS + "subClassOf", X + "B", "iri", None, None)}


def test_random_edits_say_what_they_should(spark):
    rng, texts, wanted, rows = random.Random(6), {}, {}, []
    spaces = ["", " ", "\n", "  # c . ;\n", "\t"]
    gap = lambda: " " + rng.choice(spaces)
    for n in range(60):
        quads, out = set(), HEAD
        for k in range(rng.randint(1, 5)):
            verbs = []
            for v in rng.sample("pqrs", rng.randint(1, 3)):
                objects = rng.sample(["ex:a", "ex:b", '"l;"', '"é"@en', "7"], rng.randint(1, 4))
                verbs.append(f"ex:{v}{gap()}" + f"{gap()},{gap()}".join(objects))
            out += f"ex:s{k}{gap()}" + f"{gap()};{gap()}".join(verbs) + rng.choice(["", " ;", " ; ;"]) + f"{gap()}.{gap()}\n"
        quads = facts(out)[0]
        gone = {q for q in quads if rng.random() < rng.choice([0.1, 0.5, 1])}
        new = {(X + f"s{rng.randint(0, 6)}", X + rng.choice("pqt"), X + f"n{j}", "iri", None, None) for j in range(rng.randint(0, 3))}
        texts[f"f{n}"], wanted[f"f{n}"] = out, (quads - gone) | new
        rows += [(f"f{n}", op, s, p, o, k, dt, lang) for op, some in (("remove", gone), ("add", new)) for s, p, o, k, dt, lang in some]
    source = files(spark, texts)
    made = edits.triple_edits(source, frame(spark, rows, edits.CHANGE)).cache()
    after = {r.path: (r.text, r.state) for r in edits.apply(source, made).collect()}
    for path, text in texts.items():
        new, state = after.get(path, (text, "ok"))
        assert state == "ok" and facts(new)[0] == wanted[path], (text, new)
    back = {r.path: r.text for r in edits.apply(files(spark, {p: t for p, (t, _) in after.items()}), edits.invert(source, made)).collect()}
    assert back == {p: texts[p] for p in after}
