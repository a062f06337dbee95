"""SPARQL, graphs, fixpoints, reasoning, rules, diff and plugins; and every query against DuckDB on the smallest tables."""

import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lattica import queries as library
from lattica.catalog import Catalog
from lattica.model import SWRL_RULE, XSD, LatticaError
from lattica.operators import diff, fixpoint, reason, swrl
from lattica.plans.sparql import run_sparql
from lattica.plugins import Plugin, Registry
from lattica.sources import scan

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_query_equals_duckdb(spark, duck, name):
    frame = library.QUERIES[name](spark, SF)
    rows = frame.collect()
    if name in library.ORACLE_SQL:
        found = duck.execute(library.ORACLE_SQL[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(frame.columns)
        want = sorted(str([r[columns.index(c)] for c in frame.columns]) for r in found.fetchall())
        assert sorted(str(list(r)) for r in rows) == want


def quads(spark, rows):
    c = Catalog.empty(spark)
    return c.with_(quads=spark.createDataFrame([(*r[:5], *(list(r[5:]) + [None] * 3)[:3], "d") for r in rows], c.quads.schema))


@pytest.fixture(scope="module")
def small(spark):
    return quads(spark, [
        ("urn:a", "iri", "urn:p", "urn:b", "iri"), ("urn:b", "iri", "urn:p", "urn:c", "iri"), ("urn:c", "iri", "urn:p", "urn:a", "iri"),
        ("urn:a", "iri", "urn:n", "1", "literal", XSD + "integer"), ("urn:b", "iri", "urn:n", "2.5", "literal", XSD + "decimal"), ("urn:c", "iri", "urn:n", 'x"y\\z\n', "literal", XSD + "string"),
        ("urn:a", "iri", "urn:l", "hallo", "literal", None, "de"), ("urn:a", "iri", "urn:l", "hello", "literal", None, "en"), ("urn:g1", "iri", "urn:p", "urn:a", "iri", None, None, "urn:g"), ("b1", "bnode", "urn:q", "urn:a", "iri"),
    ])


I = lambda n: f'"{n}"^^<{XSD}integer>'
D = lambda n: f'"{n}"^^<{XSD}decimal>'


@pytest.mark.parametrize("text, want", [
    ("SELECT ?s ?n WHERE { ?s <urn:p> ?o OPTIONAL { ?s <urn:n> ?n FILTER(?n > 1) } }", [("<urn:a>", ""), ("<urn:b>", D("2.5")), ("<urn:c>", "")]),
    ("SELECT ?x WHERE { <urn:a> <urn:p>+ ?x }", [("<urn:a>",), ("<urn:b>",), ("<urn:c>",)]),
    ("SELECT ?x WHERE { <urn:a> (<urn:p>|^<urn:q>)* ?x }", [("<urn:a>",), ("<urn:b>",), ("<urn:c>",), ("_:b1",)]),
    ("SELECT (COUNT(*) AS ?k) (SUM(?n) AS ?t) (AVG(?n) AS ?a) WHERE { ?s <urn:n> ?n FILTER isNumeric(?n) }", [(I(2), D("3.5"), D("1.75"))]),
    ("SELECT ?s (GROUP_CONCAT(?l; separator='|') AS ?ls) WHERE { ?s <urn:l> ?l } GROUP BY ?s HAVING (COUNT(?l) > 1)", [("<urn:a>", '"hallo|hello"')]),
    ("SELECT ?s WHERE { ?s <urn:n> ?n MINUS { ?s <urn:l> ?l } }", [("<urn:b>",), ("<urn:c>",)]),
    ("SELECT ?s WHERE { ?s <urn:n> ?n MINUS { ?q <urn:l> ?l } }", [("<urn:a>",), ("<urn:b>",), ("<urn:c>",)]),
    ("SELECT ?s WHERE { ?s <urn:p> ?o FILTER NOT EXISTS { ?s <urn:l> ?z } }", [("<urn:b>",), ("<urn:c>",)]),
    ("SELECT ?g ?s WHERE { GRAPH ?g { ?s <urn:p> ?o } }", [("<urn:g>", "<urn:g1>")]),
    ("SELECT ?s WHERE { ?s <urn:p> <urn:a> }", [("<urn:c>",)]),
    ("SELECT ?s FROM <urn:g> WHERE { ?s <urn:p> <urn:a> }", [("<urn:g1>",)]),
    ("SELECT ?s ?v WHERE { VALUES (?s ?v) { (<urn:a> 1) (UNDEF 2) } ?s <urn:n> 2.5 }", [("<urn:b>", I(2))]),
    ("SELECT ?x ?X WHERE { ?x <urn:p> ?X . ?X <urn:n> 2.5 }", [("<urn:a>", "<urn:b>")]),
    ("SELECT ?d WHERE { ?s <urn:n> ?n BIND(?n * 2 AS ?d) FILTER(BOUND(?d)) }", [(I(2),), (D("5.0"),)]),
    ("SELECT ?b WHERE { ?b !(<urn:p>|<urn:n>|<urn:l>) ?o FILTER isBlank(?b) }", [("_:b1",)]),
    ("SELECT (STRLEN(STR(?n)) AS ?k) WHERE { <urn:c> <urn:n> ?n }", [(I(6),)]),
    ("SELECT ?l WHERE { ?s <urn:l> ?l FILTER(langMatches(LANG(?l), 'EN')) }", [('"hello"@en',)]),
    ("SELECT (IF(1 < 2, 'y', 'n') AS ?r) (COALESCE(?z, 3) AS ?c) (1 / 0 AS ?e) WHERE { }", [('"y"', I(3), "")]),
    ("ASK { <urn:a> <urn:p> <urn:c> }", [("false",)]),
])
def test_sparql(small, text, want):
    assert sorted(tuple(r) for r in run_sparql(small, text).frame.collect()) == sorted(want)


def test_sparql_order(small):
    got = [r[0] for r in run_sparql(small, "SELECT ?n WHERE { ?s ?p ?n } ORDER BY DESC(?n) LIMIT 2").frame.collect()]
    assert got == [D("2.5"), I(1)]


@pytest.mark.parametrize("text", ["CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "# c\nPREFIX x: <urn:x>\nINSERT DATA { <a> <b> <c> }", "SELECT ?x WHERE { ?x rdfs:label ?y }", "SELECT", "SELECT ?x WHERE { ?x ?y }", "DROP ALL", "SELECT ?x WHERE { SERVICE <urn:s> { ?x ?y ?z } }", "SELECT ?x WHERE { ?x ?y ?z BIND(1 AS ?x) }"])
def test_sparql_rejects(small, text):
    with pytest.raises(LatticaError):
        run_sparql(small, text)


@pytest.mark.parametrize("seed", range(3))
def test_fixpoints_equal_plain_python(spark, seed):
    rng = random.Random(seed)
    pairs = {(rng.randrange(25), rng.randrange(25)) for _ in range(30)}
    edges = spark.createDataFrame(sorted(pairs), "a long, b long").repartition(1 + seed)
    want = set(pairs)
    while True:
        more = {(x, z) for x, y in want for y2, z in pairs if y == y2} - want
        if not more:
            break
        want |= more
    assert {(r.a, r.b) for r in fixpoint.closure(edges).collect()} == want
    sources = spark.createDataFrame([(1,), (2,)], "a long")
    assert {(r.a, r.b) for r in fixpoint.closure(edges, sources).collect()} == {p for p in want if p[0] in (1, 2)}
    parent = {x: x for p in pairs for x in p}
    for _ in parent:
        for a, b in pairs:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {r.node: r.component for r in fixpoint.components(edges).collect()} == parent


HEAD = "@prefix : <http://r/#> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
R = "http://r/#"


def index(spark, body, name="/r.ttl"):
    return scan.index_texts(spark, {name: HEAD + body}, lint=False)


def test_unsatisfiable_and_explained(spark):
    c = index(spark, ":A a owl:Class . :B a owl:Class ; rdfs:subClassOf owl:Nothing . :I a owl:Class ; rdfs:subClassOf :A , :B . :C a owl:Class ; owl:disjointWith :A . :D a owl:Class ; rdfs:subClassOf :A , :C .")
    result = reason.classify(c, "rl")
    assert {r.iri for r in result.unsatisfiable.collect()} == {R + "B", R + "I", R + "D"}
    assert reason.explain(c, R + "I")[0] == [f"{R}I SubClassOf {R}B", f"{R}B SubClassOf http://www.w3.org/2002/07/owl#Nothing"]
    assert any("DisjointWith" in x for x in reason.explain(c, R + "D", 3)[0])
    assert reason.check_consistency(c)["consistent"] is False


def test_realize_and_cycles(spark):
    c = index(spark, ":P a owl:Class . :E a owl:Class ; rdfs:subClassOf :P . :x a owl:Class ; rdfs:subClassOf :y . :y a owl:Class ; rdfs:subClassOf :x . :w a owl:ObjectProperty ; rdfs:domain :E ; owl:inverseOf :v . :al a owl:NamedIndividual , :E ; :w :ac . :ac a owl:NamedIndividual . :al owl:sameAs :al2 . :al2 owl:differentFrom :al .")
    rows = {(r.individual.rpartition("#")[2], r.type.rpartition("#")[2], r.inferred, r.most_specific) for r in reason.realize(c).collect()}
    assert {("al", "E", False, True), ("al", "P", True, False), ("al2", "E", True, True)} <= rows
    assert reason.check_instance(c, R + "al", R + "P")
    assert {(r.a.rpartition("#")[2], r.b.rpartition("#")[2]) for r in reason.clashes(c).collect()} == {("al", "al2"), ("al2", "al")}
    assert {r.p.rpartition("#")[2] for r in reason.inferred_assertions(c)["properties"].where(f"s = '{R}ac'").collect()} == {"v"}
    assert {tuple(x.rpartition("#")[2] for x in r) for r in reason.classify(c).equivalences.collect()} == {("x", "x"), ("y", "x")}
    got = reason.dl_query(c, "w some owl:Thing and not P2", {"": R})["instances"].collect()
    assert {r.individual.rpartition("#")[2] for r in got} == {"al", "al2"}


def test_swrl(spark):
    rule = {"id": "r", "enabled": True, "body": [{"kind": "class", "class": R + "Person", "args": ["?x"]}, {"kind": "object_property", "property": R + "pet", "args": ["?x", "?y"]}, {"kind": "data_property", "property": R + "age", "args": ["?x", "?a"]}, {"kind": "builtin", "predicate": "swrlb:greaterThan", "args": ["?a", "17"]}], "head": [{"kind": "class", "class": R + "Owner", "args": ["?x"]}]}
    text = json.dumps(json.dumps(rule))
    c = index(spark, f":Person a owl:Class . :pet a owl:ObjectProperty . :age a owl:DatatypeProperty . :a a :Person ; :pet :d ; :age 20 . :b a :Person ; :pet :d ; :age 9 . :rule <{SWRL_RULE}> {text} .")
    new, warnings = swrl.materialise(c)
    assert [(r.s, r.o) for r in new.collect()] == [(R + "a", R + "Owner")] and not warnings
    bad = swrl.validate_rule({"id": "b", "body": [], "head": [{"kind": "class", "class": "", "args": ["?z"]}]})
    assert {d["code"] for d in bad} == {"swrl_empty_body", "swrl_unbound_variable", "swrl_bad_iri"}


def test_renames_are_greedy_and_one_to_one(spark):
    row = lambda *x: spark.createDataFrame([(i,) for i in x], "iri string")
    links = spark.createDataFrame([("n1", "o1"), ("o1", "n2"), ("o2", "n1"), ("n2", "o2"), ("o3", "n1")], "subject string, object string")
    assert sorted(tuple(r) for r in diff.renames(row("o1", "o2", "o3"), row("n1", "n2"), links).collect()) == [("o1", "n1"), ("o2", "n2")]


def test_plugins(spark, small):
    r = Registry()
    bad = lambda c: (_ for _ in ()).throw(ValueError("no"))
    r.register(Plugin("b", "validator", bad, needs=("a",)))
    r.register(Plugin("a", "query", lambda c: c.quads))
    assert r.order() == ["a", "b"] and r.run("a", small).count() == 10
    assert [x.code for x in r.validate(small).collect()] == ["plugin_failed"]
    with pytest.raises(LatticaError):
        r.register(Plugin("c", "validator", bad, capabilities=frozenset({"write"})))


def test_streams(spark, tmp_path):
    import os
    import shutil

    from lattica.streaming import reindex

    os.makedirs(tmp_path / "in")
    shutil.copy(f"{SF}/events.parquet", tmp_path / "in" / "e.parquet")
    batch = spark.read.parquet(f"{SF}/events.parquet")
    got = reindex.replay(spark, str(tmp_path / "in"), batch.schema.simpleString().removeprefix("struct<")[:-1].replace(":", " "), reindex.latest_state, "complete", "latest", str(tmp_path / "c"))
    assert sorted(map(str, got.select("user_id", "event_id").collect())) == sorted(map(str, reindex.latest_state(batch).select("user_id", "event_id").collect()))
    seen = []
    os.makedirs(tmp_path / "w")
    (tmp_path / "w" / "a.ttl").write_text("<u:a> <u:p> <u:b> .")
    reindex.watch(spark, str(tmp_path / "w"), str(tmp_path / "c2"), lambda df, n: seen.extend(r.a for r in df.where(F.col("row") == "quad").collect()), once=True).awaitTermination()
    assert seen == ["u:a"]
