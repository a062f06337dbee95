"""Scalar functions and the Manchester syntax."""

import pytest
from pyspark.sql import functions as F

from lattica.functions import exprs as X
from lattica.functions import manchester as M
from lattica.model import LatticaError


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("iri, parser, graph, namespace", [
    ("http://x/a#b", "b", "b", "http://x/a#"),
    ("http://x/a/b", "b", "b", "http://x/a/"),
    ("http://x#a/b", "a/b", "b", "http://x#"),
    ("plain", "plain", "plain", "plain"),
    ("http://x/", "", "", "http://x/"),
])
def test_names(spark, iri, parser, graph, namespace):
    c = F.lit(iri)
    assert value(spark, X.short_name(c)) == parser
    assert value(spark, X.graph_short_name(c)) == graph
    assert value(spark, X.namespace_of(c)) == namespace


def test_normalisation(spark):
    assert value(spark, X.normalize_iri(F.lit("http://x/a/##"))) == "http://x/a"
    assert value(spark, X.normalize_label(F.lit('" ÀB c "'))) == "Àb c"
    assert [value(spark, X.parse_boolean_literal(F.lit(t))) for t in ("true", '"false"', '"1"^^xsd:boolean', "maybe")] == [True, False, True, None]


def test_curies_take_the_longest_namespace(spark):
    ns = F.create_map(*[F.lit(x) for x in ("a", "http://x/", "b", "http://x/y/", "c", "")])
    assert value(spark, X.curie(F.lit("http://x/y/z"), ns)) == "b:z"
    assert value(spark, X.curie(F.lit("http://www.w3.org/2002/07/owl#Class"), ns)) == "owl:Class"
    assert value(spark, X.curie(F.lit("urn:q"), ns)) is None
    assert value(spark, X.render_entity_iri(F.lit("http://q/r"))) == "r"
    assert value(spark, X.expand_prefixed(F.lit("b:k"), ns)) == "http://x/y/k"
    assert value(spark, X.expand_prefixed(F.lit("zz:k"), ns)) is None
    assert value(spark, X.expand_prefixed(F.lit("<urn:k>"), ns)) == "urn:k"


@pytest.mark.parametrize("text, head", [("p some C", ("p", "some")), ("p only (q some C)", ("p only (q", "some")), ("p exactly 2 C", ("", "complex")), ("p Self", ("p", "self")), ("p max 3 C", ("p", "max"))])
def test_restriction_header_scans_keywords_in_order(spark, text, head):
    r = value(spark, X.restriction_header(F.lit(text)))
    assert (r.property, r.kind) == head
    if head[1] == "complex":
        assert value(spark, X.restriction_parts(F.lit(text))).cardinality == 2


def test_restriction_detector(spark):
    texts = ["a some b", "Self", "x self", "Myself", "http://x/some", "a exactly 1 b", "ObjectHasSelf(p)"]
    assert [value(spark, X.is_restriction(F.lit(t))) for t in texts] == [True, True, True, False, False, False, True]


def test_links_do_not_overlap(spark):
    got = value(spark, X.links(F.lit("OMIMPS:12 OMIM:34 doi:10.1234/ab.c Wikipedia:X_(y)")))
    assert [(x.kind, x.start) for x in got] == [("OMIMPS", 0), ("OMIM", 10), ("DOI", 18), ("Wikipedia", 35)]
    got = value(spark, X.links(F.lit("orcid: 0000-1 ISBN:0123456789 Orphanet:7 WikipediaVersioned:A&oldid=3 PMID: 5")))
    assert [x.url for x in got] == ["https://orcid.org/0000-1", "http://www.isbnsearch.org/isbn/0123456789", "https://www.orpha.net/consor/cgi-bin/OC_Exp.php?Expert=7", "https://wikipedia.org/wiki/index.php?title=A&oldid=3", "http://www.ncbi.nlm.nih.gov/pubmed/5"]


def test_texts(spark):
    assert value(spark, X.strip_turtle(F.lit('<u#v> a "x # \\" y" . # c\n\'k\''))) == "<u#v> a  . \n"
    assert value(spark, X.bounded(F.lit("see (ex:ab) ."), F.lit("ex:ab"))) and not any(value(spark, X.bounded(F.lit(t), F.lit("ex:ab"))) for t in ("ex:abc", "ex:ab.c", "see ex:ab.", "x:ex:ab", "#ex:ab"))
    at = value(spark, X.first_location(F.lit("a\n  :bc :b"), F.lit(":b")))
    assert (at.line, at.column) == (2, 6)
    at = value(spark, X.first_location(F.lit("xx:ab x:a"), F.lit("x:a")))
    assert (at.line, at.column) == (1, 6)
    at = value(spark, X.first_location(F.lit("q:b\n p:b q:b"), F.lit("p:b"), F.lit("q:b")))
    assert (at.line, at.column) == (1, 0) and value(spark, X.first_location(F.lit("ab"), F.lit("a"))) is None
    assert value(spark, X.abbreviate(F.lit("abcdefgh"), 6)) == "abc..."
    zone = spark.conf.get("spark.sql.session.timeZone")
    for other in ("UTC", "Asia/Tokyo", "Europe/Berlin"):
        spark.conf.set("spark.sql.session.timeZone", other)
        # 01:30 UTC on 30 March 2025 has no local time in Berlin's change of clocks.
        assert [value(spark, X.iso_utc(F.lit(s))) for s in (0, 1743298200)] == ["1970-01-01T00:00:00Z", "2025-03-30T01:30:00Z"]
    spark.conf.set("spark.sql.session.timeZone", zone)
    assert value(spark, X.obo_id_to_iri(F.lit("GO:1"))) == "http://purl.obolibrary.org/obo/GO_1"


@pytest.mark.parametrize("text, complex_", [("http://x/some thing", False), ("<http://x/a and b>", False), ("http://x/a", False), ("ex:a", False), ("p some http://x/a", True), ("http://x/p only http://x/a", True), ("not ex:a", True), ("a and not b", True), ("(ex:a)", True), ("", False), ("p exactly 1 ex:a", True)])
def test_complex_expressions(spark, text, complex_):
    # Expressions hold whole IRIs: :// makes a name only of a text without white space.
    assert value(spark, X.is_complex_expression(F.lit(text))) is (complex_ if text != "http://x/some thing" else False)


EXPRESSIONS = ["hasPet some (Dog or Cat)", "p min 2 A and not (q only {a, b})", "p exactly 1", "p Self and r value \"x\"@en", "inverse p some A", "not A or B and C", "age some xsd:integer[>= 18, < 65]", "(A or B) and C", "p only (not A)"]


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_manchester_round_trip(text):
    ns = {"": "http://x/"}
    tree = M.parse(text, ns)
    assert M.parse(M.render(tree, ns), ns) == tree


@pytest.mark.parametrize("text", ["", "A and", "p some", "(A", "p min x A", "zz:A", "A B", "p some (A"])
def test_manchester_rejects(text):
    with pytest.raises(LatticaError):
        M.parse(text, {"": "http://x/"})


def test_keyword_first_restrictions():
    assert M.parse("some hasPet Dog", {"": ""}) == ("some", "hasPet", ("class", "Dog"))
    assert M.parse("min 2 hasPet Dog", {"": ""}) == ("min", 2, "hasPet", ("class", "Dog"))


def test_annotation_order(spark):
    iris = ["http://z/x", "http://a/x", "http://www.w3.org/2000/01/rdf-schema#comment", "http://purl.obolibrary.org/obo/IAO_0000115", "http://www.w3.org/2000/01/rdf-schema#label"]
    got = [r.p for r in spark.createDataFrame([(i,) for i in iris], "p string").orderBy(X.annotation_order("p")).collect()]
    assert got == [iris[4], iris[3], iris[2], iris[1], iris[0]]
    assert value(spark, X.entity_markdown(F.lit("'a b'"), F.lit("http://x"))) == "[a b](http://x)"


def test_long_names_and_tags_do_not_recurse(spark):
    from lattica.sources import rdf

    long = "'" + "a b\\' " * 100_000 + "' some X"
    row = spark.createDataFrame([(long,)], "e string").select(X.restriction_parts("e").alias("r")).first()
    assert row.r.kind == "some" and row.r.filler == "X" and len(row.r.property) == len(long) - 7
    line = '<s> <p> "x"@a' + "-b" * 200_000 + " ."
    assert rdf.parse_lines(spark.createDataFrame([(line, "d")], "value string, doc_id string")).first().ok
