"""OWL/XML output: all kinds of axioms survive writing and reading."""

import glob

from lattica.sources import owx_write, scan

HEAD = "@prefix : <http://r/#> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n@prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
BODY = """<http://r/> a owl:Ontology ; owl:imports <http://other/> .
:A a owl:Class ; rdfs:label "a & <b>" , "é\\r\\n𝒳"@en ; rdfs:subClassOf :B , [ a owl:Restriction ; owl:onProperty :p ; owl:someValuesFrom [ a owl:Class ; owl:intersectionOf ( :B [ a owl:Class ; owl:complementOf :C ] ) ] ] .
:B a owl:Class ; owl:equivalentClass :C ; owl:disjointWith :D ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty :d ; owl:someValuesFrom xsd:int ] , [ a owl:Restriction ; owl:onProperty :p ; owl:maxQualifiedCardinality "3"^^xsd:nonNegativeInteger ; owl:onClass :A ] , [ a owl:Restriction ; owl:onProperty :p ; owl:minCardinality "1"^^xsd:nonNegativeInteger ] , [ a owl:Restriction ; owl:onProperty :p ; owl:hasValue :i ] , [ a owl:Restriction ; owl:onProperty :p ; owl:hasSelf true ] , [ a owl:Restriction ; owl:onProperty :d ; owl:hasValue "5"^^xsd:int ] , [ a owl:Restriction ; owl:onProperty [ owl:inverseOf :p ] ; owl:allValuesFrom :D ] .
:C a owl:Class ; owl:equivalentClass [ a owl:Class ; owl:unionOf ( :A :D ) ] , [ a owl:Class ; owl:oneOf ( :i :j ) ] .
:D a owl:Class ; owl:disjointUnionOf ( :A :E ) ; owl:hasKey ( :p :q ) .
:E a owl:Class ; owl:disjointWith [ a owl:Restriction ; owl:onProperty :p ; owl:someValuesFrom :A ] .
[] a owl:AllDisjointClasses ; owl:members ( :A :D :E ) .
:p a owl:ObjectProperty , owl:TransitiveProperty , owl:SymmetricProperty ; rdfs:domain :A ; rdfs:range :B ; owl:inverseOf :q ; rdfs:subPropertyOf :q ; owl:propertyChainAxiom ( :p :q :r ) ; owl:equivalentProperty :r ; owl:propertyDisjointWith :s .
:q a owl:ObjectProperty , owl:InverseFunctionalProperty . :r a owl:ObjectProperty . :s a owl:ObjectProperty .
:d a owl:DatatypeProperty , owl:FunctionalProperty ; rdfs:domain :A ; rdfs:range [ a rdfs:Datatype ; owl:onDatatype xsd:integer ; owl:withRestrictions ( [ xsd:minInclusive 5 ] [ xsd:maxExclusive 9 ] ) ] ; rdfs:subPropertyOf :e ; owl:equivalentProperty :f ; owl:propertyDisjointWith :e .
:e a owl:DatatypeProperty . :f a owl:DatatypeProperty . :n a owl:AnnotationProperty .
:t a rdfs:Datatype ; owl:equivalentClass [ a rdfs:Datatype ; owl:oneOf ( "x" "y" ) ] .
:i a owl:NamedIndividual , :A , [ a owl:Restriction ; owl:onProperty :p ; owl:someValuesFrom :B ] ; :p :j ; :d "v<&>" ; owl:sameAs :k ; owl:differentFrom :j ; :n "note" . :j a owl:NamedIndividual . :k a owl:NamedIndividual .
[] a owl:NegativePropertyAssertion ; owl:sourceIndividual :i ; owl:assertionProperty :p ; owl:targetIndividual :k .
[] a owl:NegativePropertyAssertion ; owl:sourceIndividual :i ; owl:assertionProperty :d ; owl:targetValue "no" .
"""


def rows(c):
    axioms = {tuple(r) for r in c.axioms.select("axiom_kind", "subject", "predicate", "object").collect()}
    entities = {(r.iri, r.kind, tuple(r.characteristics)) for r in c.entities.where("kind <> 'ontology'").collect()}
    return axioms, entities, {tuple(r) for r in c.annotations.select("subject", "predicate", "object").collect()}


def test_all_kinds_survive(spark, tmp_path):
    c = scan.index_texts(spark, {"/r.ttl": HEAD + BODY}, lint=False)
    body = "\n".join(r.value for r in owx_write.to_owlxml(c).collect())
    again = scan.index_texts(spark, {"/r.owx": owx_write.head("http://r/", ["http://other/"]) + body + "\n" + owx_write.TAIL}, lint=False)
    before, after = rows(c), rows(again)
    kinds = {a[0] for a in before[0]}
    assert len(kinds) >= 22, kinds
    assert after[0] == before[0]
    assert after[1] == before[1] and after[2] == before[2]
    assert [tuple(r) for r in again.imports.collect()] == [("http://r/", "http://other/")]
    assert {r.parse_status for r in again.documents.collect()} == {"ok"}
    owx_write.write_owlxml(c, str(tmp_path / "out"))
    files = {f: open(f, encoding="utf-8", newline="").read() for f in glob.glob(str(tmp_path / "out" / "*" / "*.txt"))}
    texts = {f"/f{k}.owx": t for k, t in enumerate(files.values()) if t}
    assert texts and rows(scan.index_texts(spark, texts, lint=False))[0] == before[0]
