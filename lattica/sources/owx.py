"""OWL/XML: axioms to the quads that say the same."""

from __future__ import annotations

import itertools
import xml.etree.ElementTree as ET

from lattica.model import CHARACTERISTICS, FIRST, IMPORTS, NIL, OWL, RDFS, REST, SAME_AS, SUB_CLASS, TYPE, XSD
from lattica.sources.rdf import Parsed, _xml

_O = "{" + OWL + "}"
_DECLARED = {"Class": OWL + "Class", "ObjectProperty": OWL + "ObjectProperty", "DataProperty": OWL + "DatatypeProperty", "AnnotationProperty": OWL + "AnnotationProperty", "NamedIndividual": OWL + "NamedIndividual", "Datatype": RDFS + "Datatype"}
_NARY = {"EquivalentClasses": OWL + "equivalentClass", "SameIndividual": SAME_AS, "EquivalentObjectProperties": OWL + "equivalentProperty", "EquivalentDataProperties": OWL + "equivalentProperty"}
_ALL = {"DisjointClasses": ("AllDisjointClasses", "members"), "DifferentIndividuals": ("AllDifferent", "distinctMembers"), "DisjointObjectProperties": ("AllDisjointProperties", "members"), "DisjointDataProperties": ("AllDisjointProperties", "members")}
_PAIR = {"SubClassOf": SUB_CLASS, "SubObjectPropertyOf": RDFS + "subPropertyOf", "SubDataPropertyOf": RDFS + "subPropertyOf", "ObjectPropertyDomain": RDFS + "domain", "DataPropertyDomain": RDFS + "domain", "ObjectPropertyRange": RDFS + "range", "DataPropertyRange": RDFS + "range", "InverseObjectProperties": OWL + "inverseOf", "DatatypeDefinition": OWL + "equivalentClass"}
_LISTS = {"ObjectIntersectionOf": "intersectionOf", "ObjectUnionOf": "unionOf", "DataIntersectionOf": "intersectionOf", "DataUnionOf": "unionOf", "ObjectOneOf": "oneOf", "DataOneOf": "oneOf"}
_VALUES = {"ObjectSomeValuesFrom": "someValuesFrom", "DataSomeValuesFrom": "someValuesFrom", "ObjectAllValuesFrom": "allValuesFrom", "DataAllValuesFrom": "allValuesFrom", "ObjectHasValue": "hasValue", "DataHasValue": "hasValue"}
_COUNTS = {"Min": "min", "Max": "max", "Exact": ""}


class _Owx:
    def __init__(self, root: ET.Element, out: Parsed):
        self.out, self.fresh = out, itertools.count()
        self.prefixes = {e.get("name", ""): e.get("IRI", "") for e in root.iter(_O + "Prefix")}
        out.prefixes.clear()
        out.prefixes |= self.prefixes
        self.base = root.get("{http://www.w3.org/XML/1998/namespace}base", root.get("ontologyIRI", ""))

    def emit(self, s: tuple, p: str, o: tuple) -> None:
        self.out.quads.append((s[0], s[1], p, *o, None))

    def blank(self) -> tuple:
        return (f"genid{next(self.fresh)}", "bnode", None, None)

    def iri(self, e: ET.Element) -> tuple:
        if (short := e.get("abbreviatedIRI")) is not None:
            prefix, _, local = short.partition(":")
            return (self.prefixes.get(prefix, prefix + ":") + local, "iri", None, None)
        text = e.get("IRI") if e.get("IRI") is not None else (e.text or "").strip()
        if e.tag == _O + "AbbreviatedIRI":
            prefix, _, local = text.partition(":")
            return (self.prefixes.get(prefix, "") + local, "iri", None, None)
        return (self.base + text if text.startswith("#") else text, "iri", None, None)

    def collection(self, items: list[tuple]) -> tuple:
        cells = [self.blank() for _ in items] + [(NIL, "iri", None, None)]
        for cell, item, after in zip(cells, items, cells[1:]):
            self.emit(cell, FIRST, item)
            self.emit(cell, REST, after)
        return cells[0]

    def term(self, e: ET.Element) -> tuple:
        tag = e.tag.removeprefix(_O)
        if tag == "Literal":
            lang = e.get("{http://www.w3.org/XML/1998/namespace}lang")
            return (e.text or "", "literal", None if lang else e.get("datatypeIRI", XSD + "string"), lang and lang.lower())
        if tag in _DECLARED or tag in ("IRI", "AbbreviatedIRI"):
            return self.iri(e)
        if tag == "AnonymousIndividual":
            return (e.get("nodeID", "").removeprefix("_:"), "bnode", None, None)
        own = self.blank()
        if tag in _LISTS:
            self.emit(own, OWL + _LISTS[tag], self.collection([self.term(c) for c in e]))
        elif tag in ("ObjectComplementOf", "DataComplementOf"):
            self.emit(own, OWL + "complementOf", self.term(e[0]))
        elif tag == "ObjectInverseOf":
            self.emit(own, OWL + "inverseOf", self.term(e[0]))
        elif tag in _VALUES:
            self.emit(own, OWL + "onProperty", self.term(e[0]))
            self.emit(own, OWL + _VALUES[tag], self.term(e[1]))
        elif tag == "ObjectHasSelf":
            self.emit(own, OWL + "onProperty", self.term(e[0]))
            self.emit(own, OWL + "hasSelf", ("true", "literal", XSD + "boolean", None))
        elif tag.endswith("Cardinality"):
            kind = next(v for k, v in _COUNTS.items() if k in tag)
            name = f"{kind}{'Qualified' if len(e) > 1 else ''}Cardinality"
            self.emit(own, OWL + "onProperty", self.term(e[0]))
            self.emit(own, OWL + name[0].lower() + name[1:], (e.get("cardinality", "0"), "literal", XSD + "nonNegativeInteger", None))
            if len(e) > 1:
                self.emit(own, OWL + ("onClass" if tag.startswith("Object") else "onDataRange"), self.term(e[1]))
        elif tag == "DatatypeRestriction":
            facets = []
            for f in e[1:]:
                cell = self.blank()
                self.emit(cell, f.get("facet", ""), self.term(f[0]))
                facets.append(cell)
            self.emit(own, OWL + "onDatatype", self.term(e[0]))
            self.emit(own, OWL + "withRestrictions", self.collection(facets))
        return own

    def axiom(self, e: ET.Element) -> None:
        tag = e.tag.removeprefix(_O)
        parts = [c for c in e if c.tag != _O + "Annotation"]
        if tag == "Declaration":
            kind = parts[0].tag.removeprefix(_O)
            self.emit(self.iri(parts[0]), TYPE, (_DECLARED[kind], "iri", None, None))
        elif tag == "AnnotationAssertion":
            self.emit(self.term(parts[1]), self.term(parts[0])[0], self.term(parts[2]))
        elif tag == "SubObjectPropertyOf" and parts[0].tag == _O + "ObjectPropertyChain":
            self.emit(self.term(parts[1]), OWL + "propertyChainAxiom", self.collection([self.term(c) for c in parts[0]]))
        elif tag in _PAIR:
            self.emit(self.term(parts[0]), _PAIR[tag], self.term(parts[1]))
        elif tag in _NARY:
            terms = [self.term(c) for c in parts]
            for x in terms[1:]:
                self.emit(terms[0], _NARY[tag], x)
        elif tag in _ALL:
            own = self.blank()
            self.emit(own, TYPE, (OWL + _ALL[tag][0], "iri", None, None))
            self.emit(own, OWL + _ALL[tag][1], self.collection([self.term(c) for c in parts]))
        elif tag == "DisjointUnion":
            self.emit(self.term(parts[0]), OWL + "disjointUnionOf", self.collection([self.term(c) for c in parts[1:]]))
        elif tag == "HasKey":
            self.emit(self.term(parts[0]), OWL + "hasKey", self.collection([self.term(c) for c in parts[1:]]))
        elif tag == "ClassAssertion":
            self.emit(self.term(parts[1]), TYPE, self.term(parts[0]))
        elif tag in ("ObjectPropertyAssertion", "DataPropertyAssertion"):
            self.emit(self.term(parts[1]), self.term(parts[0])[0], self.term(parts[2]))
        elif tag in ("NegativeObjectPropertyAssertion", "NegativeDataPropertyAssertion"):
            own = self.blank()
            self.emit(own, TYPE, (OWL + "NegativePropertyAssertion", "iri", None, None))
            for name, c in zip(("assertionProperty", "sourceIndividual", "targetIndividual" if "Object" in tag else "targetValue"), parts):
                self.emit(own, OWL + name, self.term(c))
        elif tag.endswith(("ObjectProperty", "DataProperty")):
            name = tag.removesuffix("ObjectProperty").removesuffix("DataProperty")
            key = next((t for k, t in CHARACTERISTICS.items() if k.replace("_", "") == name.lower()), None)
            if key:
                self.emit(self.term(parts[0]), TYPE, (key, "iri", None, None))


def parse_owx(text: str, base: str = "") -> Parsed:
    out = Parsed()
    root = _xml(text, out)
    if root is None:
        return out
    reader = _Owx(root, out)
    if iri := root.get("ontologyIRI"):
        own = (iri, "iri", None, None)
        reader.emit(own, TYPE, (OWL + "Ontology", "iri", None, None))
        for e in root.findall(_O + "Import"):
            reader.emit(own, IMPORTS, ((e.text or "").strip(), "iri", None, None))
    for e in root:
        try:
            reader.axiom(e)
        except (IndexError, KeyError, StopIteration) as x:
            out.error = out.error or f"bad axiom {e.tag}: {x}"
    return out
