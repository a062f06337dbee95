"""From one file's quads to catalog rows: entities, axioms of all kinds, annotations, imports.

Blank nodes are local to a file, so lists and nested expressions are put together here, in memory, where the file was
read. Complex expressions become Manchester text with whole IRIs."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from lattica.functions import manchester
from lattica.model import CHARACTERISTICS, COMMENT, DEPRECATED, ENTITY_TYPES, FIRST, IMPORTS, LABEL, NIL, NOTES, OBO_IN_OWL, OWL, RDF, RDFS, REST, SAME_AS, SKOS, SUB_CLASS, TYPE, XSD

_FACETS = {XSD + "minInclusive": ">=", XSD + "maxInclusive": "<=", XSD + "minExclusive": ">", XSD + "maxExclusive": "<", XSD + "length": "length", XSD + "minLength": "minLength", XSD + "maxLength": "maxLength", XSD + "pattern": "pattern"}
# Annotation properties that need no declaration.
_ANNOTATIONS = {LABEL, COMMENT, RDFS + "seeAlso", RDFS + "isDefinedBy", DEPRECATED, OWL + "versionInfo", OWL + "priorVersion", OWL + "backwardCompatibleWith", OWL + "incompatibleWith"}
_SPACES = (SKOS, "http://purl.org/dc/elements/1.1/", "http://purl.org/dc/terms/", OBO_IN_OWL, "http://purl.obolibrary.org/obo/IAO_", NOTES)


@dataclass
class Rows:
    ontology_iri: str | None = None
    version_iri: str | None = None
    imports: list[str] = field(default_factory=list)
    entities: dict[str, dict] = field(default_factory=dict)
    axioms: list[tuple] = field(default_factory=list)
    annotations: list[tuple] = field(default_factory=list)


class Bridge:
    def __init__(self, quads: list[tuple]):
        self.about: dict[str, dict[str, list[tuple]]] = defaultdict(lambda: defaultdict(list))
        self.order: list[tuple] = []
        for s, sk, p, o, ok, dt, lang, _ in dict.fromkeys(quads):
            key = ("_:" + s) if sk == "bnode" else s
            term = (("_:" + o) if ok == "bnode" else o, ok, dt, lang)
            self.about[key][p].append(term)
            self.order.append((key, p, term))
        self.rows = Rows()
        self.kinds: dict[str, set[str]] = defaultdict(set)

    def one(self, node: str, p: str) -> str | None:
        found = self.about[node][p] if node in self.about else []
        return found[0][0] if found else None

    def items(self, node: str) -> list[str]:
        out, seen = [], set()
        while node and node != NIL and node not in seen:
            seen.add(node)
            if (item := self.one(node, FIRST)) is not None:
                out.append(item)
            node = self.one(node, REST)
        return out

    def types(self, node: str) -> set[str]:
        return {t[0] for t in self.about[node][TYPE]} if node in self.about else set()

    # -- expressions

    def property_of(self, node: str) -> str:
        return "inverse " + (self.one(node, OWL + "inverseOf") or "") if node.startswith("_:") else node

    def literal(self, term: tuple) -> str:
        value = term[0].replace("\\", "\\\\").replace('"', '\\"')
        tail = f"@{term[3]}" if term[3] else f"^^<{term[2]}>" if term[2] and term[2] != XSD + "string" else ""
        return f'"{value}"{tail}'

    def expression(self, node: str, depth: int = 0) -> tuple:
        if not node.startswith("_:") or depth > 200:
            return ("datatype", node) if node.startswith(XSD) else ("class", node)
        a = self.about[node] if node in self.about else {}
        again = lambda x: self.expression(x, depth + 1)
        for p, kind in ((OWL + "intersectionOf", "and"), (OWL + "unionOf", "or")):
            if a.get(p):
                return (kind, [again(x) for x in self.items(a[p][0][0])])
        for p in (OWL + "complementOf", OWL + "datatypeComplementOf"):
            if a.get(p):
                return ("not", again(a[p][0][0]))
        if a.get(OWL + "oneOf"):
            return ("one_of", self.items(a[OWL + "oneOf"][0][0]))
        if a.get(OWL + "onDatatype"):
            facets = []
            for x in self.items(self.one(node, OWL + "withRestrictions") or NIL):
                facets += [(_FACETS[p], self.literal(v[0])) for p, v in self.about[x].items() if p in _FACETS]
            return ("facets", a[OWL + "onDatatype"][0][0], facets)
        if a.get(OWL + "onProperty"):
            prop = self.property_of(a[OWL + "onProperty"][0][0])
            for p, kind in ((OWL + "someValuesFrom", "some"), (OWL + "allValuesFrom", "only")):
                if a.get(p):
                    return (kind, prop, again(a[p][0][0]))
            if a.get(OWL + "hasValue"):
                v = a[OWL + "hasValue"][0]
                return ("value", prop, ("literal", self.literal(v)) if v[1] == "literal" else ("class", v[0]))
            if a.get(OWL + "hasSelf"):
                return ("self", prop)
            filler = self.one(node, OWL + "onClass") or self.one(node, OWL + "onDataRange")
            for name, kind in (("minQualifiedCardinality", "min"), ("maxQualifiedCardinality", "max"), ("qualifiedCardinality", "exactly"), ("minCardinality", "min"), ("maxCardinality", "max"), ("cardinality", "exactly")):
                if a.get(OWL + name):
                    n = a[OWL + name][0][0]
                    return (kind, int(n) if n.isdigit() else 0, prop, again(filler) if filler else None)
        return ("class", node)

    def text(self, node: str) -> str:
        return manchester.render(self.expression(node), plain=True)

    # -- rows

    def axiom(self, kind: str, s: str, o: str, p: str = "", annotations: list | None = None) -> None:
        self.rows.axioms.append((kind, s, p, o, annotations or []))

    def pairs(self, kind: str, members: list[str], text: bool = False) -> None:
        for i, x in enumerate(members):
            if not x.startswith("_:"):
                for j, y in enumerate(members):
                    if i != j:
                        self.axiom(kind, x, self.text(y) if text else y)

    def declare(self) -> None:
        for node, properties in list(self.about.items()):
            for t, _, _, _ in properties.get(TYPE, []):
                for kind, types in ENTITY_TYPES.items():
                    if t in types:
                        self.kinds[node].add(kind)
                if t in CHARACTERISTICS.values():
                    self.kinds[node].add("data_property" if t == CHARACTERISTICS["functional"] and OWL + "DatatypeProperty" in self.types(node) else "object_property")

    def kind(self, iri: str) -> str:
        return next((k for k in ENTITY_TYPES if k in self.kinds.get(iri, ())), "other")

    def is_individual(self, node: str) -> bool:
        return self.kind(node) in ("individual", "other") and not node.startswith("_:")

    def run(self) -> Rows:
        rows = self.rows
        self.declare()
        for node in [n for n, k in self.kinds.items() if "ontology" in k]:
            if not node.startswith("_:") and rows.ontology_iri is None:
                rows.ontology_iri = node
            rows.version_iri = rows.version_iri or self.one(node, OWL + "versionIRI")
            rows.imports += [t[0] for t in self.about[node][IMPORTS]]
        reified = defaultdict(list)
        for node in list(self.about):
            if OWL + "Axiom" in self.types(node):
                key = tuple(self.one(node, OWL + x) for x in ("annotatedSource", "annotatedProperty", "annotatedTarget"))
                reified[key] += [(p, t[0]) for p, ts in self.about[node].items() for t in ts if p not in (TYPE, OWL + "annotatedSource", OWL + "annotatedProperty", OWL + "annotatedTarget")]
        builtin = {t for ts in ENTITY_TYPES.values() for t in ts} | set(CHARACTERISTICS.values())
        for s, p, term in self.order:
            o, ok = term[0], term[1]
            notes = reified.get((s, p, o), [])
            named = not s.startswith("_:")
            if p == SUB_CLASS and named:
                self.axiom("sub_class_of", s, self.text(o), "", notes)
            elif p == OWL + "equivalentClass":
                if self.kind(s) == "datatype":
                    self.axiom("datatype_definition", s, self.text(o))
                else:
                    self.pairs("equivalent_class", [s, o], text=True)
            elif p == OWL + "disjointWith":
                self.pairs("disjoint_class", [s, o], text=True)
            elif p == OWL + "disjointUnionOf" and named:
                self.axiom("disjoint_union", s, " | ".join(map(self.text, self.items(o))))
            elif p == OWL + "hasKey" and named:
                self.axiom("has_key", s, " | ".join(self.items(o)))
            elif p == OWL + "inverseOf" and named and not o.startswith("_:"):
                self.axiom("inverse_object_properties", s, o)
                self.axiom("inverse_object_properties", o, s)
            elif p in (OWL + "equivalentProperty", OWL + "propertyDisjointWith"):
                kind = "data" if self.kind(s) == "data_property" else "object"
                self.pairs(f"{'equivalent' if p.endswith('equivalentProperty') else 'disjoint'}_{kind}_properties", [s, o])
            elif p == RDFS + "domain" and named:
                if not o.startswith("_:"):
                    self.axiom("domain", s, o)
            elif p == RDFS + "range" and named:
                if not o.startswith("_:") or self.kind(s) == "data_property":
                    self.axiom("range", s, self.text(o))
            elif p == OWL + "propertyChainAxiom" and named:
                self.axiom("property_chain", s, " o ".join(map(self.property_of, self.items(o))))
            elif p == RDFS + "subPropertyOf" and named:
                if self.kind(s) in ("object_property", "data_property"):
                    self.axiom("sub_data_property_of" if self.kind(s) == "data_property" else "sub_object_property_of", s, self.property_of(o))
            elif p == SAME_AS:
                self.pairs("same_individual", [s, o])
                if named:
                    rows.annotations.append((s, p, o))
            elif p == OWL + "differentFrom":
                self.pairs("different_individuals", [s, o])
            elif p == TYPE:
                if named and o not in builtin and not o.startswith((OWL, RDF)) or named and o == OWL + "Thing":
                    self.axiom("class_assertion", s, self.text(o), TYPE)
                    self.kinds[s].add("individual") if not self.kinds[s] else None
            elif p in _ANNOTATIONS or p.startswith(_SPACES) or self.kind(p) == "annotation_property":
                if named:
                    rows.annotations.append((s, p, o))
            elif named and not p.startswith((OWL, RDF, RDFS)):
                if ok == "literal":
                    if self.kind(p) == "data_property":
                        self.axiom("data_property_assertion", s, o, p)
                    else:
                        rows.annotations.append((s, p, o))
                elif not o.startswith("_:"):
                    self.axiom("object_property_assertion", s, o, p)
        for node in list(self.about):
            types = self.types(node)
            members = self.items(self.one(node, OWL + "members") or self.one(node, OWL + "distinctMembers") or NIL)
            if OWL + "AllDifferent" in types:
                self.pairs("different_individuals", members)
            elif OWL + "AllDisjointClasses" in types:
                self.pairs("disjoint_class", members, text=True)
            elif OWL + "AllDisjointProperties" in types:
                self.pairs("disjoint_data_properties" if members and self.kind(members[0]) == "data_property" else "disjoint_object_properties", members)
            elif OWL + "NegativePropertyAssertion" in types:
                s, p = self.one(node, OWL + "sourceIndividual"), self.one(node, OWL + "assertionProperty")
                value = self.one(node, OWL + "targetValue")
                if s and p:
                    self.axiom("negative_data_property_assertion" if value is not None else "negative_object_property_assertion", s, value if value is not None else self.one(node, OWL + "targetIndividual") or "", p)
            if OWL + "intersectionOf" in self.about[node] and not node.startswith("_:"):
                self.axiom("equivalent_class", node, manchester.render(("and", [self.expression(x) for x in self.items(self.one(node, OWL + "intersectionOf"))]), plain=True))
        for iri in self.kinds:
            if not iri.startswith("_:") and self.kind(iri) not in ("ontology", "other") and not iri.startswith((OWL, RDF, RDFS, XSD)):
                a = self.about[iri] if iri in self.about else {}
                texts = lambda p: [t[0] for t in a.get(p, [])]
                rows.entities[iri] = {"kind": self.kind(iri), "labels": texts(LABEL), "comments": texts(COMMENT), "deprecated": (texts(DEPRECATED) or ["false"])[-1] in ("true", "1"), "obo_id": next(iter(texts(OBO_IN_OWL + "id")), None), "characteristics": {k: t in self.types(iri) for k, t in CHARACTERISTICS.items()}}
        return rows


def bridge(quads: list[tuple]) -> Rows:
    return Bridge(quads).run()
