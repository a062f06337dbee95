"""OWL/XML output: an element for each axiom, annotation and declaration, printed where the rows are.

Class expressions are read from their Manchester text and printed as nested elements. Each row's element declares the
properties that it needs to be read again by itself, so any of them are a document between ``head`` and ``TAIL``. Axioms
that the catalog holds in both directions are written once. What the catalog doesn't hold (datatypes of asserted values)
isn't written."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.catalog import Catalog
from lattica.functions import manchester
from lattica.model import OWL, XSD, LatticaError

TAIL = "</Ontology>\n"
# Facets and the IRIs that they are written as; kinds of entities and characteristics and their elements.
FACETS = {">=": "minInclusive", "<=": "maxInclusive", ">": "minExclusive", "<": "maxExclusive", "length": "length", "minLength": "minLength", "maxLength": "maxLength", "pattern": "pattern"}
ENTITIES = {"class": "Class", "object_property": "ObjectProperty", "data_property": "DataProperty", "annotation_property": "AnnotationProperty", "individual": "NamedIndividual", "datatype": "Datatype"}
CHARACTERISTICS = {"functional": "Functional", "inverse_functional": "InverseFunctional", "transitive": "Transitive", "symmetric": "Symmetric", "asymmetric": "Asymmetric", "reflexive": "Reflexive", "irreflexive": "Irreflexive"}
#: Kinds that the catalog holds as pairs in both directions.
PAIRS = {"equivalent_class": ("EquivalentClasses", "Class"), "disjoint_class": ("DisjointClasses", "Class"), "inverse_object_properties": ("InverseObjectProperties", "ObjectProperty"), "equivalent_object_properties": ("EquivalentObjectProperties", "ObjectProperty"), "disjoint_object_properties": ("DisjointObjectProperties", "ObjectProperty"), "equivalent_data_properties": ("EquivalentDataProperties", "DataProperty"), "disjoint_data_properties": ("DisjointDataProperties", "DataProperty"), "same_individual": ("SameIndividual", "NamedIndividual"), "different_individuals": ("DifferentIndividuals", "NamedIndividual")}
_LITERAL = re.compile(r'"((?:[^"\\]|\\.)*+)"(?:@([A-Za-z-]+)|\^\^<?([^<>\s]+?)>?)?', re.S)


def head(ontology: str, imports: list[str] = ()) -> str:
    about = f" ontologyIRI={quoteattr(ontology)}" if ontology else ""
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<Ontology xmlns="{OWL}"{about}>\n' + "".join(f"<Import>{escape(x)}</Import>\n" for x in imports)


def _entity(tag: str, iri: str) -> str:
    return f"<{tag} IRI={quoteattr(iri)}/>"


def _element(tag: str, *inside: str, **attributes: str) -> str:
    return f"<{tag}" + "".join(f" {k}={quoteattr(v)}" for k, v in attributes.items()) + ">" + "".join(inside) + f"</{tag}>"


def _text(value: str) -> str:
    return escape(value, {"\r": "&#13;"})


def _literal(text: str) -> str:
    m = _LITERAL.fullmatch(text)
    if not m:
        kind = "integer" if re.fullmatch(r"[+-]?\d+", text) else "decimal" if re.fullmatch(r"[+-]?\d*\.\d+", text) else "string"
        return f'<Literal datatypeIRI="{XSD}{kind}">{_text(text)}</Literal>'
    mark = f' xml:lang="{m[2]}"' if m[2] else f" datatypeIRI={quoteattr(m[3])}" if m[3] else ""
    return f"<Literal{mark}>{_text(re.sub(r'\\(.)', r'\1', m[1]))}</Literal>"


def _property(p: str, data: bool) -> str:
    if p.startswith("inverse "):
        return _element("ObjectInverseOf", _entity("ObjectProperty", p[8:]))
    return _entity("DataProperty" if data else "ObjectProperty", p)


def _is_data(t: tuple | None) -> bool:
    return t is not None and (t[0] in ("datatype", "facets", "literal") or t[0] == "one_of" and t[1][0][:1] in '"+-0123456789' or t[0] in ("and", "or") and all(map(_is_data, t[1])) or t[0] == "not" and _is_data(t[1]))


def expression(t: tuple) -> str:
    kind, data = t[0], _is_data(t)
    side = "Data" if data else "Object"
    if kind in ("class", "datatype"):
        return _entity("Class" if kind == "class" else "Datatype", t[1])
    if kind in ("and", "or"):
        return _element(f"{side}{'Intersection' if kind == 'and' else 'Union'}Of", *map(expression, t[1]))
    if kind == "not":
        return _element(f"{side}ComplementOf", expression(t[1]))
    if kind == "one_of":
        return _element(f"{side}OneOf", *(_literal(x) if data else _entity("NamedIndividual", x) for x in t[1]))
    if kind == "facets":
        return _element("DatatypeRestriction", _entity("Datatype", t[1]), *(_element("FacetRestriction", _literal(v), facet=XSD + FACETS[f]) for f, v in t[2]))
    if kind in ("some", "only"):
        side = "Data" if _is_data(t[2]) else "Object"
        return _element(f"{side}{'Some' if kind == 'some' else 'All'}ValuesFrom", _property(t[1], side == "Data"), expression(t[2]))
    if kind == "value":
        side = "Data" if t[2][0] == "literal" else "Object"
        return _element(f"{side}HasValue", _property(t[1], side == "Data"), _literal(t[2][1]) if side == "Data" else _entity("NamedIndividual", t[2][1]))
    if kind == "self":
        return _element("ObjectHasSelf", _property(t[1], False))
    if kind in ("min", "max", "exactly"):
        side = "Data" if _is_data(t[3]) else "Object"
        return _element(f"{side}{ {'min': 'Min', 'max': 'Max', 'exactly': 'Exact'}[kind] }Cardinality", _property(t[2], side == "Data"), *([expression(t[3])] if t[3] else []), cardinality=str(t[1]))
    raise LatticaError(f"an expression of kind {kind} can't be written")


def _class(text: str) -> str:
    return expression(manchester.parse(text))


def _declared(tag: str, iri: str) -> str:
    return _element("Declaration", _entity(tag, iri)) if not iri.startswith("inverse ") else ""


def axiom(kind: str, s: str, p: str, o: str, data: bool, notes: list | None = None) -> str:
    """The element of an axiom; data: its subject is a data property."""
    said = "".join(_element("Annotation", _entity("AnnotationProperty", n["predicate"]), _element("Literal", _text(n["value"]))) for n in notes or [])
    side = "Data" if data else "Object"
    if kind in PAIRS:
        tag, of = PAIRS[kind]
        known = "".join(_declared(of, x) for x in (s, o)) if of.endswith("Property") else ""
        return known + _element(tag, said, _entity(of, s), _class(o) if of == "Class" else _entity(of, o))
    if kind == "sub_class_of":
        return _element("SubClassOf", said, _entity("Class", s), _class(o))
    if kind == "disjoint_union":
        return _element("DisjointUnion", said, _entity("Class", s), *map(_class, o.split(" | ")))
    if kind == "has_key":
        return _element("HasKey", said, _entity("Class", s), *(_property(x, False) for x in o.split(" | ")))
    if kind in ("domain", "range"):
        return _declared(f"{side}Property", s) + _element(f"{side}Property{kind.title()}", said, _entity(f"{side}Property", s), _class(o))
    if kind == "property_chain":
        return _declared("ObjectProperty", s) + _element("SubObjectPropertyOf", said, _element("ObjectPropertyChain", *(_property(x, False) for x in o.split(" o "))), _entity("ObjectProperty", s))
    if kind in ("sub_object_property_of", "sub_data_property_of"):
        side = "Object" if "object" in kind else "Data"
        return _declared(f"{side}Property", s) + _element(f"Sub{side}PropertyOf", said, _entity(f"{side}Property", s), _property(o, side == "Data"))
    if kind == "class_assertion":
        return _element("ClassAssertion", said, _class(o), _entity("NamedIndividual", s))
    if kind == "datatype_definition":
        return _declared("Datatype", s) + _element("DatatypeDefinition", said, _entity("Datatype", s), _class(o))
    if kind.endswith("property_assertion"):
        side = "Object" if "object" in kind else "Data"
        value = _entity("NamedIndividual", o) if side == "Object" else _element("Literal", _text(o))
        return _declared(f"{side}Property", p) + _element(f"{'Negative' if kind.startswith('negative') else ''}{side}PropertyAssertion", said, _entity(f"{side}Property", p), _entity("NamedIndividual", s), value)
    raise LatticaError(f"an axiom of kind {kind} can't be written")


def to_owlxml(catalog: Catalog) -> DataFrame:
    """ontology_id, value: the elements of all axioms, annotations, declarations and characteristics."""
    data = catalog.entities.where("kind = 'data_property'").select(F.col("iri").alias("subject"), F.lit(True).alias("data")).distinct()
    named = ~F.col("object").rlike(r"[\s(){}\[\]]")
    once = ~F.col("axiom_kind").isin(*PAIRS) | ~named | (F.col("subject") <= F.col("object"))
    # A pair of which only the other direction is held is written as it is.
    back = catalog.axioms.where(F.col("axiom_kind").isin(*PAIRS)).select("ontology_id", "axiom_kind", F.col("object").alias("subject"), F.col("subject").alias("object"), F.lit(True).alias("both")).distinct()
    ax = catalog.axioms.where(F.col("axiom_kind").isNotNull()).join(back, ["ontology_id", "axiom_kind", "subject", "object"], "left").where(once | F.col("both").isNull())
    ax = ax.join(data, "subject", "left").select("ontology_id", "axiom_kind", "subject", F.coalesce("predicate", F.lit("")), "object", F.coalesce("data", F.lit(False)), "annotations")

    def printed(df: DataFrame, row) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([row(*r) for r in zip(*columns[1:])], pa.string())], names=["ontology_id", "value"])

        return df.mapInArrow(run, "ontology_id string, value string")

    def entity(kind: str, iri: str, flags: dict | None) -> str:
        tag = ENTITIES[kind]
        return _declared(tag, iri) + "".join(_element(f"{CHARACTERISTICS[k]}{tag}", _entity(tag, iri)) for k, v in (flags or {}).items() if v and tag.endswith("Property"))

    note = lambda s, p, o: _declared("AnnotationProperty", p) + _element("AnnotationAssertion", _entity("AnnotationProperty", p), _element("IRI", _text(s)), _element("Literal", _text(o)))
    entities = catalog.entities.where(F.col("kind").isin(*ENTITIES)).select("ontology_id", "kind", "iri", "characteristics")
    notes = catalog.annotations.select("ontology_id", "subject", "predicate", "object")
    return reduce(DataFrame.union, [printed(entities, entity), printed(ax, axiom), printed(notes, note)])


def write_owlxml(catalog: Catalog, path: str) -> None:
    """A folder of files, each a document; a file for each ontology and partition."""
    imports = {r.ontology_id: sorted(r.i) for r in catalog.imports.groupBy("ontology_id").agg(F.collect_set("import_iri").alias("i")).collect()}

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            lines = []
            for ontology, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ontology != now:
                    lines += ([TAIL.strip()] if now is not None else []) + [head(ontology or "", imports.get(ontology, ())).rstrip("\n")]
                    now = ontology
                lines.append(value)
            yield pa.RecordBatch.from_pydict({"key": pa.array([now] * len(lines), pa.string()), "value": pa.array(lines, pa.string())})
        if now is not None:
            yield pa.RecordBatch.from_pydict({"key": pa.array([now], pa.string()), "value": pa.array([TAIL.strip()], pa.string())})

    # An ontology's rows are together in a task, so that a file holds one document.
    rows = to_owlxml(catalog)
    keys = [r.ontology_id for r in rows.select("ontology_id").distinct().collect()]
    for k, key in enumerate(keys):
        own = rows.where(F.col("ontology_id").eqNullSafe(key))
        own.mapInArrow(documents, "key string, value string").select("value").write.mode("overwrite").text(f"{path}/{k}")
