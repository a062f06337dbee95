"""Vocabulary, axiom kinds, limits and the schemas of the catalog's frames."""

from __future__ import annotations

from pyspark.sql import types as T

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
OBO_IN_OWL = "http://www.geneontology.org/formats/oboInOwl#"
OBO_PURL = "http://purl.obolibrary.org/obo/"

TYPE, LABEL, COMMENT, SUB_CLASS = RDF + "type", RDFS + "label", RDFS + "comment", RDFS + "subClassOf"
DEPRECATED, IMPORTS, SAME_AS = OWL + "deprecated", OWL + "imports", OWL + "sameAs"
THING, NOTHING, NAMED_INDIVIDUAL = OWL + "Thing", OWL + "Nothing", OWL + "NamedIndividual"
FIRST, REST, NIL = RDF + "first", RDF + "rest", RDF + "nil"
# The namespace of annotations in files on disk, and its predicate whose literals hold rules.
NOTES = "http://ontocode.dev/ns#"
SWRL_RULE = NOTES + "swrlRule"

# Kinds of axioms.
AXIOM_KINDS = [
    "sub_class_of", "equivalent_class", "disjoint_class", "disjoint_union", "has_key", "inverse_object_properties",
    "equivalent_object_properties", "disjoint_object_properties", "equivalent_data_properties", "disjoint_data_properties",
    "domain", "range", "property_chain", "sub_object_property_of", "sub_data_property_of", "class_assertion",
    "object_property_assertion", "data_property_assertion", "negative_object_property_assertion",
    "negative_data_property_assertion", "same_individual", "different_individuals", "datatype_definition",
]
# Kinds of entities and the types that declare them, first match wins.
ENTITY_TYPES = {
    "class": [OWL + "Class", RDFS + "Class"],
    "object_property": [OWL + "ObjectProperty"],
    "data_property": [OWL + "DatatypeProperty"],
    "annotation_property": [OWL + "AnnotationProperty"],
    "individual": [NAMED_INDIVIDUAL],
    "datatype": [RDFS + "Datatype"],
    "ontology": [OWL + "Ontology"],
}
# Property characteristics.
CHARACTERISTICS = {
    "functional": OWL + "FunctionalProperty", "inverse_functional": OWL + "InverseFunctionalProperty", "transitive": OWL + "TransitiveProperty",
    "symmetric": OWL + "SymmetricProperty", "asymmetric": OWL + "AsymmetricProperty", "reflexive": OWL + "ReflexiveProperty", "irreflexive": OWL + "IrreflexiveProperty",
}
# File formats by extension.
FORMATS = {"ttl": "turtle", "rdf": "rdf_xml", "owl": "owl", "owx": "owl_xml", "jsonld": "json_ld", "json-ld": "json_ld", "nt": "n_triples", "nq": "n_quads", "trig": "trig", "obo": "obo"}
# Prefixes that need no declaration.
BUILTIN_PREFIXES = {"owl": OWL, "rdf": RDF, "rdfs": RDFS, "xsd": XSD}

MAX_QUERY_BYTES, MAX_RESULT_ROWS, MAX_GRAPH_NODES, MAX_GRAPH_EDGES = 1 << 20, 100_000, 2_000, 5_000
MAX_DEPTH, DEFAULT_DEPTH = 5, 2

LOCATION = "struct<line: bigint, column: bigint, start_byte: bigint, end_byte: bigint>"
SCHEMAS = {
    "documents": f"doc_order bigint, id string, path string, format string, base_iri string, version_iri string, imports array<string>, namespaces map<string,string>, parse_status string, content_hash string, modified_time bigint, parse_message string, parse_error_location {LOCATION}",
    "entities": f"iri string, short_name string, kind string, ontology_id string, source_location {LOCATION}, labels array<string>, comments array<string>, deprecated boolean, obo_id string, characteristics struct<functional: boolean, inverse_functional: boolean, transitive: boolean, symmetric: boolean, asymmetric: boolean, reflexive: boolean, irreflexive: boolean>",
    "annotations": "subject string, predicate string, object string, ontology_id string",
    "axioms": "id string, ontology_id string, subject string, predicate string, object string, axiom_kind string, annotations array<struct<predicate: string, value: string>>",
    "namespaces": "prefix string, iri string, ontology_id string",
    "imports": "ontology_id string, import_iri string",
    "diagnostics": "code string, severity string, message string, file string, line bigint, column bigint, entity_iri string, quick_fix string",
    "quads": "s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string, g string, doc_id string",
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


class LatticaError(ValueError):
    """A request that the engine rejects."""
