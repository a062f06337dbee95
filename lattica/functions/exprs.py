"""Scalar functions as column expressions; all are built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lattica.model import BUILTIN_PREFIXES, OBO_IN_OWL, OBO_PURL

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_name(iri: C) -> Column:
    """After the last #, else after the last /, else the whole."""
    iri = col(iri)
    return F.when(F.contains(iri, F.lit("#")), F.substring_index(iri, "#", -1)).when(F.contains(iri, F.lit("/")), F.substring_index(iri, "/", -1)).otherwise(iri)


def graph_short_name(iri: C) -> Column:
    """After the later of the last # and the last /."""
    return F.regexp_extract(col(iri), "([^#/]*)$", 1)


def namespace_of(iri: C) -> Column:
    """Up to and including the last #, else the last /, else the whole."""
    iri = col(iri)
    some = F.contains(iri, F.lit("#")) | F.contains(iri, F.lit("/"))
    return F.when(some, F.substring(iri, F.lit(1), F.length(iri) - F.length(short_name(iri)))).otherwise(iri)


def split_iri(iri: C) -> Column:
    iri = col(iri)
    some = F.contains(iri, F.lit("#")) | F.contains(iri, F.lit("/"))
    return F.struct(F.when(some, namespace_of(iri)).otherwise("").alias("namespace"), short_name(iri).alias("local"))


def normalize_iri(iri: C) -> Column:
    """Without trailing #s, then without trailing /s."""
    return F.rtrim(F.rtrim(col(iri), F.lit("#")), F.lit("/"))


def ascii_lower(text: C) -> Column:
    return F.translate(col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalize_label(label: C) -> Column:
    return ascii_lower(F.trim(F.btrim(col(label), F.lit('"'))))


def parse_boolean_literal(text: C) -> Column:
    """true, false, quoted or typed; null for anything else."""
    value = F.regexp_extract(F.trim(col(text)), r'^"?(true|false|1|0)"?(?:\^\^.*)?$', 1)
    return F.when(value.isin("true", "1"), True).when(value.isin("false", "0"), False)


def longest_prefix(iri: Column, namespaces: Column) -> Column:
    """Of entries (prefix, namespace), that with the longest namespace the IRI starts with; ties to the first prefix."""
    fits = F.filter(namespaces, lambda n: F.startswith(iri, n["namespace"]) & (F.length(n["namespace"]) > 0))
    best = F.array_max(F.transform(fits, lambda n: F.length(n["namespace"])))
    return F.array_min(F.filter(fits, lambda n: F.length(n["namespace"]) == best))


def builtin_namespaces() -> Column:
    return F.array(*[F.struct(F.lit(p).alias("prefix"), F.lit(n).alias("namespace")) for p, n in sorted(BUILTIN_PREFIXES.items())])


def curie(iri: C, namespaces: Column | None = None) -> Column:
    """prefix:local by the longest namespace of a map prefix -> namespace, then by the built-in ones; null if none fits."""
    iri = col(iri)

    def render(found: Column) -> Column:
        return F.concat(found["prefix"], F.lit(":"), F.substring(iri, F.length(found["namespace"]) + 1, F.length(iri)))

    own = F.transform(F.map_entries(namespaces), lambda e: F.struct(e["key"].alias("prefix"), e["value"].alias("namespace"))) if namespaces is not None else None
    builtin = render(longest_prefix(iri, builtin_namespaces()))
    return F.coalesce(render(longest_prefix(iri, own)), builtin) if own is not None else builtin


def render_entity_iri(iri: C, namespaces: Column | None = None) -> Column:
    iri = col(iri)
    name = short_name(iri)
    return F.coalesce(curie(iri, namespaces), F.when((name != "") & (name != iri), name), F.concat(F.lit("<"), iri, F.lit(">")))


def expand_prefixed(token: C, namespaces: Column) -> Column:
    """<iri> and anything with :// stay; prefix:local by the map; null if the prefix is unknown."""
    token = col(token)
    name = F.substring_index(token, ":", 1)
    local = F.substring(token, F.length(name) + 2, F.length(token))
    angled = token.rlike("^<.*>$")
    return F.when(angled, F.substring(token, F.lit(2), F.length(token) - 2)).when(F.contains(token, F.lit("://")), token).when(F.contains(token, F.lit(":")), F.concat(F.try_element_at(namespaces, name), local))


def manchester_escape(name: C) -> Column:
    """In single quotes, with quotes and backslashes escaped, where a name has characters of the syntax."""
    name = col(name)
    escaped = F.replace(F.replace(name, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.when(name.rlike(r"[\s(){}\[\],<>=\"'\\]"), F.concat(F.lit("'"), escaped, F.lit("'"))).otherwise(name)


def manchester_unescape(name: C) -> Column:
    name = col(name)
    inner = F.substring(name, F.lit(2), F.length(name) - 2)
    return F.when(name.rlike("^'.*'$"), F.replace(F.replace(inner, F.lit("\\'"), F.lit("'")), F.lit("\\\\"), F.lit("\\"))).otherwise(name)


def obo_id_to_iri(obo_id: C, idspaces: Column | None = None) -> Column:
    """http(s) stays; a declared idspace expands; else the PURL with _ for the colon."""
    obo_id = col(obo_id)
    purl = F.concat(F.lit(OBO_PURL), F.replace(obo_id, F.lit(":"), F.lit("_")))
    known = F.try_element_at(idspaces, F.substring_index(obo_id, ":", 1)) if idspaces is not None else F.lit(None).cast("string")
    local = F.substring(obo_id, F.length(F.substring_index(obo_id, ":", 1)) + 2, F.length(obo_id))
    return F.when(obo_id.rlike("^https?://"), obo_id).otherwise(F.coalesce(F.concat(known, local), purl))


def obo_annotation_iri(name: C) -> Column:
    """Names of synonym scopes and the like go to oboInOwl, ids with _ or : to the PURL."""
    name = col(name)
    return F.when(name.rlike("^https?://"), name).when(name.rlike("^[A-Za-z]+[_:][0-9]+$"), F.concat(F.lit(OBO_PURL), F.replace(name, F.lit(":"), F.lit("_")))).otherwise(F.concat(F.lit(OBO_IN_OWL), F.substring_index(name, ":", -1)))


def file_uri(path: C) -> Column:
    coded = F.replace(F.replace(F.url_encode(col(path)), F.lit("%2F"), F.lit("/")), F.lit("+"), F.lit("%20"))
    return F.concat(F.lit("file://"), coded)


def content_hash(content: C) -> Column:
    return F.sha2(col(content), 256)


def is_restriction(expression: C) -> Column:
    lower = ascii_lower(expression)
    words = " some | only | value | min | max "
    return lower.rlike(rf"(?s){words}|^self$|^self | self$| self |objecthasself")


def restriction_header(expression: C) -> Column:
    """(property, kind): the first keyword of a fixed order that occurs decides, wherever it stands."""
    text = F.trim(col(expression))
    lower = ascii_lower(text)
    found = None
    for kind in ("some", "only", "value", "min", "max", "self"):
        at = F.instr(lower, f" {kind} ")
        hit = F.struct(F.trim(F.substring(text, F.lit(1), at - 1)).alias("property"), F.lit(kind).alias("kind"))
        found = F.when(at > 0, hit) if found is None else found.when(at > 0, hit)
    ended = F.struct(F.trim(F.substring(text, F.lit(1), F.length(text) - 5)).alias("property"), F.lit("self").alias("kind"))
    return found.when(F.endswith(lower, F.lit(" self")), ended).otherwise(F.struct(F.lit("").alias("property"), F.lit("complex").alias("kind")))


def restriction_parts(expression: C) -> Column:
    """Beside the one above: property, kind, cardinality and filler by position, 'exactly' included; null if it is none."""
    text = F.trim(col(expression))
    pattern = r"(?is)^(\S+|'(?:[^'\\]|\\.)*+')\s+(some|only|value|min|max|exactly|self)\b\s*([0-9]*)\s*(.*)$"
    part = lambda k: F.regexp_extract(text, pattern, k)
    return F.when(text.rlike(pattern), F.struct(part(1).alias("property"), F.lower(part(2)).alias("kind"), F.when(part(3) != "", part(3).cast("int")).alias("cardinality"), part(4).alias("filler")))


def is_complex_expression(expression: C) -> Column:
    """Whether a superclass is an expression rather than a name. Expressions hold whole IRIs here, so :// alone makes no
    name: only a text in angle brackets, or one that has :// and no white space, is one."""
    text = F.trim(col(expression))
    named = text.rlike(r"(?s)^<.*>$") | (F.contains(text, F.lit("://")) & ~text.rlike(r"\s"))
    return ~named & ascii_lower(text).rlike(r"(?s) some | only | value | min | max | exactly | and | or | not |^not |[()]")


def members(expression: C, separator: str) -> Column:
    return F.filter(F.transform(F.split(col(expression), f" \\Q{separator}\\E "), lambda x: F.trim(x)), lambda x: x != "")


# Labels of axiom kinds.
AXIOM_LABELS = {
    "sub_class_of": "SubClassOf", "equivalent_class": "EquivalentTo", "disjoint_class": "DisjointWith", "disjoint_union": "DisjointUnionOf", "has_key": "HasKey",
    "inverse_object_properties": "InverseOf", "equivalent_object_properties": "EquivalentTo", "disjoint_object_properties": "DisjointWith", "equivalent_data_properties": "EquivalentTo",
    "disjoint_data_properties": "DisjointWith", "domain": "Domain", "range": "Range", "property_chain": "SubPropertyChain", "sub_object_property_of": "SubPropertyOf",
    "sub_data_property_of": "SubPropertyOf", "class_assertion": "Type", "object_property_assertion": "ObjectPropertyAssertion", "data_property_assertion": "DataPropertyAssertion",
    "negative_object_property_assertion": "NegativeObjectPropertyAssertion", "negative_data_property_assertion": "NegativeDataPropertyAssertion", "same_individual": "SameAs",
    "different_individuals": "DifferentFrom", "datatype_definition": "DatatypeDefinition",
}


def axiom_label(kind: C) -> Column:
    table = F.create_map(*[F.lit(x) for pair in AXIOM_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, col(kind)), col(kind))


def axiom_display(kind: C, predicate: C, obj: C) -> Column:
    assertion = col(kind).isin("object_property_assertion", "data_property_assertion")
    return F.when(assertion, F.concat_ws(" ", graph_short_name(predicate), graph_short_name(obj))).otherwise(F.concat_ws(" ", axiom_label(kind), graph_short_name(obj)))


# Link kinds, patterns and where they lead.
LINKS = [
    ("DOI", r"(?i)DOI:\s*([^\s]+)", "https://doi.org/"),
    ("PubMedId", r"(?i)PMID:\s*(\d+)", "http://www.ncbi.nlm.nih.gov/pubmed/"),
    ("ORCID", r"(?i)ORCID:\s*([^\s]+)", "https://orcid.org/"),
    ("OMIMPS", r"(?i)OMIMPS:\s*(\d+)", "https://www.omim.org/phenotypicSeries/"),
    ("OMIM", r"(?i)OMIM:\s*(\d+)", "https://omim.org/entry/"),
    ("Orphanet", r"(?i)Orphanet:\s*(\d+)", "https://www.orpha.net/consor/cgi-bin/OC_Exp.php?Expert="),
    ("ISBN-10", r"(?i)ISBN:(\d{10})", "http://www.isbnsearch.org/isbn/"),
    ("WikipediaVersioned", r"(?i)WikipediaVersioned:([^\s]+)", "https://wikipedia.org/wiki/index.php?title="),
    ("Wikipedia", r"(?i)Wikipedia:([^\s]+)", "https://wikipedia.org/wiki/"),
]


def links(text: C) -> Column:
    """kind, matched, url, start, end (offsets in characters), left to right without overlaps: the earlier, then the shorter, then the first pattern."""
    text = col(text)

    def of(rank: int, kind: str, pattern: str, url: str) -> Column:
        whole, inner = (F.regexp_extract_all(text, F.lit(pattern), F.lit(k)) for k in (0, 1))
        gaps = F.split(text, pattern, -1)
        before = lambda i: F.aggregate(F.slice(F.zip_with(gaps, whole, lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0))), F.lit(1), i), F.lit(0), lambda a, b: a + b) + F.length(F.get(gaps, i))
        return F.transform(whole, lambda m, i: F.struct(before(i).alias("start"), (before(i) + F.length(m)).alias("end"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m.alias("matched"), F.concat(F.lit(url), F.get(inner, i)).alias("url")))

    found = F.array_sort(F.concat(*[of(r, *link) for r, link in enumerate(LINKS)]))
    zero = F.filter(found, lambda x: F.lit(False))
    kept = F.aggregate(found, zero, lambda out, x: F.when(x["start"] >= F.coalesce(F.try_element_at(out, F.lit(-1))["end"], F.lit(0)), F.array_append(out, x)).otherwise(out))
    return F.transform(kept, lambda x: F.struct(x["kind"], x["matched"], x["url"], x["start"], x["end"]))


def abbreviate(text: C, size: int) -> Column:
    text = col(text)
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, max(0, size - 3)), F.lit("...")))


def iso_utc(seconds: C) -> Column:
    """In UTC, whatever the session's time zone."""
    whole = F.floor(col(seconds)).cast("decimal(18,6)")
    local = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=whole)
    return F.concat(F.replace(local.cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))


# Annotation properties in the order in which they are shown.
ANNOTATION_ORDER = [
    "http://www.w3.org/2000/01/rdf-schema#label",
    "http://www.w3.org/2004/02/skos/core#prefLabel",
    "http://purl.org/dc/elements/1.1/title",
    "http://www.geneontology.org/formats/oboInOwl#id",
    "http://www.geneontology.org/formats/oboInOwl#hasAlternativeId",
    "http://www.geneontology.org/formats/oboInOwl#hasOBONamespace",
    "http://purl.obolibrary.org/obo/IAO_0000115",
    "http://www.w3.org/2004/02/skos/core#definition",
    "http://www.w3.org/2004/02/skos/core#note",
    "http://purl.org/dc/elements/1.1/description",
    "http://purl.org/dc/elements/1.1/rights",
    "http://purl.org/dc/terms/license",
    "http://purl.org/dc/elements/1.1/publisher",
    "http://purl.org/dc/elements/1.1/creator",
    "http://purl.org/dc/elements/1.1/contributor",
    "http://www.w3.org/2000/01/rdf-schema#comment",
    "http://www.w3.org/2004/02/skos/core#altLabel",
    "http://www.w3.org/2000/01/rdf-schema#seeAlso",
    "http://www.w3.org/2000/01/rdf-schema#isDefinedBy",
    "http://www.geneontology.org/formats/oboInOwl#hasExactSynonym",
    "http://www.geneontology.org/formats/oboInOwl#hasRelatedSynonym",
    "http://www.geneontology.org/formats/oboInOwl#hasBroadSynonym",
    "http://www.geneontology.org/formats/oboInOwl#hasNarrowSynonym",
]


def annotation_order(predicate: C) -> Column:
    """What annotation properties are sorted by: the known ones in their order, then the others by IRI."""
    at = F.array_position(F.array(*[F.lit(p) for p in ANNOTATION_ORDER]), col(predicate))
    return F.struct(F.when(at > 0, at).otherwise(len(ANNOTATION_ORDER) + 1).alias("rank"), col(predicate).alias("iri"))


def entity_markdown(name: C, iri: C) -> Column:
    return F.concat(F.lit("["), manchester_unescape(name), F.lit("]("), col(iri), F.lit(")"))


def slug(text: C) -> Column:
    """Lower-case words joined by hyphens, with a tag that tells equal ones apart."""
    text = col(text)
    words = F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.concat(F.when(words == "", "item").otherwise(words), F.lit("-"), F.lpad(F.lower(F.hex(F.xxhash64(text))), 16, "0"))


def strip_turtle(text: C) -> Column:
    """Comments and strings become blanks' worth of nothing; IRIs stay."""
    # A quoted string or a comment goes; an IRI, in which # is no comment, is kept by the first group.
    return F.regexp_replace(col(text), r'(<[^<>\s]*+>)|"""(?:[^"\\]|\\.|"(?!""))*+"""|\'\'\'(?:[^\'\\]|\\.|\'(?!\'\'))*+\'\'\'|"(?:[^"\\\n]|\\.)*+"|\'(?:[^\'\\\n]|\\.)*+\'|#[^\n]*+', "$1")


# Characters that continue a token.
_CONTINUES = r"[A-Za-z0-9_\-.~:#/%?=&]"


def token_pattern(token: C) -> Column:
    quoted = F.replace(col(token), F.lit(r"\E"), F.lit(r"\E\\E\Q"))
    return F.concat(F.lit(rf"(?<!{_CONTINUES})\Q"), quoted, F.lit(rf"\E(?!{_CONTINUES})"))


def bounded(text: C, token: C) -> Column:
    """Whether a token occurs and isn't part of a longer one."""
    return F.regexp_like(col(text), token_pattern(token))


def token_at(text: C, token: C) -> Column:
    """Where a token that isn't part of a longer one first stands (from 0); null if nowhere."""
    at = F.regexp_instr(col(text), token_pattern(token))
    return F.when((F.length(col(token)) > 0) & (at > 0), at - 1)


def remap_iri(iri: C, old: str, new: str) -> Column:
    iri = col(iri)
    return F.when(F.startswith(iri, F.lit(old)), F.concat(F.lit(new), F.substring(iri, F.lit(len(old) + 1), F.length(iri)))).otherwise(iri)


def replace_iri_in_text(text: C, old: str, new: str) -> Column:
    return F.replace(col(text), F.lit(f"<{old}>"), F.lit(f"<{new}>"))


def scoped_blank(doc_id: C, blank: C) -> Column:
    return F.concat_ws("_", col(doc_id), col(blank))


# Synonym scopes and their properties.
SYNONYM_SCOPES = {"EXACT": "hasExactSynonym", "BROAD": "hasBroadSynonym", "NARROW": "hasNarrowSynonym", "RELATED": "hasRelatedSynonym"}


def synonym_property(scope: C) -> Column:
    table = F.create_map(*[F.lit(x) for k, v in SYNONYM_SCOPES.items() for x in (k, OBO_IN_OWL + v)])
    return F.coalesce(F.try_element_at(table, F.upper(col(scope))), F.lit(OBO_IN_OWL + "hasRelatedSynonym"))


def first_location(text: C, *needles: C) -> Column:
    """line (from 1) and column (from 0) of the first line that holds a needle as a token, the needles tried in order on
    each line; null if none does."""
    lines = F.split(col(text), "\n")
    at = lambda line: F.coalesce(*[token_at(line, n) for n in needles])
    hits = F.filter(F.transform(lines, lambda line, i: F.struct((i + 1).cast("bigint").alias("line"), at(line).cast("bigint").alias("column"))), lambda x: x["column"].isNotNull())
    return F.get(hits, 0)
