"""Lint rules as filters, joins and anti-joins over the catalog."""

from __future__ import annotations

import tomllib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.catalog import Catalog
from lattica.functions import exprs as X
from lattica.model import SCHEMAS, THING, NOTHING

# Rules and their severities.
SEVERITY = {"parse_error": "error", "broken_import": "error", "undefined_prefix": "error", "duplicate_label": "warning", "missing_label": "warning", "orphan_class": "warning", "owl_bridge_failed": "warning", "io_read_error": "warning"}
# Prefixes that are always known to the prefix rule.
KNOWN_PREFIXES = ["owl", "rdf", "rdfs", "xsd", "xml", "skos", "dc", "dcterms", "foaf", "schema", "prov", "sh"]
BUILTIN_ROOTS = [THING, NOTHING]


def _rows(df: DataFrame, code: str, message: Column, entity: Column | None = None, quick_fix: Column | None = None, line: Column | None = None, column: Column | None = None) -> DataFrame:
    null = F.lit(None)
    return df.select(F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"), message.alias("message"), F.col("path").alias("file"), (line if line is not None else null).cast("bigint").alias("line"), (column if column is not None else null).cast("bigint").alias("column"), (entity if entity is not None else null).cast("string").alias("entity_iri"), (quick_fix if quick_fix is not None else null).cast("string").alias("quick_fix"))


def _located(df: DataFrame, catalog: Catalog) -> DataFrame:
    """With line and column of the entity's IRI in its file, where texts are at hand."""
    if catalog.texts is None:
        return df.withColumn("line", F.lit(None).cast("bigint")).withColumn("column", F.lit(None).cast("bigint"))
    found = df.join(catalog.texts.select("path", "text"), "path", "left")
    prefixed = F.transform(F.filter(F.map_entries("namespaces"), lambda n: (n["key"] != "") & F.startswith("iri", n["value"])), lambda n: F.concat(n["key"], F.lit(":"), X.short_name("iri")))
    needles = F.concat(F.array("iri", F.concat(F.lit("<"), "iri", F.lit(">"))), F.coalesce(F.array_sort(prefixed), F.array().cast("array<string>")), F.array(F.concat(F.lit(":"), X.short_name("iri"))))
    # The first line that holds any needle, and on it the first needle of the list.
    each = F.filter(F.transform(needles, lambda n, k: F.struct(X.first_location("text", n).alias("at"), k.alias("k"))), lambda x: x["at"].isNotNull())
    first = F.array_min(F.transform(each, lambda x: F.struct(x["at"]["line"].alias("line"), x["k"].alias("k"), x["at"]["column"].alias("column"))))
    found = found.join(catalog.documents.groupBy("path").agg(F.first("namespaces").alias("namespaces")), "path", "left")
    return found.withColumn("at", first).withColumn("line", F.col("at.line")).withColumn("column", F.col("at.column")).drop("text", "at", "namespaces")


def parse_errors(catalog: Catalog) -> DataFrame:
    bad = catalog.documents.where("parse_status = 'error'")
    return _rows(bad, "parse_error", F.coalesce("parse_message", F.lit("parse error")), line=F.coalesce("parse_error_location.line", F.lit(1)), column=F.coalesce("parse_error_location.column", F.lit(0)))


def load_failures(rows: DataFrame) -> DataFrame:
    """From a loader's failure rows (path, a: code, b: message): files that could not be read, or not be understood as OWL."""
    code = F.coalesce("a", F.lit("io_read_error"))
    null = lambda kind: F.lit(None).cast(kind)
    return rows.select(code.alias("code"), F.lit("warning").alias("severity"), F.coalesce("b", F.lit("")).alias("message"), F.col("path").alias("file"), null("bigint").alias("line"), null("bigint").alias("column"), null("string").alias("entity_iri"), null("string").alias("quick_fix"))


def broken_imports(catalog: Catalog) -> DataFrame:
    known = catalog.documents.select(F.explode(F.array(X.normalize_iri(F.coalesce("base_iri", F.lit(""))), X.normalize_iri("id"))).alias("key")).where("key <> ''").distinct()
    missing = catalog.imports.withColumn("key", X.normalize_iri("import_iri")).join(known, "key", "left_anti")
    owner = catalog.documents.select(F.col("path"), F.explode(F.array_distinct(F.array("id", F.coalesce("base_iri", "id")))).alias("ontology_id")).groupBy("ontology_id").agg(F.min("path").alias("path"))
    fix = F.to_json(F.struct(F.concat(F.lit("Remove broken import <"), F.col("import_iri"), F.lit(">")).alias("label"), F.lit("remove_import").alias("op"), F.col("import_iri").alias("import_iri")))
    return _rows(missing.join(owner, "ontology_id"), "broken_import", F.concat(F.lit("import not found in workspace: "), "import_iri"), quick_fix=fix)


def undefined_prefixes(catalog: Catalog) -> DataFrame:
    """Prefixes used in Turtle and TriG texts that nothing declares; one row for each file, prefix and line."""
    empty = catalog.spark.createDataFrame([], SCHEMAS["diagnostics"])
    if catalog.texts is None:
        return empty
    docs = catalog.documents.where(F.col("format").isin("turtle", "trig")).select("path").join(catalog.texts, "path")
    bare = docs.select("path", X.strip_turtle("text").alias("text"))
    declared = bare.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?im)^\s*@?prefix\s+([\w.-]*):"), F.lit(1))).alias("prefix")).distinct()
    lines = bare.select("path", F.posexplode(F.split("text", "\n")).alias("n", "line_text")).where(~F.col("line_text").rlike(r"(?i)^\s*@?(?:prefix|base)\b"))
    used = lines.select("path", (F.col("n") + 1).alias("n"), F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("line_text", r"<[^>]*>", " "), F.lit(r"(?<![\w:/])([A-Za-z][\w.-]*):(?!//)[\w%]"), F.lit(1)))).alias("prefix"))
    unknown = used.where(~F.col("prefix").isin(*KNOWN_PREFIXES, "urn")).join(declared, ["path", "prefix"], "left_anti").distinct()
    fix = F.to_json(F.struct(F.concat(F.lit("Declare @prefix "), "prefix", F.lit(":")).alias("label"), F.concat(F.lit("@prefix "), "prefix", F.lit(": <http://example.org/"), "prefix", F.lit("#> .\n")).alias("text")))
    return _rows(unknown, "undefined_prefix", F.concat(F.lit("undefined prefix: "), "prefix", F.lit(":")), quick_fix=fix, line=F.col("n"), column=F.lit(0))


def label_groups(catalog: Catalog) -> DataFrame:
    """label (normalised), iri of labels that at least two entities have. Counts come first, so a common label is never gathered."""
    labels = catalog.entities.select("iri", F.explode("labels").alias("raw")).select(X.normalize_label("raw").alias("label"), "iri").where("label <> ''").distinct()
    many = labels.groupBy("label").agg(F.count("*").alias("n")).where("n >= 2").select("label")
    return labels.join(many, "label")


def duplicate_labels(catalog: Catalog) -> DataFrame:
    found = _located(label_groups(catalog).join(catalog.owners().select("iri", "path"), "iri"), catalog)
    return _rows(found, "duplicate_label", F.concat(F.lit('duplicate label "'), "label", F.lit('" (also used by other entities)')), F.col("iri"), line=F.col("line"), column=F.col("column"))


def missing_labels(catalog: Catalog) -> DataFrame:
    kinds = ("class", "object_property", "data_property", "annotation_property")
    bare = catalog.entities.where(F.col("kind").isin(*kinds) & (F.size("labels") == 0)).select("iri", "kind", "short_name")
    found = _located(bare.join(catalog.owners().select("iri", "path"), "iri"), catalog)
    fix = F.to_json(F.struct(F.concat(F.lit('Add rdfs:label "'), "short_name", F.lit('"')).alias("label"), F.lit("add_label").alias("op"), F.col("iri").alias("entity_iri"), F.col("short_name").alias("value")))
    return _rows(found, "missing_label", F.concat("kind", F.lit(" has no rdfs:label")), F.col("iri"), fix, F.col("line"), F.col("column"))


def orphans(catalog: Catalog) -> DataFrame:
    """iri of classes that are nobody's parent and have no parent that is known, built in or complex."""
    edges = catalog.axioms.where("axiom_kind = 'sub_class_of'").select("subject", "object")
    classes = catalog.entities.where((F.col("kind") == "class") & ~F.col("iri").isin(*BUILTIN_ROOTS)).select("iri").distinct()
    leaves = classes.join(edges.select(F.col("object").alias("iri")).distinct(), "iri", "left_anti")
    known = edges.join(catalog.entities.select(F.col("iri").alias("object")).distinct(), "object", "left_semi").select(F.col("subject").alias("iri"))
    other = edges.where(F.col("object").isin(*BUILTIN_ROOTS) | X.is_complex_expression("object")).select(F.col("subject").alias("iri"))
    return leaves.join(known.union(other).distinct(), "iri", "left_anti")


def orphan_classes(catalog: Catalog) -> DataFrame:
    found = _located(orphans(catalog).join(catalog.owners().select("iri", "path"), "iri"), catalog)
    return _rows(found, "orphan_class", F.lit("class has no parent in workspace catalog"), F.col("iri"), line=F.col("line"), column=F.col("column"))


RULES = [parse_errors, broken_imports, undefined_prefixes, duplicate_labels, missing_labels, orphan_classes]


def read_config(text: str) -> dict[str, str]:
    """Rule code to 'off' or a severity, from TOML like  [rules] missing_label = "off"  or  = {enabled = true, severity = "hint"}."""
    out: dict[str, str] = {}
    data = tomllib.loads(text)
    for code, value in (data.get("rules") or data.get("diagnostics", {}).get("rules", {})).items():
        enabled, severity = (value.get("enabled", True), value.get("severity")) if isinstance(value, dict) else (value not in (False, "off"), value if isinstance(value, str) and value != "off" else None)
        if not enabled:
            out[code] = "off"
        elif severity:
            out[code] = "info" if severity == "hint" else severity
    return out


def configured(rows: DataFrame, config: dict[str, str]) -> DataFrame:
    off = [c for c, s in config.items() if s == "off"]
    rows = rows.where(~F.col("code").isin(*off)) if off else rows
    severity = F.col("severity")
    for code, value in config.items():
        if value != "off":
            severity = F.when(F.col("code") == code, value).otherwise(severity)
    return rows.withColumn("severity", severity)


def collect(catalog: Catalog, config: dict[str, str] | None = None, extra: DataFrame | None = None) -> DataFrame:
    """All rules' rows, and those of loaders, under a configuration."""
    rows = reduce(DataFrame.unionByName, [rule(catalog) for rule in RULES])
    rows = rows.unionByName(extra) if extra is not None else rows
    return configured(rows, config or {})


def naming(catalog: Catalog, prefix: str | None = None) -> DataFrame:
    """The naming validator: entities without a label, and IRIs outside a prefix."""
    e = catalog.entities.where(F.col("kind").isin("class", "object_property", "data_property", "individual"))
    bare = e.where(F.size("labels") == 0).select("iri", F.concat(F.lit("missing label: "), "iri").alias("message"))
    if prefix:
        bare = bare.union(e.where(~F.startswith("iri", F.lit(prefix))).select("iri", F.concat(F.lit(f"IRI does not start with {prefix}: "), "iri")))
    return bare.select(F.lit("plugin").alias("code"), F.lit("warning").alias("severity"), "message", F.lit("").alias("file"), F.lit(None).cast("bigint").alias("line"), F.lit(None).cast("bigint").alias("column"), F.col("iri").alias("entity_iri"), F.lit(None).cast("string").alias("quick_fix"))


def by_severity(rows: DataFrame) -> DataFrame:
    return rows.groupBy("severity").agg(F.count("*").alias("n"))


def exit_code(rows: DataFrame) -> int:
    return int(not rows.where("severity = 'error'").isEmpty())
