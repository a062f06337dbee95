"""Where an IRI is used, what a change would touch, and modules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.catalog import Catalog
from lattica.functions import exprs as X
from lattica.model import OWL, RDF, RDFS, SWRL_RULE, XSD
from lattica.operators.fixpoint import reachable
from lattica.storage import cut, written

# Kinds of usages.
KINDS = ["entity", "axiom_subject", "axiom_predicate", "axiom_object", "annotation_subject", "annotation_predicate", "annotation_object", "import", "text", "swrl"]
_IRI = r"https?://[^\s<>(){}\"',\[\]]+|urn:[^\s<>(){}\"',\[\]]+"


def references(catalog: Catalog) -> DataFrame:
    """iri, usage, ontology_id, key: every use of every IRI by rows; complex objects count for each IRI they name."""
    e, ax, an = catalog.entities, catalog.axioms, catalog.annotations
    row = lambda df, iri, usage, key: df.select(F.col(iri).alias("iri"), F.lit(usage).alias("usage"), "ontology_id", F.col(key).alias("key"))
    named = ax.select(F.explode(F.array_distinct(F.regexp_extract_all("object", F.lit(_IRI), F.lit(0)))).alias("iri"), "ontology_id", "id")
    parts = [
        row(e, "iri", "entity", "iri"),
        row(ax, "subject", "axiom_subject", "id"),
        row(ax.where("predicate <> ''"), "predicate", "axiom_predicate", "id"),
        row(named, "iri", "axiom_object", "id"),
        row(an, "subject", "annotation_subject", "object"),
        row(an, "predicate", "annotation_predicate", "object"),
        row(an.where(F.col("object").rlike(rf"^(?:{_IRI})$")), "object", "annotation_object", "subject"),
        row(catalog.imports, "import_iri", "import", "ontology_id"),
        row(catalog.quads.where(F.col("p") == SWRL_RULE).select(F.explode(F.array_distinct(F.regexp_extract_all("o", F.lit(_IRI), F.lit(0)))).alias("iri"), F.col("doc_id").alias("ontology_id"), F.col("s").alias("key")), "iri", "swrl", "key"),
    ]
    return reduce(DataFrame.unionByName, parts)


def text_usages(catalog: Catalog, iri: str) -> DataFrame:
    """file, line, column, token: <iri>, prefix:local and :local in the texts of files that parsed."""
    if catalog.texts is None:
        return catalog.spark.createDataFrame([], "file string, line bigint, column bigint, token string")
    docs = catalog.documents.where(F.col("format").isin("turtle", "trig") & (F.col("parse_status") == "ok")).select("path", "namespaces").join(catalog.texts, "path")
    prefixes = F.transform(F.filter(F.map_entries("namespaces"), lambda n: F.startswith(F.lit(iri), n["value"]) & (F.length(n["value"]) > 0)), lambda n: F.concat(n["key"], F.lit(":"), F.substring(F.lit(iri), F.length(n["value"]) + 1, F.lit(len(iri)))))
    tokens = F.array_distinct(F.concat(F.array(F.lit(f"<{iri}>")), F.coalesce(prefixes, F.array().cast("array<string>"))))
    lines = docs.select("path", tokens.alias("tokens"), F.posexplode(F.split("text", "\n")).alias("n", "line_text"))
    hits = lines.select("path", "n", "line_text", F.explode("tokens").alias("token")).where(F.startswith("token", F.lit("<")) & F.contains("line_text", F.col("token")) | ~F.startswith("token", F.lit("<")) & X.bounded("line_text", "token"))
    return hits.select(F.col("path").alias("file"), (F.col("n") + 1).cast("bigint").alias("line"), F.coalesce(X.token_at("line_text", "token"), F.instr("line_text", F.col("token")) - 1).cast("bigint").alias("column"), "token").distinct()


def find_usages(catalog: Catalog, iri: str) -> DataFrame:
    """file, usage, key, line, column of one IRI, without repeats, in order."""
    paths = catalog.documents.select(F.col("path").alias("file"), F.explode(F.array_distinct(F.array("id", F.coalesce("base_iri", "id")))).alias("ontology_id")).groupBy("ontology_id").agg(F.min("file").alias("file"))
    null = F.lit(None).cast("bigint")
    rows = references(catalog).where(F.col("iri") == iri).join(paths, "ontology_id", "left").select(F.coalesce("file", F.lit("")).alias("file"), "usage", "key", null.alias("line"), null.alias("column"))
    texts = text_usages(catalog, iri).select("file", F.lit("text").alias("usage"), F.col("token").alias("key"), "line", "column")
    return rows.unionByName(texts).dropDuplicates(["file", "usage", "key", "line"]).orderBy("file", "line", "column", "usage", "key")


def delete_impact(catalog: Catalog, iris: DataFrame | None = None) -> DataFrame:
    """iri, usages, axioms, referencers: for every entity, or those asked for, what would dangle."""
    refs = references(catalog).where("usage <> 'entity'")
    refs = refs.join(iris.select("iri"), "iri", "left_semi") if iris is not None else refs.join(catalog.entities.select("iri"), "iri", "left_semi")
    by_axiom = catalog.axioms.select(F.col("id").alias("key"), F.col("subject"))
    counts = refs.groupBy("iri").agg(F.count("*").alias("usages"), F.count_distinct(F.when(F.startswith("usage", F.lit("axiom")), F.col("key"))).alias("axioms"))
    who = refs.where("usage = 'axiom_object'").join(by_axiom, "key").groupBy("iri").agg(F.count_distinct("subject").alias("referencers"))
    return counts.join(who, "iri", "left").select("iri", "usages", "axioms", F.coalesce("referencers", F.lit(0)).alias("referencers"))


def _builtin(iri: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(iri, F.lit(n)) for n in (OWL, RDF, RDFS, XSD)])


def _names(*columns: str) -> Column:
    """The different IRIs in columns of axioms, expressions among them; built-in IRIs are none."""
    named = F.array_distinct(F.concat(*[F.regexp_extract_all(c, F.lit(_IRI), F.lit(0)) if c == "object" else F.array(c) for c in columns]))
    return F.filter(named, lambda x: (x != "") & ~_builtin(x))


def signature(catalog: Catalog) -> DataFrame:
    """axiom, iri: the catalog's entities that each axiom names; built-in IRIs are none."""
    pairs = catalog.axioms.select(F.col("id").alias("axiom"), F.explode(_names("subject", "predicate", "object")).alias("iri"))
    return pairs.join(catalog.entities.select("iri").distinct(), "iri", "left_semi").select("axiom", "iri")


def module(catalog: Catalog, seeds: DataFrame) -> DataFrame:
    """iri: the seeds (iri) and, to a fixpoint, all entities of axioms that share an entity with them.

    All entities of an axiom are linked to one of them, its hub: the predicate, else the last that the axiom names. So an
    entity has a row for each of its hubs, however many axioms it is in. Hubs of one entity are linked to the least of
    them, and rounds follow the links between hubs alone."""
    known = catalog.entities.select("iri").distinct()
    ax = catalog.axioms.select("id", "subject", "predicate", "object")
    # A row for each property.
    properties = ax.select(F.col("predicate").alias("hub")).distinct().where(~_builtin(F.col("hub")) & (F.col("hub") != ""))
    properties = cut(properties.join(known.withColumnRenamed("iri", "hub"), "hub", "left_semi"), "properties")
    hubs = ax.join(F.broadcast(properties), F.col("predicate") == F.col("hub"), "left")
    # Texts are looked into when they are different.
    said = F.when(F.contains("object", F.lit(":")), F.col("object"))
    texts = hubs.where("hub IS NOT NULL").select("hub", F.posexplode(F.array("subject", said)).alias("k", "text")).where("text IS NOT NULL").distinct()
    named = texts.select("hub", F.explode(F.when(F.col("k") == 0, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(_IRI), F.lit(0)))).alias("iri")).where(~_builtin(F.col("iri")) & (F.col("iri") != ""))
    without = hubs.select("id", F.posexplode(F.when(F.col("hub").isNull(), _names("subject", "object"))).alias("k", "iri")).join(known, "iri", "left_semi")
    others = without.groupBy("id").agg(F.collect_set(F.struct("k", "iri")).alias("x")).where("size(x) > 1").select(F.array_max("x")["iri"].alias("hub"), F.explode("x.iri").alias("iri"))
    least = F.min("hub").over(Window.partitionBy("iri"))
    # Dealt out by iri once, for the entities, the different rows and their least hubs.
    of = cut(named.union(properties.select("hub", "hub")).union(others).join(known, "iri", "left_semi").select("hub", "iri").distinct().withColumn("least", least), "hubs", "zstd")
    links = of.where("hub <> least").select(F.col("hub").alias("a"), F.col("least").alias("b")).distinct()
    one = of.where("hub = least").select("iri", "least")
    begin = seeds.select("iri").distinct()
    found = cut(reachable(links.union(links.select("b", "a")), one.join(begin, "iri", "left_semi").select(F.col("least").alias("node"))), "reached")
    return one.join(found, F.col("least") == F.col("node"), "left_semi").select("iri").union(begin).distinct()


def module_axioms(catalog: Catalog, iris: DataFrame, lazy: bool = False) -> DataFrame:
    """Axioms whose whole signature is in a module (iri). The axioms looked into are written once, or found twice if lazy.

    Only axioms that name something of the module are looked into; where the module is small they are found without a shuffle."""
    inside = written(iris, "module").select("iri")
    ax = catalog.axioms
    rest = [c for c in ax.columns if c != "id"]
    named = ax.select("id", F.struct(*rest).alias("row"), _names("subject", "predicate", "object").alias("names"))
    touching = named.select("id", "row", "names", F.explode("names").alias("iri")).join(inside, "iri", "left_semi")
    # Axioms of one id are the same; each of them has as many rows as names in the module.
    by_id = touching.groupBy("id").agg(F.count("*").alias("n"), F.first("row").alias("row"), F.first("names").alias("names"), F.collect_set("iri").alias("own"))
    by_id = by_id if lazy else cut(by_id, "touching", "zstd")
    left = by_id.select("id", F.explode(F.array_except("names", "own")).alias("iri"))
    outside = left.join(catalog.entities.select("iri").distinct(), "iri", "left_semi").select("id").distinct()
    whole = by_id.join(outside, "id", "left_anti")
    each = F.explode(F.sequence(F.lit(1), (F.col("n") / F.size("own")).cast("int")))
    return whole.select("id", "row", each.alias("copy")).select("id", "row.*").select(*ax.columns)


def migration_set(catalog: Catalog, old_base: str) -> DataFrame:
    """iri: distinct IRIs under a base, of entities and of subjects and objects of axioms."""
    iris = catalog.entities.select("iri").union(catalog.axioms.select(F.explode(F.array("subject", "object"))))
    return iris.where(F.startswith("iri", F.lit(old_base)) & ~F.contains("iri", F.lit(" "))).distinct()


def import_closure(catalog: Catalog, ontology_iri: str) -> tuple[DataFrame, DataFrame]:
    """ontology_iri of all that one ontology imports, itself included; and warnings (import_iri, reason)."""
    edges = catalog.imports.select(X.normalize_iri("ontology_id").alias("a"), X.normalize_iri("import_iri").alias("b"))
    seeds = catalog.spark.createDataFrame([(ontology_iri.rstrip("#").rstrip("/"),)], "node string")
    found = reachable(edges, seeds).select(F.col("node").alias("ontology_iri"))
    docs = catalog.documents.select(X.normalize_iri(F.coalesce("base_iri", "id")).alias("ontology_iri"), "format", "parse_status")
    joined = found.join(docs, "ontology_iri", "left")
    reason = F.when(F.col("format").isNull(), "unresolved").when(~F.col("format").isin("turtle", "trig"), "not Turtle").when(F.col("parse_status") != "ok", "did not parse")
    return found, joined.select(F.col("ontology_iri").alias("import_iri"), reason.alias("reason")).where("reason IS NOT NULL")


def unused_imports(catalog: Catalog) -> DataFrame:
    """ontology_id, import_iri, reason: imports none of whose entities the importer names ('unused'), or which are not indexed."""
    docs = catalog.documents.select(F.explode(F.array_distinct(F.array("id", F.coalesce("base_iri", "id")))).alias("import_iri")).distinct()
    owned = catalog.entities.select("iri", F.col("ontology_id").alias("import_iri"))
    used = references(catalog).where("usage NOT IN ('entity', 'import')").select("iri", "ontology_id").distinct().join(owned, "iri").select("ontology_id", "import_iri").distinct()
    left = catalog.imports.join(used, ["ontology_id", "import_iri"], "left_anti").join(docs.withColumn("indexed", F.lit(True)), "import_iri", "left")
    return left.select("ontology_id", "import_iri", F.when(F.col("indexed"), "unused").otherwise("unresolved").alias("reason"))


def resolve_imports(catalog: Catalog, redirects: DataFrame | None = None) -> DataFrame:
    """ontology_id, import_iri, path: by IRI, then by an XML catalog's redirect (uri, target), then by file name."""
    docs = catalog.documents.select("doc_order", "path", X.normalize_iri(F.coalesce("base_iri", "id")).alias("key"))
    first = lambda df, key: df.groupBy(key).agg(F.min_by("path", "doc_order").alias("p"))
    by_iri = first(docs, "key").withColumnRenamed("p", "by_iri")
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[A-Za-z-]+$", "")
    by_name = first(docs.select("doc_order", "path", name.alias("name")), "name").withColumnRenamed("p", "by_name")
    rows = catalog.imports.select("ontology_id", "import_iri", X.normalize_iri("import_iri").alias("key")).withColumn("name", F.regexp_replace(X.short_name("key"), r"\.(?:ttl|rdf|owl|owx|obo|nt|nq|trig|jsonld)$", ""))
    rows = rows.join(by_iri, "key", "left").join(by_name, "name", "left")
    if redirects is not None:
        rows = rows.join(redirects.select(F.col("uri").alias("import_iri"), F.col("target").alias("by_catalog")), "import_iri", "left")
    else:
        rows = rows.withColumn("by_catalog", F.lit(None).cast("string"))
    return rows.select("ontology_id", "import_iri", F.coalesce("by_iri", "by_catalog", "by_name").alias("path"))
