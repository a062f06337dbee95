"""The catalog: one frame for each kind of row, the SQL views over them, statistics, merge, search and entity detail."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import exprs as X
from lattica.model import MAX_RESULT_ROWS, SCHEMAS, schema

ENTITY_COLUMNS = ["iri", "short_name", "kind", "ontology_id", "labels", "comments", "deprecated", "obo_id"]
# The virtual tables and their columns.
TABLES = {
    "ontologies": ["id", "path", "format", "base_iri", "parse_status", "content_hash", "modified_time"],
    **{t: ENTITY_COLUMNS for t in ("classes", "object_properties", "data_properties", "annotation_properties", "individuals", "entities", "properties")},
    "annotations": ["subject", "predicate", "object", "ontology_id"],
    "axioms": ["id", "ontology_id", "subject", "predicate", "object", "axiom_kind"],
    "namespaces": ["prefix", "iri", "ontology_id"],
    "imports": ["ontology_id", "import_iri"],
    "diagnostics": ["code", "severity", "message", "file", "line", "column", "entity_iri"],
    "equivalent_class_axioms": ["class_iri", "expression"],
    "disjoint_class_axioms": ["class_iri", "disjoint_with"],
    "domain_axioms": ["property_iri", "domain"],
    "range_axioms": ["property_iri", "range"],
    "restrictions": ["class_iri", "property_iri", "restriction_kind", "filler"],
}
_KIND_OF = {"classes": "class", "object_properties": "object_property", "data_properties": "data_property", "annotation_properties": "annotation_property", "individuals": "individual"}


@dataclass(frozen=True)
class Catalog:
    """Frames of SCHEMAS, documents in the order of ``doc_order``; ``texts`` (path, text) where sources are at hand."""

    spark: SparkSession
    documents: DataFrame
    entities: DataFrame
    annotations: DataFrame
    axioms: DataFrame
    namespaces: DataFrame
    imports: DataFrame
    quads: DataFrame
    diagnostics: DataFrame | None = None
    texts: DataFrame | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)

    @staticmethod
    def empty(spark: SparkSession) -> Catalog:
        none = {n: spark.createDataFrame([], schema(n)) for n in SCHEMAS}
        return Catalog(spark, **{n: none[n] for n in ("documents", "entities", "annotations", "axioms", "namespaces", "imports", "quads", "diagnostics")})

    def with_(self, **frames: DataFrame) -> Catalog:
        return replace(self, **frames)

    # -- the virtual tables

    def view(self, name: str) -> DataFrame:
        """A virtual table: text columns without nulls."""
        name = name.lower()
        if name in _KIND_OF:
            return self._entity_rows(self.entities.where(F.col("kind") == _KIND_OF[name]))
        if name == "entities":
            return self._entity_rows(self.entities)
        if name == "properties":
            rows = [self.view(t) for t in ("object_properties", "data_properties", "annotation_properties")]
            return rows[0].unionByName(rows[1]).unionByName(rows[2])
        if name in ("equivalent_class_axioms", "disjoint_class_axioms", "domain_axioms", "range_axioms"):
            kind = name.removesuffix("_axioms")
            a, b = TABLES[name]
            return _text(self.axioms.where(F.col("axiom_kind") == kind).select(F.col("subject").alias(a), F.col("object").alias(b)))
        if name == "restrictions":
            rows = self.axioms.where((F.col("axiom_kind") == "sub_class_of") & X.is_restriction("object"))
            head = X.restriction_header("object")
            return _text(rows.select(F.col("subject").alias("class_iri"), head["property"].alias("property_iri"), head["kind"].alias("restriction_kind"), F.col("object").alias("filler")))
        if name == "ontologies":
            return _text(self.documents.select(*TABLES[name]))
        if name == "diagnostics":
            found = self.diagnostics if self.diagnostics is not None else self.spark.createDataFrame([], schema("diagnostics"))
            return _text(found.select(*TABLES[name]))
        if name in ("annotations", "axioms", "namespaces", "imports"):
            return _text(getattr(self, name).select(*TABLES[name]))
        raise KeyError(name)

    @staticmethod
    def _entity_rows(rows: DataFrame) -> DataFrame:
        joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), "; ").alias(c)
        return _text(rows.select("iri", "short_name", "kind", "ontology_id", joined("labels"), joined("comments"), F.coalesce("deprecated", F.lit(False)).alias("deprecated"), "obo_id"))

    def restrictions_exact(self) -> DataFrame:
        """Restrictions by position of the keyword, with 'exactly', cardinality and the filler itself."""
        part = X.restriction_parts("object")
        rows = self.axioms.where(F.col("axiom_kind") == "sub_class_of").select(F.col("subject").alias("class_iri"), part.alias("p")).where("p IS NOT NULL")
        return rows.select("class_iri", F.col("p.property").alias("property_iri"), F.col("p.kind").alias("restriction_kind"), F.col("p.cardinality").alias("cardinality"), F.col("p.filler").alias("filler"))

    def register(self, prefix: str = "") -> None:
        for name in TABLES:
            self.view(name).createOrReplaceTempView(prefix + name)

    # -- statistics

    def stats(self) -> DataFrame:
        """metric, value: one pass over each frame."""
        kind = lambda k: F.count_if(F.col("kind") == k)
        term = [F.coalesce(c, F.lit("")) for c in ("s", "p", "o", "o_kind", "o_datatype", "o_lang", "g")]
        kinds = {"classes": "class", "object_properties": "object_property", "data_properties": "data_property", "annotation_properties": "annotation_property", "individuals": "individual"}
        parts = [
            (self.documents, {"ontologies": F.count("*"), "parse_errors": F.count_if(F.col("parse_status") == "error")}),
            (self.entities, {"entities": F.count("*")} | {n: kind(k) for n, k in kinds.items()}),
            *((getattr(self, n), {n: F.count("*")}) for n in ("annotations", "axioms", "namespaces", "imports")),
            (self.quads, {"triples": F.count("*"), "distinct_triples": F.count_distinct(*term)}),
        ]
        rows = [df.agg(*[v.alias(k) for k, v in counts.items()]).select(F.inline(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("bigint").alias("value")) for k in counts]))) for df, counts in parts]
        return reduce(DataFrame.unionByName, rows)

    def counts_by_kind(self) -> DataFrame:
        return self.entities.groupBy("kind").agg(F.count("*").alias("n"))

    # -- search

    def search(self, term: str, limit: int | None = 100, obo: bool = True) -> DataFrame:
        """Entities that hold the term in IRI, short name, OBO id or a label, by short name."""
        q = F.lit(term.strip().lower())
        has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), q)
        hit = has(F.col("iri")) | has(F.col("short_name")) | F.exists("labels", has)
        if obo:
            hit = hit | has(F.col("obo_id"))
        found = self.entities.where(hit).dropDuplicates(["iri"]).orderBy("short_name", "iri")
        return found if limit is None else found.limit(min(limit, 500))

    def symbols(self, term: str = "") -> DataFrame:
        """Symbols of documents: like search without OBO ids, only of entities that a document owns; an empty term finds all."""
        return self.search(term, None, obo=False).join(self.owners().select("iri", "path"), "iri")

    def completions(self, kind: str, limit: int = 100) -> DataFrame:
        """IRIs of a kind, or the data types that are always offered."""
        if kind == "datatype":
            from lattica.model import XSD

            # Data types that are offered.
            return self.spark.createDataFrame([(XSD + t,) for t in ("boolean", "date", "dateTime", "decimal", "double", "integer", "string")], "iri string")
        return self.entities.where(F.col("kind") == kind).select("iri").distinct().orderBy("iri").limit(limit)

    # -- ownership

    def owners(self) -> DataFrame:
        """iri, path, namespaces of the document that owns each entity: by id, else by base IRI, else by its longest prefix.

        The three ways are tried in turn on what is left; the last splits IRIs into their prefixes at separators, so that
        every way is an equi-join."""
        docs = self.documents.select("doc_order", "id", "path", X.normalize_iri(F.coalesce("base_iri", F.lit(""))).alias("base"), "base_iri")
        # As in any map from keys, the first document of a key wins.
        keys = docs.select(F.explode(F.array_distinct(F.filter(F.array(X.normalize_iri("id"), "base"), lambda k: k != ""))).alias("key"), "doc_order", "path").groupBy("key").agg(F.min_by("path", "doc_order").alias("path"))
        entities = self.entities.select("iri", X.normalize_iri("ontology_id").alias("key"))
        by_key = entities.join(keys, "key", "left")
        prefix = docs.where(F.coalesce("base_iri", F.lit("")) != "").groupBy(F.col("base_iri").alias("prefix")).agg(F.max(F.struct("doc_order", "path")).alias("d"))
        left = by_key.where("path IS NULL").select("iri")
        cuts = F.filter(F.sequence(F.lit(1), F.length("iri")), lambda i: F.substring("iri", i, F.lit(1)).isin("#", "/", ":", "_") | (i == F.length("iri")))
        parts = left.select("iri", F.explode(F.array_distinct(F.flatten(F.transform(cuts, lambda i: F.array(F.substring("iri", F.lit(1), i), F.substring("iri", F.lit(1), i - 1)))))).alias("prefix"))
        by_prefix = parts.join(prefix, "prefix").groupBy("iri").agg(F.max_by("d.path", F.struct(F.length("prefix"), "d.doc_order")).alias("path"))
        return by_key.where("path IS NOT NULL").select("iri", "path").unionByName(by_prefix)

    # -- hierarchy and detail

    def hierarchy(self) -> DataFrame:
        """child, parent of subclass axioms whose child is a known class."""
        classes = self.entities.where("kind = 'class'").select(F.col("iri").alias("child"))
        edges = self.axioms.where("axiom_kind = 'sub_class_of'").select(F.col("subject").alias("child"), F.col("object").alias("parent"))
        return edges.join(classes, "child", "left_semi").distinct()

    def parents(self) -> DataFrame:
        return self.hierarchy().groupBy("child").agg(F.sort_array(F.collect_set("parent")).alias("parents"))

    def children(self) -> DataFrame:
        return self.hierarchy().groupBy("parent").agg(F.sort_array(F.collect_set("child")).alias("children"))

    def entity_detail(self, iri: str) -> dict[str, DataFrame]:
        """What a detail pane shows of one entity."""
        edges = self.hierarchy()
        own = self.axioms.where(F.col("subject") == iri)
        shown = own.select("axiom_kind", X.axiom_label("axiom_kind").alias("label"), X.axiom_display("axiom_kind", "predicate", "object").alias("display"), "object")
        from lattica.model import COMMENT, DEPRECATED, LABEL

        rest = self.annotations.where((F.col("subject") == iri) & ~F.col("predicate").isin(LABEL, COMMENT, DEPRECATED)).orderBy(X.annotation_order("predicate"), "object")
        return {"entity": self.entities.where(F.col("iri") == iri), "parents": edges.where(F.col("child") == iri).select("parent").orderBy("parent"), "children": edges.where(F.col("parent") == iri).select("child").orderBy("child"), "axioms": shown, "annotations": rest, "source": self.owners().where(F.col("iri") == iri)}

    def namespace_map(self) -> DataFrame:
        """prefix, iri: the first document that declares a prefix wins."""
        order = self.documents.select(F.col("id").alias("ontology_id"), "doc_order").unionByName(self.documents.where("base_iri IS NOT NULL").select(F.col("base_iri").alias("ontology_id"), "doc_order")).groupBy("ontology_id").agg(F.min("doc_order").alias("doc_order"))
        return self.namespaces.join(order, "ontology_id", "left").groupBy("prefix").agg(F.min_by("iri", F.struct(F.coalesce("doc_order", F.lit(1 << 60)), "iri")).alias("iri"))


def _text(df: DataFrame) -> DataFrame:
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def merge_entities(rows: DataFrame) -> DataFrame:
    """One row for each IRI of rows with doc_order: labels and comments in order of first sight, booleans or-ed, the last
    ontology, the first OBO id, location and kind other than 'other'."""
    ordered = lambda c: F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("doc_order", c))), lambda x: x[c]))).alias(c)
    first = lambda value, keep: F.min_by(value, F.when(keep, F.col("doc_order")))
    flags = [f.name for f in rows.schema["characteristics"].dataType.fields]
    return rows.groupBy("iri").agg(
        F.min_by("short_name", "doc_order").alias("short_name"),
        F.coalesce(first("kind", F.col("kind") != "other"), F.min("kind")).alias("kind"),
        F.max_by("ontology_id", "doc_order").alias("ontology_id"),
        first("source_location", F.col("source_location").isNotNull()).alias("source_location"),
        ordered("labels"),
        ordered("comments"),
        F.bool_or(F.coalesce("deprecated", F.lit(False))).alias("deprecated"),
        first("obo_id", F.coalesce("obo_id", F.lit("")) != "").alias("obo_id"),
        F.struct(*[F.coalesce(F.bool_or(f"characteristics.{f}"), F.lit(False)).alias(f) for f in flags]).alias("characteristics"),
    )


def capped(df: DataFrame, limit: int = MAX_RESULT_ROWS) -> tuple[DataFrame, bool]:
    """At most so many rows, and whether there are more."""
    more = df.limit(limit + 1).count() > limit
    return df.limit(limit), more


def window_first(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """Of rows with equal keys the first by order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
