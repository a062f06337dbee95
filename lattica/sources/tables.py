"""A catalog over relational tables: places, products and parties become classes and individuals.

The same mapping is stated once more as SQL (``MAPPING``), which the queries' DuckDB counterparts start from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.catalog import Catalog
from lattica.functions import exprs as X
from lattica.model import LABEL, RDF, RDFS, XSD, schema
from lattica.storage import cut

BASE = "http://example.org/t/"
ONTOLOGIES = ["core", "orders", "parties", "parts"]

_ROOTS = ["Place", "Product", "Party"]
_PROPERTIES = [("object_property", "placedBy", "orders"), ("object_property", "contains", "orders"), ("object_property", "suppliedBy", "parts"), ("data_property", "totalprice", "orders"), ("data_property", "quantity", "orders"), ("annotation_property", "size", "parts"), ("annotation_property", "segment", "parties"), ("annotation_property", "priority", "orders")]


def _iri(kind: str, key: str | Column) -> Column:
    return F.concat(F.lit(f"{BASE}{kind}/"), F.col(key).cast("string") if isinstance(key, str) else key)


def from_tables(spark: SparkSession, sf_dir: str) -> Catalog:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    t = {n: read(n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    onto = lambda name: F.lit(f"{BASE}onto/{name}")

    def entity(df: DataFrame, kind: str, iri: Column, ontology: str, label: Column | None = None, deprecated: Column | None = None) -> DataFrame:
        labels = F.array(label) if label is not None else F.array().cast("array<string>")
        return df.select(iri.alias("iri"), F.lit(kind).alias("kind"), onto(ontology).alias("ontology_id"), labels.alias("labels"), (deprecated if deprecated is not None else F.lit(False)).alias("deprecated"))

    def axiom(df: DataFrame, kind: str, subject: Column, obj: Column, ontology: str, predicate: Column | None = None) -> DataFrame:
        return df.select(onto(ontology).alias("ontology_id"), subject.alias("subject"), (predicate if predicate is not None else F.lit("")).alias("predicate"), obj.alias("object"), F.lit(kind).alias("axiom_kind"))

    one = spark.range(1)
    types, brands = t["part"].select("p_type").distinct(), t["part"].select("p_brand").distinct()
    entities = [entity(one, "class", F.lit(BASE + r), "core", F.lit(r)) for r in _ROOTS]
    entities += [entity(one, k, F.lit(BASE + n), o, F.lit(n)) for k, n, o in _PROPERTIES]
    entities += [
        entity(t["region"], "class", _iri("region", "r_regionkey"), "core", F.col("r_name")),
        entity(t["nation"], "class", _iri("nation", "n_nationkey"), "core", F.col("n_name")),
        entity(types, "class", _iri("type", F.replace("p_type", F.lit(" "), F.lit("_"))), "parts"),
        entity(brands, "class", _iri("brand", F.replace("p_brand", F.lit("#"), F.lit("-"))), "parts", F.col("p_brand")),
        entity(t["part"], "class", _iri("part", "p_partkey"), "parts", F.col("p_name"), F.col("p_size") % 10 == 0),
        entity(t["customer"], "individual", _iri("customer", "c_custkey"), "parties", F.col("c_name")),
        entity(t["supplier"], "individual", _iri("supplier", "s_suppkey"), "parties", F.col("s_name")),
        entity(t["orders"], "individual", _iri("order", "o_orderkey"), "orders"),
    ]
    type_iri = lambda: _iri("type", F.replace("p_type", F.lit(" "), F.lit("_")))
    brand_iri = lambda: _iri("brand", F.replace("p_brand", F.lit("#"), F.lit("-")))
    name = lambda n: F.lit(BASE + n)
    axioms = [
        axiom(t["region"], "sub_class_of", _iri("region", "r_regionkey"), name("Place"), "core"),
        axiom(t["nation"], "sub_class_of", _iri("nation", "n_nationkey"), _iri("region", "n_regionkey"), "core"),
        axiom(t["nation"], "sub_class_of", _iri("nation", "n_nationkey"), F.concat(F.lit("locatedIn some "), _iri("region", "n_regionkey")), "core"),
        axiom(types, "sub_class_of", type_iri(), name("Product"), "parts"),
        axiom(t["part"].select("p_brand", "p_type").distinct(), "sub_class_of", brand_iri(), type_iri(), "parts"),
        axiom(t["part"], "sub_class_of", _iri("part", "p_partkey"), brand_iri(), "parts"),
        axiom(t["part"].where("p_size % 25 = 0"), "sub_class_of", _iri("part", "p_partkey"), F.concat(F.lit("suppliedBy max "), F.col("p_size").cast("string"), F.lit(" "), name("Party")), "parts"),
        axiom(t["region"].where("r_regionkey > 0"), "disjoint_class", _iri("region", F.lit("0")), _iri("region", "r_regionkey"), "core"),
        axiom(t["nation"].where("n_nationkey % 5 = 0"), "equivalent_class", _iri("nation", "n_nationkey"), F.concat(F.lit(f"{BASE}state/"), F.col("n_nationkey").cast("string")), "core"),
        *[axiom(one, "domain", name(p), name(d), o) for p, d, o in (("contains", "Order", "orders"), ("placedBy", "Order", "orders"), ("suppliedBy", "Product", "parts"))],
        *[axiom(one, "range", name(p), name(r), o) for p, r, o in (("contains", "Product", "orders"), ("placedBy", "Party", "orders"), ("suppliedBy", "Party", "parts"))],
        axiom(t["customer"], "class_assertion", _iri("customer", "c_custkey"), _iri("nation", "c_nationkey"), "parties", F.lit(RDF + "type")),
        axiom(t["supplier"], "class_assertion", _iri("supplier", "s_suppkey"), _iri("nation", "s_nationkey"), "parties", F.lit(RDF + "type")),
        axiom(t["orders"], "object_property_assertion", _iri("order", "o_orderkey"), _iri("customer", "o_custkey"), "orders", name("placedBy")),
        axiom(t["lineitem"].select("l_orderkey", "l_partkey").distinct(), "object_property_assertion", _iri("order", "l_orderkey"), _iri("part", "l_partkey"), "orders", name("contains")),
        axiom(t["lineitem"].select("l_partkey", "l_suppkey").distinct(), "object_property_assertion", _iri("part", "l_partkey"), _iri("supplier", "l_suppkey"), "parts", name("suppliedBy")),
        axiom(t["orders"], "data_property_assertion", _iri("order", "o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "orders", name("totalprice")),
    ]
    ann = lambda df, s, p, v, o: df.select(s.alias("subject"), name(p).alias("predicate"), F.col(v).cast("string").alias("object"), onto(o).alias("ontology_id"))
    annotations = reduce(DataFrame.unionByName, [ann(t["part"], _iri("part", "p_partkey"), "size", "p_size", "parts"), ann(t["customer"], _iri("customer", "c_custkey"), "segment", "c_mktsegment", "parties"), ann(t["orders"], _iri("order", "o_orderkey"), "priority", "o_orderpriority", "orders")])

    full, ax = _entities(reduce(DataFrame.unionByName, entities)), _axioms(reduce(DataFrame.unionByName, axioms))

    # Fixed documents: parts and parties import core; orders imports both, and one ontology that is nowhere.
    rows = [(i, f"doc-{i}", f"/data/{o}.ttl", "turtle", f"{BASE}onto/{o}", None, [f"{BASE}onto/{x}" for x in m], {"t": BASE}, "ok", None, None, None, None) for i, (o, m) in enumerate([("core", []), ("orders", ["parties", "parts", "missing"]), ("parties", ["core"]), ("parts", ["core"])])]
    documents = spark.createDataFrame(rows, schema("documents"))
    imports = documents.select(F.col("base_iri").alias("ontology_id"), F.explode("imports").alias("import_iri"))
    namespaces = documents.select(F.lit("t").alias("prefix"), F.lit(BASE).alias("iri"), F.col("base_iri").alias("ontology_id"))
    return Catalog(spark, documents, full, annotations, ax, namespaces, imports, quads_of(full, ax, annotations))


def _entities(rows: DataFrame) -> DataFrame:
    """The whole frame of entities, from the columns that tell them apart."""
    none = "cast(null as {})".format
    return rows.select("iri", X.short_name("iri").alias("short_name"), "kind", "ontology_id", F.expr(none(schema("entities")["source_location"].dataType.simpleString())).alias("source_location"), "labels", F.array().cast("array<string>").alias("comments"), "deprecated", F.lit(None).cast("string").alias("obo_id"), F.expr("named_struct(" + ", ".join(f"'{f.name}', false" for f in schema("entities")["characteristics"].dataType.fields) + ")").alias("characteristics"))


def _axioms(rows: DataFrame) -> DataFrame:
    """The whole frame of axioms; ids are digests of what they say, computed only where they are read."""
    digest = F.sha2(F.concat_ws("|", "ontology_id", "axiom_kind", "subject", "predicate", "object"), 256)
    return rows.select(F.concat(F.lit("axiom-"), F.substring(digest, 1, 16)).alias("id"), "ontology_id", "subject", "predicate", "object", "axiom_kind", F.array().cast("array<struct<predicate: string, value: string>>").alias("annotations"))


_STORED: dict[tuple[str, str], Catalog] = {}


def stored(spark: SparkSession, sf_dir: str) -> Catalog:
    """The same catalog, indexed: its frames are written once in a session, and queries read those.

    Only what can't be computed from other columns or tables is written; ids, short names and quads follow from it row by row."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _STORED:
        c = from_tables(spark, sf_dir)
        entities = _entities(cut(c.entities.select("iri", "kind", "ontology_id", "labels", "deprecated"), "entities", "zstd"))
        axioms = _axioms(cut(c.axioms.select("ontology_id", "subject", "predicate", "object", "axiom_kind"), "axioms", "zstd"))
        annotations = cut(c.annotations, "annotations", "zstd")
        _STORED[key] = c.with_(entities=entities, axioms=axioms, annotations=annotations, quads=quads_of(entities, axioms, annotations))
    return _STORED[key]


def quads_of(entities: DataFrame, axioms: DataFrame, annotations: DataFrame) -> DataFrame:
    """Types, labels, named superclasses, assertions and annotations as quads of the default graph."""
    from lattica.model import ENTITY_TYPES

    types = F.create_map(*[F.lit(x) for k, v in ENTITY_TYPES.items() for x in (k, v[0])])

    def quad(df: DataFrame, s: str, p: Column, o: Column, kind: Column, datatype: Column) -> DataFrame:
        return df.select(F.col(s).alias("s"), F.lit("iri").alias("s_kind"), p.alias("p"), o.alias("o"), kind.alias("o_kind"), datatype.cast("string").alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"), F.lit(None).cast("string").alias("g"), F.col("ontology_id").alias("doc_id"))

    kind, none, iri, literal = F.col("axiom_kind"), F.lit(None), F.lit("iri"), F.lit("literal")
    named = kind.isin("sub_class_of", "class_assertion", "object_property_assertion") & ~F.contains("object", F.lit(" "))
    data = kind == "data_property_assertion"
    # One pass over the axioms for all kinds of them.
    said = F.when(kind == "sub_class_of", RDFS + "subClassOf").when(kind == "class_assertion", RDF + "type").otherwise(F.col("predicate"))
    return reduce(DataFrame.unionByName, [
        quad(entities, "iri", F.lit(RDF + "type"), F.element_at(types, F.col("kind")), iri, none),
        quad(entities.select("iri", "ontology_id", F.explode("labels").alias("label")), "iri", F.lit(LABEL), F.col("label"), literal, F.lit(XSD + "string")),
        quad(axioms.where(named | data), "subject", said, F.col("object"), F.when(data, literal).otherwise(iri), F.when(data, XSD + "decimal")),
        quad(annotations, "subject", F.col("predicate"), F.col("object"), literal, F.lit(XSD + "string")),
    ])


def _sql() -> str:
    b, o = BASE, lambda n: f"'{BASE}onto/{n}'"
    iri = lambda k, c: f"'{b}{k}/' || CAST({c} AS VARCHAR)"
    typ, brand = f"'{b}type/' || replace(p_type, ' ', '_')", f"'{b}brand/' || replace(p_brand, '#', '-')"
    ents = [f"SELECT '{b}{r}' AS iri, 'class' AS kind, {o('core')} AS ontology_id, '{r}' AS label, false AS deprecated" for r in _ROOTS]
    ents += [f"SELECT '{b}{n}', '{k}', {o(x)}, '{n}', false" for k, n, x in _PROPERTIES]
    ents += [
        f"SELECT {iri('region', 'r_regionkey')}, 'class', {o('core')}, r_name, false FROM region",
        f"SELECT {iri('nation', 'n_nationkey')}, 'class', {o('core')}, n_name, false FROM nation",
        f"SELECT DISTINCT {typ}, 'class', {o('parts')}, NULL, false FROM part",
        f"SELECT DISTINCT {brand}, 'class', {o('parts')}, p_brand, false FROM part",
        f"SELECT {iri('part', 'p_partkey')}, 'class', {o('parts')}, p_name, p_size % 10 = 0 FROM part",
        f"SELECT {iri('customer', 'c_custkey')}, 'individual', {o('parties')}, c_name, false FROM customer",
        f"SELECT {iri('supplier', 's_suppkey')}, 'individual', {o('parties')}, s_name, false FROM supplier",
        f"SELECT {iri('order', 'o_orderkey')}, 'individual', {o('orders')}, NULL, false FROM orders",
    ]
    axs = [
        f"SELECT {o('core')} AS ontology_id, {iri('region', 'r_regionkey')} AS subject, '' AS predicate, '{b}Place' AS object, 'sub_class_of' AS axiom_kind FROM region",
        f"SELECT {o('core')}, {iri('nation', 'n_nationkey')}, '', {iri('region', 'n_regionkey')}, 'sub_class_of' FROM nation",
        f"SELECT {o('core')}, {iri('nation', 'n_nationkey')}, '', 'locatedIn some ' || {iri('region', 'n_regionkey')}, 'sub_class_of' FROM nation",
        f"SELECT DISTINCT {o('parts')}, {typ}, '', '{b}Product', 'sub_class_of' FROM part",
        f"SELECT DISTINCT {o('parts')}, {brand}, '', {typ}, 'sub_class_of' FROM part",
        f"SELECT {o('parts')}, {iri('part', 'p_partkey')}, '', {brand}, 'sub_class_of' FROM part",
        f"SELECT {o('parts')}, {iri('part', 'p_partkey')}, '', 'suppliedBy max ' || CAST(p_size AS VARCHAR) || ' {b}Party', 'sub_class_of' FROM part WHERE p_size % 25 = 0",
        f"SELECT {o('core')}, '{b}region/0', '', {iri('region', 'r_regionkey')}, 'disjoint_class' FROM region WHERE r_regionkey > 0",
        f"SELECT {o('core')}, {iri('nation', 'n_nationkey')}, '', {iri('state', 'n_nationkey')}, 'equivalent_class' FROM nation WHERE n_nationkey % 5 = 0",
        *[f"SELECT {o(x)}, '{b}{p}', '', '{b}{d}', 'domain'" for p, d, x in (("contains", "Order", "orders"), ("placedBy", "Order", "orders"), ("suppliedBy", "Product", "parts"))],
        *[f"SELECT {o(x)}, '{b}{p}', '', '{b}{r}', 'range'" for p, r, x in (("contains", "Product", "orders"), ("placedBy", "Party", "orders"), ("suppliedBy", "Party", "parts"))],
        f"SELECT {o('parties')}, {iri('customer', 'c_custkey')}, '{RDF}type', {iri('nation', 'c_nationkey')}, 'class_assertion' FROM customer",
        f"SELECT {o('parties')}, {iri('supplier', 's_suppkey')}, '{RDF}type', {iri('nation', 's_nationkey')}, 'class_assertion' FROM supplier",
        f"SELECT {o('orders')}, {iri('order', 'o_orderkey')}, '{b}placedBy', {iri('customer', 'o_custkey')}, 'object_property_assertion' FROM orders",
        f"SELECT DISTINCT {o('orders')}, {iri('order', 'l_orderkey')}, '{b}contains', {iri('part', 'l_partkey')}, 'object_property_assertion' FROM lineitem",
        f"SELECT DISTINCT {o('parts')}, {iri('part', 'l_partkey')}, '{b}suppliedBy', {iri('supplier', 'l_suppkey')}, 'object_property_assertion' FROM lineitem",
        f"SELECT {o('orders')}, {iri('order', 'o_orderkey')}, '{b}totalprice', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), 'data_property_assertion' FROM orders",
    ]
    anns = [
        f"SELECT {iri('part', 'p_partkey')} AS subject, '{b}size' AS predicate, CAST(p_size AS VARCHAR) AS object, {o('parts')} AS ontology_id FROM part",
        f"SELECT {iri('customer', 'c_custkey')}, '{b}segment', c_mktsegment, {o('parties')} FROM customer",
        f"SELECT {iri('order', 'o_orderkey')}, '{b}priority', o_orderpriority, {o('orders')} FROM orders",
    ]
    owl, rdfs, xsd = "http://www.w3.org/2002/07/owl#", RDFS, XSD
    quads = [
        f"SELECT iri AS s, '{RDF}type' AS p, CASE kind WHEN 'class' THEN '{owl}Class' WHEN 'individual' THEN '{owl}NamedIndividual' WHEN 'object_property' THEN '{owl}ObjectProperty' WHEN 'data_property' THEN '{owl}DatatypeProperty' ELSE '{owl}AnnotationProperty' END AS o, 'iri' AS o_kind, CAST(NULL AS VARCHAR) AS dt, ontology_id AS doc_id FROM ent",
        f"SELECT iri, '{LABEL}', label, 'literal', '{xsd}string', ontology_id FROM ent WHERE label IS NOT NULL",
        f"SELECT subject, '{rdfs}subClassOf', object, 'iri', NULL, ontology_id FROM ax WHERE axiom_kind = 'sub_class_of' AND NOT contains(object, ' ')",
        "SELECT subject, predicate, object, 'iri', NULL, ontology_id FROM ax WHERE axiom_kind IN ('class_assertion', 'object_property_assertion')",
        f"SELECT subject, predicate, object, 'literal', '{xsd}decimal', ontology_id FROM ax WHERE axiom_kind = 'data_property_assertion'",
        f"SELECT subject, predicate, object, 'literal', '{xsd}string', ontology_id FROM ann",
    ]
    docs = ", ".join(f"({i}, '{b}onto/{n}', '/data/{n}.ttl')" for i, n in enumerate(ONTOLOGIES))
    imps = ", ".join(f"('{b}onto/{a}', '{b}onto/{c}')" for a, c in (("orders", "parties"), ("orders", "parts"), ("orders", "missing"), ("parties", "core"), ("parts", "core")))
    union = " UNION ALL ".join
    return f"WITH RECURSIVE ent AS ({union(ents)}), ax AS ({union(axs)}), ann AS ({union(anns)}), q AS ({union(quads)}), doc(doc_order, base_iri, path) AS (VALUES {docs}), imp(ontology_id, import_iri) AS (VALUES {imps})"


#: Common table expressions ent, ax, ann, q (quads), doc, imp: the same catalog in SQL.
MAPPING = _sql()
