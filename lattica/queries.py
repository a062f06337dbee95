"""Queries over whole tables, one or more for each operator, and the DuckDB SQL that says the same.

The SQL starts from ``MAPPING`` (ent, ax, ann, q, doc, imp), which states the catalog over the tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.catalog import Catalog, merge_entities
from lattica.functions import exprs as X
from lattica.operators import diagnostics, diff, fixpoint, graph, usages
from lattica.plans import stats
from lattica.plans.sparql import run_sparql
from lattica.plans.sqlgate import run_sql
from lattica.sources.tables import BASE, MAPPING, stored
from lattica.storage import cut, shared_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def define(name: str, query: Callable[[Catalog], DataFrame], sql: str | None = None, tables: bool = False) -> None:
    """A query over the catalog, or over (spark, sf_dir) itself."""
    QUERIES[name] = query if tables else lambda spark, sf_dir: query(stored(spark, sf_dir))
    if sql is not None:
        ORACLE_SQL[name] = sql if tables else f"{MAPPING} {sql}" if sql.lstrip().upper().startswith("SELECT") else f"{MAPPING}, {sql}"


_SHORT = "CASE WHEN contains({0}, '#') THEN regexp_extract({0}, '[^#]*$') WHEN contains({0}, '/') THEN regexp_extract({0}, '[^/]*$') ELSE {0} END"
_ENT = f"iri, {_SHORT.format('iri')} AS short_name, kind, ontology_id, coalesce(label, '') AS labels, '' AS comments, CAST(deprecated AS VARCHAR) AS deprecated, '' AS obo_id"
_HIER = "h AS (SELECT DISTINCT subject AS child, object AS parent FROM ax WHERE axiom_kind = 'sub_class_of' AND subject IN (SELECT iri FROM ent WHERE kind = 'class'))"
_OWNER = "'/data/' || regexp_extract(ontology_id, '[^/]*$') || '.ttl'"
_HEAD_DOC = "'/data/' || regexp_extract(ontology_id, '[^/]*$') || '.ttl'"
T = BASE


# -- the SQL subset and its views

define("p1_sql_flagship", lambda c: run_sql(c, f"SELECT short_name, labels FROM classes WHERE deprecated = 'false' AND ontology_id != '{T}onto/core'").frame, f"SELECT short_name, labels FROM (SELECT {_ENT} FROM ent) WHERE kind = 'class' AND deprecated = 'false' AND ontology_id <> '{T}onto/core'")
define("p2_sql_star", lambda c: run_sql(c, "SELECT * FROM individuals").frame, f"SELECT {_ENT} FROM ent WHERE kind = 'individual'")
define("p4_sql_alias", lambda c: run_sql(c, "SELECT iri AS Thing, labels name FROM entities").frame, "SELECT iri AS thing, coalesce(label, '') AS name FROM ent")
define("p6_sql_equal_text", lambda c: run_sql(c, "SELECT subject, object FROM annotations WHERE object = 7").frame, "SELECT subject, object FROM ann WHERE object = '7'")
define("p7_sql_not_equal", lambda c: run_sql(c, "SELECT iri FROM classes WHERE labels <> '' AND short_name != 'Place'").frame, "SELECT iri FROM ent WHERE kind = 'class' AND label IS NOT NULL AND iri NOT LIKE '%/Place'")
define("p8_sql_and_or", lambda c: run_sql(c, f"SELECT iri FROM entities WHERE kind = 'class' AND deprecated = 'true' OR kind = 'individual' AND ontology_id = '{T}onto/parties'").frame, f"SELECT iri FROM ent WHERE kind = 'class' AND deprecated OR kind = 'individual' AND ontology_id = '{T}onto/parties'")
define("p9_sql_parentheses", lambda c: run_sql(c, "SELECT iri FROM entities WHERE (kind = 'class' OR kind = 'individual') AND ((deprecated = 'true'))").frame, "SELECT iri FROM ent WHERE kind IN ('class', 'individual') AND deprecated")
define("p10_sql_constant", lambda c: run_sql(c, "SELECT prefix, iri FROM namespaces WHERE TRUE OR FALSE").frame, f"SELECT 't' AS prefix, '{T}' AS iri FROM doc")
define("p11_sql_literals", lambda c: run_sql(c, "SELECT iri FROM properties WHERE deprecated = false AND 'a' = 'a'").frame, "SELECT iri FROM ent WHERE kind IN ('object_property', 'data_property', 'annotation_property')")
define("p13_sql_permissive", lambda c: run_sql(c, "SELECT kind, count(*) AS n FROM entities GROUP BY kind ORDER BY n DESC, kind LIMIT 3", permissive=True).frame, "SELECT kind, count(*) AS n FROM ent GROUP BY kind ORDER BY n DESC, kind LIMIT 3")
define("p15_sql_row_cap", lambda c: run_sql(c, "SELECT iri FROM individuals").capped(1000)[0].agg(F.count("*").alias("n")), "SELECT least(count(*), 1000) AS n FROM ent WHERE kind = 'individual'")
for _kind, _view in (("class", "classes"), ("object_property", "object_properties"), ("data_property", "data_properties"), ("annotation_property", "annotation_properties")):
    define(f"view_{_view}", lambda c, v=_view: c.view(v), f"SELECT {_ENT} FROM ent WHERE kind = '{_kind}'")
define("view_entities", lambda c: c.view("entities"), f"SELECT {_ENT} FROM ent")
define("view_properties", lambda c: c.view("properties"), f"SELECT {_ENT} FROM ent WHERE kind IN ('object_property', 'data_property', 'annotation_property')")
define("view_annotations", lambda c: c.view("annotations"), "SELECT subject, predicate, object, ontology_id FROM ann")
define("view_axioms", lambda c: c.view("axioms"), "SELECT 'axiom-' || substr(sha256(ontology_id || '|' || axiom_kind || '|' || subject || '|' || predicate || '|' || object), 1, 16) AS id, ontology_id, subject, predicate, object, axiom_kind FROM ax")
define("view_imports", lambda c: c.view("imports"), "SELECT ontology_id, import_iri FROM imp")
define("view_ontologies", lambda c: c.view("ontologies").select("id", "path", "format", "base_iri", "parse_status"), "SELECT 'doc-' || CAST(doc_order AS VARCHAR) AS id, path, 'turtle' AS format, base_iri, 'ok' AS parse_status FROM doc")
define("view_equivalent_class_axioms", lambda c: c.view("equivalent_class_axioms"), "SELECT subject AS class_iri, object AS expression FROM ax WHERE axiom_kind = 'equivalent_class'")
define("view_disjoint_class_axioms", lambda c: c.view("disjoint_class_axioms"), "SELECT subject AS class_iri, object AS disjoint_with FROM ax WHERE axiom_kind = 'disjoint_class'")
define("view_domain_axioms", lambda c: c.view("domain_axioms"), "SELECT subject AS property_iri, object AS domain FROM ax WHERE axiom_kind = 'domain'")
define("view_range_axioms", lambda c: c.view("range_axioms"), "SELECT subject AS property_iri, object AS \"range\" FROM ax WHERE axiom_kind = 'range'")
define("p19_view_restrictions", lambda c: c.view("restrictions"), "SELECT subject AS class_iri, split_part(object, ' ', 1) AS property_iri, split_part(object, ' ', 2) AS restriction_kind, object AS filler FROM ax WHERE axiom_kind = 'sub_class_of' AND contains(object, ' ')")
define("p19_restrictions_exact", lambda c: c.restrictions_exact(), "SELECT subject AS class_iri, split_part(object, ' ', 1) AS property_iri, split_part(object, ' ', 2) AS restriction_kind, CASE WHEN split_part(object, ' ', 2) = 'max' THEN CAST(split_part(object, ' ', 3) AS INTEGER) END AS cardinality, regexp_extract(object, '[^ ]*$') AS filler FROM ax WHERE axiom_kind = 'sub_class_of' AND contains(object, ' ')")
define("p16_search", lambda c: c.search("nation_1", None).select("iri", "short_name"), f"SELECT iri, {_SHORT.format('iri')} AS short_name FROM ent WHERE contains(lower(iri), 'nation_1') OR contains(lower(coalesce(label, '')), 'nation_1')")
define("t4_search_top_k", lambda c: c.search("brand", 20).select("iri"), "SELECT iri FROM ent WHERE contains(lower(iri), 'brand') OR contains(lower(coalesce(label, '')), 'brand') ORDER BY regexp_extract(iri, '[^/]*$'), iri LIMIT 20")
define("p16b_symbols", lambda c: c.symbols("region").select("iri", "path"), f"SELECT iri, {_OWNER} AS path FROM ent WHERE contains(lower(iri), 'region') OR contains(lower(coalesce(label, '')), 'region')")
define("p16c_completions", lambda c: c.completions("class"), "SELECT DISTINCT iri FROM ent WHERE kind = 'class' ORDER BY iri LIMIT 100")
define("p16e_result_seeds", lambda c: graph.result_seeds(run_sql(c, "SELECT * FROM domain_axioms").frame), "SELECT DISTINCT x AS iri FROM (SELECT subject AS x FROM ax WHERE axiom_kind = 'domain' UNION ALL SELECT object FROM ax WHERE axiom_kind = 'domain')")

# -- joins

define("j1_axiom_entity", lambda c: c.axioms.join(c.entities, F.col("subject") == F.col("iri")).groupBy("axiom_kind", "kind").agg(F.count("*").alias("n")), "SELECT axiom_kind, kind, count(*) AS n FROM ax JOIN ent ON subject = iri GROUP BY ALL")
define("j2_hierarchy_semi", lambda c: c.hierarchy(), f"{_HIER} SELECT child, parent FROM h")
define("j5_annotation_difference", lambda c: diff._changed(c.annotations, _head(c).annotations, ["ontology_id", "subject", "predicate", "object"]).groupBy("change", "predicate").agg(F.count("*").alias("n")), "HEADS SELECT change, predicate, count(*) AS n FROM (SELECT 'removed' AS change, predicate FROM ann WHERE (subject, predicate, object) NOT IN (SELECT subject, predicate, object FROM hann) UNION ALL SELECT 'added', predicate FROM hann WHERE (subject, predicate, object) NOT IN (SELECT subject, predicate, object FROM ann)) GROUP BY ALL")
define("j8_owner", lambda c: c.owners(), f"SELECT iri, {_OWNER} AS path FROM ent")
define("j9_axiom_document", lambda c: c.axioms.join(c.documents.select(F.col("base_iri").alias("ontology_id"), "path"), "ontology_id").groupBy("path").agg(F.count("*").alias("n")), f"SELECT {_OWNER} AS path, count(*) AS n FROM ax GROUP BY ALL")
define("j10_curie", lambda c: c.entities.select("iri", X.curie("iri", F.create_map(F.lit("t"), F.lit(T), F.lit("part"), F.lit(T + "part/"))).alias("curie")), f"SELECT iri, CASE WHEN starts_with(iri, '{T}part/') THEN 'part:' || substr(iri, {len(T) + 6}) ELSE 't:' || substr(iri, {len(T) + 1}) END AS curie FROM ent")
define("j11_mentioned_classes", lambda c: graph.mentioned_classes(c), "SELECT DISTINCT ax.subject, ent.iri AS filler FROM ax JOIN ent ON ent.kind = 'class' AND list_contains(string_split(ax.object, ' '), ent.iri) WHERE axiom_kind = 'sub_class_of' AND contains(ax.object, ' ')")
define("j12_pairs", lambda c: _sibling_pairs(c), "SELECT a.object AS class, a.subject AS x, b.subject AS y FROM ax a JOIN ax b ON a.object = b.object AND a.subject <> b.subject WHERE a.axiom_kind = 'sub_class_of' AND b.axiom_kind = 'sub_class_of' AND a.ontology_id LIKE '%core' AND b.ontology_id LIKE '%core' AND NOT contains(a.object, ' ')")
define("j16_reuse", lambda c: _reuse(c), f"SELECT CASE WHEN b.path IS NULL THEN 'reparsed' WHEN a.path IS NULL THEN 'removed' ELSE 'reused' END AS state, coalesce(a.path, b.path) AS path FROM doc a FULL JOIN (SELECT path FROM doc WHERE doc_order <> 1 UNION ALL SELECT '/data/old.ttl') b ON a.path = b.path")
define("j18_import_resolution", lambda c: usages.resolve_imports(c), "SELECT imp.ontology_id, import_iri, path FROM imp LEFT JOIN doc ON doc.base_iri = imp.import_iri")


def _sibling_pairs(c: Catalog) -> DataFrame:
    e = c.axioms.where(F.col("axiom_kind").eqNullSafe("sub_class_of") & F.endswith("ontology_id", F.lit("core")) & ~F.contains("object", F.lit(" ")))
    x, y = e.select(F.col("object").alias("class"), F.col("subject").alias("x")), e.select(F.col("object").alias("class"), F.col("subject").alias("y"))
    return x.join(y, "class").where("x <> y")


def _reuse(c: Catalog) -> DataFrame:
    from lattica.sources.incremental import reuse_plan

    old = c.documents.where("doc_order <> 1").select("path", F.col("base_iri").alias("content_hash"))
    old = old.union(c.spark.createDataFrame([("/data/old.ttl", "x")], old.schema))
    return reuse_plan(c.documents.select("path", F.col("base_iri").alias("content_hash")), old).select("state", "path")


def _head(c: Catalog) -> Catalog:
    """A later state: a seventh of the parts is gone, as many come back re-keyed with a link to the old one, some are deprecated."""
    gone = F.startswith("iri", F.lit(T + "part/")) & (F.regexp_extract("iri", "([0-9]+)$", 1).try_cast("bigint") % 7 == 0)
    subject = lambda s: F.coalesce(F.startswith(s, F.lit(T + "part/")) & (F.regexp_extract(s, "([0-9]+)$", 1).try_cast("bigint") % 7 == 0), F.lit(False))
    moved = c.entities.where(gone & (F.regexp_extract("iri", "([0-9]+)$", 1).try_cast("bigint") % 14 == 0))
    new = moved.withColumn("iri", F.concat("iri", F.lit("-new")))
    kept = c.entities.where(~F.coalesce(gone, F.lit(False)))
    kept = kept.withColumn("deprecated", F.col("deprecated") | F.startswith("iri", F.lit(T + "nation/1")))
    links = moved.select(F.concat("iri", F.lit("-new")).alias("subject"), F.lit("http://www.w3.org/2002/07/owl#sameAs").alias("predicate"), F.col("iri").alias("object"), "ontology_id")
    return c.with_(entities=kept.unionByName(new), annotations=c.annotations.where(~subject("subject")).unionByName(links), axioms=c.axioms.where(~subject("subject") & ~subject("object")), imports=c.imports.where(~F.endswith("import_iri", F.lit("missing"))))


_GONE = f"(starts_with({{0}}, '{T}part/') AND coalesce(TRY_CAST(regexp_extract({{0}}, '[0-9]+$') AS BIGINT) % 7 = 0, false))"
_HEADS = (
    f"hent AS (SELECT iri, kind, ontology_id, label, deprecated OR starts_with(iri, '{T}nation/1') AS deprecated FROM ent WHERE NOT {_GONE.format('iri')} UNION ALL SELECT iri || '-new', kind, ontology_id, label, deprecated FROM ent WHERE {_GONE.format('iri')} AND TRY_CAST(regexp_extract(iri, '[0-9]+$') AS BIGINT) % 14 = 0), "
    f"hann AS (SELECT * FROM ann WHERE NOT {_GONE.format('subject')} UNION ALL SELECT iri || '-new', 'http://www.w3.org/2002/07/owl#sameAs', iri, ontology_id FROM ent WHERE {_GONE.format('iri')} AND TRY_CAST(regexp_extract(iri, '[0-9]+$') AS BIGINT) % 14 = 0), "
    f"hax AS (SELECT * FROM ax WHERE NOT {_GONE.format('subject')} AND NOT {_GONE.format('object')}), himp AS (SELECT * FROM imp WHERE import_iri NOT LIKE '%missing')"
)
ORACLE_SQL["j5_annotation_difference"] = ORACLE_SQL["j5_annotation_difference"].replace(", HEADS", f", {_HEADS}")

# -- aggregations

define("a1_stats", lambda c: c.stats(), "SELECT * FROM (SELECT 'ontologies' AS metric, count(*) AS value FROM doc UNION ALL SELECT 'parse_errors', 0 UNION ALL SELECT 'entities', count(*) FROM ent UNION ALL SELECT 'classes', count(*) FROM ent WHERE kind = 'class' UNION ALL SELECT 'object_properties', count(*) FROM ent WHERE kind = 'object_property' UNION ALL SELECT 'data_properties', count(*) FROM ent WHERE kind = 'data_property' UNION ALL SELECT 'annotation_properties', count(*) FROM ent WHERE kind = 'annotation_property' UNION ALL SELECT 'individuals', count(*) FROM ent WHERE kind = 'individual' UNION ALL SELECT 'annotations', count(*) FROM ann UNION ALL SELECT 'axioms', count(*) FROM ax UNION ALL SELECT 'namespaces', count(*) FROM doc UNION ALL SELECT 'imports', count(*) FROM imp UNION ALL SELECT 'triples', count(*) FROM q UNION ALL SELECT 'distinct_triples', count(*) FROM (SELECT DISTINCT s, p, o, o_kind, dt FROM q))")
define("a2_merge", lambda c: _merged(c), f"SELECT iri, kind, labels, CAST(deprecated AS VARCHAR) AS deprecated, ontology_id FROM (SELECT iri, 'class' AS kind, CASE WHEN label = lower(label) THEN label ELSE label || '; ' || lower(label) END AS labels, deprecated OR iri LIKE '%1' AS deprecated, '{T}onto/extra' AS ontology_id FROM ent WHERE kind = 'class' AND label IS NOT NULL)")
define("a4_label_groups", lambda c: diagnostics.label_groups(c).groupBy("label").agg(F.count("*").alias("n")), "SELECT lower(trim(label)) AS label, count(DISTINCT iri) AS n FROM ent WHERE label IS NOT NULL GROUP BY 1 HAVING count(DISTINCT iri) >= 2")
define("a5_parents", lambda c: c.parents().select("child", F.array_join("parents", "; ").alias("parents")), f"{_HIER} SELECT child, string_agg(parent, '; ' ORDER BY parent) AS parents FROM h GROUP BY child")
define("a5_children", lambda c: c.children().select("parent", F.size("children").cast("bigint").alias("n")), f"{_HIER} SELECT parent, count(*) AS n FROM h GROUP BY parent")
define("a6_counts_by_kind", lambda c: c.counts_by_kind(), "SELECT kind, count(*) AS n FROM ent GROUP BY kind")
define("a9_namespace_map", lambda c: c.namespace_map(), f"SELECT 't' AS prefix, '{T}' AS iri")
define("a10_delete_impact", lambda c: usages.delete_impact(c, c.entities.where("kind = 'class'").select("iri")), """named AS (SELECT DISTINCT iri, id, subject FROM (SELECT row_number() OVER () AS id, subject, unnest(regexp_extract_all(object, 'https?://[^ ]+')) AS iri FROM ax)), cls AS (SELECT iri FROM ent WHERE kind = 'class'),
  u AS (SELECT subject AS iri, 'a' || CAST(row_number() OVER () AS VARCHAR) AS k, 's' AS role, NULL AS who FROM ax UNION ALL SELECT iri, 'b' || CAST(id AS VARCHAR), 'o', subject FROM named UNION ALL SELECT subject, NULL, 'n', NULL FROM ann UNION ALL SELECT object, NULL, 'n', NULL FROM ann)
  SELECT cls.iri, count(*) AS usages, count(DISTINCT k) AS axioms, count(DISTINCT who) AS referencers FROM u JOIN cls ON cls.iri = u.iri GROUP BY cls.iri""")
define("a12_components", lambda c: fixpoint.components(c.axioms.where("axiom_kind IN ('sub_class_of', 'disjoint_class', 'equivalent_class') AND object NOT LIKE '% %'").select(F.col("subject").alias("a"), F.col("object").alias("b"))).groupBy("component").agg(F.count("*").alias("n")), f"e AS MATERIALIZED (SELECT subject AS a, object AS b FROM ax WHERE axiom_kind IN ('sub_class_of', 'disjoint_class', 'equivalent_class') AND NOT contains(object, ' ')), b AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e), w(root, x) AS (SELECT t, t FROM (VALUES ('{T}Place'), ('{T}Product')) v(t) UNION SELECT root, b.b FROM w JOIN b ON b.a = w.x) SELECT min(x) AS component, count(*) AS n FROM w GROUP BY root")


def _merged(c: Catalog) -> DataFrame:
    e = c.entities.where("kind = 'class' AND size(labels) > 0").withColumn("doc_order", F.lit(0))
    other = e.withColumn("doc_order", F.lit(1)).withColumn("labels", F.transform("labels", F.lower)).withColumn("kind", F.lit("other")).withColumn("deprecated", F.endswith("iri", F.lit("1"))).withColumn("ontology_id", F.lit(T + "onto/extra"))
    m = merge_entities(e.unionByName(other))
    return m.select("iri", "kind", F.array_join("labels", "; ").alias("labels"), F.col("deprecated").cast("string").alias("deprecated"), "ontology_id")


# -- sorts and set operations

define("t2_sorted_entities", lambda c: c.view("classes").orderBy("short_name").limit(50).select("short_name"), "SELECT regexp_extract(iri, '[^/]*$') AS short_name FROM ent WHERE kind = 'class' ORDER BY 1 LIMIT 50")
define("u3_set_difference", lambda c: c.entities.select("iri").subtract(c.axioms.select(F.col("subject").alias("iri"))), "SELECT iri FROM ent EXCEPT SELECT subject FROM ax")
define("u4_set_intersection", lambda c: c.axioms.select("subject").intersect(c.axioms.select("object")), "SELECT subject FROM ax INTERSECT SELECT object FROM ax")

# -- scalar functions

_TEXTS = lambda spark, sf: spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
define("f1_short_name", lambda c: c.quads.select(F.col("p").alias("iri")).distinct().select("iri", X.short_name("iri").alias("name")), f"SELECT iri, {_SHORT.format('iri')} AS name FROM (SELECT DISTINCT p AS iri FROM q)")
define("f2_graph_short_name", lambda c: c.quads.select("p").distinct().select("p", X.graph_short_name("p").alias("name")), "SELECT p, regexp_extract(p, '[^#/]*$') AS name FROM (SELECT DISTINCT p FROM q)")
define("f3_namespace_of", lambda c: c.entities.select(X.namespace_of("iri").alias("ns")).groupBy("ns").agg(F.count("*").alias("n")), "SELECT regexp_extract(iri, '^(.*[/#])', 1) AS ns, count(*) AS n FROM ent GROUP BY 1")
define("f4_split_iri", lambda c: c.entities.select("iri", X.split_iri("iri").alias("x")).select("iri", "x.namespace", "x.local"), "SELECT iri, regexp_extract(iri, '^(.*[/#])', 1) AS namespace, regexp_extract(iri, '[^/#]*$') AS local FROM ent")
define("f5_normalize_iri", lambda c: c.imports.select(X.normalize_iri(F.concat("import_iri", F.lit("/##"))).alias("iri")), "SELECT rtrim(rtrim(import_iri || '/##', '#'), '/') AS iri FROM imp")
define("f6_normalize_label", lambda c: c.entities.where("size(labels) > 0").select("iri", X.normalize_label(F.concat(F.lit('" '), F.get("labels", F.lit(0)), F.lit('"'))).alias("label")), "SELECT iri, lower(trim(trim('\" ' || label || '\"', '\"'))) AS label FROM ent WHERE label IS NOT NULL")
define("f7_boolean_literal", lambda c: c.entities.select("iri", X.parse_boolean_literal(F.concat(F.lit('"'), F.col("deprecated").cast("string"), F.lit('"^^xsd:boolean'))).alias("b")), "SELECT iri, deprecated AS b FROM ent")
define("f9_render_iri", lambda c: c.quads.select("p").distinct().select("p", X.render_entity_iri("p").alias("shown")), "SELECT p, CASE WHEN starts_with(p, 'http://www.w3.org/1999') THEN 'rdf:' || substr(p, 44) WHEN starts_with(p, 'http://www.w3.org/2000') THEN 'rdfs:' || substr(p, 38) ELSE regexp_extract(p, '[^/#]*$') END AS shown FROM (SELECT DISTINCT p FROM q)")
define("f10_expand", lambda c: c.entities.select("iri", X.expand_prefixed(F.concat(F.lit("t:"), F.substring("iri", F.lit(len(T) + 1), F.length("iri"))), F.create_map(F.lit("t"), F.lit(T))).alias("back")), "SELECT iri, iri AS back FROM ent")
define("f11_manchester_escape", lambda spark, sf: spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", X.manchester_unescape(X.manchester_escape("p_name")).alias("same"), X.manchester_escape("p_name").alias("quoted")), "SELECT p_partkey, p_name AS same, CASE WHEN regexp_matches(p_name, '[\\s(){}\\[\\],<>=\"'']') THEN '''' || p_name || '''' ELSE p_name END AS quoted FROM part", tables=True)
define("f12_obo_id", lambda spark, sf: spark.read.parquet(f"{sf}/part.parquet").select(X.obo_id_to_iri(F.concat(F.lit("GO:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0"))).alias("iri")), "SELECT 'http://purl.obolibrary.org/obo/GO_' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS iri FROM part", tables=True)
define("f14_file_uri", lambda spark, sf: spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", X.file_uri(F.concat(F.lit("/a b/"), F.replace("p_name", F.lit(" "), F.lit("/")))).alias("uri")), "SELECT p_partkey, 'file:///a%20b/' || replace(p_name, ' ', '/') AS uri FROM part", tables=True)
define("f15_content_hash", lambda spark, sf: _TEXTS(spark, sf).select("doc_id", X.content_hash("text").alias("sha")), "SELECT doc_id, sha256(text) AS sha FROM documents", tables=True)
define("f16_restriction_header", lambda c: c.axioms.where("object LIKE '% %' AND axiom_kind = 'sub_class_of'").select(X.restriction_header("object").alias("h")).select("h.kind").groupBy("kind").agg(F.count("*").alias("n")), "SELECT split_part(object, ' ', 2) AS kind, count(*) AS n FROM ax WHERE axiom_kind = 'sub_class_of' AND contains(object, ' ') GROUP BY 1")
define("f17_members", lambda spark, sf: spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", F.explode(X.members(F.concat("n_name", F.lit(" o  "), F.col("n_regionkey").cast("string"), F.lit(" o c")), "o")).alias("m")), "SELECT n_nationkey, unnest([n_name, CAST(n_regionkey AS VARCHAR), 'c']) AS m FROM nation", tables=True)
define("f18_axiom_display", lambda c: c.axioms.select(X.axiom_label("axiom_kind").alias("label"), X.axiom_display("axiom_kind", "predicate", "object").alias("display")).where("label = 'Domain' OR label = 'Range'"), "SELECT CASE axiom_kind WHEN 'domain' THEN 'Domain' ELSE 'Range' END AS label, CASE axiom_kind WHEN 'domain' THEN 'Domain ' ELSE 'Range ' END || regexp_extract(object, '[^/]*$') AS display FROM ax WHERE axiom_kind IN ('domain', 'range')")
define("f19_links", lambda spark, sf: _linked(spark, sf), "SELECT p_partkey, kind, url FROM (SELECT p_partkey, 'PubMedId' AS kind, 'http://www.ncbi.nlm.nih.gov/pubmed/' || CAST(p_partkey AS VARCHAR) AS url FROM part UNION ALL SELECT p_partkey, 'DOI', 'https://doi.org/10.1000/' || CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'OMIMPS', 'https://www.omim.org/phenotypicSeries/' || CAST(p_size AS VARCHAR) FROM part UNION ALL SELECT p_partkey, 'Wikipedia', 'https://wikipedia.org/wiki/' || replace(p_name, ' ', '_') FROM part)", tables=True)
define("f20_abbreviate", lambda spark, sf: _TEXTS(spark, sf).select("doc_id", X.abbreviate("text", 40).alias("t")), "SELECT doc_id, CASE WHEN length(text) <= 40 THEN text ELSE substr(text, 1, 37) || '...' END AS t FROM documents", tables=True)
define("f20_iso_utc", lambda spark, sf: spark.read.parquet(f"{sf}/events.parquet").select("event_id", X.iso_utc(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("t")), "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS t FROM events", tables=True)
define("f22_strip_turtle", lambda spark, sf: spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", X.strip_turtle(F.concat(F.lit("<u#x> a \"#"), "p_name", F.lit("\" . # "), "p_brand")).alias("t")), "SELECT p_partkey, '<u#x> a  . ' AS t FROM part", tables=True)
_STOP = "[^A-Za-z0-9_.~:#/%?=&-]"
_THE = f"(^|{_STOP})the($|{_STOP})"
define("f23_first_location", lambda spark, sf: _TEXTS(spark, sf).select("doc_id", X.first_location("text", F.lit("the")).alias("l")).select("doc_id", "l.line", "l.column"), f"SELECT doc_id, line, \"column\" FROM (SELECT doc_id, NULL AS line, NULL AS \"column\" FROM documents WHERE NOT regexp_matches(text, '{_THE}') UNION ALL SELECT doc_id, min(line), arg_min(CASE WHEN regexp_matches(l, '^the($|{_STOP})') THEN 0 ELSE length(regexp_extract(l, '^(.*?{_STOP})the($|{_STOP})', 1)) END, line) FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) WHERE regexp_matches(l, '{_THE}') GROUP BY doc_id)", tables=True)
define("f24_bounded", lambda spark, sf: _TEXTS(spark, sf).select("doc_id", X.bounded("text", F.lit("the")).alias("hit")), "SELECT doc_id, regexp_matches(text, '(^|[^A-Za-z0-9_.~:#/%?=&-])the($|[^A-Za-z0-9_.~:#/%?=&-])') AS hit FROM documents", tables=True)
define("f25_remap", lambda c: c.entities.select(X.remap_iri("iri", T + "part/", "http://new/p/").alias("iri")), f"SELECT CASE WHEN starts_with(iri, '{T}part/') THEN 'http://new/p/' || substr(iri, {len(T) + 6}) ELSE iri END AS iri FROM ent")
define("f26_scoped_blank", lambda c: c.documents.select(X.scoped_blank("id", F.lit("b0")).alias("b")), "SELECT 'doc-' || CAST(doc_order AS VARCHAR) || '_b0' AS b FROM doc")
define("f27_synonym_scope", lambda spark, sf: spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", X.synonym_property(F.when(F.col("c_mktsegment") == "BUILDING", "EXACT").otherwise(F.col("c_mktsegment"))).alias("p")), "SELECT c_custkey, 'http://www.geneontology.org/formats/oboInOwl#has' || CASE WHEN c_mktsegment = 'BUILDING' THEN 'Exact' ELSE 'Related' END || 'Synonym' AS p FROM customer", tables=True)


def _linked(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("see PMID: "), F.col("p_partkey").cast("string"), F.lit(" and doi:10.1000/"), F.col("p_size").cast("string"), F.lit(" then OMIMPS:"), F.col("p_size").cast("string"), F.lit(" Wikipedia:"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.explode(X.links(text)).alias("l")).select("p_partkey", "l.kind", "l.url")


# -- graphs

define("g1_hierarchy", lambda c: c.hierarchy().groupBy("parent").agg(F.count("*").alias("n")), f"{_HIER} SELECT parent, count(*) AS n FROM h GROUP BY parent")
define("g2_class_graph_edges", lambda c: graph.build(c, graph.Request("class", filters=graph.Filters(hide_deprecated=True))).edges.select("source", "target"), f"live AS MATERIALIZED (SELECT iri FROM ent WHERE kind = 'class' AND NOT deprecated) SELECT DISTINCT subject AS source, object AS target FROM ax JOIN live a ON a.iri = subject JOIN live b ON b.iri = object WHERE axiom_kind = 'sub_class_of'")
define("g3_property_graph", lambda c: graph.build(c, graph.Request("property")).edges.select("source", "target", "kind"), "SELECT subject AS source, object AS target, axiom_kind AS kind FROM ax WHERE axiom_kind IN ('domain', 'range')")
define("g3_object_properties", lambda c: graph.build(c, graph.Request("object_property")).nodes.select("id", "label", "kind"), "SELECT iri AS id, label, kind FROM ent WHERE kind = 'object_property' UNION SELECT object, regexp_extract(object, '[^/]*$'), CASE WHEN object LIKE '%Order' THEN 'other' ELSE 'class' END FROM ax WHERE axiom_kind IN ('domain', 'range')")
_CLOSURE = f"{_HIER}, up(a, b) AS (SELECT child, parent FROM h UNION SELECT up.a, h.parent FROM up JOIN h ON up.b = h.child)"
define("g4_closure", lambda c: fixpoint.closure(c.hierarchy().select(F.col("child").alias("a"), F.col("parent").alias("b"))), f"{_CLOSURE} SELECT a, b FROM up")
define("g4_ancestors_of", lambda c: fixpoint.closure(c.hierarchy().select(F.col("child").alias("a"), F.col("parent").alias("b")), c.entities.where("deprecated").select(F.col("iri").alias("a"))), f"{_CLOSURE} SELECT a, b FROM up WHERE a IN (SELECT iri FROM ent WHERE deprecated)")
define("g5_strict_subclasses", lambda c: fixpoint.closure(c.hierarchy().select(F.col("parent").alias("a"), F.col("child").alias("b")), c.spark.createDataFrame([(T + "Place",)], "a string")).select(F.col("b").alias("iri")), f"{_CLOSURE} SELECT a AS iri FROM up WHERE b = '{T}Place'")
define("g6_import_graph", lambda c: graph.build(c, graph.Request("import", roots=[T + "onto/orders"])).edges.select("source", "target"), f"SELECT ontology_id AS source, import_iri AS target FROM imp WHERE ontology_id = '{T}onto/orders'")
define("g6_dependency_graph", lambda c: graph.build(c, graph.Request("dependency", roots=[T + "onto/orders"])).edges.select("source", "target"), "SELECT ontology_id AS source, import_iri AS target FROM imp")
define("g7_individual_graph", lambda c: graph.build(c, graph.Request("individual", roots=[T + "order/1"], depth=2)).edges.select("source", "target", "kind"), f"adj AS (SELECT subject AS s, object AS t, CASE WHEN axiom_kind = 'class_assertion' THEN 'type' ELSE 'assertion' END AS k FROM ax WHERE axiom_kind IN ('class_assertion', 'object_property_assertion') UNION ALL SELECT object, subject, CASE WHEN axiom_kind = 'class_assertion' THEN 'instance' ELSE 'assertion' END FROM ax WHERE axiom_kind IN ('class_assertion', 'object_property_assertion')), l1 AS (SELECT '{T}order/1' AS n UNION SELECT t FROM adj WHERE s = '{T}order/1') SELECT s AS source, t AS target, k AS kind FROM adj WHERE s IN (SELECT n FROM l1)")
define("g8_neighborhood", lambda c: graph.build(c, graph.Request("neighborhood", roots=[T + "nation/5"], depth=1)).edges.select("source", "target", "kind"), f"{_HIER} SELECT child AS source, parent AS target, 'sub_class_of' AS kind FROM h WHERE child = '{T}nation/5' UNION ALL SELECT parent, child, 'super_class_of' FROM h WHERE parent = '{T}nation/5' UNION ALL SELECT subject, object, 'equivalent_class' FROM ax WHERE axiom_kind = 'equivalent_class' AND subject = '{T}nation/5' UNION ALL SELECT subject, regexp_extract(object, '[^ ]*$'), 'some_values_from' FROM ax WHERE axiom_kind = 'sub_class_of' AND contains(object, ' ') AND subject = '{T}nation/5'")
define("g9_query_result", lambda c: graph.build(c, graph.Request("query_result", roots=[T + "region/0", T + "region/1", T + "nowhere"], depth=1)).edges.where("kind = 'query_result'").select("source", "target"), f"SELECT '{T}region/0' AS source, '{T}region/1' AS target UNION ALL SELECT '{T}region/1', '{T}nowhere'")
define("g10_bounded_bfs", lambda c: fixpoint.bfs(c.hierarchy().select(F.col("parent").alias("source"), F.col("child").alias("target")), c.spark.createDataFrame([(T + "Product",)], "node string"), 2).groupBy("depth").agg(F.count("*").alias("n")), f"{_HIER}, w(node, depth) AS (SELECT '{T}Product', 0 UNION SELECT h.child, depth + 1 FROM w JOIN h ON h.parent = w.node WHERE depth < 2) SELECT depth, count(*) AS n FROM (SELECT node, min(depth) AS depth FROM w GROUP BY node) GROUP BY depth")
define("g11_nodes", lambda c: graph.nodes_of(c.axioms.select(F.col("object").alias("iri")).where("iri NOT LIKE '% %' AND iri LIKE 'http%'").distinct(), c).groupBy("kind").agg(F.count("*").alias("n")), "SELECT coalesce(kind, 'other') AS kind, count(*) AS n FROM (SELECT DISTINCT object FROM ax WHERE object NOT LIKE '% %' AND object LIKE 'http%') LEFT JOIN ent ON iri = object GROUP BY 1")
define("g12_import_closure", lambda c: usages.import_closure(c, T + "onto/orders")[0], f"r(ontology_iri) AS (SELECT '{T}onto/orders' UNION SELECT import_iri FROM imp JOIN r ON ontology_id = ontology_iri) SELECT ontology_iri FROM r")
define("g12_import_warnings", lambda c: usages.import_closure(c, T + "onto/orders")[1], f"SELECT '{T}onto/missing' AS import_iri, 'unresolved' AS reason")
_SIG = "sig AS MATERIALIZED (SELECT id, x FROM (SELECT id, unnest(list_distinct([subject, predicate] || string_split(object, ' '))) AS x FROM (SELECT *, row_number() OVER () AS id FROM ax)) WHERE x IN (SELECT iri FROM ent))"
define("g13_module", lambda c: usages.module(c, c.spark.createDataFrame([(T + "region/1",)], "iri string")), f"{_SIG}, w(iri) AS (SELECT '{T}region/1' UNION SELECT b.x FROM w JOIN sig a ON a.x = w.iri JOIN sig b ON b.id = a.id) SELECT iri FROM w")
define("g14_text_tree", lambda c: graph.text_tree(c).select("path", "level"), f"{_HIER}, w(iri, path, level) AS (SELECT iri, regexp_extract(iri, '[^/]*$'), 0 FROM ent WHERE kind = 'class' AND iri NOT IN (SELECT child FROM h) UNION ALL SELECT h.child, path || '/' || regexp_extract(h.child, '[^/]*$'), level + 1 FROM w JOIN h ON h.parent = w.iri) SELECT path, level FROM w")
define("p17_entity_filter", lambda c: graph.keep_allowed(c.axioms.select(F.col("subject").alias("iri")).distinct(), "iri", c, graph.Filters(ontology_iri=T + "onto/parts", hide_deprecated=True, entity_kinds=["class"], search_text=" BRAND ")), f"SELECT DISTINCT subject AS iri FROM ax JOIN ent ON iri = subject WHERE ent.ontology_id = '{T}onto/parts' AND NOT deprecated AND kind = 'class' AND (contains(lower(iri), 'brand') OR contains(lower(coalesce(label, '')), 'brand'))")
define("p18_relationship_filter", lambda c: graph.build(c, graph.Request("property", filters=graph.Filters(relationship_kinds=["range"]))).edges.select("source", "target"), "SELECT subject AS source, object AS target FROM ax WHERE axiom_kind = 'range'")
define("p20_complex_expression", lambda c: c.axioms.where(X.is_complex_expression("object")).groupBy("axiom_kind").agg(F.count("*").alias("n")), "SELECT axiom_kind, count(*) AS n FROM ax WHERE contains(object, ' some ') OR contains(object, ' max ') GROUP BY 1")
define("t3_graph_caps", lambda c: c.spark.createDataFrame([tuple(_caps(c))], "nodes bigint, edges bigint, truncated boolean"), "SELECT CAST(50 AS BIGINT) AS nodes, CAST(60 AS BIGINT) AS edges, true AS truncated")


def _caps(c: Catalog):
    n, e, more = graph.build(c, graph.Request("class")).capped(50, 60)
    return n.count(), e.count(), more


# -- diagnostics

_DIAG = "code, severity, message, file, entity_iri"
_D = lambda df: df.select("code", "severity", "message", "file", F.coalesce("entity_iri", F.lit("")).alias("entity_iri"))
define("d2_j3_broken_imports", lambda c: _D(diagnostics.broken_imports(c)), f"SELECT 'broken_import' AS code, 'error' AS severity, 'import not found in workspace: ' || import_iri AS message, {_OWNER} AS file, '' AS entity_iri FROM imp WHERE import_iri NOT IN (SELECT base_iri FROM doc)")
define("d4_duplicate_labels", lambda c: _D(diagnostics.duplicate_labels(c)), f"SELECT 'duplicate_label' AS code, 'warning' AS severity, 'duplicate label \"' || l || '\" (also used by other entities)' AS message, {_OWNER} AS file, iri AS entity_iri FROM (SELECT *, lower(trim(label)) AS l, count(*) OVER (PARTITION BY lower(trim(label))) AS n FROM ent WHERE label IS NOT NULL) WHERE n >= 2")
define("d5_missing_labels", lambda c: _D(diagnostics.missing_labels(c)), f"SELECT 'missing_label' AS code, 'warning' AS severity, kind || ' has no rdfs:label' AS message, {_OWNER} AS file, iri AS entity_iri FROM ent WHERE kind = 'class' AND label IS NULL")
_ORPHAN = f"SELECT 'orphan_class' AS code, 'warning' AS severity, 'class has no parent in workspace catalog' AS message, {_OWNER} AS file, ent.iri AS entity_iri FROM ent WHERE kind = 'class' AND iri NOT IN (SELECT object FROM ax WHERE axiom_kind = 'sub_class_of') AND iri NOT IN (SELECT subject FROM ax WHERE axiom_kind = 'sub_class_of' AND (contains(object, ' ') OR object IN (SELECT iri FROM ent)))"
define("d6_j4_orphans", lambda c: _D(diagnostics.orphan_classes(c)), _ORPHAN)
define("a8_severities", lambda c: diagnostics.by_severity(diagnostics.collect(c)), "SELECT severity, count(*) AS n FROM (" + " UNION ALL ".join(x.removeprefix(MAPPING + " ") for x in (ORACLE_SQL["d2_j3_broken_imports"], ORACLE_SQL["d4_duplicate_labels"], ORACLE_SQL["d5_missing_labels"], MAPPING + " " + _ORPHAN)) + ") GROUP BY severity")
define("d8_config", lambda c: diagnostics.collect(c, {"missing_label": "off", "broken_import": "info", "duplicate_label": "off"}).groupBy("code", "severity").agg(F.count("*").alias("n")), "SELECT 'broken_import' AS code, 'info' AS severity, count(*) AS n FROM imp WHERE import_iri NOT IN (SELECT base_iri FROM doc) UNION ALL SELECT 'orphan_class', 'warning', count(*) FROM ent WHERE iri LIKE '%/Party' AND kind = 'class'")
define("d9_naming", lambda c: diagnostics.naming(c, T + "p").groupBy("severity").agg(F.count("*").alias("n")), f"SELECT 'warning' AS severity, count(*) FILTER (WHERE label IS NULL) + count(*) FILTER (WHERE NOT starts_with(iri, '{T}p')) AS n FROM ent WHERE kind IN ('class', 'object_property', 'data_property', 'individual')")

# -- semantic diff


def _with_heads(name: str, query, sql: str) -> None:
    define(name, query, f"{_HEADS} {sql}")


_with_heads("v1_added_removed", lambda c: diff.diff_catalogs(c, _head(c)).entities.where("change IN ('added', 'removed')").select("change", "iri"), f"SELECT 'removed' AS change, iri FROM ent WHERE {_GONE.format('iri')} AND TRY_CAST(regexp_extract(iri, '[0-9]+$') AS BIGINT) % 14 <> 0")
_with_heads("v2_deprecated", lambda c: diff.diff_catalogs(c, _head(c)).entities.where("change = 'deprecated'").select("iri"), "SELECT b.iri FROM ent a JOIN hent b USING (iri) WHERE b.deprecated AND NOT a.deprecated")
_with_heads("v3_j7_renamed", lambda c: diff.diff_catalogs(c, _head(c)).entities.where("change = 'renamed'").select("iri", "new_iri"), f"SELECT iri, iri || '-new' AS new_iri FROM ent WHERE {_GONE.format('iri')} AND TRY_CAST(regexp_extract(iri, '[0-9]+$') AS BIGINT) % 14 = 0")
_with_heads("v5_axiom_changes", lambda c: diff.diff_catalogs(c, _head(c)).axioms.select("change", "axiom_kind", "subject", "object"), f"SELECT 'removed' AS change, axiom_kind, subject, object FROM ax WHERE {_GONE.format('subject')} OR {_GONE.format('object')}")
_with_heads("v6_import_changes", lambda c: diff.diff_catalogs(c, _head(c)).imports.select("change", "import_iri"), "SELECT 'removed' AS change, import_iri FROM imp WHERE import_iri LIKE '%missing'")
_with_heads("v7_breaking", lambda c: diff.diff_catalogs(c, _head(c)).breaking.groupBy("code").agg(F.count("*").alias("n")), f"SELECT 'removed_superclass' AS code, count(DISTINCT subject || object) AS n FROM ax WHERE axiom_kind = 'sub_class_of' AND {_GONE.format('subject')} UNION ALL SELECT 'removed_import', 1 UNION ALL SELECT CASE WHEN TRY_CAST(regexp_extract(iri, '[0-9]+$') AS BIGINT) % 14 = 0 THEN 'renamed_iri' ELSE 'removed_entity' END, count(*) FROM ent WHERE {_GONE.format('iri')} GROUP BY 1")
_with_heads("v8_unsatisfiable_diff", lambda c: diff.with_unsatisfiable(diff.diff_catalogs(c, c), c.view("classes").where("iri LIKE '%1'"), c.view("classes").where("iri LIKE '%2' OR iri LIKE '%11'")).unsatisfiable.select("change", "iri"), "SELECT 'became_unsatisfiable' AS change, iri FROM ent WHERE kind = 'class' AND iri LIKE '%2' UNION ALL SELECT 'became_satisfiable', iri FROM ent WHERE kind = 'class' AND iri LIKE '%1' AND iri NOT LIKE '%11'")
_with_heads("a7_diff_summary", lambda c: diff.diff_catalogs(c, _head(c)).summary().where("part IN ('axiom', 'import')"), f"SELECT 'axiom' AS part, 'removed' AS change, count(*) AS n FROM ax WHERE {_GONE.format('subject')} OR {_GONE.format('object')} UNION ALL SELECT 'import', 'removed', 1")
_with_heads("v10_round_trip", lambda c: diff.round_trip(c, _head(c)).where("aspect = 'import'").select("key", "change"), "SELECT import_iri AS key, 'removed' AS change FROM imp WHERE import_iri LIKE '%missing'")

# -- usages and modules

define("e1_find_usages", lambda c: usages.find_usages(c, T + "nation/5").groupBy("usage").agg(F.count("*").alias("n")), f"SELECT 'entity' AS usage, 1 AS n UNION ALL SELECT 'axiom_subject', count(*) FROM ax WHERE subject = '{T}nation/5' UNION ALL SELECT 'axiom_object', count(*) FROM ax WHERE list_contains(string_split(object, ' '), '{T}nation/5')")
define("j13_references", lambda c: usages.references(c).groupBy("usage").agg(F.count("*").alias("n")), "SELECT 'entity' AS usage, count(*) AS n FROM ent UNION ALL SELECT 'axiom_subject', count(*) FROM ax UNION ALL SELECT 'axiom_predicate', count(*) FROM ax WHERE predicate <> '' UNION ALL SELECT 'axiom_object', count(*) FROM ax WHERE contains(object, 'http://') UNION ALL SELECT 'annotation_subject', count(*) FROM ann UNION ALL SELECT 'annotation_predicate', count(*) FROM ann UNION ALL SELECT 'import', count(*) FROM imp")
define("e1b_migration_set", lambda c: usages.migration_set(c, T + "part/"), f"SELECT DISTINCT iri FROM (SELECT iri FROM ent UNION ALL SELECT subject FROM ax UNION ALL SELECT object FROM ax) WHERE starts_with(iri, '{T}part/') AND NOT contains(iri, ' ')")
define("e3_unused_imports", lambda c: usages.unused_imports(c), "own AS (SELECT iri, ontology_id AS o FROM ent), ref AS (SELECT ontology_id, subject AS iri FROM ax UNION SELECT ontology_id, predicate FROM ax UNION SELECT ontology_id, unnest(string_split(object, ' ')) FROM ax UNION SELECT ontology_id, subject FROM ann UNION SELECT ontology_id, predicate FROM ann), used AS (SELECT DISTINCT ontology_id, o FROM ref JOIN own USING (iri)) SELECT imp.ontology_id, import_iri, CASE WHEN import_iri IN (SELECT base_iri FROM doc) THEN 'unused' ELSE 'unresolved' END AS reason FROM imp WHERE (imp.ontology_id, import_iri) NOT IN (SELECT ontology_id, o FROM used)")
define("u5_module_axioms", lambda c: usages.module_axioms(c, c.entities.where("ontology_id LIKE '%core' OR iri LIKE '%type%'").select("iri")).groupBy("axiom_kind").agg(F.count("*").alias("n")), "b AS (SELECT iri FROM ent WHERE ontology_id LIKE '%core' OR iri LIKE '%type%'), sig AS (SELECT id, axiom_kind, x FROM (SELECT row_number() OVER () AS id, axiom_kind, unnest(list_distinct([subject, predicate] || string_split(object, ' '))) AS x FROM ax) WHERE x IN (SELECT iri FROM ent)) SELECT axiom_kind, count(*) AS n FROM (SELECT id, axiom_kind FROM sig GROUP BY ALL HAVING count(*) = count(*) FILTER (WHERE x IN (SELECT iri FROM b))) GROUP BY 1")


# -- SPARQL

_P = f"PREFIX t: <{T}> PREFIX rdfs: <http://www.w3.org/2000/01/rdf-schema#> PREFIX owl: <http://www.w3.org/2002/07/owl#> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#> "
_RDFS, _RDF = "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


def _sparql(name: str, text: str, sql: str) -> None:
    define(name, lambda c: run_sparql(c, _P + text).frame, sql)


_I = "'<' || {} || '>'".format
_L = "'\"' || {} || '\"'".format
_NUM = lambda v, t: f"'\"' || CAST({v} AS VARCHAR) || '\"^^<http://www.w3.org/2001/XMLSchema#{t}>'"
_PART = f"q.p = '{T}contains'"
_sparql("q1_triple_pattern", "SELECT ?s ?o WHERE { ?s t:suppliedBy ?o }", f"SELECT {_I('s')} AS s, {_I('o')} AS o FROM q WHERE p = '{T}suppliedBy'")
# Written worst first; the order comes from characteristic sets.
_STAR = "SELECT ?o ?l ?n WHERE { ?o t:contains ?p . ?p rdfs:label ?l . ?o a owl:NamedIndividual . ?o t:totalprice ?v . ?o t:placedBy ?c . ?c a ?n . ?n rdfs:subClassOf <REGION> }".replace("REGION", T + "region/0")
define("q2_statistics_order", lambda c: run_sparql(c, _P + _STAR, stats.gather(c.quads)).frame, f"SELECT {_I('a.s')} AS o, {_L('l.o')} AS l, {_I('b.o')} AS n FROM q a JOIN q b ON b.s = a.o AND b.p = '{_RDF}type' JOIN q d ON d.s = b.o AND d.p = '{_RDFS}subClassOf' AND d.o = '{T}region/0' JOIN q v ON v.s = a.s AND v.p = '{T}totalprice' JOIN q k ON k.s = a.s AND k.p = '{T}contains' JOIN q l ON l.s = k.o AND l.p = '{_RDFS}label' JOIN q t ON t.s = a.s AND t.p = '{_RDF}type' AND t.o LIKE '%owl#NamedIndividual' WHERE a.p = '{T}placedBy'")
_sparql("q2_bgp_join", "SELECT ?o ?c ?n WHERE { ?o t:placedBy ?c . ?c a ?n . ?n rdfs:subClassOf t:region/0 }".replace("t:region/0", f"<{T}region/0>"), f"SELECT {_I('a.s')} AS o, {_I('a.o')} AS c, {_I('b.o')} AS n FROM q a JOIN q b ON b.s = a.o AND b.p = '{_RDF}type' JOIN q d ON d.s = b.o AND d.p = '{_RDFS}subClassOf' AND d.o = '{T}region/0' WHERE a.p = '{T}placedBy'")
_sparql("q3_optional", "SELECT ?s ?l WHERE { ?s a owl:Class OPTIONAL { ?s rdfs:label ?l FILTER(STRSTARTS(?l, 'NATION')) } }", f"SELECT {_I('a.s')} AS s, coalesce({_L('b.o')}, '') AS l FROM q a LEFT JOIN q b ON b.s = a.s AND b.p = '{_RDFS}label' AND starts_with(b.o, 'NATION') WHERE a.p = '{_RDF}type' AND a.o LIKE '%owl#Class'")
_sparql("q4_union", "SELECT ?x WHERE { { ?x t:size '7' } UNION { ?x t:segment 'BUILDING' } }", f"SELECT {_I('s')} AS x FROM q WHERE p = '{T}size' AND o = '7' UNION ALL SELECT {_I('s')} FROM q WHERE p = '{T}segment' AND o = 'BUILDING'")
_sparql("q5_minus", "SELECT ?x WHERE { ?x a owl:Class MINUS { ?x rdfs:label ?l } }", f"SELECT {_I('s')} AS x FROM q WHERE p = '{_RDF}type' AND o LIKE '%owl#Class' AND s NOT IN (SELECT s FROM q WHERE p = '{_RDFS}label')")
_sparql("q6_not_exists", "SELECT ?c WHERE { ?c a owl:Class ; rdfs:label ?l FILTER NOT EXISTS { ?o t:contains ?c . ?o t:totalprice ?v FILTER(?v > 200000) } }", f"SELECT {_I('a.s')} AS c FROM q a JOIN q l ON l.s = a.s AND l.p = '{_RDFS}label' WHERE a.p = '{_RDF}type' AND a.o LIKE '%owl#Class' AND a.s NOT IN (SELECT '{T}part/' || CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 200000))")
_sparql("q6_filter", "SELECT ?o ?v WHERE { ?o t:totalprice ?v FILTER(?v > 100000 && ?v <= 150000.5) }", f"SELECT {_I('s')} AS o, {_NUM('o', 'decimal')} AS v FROM q WHERE p = '{T}totalprice' AND CAST(o AS DOUBLE) > 100000 AND CAST(o AS DOUBLE) <= 150000.5")
_sparql("q7_bind_values", "SELECT ?s ?n WHERE { VALUES ?k { '1' '2' } ?s t:size ?k BIND(CONCAT('size ', ?k) AS ?n) }", f"SELECT {_I('s')} AS s, '\"size ' || o || '\"' AS n FROM q WHERE p = '{T}size' AND o IN ('1', '2')")
_sparql("q8_distinct", "SELECT DISTINCT ?g WHERE { ?c t:segment ?g }", f"SELECT DISTINCT {_L('o')} AS g FROM q WHERE p = '{T}segment'")
_sparql("q9_group_count", "SELECT ?c (COUNT(?o) AS ?n) WHERE { ?o t:placedBy ?c } GROUP BY ?c HAVING (COUNT(?o) > 12)", f"SELECT {_I('o')} AS c, {_NUM('count(*)', 'integer')} AS n FROM q WHERE p = '{T}placedBy' GROUP BY o HAVING count(*) > 12")
_sparql("q9_count_distinct", "SELECT (COUNT(DISTINCT ?g) AS ?n) (MIN(?g) AS ?lo) (MAX(?g) AS ?hi) WHERE { ?c t:segment ?g }", f"SELECT {_NUM('count(DISTINCT o)', 'integer')} AS n, {_L('min(o)')} AS lo, {_L('max(o)')} AS hi FROM q WHERE p = '{T}segment'")
_sparql("q10_order_limit", "SELECT ?l WHERE { ?s rdfs:label ?l . ?s rdfs:subClassOf t:Place } ORDER BY DESC(?l) OFFSET 1 LIMIT 3", f"SELECT {_L('b.o')} AS l FROM q a JOIN q b ON a.s = b.s AND b.p = '{_RDFS}label' WHERE a.p = '{_RDFS}subClassOf' AND a.o = '{T}Place' ORDER BY b.o DESC LIMIT 3 OFFSET 1")
_sparql("q11_subselect", "SELECT ?c ?l WHERE { { SELECT ?c WHERE { ?o t:placedBy ?c } GROUP BY ?c HAVING (COUNT(*) > 14) } ?c rdfs:label ?l }", f"SELECT {_I('s')} AS c, {_L('o')} AS l FROM q WHERE p = '{_RDFS}label' AND s IN (SELECT o FROM q WHERE p = '{T}placedBy' GROUP BY o HAVING count(*) > 14)")
_sparql("q12_path_plus", "SELECT ?x WHERE { ?x rdfs:subClassOf+ t:Place }", f"w(x) AS (SELECT s FROM q WHERE p = '{_RDFS}subClassOf' AND o = '{T}Place' UNION SELECT s FROM q JOIN w ON o = x WHERE p = '{_RDFS}subClassOf') SELECT {_I('x')} AS x FROM w")
_sparql("q12_path_sequence", "SELECT DISTINCT ?s ?r WHERE { ?s t:suppliedBy/a/rdfs:subClassOf ?r }", f"SELECT DISTINCT {_I('a.s')} AS s, {_I('c.o')} AS r FROM q a JOIN q b ON a.o = b.s AND b.p = '{_RDF}type' JOIN q c ON c.s = b.o AND c.p = '{_RDFS}subClassOf' WHERE a.p = '{T}suppliedBy'")
define("q13_graph", lambda c: run_sparql(_in_graphs(c), _P + "SELECT ?g ?s ?o WHERE { GRAPH ?g { ?s rdfs:subClassOf ?o } FILTER(?g != t:onto/parts) }".replace("t:onto/parts", f"<{T}onto/parts>")).frame, f"SELECT {_I('doc_id')} AS g, {_I('s')} AS s, {_I('o')} AS o FROM q WHERE p = '{_RDFS}subClassOf' AND doc_id <> '{T}onto/parts'")
define("q13_from", lambda c: run_sparql(_in_graphs(c), _P + f"SELECT ?s FROM <{T}onto/parties> WHERE {{ ?s a ?k }}").frame, f"SELECT {_I('s')} AS s FROM q WHERE p = '{_RDF}type' AND doc_id = '{T}onto/parties'")
_sparql("q14_ask", "ASK { ?s rdfs:subClassOf t:Product }", "SELECT 'true' AS \"boolean\"")
_sparql("q18_rendering", "SELECT ?p ?v WHERE { VALUES ?p { t:totalprice t:priority t:placedBy } ?s ?p ?v }", f"SELECT {_I('p')} AS p, CASE WHEN o_kind = 'iri' THEN {_I('o')} WHEN dt LIKE '%decimal' THEN {_NUM('o', 'decimal')} ELSE {_L('o')} END AS v FROM q WHERE p IN ('{T}totalprice', '{T}priority', '{T}placedBy')")
_sparql("fs_functions", "SELECT ?s (STRLEN(?l) AS ?n) (UCASE(SUBSTR(?l, 1, 3)) AS ?u) (STRAFTER(STR(?s), 'region/') AS ?k) (MD5(?l) AS ?h) WHERE { ?s rdfs:subClassOf t:Place ; rdfs:label ?l }", f"SELECT {_I('a.s')} AS s, {_NUM('length(b.o)', 'integer')} AS n, {_L('upper(substr(b.o, 1, 3))')} AS u, {_L('regexp_extract(a.s, $$[^/]*$$$)').replace('$$[^/]*$$$', chr(39) + '[^/]*$' + chr(39))} AS k, {_L('md5(b.o)')} AS h FROM q a JOIN q b ON a.s = b.s AND b.p = '{_RDFS}label' WHERE a.p = '{_RDFS}subClassOf' AND a.o = '{T}Place'")


def _in_graphs(c: Catalog) -> Catalog:
    """The same quads, each in the graph of its ontology."""
    return c.with_(quads=c.quads.withColumn("g", F.col("doc_id")))


# -- reasoning

from lattica.operators import reason, swrl  # noqa: E402

_EDGE = "e0 AS (SELECT DISTINCT subject AS child, object AS parent FROM ax WHERE axiom_kind = 'sub_class_of' AND NOT contains(object, ' ')), eq AS (SELECT subject AS child, object AS parent FROM ax WHERE axiom_kind = 'equivalent_class'), e AS (SELECT * FROM e0 UNION SELECT * FROM eq UNION SELECT parent, child FROM eq), up(a, b) AS (SELECT child, parent FROM e UNION SELECT up.a, e.parent FROM up JOIN e ON up.b = e.child)"
define("r2_classify_rdfs", lambda c: reason.classify(c, "rdfs").edges, _EDGE.replace("e AS (SELECT * FROM e0 UNION SELECT * FROM eq UNION SELECT parent, child FROM eq)", "e AS (SELECT * FROM e0)") + " SELECT a AS child, b AS parent FROM up WHERE a <> b")
define("r4_inferred_edges", lambda c: reason.classify(c, "rl").inferred, f"{_EDGE} SELECT a AS child, b AS parent FROM up WHERE a <> b AND (a, b) NOT IN (SELECT child, parent FROM e0)")
define("r2_equivalences", lambda c: reason.classify(c, "rl").equivalences, "SELECT subject AS node, subject AS component FROM ax WHERE axiom_kind = 'equivalent_class' UNION ALL SELECT object, subject FROM ax WHERE axiom_kind = 'equivalent_class'")
define("r3_unsatisfiable", lambda c: reason.classify(_crossed(c), "rl").unsatisfiable, "SELECT '" + T + "nation/1' AS iri")
define("r6_realize", lambda c: reason.realize(c, "rdfs").where("individual LIKE '%supplier%' AND most_specific").select("individual", "type", "inferred"), f"SELECT '{T}supplier/' || CAST(s_suppkey AS VARCHAR) AS individual, '{T}nation/' || CAST(s_nationkey AS VARCHAR) AS type, false AS inferred FROM supplier UNION ALL SELECT DISTINCT '{T}supplier/' || CAST(l_suppkey AS VARCHAR), '{T}Party', true FROM lineitem")
define("r8_inferred_inverse", lambda c: reason.facts(_with_inverse(c), "rl").where(f"p = '{T}supplies'"), f"SELECT o AS s, '{T}supplies' AS p, s AS o FROM q WHERE p = '{T}suppliedBy'")
define("r10_dl_query", lambda c: reason.dl_query(c, f"<{T}placedBy> some <{T}nation/3>", mode="asserted")["instances"], f"SELECT DISTINCT subject AS individual FROM ax WHERE predicate = '{T}placedBy' AND object IN (SELECT subject FROM ax WHERE axiom_kind = 'class_assertion' AND object = '{T}nation/3')")
define("r10_dl_cardinality", lambda c: reason.dl_query(c, f"<{T}contains> min 7", mode="asserted")["instances"], f"SELECT subject AS individual FROM ax WHERE predicate = '{T}contains' GROUP BY subject HAVING count(DISTINCT object) >= 7")
define("r11_swrl", lambda c: swrl.materialise(_with_rule(c))[0], f"SELECT a.subject AS s, '{T}buysFrom' AS p, b.object AS o FROM (SELECT DISTINCT object AS subject, subject AS ord FROM ax WHERE predicate = '{T}placedBy') a JOIN ax x ON x.subject = a.ord AND x.predicate = '{T}contains' JOIN ax b ON b.subject = x.object AND b.predicate = '{T}suppliedBy' GROUP BY ALL")


def _crossed(c: Catalog) -> Catalog:
    more = c.axioms.where(f"axiom_kind = 'sub_class_of' AND subject = '{T}nation/1' AND object NOT LIKE '% %'").limit(1)
    both = more.withColumn("object", F.lit(T + "region/0")).union(more.withColumn("object", F.lit(T + "region/1")))
    return c.with_(axioms=c.axioms.union(both))


def _with_inverse(c: Catalog) -> Catalog:
    one = c.axioms.limit(1)
    return c.with_(axioms=c.axioms.union(one.withColumn("axiom_kind", F.lit("inverse_object_properties")).withColumn("subject", F.lit(T + "suppliedBy")).withColumn("object", F.lit(T + "supplies")).withColumn("predicate", F.lit(""))))


def _with_rule(c: Catalog) -> Catalog:
    import json

    from lattica.model import SWRL_RULE

    atom = lambda p, x, y: {"kind": "object_property", "property": T + p, "args": [f"?{x}", f"?{y}"]}
    rule = json.dumps({"id": "r1", "enabled": True, "body": [atom("placedBy", "o", "c"), atom("contains", "o", "p"), atom("suppliedBy", "p", "s")], "head": [atom("buysFrom", "c", "s")]})
    quad = c.spark.createDataFrame([("urn:r1", "iri", SWRL_RULE, rule, "literal", None, None, None, "d")], c.quads.schema)
    return c.with_(quads=c.quads.unionByName(quad))


# -- sources and sinks, round trips through text

from lattica import sinks  # noqa: E402
from lattica.operators import edits, refactor  # noqa: E402
from lattica.sources import incremental, owx_write, rdf, scan, turtle  # noqa: E402
from lattica.streaming import reindex  # noqa: E402

_QUAD = "s, p, o, o_kind, coalesce(dt, '') AS dt"
_ROW = lambda df: df.select("s", "p", "o", "o_kind", F.coalesce("o_datatype", F.lit("")).alias("dt"))
define("s8_k7_ntriples_round_trip", lambda c: _ROW(rdf.parse_lines(rdf.to_ntriples(c.quads).withColumn("doc_id", F.lit("d")))), f"SELECT {_QUAD} FROM q")


def _through_files(form: str, text, rows, kinds: set[str] | None = None) -> Callable[[Catalog], DataFrame]:
    """All classes as texts, parsed again; of kinds of rows, where only those are read."""

    def query(c: Catalog) -> DataFrame:
        # Keys are digits of one length: their values are the positions of their paths.
        files = text(c).select(F.concat(F.lit("/m/"), "k", F.lit("." + form)).alias("path"), F.conv("k", 16, 10).cast("bigint").alias("doc_order"), F.lit(scan.FORMATS[form]).alias("format"), "text")
        return rows(scan.parse_files(files, kinds))

    return query


def _classes(c: Catalog) -> DataFrame:
    """child, parent, label: every named superclass."""
    e = c.entities.where("kind = 'class'").select(F.col("iri").alias("child"), F.coalesce(F.get("labels", F.lit(0)), "short_name").alias("label"))
    return c.axioms.where("axiom_kind = 'sub_class_of' AND object NOT LIKE '% %'").select(F.col("subject").alias("child"), F.col("object").alias("parent")).join(e, "child")


#: Rows of a file, about: the number of files grows with the input.
_FILE_ROWS = 10_000


def _file(key: str, rows: int):
    """The file of a key: the first digits of its digest, more of them where there are more rows."""
    return F.substring(F.md5(key), 1, max(1, math.ceil(math.log(max(1, rows) / _FILE_ROWS) / math.log(16))))


_FILE_SQL = f"substr(md5({{0}}), 1, (SELECT CAST(greatest(1, ceil(ln(count(*) / {_FILE_ROWS}.0) / ln(16))) AS INTEGER) FROM ({{1}})))"


def _joined(c: Catalog, one, head: str, tail: str = "") -> DataFrame:
    """A text for each file of classes."""
    rows = _classes(c)
    return rows.select(_file("child", rows.count()).alias("k"), one().alias("t")).groupBy("k").agg(F.concat(F.lit(head), F.array_join(F.array_sort(F.collect_list("t")), "\n"), F.lit(tail)).alias("text"))


def _blocks(c: Catalog, blocks: DataFrame, head: str = "", tail: str = "", between: str = "\n") -> DataFrame:
    """A text for each file of blocks (value) that hold all quads."""
    return blocks.select(_file("value", c.quads.count()).alias("k"), "value").groupBy("k").agg(F.concat(F.lit(head), F.array_join(F.collect_list("value"), between), F.lit(tail)).alias("text"))


def _jsonld(c: Catalog) -> DataFrame:
    """value: a node object for each quad."""
    text = lambda x: F.expr(f"substring(to_json(array({x})), 2, length(to_json(array({x}))) - 2)")
    node = F.concat(F.lit('{"@id": '), text("o"), F.lit("}"))
    value = F.concat(F.lit('{"@value": '), text("o"), F.lit(', "@type": '), text("o_datatype"), F.lit("}"))
    return c.quads.select(F.concat(F.lit('{"@id": '), text("s"), F.lit(", "), text("p"), F.lit(": "), F.when(F.col("o_kind") == "iri", node).otherwise(value), F.lit("}")).alias("value"))


_QUADS = lambda rows: rows.where("row = 'quad'").select(F.col("a").alias("s"), F.col("c").alias("p"), F.col("d").alias("o"), F.col("e").alias("o_kind"), F.coalesce("f", F.lit("")).alias("dt")).distinct()
_TTL_HEAD = "@prefix owl: <http://www.w3.org/2002/07/owl#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
_ttl = lambda: F.concat(F.lit("<"), "child", F.lit("> a owl:Class ; rdfs:label \""), "label", F.lit("\" ; rdfs:subClassOf <"), "parent", F.lit("> ."))
_xml = lambda: F.concat(F.lit("<owl:Class rdf:about=\""), "child", F.lit("\"><rdfs:label>"), "label", F.lit("</rdfs:label><rdfs:subClassOf rdf:resource=\""), "parent", F.lit("\"/></owl:Class>"))
_owx = lambda: F.concat(F.lit("<Declaration><Class IRI=\""), "child", F.lit("\"/></Declaration><SubClassOf><Class IRI=\""), "child", F.lit("\"/><Class IRI=\""), "parent", F.lit("\"/></SubClassOf>"))
_ID = lambda c: F.regexp_replace(F.substring(c, F.lit(len(T) + 1), F.length(c)), "[^A-Za-z0-9]", "")
_obo = lambda: F.concat(F.lit("[Term]\nid: N:"), _ID(F.col("child")), F.lit("\nname: "), "label", F.lit("\nis_a: R:"), _ID(F.col("parent")), F.lit(" ! x\n"))
_SUB = lambda rows: rows.where("row = 'axiom' AND a = 'sub_class_of'").select(F.col("b").alias("child"), F.col("d").alias("parent"))
_NAMED = "SELECT subject AS child, object AS parent FROM ax WHERE axiom_kind = 'sub_class_of' AND NOT contains(object, ' ')"
define("s6_turtle", _through_files("ttl", lambda c: _blocks(c, sinks.to_turtle(c.quads)), _QUADS, {"quad"}), f"SELECT DISTINCT {_QUAD} FROM q")


_BOTH = "equivalent_class disjoint_class".split()
define("k7_owlxml", _through_files("owx", lambda c: _blocks(c, owx_write.to_owlxml(c).select("value"), owx_write.head(""), owx_write.TAIL), lambda rows: rows.where("row = 'axiom'").select(F.col("a").alias("axiom_kind"), F.col("b").alias("subject"), F.col("c").alias("predicate"), F.col("d").alias("object")).distinct(), {"axiom"}), f"SELECT axiom_kind, subject, predicate, object FROM ax UNION SELECT axiom_kind, object, predicate, subject FROM ax WHERE axiom_kind IN ('{_BOTH[0]}', '{_BOTH[1]}')")


def _turtle_splits(c: Catalog) -> DataFrame:
    """All quads as Turtle files in the shared folder, read by as many tasks as they have splits."""
    path = f"{shared_dir(c.spark)}/lattica-ttl-{uuid.uuid4().hex[:12]}"
    sinks.to_turtle(c.quads).write.text(path)
    return _ROW(turtle.read_turtle(c.spark, path)[0])


define("s6_turtle_splits", _turtle_splits, f"SELECT DISTINCT {_QUAD} FROM q")
define("s7_rdfxml", _through_files("rdf", lambda c: _joined(c, _xml, "<rdf:RDF xmlns:rdf=\"http://www.w3.org/1999/02/22-rdf-syntax-ns#\" xmlns:owl=\"http://www.w3.org/2002/07/owl#\" xmlns:rdfs=\"http://www.w3.org/2000/01/rdf-schema#\">", "</rdf:RDF>"), _SUB), _NAMED)
define("s9_jsonld", _through_files("jsonld", lambda c: _blocks(c, _jsonld(c), '{"@graph": [', "]}", ",\n"), _QUADS), f"SELECT DISTINCT {_QUAD} FROM q")
define("s10_owlxml", _through_files("owx", lambda c: _joined(c, _owx, "<Ontology xmlns=\"http://www.w3.org/2002/07/owl#\">", "</Ontology>"), _SUB), _NAMED)
define("s11_s12_obo", _through_files("obo", lambda c: _joined(c, _obo, "ontology: m\n"), _SUB), f"SELECT 'http://purl.obolibrary.org/obo/N_' || regexp_replace(substr(child, {len(T) + 1}), '[^A-Za-z0-9]', '', 'g') AS child, 'http://purl.obolibrary.org/obo/R_' || regexp_replace(substr(parent, {len(T) + 1}), '[^A-Za-z0-9]', '', 'g') AS parent FROM ({_NAMED})")
define("s13_prefixes", _through_files("ttl", lambda c: _joined(c, _ttl, _TTL_HEAD), lambda rows: rows.where("row = 'document'").select("path", F.explode(F.from_json("d", "map<string,string>")).alias("prefix", "iri")).select("prefix").groupBy("prefix").agg(F.count("*").alias("n"))), f"SELECT prefix, count(DISTINCT {_FILE_SQL.format('child', _NAMED)}) AS n FROM ({_NAMED}), (VALUES ('owl'), ('rdfs')) v(prefix) GROUP BY prefix")
define("s14_error_recovery", _through_files("ttl", lambda c: _joined(c, _ttl, _TTL_HEAD, "\n<broken> <"), lambda rows: rows.groupBy("path").agg(F.count_if(F.col("row") == "error").alias("errors"), F.count_if((F.col("row") == "axiom")).alias("axioms")).select("errors", "axioms")), f"SELECT CAST(1 AS BIGINT) AS errors, count(*) AS axioms FROM ({_NAMED}) GROUP BY {_FILE_SQL.format('child', _NAMED)}")
define("s4_describe", lambda c: scan.described(c.spark.createDataFrame([], "path string, content binary, modified_time bigint, size bigint"), c.documents.select("path", F.col("base_iri").alias("text"))).select("path", "format", "content_hash", "doc_order"), "SELECT path, 'turtle' AS format, sha256(base_iri) AS content_hash, row_number() OVER (ORDER BY path) - 1 AS doc_order FROM doc")
_TERM = f"CASE WHEN o_kind = 'iri' THEN '<' || o || '>' WHEN dt LIKE '%#string' THEN '\"' || o || '\"' ELSE '\"' || o || '\"^^<' || dt || '>' END"
define("k7_turtle", lambda c: sinks.to_turtle(c.quads), f"SELECT '<' || s || '> ' || string_agg(line, ' ;' || chr(10) || '    ' ORDER BY line) || ' .' AS value FROM (SELECT s, '<' || p || '> ' || string_agg(t, ' , ' ORDER BY t) AS line FROM (SELECT DISTINCT s, p, {_TERM} AS t FROM q) GROUP BY s, p) GROUP BY s")
define("k5_pages", lambda c: sinks.pages(c).where("name IN ('index.md', 'properties.md')").select("name", "content"), f"SELECT 'index.md' AS name, '# Index' || chr(10) || chr(10) || string_agg('- ' || kind || ': ' || CAST(n AS VARCHAR), chr(10) ORDER BY kind) || chr(10) AS content FROM (SELECT kind, count(*) AS n FROM ent GROUP BY kind) UNION ALL SELECT 'properties.md', '# Properties' || chr(10) || chr(10) || string_agg('- ' || label || ' (' || kind || ')', chr(10) ORDER BY {_SHORT.format('iri')} || ' ' || iri) || chr(10) FROM ent WHERE kind LIKE '%property'")
define("st2_incremental_states", lambda c: incremental.stats(incremental.reuse_plan(c.documents.select("path", F.col("base_iri").alias("content_hash")), c.documents.where("doc_order < 3").select("path", F.when(F.col("doc_order") == 0, "x").otherwise(F.col("base_iri")).alias("content_hash")))), "SELECT 'reused' AS state, 2 AS n UNION ALL SELECT 'reparsed', 2")
define("st_latest_state", lambda spark, sf: reindex.latest_state(spark.read.parquet(f"{sf}/events.parquet")).select("user_id", "changes", "event_id", "event_type"), "SELECT user_id, count(*) AS changes, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id", tables=True)
define("st_windowed_changes", lambda spark, sf: reindex.windowed_changes(spark.read.parquet(f"{sf}/events.parquet")).select(F.substring(X.iso_utc(F.unix_seconds("start")), 1, 10).alias("day"), "event_type", "n"), "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY ALL", tables=True)

# -- refactoring

define("e2_rename", lambda c: refactor.rename(c, T + "region/1", T + "zone/1").axioms.where(f"object LIKE '%zone/1'").select("subject", "object"), f"SELECT subject, replace(object, '{T}region/1', '{T}zone/1') AS object FROM ax WHERE object LIKE '%region/1'")
define("e2_migrate", lambda c: refactor.migrate_namespace(c, T + "part/", "http://new/p/").entities.where("iri LIKE 'http://new/%'").select("iri", "short_name"), f"SELECT 'http://new/p/' || substr(iri, {len(T) + 6}) AS iri, substr(iri, {len(T) + 6}) AS short_name FROM ent WHERE starts_with(iri, '{T}part/')")
define("e2_merge", lambda c: refactor.merge(c, T + "region/0", T + "region/1").axioms.where(f"object = '{T}region/0' AND axiom_kind = 'sub_class_of'").select("subject"), f"SELECT DISTINCT subject FROM ax WHERE axiom_kind = 'sub_class_of' AND object IN ('{T}region/0', '{T}region/1')")
define("e2_extract_module", lambda c: refactor.extract_module(c, c.spark.createDataFrame([(T + "placedBy",)], "iri string")).entities.select("iri"), f"{_SIG}, w(iri) AS (SELECT '{T}placedBy' UNION SELECT b.x FROM w JOIN sig a ON a.x = w.iri JOIN sig b ON b.id = a.id) SELECT iri FROM ent WHERE iri IN (SELECT iri FROM w)")
define("e3_merge_ontologies", lambda c: refactor.merge_ontologies(c, [T + "onto/parts", T + "onto/parties"], T + "onto/both").imports.select("ontology_id", "import_iri"), f"SELECT DISTINCT CASE WHEN ontology_id LIKE '%part%' THEN '{T}onto/both' ELSE ontology_id END AS ontology_id, import_iri FROM imp WHERE import_iri NOT IN ('{T}onto/parts', '{T}onto/parties')")
define("e3_flatten", lambda c: refactor.flatten_imports(c, T + "onto/parties")[0].entities.groupBy("ontology_id", "kind").agg(F.count("*").alias("n")), f"SELECT '{T}onto/parties' AS ontology_id, kind, count(*) AS n FROM ent WHERE ontology_id IN ('{T}onto/parties', '{T}onto/core') GROUP BY kind")
define("a11_plan_metrics", lambda c: refactor.metrics(refactor.plan(c, refactor.move_entity(c, T + "nation/5", T + "onto/parts"))).where("part = 'axioms'"), f"SELECT 'axioms' AS part, op, count(*) AS n FROM ax, (VALUES ('add'), ('remove')) v(op) WHERE subject = '{T}nation/5' GROUP BY op")
_RENAMED = "SELECT axiom_kind, count(*) AS n FROM ax WHERE subject = '{0}' OR list_contains(string_split(object, ' '), '{0}') GROUP BY axiom_kind"
define("e4_apply_and_invert", lambda c: _delta(c), f"SELECT 'applied' AS step, * FROM ({_RENAMED.format(T + 'region/1')}) UNION ALL SELECT 'inverted', * FROM ({_RENAMED.format(T + 'region/1')}) UNION ALL SELECT 'all', axiom_kind, count(*) FROM ax GROUP BY axiom_kind")


def _delta(c: Catalog) -> DataFrame:
    """Axioms of an entity after its renaming and after the inverse; and those that are as they were after both."""
    delta = cut(refactor.plan(c, refactor.rename(c, T + "region/1", T + "zone/1")), "delta")
    there = refactor.apply(c, delta)
    back = refactor.apply(there, refactor.invert(delta))
    keys = ["axiom_kind", "subject", "predicate", "object", "ontology_id"]
    of = lambda x, iri, step: x.axioms.where((F.col("subject") == iri) | F.array_contains(F.split("object", " "), iri)).groupBy("axiom_kind").agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), "axiom_kind", "n")
    same = back.axioms.select(keys).intersectAll(c.axioms.select(keys)).groupBy("axiom_kind").agg(F.count("*").alias("n")).select(F.lit("all").alias("step"), "axiom_kind", "n")
    return of(there, T + "zone/1", "applied").union(of(back, T + "region/1", "inverted")).union(same)


def _sources(c: Catalog) -> DataFrame:
    return cut(_blocks(c, sinks.to_turtle(c.quads)).select(F.concat(F.lit("/m/"), "k", F.lit(".ttl")).alias("path"), F.conv("k", 16, 10).cast("bigint").alias("doc_order"), "text"), "sources", "zstd")


def _edited(c: Catalog, files: DataFrame, made: DataFrame) -> DataFrame:
    """Quads of the files after edits."""
    after = edits.apply(files, made).where("state = 'ok'").select("path", F.col("text").alias("new"))
    texts = files.join(after, "path", "left").select("path", "doc_order", F.lit("turtle").alias("format"), F.coalesce("new", "text").alias("text"))
    return _QUADS(scan.parse_files(texts, {"quad"}))


def _relabelled(c: Catalog) -> DataFrame:
    """Labels of parts become values of another predicate, in the sources."""
    files = _sources(c)
    found = edits.statements(files, [_RDFS + "label"]).where(f"p = '{_RDFS}label' AND s LIKE '{T}part/%'").select("path", "s", "p", "o", "o_kind", "o_datatype", "o_lang")
    changes = found.select("path", F.lit("remove").alias("op"), "s", "p", "o", "o_kind", "o_datatype", "o_lang").union(found.select("path", F.lit("add"), "s", F.lit(T + "altLabel"), "o", "o_kind", "o_datatype", "o_lang"))
    return _edited(c, files, cut(edits.triple_edits(files, changes), "edits")).where(f"p IN ('{_RDFS}label', '{T}altLabel')").select("s", "p", "o")


define("e4_source_labels", _relabelled, f"SELECT DISTINCT s, CASE WHEN s LIKE '{T}part/%' THEN '{T}altLabel' ELSE p END AS p, o FROM q WHERE p = '{_RDFS}label'")
define("e4_source_rename", lambda c: (lambda files: _edited(c, files, cut(edits.rename(files, T + "placedBy", T + "orderedBy"), "edits")).where(f"p = '{T}orderedBy' OR s = '{T}orderedBy'").drop("dt", "o_kind"))(_sources(c)), f"SELECT DISTINCT CASE WHEN s = '{T}placedBy' THEN '{T}orderedBy' ELSE s END AS s, CASE WHEN p = '{T}placedBy' THEN '{T}orderedBy' ELSE p END AS p, o FROM q WHERE p = '{T}placedBy' OR s = '{T}placedBy'")


# -- what is refused, and what is said of it

_SQL_CASES = [("SELECT iri FROM classes", "ok"), ("DELETE FROM classes", "refused"), ("SELECT count(*) FROM classes", "refused"), ("SELECT iri FROM classes WHERE deprecated", "refused"), ("SELECT iri FROM classes WHERE iri LIKE 'a'", "refused"), ("SELECT iri FROM classes WHERE iri > 'a'", "refused"), ("SELECT iri FROM nowhere", "refused"), ("SELECT nothing FROM classes", "refused"), ("SELECT iri FROM classes ORDER BY iri", "refused"), ("SELECT iri FROM classes UNION SELECT iri FROM individuals", "refused"), ("SELECT iri FROM classes; SELECT iri FROM classes", "refused")]
_SPARQL_CASES = [("SELECT ?s WHERE { ?s a ?o }", "ok"), ("CONSTRUCT { ?s a ?o } WHERE { ?s a ?o }", "refused"), ("DESCRIBE <http://x>", "refused"), ("INSERT DATA { <http://x> a <http://y> }", "refused"), ("DELETE WHERE { ?s ?p ?o }", "refused"), ("SELECT ?s WHERE { SERVICE <http://x> { ?s a ?o } }", "refused"), ("SELECT ?s WHERE { ?s a", "refused")]


def _outcomes(run: Callable[[Catalog, str], object], cases: list[tuple[str, str]]) -> Callable[[Catalog], DataFrame]:
    from lattica.model import LatticaError

    def query(c: Catalog) -> DataFrame:
        def outcome(text: str) -> str:
            try:
                run(c, text)
            except LatticaError:
                return "refused"
            return "ok"

        return c.spark.createDataFrame([(t, outcome(t)) for t, _ in cases], "statement string, outcome string")

    return query


_values = lambda rows, names: f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(chr(39) + str(x).replace(chr(39), chr(39) * 2) + chr(39) for x in r) + ')' for r in rows)}) v({names})"
define("p1_sql_refused", _outcomes(run_sql, _SQL_CASES), _values(_SQL_CASES, "statement, outcome"))
define("q16_sparql_refused", _outcomes(run_sparql, _SPARQL_CASES), _values(_SPARQL_CASES, "statement, outcome"))
define("q19_sparql_row_cap", lambda c: run_sparql(c, _P + "SELECT ?s ?o WHERE { ?s t:contains ?o }").capped(1000)[0].agg(F.count("*").alias("n")), f"SELECT least(count(*), 1000) AS n FROM q WHERE p = '{T}contains'")

# -- more forms of SPARQL

_sparql("q7_undef", f"SELECT ?s ?k WHERE {{ VALUES (?s ?k) {{ (<{T}part/1> UNDEF) (UNDEF '50') }} ?s t:size ?k }}", f"SELECT {_I('s')} AS s, {_L('o')} AS k FROM q WHERE p = '{T}size' AND s = '{T}part/1' UNION ALL SELECT {_I('s')}, {_L('o')} FROM q WHERE p = '{T}size' AND o = '50'")
_sparql("q12_path_star", "SELECT ?x WHERE { ?x rdfs:subClassOf* t:Place }", f"w(x) AS (SELECT '{T}Place' UNION SELECT s FROM q JOIN w ON o = x WHERE p = '{_RDFS}subClassOf') SELECT {_I('x')} AS x FROM w")
_sparql("q12_path_inverse_alternative", "SELECT DISTINCT ?x ?y WHERE { ?x (^t:placedBy|t:segment) ?y }", f"SELECT DISTINCT {_I('o')} AS x, {_I('s')} AS y FROM q WHERE p = '{T}placedBy' UNION SELECT DISTINCT {_I('s')}, {_L('o')} FROM q WHERE p = '{T}segment'")
_sparql("q9_sum", "SELECT ?c (SUM(?v) AS ?total) WHERE { ?o t:placedBy ?c ; t:totalprice ?v } GROUP BY ?c", f"SELECT {_I('a.o')} AS c, {_NUM("regexp_replace(CAST(sum(CAST(b.o AS DECIMAL(18,2))) AS VARCHAR), '([.][0-9])0$', '\\1')", 'decimal')} AS total FROM q a JOIN q b ON a.s = b.s AND b.p = '{T}totalprice' WHERE a.p = '{T}placedBy' GROUP BY a.o")
_sparql("q9_group_concat", "SELECT ?g (GROUP_CONCAT(DISTINCT ?k; separator='|') AS ?all) WHERE { ?c t:segment ?g . ?c a ?k FILTER(?k = owl:NamedIndividual) } GROUP BY ?g", f"SELECT {_L('o')} AS g, '\"http://www.w3.org/2002/07/owl#NamedIndividual\"' AS \"all\" FROM q WHERE p = '{T}segment' GROUP BY o")

# -- scalar functions over whole tables

_LABELS = {"sub_class_of": "SubClassOf", "equivalent_class": "EquivalentTo", "disjoint_class": "DisjointWith", "domain": "Domain", "range": "Range", "class_assertion": "Type", "object_property_assertion": "ObjectPropertyAssertion", "data_property_assertion": "DataPropertyAssertion"}
_LABEL_CASE = "CASE axiom_kind " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _LABELS.items()) + " END"
_LAST = "regexp_extract({0}, '[^#/]*$')".format
define("f18_axiom_display_all", lambda c: c.axioms.select("id", X.axiom_label("axiom_kind").alias("label"), X.axiom_display("axiom_kind", "predicate", "object").alias("display")).groupBy("label", "display").agg(F.count("*").alias("n")), f"SELECT {_LABEL_CASE} AS label, CASE WHEN axiom_kind LIKE '%_property_assertion' THEN {_LAST('predicate')} ELSE {_LABEL_CASE} END || ' ' || {_LAST('object')} AS display, count(*) AS n FROM ax GROUP BY ALL")
define("f13_obo_annotation", lambda spark, sf: spark.read.parquet(f"{sf}/part.parquet").select(F.explode(F.array(X.obo_annotation_iri(F.concat(F.lit("oio:"), F.replace("p_name", F.lit(" "), F.lit("_")))), X.obo_annotation_iri(F.concat(F.lit("IAO:"), F.col("p_partkey").cast("string"))), X.obo_annotation_iri(F.concat(F.lit("http://x/"), F.col("p_partkey").cast("string"))))).alias("iri")), "SELECT unnest(['http://www.geneontology.org/formats/oboInOwl#' || replace(p_name, ' ', '_'), 'http://purl.obolibrary.org/obo/IAO_' || CAST(p_partkey AS VARCHAR), 'http://x/' || CAST(p_partkey AS VARCHAR)]) AS iri FROM part", tables=True)
define("f17_members_all", lambda spark, sf: spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.explode(X.members(F.concat("p_type", F.lit(" and "), "p_brand", F.lit("  and "), "p_name"), "and")).alias("m")), "SELECT p_partkey, unnest([p_type, p_brand, p_name]) AS m FROM part", tables=True)
define("f27_synonym_scope_all", lambda spark, sf: spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", X.synonym_property(F.element_at(F.array(*map(F.lit, ("exact", "BROAD", "Narrow", "related", "x"))), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("p")), "SELECT o_orderkey, 'http://www.geneontology.org/formats/oboInOwl#has' || (['Exact', 'Broad', 'Narrow', 'Related', 'Related'])[o_orderkey % 5 + 1] || 'Synonym' AS p FROM orders", tables=True)
define("t5_annotation_order", lambda c: c.quads.select("p").distinct().select("p", F.row_number().over(Window.orderBy(X.annotation_order("p"))).cast("bigint").alias("at")), f"SELECT p, row_number() OVER (ORDER BY CASE WHEN p = '{_RDFS}label' THEN 0 ELSE 1 END, p) AS at FROM (SELECT DISTINCT p FROM q)")

# -- diagnostics of files


def _indexed(tail: str) -> Callable[[Catalog], Catalog]:
    """A catalog of all classes as Turtle files, each with the same text at its end."""

    def build(c: Catalog) -> Catalog:
        texts = _joined(c, _ttl, _TTL_HEAD, tail).withColumn("path", F.concat(F.lit("/m/"), "k", F.lit(".ttl")))
        none = c.spark.createDataFrame([], "path string, content binary, modified_time bigint, size bigint")
        files = scan.described(none, texts.select("path", "text"))
        return scan.assemble(c.spark, files, scan.parse_files(files), lint=False)

    return build


_FILES = f"SELECT DISTINCT '/m/' || {_FILE_SQL.format('child', _NAMED)} || '.ttl' AS file FROM ({_NAMED})"
define("d1_parse_errors", lambda c: diagnostics.parse_errors(_indexed("\n<broken> <")(c)).select("code", "severity", "file"), f"SELECT 'parse_error' AS code, 'error' AS severity, file FROM ({_FILES})")
define("d3_undefined_prefixes", lambda c: diagnostics.undefined_prefixes(_indexed("\nzz:a a owl:Class .")(c)).select("code", "severity", "file"), f"SELECT 'undefined_prefix' AS code, 'error' AS severity, file FROM ({_FILES})")
define("d7_read_errors", lambda c: diagnostics.load_failures(scan.parse_files(_joined(c, _ttl, "").select("k").select(F.concat(F.lit("/m/"), "k", F.lit(".ttl")).alias("path"), F.lit(0).cast("bigint").alias("doc_order"), F.lit("turtle").alias("format"), F.lit(None).cast("string").alias("text"))).where("row = 'failure'")).select("code", "severity", "file"), f"SELECT 'io_read_error' AS code, 'warning' AS severity, file FROM ({_FILES})")

# -- reasoning on the whole catalog


def _with_rules(c: Catalog, *rules: dict) -> Catalog:
    import json

    from lattica.model import SWRL_RULE

    rows = [(f"urn:r{k}", "iri", SWRL_RULE, json.dumps(r), "literal", None, None, None, "d") for k, r in enumerate(rules)]
    return c.with_(quads=c.quads.unionByName(c.spark.createDataFrame(rows, c.quads.schema)))


_BIG = {"id": "big", "enabled": True, "body": [{"kind": "data_property", "property": T + "totalprice", "args": ["?o", "?v"]}, {"kind": "builtin", "builtin": "http://www.w3.org/2003/11/swrlb#greaterThan", "args": ["?v", "200000"]}], "head": [{"kind": "class", "class": T + "BigOrder", "args": ["?o"]}]}
_BAD = {"id": "bad", "enabled": True, "body": [{"kind": "class", "class": "", "args": ["?x"]}], "head": [{"kind": "class", "class": T + "A", "args": ["?y"]}]}
define("fw_swrl_builtins", lambda c: swrl.materialise(_with_rules(c, _BIG))[0], f"SELECT s, '{_RDF}type' AS p, '{T}BigOrder' AS o FROM q WHERE p = '{T}totalprice' AND CAST(o AS DOUBLE) > 200000")
define("d11_swrl_validation", lambda c: swrl.diagnostics(_with_rules(c, _BIG, _BAD)).select("code", "severity"), _values([("swrl_unbound_variable", "error"), ("swrl_bad_iri", "error")], "code, severity"))
define("r2b_profile_warnings", lambda c: c.spark.createDataFrame([(w,) for w in reason.profile_warnings(c, "rdfs")], "warning string"), "SELECT 'rdfs: ' || count(*) || ' axioms of kind ' || axiom_kind || ' are not used' AS warning FROM ax WHERE axiom_kind IN ('disjoint_class', 'equivalent_class') GROUP BY axiom_kind UNION ALL SELECT 'rdfs: ' || count(*) || ' complex superclasses are used in part only' FROM ax WHERE axiom_kind = 'sub_class_of' AND contains(object, ' ')")
define("r5_consistency", lambda c: (lambda found: c.spark.createDataFrame([(found["consistent"], x) for x in found["unsatisfiable"]], "consistent boolean, unsatisfiable string"))(reason.check_consistency(_crossed(c), "rl")), f"SELECT false AS consistent, '{T}nation/1' AS unsatisfiable")
define("r7_check_instance", lambda c: c.spark.createDataFrame([(n, reason.check_instance(c, T + n, T + "Place", "rdfs")) for n in ("customer/1", "order/1")], "individual string, found boolean"), "SELECT 'customer/1' AS individual, true AS found UNION ALL SELECT 'order/1', false")
define("r9_explain", lambda c: c.spark.createDataFrame([(k, step) for chain in reason.explain(_crossed(c), T + "nation/1") for k, step in enumerate(chain)], "k int, step string"), f"SELECT * FROM (VALUES (0, '{T}nation/1 SubClassOf {T}region/0'), (1, '{T}nation/1 SubClassOf {T}region/1'), (2, '{T}region/0 DisjointWith {T}region/1')) v(k, step)")


def _with_places(c: Catalog) -> Catalog:
    """Classes of what is located in each region and in any place, and of what has each brand or any product for one; and
    that each part has its brand."""
    none = F.array().cast(c.axioms.schema["annotations"].dataType)
    row = lambda df, kind, subject, obj: df.select(F.lit("el").alias("id"), F.lit(T + "onto/core").alias("ontology_id"), subject.alias("subject"), F.lit("").alias("predicate"), obj.alias("object"), F.lit(kind).alias("axiom_kind"), none.alias("annotations"))
    of = lambda pattern: c.entities.where(f"kind = 'class' AND iri LIKE '{T}{pattern}'").select("iri")
    named = lambda df, role, kind, to: row(df, "equivalent_class", F.regexp_replace("iri", f"/t/({kind}/)?", f"/t/{to}/"), F.concat(F.lit(role + " some "), "iri"))
    parts = c.axioms.where(f"axiom_kind = 'sub_class_of' AND object LIKE '{T}brand/%'")
    more = named(of("region/%").union(of("Place")), "locatedIn", "region", "in").union(named(of("brand/%").union(of("Product")), "ofBrand", "brand", "of")).union(row(parts, "sub_class_of", F.col("subject"), F.concat(F.lit("ofBrand some "), "object")))
    return c.with_(axioms=c.axioms.union(more))


_EL = f"""{_EDGE}, below AS (SELECT a AS child, b AS parent FROM up UNION SELECT iri, iri FROM ent WHERE kind = 'class' UNION SELECT object, object FROM ax WHERE axiom_kind = 'equivalent_class')
SELECT child, parent FROM below WHERE child <> parent
UNION SELECT child, replace(split_part(object, ' ', 3), '/region/', '/in/') FROM below JOIN ax ON subject = parent WHERE object LIKE 'locatedIn some %'
UNION SELECT child, '{T}in/Place' FROM below JOIN ax ON subject = parent WHERE object LIKE 'locatedIn some %'
UNION SELECT replace(iri, '/region/', '/in/'), '{T}in/Place' FROM ent WHERE iri LIKE '{T}region/%'
UNION SELECT subject, replace(object, '/brand/', '/of/') FROM ax WHERE axiom_kind = 'sub_class_of' AND object LIKE '{T}brand/%'
UNION SELECT subject, '{T}of/Product' FROM ax WHERE axiom_kind = 'sub_class_of' AND object LIKE '{T}brand/%'
UNION SELECT replace(iri, '/brand/', '/of/'), '{T}of/Product' FROM ent WHERE iri LIKE '{T}brand/%'"""
define("r1_el_classification", lambda c: reason.classify(_with_places(c), "el").edges, _EL)


def _all_crossed(c: Catalog) -> Catalog:
    """Every nation of region 0 is in region 1, too."""
    more = c.axioms.where(f"axiom_kind = 'sub_class_of' AND subject LIKE '{T}nation/%' AND object = '{T}region/0'").withColumn("object", F.lit(T + "region/1"))
    return c.with_(axioms=c.axioms.union(more))


_NATION = f"SELECT '{T}nation/' || CAST(n_nationkey AS VARCHAR) AS n, '{T}state/' || CAST(n_nationkey AS VARCHAR) AS s, n_nationkey % 5 = 0 AS same FROM nation WHERE n_regionkey = 0"
_STEPS = [f"n || ' SubClassOf {T}region/0'", f"n || ' SubClassOf {T}region/1'", f"'{T}region/0 DisjointWith {T}region/1'"]
define("r9_justifications", lambda c: reason.explanations(_all_crossed(c)).select("iri", "k", F.posexplode("steps").alias("at", "step")), f"x AS ({_NATION}) " + " UNION ALL ".join([*(f"SELECT n AS iri, 0 AS k, {i} AS at, {step} AS step FROM x" for i, step in enumerate(_STEPS)), *(f"SELECT s, 0, {i}, {step} FROM x WHERE same" for i, step in enumerate(["n || ' EquivalentTo ' || s", *_STEPS]))]))
define("x16_entity_detail", lambda c: (lambda d: d["parents"].select(F.lit("parent").alias("side"), F.col("parent").alias("iri")).union(d["children"].select(F.lit("child"), "child")))(c.entity_detail(T + "region/1")), f"{_HIER} SELECT 'parent' AS side, parent AS iri FROM h WHERE child = '{T}region/1' UNION ALL SELECT 'child', child FROM h WHERE parent = '{T}region/1'")

# -- sinks

define("k1_tsv", lambda c: c.spark.createDataFrame([(x,) for x in sinks.to_tsv(run_sql(c, "SELECT iri, kind FROM properties"))], "line string"), "SELECT 'iri' || chr(9) || 'kind' AS line UNION ALL SELECT iri || chr(9) || kind FROM ent WHERE kind LIKE '%property'")
define("k3_json", lambda c: c.spark.createDataFrame([(sinks.to_json(run_sql(c, "SELECT iri FROM object_properties")),)], "j string").select(F.explode(F.from_json("j", "rows array<array<string>>")["rows"]).alias("r")).select(F.get("r", F.lit(0)).alias("iri")), "SELECT iri FROM ent WHERE kind = 'object_property'")
_with_heads("k6_diff_json", lambda c: diff.to_json(diff.diff_catalogs(c, _head(c))).where("part IN ('axioms', 'imports')").select("part", F.from_json("json", "change string, subject string, import_iri string").alias("r")).groupBy("part", "r.change").agg(F.count("*").alias("n")), f"SELECT 'axioms' AS part, 'removed' AS change, count(*) AS n FROM ax WHERE {_GONE.format('subject')} OR {_GONE.format('object')} UNION ALL SELECT 'imports', 'removed', count(*) FROM imp WHERE import_iri LIKE '%missing'")
_with_heads("v9_diff_text", lambda c: diff.text_lines(diff.diff_catalogs(c, _head(c))).where("line LIKE 'removed %'").select("line"), f"SELECT 'removed ' || kind || ': ' || iri AS line FROM ent WHERE {_GONE.format('iri')} AND TRY_CAST(regexp_extract(iri, '[0-9]+$') AS BIGINT) % 14 <> 0 UNION ALL SELECT 'removed axiom: ' || subject || ' ' || axiom_kind || ' ' || object FROM ax WHERE {_GONE.format('subject')} OR {_GONE.format('object')} UNION ALL SELECT 'removed import: ' || ontology_id || ' ' || import_iri FROM imp WHERE import_iri LIKE '%missing'")


define("k7_rdfxml_round_trip", _through_files("rdf", lambda c: _blocks(c, sinks.to_rdfxml(c.quads), sinks.RDFXML_HEAD, sinks.RDFXML_TAIL), lambda rows: _QUADS(rows).drop("dt"), {"quad"}), "SELECT DISTINCT s, p, o, o_kind FROM q")
