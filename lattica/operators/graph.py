"""Graph extraction: ten kinds of graphs as two frames, nodes and edges."""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.catalog import Catalog, capped
from lattica.functions import exprs as X
from lattica.model import DEFAULT_DEPTH, MAX_DEPTH, MAX_GRAPH_EDGES, MAX_GRAPH_NODES, LatticaError
from lattica.operators.fixpoint import bfs, reachable
from lattica.storage import cut

KINDS = ["class", "property", "object_property", "data_property", "individual", "import", "dependency", "neighborhood", "query_result", "refactor_preview"]


@dataclass(frozen=True)
class Filters:
    ontology_iri: str | None = None
    hide_deprecated: bool = False
    entity_kinds: list[str] = field(default_factory=list)
    namespaces: list[str] = field(default_factory=list)
    search_text: str = ""
    relationship_kinds: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Request:
    graph_kind: str
    roots: list[str] = field(default_factory=list)
    depth: int = DEFAULT_DEPTH
    include_inferred: bool = False
    filters: Filters = Filters()


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame

    def capped(self, nodes: int = MAX_GRAPH_NODES, edges: int = MAX_GRAPH_EDGES) -> tuple[DataFrame, DataFrame, bool]:
        """The payload of a viewer: cut in a fixed order, and whether anything was cut."""
        order = [c for c in ("depth", "id") if c in self.nodes.columns]
        n, more_n = capped(self.nodes.orderBy(*order), nodes)
        e, more_e = capped(self.edges.orderBy("source", "target", "kind", "inferred"), edges)
        return n, e, more_n or more_e


def _allowed(f: Filters, iri: Column, known: Column, e: dict[str, Column]) -> Column:
    """Whether an IRI passes; e has the columns of its entity, which is null where ``known`` is false."""
    q = f.search_text.strip().lower()
    has = lambda c: F.contains(F.lower(c), F.lit(q))
    unknown = F.lit(not (f.ontology_iri is not None or f.entity_kinds or f.namespaces or f.hide_deprecated))
    own = F.lit(True)
    if f.hide_deprecated:
        own = own & ~F.coalesce(e["deprecated"], F.lit(False))
    if f.ontology_iri is not None:
        own = own & (e["ontology_id"] == f.ontology_iri)
    if f.entity_kinds:
        own = own & e["kind"].isin(*f.entity_kinds)
    if f.namespaces:
        fits = [(X.namespace_of(iri) == n) | F.startswith(iri, F.lit(n)) for n in f.namespaces]
        own = own & F.exists(F.array(*fits), lambda x: x)
    if q:
        unknown = unknown & (has(iri) | has(X.graph_short_name(iri)))
        own = own & (has(iri) | has(e["short_name"]) | F.exists(e["labels"], has))
    return F.when(known, own).otherwise(unknown)


def keep_allowed(df: DataFrame, column: str, catalog: Catalog, filters: Filters) -> DataFrame:
    """Rows whose IRI in a column passes the filters; one left join with the entities."""
    if filters == Filters(relationship_kinds=filters.relationship_kinds):
        return df
    e = catalog.entities.select(F.col("iri").alias("__iri"), *[F.col(c).alias(f"__{c}") for c in ("kind", "ontology_id", "deprecated", "short_name", "labels")])
    joined = df.join(e, F.col(column) == F.col("__iri"), "left")
    fields = {c: F.col(f"__{c}") for c in ("kind", "ontology_id", "deprecated", "short_name", "labels")}
    return joined.where(_allowed(filters, F.col(column), F.col("__iri").isNotNull(), fields)).select(*df.columns)


def _relations(edges: DataFrame, filters: Filters) -> DataFrame:
    return edges.where(F.col("kind").isin(*filters.relationship_kinds)) if filters.relationship_kinds else edges


def nodes_of(iris: DataFrame, catalog: Catalog, unsatisfiable: DataFrame | None = None) -> DataFrame:
    """Node rows of iri (and depth): label is the first label, else the short name; unknown IRIs are of kind other."""
    e = catalog.entities.select("iri", "short_name", "kind", "ontology_id", "labels", "deprecated")
    equivalent = catalog.axioms.where("axiom_kind = 'equivalent_class'").select(F.col("subject").alias("iri")).distinct().withColumn("equivalent", F.lit(True))
    out = iris.join(e, "iri", "left").join(equivalent, "iri", "left")
    out = out.join(unsatisfiable.select("iri").distinct().withColumn("unsatisfiable", F.lit(True)), "iri", "left") if unsatisfiable is not None else out.withColumn("unsatisfiable", F.lit(False))
    label = F.coalesce(F.get("labels", F.lit(0)), F.when(F.col("short_name") != "", F.col("short_name")), X.graph_short_name("iri"))
    more = ["depth"] if "depth" in iris.columns else []
    return out.select(F.col("iri").alias("id"), label.alias("label"), F.coalesce("kind", F.lit("other")).alias("kind"), X.namespace_of("iri").alias("namespace"), F.col("ontology_id").alias("ontology_iri"), F.coalesce("deprecated", F.lit(False)).alias("deprecated"), F.coalesce("unsatisfiable", F.lit(False)).alias("unsatisfiable"), F.coalesce("equivalent", F.lit(False)).alias("equivalent"), *more)


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("source", "target")).alias("iri")).distinct()


def class_graph(catalog: Catalog, request: Request, inferred: DataFrame | None = None) -> Graph:
    """Subclass edges with both ends allowed; inferred ones (child, parent) that aren't asserted, if asked for."""
    asserted = catalog.hierarchy()
    edges = asserted.withColumn("inferred", F.lit(False))
    if request.include_inferred and inferred is not None:
        edges = edges.unionByName(inferred.select("child", "parent").join(asserted, ["child", "parent"], "left_anti").withColumn("inferred", F.lit(True)))
    edges = keep_allowed(keep_allowed(edges, "child", catalog, request.filters), "parent", catalog, request.filters)
    nodes = nodes_of(edges.select(F.explode(F.array("child", "parent")).alias("iri")).distinct(), catalog)
    edges = edges.select(F.col("child").alias("source"), F.col("parent").alias("target"), F.lit("sub_class_of").alias("kind"), "inferred")
    return Graph(nodes, _relations(edges, request.filters))


def property_graph(catalog: Catalog, request: Request, kinds: tuple[str, ...] = ("object_property", "data_property")) -> Graph:
    """Properties, their domains and ranges (only the property is filtered) and sub-property edges (both ends are)."""
    f = request.filters
    own = keep_allowed(catalog.entities.where(F.col("kind").isin(*kinds)).select("iri"), "iri", catalog, f)
    ax = catalog.axioms
    ends = ax.where(F.col("axiom_kind").isin("domain", "range")).select(F.col("subject").alias("source"), F.col("object").alias("target"), F.col("axiom_kind").alias("kind"))
    ends = ends.join(own.select(F.col("iri").alias("source")), "source", "left_semi")
    subs = ax.where(F.col("axiom_kind").isin(*[f"sub_{k}_of" for k in kinds])).select(F.col("subject").alias("source"), F.col("object").alias("target"), F.lit("sub_property_of").alias("kind"))
    subs = subs.join(own.select(F.col("iri").alias("source")), "source", "left_semi").join(own.select(F.col("iri").alias("target")), "target", "left_semi").select("source", "target", "kind")
    edges = ends.unionByName(subs).withColumn("inferred", F.lit(False))
    return Graph(nodes_of(own.union(_ends(edges)).distinct(), catalog), _relations(edges, f))


def import_edges(catalog: Catalog) -> DataFrame:
    return catalog.imports.select(F.col("ontology_id").alias("source"), F.col("import_iri").alias("target")).distinct()


def import_graph(catalog: Catalog, request: Request, closure: bool) -> Graph:
    """Import edges, of all documents or of the roots; with closure, of all that those reach too."""
    edges = import_edges(catalog)
    if request.filters.ontology_iri or request.roots:
        seeds = catalog.spark.createDataFrame([(r,) for r in [*request.roots, *filter(None, [request.filters.ontology_iri])]], "node string")
        if closure:
            seeds = reachable(edges.select(F.col("source").alias("a"), F.col("target").alias("b")), seeds)
        edges = edges.join(seeds.select(F.col("node").alias("source")), "source", "left_semi")
    edges = edges.select("source", "target", F.lit("imports").alias("kind"), F.lit(False).alias("inferred"))
    documents = catalog.documents.select(F.coalesce("base_iri", "id").alias("iri"))
    iris = _ends(edges) if request.filters.ontology_iri or request.roots else _ends(edges).union(documents).distinct()
    nodes = nodes_of(iris, catalog).withColumn("kind", F.lit("ontology"))
    return Graph(nodes, _relations(edges, request.filters))


def individual_adjacency(catalog: Catalog) -> DataFrame:
    ax = catalog.axioms
    types = ax.where("axiom_kind = 'class_assertion'")
    facts = ax.where("axiom_kind = 'object_property_assertion'")
    row = lambda df, s, t, k: df.select(F.col(s).alias("source"), F.col(t).alias("target"), F.lit(k).alias("kind"), F.lit(False).alias("inferred"))
    return row(types, "subject", "object", "type").union(row(types, "object", "subject", "instance")).union(row(facts, "subject", "object", "assertion")).union(row(facts, "object", "subject", "assertion"))


def class_adjacency(catalog: Catalog, inferred: DataFrame | None = None) -> DataFrame:
    """Sub- and superclasses, equivalent IRIs both ways, and the classes named in complex superclasses."""
    row = lambda df, s, t, k, i=False: df.select(F.col(s).alias("source"), F.col(t).alias("target"), F.lit(k).alias("kind"), F.lit(i).alias("inferred"))
    h = catalog.hierarchy()
    out = row(h, "child", "parent", "sub_class_of").union(row(h, "parent", "child", "super_class_of"))
    if inferred is not None:
        out = out.union(row(inferred, "child", "parent", "sub_class_of", True)).union(row(inferred, "parent", "child", "super_class_of", True))
    eq = catalog.axioms.where(F.col("axiom_kind") == "equivalent_class").where(F.col("object").rlike("^https?://\\S+$"))
    out = out.union(row(eq, "subject", "object", "equivalent_class")).union(row(eq, "object", "subject", "equivalent_class"))
    return out.union(row(mentioned_classes(catalog), "subject", "filler", "some_values_from"))


def mentioned_classes(catalog: Catalog) -> DataFrame:
    """subject, filler: classes that a complex superclass names, by IRI or :short_name; tokens make it an equi-join."""
    ax = catalog.axioms.where((F.col("axiom_kind") == "sub_class_of") & ~F.col("object").rlike("^https?://\\S+$"))
    token = F.explode(F.array_distinct(F.regexp_extract_all("object", F.lit(r"[^\s(){}<>,\[\]]+"), F.lit(0))))
    tokens = ax.select("subject", token.alias("token"))
    classes = catalog.entities.where("kind = 'class'").select("iri", "short_name")
    by_iri = tokens.join(classes.select(F.col("iri").alias("token"), F.col("iri").alias("filler")), "token")
    local = tokens.where(F.contains("token", F.lit(":")) & ~F.contains("token", F.lit("://"))).select("subject", F.substring_index("token", ":", -1).alias("short_name"))
    by_name = local.join(classes, "short_name").select("subject", F.col("iri").alias("filler"))
    return by_iri.select("subject", "filler").union(by_name).distinct()


def walk(catalog: Catalog, request: Request, adjacency: DataFrame) -> Graph:
    """Breadth-first from the roots: each entry of a node less than ``depth`` away whose target is allowed is an edge."""
    depth = max(1, min(MAX_DEPTH, request.depth))
    allowed = cut(keep_allowed(adjacency, "target", catalog, request.filters), "adjacency")
    roots = catalog.spark.createDataFrame([(r,) for r in request.roots], "node string")
    seen = bfs(allowed, roots, depth)
    edges = allowed.join(seen.where(F.col("depth") < depth).select(F.col("node").alias("source")), "source", "left_semi").select("source", "target", "kind", "inferred")
    return Graph(nodes_of(seen.select(F.col("node").alias("iri"), "depth"), catalog), _relations(edges, request.filters))


def seeded(catalog: Catalog, request: Request, adjacency: DataFrame, prefix: str) -> Graph:
    graph = walk(catalog, request, adjacency)
    pairs = [(a, b, f"{prefix}_result", False) for a, b in zip(request.roots, request.roots[1:])]
    links = catalog.spark.createDataFrame(pairs, "source string, target string, kind string, inferred boolean")
    return Graph(graph.nodes, graph.edges.union(_relations(links, request.filters)))


def build(catalog: Catalog, request: Request, inferred: DataFrame | None = None) -> Graph:
    kind = request.graph_kind
    if kind not in KINDS:
        raise LatticaError(f"unknown graph_kind: {kind}")
    if kind in ("individual", "neighborhood", "query_result", "refactor_preview") and not request.roots:
        raise LatticaError(f"{kind} graph requires root_iri or root_iris")
    if kind == "class":
        return class_graph(catalog, request, inferred)
    if kind == "property":
        return property_graph(catalog, request)
    if kind in ("object_property", "data_property"):
        return property_graph(catalog, request, (kind,))
    if kind in ("import", "dependency"):
        return import_graph(catalog, request, kind == "dependency")
    if kind == "individual":
        return walk(catalog, request, individual_adjacency(catalog))
    adjacency = class_adjacency(catalog, inferred if request.include_inferred else None)
    if kind == "neighborhood":
        return walk(catalog, request, adjacency)
    return seeded(catalog, request, adjacency, "query" if kind == "query_result" else "refactor")


def result_seeds(frame: DataFrame, limit: int = 200) -> DataFrame:
    """iri: distinct IRIs of a query result, the first so many by order."""
    cells = frame.select(F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in frame.columns])).alias("cell"))
    iri = F.regexp_extract("cell", r"^<?(https?://[^>\s]+|urn:[^>\s]+)>?$", 1)
    return cells.select(iri.alias("iri")).where("iri <> ''").distinct().orderBy("iri").limit(limit)


def text_tree(catalog: Catalog, depth: int | None = None) -> DataFrame:
    """path, level, iri: the hierarchy as lines, from classes without parents, in the order of paths, to its whole depth
    or the one asked for; cycles are cut by not visiting a class twice on one path."""
    edges = cut(catalog.hierarchy(), "tree")
    names = catalog.entities.where("kind = 'class'").select("iri", "short_name")
    roots = names.join(edges.select(F.col("child").alias("iri")).distinct(), "iri", "left_anti")
    level = roots.select("iri", F.col("short_name").alias("path"), F.array("iri").alias("seen"), F.lit(0).alias("level"))
    out = level
    for k in itertools.count(1) if depth is None else range(1, depth):
        below = level.join(edges, level["iri"] == edges["parent"]).where(~F.array_contains("seen", F.col("child"))).select(F.col("child").alias("iri"), "path", "seen")
        level = below.join(names, "iri").select("iri", F.concat_ws("/", "path", "short_name").alias("path"), F.array_append("seen", F.col("iri")).alias("seen"), F.lit(k).alias("level"))
        level = cut(level, "tree")
        if level.isEmpty():
            break
        out = out.union(level)
    return out.select("path", "level", "iri")
