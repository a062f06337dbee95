"""The library's front: a workspace of files, its catalog, and what can be asked of it."""

from __future__ import annotations

from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica import sinks
from lattica.catalog import Catalog
from lattica.operators import diagnostics, diff, graph, reason, usages
from lattica.plans.sparql import run_sparql
from lattica.plans.sqlgate import QueryResult, list_sql_tables, run_sql
from lattica.plugins import Registry
from lattica.sources import scan
from lattica.sources.incremental import SnapshotStore, fingerprint, reuse_plan
from lattica.storage import cancel, cancellable, cut


#: Classifications kept for a workspace's recent states.
KEPT = 8


class Workspace:
    def __init__(self, spark: SparkSession, roots: list[str], config: dict | None = None, store: str | None = None):
        """store: a folder for parsed documents by content; what another configuration stored is not used."""
        self.spark, self.roots, self.config = spark, roots, config
        self.store = SnapshotStore(spark, f"{store.rstrip('/')}/{fingerprint(config or {})}") if store else None
        self.classified: OrderedDict[tuple, reason.Classification] = OrderedDict()
        self.plugins = Registry()
        self.files: DataFrame | None = None
        self.parsed: DataFrame | None = None
        self.catalog: Catalog = self.reindex()

    @staticmethod
    def open(spark: SparkSession, *roots: str) -> Workspace:
        return Workspace(spark, list(roots))

    def _files(self, overrides: DataFrame | None = None) -> DataFrame:
        return cut(scan.described(scan.scan_files(self.spark, self.roots), overrides), "files")

    def reindex(self, overrides: DataFrame | None = None) -> Catalog:
        self.files = self._files(overrides)
        self.parsed = self._parsed(self.files)
        self.catalog = scan.assemble(self.spark, self.files, self.parsed, config=self.config)
        return self.catalog

    def reindex_incremental(self, overrides: DataFrame | None = None) -> DataFrame:
        """Parses only files whose content changed; the catalog is the one a full index gives. Returns states and counts."""
        files = self._files(overrides)
        plan = cut(reuse_plan(files, self.files), "reuse")
        fresh = plan.where("state = 'reparsed'").select("path")
        old = self.parsed.join(plan.where("state = 'reused'").select("path"), "path", "left_semi").join(files.select("path", F.col("doc_order").alias("now")), "path")
        self.parsed = cut(_moved(old).unionByName(scan.parse_files(files.join(fresh, "path", "left_semi"))), "parsed")
        self.files = files
        self.catalog = scan.assemble(self.spark, files, self.parsed, config=self.config)
        return plan.groupBy("state").agg(F.count("*").alias("n"))

    def _parsed(self, files: DataFrame) -> DataFrame:
        """Rows of all files: those of contents that the store holds are read, the rest parsed and stored."""
        if self.store is None:
            return cut(scan.parse_files(files), "parsed")
        known = self.store.hashes()
        held = files.join(known, "content_hash", "left_semi") if known is not None else files.limit(0)
        fresh = cut(scan.parse_files(files.join(held.select("path"), "path", "left_anti")), "parsed")
        parts = fresh
        if known is not None:
            at = held.select("content_hash", F.col("path").alias("new_path"), F.col("doc_order").alias("now"))
            parts = parts.unionByName(_moved(self.store.get(held).join(at, "content_hash").withColumn("path", F.col("new_path"))).select(parts.columns))
        out = cut(parts, "parsed")
        once = files.groupBy("content_hash").agg(F.min("path").alias("path"))
        if not fresh.isEmpty():
            self.store.put(fresh.join(once, "path"))
        return out

    def prune_snapshots(self) -> int:
        """Removes stored documents whose content no file has now."""
        return self.store.prune(self.files) if self.store is not None else 0

    def stats(self) -> DataFrame:
        return self.catalog.stats()

    def import_graph(self) -> graph.Graph:
        return graph.build(self.catalog, graph.Request("import"))

    def graph(self, request: graph.Request) -> graph.Graph:
        return graph.build(self.catalog, request)

    def diagnostics(self) -> DataFrame:
        own = self.catalog.diagnostics if self.catalog.diagnostics is not None else diagnostics.collect(self.catalog, self.config)
        return own.unionByName(self.plugins.validate(self.catalog))

    def query(self, sql: str, permissive: bool = False) -> QueryResult:
        return run_sql(self.catalog, sql, permissive)

    def schema(self) -> list[dict]:
        return list_sql_tables()

    def sparql(self, text: str) -> QueryResult:
        return run_sparql(self.catalog, text)

    def diff(self, head: Catalog) -> diff.Diff:
        return diff.diff_catalogs(self.catalog, head)

    def diff_git(self, repo: str, range_: str) -> diff.Diff:
        base, head = scan.git_range(repo, range_)
        load = lambda ref: scan.index_texts(self.spark, scan.git_texts(repo, ref), lint=False) if ref else scan.index(self.spark, [repo], lint=False)
        return diff.diff_catalogs(load(base), load(head))

    def classify(self, profile: str = "rl") -> reason.Classification:
        """Kept by what the files hold and the profile, for the KEPT last asked for."""
        state = self.files.agg(F.count("*"), F.sum(F.xxhash64("path", "content_hash").cast("decimal(20,0)"))).first()
        key = (*state, profile)
        if key not in self.classified:
            self.classified[key] = reason.classify(self.catalog, profile)
        self.classified.move_to_end(key)
        while len(self.classified) > KEPT:
            self.classified.popitem(last=False)
        return self.classified[key]

    def classify_now(self, profile: str = "rl", tag: str = "classify") -> reason.Classification:
        """The same, all of it worked out at once, so that ``cancel(tag)`` from another thread can end it."""
        with cancellable(self.spark, tag):
            result = reason.Classification(self.catalog, profile)
            for part in (result.edges, result.unsatisfiable, result.equivalences, result.inferred):
                part.count()
            return result

    def cancel(self, tag: str = "classify") -> None:
        cancel(self.spark, tag)

    def explain(self, iri: str, most: int = 1) -> list[list[str]]:
        return reason.explain(self.catalog, iri, most)

    def dl_query(self, expression: str, **options) -> dict[str, DataFrame]:
        return reason.dl_query(self.catalog, expression, **options)

    def usages(self, iri: str) -> DataFrame:
        return usages.find_usages(self.catalog, iri)

    def search(self, term: str, limit: int | None = 100) -> DataFrame:
        return self.catalog.search(term, limit)

    def snapshot(self) -> dict[str, DataFrame]:
        return {"documents": self.catalog.documents, "entities": self.catalog.entities, "hierarchy": self.catalog.hierarchy(), "diagnostics": self.diagnostics(), "stats": self.stats()}

    def export_docs(self, folder: str, form: str = "markdown") -> int:
        return sinks.write_pages(self.catalog, folder, form)


def _moved(rows: DataFrame) -> DataFrame:
    """Parsed rows at the position ``now``; blank nodes are named by position."""
    rename = lambda c: F.regexp_replace(c, r"^doc-\d+_", F.concat(F.lit("doc-"), F.col("now").cast("string"), F.lit("_")))
    of = lambda c, kind: F.when((F.col("row") == "quad") & (F.col(kind) == "bnode"), rename(F.col(c))).otherwise(F.col(c))
    names = [c.split()[0] for c in scan._PARSED.split(", ")]
    return rows.withColumn("a", of("a", "b")).withColumn("d", of("d", "e")).withColumn("doc_order", F.col("now")).select(*names)
