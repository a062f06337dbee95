"""Semantic diff of two catalogs: changes as joins and anti-joins, and what of them breaks users."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.catalog import Catalog
from lattica.model import SAME_AS, SKOS
from lattica.storage import cut

# Predicates that identify a renamed entity.
IDENTITY = [SAME_AS, SKOS + "exactMatch", "owl:sameAs", "skos:exactMatch"]


@dataclass(frozen=True)
class Diff:
    """entities (change, iri, new_iri, kind), annotations, axioms, imports (change and their columns), breaking (code, subject,
    detail), and unsatisfiable (change, iri) where classes were classified."""

    entities: DataFrame
    annotations: DataFrame
    axioms: DataFrame
    imports: DataFrame
    breaking: DataFrame
    unsatisfiable: DataFrame | None = None

    def summary(self) -> DataFrame:
        parts = [("entity", self.entities), ("annotation", self.annotations), ("axiom", self.axioms), ("import", self.imports)]
        rows = [df.groupBy("change").agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "change", "n") for name, df in parts]
        return reduce(DataFrame.unionByName, [*rows, self.breaking.agg(F.count("*").alias("n")).select(F.lit("breaking").alias("part"), F.lit("all").alias("change"), "n")])


def _changed(base: DataFrame, head: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of head without an equal one in base, and the other way round; duplicates stay. Both sides meet in one shuffle."""
    sides = base.select(*columns, F.lit(0).alias("side")).union(head.select(*columns, F.lit(1).alias("side")))
    both = sides.groupBy(*columns).agg(F.count("*").alias("n"), F.min("side").alias("side"), F.max("side").alias("other")).where("side = other")
    change = F.when(F.col("side") == 0, "removed").otherwise("added").alias("change")
    return both.select(*columns, change, F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select(*columns, "change")


def renames(removed: DataFrame, added: DataFrame, links: DataFrame) -> DataFrame:
    """old, new: removed and added IRIs that a new identity link joins, one to one, greedily by old, then new IRI.

    Candidates are the links alone, so there is no product. A pair is taken once it is the least on both of its sides;
    rounds go on until no candidate is left, which equals the greedy pass in order."""
    both = links.select(F.col("subject").alias("x"), F.col("object").alias("y"))
    both = both.union(both.select("y", "x")).distinct()
    left = cut(both.join(removed.select(F.col("iri").alias("x")), "x", "left_semi").join(added.select(F.col("iri").alias("y")), "y", "left_semi").select(F.col("x").alias("old"), F.col("y").alias("new")), "renames")
    taken = left.limit(0)
    while not left.isEmpty():
        first_new = left.groupBy("old").agg(F.min("new").alias("new"))
        first_old = left.groupBy("new").agg(F.min("old").alias("old"))
        now = cut(first_new.join(first_old, ["old", "new"]).select("old", "new"), "renames")
        taken = taken.union(now)
        left = cut(left.join(now.select("old"), "old", "left_anti").join(now.select("new"), "new", "left_anti").select("old", "new"), "renames")
    return taken


def diff_catalogs(base: Catalog, head: Catalog) -> Diff:
    a, b = (c.entities.select("iri", "kind", "deprecated") for c in (base, head))
    added, removed = b.join(a, "iri", "left_anti"), a.join(b, "iri", "left_anti")
    annotations = _changed(base.annotations, head.annotations, ["ontology_id", "subject", "predicate", "object"])
    links = annotations.where((F.col("change") == "added") & F.col("predicate").isin(*IDENTITY))
    moved = cut(renames(removed, added, links), "renamed")
    row = lambda df, change, iri="iri", new=None: df.select(F.lit(change).alias("change"), F.col(iri).alias("iri"), (F.col(new) if new else F.lit(None).cast("string")).alias("new_iri"), "kind")
    deprecated = a.join(b.select("iri", F.col("deprecated").alias("now")), "iri").where(F.coalesce("now", F.lit(False)) & ~F.coalesce("deprecated", F.lit(False)))
    entities = reduce(DataFrame.union, [
        row(added.join(moved.select(F.col("new").alias("iri")), "iri", "left_anti"), "added"),
        row(removed.join(moved.select(F.col("old").alias("iri")), "iri", "left_anti"), "removed"),
        row(deprecated, "deprecated"),
        row(moved.join(removed.select(F.col("iri").alias("old"), "kind"), "old"), "renamed", "old", "new"),
    ])
    axioms = _changed(base.axioms, head.axioms, ["ontology_id", "axiom_kind", "subject", "predicate", "object"])
    imports = _changed(base.imports, head.imports, ["ontology_id", "import_iri"])
    return Diff(entities, annotations, axioms, imports, breaking(entities, axioms, imports))


def breaking(entities: DataFrame, axioms: DataFrame, imports: DataFrame) -> DataFrame:
    gone = axioms.where("change = 'removed'")
    row = lambda df, code, subject, detail: df.select(code.alias("code"), subject.alias("subject"), detail.alias("detail"))
    c, lit = F.col, F.lit
    return reduce(DataFrame.union, [
        row(gone.where("axiom_kind = 'sub_class_of'"), lit("removed_superclass"), c("subject"), c("object")),
        row(gone.where("axiom_kind IN ('domain', 'range')"), lit("domain_range_change"), c("subject"), F.concat_ws(" ", "axiom_kind", "object")),
        row(imports.where("change = 'removed'"), lit("removed_import"), c("ontology_id"), c("import_iri")),
        row(entities.where("change = 'removed'"), lit("removed_entity"), c("iri"), c("kind")),
        row(entities.where("change = 'renamed'"), lit("renamed_iri"), c("iri"), c("new_iri")),
    ]).distinct()


def with_unsatisfiable(diff: Diff, base: DataFrame, head: DataFrame) -> Diff:
    """Adds which classes (iri) became unsatisfiable, which breaks users, or satisfiable."""
    became, ceased = head.select("iri").subtract(base.select("iri")), base.select("iri").subtract(head.select("iri"))
    changes = became.withColumn("change", F.lit("became_unsatisfiable")).union(ceased.withColumn("change", F.lit("became_satisfiable")))
    more = became.select(F.lit("became_unsatisfiable").alias("code"), F.col("iri").alias("subject"), F.lit("").alias("detail"))
    return Diff(diff.entities, diff.annotations, diff.axioms, diff.imports, diff.breaking.union(more), changes)


def round_trip(before: Catalog, after: Catalog) -> DataFrame:
    """aspect, key, change: what a write and a read again changed of entities, labels, parents and imports."""
    labels = lambda c: c.entities.select("iri", F.explode("labels").alias("label"))
    parts = [("entity", [c.entities.select("iri", "kind") for c in (before, after)]), ("label", [labels(c) for c in (before, after)]), ("parent", [c.hierarchy() for c in (before, after)]), ("import", [c.imports.select("import_iri") for c in (before, after)])]
    return reduce(DataFrame.union, [_changed(x, y, x.columns).select(F.lit(name).alias("aspect"), F.concat_ws(" ", *x.columns).alias("key"), "change") for name, (x, y) in parts])


def text_lines(diff: Diff) -> DataFrame:
    """part (0 to 3: entities, axioms, imports, breaking), order (within a part), line of every change."""
    c = lambda name: F.coalesce(name, F.lit("None"))
    lit = F.lit
    of = lambda df, part, order, *line: df.select(lit(part).alias("part"), F.array(*order).alias("order"), F.concat(*line).alias("line"))
    to = F.when(F.coalesce("new_iri", lit("")) != "", F.concat(lit(" -> "), "new_iri")).otherwise("")
    said = of(diff.breaking, 3, ["code", "subject", "detail"], lit("breaking "), c("code"), lit(": "), c("subject"), lit(" "), c("detail"))
    return reduce(DataFrame.union, [
        of(diff.entities, 0, ["change", "iri"], c("change"), lit(" "), c("kind"), lit(": "), c("iri"), to),
        of(diff.axioms, 1, ["change", "subject", "axiom_kind", "object"], c("change"), lit(" axiom: "), c("subject"), lit(" "), c("axiom_kind"), lit(" "), c("object")),
        of(diff.imports, 2, ["change", "import_iri"], c("change"), lit(" import: "), c("ontology_id"), lit(" "), c("import_iri")),
        said.withColumn("line", F.regexp_replace("line", r"\s+$", "")),
    ])


def to_text(diff: Diff, limit: int = 1000) -> str:
    """A text for the eye: at most so many lines of a part."""
    rows = text_lines(diff)
    lines = [r.line for part in range(4) for r in rows.where(F.col("part") == part).orderBy("order").limit(limit).collect()]
    return "\n".join(lines) + "\n" if lines else "no changes\n"


def to_markdown(diff: Diff, entities: int = 50, axioms: int = 30) -> str:
    """A summary for a review: at most so many entities and axioms, and how many there are."""
    counts = {(r.part, r.change): r.n for r in diff.summary().collect()}
    out = ["# Semantic diff", "", "| part | change | count |", "| --- | --- | --- |", *[f"| {p} | {c} | {n} |" for (p, c), n in sorted(counts.items())], "", "## Breaking changes", ""]
    out += [f"- **{r.code}** `{r.subject}` {r.detail}".rstrip() for r in diff.breaking.orderBy("code", "subject", "detail").limit(entities).collect()] or ["none"]
    for title, frame, most, render in (("Entities", diff.entities.orderBy("change", "iri"), entities, lambda r: f"- {r.change} {r.kind} `{r.iri}`" + (f" → `{r.new_iri}`" if r.new_iri else "")), ("Axioms", diff.axioms.orderBy("change", "subject", "axiom_kind", "object"), axioms, lambda r: f"- {r.change} {r.axiom_kind} `{r.subject}` {r.object}")):
        rows = frame.limit(most + 1).collect()
        out += ["", f"## {title}", "", *([render(r) for r in rows[:most]] or ["none"]), *(["- ..."] if len(rows) > most else [])]
    return "\n".join(out) + "\n"


def to_json(diff: Diff) -> DataFrame:
    parts = [("entities", diff.entities), ("annotations", diff.annotations), ("axioms", diff.axioms), ("imports", diff.imports), ("breaking", diff.breaking)]
    return reduce(DataFrame.union, [df.select(F.lit(n).alias("part"), F.to_json(F.struct(*df.columns)).alias("json")) for n, df in parts])
