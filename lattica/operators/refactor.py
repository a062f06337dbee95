"""Changes as plans: which rows and lines an edit touches, and the catalog after it. Deltas of rows apply and invert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.catalog import Catalog, merge_entities
from lattica.functions import exprs as X
from lattica.model import DEPRECATED
from lattica.operators.usages import module, module_axioms, text_usages
from lattica.storage import cut

_ROWS = {"entities": ["iri", "ontology_id"], "axioms": ["subject", "predicate", "object", "ontology_id"], "annotations": ["subject", "predicate", "object", "ontology_id"], "imports": ["ontology_id", "import_iri"]}


def _in_text(c: Column, old: str, new: str) -> Column:
    """Whole tokens of an expression only."""
    changed = F.regexp_replace(c, rf"(?<![^\s(){{}},<])\Q{old}\E(?![^\s(){{}},>])", new.replace("\\", "\\\\").replace("$", "\\$"))
    return F.when(F.contains(c, F.lit(old)), changed).otherwise(c)


def rewrite(catalog: Catalog, change) -> Catalog:
    """Every IRI of the catalog through a column function; entities that become one are merged."""
    e = catalog.entities.withColumn("iri", change(F.col("iri"))).withColumn("short_name", X.short_name("iri")).withColumn("doc_order", F.lit(0))
    ax, an = catalog.axioms, catalog.annotations
    for c in ("subject", "predicate", "object"):
        ax, an = ax.withColumn(c, change(F.col(c))), an.withColumn(c, change(F.col(c)))
    quads = catalog.quads.withColumn("s", change(F.col("s"))).withColumn("p", change(F.col("p"))).withColumn("o", F.when(F.col("o_kind") == "literal", F.col("o")).otherwise(change(F.col("o"))))
    return catalog.with_(entities=merge_entities(e).select(*catalog.entities.columns), axioms=ax.dropDuplicates(["ontology_id", "axiom_kind", "subject", "predicate", "object"]), annotations=an.distinct(), quads=quads.distinct())


def rename(catalog: Catalog, old: str, new: str) -> Catalog:
    return rewrite(catalog, lambda c: _in_text(c, old, new))


def merge(catalog: Catalog, keep: str, gone: str) -> Catalog:
    """One entity takes over all that another had; self-references that come of it go."""
    out = rename(catalog, gone, keep)
    return out.with_(axioms=out.axioms.where("NOT (axiom_kind IN ('sub_class_of', 'equivalent_class') AND subject = object)"))


def replace(catalog: Catalog, old: str, new: str) -> Catalog:
    """References move to another entity; the old one stays and is marked deprecated."""
    ax = catalog.axioms.withColumn("object", _in_text(F.col("object"), old, new))
    an = catalog.annotations.withColumn("object", _in_text(F.col("object"), old, new))
    own = catalog.entities.where(F.col("iri") == old).select(F.col("iri").alias("subject"), F.lit(DEPRECATED).alias("predicate"), F.lit("true").alias("object"), "ontology_id")
    e = catalog.entities.withColumn("deprecated", F.coalesce("deprecated", F.lit(False)) | (F.col("iri") == old))
    return catalog.with_(entities=e, axioms=ax, annotations=an.unionByName(own))


def migrate_namespace(catalog: Catalog, old: str, new: str) -> Catalog:
    def change(c: Column) -> Column:
        return F.when(F.startswith(c, F.lit(old)), X.remap_iri(c, old, new)).otherwise(F.regexp_replace(c, rf"(?<![^\s(){{}},<])\Q{old}\E", new.replace("\\", "\\\\").replace("$", "\\$")))

    return rewrite(catalog, change)


def move_entity(catalog: Catalog, iri: str, ontology_id: str) -> Catalog:
    """An entity with its axioms and annotations to another document."""
    to = lambda df, key: df.withColumn("ontology_id", F.when(F.col(key) == iri, ontology_id).otherwise(F.col("ontology_id")))
    return catalog.with_(entities=to(catalog.entities, "iri"), axioms=to(catalog.axioms, "subject"), annotations=to(catalog.annotations, "subject"))


def move_axioms(catalog: Catalog, ids: DataFrame, ontology_id: str) -> Catalog:
    marked = catalog.axioms.join(ids.select("id", F.lit(True).alias("__move")), "id", "left")
    return catalog.with_(axioms=marked.withColumn("ontology_id", F.when(F.col("__move"), ontology_id).otherwise(F.col("ontology_id"))).select(*catalog.axioms.columns))


def extract_module(catalog: Catalog, seeds: DataFrame) -> Catalog:
    iris = cut(module(catalog, seeds), "module")
    return catalog.with_(entities=catalog.entities.join(iris, "iri", "left_semi"), axioms=module_axioms(catalog, iris, lazy=True), annotations=catalog.annotations.join(iris.select(F.col("iri").alias("subject")), "subject", "left_semi"))


def flatten_imports(catalog: Catalog, ontology_iri: str) -> tuple[Catalog, DataFrame]:
    """One ontology with all that it imports as its own rows, and warnings."""
    from lattica.operators.usages import import_closure

    inside, warnings = import_closure(catalog, ontology_iri)
    own = lambda df: df.withColumn("__key", X.normalize_iri("ontology_id")).join(inside.select(F.col("ontology_iri").alias("__key")), "__key", "left_semi").drop("__key").withColumn("ontology_id", F.lit(ontology_iri))
    return catalog.with_(entities=own(catalog.entities), axioms=own(catalog.axioms).dropDuplicates(["axiom_kind", "subject", "predicate", "object"]), annotations=own(catalog.annotations).distinct(), imports=catalog.imports.limit(0)), warnings


def merge_ontologies(catalog: Catalog, sources: list[str], target: str) -> Catalog:
    to = lambda df: df.withColumn("ontology_id", F.when(F.col("ontology_id").isin(*sources), target).otherwise(F.col("ontology_id")))
    imports = to(catalog.imports).where("ontology_id <> import_iri").where(~F.col("import_iri").isin(*sources)).distinct()
    return catalog.with_(entities=to(catalog.entities), axioms=to(catalog.axioms), annotations=to(catalog.annotations), imports=imports)


def plan(before: Catalog, after: Catalog) -> DataFrame:
    """part, op (add, remove), row (JSON): what changes, as a delta that ``apply`` takes."""
    out = []
    for part, columns in _ROWS.items():
        columns = ["axiom_kind", *columns] if part == "axioms" else columns
        a, b = getattr(before, part).select(*columns), getattr(after, part).select(*columns)
        # Both sides meet in one shuffle; what is left of a row's count is added or removed as often.
        both = a.withColumn("n", F.lit(-1)).union(b.withColumn("n", F.lit(1))).groupBy(*columns).agg(F.sum("n").alias("n")).where("n <> 0")
        each = both.select(*columns, "n", F.explode(F.sequence(F.lit(1), F.abs("n").cast("int"))).alias("copy"))
        out.append(each.select(F.lit(part).alias("part"), F.when(F.col("n") > 0, "add").otherwise("remove").alias("op"), F.to_json(F.struct(*columns)).alias("row")))
    return reduce(DataFrame.union, out)


def metrics(delta: DataFrame) -> DataFrame:
    return delta.groupBy("part", "op").agg(F.count("*").alias("n"))


def invert(delta: DataFrame) -> DataFrame:
    return delta.withColumn("op", F.when(F.col("op") == "add", "remove").otherwise("add"))


def apply(catalog: Catalog, delta: DataFrame) -> Catalog:
    """Axioms, annotations and imports after a delta: an anti-join and a union for each part."""
    frames = {}
    for part in ("axioms", "annotations", "imports"):
        df = getattr(catalog, part)
        keys = (["axiom_kind"] if part == "axioms" else []) + _ROWS[part]
        kind = df.select(*keys).schema.simpleString()
        rows = lambda op: delta.where((F.col("part") == part) & (F.col("op") == op)).select(F.from_json("row", kind).alias("r")).select("r.*")  # noqa: B023, E731
        same = [df[k].eqNullSafe(F.col(f"__{k}")) for k in keys]
        gone = rows("remove").select(*[F.col(k).alias(f"__{k}") for k in keys])
        kept = df.join(gone, reduce(Column.__and__, same), "left_anti")
        frames[part] = kept.unionByName(rows("add"), allowMissingColumns=True)
    return catalog.with_(**frames)


def preview(catalog: Catalog, old: str, new: str) -> DataFrame:
    """file, line, old, new of the text lines that a rename touches."""
    hits = text_usages(catalog, old).select("file", "line").distinct()
    lines = catalog.texts.select(F.col("path").alias("file"), F.posexplode(F.split("text", "\n")).alias("n", "old")).withColumn("line", (F.col("n") + 1).cast("bigint"))
    local_old, local_new = (x.rstrip("/").rpartition("#")[2].rpartition("/")[2] for x in (old, new))
    changed = F.regexp_replace(X.replace_iri_in_text("old", old, new), rf"(?<=:)\Q{local_old}\E(?![\w-])", local_new)
    return lines.join(hits, ["file", "line"]).select("file", "line", "old", changed.alias("new"))
