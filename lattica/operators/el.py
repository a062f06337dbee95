"""Classification in EL: axioms in normal form, saturated by rounds of joins, and proofs read backwards from the result.

The normal form has seven kinds of rows over names (classes, and expressions by their text): sub (a below b), and (a and b
below c), link (a below b some c), need (a some b below c), domain (a some Thing below b), role (a below b), chain (a o b
below c). Expressions are named by their own text, so rows of different axioms share them without a meeting; only the rows
that tie a name to an axiom carry that axiom. Disjoint classes, ``not``, ``only Nothing`` and ``max 0`` are rows that end in
owl:Nothing; ranges narrow the fillers of links. What EL can't say is reported, not guessed.

Two tables grow: S (x, c: x is below c) and L (x, r, y: each x has an r that is a y). Names are numbers while they grow. The
told hierarchy is closed by doubling first, so rounds follow the depth of the roles, not that of the classes; each round
joins what the last one found. Roles of one table that many classes share are left to adaptive skew joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.catalog import Catalog
from lattica.functions import exprs as X
from lattica.functions import manchester
from lattica.model import NOTHING, THING
from lattica.operators.fixpoint import MAX_ROUNDS, closure
from lattica.storage import Grown, cut

ROW = "form string, a string, b string, c string, axiom string"
#: Kinds of axioms that are read, and those that say nothing about classes.
READ = {"sub_class_of", "equivalent_class", "disjoint_class", "disjoint_union", "domain", "range", "sub_object_property_of", "sub_data_property_of", "equivalent_object_properties", "equivalent_data_properties", "property_chain"}
ASIDE = {"class_assertion", "object_property_assertion", "data_property_assertion", "negative_object_property_assertion", "negative_data_property_assertion", "same_individual", "different_individuals", "has_key", "datatype_definition"}
#: Sets of axioms that are kept for each step of a proof.
KEPT = 16


class _NotEL(Exception):
    pass


def _canonical(t: tuple) -> tuple:
    """Parts in order, without repetition; owl:Thing is no part; what means the same is written the same."""
    kind = t[0]
    if kind in ("and", "or"):
        parts = []
        for x in map(_canonical, t[1]):
            parts += x[1] if x[0] == kind else [x]
        named = {manchester.render(x, plain=True): x for x in parts if kind == "or" or x != ("class", THING)}
        parts = [named[k] for k in sorted(named)] or [("class", THING)]
        return parts[0] if len(parts) == 1 else (kind, parts)
    if kind == "not":
        return ("not", _canonical(t[1]))
    if kind in ("some", "only"):
        return (kind, t[1], _canonical(t[2]))
    if kind == "value":
        return ("some", t[1], ("one_of", [t[2][1]]))
    if kind in ("min", "max", "exactly"):
        filler = _canonical(t[3]) if t[3] else ("class", THING)
        if kind == "min" and t[1] == 1:
            return ("some", t[2], filler)
        if kind != "min" and t[1] == 0:
            return ("not", ("some", t[2], filler))
        return (kind, t[1], t[2], filler)
    if t[0] == "one_of" and len(t[1]) > 1:
        return _canonical(("or", [("one_of", [x]) for x in t[1]]))
    return t


class Normal:
    """Rows of one axiom."""

    def __init__(self, axiom: str):
        self.axiom, self.rows = axiom, []

    def add(self, form: str, a: str, b: str = "", c: str = "", told: bool = True) -> None:
        self.rows.append((form, a, b, c, self.axiom if told else None))

    def name(self, t: tuple) -> str:
        return manchester.render(t, plain=True)

    def role(self, r: str) -> str:
        if r.startswith("inverse "):
            raise _NotEL("inverse")
        return r

    def left(self, t: tuple) -> str:
        """A name above the expression, by definitions."""
        kind = t[0]
        if kind in ("class", "datatype") or kind == "one_of" and len(t[1]) == 1:
            return self.name(t)
        if kind == "and":
            so_far = self.left(t[1][0])
            for k, x in enumerate(t[1][1:]):
                whole = self.name(("and", t[1][: k + 2]))
                self.add("and", so_far, self.left(x), whole, told=False)
                so_far = whole
            return so_far
        if kind == "or":
            for x in t[1]:
                self.add("sub", self.left(x), self.name(t), told=False)
            return self.name(t)
        if kind == "some":
            role, filler = self.role(t[1]), self.left(t[2])
            self.add(*(("domain", role, self.name(t)) if filler == THING else ("need", role, filler, self.name(t))), told=False)
            return self.name(t)
        raise _NotEL(kind)

    def right(self, t: tuple) -> str:
        """A name below the expression, by definitions; parts that aren't EL are noted and left out."""
        kind = t[0]
        if kind in ("class", "datatype") or kind == "one_of" and len(t[1]) == 1:
            return self.name(t)
        own = self.name(t)
        try:
            if kind == "and":
                for x in t[1]:
                    self.add("sub", own, self.right(x), told=False)
            elif kind == "some":
                self.add("link", own, self.role(t[1]), self.right(t[2]), told=False)
            elif kind == "not":
                self.add("and", own, self.left(t[1]), NOTHING, told=False)
            elif kind == "only" and t[2] == ("class", NOTHING):
                self.add("and", own, self.left(("some", t[1], ("class", THING))), NOTHING, told=False)
            else:
                if kind in ("min", "exactly"):
                    self.add("link", own, self.role(t[2]), self.right(t[3]), told=False)
                raise _NotEL(kind)
        except _NotEL as e:
            self.add("note", str(e))
        return own

    def axiom_rows(self, kind: str, s: str, o: str) -> list[tuple]:
        try:
            if kind == "property_chain":
                parts = o.split(" o ")
                if any(x.startswith("inverse ") for x in parts):
                    raise _NotEL("inverse")
                if len(parts) == 1:
                    self.add("role", parts[0], s)
                else:
                    for k in range(1, len(parts)):
                        last = k == len(parts) - 1
                        self.add("chain", " o ".join(parts[:k]), parts[k], s if last else " o ".join(parts[: k + 1]), told=last)
                return self.rows
            if kind == "disjoint_union":
                members = o.split(" | ")
                for k, x in enumerate(members):
                    part = self.left(_canonical(manchester.parse(x)))
                    self.add("sub", part, s)
                    if k:
                        # Linear: each member is disjoint with all before it together.
                        self.add("and", part, f"{s} before {k}", NOTHING)
                        self.add("sub", f"{s} before {k}", f"{s} before {k + 1}")
                    self.add("sub", part, f"{s} before {k + 1}")
                raise _NotEL("or")
            tree = _canonical(manchester.parse(o))
            if kind == "sub_class_of":
                self.add("sub", s, self.right(tree))
            elif kind == "equivalent_class":
                self.add("sub", s, self.right(tree))
                self.add("sub", self.left(tree), s)
            elif kind == "disjoint_class":
                self.add("and", s, self.left(tree), NOTHING)
            elif kind == "domain":
                self.add("domain", s, self.right(tree))
            elif kind == "range":
                self.add("sub", f"range {s}", self.right(tree))
        except (_NotEL, manchester.ManchesterError) as e:
            self.add("note", str(e) if isinstance(e, _NotEL) else "unreadable")
        return self.rows


def normal_form(catalog: Catalog) -> DataFrame:
    """form, a, b, c, axiom (text; null for definitions); form note: a kind of expression that was left out, with its axiom."""
    ax = catalog.axioms.where(F.col("axiom_kind").isin(*READ)).select(F.col("axiom_kind").alias("kind"), F.col("subject").alias("s"), F.col("object").alias("o"))
    simple = ~F.col("o").rlike(r"[\s(){}\[\]]")
    both_ways = simple & F.col("kind").isin("equivalent_class", "disjoint_class", "equivalent_object_properties", "equivalent_data_properties")
    first, second = F.when(both_ways, F.least("s", "o")).otherwise(F.col("s")), F.when(both_ways, F.greatest("s", "o")).otherwise(F.col("o"))
    ax = ax.select("kind", "s", "o", F.concat_ws(" ", first, X.axiom_label("kind"), second).alias("axiom"), (simple & ~F.col("kind").isin("property_chain", "disjoint_union")).alias("simple"))
    ax = cut(ax.distinct(), "el-axioms")
    plain = ax.where("simple")

    def rows(kinds: str, form: str, a: str, b: str, c: Column | None = None) -> DataFrame:
        return plain.where(F.col("kind").isin(*kinds.split())).select(F.lit(form).alias("form"), F.expr(a).alias("a"), F.expr(b).alias("b"), (c if c is not None else F.lit("")).alias("c"), "axiom")

    roles = "sub_object_property_of sub_data_property_of equivalent_object_properties equivalent_data_properties"
    own = [
        rows("sub_class_of equivalent_class", "sub", "s", "o"), rows("equivalent_class", "sub", "o", "s"),
        rows("disjoint_class", "and", "least(s, o)", "greatest(s, o)", F.lit(NOTHING)), rows("domain", "domain", "s", "o"),
        rows("range", "sub", "concat('range ', s)", "o"), rows(roles, "role", "s", "o"), rows("equivalent_object_properties equivalent_data_properties", "role", "o", "s"),
    ]
    flag = lambda name, form, b: catalog.entities.where(F.col(f"characteristics.{name}")).select(F.lit(form).alias("form"), F.col("iri").alias("a"), F.col(b).alias("b"), F.col(b).alias("c"), F.concat_ws(" ", F.col("iri"), F.lit("Characteristics"), F.lit(name.capitalize())).alias("axiom"))
    own += [flag("transitive", "chain", "iri"), flag("reflexive", "reflexive", "iri")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [r for kind, s, o, axiom in zip(*(c.to_pylist() for c in batch.columns)) for r in Normal(axiom).axiom_rows(kind, s, o)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (zip(*out) if out else [[]] * 5)], names=["form", "a", "b", "c", "axiom"])

    out = reduce(DataFrame.union, own).union(ax.where("NOT simple").select("kind", "s", "o", "axiom").mapInArrow(run, ROW)).distinct()
    out = out.where(~((F.col("form") == "sub") & ((F.col("a") == F.col("b")) | (F.col("b") == THING) | (F.col("a") == NOTHING))))
    return _with_ranges(cut(out, "el-rows"))


def _with_ranges(rows: DataFrame) -> DataFrame:
    """A link's filler is also in the ranges of its role and of all roles above."""
    ranged = rows.where("form = 'sub' AND a LIKE 'range %'").select(F.substring("a", 7, 1 << 30).alias("b")).distinct()
    if ranged.isEmpty():
        return rows
    roles = rows.where("form = 'role'")
    below = closure(roles.select("a", "b")).join(ranged, "b", "left_semi").select("a").union(ranged).distinct()
    names = F.broadcast(below) if below.count() <= 100_000 else below
    is_link = F.col("form") == "link"
    links = rows.where(is_link).join(names.select(F.col("a").alias("role"), F.lit(True).alias("ranged")), F.col("b") == F.col("role"), "left").drop("role")
    narrow = F.concat_ws(" in ", "c", "b")
    moved = links.select("form", "a", "b", F.when(F.col("ranged"), narrow).otherwise(F.col("c")).alias("c"), "axiom")
    of = links.where("ranged")
    sub = lambda df, a, b, axiom: df.select(F.lit("sub"), a, b, F.lit(""), axiom)
    none = F.lit(None).cast("string")
    more = [sub(of, narrow, F.col("c"), none), sub(of, narrow, F.concat(F.lit("range "), "b"), none), sub(roles, F.concat(F.lit("range "), "a"), F.concat(F.lit("range "), "b"), F.col("axiom"))]
    return cut(reduce(DataFrame.union, [rows.where(~is_link), moved, *more]).where(f"NOT (form = 'sub' AND b = '{THING}')").distinct(), "el-rows")


@dataclass
class Saturated:
    """Normal-form rows (a, b, c and axiom as numbers), names (name, id), axioms (axiom, id), S (x, c) and L (x, r, y)."""

    rows: DataFrame
    names: DataFrame
    axioms: DataFrame
    notes: DataFrame
    S: DataFrame
    L: DataFrame
    thing: int
    nothing: int

    def named(self) -> DataFrame:
        """id, name of classes; not of expressions."""
        return self.names.where(~F.col("name").rlike(r"[\s{]"))

    @cached_property
    def unsatisfiable(self) -> DataFrame:
        return self.S.where(F.col("c") == self.nothing).join(self.named().select(F.col("id").alias("x"), F.col("name").alias("iri")), "x").select("iri").where(F.col("iri") != NOTHING)

    @cached_property
    def edges(self) -> DataFrame:
        """child, parent of all entailed subsumptions between different named classes, but for owl:Thing and owl:Nothing."""
        n = self.named().where(~F.col("name").isin(THING, NOTHING))
        x = self.S.where("x <> c").join(n.select(F.col("id").alias("x"), F.col("name").alias("child")), "x")
        return cut(x.join(n.select(F.col("id").alias("c"), F.col("name").alias("parent")), "c").select("child", "parent"), "el-edges")


def _numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    return cut(df.select(F.col(column)).where(F.col(column).isNotNull()).distinct().withColumn("id", F.monotonically_increasing_id() + 1), name)


def saturate(catalog: Catalog) -> Saturated:
    spark, text = catalog.spark, normal_form(catalog)
    notes, text = text.where("form = 'note'"), text.where("form <> 'note'")
    all_names = text.select(F.explode(F.array("a", "b", "c")).alias("name")).where("name <> ''").union(spark.createDataFrame([(THING,), (NOTHING,)], "name string"))
    names, axioms = _numbered(all_names, "name", "el-names"), _numbered(text, "axiom", "el-texts")
    known = {r.name: r.id for r in names.where(F.col("name").isin(THING, NOTHING)).collect()}
    thing, nothing = known[THING], known[NOTHING]
    rows = text
    for column in "abc":
        rows = rows.join(names.select(F.col("name").alias(column), F.col("id").alias(f"{column}_id")), column, "left")
    rows = rows.join(axioms.withColumnRenamed("id", "axiom_id"), "axiom", "left")
    rows = cut(rows.select("form", F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.col("c_id").alias("c"), F.col("axiom_id").alias("axiom")), "el-numbers")
    count = {r.form: r["count"] for r in rows.groupBy("form").count().collect()}
    of = lambda form: rows.where(F.col("form") == form).select("a", "b", "c").distinct()

    sub, links, needs, domains, chains = of("sub").select("a", "b"), of("link"), of("need"), of("domain").select("a", "b"), of("chain")
    ands = of("and")
    ands = cut(ands.union(ands.select("b", "a", "c")).distinct(), "el-ands")
    above = closure(sub)
    above = cut(above.where("a <> b"), "el-above")
    super_roles = of("role").select("a", "b")
    super_roles = closure(super_roles).where("a <> b") if count.get("role") else super_roles
    roles = cut(of("role").select(F.explode(F.array("a", "b")).alias("a")).union(links.select("b")).union(chains.select("c")).union(of("reflexive").select("a")).distinct(), "el-roles")
    super_roles = cut(super_roles.union(roles.select("a", F.col("a").alias("b"))).distinct(), "el-super-roles")

    subjects = names.where(~F.col("name").rlike(r"[\s{]")).select("id").union(links.select("c")).distinct().select(F.col("id").alias("x"))
    # Role names stand there too: no row has them as a class, so nothing follows for them.
    first = subjects.select("x", F.col("x").alias("c"))
    if not rows.where((F.col("a") == thing) & F.col("form").isin("sub", "and", "link") | (F.col("b") == thing) & (F.col("form") == "and")).isEmpty():
        first = first.union(subjects.select("x", F.lit(thing).alias("c")))

    def closed(found: DataFrame) -> DataFrame:
        return found.union(found.join(above, found["c"] == above["a"]).select("x", F.col("b").alias("c")))

    new = cut(closed(first).distinct(), "el-s")
    S = Grown(new, "el-s")
    empty = cut(spark.createDataFrame([], "x bigint, r bigint, y bigint"), "el-l")
    L, N = Grown(empty, "el-l"), Grown(empty, "el-n")
    reflexive = of("reflexive").select(F.col("a").alias("r"))
    new_links = empty
    for round_ in range(MAX_ROUNDS):
        known_links = L.frame
        found = [new.join(links, new["c"] == links["a"]).select("x", F.col("b").alias("r"), links["c"].alias("y"))]
        if count.get("reflexive") and round_ == 0:
            found.append(subjects.join(reflexive.withColumn("k", F.lit(1)), F.lit(1) == F.col("k")).select("x", "r", F.col("x").alias("y")))
        if count.get("chain") and round_:
            x = lambda df: df.select("x", F.col("r").alias("a"), F.col("y").alias("m"))
            y = lambda df: df.select(F.col("x").alias("m"), F.col("r").alias("b"), "y")
            found += [x(u).join(chains, "a").join(y(v), ["m", "b"]).select("x", F.col("c").alias("r"), "y") for u, v in ((new_links, known_links), (known_links, new_links))]
        wide = reduce(DataFrame.union, found).join(super_roles.withColumnRenamed("a", "r"), "r").select("x", F.col("b").alias("r"), "y")
        more = cut(wide.distinct().join(known_links, ["x", "r", "y"], "left_anti"), "el-l")
        known_needs = N.frame
        wanted = new.join(needs, new["c"] == needs["b"]).select("x", F.col("a").alias("r"), needs["c"].alias("y")).distinct()
        new_needs = cut(wanted.join(known_needs, ["x", "r", "y"], "left_anti"), "el-n")
        # needs (x, r, y): what has an r to an x is a y
        has = lambda a, b: a.join(b.select(F.col("x").alias("y"), "r", F.col("y").alias("c")), ["y", "r"]).select("x", "c")
        impossible = lambda df: df.where(F.col("c") == nothing).select(F.col("x").alias("y"))
        said = S.frame
        got = [has(more, known_needs.union(new_needs)), has(known_links, new_needs), more.join(domains, more["r"] == domains["a"]).select("x", F.col("b").alias("c"))]
        got += [df.join(impossible(s), "y", "left_semi").select("x", F.lit(nothing).alias("c")) for df, s in ((more, said), (known_links, new))]
        got.append(new.select("x", F.col("c").alias("a")).join(ands.withColumnRenamed("c", "to"), "a").join(said.select("x", F.col("c").alias("b")), ["x", "b"]).select("x", F.col("to").alias("c")))
        new = cut(closed(reduce(DataFrame.union, got)).distinct().join(said, ["x", "c"], "left_anti"), "el-s")
        L.add(more)
        N.add(new_needs)
        if new.isEmpty() and (more.isEmpty() or not count.get("chain")):
            return Saturated(rows, names, axioms, notes, said, L.frame, thing, nothing)
        S.add(new)
        new_links = more
    raise RuntimeError(f"no fixpoint after {MAX_ROUNDS} rounds")


def warnings(catalog: Catalog, notes: DataFrame, profile: str = "el") -> list[str]:
    """What was said and is not decided; nothing of what EL can say."""
    counts = {r.axiom_kind: r["count"] for r in catalog.axioms.groupBy("axiom_kind").count().collect()}
    out = [f"{profile}: {n} axioms of kind {k} are not used" for k, n in sorted(counts.items()) if k not in READ | ASIDE]
    left_out = notes.groupBy("a").agg(F.count_distinct("axiom").alias("n")).orderBy("a").collect()
    return out + [f"{profile}: {r.n} axioms with {r.a} are used in part only" for r in left_out]


# -- proofs

def _key(kind: str, *columns: str) -> Column:
    return F.concat_ws(":", F.lit(kind), *columns)


def _least_sets(sets: Column) -> Column:
    """Of an array of sorted sets: the KEPT smallest of those that contain no other."""
    ordered = F.transform(F.array_sort(F.array_distinct(F.transform(sets, lambda s: F.struct(F.size(s).alias("n"), s.alias("s"))))), lambda x: x["s"])
    contains = lambda kept, s: F.exists(kept, lambda k: F.size(F.array_except(k, s)) == 0)
    add = lambda kept, s: F.when((F.size(kept) >= KEPT) | contains(kept, s), kept).otherwise(F.concat(kept, F.array(s)))
    return F.aggregate(ordered, F.array().cast("array<array<bigint>>"), add)


def proof_steps(result: Saturated, classes: DataFrame) -> DataFrame:
    """key, axiom, p1, p2, depth: all ways to conclude what the unsatisfiability of the classes (iri) rests on, found
    backwards from owl:Nothing by joins with the saturated tables."""
    S, L = result.S, result.L
    of = lambda form: result.rows.where(F.col("form") == form).select("a", F.col("b"), F.col("c").alias("d"), "axiom")
    x = classes.join(result.names.withColumnRenamed("name", "iri"), "iri").select(F.col("id").alias("x"), F.lit(result.nothing).alias("c"))
    new = cut(x.join(S, ["x", "c"], "left_semi").distinct().select(_key("S", "x", "c").alias("key"), "x", F.lit(0).cast("bigint").alias("r"), F.col("c").alias("y")), "el-goals")
    goals, steps = Grown(new, "el-goals"), []
    top = lambda df: df.unionByName(new.select("x", F.lit(result.thing).alias("c")).distinct())
    for depth in range(MAX_ROUNDS):
        is_s = F.startswith("key", F.lit("S"))
        g, h = new.where(is_s).select("key", "x", F.col("y").alias("c")), new.where(~is_s)
        none = F.lit(None).cast("string")
        own = lambda df, axiom, p1, p2=none: df.select("key", axiom.alias("axiom"), p1.alias("p1"), p2.alias("p2"))
        is_ = top(S)
        said = lambda column, at="x": is_.select(F.col("x").alias(at), F.col("c").alias(column)).distinct()
        sub, ands, needs, domains = of("sub").withColumnRenamed("b", "c"), of("and").withColumnRenamed("d", "c"), of("need").withColumnRenamed("d", "c"), of("domain").withColumnRenamed("b", "c").drop("d")
        with_link = lambda df, r: df.join(L.withColumnRenamed("r", r), ["x", r])
        no_axiom = F.lit(None).cast("bigint")
        need = with_link(g.join(needs, "c").withColumnRenamed("a", "r"), "r").join(said("b", "y"), ["y", "b"])
        failed = g.where(F.col("c") == result.nothing).join(L, "x").join(said("c", "y").where(F.col("c") == result.nothing).select("y"), "y")
        link = h.join(of("link").select("a", F.col("b").alias("r"), F.col("d").alias("y"), "axiom"), ["r", "y"]).join(said("a"), ["x", "a"])
        role = h.join(of("role").select(F.col("a").alias("r1"), F.col("b").alias("r"), "axiom"), "r").join(L.withColumnRenamed("r", "r1"), ["x", "r1", "y"])
        chain = h.join(of("chain").select(F.col("a").alias("r1"), F.col("b").alias("r2"), F.col("d").alias("r"), "axiom"), "r")
        chain = chain.join(L.select("x", F.col("r").alias("r1"), F.col("y").alias("m")), ["x", "r1"]).join(L.select(F.col("x").alias("m"), F.col("r").alias("r2"), "y"), ["m", "r2", "y"])
        domain = with_link(g.join(domains.withColumnRenamed("a", "r"), "c"), "r")
        found = [
            own(g.where((F.col("x") == F.col("c")) | (F.col("c") == result.thing)), no_axiom, none),
            own(g.join(sub, "c").join(said("a"), ["x", "a"]), F.col("axiom"), _key("S", "x", "a")),
            own(g.join(ands, "c").join(said("a"), ["x", "a"]).join(said("b"), ["x", "b"]), F.col("axiom"), _key("S", "x", "a"), _key("S", "x", "b")),
            own(need, F.col("axiom"), _key("L", "x", "r", "y"), _key("S", "y", "b")),
            own(domain, F.col("axiom"), _key("L", "x", "r", "y")),
            own(failed, no_axiom, _key("L", "x", "r", "y"), _key("S", "y", "c")),
            own(link, F.col("axiom"), _key("S", "x", "a")),
            own(role, F.col("axiom"), _key("L", "x", "r1", "y")),
            own(chain, F.col("axiom"), _key("L", "x", "r1", "m"), _key("L", "m", "r2", "y")),
            own(h.where("x = y").join(of("reflexive").select(F.col("a").alias("r"), "axiom"), "r"), F.col("axiom"), none),
        ]
        step = cut(reduce(DataFrame.union, found).distinct().withColumn("depth", F.lit(depth)), "el-steps")
        steps.append(step)
        keys = step.select(F.explode(F.array("p1", "p2")).alias("key")).where("key IS NOT NULL").distinct().join(goals.frame, "key", "left_anti")
        part = F.split("key", ":")
        number = lambda k: F.get(part, F.lit(k)).cast("bigint")
        is_s = F.startswith("key", F.lit("S"))
        new = cut(keys.select("key", number(1).alias("x"), F.when(is_s, 0).otherwise(number(2)).alias("r"), F.when(is_s, number(2)).otherwise(F.when(~is_s, F.get(part, F.lit(3)).cast("bigint"))).alias("y")), "el-goals")
        if new.isEmpty():
            return cut(reduce(DataFrame.union, steps), "el-steps")
        goals.add(new)
    raise RuntimeError(f"no end after {MAX_ROUNDS} rounds")


def justifications(result: Saturated, classes: DataFrame, most: int = 8) -> DataFrame:
    """iri, k, steps: up to ``most`` sets of axioms for each unsatisfiable class (iri), smallest first.

    Each entails that the class is empty, and none contains another; steps go from the class towards owl:Nothing. Each
    conclusion on the way keeps its KEPT smallest sets, so where there are more, a large set may be missed."""
    steps = proof_steps(result, classes)
    told = F.when(F.col("axiom").isNull(), F.array().cast("array<bigint>")).otherwise(F.array("axiom"))
    base = steps.where("p1 IS NULL").select("key", told.alias("set"))
    grouped = lambda df: df.groupBy("key").agg(_least_sets(F.collect_list("set")).alias("sets"))
    best, seen = cut(grouped(base), "el-proofs"), None
    inner = steps.where("p1 IS NOT NULL")
    for _ in range(MAX_ROUNDS):
        left, right = best.select(F.col("key").alias("p1"), F.col("sets").alias("s1")), best.select(F.col("key").alias("p2"), F.col("sets").alias("s2"))
        both = inner.join(left, "p1").join(right, "p2", "left").where("p2 IS NULL OR s2 IS NOT NULL")
        other = F.coalesce("s2", F.array(F.array().cast("array<bigint>")))
        sets = F.flatten(F.transform("s1", lambda s: F.transform(other, lambda t: F.array_sort(F.array_union(F.array_union(s, t), told)))))
        best = cut(grouped(base.union(both.select("key", F.explode(sets).alias("set")))), "el-proofs")
        now = best.agg(F.count("*"), F.sum(F.xxhash64("key", "sets").cast("decimal(20,0)"))).first()
        if now == seen:
            break
        seen = now
    x = classes.join(result.names.withColumnRenamed("name", "iri"), "iri").select("iri", _key("S", "id", F.lit(str(result.nothing))).alias("key")).distinct()
    sets = best.join(x, "key").select("iri", F.posexplode(F.slice("sets", 1, most)).alias("k", "set"))
    at = steps.where("axiom IS NOT NULL").groupBy("axiom").agg(F.min("depth").alias("depth")).join(result.axioms.select(F.col("id").alias("axiom"), F.col("axiom").alias("text")), "axiom")
    out = sets.select("iri", "k", F.explode("set").alias("axiom")).join(at, "axiom").groupBy("iri", "k").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("d"), "text"))).alias("s"))
    return out.select("iri", "k", F.transform("s", lambda s: s["text"]).alias("steps"))
