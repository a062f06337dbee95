"""Reasoning as fixpoints of joins over axiom rows.

Profiles: rdfs (subclass and subproperty closure, types, domains, ranges); rl (also equivalence, inverse, symmetric and
transitive properties, chains, sameAs); el (classification by completion, with existential restrictions: see ``el``). dl and
auto classify by the el rules and name what these don't decide: nothing is called consistent that the rules can't decide."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.catalog import Catalog
from lattica.functions import manchester
from lattica.model import MAX_RESULT_ROWS, NAMED_INDIVIDUAL, NOTHING, THING, LatticaError
from lattica.operators import el
from lattica.operators.fixpoint import MAX_ROUNDS, closure, components
from lattica.storage import Grown, cut

PROFILES = ["rdfs", "rl", "el", "dl", "auto"]


def _simple() -> Column:
    """A named class or property, no expression."""
    return ~F.col("object").rlike(r"\s")


def _axioms(catalog: Catalog, *kinds: str) -> DataFrame:
    return catalog.axioms.where(F.col("axiom_kind").isin(*kinds))


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.col("subject").alias("a"), F.col("object").alias("b")).where("a <> b").distinct()


def asserted_edges(catalog: Catalog) -> DataFrame:
    """child, parent between named classes."""
    return _pairs(_axioms(catalog, "sub_class_of").where(_simple())).select(F.col("a").alias("child"), F.col("b").alias("parent"))


def _conjuncts(catalog: Catalog) -> DataFrame:
    """child, parent: named conjuncts of a named class's superclass or equivalent class."""
    rows = _axioms(catalog, "sub_class_of", "equivalent_class").where(F.contains("object", F.lit(" and ")) & ~F.contains("object", F.lit("(")) & ~F.contains("object", F.lit(" or ")))
    return rows.select(F.col("subject").alias("child"), F.explode(F.split("object", " and ")).alias("parent")).where(~F.col("parent").rlike(r"\s"))


class Classification:
    """The hierarchy that a profile's rules entail; each part is worked out when it is first asked for."""

    def __init__(self, catalog: Catalog, profile: str):
        if profile not in PROFILES:
            raise LatticaError(f"unknown profile: {profile}")
        self.catalog, self.profile = catalog, profile

    @cached_property
    def asserted(self) -> DataFrame:
        return cut(asserted_edges(self.catalog), "asserted")

    @cached_property
    def saturated(self) -> el.Saturated:
        return el.saturate(self.catalog)

    @cached_property
    def edges(self) -> DataFrame:
        """child, parent: the transitive hierarchy."""
        if self.profile not in ("rdfs", "rl"):
            return self.saturated.edges
        edges = self.asserted
        if self.profile != "rdfs":
            eq = _pairs(_axioms(self.catalog, "equivalent_class").where(_simple())).select(F.col("a").alias("child"), F.col("b").alias("parent"))
            edges = edges.union(eq).union(eq.select("parent", "child")).union(_conjuncts(self.catalog)).distinct()
        full = closure(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")))
        return cut(full.where("a <> b").select(F.col("a").alias("child"), F.col("b").alias("parent")), "closure")

    @cached_property
    def inferred(self) -> DataFrame:
        """child, parent that isn't asserted."""
        return self.edges.join(self.asserted, ["child", "parent"], "left_anti")

    @cached_property
    def unsatisfiable(self) -> DataFrame:
        """iri"""
        return unsatisfiable(self.catalog, self.edges) if self.profile in ("rdfs", "rl") else self.saturated.unsatisfiable

    @cached_property
    def equivalences(self) -> DataFrame:
        """node, component (its smallest node): as the hierarchy is transitive, all of a cluster are above each other."""
        back = self.edges.select(F.col("parent").alias("child"), F.col("child").alias("parent"))
        both = self.edges.join(back, ["child", "parent"], "left_semi")
        return both.groupBy(F.col("child").alias("node")).agg(F.min("parent").alias("m")).select("node", F.least("node", "m").alias("component"))

    @cached_property
    def warnings(self) -> list[str]:
        notes = None if self.profile in ("rdfs", "rl") else self.saturated.notes
        return profile_warnings(self.catalog, self.profile, notes)


def classify(catalog: Catalog, profile: str = "rl") -> Classification:
    return Classification(catalog, profile)


def unsatisfiable(catalog: Catalog, up: DataFrame) -> DataFrame:
    """iri of classes below owl:Nothing or below two disjoint classes, of a transitive hierarchy: what is below such a
    class is below both, too."""
    self_up = up.union(up.select("child", F.col("child").alias("parent"))).distinct()
    disjoint = _pairs(_axioms(catalog, "disjoint_class").where(_simple()))
    disjoint = disjoint.union(disjoint.select("b", "a")).distinct()
    x = self_up.select(F.col("child").alias("iri"), F.col("parent").alias("a"))
    clash = x.join(disjoint, "a").join(self_up.select(F.col("child").alias("iri"), F.col("parent").alias("b")), ["iri", "b"], "left_semi").select("iri")
    return clash.union(up.where(F.col("parent") == NOTHING).select("child")).distinct().where(F.col("iri") != NOTHING)


# Kinds of axioms that each profile's rules read.
_READ = {
    "rdfs": {"sub_class_of", "sub_object_property_of", "sub_data_property_of", "domain", "range", "class_assertion", "object_property_assertion", "data_property_assertion"},
    "rl": {"sub_class_of", "equivalent_class", "disjoint_class", "sub_object_property_of", "sub_data_property_of", "inverse_object_properties", "equivalent_object_properties", "property_chain", "domain", "range", "class_assertion", "object_property_assertion", "data_property_assertion", "same_individual", "different_individuals"},
}


def profile_warnings(catalog: Catalog, profile: str, notes: DataFrame | None = None) -> list[str]:
    """notes: what the el rules left out, where that is known."""
    if profile not in ("rdfs", "rl"):
        return el.warnings(catalog, el.normal_form(catalog).where("form = 'note'") if notes is None else notes, profile)
    known = _READ[profile]
    counts = {r.axiom_kind: r["count"] for r in catalog.axioms.groupBy("axiom_kind").count().collect()}
    out = [f"{profile}: {n} axioms of kind {k} are not used" for k, n in sorted(counts.items()) if k not in known]
    complex_ = catalog.axioms.where((F.col("axiom_kind") == "sub_class_of") & ~_simple()).count()
    return out + ([f"{profile}: {complex_} complex superclasses are used in part only"] if complex_ else [])


def suggested_profile(catalog: Catalog) -> str:
    kinds = {r.axiom_kind for r in catalog.axioms.select("axiom_kind").distinct().collect()}
    return "rdfs" if kinds <= _READ["rdfs"] else "rl" if kinds <= _READ["rl"] else "el"


# -- individuals

def same_as(catalog: Catalog) -> DataFrame:
    """node, component of individuals stated to be the same."""
    return components(_pairs(_axioms(catalog, "same_individual")))


def facts(catalog: Catalog, profile: str = "rl") -> DataFrame:
    """s, p, o: object property assertions and what sub-properties, inverses, symmetry, transitivity, chains and sameAs add,
    to a fixpoint. Transitive properties are closed by doubling paths; the rest goes in rounds of new facts. A chain is an
    automaton whose states are its beginnings: what has gone through one is a fact of that name until the chain ends."""
    known = cut(_axioms(catalog, "object_property_assertion").select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o")).distinct(), "facts")
    sub = _pairs(_axioms(catalog, "sub_object_property_of", *(["equivalent_object_properties"] if profile != "rdfs" else [])))
    inverse = _pairs(_axioms(catalog, "inverse_object_properties"))
    flag = lambda c: catalog.entities.where(F.col(f"characteristics.{c}")).select(F.col("iri").alias("p"))
    symmetric, transitive = flag("symmetric"), flag("transitive")
    listed = _axioms(catalog, "property_chain").select(F.split("object", " o ").alias("x"), F.col("subject").alias("p")).withColumn("n", F.size("x"))
    begun = lambda k: F.array_join(F.slice("x", 1, k), " o ")
    chains = listed.where("n > 1").select("p", "n", "x", F.explode(F.sequence(F.lit(1), F.col("n") - 1)).alias("k"))
    chains = chains.select(begun(F.col("k")).alias("p1"), F.get("x", F.col("k")).alias("p2"), F.when(F.col("k") == F.col("n") - 1, F.col("p")).otherwise(begun(F.col("k") + 1)).alias("p"))
    chains = cut(chains.union(transitive.select("p", F.col("p").alias("p2"), F.col("p").alias("p3"))).distinct(), "chains")
    if profile != "rdfs":
        sub = sub.union(listed.where("n = 1").select(F.get("x", F.lit(0)), "p"))
        # A link of a chain may be an inverse: its facts stand under that name.
        turned = listed.select(F.explode("x").alias("b")).where("b LIKE 'inverse %'").select(F.substring("b", 9, 1 << 30).alias("a"), "b").distinct()
        inverse = inverse.union(turned)
    same = cut(same_as(catalog), "same") if profile != "rdfs" else None
    new, all_ = known, Grown(known, "facts")
    for _ in range(MAX_ROUNDS):
        known = all_.frame
        found = [new.join(sub, new["p"] == sub["a"]).select("s", F.col("b").alias("p"), "o")]
        if profile != "rdfs":
            found.append(new.join(inverse, new["p"] == inverse["a"]).select(F.col("o").alias("s"), F.col("b").alias("p"), F.col("s").alias("o")))
            found.append(new.join(symmetric, "p", "left_semi").select(F.col("o").alias("s"), "p", F.col("s").alias("o")))
            x = lambda df: df.select("s", F.col("p").alias("p1"), F.col("o").alias("m"))
            y = lambda df: df.select(F.col("s").alias("m"), F.col("p").alias("p2"), "o")
            found.append(x(new).join(chains, "p1").join(y(known), ["m", "p2"]).select("s", "p", "o"))
            found.append(x(known).join(chains, "p1").join(y(new), ["m", "p2"]).select("s", "p", "o"))
            root = same.select("node", "component").where("node <> component")
            found.append(new.join(root.withColumnRenamed("node", "s"), "s").select(F.col("component").alias("s"), "p", "o"))
            found.append(new.join(root.withColumnRenamed("node", "o"), "o").select("s", "p", F.col("component").alias("o")))
        new = cut(reduce(DataFrame.union, found).distinct().join(known, ["s", "p", "o"], "left_anti"), "facts")
        if new.isEmpty():
            break
        all_.add(new)
    if same is None:
        return known
    known = known.where(~F.contains("p", F.lit(" ")))
    # What holds of a cluster's representative holds of its members.
    member = same.where("node <> component")
    wide = known.union(known.join(member.select(F.col("component").alias("s"), "node"), "s").select(F.col("node").alias("s"), "p", "o")).distinct()
    return wide.union(wide.join(member.select(F.col("component").alias("o"), "node"), "o").select("s", "p", F.col("node").alias("o"))).distinct()


def types(catalog: Catalog, up: DataFrame, profile: str = "rl") -> DataFrame:
    """individual, type: asserted, by domain and range, through the hierarchy; owl:Thing and owl:NamedIndividual are left out."""
    asserted = _axioms(catalog, "class_assertion").where(_simple()).select(F.col("subject").alias("individual"), F.col("object").alias("type"))
    f = facts(catalog, profile)
    domain = _axioms(catalog, "domain").select(F.col("subject").alias("p"), F.col("object").alias("type"))
    range_ = _axioms(catalog, "range").where(_simple()).select(F.col("subject").alias("p"), F.col("object").alias("type"))
    own = reduce(DataFrame.union, [asserted, f.join(domain, "p").select(F.col("s").alias("individual"), "type"), f.join(range_, "p").select(F.col("o").alias("individual"), "type")])
    if profile != "rdfs":
        same = same_as(catalog)
        of_cluster = own.join(same.withColumnRenamed("node", "individual"), "individual").select("component", "type").distinct()
        own = own.union(of_cluster.join(same, "component").select(F.col("node").alias("individual"), "type"))
    own = cut(own.distinct(), "types")
    above = own.join(up.select(F.col("child").alias("type"), "parent"), "type").select("individual", F.col("parent").alias("type"))
    return own.union(above).where(~F.col("type").isin(THING, NAMED_INDIVIDUAL)).distinct()


def realize(catalog: Catalog, profile: str = "rl", result: Classification | None = None) -> DataFrame:
    """individual, type, inferred, most_specific of every individual: no strict subclass of a most specific type is entailed."""
    result = result or classify(catalog, profile)
    all_ = cut(types(catalog, result.edges, profile), "realized")
    strict = result.edges.join(result.edges.select(F.col("parent").alias("child"), F.col("child").alias("parent")), ["child", "parent"], "left_anti")
    less = all_.join(strict.select(F.col("child").alias("type"), "parent"), "type").select("individual", F.col("parent").alias("type")).distinct()
    asserted = _axioms(catalog, "class_assertion").select(F.col("subject").alias("individual"), F.col("object").alias("type")).distinct()
    return all_.join(asserted.withColumn("a", F.lit(True)), ["individual", "type"], "left").join(less.withColumn("l", F.lit(True)), ["individual", "type"], "left").select("individual", "type", F.col("a").isNull().alias("inferred"), F.col("l").isNull().alias("most_specific"))


def check_instance(catalog: Catalog, individual: str, class_iri: str, profile: str = "rl") -> bool:
    """Only what is at or below the class is looked at; facts are worked out only if a domain or range leads there."""
    if class_iri in (THING, NAMED_INDIVIDUAL):
        return False
    up = classify(catalog, profile).edges
    below = cut(up.where(F.col("parent") == class_iri).select(F.col("child").alias("type")).union(catalog.spark.createDataFrame([(class_iri,)], "type string")).distinct(), "below")
    told = _axioms(catalog, "class_assertion").where(F.col("subject") == individual).select(F.col("object").alias("type"))
    if not told.join(below, "type", "left_semi").isEmpty():
        return True
    leads = _axioms(catalog, "domain", "range").select(F.col("object").alias("type")).join(below, "type", "left_semi")
    same = profile != "rdfs" and not _axioms(catalog, "same_individual").where((F.col("subject") == individual) | (F.col("object") == individual)).isEmpty()
    if leads.isEmpty() and not same:
        return False
    return not types(catalog, up.join(below.withColumnRenamed("type", "parent"), "parent", "left_semi").select("child", "parent"), profile).where((F.col("individual") == individual) & (F.col("type") == class_iri)).isEmpty()


def inferred_assertions(catalog: Catalog, profile: str = "rl") -> dict[str, DataFrame]:
    asserted = _axioms(catalog, "object_property_assertion").select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"))
    return {"types": realize(catalog, profile).where("inferred").select("individual", "type"), "properties": facts(catalog, profile).join(asserted, ["s", "p", "o"], "left_anti"), "clusters": same_as(catalog)}


def clashes(catalog: Catalog) -> DataFrame:
    """a, b: individuals that are the same and stated to be different."""
    same, different = same_as(catalog), _pairs(_axioms(catalog, "different_individuals"))
    x = different.join(same.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a").join(same.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b")
    return x.where("ca = cb").select("a", "b")


def check_consistency(catalog: Catalog, profile: str = "rl") -> dict:
    """consistent is False only with a reason, and complete only where the rules decide all that was stated."""
    result = classify(catalog, profile)
    bad = [r.iri for r in result.unsatisfiable.orderBy("iri").limit(MAX_RESULT_ROWS).collect()]
    both = [(r.a, r.b) for r in clashes(catalog).orderBy("a", "b").limit(MAX_RESULT_ROWS).collect()]
    return {"consistent": not bad and not both, "unsatisfiable": bad, "clashes": both, "complete": not result.warnings, "warnings": result.warnings}


# -- explanation

def explanations(catalog: Catalog, classes: DataFrame | None = None, most: int = 8, result: Classification | None = None) -> DataFrame:
    """iri, k, steps: up to ``most`` sets of axioms for each unsatisfiable class (of ``classes``, iri), smallest first."""
    saturated = (result or classify(catalog, "el")).saturated
    return el.justifications(saturated, saturated.unsatisfiable if classes is None else classes, most)


def explain(catalog: Catalog, class_iri: str, most: int = 1) -> list[list[str]]:
    """Up to ``most`` chains of axioms, shortest first, from an unsatisfiable class to owl:Nothing or to a disjointness."""
    most = max(1, min(8, most))
    one = catalog.spark.createDataFrame([(class_iri,)], "iri string")
    return [list(r.steps) for r in explanations(catalog, one, most).orderBy("k").collect()]


# -- DL queries

def instances(catalog: Catalog, tree: tuple, known: DataFrame, f: DataFrame) -> DataFrame:
    """individual that a class expression describes, of known types and facts: semi-joins, anti-joins and counts.

    'not' and 'only' are read over the individuals and facts that are known."""
    kind = tree[0]
    everyone = known.select("individual").union(f.select("s")).union(f.select("o")).distinct()
    again = lambda t: instances(catalog, t, known, f)
    if kind == "class":
        return everyone if tree[1] == THING else known.where(F.col("type") == tree[1]).select("individual").distinct()
    if kind == "and":
        return reduce(DataFrame.intersect, map(again, tree[1]))
    if kind == "or":
        return reduce(DataFrame.union, map(again, tree[1])).distinct()
    if kind == "not":
        return everyone.subtract(again(tree[1]))
    if kind == "one_of":
        return everyone.where(F.col("individual").isin(*tree[1]))
    prop = tree[2] if kind in ("min", "max", "exactly") else tree[1]
    p = prop.removeprefix("inverse ")
    own = f.where(F.col("p") == p).select(F.col("o" if p != prop else "s").alias("individual"), F.col("s" if p != prop else "o").alias("value"))
    if kind == "some":
        return own.join(again(tree[2]).select(F.col("individual").alias("value")), "value", "left_semi").select("individual").distinct()
    if kind == "only":
        return everyone.subtract(own.join(again(tree[2]).select(F.col("individual").alias("value")), "value", "left_anti").select("individual"))
    if kind == "value":
        return own.where(F.col("value") == tree[2][1]).select("individual").distinct()
    if kind == "self":
        return own.where("individual = value").select("individual").distinct()
    if kind in ("min", "max", "exactly"):
        counted = own if tree[3] is None else own.join(again(tree[3]).select(F.col("individual").alias("value")), "value", "left_semi")
        n = everyone.join(counted.groupBy("individual").agg(F.count_distinct("value").alias("n")), "individual", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        test: Column = F.col("n") >= tree[1] if kind == "min" else F.col("n") <= tree[1] if kind == "max" else F.col("n") == tree[1]
        return n.where(test).select("individual")
    raise LatticaError(f"DL query doesn't support {kind}")


def dl_query(catalog: Catalog, expression: str, namespaces: dict[str, str] | None = None, mode: str = "inferred", profile: str = "rl") -> dict[str, DataFrame]:
    """sub, super, equivalent (iri) and instances (individual) of a Manchester expression.

    Of an anonymous expression the named classes are those that its parts entail: conjuncts above, disjuncts below."""
    tree = manchester.parse(expression, namespaces)
    if mode == "asserted":
        up = asserted_edges(catalog)
        up = closure(up.select(F.col("child").alias("a"), F.col("parent").alias("b"))).select(F.col("a").alias("child"), F.col("b").alias("parent"))
        known = _axioms(catalog, "class_assertion").where(_simple()).select(F.col("subject").alias("individual"), F.col("object").alias("type"))
        known = known.union(known.join(up.select(F.col("child").alias("type"), "parent"), "type").select("individual", F.col("parent").alias("type"))).distinct()
        f = _axioms(catalog, "object_property_assertion").select(F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"))
    else:
        up = classify(catalog, profile).edges
        known, f = cut(types(catalog, up, profile), "dl"), cut(facts(catalog, profile), "dl")

    def above(t: tuple) -> DataFrame:
        if t[0] == "class":
            return up.where(F.col("child") == t[1]).select(F.col("parent").alias("iri")).union(catalog.spark.createDataFrame([(t[1],)], "iri string")).distinct()
        if t[0] == "and":
            return reduce(DataFrame.union, map(above, t[1])).distinct()
        if t[0] == "or":
            return reduce(DataFrame.intersect, map(above, t[1]))
        return catalog.spark.createDataFrame([(THING,)], "iri string")

    def below(t: tuple) -> DataFrame:
        if t[0] == "class":
            return up.where(F.col("parent") == t[1]).select(F.col("child").alias("iri")).union(catalog.spark.createDataFrame([(t[1],)], "iri string")).distinct()
        if t[0] == "or":
            return reduce(DataFrame.union, map(below, t[1])).distinct()
        if t[0] == "and":
            return reduce(DataFrame.intersect, map(below, t[1]))
        return catalog.spark.createDataFrame([], "iri string")

    hi, lo = cut(above(tree), "dl"), cut(below(tree), "dl")
    equal = hi.intersect(lo)
    own = catalog.spark.createDataFrame([(tree[1],)], "iri string") if tree[0] == "class" else catalog.spark.createDataFrame([], "iri string")
    return {"super": hi.subtract(equal).where(F.col("iri") != THING), "sub": lo.subtract(equal).where(F.col("iri") != NOTHING), "equivalent": equal.subtract(own), "instances": instances(catalog, tree, known, f).distinct()}
