"""EL classification and proofs against a plain-Python completion; property chains."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lattica.catalog import Catalog
from lattica.functions import manchester
from lattica.model import NOTHING, THING
from lattica.operators import el, reason

U = "http://u/"


def catalog(spark, axioms, transitive=(), reflexive=()):
    c = Catalog.empty(spark)
    rows = [(f"axiom-{i}", "o", s, "", o, kind, []) for i, (kind, s, o) in enumerate(axioms)]
    flags = [(p, p in transitive, p in reflexive) for p in sorted({*transitive, *reflexive})]
    entities = spark.createDataFrame(flags, "iri string, transitive boolean, reflexive boolean")
    false = F.lit(False)
    made = F.struct(*[F.col(n) if n in ("transitive", "reflexive") else false.alias(n) for n in c.entities.schema["characteristics"].dataType.names])
    entities = entities.select("iri", *[F.lit(None).cast(f.dataType).alias(f.name) for f in c.entities.schema if f.name not in ("iri", "characteristics")], made.alias("characteristics"))
    return c.with_(axioms=spark.createDataFrame(rows, c.axioms.schema), entities=entities.select(c.entities.columns))


def random_ontology(rng, n):
    """Axioms over the names of ontology n only."""
    classes, roles = [f"{U}{n}/{x}" for x in "ABCDEFGH"], [f"{U}{n}/{x}" for x in ("p", "q", "r")]

    def expression(depth):
        kind = rng.choice(["class", "class", "class", "some", "some", "and"]) if depth else "class"
        if kind == "some":
            return ("some", rng.choice(roles), expression(depth - 1))
        if kind == "and":
            return ("and", [expression(depth - 1) for _ in range(2)])
        return ("class", rng.choice([*classes, *classes, THING] if depth < 2 else classes))

    text = lambda t: manchester.render(t, plain=True)
    out = []
    for _ in range(rng.randint(4, 12)):
        kind = rng.choice(["sub_class_of"] * 6 + ["equivalent_class"] * 3 + ["disjoint_class", "domain", "range", "sub_object_property_of", "property_chain"])
        if kind in ("sub_class_of", "equivalent_class"):
            out.append((kind, rng.choice(classes), text(expression(2))))
        elif kind == "disjoint_class":
            out.append((kind, *rng.sample(classes, 2)))
        elif kind in ("domain", "range"):
            out.append((kind, rng.choice(roles), rng.choice(classes)))
        elif kind == "sub_object_property_of":
            out.append((kind, *rng.sample(roles, 2)))
        else:
            out.append((kind, rng.choice(roles), " o ".join(rng.choice(roles) for _ in range(rng.randint(2, 3)))))
    if rng.random() < 0.2:
        out.append(("sub_class_of", rng.choice(classes), NOTHING))
    return out, classes, roles


def completion(axioms, classes, transitive):
    """child -> what it is below, by trying every rule on every expression until nothing is new."""
    nodes, above, told = {("class", THING), ("class", NOTHING), *(("class", c) for c in classes)}, {}, set()
    hold = lambda t: ("and", tuple(map(hold, t[1]))) if t[0] == "and" else (t[0], t[1], hold(t[2])) if t[0] == "some" else t

    def add(t):
        nodes.add(t)
        for x in t[1] if t[0] == "and" else [t[2]] if t[0] == "some" else []:
            add(x)
        return t

    roles, chains, domains, ranges, disjoint = set(), set(), set(), set(), set()
    for kind, s, o in axioms:
        if kind == "sub_object_property_of":
            roles.add((s, o))
        elif kind == "property_chain":
            parts = o.split(" o ")
            for k in range(1, len(parts)):
                chains.add((" o ".join(parts[:k]), parts[k], s if k == len(parts) - 1 else " o ".join(parts[: k + 1])))
        elif kind == "domain":
            domains.add((s, add(("class", o))))
        elif kind == "range":
            ranges.add((s, add(("class", o))))
        elif kind == "disjoint_class":
            disjoint.add((add(("class", s)), add(("class", o))))
        else:
            a, b = add(("class", s)), add(hold(manchester.parse(o)))
            told |= {(a, b)} | ({(b, a)} if kind == "equivalent_class" else set())
    chains |= {(p, p, p) for p in transitive}
    up = {r: {r} for r in {x for p in roles for x in p} | {p for c in chains for p in c} | {p for p, _ in domains | ranges} | {t[1] for t in nodes if t[0] == "some"}}
    for _ in up:
        for a, b in roles:
            for s in up.values():
                if a in s:
                    s.add(b)
    # A filler in the ranges of its role is a node of its own.
    of = {}
    for t in [t for t in nodes if t[0] == "some"]:
        extra = {c for p, c in ranges if p in up[t[1]]}
        of[t] = ("in", t[2], frozenset(extra)) if extra else t[2]
        nodes.add(of[t])
    above = {x: {x, ("class", THING)} | ({x[1], *x[2]} if x[0] == "in" else set()) for x in nodes}
    links = set()
    changed = True
    while changed:
        changed = False
        for x, s in above.items():
            new = {b for a, b in told if a in s} | {y for t in s if t[0] == "and" for y in t[1]} | {t for t in nodes if t[0] == "and" and set(t[1]) <= s}
            if any({a, b} <= s for a, b in disjoint):
                new.add(("class", NOTHING))
            for t in s:
                if t[0] == "some" and (x, t[1], of[t]) not in links:
                    links.add((x, t[1], of[t]))
                    changed = True
            if not new <= s:
                s |= new
                changed = True
        for x, r, y in list(links):
            new = {(x, q, y) for q in up[r]} | {(x, c, z) for a, b, c in chains if a == r for y2, r2, z in links if y2 == y and r2 == b}
            got = {c for p, c in domains if p == r} | {t for t in nodes if t[0] == "some" and t[1] == r and t[2] in above[y]}
            if ("class", NOTHING) in above[y]:
                got.add(("class", NOTHING))
            if not new <= links or not got <= above[x]:
                links |= new
                above[x] |= got
                changed = True
    return {c: {t[1] for t in above[("class", c)] if t[0] == "class"} for c in classes}


def test_classification_equals_completion_on_random_ontologies(spark):
    rng = random.Random(11)
    made = [random_ontology(rng, n) for n in range(200)]
    transitive = [f"{U}{n}/p" for n in range(0, 200, 3)]
    c = catalog(spark, [a for axioms, _, _ in made for a in axioms], transitive)
    result = reason.classify(c, "el")
    assert result.warnings == []
    edges, bad, same = {}, {r.iri for r in result.unsatisfiable.collect()}, {r.node: r.component for r in result.equivalences.collect()}
    for r in result.edges.collect():
        edges.setdefault(r.child, set()).add(r.parent)
    some = 0
    for axioms, classes, roles in made:
        want = completion(axioms, classes, set(transitive) & set(roles))
        for x in classes:
            assert (x in bad) == (NOTHING in want[x]), (x, axioms)
            assert edges.get(x, set()) == want[x] - {x, THING, NOTHING}, (x, axioms)
            cluster = {y for y in classes if y in want[x] and x in want[y]}
            assert same.get(x, x) == min(cluster)
            some += len(want[x]) > 3
    assert some > 100 and len(bad) > 50


def axiom_of(step):
    for word, kind in ((" SubClassOf ", "sub_class_of"), (" EquivalentTo ", "equivalent_class"), (" DisjointWith ", "disjoint_class"), (" Domain ", "domain"), (" Range ", "range"), (" SubPropertyOf ", "sub_object_property_of"), (" SubPropertyChain ", "property_chain")):
        if word in step:
            s, _, o = step.partition(word)
            return kind, s, o
    raise AssertionError(step)


def test_justifications_entail_and_are_minimal(spark):
    rng = random.Random(29)
    made = [random_ontology(rng, n) for n in range(60)]
    c = catalog(spark, [a for axioms, _, _ in made for a in axioms])
    result = reason.classify(c, "el")
    bad = {r.iri for r in result.unsatisfiable.collect()}
    found = {}
    for r in reason.explanations(c, None, 8, result).collect():
        found.setdefault(r.iri, []).append((r.k, r.steps))
    assert bad and set(found) == bad
    several = 0
    for iri, sets in found.items():
        axioms, classes, _ = made[int(iri.removeprefix(U).partition("/")[0])]
        sets = [[axiom_of(x) for x in steps] for _, steps in sorted(sets)]
        assert [len(x) for x in sets] == sorted(map(len, sets)) and len(sets) <= 8
        for own in sets:
            assert NOTHING in completion(own, classes, set())[iri], (iri, own)
            assert all(NOTHING not in completion([x for x in own if x != y], classes, set())[iri] for y in own), (iri, own)
        assert not any(set(a) <= set(b) for a, b in itertools.permutations(sets, 2))
        # The smallest of all: no set of fewer axioms does.
        unique = sorted(set(axioms))
        if len(sets[0]) <= 3:
            assert not any(NOTHING in completion(list(x), classes, set())[iri] for n in range(1, len(sets[0])) for x in itertools.combinations(unique, n))
        several += len(sets) > 1
    assert several > 3


def test_explain_agrees_with_every_profile(spark):
    e, a, b = U + "E", U + "A", U + "B"
    c = catalog(spark, [("equivalent_class", e, f"{a} and {b}"), ("disjoint_class", a, b), ("disjoint_class", b, a), ("sub_class_of", U + "F", e)])
    for profile in ("rl", "el", "dl", "auto"):
        assert {r.iri for r in reason.classify(c, profile).unsatisfiable.collect()} == {e, U + "F"}
    assert reason.explain(c, e, 8) == [[f"{e} EquivalentTo {a} and {b}", f"{a} DisjointWith {b}"]]
    assert reason.explain(c, U + "F", 8) == [[f"{U}F SubClassOf {e}", f"{e} EquivalentTo {a} and {b}", f"{a} DisjointWith {b}"]]
    assert reason.explain(c, a) == [] and reason.explain(c, U + "nowhere") == []


def test_what_el_cannot_say_is_named(spark):
    c = catalog(spark, [
        ("sub_class_of", U + "A", f"({U}p some {U}B) and ({U}p only {U}B)"), ("sub_class_of", U + "C", f"{U}p max 0 {U}B"), ("sub_class_of", U + "A2", f"{U}A and {U}C"), ("equivalent_class", U + "D", f"{U}A or {U}B"),
        ("sub_class_of", U + "G", f"not {U}A"), ("sub_class_of", U + "H", f"{U}A and {U}G"), ("sub_class_of", U + "K", f"inverse {U}p some {U}B"), ("inverse_object_properties", U + "p", U + "q"), ("disjoint_union", U + "M", f"{U}X | {U}Y | {U}Z"),
        ("sub_class_of", U + "N", U + "X"), ("sub_class_of", U + "N", U + "Z"), ("sub_class_of", U + "V", f"{U}p value {U}i"), ("equivalent_class", U + "W", f"{U}p value {U}i"), ("sub_class_of", U + "Q", f"{U}s exactly 2 {U}A2"),
    ], reflexive=[U + "s"])
    result = reason.classify(c, "el")
    assert {r.iri for r in result.unsatisfiable.collect()} == {U + x for x in ("A2", "H", "N", "Q")}
    assert {(U + "A", U + "D"), (U + "B", U + "D"), (U + "X", U + "M"), (U + "V", U + "W")} <= {tuple(r) for r in result.edges.collect()}
    assert result.warnings == ["el: 1 axioms of kind inverse_object_properties are not used", "el: 1 axioms with exactly are used in part only", "el: 1 axioms with inverse are used in part only", "el: 1 axioms with only are used in part only", "el: 2 axioms with or are used in part only"]
    assert el.normal_form(catalog(spark, [])).collect() == []
    none = reason.classify(catalog(spark, []), "el")
    assert none.edges.collect() == [] and none.unsatisfiable.collect() == [] and none.equivalences.collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_of_any_length_equal_plain_python(spark, seed):
    rng = random.Random(seed)
    P = [U + x for x in "pqrstv"]
    N = [U + f"i{k}" for k in range(12)]
    chains = [(P[3], [P[0], P[1], P[2]]), (P[4], [P[0], P[1], P[2], P[1]]), (P[5], [P[0], P[1], P[0], P[1], P[2], P[0]]), (P[0], [P[3], "inverse " + P[4], P[2]]), (P[1], [P[2]])]
    chains += [(rng.choice(P), [rng.choice(P) for _ in range(rng.randint(2, 4))])]
    told = {(rng.choice(N), rng.choice(P[:3]), rng.choice(N)) for _ in range(14)}
    base = catalog(spark, [("property_chain", p, " o ".join(x)) for p, x in chains])
    rows = [(f"f{i}", "o", s, p, o, "object_property_assertion", []) for i, (s, p, o) in enumerate(sorted(told))]
    c = base.with_(axioms=base.axioms.union(spark.createDataFrame(rows, base.axioms.schema)))
    want = set(told)
    while True:
        more = set(want)
        for p, links in chains:
            ends = {(s, s) for s in N}
            for link in links:
                turned = link.startswith("inverse ")
                step = {(o, s) if turned else (s, o) for s, q, o in want if q == link.removeprefix("inverse ")}
                ends = {(s, o) for s, m in ends for m2, o in step if m == m2}
            more |= {(s, p, o) for s, o in ends}
        if more == want:
            break
        want = more
    assert {tuple(r) for r in reason.facts(c, "rl").collect()} == want and len(want) > len(told)
