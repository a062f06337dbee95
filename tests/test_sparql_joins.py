"""Joins on variables that may be unbound: as the definition says, and without nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.catalog import Catalog
from lattica.plans.sparql import Solution, Compiler, run_sparql


def solution(spark, rows, names, bound):
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))
    return Solution(df, set(bound), set(names) - set(bound))


def compatible(a, b):
    return all(a.get(k) is None or b.get(k) is None or a[k] == b[k] for k in a.keys() & b.keys())


def merged(a, b):
    return {k: a.get(k) if a.get(k) is not None else b.get(k) for k in {**a, **b}}


def shown(rows, names):
    return sorted(str([r.get(n) for n in sorted(names)]) for r in rows)


@pytest.mark.parametrize("seed", range(6))
def test_joins_equal_the_definition(spark, seed):
    rng = random.Random(seed)
    compiler = Compiler.__new__(Compiler)
    left_names, right_names = ["a", "b", "c", "x"], ["a", "b", "c", "y"]
    left_bound, right_bound = [{n for n in names if n in "xy" or rng.random() < 0.4} for names in (left_names, right_names)]
    table = lambda names, bound, n: [{k: str(rng.randint(0, 2)) if k in bound or rng.random() < 0.6 else None for k in names} for _ in range(n)]
    xs, ys = table(left_names, left_bound, 25), table(right_names, right_bound, 20)
    x, y = solution(spark, xs, left_names, left_bound), solution(spark, ys, right_names, right_bound)
    test = lambda r: r["x"] is not None and r["y"] is not None and r["x"] <= r["y"]
    condition = lambda scope: F.coalesce(scope["x"] <= scope["y"], F.lit(False))
    both = set(left_names + right_names)
    pairs = [(a, b) for a in xs for b in ys if compatible(a, b)]
    read = lambda s, names: sorted(str([r[n] for n in sorted(names)]) for r in s.df.collect())
    assert read(compiler.join(x, y), both) == shown([merged(a, b) for a, b in pairs], both)
    ok = [(a, b) for a, b in pairs if test(merged(a, b))]
    hit = {id(a) for a, _ in ok}
    assert read(compiler.join(x, y, "left", condition), both) == shown([merged(a, b) for a, b in ok] + [a for a in xs if id(a) not in hit], both)
    met = {id(a) for a, _ in pairs}
    assert read(compiler.exists(x, y, False), left_names) == shown([a for a in xs if id(a) in met], left_names)
    assert read(compiler.exists(x, y, True), left_names) == shown([a for a in xs if id(a) not in met], left_names)
    apart = {id(a) for a, b in pairs if any(a.get(k) is not None and b.get(k) is not None for k in "abc")}
    assert read(compiler.exists(x, y, True, strict_domain=True), left_names) == shown([a for a in xs if id(a) not in apart], left_names)


def test_no_nested_loops_in_the_plans(spark):
    c = Catalog.empty(spark)
    rows = [(f"urn:s{i}", "iri", p, f"urn:o{i % 7}", "iri", None, None, None, "d") for i in range(50) for p in ("urn:p", "urn:q", "urn:r") if i % 3 or p != "urn:q"]
    c = c.with_(quads=spark.createDataFrame(rows, c.quads.schema))
    for text in (
        "SELECT * WHERE { VALUES (?s ?o) { (<urn:s1> UNDEF) (UNDEF <urn:o2>) } ?s <urn:p> ?o }",
        "SELECT * WHERE { ?s <urn:p> ?o OPTIONAL { ?s <urn:q> ?x } OPTIONAL { ?s <urn:r> ?x } }",
        "SELECT * WHERE { ?s <urn:p> ?o OPTIONAL { ?s <urn:q> ?x OPTIONAL { ?x <urn:r> ?z } } OPTIONAL { ?s <urn:r> ?z } }",
        "SELECT * WHERE { { ?s <urn:p> ?o OPTIONAL { ?s <urn:q> ?x } } MINUS { ?s <urn:r> ?o OPTIONAL { ?s <urn:q> ?x } } }",
        "SELECT * WHERE { ?s <urn:p> ?o OPTIONAL { ?s <urn:q> ?x } FILTER NOT EXISTS { ?s <urn:r> ?x } }",
    ):
        frame = run_sparql(c, text).frame
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan, text
        frame.collect()
