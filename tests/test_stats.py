"""Characteristic sets, estimates, and joins in the order that they choose."""

import random

import pytest

from lattica.catalog import Catalog
from lattica.plans import stats
from lattica.plans.sparql import join_order, run_sparql


@pytest.fixture(scope="module")
def catalog(spark):
    rng, rows = random.Random(1), []
    add = lambda s, p, o: rows.append((s, "iri", "urn:" + p, o, "iri", None, None, None, "d"))
    for i in range(600):
        s = f"urn:s{i}"
        add(s, "type", "urn:T")
        add(s, "name", f"urn:n{i}")
        for _ in range(3):
            add(s, "link", f"urn:s{rng.randrange(600)}")
        if i % 3 == 0:
            add(s, "color", f"urn:c{i % 5}")
        if i % 60 == 0:
            add(s, "rare", "urn:r")
    c = Catalog.empty(spark)
    return c.with_(quads=spark.createDataFrame(sorted(set(rows)), c.quads.schema))


def test_sets_and_stars(catalog):
    rows = {tuple(x.rpartition(":")[2] for x in r.predicates): (r.subjects, dict(zip(r.predicates, r.triples))["urn:name"]) for r in stats.characteristic_sets(catalog.quads).collect()}
    assert rows == {("link", "name", "type"): (400, 400), ("color", "link", "name", "type"): (190, 190), ("color", "link", "name", "rare", "type"): (10, 10)}
    found = stats.gather(catalog.quads)
    star = lambda *names: found.star(frozenset("urn:" + n for n in names))
    assert star("type", "name") == 600 and star("color", "type") == 200 and star("rare", "color", "name") == 10 and star("rare", "nothing") == 0.5
    n = catalog.quads.where("p = 'urn:link'").join(catalog.quads.where("p = 'urn:color'").select("s"), "s").count()
    assert star("link", "color") == pytest.approx(n)
    assert stats.gather(catalog.quads.where("false")).total == 0


WORST = "SELECT ?s ?n ?x WHERE { ?s <urn:link> ?x . ?x <urn:name> ?n . ?s <urn:type> <urn:T> . ?s <urn:color> ?c . ?s <urn:rare> <urn:r> }"


def test_orders_are_by_expected_rows_and_change_no_result(catalog):
    found = stats.gather(catalog.quads)
    order = join_order(catalog, WORST, found)
    assert [t[2][1] for t, _ in order][0] == "urn:rare" and [t[2][1] for t, _ in order][-1] in ("urn:name", "urn:link")
    assert order[0][1] == 10 and all(n > 0 for _, n in order)
    read = lambda c, text, s=None: sorted(map(tuple, run_sparql(c, text, s).frame.collect()))
    texts = [WORST, "SELECT * WHERE { ?a <urn:link> ?b . ?b <urn:link> ?c . ?c <urn:rare> ?r }", "SELECT * WHERE { ?a <urn:rare> ?r . ?b <urn:color> ?c . ?b <urn:rare> ?r OPTIONAL { ?b <urn:link> ?x . ?x <urn:rare> ?y } }", "SELECT * WHERE { ?s ?p <urn:r> . ?s <urn:link>/<urn:color> ?c . ?s <urn:name> ?n }", "SELECT ?s WHERE { ?s <urn:none> ?x . ?s <urn:name> ?n }"]
    for text in texts:
        assert read(catalog, text, found) == read(catalog, text), text
    assert read(stats.clustered(catalog), WORST, found) == read(catalog, WORST)


def test_clustered_quads_are_read_by_predicate(spark, catalog):
    c = stats.clustered(catalog)
    files = c.quads.selectExpr("_metadata.file_path AS f", "p").distinct().groupBy("f").count().collect()
    assert len(files) >= 1 and "EqualTo(p,urn:rare)" in run_sparql(c, "SELECT ?s WHERE { ?s <urn:rare> ?o }").frame._jdf.queryExecution().executedPlan().toString()
