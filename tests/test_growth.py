"""What queries write and hold as tables grow: results in full, from less."""

import json
import os
import random

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica import storage
from lattica.catalog import Catalog
from lattica import queries as library
from lattica.model import SWRL_RULE
from lattica.operators import edits, refactor, swrl, usages
from lattica.sources import rdf, scan, tables

SF = "/root/testdata/sf0.01"


def _bytes(folder: str) -> int:
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet"))


@pytest.fixture
def folder(monkeypatch, tmp_path):
    """A shared folder of its own."""
    monkeypatch.setattr(storage, "shared_dir", lambda spark: f"file://{tmp_path}")
    return str(tmp_path)


def test_indexed_tables_take_less_than_their_sources(spark, folder):
    tables._STORED.pop((spark.sparkContext.applicationId, SF), None)
    c = tables.stored(spark, SF)
    sources = sum(os.path.getsize(f"{SF}/{t}.parquet") for t in "region nation customer supplier part orders lineitem".split())
    assert _bytes(folder) < sources
    # Ids and quads are those of the whole catalog.
    whole = tables.from_tables(spark, SF)
    assert c.axioms.exceptAll(whole.axioms).isEmpty() and whole.axioms.exceptAll(c.axioms).isEmpty()
    assert c.quads.exceptAll(whole.quads).isEmpty() and c.quads.count() == whole.quads.count()
    assert c.entities.drop("characteristics").exceptAll(whole.entities.drop("characteristics")).isEmpty()
    tables._STORED.pop((spark.sparkContext.applicationId, SF))


def _axioms(spark, rows, entities):
    c = Catalog.empty(spark)
    made = spark.createDataFrame([(f"x{i}", "urn:o", s, p, o, k, []) for i, (s, p, o, k) in enumerate(rows)], c.axioms.schema)
    iris = spark.createDataFrame([(x,) for x in entities], "iri string").select("iri", *[F.lit(None).cast(f.dataType).alias(f.name) for f in c.entities.schema if f.name != "iri"])
    return c.with_(axioms=made, entities=iris.select(*c.entities.columns))


def test_module_has_a_row_for_each_hub_of_an_entity_and_no_more(spark, folder):
    n = 2_000
    rows = [(f"urn:s{i % 50}", "urn:p", f"urn:o{i}", "object_property_assertion") for i in range(n)]
    rows += [("urn:p", "", "urn:q some urn:D", "domain"), ("urn:q", "", "urn:E", "range"), ("urn:lone", "", "urn:else", "sub_class_of"), ("urn:o1", "", "urn:out", "sub_class_of"), ("urn:far", "", "urn:out", "sub_class_of")]
    iris = ["urn:p", "urn:q", "urn:D", "urn:E", "urn:lone", "urn:else", "urn:far", *(f"urn:s{i}" for i in range(50)), *(f"urn:o{i}" for i in range(n))]
    c = _axioms(spark, rows, iris)
    found = {r.iri for r in usages.module(c, spark.createDataFrame([("urn:o7",), ("urn:nowhere",)], "iri string")).collect()}
    # urn:out is no entity, so it links nothing.
    assert found == set(iris) - {"urn:lone", "urn:else", "urn:far"} | {"urn:nowhere"}
    written = [d for d in os.listdir(folder) if d.startswith("lattica-")]
    assert sum(spark.read.parquet(f"file://{folder}/{d}").count() for d in written) < 1.2 * len(iris) + 50


def test_axioms_of_a_module_keep_copies_and_leave_out_what_names_others(spark):
    rows = [("urn:a", "urn:p", "urn:b", "object_property_assertion"), ("urn:a", "urn:p", "urn:c", "object_property_assertion"), ("urn:a", "", "urn:none", "sub_class_of"), ("urn:none", "", "urn:nor", "sub_class_of"), ("urn:b", "", "urn:p some urn:a", "sub_class_of")]
    c = _axioms(spark, rows, ["urn:a", "urn:b", "urn:c", "urn:p"])
    c = c.with_(axioms=c.axioms.union(c.axioms.where("id = 'x0'")))
    inside = spark.createDataFrame([("urn:a",), ("urn:b",), ("urn:p",), ("urn:a",)], "iri string")
    found = usages.module_axioms(c, inside)
    assert found.columns == c.axioms.columns
    assert sorted(r.id for r in found.collect()) == ["x0", "x0", "x2", "x4"]


class _TermByTerm(edits._Places):
    def statement(self) -> bool:
        return False


def test_plain_statements_are_read_by_one_match_and_as_before():
    rng = random.Random(6)
    pieces = ["<urn:a>", "<>", '"x"', '""', '"x"^^<urn:d>', '"x"^^<>', '"x"@en', '"""l"""', '"a\\"b"', "_:b", ",", ";", ".", "# c\n", "a", ".5", "[", "]", "<urn:\\u0041>", "p:x", "{", "}", "@base <http://b/> ."]
    good = ["<urn:a> <urn:p> <urn:o> .", '<urn:a> <urn:p> "x" , "y"^^<urn:d> ;\n <urn:q> <urn:z> .', "p:x a <urn:T> ; <urn:p> 'q' .", "<urn:g> { <urn:a> <urn:p> <urn:o> . }", "<urn:a> <urn:p> <urn:o> ; .", '# c <urn:x>\n<urn:é> <urn:p> "ü" ;<urn:p> <urn:k>.']

    def read(cls, text):
        out = rdf.Parsed()
        places = None
        try:
            places = cls(text, out)
            places.document()
        except rdf._Stop as e:
            out.error = f"{e} {e.at}"
        return out.quads, out.prefixes, out.error, out.error or (places.terms, places.statements)

    for k in range(4_000):
        text = "@prefix p: <urn:> . " + "".join(rng.choice(good) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 3)))
        text += "".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randint(1, 6) * (k % 2)))
        fast = read(edits._Places, text)
        assert fast == read(_TermByTerm, text), text
        assert fast[0] == rdf.parse_turtle(text).quads
    steps = []
    places = edits._Places(good[1] * 50, rdf.Parsed())
    places.node = lambda: steps.append(1)
    places.document()
    assert not steps and len(places.statements) == 50


def test_files_give_the_rows_that_are_asked_for_a_few_mb_at_once(spark):
    texts = ["<urn:a> <http://www.w3.org/2000/01/rdf-schema#subClassOf> _:x . <urn:b> <urn:p> 'v'@en .", None, "<urn:a> <urn:p> <urn:b> . <broken", ""]
    files = spark.createDataFrame([(f"/m/{i}.ttl", i, "turtle", x) for i, x in enumerate(texts)], "path string, doc_order bigint, format string, text string")
    whole = scan.parse_files(files)
    key = ["path", "row", *"abcdefgh"]
    for kinds in ({"quad"}, {"axiom"}, {"quad", "error", "failure"}):
        assert scan.parse_files(files, kinds).select(key).exceptAll(whole.where(F.col("row").isin(*kinds)).select(key)).isEmpty()
        assert scan.parse_files(files, kinds).count() == whole.where(F.col("row").isin(*kinds)).count()
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20


def test_rules_hold_only_facts_that_they_read_or_make(spark, folder):
    atom = lambda p, a, b: {"kind": "property", "property": p, "args": [a, b]}
    kind = lambda c, a: {"kind": "class", "class": c, "args": [a]}
    rules = [
        {"body": [atom("urn:p", "?a", "?b")], "head": [atom("urn:q", "?b", "?a")]},
        {"body": [atom("urn:q", "?a", "?b"), kind("urn:C", "?a")], "head": [kind("urn:D", "?b"), atom(rdf.TYPE, "?a", "urn:E")]},
        {"body": [kind("urn:E", "?a"), atom("urn:p", "?a", "?b")], "head": [atom("urn:p", "?b", "?a")]},
    ]
    rows = [(f"urn:s{i}", "urn:other", f"urn:o{i}", "object_property_assertion") for i in range(500)]
    rows += [("urn:a", "urn:p", "urn:b", "object_property_assertion")] * 2 + [("urn:b", "urn:q", "urn:a", "object_property_assertion"), ("urn:b", rdf.TYPE, "urn:C", "class_assertion"), ("urn:b", "urn:p", "urn:c", "object_property_assertion"), ("urn:a", rdf.TYPE, "urn:D", "class_assertion")]
    c = _axioms(spark, rows, [])
    quads = [(f"urn:r{i}", "iri", SWRL_RULE, json.dumps(r), "literal", None, None, None, "d") for i, r in enumerate(rules)]
    found, warnings = swrl.materialise(c.with_(quads=spark.createDataFrame(quads, c.quads.schema)))
    assert not warnings
    # urn:b is an urn:E, as it is an urn:C to which something has urn:p; then urn:c has urn:p to it, and urn:b urn:q to urn:c.
    assert sorted(tuple(r) for r in found.collect()) == sorted([("urn:c", "urn:q", "urn:b"), ("urn:b", rdf.TYPE, "urn:E"), ("urn:c", "urn:p", "urn:b"), ("urn:b", "urn:q", "urn:c"), ("urn:c", rdf.TYPE, "urn:D")])
    assert sum(spark.read.parquet(f"file://{folder}/{d}").count() for d in os.listdir(folder)) < 50


def test_a_plan_compares_each_part_in_one_shuffle(spark):
    a = _axioms(spark, [("urn:a", "", "urn:b", "sub_class_of")] * 3 + [("urn:c", "", "urn:d", "sub_class_of")], [])
    b = _axioms(spark, [("urn:a", "", "urn:b", "sub_class_of")] + [("urn:e", "", "urn:f", "sub_class_of")] * 2, [])
    delta = refactor.plan(a, b)
    ops = sorted((r.op, json.loads(r.row)["subject"]) for r in delta.collect())
    assert ops == [("add", "urn:e"), ("add", "urn:e"), ("remove", "urn:a"), ("remove", "urn:a"), ("remove", "urn:c")]
    axioms = delta.where("part = 'axioms'")
    assert axioms._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1


def test_lines_of_a_diff_stay_in_their_tasks(spark, monkeypatch):
    monkeypatch.setattr(DataFrame, "collect", lambda self: pytest.fail("lines on the driver"))
    lines = library.QUERIES["v9_diff_text"](spark, SF)
    monkeypatch.undo()
    assert lines.count() > 100
