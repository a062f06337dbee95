"""Indexing files, the virtual tables, the SQL subset, diagnostics, sinks and incremental indexing."""

import json
import os
import shutil
import subprocess

import pytest

from lattica import sinks
from lattica.cli import main
from lattica.model import LatticaError
from lattica.plans.sqlgate import list_sql_tables, run_sql
from lattica.sources import rdf, scan
from lattica.workspace import Workspace

FIXTURES = os.path.join(os.path.dirname(__file__), "fixtures", "main")
P = "http://example.org/people#"


@pytest.fixture(scope="module")
def catalog(spark):
    return scan.index(spark, [FIXTURES])


def test_counts(catalog):
    n = {r.metric: r.value for r in catalog.stats().collect()}
    assert (n["ontologies"], n["parse_errors"], n["classes"], n["object_properties"], n["data_properties"], n["annotation_properties"], n["individuals"]) == (8, 0, 17, 3, 1, 1, 2)


def test_tables_have_their_columns(catalog):
    tables = list_sql_tables()
    assert len(tables) == 18
    for t in tables:
        frame = catalog.view(t["name"])
        assert frame.columns == [c["name"] for c in t["columns"]]
        assert all(v is not None for r in frame.collect() for v in r)


def test_axioms(catalog):
    rows = {(r.axiom_kind, r.subject.rpartition("/")[2], r.object.rpartition("/")[2]) for r in catalog.axioms.collect()}
    for want in [("sub_class_of", "people#Person", "people#Being"), ("domain", "people#worksFor", "people#Person"), ("class_assertion", "people#alice", "people#Person"), ("data_property_assertion", "people#alice", "30"), ("different_individuals", "things#y", "things#x"), ("disjoint_class", "clinic#Dog", "clinic#Cat"), ("equivalent_class", "clinic#Patient", "clinic#Case"), ("sub_class_of", "org#Department", "people#Company"), ("sub_class_of", "j#J", "j#K"), ("sub_class_of", "DEMO_0000002", "obo/DEMO_0000001".rpartition("/")[2])]:
        assert want in rows
    r = catalog.view("restrictions").where("class_iri LIKE '%Patient'").first()
    assert (r.property_iri.rpartition("#")[2], r.restriction_kind) == ("hasRecord", "some")


ACCEPTED = ["SELECT * FROM classes", "select Iri, labels AS l from CLASSES where deprecated = 'false'", "SELECT iri FROM classes WHERE (kind = 'class')", "SELECT iri FROM classes WHERE TRUE", "SELECT iri FROM classes WHERE iri <> '' AND (kind = 'class' OR kind != 'x');", "SELECT iri FROM classes WHERE 'class' = kind", "SELECT line FROM diagnostics WHERE line = 7"]
REJECTED = ["", "DELETE FROM classes", "SELECT * FROM nowhere", "SELECT nothing FROM classes", "SELECT iri FROM classes ORDER BY iri", "SELECT iri FROM classes LIMIT 3", "SELECT DISTINCT iri FROM classes", "SELECT count(*) FROM classes", "SELECT iri FROM classes GROUP BY iri", "SELECT a.iri FROM classes a", "SELECT iri FROM classes, entities", "SELECT iri FROM classes JOIN entities ON 1 = 1", "SELECT iri FROM classes WHERE deprecated", "SELECT iri FROM classes WHERE iri LIKE 'x'", "SELECT iri FROM classes WHERE iri IN ('x')", "SELECT iri FROM classes WHERE iri > 'x'", "SELECT iri FROM classes WHERE NOT iri = 'x'", "SELECT iri FROM classes WHERE iri = NULL", "SELECT iri FROM classes WHERE iri = \"Person\"", "SELECT iri FROM classes UNION SELECT iri FROM classes", "WITH x AS (SELECT 1) SELECT iri FROM classes", "SELECT iri FROM classes; SELECT iri FROM classes", "SELECT iri, iri FROM classes", "SELECT iri || 'x' FROM classes", "SELECT iri FROM classes FETCH FIRST 1 ROWS ONLY", "SELECT iri FROM (SELECT * FROM classes)", "SELECT iri", "SELECT iri FROM classes WHERE iri IS NULL"]


@pytest.mark.parametrize("sql", ACCEPTED)
def test_sql_accepts(catalog, sql):
    run_sql(catalog, sql).rows()


@pytest.mark.parametrize("sql", REJECTED)
def test_sql_rejects(catalog, sql):
    with pytest.raises(LatticaError):
        run_sql(catalog, sql)


def test_results_are_cut_with_a_mark(catalog):
    result = run_sql(catalog, "SELECT iri FROM classes")
    rows, more = result.rows(5)
    assert len(rows) == 5 and more
    assert list(sinks.to_tsv(result, 2))[-1] == "# truncated: true"
    assert json.loads(sinks.to_json(result))["truncated"] is False


def test_diagnostics(spark):
    head = "@prefix : <http://l/#> .\n@prefix owl: <http://www.w3.org/2002/07/owl#> .\n@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> .\n"
    c = scan.index_texts(spark, {
        "/a.ttl": head + "<http://l/a> a owl:Ontology ; owl:imports <http://l/missing> .\n:A a owl:Class .\n",
        "/b.ttl": head + "<http://l/b> a owl:Ontology .\n:X a owl:Class ; rdfs:label \"Shared\" ; rdfs:subClassOf :Y .\n:Y a owl:Class ; rdfs:label \" shared\" .\n",
        "/c.ttl": "<http://l/c> a owl:Ontology .\n",
        "/d.ttl": head + "<http://l/d> a owl:Ontology .\n:Z a owl:Class ; rdfs:label \"zed\" ; rdfs:subClassOf foo:bar .\n",
    })
    rows = {(r.code, r.severity, r.file, (r.entity_iri or "").rpartition("#")[2]) for r in c.diagnostics.collect()}
    for want in [("broken_import", "error", "/a.ttl", ""), ("missing_label", "warning", "/a.ttl", "A"), ("orphan_class", "warning", "/a.ttl", "A"), ("duplicate_label", "warning", "/b.ttl", "X"), ("duplicate_label", "warning", "/b.ttl", "Y"), ("parse_error", "error", "/c.ttl", ""), ("parse_error", "error", "/d.ttl", ""), ("undefined_prefix", "error", "/d.ttl", "")]:
        assert want in rows
    assert c.documents.where("parse_status = 'ok'").count() == 2
    assert not any(r[3] in ("X", "Y") and r[0] == "orphan_class" for r in rows)


@pytest.mark.parametrize("text, n", [
    ("@prefix : <u:> . :a :p 1, 2.5, 1e3, true, \"x\"@EN, \"\"\"l\"q\"\"\" ; :q [ :r :b ] , ( 1 2 ) .", 13),
    ("PREFIX : <u:>\n:g { :a :b :c . :d :e :f }\n:x :y :z .", 3),
    ("<u:a> <u:b> 'it\\u0041' . # end", 1),
])
def test_turtle(text, n):
    got = rdf.parse_turtle(text)
    assert got.error is None and len(got.quads) == n


@pytest.mark.parametrize("text", ["<u:a> <u:b> .", ":a :b :c .", "<u:a> <u:b> <u:c>", "<u:a> <u:b> \"x", "{ <u:a> <u:b>"])
def test_turtle_errors_keep_what_came_before(text):
    got = rdf.parse_turtle("<u:x> <u:y> <u:z> .\n" + text)
    assert got.error and got.line >= 2 and len(got.quads) >= 1


def test_blank_nodes_of_files_stay_apart(spark):
    c = scan.index_texts(spark, {f"/{k}.ttl": f"<u:{k}> <u:p> _:x . _:x <u:q> <u:{k}> ." for k in "ab"}, lint=False)
    from lattica.plans.sparql import run_sparql

    assert sorted(tuple(r) for r in run_sparql(c, "SELECT ?s ?o WHERE { ?s <u:p> ?b . ?b <u:q> ?o }").frame.collect()) == [("<u:a>", "<u:a>"), ("<u:b>", "<u:b>")]


def test_incremental_equals_full(spark, tmp_path):
    root = str(tmp_path / "w")
    shutil.copytree(FIXTURES, root)
    ws = Workspace.open(spark, root)
    with open(f"{root}/aaa.ttl", "w") as f:
        f.write("<u:n> <u:p> _:z .")
    with open(f"{root}/example.ttl", "a") as f:
        f.write("\nex:New a owl:Class ; rdfs:label \"new\" .\n")
    os.remove(f"{root}/terms.obo")
    states = {r.state: r.n for r in ws.reindex_incremental().collect()}
    assert states == {"reused": 6, "reparsed": 2, "removed": 1}
    full = scan.index(spark, [root])
    for name in ("entities", "axioms", "annotations", "quads", "imports", "documents"):
        a, b = (sorted(map(str, getattr(c, name).drop("modified_time").collect())) for c in (ws.catalog, full))
        assert a == b, name


def test_overrides_gitignore_and_xml_catalog(spark, tmp_path):
    root = str(tmp_path)
    for name, text in {"a.ttl": "<u:a> <u:p> <u:b> .", "skip.ttl": "<u:s> <u:p> <u:b> .", ".gitignore": "skip.ttl\n"}.items():
        with open(f"{root}/{name}", "w") as f:
            f.write(text)
    o = spark.createDataFrame([(f"{root}/a.ttl", "<u:changed> <u:p> <u:b> ."), (f"{root}/new.ttl", "<u:new> <u:p> <u:b> .")], "path string, text string")
    c = scan.index(spark, [root], overrides=o)
    assert {r.s for r in c.quads.collect()} == {"u:changed", "u:new"}
    with open(f"{root}/catalog-v001.xml", "w") as f:
        f.write('<catalog xmlns="urn:oasis:names:tc:entity:xmlns:xml:catalog"><uri name="http://i/x" uri="a.ttl"/><rewriteURI uriStartString="http://r/" rewritePrefix="sub/"/><nextCatalog catalog="catalog-v001.xml"/></catalog>')
    uris, rewrites = scan.read_xml_catalog(f"{root}/catalog-v001.xml", root)
    assert uris == {"http://i/x": os.path.realpath(root) + "/a.ttl"} and list(rewrites) == ["http://r/"]


def test_command_line(spark, tmp_path, capsys):
    assert main(["query", FIXTURES, "SELECT short_name FROM annotation_properties"], spark) == 0
    assert capsys.readouterr().out.split() == ["short_name", "note"]
    assert main(["query", FIXTURES, "SELECT x FROM classes"], spark) == 2
    assert main(["sparql", FIXTURES, "ASK { ?s ?p ?o }", "--format", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["rows"] == [{"boolean": "true"}]
    assert main(["docs", FIXTURES, str(tmp_path / "out")], spark) == 0
    assert (tmp_path / "out" / "index.md").read_text().startswith("# Index")


def test_git_ranges(spark, tmp_path):
    repo = str(tmp_path)
    git = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    for k, text in enumerate(["<http://g#A> a <http://www.w3.org/2002/07/owl#Class> .", "<http://g#B> a <http://www.w3.org/2002/07/owl#Class> ."]):
        with open(f"{repo}/a.ttl", "w") as f:
            f.write(text)
        git("add", "-A")
        git("commit", "-qm", str(k))
    found = Workspace.open(spark, repo).diff_git(repo, "HEAD~1..HEAD")
    assert sorted((r.change, r.iri) for r in found.entities.collect()) == [("added", "http://g#B"), ("removed", "http://g#A")]


def test_snapshot_store_gives_what_parsing_gives(spark, tmp_path):
    from lattica.workspace import Workspace

    root = tmp_path / "w"
    root.mkdir()
    (root / "a.ttl").write_text("@prefix ex: <http://x/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . @prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . ex:A a owl:Class ; rdfs:subClassOf [ a owl:Restriction ; owl:onProperty ex:p ; owl:someValuesFrom ex:B ] .")
    (root / "b.ttl").write_text("@prefix ex: <http://x/> . @prefix owl: <http://www.w3.org/2002/07/owl#> . ex:B a owl:Class .")
    shown = lambda w: [sorted(map(str, f.collect())) for f in (w.catalog.quads, w.catalog.axioms, w.catalog.entities, w.catalog.documents.drop("modified_time"))]
    open_ = lambda **k: Workspace(spark, [str(root)], **k)
    store = str(tmp_path / "store")
    first = open_(store=store)
    assert shown(first) == shown(open_())
    # A file before the others moves them; its content is that of b.
    (root / "A.ttl").write_text((root / "b.ttl").read_text())
    (root / "b.ttl").unlink()
    parsed, plain = [], __import__("lattica.sources.scan", fromlist=["x"])
    keep = plain.parse_files
    plain.parse_files = lambda files: (parsed.append(files.count()), keep(files))[1]
    try:
        again = open_(store=store)
    finally:
        plain.parse_files = keep
    assert parsed == [0] and shown(again) == shown(open_())
    (root / "a.ttl").unlink()
    last = open_(store=store)
    assert last.prune_snapshots() == 1 and shown(open_(store=store)) == shown(open_())
    # Another configuration reads nothing of it; classifications are kept by state and profile.
    assert open_(store=store, config={"missing_label": "off"}).store.path != last.store.path
    assert last.classify("rdfs") is last.classify("rdfs") and last.classify("rl") is not last.classify("rdfs")


def test_failures_have_codes_of_their_own(spark, monkeypatch):
    from lattica.sources import bridge, scan

    ok = bridge.bridge
    monkeypatch.setattr(bridge, "bridge", lambda quads: 1 / 0 if any("bad" in str(q) for q in quads) else ok(quads))
    files = spark.createDataFrame([("/a.ttl", 0, "turtle", "<http://x/bad> a <http://www.w3.org/2002/07/owl#Class> ."), ("/b.ttl", 1, "turtle", None), ("/c.ttl", 2, "turtle", "<http://x/c> a <http://www.w3.org/2002/07/owl#Class> .")], "path string, doc_order bigint, format string, text string")
    from lattica.operators.diagnostics import load_failures

    run = scan.parse_files(files)
    rows = {r.path: r for r in load_failures(run.where("row = 'failure'")).withColumnRenamed("file", "path").collect()}
    assert rows["/b.ttl"].code == "io_read_error" and rows["/b.ttl"].severity == "warning" and "/c.ttl" not in rows
    # The bridge runs in a worker, where it isn't replaced: the row is made by hand.
    one = load_failures(spark.createDataFrame([("/a.ttl", "owl_bridge_failed", "ValueError: x")], "path string, a string, b string")).first()
    assert (one.code, one.severity, one.file, one.message) == ("owl_bridge_failed", "warning", "/a.ttl", "ValueError: x")


def test_git_texts(spark, tmp_path):
    import subprocess

    from lattica.sources.scan import git_texts

    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.ttl").write_text("<http://x/a> a <http://x/b> .")
    (tmp_path / "n.md").write_text("no")
    run("add", "-A")
    run("commit", "-qm", "x")
    (tmp_path / "o" / "a.ttl").write_text("changed")
    assert git_texts(str(tmp_path), "HEAD") == {"/o/a.ttl": "<http://x/a> a <http://x/b> ."}
