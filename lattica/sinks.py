"""Where results go: text, CSV, JSON, N-Triples, Turtle, RDF/XML and documentation pages."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.catalog import Catalog
from lattica.functions import exprs as X
from lattica.model import MAX_RESULT_ROWS, XSD
from lattica.operators.graph import text_tree
from lattica.plans.sqlgate import QueryResult
from lattica.sources.rdf import to_ntriples


def to_tsv(result: QueryResult, limit: int = MAX_RESULT_ROWS) -> Iterator[str]:
    """Lines: header, rows, and a mark where rows were left out; rows come one partition at a time."""
    yield "\t".join(result.columns)
    for n, row in enumerate(result.frame.limit(limit + 1).toLocalIterator()):
        if n == limit:
            yield "# truncated: true"
            return
        yield "\t".join("" if v is None else str(v) for v in row)


def write_csv(result: QueryResult, path: str) -> None:
    result.frame.write.mode("overwrite").option("header", True).csv(path)


def to_json(result: QueryResult, objects: bool = False, limit: int = MAX_RESULT_ROWS) -> str:
    """{columns, rows, truncated}; rows as lists, or as objects."""
    rows, more = result.rows(limit)
    return json.dumps({"columns": result.columns, "rows": [dict(zip(result.columns, r)) for r in rows] if objects else rows, "truncated": more})


def write_ntriples(quads: DataFrame, path: str) -> None:
    to_ntriples(quads).write.mode("overwrite").text(path)


def to_turtle(quads: DataFrame) -> DataFrame:
    """value: a block for each subject, predicates and objects in order."""
    from lattica.plans.sparql import object_term, subject_term

    rows = quads.where("g IS NULL").select(subject_term().alias("s"), F.concat(F.lit("<"), "p", F.lit(">")).alias("p"), object_term().alias("o"))
    # Dealt out by subject once, for its predicates and its block.
    by_p = rows.repartition("s").groupBy("s", "p").agg(F.array_join(F.array_sort(F.collect_set("o")), " , ").alias("os"))
    blocks = by_p.groupBy("s").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "p", "os"))), " ;\n    ").alias("body"))
    return blocks.select(F.concat("s", F.lit(" "), "body", F.lit(" .")).alias("value"))


RDFXML_HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">\n'
RDFXML_TAIL = "\n</rdf:RDF>\n"


def _xml(text: str) -> Column:
    c = F.col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\r", "&#13;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def to_rdfxml(quads: DataFrame) -> DataFrame:
    """value: an rdf:Description for each subject of the default graph, properties in order; between RDFXML_HEAD and
    RDFXML_TAIL any of them are a document. Predicates whose IRI does not end in an XML name can't be written."""
    local = F.regexp_extract("p", r"([\p{L}_][\p{L}\p{N}_.-]*)$", 1)
    rows = quads.where("g IS NULL").distinct().withColumn("local", local).where("local <> ''")
    about = F.when(F.col("s_kind") == "bnode", F.concat(F.lit('rdf:nodeID="'), "s", F.lit('"'))).otherwise(F.concat(F.lit('rdf:about="'), _xml("s"), F.lit('"')))
    space = F.concat(F.lit('<n:'), "local", F.lit(' xmlns:n="'), F.substring(_xml("p"), F.lit(1), F.length(_xml("p")) - F.length("local")), F.lit('"'))
    string = F.coalesce("o_datatype", F.lit(XSD + "string")) == XSD + "string"
    mark = F.when(F.coalesce("o_lang", F.lit("")) != "", F.concat(F.lit(' xml:lang="'), "o_lang", F.lit('"'))).when(~string, F.concat(F.lit(' rdf:datatype="'), _xml("o_datatype"), F.lit('"'))).otherwise("")
    literal = F.concat(mark, F.lit(">"), _xml("o"), F.lit("</n:"), "local", F.lit(">"))
    node = F.concat(F.when(F.col("o_kind") == "bnode", F.lit(' rdf:nodeID="')).otherwise(F.lit(' rdf:resource="')), _xml("o"), F.lit('"/>'))
    lines = rows.select(about.alias("about"), F.concat(F.lit("    "), space, F.when(F.col("o_kind") == "literal", literal).otherwise(node)).alias("line"))
    body = F.array_join(F.array_sort(F.collect_list("line")), "\n")
    return lines.groupBy("about").agg(body.alias("body")).select(F.concat(F.lit("  <rdf:Description "), "about", F.lit(">\n"), "body", F.lit("\n  </rdf:Description>")).alias("value"))


def write_rdfxml(quads: DataFrame, path: str) -> None:
    """A folder of files, each a document of its own."""

    def documents(frames):
        yield pd.DataFrame({"value": [RDFXML_HEAD.rstrip()]})
        yield from frames
        yield pd.DataFrame({"value": [RDFXML_TAIL.strip()]})

    to_rdfxml(quads).mapInPandas(documents, "value string").write.mode("overwrite").text(path)


def pages(catalog: Catalog, form: str = "markdown") -> DataFrame:
    """name, content of an index, the hierarchy, the properties and one page for each ontology.

    Rows of a page are joined to one string by their order; ontologies are pages of their own, so a page is as long as
    its ontology."""
    md = form == "markdown"
    end = ".md" if md else ".html"
    item = lambda c: F.concat(F.lit("- " if md else "<li>"), c, F.lit("" if md else "</li>"))
    page = lambda title, rows: F.concat(F.lit(f"# {title}\n\n" if md else f"<h1>{html.escape(title)}</h1>\n<ul>\n"), rows, F.lit("\n" if md else "\n</ul>\n"))
    lines = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), "\n")
    e = catalog.entities.withColumn("label", F.coalesce(F.get("labels", F.lit(0)), F.col("short_name")))
    counts = e.groupBy("kind").agg(F.count("*").alias("n"))
    index = counts.agg(lines(F.col("kind"), item(F.concat_ws(": ", "kind", F.col("n").cast("string")))).alias("c")).select(F.lit("index" + end).alias("name"), page("Index", F.col("c")).alias("content"))
    tree = text_tree(catalog)
    hierarchy = tree.agg(lines(F.col("path"), F.concat(F.repeat(F.lit("  "), F.col("level")), item(F.substring_index("path", "/", -1)))).alias("c")).select(F.lit("hierarchy" + end).alias("name"), page("Class hierarchy", F.col("c")).alias("content"))
    props = e.where(F.endswith("kind", F.lit("property"))).agg(lines(F.concat_ws(" ", "short_name", "iri"), item(F.concat_ws(" ", "label", F.concat(F.lit("("), "kind", F.lit(")"))))).alias("c")).select(F.lit("properties" + end).alias("name"), page("Properties", F.col("c")).alias("content"))
    own = e.groupBy("ontology_id").agg(lines(F.concat_ws(" ", "short_name", "iri"), item(F.concat_ws(" ", "label", F.concat(F.lit("<" if md else "&lt;"), "iri", F.lit(">" if md else "&gt;"))))).alias("c"))
    each = own.select(F.concat(X.slug("ontology_id"), F.lit(end)).alias("name"), F.concat(F.lit("# " if md else "<h1>"), "ontology_id", F.lit("\n\n" if md else "</h1>\n<ul>\n"), "c", F.lit("\n" if md else "\n</ul>\n")).alias("content"))
    return index.union(hierarchy).union(props).union(each)


def write_pages(catalog: Catalog, folder: str, form: str = "markdown") -> int:
    """One file for each page."""
    import os

    os.makedirs(folder, exist_ok=True)
    n = 0
    for r in pages(catalog, form).toLocalIterator():
        with open(os.path.join(folder, r.name), "w") as f:
            f.write(r.content)
        n += 1
    return n
