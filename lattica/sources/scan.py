"""Indexing a tree of ontology files: files in, a catalog out. One file is one row; parsing never leaves its task."""

from __future__ import annotations

import json
import os
import re
import subprocess
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.catalog import Catalog, merge_entities
from lattica.functions import exprs as X
from lattica.model import FORMATS, LatticaError, schema
from lattica.sources import bridge as B
from lattica.sources import obo, owx, rdf
from lattica.storage import cut

# Parsers by format.
PARSERS = {"turtle": rdf.parse_turtle, "trig": rdf.parse_turtle, "n_triples": rdf.parse_nquads, "n_quads": rdf.parse_nquads, "rdf_xml": rdf.parse_rdfxml, "json_ld": rdf.parse_jsonld, "owl_xml": owx.parse_owx, "obo": obo.parse_obo}


def _rule(line: str) -> tuple[str, bool, bool] | None:
    """Of a line of a .gitignore: a pattern for paths below its folder, whether it takes back, whether it is for folders only."""
    line = re.sub(r"(?<!\\) +$", "", line.rstrip("\r"))
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    folders = line.endswith("/")
    line = line.rstrip("/")
    if not line:
        return None
    anchored = "/" in line
    out, k = "", 0
    line = line.removeprefix("/")
    while k < len(line):
        c = line[k]
        if line.startswith("**/", k) and (k == 0 or line[k - 1] == "/"):
            out, k = out + "(?:[^/]+/)*", k + 3
        elif line.startswith("/**", k) and k + 3 == len(line):
            out, k = out + "/.+", k + 3
        elif c == "*":
            out, k = out + "[^/]*", k + (len(line[k:]) - len(line[k:].lstrip("*")))
        elif c == "?":
            out, k = out + "[^/]", k + 1
        elif c == "[" and (end := line.find("]", k + 2)) > 0:
            inside = line[k + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            inside = "^" + inside[1:] if inside[0] in "!^" else inside
            out, k = out + f"(?!/)[{inside}]", end + 1
        elif c == "\\" and k + 1 < len(line):
            out, k = out + re.sub(r"([^A-Za-z0-9])", r"\\\1", line[k + 1]), k + 2
        else:
            out, k = out + re.sub(r"([^A-Za-z0-9/_])", r"\\\1", c), k + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$", negated, folders


def ignore_files(spark: SparkSession, roots: list[str], depth: int) -> DataFrame:
    """path, text of the .gitignore files up to so many folders below the roots. Spark's readers pass over hidden files, so
    these few are found by a pattern for each depth and read by the file system's client."""
    jvm, conf, rows = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), []
    for root in roots:
        for k in range(depth + 1):
            pattern = jvm.org.apache.hadoop.fs.Path(root.rstrip("/") + "/*" * k + "/.gitignore")
            fs = pattern.getFileSystem(conf)
            for status in fs.globStatus(pattern) or []:
                stream = fs.open(status.getPath())
                rows.append((re.sub("^file:/*", "/", status.getPath().toString()), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
                stream.close()
    return spark.createDataFrame(rows, "path string, text string")


_RULE = "folder string, n bigint, pattern string, negated boolean, folders boolean"


def ignore_rules(files: DataFrame) -> DataFrame:
    """folder, n, pattern, negated, folders of .gitignore files (path, text)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(path.rpartition("/")[0], n, *rule) for path, text in zip(frame["path"], frame["text"]) for n, line in enumerate((text or "").split("\n")) if (rule := _rule(line))]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in _RULE.split(", ")])

    return files.select("path", "text").mapInPandas(run, _RULE)


def not_ignored(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """The paths (path, and more columns) that no rule leaves out.

    For a path and each folder above it, the rules of the folders above that one are tried; the last match of the deepest
    folder wins. What is below a folder that is left out is left out, whatever rules say of it: joins by folder and a
    maximum for each, no loop over rules."""
    parts = F.split("path", "/")
    own = paths.select("path").distinct().select("path", F.explode(F.sequence(F.lit(2), F.size(parts))).alias("k"))
    own = own.select("path", F.array_join(F.slice(parts, 1, F.col("k")), "/").alias("at"), (F.col("k") < F.size(parts)).alias("is_folder"))
    at = F.split("at", "/")
    above = own.select("path", "at", "is_folder", F.explode(F.sequence(F.lit(1), F.size(at) - 1)).alias("d"))
    above = above.select("path", "at", "is_folder", "d", F.array_join(F.slice(at, 1, F.col("d")), "/").alias("folder"))
    met = above.join(rules, "folder").where((F.col("is_folder") | ~F.col("folders")) & F.rlike(F.expr("substring(at, length(folder) + 2)"), F.col("pattern")))
    last = met.groupBy("path", "at").agg(F.max_by("negated", F.struct("d", "n")).alias("negated"))
    return paths.join(last.where("NOT negated").select("path").distinct(), "path", "left_anti")


def inside(paths: DataFrame, roots: list[str]) -> DataFrame:
    """The paths that stay below a root, without steps upwards or out of it."""
    below = reduce(Column.__or__, [F.startswith("path", F.lit(r.rstrip("/") + "/")) for r in roots])
    return paths.where(below & ~F.col("path").rlike(r"(?:^|/)\.\.(?:/|$)"))


class TooMuch(LatticaError):
    """A workspace beyond its limits."""


def scan_files(spark: SparkSession, roots: list[str], paths: list[str] | None = None, most_files: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """path, content, modified_time, size of files with a known extension under the roots and not ignored there, or of the
    paths given; each once. Limits, where given, are on the number of files and on the size of one."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    glob = "*.{" + ",".join(FORMATS) + "}"
    df = reader.load(paths) if paths is not None else reader.option("pathGlobFilter", glob).load(roots)
    path = F.regexp_replace("path", "^file:/*", "/")
    df = df.select(path.alias("path"), "content", F.unix_seconds("modificationTime").alias("modified_time"), F.col("length").alias("size"))
    if paths is None:
        df = inside(df, [os.path.abspath(r) if "://" not in r else r for r in roots])
        depth = df.agg(F.max(F.size(F.split("path", "/")))).first()[0] or 0
        df = not_ignored(df, ignore_rules(ignore_files(spark, roots, depth - min(len(r.rstrip("/").split("/")) for r in roots))))
    if most_files is not None or most_bytes is not None:
        n, largest = df.agg(F.count("*"), F.max("size")).first()
        if most_files is not None and n > most_files:
            raise TooMuch(f"{n} files, more than {most_files}")
        if most_bytes is not None and (largest or 0) > most_bytes:
            raise TooMuch(f"a file of {largest} bytes, more than {most_bytes}")
    return df.dropDuplicates(["path"])


def described(files: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """path, doc_order, format, content_hash, modified_time, size, text; overrides (path, text) replace or add files."""
    files = files.withColumn("text", F.decode("content", "UTF-8"))
    if overrides is not None:
        o = overrides.select(F.col("path").alias("o_path"), F.col("text").alias("o_text"))
        files = files.join(o, F.col("path") == F.col("o_path"), "full_outer").select(F.coalesce("path", "o_path").alias("path"), F.coalesce("o_text", "text").alias("text"), F.when(F.col("o_text").isNull(), F.col("content")).alias("content"), "modified_time", "size")
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    form = F.try_element_at(table, F.lower(F.substring_index("path", ".", -1)))
    digest = X.content_hash(F.coalesce("content", F.col("text").cast("binary")))
    rows = files.select("path", form.alias("format"), digest.alias("content_hash"), "modified_time", F.coalesce("size", F.length("text").cast("bigint")).alias("size"), "text")
    # Positions come from the paths alone: a list as long as the number of files.
    order = {p: i for i, p in enumerate(sorted(r.path for r in rows.select("path").toLocalIterator()))}
    known = files.sparkSession.createDataFrame(list(order.items()), "path string, doc_order bigint")
    return rows.join(known, "path")


_PARSED = "path string, doc_order bigint, row string, ord bigint, a string, b string, c string, d string, e string, f string, g string, h string"


#: Bytes of texts that travel to Python at once.
_AT_ONCE = 8 << 20


def in_small_batches(files: DataFrame) -> DataFrame:
    """files, in a session that hands texts to Python a few MB at a time (from now on, and for other jobs, too)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", files.sparkSession.conf.get(key))
    if not now or int(now[1]) > _AT_ONCE:
        files.sparkSession.conf.set(key, str(_AT_ONCE))
    return files


def parse_files(files: DataFrame, kinds: set[str] | None = None) -> DataFrame:
    """Rows of all kinds (row, ord, a..h) of each file; a file that can't be read gives an error row and what came before it.

    With kinds only their rows are made, numbered among themselves; quads alone need no bridge to axioms."""
    names = [c.split()[0] for c in _PARSED.split(", ")]
    types = [pa.int64() if c.endswith(" bigint") else pa.string() for c in _PARSED.split(", ")]
    bridged = kinds is None or bool(kinds & {"failure", "document", "entity", "axiom", "annotation"})

    def parsed_rows(order: int, form: str, text: str | None) -> list[tuple]:
        out: list[tuple] = []

        def add(row: str, *cells) -> None:
            if kinds is None or row in kinds:
                out.append((row, *cells, *[None] * (8 - len(cells))))

        parsed, rows = rdf.Parsed(), B.Rows()
        try:
            if text is None:
                raise OSError("the file has no readable text")
            form = "owl_xml" if form == "owl" and "<Ontology" in text[:4000] else "rdf_xml" if form == "owl" and text.lstrip().startswith("<") else "turtle" if form == "owl" else form
            parsed = PARSERS[form](text, "")
        except OSError as x:
            add("failure", "io_read_error", str(x))
        except Exception as x:  # a file must not take its siblings down
            add("error", f"{type(x).__name__}: {x}", None, None)
        if bridged:
            try:
                rows = B.bridge(parsed.quads)
            except Exception as x:  # what was parsed stays as quads
                add("failure", "owl_bridge_failed", f"{type(x).__name__}: {x}")
        if parsed.error:
            add("error", parsed.error, str(parsed.line or ""), str(parsed.column or 0))
        if kinds is None or "quad" in kinds:
            scope = lambda v, k: f"doc-{order}_{v}" if k == "bnode" else v
            out += [("quad", scope(s, sk), sk, p, scope(o, ok), ok, dt, lang, g) for s, sk, p, o, ok, dt, lang, g in parsed.quads]
        if bridged:
            add("document", rows.ontology_iri, rows.version_iri, json.dumps(rows.imports), json.dumps(parsed.prefixes))
            for iri, e in rows.entities.items() if kinds is None or "entity" in kinds else ():
                add("entity", iri, e["kind"], json.dumps(e["labels"]), json.dumps(e["comments"]), str(e["deprecated"]).lower(), e["obo_id"], json.dumps(e["characteristics"]))
            for kind, s, p, o, notes in rows.axioms if kinds is None or "axiom" in kinds else ():
                add("axiom", kind, s, p, o, json.dumps([{"predicate": a, "value": b} for a, b in notes]) if notes else "[]")
            for s, p, o in rows.annotations if kinds is None or "annotation" in kinds else ():
                add("annotation", s, p, o)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A text at a time; the others stay as they came.
            for path, order, form, text in zip(*batch.columns):
                rows = parsed_rows(order.as_py(), form.as_py(), text.as_py())
                n = len(rows)
                columns = list(zip(*rows)) or [()] * 9
                cells = [[path.as_py()] * n, [order.as_py()] * n, columns[0], range(n), *columns[1:]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names=names)

    return in_small_batches(files).select("path", "doc_order", "format", "text").mapInArrow(run, _PARSED)


def index(spark: SparkSession, roots: list[str], paths: list[str] | None = None, overrides: DataFrame | None = None, lint: bool = True, config: dict | None = None) -> Catalog:
    files = cut(described(scan_files(spark, roots, paths), overrides), "files")
    return assemble(spark, files, cut(parse_files(files.repartition(spark.sparkContext.defaultParallelism)), "parsed"), lint, config)


def index_texts(spark: SparkSession, texts: dict[str, str], lint: bool = True) -> Catalog:
    """The same for texts by path that no disk holds."""
    none = spark.createDataFrame([], "path string, content binary, modified_time bigint, size bigint")
    files = cut(described(none, spark.createDataFrame(list(texts.items()), "path string, text string")), "files")
    return assemble(spark, files, cut(parse_files(files), "parsed"), lint)


def assemble(spark: SparkSession, files: DataFrame, rows: DataFrame, lint: bool = True, config: dict | None = None) -> Catalog:
    of = lambda kind: rows.where(F.col("row") == kind)
    doc = F.concat(F.lit("doc-"), F.col("doc_order").cast("string"))
    errors = of("error").groupBy("path").agg(F.min_by(F.struct("a", "b", "c"), "ord").alias("x"))
    heads = of("document").select("path", "a", "b", "c", "d")
    d = files.drop("text").join(heads, "path", "left").join(errors, "path", "left")
    location = F.when(F.col("x").isNotNull(), F.struct(F.col("x.b").try_cast("bigint").alias("line"), F.col("x.c").try_cast("bigint").alias("column"), F.lit(None).cast("bigint").alias("start_byte"), F.lit(None).cast("bigint").alias("end_byte")))
    documents = cut(d.select("doc_order", doc.alias("id"), "path", "format", F.col("a").alias("base_iri"), F.col("b").alias("version_iri"), F.from_json("c", "array<string>").alias("imports"), F.from_json("d", "map<string,string>").alias("namespaces"), F.when(F.col("x").isNull(), "ok").otherwise("error").alias("parse_status"), "content_hash", "modified_time", F.col("x.a").alias("parse_message"), location.alias("parse_error_location")), "documents")
    owner = documents.select("path", F.coalesce("base_iri", "id").alias("ontology_id"))
    with_owner = lambda df: df.join(owner, "path")
    flags = schema("entities")["characteristics"].dataType.simpleString()
    entity = with_owner(of("entity")).select("doc_order", F.col("a").alias("iri"), X.short_name("a").alias("short_name"), F.col("b").alias("kind"), "ontology_id", F.lit(None).cast(schema("entities")["source_location"].dataType).alias("source_location"), F.from_json("c", "array<string>").alias("labels"), F.from_json("d", "array<string>").alias("comments"), (F.col("e") == "true").alias("deprecated"), F.col("f").alias("obo_id"), F.from_json("g", flags).alias("characteristics"))
    entities = cut(merge_entities(entity).select(*schema("entities").names), "entities")
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("path").orderBy("ord")) - 1
    axioms = cut(with_owner(of("axiom")).withColumn("n", n).select(F.concat(doc, F.lit("#axiom-"), F.col("n").cast("string")).alias("id"), "ontology_id", F.col("b").alias("subject"), F.col("c").alias("predicate"), F.col("d").alias("object"), F.col("a").alias("axiom_kind"), F.from_json("e", "array<struct<predicate: string, value: string>>").alias("annotations")), "axioms")
    annotations = with_owner(of("annotation")).select(F.col("a").alias("subject"), F.col("b").alias("predicate"), F.col("c").alias("object"), "ontology_id")
    quads = of("quad").select(F.col("a").alias("s"), F.col("b").alias("s_kind"), F.col("c").alias("p"), F.col("d").alias("o"), F.col("e").alias("o_kind"), F.col("f").alias("o_datatype"), F.col("g").alias("o_lang"), F.col("h").alias("g"), doc.alias("doc_id"))
    own = F.coalesce("base_iri", "id").alias("ontology_id")
    namespaces = documents.select(F.explode("namespaces").alias("prefix", "iri"), own)
    imports = documents.select(own, F.explode("imports").alias("import_iri"))
    catalog = Catalog(spark, documents, entities, annotations, axioms, namespaces, imports, quads, texts=files.select("path", "text"))
    if lint:
        from lattica.operators.diagnostics import collect, load_failures

        catalog = catalog.with_(diagnostics=cut(collect(catalog, config, load_failures(of("failure"))), "diagnostics"))
    return catalog


# -- XML catalogs, git, registries

def read_xml_catalog(path: str, root: str, seen: frozenset[str] = frozenset()) -> tuple[dict[str, str], dict[str, str]]:
    """uri -> file, and prefix -> prefix of rewrites, with nextCatalog; nothing outside root, no catalog twice."""
    real = os.path.realpath(path)
    if real in seen or not real.startswith(os.path.realpath(root) + os.sep) or not os.path.exists(real):
        return {}, {}
    uris: dict[str, str] = {}
    rewrites: dict[str, str] = {}

    def walk(e: ET.Element, base: str) -> None:
        base = os.path.join(base, e.get("{http://www.w3.org/XML/1998/namespace}base", "").removeprefix("file://"))
        for c in e:
            tag = c.tag.rpartition("}")[2]
            here = os.path.join(base, c.get("{http://www.w3.org/XML/1998/namespace}base", "").removeprefix("file://"))
            if tag == "uri":
                uris.setdefault(c.get("name", ""), os.path.normpath(os.path.join(here, c.get("uri", ""))))
            elif tag == "rewriteURI":
                rewrites.setdefault(c.get("uriStartString", ""), os.path.join(here, c.get("rewritePrefix", "")))
            elif tag == "nextCatalog":
                more = read_xml_catalog(os.path.join(here, c.get("catalog", "")), root, seen | {real})
                for own, other in zip((uris, rewrites), more):
                    for k, v in other.items():
                        own.setdefault(k, v)
            elif tag == "group":
                walk(c, base)

    try:
        walk(ET.parse(real).getroot(), os.path.dirname(real))
    except ET.ParseError:
        return {}, {}
    inside = os.path.realpath(root) + os.sep
    return {k: v for k, v in uris.items() if os.path.realpath(v).startswith(inside) or "://" in v}, rewrites


def redirects(spark: SparkSession, catalog: Catalog, path: str, root: str) -> DataFrame:
    """uri, target of the catalog's imports: exact entries, else the longest rewrite."""
    uris, rewrites = read_xml_catalog(path, root)
    rules = F.array(*[F.struct(F.lit(k).alias("namespace"), F.lit(v).alias("to")) for k, v in rewrites.items()]) if rewrites else None
    exact = F.try_element_at(F.create_map(*[F.lit(x) for p in uris.items() for x in p]), F.col("import_iri")) if uris else F.lit(None).cast("string")
    iri = F.col("import_iri")
    if rules is not None:
        fits = F.filter(rules, lambda r: F.startswith(iri, r["namespace"]))
        best = F.get(F.array_sort(fits, lambda x, y: F.length(y["namespace"]) - F.length(x["namespace"])), F.lit(0))
        exact = F.coalesce(exact, F.concat(best["to"], F.substring(iri, F.length(best["namespace"]) + 1, F.length(iri))))
    return catalog.imports.select("import_iri").distinct().select(iri.alias("uri"), exact.alias("target")).where("target IS NOT NULL")


def git_texts(repo: str, ref: str) -> dict[str, str]:
    """Path and text of the ontology files of a commit. They travel as rows: no folder of this machine is read by others."""
    names = subprocess.run(["git", "-C", repo, "ls-tree", "-r", "--name-only", "-z", ref], check=True, capture_output=True).stdout.decode().split("\0")
    show = lambda name: subprocess.run(["git", "-C", repo, "show", f"{ref}:{name}"], check=True, capture_output=True).stdout.decode(errors="replace")
    return {"/" + name: show(name) for name in names if name.rpartition(".")[2].lower() in FORMATS}


def git_range(repo: str, text: str) -> tuple[str, str | None]:
    """base and head of a..b, a...b (from the merge base), or a alone against the working tree (None)."""
    run = lambda *a: subprocess.run(["git", "-C", repo, *a], check=True, capture_output=True, text=True).stdout.strip()
    if "..." in text:
        a, b = text.split("...", 1)
        return run("merge-base", a or "HEAD", b or "HEAD"), b or "HEAD"
    if ".." in text:
        a, b = text.split("..", 1)
        return a or "HEAD", b or "HEAD"
    return text, None


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an OBO registry: id, title, preferred prefix, whether obsolete."""
    rows = spark.read.option("multiLine", True).json(path).select(F.explode("ontologies").alias("o"))
    fields = rows.schema["o"].dataType.names
    pick = lambda n: (F.col(f"o.{n}") if n in fields else F.lit(None)).cast("string").alias(n)
    return rows.select(pick("id"), pick("title"), pick("preferredPrefix"), pick("is_obsolete"))


def id_ranges(texts: DataFrame) -> DataFrame:
    """path, name, low, high of an id policy's blocks with allocatedto; exclusive bounds are moved by one."""
    blocks = texts.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?s)Datatype:.*?(?=Datatype:|$)"), F.lit(0))).alias("block"))
    at = lambda p: F.regexp_extract("block", p, 1)
    low = F.coalesce(at(r">=\s*(\d+)").try_cast("bigint"), at(r">\s*(\d+)").try_cast("bigint") + 1)
    high = F.coalesce(at(r"<=\s*(\d+)").try_cast("bigint"), at(r"<\s*(\d+)").try_cast("bigint") - 1)
    return blocks.select("path", at(r'allocatedto:?\s*"([^"]*)"').alias("name"), low.alias("low"), high.alias("high")).where("name <> '' AND low IS NOT NULL AND high IS NOT NULL")
