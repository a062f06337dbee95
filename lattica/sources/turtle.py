"""Turtle and TriG files of any size, read by many tasks.

A file is read as lines by Spark's text reader, which splits it anywhere; a task's lines of one split are a block. Whether a
block begins inside of a string, of brackets, of a graph or of a statement is known only from what comes before it, so

1. every block is scanned from each state in which it can begin (plain, or inside of one of the two kinds of long strings),
   and says in which state it would end, how brackets change, and which prefixes it declares;
2. these few facts of a file's blocks are put together in order, a row for each block: now each knows how it begins;
3. every block is read again: it parses its own statements from the first line that ends one for sure (a dot at the end of
   a line, outside of strings and brackets), and hands on what comes before and after them;
4. the pieces of a statement that crosses blocks are brought together and parsed.

Quads are those of the whole-file parser but for the names of blank nodes without a label. As there, what follows a file's
first error is not read, and the error has its line. Limits: a prefix is declared within the lines of one block; the driver
sees a row for each block (as many as tasks). A statement, or a graph whose name isn't on the line of its brace, is parsed
in one piece.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.sources.rdf import Parsed, _place, _Stop, _Turtle
from lattica.storage import cut

#: Characters of statements that are parsed together.
CHUNK = 1 << 16
#: How a block can begin: plain, or inside of a long string.
STATES = ("", '"""', "'''")
_SCAN = re.compile(r"""<[^<>\s]*>|\"\"\"|'''|"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|\#.*|[\[\](){}]|\\.""", re.S)
_CLOSE = {q: re.compile(rf"\\.|{q}", re.S) for q in STATES[1:]}
_DIRECTIVE = re.compile(r"@?\b(?:prefix\s+([\w.-]*):\s*|base\s+)(<[^<>\s]*>)", re.I)
_KEYWORD = re.compile(r"\b(?:prefix|base)\b", re.I)


class Scanner:
    """Follows strings, brackets and graphs from line to line; what is outside of strings and comments is code."""

    def __init__(self, state: str = "", depth: int = 0):
        self.state, self.depth = state, depth
        #: None: as before the block; "": in no graph; else a brace and what stands before it on its line. Whether all code
        #: so far ends statements.
        self.graph: str | None = None
        self.ended: bool | None = None
        self.directives: list[tuple[str | None, str]] = []
        self.waiting = ""

    def line(self, text: str) -> bool:
        """Reads a line; True if a statement or graph ends with it for sure, when brackets are closed."""
        at, code, last, name = 0, [], 0, 0
        while True:
            if self.state:
                m = _CLOSE[self.state].search(text, at)
                while m and m[0][0] == "\\":
                    m = _CLOSE[self.state].search(text, m.end())
                if not m:
                    break
                self.state, at = "", m.end()
                last = at
                code.append('""')
            m = _SCAN.search(text, at)
            if not m:
                code.append(text[at:])
                break
            token = m[0]
            code.append(text[at : m.start()])
            if token[0] == "#":
                break
            at = m.end()
            if token in _CLOSE:
                self.state = token
                continue
            if token in "[(":
                self.depth += 1
            elif token in "])":
                self.depth -= 1
            elif token == "{":
                self.graph = "{" + text[name : m.start()].strip()
            elif token == "}":
                self.graph, name = "", at
            if token not in "[](){}":
                last = at
            code.append(token if token[0] not in "\"'" else '""')
        if self.state:
            self.ended = False
        plain = "".join(code).rstrip()
        if not plain:
            return False
        if self.waiting or _KEYWORD.search(plain):
            self.waiting += plain + " "
            found = list(_DIRECTIVE.finditer(self.waiting))
            self.directives += [(m[1], m[2]) for m in found]
            self.waiting = self.waiting[found[-1].end() :] if found else self.waiting
            if not _KEYWORD.search(self.waiting) or self.waiting.count(" ") > 200:
                self.waiting = ""
        dot = text.rfind(".")
        self.ended = not self.state and (plain[-1] == "}" or plain[-1] == "." and dot >= last)
        return self.ended


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.text(paths, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """(path, block, lines) one after the other, as a task reads them."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for (path, block), group in itertools.groupby(rows, key=lambda r: r[1:]):
        yield path, block, (r[0] for r in group)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for path, block, lines in _blocks(batches):
        scanners, n = [Scanner(s) for s in STATES], 0
        for line in lines:
            n += 1
            for s in scanners:
                s.line(line)
        facts = [(s.state, s.depth, s.graph, s.ended, s.directives) for s in scanners]
        yield pa.RecordBatch.from_pydict({"path": [path], "block": [block], "lines": [n], "facts": [json.dumps(facts)]})


def _beginnings(frame: pd.DataFrame) -> pd.DataFrame:
    """How each block of a file begins, from the facts of all before it."""
    state, depth, graph, ended, prefixes, base, line, out = "", 0, "", True, {}, None, 1, []
    for r in frame.sort_values("block").itertuples():
        out.append((r.path, r.block, json.dumps([state, depth, graph, ended, prefixes, base, line])))
        after, change, inside, done, directives = json.loads(r.facts)[STATES.index(state)]
        state, depth, line = after, depth + change, line + r.lines
        graph = graph if inside is None else inside
        ended = (ended if done is None else done) and depth == 0 and not state and _splits(graph)
        for name, iri in directives:
            if name is None:
                base = iri
            else:
                prefixes = prefixes | {name: iri}
    return pd.DataFrame(out, columns=["path", "block", "begin"])


class _Reader:
    """Parses pieces of a file with the prefixes, base and graph that hold there."""

    def __init__(self, prefixes: dict[str, str], base: str, names: str):
        self.prefixes, self.base = prefixes, base
        self.fresh = (f"{names}{n}" for n in itertools.count())

    @staticmethod
    def begin(prefixes: dict[str, str], base: str | None, names: str) -> _Reader:
        """Declarations as they are written, resolved."""
        out = Parsed()
        head = (f"@base {base} . " if base else "") + "".join(f"@prefix {k}: {v} . " for k, v in prefixes.items())
        parser = _Turtle(head, "", out)
        parser.document()
        return _Reader(out.prefixes, parser.base, names)

    def parse(self, text: str, graph: str, open_: bool, line: int) -> tuple[list, tuple | None]:
        """Quads, and the error (message, line, column) that ended them."""
        head = f"{graph[1:]} {{ " if graph else ""
        out = Parsed(prefixes=dict(self.prefixes))
        error = None
        try:
            parser = _Turtle(head + text + (" }" if open_ else ""), self.base, out)
            parser.fresh = self.fresh
            parser.document()
            self.base = parser.base
        except _Stop as e:
            row, column = _place(head + text, e.at)
            error = (str(e), line + row - 1, max(0, column - (len(head) if row == 1 else 0)))
        except RecursionError:
            error = ("nested too deeply", line, 0)
        self.prefixes = out.prefixes
        return out.quads, error


_ROW = "path string, block bigint, part int, row string, s string, s_kind string, p string, o string, o_kind string, o_datatype string, o_lang string, g string, line bigint, col bigint"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _batch(path: str, block: int, part: int, rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string() if x.endswith(" string") else pa.int32() if x.endswith(" int") else pa.int64() for x in _ROW.split(", ")]
    whole = [(path, block, part, *r) for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*whole), types)], names=_NAMES)


def _quads(quads: list, error: tuple | None) -> list[tuple]:
    rows = [("quad", *q, None, None) for q in quads]
    return rows + ([("error", error[0], *[None] * 7, error[1], error[2])] if error else [])


def _parsed(batches: Iterator[pa.RecordBatch], begins: dict[tuple[str, int], str]) -> Iterator[pa.RecordBatch]:
    """Quads and errors of a block's own statements (part 0); head: text that ends a statement of earlier blocks, tail: text
    of one that later blocks end, with what holds there (both in column s)."""
    for path, block, lines in _blocks(batches):
        state, depth, graph, ended, prefixes, base, number = json.loads(begins[path, block])
        scanner, reader = Scanner(state, depth), _Reader.begin(prefixes, base, f"{block}x")
        scanner.graph = graph
        held, size, first, inside, failed = [], 0, number, graph, False
        ready = 0  # lines of held that end with a statement
        for line in lines:
            done = scanner.line(line) and scanner.depth == 0
            number += 1
            if failed:
                continue
            held.append(line)
            size += len(line) + 1
            if not done:
                continue
            if _splits(scanner.graph):
                ready = len(held)
            if not ended and ready:
                yield _batch(path, block, 0, [("head", "\n".join(held), scanner.graph or "", *[None] * 6, 1, None)])
                held, size, first, ready, inside, ended = [], 0, number, 0, scanner.graph, True
            elif size >= CHUNK and ready == len(held):
                rows = _quads(*reader.parse("\n".join(held), inside, bool(scanner.graph), first))
                failed = bool(rows) and rows[-1][0] == "error"
                if rows:
                    yield _batch(path, block, 0, rows)
                held, size, first, ready, inside = [], 0, number, 0, scanner.graph
        if failed:
            # What follows belongs to it, not to what came before.
            yield _batch(path, block, 1, [("tail", "", json.dumps([{}, "", ""]), *[None] * 6, number, None)])
            continue
        if not ended:
            yield _batch(path, block, 0, [("head", "\n".join(held), "", *[None] * 6, 0, None)])
            continue
        if ready:
            open_ = _graph_after(held[:ready], inside)
            rows = _quads(*reader.parse("\n".join(held[:ready]), inside, bool(open_), first))
            if rows:
                yield _batch(path, block, 0, rows)
            if rows and rows[-1][0] == "error":
                held, ready = [], 0
            first, inside, held = first + ready, open_, held[ready:]
        begin = json.dumps([reader.prefixes, reader.base, inside])
        yield _batch(path, block, 1, [("tail", "\n".join(held), begin, *[None] * 6, first, None)])


def _splits(graph: str) -> bool:
    """Whether statements can be parsed apart here: in no graph, or in one whose name is known from the line of its brace."""
    return not graph or bool(re.fullmatch(r"\{(?:graph\s+)?(?:<[^<>\s]*>|[\w.-]*:[^\s{}]*)", graph, re.I))


def _graph_after(lines: list[str], graph: str) -> str:
    scanner = Scanner()
    scanner.graph = graph
    for line in lines:
        scanner.line(line)
    return scanner.graph


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    """The statement that a tail and the heads after it make."""
    frame = frame.sort_values(["block", "part"])
    tail = frame[frame["row"] == "tail"].iloc[0]
    heads = frame[frame["row"] == "head"]
    text = "\n".join([*([tail["s"]] if tail["s"] else []), *heads["s"]])
    prefixes, base, inside = json.loads(tail["s_kind"])
    reader = _Reader(prefixes, base, f"{tail['block']}t")
    after = heads.iloc[-1]["s_kind"] if len(heads) and heads.iloc[-1]["line"] else inside
    rows = _quads(*reader.parse(text, inside, bool(after), int(tail["line"]))) if text.strip() else []
    return pd.DataFrame([(tail["path"], tail["block"], 1, *r) for r in rows], columns=_NAMES)


def read_turtle(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """Quads (s to g, doc_id: the path) and errors (doc_id, message, line, column: the first of each file that has one)."""
    paths = [paths] if isinstance(paths, str) else paths
    lines = _lines(spark, paths)
    facts = lines.mapInArrow(_scanned, "path string, block bigint, lines bigint, facts string")
    begins = {(r.path, r.block): r.begin for r in facts.groupBy("path").applyInPandas(_beginnings, "path string, block bigint, begin string").collect()}
    shared = spark.sparkContext.broadcast(begins)
    rows = cut(lines.mapInArrow(lambda batches: _parsed(batches, shared.value), _ROW), "turtle")
    # A head belongs to the last tail before it.
    in_order = Window.partitionBy("path").orderBy("block", "part")
    pieces = rows.where("row IN ('head', 'tail')").withColumn("start", F.last(F.when(F.col("row") == "tail", F.col("block")), ignorenulls=True).over(in_order))
    crossing = cut(pieces.where("start IS NOT NULL").groupBy("path", "start").applyInPandas(lambda frame: _joined(frame[_NAMES]), _ROW), "turtle-crossing")
    all_ = rows.where("row IN ('quad', 'error')").union(crossing)
    at = F.struct("block", "part")
    first = all_.where("row = 'error'").groupBy("path").agg(F.min_by(F.struct("block", "part", "s", "line", "col"), at).alias("e"))
    read = all_.where("row = 'quad'").join(first.select("path", F.struct("e.block", "e.part").alias("stop")), "path", "left").where(F.col("stop").isNull() | (at <= F.col("stop")))
    quads = read.select("s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang", "g", F.col("path").alias("doc_id"))
    return quads, first.select(F.col("path").alias("doc_id"), F.col("e.s").alias("message"), "e.line", F.col("e.col").alias("column"))
