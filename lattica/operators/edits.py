"""Edits of Turtle sources by byte spans: what isn't edited stays as it is, comments and odd spacing too.

A lexer that keeps places turns each file into rows: ``statements`` (an object of a statement each, with its span, that of
its predicate and of the statement) and ``terms`` (an IRI each). Edits are rows as well: path, hash of the text they were
made for, start, end (bytes), text. ``rename`` makes them from the terms, ``triple_edits`` from triples to add or to remove.
``apply`` merges a file's edits in one pass: a file whose hash differs is stale, edits that overlap are in conflict, and
neither is changed. ``invert`` gives the edits that lead back to the same bytes.

Files are edited each in one task, side by side; changes go to them by path. Defined results: a triple that is there isn't
added again, one that isn't is not removed; files that can't be parsed are in state 'error' and have no spans; nulls in a
change match nothing. An object of kind 'expression' is a class expression in Manchester syntax with whole IRIs.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import exprs as X
from lattica.functions import manchester
from lattica.model import DEPRECATED, IMPORTS, LABEL, COMMENT, OWL, RDF, RDFS, SUB_CLASS, TYPE, XSD, LatticaError
from lattica.sources.bridge import Bridge
from lattica.sources.rdf import _PART, Parsed, _Stop, _Turtle
from lattica.sources.rdf import _STATEMENT as _PLAIN
from lattica.sources.scan import in_small_batches

EDIT = "path string, hash string, start bigint, end bigint, text string"
CHANGE = "path string, op string, s string, p string, o string, o_kind string, o_datatype string, o_lang string"
_STATEMENT = "path string, hash string, statement bigint, s string, p string, o string, o_kind string, o_datatype string, o_lang string, start bigint, end bigint, verb_start bigint, verb_end bigint, statement_start bigint, statement_end bigint"
_TERM = "path string, hash string, start bigint, end bigint, iri string, text string, role string"


@dataclass
class _Verb:
    p: str
    start: int
    end: int = 0
    objects: list[tuple[tuple, int, int]] = field(default_factory=list)
    commas: list[int] = field(default_factory=list)
    semicolons: list[int] = field(default_factory=list)


@dataclass
class _Statement:
    s: tuple
    start: int
    verbs: list[_Verb]
    end: int
    graph: str | None


class _Places(_Turtle):
    """The parser, which also keeps where things stand (in characters)."""

    def __init__(self, text: str, out: Parsed):
        self.statements: list[_Statement] = []
        self.terms: list[tuple[int, int, str, str]] = []
        self.level, self.done, self.node_start, self.role = 0, 0, 0, "node"
        super().__init__(text, "", out)

    def advance(self) -> tuple:
        self.done = self.at
        return super().advance()

    def iri(self) -> str:
        kind, start = self.token[0], self.token[2]
        out = super().iri()
        self.terms.append((start, self.done, out, kind))
        return out

    def statement(self) -> bool:
        m = _PLAIN.match(self.text, self.token[2])
        if not m:
            return False
        s, begin, place, quad = m[1][1:-1], m.start(), self.terms.append, self.out.quads.append
        subject, verbs, mark, verb = (s, "iri", None, None), [], ";", None
        place((begin, m.end(1), s, "iri"))
        for x in _PART.finditer(self.text, m.start(2), m.end(2)):
            iri, string, datatype, between = x.groups()
            at, end = x.span()
            if between:
                mark = between
                if between == ",":
                    verb.commas.append(at)
                else:
                    verb.semicolons.append(at)
            elif string:
                if datatype is not None:
                    place((x.start(3) - 1, end, datatype, "iri"))
                term = (string[1:-1], "literal", XSD + "string" if datatype is None else datatype, None)
                verb.objects.append((term, at, end))
                verb.end = end
                quad((s, "iri", verb.p, term[0], "literal", term[2], None, None))
            else:
                place((at, end, iri, "iri"))
                if mark == ";":
                    mark, verb = "", _Verb(iri, at)
                    verbs.append(verb)
                else:
                    verb.objects.append(((iri, "iri", None, None), at, end))
                    verb.end = end
                    quad((s, "iri", verb.p, iri, "iri", None, None, None))
        self.statements.append(_Statement(subject, begin, verbs, m.end(), None))
        self.at = m.end()
        self.advance()
        return True

    def node(self) -> tuple:
        if not self.level:
            self.node_start = self.token[2]
        self.level += 1
        out = super().node()
        self.level -= 1
        return out

    def properties(self, subject: tuple) -> None:
        if self.level:
            return super().properties(subject)
        start, verbs = self.node_start, []
        while True:
            at = self.token[2]
            if self.token[:2] == ("word", "a"):
                self.advance()
                verb = _Verb(TYPE, at)
            else:
                verb = _Verb(self.iri(), at)
            verbs.append(verb)
            while True:
                at = self.token[2]
                term = self.node()
                verb.objects.append((term, at, self.done))
                self.emit(subject, verb.p, term)
                if self.token[:2] != ("op", ","):
                    break
                verb.commas.append(self.token[2])
                self.advance()
            verb.end = self.done
            while self.token[:2] == ("op", ";"):
                verb.semicolons.append(self.token[2])
                self.advance()
            if not verb.semicolons or self.token[0] == "end" or self.token[0] == "op" and self.token[1] in ".]}":
                break
        end = self.token[2] + (self.token[:2] == ("op", "."))
        self.statements.append(_Statement(subject, start, verbs, end, self.graph))


def _read(text: str) -> tuple[_Places | None, Parsed]:
    out = Parsed()
    try:
        places = _Places(text, out)
        places.document()
        return places, out
    except (_Stop, RecursionError) as e:
        out.error = str(e)
        return None, out


class _Bytes:
    """Byte offsets of characters, and back."""

    def __init__(self, text: str):
        self.at = None if text.isascii() else [0, *accumulate(1 if c < "\x80" else 2 if c < "\u0800" else 3 if c < "\U00010000" else 4 for c in text)]

    def __call__(self, k: int) -> int:
        return k if self.at is None else self.at[k]


def _with_hash(files: DataFrame) -> DataFrame:
    return in_small_batches(files).where("text IS NOT NULL").select("path", "text", X.content_hash(F.col("text").cast("binary")).alias("hash"))


def _per_file(files: DataFrame, schema: str, rows) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text, digest in zip(frame["path"], frame["text"], frame["hash"]):
                places, _ = _read(text)
                if places:
                    yield pd.DataFrame([(path, digest, *r) for r in rows(places, text, _Bytes(text))], columns=names)

    return _with_hash(files).mapInPandas(run, schema)


def statements(files: DataFrame, predicates: list[str] | None = None) -> DataFrame:
    """An object of a statement of files (path, text) each, of all or some predicates: what it says and where it stands, in bytes."""

    def rows(places: _Places, text: str, at: _Bytes):
        for k, st in enumerate(places.statements):
            for v in st.verbs:
                for (o, kind, dt, lang), start, end in v.objects if predicates is None or v.p in predicates else ():
                    yield (k, st.s[0], v.p, o, kind, dt, lang, at(start), at(end), at(v.start), at(v.end), at(st.start), at(st.end))

    return _per_file(files, _STATEMENT, rows)


def terms(files: DataFrame) -> DataFrame:
    """Every IRI as it is written (role: iri or pname), with the whole IRI."""
    return _per_file(files, _TERM, lambda places, text, at: ((at(a), at(b), iri, text[a:b], role) for a, b, iri, role in places.terms))


def _written(iri: str, prefixes: dict[str, str]) -> str:
    """An IRI as a prefixed name, where a prefix of the file allows it."""
    fits = [(len(ns), p, iri[len(ns) :]) for p, ns in prefixes.items() if ns and iri.startswith(ns) and re.fullmatch(r"(?:[\w-](?:[\w.-]*[\w-])?)?", iri[len(ns) :])]
    if fits:
        _, p, local = max(fits)
        return f"{p}:{local}"
    return f"<{iri}>"


def _literal(value: str, datatype: str | None, lang: str | None, prefixes: dict[str, str]) -> str:
    escaped = value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n").replace("\r", "\\r").replace("\t", "\\t")
    return f'"{escaped}"' + (f"@{lang}" if lang else f"^^{_written(datatype, prefixes)}" if datatype and datatype != XSD + "string" else "")


_CARDINALITY = {"min": "minQualifiedCardinality", "max": "maxQualifiedCardinality", "exactly": "qualifiedCardinality"}


def _expression(t: tuple, prefixes: dict[str, str]) -> str:
    """A class expression as a Turtle node."""
    iri = lambda x: _written(x, prefixes)
    go = lambda x: _expression(x, prefixes)
    kind = t[0]
    if kind in ("class", "datatype"):
        return iri(t[1])
    role = lambda p: f"[ {iri(OWL + 'inverseOf')} {iri(p[8:])} ]" if p.startswith("inverse ") else iri(p)
    restriction = lambda p, *more: f"[ a {iri(OWL + 'Restriction')} ; {iri(OWL + 'onProperty')} {role(p)} ; " + " ; ".join(f"{iri(OWL + k)} {v}" for k, v in more) + " ]"
    if kind in ("and", "or"):
        return f"[ a {iri(OWL + 'Class')} ; {iri(OWL + ('intersectionOf' if kind == 'and' else 'unionOf'))} ( {' '.join(map(go, t[1]))} ) ]"
    if kind == "not":
        return f"[ a {iri(OWL + 'Class')} ; {iri(OWL + 'complementOf')} {go(t[1])} ]"
    if kind == "one_of":
        return f"[ a {iri(OWL + 'Class')} ; {iri(OWL + 'oneOf')} ( {' '.join(map(iri, t[1]))} ) ]"
    if kind in ("some", "only"):
        return restriction(t[1], ("someValuesFrom" if kind == "some" else "allValuesFrom", go(t[2])))
    if kind == "value":
        return restriction(t[1], ("hasValue", t[2][1] if t[2][0] == "literal" else iri(t[2][1])))
    if kind == "self":
        return restriction(t[1], ("hasSelf", "true"))
    if kind in _CARDINALITY:
        n = f'"{t[1]}"^^{iri(XSD + "nonNegativeInteger")}'
        return restriction(t[2], (_CARDINALITY[kind], n), ("onClass", go(t[3]))) if t[3] else restriction(t[2], (kind.replace("exactly", "") + ("Cardinality" if kind != "exactly" else "cardinality"), n))
    raise LatticaError(f"an expression of kind {kind} can't be written")


class _Editor:
    """Intervals that add and remove triples in one text."""

    def __init__(self, text: str, places: _Places, prefixes: dict[str, str]):
        self.text, self.places, self.prefixes = text, places, prefixes
        self.gone: list[tuple[int, int]] = []
        self.new: list[tuple[int, str]] = []

    @cached_property
    def bridge(self) -> Bridge:
        return Bridge(self.places.out.quads)

    def key(self, term: tuple) -> tuple:
        """What a term says, whatever its spelling; a blank node says its expression."""
        o, kind, dt, lang = term
        if kind == "bnode":
            return ("expression", self.bridge.text("_:" + o))
        return (kind, o) if kind == "iri" else (kind, o, dt or XSD + "string", (lang or "").lower())

    @staticmethod
    def wanted(c: tuple) -> tuple:
        op, s, p, o, kind, dt, lang = c
        if kind == "expression":
            tree = manchester.parse(o)
            return ("iri", tree[1]) if tree[0] == "class" else ("expression", manchester.render(tree, plain=True))
        return ("iri", o) if kind != "literal" else ("literal", o, None if dt is None and lang is None else dt or (RDF + "langString" if lang else XSD + "string"), (lang or "").lower())

    def matches(self, want: tuple, key: tuple) -> bool:
        """A literal without datatype and language is any with that text."""
        if want[0] == "literal" and key[0] == "literal":
            return want[1] == key[1] and (want[2] is None or (want[2] == key[2] or bool(want[3])) and want[3] == key[3])
        return want == key

    def separators(self, kept: list[int], marks: list[list[int]], last_may_stay: bool) -> None:
        """Marks between kept parts: one group stays between two of them, the others go."""
        keep = set(kept[:-1]) | ({kept[-1]} if last_may_stay and kept and kept[-1] == len(marks) - 1 else set())
        for i, group in enumerate(marks):
            if i not in keep:
                self.gone += [(k, k + 1) for k in group]

    def remove(self, st: _Statement, gone: set[tuple[int, int]]) -> list[int]:
        """Takes objects (verb, object) out of a statement; the verbs that stay."""
        left = [[j for j in range(len(v.objects)) if (i, j) not in gone] for i, v in enumerate(st.verbs)]
        kept = [i for i, x in enumerate(left) if x]
        if not kept:
            self.gone.append((st.start, st.end))
            return []
        for i, v in enumerate(st.verbs):
            if not left[i]:
                self.gone.append((v.start, v.end))
            elif len(left[i]) < len(v.objects):
                self.gone += [v.objects[j][1:] for j in range(len(v.objects)) if j not in left[i]]
                self.separators(left[i], [[c] for c in v.commas] + [[]], False)
        if len(kept) < len(st.verbs):
            self.separators(kept, [v.semicolons for v in st.verbs], True)
        return kept

    def edit(self, changes: list[tuple]) -> None:
        own = [st for st in self.places.statements if st.graph is None and st.s[1] == "iri"]
        by_subject: dict[str, list[_Statement]] = defaultdict(list)
        for st in own:
            by_subject[st.s[0]].append(st)
        removed: dict[int, set] = defaultdict(set)
        for c in changes:
            if c[0] == "remove":
                want = self.wanted(c)
                for st in by_subject.get(c[1], []):
                    for i, v in enumerate(st.verbs):
                        if v.p == c[2]:
                            removed[id(st)] |= {(i, j) for j, (term, _, _) in enumerate(v.objects) if self.matches(want, self.key(term))}
        kept = {}
        for st in own:
            if removed.get(id(st)):
                kept[id(st)] = self.remove(st, removed[id(st)])
        added: dict[str, dict[str, list[str]]] = defaultdict(lambda: defaultdict(list))
        for c in changes:
            if c[0] == "add":
                want = self.wanted(c)
                there = any(v.p == c[2] and self.matches(want, self.key(term)) and (i, j) not in removed.get(id(st), ()) for st in by_subject.get(c[1], []) for i, v in enumerate(st.verbs) for j, (term, _, _) in enumerate(v.objects))
                text = _literal(c[3], c[5], c[6], self.prefixes) if c[4] == "literal" else _expression(manchester.parse(c[3]), self.prefixes) if c[4] == "expression" else _written(c[3], self.prefixes)
                if not there and text not in added[c[1]][c[2]]:
                    added[c[1]][c[2]].append(text)
        verb = lambda p: "a" if p == TYPE else _written(p, self.prefixes)
        tail = []
        for s, verbs in added.items():
            lines = [f"{verb(p)} {' , '.join(o)}" for p, o in verbs.items() if o]
            home = next((st for st in reversed(by_subject.get(s, [])) if kept.get(id(st), [0])), None)
            if lines and home is not None:
                last = home.verbs[kept[id(home)][-1] if id(home) in kept else -1]
                self.new.append((last.end, "".join(f" ;\n    {x}" for x in lines)))
            elif lines:
                tail.append(f"{_written(s, self.prefixes)} " + " ;\n    ".join(lines) + " .\n")
        if tail:
            self.new.append((len(self.text), ("" if not self.text or self.text.endswith("\n") else "\n") + "".join(tail)))

    def intervals(self) -> list[tuple[int, int, str]]:
        """Without overlaps; a line of which nothing is left goes altogether."""
        merged: list[list[int]] = []
        fixed = {k for k, _ in self.new}
        for a, b in sorted(self.gone):
            if merged and (a <= merged[-1][1] or not self.text[merged[-1][1] : a].strip() and not any(merged[-1][1] <= k <= a for k in fixed)):
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        out = []
        for a, b in merged:
            start, end = self.text.rfind("\n", 0, a) + 1, self.text.find("\n", b)
            end = len(self.text) if end < 0 else end + 1
            if not self.text[start:a].strip() and not self.text[b:end].strip() and not any(start <= k < end for k in fixed):
                a, b = start, end
            out.append((a, b, ""))
        return sorted([*out, *((k, k, x) for k, x in self.new)])


def triple_edits(files: DataFrame, changes: DataFrame) -> DataFrame:
    """Edits of files (path, text) that make ``changes``: path, op (add or remove), s, p, o, o_kind (iri, literal, expression),
    o_datatype, o_lang."""
    names = [x.split()[0] for x in CHANGE.split(", ")]
    used = changes.select(*names).where("op IN ('add', 'remove') AND s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")
    by_path = used.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*names[1:]))).alias("changes"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text, digest, wanted in zip(frame["path"], frame["text"], frame["hash"], frame["changes"]):
                places, parsed = _read(text)
                if places:
                    editor, at = _Editor(text, places, parsed.prefixes), _Bytes(text)
                    editor.edit([tuple(c[n] for n in names[1:]) for c in wanted])
                    yield pd.DataFrame([(path, digest, at(a), at(b), x) for a, b, x in editor.intervals()], columns=["path", "hash", "start", "end", "text"])

    return _with_hash(files).join(by_path, "path").mapInPandas(run, EDIT)


def rename(files: DataFrame, old: str, new: str) -> DataFrame:
    """Edits that write another IRI wherever one is written; as a prefixed name where it was one and a prefix allows it."""

    def rows(places: _Places, text: str, at: _Bytes):
        for a, b, iri, role in places.terms:
            if iri == old and text[a:b] != "":
                yield (at(a), at(b), _written(new, places.out.prefixes) if role == "pname" else f"<{new}>")

    return _per_file(files.where(F.contains("text", F.lit(re.split(r"[#/:]", old)[-1]))), EDIT, rows)


def migrate_namespace(files: DataFrame, old: str, new: str) -> DataFrame:
    """Edits of every IRI in angle brackets that begins with a namespace; prefixed names follow their prefix."""
    found = terms(files).where((F.col("role") == "iri") & F.startswith("iri", F.lit(old)))
    return found.select("path", "hash", "start", "end", F.concat(F.lit("<" + new), F.substring("iri", len(old) + 1, 1 << 30), F.lit(">")).alias("text"))


def _planned(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, text, hash, edits (sorted), state: ok, stale or conflict."""
    one = F.struct("start", "end", "text", "hash")
    by_path = edits.groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("edits"))
    rows = _with_hash(files).join(by_path, "path")
    pairs = F.zip_with(F.slice("edits", 1, F.greatest(F.size("edits") - 1, F.lit(0))), F.slice("edits", 2, F.greatest(F.size("edits") - 1, F.lit(0))), lambda a, b: (b["start"] < a["end"]) | ((a["start"] == b["start"]) & (a["end"] == b["end"])))
    stale = F.exists("edits", lambda e: e["hash"] != F.col("hash")) | F.exists("edits", lambda e: (e["end"] > F.octet_length("text")) | (e["start"] > e["end"]) | (e["start"] < 0))
    return rows.withColumn("state", F.when(stale, "stale").when(F.exists(pairs, lambda x: x), "conflict").otherwise("ok"))


def apply(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, text, state of the files with edits; text is as it was where the state isn't ok."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, text, state, wanted in zip(frame["path"], frame["text"], frame["state"], frame["edits"]):
                if state == "ok":
                    raw, parts, at = text.encode(), [], 0
                    for e in wanted:
                        parts += [raw[at : e["start"]], e["text"].encode()]
                        at = e["end"]
                    text = b"".join([*parts, raw[at:]]).decode()
                out.append((path, text, state))
            yield pd.DataFrame(out, columns=["path", "text", "state"])

    return _planned(files, edits).mapInPandas(run, "path string, text string, state string")


def invert(files: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits of the texts after ``apply`` that give the texts before it; files: those before."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, text, state, wanted, digest in zip(frame["path"], frame["text"], frame["state"], frame["edits"], frame["new_hash"]):
                raw, shift, out = text.encode(), 0, []
                for e in wanted if state == "ok" else []:
                    size = len(e["text"].encode())
                    out.append((path, digest, e["start"] + shift, e["start"] + shift + size, raw[e["start"] : e["end"]].decode()))
                    shift += size - (e["end"] - e["start"])
                yield pd.DataFrame(out, columns=["path", "hash", "start", "end", "text"])

    after = _with_hash(apply(files, edits).where("state = 'ok'")).select("path", F.col("hash").alias("new_hash"))
    return _planned(files, edits).join(after, "path").mapInPandas(run, EDIT)


# What operations are called, and the predicate that each is about; kind of the object.
NOUNS = {
    "label": (LABEL, "literal"), "comment": (COMMENT, "literal"), "sub_class_of": (SUB_CLASS, "iri"), "complex_sub_class_of": (SUB_CLASS, "expression"),
    "equivalent_class": (OWL + "equivalentClass", "expression"), "disjoint_class": (OWL + "disjointWith", "iri"), "import": (IMPORTS, "iri"), "domain": (RDFS + "domain", "iri"), "range": (RDFS + "range", "iri"),
    "class_assertion": (TYPE, "iri"), "sub_object_property_of": (RDFS + "subPropertyOf", "iri"), "sub_data_property_of": (RDFS + "subPropertyOf", "iri"), "inverse_object_properties": (OWL + "inverseOf", "iri"),
    "deprecated": (DEPRECATED, "literal"), "version_iri": (OWL + "versionIRI", "iri"), "datatype_definition": (OWL + "equivalentClass", "expression"),
    "object_property_assertion": (None, "iri"), "data_property_assertion": (None, "literal"), "annotation": (None, "literal"), "ontology_annotation": (None, "literal"),
    **{name: (TYPE, OWL + name.title() + "Property") for name in ("functional", "transitive", "symmetric", "asymmetric", "reflexive", "irreflexive")},
    "inverse_functional": (TYPE, OWL + "InverseFunctionalProperty"),
}


def operations(files: DataFrame, ops: DataFrame) -> DataFrame:
    """Changes from operations (path, op, subject, predicate, value): add_, remove_ or set_ and a noun of NOUNS.

    set_ replaces all values of the subject's predicate; for characteristics of properties its value is 'true' or 'false'."""
    noun = F.regexp_replace("op", "^(add|remove|set)_", "")
    table = files.sparkSession.createDataFrame([(k, p, o if not o.startswith(OWL) else "iri", o if o.startswith(OWL) else None) for k, (p, o) in NOUNS.items()], "noun string, own string, kind string, type string")
    rows = ops.withColumn("noun", noun).join(F.broadcast(table), "noun").withColumn("p", F.coalesce("own", "predicate"))
    flag = F.col("type").isNotNull()
    true = F.lower("value") == "true"
    way = F.when(flag, F.when(true | F.startswith("op", F.lit("add_")), "add").otherwise("remove")).when(F.startswith("op", F.lit("remove_")), "remove").otherwise("add")
    datatype = F.when(F.col("noun") == "deprecated", F.lit(XSD + "boolean"))
    said = rows.select("path", way.alias("op"), F.col("subject").alias("s"), "p", F.coalesce("type", "value").alias("o"), F.col("kind").alias("o_kind"), F.when(F.col("noun") == "deprecated", datatype).alias("o_datatype"), F.lit(None).cast("string").alias("o_lang"))
    replaced = rows.where(F.startswith("op", F.lit("set_")) & ~flag).select("path", F.col("subject").alias("s"), "p", F.col("value").alias("new"))
    now = statements(files).select("path", "s", "p", "o", "o_kind", "o_datatype", "o_lang").distinct()
    gone = replaced.join(now, ["path", "s", "p"]).where("o_kind <> 'bnode' AND o <> new").select("path", F.lit("remove").alias("op"), "s", "p", "o", "o_kind", "o_datatype", "o_lang")
    return said.unionByName(gone)
