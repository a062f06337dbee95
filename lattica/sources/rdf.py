"""Readers of RDF syntaxes: text to quads (s, s_kind, p, o, o_kind, o_datatype, o_lang, g), one file at a time.

N-Triples and N-Quads have a line for each quad and are read natively, split anywhere (``read_ntriples``). The other
syntaxes nest, so a file is read by one call: Turtle and TriG by recursive descent, RDF/XML and OWL/XML over an XML
tree, JSON-LD over its JSON (inline contexts). A reader hands on what it read before an error, and the error."""

from __future__ import annotations

import itertools
import json
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field
from urllib.parse import urljoin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.model import FIRST, NIL, RDF, REST, TYPE, XSD

Quad = tuple  # s, s_kind, p, o, o_kind, o_datatype, o_lang, g


@dataclass
class Parsed:
    quads: list[Quad] = field(default_factory=list)
    prefixes: dict[str, str] = field(default_factory=dict)
    error: str | None = None
    line: int | None = None
    column: int | None = None


class _Stop(Exception):
    def __init__(self, message: str, at: int):
        super().__init__(message)
        self.at = at


# -- N-Triples and N-Quads, natively

_IRI, _BNODE, _LIT = r"<([^<>\s]*)>", r"_:(\S+?)", r'"((?:[^"\\]|\\.)*+)"(?:@([A-Za-z]+(?:-[A-Za-z0-9]+)*+)|\^\^<([^<>\s]*)>)?'
_LINE = rf"^\s*(?:{_IRI}|{_BNODE})\s+{_IRI}\s+(?:{_IRI}|{_BNODE}|{_LIT})\s*(?:{_IRI}|{_BNODE})?\s*\.\s*(?:#.*)?$"


def _unescaped(c: Column) -> Column:
    """The escapes of N-Triples; \\u and \\U by the JSON reader, which knows the same ones but the long form."""
    long = F.regexp_replace(c, r"\\U0000([0-9A-Fa-f]{4})", r"\\u$1")
    quoted = F.concat(F.lit('{"v":"'), F.regexp_replace(F.regexp_replace(long, "\t", r"\\t"), r"\\'", "'"), F.lit('"}'))
    return F.when(F.contains(c, F.lit("\\")), F.coalesce(F.get_json_object(quoted, "$.v"), c)).otherwise(c)


def parse_lines(lines: DataFrame) -> DataFrame:
    """Quads of a column ``value`` of lines (and doc_id), and ok: false for lines that are neither quads, comments nor blank."""
    rows = lines.where(~F.col("value").rlike(r"^\s*(?:#.*)?$"))
    # One match: its groups, which can't hold a line end, in lines of their own.
    groups = F.split(F.regexp_replace("value", _LINE, "\n".join(f"${k}" for k in range(1, 11))), "\n", -1)
    rows = rows.select("*", groups.alias("groups"))
    part = lambda k: F.when(F.size("groups") == 10, F.get("groups", F.lit(k - 1))).otherwise("")
    g = F.coalesce(F.nullif(part(9), F.lit("")), F.nullif(part(10), F.lit("")))
    literal = (part(4) == "") & (part(5) == "") & F.col("value").rlike(r'^\S+\s+\S+\s+"')
    return rows.select(
        F.when(part(1) != "", _unescaped(part(1))).otherwise(part(2)).alias("s"),
        F.when(part(1) != "", "iri").otherwise("bnode").alias("s_kind"),
        _unescaped(part(3)).alias("p"),
        F.when(literal, _unescaped(part(6))).when(part(4) != "", _unescaped(part(4))).otherwise(part(5)).alias("o"),
        F.when(literal, "literal").when(part(4) != "", "iri").otherwise("bnode").alias("o_kind"),
        F.when(literal & (part(7) == ""), F.when(part(8) != "", part(8)).otherwise(XSD + "string")).alias("o_datatype"),
        F.when(literal & (part(7) != ""), F.lower(part(7))).alias("o_lang"),
        g.alias("g"),
        "doc_id",
        (F.size("groups") == 10).alias("ok"),
    )


def read_ntriples(spark, path: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("doc_id"))
    return parse_lines(lines)


def to_ntriples(quads: DataFrame) -> DataFrame:
    """value: a line for each quad."""
    from lattica.plans.sparql import object_term, subject_term

    g = F.when(F.col("g").isNotNull(), F.concat(F.lit(" <"), "g", F.lit(">"))).otherwise("")
    return quads.select(F.concat(subject_term(), F.lit(" <"), "p", F.lit("> "), object_term(), g, F.lit(" .")).alias("value"))


# -- Turtle and TriG

_TOKEN = re.compile(
    r"""(?:\s++|\#[^\n]*+)*+(?:(?P<iri><(?:[^<>"{}|^`\\\x00-\x20]|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8})*>)
    |(?P<string>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<blank>_:[\w](?:[\w.-]*[\w-])?)
    |(?P<pname>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:%-]|\\.)(?:(?:[\w.:%-]|\\.)*(?:[\w:%-]|\\.))?)?)
    |(?P<number>[+-]?(?:\d+\.?\d*[eE][+-]?\d+|\.\d+[eE][+-]?\d+|\d*\.\d+|\d+))
    |(?P<word>[A-Za-z]+)
    |(?P<op>\^\^|[.;,()\[\]{}]))""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text, flags=re.S)


_PLAIN_IRI = r"""<[^<>"{}|^`\\\x00-\x20]*+>"""
_PLAIN = rf"""(?:{_PLAIN_IRI}|"(?!"")[^"\\\n\r]*+"(?:\^\^(?!<>){_PLAIN_IRI})?+)"""
_VERB = rf"{_PLAIN_IRI}\s++{_PLAIN}(?:\s*+,\s*+{_PLAIN})*+"
#: A statement of whole IRIs and literals without escapes or language tags, and its parts.
_STATEMENT = re.compile(rf"({_PLAIN_IRI})\s++({_VERB}(?:\s*+;\s*+{_VERB})*+)\s*+\.(?!\d)")
_PART = re.compile(r"""<([^>]*+)>|("[^"]*+")(?:\^\^<([^>]*+)>)?+|([,;])""")


class _Turtle:
    def __init__(self, text: str, base: str, out: Parsed):
        self.text, self.base, self.out, self.at = text, base, out, 0
        self.graph: str | None = None
        self.fresh = itertools.count()
        self.token: tuple[str, str, int] = ("end", "", 0)
        self.advance()

    def advance(self) -> tuple[str, str, int]:
        before = self.token
        m = _TOKEN.match(self.text, self.at)
        if m:
            self.token, self.at = (m.lastgroup, m[m.lastgroup], m.start(m.lastgroup)), m.end()
        else:
            rest = re.compile(r"(?:\s+|#[^\n]*)*").match(self.text, self.at).end()
            if rest < len(self.text):
                self.token = ("bad", self.text[rest], rest)
            else:
                self.token = ("end", "", rest)
        return before

    def fail(self, message: str):
        raise _Stop(message, self.token[2])

    def op(self, text: str) -> bool:
        if self.token[:2] == ("op", text):
            self.advance()
            return True
        return False

    def resolve(self, text: str) -> str:
        inner = unescape(text[1:-1])
        return inner if re.match(r"^[A-Za-z][\w+.-]*:", inner) or not self.base else urljoin(self.base, inner)

    def iri(self) -> str:
        kind, text, at = self.token
        if kind == "iri":
            self.advance()
            return self.resolve(text)
        if kind == "pname":
            prefix, _, local = text.partition(":")
            if prefix not in self.out.prefixes:
                self.fail(f"The prefix {prefix}: has not been declared")
            self.advance()
            return self.out.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        self.fail(f"expected an IRI, found {text or 'the end'}")

    def statement(self) -> bool:
        """Reads a plain statement; what it leaves is read term by term, and so are relative IRIs."""
        m = _STATEMENT.match(self.text, self.token[2])
        if not m:
            return False
        s, p, add, mark = m[1][1:-1], None, self.out.quads.append, ";"
        for iri, string, datatype, between in _PART.findall(m[2]):
            if between:
                mark = between
            elif string:
                add((s, "iri", p, string[1:-1], "literal", datatype or XSD + "string", None, None))
            elif mark == ";":
                p, mark = iri, ""
            else:
                add((s, "iri", p, iri, "iri", None, None, None))
        self.at = m.end()
        self.advance()
        return True

    def document(self) -> None:
        while self.token[0] != "end":
            kind, text, _ = self.token
            if kind == "iri" and not self.base and self.statement():
                continue
            word = text.lower() if kind in ("word", "lang") else ""
            if word in ("@prefix", "prefix"):
                self.advance()
                kind, name, _ = self.token
                if kind != "pname" or not name.endswith(":"):
                    self.fail("expected a prefix")
                self.advance()
                self.out.prefixes[name[:-1]] = self.iri()
                if word[0] == "@" and not self.op("."):
                    self.fail("expected .")
            elif word in ("@base", "base"):
                self.advance()
                self.base = self.iri()
                if word[0] == "@" and not self.op("."):
                    self.fail("expected .")
            elif word == "graph" or kind == "op" and text == "{":
                if word == "graph":
                    self.advance()
                    self.graph = self.iri()
                self.block()
            else:
                start, before = self.token, len(self.out.quads)
                subject = self.node()
                if self.token[:2] == ("op", "{") and start[0] in ("iri", "pname"):
                    self.graph = subject[0]
                    self.block()
                    continue
                if not (start[:2] == ("op", "[") and len(self.out.quads) > before and self.token[:2] == ("op", ".")):
                    self.properties(subject)
                if not self.op("."):
                    self.fail(f"expected ., found {self.token[1] or 'the end'}")

    def block(self) -> None:
        if not self.op("{"):
            self.fail("expected {")
        while not self.op("}"):
            self.properties(self.node())
            if not self.op(".") and self.token[:2] != ("op", "}"):
                self.fail("expected . or }")
        self.graph = None

    def emit(self, s: tuple, p: str, o: tuple) -> None:
        if s[1] == "literal":
            self.fail("a literal can't be a subject")
        self.out.quads.append((s[0], s[1], p, o[0], o[1], o[2], o[3], self.graph))

    def properties(self, subject: tuple) -> None:
        while True:
            if self.token[:2] == ("word", "a"):
                self.advance()
                p = TYPE
            else:
                p = self.iri()
            while True:
                self.emit(subject, p, self.node())
                if not self.op(","):
                    break
            if not self.op(";"):
                return
            while self.op(";"):
                pass
            if self.token[0] == "end" or self.token[0] == "op" and self.token[1] in ".]}":
                return

    def blank(self) -> tuple:
        return (f"genid{next(self.fresh)}", "bnode", None, None)

    def node(self) -> tuple:
        kind, text, _ = self.token
        if kind in ("iri", "pname"):
            return (self.iri(), "iri", None, None)
        if kind == "blank":
            self.advance()
            return (text[2:], "bnode", None, None)
        if kind == "string":
            self.advance()
            quote = 3 if text[:3] in ('"""', "'''") else 1
            lexical = unescape(text[quote:-quote])
            if self.token[0] == "lang":
                return (lexical, "literal", None, self.advance()[1][1:].lower())
            return (lexical, "literal", self.iri() if self.op("^^") else XSD + "string", None)
        if kind == "number":
            self.advance()
            return (text, "literal", XSD + ("double" if re.search("[eE]", text) else "decimal" if "." in text else "integer"), None)
        if kind == "word" and text in ("true", "false"):
            self.advance()
            return (text, "literal", XSD + "boolean", None)
        if self.op("["):
            own = self.blank()
            if not self.op("]"):
                self.properties(own)
                if not self.op("]"):
                    self.fail("expected ]")
            return own
        if self.op("("):
            items = []
            while not self.op(")"):
                items.append(self.node())
            cells = [self.blank() for _ in items] + [(NIL, "iri", None, None)]
            for cell, item, after in zip(cells, items, cells[1:]):
                self.emit(cell, FIRST, item)
                self.emit(cell, REST, after)
            return cells[0]
        self.fail(f"unexpected {text or 'end of file'}")


def _place(text: str, at: int) -> tuple[int, int]:
    return text.count("\n", 0, at) + 1, at - (text.rfind("\n", 0, at) + 1)


def parse_turtle(text: str, base: str = "") -> Parsed:
    out = Parsed()
    try:
        _Turtle(text, base, out).document()
    except _Stop as e:
        out.error = str(e)
        out.line, out.column = _place(text, e.at)
    except RecursionError:
        out.error = "nested too deeply"
    return out


def parse_nquads(text: str, base: str = "") -> Parsed:
    """The same lines for a whole text, where a single file is at hand."""
    out, rx = Parsed(), re.compile(_LINE.replace("*+", "*"))
    for n, line in enumerate(text.split("\n"), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        m = rx.match(line)
        if not m:
            out.error, out.line, out.column = out.error or "not a quad", out.line or n, 0
            continue
        s = (unescape(m[1]), "iri") if m[1] is not None else (m[2], "bnode")
        o = (unescape(m[4]), "iri", None, None) if m[4] is not None else (m[5], "bnode", None, None) if m[5] is not None else (unescape(m[6]), "literal", None if m[7] else m[8] or XSD + "string", m[7] and m[7].lower())
        out.quads.append((*s, unescape(m[3]), *o, m[9] or m[10]))
    return out


# -- RDF/XML

_XML = "{http://www.w3.org/XML/1998/namespace}"
_R = "{" + RDF + "}"


def _tag(name: str) -> str:
    return name[1:].replace("}", "") if name[:1] == "{" else name


class _RdfXml:
    def __init__(self, out: Parsed, base: str):
        self.out, self.base, self.fresh = out, base, itertools.count()

    def emit(self, s: tuple, p: str, o: tuple) -> None:
        self.out.quads.append((s[0], s[1], p, *o, None))

    def blank(self) -> tuple:
        return (f"genid{next(self.fresh)}", "bnode", None, None)

    def node(self, e: ET.Element, base: str, lang: str | None) -> tuple:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        if (about := e.get(_R + "about")) is not None:
            own = (urljoin(base, about) if base else about, "iri", None, None)
        elif (key := e.get(_R + "ID")) is not None:
            own = (base.split("#")[0] + "#" + key, "iri", None, None)
        elif (key := e.get(_R + "nodeID")) is not None:
            own = (key, "bnode", None, None)
        else:
            own = self.blank()
        if e.tag != _R + "Description":
            self.emit(own, TYPE, (_tag(e.tag), "iri", None, None))
        for k, v in e.attrib.items():
            if not k.startswith((_R, _XML)) or k == _R + "type":
                self.emit(own, _tag(k), (v, "iri", None, None) if k == _R + "type" else (v, "literal", None if lang else XSD + "string", lang))
        n = 0
        for child in e:
            tag = _tag(child.tag)
            if child.tag == _R + "li":
                n += 1
                tag = f"{RDF}_{n}"
            self.property(own, tag, child, base, lang)
        return own

    def property(self, s: tuple, p: str, e: ET.Element, base: str, lang: str | None) -> None:
        base, lang = e.get(_XML + "base", base), e.get(_XML + "lang", lang)
        kind = e.get(_R + "parseType")
        if (resource := e.get(_R + "resource")) is not None:
            o = (urljoin(base, resource) if base else resource, "iri", None, None)
        elif (key := e.get(_R + "nodeID")) is not None:
            o = (key, "bnode", None, None)
        elif kind == "Collection":
            items = [self.node(c, base, lang) for c in e]
            cells = [self.blank() for _ in items] + [(NIL, "iri", None, None)]
            for cell, item, after in zip(cells, items, cells[1:]):
                self.emit(cell, FIRST, item)
                self.emit(cell, REST, after)
            o = cells[0]
        elif kind == "Resource":
            o = self.blank()
            for c in e:
                self.property(o, _tag(c.tag), c, base, lang)
        elif kind == "Literal":
            o = ((e.text or "") + "".join(ET.tostring(c, encoding="unicode") for c in e), "literal", RDF + "XMLLiteral", None)
        elif len(e):
            o = self.node(e[0], base, lang)
        else:
            datatype = e.get(_R + "datatype")
            o = (e.text or "", "literal", datatype or (None if lang else XSD + "string"), None if datatype else lang and lang.lower())
        self.emit(s, p, o)


def _xml(text: str, out: Parsed) -> ET.Element | None:
    entities = dict(re.findall(r'<!ENTITY\s+(\S+)\s+"([^"]*)"', text))
    out.prefixes |= dict(re.findall(r'xmlns:([\w.-]+)\s*=\s*["\']([^"\']*)["\']', text))
    for prefix, value in out.prefixes.items():
        out.prefixes[prefix] = re.sub(r"&(\w+);", lambda m: entities.get(m[1], m[0]), value)
    if (default := re.search(r'\sxmlns\s*=\s*["\']([^"\']*)["\']', text)):
        out.prefixes.setdefault("", default[1])
    # Internal entities are expanded as text, and no other declaration reaches the XML reader.
    text = re.sub(r"<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>", "", text, flags=re.S)
    text = re.sub(r"&(\w+);", lambda m: entities.get(m[1], m[0]), text)
    try:
        return ET.fromstring(text)
    except ET.ParseError as e:
        out.error, (out.line, out.column) = str(e), e.position
    return None


def parse_rdfxml(text: str, base: str = "") -> Parsed:
    out = Parsed()
    root = _xml(text, out)
    if root is not None:
        reader = _RdfXml(out, base)
        base = root.get(_XML + "base", base)
        for e in root if root.tag == _R + "RDF" else [root]:
            reader.node(e, base, root.get(_XML + "lang"))
    return out


# -- JSON-LD, with inline contexts

def parse_jsonld(text: str, base: str = "") -> Parsed:
    out = Parsed()
    fresh = itertools.count()
    try:
        data = json.loads(text)
    except ValueError as e:
        out.error, out.line, out.column = str(e), getattr(e, "lineno", None), getattr(e, "colno", None)
        return out

    def context(now: dict, more) -> dict:
        now = dict(now)
        for one in more if isinstance(more, list) else [more]:
            if isinstance(one, str):
                out.error = out.error or f"remote context is not read: {one}"
            elif isinstance(one, dict):
                for k, v in one.items():
                    now[k] = v
                    if isinstance(v, str) and not k.startswith("@") and re.search(r"[#/:_]$", v):
                        out.prefixes[k] = v
        return now

    def expand(name: str, ctx: dict, vocab: bool) -> str | None:
        if name.startswith("@"):
            return name
        if vocab and name in ctx:
            v = ctx[name]["@id"] if isinstance(ctx[name], dict) and "@id" in ctx[name] else ctx[name] if isinstance(ctx[name], str) else name
            return v if v == name else expand(v, {k: x for k, x in ctx.items() if k != name}, True)
        prefix, colon, local = name.partition(":")
        if colon and not local.startswith("//") and isinstance(ctx.get(prefix), str):
            return expand(ctx[prefix], {}, False) + local
        if colon:
            return name
        if vocab:
            return ctx["@vocab"] + name if ctx.get("@vocab") else None
        return urljoin(ctx.get("@base", base), name) if ctx.get("@base", base) else name

    def reference(name: str, ctx: dict) -> tuple:
        return (name[2:], "bnode", None, None) if name.startswith("_:") else (expand(name, ctx, False), "iri", None, None)

    def value(v, ctx: dict, term, graph) -> tuple | None:
        hint = ctx.get(term) if isinstance(ctx.get(term), dict) else {}
        if isinstance(v, dict):
            ctx = context(ctx, v["@context"]) if "@context" in v else ctx
            if "@value" in v:
                raw = v["@value"]
                lexical = str(raw).lower() if isinstance(raw, bool) else str(raw)
                lang = v.get("@language")
                datatype = v.get("@type") and expand(v["@type"], ctx, True)
                return (lexical, "literal", None if lang else datatype or XSD + "string", lang and lang.lower())
            if "@list" in v:
                return collection(v["@list"], ctx, term, graph)
            return node(v, ctx, graph)
        if isinstance(v, bool):
            return (str(v).lower(), "literal", XSD + "boolean", None)
        if isinstance(v, int):
            return (str(v), "literal", expand(hint["@type"], ctx, True) if "@type" in hint and hint["@type"] != "@id" else XSD + "integer", None)
        if isinstance(v, float):
            return (repr(v), "literal", XSD + "double", None)
        if hint.get("@type") in ("@id", "@vocab"):
            return (expand(v, ctx, True), "iri", None, None) if hint["@type"] == "@vocab" else reference(v, ctx)
        if "@type" in hint:
            return (v, "literal", expand(hint["@type"], ctx, True), None)
        lang = hint.get("@language", ctx.get("@language"))
        return (v, "literal", None if lang else XSD + "string", lang and lang.lower())

    def collection(items, ctx, term, graph) -> tuple:
        items = [value(x, ctx, term, graph) for x in (items if isinstance(items, list) else [items])]
        cells = [(f"genid{next(fresh)}", "bnode", None, None) for _ in items] + [(NIL, "iri", None, None)]
        for cell, item, after in zip(cells, items, cells[1:]):
            out.quads.append((cell[0], "bnode", FIRST, *item, graph))
            out.quads.append((cell[0], "bnode", REST, *after, graph))
        return cells[0]

    def node(v: dict, ctx: dict, graph) -> tuple:
        ctx = context(ctx, v["@context"]) if "@context" in v else ctx
        own = reference(v["@id"], ctx) if "@id" in v else (f"genid{next(fresh)}", "bnode", None, None)
        if "@graph" in v:
            inner = own[0] if "@id" in v else graph
            for x in v["@graph"] if isinstance(v["@graph"], list) else [v["@graph"]]:
                node(x, ctx, inner)
        for k, values in v.items():
            key = expand(k, ctx, True)
            if key in (None, "@id", "@graph", "@context"):
                continue
            if key == "@type":
                for t in values if isinstance(values, list) else [values]:
                    out.quads.append((own[0], own[1], TYPE, expand(t, ctx, True) or t, "iri", None, None, graph))
                continue
            if key == "@reverse":
                for p, xs in values.items():
                    for x in xs if isinstance(xs, list) else [xs]:
                        s = node(x, ctx, graph) if isinstance(x, dict) else reference(x, ctx)
                        out.quads.append((s[0], s[1], expand(p, ctx, True), *own, graph))
                continue
            if key.startswith("@"):
                continue
            hint = ctx.get(k) if isinstance(ctx.get(k), dict) else {}
            if hint.get("@container") == "@list":
                out.quads.append((own[0], own[1], key, *collection(values, ctx, k, graph), graph))
                continue
            if hint.get("@container") == "@language" and isinstance(values, dict):
                values = [{"@value": x, "@language": lang} for lang, xs in values.items() for x in (xs if isinstance(xs, list) else [xs])]
            for x in values if isinstance(values, list) else [values]:
                if x is not None and (o := value(x, ctx, k, graph)) is not None:
                    out.quads.append((own[0], own[1], key, *o, graph))
        return own

    try:
        for x in data if isinstance(data, list) else [data]:
            node(x, {}, None)
    except (TypeError, KeyError, AttributeError) as e:
        out.error = f"not JSON-LD: {e}"
    return out
