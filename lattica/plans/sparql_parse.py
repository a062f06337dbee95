"""SPARQL text to a tree. Terms are tuples: ('iri', v), ('lit', lexical, datatype, language), ('var', name)."""

from __future__ import annotations

import itertools
import re

from lattica.model import NIL, FIRST, RDF, REST, XSD, LatticaError


class SparqlError(LatticaError):
    pass


_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<iri><[^<>"{}|^`\\\x00-\x20]*>)
    |(?P<string>\"\"\"(?:(?:"|"")?(?:[^"\\]|\\.))*\"\"\"|'''(?:(?:'|'')?(?:[^'\\]|\\.))*'''|"(?:[^"\\\n\r]|\\.)*"|'(?:[^'\\\n\r]|\\.)*')
    |(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)
    |(?P<var>[?$][\w]+)
    |(?P<number>(?:\d+\.\d*|\.\d+|\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
    |(?P<blank>_:[\w.-]*\w)
    |(?P<pname>(?:[A-Za-z][\w.-]*)?:(?:[\w:%-](?:[\w.:%-]|\\.)*[\w:%-]|[\w:%-])?)
    |(?P<word>[A-Za-z_][A-Za-z_0-9]*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,*/|^+?!=<>-])""",
    re.X | re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT")
UPDATES = ("INSERT", "DELETE", "LOAD", "CLEAR", "CREATE", "DROP", "MOVE", "COPY", "ADD")


def unescape(text: str) -> str:
    text = re.sub(r"\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})", lambda m: chr(int(m[1] or m[2], 16)), text)
    return re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text, flags=re.S)


def tokens_of(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SparqlError(f"unexpected character {text[at]!r} at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return out


def is_update(text: str) -> bool:
    """Whether the first keyword after comments, PREFIX, BASE, WITH and USING is one of an update."""
    try:
        tokens = tokens_of(text)
    except SparqlError:
        tokens = [("word", w) for w in re.findall(r"[A-Za-z]+", re.sub(r"#[^\n]*|<[^>]*>", " ", text))]
    words = iter(tokens)
    for kind, value in words:
        word = value.upper() if kind == "word" else ""
        if word == "PREFIX":
            next(words, None), next(words, None)
        elif word in ("BASE", "WITH"):
            next(words, None)
        elif word == "USING":
            if (token := next(words, None)) and token[1].upper() == "NAMED":
                next(words, None)
        else:
            return word in UPDATES
    return False


class Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokens_of(text), 0
        self.prefixes: dict[str, str] = {}
        self.base = ""
        self.fresh = itertools.count()

    # -- tokens

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def word(self, ahead: int = 0) -> str:
        kind, text = self.peek(ahead)
        return text.upper() if kind == "word" else ""

    def take(self) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end":
            raise SparqlError("unexpected end of query")
        self.at += 1
        return token

    def accept(self, text: str) -> bool:
        if self.peek() == ("op", text) or self.word() == text:
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise SparqlError(f"expected {text}, found {self.peek()[1] or 'the end'}")

    # -- queries

    def query(self) -> dict:
        while True:
            if self.accept("PREFIX"):
                kind, name = self.take()
                if kind != "pname" or not name.endswith(":"):
                    raise SparqlError(f"bad prefix {name!r}")
                self.prefixes[name[:-1]] = self.iri()
            elif self.accept("BASE"):
                self.base = self.iri()
            else:
                break
        form = self.word()
        if form in ("CONSTRUCT", "DESCRIBE"):
            raise SparqlError("only SELECT and ASK queries are supported")
        if form == "ASK":
            self.take()
            out = {"form": "ask", **self.dataset()}
            self.accept("WHERE")
            out["where"] = self.group()
            out |= self.modifiers()
        elif form == "SELECT":
            out = self.select()
        else:
            raise SparqlError(f"expected SELECT or ASK, found {self.peek()[1] or 'the end'}")
        if self.accept("VALUES"):
            out["where"] = ("group", [out["where"], self.values()])
        if self.peek()[0] != "end":
            raise SparqlError(f"unexpected {self.peek()[1]!r}")
        return out

    def dataset(self) -> dict:
        default, named = [], []
        while self.accept("FROM"):
            (named if self.accept("NAMED") else default).append(self.iri())
        return {"from": default, "from_named": named}

    def select(self) -> dict:
        self.expect("SELECT")
        out: dict = {"form": "select", "distinct": self.accept("DISTINCT") or self.accept("REDUCED"), "items": []}
        if self.accept("*"):
            out["items"] = None
        else:
            while True:
                if self.peek()[0] == "var":
                    out["items"].append((self.take()[1][1:], None))
                elif self.accept("("):
                    e = self.expression()
                    self.expect("AS")
                    out["items"].append((self.variable(), e))
                    self.expect(")")
                else:
                    break
            if not out["items"]:
                raise SparqlError("SELECT needs variables or *")
        out |= self.dataset()
        self.accept("WHERE")
        out["where"] = self.group()
        return out | self.modifiers()

    def variable(self) -> str:
        kind, text = self.take()
        if kind != "var":
            raise SparqlError(f"expected a variable, found {text!r}")
        return text[1:]

    def modifiers(self) -> dict:
        out: dict = {"group": None, "having": [], "order": [], "limit": None, "offset": 0}
        if self.accept("GROUP"):
            self.expect("BY")
            out["group"] = []
            while True:
                if self.peek()[0] == "var":
                    out["group"].append((self.take()[1][1:], None))
                elif self.accept("("):
                    e = self.expression()
                    name = self.variable() if self.accept("AS") else f"__g{next(self.fresh)}"
                    self.expect(")")
                    out["group"].append((name, e))
                elif self.peek()[0] == "word" and self.word() not in ("HAVING", "ORDER") and self.peek(1) == ("op", "("):
                    out["group"].append((f"__g{next(self.fresh)}", self.primary()))
                else:
                    break
        if self.accept("HAVING"):
            while self.peek() == ("op", "(") or self.peek()[0] == "word" and self.peek(1) == ("op", "("):
                out["having"].append(self.primary())
        if self.accept("ORDER"):
            self.expect("BY")
            while True:
                if self.word() in ("ASC", "DESC"):
                    down = self.take()[1].upper() == "DESC"
                    self.expect("(")
                    out["order"].append((self.expression(), down))
                    self.expect(")")
                elif self.peek()[0] == "var" or self.peek() == ("op", "(") or self.peek()[0] == "word" and self.peek(1) == ("op", "("):
                    out["order"].append((self.primary(), False))
                else:
                    break
        while self.word() in ("LIMIT", "OFFSET"):
            key = self.take()[1].lower()
            kind, text = self.take()
            if kind != "number" or not text.isdigit():
                raise SparqlError(f"{key} needs a number")
            out[key] = int(text)
        return out

    # -- terms

    def iri(self) -> str:
        kind, text = self.take()
        if kind == "iri":
            inner = unescape(text[1:-1])
            return inner if re.match(r"^[A-Za-z][\w+.-]*:", inner) or not self.base else self.base + inner
        if kind == "pname":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SparqlError(f"undeclared prefix: {prefix}:")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise SparqlError(f"expected an IRI, found {text!r}")

    def literal(self) -> tuple:
        text = self.take()[1]
        quote = 3 if text[:3] in ('"""', "'''") else 1
        lexical = unescape(text[quote:-quote])
        if self.peek()[0] == "lang":
            return ("lit", lexical, None, self.take()[1][1:].lower())
        if self.accept("^^"):
            return ("lit", lexical, self.iri(), None)
        return ("lit", lexical, None, None)

    def number(self, sign: str = "") -> tuple:
        text = self.take()[1]
        kind = "double" if re.search("[eE]", text) else "decimal" if "." in text else "integer"
        return ("lit", sign + text, XSD + kind, None)

    def term(self) -> tuple:
        kind, text = self.peek()
        if kind == "var":
            return ("var", self.take()[1][1:])
        if kind in ("iri", "pname"):
            return ("iri", self.iri())
        if kind == "string":
            return self.literal()
        if kind == "number":
            return self.number()
        if kind == "op" and text in "+-" and self.peek(1)[0] == "number":
            self.take()
            return self.number("-" if text == "-" else "")
        if kind == "blank":
            return ("var", "__b_" + self.take()[1][2:])
        if self.word() in ("TRUE", "FALSE"):
            return ("lit", self.take()[1].lower(), XSD + "boolean", None)
        raise SparqlError(f"expected a term, found {text or 'the end'}")

    # -- patterns

    def group(self) -> tuple:
        self.expect("{")
        parts: list = []
        if self.word() == "SELECT":
            inner = self.select()
            if self.accept("VALUES"):
                inner["where"] = ("group", [inner["where"], self.values()])
            self.expect("}")
            return ("group", [("select", inner)])
        while not self.accept("}"):
            if self.accept("."):
                continue
            if self.accept("OPTIONAL"):
                parts.append(("optional", self.group()))
            elif self.accept("MINUS"):
                parts.append(("minus", self.group()))
            elif self.accept("FILTER"):
                parts.append(("filter", self.primary()))
            elif self.accept("BIND"):
                self.expect("(")
                e = self.expression()
                self.expect("AS")
                parts.append(("bind", self.variable(), e))
                self.expect(")")
            elif self.accept("VALUES"):
                parts.append(self.values())
            elif self.accept("GRAPH"):
                name = ("var", self.variable()) if self.peek()[0] == "var" else ("iri", self.iri())
                parts.append(("graph", name, self.group()))
            elif self.word() == "SERVICE":
                raise SparqlError("SERVICE is not supported")
            elif self.peek() == ("op", "{"):
                branch = self.group()
                branches = [branch]
                while self.accept("UNION"):
                    branches.append(self.group())
                parts.append(("union", branches) if len(branches) > 1 else branch)
            else:
                parts += self.triples()
        return ("group", parts)

    def values(self) -> tuple:
        single = self.peek()[0] == "var"
        if single:
            names = [self.variable()]
        else:
            self.expect("(")
            names = []
            while not self.accept(")"):
                names.append(self.variable())
        self.expect("{")
        rows = []
        while not self.accept("}"):
            if not single:
                self.expect("(")
            row = []
            while single and not row or not single and not self.accept(")"):
                row.append(None if self.accept("UNDEF") else self.term())
            if len(row) != len(names):
                raise SparqlError("VALUES row of the wrong length")
            rows.append(row)
        return ("values", names, rows)

    def triples(self) -> list:
        out: list = []
        subject = self.node(out)
        if out and self.peek() in (("op", "."), ("op", "}")):
            return out
        self.properties(subject, out)
        return out

    def properties(self, subject: tuple, out: list) -> None:
        while True:
            path = self.verb()
            while True:
                obj = self.node(out)
                if path[0] in ("iri", "var"):
                    out.append(("triple", subject, path, obj))
                else:
                    out.append(("path", subject, path, obj))
                if not self.accept(","):
                    break
            if not self.accept(";"):
                return
            while self.accept(";"):
                pass
            if self.peek()[0] == "end" or self.peek() in (("op", "."), ("op", "}"), ("op", "]")):
                return

    def node(self, out: list) -> tuple:
        if self.accept("["):
            own = ("var", f"__n{next(self.fresh)}")
            if not self.accept("]"):
                self.properties(own, out)
                self.expect("]")
            return own
        if self.accept("("):
            items = []
            while not self.accept(")"):
                items.append(self.node(out))
            cells = [("var", f"__n{next(self.fresh)}") for _ in items] + [("iri", NIL)]
            for cell, item, after in zip(cells, items, cells[1:]):
                out += [("triple", cell, ("iri", FIRST), item), ("triple", cell, ("iri", REST), after)]
            return cells[0]
        return self.term()

    def verb(self) -> tuple:
        if self.peek()[0] == "var":
            return ("var", self.take()[1][1:])
        return self.alternative()

    def alternative(self) -> tuple:
        parts = [self.sequence()]
        while self.accept("|"):
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self) -> tuple:
        parts = [self.step()]
        while self.accept("/"):
            parts.append(self.step())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def step(self) -> tuple:
        if self.accept("^"):
            return ("inv", self.step())
        if self.accept("!"):
            inside = []
            if self.accept("("):
                while not self.accept(")"):
                    inside.append(("inv", self.plain()) if self.accept("^") else self.plain())
                    self.accept("|")
            else:
                inside.append(("inv", self.plain()) if self.accept("^") else self.plain())
            return ("not", inside)
        if self.accept("("):
            inner = self.alternative()
            self.expect(")")
        else:
            inner = self.plain()
        if self.peek()[0] == "op" and self.peek()[1] in "*+?":
            return ({"*": "star", "+": "plus", "?": "maybe"}[self.take()[1]], inner)
        return inner

    def plain(self) -> tuple:
        if self.peek() == ("word", "a"):
            self.take()
            return ("iri", RDF + "type")
        return ("iri", self.iri())

    # -- expressions

    def expression(self) -> tuple:
        left = self.conjunction()
        while self.accept("||"):
            left = ("or", left, self.conjunction())
        return left

    def conjunction(self) -> tuple:
        left = self.relation()
        while self.accept("&&"):
            left = ("and", left, self.relation())
        return left

    def relation(self) -> tuple:
        left = self.sum()
        kind, text = self.peek()
        if kind == "op" and text in ("=", "!=", "<", ">", "<=", ">="):
            self.take()
            return ("compare", text, left, self.sum())
        negated = self.word() == "NOT" and self.word(1) == "IN"
        if negated or self.word() == "IN":
            self.at += 2 if negated else 1
            self.expect("(")
            items = []
            while not self.accept(")"):
                items.append(self.expression())
                self.accept(",")
            return ("not", ("in", left, items)) if negated else ("in", left, items)
        return left

    def sum(self) -> tuple:
        left = self.product()
        while self.peek()[0] == "op" and self.peek()[1] in "+-":
            left = ("arith", self.take()[1], left, self.product())
        return left

    def product(self) -> tuple:
        left = self.unary()
        while self.peek()[0] == "op" and self.peek()[1] in "*/":
            left = ("arith", self.take()[1], left, self.unary())
        return left

    def unary(self) -> tuple:
        if self.accept("!"):
            return ("not", self.unary())
        if self.accept("-"):
            return ("arith", "-", ("lit", "0", XSD + "integer", None), self.unary())
        if self.accept("+"):
            return self.unary()
        return self.primary()

    def primary(self) -> tuple:
        if self.accept("("):
            e = self.expression()
            self.expect(")")
            return e
        word = self.word()
        if word == "EXISTS" or word == "NOT" and self.word(1) == "EXISTS":
            self.at += 1 + (word == "NOT")
            return ("exists", word == "NOT", self.group())
        if word in AGGREGATES and self.peek(1) == ("op", "("):
            return self.aggregate()
        if self.peek()[0] == "word" and self.peek(1) == ("op", "("):
            name = self.take()[1].upper()
            return ("call", name, self.arguments())
        if self.peek()[0] in ("iri", "pname") and self.peek(1) == ("op", "("):
            return ("call", self.iri(), self.arguments())
        return self.term()

    def arguments(self) -> list:
        self.expect("(")
        out = []
        while not self.accept(")"):
            out.append(self.expression())
            self.accept(",")
        return out

    def aggregate(self) -> tuple:
        name = self.take()[1].upper()
        self.expect("(")
        distinct = self.accept("DISTINCT")
        e = None if self.accept("*") else self.expression()
        separator = " "
        if self.accept(";"):
            self.expect("SEPARATOR")
            self.expect("=")
            separator = self.literal()[1]
        self.expect(")")
        return ("aggregate", name, distinct, e, separator)


def parse(text: str) -> dict:
    return Parser(text).query()
