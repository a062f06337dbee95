"""Manchester class expressions: parser to a tree, printer, and JSON; one recursive-descent pass for each text.

Trees are tuples: ('class', iri), ('and'|'or', [..]), ('not', x), ('one_of', [iris]), ('some'|'only', property, filler),
('value', property, term), ('self', property), ('min'|'max'|'exactly', n, property, filler or None), ('datatype', iri),
('facets', datatype, [(facet, literal)]), ('literal', text)."""

from __future__ import annotations

import json
import re

from lattica.model import BUILTIN_PREFIXES, XSD, LatticaError


class ManchesterError(LatticaError):
    pass


_TOKEN = re.compile(r"\s+|(?P<iri><[^<>\s]+>)|(?P<literal>\"(?:[^\"\\]|\\.)*\"(?:@[A-Za-z-]+|\^\^(?:<[^<>\s]+>|[\w:.-]+))?)|(?P<quoted>'(?:[^'\\]|\\.)*')|(?P<number>[+-]?\d+(?:\.\d+)?)(?![\w:])|(?P<op><=|>=|[(){}\[\],<>])|(?P<name>[^\s(){}\[\],<>\"']+)")
_KEYWORDS = {"some", "only", "value", "self", "min", "max", "exactly", "and", "or", "not", "that", "inverse"}
_FACETS = {"<=", "<", ">=", ">", "length", "minLength", "maxLength", "pattern"}


class _Parser:
    def __init__(self, text: str, namespaces: dict[str, str]):
        self.namespaces = BUILTIN_PREFIXES | namespaces
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ManchesterError(f"unexpected character {text[at]!r} at {at}")
            if m.lastgroup:
                self.tokens.append((m.lastgroup, m.group()))
            at = m.end()
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def word(self, ahead: int = 0) -> str:
        kind, text = self.peek(ahead)
        return text.lower() if kind == "name" and text.lower() in _KEYWORDS else ""

    def accept(self, text: str) -> bool:
        if self.peek() == ("op", text) or self.word() == text:
            self.at += 1
            return True
        return False

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise ManchesterError(f"expected {text}, found {self.peek()[1] or 'the end'}")

    def iri(self) -> str:
        kind, text = self.peek()
        self.at += 1
        if kind == "iri":
            return text[1:-1]
        if kind == "quoted":
            text = re.sub(r"\\(.)", r"\1", text[1:-1])
        elif kind != "name" or text.lower() in _KEYWORDS:
            raise ManchesterError(f"expected a name, found {text or 'the end'}")
        if "://" in text:
            return text
        prefix, colon, local = text.partition(":")
        if colon and prefix not in self.namespaces:
            raise ManchesterError(f"undeclared prefix: {prefix}:")
        return self.namespaces[prefix] + local if colon else self.namespaces.get("", "") + text

    def union(self) -> tuple:
        parts = [self.intersection()]
        while self.accept("or"):
            parts.append(self.intersection())
        return parts[0] if len(parts) == 1 else ("or", parts)

    def intersection(self) -> tuple:
        parts = [self.negation()]
        while self.accept("and") or self.accept("that"):
            parts.append(self.negation())
        return parts[0] if len(parts) == 1 else ("and", parts)

    def negation(self) -> tuple:
        return ("not", self.negation()) if self.accept("not") else self.primary()

    def primary(self) -> tuple:
        if self.accept("("):
            inner = self.union()
            self.expect(")")
            return inner
        if self.accept("{"):
            out = []
            while not self.accept("}"):
                out.append(self.peek()[1] if self.peek()[0] in ("literal", "number") else None)
                if out[-1] is None:
                    out[-1] = self.iri()
                else:
                    self.at += 1
                self.accept(",")
            return ("one_of", out)
        if self.word() in ("some", "only", "min", "max", "exactly", "value", "self"):
            # keyword first: the property follows
            keyword = self.word()
            self.at += 1
            if keyword == "self":
                return ("self", self.property())
            n = self.count() if keyword in ("min", "max", "exactly") else None
            return self.restriction(self.property(), keyword, n)
        start = self.at
        inverse = self.accept("inverse")
        if inverse:
            bracket = self.accept("(")
            name = "inverse " + self.iri()
            if bracket:
                self.expect(")")
        else:
            name = self.iri()
        keyword = self.word()
        if keyword in ("some", "only", "value", "min", "max", "exactly", "self"):
            self.at += 1
            if keyword == "self":
                return ("self", name)
            return self.restriction(name, keyword, self.count() if keyword in ("min", "max", "exactly") else None)
        if inverse:
            raise ManchesterError("a property stands where a class is expected")
        if self.peek() == ("op", "["):
            self.at += 1
            facets = []
            while not self.accept("]"):
                facet = self.peek()[1]
                if facet not in _FACETS:
                    raise ManchesterError(f"unknown facet: {facet}")
                self.at += 1
                facets.append((facet, self.peek()[1]))
                self.at += 1
                self.accept(",")
            return ("facets", name, facets)
        if self.at == start:
            raise ManchesterError("expected an expression")
        return ("datatype", name) if name.startswith(XSD) else ("class", name)

    def property(self) -> str:
        return "inverse " + self.iri() if self.accept("inverse") else self.iri()

    def count(self) -> int:
        kind, text = self.peek()
        if kind != "number" or not text.isdigit():
            raise ManchesterError(f"expected a number, found {text or 'the end'}")
        self.at += 1
        return int(text)

    def restriction(self, name: str, keyword: str, n: int | None) -> tuple:
        if keyword == "value":
            kind, text = self.peek()
            if kind in ("literal", "number"):
                self.at += 1
                return ("value", name, ("literal", text))
            return ("value", name, ("class", self.iri()))
        if n is not None:
            more = self.peek()[0] != "end" and self.peek() not in (("op", ")"), ("op", "}")) and self.word() not in ("and", "or", "that")
            return (keyword, n, name, self.negation() if more else None)
        return (keyword, name, self.negation())


def parse(text: str, namespaces: dict[str, str] | None = None) -> tuple:
    p = _Parser(text, namespaces or {})
    if p.peek()[0] == "end":
        raise ManchesterError("empty expression")
    tree = p.union()
    if p.peek()[0] != "end":
        raise ManchesterError(f"unexpected {p.peek()[1]!r}")
    return tree


def _name(iri: str, namespaces: dict[str, str]) -> str:
    if iri.startswith("inverse "):
        return "inverse " + _name(iri[8:], namespaces)
    best = max(((len(n), p) for p, n in (BUILTIN_PREFIXES | namespaces).items() if n and iri.startswith(n)), default=None)
    if best:
        local = iri[best[0]:]
        if re.fullmatch(r"[\w.-]*", local):
            return f"{best[1]}:{local}"
    return f"<{iri}>" if "://" in iri or iri.startswith("urn:") else iri


def render(tree: tuple, namespaces: dict[str, str] | None = None, plain: bool = False) -> str:
    """Text of a tree; plain writes IRIs as they are, which is how the catalog's rows hold them."""
    ns = namespaces or {}
    name = (lambda i: i) if plain else (lambda i: _name(i, ns))

    def go(t: tuple, level: int = 0) -> str:
        kind = t[0]
        if kind in ("class", "datatype"):
            return name(t[1])
        if kind == "literal":
            return t[1]
        if kind in ("and", "or"):
            own = 2 if kind == "and" else 1
            out = f" {kind} ".join(go(x, own + 1) for x in t[1])
        elif kind == "not":
            own, out = 3, "not " + go(t[1], 4)
        elif kind == "one_of":
            return "{" + ", ".join(x if x[:1] in '"+-0123456789' else name(x) for x in t[1]) + "}"
        elif kind == "facets":
            return f"{name(t[1])}[" + ", ".join(f"{a} {b}" for a, b in t[2]) + "]"
        elif kind == "self":
            own, out = 3, f"{name(t[1])} Self"
        elif kind in ("min", "max", "exactly"):
            own, out = 3, f"{name(t[2])} {kind} {t[1]}" + (f" {go(t[3], 4)}" if t[3] else "")
        else:
            own, out = 3, f"{name(t[1])} {kind} {go(t[2], 4)}"
        return f"({out})" if own < level or level == 4 and own == 3 else out

    return go(tree)


def to_json(tree: tuple) -> str:
    return json.dumps(tree)


def from_json(text: str) -> tuple:
    tuples = lambda x: tuple(tuples(y) for y in x) if isinstance(x, list) and x and isinstance(x[0], str) and x[0] in _HEADS else [tuples(y) for y in x] if isinstance(x, list) else x
    return tuples(json.loads(text))


_HEADS = {"class", "and", "or", "not", "one_of", "some", "only", "value", "self", "min", "max", "exactly", "datatype", "facets", "literal"}


def signature(tree: tuple) -> set[str]:
    """IRIs that an expression names."""
    out: set[str] = set()
    for x in tree[1:]:
        if isinstance(x, tuple):
            out |= signature(x)
        elif isinstance(x, list):
            for y in x:
                out |= signature(y) if isinstance(y, tuple) and y and y[0] in _HEADS else {y} if isinstance(y, str) else set()
        elif isinstance(x, str) and tree[0] != "literal":
            out.add(x.removeprefix("inverse "))
    return out
