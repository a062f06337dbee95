"""The strict SQL subset over the virtual tables: text to one DataFrame plan, or an error that says why not.

SELECT * or columns (with AS) FROM one table, WHERE of =, !=, <>, AND, OR, parentheses, TRUE and FALSE over columns and
literals; literals compare as text. Everything else is rejected before any plan is made. ``permissive`` hands any query
to Spark SQL over the same views instead.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.catalog import TABLES, Catalog, capped
from lattica.model import MAX_QUERY_BYTES, MAX_RESULT_ROWS, LatticaError


class SqlError(LatticaError):
    pass


@dataclass(frozen=True)
class QueryResult:
    columns: list[str]
    frame: DataFrame

    def rows(self, limit: int = MAX_RESULT_ROWS) -> tuple[list[list[str]], bool]:
        """At most so many rows, and whether more were left."""
        found = self.frame.limit(limit + 1).collect()
        return [list(r) for r in found[:limit]], len(found) > limit

    def capped(self, limit: int = MAX_RESULT_ROWS) -> tuple[DataFrame, bool]:
        return capped(self.frame, limit)


_TOKEN = re.compile(r"\s+|--[^\n]*|/\*.*?\*/|(?P<string>'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\")|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_$]*)|(?P<op><>|!=|<=|>=|\|\||[=<>(),.*;+\-/%])", re.S)
_CLAUSES = {"ORDER": "ORDER BY is not supported", "LIMIT": "LIMIT and OFFSET are not supported", "OFFSET": "LIMIT and OFFSET are not supported", "GROUP": "GROUP BY is not supported", "HAVING": "HAVING is not supported", "JOIN": "JOIN is not supported", "INNER": "JOIN is not supported", "LEFT": "JOIN is not supported", "RIGHT": "JOIN is not supported", "FULL": "JOIN is not supported", "CROSS": "JOIN is not supported", "NATURAL": "JOIN is not supported", "UNION": "only SELECT queries are supported", "INTERSECT": "only SELECT queries are supported", "EXCEPT": "only SELECT queries are supported", "FETCH": "FETCH is not supported", "QUALIFY": "QUALIFY is not supported", "WINDOW": "WINDOW is not supported"}


def _tokens(sql: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"unexpected character {sql[at]!r} at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group()))
        at = m.end()
    return out


class _Parser:
    def __init__(self, sql: str):
        self.tokens, self.at = _tokens(sql), 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + ahead] if self.at + ahead < len(self.tokens) else ("end", "")

    def word(self, ahead: int = 0) -> str:
        kind, text = self.peek(ahead)
        return text.upper() if kind == "name" else ""

    def take(self) -> tuple[str, str]:
        token = self.peek()
        self.at += 1
        return token

    def is_op(self, text: str) -> bool:
        return self.peek() == ("op", text)

    def identifier(self) -> str:
        kind, text = self.take()
        if kind == "name":
            return text.lower()
        if kind == "quoted":
            return text[1:-1].replace('""', '"').lower()
        raise SqlError(f"expected a name, found {text or 'the end'}")

    def statement(self) -> tuple[list[tuple[str, str]] | None, str, object]:
        if self.peek()[0] == "end":
            raise SqlError("empty query")
        if self.word() == "WITH":
            raise SqlError("WITH is not supported")
        if self.word() != "SELECT":
            raise SqlError("only SELECT queries are supported")
        self.take()
        if self.word() == "DISTINCT":
            raise SqlError("DISTINCT is not supported")
        if self.word() in ("TOP", "ALL"):
            raise SqlError(f"{self.word()} is not supported")
        items = self.items()
        if self.word() != "FROM":
            raise SqlError("missing FROM clause" if self.peek()[0] == "end" else "only simple column projections are supported")
        self.take()
        if self.is_op("("):
            raise SqlError("unsupported table expression")
        table = self.identifier()
        if self.is_op(","):
            raise SqlError("JOIN is not supported")
        where = None
        if self.word() == "WHERE":
            self.take()
            where = self.either()
        if self.is_op(";"):
            self.take()
            if self.peek()[0] != "end":
                raise SqlError("only a single SQL statement is supported")
        if self.peek()[0] != "end":
            raise SqlError(_CLAUSES.get(self.word(), f"unsupported syntax near {self.peek()[1]!r}"))
        return items, table, where

    def items(self) -> list[tuple[str, str]] | None:
        """Pairs (column, name), or None for *."""
        out: list[tuple[str, str]] = []
        while True:
            if self.is_op("*"):
                self.take()
                if out or self.is_op(","):
                    raise SqlError("* must be the only item")
                return None
            if self.peek()[0] not in ("name", "quoted") or self.word() == "FROM":
                raise SqlError("only simple column projections are supported")
            name = self.identifier()
            if self.peek()[0] == "op" and not self.is_op(","):
                raise SqlError("only simple column projections are supported")
            alias = name
            if self.word() == "AS":
                self.take()
                alias = self.identifier()
            elif self.peek()[0] == "quoted" or self.peek()[0] == "name" and self.word() != "FROM":
                alias = self.identifier()
            out.append((name, alias))
            if not self.is_op(","):
                return out
            self.take()

    def either(self):
        left = self.both()
        while self.word() == "OR":
            self.take()
            left = ("or", left, self.both())
        return left

    def both(self):
        left = self.test()
        while self.word() == "AND":
            self.take()
            left = ("and", left, self.test())
        return left

    def test(self):
        if self.is_op("("):
            # A bracket may hold a condition or a value: try the condition first.
            start = self.at
            self.take()
            try:
                inner = self.either()
                if self.is_op(")"):
                    self.take()
                    if self.peek()[0] != "op" or self.is_op(")") or self.is_op(";"):
                        return inner
            except SqlError:
                pass
            self.at = start
        value = self.value()
        if self.peek()[0] == "op" and self.peek()[1] in ("=", "!=", "<>"):
            op = self.take()[1]
            return ("=" if op == "=" else "!=", value, self.value())
        if value[0] == "literal" and value[1] in ("true", "false") and value[2] == "bool":
            return ("constant", value[1] == "true")
        if value[0] == "column" and (self.peek()[0] == "end" or self.is_op(")") or self.is_op(";") or self.word() in ("AND", "OR")):
            raise SqlError("bare column names are not supported in WHERE; use column = 'value'")
        raise SqlError(f"unsupported WHERE operator or expression near {self.peek()[1]!r}")

    def value(self):
        if self.is_op("("):
            self.take()
            inner = self.value()
            if not self.is_op(")"):
                raise SqlError(f"unsupported expression near {self.peek()[1]!r}")
            self.take()
            return inner
        kind, text = self.take()
        if kind == "string":
            return ("literal", text[1:-1].replace("''", "'"), "text")
        if kind == "number":
            return ("literal", text, "number")
        if kind == "name" and text.upper() in ("TRUE", "FALSE"):
            return ("literal", text.lower(), "bool")
        if kind == "name" and text.upper() in ("NULL", "NOT", "CASE", "EXISTS", "INTERVAL", "DATE", "CAST"):
            raise SqlError(f"unsupported WHERE expression: {text}")
        if kind in ("name", "quoted"):
            if self.is_op("(") or self.is_op("."):
                raise SqlError(f"unsupported expression: {text}{self.peek()[1]}")
            return ("column", text.lower() if kind == "name" else text[1:-1].lower())
        raise SqlError(f"unsupported expression near {text!r}")


def _condition(node, known: list[str]) -> Column:
    def value(v) -> Column:
        if v[0] == "literal":
            return F.lit(v[1])
        if v[1] not in known:
            raise SqlError(f"unknown column: {v[1]}")
        return F.col(f"`{v[1]}`").cast("string")

    kind = node[0]
    if kind == "constant":
        return F.lit(node[1])
    if kind in ("and", "or"):
        left, right = (_condition(n, known) for n in node[1:])
        return left & right if kind == "and" else left | right
    left, right = value(node[1]), value(node[2])
    return left == right if kind == "=" else left != right


def run_sql(catalog: Catalog, sql: str, permissive: bool = False) -> QueryResult:
    if len(sql.encode()) > MAX_QUERY_BYTES:
        raise SqlError(f"query exceeds maximum length of {MAX_QUERY_BYTES} bytes")
    if permissive:
        catalog.register()
        frame = catalog.spark.sql(sql)
        return QueryResult(frame.columns, frame)
    items, table, where = _Parser(sql).statement()
    if table not in TABLES:
        raise SqlError(f"unknown table: {table}")
    known = TABLES[table]
    for name, _ in items or []:
        if name not in known:
            raise SqlError(f"unknown column: {name}")
    names = [a for _, a in items or []]
    if len(set(names)) < len(names):
        raise SqlError("duplicate column names are not supported")
    frame = catalog.view(table)
    if where is not None:
        frame = frame.where(_condition(where, known))
    frame = frame.select(*[F.col(f"`{n}`").alias(a) for n, a in items]) if items else frame.select(*[F.col(f"`{c}`") for c in known])
    return QueryResult(frame.columns, frame)


def list_sql_tables() -> list[dict]:
    return [{"name": t, "columns": [{"name": c, "type": "string"} for c in columns]} for t, columns in TABLES.items()]
