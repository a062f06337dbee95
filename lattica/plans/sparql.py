"""SPARQL over the catalog's quads, compiled to DataFrame plans.

A bound term is its N-Triples text (<iri>, _:b, "x"@en, "1"^^<dt>), so joins are equi-joins of one column and results need
no rendering; unbound is null. Constants of a pattern filter the quads' own columns, which reaches the scan. Expression
errors are nulls, and FILTER keeps true only. Catalyst orders joins and picks their strategy; patterns of a group are
first put in an order in which each is connected to those before it, the most bound first.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.catalog import Catalog
from lattica.model import MAX_QUERY_BYTES, XSD
from lattica.operators.fixpoint import closure
from lattica.plans.sparql_parse import AGGREGATES, SparqlError, is_update, parse
from lattica.plans.sqlgate import QueryResult
from lattica.plans.stats import Statistics

NUMERIC = [XSD + t for t in ("integer", "decimal", "double", "float", "int", "long", "short", "byte", "nonNegativeInteger", "positiveInteger", "negativeInteger", "nonPositiveInteger", "unsignedInt", "unsignedLong")]


#: Functions that are tests.
BOOLEAN = {"BOUND", "STRSTARTS", "STRENDS", "CONTAINS", "LANGMATCHES", "REGEX", "SAMETERM", "ISIRI", "ISURI", "ISBLANK", "ISLITERAL", "ISNUMERIC"}


def escape(c: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescaped(c: Column) -> Column:
    """The inverse; a doubled backslash is set aside while the others are read."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\u0001"))
    for a, b in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\\", "\u0001")):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def constant(term: tuple) -> str:
    if term[0] == "iri":
        return f"<{term[1]}>"
    text = term[1]
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = text.replace(a, b)
    tail = f"@{term[3]}" if term[3] else f"^^<{term[2]}>" if term[2] and term[2] != XSD + "string" else ""
    return f'"{text}"{tail}'


def subject_term(value: str = "s", kind: str = "s_kind") -> Column:
    return F.when(F.col(kind) == "bnode", F.concat(F.lit("_:"), value)).otherwise(F.concat(F.lit("<"), value, F.lit(">")))


def object_term() -> Column:
    tail = F.when(F.coalesce("o_lang", F.lit("")) != "", F.concat(F.lit("@"), "o_lang")).when(F.coalesce("o_datatype", F.lit(XSD + "string")) != XSD + "string", F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).otherwise("")
    literal = F.concat(F.lit('"'), escape(F.col("o")), F.lit('"'), tail)
    return F.when(F.col("o_kind") == "literal", literal).when(F.col("o_kind") == "bnode", F.concat(F.lit("_:"), "o")).otherwise(F.concat(F.lit("<"), "o", F.lit(">")))


class Terms:
    """Column functions over term text."""

    is_iri = staticmethod(lambda t: F.startswith(t, F.lit("<")))
    is_blank = staticmethod(lambda t: F.startswith(t, F.lit("_:")))
    is_literal = staticmethod(lambda t: F.startswith(t, F.lit('"')))

    @staticmethod
    def tail(t: Column) -> Column:
        return F.regexp_extract(t, r'"((?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?)$', 1)

    @staticmethod
    def lexical(t: Column) -> Column:
        return F.when(Terms.is_literal(t), unescaped(F.substring(t, F.lit(2), F.length(t) - 2 - F.length(Terms.tail(t)))))

    @staticmethod
    def string(t: Column) -> Column:
        return F.when(Terms.is_iri(t), F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(Terms.lexical(t))

    @staticmethod
    def language(t: Column) -> Column:
        return F.when(Terms.is_literal(t), F.regexp_extract(Terms.tail(t), "^@(.*)$", 1))

    @staticmethod
    def datatype(t: Column) -> Column:
        tail = Terms.tail(t)
        rdf = "http://www.w3.org/1999/02/22-rdf-syntax-ns#langString"
        return F.when(Terms.is_literal(t), F.when(F.startswith(tail, F.lit("@")), rdf).when(tail == "", XSD + "string").otherwise(F.regexp_extract(tail, r"^\^\^<(.*)>$", 1)))

    @staticmethod
    def number(t: Column) -> Column:
        """struct (v, rank): rank 0 integer, 1 decimal, 2 double; null for what is no number."""
        dt = Terms.datatype(t)
        v = Terms.lexical(t).try_cast("double")
        rank = F.when(dt == XSD + "decimal", 1).when(dt.isin(XSD + "double", XSD + "float"), 2).otherwise(0)
        return F.when(dt.isin(*NUMERIC) & v.isNotNull(), F.struct(v.alias("v"), rank.alias("rank")))

    @staticmethod
    def of_number(n: Column) -> Column:
        whole = F.concat(F.lit('"'), n["v"].try_cast("bigint").cast("string"), F.lit(f'"^^<{XSD}integer>'))
        plain = F.regexp_replace(F.regexp_replace(n["v"].try_cast("decimal(38,10)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
        dec = F.concat(F.lit('"'), plain, F.lit(f'"^^<{XSD}decimal>'))
        dbl = F.concat(F.lit('"'), n["v"].cast("string"), F.lit(f'"^^<{XSD}double>'))
        return F.when(n["rank"] == 0, whole).when(n["rank"] == 1, dec).when(n["rank"] == 2, dbl)

    @staticmethod
    def of_string(c: Column, like: Column | None = None) -> Column:
        tail = F.when(F.startswith(Terms.tail(like), F.lit("@")), Terms.tail(like)).otherwise("") if like is not None else F.lit("")
        return F.concat(F.lit('"'), escape(c), F.lit('"'), tail)

    @staticmethod
    def of_boolean(c: Column) -> Column:
        return F.when(c, f'"true"^^<{XSD}boolean>').when(~c, f'"false"^^<{XSD}boolean>')

    @staticmethod
    def of_iri(c: Column) -> Column:
        return F.concat(F.lit("<"), c, F.lit(">"))


class Solution:
    """A frame whose columns are variables, and which of them are bound in every row."""

    def __init__(self, df: DataFrame | None, bound: set[str], maybe: set[str] = frozenset()):
        self.df, self.bound, self.maybe = df, set(bound), set(maybe)

    @property
    def names(self) -> set[str]:
        return self.bound | self.maybe


class Compiler:
    #: What orders joins, if anything, and the order that was chosen, with the rows expected after each pattern.
    statistics: Statistics | None = None

    def __init__(self, catalog: Catalog):
        self.chosen: list[tuple[tuple, float]] = []
        self.catalog, self.spark = catalog, catalog.spark
        self.fresh = itertools.count()
        self.columns: dict[str, str] = {}
        self.default: list[str] = []
        self.named: list[str] = []

    def c(self, name: str) -> str:
        """Spark's names don't tell case apart, SPARQL's do."""
        return self.columns.setdefault(name, f"v{len(self.columns)}")

    # -- scans

    def quads(self, graph: tuple | None) -> DataFrame:
        q = self.catalog.quads
        if graph is None:
            return q.where(F.col("g").isin(*self.default)) if self.default else q.where("g IS NULL")
        if graph[0] == "iri":
            return q.where(F.col("g") == graph[1])
        return q.where(F.col("g").isin(*self.named)) if self.named else q.where("g IS NOT NULL")

    def triple(self, s: tuple, p: tuple, o: tuple, graph: tuple | None) -> Solution:
        q = self.quads(graph)
        if p[0] == "iri":
            q = q.where(F.col("p") == p[1])
        elif p[0] == "lit":
            return Solution(self.spark.createDataFrame([], "none string").select(), set())
        if s[0] == "iri":
            q = q.where((F.col("s") == s[1]) & (F.col("s_kind") != "bnode"))
        elif s[0] == "lit":
            q = q.where(F.lit(False))
        if o[0] == "iri":
            q = q.where((F.col("o") == o[1]) & (F.col("o_kind") == "iri"))
        elif o[0] == "lit":
            datatype = F.coalesce("o_datatype", F.lit(XSD + "string"))
            q = q.where((F.col("o") == o[1]) & (F.col("o_kind") == "literal") & (F.lower(F.coalesce("o_lang", F.lit(""))) == (o[3] or "")))
            q = q if o[3] else q.where(datatype == (o[2] or XSD + "string"))
        parts: list[tuple[str, Column]] = []
        for term, column in ((s, subject_term()), (p, F.concat(F.lit("<"), F.col("p"), F.lit(">"))), (o, object_term())):
            if term[0] == "var":
                parts.append((self.c(term[1]), column))
        if graph is not None and graph[0] == "var":
            parts.append((self.c(graph[1]), F.concat(F.lit("<"), F.col("g"), F.lit(">"))))
        return self._columns(q, parts)

    def _columns(self, q: DataFrame, parts: list[tuple[str, Column]]) -> Solution:
        """Repeated variables must agree."""
        names: dict[str, Column] = {}
        for name, column in parts:
            if name in names:
                q = q.where(names[name] == column)
            else:
                names[name] = column
        q = q.select(*[c.alias(n) for n, c in names.items()]) if names else q.select(F.lit(1).alias("__one"))
        # The default graph is a set of triples.
        return Solution(q.distinct() if len(self.default) > 1 else q, set(names))

    # -- paths

    def path(self, path: tuple, graph: tuple | None, start: Column | None = None) -> DataFrame:
        """a, b of terms that the path leads between; ``start``, a term, if a is given."""
        kind = path[0]
        if kind == "iri":
            df = self.quads(graph).where(F.col("p") == path[1]).select(subject_term().alias("a"), object_term().alias("b"))
        elif kind == "inv":
            df = self.path(path[1], graph).select(F.col("b").alias("a"), F.col("a").alias("b"))
        elif kind == "seq":
            df = self.path(path[1][0], graph, start)
            for step in path[1][1:]:
                df = df.select("a", F.col("b").alias("m")).join(self.path(step, graph).select(F.col("a").alias("m"), "b"), "m").select("a", "b")
            return df
        elif kind == "alt":
            df = reduce(DataFrame.union, [self.path(p, graph) for p in path[1]])
        elif kind == "not":
            plain, inverse = [p[1] for p in path[1] if p[0] == "iri"], [p[1][1] for p in path[1] if p[0] == "inv"]
            q, parts = self.quads(graph), []
            if plain or not inverse:
                parts.append(q.where(~F.col("p").isin(*plain)).select(subject_term().alias("a"), object_term().alias("b")))
            if inverse:
                parts.append(q.where(~F.col("p").isin(*inverse)).select(object_term().alias("a"), subject_term().alias("b")))
            df = reduce(DataFrame.union, parts)
        else:
            edges = self.path(path[1], graph)
            if kind == "maybe":
                df = edges.distinct()
            else:
                sources = self.spark.range(1).select(start.alias("a")) if start is not None else None
                df = closure(edges, sources)
            if kind != "plus":
                q = self.quads(graph)
                same = q.select(subject_term().alias("n")).union(q.select(object_term().alias("n")))
                if start is not None:
                    same = self.spark.range(1).select(start.alias("n"))
                df = df.union(same.distinct().select(F.col("n").alias("a"), F.col("n").alias("b"))).distinct()
        return df if start is None else df.where(F.col("a") == start)

    def path_pattern(self, s: tuple, path: tuple, o: tuple, graph: tuple | None) -> Solution:
        if s[0] != "var" and o[0] != "var" or s[0] != "var":
            df = self.path(path, graph, F.lit(constant(s)))
        elif o[0] != "var":
            df = self.path(("inv", path) if path[0] not in ("plus", "star", "maybe") else (path[0], ("inv", path[1])), graph, F.lit(constant(o))).select(F.col("b").alias("a"), F.col("a").alias("b"))
        else:
            df = self.path(path, graph)
        parts = []
        for term, column in ((s, "a"), (o, "b")):
            if term[0] == "var":
                parts.append((self.c(term[1]), F.col(column)))
            else:
                df = df.where(F.col(column) == constant(term))
        return self._columns(df, parts)

    # -- joins

    def _sides(self, x: Solution, y: Solution, loose: list[str], null: frozenset[str] | None = None) -> tuple[DataFrame, DataFrame, list[Column]]:
        """Both sides with keys, and equalities that hold for compatible mappings and for each pair of rows once.

        A variable that may be unbound on a side is no reason for a nested loop. Its key is the value, or a mark: L where
        the left is unbound, R where only the right is. A row has a key for each way in which it can be met. ``null``: the
        right rows are those in which these variables are unbound and the others are not; then a left row has one key."""
        left, right = x.df.drop("__one"), y.df.select(*[F.col(n).alias(f"__r_{n}") for n in sorted(y.names)])
        if not y.names:
            right = y.df.select(F.lit(1).alias("__r"))
        if not left.columns:
            left = x.df.select(F.lit(1).alias("__l"))
        sure = sorted((x.names & y.names) - set(loose))
        on = [F.col(n) == F.col(f"__r_{n}") for n in sure]
        if null is not None:
            for n in sorted(loose):
                right = right.where(F.col(f"__r_{n}").isNull() if n in null else F.col(f"__r_{n}").isNotNull())
            loose = [n for n in loose if n not in null]
        for k, n in enumerate(sorted(loose)):
            a, b = F.col(n), F.col(f"__r_{n}")
            left_may, right_may = n not in x.bound, null is None and n not in y.bound
            value = lambda c: F.concat(F.lit("="), c)
            mine = F.when(a.isNotNull(), F.array(value(a), F.lit("R")) if right_may else F.array(value(a))).otherwise(F.array(F.lit("L")))
            theirs = F.when(b.isNotNull(), F.array(value(b), F.lit("L")) if left_may else F.array(value(b))).otherwise(F.array(F.lit("R"), F.lit("L")) if left_may else F.array(F.lit("R")))
            left, right = left.withColumn(f"__a{k}", F.explode(mine) if right_may else F.get(mine, F.lit(0))), right.withColumn(f"__b{k}", F.explode(theirs) if left_may or right_may else F.get(theirs, F.lit(0)))
            on.append(F.col(f"__a{k}") == F.col(f"__b{k}"))
        return left, right, on

    @staticmethod
    def _loose(x: Solution, y: Solution) -> list[str]:
        return sorted(n for n in x.names & y.names if n not in x.bound or n not in y.bound)

    def _nulls(self, y: Solution, loose: list[str]) -> list[frozenset[str]]:
        """The ways in which variables can be unbound on the right."""
        out = [frozenset()]
        for n in loose:
            if n not in y.bound:
                out += [q | {n} for q in out]
        return out

    def join(self, x: Solution, y: Solution, how: str = "inner", condition=None) -> Solution:
        """Compatible mappings; what may be unbound on a side is joined by marks instead of a condition."""
        if x.df is None:
            return y
        if y.df is None:
            return x
        shared, loose, both = x.names & y.names, self._loose(x, y), set(x.names | y.names)
        merged = {n: F.coalesce(F.col(n), F.col(f"__r_{n}")) if n in loose else F.col(n) for n in shared}
        scope = {n: merged.get(n, F.col(n) if n in x.names else F.col(f"__r_{n}")) for n in both}
        extra = [condition(scope)] if condition is not None else []
        left, right, on = self._sides(x, y, loose)
        whole = how == "left" and all(n in y.bound for n in loose)
        joined = left.join(right, reduce(Column.__and__, on + extra) if on + extra else F.lit(True), how if whole else "inner")
        out = joined.select(*[scope[n].alias(n) for n in sorted(both)]) if both else joined.select(F.lit(1).alias("__one"))
        if how == "left":
            if not whole:
                alone = self._meeting(x, y, loose, True, extra, False)
                out = out.union(alone.select(*[(F.col(n) if n in x.names else F.lit(None).cast("string")).alias(n) for n in sorted(both)]))
            return Solution(out, x.bound, (x.maybe | y.names) - x.bound)
        bound = x.bound | y.bound
        return Solution(out, bound, both - bound)

    def _meeting(self, x: Solution, y: Solution, loose: list[str], negated: bool, extra: list[Column], strict_domain: bool) -> DataFrame:
        """The rows of x that (don't) meet one of y: an equi-join for each way in which the right can be unbound."""
        rest, found = x.df, []
        names = list(x.df.columns)
        for null in self._nulls(y, loose):
            now = Solution(rest, x.bound, x.maybe)
            left, right, on = self._sides(now, y, loose, null)
            if strict_domain:
                # At least one variable must be bound on both sides.
                kept = [n for n in sorted(x.names & y.names) if n not in null]
                if not kept:
                    continue
                on = [*on, reduce(Column.__or__, [F.col(n).isNotNull() for n in kept])]
            if not on and not extra:
                right, left = right.select(F.lit(1).alias("__b")).limit(1), left.withColumn("__a", F.lit(1))
                on = [F.col("__a") == F.col("__b")]
            test = reduce(Column.__and__, on + extra)
            back = lambda df: df.select(*names) if "__one" not in names else df.select(F.lit(1).alias("__one"))  # noqa: B023, E731
            if not negated:
                found.append(back(left.join(right, test, "left_semi")))
            rest = back(left.join(right, test, "left_anti"))
        if negated:
            return rest
        return reduce(DataFrame.union, found) if found else x.df.limit(0)

    def exists(self, x: Solution, y: Solution, negated: bool, strict_domain: bool = False) -> Solution:
        shared = x.names & y.names
        if strict_domain and not shared:
            return x
        right = Solution(y.df.select(*sorted(shared)) if shared else y.df.select(F.lit(1).alias("__one")), y.bound & shared, shared - y.bound)
        return Solution(self._meeting(x, right, self._loose(x, right), negated, [], strict_domain), x.bound, x.maybe)

    # -- groups

    def group(self, parts: list, graph: tuple | None, outer_filters: list | None = None) -> Solution:
        now = Solution(None, set())
        filters, pending = list(outer_filters or []), []

        def flush() -> None:
            nonlocal now, pending
            waiting, pending = pending, []
            if self.statistics is not None and len(waiting) > 1:
                # Variables of the graph don't matter for the order.
                known = {v for v, c in self.columns.items() if c in now.names}
                ordered = self.statistics.order(waiting, known)
                self.chosen += ordered
                for t, _ in ordered:
                    now = self.join(now, self.triple(*t[1:], graph) if t[0] == "triple" else self.path_pattern(*t[1:], graph))
                return
            while waiting:
                seen = {n for n in now.names}
                rank = lambda t: (not (self._vars(t, graph) & seen) and bool(seen), sum(x[0] == "var" and self.c(x[1]) not in seen for x in (t[1], t[2], t[3])), t[0] == "path")
                best = min(waiting, key=rank)
                waiting.remove(best)
                one = self.triple(*best[1:], graph) if best[0] == "triple" else self.path_pattern(*best[1:], graph)
                now = self.join(now, one)

        for part in parts:
            kind = part[0]
            if kind in ("triple", "path"):
                pending.append(part)
                continue
            if kind == "filter":
                filters.append(part[1])
                continue
            flush()
            if kind == "group":
                now = self.join(now, self.group(part[1], graph))
            elif kind == "union":
                now = self.join(now, self.union([self.group(b[1], graph) for b in part[1]]))
            elif kind == "optional":
                inner = [p for p in part[1][1] if p[0] != "filter"]
                tests = [p[1] for p in part[1][1] if p[0] == "filter"]
                right = self.group(inner, graph)
                if now.df is None:
                    now = self.unit()
                if any(_has_exists(t) for t in tests):
                    right = self.filtered(right, tests, graph)
                    tests = []
                test = (lambda scope, t=tests: reduce(Column.__and__, [F.coalesce(self.ebv(e, scope), F.lit(False)) for e in t])) if tests else None
                now = self.join(now, right, "left", test)
            elif kind == "minus":
                if now.df is not None:
                    now = self.exists(now, self.group(part[1][1], graph), True, strict_domain=True)
            elif kind == "graph":
                now = self.join(now, self.group(part[2][1], part[1]))
            elif kind == "bind":
                now = self.bind(now if now.df is not None else self.unit(), part[1], part[2])
            elif kind == "values":
                now = self.join(now, self.values(part[1], part[2]))
            elif kind == "select":
                now = self.join(now, self.select(part[1], graph))
        flush()
        if now.df is None:
            now = self.unit()
        return self.filtered(now, filters, graph)

    def _vars(self, t: tuple, graph: tuple | None) -> set[str]:
        return {self.c(x[1]) for x in (t[1], t[2], t[3], *([graph] if graph else [])) if x[0] == "var"}

    def unit(self) -> Solution:
        return Solution(self.spark.range(1).select(F.lit(1).alias("__one")), set())

    def filtered(self, now: Solution, filters: list, graph: tuple | None) -> Solution:
        for e in filters:
            for part in _conjuncts(e):
                if part[0] == "exists":
                    now = self.exists(now, self.group(part[2][1], graph), part[1])
                elif part[0] == "not" and part[1][0] == "exists":
                    now = self.exists(now, self.group(part[1][2][1], graph), not part[1][1])
                elif _has_exists(part):
                    raise SparqlError("EXISTS is supported as a conjunct of FILTER only")
                else:
                    now = Solution(now.df.where(F.coalesce(self.ebv(part, self.scope(now)), F.lit(False))), now.bound, now.maybe)
        return now

    def scope(self, s: Solution) -> dict[str, Column]:
        return {n: F.col(n) for n in s.names}

    def union(self, branches: list[Solution]) -> Solution:
        names = set().union(*[b.names for b in branches])
        bound = set.intersection(*[b.bound for b in branches])
        frames = [b.df.select(*[(F.col(n) if n in b.names else F.lit(None).cast("string")).alias(n) for n in sorted(names)], *([F.lit(1).alias("__one")] if not names else [])) for b in branches]
        return Solution(reduce(DataFrame.union, frames), bound, names - bound)

    def bind(self, now: Solution, name: str, e: tuple) -> Solution:
        column = self.c(name)
        if column in now.names:
            raise SparqlError(f"?{name} is already bound")
        return Solution(now.df.withColumn(column, self.term(e, self.scope(now))), now.bound, now.maybe | {column})

    def values(self, names: list[str], rows: list) -> Solution:
        columns = [self.c(n) for n in names]
        data = [tuple(None if t is None else constant(t) for t in row) for row in rows]
        df = self.spark.createDataFrame(data, ", ".join(f"{c} string" for c in columns))
        maybe = {c for i, c in enumerate(columns) if any(r[i] is None for r in data)}
        return Solution(df, set(columns) - maybe, maybe)

    # -- SELECT

    def select(self, q: dict, graph: tuple | None = None) -> Solution:
        now = self.group(q["where"][1], graph)
        aggregates: dict[tuple, str] = {}
        items = q["items"]
        collect = lambda e: _collect(e, aggregates, self.fresh)
        grouped = q["group"] is not None or any(e is not None and _has_aggregate(e) for _, e in items or []) or any(map(_has_aggregate, q["having"]))
        having, order = list(q["having"]), list(q["order"])
        if grouped:
            if items is None:
                raise SparqlError("SELECT * can't be grouped")
            items = [(n, collect(e) if e is not None else None) for n, e in items]
            having = [collect(e) for e in having]
            order = [(collect(e), d) for e, d in order]
            now = self.aggregated(now, q["group"] or [], aggregates)
            keys = {n for n, _ in q["group"] or []}
            for n, e in items:
                if e is None and n not in keys:
                    raise SparqlError(f"?{n} is neither grouped nor aggregated")
        for e in having:
            now = Solution(now.df.where(F.coalesce(self.ebv(e, self.scope(now)), F.lit(False))), now.bound, now.maybe)
        for n, e in items or []:
            if e is not None:
                now = self.bind(now, n, e)
        keep = [self.c(n) for n, _ in items] if items is not None else sorted(n for n in now.names if not self._hidden(n))
        df = now.df.select(*[(F.col(n) if n in now.names else F.lit(None).cast("string")).alias(n) for n in dict.fromkeys(keep)], *[F.col(n) for n in sorted(now.names) if n not in keep and order]) if keep or order else now.df
        scope = {n: F.col(n) for n in now.names if n in df.columns}
        keys = []
        for e, down in order:
            for k in self.order_keys(self.term(e, scope)):
                keys.append(k.desc() if down else k.asc())
        if q["distinct"]:
            df = df.select(*dict.fromkeys(keep)).distinct() if not order else df.groupBy(*dict.fromkeys(keep)).agg(*[F.min(c).alias(c) for c in df.columns if c not in keep])
        df = df.orderBy(*keys) if keys else df
        df = df.offset(q["offset"]) if q["offset"] else df
        df = df.limit(q["limit"]) if q["limit"] is not None else df
        df = df.select(*dict.fromkeys(keep)) if keep else df
        return Solution(df, {n for n in keep if n in now.bound}, {n for n in keep if n not in now.bound})

    def _hidden(self, column: str) -> bool:
        return next((n for n, c in self.columns.items() if c == column), "").startswith("__")

    def order_keys(self, t: Column) -> list[Column]:
        kind = F.when(t.isNull(), 0).when(Terms.is_blank(t), 1).when(Terms.is_iri(t), 2).otherwise(3)
        return [kind, Terms.number(t)["v"], Terms.string(t), t]

    def aggregated(self, now: Solution, group: list, aggregates: dict[tuple, str]) -> Solution:
        for n, e in group:
            if e is not None:
                now = self.bind(now, n, e)
        keys = [self.c(n) for n, _ in group]
        df = now.df.select(*[(F.col(k) if k in now.names else F.lit(None).cast("string")).alias(k) for k in keys], *[F.col(n) for n in sorted(now.names) if n not in keys], *(["__one"] if "__one" in now.df.columns else []))
        scope = {n: F.col(n) for n in df.columns if n != "__one"}
        out = []
        for (_, name, distinct, e, separator), column in aggregates.items():
            if e is None:
                v = F.count_distinct(F.struct(*[F.coalesce(F.col(c), F.lit("")) for c in df.columns])) if distinct else F.count("*")
                out.append(Terms.of_number(F.struct(v.cast("double").alias("v"), F.lit(0).alias("rank"))).alias(column))
                continue
            t = self.term(e, scope)
            n = Terms.number(t)
            if name == "COUNT":
                a = Terms.of_number(F.struct((F.count_distinct(t) if distinct else F.count(t)).cast("double").alias("v"), F.lit(0).alias("rank")))
            elif name in ("SUM", "AVG"):
                # Exact sums in decimals: their order doesn't matter.
                v, rank = n["v"].cast("decimal(28,6)"), F.coalesce(F.max(n["rank"]), F.lit(0))
                total = (F.sum_distinct(v) if distinct else F.sum(v)).cast("double")
                many = F.count_distinct(v) if distinct else F.count(v)
                value = F.coalesce(total, F.lit(0.0)) if name == "SUM" else F.when(many > 0, total / many).otherwise(0.0)
                a = F.when(F.count(t) == F.count(n["v"]), Terms.of_number(F.struct(value.alias("v"), (rank if name == "SUM" else F.greatest(rank, F.lit(1))).alias("rank"))))
            elif name in ("MIN", "MAX"):
                pick = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(self.order_keys(t))])
                a = (F.min(F.when(t.isNotNull(), pick)) if name == "MIN" else F.max(F.when(t.isNotNull(), pick)))["k3"]
            elif name == "SAMPLE":
                a = F.min(t)
            else:
                parts = F.array_sort(F.collect_set(Terms.string(t)) if distinct else F.collect_list(Terms.string(t)))
                a = Terms.of_string(F.array_join(parts, separator))
            out.append(a.alias(column))
        df = df.groupBy(*keys).agg(*out) if out else df.select(*keys).distinct()
        bound = {k for k in keys if k in now.bound}
        return Solution(df, bound, set(df.columns) - bound)

    # -- expressions

    def term(self, e: tuple, scope: dict[str, Column]) -> Column:
        kind = e[0]
        if kind == "var":
            column = scope.get(self.c(e[1]))
            return column if column is not None else F.lit(None).cast("string")
        if kind == "__column":
            return scope[e[1]]
        if kind in ("iri", "lit"):
            return F.lit(constant(e))
        if kind == "arith":
            return Terms.of_number(self.arithmetic(e, scope))
        if kind in ("or", "and", "not", "compare", "in"):
            return Terms.of_boolean(self.ebv(e, scope))
        if kind == "call":
            return self.call(e[1], e[2], scope)
        raise SparqlError(f"unsupported expression: {kind}")

    def number(self, e: tuple, scope: dict[str, Column]) -> Column:
        return self.arithmetic(e, scope) if e[0] == "arith" else Terms.number(self.term(e, scope))

    def arithmetic(self, e: tuple, scope: dict[str, Column]) -> Column:
        x, y = self.number(e[2], scope), self.number(e[3], scope)
        op, a, b = e[1], x["v"], y["v"]
        v = a + b if op == "+" else a - b if op == "-" else a * b if op == "*" else F.when(b != 0, a / b)
        rank = F.greatest(x["rank"], y["rank"]) if op != "/" else F.greatest(x["rank"], y["rank"], F.lit(1))
        return F.when(v.isNotNull(), F.struct(v.alias("v"), rank.alias("rank")))

    def ebv(self, e: tuple, scope: dict[str, Column]) -> Column:
        """The effective boolean value; null is an error."""
        kind = e[0]
        if kind == "or":
            return self.ebv(e[1], scope) | self.ebv(e[2], scope)
        if kind == "and":
            return self.ebv(e[1], scope) & self.ebv(e[2], scope)
        if kind == "not":
            return ~self.ebv(e[1], scope)
        if kind == "compare":
            return self.compare(e[1], e[2], e[3], scope)
        if kind == "in":
            tests = [self.compare("=", e[1], x, scope) for x in e[2]]
            return reduce(Column.__or__, tests, F.lit(False))
        if kind == "call" and e[1] in BOOLEAN:
            return self.call(e[1], e[2], scope, raw=True)
        t = self.term(e, scope)
        n, dt = Terms.number(t)["v"], Terms.datatype(t)
        return F.when(dt == XSD + "boolean", Terms.lexical(t).isin("true", "1")).when(n.isNotNull(), (n != 0) & ~F.isnan(n)).when(dt == XSD + "string", Terms.lexical(t) != "")

    def compare(self, op: str, left: tuple, right: tuple, scope: dict[str, Column]) -> Column:
        x, y = self.term(left, scope), self.term(right, scope)
        a, b = self.number(left, scope)["v"], self.number(right, scope)["v"]
        dx, dy = Terms.datatype(x), Terms.datatype(y)
        lx, ly = Terms.lexical(x), Terms.lexical(y)
        times = (XSD + "dateTime", XSD + "date")
        tx, ty = lx.try_cast("timestamp"), ly.try_cast("timestamp")
        relate = {"=": Column.__eq__, "!=": Column.__ne__, "<": Column.__lt__, ">": Column.__gt__, "<=": Column.__le__, ">=": Column.__ge__}[op]
        out = F.when(a.isNotNull() & b.isNotNull(), relate(a, b)).when(dx.isin(*times) & dy.isin(*times) & tx.isNotNull() & ty.isNotNull(), relate(tx, ty))
        if op in ("=", "!="):
            known = ~Terms.is_literal(x) | ~Terms.is_literal(y) | dx.isin(XSD + "string", XSD + "boolean") | (x == y) | (dx != dy)
            return out.when(known, relate(x, y))
        return out.when((dx == dy) & dx.isin(XSD + "string", XSD + "boolean"), relate(lx, ly))

    def call(self, name: str, args: list, scope: dict[str, Column], raw: bool = False) -> Column:
        """The term that a function gives; ``raw`` gives a test's truth value itself, which keeps plans small."""
        t = [self.term(a, scope) for a in args] if name not in ("IF", "COALESCE", "BOUND") else []
        s = lambda i: Terms.string(t[i])
        lex = lambda i: Terms.lexical(t[i])
        num = lambda i: self.number(args[i], scope)
        text = lambda c, like=None: Terms.of_string(c, like)
        boolean = (lambda c: c) if raw else Terms.of_boolean
        integer = lambda c: Terms.of_number(F.when(c.isNotNull(), F.struct(c.cast("double").alias("v"), F.lit(0).alias("rank"))))
        rounded = lambda f: Terms.of_number(F.when(num(0).isNotNull(), F.struct(f(num(0)["v"]).cast("double").alias("v"), num(0)["rank"].alias("rank"))))
        stamp = lambda: lex(0).try_cast("timestamp")
        zone = lambda: F.regexp_extract(lex(0), r"(Z|[+-]\d\d:\d\d)$", 1)
        if name == "BOUND":
            return boolean(self.term(args[0], scope).isNotNull())
        if name == "IF":
            test = self.ebv(args[0], scope)
            return F.when(test, self.term(args[1], scope)).when(~test, self.term(args[2], scope))
        if name == "COALESCE":
            return F.coalesce(*[self.term(a, scope) for a in args])
        simple = {
            "STR": lambda: text(s(0)),
            "LANG": lambda: text(Terms.language(t[0])),
            "DATATYPE": lambda: Terms.of_iri(Terms.datatype(t[0])),
            "IRI": lambda: Terms.of_iri(s(0)),
            "URI": lambda: Terms.of_iri(s(0)),
            "BNODE": lambda: F.concat(F.lit("_:"), lex(0) if t else F.replace(F.uuid(), F.lit("-"), F.lit(""))),
            "STRLEN": lambda: integer(F.length(lex(0))),
            "SUBSTR": lambda: text(F.substring(lex(0), num(1)["v"].cast("int"), num(2)["v"].cast("int") if len(t) > 2 else F.length(lex(0))), t[0]),
            "UCASE": lambda: text(F.upper(lex(0)), t[0]),
            "LCASE": lambda: text(F.lower(lex(0)), t[0]),
            "STRSTARTS": lambda: boolean(F.startswith(lex(0), lex(1))),
            "STRENDS": lambda: boolean(F.endswith(lex(0), lex(1))),
            "CONTAINS": lambda: boolean(F.contains(lex(0), lex(1))),
            "STRBEFORE": lambda: text(F.when(F.contains(lex(0), lex(1)), F.substring(lex(0), F.lit(1), F.instr(lex(0), lex(1)) - 1)).otherwise("")),
            "STRAFTER": lambda: text(F.when(F.contains(lex(0), lex(1)), F.substring(lex(0), F.instr(lex(0), lex(1)) + F.length(lex(1)), F.length(lex(0)))).otherwise("")),
            "ENCODE_FOR_URI": lambda: text(F.replace(F.replace(F.url_encode(lex(0)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))),
            "CONCAT": lambda: text(F.concat(*[lex(i) for i in range(len(t))])),
            "LANGMATCHES": lambda: boolean(F.when(lex(1) == "*", lex(0) != "").otherwise((F.lower(lex(0)) == F.lower(lex(1))) | F.startswith(F.lower(lex(0)), F.concat(F.lower(lex(1)), F.lit("-"))))),
            "REGEX": lambda: boolean(F.regexp_like(lex(0), self._pattern(lex(1), args[2:]))),
            "REPLACE": lambda: text(F.regexp_replace(lex(0), self._pattern(lex(1), args[3:]), lex(2)), t[0]),
            "ABS": lambda: rounded(F.abs),
            "ROUND": lambda: rounded(lambda v: F.floor(v + 0.5)),
            "CEIL": lambda: rounded(F.ceil),
            "FLOOR": lambda: rounded(F.floor),
            "RAND": lambda: Terms.of_number(F.struct(F.rand().alias("v"), F.lit(2).alias("rank"))),
            "NOW": lambda: F.concat(F.lit('"'), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(f'"^^<{XSD}dateTime>')),
            "YEAR": lambda: integer(F.regexp_extract(lex(0), r"^(-?\d{4,})-\d\d-\d\d", 1).try_cast("int")),
            "MONTH": lambda: integer(F.regexp_extract(lex(0), r"^-?\d{4,}-(\d\d)-\d\d", 1).try_cast("int")),
            "DAY": lambda: integer(F.regexp_extract(lex(0), r"^-?\d{4,}-\d\d-(\d\d)", 1).try_cast("int")),
            "HOURS": lambda: integer(F.regexp_extract(lex(0), r"T(\d\d):", 1).try_cast("int")),
            "MINUTES": lambda: integer(F.regexp_extract(lex(0), r"T\d\d:(\d\d)", 1).try_cast("int")),
            "SECONDS": lambda: Terms.of_number(F.when(stamp().isNotNull(), F.struct(F.regexp_extract(lex(0), r"T\d\d:\d\d:([\d.]+)", 1).try_cast("double").alias("v"), F.lit(1).alias("rank")))),
            "TZ": lambda: text(zone()),
            "TIMEZONE": lambda: F.when(zone() == "Z", f'"PT0S"^^<{XSD}dayTimeDuration>').when(zone() != "", F.concat(F.lit('"'), F.when(F.startswith(zone(), F.lit("-")), "-").otherwise(""), F.lit("PT"), F.substring(zone(), 2, 2).cast("int").cast("string"), F.lit("H"), F.lit(f'"^^<{XSD}dayTimeDuration>'))),
            "MD5": lambda: text(F.md5(lex(0).cast("binary"))),
            "SHA1": lambda: text(F.sha1(lex(0).cast("binary"))),
            "SHA256": lambda: text(F.sha2(lex(0), 256)),
            "SHA384": lambda: text(F.sha2(lex(0), 384)),
            "SHA512": lambda: text(F.sha2(lex(0), 512)),
            "SAMETERM": lambda: boolean(t[0] == t[1]),
            "ISIRI": lambda: boolean(Terms.is_iri(t[0])),
            "ISURI": lambda: boolean(Terms.is_iri(t[0])),
            "ISBLANK": lambda: boolean(Terms.is_blank(t[0])),
            "ISLITERAL": lambda: boolean(Terms.is_literal(t[0])),
            "ISNUMERIC": lambda: boolean(F.when(t[0].isNotNull(), Terms.number(t[0]).isNotNull())),
            "STRDT": lambda: F.when(s(1) == XSD + "string", text(lex(0))).otherwise(F.concat(F.lit('"'), escape(lex(0)), F.lit('"^^<'), s(1), F.lit(">"))),
            "STRLANG": lambda: F.concat(F.lit('"'), escape(lex(0)), F.lit('"@'), F.lower(lex(1))),
            "UUID": lambda: F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")),
            "STRUUID": lambda: text(F.uuid()),
        }
        if name in simple:
            return simple[name]()
        if name.startswith(XSD):
            kind, value = name[len(XSD):], s(0)
            if kind == "string":
                return text(value)
            if kind == "boolean":
                return boolean(self.ebv(args[0], scope))
            if name in NUMERIC:
                rank = {"decimal": 1, "double": 2, "float": 2}.get(kind, 0)
                v = value.try_cast("double")
                return Terms.of_number(F.when(v.isNotNull(), F.struct((F.when(v >= 0, F.floor(v)).otherwise(F.ceil(v)).cast("double") if rank == 0 else v).alias("v"), F.lit(rank).alias("rank"))))
            return F.concat(F.lit('"'), escape(value), F.lit(f'"^^<{name}>'))
        raise SparqlError(f"unknown function: {name}")

    @staticmethod
    def _pattern(c: Column, flags: list) -> Column:
        if not flags:
            return c
        letters = "".join(x for x in flags[0][1] if x in "ismx")
        return F.concat(F.lit(f"(?{letters})"), c) if letters else c


def _conjuncts(e: tuple) -> list:
    return _conjuncts(e[1]) + _conjuncts(e[2]) if e[0] == "and" else [e]


def _walk(e):
    if isinstance(e, tuple):
        yield e
        if e and e[0] == "exists":
            return
        for x in e[1:]:
            yield from _walk(x)
    elif isinstance(e, list):
        for x in e:
            yield from _walk(x)


def _has_exists(e) -> bool:
    return any(x[:1] == ("exists",) for x in _walk(e))


def _has_aggregate(e) -> bool:
    return any(x[:1] == ("aggregate",) and x[1] in AGGREGATES for x in _walk(e))


def _freeze(e):
    return tuple(map(_freeze, e)) if isinstance(e, (tuple, list)) else e


def _collect(e, found: dict, fresh) -> tuple:
    """The expression with its aggregates replaced by columns."""
    if isinstance(e, tuple) and e[:1] == ("aggregate",):
        return ("__column", found.setdefault(e if not isinstance(e[3], list) else _freeze(e), f"a{next(fresh)}")) if _hashable(e) else _add(e, found, fresh)
    if isinstance(e, tuple):
        return tuple(_collect(x, found, fresh) for x in e)
    if isinstance(e, list):
        return [_collect(x, found, fresh) for x in e]
    return e


def _hashable(e) -> bool:
    try:
        hash(e)
    except TypeError:
        return False
    return True


def _add(e, found: dict, fresh) -> tuple:
    key = ("aggregate", e[1], e[2], _Box(e[3]), e[4])
    return ("__column", found.setdefault(key, f"a{next(fresh)}"))


class _Box(tuple):
    """An expression that holds lists, told apart by identity."""

    def __new__(cls, e):
        return super().__new__(cls, e)

    def __hash__(self):
        return id(self)

    def __eq__(self, other):
        return self is other


def run_sparql(catalog: Catalog, text: str, statistics: Statistics | None = None) -> QueryResult:
    """statistics: of ``stats.gather``; joins are then ordered by estimated rows, else by bound variables."""
    if len(text.encode()) > MAX_QUERY_BYTES:
        raise SparqlError(f"query exceeds maximum length of {MAX_QUERY_BYTES} bytes")
    if is_update(text):
        raise SparqlError("SPARQL Update is not supported")
    q = parse(text)
    compiler = Compiler(catalog)
    compiler.statistics = statistics
    compiler.default, compiler.named = q["from"], q["from_named"]
    if q["form"] == "ask":
        found = compiler.group(q["where"][1], None)
        yes = found.df.limit(1).agg((F.count("*") > 0).cast("string").alias("boolean"))
        return QueryResult(["boolean"], yes)
    solution = compiler.select(q)
    of = {c: n for n, c in compiler.columns.items()}
    names = [n for n, _ in q["items"]] if q["items"] is not None else sorted(of[c] for c in solution.names)
    frame = solution.df.select(*[F.coalesce(F.col(compiler.c(n)), F.lit("")).alias(n) for n in names])
    return QueryResult(names, frame)


def join_order(catalog: Catalog, text: str, statistics: Statistics) -> list[tuple[tuple, float]]:
    """The patterns in the order in which they are joined, each with the rows that are expected after it."""
    q = parse(text)
    compiler = Compiler(catalog)
    compiler.statistics = statistics
    compiler.default, compiler.named = q["from"], q["from_named"]
    compiler.group(q["where"][1], None) if q["form"] == "ask" else compiler.select(q)
    return compiler.chosen
