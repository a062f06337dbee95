"""Statistics of quads, from which the order of SPARQL joins is chosen, and storage that suits them.

A characteristic set is the set of predicates that a subject has. How many subjects have each set, and how many triples of
each predicate they have, says how many rows a star of patterns on one subject gives, though its predicates depend on each
other. Joins with other patterns are estimated from the numbers of triples, subjects and objects of their predicates.

Statistics only choose an order: results are the same without them. The driver gets a row for each predicate, and the
MOST sets that most subjects have; stars of rarer sets count as rare.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.catalog import Catalog
from lattica.storage import cut

MOST = 2_000


def characteristic_sets(quads: DataFrame) -> DataFrame:
    """predicates (sorted), subjects, triples (of each predicate, in the same order)."""
    each = quads.groupBy("s", "s_kind", "p").agg(F.count("*").alias("n"))
    of = each.groupBy("s", "s_kind").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("x"))
    rows = of.select(F.transform("x", lambda e: e["p"]).alias("predicates"), F.transform("x", lambda e: e["n"]).alias("n"))
    sums = rows.select("predicates", F.posexplode("n").alias("k", "n")).groupBy("predicates", "k").agg(F.sum("n").alias("n"), F.count("*").alias("subjects"))
    return sums.groupBy("predicates").agg(F.max("subjects").alias("subjects"), F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda e: e["n"]).alias("triples"))


def predicates(quads: DataFrame) -> DataFrame:
    """p, triples, subjects, objects (the last two nearly)."""
    return quads.groupBy("p").agg(F.count("*").alias("triples"), F.approx_count_distinct("s").alias("subjects"), F.approx_count_distinct("o").alias("objects"))


@dataclass
class Statistics:
    predicates: dict[str, tuple[int, int, int]] = field(default_factory=dict)
    sets: list[tuple[dict[str, float], int]] = field(default_factory=list)

    @property
    def total(self) -> int:
        return sum(x[0] for x in self.predicates.values())

    def star(self, wanted: frozenset[str]) -> float:
        """Rows of a star: a subject with all these predicates, for each combination of its objects."""
        return sum(n * prod(per[p] for p in wanted) for per, n in self.sets if wanted <= per.keys()) or 0.5

    def size(self, s: tuple, p: tuple, o: tuple) -> float:
        """Rows of one pattern."""
        if p[0] != "iri":
            triples, subjects, objects = self.total, *(max([1, *(x[k] for x in self.predicates.values())]) for k in (1, 2))
        else:
            triples, subjects, objects = self.predicates.get(p[1], (0, 1, 1))
        return triples / (1 if s[0] == "var" else max(1, subjects)) / (1 if o[0] == "var" else max(1, objects))

    def distinct(self, s: tuple, p: tuple, o: tuple, variable: str) -> float:
        """Different values of a pattern's variable."""
        _, subjects, objects = self.predicates.get(p[1], (0, 1, 1)) if p[0] == "iri" else (0, self.total, self.total)
        return max(1.0, min(self.size(s, p, o), subjects if s == ("var", variable) else objects))

    def order(self, patterns: list[tuple], known: set[str]) -> list[tuple[tuple, float]]:
        """The patterns (kind, s, p, o), least rows first, each with the rows after it; known: variables bound before."""
        left, out, seen = list(patterns), [], set(known)
        rows, stars, values = 1.0, {}, {}
        names = lambda t: {x[1] for x in t[1:] if x[0] == "var"}

        def after(t: tuple) -> float:
            _, s, p, o = t
            own = self.size(s, p, o) if t[0] == "triple" else float(self.total)
            shared = names(t) & seen
            if not shared:
                return rows * own
            if t[0] == "triple" and p[0] == "iri" and s[0] == "var" and s[1] in stars:
                grown = rows * self.star(stars[s[1]] | {p[1]}) / self.star(stars[s[1]])
                grown /= 1 if o[0] == "var" else max(1, self.predicates.get(p[1], (0, 1, 1))[2])
                return grown / (max(1.0, values.get(o[1], 1.0)) if o[0] == "var" and o[1] in seen else 1)
            for v in shared:
                own /= max(values.get(v, 1.0), self.distinct(s, p, o, v) if t[0] == "triple" else 1.0)
            return rows * own

        while left:
            linked = [t for t in left if names(t) & seen] or left
            best = min(linked, key=after)
            rows = max(after(best), 1e-3)
            left.remove(best)
            _, s, p, o = best
            if best[0] == "triple" and p[0] == "iri" and s[0] == "var":
                stars[s[1]] = stars.get(s[1], frozenset()) | {p[1]}
            for v in names(best):
                d = self.distinct(s, p, o, v) if best[0] == "triple" else rows
                values[v] = min(values.get(v, d), d, max(1.0, rows))
            seen |= names(best)
            out.append((best, rows))
        return out


def gather(quads: DataFrame) -> Statistics:
    found = Statistics({r.p: (r.triples, r.subjects, r.objects) for r in predicates(quads).collect()})
    for r in characteristic_sets(quads).orderBy(F.desc("subjects"), "predicates").limit(MOST).collect():
        found.sets.append(({p: n / r.subjects for p, n in zip(r.predicates, r.triples)}, r.subjects))
    return found


def clustered(catalog: Catalog) -> Catalog:
    """The same catalog with quads in ranges of predicate and subject: a pattern reads the row groups of its predicate."""
    rows = catalog.quads.repartitionByRange("p", "s").sortWithinPartitions("p", "s")
    return catalog.with_(quads=cut(rows, "quads-by-predicate"))
