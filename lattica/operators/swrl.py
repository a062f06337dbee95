"""SWRL rules: read from quads, checked, and materialised as conjunctive queries to a fixpoint."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.catalog import Catalog
from lattica.model import SWRL_RULE, TYPE
from lattica.operators.fixpoint import MAX_ROUNDS
from lattica.storage import Grown, cut

MAX_ATOMS, MAX_IRI = 256, 2_048

# Built-ins as column functions; the last argument of those in ASSIGN may be an unbound variable that gets the value.
_N = lambda c: c.try_cast("double")
BUILTINS = {
    "equal": lambda a, b: F.coalesce(_N(a) == _N(b), a == b), "notEqual": lambda a, b: ~F.coalesce(_N(a) == _N(b), a == b),
    "lessThan": lambda a, b: _N(a) < _N(b), "lessThanOrEqual": lambda a, b: _N(a) <= _N(b), "greaterThan": lambda a, b: _N(a) > _N(b), "greaterThanOrEqual": lambda a, b: _N(a) >= _N(b),
    "stringEqualIgnoreCase": lambda a, b: F.lower(a) == F.lower(b), "contains": lambda a, b: F.contains(a, b), "startsWith": lambda a, b: F.startswith(a, b), "endsWith": lambda a, b: F.endswith(a, b), "matches": lambda a, b: F.regexp_like(a, b),
}
ASSIGN = {
    "add": lambda x: reduce(Column.__add__, map(_N, x)), "subtract": lambda x: _N(x[0]) - _N(x[1]), "multiply": lambda x: reduce(Column.__mul__, map(_N, x)), "divide": lambda x: F.when(_N(x[1]) != 0, _N(x[0]) / _N(x[1])),
    "stringConcat": lambda x: F.concat(*x), "substring": lambda x: F.substring(x[0], x[1].try_cast("int"), x[2].try_cast("int") if len(x) > 2 else F.length(x[0])), "stringLength": lambda x: F.length(x[0]).cast("double"), "booleanNot": lambda x: F.when(x[0] == "true", "false").otherwise("true"),
}


def rules_of(catalog: Catalog) -> list[dict]:
    """The rules, which are few and short, as dicts: id, enabled, body, head."""
    out = []
    for r in catalog.quads.where(F.col("p") == SWRL_RULE).select("s", "o").orderBy("s", "o").collect():
        try:
            rule = json.loads(r.o)
        except ValueError:
            rule = {"id": r.s, "body": [], "head": [], "error": "not JSON"}
        out.append({"id": r.s, "enabled": True, "body": [], "head": [], **rule})
    return out


def _args(atom: dict) -> list:
    args = atom.get("args") or [atom[k] for k in ("arg", "subject", "object", "arg1", "arg2", "left", "right") if k in atom]
    out = []
    for a in args:
        if isinstance(a, dict):
            out.append(("var", a.get("var", a.get("value", a.get("name")))) if a.get("kind") == "variable" or "var" in a or a.get("is_var") else ("const", str(a.get("value", a.get("iri", "")))))
        else:
            text = str(a)
            out.append(("var", text[1:]) if text.startswith("?") else ("const", text))
    return out


def _name(atom: dict) -> str:
    return next((str(atom[k]) for k in ("class", "class_iri", "property", "property_iri", "predicate", "builtin", "iri") if k in atom), "")


def _kind(atom: dict) -> str:
    kind = str(atom.get("kind", "")).lower()
    return "builtin" if "builtin" in kind or "built_in" in kind else "same" if "same" in kind else "different" if "different" in kind else "range" if "range" in kind else "class" if "class" in kind else "property"


def variables(atoms: list[dict]) -> set[str]:
    return {v for a in atoms for k, v in _args(a) if k == "var"}


def validate_rule(rule: dict) -> list[dict]:
    """code, severity, message of what is wrong with a rule."""
    say = lambda code, severity, message: {"code": code, "severity": severity, "message": f"{rule.get('id', '')}: {message}"}
    out = []
    if rule.get("error"):
        out.append(say("swrl_syntax", "error", rule["error"]))
    for part in ("body", "head"):
        if not rule[part]:
            out.append(say(f"swrl_empty_{part}", "error", f"the {part} is empty"))
    atoms = [*rule["body"], *rule["head"]]
    if len(atoms) > MAX_ATOMS:
        out.append(say("swrl_too_many_atoms", "error", f"more than {MAX_ATOMS} atoms"))
    for v in sorted(variables(rule["head"]) - variables(rule["body"])):
        out.append(say("swrl_unbound_variable", "error", f"?{v} is in the head but not in the body"))
    for a in atoms:
        name = _name(a)
        if _kind(a) not in ("same", "different") and (not name or len(name) > MAX_IRI):
            out.append(say("swrl_bad_iri", "error", "an atom has an empty or very long IRI"))
        if _kind(a) == "builtin" and name.rpartition("#")[2].rpartition(":")[2] not in {*BUILTINS, *ASSIGN}:
            out.append(say("swrl_unsupported_builtin", "warning", f"{name} is not supported"))
        if _kind(a) == "range":
            out.append(say("swrl_data_range", "warning", "data ranges are not executed"))
    return out


def diagnostics(catalog: Catalog) -> DataFrame:
    rows = [(d["code"], d["severity"], d["message"]) for r in rules_of(catalog) for d in validate_rule(r)]
    return catalog.spark.createDataFrame(rows, "code string, severity string, message string")


def _atom(a: dict, facts: DataFrame) -> DataFrame:
    """Bindings of one atom over facts (s, p, o)."""
    args = _args(a)
    kind = _kind(a)
    if kind == "class":
        df, columns = facts.where((F.col("p") == TYPE) & (F.col("o") == _name(a))), ["s"]
    else:
        df, columns = facts.where(F.col("p") == _name(a)), ["s", "o"]
    names: dict[str, str] = {}
    for (k, v), c in zip(args, columns):
        if k == "const":
            df = df.where(F.col(c) == v)
        elif v in names:
            df = df.where(F.col(names[v]) == F.col(c))
        else:
            names[v] = c
    return df.select(*[F.col(c).alias(v) for v, c in names.items()]).distinct() if names else df.select(F.lit(1).alias("__one")).limit(1)


def _body(rule: dict, facts: DataFrame, new: DataFrame, old: DataFrame | None) -> DataFrame | None:
    """Bindings of which at least one atom is new: a union over the first such atom, with old facts before it and all
    facts after it, so that none is found twice. Without old facts all are new, and one pass is enough. Variables that
    nothing needs any more are left out as soon as they are joined."""
    patterns = [a for a in rule["body"] if _kind(a) in ("class", "property")]
    last = variables([*rule["head"], *[a for a in rule["body"] if _kind(a) not in ("class", "property")]])
    out = []
    for i in range(len(patterns) if old is not None else min(1, len(patterns))):
        df, left = _atom(patterns[i], new), [(j, a) for j, a in enumerate(patterns) if j != i]
        while left:
            j, a = next((x for x in left if variables([x[1]]) & set(df.columns)), left[0])
            left.remove((j, a))
            right = _atom(a, old if old is not None and j < i else facts)
            shared = [c for c in right.columns if c in df.columns and c != "__one"]
            df = df.join(right.drop("__one") if shared else right, shared or None).drop("__one") if shared else df.join(right.withColumnRenamed("__one", "__other"))
            needed = last | variables([x for _, x in left])
            kept = [c for c in df.columns if c in needed]
            if kept and len(kept) < len(df.columns):
                df = df.select(*kept).distinct()
        out.append(df.drop("__one", "__other"))
    if not out:
        return None
    df = reduce(lambda x, y: x.unionByName(y), out).distinct()
    for a in rule["body"]:
        kind, args = _kind(a), _args(a)
        value = lambda arg: F.col(arg[1]).cast("string") if arg[0] == "var" else F.lit(arg[1])
        if kind in ("same", "different"):
            test = value(args[0]) == value(args[1])
            df = df.where(test if kind == "same" else ~test)
        elif kind == "builtin":
            name = _name(a).rpartition("#")[2].rpartition(":")[2]
            if name in BUILTINS:
                df = df.where(F.coalesce(BUILTINS[name](*map(value, args)), F.lit(False)))
            else:
                result = ASSIGN[name](list(map(value, args[1:]))).cast("string")
                target = args[0]
                df = df.where(value(target) == result) if target[0] == "const" or target[1] in df.columns else df.withColumn(target[1], result)
    return df


def _reads(rule: dict) -> set[tuple[str, str]]:
    """Kind and name of the facts that a rule's body is about."""
    return {(_kind(a), _name(a)) for a in rule["body"] if _kind(a) in ("class", "property")}


def _about(names: set[tuple[str, str]]) -> Column:
    """Whether a fact (p, o) is one of such kinds and names."""
    classes, properties = (sorted(n for k, n in names if (k == "class") == wanted) for wanted in (True, False))
    return (F.col("p") == TYPE) & F.col("o").isin(classes) | F.col("p").isin(properties)


def materialise(catalog: Catalog) -> tuple[DataFrame, list[str]]:
    """s, p, o that enabled rules add to types and property assertions, and warnings of rules left out.

    Variables range over named terms only. Each round joins new facts with all; only facts that a rule reads or makes are
    held, what a round finds is compared with facts of its own name, and rounds end with the rules that can go on."""
    warnings, rules = [], []
    for rule in rules_of(catalog):
        bad = validate_rule(rule)
        if rule["enabled"] and not bad:
            rules.append(rule)
        else:
            warnings += [d["message"] for d in bad] or [f"{rule['id']}: disabled"]
    ax = catalog.axioms
    known = ax.where(F.col("axiom_kind") == "class_assertion").select(F.col("subject").alias("s"), F.lit(TYPE).alias("p"), F.col("object").alias("o"))
    known = known.union(ax.where(F.col("axiom_kind").isin("object_property_assertion", "data_property_assertion")).select("subject", "predicate", "object"))
    made_by = lambda rules: {("class" if _kind(a) == "class" else "property", _name(a)) for r in rules for a in r["head"]}
    read = set().union(*map(_reads, rules)) if rules else set()
    start = new = cut(known.where(_about(read | made_by(rules))), "swrl", "zstd")
    made, old, active = None, None, rules
    for _ in range(MAX_ROUNDS if rules else 0):
        known, found = start.union(made.frame) if made else start, {}
        for rule in active:
            df = _body(rule, known, new, old)
            for a in rule["head"] if df is not None else []:
                value = lambda arg: F.col(arg[1]).cast("string") if arg[0] == "var" else F.lit(arg[1])
                args = _args(a)
                p, o = (F.lit(TYPE), F.lit(_name(a))) if _kind(a) == "class" else (F.lit(_name(a)), value(args[1]))
                name = "class" if _kind(a) == "class" else "property", _name(a)
                found.setdefault(name, []).append(df.select(value(args[0]).alias("s"), p.alias("p"), o.alias("o")))
        if not found:
            break
        # A property atom that names the type's property makes types of any class: then all types are compared together.
        if ("property", TYPE) in found:
            classes = [name for name in found if name[0] == "class"]
            found["property", TYPE] += [f for name in classes for f in found.pop(name)]
        facts = []
        for name, frames in found.items():
            own, rows = known.where(_about({name})), reduce(DataFrame.union, frames).distinct()
            facts.append(rows if own.isEmpty() else rows.join(own, ["s", "p", "o"], "left_anti"))
        new = cut(reduce(DataFrame.union, facts), "swrl", "zstd")
        if new.isEmpty():
            break
        if made:
            made.add(new)
            old = start.union(made.before)
        else:
            made, old = Grown(new, "swrl"), start
        now = made_by(active)
        typed = any(k == "class" or n == TYPE for k, n in now)
        active = [r for r in rules if any(x in now or typed and (x[0] == "class" or x[1] == TYPE) for x in _reads(r))]
        if not active:
            break
    return (made.frame if made else start.limit(0)), warnings
