"""Command line: lattica index|query|sparql|validate|inspect|classify|explain|realize|check-instance|dl-query|usages|diff|docs WORKSPACE ..."""

from __future__ import annotations

import argparse
import sys

from lattica import sinks
from lattica.model import LatticaError
from lattica.operators import diagnostics, diff, reason
from lattica.workspace import Workspace


def _show(frame, columns=None) -> None:
    for r in (frame.select(*columns) if columns else frame).toLocalIterator():
        print("\t".join("" if v is None else str(v) for v in r))


def main(argv: list[str] | None = None, spark=None) -> int:
    p = argparse.ArgumentParser(prog="lattica", description=__doc__)
    commands = p.add_subparsers(dest="command", required=True)
    for name, more in {"index": (), "inspect": (), "validate": (), "query": ("text",), "sparql": ("text",), "classify": (), "explain": ("iri",), "realize": (), "check-instance": ("iri", "class_iri"), "dl-query": ("text",), "usages": ("iri",), "search": ("text",), "diff": ("head",), "docs": ("folder",)}.items():
        c = commands.add_parser(name)
        c.add_argument("workspace")
        for m in more:
            c.add_argument(m)
        c.add_argument("--format", default="text", choices=["text", "csv", "json", "markdown", "html"])
        c.add_argument("--profile", default="rl", choices=reason.PROFILES)
    a = p.parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lattica").getOrCreate()
    try:
        ws = Workspace.open(spark, a.workspace)
        if a.command in ("index", "inspect"):
            _show(ws.stats())
        elif a.command == "validate":
            rows = ws.diagnostics()
            _show(rows.orderBy("file", "line", "code"), ["severity", "code", "file", "line", "message"])
            return diagnostics.exit_code(rows)
        elif a.command in ("query", "sparql"):
            result = ws.query(a.text) if a.command == "query" else ws.sparql(a.text)
            if a.format == "json":
                print(sinks.to_json(result, objects=a.command == "sparql"))
            else:
                for line in sinks.to_tsv(result):
                    print(line.replace("\t", ",") if a.format == "csv" else line)
        elif a.command == "classify":
            result = ws.classify(a.profile)
            _show(result.inferred.orderBy("child", "parent"))
            for w in result.warnings:
                print(f"# {w}", file=sys.stderr)
            bad = [r.iri for r in result.unsatisfiable.orderBy("iri").collect()]
            print("\n".join(f"unsatisfiable\t{x}" for x in bad)) if bad else None
            return int(bool(bad))
        elif a.command == "explain":
            for chain in ws.explain(a.iri, 8):
                print("; ".join(chain))
        elif a.command == "realize":
            _show(reason.realize(ws.catalog, a.profile).orderBy("individual", "type"))
        elif a.command == "check-instance":
            found = reason.check_instance(ws.catalog, a.iri, a.class_iri, a.profile)
            print(str(found).lower())
            return int(not found)
        elif a.command == "dl-query":
            for part, frame in ws.dl_query(a.text, profile=a.profile).items():
                for r in frame.orderBy(frame.columns[0]).toLocalIterator():
                    print(f"{part}\t{r[0]}")
        elif a.command == "usages":
            _show(ws.usages(a.iri))
        elif a.command == "search":
            _show(ws.search(a.text), ["iri", "short_name", "kind"])
        elif a.command == "diff":
            found = ws.diff(Workspace.open(spark, a.head).catalog)
            print(diff.to_markdown(found) if a.format == "markdown" else diff.to_text(found), end="")
            return int(not found.breaking.isEmpty())
        else:
            print(ws.export_docs(a.folder, "html" if a.format == "html" else "markdown"))
    except LatticaError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
