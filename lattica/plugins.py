"""Plugins: named functions over a catalog, ordered by what they need; one that fails gives an error row."""

from __future__ import annotations

import graphlib
import json
import subprocess
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from lattica.catalog import Catalog
from lattica.model import SCHEMAS, LatticaError

KINDS = ("validator", "exporter", "workflow", "reasoner", "query", "refactor", "graph")


@dataclass(frozen=True)
class Plugin:
    id: str
    kind: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ()
    capabilities: frozenset[str] = frozenset()


@dataclass
class Registry:
    plugins: dict[str, Plugin] = field(default_factory=dict)
    allowed: frozenset[str] = frozenset({"read"})

    def register(self, plugin: Plugin) -> None:
        if plugin.kind not in KINDS:
            raise LatticaError(f"unknown plugin kind: {plugin.kind}")
        if plugin.id in self.plugins:
            raise LatticaError(f"plugin {plugin.id} is registered already")
        if not plugin.capabilities <= self.allowed:
            raise LatticaError(f"plugin {plugin.id} needs {', '.join(sorted(plugin.capabilities - self.allowed))}")
        self.plugins[plugin.id] = plugin

    def order(self) -> list[str]:
        missing = {n for p in self.plugins.values() for n in p.needs} - set(self.plugins)
        if missing:
            raise LatticaError(f"missing plugins: {', '.join(sorted(missing))}")
        try:
            return list(graphlib.TopologicalSorter({k: self.plugins[k].needs for k in sorted(self.plugins)}).static_order())
        except graphlib.CycleError as e:
            raise LatticaError(f"plugins need each other: {' -> '.join(e.args[1])}") from e

    def run(self, plugin_id: str, catalog: Catalog, *args) -> DataFrame:
        if plugin_id not in self.plugins:
            raise LatticaError(f"unknown plugin: {plugin_id}")
        return self.plugins[plugin_id].run(catalog, *args)

    def validate(self, catalog: Catalog) -> DataFrame:
        """Diagnostics of all validators, in order."""
        out = catalog.spark.createDataFrame([], SCHEMAS["diagnostics"])
        for name in self.order():
            if self.plugins[name].kind == "validator":
                try:
                    out = out.unionByName(self.plugins[name].run(catalog), allowMissingColumns=True)
                except Exception as e:
                    out = out.union(catalog.spark.createDataFrame([("plugin_failed", "error", f"{name}: {e}", "", None, None, None, None)], SCHEMAS["diagnostics"]))
        return out


def command(plugin_id: str, argv: list[str], timeout: int = 60, most: int = 1 << 20) -> Plugin:
    """A validator in a process of its own: JSON rows of diagnostics on its output, with limits of time and size."""

    def run(catalog: Catalog) -> DataFrame:
        done = subprocess.run(argv, capture_output=True, timeout=timeout, check=True)
        if len(done.stdout) > most:
            raise LatticaError("output is too long")
        names = [f.split()[0] for f in SCHEMAS["diagnostics"].split(", ")]
        return catalog.spark.createDataFrame([tuple(r.get(n) for n in names) for r in json.loads(done.stdout)], SCHEMAS["diagnostics"])

    return Plugin(plugin_id, "validator", run)
