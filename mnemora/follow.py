"""A view of a store that stays at one version until it follows others' commits, with derived tables kept up by what changed.

A derived table comes of its source row by row (an index of names, neighbours of nodes), so a changed row takes away
what its earlier state gave and adds what it gives now. A refresh reads the rows written and the keys deleted since, looks their earlier
state up, and writes a delta; where the source was rewritten or folded since, the table is derived anew.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from mnemora import keyed
from mnemora.functions.text import normalize
from mnemora.schemas import TABLES
from mnemora.shared import scratch
from mnemora.store import GraphStore


@dataclass(frozen=True)
class Derived:
    """derive: rows of a store's table to rows of this one, each from one; by: the key columns that lookups go by."""

    source: str
    schema: str
    keys: tuple[str, ...]
    by: tuple[str, ...]
    derive: Callable[[DataFrame], DataFrame]


def _names(nodes: DataFrame) -> DataFrame:
    every = F.concat(F.array(F.struct(F.col("label").alias("t"), F.lit(0).alias("tier"))), F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.struct(a.alias("t"), F.lit(1).alias("tier"))))
    return nodes.select("id", F.explode(every).alias("x")).select(normalize(F.col("x.t")).alias("name"), "id", F.col("x.tier").alias("tier")).filter("name is not null").distinct()


def _neighbors(edges: DataFrame) -> DataFrame:
    end = lambda a, b: edges.select(F.col(a).alias("node"), F.col(b).alias("neighbor"), F.col("id").alias("edge"), "type", "weight")
    return end("source", "target").unionByName(end("target", "source").filter("node <> neighbor"))


NAMES = Derived("nodes", "name string, id string, tier int", ("name", "id", "tier"), ("name",), _names)
NEIGHBORS = Derived("edges", "node string, neighbor string, edge string, type string, weight double", ("node", "edge", "neighbor"), ("node",), _neighbors)


@dataclass
class View:
    """A store as of one version; ``refresh`` goes to the last one. folder: where derived tables lie (by default the shared folder)."""

    store: GraphStore
    derived: dict[str, Derived] = field(default_factory=lambda: {"names": NAMES, "neighbors": NEIGHBORS})
    folder: str | None = None

    def __post_init__(self) -> None:
        self.folder = self.folder or scratch(self.store.spark, "view")
        self.version = self.store.version()
        self.states = {name: self._table(name).replaced(d.derive(self.table(d.source))) for name, d in self.derived.items()}

    def _table(self, name: str) -> keyed.KeyedTable:
        d = self.derived[name]
        return keyed.KeyedTable(self.store.spark, f"{self.folder}/{uuid.uuid4().hex[:8]}", name, StructType.fromDDL(d.schema), d.keys, by=d.by)

    def table(self, name: str) -> DataFrame:
        """A table of the store as of the view's version, or a derived one."""
        if name in self.derived:
            return self._table(name).rows(self.states[name])
        return self.store._keyed(name).rows(self.store._state(name, self.version))

    def lookup(self, name: str, keys: DataFrame) -> DataFrame:
        if name in self.derived:
            return self._table(name).lookup(self.states[name], keys)
        return self.store._keyed(name).lookup(self.store._state(name, self.version), keys)

    def stale(self) -> bool:
        """Whether another commit came since."""
        return self.store.version()["n"] != self.version["n"]

    def refresh(self) -> dict[str, str]:
        """Follows to the last version; for each derived table ``same``, ``delta`` or ``anew``."""
        last, done = self.store.version(), {}
        for name, d in self.derived.items():
            then, now = self.store._state(d.source, self.version), self.store._state(d.source, last)
            old, new = [r["path"] for r in then["deltas"]], [r["path"] for r in now["deltas"]]
            source, own = self.store._keyed(d.source), self._table(name)
            if then == now:
                done[name] = "same"
            elif then["base"] == now["base"] and new[: len(old)] == old:
                rows, gone = source.changes(now["deltas"][len(old) :])
                keys = list(TABLES[d.source][1])
                before = d.derive(source.lookup(then, rows.select(*keys).unionByName(gone.select(*keys))))
                self.states[name] = own.compacted(own.changed(self.states[name], d.derive(rows), before.select(*d.keys)))
                done[name] = "delta"
            else:
                self.states[name] = own.replaced(d.derive(source.rows(now)))
                done[name] = "anew"
        self.version = last
        return done

    def ids_of(self, names: DataFrame) -> DataFrame:
        """(name, id) of names (name): by label before alias, the least id of several; read from the files that hold them."""
        asked = names.select(normalize(F.col("name")).alias("name")).distinct()
        best = self.lookup("names", asked).groupBy("name").agg(F.min(F.struct("tier", "id")).alias("b"))
        return best.select("name", "b.id")
