"""Pending-orphan state as a structured stream: every micro-batch is one batch of arrivals."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators.orphans import TABLES, State, advance, counts
from docloom.runtime import _fs

ARRIVAL = "side string, tbl string, row_key string, parent string, ref string, time timestamp, gone boolean"


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)]


class Store:
    """Versions of the state in a shared folder, each told by a small file that is written last, so a batch that fails is done again.

    A batch appends what it changes; nothing is written twice. Parts that no newest version but one tells of are deleted.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _told(self, n: int) -> str:
        return f"{self.path}/versions/{n}.json"

    def _done(self, n: int) -> bool:
        fs, p = _fs(self.spark, self._told(n))
        return fs.exists(p)

    def load(self, n: int) -> State:
        """The state after batch ``n``; an empty one below 0."""
        if n < 0:
            return State.empty(self.spark, self.path)
        told = json.loads("".join(r.value for r in self.spark.read.text(self._told(n)).collect()))
        return State(self.spark, self.path, told["version"], {t: tuple(p) for t, p in told["parts"].items()})

    def save(self, n: int, state: State) -> None:
        told = {"version": state.version, "parts": state.parts}
        before = self.load(n - 1) if n > 0 and self._done(n - 1) else None
        fs, p = _fs(self.spark, self._told(n) + ".new")
        out = fs.create(p, True)
        out.write(bytearray(json.dumps(told).encode()))
        out.close()
        fs.rename(p, _fs(self.spark, self._told(n))[1])
        for t in TABLES:
            kept = {*state.parts[t], *(before.parts[t] if before else ())}
            for v in [int(x[5:]) for x in _names(self.spark, f"{self.path}/{t}") if x.startswith("part-")]:
                if v not in kept and v <= state.version:
                    fs.delete(_fs(self.spark, state.part(t, v))[1], True)

    def newest(self) -> int:
        fs, p = _fs(self.spark, f"{self.path}/versions")
        if not fs.exists(p):
            return -1
        return max([-1, *(int(n[:-5]) for n in _names(self.spark, f"{self.path}/versions") if n.endswith(".json") and n[:-5].isdigit())])


def follow(arrivals: DataFrame, store: Store, on_counts: Callable[[int, DataFrame], None] | None = None, every: int = 1):
    """A started-by-caller ``writeStream`` that takes in arrivals (columns of ``ARRIVAL``; side is ``ref`` or ``parent``).

    After every ``every``-th batch ``on_counts`` gets the batch number and the orphan counts per table and month.
    """

    def batch(df: DataFrame, n: int) -> None:
        if store._done(n):
            return
        refs = df.where("side = 'ref'").select("tbl", "row_key", "parent", "ref", "time")
        known = df.where("side = 'parent'").select("parent", "ref", "time", F.coalesce("gone", F.lit(False)).alias("gone"))
        state = advance(store.load(store.newest()), refs, known)
        store.save(n, state)
        if on_counts and n % every == 0:
            on_counts(n, counts(state))

    return arrivals.writeStream.foreachBatch(batch)


__all__ = ["ARRIVAL", "Store", "follow"]
