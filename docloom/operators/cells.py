"""An approximate vector index: rows clustered by the cell of their nearest centre, of which a search reads the nearest few.

The centres are fitted on a bounded sample; every usable row is in the index. A search scores what it reads exactly, with any filter,
so only a neighbour in a cell that isn't read can be missed: ``probe`` trades reading for recall, and with all cells it is exact.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import retrieve, store

#: Rows the centres are fitted on, and the most centres there are: bounds of what the driver holds and sends.
SAMPLE, MOST = 20_000, 4096


@dataclass(frozen=True)
class Cells:
    """A written index: its folder and its centres, of unit length."""

    path: str
    centres: np.ndarray


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def fit(vectors: np.ndarray, cells: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Spherical k-means; fixed seed. Fewer vectors than cells give a centre for each."""
    x = _unit(np.asarray(vectors, np.float64))
    if len(x) <= cells:
        return x.astype(np.float32)
    c = x[np.random.default_rng(seed).choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        at = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        some = np.bincount(at, minlength=cells) > 0
        c[some] = _unit(sums[some])
    return c.astype(np.float32)


def usable(df: DataFrame, key: str, vector: str, dim: int, at: str | None = None) -> DataFrame:
    """Rows with a key and a vector of ``dim`` finite elements that aren't all zero; of several with a key that with the greatest ``at``."""
    df = df.where(F.col(key).isNotNull())
    if at:
        df = store.first_wins(df, [key], [F.desc(at)])
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where((F.size(vector) == dim) & ~bad & F.exists(vector, lambda x: x != 0))


def write(df: DataFrame, path: str, vector: str = "vector", cells: int | None = None, key: str = "id") -> Cells:
    """Index the rows of :func:`usable` under ``path``, with all their columns. The number of cells is the root of that of the rows, at most ``MOST``."""
    n = df.count()
    cells = min(MOST, cells or max(1, round(n**0.5)))
    drawn = df.select(vector) if n <= SAMPLE else df.where(F.pmod(F.xxhash64(key), F.lit(1_000_003)) < F.lit(int(1_000_003 * SAMPLE / n))).select(vector)
    rows = drawn.toPandas()[vector].tolist() if n else []  # about SAMPLE rows at most
    centres = fit(np.array(rows, np.float64), cells) if rows else np.zeros((1, 1), np.float32)
    shared = df.sparkSession.sparkContext.broadcast(centres)  # at most MOST rows
    place, names = df.columns.index(vector), [*df.columns, "cell"]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(place).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, shared.value.shape[1]))
            at = (x.astype(np.float32) @ shared.value.T).argmax(1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", cell int"
    out = df.mapInArrow(assign, schema)
    # cells come together in files, and large ones are split over several
    out.hint("rebalance", "cell").sortWithinPartitions("cell").write.mode("overwrite").option("parquet.block.size", str(8 << 20)).parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<float>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
    return Cells(path, centres)


def load(spark: SparkSession, path: str) -> Cells:
    c = spark.read.parquet(f"{path}/centres").orderBy("cell").collect()  # at most MOST rows
    return Cells(path, np.array([r.centre for r in c], np.float32))


def search(spark: SparkSession, index: Cells, query: Sequence[float], k: int, key: str, vector: str = "vector", probe: int = 8, least: float | None = None, where: Column | None = None) -> DataFrame:
    """``id``, ``score``: the ``k`` most similar rows of the ``probe`` cells nearest to the query that pass ``where``."""
    q = np.asarray(query, np.float32)
    near = np.argsort(-(index.centres @ q), kind="stable")[:probe].tolist() if len(q) == index.centres.shape[1] else []
    rows = spark.read.parquet(f"{index.path}/rows").where(F.col("cell").isin(near))
    return retrieve.vector_top(rows if where is None else rows.where(where), query, k, key, vector, least)
