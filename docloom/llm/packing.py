"""Filling containers of fixed capacity: hierarchical best fit over residual bins.

Every task best-fits the items it holds, largest first, and emits the bins that are full to at least
``full``. The underfull bins go on as items (their content stays together), are dealt anew to a quarter as
many tasks and best-fitted again, and so on up the tree. The last rounds hold at most ``group`` underfull
bins in a task: the number of tasks of a round follows from the number of bins left, so no task grows with
the corpus. The tree ends when a round no longer saves a thousandth of its bins. What comes out depends on the items
alone, not on cores or partitions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.bpe import DEFAULT_RANKS, count_column
from docloom.runtime import materialize

CAPACITY = 4096


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item; items are taken in the given order, each into the fullest bin with room."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = 0  # bit r is set if a bin has r left
    out, bins = [], 0
    for s in sizes:
        fit = some >> s
        if fit:
            left = s + (fit & -fit).bit_length() - 1
            b = stacks[left].pop()
            if not stacks[left]:
                some &= ~(1 << left)
        else:
            left, b = capacity, bins
            bins += 1
        left -= s
        stacks[left].append(b)
        some |= 1 << left
        out.append(b)
    return out


def _round(capacity: int, full: float, name: str):
    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        if not got:
            return
        f = pd.concat(got, ignore_index=True).sort_values(["size", "item"], ascending=[False, True], kind="stable", ignore_index=True)
        bins = np.array(best_fit(f["size"].tolist(), capacity))
        fill = np.bincount(bins, weights=f["size"]).astype(np.int64)
        # a bin is named after its first item, which is the same whenever the task runs again
        first = np.full(len(fill), len(f))
        np.minimum.at(first, bins, np.arange(len(f)))
        label = (name + ":" + f["item"]).to_numpy()[first]
        yield pd.DataFrame({"item": f["item"], "bin": label[bins], "fill": fill[bins], "done": fill[bins] >= full * capacity})

    return run


def pack(items: DataFrame, item: str = "item", size: str = "size", capacity: int = CAPACITY, full: float = 0.99, group: int = 100_000, fan_in: int = 4, leaf: int = 4000, gain: float = 0.001) -> DataFrame:
    """Pack unsplittable items into bins of ``capacity``.

    Returns ``item`` (string), ``size``, ``bin`` (string) and ``fill`` (sum of the bin's sizes), one row for each row
    with a size above zero; null and non-positive sizes and null items stay out. Equal sizes are taken in
    order of the item, and items are expected to be unique. Sizes above the capacity must have been split
    (:func:`pack_documents` does so). The first round has a task for ``leaf`` items, up to 64 tasks, and at most ``group`` items in
    each; rounds go on until one saves less than the share ``gain`` of its bins.
    """
    base = materialize(items.select(F.col(item).cast("string").alias("item"), F.col(size).cast("long").alias("size")).where("size > 0 and item is not null"), "pack-items")
    schema = "item string, bin string, fill long, done boolean"
    n = base.count()
    if not n:
        return base.select("item", "size", F.lit("").alias("bin"), F.lit(0).cast("long").alias("fill"))
    tasks = max(-(-n // group), min(64, -(-n // leaf)))
    closed: list[DataFrame] = []
    waiting, where = base, None  # underfull bins as items; the bin that each item without a closed bin is in
    r = 0
    while True:
        fitted = materialize(waiting.repartition(tasks, F.xxhash64("item")).mapInPandas(_round(capacity, full, str(r)), schema), f"pack-{r}")
        if where is None:
            placed = fitted
        else:
            to = fitted.select(F.col("item").alias("old"), F.col("bin").alias("new"), "fill", "done")
            placed = materialize(where.join(to, F.col("bin") == F.col("old")).select("item", F.col("new").alias("bin"), "fill", "done"), f"pack-at-{r}")
        bins = fitted.where("not done").groupBy("bin").agg(F.first("fill").alias("size"))
        m = bins.count()
        least = max(1, -(-m // group))
        if m <= 1 or (tasks <= least and (r == 0 or m > (1 - gain) * n)):
            closed.append(placed)
            break
        closed.append(placed.where("done"))
        where, waiting = placed.where("not done").select("item", "bin"), bins.select(F.col("bin").alias("item"), "size")
        n, tasks, r = m, max(least, tasks // fan_in), r + 1
    out = closed[0]
    for c in closed[1:]:
        out = out.unionByName(c)
    return base.join(out.select("item", "bin", "fill"), "item")


def pack_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, ranks: str = DEFAULT_RANKS, full: float = 0.99, group: int = 100_000) -> DataFrame:
    """Containers of ``capacity`` tokens for the texts of ``documents``.

    Returns ``key``, ``piece_no`` (from 1), ``start_token``, ``n_tokens``, ``container`` (string) and ``container_tokens``. A text is
    split only if it alone exceeds the capacity: then into full pieces, each a container of its own, and a
    last piece that is packed like any text. Texts without a token (null, empty) stay out, so an empty
    table gives no rows. Keys must be unique and not null.
    """
    counted = materialize(count_column(documents, key, text, ranks).where(f"n_tokens > 0 and `{key}` is not null"), "token-counts")
    c = F.lit(capacity).cast("long")
    whole = F.floor(F.col("n_tokens") / c).cast("long")
    full_pieces = (
        counted.where(F.col("n_tokens") >= c)
        .select(F.col(key), F.explode(F.sequence(F.lit(1).cast("long"), whole)).alias("p"))
        .select(
            key,
            F.col("p").cast("int").alias("piece_no"),
            ((F.col("p") - 1) * c).alias("start_token"),
            c.alias("n_tokens"),
            F.concat(F.lit("w:"), F.col(key).cast("string"), F.lit("#"), F.col("p").cast("string")).alias("container"),
            c.alias("container_tokens"),
        )
    )
    rest = counted.where(F.col("n_tokens") % c > 0)
    packed = pack(rest.select(F.col(key).alias("item"), (F.col("n_tokens") % c).alias("size")), "item", "size", capacity, full, group)
    packed = (
        packed.join(rest.select(F.col(key), F.col("n_tokens").alias("total")), F.col("item") == F.col(key).cast("string"))
        .select(
            key,
            (F.floor(F.col("total") / c) + 1).cast("int").alias("piece_no"),
            (F.col("total") - F.col("size")).alias("start_token"),
            F.col("size").alias("n_tokens"),
            F.col("bin").alias("container"),
            F.col("fill").alias("container_tokens"),
        )
    )
    return full_pieces.unionByName(packed)
