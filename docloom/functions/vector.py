"""Vector functions over ``array<float>``, computed in double."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def doubles(v: Column | str) -> Column:
    return _c(v).cast("array<double>")


def literal(v: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in v])


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; null if the lengths differ or an element is null."""
    a, b = doubles(a), doubles(b)
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column | str, floor: float = 1e-12) -> Column:
    n = norm(v) + F.lit(floor)
    return F.transform(doubles(v), lambda x: x / n)


def scorer(query: Sequence[float], k: int | None = None, least: float | None = None):
    """Arrow batches (id, at, v) to (id, at, score): the cosine of each vector to ``query``, null for unusable ones.

    With ``k`` only each batch's rows of at least ``least`` that may be among the k best go on, the unusable ones not.
    """
    q = np.asarray(query, float)
    q = q / (np.sqrt(q @ q) or np.nan)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = np.full(b.num_rows, np.nan)
            v = b.column(2)
            at = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                x = v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), len(q))
                with np.errstate(all="ignore"):
                    score[at] = (x @ q) / np.sqrt((x * x).sum(1))
            score[~np.isfinite(score)] = np.nan
            keep = np.arange(b.num_rows)
            if k is not None:
                keep = np.flatnonzero(score >= (-2.0 if least is None else least))
                if len(keep) > k:
                    keep = keep[score[keep] >= np.partition(score[keep], len(keep) - k)[len(keep) - k]]  # ties all stay
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array(score[keep], from_pandas=True)], names=["id", "at", "score"])

    return run


def cosine(a: Column | str, b: Column | str) -> Column:
    """Null for a vector without length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)
