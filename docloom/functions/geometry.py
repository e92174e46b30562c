"""Boxes as ``struct<x0,y0,x1,y1>``: Column functions, and greedy folds as Arrow functions over arrays of boxes."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def box(x0, y0, x1, y1) -> Column:
    return F.struct(*[_c(v).cast("double").alias(n) for v, n in ((x0, "x0"), (y0, "y0"), (x1, "x1"), (y1, "y1"))])


def area(b: Column | str) -> Column:
    b = _c(b)
    zero = F.lit(0.0)
    return F.greatest(zero, b["x1"] - b["x0"]) * F.greatest(zero, b["y1"] - b["y0"])


def intersection(a: Column | str, b: Column | str) -> Column:
    """Shared area; 0 for boxes that only touch."""
    a, b, zero = _c(a), _c(b), F.lit(0.0)
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(zero, w) * F.greatest(zero, h)


def iou(a: Column | str, b: Column | str) -> Column:
    i = intersection(a, b)
    whole = area(a) + area(b) - i
    return F.when(whole > 0, i / whole).otherwise(F.lit(0.0))


def overlap_ratio(part: Column | str, mask: Column | str) -> Column:
    """Share of the first box that the second covers."""
    a = area(part)
    return F.when(a > 0, intersection(part, mask) / a).otherwise(F.lit(0.0))


def contains(outer: Column | str, inner: Column | str, share: float = 0.8) -> Column:
    """Whether at least ``share`` of the inner box is in the outer one; a box without area is in none."""
    a = area(inner)
    return (a > 0) & (intersection(outer, inner) / F.nullif(a, F.lit(0.0)) >= share)


def scaled(b: Column | str, factor: float) -> Column:
    b = _c(b)
    return box(*[b[n] * F.lit(float(factor)) for n in ("x0", "y0", "x1", "y1")])


def union(a: Column | str, b: Column | str) -> Column:
    a, b = _c(a), _c(b)
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def widened(b: Column | str, page_width: Column | str, narrow: float = 200, margin: int = 10, share: float = 0.8) -> Column:
    """A box narrower than ``narrow`` reaches to ``share`` of the page, at most to ``margin`` before its edge."""
    b, w = _c(b), _c(page_width)
    x1 = F.least(w - margin, F.floor(w * F.lit(share))).cast("double")
    return F.when(b["x1"] - b["x0"] < narrow, box(b["x0"], b["y0"], x1, b["y1"])).otherwise(b)


def crop(b: Column | str, scale: float, width: Column | str, height: Column | str) -> Column:
    """Pixel rectangle of a box, clamped to the image; null if nothing is left."""
    b = _c(b)
    x0, y0 = (F.greatest(F.lit(0), F.bround(b[n] * F.lit(float(scale))).cast("int")) for n in ("x0", "y0"))
    x1 = F.least(_c(width).cast("int"), F.bround(b["x1"] * F.lit(float(scale))).cast("int"))
    y1 = F.least(_c(height).cast("int"), F.bround(b["y1"] * F.lit(float(scale))).cast("int"))
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


# ---- greedy folds: the result depends on the order of the boxes, so they run over one page's array

Box = tuple[float, float, float, float]


def _area(b: Box) -> float:
    return max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])


def _shared(a: Box, b: Box) -> float:
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def _iou(a: Box, b: Box) -> float:
    i = _shared(a, b)
    whole = _area(a) + _area(b) - i
    return i / whole if whole > 0 else 0.0


def merge_greedily(boxes: Sequence[Box], above: float) -> list[Box]:
    """From the front, each box either joins the first later one that it overlaps by more than ``above`` or is done."""
    rest, done = list(boxes), []
    while rest:
        head = rest.pop(0)
        partner = next((i for i, b in enumerate(rest) if _iou(head, b) > above), None)
        if partner is None:
            done.append(head)
        else:
            b = rest[partner]
            rest[partner] = (min(head[0], b[0]), min(head[1], b[1]), max(head[2], b[2]), max(head[3], b[3]))
    return done


def _within(outer: Box, inner: Box, share: float) -> bool:
    a = _area(inner)
    return a > 0 and _shared(outer, inner) / a >= share


def drop_contained(boxes: Sequence[Box], share: float = 0.5, small: float = 0.2) -> list[Box]:
    """Largest first, a box is kept unless a kept one contains it, or is far larger and covers more than half of it."""
    kept: list[Box] = []
    for b in sorted(boxes, key=_area, reverse=True):
        if not any(_within(k, b, share) or (_area(b) < small * _area(k) and _shared(k, b) > 0.5 * _area(b)) for k in kept):
            kept.append(b)
    return kept


def settle_containment(first: Sequence[Box], tables: Sequence[Box], share: float = 0.5) -> tuple[list[Box], list[Box]]:
    """Boxes of the first kind inside a table go; tables inside a remaining box of the first kind go with it."""
    left, kept = list(tables), []
    for r in first:
        if any(_within(t, r, share) for t in left):
            continue
        left = [t for t in left if not _within(r, t, share)]
        kept.append(r)
    return kept, left


def _rows(cells) -> list[Box]:
    return [tuple(float(b[n]) for n in ("x0", "y0", "x1", "y1")) for b in cells if b is not None] if cells is not None else []


def _dicts(boxes: Sequence[Box]) -> list[dict]:
    return [dict(zip(("x0", "y0", "x1", "y1"), b)) for b in boxes]


def merge_boxes(above: float):
    """Arrow function: array of boxes to the greedily merged array."""

    @F.pandas_udf(f"array<{BOX}>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda cells: _dicts(merge_greedily(_rows(cells), above)))

    return f


def drop_contained_boxes(share: float = 0.5, small: float = 0.2):
    @F.pandas_udf(f"array<{BOX}>")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda cells: _dicts(drop_contained(_rows(cells), share, small)))

    return f


def settle_boxes(share: float = 0.5):
    """Arrow function of two arrays of boxes: struct (first, tables) after :func:`settle_containment`."""

    @F.pandas_udf(f"struct<first:array<{BOX}>,tables:array<{BOX}>>")
    def f(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        got = [settle_containment(_rows(x), _rows(y), share) for x, y in zip(a, b)]
        return pd.DataFrame({"first": [_dicts(g[0]) for g in got], "tables": [_dicts(g[1]) for g in got]})

    return f
