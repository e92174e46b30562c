"""Row numbers, running sums and forward fills within keys of any size.

A window over a key puts all its rows into one task. Here the rows are range-partitioned by key and order, so a
hot key spreads over many tasks; what each part passes on to the next (its count, sum or last value) is a few
rows, and is added to the windows inside the parts. The result equals that of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.runtime import materialize


def _parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_part``: parts of a key's rows that follow each other in order; written out, as parts are drawn by sampling."""
    spread = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (*keys, *order)])
    return materialize(spread.withColumn("_part", F.spark_partition_id()), "ordered")


def _before(parts: DataFrame, keys: Sequence[str], aggregate: Column, prefix) -> DataFrame:
    """Per key and part what all earlier parts of the key pass on."""
    per = parts.groupBy(*keys, "_part").agg(aggregate.alias("_own"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return per.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_part").alias("__part"), prefix(F.col("_own"), w).alias("_carry"))


def _with_carry(parts: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    on = F.col("_part") == F.col("__part")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return parts.join(carry, on, "left").drop("__part", *[f"_{k}" for k in keys])


def _inside(keys: Sequence[str], order: Sequence[str]):
    return Window.partitionBy(*keys, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order])


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "n") -> DataFrame:
    """``df`` with the row's number within its key (long, from 1). ``order`` should be total; nulls come first; null is a key."""
    p = _parts(df, keys, order)
    carry = _before(p, keys, F.count("*"), lambda own, w: F.coalesce(F.sum(own).over(w), F.lit(0)))
    got = _with_carry(p, carry, keys)
    return got.withColumn(name, F.row_number().over(_inside(keys, order)).cast("long") + F.coalesce("_carry", F.lit(0))).drop("_part", "_carry")


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "total") -> DataFrame:
    """``df`` with the sum of ``value`` over the key's rows up to and including this one; nulls count 0."""
    p = _parts(df, keys, order)
    carry = _before(p, keys, F.coalesce(F.sum(value), F.lit(0)), lambda own, w: F.coalesce(F.sum(own).over(w), F.lit(0)))
    inside = F.sum(F.coalesce(value, F.lit(0))).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return _with_carry(p, carry, keys).withColumn(name, inside + F.coalesce("_carry", F.lit(0))).drop("_part", "_carry")


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """``df`` with the key's last value of ``value`` that isn't null, this row's included."""
    p = _parts(df, keys, order)
    last = F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*order)))
    carry = _before(p, keys, last, lambda own, w: F.last(own, True).over(w))
    inside = F.last(value, True).over(_inside(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    return _with_carry(p, carry, keys).withColumn(name, F.coalesce(inside, "_carry")).drop("_part", "_carry")
