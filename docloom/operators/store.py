"""Sinks over parquet tables: keyed upsert, create, back up, evolve, clear."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row for each key (null is a key like any other): the first in ``order``."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", r).where("_r = 1").drop("_r")


def merge(target: DataFrame, batch: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Target rows whose key is not in the batch, and the batch, of which the first row a key counts.

    Columns that only one side has are null in the other's rows.
    """
    came = batch.select(*[F.col(k).alias(f"_{k}") for k in keys])  # repeats do no harm to an anti-join
    kept = target.join(came, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_anti")
    return kept.unionByName(first_wins(batch, keys, order), allowMissingColumns=True)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def replace(df: DataFrame, path: str) -> None:
    """Write ``df`` beside ``path``, then swap: readers see the old or the new table, and ``df`` may read the old one."""
    spark = df.sparkSession
    staged, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    fs, p = _fs(spark, path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    if fs.exists(p):
        fs.rename(p, hadoop(old))
    fs.rename(hadoop(staged), p)
    fs.delete(hadoop(old), True)


def upsert(batch: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column | str]) -> None:
    """Upsert a batch into a parquet table; an empty batch changes nothing."""
    spark = batch.sparkSession
    if batch.isEmpty():
        return
    if exists(spark, path):
        replace(merge(spark.read.parquet(path), batch, keys, order), path)
    else:
        replace(first_wins(batch, keys, order), path)


def create_if_absent(spark: SparkSession, path: str, schema: str) -> None:
    if not exists(spark, path):
        spark.createDataFrame([], schema).coalesce(1).write.parquet(path)


def recreate(spark: SparkSession, path: str, schema: str) -> None:
    """Delete the table if it is there, and make it anew, empty."""
    replace(spark.createDataFrame([], schema).coalesce(1), path)


def ensure_collection(spark: SparkSession, path: str, dim: int, metric: str = "cosine", index_from: int = 20_000) -> dict:
    """The vector table under ``path``, made if it isn't there, and its settings, which stay as they were made.

    ``index_from`` is the number of rows from which a search should go through an index; a table of another dimension is an error.
    """
    if not exists(spark, f"{path}/settings"):
        create_if_absent(spark, f"{path}/points", "id string, point_id string, vector array<float>, payload string")
        spark.createDataFrame([(dim, metric, index_from)], "dim int, metric string, index_from int").coalesce(1).write.parquet(f"{path}/settings")
    r = spark.read.parquet(f"{path}/settings").first()
    if r.dim != dim:
        raise ValueError(f"{path} holds vectors of {r.dim} elements, not {dim}")
    return r.asDict()


def back_up(spark: SparkSession, path: str, to: str) -> None:
    spark.read.parquet(path).write.mode("overwrite").parquet(to)


def evolve(df: DataFrame, add: dict[str, str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Columns added as nulls where they are missing, and dropped where they are there."""
    new = {c: F.lit(None).cast(t) for c, t in (add or {}).items() if c not in df.columns}
    return df.drop(*drop).withColumns(new) if new else df.drop(*drop)


def clear(spark: SparkSession, paths: Sequence[str]) -> None:
    """Empty the tables in the given order (children first); schemas stay."""
    for p in paths:
        if exists(spark, p):
            schema = spark.read.parquet(p).schema
            replace(spark.createDataFrame([], schema).coalesce(1), p)


def to_layout_json(items: DataFrame) -> DataFrame:
    """``doc_id``, ``json``: each document's items as one object of pages, the items of a page in reading order (y0, x0)."""
    cols = [c for c in items.columns if c not in ("doc_id", "page", "y0", "x0")]
    pages = items.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("y0", "x0", *cols))).alias("l"))
    pages = pages.select("doc_id", "page", F.transform("l", lambda x: F.struct(*[x[c].alias(c) for c in cols])).alias("l"))
    return pages.groupBy("doc_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.format_string("page_%d", "page").alias("k"), F.col("l").alias("v")))))).alias("json"))


def payload(*columns: str) -> Column:
    """The columns as JSON without those that are null."""
    return F.to_json(F.struct(*columns))
