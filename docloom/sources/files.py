"""Scans: raw Markdown, layout JSON, PDF listings, vocabularies, JDBC."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence
from urllib.parse import parse_qsl, unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """``path``, ``size``, ``modified`` of the files below ``root``; contents are not read."""
    r = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return r.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def read_texts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """``path``, ``text``: whole UTF-8 files below ``root``, without a byte-order mark."""
    r = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").text(root, wholetext=True)
    return r.select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^﻿", "").alias("text"))


def read_markdown(spark: SparkSession, root: str) -> DataFrame:
    return read_texts(spark, root, "*_layout.md").withColumnRenamed("text", "md")


def read_layouts(spark: SparkSession, root: str) -> DataFrame:
    """``stem`` and ``json``; join by stem to Markdown files, left: a missing layout means no laws."""
    return read_texts(spark, root, "*_layout.json").select(stem("path").alias("stem"), F.col("text").alias("json"))


def stem(path):
    return F.regexp_replace(F.col(path) if isinstance(path, str) else path, r"_layout\.(md|json)$", "")


def read_vocabulary(path: str) -> dict[str, list[str]]:
    """Labels and synonyms from a YAML file of two or three levels; {} if the file is missing.

    Reads the plain subset such files use (nested keys and dashed lists), so no YAML package is needed.
    """
    if not os.path.exists(path):
        return {}
    out: dict[str, list[str]] = {}
    stack: list[tuple[int, str]] = []
    with open(path, encoding="utf-8-sig") as f:
        for raw in f:
            line = raw.split(" #")[0].rstrip()
            body = line.strip()
            if not body or body.startswith("#"):
                continue
            depth = len(line) - len(line.lstrip())
            if body.startswith("- "):
                owner = next((k for d, k in reversed(stack) if k not in ("synonyms", "subs", "keywords")), None)
                if owner is not None:
                    out.setdefault(owner, []).append(body[2:].strip().strip("\"'"))
                continue
            while stack and stack[-1][0] >= depth:
                stack.pop()
            key, _, rest = body.partition(":")
            key = key.strip().strip("\"'")
            stack.append((depth, key))
            if len(stack) > 1 and key not in ("synonyms", "subs", "keywords"):
                out.setdefault(key, [])
            if rest.strip().startswith("["):
                owner = next((k for _, k in reversed(stack) if k not in ("synonyms", "subs", "keywords")), key)
                out.setdefault(owner, []).extend(x.strip().strip("\"'") for x in rest.strip()[1:-1].split(",") if x.strip())
    return out


def parse_dsn(dsn: str) -> dict[str, object]:
    """Parts of a ``postgresql://`` address, percent-decoded, with the usual defaults."""
    u = urlsplit(dsn)
    if u.scheme not in ("postgres", "postgresql"):
        raise ValueError(f"not a PostgreSQL address: {u.scheme}")
    out: dict[str, object] = {"host": u.hostname or "localhost", "port": u.port or 5432, "dbname": unquote(u.path.lstrip("/")) or "postgres"}
    if u.username:
        out["user"] = unquote(u.username)
    if u.password:
        out["password"] = unquote(u.password)
    return out | dict(parse_qsl(u.query))


def dsn_columns(c):
    """Struct (scheme, host, port, path) of an address column, with the same defaults; null where it is no address."""
    c = F.col(c) if isinstance(c, str) else c
    part = lambda p: F.try_parse_url(c, F.lit(p))
    port = F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1).try_cast("int")
    return F.struct(part("PROTOCOL").alias("scheme"), F.coalesce(part("HOST"), F.lit("localhost")).alias("host"), F.coalesce(port, F.lit(5432)).alias("port"), F.regexp_replace(part("PATH"), "^/", "").alias("path"))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 32, **options: str) -> DataFrame:
    """A JDBC table, in parallel over ranges of a numeric key if bounds are given."""
    r = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if key and bounds:
        r = r.options(partitionColumn=key, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return r.load()


def by_id(df: DataFrame, ids: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The named columns of the rows with given ids, null for ids that are not there; ids keep their order-free multiplicity."""
    found = df.select(key, *columns).join(ids.select(key).distinct(), key, "left_semi").dropDuplicates([key])
    return ids.join(found, key, "left")


def table_size(df: DataFrame) -> DataFrame:
    """``rows``, ``files`` and ``bytes`` of a file table."""
    files = df.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s")).groupBy("f").agg(F.first("s").alias("s"), F.count("*").alias("n"))
    return files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("files"), F.coalesce(F.sum("s"), F.lit(0)).alias("bytes"))


class Vectors:
    """A vector table by the address of its store: ``:memory:`` (a temporary view), ``path:...`` (a parquet table) or a ``jdbc:`` address."""

    def __init__(self, spark: SparkSession, address: str, name: str = "vectors", **options: str):
        self.spark, self.address, self.name, self.options = spark, address, name, options
        if not (address == ":memory:" or address.startswith(("path:", "jdbc:"))):
            raise ValueError(f"no vector store: {address}")

    def read(self) -> DataFrame:
        if self.address == ":memory:":
            return self.spark.table(self.name)
        if self.address.startswith("path:"):
            return self.spark.read.parquet(f"{self.address[5:]}/{self.name}")
        return read_jdbc(self.spark, self.address, self.name, **self.options)

    def write(self, df: DataFrame) -> None:
        """Replace the table; a table at a path may be read by ``df``."""
        from docloom.operators import store

        if self.address == ":memory:":
            df.createOrReplaceTempView(self.name)
        elif self.address.startswith("path:"):
            store.replace(df, f"{self.address[5:]}/{self.name}")
        else:
            df.write.format("jdbc").options(url=self.address, dbtable=self.name, **self.options).mode("overwrite").save()


def setting(env: Mapping[str, str], key: str, default, kind=str):
    """A typed setting from the environment; the default where it is unset or can't be read."""
    raw = env.get(key)
    if raw is None:
        return default
    if kind is bool:
        return raw.strip().lower() in ("1", "true", "yes", "on")
    try:
        return kind(raw)
    except ValueError:
        return default
