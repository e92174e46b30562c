"""References to records that do not exist: incrementally kept pending-orphan state.

The state has three tables in a folder, each clustered by buckets, a hash of its key: an index of parents by their key, the
references by their own key (what they point to now), and the references by the key they point to, with their present kind. A
batch of arrivals reads the row groups of the buckets it touches and appends only rows that change: new references probe the parent index;
references whose parent arrived, was deleted or was restored are judged anew, and written if their kind is another one. So a batch
costs what it touches, not what the state holds. The newest row of a key counts; after ``MOST`` batches what was appended is
merged. The outcome doesn't depend on how the rows were dealt to batches. Counts can be taken after any batch.

Kinds: ``missing`` if the parent has no record, else ``deleted`` if its latest copy has a deletion time, else ``late`` if its
first time is after the first time of the referring record; null if the reference is sound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.runtime import materialize, work_folder


#: Columns of arrivals.
REFS, PARENTS = "tbl string, row_key string, parent string, ref string, time timestamp", "parent string, ref string, time timestamp, gone boolean"


def key_form(c: Column | str) -> Column:
    """A reference key as it is compared: without surrounding blanks, tabs and line breaks, in lower case; blank gives null."""
    bare = F.lower(F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"^[ \t\r\n]+|[ \t\r\n]+$", ""))
    return F.when(bare != "", bare)


def references(df: DataFrame, tbl: str, key: str, ref: str, parent: str, at: str) -> DataFrame:
    """Arrivals of references: tbl, row_key, parent, ref, time. Null keys stay out; null references are kept out of the state later."""
    return df.select(F.lit(tbl).alias("tbl"), F.col(key).cast("string").alias("row_key"), F.lit(parent).alias("parent"), key_form(F.col(ref).cast("string")).alias("ref"), F.col(at).cast("timestamp").alias("time")).where("row_key is not null")


def parents(df: DataFrame, parent: str, key: str, at: str, deleted: str | None) -> DataFrame:
    """Arrivals of parents: parent, ref (their key as compared), time, gone."""
    gone = F.col(deleted).isNotNull() if deleted else F.lit(False)
    return df.select(F.lit(parent).alias("parent"), key_form(F.col(key).cast("string")).alias("ref"), F.col(at).cast("timestamp").alias("time"), gone.alias("gone")).where("ref is not null")


#: Columns, key and bucket columns of the tables of the state.
TABLES = {
    "parents": ("parent string, ref string, first timestamp, last timestamp, gone boolean", ["parent", "ref"], ["parent", "ref"]),
    "keys": ("tbl string, row_key string, parent string, ref string, first timestamp, last timestamp, old_parent string, old_ref string", ["tbl", "row_key"], ["tbl", "row_key"]),
    "refs": ("tbl string, row_key string, parent string, ref string, first timestamp, kind string, there boolean", ["tbl", "row_key", "parent", "ref"], ["parent", "ref"]),
}
BUCKETS = 4096
#: Bytes of a row group, the least that is read of a table.
GROUP = 4 << 20
#: Appended parts of a table before they are merged.
MOST = 16


def _bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class State:
    """A version of the state: the appended parts of each table by their numbers. Parts never change once they are written."""

    spark: SparkSession
    path: str
    version: int = -1
    parts: Mapping[str, tuple[int, ...]] = field(default_factory=lambda: dict.fromkeys(TABLES, ()))

    @staticmethod
    def empty(spark: SparkSession, path: str | None = None) -> State:
        """An empty state under ``path``; without one in a folder of its own that goes when the session ends."""
        return State(spark, path or work_folder(spark, "orphans"))

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """The newest row of each key, of the given buckets or all."""
        schema, key, _ = TABLES[name]
        parts = self.parts[name]
        if not parts:
            return self.spark.createDataFrame([], schema)
        df = self.spark.read.schema(f"{schema}, v int, bucket int").parquet(*[self.part(name, v) for v in parts])
        if buckets is not None and len(wanted := sorted(buckets)) < BUCKETS // 2:
            df = df.where(F.col("bucket").isin(wanted))
        cols = [c.split()[0] for c in schema.split(", ")]
        if len(parts) > 1:
            df = df.groupBy(*key).agg(F.max_by(F.struct(*[c for c in cols if c not in key]), "v").alias("s")).select(*key, "s.*")
        return df.select(*cols)

    def part(self, name: str, version: int) -> str:
        return f"{self.path}/{name}/part-{version}"

    def append(self, version: int, **tables: DataFrame) -> State:
        """The state with rows added to some of its tables; a part that was there already is written anew."""
        parts = dict(self.parts)
        for name, df in tables.items():
            cols = [c.split()[0] for c in TABLES[name][0].split(", ")]
            # buckets come together, but large ones are split
            out = df.select(*cols, F.lit(version).alias("v"), _bucket(TABLES[name][2]).alias("bucket")).hint("rebalance", "bucket").sortWithinPartitions("bucket")
            out.write.mode("overwrite").option("parquet.block.size", str(GROUP)).parquet(self.part(name, version))
            parts[name] = (*(v for v in parts[name] if v != version), version)
        return State(self.spark, self.path, version, parts)

    def merged(self) -> State:
        """The same state with each table in one part."""
        whole = {t: self.read(t) for t in TABLES}
        whole["refs"] = whole["refs"].where("there")
        return State(self.spark, self.path, self.version).append(self.version + 1, **whole)


def _judge(refs: DataFrame, index: DataFrame) -> DataFrame:
    """``refs`` with the kind by the parent in ``index``; the parent side is one row a key, so a hot key splits."""
    p = index.select(F.col("parent").alias("p_parent"), F.col("ref").alias("p_ref"), F.col("first").alias("p_first"), "gone")
    on = (F.col("parent") == F.col("p_parent")) & (F.col("ref") == F.col("p_ref"))
    kind = F.when(F.col("p_ref").isNull(), F.lit("missing")).when(F.col("gone"), F.lit("deleted")).when(F.col("p_first") > F.col("first"), F.lit("late"))
    return refs.join(p, on, "left").withColumn("kind", kind).drop("p_parent", "p_ref", "p_first", "gone")


def _buckets(*dfs: tuple[DataFrame, list[str]]) -> list[set[int]]:
    """The buckets that each of the tables touches: at most ``BUCKETS`` numbers each, however many rows there are."""
    out: list[set[int]] = [set() for _ in dfs]
    each = [df.select(F.lit(i).alias("i"), _bucket(key).alias("b")) for i, (df, key) in enumerate(dfs)]
    for r in reduce(lambda a, b: a.unionByName(b), each).groupBy("i").agg(F.collect_set("b").alias("b")).collect():
        out[r.i].update(r.b)
    return out


def advance(state: State, new_refs: DataFrame, new_parents: DataFrame, version: int | None = None) -> State:
    """The state after a batch of arrivals."""
    if any(len(p) >= MOST for p in state.parts.values()):
        state = state.merged()
    version = max(state.version + 1, version or 0)
    came = new_parents.groupBy("parent", "ref").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.max(F.struct("time", "gone")).alias("s")).select("parent", "ref", "first", "last", F.col("s.gone").alias("gone"))
    fresh = new_refs.groupBy("tbl", "row_key").agg(F.min("time").alias("first"), F.max("time").alias("last"), F.max(F.struct("time", "parent", "ref")).alias("s")).select("tbl", "row_key", F.col("s.parent").alias("parent"), F.col("s.ref").alias("ref"), "first", "last")
    first_batch = not any(state.parts.values())  # nothing to merge with
    if not first_batch:  # read several times below
        came, fresh = materialize(came, "came-parents"), materialize(fresh, "came-references")
        in_parents, in_keys = _buckets((came, ["parent", "ref"]), (fresh, ["tbl", "row_key"]))

    index = came.withColumn("new", F.lit(1))
    if not first_batch:
        index = index.unionByName(state.read("parents", in_parents).join(came.select("parent", "ref"), ["parent", "ref"], "left_semi").withColumn("new", F.lit(0)))
        index = index.groupBy("parent", "ref").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max(F.struct("last", "new", "gone")).alias("s")).select("parent", "ref", "first", "last", F.col("s.gone").alias("gone"))

    moved = fresh.withColumns({"old_parent": F.lit(None).cast("string"), "old_ref": F.lit(None).cast("string")})
    if not first_batch:
        old = state.read("keys", in_keys).select("tbl", "row_key", *[F.col(c).alias(f"o_{c}") for c in ("parent", "ref", "first", "last")])
        stays = F.col("o_last").isNotNull() & (F.col("last").isNull() | (F.col("o_last") > F.col("last")))  # a later copy is known
        now = lambda c: F.when(stays, F.col(f"o_{c}")).otherwise(F.col(c)).alias(c)
        moved = fresh.join(old, ["tbl", "row_key"], "left").select("tbl", "row_key", now("parent"), now("ref"), F.least("first", "o_first").alias("first"), F.greatest("last", "o_last").alias("last"), F.col("o_parent").alias("old_parent"), F.col("o_ref").alias("old_ref"))
    state = state.append(version, parents=index, keys=moved)

    mine = state.spark.read.schema(TABLES["keys"][0]).parquet(state.part("keys", version))
    pointing = mine.where("ref is not null")
    to = None if first_batch else _buckets((pointing, ["parent", "ref"]))[0]
    out = _judge(pointing.select("tbl", "row_key", "parent", "ref", "first"), state.read("parents", to)).withColumn("there", F.lit(True))
    if not first_batch:
        left = mine.where("old_ref is not null and not (old_parent <=> parent and old_ref <=> ref)")
        left = left.select("tbl", "row_key", F.col("old_parent").alias("parent"), F.col("old_ref").alias("ref"), "first", F.lit(None).cast("string").alias("kind"), F.lit(False).alias("there"))
        waiting = state.read("refs", in_parents).where("there").join(came.select("parent", "ref"), ["parent", "ref"], "left_semi").join(mine.select("tbl", "row_key"), ["tbl", "row_key"], "left_anti")
        again = _judge(waiting.withColumnRenamed("kind", "was"), state.read("parents", in_parents)).where("not (kind <=> was)").drop("was")
        out = out.unionByName(left).unionByName(again)
    return state.append(version, refs=out)


def orphans(state: State) -> DataFrame:
    """``tbl``, ``row_key``, ``ym``, ``kind`` of the references that lead nowhere."""
    return state.read("refs").where("there and kind is not null").select("tbl", "row_key", F.date_format("first", "yyyy-MM").alias("ym"), "kind")


def counts(state: State) -> DataFrame:
    """``tbl``, ``ym``, ``kind``, ``n``: orphans per table and month."""
    return orphans(state).groupBy("tbl", "ym", "kind").agg(F.count("*").alias("n"))


def states(refs: DataFrame, parent_rows: DataFrame, batches: int = 3) -> Iterator[tuple[int | None, State]]:
    """Take whole tables in as ``batches`` batches, and give the state after each, with the batch's last microsecond.

    The batches part the time from the first to the last arrival of a reference evenly. Rows without a time arrive first; the last
    batch has no end. The tables are read once: arrivals are written out by batch.
    """
    spark = refs.sparkSession
    cuts: list[int] = []
    if batches > 1:
        lo, hi = refs.agg(F.min(F.unix_micros("time")), F.max(F.unix_micros("time"))).first()
        if lo is not None:
            cuts = sorted({lo + (hi - lo) * i // batches for i in range(1, batches)})
    at = F.coalesce(F.unix_micros("time"), F.lit(-(2**62)))
    number = reduce(lambda a, b: a + b, [(at > c).cast("int") for c in cuts], F.lit(0))
    state = State.empty(spark)
    folder = work_folder(spark, "arrivals")
    for name, df in (("refs", refs), ("parents", parent_rows)):
        df.withColumn("batch", number).hint("rebalance", "batch").write.partitionBy("batch").parquet(f"{folder}/{name}")
    came = [spark.read.schema(f"{kind}, batch int").parquet(f"{folder}/{name}") for name, kind in (("refs", REFS), ("parents", PARENTS))]
    for i, hi in enumerate([*cuts, None]):
        state = advance(state, *(df.where(F.col("batch") == i).drop("batch") for df in came))
        yield hi, state


def replay(refs: DataFrame, parent_rows: DataFrame, batches: int = 3) -> State:
    """The state after all batches; see :func:`states`."""
    *_, (_, state) = states(refs, parent_rows, batches)
    return state


def snapshots(refs: DataFrame, parent_rows: DataFrame, batches: int = 3) -> DataFrame:
    """``until`` (null for the last), ``tbl``, ``ym``, ``kind``, ``n``: the counts as they were after each batch."""
    parts = [counts(s).withColumn("until", F.timestamp_micros(F.lit(hi).cast("long"))) for hi, s in states(refs, parent_rows, batches)]
    return reduce(lambda a, b: a.unionByName(b), parts).select("until", "tbl", "ym", "kind", "n")


def report_tables(chunks: DataFrame, law_references: DataFrame, table_rows: DataFrame, findings: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Arrivals of references and of parents in the tables of case reports."""
    refs = (
        references(chunks, "chunks", "chunk_id", "finding_id", "findings", "created_at")
        .unionByName(references(law_references, "law_references", "law_id", "finding_id", "findings", "created_at"))
        .unionByName(references(table_rows, "table_rows", "row_id", "doc_id", "reports", "ingested_at"))
        .unionByName(references(findings, "findings", "finding_id", "doc_id", "reports", "ingested_at"))
    )
    known = parents(findings, "findings", "finding_id", "ingested_at", "deleted_at").unionByName(parents(reports, "reports", "doc_id", "ingested_at", "deleted_at"))
    return refs, known


def report_references(chunks: DataFrame, law_references: DataFrame, table_rows: DataFrame, findings: DataFrame, reports: DataFrame, batches: int = 2) -> State:
    """The state over the tables of case reports; see :func:`states`."""
    return replay(*report_tables(chunks, law_references, table_rows, findings, reports), batches)
