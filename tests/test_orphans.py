"""Orphan references: kinds, keys, batches, deletions and restorations, and the stream."""

import datetime as dt

from pyspark.sql import functions as F

from docloom.operators import orphans
from docloom.streaming import orphans as stream

D = [dt.datetime(2020, m, 1) for m in range(1, 13)]
REFS = "tbl string, row_key string, parent string, ref string, time timestamp"
PARENTS = "parent string, ref string, time timestamp, gone boolean"

REF_ROWS = [
    ("c", "sound", "p", "a", D[3]), ("c", "early", "p", "a", D[0]), ("c", "lost", "p", "zz", D[3]), ("c", "dead", "p", "b", D[5]), ("c", "back", "p", "c", D[5]),
    ("c", "blank", "p", None, D[5]), ("c", "twice", "p", "a", D[4]), ("c", "twice", "p", "a", D[0]), ("d", "sound", "q", "a", D[5]), ("c", "untimed", "p", "a", None),
]
PARENT_ROWS = [("p", "a", D[1], False), ("p", "a", D[8], False), ("p", "b", D[1], False), ("p", "b", D[7], True), ("p", "c", D[1], True), ("p", "c", D[9], False), ("q", "x", D[0], False)]
WANT = {("c", "early"): "late", ("c", "lost"): "missing", ("c", "dead"): "deleted", ("c", "twice"): "late", ("d", "sound"): "missing"}


def kinds(state):
    return {(r.tbl, r.row_key): r.kind for r in orphans.orphans(state).collect()}


def test_outcome_does_not_depend_on_batches(spark):
    refs, known = spark.createDataFrame(REF_ROWS, REFS), spark.createDataFrame(PARENT_ROWS, PARENTS)
    for n in (1, 2, 5):
        assert kinds(orphans.replay(refs, known, n)) == WANT


def test_states_over_time(spark):
    s = orphans.State.empty(spark)
    refs = spark.createDataFrame([("c", "x", "p", "b", D[5])], REFS)
    none_r, none_p = spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS)
    s = orphans.advance(s, refs, none_p)
    assert kinds(s) == {("c", "x"): "missing"}
    for row, want in ((("p", "b", D[2], False), None), (("p", "b", D[6], True), "deleted"), (("p", "b", D[7], False), None)):
        s = orphans.advance(s, none_r, spark.createDataFrame([row], PARENTS))
        assert kinds(s).get(("c", "x")) == want
    assert orphans.counts(s).count() == 0
    assert kinds(orphans.advance(s, none_r, none_p)) == {}


def _rows_written(state, before):
    """Rows of the parts that a batch appended."""
    return sum(state.spark.read.parquet(state.part(t, v)).count() for t, p in state.parts.items() for v in p if v not in before.parts[t])


def test_a_batch_costs_what_it_touches(spark):
    refs = spark.range(20_000).selectExpr("'c' tbl", "concat('r', id) row_key", "'p' parent", "concat('k', id % 5000) ref", "timestamp'2020-03-01' time")
    known = spark.range(4000).selectExpr("'p' parent", "concat('k', id) ref", "timestamp'2020-01-01' time", "false gone")
    s = orphans.advance(orphans.State.empty(spark), refs, known)
    assert orphans.orphans(s).count() == 4000
    new = spark.createDataFrame([("c", f"n{i}", "p", "k1", D[5]) for i in range(8)], REFS)
    t = orphans.advance(s, new, spark.createDataFrame([("p", "k4500", D[1], False), ("p", "k7", D[6], True)], PARENTS))
    # 2 parents, 8 new references by key and by parent, 4 resolved and 4 reopened ones
    assert _rows_written(t, s) == 2 + 8 + 8 + 4 + 4
    # of the parents' buckets only the wanted ones leave the scan, by the row groups' bounds
    plan = t.read("parents", [3, 9])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(bucket, [3,9])]" in plan
    k = kinds(t)
    assert len(k) == 4000 and sum(v == "deleted" for v in k.values()) == 4 and ("c", "r4500") not in k


def test_a_reference_that_changes(spark):
    s = orphans.State.empty(spark)
    known = spark.createDataFrame([("p", "a", D[0], False)], PARENTS)
    none = spark.createDataFrame([], PARENTS)
    s = orphans.advance(s, spark.createDataFrame([("c", "x", "p", "gone", D[3])], REFS), known)
    assert kinds(s) == {("c", "x"): "missing"}
    s = orphans.advance(s, spark.createDataFrame([("c", "x", "p", "a", D[4])], REFS), none)
    assert kinds(s) == {}
    s = orphans.advance(s, spark.createDataFrame([("c", "x", "p", "gone", D[2])], REFS), none)  # an older copy
    assert kinds(s) == {}
    s = orphans.advance(s, spark.createDataFrame([], REFS), spark.createDataFrame([("p", "a", D[6], True), ("p", "gone", D[0], False)], PARENTS))
    assert kinds(s) == {("c", "x"): "deleted"}
    s = orphans.advance(s, spark.createDataFrame([("c", "x", "p", None, D[7])], REFS), none)
    assert kinds(s) == {}


def test_merging_parts_changes_nothing(spark):
    refs, known = spark.createDataFrame(REF_ROWS, REFS), spark.createDataFrame(PARENT_ROWS, PARENTS)
    for s in orphans.states(refs, known, 4):
        pass
    m = s[1].merged()
    assert kinds(m) == kinds(s[1]) == WANT and all(len(p) == 1 for p in m.parts.values())
    more = spark.createDataFrame([("p", "zz", D[0], False)], PARENTS)
    assert kinds(orphans.advance(m, spark.createDataFrame([], REFS), more)) == {k: v for k, v in WANT.items() if k != ("c", "lost")}


def test_snapshots(spark):
    refs = spark.createDataFrame([("c", f"r{m}", "p", "b", D[m]) for m in range(12)], REFS)
    known = spark.createDataFrame([("p", "b", D[2], False), ("p", "b", D[6], True)], PARENTS)
    rows = orphans.snapshots(refs, known, 3).collect()
    by = {}
    for r in rows:
        by.setdefault(r.until, {}).setdefault(r.kind, 0)
        by[r.until][r.kind] += r.n
    assert by[None] == {"deleted": 12} and len(by) == 3
    assert by[min(t for t in by if t)] == {"late": 2}  # the parent is there, and the first two are older


def test_keys(spark):
    df = spark.createDataFrame([(" \tAb\n",), ("  ",), (None,), ("ab\u00a0",)], "k string")
    assert [r[0] for r in df.select(orphans.key_form("k")).collect()] == ["ab", None, None, "ab\u00a0"]


def test_report_tables(spark):
    c = spark.createDataFrame([("c1", "F1", D[3]), ("c2", "f9", D[3]), (None, "f9", D[3])], "chunk_id string, finding_id string, created_at timestamp")
    law = spark.createDataFrame([("l1", None, D[3])], "law_id string, finding_id string, created_at timestamp")
    t = spark.createDataFrame([("r1", "d1 ", D[0]), ("r2", "\n", D[0])], "row_id string, doc_id string, ingested_at timestamp")
    f = spark.createDataFrame([("f1", "d2", D[2], None), ("f1", "d2", D[5], None)], "finding_id string, doc_id string, ingested_at timestamp, deleted_at timestamp")
    r = spark.createDataFrame([("D1", D[1], None, 1)], "doc_id string, ingested_at timestamp, deleted_at timestamp, kind int")
    got = {tuple(x) for x in orphans.orphans(orphans.report_references(c, law, t, f, r)).collect()}
    assert got == {("chunks", "c2", "2020-04", "missing"), ("table_rows", "r1", "2020-01", "late"), ("findings", "f1", "2020-03", "missing")}
    assert orphans.orphans(orphans.report_references(*(x.limit(0) for x in (c, law, t, f, r)))).count() == 0


def test_stream(spark, tmp_path):
    refs = spark.createDataFrame(REF_ROWS, REFS).select(F.lit("ref").alias("side"), "*", F.lit(None).cast("boolean").alias("gone"))
    known = spark.createDataFrame(PARENT_ROWS, PARENTS).select(F.lit("parent").alias("side"), F.lit(None).cast("string").alias("tbl"), F.lit(None).cast("string").alias("row_key"), "parent", "ref", "time", "gone")
    src = str(tmp_path / "in")
    rows = refs.unionByName(known)
    store = stream.Store(spark, str(tmp_path / "state"))
    seen = []
    for half in (0, 1):
        rows.where(F.pmod(F.hash("row_key", "time"), F.lit(2)) == half).coalesce(1).write.mode("append").parquet(src)
        q = stream.follow(spark.readStream.schema(stream.ARRIVAL).parquet(src), store, lambda n, c: seen.append((n, c.count()))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert kinds(store.load(store.newest())) == WANT
    assert len(seen) == 2
