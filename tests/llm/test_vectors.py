"""Nearest vectors against brute force, with copies, hot buckets and unusable rows."""

import datetime as dt
import os

import numpy as np
import pytest

from docloom.llm import vectors

T = [dt.datetime(2020, 1, 1), dt.datetime(2021, 1, 1)]
SCHEMA = "k string, vector array<float>, upserted_at timestamp, id string, cos double"


def frame(spark, x, extra=()):
    rows = [(f"k{i:05d}", [float(v) for v in r], T[0], "clash", 0.0) for i, r in enumerate(x)]
    return spark.createDataFrame(rows + list(extra), SCHEMA)


def planted(n, groups, seed=0, spread=0.03):
    g = np.random.default_rng(seed)
    x = g.normal(size=(n, 64))
    for i in range(groups):
        x[3 * i + 1 : 3 * i + 3] = x[3 * i] + spread * g.normal(size=(2, 64)) * np.linalg.norm(x[3 * i]) / 2
    return x


def truth(x, least=0.92, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i, r in enumerate(s):
        for j in np.argsort(-r, kind="stable")[:k]:
            if r[j] >= least:
                out.add((min(i, j), max(i, j)))
    return {(f"k{a:05d}", f"k{b:05d}") for a, b in out}


def found(spark, df, **kw):
    p = vectors.near_pairs(vectors.usable(df, "k"), **kw).toPandas()
    return {(min(a, b), max(a, b)) for a, b in zip(p.id_a, p.id_b)}


def test_against_brute_force(spark):
    x = planted(4000, 500)
    want = truth(x)
    got = found(spark, frame(spark, x))
    assert len(want) > 900 and got <= want and len(got & want) / len(want) >= 0.97


def test_unusable_rows(spark):
    v = [1.0] + [0.0] * 63
    near = [1.0, 0.1] + [0.0] * 62
    bad = [("null", None), ("empty", []), ("short", v[:32]), ("zero", [0.0] * 64), ("nan", [float("nan")] + v[1:]), ("inf", [float("inf")] + v[1:]), ("hole", [None] + v[1:])]
    rows = [(k, x, T[0], "c", 0.0) for k, x in [*bad, ("a", v), ("b", near), (None, v)]]
    rows += [("late", v, T[0], "c", 0.0), ("late", None, T[1], "c", 0.0), ("scaled", [100 * y for y in v], T[0], "c", 0.0), ("tiny", [1e-30 * y for y in v], None, "c", 0.0), ("a", v, T[0], "c", 0.0)]
    got = found(spark, spark.createDataFrame(rows, SCHEMA))
    assert got == {("a", "b"), ("a", "scaled"), ("a", "tiny"), ("b", "scaled"), ("b", "tiny"), ("scaled", "tiny")}
    assert found(spark, spark.createDataFrame([], SCHEMA)) == set()


def test_many_copies(spark):
    g = np.random.default_rng(3)
    x = g.normal(size=(600, 64))
    x[:300] = x[0]  # half of all rows are copies
    p = vectors.near_pairs(vectors.usable(frame(spark, x), "k"), copies=20).toPandas()
    assert (p.groupby("id_a").size() >= 5).sum() == 300 and set(p.id_a) == {f"k{i:05d}" for i in range(300)}
    assert len(p) < 300 * 300 / 4


@pytest.mark.parametrize("copies", [20, 128])
def test_rows_near_many_copies(spark, copies):
    """A row outside of a group of copies has k of them as its nearest, as if the group were small: exactly brute force, ties by id."""
    g = np.random.default_rng(5)
    x = g.normal(size=(400, 64)).astype(np.float32)
    x[:40] = x[0]
    x[40:80] = x[0] + 0.2 * np.linalg.norm(x[0]) * g.normal(size=64) / 8  # a second group near the first
    x[80:84] = x[0] + 0.25 * np.linalg.norm(x[0]) * g.normal(size=(4, 64)) / 8  # single rows near both
    x = x[g.permutation(400)]  # so that the order of ids isn't the order of groups
    u = x / np.linalg.norm(x, axis=1, keepdims=True).astype(np.float64)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -2)
    want = {(f"k{i:05d}", f"k{j:05d}") for i, r in enumerate(s) for j in np.argsort(-r, kind="stable")[:5] if r[j] >= 0.92}
    p = vectors.near_pairs(vectors.usable(frame(spark, x), "k"), copies=copies).toPandas()
    assert set(zip(p.id_a, p.id_b)) == want and len(want) == 84 * 5


def test_hot_bucket(spark):
    g = np.random.default_rng(4)
    x = g.normal(size=(900, 64))
    x[:300] = x[0] + 0.02 * g.normal(size=(300, 64)) * np.linalg.norm(x[0])  # a third lies close together
    want = truth(x)
    vectors_block, vectors.BLOCK = vectors.BLOCK, 64
    try:
        got = found(spark, frame(spark, x), hot=100)
    finally:
        vectors.BLOCK = vectors_block
    assert len(got & want) / len(want) >= 0.97


@pytest.mark.parametrize("n", [3, 2500])
def test_nearest(spark, n):
    x = planted(n, n // 10, 5)
    base = vectors.usable(frame(spark, x), "k")
    got = vectors.nearest(base, base.where("pmod(xxhash64(id), 10) = 0" if n > 10 else "true"), rows=100).toPandas()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for k, rows in got.groupby("id_a"):
        s = u @ u[int(k[1:])]
        s[int(k[1:])] = -2
        want = {f"k{j:05d}" for j in np.argsort(-s)[: min(5, n - 1)]}
        hit, total = hit + len(want & set(rows.id_b)), total + len(want)
        assert sorted(rows["rank"]) == list(range(1, len(rows) + 1))
    assert total and hit / total >= 0.9


DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_recall_of_the_nearest_on_a_whole_table(spark):
    """The query set of p1_nearest against all rows of a table, by brute force in numpy: at least 0.9 of the 5 nearest."""
    base = vectors.usable(spark.read.parquet(f"{DATA}/chunks_vectors.parquet"), "chunk_id")
    rows = base.select("id", "vec").toPandas()
    x = np.frombuffer(b"".join(rows.vec), "<f4").reshape(-1, 64)
    at = {k: i for i, k in enumerate(rows.id)}
    got = vectors.nearest(base, base.where("pmod(xxhash64(id), 50) = 0")).toPandas()
    hit = total = 0
    for k, r in got.groupby("id_a"):
        s = x @ x[at[k]]
        s[at[k]] = -2
        fifth = np.partition(s, -5)[-5]
        hit, total = hit + (s[[at[j] for j in r.id_b]] >= fifth - 1e-6).sum(), total + 5
    assert len(rows) > 10_000 and total > 1000 and hit / total >= 0.9
