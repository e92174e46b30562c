"""The cell index: recall against brute force on a whole table, awkward rows, and files of which a search reads some."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.operators import cells

DATA = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_recall_on_a_whole_table(spark, tmp_path):
    """20 rows of the table as queries, a quarter of the cells: at least 0.9 of the 20 nearest."""
    df = cells.usable(spark.read.parquet(f"{DATA}/chunks_vectors.parquet").select("chunk_id", "vector", "upserted_at"), "chunk_id", "vector", 64, "upserted_at")
    at = cells.write(df, str(tmp_path / "i"), key="chunk_id")
    rows = df.toPandas()
    x = cells._unit(np.array(rows.vector.tolist(), float))
    assert spark.read.parquet(f"{at.path}/rows").count() == len(rows) > 10_000  # every row is in the index
    again = cells.load(spark, at.path)
    assert (again.centres == at.centres).all()
    hit = 0
    for q in x[:: len(x) // 20][:20]:
        near = np.argsort(-(at.centres @ q), kind="stable")[: len(at.centres) // 4]
        cell = (x.astype(np.float32) @ at.centres.T).argmax(1)
        hit += np.isin(cell[np.argsort(-(x @ q))[:20]], near).sum()
    assert hit / 400 >= 0.9
    q = x[7]
    got = cells.search(spark, again, q.tolist(), 20, "chunk_id", probe=len(at.centres) // 4)
    near = np.argsort(-(at.centres @ q.astype(np.float32)), kind="stable")[: len(at.centres) // 4]
    read = np.flatnonzero(np.isin((x.astype(np.float32) @ at.centres.T).argmax(1), near))
    want = set(rows.chunk_id.iloc[read[np.argsort(-(x[read] @ q))[:20]]])
    assert {r.id for r in got.collect()} == want  # exact within what it reads
    assert "PushedFilters: [In(cell," in got._jdf.queryExecution().executedPlan().toString()


def test_awkward_rows(spark, tmp_path):
    rows = [("a", [1.0, 0.0], 1, "x"), ("a", [0.0, 1.0], 2, "x"), ("b", None, 1, "x"), ("c", [0.0, 0.0], 1, "x"), ("d", [float("nan"), 1.0], 1, "x"), ("e", [1.0], 1, "x"), (None, [1.0, 0.0], 1, "x"), ("f", [1.0, 1.0], 1, "y"), ("g", [1.0, None], 1, "y"), ("h", [float("inf"), 1.0], 1, "y")]
    df = spark.createDataFrame(rows, "id string, vector array<float>, at int, score string")
    use = cells.usable(df, "id", "vector", 2, "at")
    assert sorted(r.id for r in use.collect()) == ["a", "f"]
    at = cells.write(use, str(tmp_path / "i"))
    find = lambda q, **k: [r.id for r in cells.search(spark, at, q, 5, "id", **k).collect()]
    assert find([0.0, 1.0]) == ["a", "f"] and find([0.0, 1.0], where=F.col("score") == "y") == ["f"] and find([1.0]) == []
    empty = cells.write(use.limit(0), str(tmp_path / "e"))
    assert cells.search(spark, empty, [1.0], 5, "id").count() == 0


def test_fit():
    x = np.random.default_rng(0).normal(size=(500, 8))
    c = cells.fit(x, 10)
    assert c.shape == (10, 8) and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-5) and (cells.fit(x, 10) == c).all()
    assert len(cells.fit(x[:3], 10)) == 3
