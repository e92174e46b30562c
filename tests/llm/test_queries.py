"""The subpackage's queries on the smallest tables, against their SQL where there is one."""

import glob
import os

import duckdb
import pytest

from docloom.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

COLUMNS = {
    "p1_found": ["tbl", "key_a", "key_b"],
    "p3_found": ["tbl", "key_a", "key_b"],
    "p5_found": ["tbl", "row_key", "span_no"],
    "p6_ids": ["doc_id", "ids"],
    "p8_found": ["doc_id", "lang"],
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert len({str(r) for r in rows}) == len(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    r = c.execute(queries.ORACLES[name])
    names = [x[0] for x in r.description]
    want = sorted(r.fetchall())
    assert sorted(tuple(x) for x in queries.QUERIES[name](spark, DATA).select(names).collect()) == want
