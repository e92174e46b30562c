"""Files, vocabularies, addresses, stores, streams and hooks."""

import json

import pytest
from pyspark.sql import functions as F

from docloom.operators import index, layout, meta, rank, retrieve, store
from docloom.functions import geometry as g
from docloom.functions import text as tx
from docloom.functions import vector as vx
from docloom.plans import answer, pipeline
from docloom.sources import files
from docloom.streaming import ingest


def test_files(spark, tmp_path):
    d = tmp_path / "a" / "b"
    d.mkdir(parents=True)
    (d / "x_layout.md").write_text("﻿---\ndoc_id: \"D-1\"\n---\n", encoding="utf-8")
    (d / "x_layout.json").write_text("{}", encoding="utf-8")
    (d / "x.pdf").write_bytes(b"%PDF")
    assert [r["size"] for r in files.list_files(spark, str(tmp_path)).collect()] == [4]
    md = files.read_markdown(spark, str(tmp_path)).first()
    assert md.md.startswith("---")
    assert files.read_layouts(spark, str(tmp_path)).first().json == "{}"
    store.create_if_absent(spark, str(tmp_path / "t"), "a int, b string")
    store.create_if_absent(spark, str(tmp_path / "t"), "a int")
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["a", "b"]
    store.back_up(spark, str(tmp_path / "t"), str(tmp_path / "u"))
    assert files.table_size(spark.read.parquet(str(tmp_path / "u"))).first()["rows"] == 0


def test_ingest(spark, tmp_path):
    from tests.test_reports import LAYOUT, MD

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "r_layout.md").write_text(MD, encoding="utf-8")
    (tmp_path / "in" / "r_layout.json").write_text(LAYOUT, encoding="utf-8")
    for _ in range(2):  # the second time changes nothing
        pipeline.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), F.lit("2024-01-01").cast("timestamp"))
    n = {t: spark.read.parquet(str(tmp_path / "out" / t)).count() for t in ("reports", "table_rows", "findings", "row_finding_map", "chunks", "law_references")}
    assert n == {"reports": 1, "table_rows": 2, "findings": 1, "row_finding_map": 1, "chunks": 2, "law_references": 1}


def test_vocabulary(tmp_path):
    p = tmp_path / "v.yaml"
    p.write_text("actions:\n  가:\n    synonyms:\n      - 나\n      - \"다 라\"  # note\n  마:\n    synonyms: [바, 사]\n", encoding="utf-8")
    assert files.read_vocabulary(str(p)) == {"가": ["나", "다 라"], "마": ["바", "사"]}
    assert files.read_vocabulary(str(tmp_path / "none.yaml")) == {}


def test_addresses(spark):
    assert files.parse_dsn("postgresql://u%40x:p%2F@h:99/db?sslmode=off") == {"host": "h", "port": 99, "dbname": "db", "user": "u@x", "password": "p/", "sslmode": "off"}
    assert files.parse_dsn("postgres:///")["host"] == "localhost"
    with pytest.raises(ValueError):
        files.parse_dsn("http://x")
    r = spark.createDataFrame([("postgresql://h/db",), (None,), ("no address",)], "d string").select(files.dsn_columns("d").alias("p")).collect()
    assert (r[0].p.host, r[0].p.port, r[0].p.path) == ("h", 5432, "db") and r[1].p.host == "localhost"
    env = {"A": "x", "B": "3", "C": "yes"}
    assert [files.setting(env, "A", 1, int), files.setting(env, "B", 1, int), files.setting(env, "C", False, bool), files.setting(env, "D", 2.0, float)] == [1, 3, True, 2.0]


def test_embed(spark):
    df = spark.createDataFrame([("a", "x"), ("b", " "), ("c", None), (None, "y"), ("d", "zz")], "k string, t string")

    def load():
        return lambda texts: [[float(len(t)), 1.0] for t in texts]

    got = pipeline.embed(df, "k", F.col("t"), load)
    assert {r.k: r.vector for r in got.collect()} == {"a": [1.0, 1.0], "d": [2.0, 1.0]}
    known = got.where("k = 'a'").select("k", "text_hash")
    assert [r.k for r in pipeline.embed(df, "k", F.col("t"), load, known).collect()] == ["d"]


def test_text_nulls(spark):
    df = spark.createDataFrame([(None,), ("",), ("가 나 가",)], "t string")
    r = df.select(tx.tokens("t").alias("a"), tx.keywords("t", [], 1).alias("b"), tx.word_count("t").alias("c"), tx.labels("t", {"가": ["x"]}).alias("d"), tx.script_of("t").alias("e"), tx.entities("t", ["가"]).alias("f"), tx.jaccard(tx.token_set("t"), F.array(F.lit("가"))).alias("g"), tx.plain_text("t").alias("h")).collect()
    assert [x.a for x in r] == [[], [], ["가", "나", "가"]]
    assert [x.b for x in r] == [[], [], ["가", "나"]]
    assert [x.c for x in r] == [0, 0, 3]
    assert r[2].d == ["가"] and [x.e for x in r] == ["unknown", "unknown", "ko"] and r[2].f == ["가"]
    assert [x.g for x in r] == [0.0, 0.0, 0.5] and [x.h for x in r] == [None, "", "가 나 가"]


def test_vector_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [0.0, 0.0]), (4, [3.0, 4.0]), (5, [1.0]), (6, [float("nan"), 1.0])], "id int, vector array<float>")
    assert [(r.id, round(r.score, 6)) for r in retrieve.vector_top(df, [3.0, 4.0], 5, "id").collect()] == [(4, 1.0)]
    assert df.where("id = 4").select(vx.normalized("vector").alias("v")).first().v == pytest.approx([0.6, 0.8])


def test_bm25_nulls(spark):
    df = spark.createDataFrame([(1, "가 나"), (2, None), (3, ""), (None, "가"), (4, "가"), (4, "가")], "id int, t string")
    got = index.bm25(df, "id", ["가", "가"], {"t": 1.0}).collect()
    assert sorted(r.id for r in got) == [1, 4, 4]
    assert index.bm25(df, "id", [], {"t": 1.0}).count() == 0
    assert index.bm25(df.limit(0), "id", ["가"], {"t": 1.0}).count() == 0


def test_index_and_text_agree(spark, tmp_path):
    df = spark.createDataFrame([(i, " ".join("가나다라"[(i * k) % 4] for k in range(1, 2 + i % 5))) for i in range(40)], "id int, t string")
    index.write_index(df, "id", ["t"], str(tmp_path), parts=2)
    posted, stats = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("postings", "stats"))
    a = {r.id: round(r.score, 9) for r in index.bm25_index(posted, stats, ["가", "나"], {"t": 2.0}).collect()}
    b = {r.id: round(r.score, 9) for r in index.bm25(df, "id", ["가", "나"], {"t": 2.0}).collect()}
    assert a == b and a


def test_mmr(spark):
    df = spark.createDataFrame([(0, "a", 1.0, [1.0, 0.0]), (0, "b", 0.99, [1.0, 0.01]), (0, "c", 0.8, [0.0, 1.0])], "q int, id string, score double, vector array<double>")
    assert [r.id for r in retrieve.diversify(df, "q", 2).orderBy("pick").collect()] == ["a", "c"]


def test_layout_columns(spark):
    page = spark.createDataFrame([("d", 1, (0.0, 0.0, 10.0, 10.0), "t1"), ("d", 1, (50.0, 0.0, 60.0, 10.0), "t2"), ("e", 1, (0.0, 0.0, 10.0, 10.0), "t3")], f"doc_id string, page int, box {g.BOX}, text string")
    regions = page.where("text = 't1'")
    assert sorted(r.text for r in layout.drop_covered_text(page, regions, ["doc_id", "page"]).collect()) == ["t2", "t3"]
    laws = spark.createDataFrame([("d", (0.0, 0.0, 10.0, 100.0))], f"doc_id string, box {g.BOX}")
    blocks = spark.createDataFrame([("d", (1.0, 5.0, 9.0, 9.0), "법령"), ("d", (1.0, 50.0, 9.0, 59.0), "법령 2"), ("d", (1.0, 70.0, 9.0, 79.0), "그 밖")], f"doc_id string, box {g.BOX}, text string")
    assert [(r.part, r.box.y0, r.box.y1) for r in layout.law_slices(laws, blocks, ["doc_id"]).orderBy("part").collect()] == [(0, 0.0, 50.0), (1, 50.0, 100.0)]
    h = spark.createDataFrame([("d", 12.04, 1), ("d", 12.0, 2), ("d", 9.0, 3), ("d", 99.0, 4), ("e", 1.0, 1)], "doc string, height double, seq int")
    assert {r.doc: r.height for r in layout.modal_height(h, ["doc"]).collect()} == {"d": 12.0, "e": 12.0}
    units = spark.createDataFrame([("(단위 : 원)",), ("본문",)], "t string").select(layout.is_unit_label(g.box(F.lit(0), F.lit(0), F.lit(1), F.lit(1)), "t", F.lit(100)).alias("u")).collect()
    assert [r.u for r in units] == [True, False]
    items = spark.createDataFrame([("d", 1, 2.0, 0.0, "b", None), ("d", 1, 1.0, 0.0, "a", "x")], "doc_id string, page int, y0 double, x0 double, type string, content string")
    assert json.loads(store.to_layout_json(items).first().json) == {"page_1": [{"type": "a", "content": "x"}, {"type": "b"}]}


def test_coverage(spark):
    df = spark.createDataFrame([("가나 가나 다라",), (None,)], "t string")
    r = meta.word_report(df, "t", ["가나마"])
    assert [(x.word, x.n, x.known) for x in r.orderBy("word").collect()] == [("가나", 2, True), ("다라", 1, False)]
    assert [x.word for x in meta.missing_words(r, 1).collect()] == ["다라"]


def test_answer(spark):
    ctx = spark.createDataFrame([(2, "b"), (1, "a")], "seq int, text string")
    assert answer.compose("q", ctx, ["- r"], "n") == "n\n\na\n\nb\n\n- r"
    assert answer.compose("q", ctx.limit(0)) == answer.NO_CONTEXT
    assert answer.compose("q", ctx, model=lambda q, c: 1 / 0) == answer.FAILED
    ex = spark.createDataFrame([("d", f"f{i}", 9.0 - i) for i in range(5)], "doc_id string, finding_id string, score double")
    assert answer.excluded_lines(rank.excluded_summary(ex)) == ["- d: f0, f1, f2 (+2)"]


def test_pack_budget(spark):
    p = spark.createDataFrame([(0, "f", i, "x" * 40) for i in range(10)], "q int, finding_id string, o int, text string")
    got = rank.pack_context(p, "q", ["o"], budget=25)
    assert [(r.seq, r.spent) for r in got.orderBy("seq").collect()] == [(1, 10), (2, 20), (3, 30)]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "k int, v string, o int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ingest.upsert_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), str(tmp_path / "t"), ["k"], ["o"]).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "c"]


def test_ordered_windows_of_hot_keys(spark):
    import random

    from pyspark.sql import Window

    from docloom.operators import ordered

    rnd = random.Random(1)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", rnd.choice([None, *range(40)]), i, rnd.choice([None, None, i])) for i in range(2000)]
    df = spark.createDataFrame(rows, "k string, o int, i int, v int").repartition(8)
    order = ["o", "i"]
    w = Window.partitionBy("k").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    want = {r.i: (r.n, r.s, r.c) for r in df.select("i", F.row_number().over(w).alias("n"), F.sum(F.coalesce("v", F.lit(0))).over(run).alias("s"), F.last("v", True).over(run).alias("c")).collect()}
    assert {r.i: r.n for r in ordered.numbered(df, ["k"], order).collect()} == {i: x[0] for i, x in want.items()}
    assert {r.i: r.total for r in ordered.running_sum(df, ["k"], order, "v").collect()} == {i: x[1] for i, x in want.items()}
    assert {r.i: r.c for r in ordered.carried(df, ["k"], order, "v", "c").collect()} == {i: x[2] for i, x in want.items()}
    assert ordered.numbered(df.limit(0), ["k"], order).count() == 0
