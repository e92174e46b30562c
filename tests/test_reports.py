"""Parsing of an anchored report, end to end, against values worked out by hand."""

import json
import time

import pytest
from pyspark.sql import functions as F

from docloom.functions import geometry as g
from docloom.functions import text as tx
from docloom.operators import chunk, layout, link, meta, parse, rank, retrieve, store
from docloom.plans import pipeline, question

MD = """---
doc_id: "2024H-001-1"
---

## Ⅰ.조사성과(결과)

### 나. 적출성과

| 연번 | 조사항목 | 코드 | 적출요지(결정/경정 사유) |
| --- | --- | --- | --- |
| ① | 접대비 한도초과 | 11209 | 업무추진비 과다 계상 | <!-- row_id: 2024H-001-1#R1 -->
| ② | 지급이자 | 10201 | 차입금이자 손금 부인 | <!-- row_id: 2024H-001-1#R2 -->

## Ⅱ.조사노하우

### 적출 1. 접대비 한도초과 <!-- finding_id: 2024H-001-1#F11209#F1 -->

| | |
|---|---|
| 적출 | 항목코드 11209 접대비 과다<br>한도 초과 |

#### 1. 조사착안

거래처 검토.

[law_table#1]

#### 2. 조사기법

전표 확인.
"""
LAYOUT = json.dumps({"page_1": [{"type": "blue_table", "bbox": [0, 0, 1, 1], "path": "crops/page_001/blue_000.png"}], "page_2": [{"type": "law_table", "bbox": [1, 2, 3, 4], "path": "crops/page_002/law_000.png", "law_type": "법령", "law_name": "가법 제1조", "law_content": "내용"}]})


@pytest.fixture(scope="module")
def tables(spark):
    raw = spark.createDataFrame([("/d/a_layout.md", MD)], "path string, md string")
    layouts = spark.createDataFrame([("/d/a", LAYOUT)], "stem string, json string")
    return pipeline.parse_reports(raw, layouts, F.lit("2024-01-01").cast("timestamp"))


def test_rows(tables):
    got = [tuple(r) for r in tables.table_rows.orderBy("row_id").collect()]
    assert got == [("2024H-001-1#R1", "2024H-001-1", 1, "접대비 한도초과", "11209", "업무추진비 과다 계상", 11), ("2024H-001-1#R2", "2024H-001-1", 2, "지급이자", "10201", "차입금이자 손금 부인", 12)]


def test_finding(tables):
    (f,) = tables.findings.collect()
    assert (f.item, f.code, f.start_line, f.end_line) == ("1. 접대비 한도초과", "11209", 16, 31)
    assert f.item_detail == "항목코드 11209 접대비 과다\n한도 초과"
    assert f.reason_kw_norm == ["항목코드", "11209", "접대비", "한도", "초과"]
    assert [tuple(s) for s in f.section_spans] == [("조사착안", 22, 27), ("조사기법", 28, 30)]


def test_law(tables):
    (law,) = tables.law_references.collect()
    assert (law.law_id, law.finding_id, law.page, law.line_number, law.law_order) == ("2024H-001-1#L1", "2024H-001-1#F11209#F1", 2, 26, 1)


def test_link(tables):
    (m,) = tables.row_finding_map.collect()
    assert (m.row_id, m.score, m.code_mismatch, m.needs_review) == ("2024H-001-1#R1", 6.333, False, False)


def test_chunks(tables):
    got = [(r.chunk_id, r.text_norm) for r in tables.chunks.orderBy("chunk_id").collect()]
    fid = "2024H-001-1#F11209#F1"
    assert got == [(f"{fid}@00-00", "1. 조사착안 거래처 검토. [law_table#1]"), (f"{fid}@01-00", "2. 조사기법 전표 확인.")]


def test_code_falls_back_to_the_anchor(spark):
    raw = spark.createDataFrame([("/d/a", MD.replace("항목코드 11209 ", ""))], "path string, md string")
    assert parse.findings(parse.lines(parse.with_ids(raw))).first().code == "11209"


def test_no_anchor_is_lost(spark, tables):
    raw = spark.createDataFrame([("/d/a", MD)], "path string, md string")
    ls = parse.lines(parse.with_ids(raw))
    assert parse.missing_anchors(ls, tables.findings, parse.FINDING_ANCHOR, "finding_id").count() == 0


def test_missing_doc_id(spark):
    raw = spark.createDataFrame([("/d/a", "no head")], "path string, md string")
    assert parse.with_ids(raw, strict=False).count() == 0
    with pytest.raises(Exception, match="no doc_id"):
        parse.with_ids(raw).collect()


def long_report(spark, n):
    """One report of ``n`` findings, each of 9 lines from line 5 on."""
    block = "### 적출 {0}. 항목 <!-- finding_id: F{0} -->\n| 적출요지 | 접대비 |\n\n#### 1. 조사착안\n검토 {0}\n\n#### 2. 조사기법\n확인 {0}\n\n"
    md = '---\ndoc_id: "D"\n---\n\n' + "".join(block.format(i) for i in range(n))
    return spark.createDataFrame([("D", md)], "doc_id string, md string")


def test_lines_of_a_long_report_are_cut_once(spark):
    began = time.time()
    got = parse.lines(long_report(spark, 6_000)).agg(F.count("*"), F.min("n_lines"), F.max("n_lines"), F.max("line_no"), F.sum(F.length("line"))).first()
    assert got[:4] == (54_005, 54_005, 54_005, 54_005)
    assert time.time() - began < 20


def test_chunks_of_a_long_report_cut_it_once(spark):
    docs, n = long_report(spark, 4_000), 4_000
    spans = F.expr("array(named_struct('name', '조사착안', 'start_line', a + 3, 'end_line', a + 5), named_struct('name', '조사기법', 'start_line', a + 6, 'end_line', a + 8))")
    f = spark.range(n).select(F.format_string("F%d", "id").alias("finding_id"), F.lit("D").alias("doc_id"), F.lit(None).cast("string").alias("code"), F.lit("항목").alias("item"), (F.col("id") * 9 + 5).cast("int").alias("a"))
    f = f.select("*", spans.alias("section_spans"), F.col("a").alias("start_line"), (F.col("a") + 8).alias("end_line"))
    began = time.time()
    got = {(r.finding_id, r.section, r.start_line, r.end_line): r.text for r in chunk.chunk_findings(f, docs).collect()}
    assert time.time() - began < 20
    want = {(f"F{i}", s, 9 * i + 5 + x, 9 * i + 5 + x + 2): f"#### {k}. {s}\n{w} {i}" for i in range(n) for k, s, x, w in ((1, "조사착안", 3, "검토"), (2, "조사기법", 6, "확인"))}
    assert got == want


def test_findings_without_text_in_their_sections_are_chunked_whole(spark):
    docs = spark.createDataFrame([("D", "a\n\nb"), ("E", None)], "doc_id string, md string")
    kind = "finding_id string, doc_id string, code string, item string, section_spans array<struct<name:string,start_line:int,end_line:int>>, start_line int, end_line int"
    rows = [("blank", "D", None, "x", [("s", 2, 2)], 1, 3), ("none", "D", None, "x", None, 3, 9), ("past", "D", None, "x", [("s", 8, 9)], None, None), ("swapped", "D", None, "x", [("s", 3, 1), ("t", 0, 1)], 1, 3), ("null", "E", None, "x", [("s", 1, 1)], 1, 1), ("nowhere", None, None, "x", [], 1, 1)]
    got = sorted((r.finding_id, r.section, r.section_order, r.text) for r in chunk.chunk_findings(spark.createDataFrame(rows, kind), docs).collect())
    assert got == [("blank", "전체", 0, "a\n\nb"), ("none", "전체", 0, "b"), ("swapped", "t", 1, "a")]


@pytest.mark.parametrize(("counts", "want"), [([800, 100, 100], [(0, 1), (0, 2), (0, 3)]), ([300, 300, 300], [(0, 2), (1, 3)]), ([399, 800], [(0, 2)]), ([10, 10], [(0, 2)]), ([], [])])
def test_overlap_groups(counts, want):
    assert chunk.overlap_groups(counts) == want


def test_boxes():
    assert g.merge_greedily([(0, 0, 10, 10), (1, 1, 10, 10), (0, 0, 10, 9.5)], 0.9) == [(1, 1, 10, 10), (0, 0, 10, 10)]
    assert g.drop_contained([(1, 1, 10, 10), (0, 0, 10, 10)], 0.5) == [(0, 0, 10, 10)]
    assert g.settle_containment([(0, 0, 10, 10)], [(1, 1, 2, 2), (20, 20, 30, 30)]) == ([(0, 0, 10, 10)], [(20, 20, 30, 30)])


def test_box_columns(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 1.0, 1.0, 10.0, 10.0), (0.0, 0.0, 1.0, 1.0, 1.0, 0.0, 2.0, 1.0), (0.0, 0.0, 10.0, 10.0, 3.0, 3.0, 3.0, 3.0)], "a double, b double, c double, d double, e double, f double, g double, h double")
    x = df.select(g.iou(g.box("a", "b", "c", "d"), g.box("e", "f", "g", "h")).alias("i"), g.contains(g.box("a", "b", "c", "d"), g.box("e", "f", "g", "h")).alias("c")).collect()
    assert [round(r.i, 6) for r in x] == [0.81, 0.0, 0.0]
    assert x[2].c is False
    w = spark.range(1).select(g.widened(g.box(F.lit(50), F.lit(0), F.lit(150), F.lit(20)), F.lit(1000)).alias("b")).first().b
    assert tuple(w) == (50, 0, 800, 20)


def test_rrf(spark):
    a = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "id string, score double")
    b = spark.createDataFrame([("c", 3.0), ("a", 2.0), ("d", 1.0)], "id string, score double")
    got = {r.id: round(r.score, 6) for r in retrieve.fused_top(retrieve.rrf(a, b), 4).collect()}
    assert got == {"a": 0.032522, "c": 0.032266, "b": 0.016129, "d": 0.015873}


@pytest.mark.parametrize(("found", "words", "want"), [([("x", 1), ("x", 2), ("y", 2), ("y", 3)], 2, {2}), ([("x", 1), ("y", 2)], 2, {1, 2}), ([("x", 5)], 1, {5})])
def test_document_set(spark, found, words, want):
    df = spark.createDataFrame([(t, d, 1.0) for t, d in found], "term string, doc_id int, score double")
    assert {r.doc_id for r in retrieve.document_set(df, words).collect()} == want


def test_relative_cut(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 0.5), (3, 0.49)], "id int, score double")
    assert {r.id for r in retrieve.relative_cut(df).collect()} == {1, 2}


def test_blend_and_caps(spark):
    a = spark.createDataFrame([("f1", 0.8), ("f2", 0.2)], "finding_id string, score double")
    b = spark.createDataFrame([("f2", 0.4)], "finding_id string, score double")
    assert {r.finding_id: round(r.score, 6) for r in rank.join_sections(a, b).collect()} == {"f1": 0.4, "f2": 0.3}
    blocks = spark.createDataFrame([(d, f"f{i}", 9.0 - i) for i, d in enumerate("AAABC")], "doc_id string, finding_id string, score double")
    got = rank.accept(blocks).orderBy("rank").collect()
    assert [(r.doc_id, r.rank) for r in got if r.accepted] == [("A", 1), ("A", 2), ("B", 4)]
    assert [r.finding_id for r in got if not r.accepted] == ["f2"]
    assert rank.accept(blocks.limit(0)).count() == 0
    assert {r.finding_id: r.accepted for r in rank.accept(blocks, n=9).collect()} == {"f0": True, "f1": True, "f2": False, "f3": True, "f4": True}


def test_merge_adjacent(spark):
    c = spark.createDataFrame([("f", "s", i, f"t{i}", i, i) for i in range(3)], "finding_id string, section string, chunk_order int, text string, start_line int, end_line int")
    assert [(r.first_order, r.n, r.text) for r in rank.merge_adjacent(c).collect()] == [(0, 3, "t0\nt1\nt2")]
    assert sorted((r.first_order, r.n) for r in rank.merge_adjacent(c, pairs=True).collect()) == [(0, 2), (2, 1)]


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "t")
    a = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "k int, v string, o int")
    store.upsert(a, path, ["k"], ["o"])
    store.upsert(spark.createDataFrame([(2, "d", 0), (3, "e", 0), (None, "n", 0)], "k int, v string, o int"), path, ["k"], ["o"])
    store.upsert(a.limit(0), path, ["k"], ["o"])
    assert sorted((str(r.k), r.v) for r in spark.read.parquet(path).collect()) == [("1", "a"), ("2", "d"), ("3", "e"), ("None", "n")]
    store.clear(spark, [path])
    assert spark.read.parquet(path).count() == 0


def test_link_needs_no_code(spark):
    rows = spark.createDataFrame([("r1", "d", "가 나 다", None, "x"), ("r2", "d", "라", "1", None), (None, "d", "가", "1", "x")], "row_id string, doc_id string, item string, code string, reason_kw_raw string")
    found = spark.createDataFrame([("f1", "d", "가 나 다", "2", ["x"]), ("f2", "d", "마", "1", None)], "finding_id string, doc_id string, item string, code string, reason_kw_norm array<string>")
    got = {(r.row_id, r.finding_id): (r.score, r.code_mismatch, r.needs_review) for r in link.link_pairs(rows, found).collect()}
    assert got == {("r1", "f1"): (3.0, False, True), ("r2", "f2"): (5.0, False, True)}
    assert {r.row_id: r.links for r in link.link_summary(rows, found).collect()} == {"r1": 1, "r2": 1}


def test_best_candidates(spark):
    names = spark.createDataFrame([("가 나",), ("다",), (None,), ("",)], "name string")
    canon = spark.createDataFrame([("가 나 라",), ("나 가",), ("마",)], "label string")
    assert [(r.name, r.label, round(r.score, 3)) for r in meta.best_candidates(names, canon).collect()] == [("가 나", "나 가", 1.0)]


def test_query_text(spark):
    df = spark.createDataFrame([("VAT 환급 적출사례를 알려줘  900101-1234567",), ("",), (None,)], "q string")
    got = [r[0] for r in df.select(tx.preprocess_query("q")).collect()]
    assert got == ["부가가치세 환급 를 주민번호", "", None]


def test_question_routes():
    vocab = {"actions": {"접대비한도초과": ["접대비 한도"]}}
    q = question.plan("접대비 한도 사례", "접대비 한도", "ko", vocab)
    assert (q.route, q.expansion.must, q.slots.labels["actions"]) == ("search", ("접대비", "한도"), ["접대비한도초과"])
    assert question.plan("?", "", "unknown", vocab).route == "clarify"
    e = question.validated({"must_have": "a", "should_have": ["b", 3], "related_terms": None, "boost_weights": {"a": 2, "b": "x"}})
    assert (e.must, e.should, e.related, dict(e.weights)) == (("a",), ("b",), (), {"a": 2.0})
    assert question.expansion_confidence(retrieve.Expansion(("a", "b"), ("c",), ("d", "e", "f"))) == 0.9


def test_markdown_table():
    t = "연번  조사항목  코드  적출요지\n①  접대비  11209  과다\n②  이자  10201"
    assert layout.markdown_table(t, "d").splitlines()[2:] == ["| ① | 접대비 | 11209 | 과다 | <!-- row_id: d#R1 -->", "| ② | 이자 | 10201 |  | <!-- row_id: d#R2 -->"]
    assert layout.markdown_table("① 접대비 한도 11209 업무 과다\n② 이자 10201 부인").splitlines()[2] == "| ① | 접대비 한도 | 11209 | 업무 과다 |"
    assert layout.markdown_table("a\nb\n1\n2\n3\n4").splitlines() == ["| a | b |", "| --- | --- |", "| 1 | 2 |", "| 3 | 4 |"]
    assert layout.markdown_table(None) == "" and layout.markdown_table("one line") == "one line"


def test_assembled_report_parses_back(spark):
    items = [("purple_text", "Ⅰ"), ("purple_text", "조사성과(결과)"), ("yellow_table", "연번  조사항목  코드  적출요지\n①  접대비 한도  11209  과다 계상"), ("purple_text", "Ⅱ. 조사노하우"), ("yellow_table", "적출  항목코드 11209 접대비\n한도  초과"), ("purple_text", "1. 조사착안"), ("purple_text", "거래처를"), ("purple_text", "검토하였음"), ("law_table", ""), ("purple_text", "2. 조사기법"), ("purple_text", "- 전표 확인.")]
    rows = [("d-1", 1, (0.0, float(i), 1.0, i + 0.5), k, t) for i, (k, t) in enumerate(items)]
    df = spark.createDataFrame(rows, f"doc_id string, page int, box {g.BOX}, type string, content string")
    majors = spark.createDataFrame([("d-1", 1, "접대비 한도", "11209")], "doc_id string, n int, item string, code string")
    md = layout.assemble_documents(df, majors).select("doc_id", "md", F.lit("p").alias("path"))
    ls = parse.lines(parse.with_ids(md.select("path", "md")))
    (f,) = parse.findings(ls).collect()
    assert (f.finding_id, f.code, f.sections_present) == ("d-1#F11209#F1", "11209", ["조사착안", "조사기법"])
    assert parse.table_rows(ls).first().row_id == "d-1#R1"
    assert "거래처를 검토하였음" in md.first().md and "[law_table#1]" in md.first().md


def test_table_class(spark):
    df = spark.createDataFrame([("법 령\n가법",), ("Ⅰ 제목",), ("적출\n항목 코드 1",), ("법인·갑",), ("조사우수사례 평가 보고서",), ("기타",), (None,)], "t string")
    assert [r[0] for r in df.select(layout.table_class("t")).collect()] == ["law", None, "yellow", "yellow", None, "blue", "blue"]


def test_report_id(spark):
    df = spark.createDataFrame([("/x/2024_s조사-7-1.pdf",), ("2023h-1234-2.pdf",), ("2024상-5-1_layout.md",), ("other.pdf",)], "f string")
    assert [r[0] for r in df.select(parse.report_id("f")).collect()] == ["2024S-007-1", "2023H-1234-2", "2024S-005-1", "other"]
