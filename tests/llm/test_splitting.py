"""Pieces: whole, within the limits, with the right overlap, at natural boundaries, steady under edits."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import splitting as sp

L = sp.Limits()


def check(text, limits=L):
    p, at = sp.pieces(text, limits), 0
    for i, (a, b, e) in enumerate(p):
        piece = text[a:e]
        assert len(piece) <= limits.chars and len(sp.WORD.findall(piece)) <= limits.words and a <= b < e and b == at
        if i:
            before = text[p[i - 1][0] : at]
            starts = [m.start() for m in sp.WORD.finditer(before)]
            words = before[starts[-limits.overlap_words] :] if len(starts) >= limits.overlap_words else before
            assert piece[: b - a] == min(words, before[-limits.overlap_chars :], key=len)
        if i < len(p) - 1:  # the own part isn't below the least size, but where nothing larger fits
            own = text[b:e]
            assert len(own) >= limits.least_chars or len(sp.WORD.findall(own)) >= limits.least_words
        at = e
    assert at == len(text)
    return p


SENTENCE = "거래처 원장과 전표를 하나씩 대조하였다. "


@pytest.mark.parametrize("text", [SENTENCE * 400, "가나 " * 5000, "a" * 50_000, "\n" * 9000, "é́" * 5000, "한문장.다음문장." * 2000, ("word " * 30 + "\n\n") * 60, "x" * 6001])
def test_pieces(text):
    assert len(check(text)) > 1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="가a .\n　́。", min_size=1, max_size=400))
def test_any_text(text):
    check(text, sp.Limits(20, 120, 3, 20, 6, 30, 3))


def test_a_short_first_line_is_no_piece():
    p = check("Title line.\n" + "word " * 3000)
    assert p[0][2] >= 300 * 5


def test_cuts_are_natural_where_they_can_be():
    text = SENTENCE * 400
    assert all(text[:e].endswith(". ") for _, _, e in sp.pieces(text))


def test_an_edit_changes_only_pieces_near_it():
    text = "".join(f"{SENTENCE[:-2]} {i * 7919 % 1000}건이다. " for i in range(3000))
    edited = text[:20_000] + "새 문장이다. " + text[20_000:]
    a, b = ({t[x:z] for x, _, z in sp.pieces(t)} for t in (text, edited))
    assert len(a) > 20 and len(a - b) <= 3


def test_spans():
    got = list(sp.span_pieces(30, 1000))
    assert got[0][0] == 30 and got[-1][2] == 1000
    for (_, _, e), (f, o, _) in zip(got, got[1:]):
        assert o == e + 1 and f == o - 10
    assert all(e - f + 1 <= 120 for f, _, e in got)


def _lines(n):
    return [("" if i % 17 == 16 else f"# 제 {i} 절" if i % 61 == 60 else f"{i * 7919 % 1009} 번 거래를 대조하였다") for i in range(n)]


def test_lines_that_come_in_move_only_pieces_near_them(spark):
    def contents(lines, first):
        doc = ["머리"] * (first - 1) + lines
        spans = spark.createDataFrame([("f", [("s", first, len(doc))])], "finding_id string, section_spans array<struct<name:string,start_line:int,end_line:int>>")
        table = spark.createDataFrame([("f", i, x) for i, x in enumerate(doc, 1)], "finding_id string, line_no int, line string")
        p = sp.split_spans(spans, "finding_id", "section_spans", lines=table).orderBy("piece_no").collect()
        assert all(r.end - r.start + 1 <= 120 for r in p) and all(r.end - r.own_start + 1 >= 60 for r in p[:-1])
        return [tuple(doc[r.start - 1 : r.end]) for r in p]

    base = _lines(900)
    a = contents(base, 5)
    assert len(a) > 7 and contents(base, 6) == a  # a line above the span changes nothing
    b = contents(base[:300] + ["새 줄"] + base[300:], 5)
    assert len(set(a) - set(b)) <= 3
    assert all(x[-1] == "" or not x[-1].startswith("#") for x in a)


def test_spans_without_texts_are_cut_by_their_own_lines():
    a = [(f - 30, o - 30, e - 30) for f, o, e in sp.span_pieces(30, 1000)]
    assert a == [(f - 31, o - 31, e - 31) for f, o, e in sp.span_pieces(31, 1001)]
    assert [e for _, _, e in sp.span_pieces(1, 300, natural=[90, 200])][:2] == [90, 200]


T = dt.datetime(2020, 1, 1)


def test_tables(spark):
    long, line = "낱말 " * 801, SENTENCE
    rows = [("a", long, T, 1), ("a", long, T, 1), ("b", "낱말 " * 800, T, 1), ("c", None, T, 1), ("d", "", T, 1), ("e", "x" * 6000, T, 1), ("f", "x" * 6001, T, 1), (None, long, T, 1), ("g", line * 20_000, T, 1)]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string, created_at timestamp, start int")
    spans = [("f1", [("s", 1, 120), ("t", 1, 121), ("u", 5, None), ("v", 9, 2), None]), ("f1", [("s", 1, 120), ("t", 1, 121), ("u", 5, None), ("v", 9, 2), None]), ("f2", None), ("f3", []), ("f4", [("s", None, 500)])]
    findings = spark.createDataFrame(spans, "finding_id string, section_spans array<struct<name:string,start_line:int,end_line:int>>")
    out = sp.split_all(chunks, findings).toPandas()
    assert {tuple(x) for x in out[["tbl", "row_key", "span_no"]].values} == {("chunks", "a", 0), ("chunks", "f", 0), ("chunks", "g", 0), ("findings", "f1", 2)}
    a = out[out.row_key == "g"].sort_values("piece_no")
    assert "".join(t[o - s :] for t, s, o in zip(a.text, a.start, a.own_start)) == line * 20_000
    assert a.n_words.max() <= 800 and a.n_chars.max() <= 6000
    assert sp.split_all(chunks.limit(0), findings.limit(0)).count() == 0
