"""Packed fields: the rules on single fields, the choice of dialects, and whole tables with awkward rows."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators import packed

CASES = {
    "보조금 누수 · 분실 ,인정이자 미수· , 「3/4분기 집중」<br>단가조정": ["보조금 누수", "분실", "인정이자 미수", "3/4분기 집중", "단가조정"],
    '["누락", "계약서 \\"특약\\" 조항"]': ["누락", '계약서 "특약" 조항'],
    '"소위 ""할인"" 약정, 구두";"갑; 을"': ['소위 "할인" 약정, 구두', "갑; 을"],
    "가. 사용 분실 나. 누수 다. 가공": ["사용 분실", "누수", "가공"],
    "(1) 위장거래 (2) e-계산서 지연 (3) 특수관계(자회사)": ["위장거래", "e-계산서 지연", "특수관계(자회사)"],
    "①시가미달 ② 위장거래": ["시가미달", "위장거래"],
    "1. 차명 2. 2.5배 마진 3. 1,200,000원": ["차명", "2.5배 마진", "1,200,000원"],
    "- a\n- b": ["a", "b"],
    "한도초과(3%)／비용,-, ": ["한도초과(3%)", "비용"],
    "'원재료|부재료'ㆍ현금": ["원재료|부재료", "현금"],
    "a\tb\r\nc": ["a", "b", "c"],
    "a  \u00a0 b": ["a b"],
    "": [],
    " - ": [],
    "x,x": ["x", "x"],
}


@pytest.mark.parametrize("field", CASES)
def test_rules(field):
    assert packed.parse(field) == CASES[field]


def test_long_tags_are_line_breaks():
    style = "style=\"text-align: center; font-family: 'Batang', serif; border: 1px solid; padding: 2px\""
    assert packed.parse(f"<td {style}>누락</td><td {style}>가공 거래</td>") == ["누락", "가공 거래"]
    assert packed.parse("a<p" + " x" * 5000) == ["a", "p" + " x" * 5000]  # no tag without its end


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="가나 a1,./;|'\"\\()[]-·\n\t%「」①<br>", max_size=40))
def test_any_text_parses(s):
    for _, _, v in packed.readings(s):
        assert all(x and x == x.strip() and x != "-" for x in v)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="가나다 ,;/|", min_size=1, max_size=8).map(lambda x: " ".join(x.split())).filter(lambda x: x and x != "-"), min_size=1, max_size=5))
def test_quoted_values_come_back(values):
    assert packed.parse(";".join('"' + v + '"' for v in values)) == values


@settings(max_examples=1000, deadline=None)
@given(st.text(alphabet="가나 a1,./;|'\"\\()[]-·\n\t%「」①2)<br>", max_size=30))
def test_readings_are_the_allowed_ones_of_all_dialects(s):
    # no dialect that leaves nothing parting in a value and overlooks nothing clear reads anything shorter or else
    full = packed.read(s, packed.FULL)
    clear = {q for q, sure in full.pairs if sure}
    got = {tuple(v): b for _, b, v in packed.readings(s)}
    assert tuple(full.values) in got
    for d in packed.DIALECTS:
        p = packed.read(s, d)
        if not p.left and d.lists and clear <= set(packed.QUOTES[d.quotes][::2]) and not any(not sure for _, sure in full.pairs):
            assert got[tuple(p.values)] <= p.bits(d)


F_SCHEMA = "tbl string, row_key string, elem int, s string"


def _unpacked(spark, fields):
    rows = [("t", f"r{i}", 0, s) for i, s in enumerate(fields)]
    got = packed.unpack(spark.createDataFrame(rows, F_SCHEMA)).orderBy("row_key", "pos").collect()
    kinds = {int(r.row_key[1:]): (r.kind, r.quotes, r.lists) for r in packed.dialects(spark.createDataFrame(rows, F_SCHEMA)).collect()}
    by = {i: [] for i in range(len(fields))}
    for r in got:
        by[int(r.row_key[1:])].append(r.val)
    return by, kinds


def test_dialect_of_least_length(spark):
    by, kinds = _unpacked(spark, ["갑; 을", "'갑; 을'|병", "병", '"갑; 을",병', "병|정, 무", "가. 정 나. 무"])
    assert by == {0: ["갑", "을"], 1: ["갑; 을", "병"], 2: ["병"], 3: ["갑; 을", "병"], 4: ["병", "정", "무"], 5: ["정", "무"]}
    assert [kinds[i][0] for i in (0, 1, 3, 4)] == ["semicolon", "bar", "comma", "all"]
    assert kinds[5][2] and not kinds[0][2]


def test_frequencies_choose_quotes(spark):
    # the quotes around both are apostrophes of years where the years are known, and quotes where the whole is
    years = ["'90s, '80s'", *["90s", "80s"] * 40]
    by, kinds = _unpacked(spark, years)
    assert by[0] == ["90s", "80s"] and kinds[0][1] == "double"
    by, kinds = _unpacked(spark, ["'90s, '80s'", *["'90s, '80s'"] * 40])
    assert by[0] == ["90s, '80s"] and kinds[0][1] == "all"


def test_frequencies_choose_lists(spark):
    by, kinds = _unpacked(spark, ["현장 2) 지점", *["현장 2", "지점"] * 40])
    assert by[0] == ["현장 2", "지점"] and not kinds[0][2]
    by, kinds = _unpacked(spark, ["현장 2) 지점", *["현장", "지점"] * 40])
    assert by[0] == ["현장", "지점"] and kinds[0][2]


def test_rare_quoted_values_stay_whole(spark):
    # what is clear by the rules is no matter of frequency
    by, _ = _unpacked(spark, ['"갑; 을",병', *["갑", "을"] * 200])
    assert by[0] == ["갑; 을", "병"]


T0, T1 = dt.datetime(2020, 1, 1), dt.datetime(2020, 2, 1)


def test_tables(spark):
    rows = spark.createDataFrame([("r1", "a,b", T0, 1), ("r1", "a,b", T1, 2), ("r2", None, T0, 3), (None, "x,y", T0, 4), ("r3", "one", T0, 5), ("r4", "p;q " * 3000, T0, 6)], "row_id string, reason_kw_raw string, ingested_at timestamp, val int")
    found = spark.createDataFrame([("f1", ["a", None, "b;c", ""], T0, "z"), ("f2", [], T0, "z"), ("f3", None, T0, "z"), ("f4", ["x", "y"], T0, "z")], "finding_id string, reason_kw_norm array<string>, ingested_at timestamp, pos string")
    got = packed.reasons(rows, found).where("packed").collect()
    few = sorted((r.tbl, r.row_key, r.pos, r.val) for r in got if r.row_key != "r4")
    assert few == [("findings", "f1", 1, "a"), ("findings", "f1", 2, "b"), ("findings", "f1", 3, "c"), ("table_rows", "r1", 1, "a"), ("table_rows", "r1", 2, "b")]
    assert sum(r.row_key == "r4" for r in got) == 3001
    assert packed.reasons(rows.limit(0), found.limit(0)).count() == 0
