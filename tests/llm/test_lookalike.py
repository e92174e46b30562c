"""One form: characters, whole texts against brute force, pairs with many copies."""

import datetime as dt
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import lookalike as la

SAME = [
    ("ＶＡＴ", "VAT"), ("VΑТ", "VAT"), ("가", "가"), ("각", "각"), ("각", "각"), ("a b", "a b"), ("a　b", "a b"), ("a​b", "ab"), ("soft­hyphen", "softhyphen"),
    ("é", "é"), ("е́", "é"), ("A‑B", "A-B"), ("A−B", "A-B"), ("가ㆍ", "가·"), ("・", "·"), ("％", "%"), ("年", "年"), ("が", "が"), ("﻿x", "x"), ("ﬁn", "fin"), ("１２", "12"), ("ё", "ë"),
]
DIFFERENT = [("VAT", "vat"), ("O", "0"), ("l", "1"), ("a b", "ab"), ("a  b", "a b"), ("a\nb", "a b"), ("12", "13"), ("é", "e"), ("가", "각"), ("", "a")]


def looks(c: str) -> str:
    """Brute force: what a whole text looks like, by Unicode's normal forms and the rows of look-alikes, until nothing changes."""
    single, was = {w: row[0] for row in (*(a + b for a, b in re.findall(r"(\S) (\S+)", la.LATIN_ALIKE)), la.HYPHENS, la.DOTS, la.BLANKS) for w in row[1:]}, None
    while c != was:
        was = c
        parts = []
        for x in unicodedata.normalize("NFD", c):
            o = ord(x)
            if la._in(o, la.INVISIBLE) or (unicodedata.category(x) == "Cf" and not la._in(o, la.VISIBLE_CF)):
                continue
            parts.append(single[x] if x in single else unicodedata.normalize("NFKD", x))
        c = "".join(parts)
    return unicodedata.normalize("NFC", c)


def rewriter(texts):
    counts = {}
    for t in texts:
        for c in t:
            counts[ord(c)] = counts.get(ord(c), 0) + 1
    return la.Rewriter(counts)


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(a, b):
    r = rewriter([a, b, b, b])
    assert r(a) == r(b)


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(a, b):
    r = rewriter([a, b])
    assert r(a) != r(b)


def test_the_most_frequent_stands_for_all():
    assert rewriter(["‐‐‐-"])("-") == "‐"
    assert rewriter(["---‐"])("‐") == "-"


def test_frequency_decides_through_all_of_a_class():
    # the Cyrillic letter stands for the Latin one where it is written more often, also in what it is part of
    r = rewriter(["ееееёё", "e", "ë", "ｅ"])
    assert r("e") == r("ｅ") == "е" and r("ë") == r("ё") == r("е\u0308") == r("ｅ\u0308") == "ё"
    r = rewriter(["eeeeëë", "е", "ё"])
    assert r("е") == "e" and r("ё") == r("е\u0308") == "ë"


def test_classes_are_transitive():
    c = la.relations(set("Ａ") | set("ДАΑꓮÅ"))
    assert len({c.root(x) for x in "AＡАΑꓮ"}) == 1
    assert c.root("Å") == c.root("Å") == c.root("A\u030a")


@pytest.mark.parametrize("text", ["ậ", "ậ", "ậ", "ậ", "ậ"])
def test_marks_in_any_order(text):
    r = rewriter(["ậ", "â", "ạ", text, "\u0302\u0323"])
    assert r(text) == r("ậ")


ALPHABET = "aeеоаАAéá가각각̧́​­  　-‑·ㆍ１" "1ﬁ年年ががё̈"


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=2, max_size=6))
def test_equal_forms_are_equal_looks(texts):
    r = rewriter([*texts, ALPHABET])
    same, forms = [looks(t) for t in texts], [r(t) for t in texts]
    for i in range(len(texts)):
        assert r(forms[i]) == forms[i]
        for j in range(i):
            if same[i] == same[j]:
                assert looks(forms[i]) == looks(forms[j])
                assert forms[i] == forms[j]


T = dt.datetime(2020, 1, 1)


def test_pairs(spark):
    rows = [("a", "VAT 환급", T, "x"), ("b", "ＶＡＴ 환급", T, "x"), ("c", "VAT 환급", T, "x"), ("d", "vat 환급", T, "x"), ("e", None, T, "x"), ("f", "", T, "x"), (None, "VAT 환급", T, "x"), ("g", "가" * 50_000, T, "x"), ("b", "ＶＡＴ 환급", T, "x")]
    df = spark.createDataFrame(rows, "chunk_id string, text string, created_at timestamp, form string")
    counts = la.code_points([(df, "text")])
    assert {tuple(r) for r in la.pairs(df, "chunk_id", "text", "created_at", counts).collect()} == {("a", "b"), ("b", "c")}
    assert la.pairs(df.limit(0), "chunk_id", "text", "created_at", {}).count() == 0


def test_many_copies_make_no_pairs_with_each_other(spark):
    df = spark.range(3000).selectExpr("cast(id as string) chunk_id", "case when id = 7 then 'аb' else 'ab' end text", "timestamp'2020-01-01' created_at")
    got = la.pairs(df, "chunk_id", "text", "created_at", la.code_points([(df, "text")]))
    assert got.count() == 2999


def test_references(spark):
    df = spark.createDataFrame([("f1", "1. ＶＡＴ 환급"), ("f2", "2) VAT 환급"), ("f3", "VAT 환급"), ("f4", "VАT 환급"), ("f5", None), ("f6", "VAT환급"), ("f4", "VАT 환급")], "finding_id string, item string")
    ref = spark.createDataFrame([("1", "VAT 환급"), ("2", None)], "code string, item string")
    counts = la.code_points([(df, "item"), (ref, "item")])
    assert {tuple(r) for r in la.references(df, "finding_id", "item", ref, "code", "item", counts).collect()} == {("f1", "1"), ("f4", "1")}
