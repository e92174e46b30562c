"""Plans of questions and their hooks, caches, stores by address, and the small functions of an answer."""

import pytest
from pyspark.sql import functions as F

from docloom.functions import text as tx
from docloom.functions import vector as vx
from docloom.operators import rank, retrieve, store
from docloom.plans import answer, question
from docloom.plans.cache import Cache
from docloom.runtime import clean_up, materialize
from docloom.sources import files

VOCABULARY = {"domain": {"계좌": ["통장"], "비용": ["외주"]}, "action": {"누락": []}}


def test_batches_plan_as_single_questions_do(spark):
    texts = ["통장 누락 31322 확인 방법", "무엇인지 정의", "", None, "외주 통장 누락 알려줘", "가"]
    got = {r.q: r for r in question.plans(spark.createDataFrame(list(enumerate(texts)), "q int, text string"), VOCABULARY).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        one = question.plan(t or "", r.plain, r.script, VOCABULARY)
        assert (r.intent, r.code, r.route, r.confidence) == (one.intent, one.slots.code, one.route, one.slots.confidence)
        assert {k: r[k] for k in VOCABULARY} == dict(one.slots.labels) and tuple(r.must) == tuple(one.expansion.must)
    assert question.plans(spark.createDataFrame([], "q int, text string"), VOCABULARY).count() == 0


def test_slot_hook():
    plan = lambda f: question.plan("통장 31322", "통장 31322", "ko", VOCABULARY, slotter=f).slots
    assert plan(lambda t: {"domain": "비용", "action": ["누락", 3, " "], "code": "99999"}).labels == {"domain": ["비용"], "action": ["누락"]}
    assert plan(lambda t: {"domain": [], "code": "99999"}).labels["domain"] == ["계좌"]  # rules where the hook names nothing
    assert plan(lambda t: {"domain": ["비용"], "code": "99999"}).code == "31322"
    assert plan(lambda t: 1 / 0).labels["domain"] == ["계좌"]
    assert question.plan("x", "x", "en", VOCABULARY, slotter=lambda t: {"code": "12345"}).slots.code == "12345"


def test_prompts_and_clarification():
    assert question.vocabulary_prompt(VOCABULARY, {"domain": (1, 1)}) == "domain: 계좌 (통장)\naction: 누락 ()"
    s = question.slots_of("통장", VOCABULARY)
    assert question.clarification(s, {"domain": "어느 분야?", "action": "어느 조치?"}) == "어느 조치?"
    assert rank.keyword_roles(["a"]) == (None, ["a"]) and rank.keyword_roles(["a", "b"]) == ("a", ["b"])
    assert answer.counts_line(["a", "b"], [1, 2]) == "a: 1, b: 2" and answer.counts_line(["a"], [1]) == ""


def test_cache():
    made = []
    c = Cache(2)
    get = lambda k: c.get(k, lambda: made.append(k) or k.upper())
    assert [get(k) for k in "abacab"] == list("ABACAB")
    assert made == ["a", "b", "c", "a", "b"] and len(c) == 2  # the first goes first, used or not
    assert Cache.key("q", ["2", "1", "1"]) == Cache.key("q", ["1", "2"]) != Cache.key("q", ["1"])
    with pytest.raises(ZeroDivisionError):
        c.get("z", lambda: 1 / 0)
    assert len(c) == 2


def test_stores_by_address(spark, tmp_path):
    df = spark.createDataFrame([("a", [1.0])], "id string, vector array<float>")
    for address in (":memory:", f"path:{tmp_path}/v"):
        v = files.Vectors(spark, address, "points_of_test")
        v.write(df)
        v.write(v.read().unionByName(df))  # reads what it replaces
        assert v.read().count() == 2
    with pytest.raises(ValueError):
        files.Vectors(spark, "ftp://x")
    store.ensure_collection(spark, f"{tmp_path}/c", 8)
    with pytest.raises(ValueError):
        store.ensure_collection(spark, f"{tmp_path}/c", 9)


def test_bool_search(spark):
    rows = [("1", "가 나", 1), ("2", "가", 1), ("3", "나 다", 1), ("4", None, 1), (None, "가 나", 1), ("5", "가 나", 1), ("5", "다", 2)]
    df = spark.createDataFrame(rows, "k string, t string, at int")
    ids = lambda *a, **k: sorted(r.id for r in retrieve.bool_search(df, "k", *a, {"t": 1.0}, at="at", **k).collect())
    assert ids(["가"], ["나"], minimum=1) == ["1"] and ids(["가"], ["나"]) == ["1", "2"]
    assert ids([], ["가", "다"]) == ["1", "2", "3", "5"] and ids([], []) == []
    got = df.where(retrieve.conditions({"k": "1"}, any_of=[{"t": "가"}, {"at": 1}])).count()
    assert got == 1 and df.where(retrieve.conditions(any_of=[])).count() == len(rows)


def test_vectors_of_records(spark):
    rows = [("a", [1.0, 0.0], 1), ("a", None, 2), ("b", [1.0, 1.0], 1), ("b", [0.0, 1.0], 2), ("c", [0.0, 0.0], 1), ("d", [float("nan"), 1.0], 1), ("e", [2.0, 0.0], 1), ("f", [1.0], 1)]
    df = spark.createDataFrame(rows, "k string, vector array<float>, at int")
    got = [(r.id, round(r.score, 6)) for r in retrieve.vector_top(df, [1.0, 0.0], 3, "k", at="at").collect()]
    assert got == [("e", 1.0), ("b", 0.0)]
    assert [r.id for r in retrieve.vector_top(df, [1.0, 0.0], 2, "k").collect()] == ["a", "e"]  # ties by key
    assert retrieve.vector_top(df, [0.0, 0.0], 2, "k").count() == 0 and retrieve.vector_top(df.limit(0), [1.0, 0.0], 2, "k").count() == 0
    assert df.select(F.round(vx.cosine("vector", vx.literal([1.0, 0.0])), 6).alias("c")).first().c == 1.0


def test_case_by_prefix(spark):
    df = spark.createDataFrame([("x", ["31201"]), ("외주", []), (None, None), ("y", ["99"])], "t string, c array<string>")
    rules = [([["매출"]], "a", 0.8, "312"), ([["외주"]], "b", 0.7)]
    assert [r.c.label for r in df.select(tx.first_case("t", rules, "c").alias("c")).collect()] == ["a", "b", None, None]


def test_clean_up(spark):
    clean_up(spark)
    m = materialize(spark.range(3).toDF("n"), "x")
    assert m.count() == 3 and clean_up(spark) == 1 and clean_up(spark) == 0
    assert rank.blend({}) is not None
