"""Encoding against a public encoder and as a round trip; packing: whole, within capacity, little unused."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import bpe, packing

RANKS = bpe.DEFAULT_RANKS
pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no vocabulary")


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.load_ranks(RANKS), keep=50)


@pytest.fixture(scope="module")
def oracle():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


def check(enc, oracle, texts):
    ids, off = enc.encode(texts)
    want = [oracle.encode_ordinary(t) if t else [] for t in texts]
    assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:])] == want
    assert enc.lengths(texts).tolist() == [len(w) for w in want]


def test_texts(enc, oracle):
    check(enc, oracle, ["", None, " ", "\n\n  \n", "<|endoftext|>", "가나다 라마 123 it's", "é​ ﷺ 😀👩‍👩‍👧", "a" * 9000, "가" * 3000, "ab" * 40 + "가나" * 90, "x" * 2047 + " " + "y" * 2049])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60), max_size=5))
def test_any_text(enc, oracle, texts):
    check(enc, oracle, texts)


def one_at_a_time(ranks, word):
    """Brute force: the leftmost pair of lowest rank, until there is none."""
    parts = [bytes([b]) for b in word]
    while True:
        r, i = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 30, 0))
        if r == 1 << 30:
            return [ranks[p] for p in parts]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@settings(max_examples=200, deadline=None)
@given(st.permutations(["ab", "ba", "aba", "bab", "aab", "abab", "cc", "cab", "abc"]), st.text("abc", max_size=40))
def test_long_rows_by_any_ranks(order, text):
    # ranks in any order, so that merges may make pairs that come first
    ranks = {bytes([i]): i for i in range(256)} | {t.encode(): 256 + i for i, t in enumerate(order)}
    b = bpe.Bpe(ranks)
    want = one_at_a_time(ranks, text.encode())
    assert b._long(text.encode()).tolist() == want
    assert b.encode_words([text.encode()])[0].tolist() == want


def test_a_very_long_row(enc, oracle):
    g = np.random.default_rng(4)
    word = "".join(g.choice(list("가나다라마바사아자차카타파하의은는이를"), 40_000).tolist())
    check(enc, oracle, [word, "a" * 30_001])


def test_long_rows_and_matrices_agree(enc):
    g = np.random.default_rng(0)
    for n in (5, 17, 64, 300, 2000):
        w = bytes(g.choice(list(b"abcdeilnorst "), n).tolist())
        flat, count = enc.bpe.encode_words([w, b""])
        assert flat.tolist() == enc.bpe._long(w).tolist() and count.tolist() == [len(flat), 0]


def test_columns(spark):
    df = spark.createDataFrame([(1, "가나 abc", "x"), (2, "", "x"), (3, None, "x"), (4, "가나 abc", "x")], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in bpe.encode_column(df).collect()}
    assert got[2] == [] and got[3] == [] and got[1] == got[4] and len(got[1]) > 2
    assert {r.doc_id: r.n_tokens for r in bpe.count_column(df).collect()} == {k: len(v) for k, v in got.items()}
    assert bpe.encode_column(df.limit(0)).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit(sizes):
    bins = packing.best_fit(sizes, 64)
    fill = np.bincount(bins, weights=sizes) if sizes else []
    assert all(0 < f <= 64 for f in fill)


def test_packing(spark):
    g = np.random.default_rng(1)
    items = [(f"i{i}", int(n)) for i, n in enumerate(g.integers(1, 3000, 9000))] + [("null", None), ("zero", 0)]
    df = spark.createDataFrame(items, "item string, size long").repartition(6)
    out = packing.pack(df, group=1500).toPandas()
    assert sorted(out["item"]) == sorted(k for k, n in items if n)
    fill = out.groupby("bin")["size"].sum()
    assert fill.max() <= 4096 and (out.groupby("bin")["fill"].first() == fill).all()
    assert fill.sum() / (len(fill) * 4096) > 0.98
    assert packing.pack(df.limit(0)).count() == 0


def test_documents(spark):
    df = spark.createDataFrame([(1, "가나다라 " * 4000, 5), (2, "", 5), (3, None, 5), (4, "short", 5), (5, "short", 5), (None, "no key", 5)], "doc_id long, text string, size int")
    out = packing.pack_documents(df, capacity=512).toPandas()
    n = {r.doc_id: r.n_tokens for r in bpe.count_column(df).collect()}
    assert set(out["doc_id"]) == {1, 4, 5}
    for k, rows in out.groupby("doc_id"):
        rows = rows.sort_values("piece_no")
        assert rows["n_tokens"].sum() == n[k] and rows["piece_no"].tolist() == list(range(1, len(rows) + 1))
        assert rows["start_token"].tolist() == [0, *rows["n_tokens"].cumsum().tolist()[:-1]]
        assert len(rows) == -(-n[k] // 512)
    assert (out.groupby("container")["n_tokens"].sum() <= 512).all()
    assert (out.groupby("container")["n_tokens"].sum() == out.groupby("container")["container_tokens"].first()).all()
