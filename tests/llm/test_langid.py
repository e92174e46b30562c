"""Languages: sentences, mixed documents, labels, held-out accuracy."""

import os
import unicodedata

import numpy as np
import pytest

from docloom.llm import langid

CODES = [("ko", "kor", "Korean"), ("en", "eng", "English"), ("de", "deu", "German"), ("fr", "fra", "French"), ("ja", "jpn", "Japanese"), ("zh", "zho", "Chinese"), ("sv", "swe", "Swedish")]
TEXT = {
    "ko": ["조사팀은 거래처 원장을 모두 제출받아 확인하였다.", "창고에는 물건이 거의 남아 있지 않았다.", "대표이사의 계좌로 돈이 입금되었다."],
    "en": ["The auditors compared the ledger with the bank statement.", "Only a few items were left in the warehouse.", "The money was paid into the account of the manager."],
    "de": ["Die Prüfer haben die Bücher mit dem Kontoauszug verglichen.", "Im Lager waren nur noch wenige Artikel vorhanden.", "Das Geld wurde auf das Konto der Leitung überwiesen."],
    "fr": ["Les inspecteurs ont comparé les livres avec le relevé bancaire.", "Il ne restait que peu d'articles dans l'entrepôt.", "L'argent a été versé sur le compte de la direction."],
    "ja": ["調査担当者は帳簿と入金明細を一つずつ照らし合わせました。", "倉庫に残っていた品目はわずかでした。", "お金は社長の口座に入金されていました。"],
    "zh": ["检查人员核对了账簿和银行入账单。", "仓库里只剩下很少的货物。", "这笔钱被存入了经理的账户。"],
}


@pytest.fixture(scope="module")
def docs(spark):
    rows, n = [], 0
    for lang, sents in TEXT.items():
        for i in range(40):
            rows.append((n, " ".join(sents[(i + j) % 3] for j in range(2)), lang if i % 8 else "sv", "x"))
            n += 1
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, named string")


@pytest.fixture(scope="module")
def codes(spark):
    return spark.createDataFrame(CODES, "lang string, iso3 string, name_en string")


@pytest.fixture(scope="module")
def model(docs, codes):
    return langid.fit_on(docs, codes)


def langs(model, text):
    parts = [p for _, _, p in langid.segments(langid.mask(langid.clean(text)))]
    return {model.languages[i] for i in model.decide(parts)[0]}


def test_a_label_that_is_always_wrong_is_no_language(model):
    assert sorted(model.languages) == ["de", "en", "fr", "ja", "ko", "zh"]


def labelled(**docs):
    """Sentences and labels: (number of documents, language of the text) under each label, three sentences a document."""
    return [(s, y) for y, kinds in docs.items() for n, lang in kinds for _ in range(n) for s in {**TEXT, "sv": SWEDISH}[lang]]


SWEDISH = ["Granskarna jämförde räkenskaperna med kontoutdraget.", "Bara några få varor fanns kvar i lagret.", "Pengarna betalades in på chefens konto."]


@pytest.mark.parametrize("n", [1, 2, 3, 4, 13, 600])
def test_codewords_differ(n):
    m = langid.Codes(n).matrix
    assert len({tuple(r) for r in m.tolist()}) == n and (n == 1 or (abs(m.sum(0)) < n).all())


def test_too_many_languages_for_the_codewords():
    with pytest.raises(ValueError):
        langid.Codes(17, bits=4)


def test_two_languages_and_one():
    two = langid.fit(*zip(*labelled(ko=[(40, "ko"), (2, "en")], en=[(40, "en"), (2, "ko")])))
    assert two.languages == ["en", "ko"] and np.isfinite(two.weights).all()
    assert all(langs(two, s) == {lang} for lang in two.languages for s in TEXT[lang])
    one = langid.fit(*zip(*labelled(ko=[(40, "ko")])))
    assert np.isfinite(one.weights).all() and langs(one, TEXT["ko"][0]) == {"ko"}


def test_a_rare_language_among_wrong_labels():
    """10 Swedish documents beside 30 of other languages under the label: it stays; without them it is dropped."""
    rest = {lang: [(60, lang)] for lang in TEXT}
    wrong = [(5, lang) for lang in TEXT]
    with_it = langid.fit(*zip(*labelled(**rest, sv=[*wrong[:3], (10, "sv"), *wrong[3:]])))
    assert "sv" in with_it.languages
    assert all(langs(with_it, s) == {lang} for lang, t in {**TEXT, "sv": SWEDISH}.items() for s in t)
    assert "sv" not in langid.fit(*zip(*labelled(**rest, sv=wrong))).languages


@pytest.mark.parametrize("lang", TEXT)
def test_sentences(model, lang):
    assert all(langs(model, s) == {lang} for s in TEXT[lang])


def test_other_writings(model):
    assert langs(model, TEXT["en"][0].upper()) == {"en"}
    assert langs(model, "Ｔｈｅ ａｕｄｉｔｏｒｓ ｃｏｍｐａｒｅｄ ｔｈｅ ｌｅｄｇｅｒ ｗｉｔｈ ｔｈｅ ｓｔａｔｅｍｅｎｔ.") == {"en"}
    assert langs(model, "​".join(TEXT["de"][1])) == {"de"}
    assert langs(model, TEXT["ko"][0].replace(" ", "")) == {"ko"}
    assert langs(model, TEXT["fr"][1].replace("e", "е")) == {"fr"}


def test_mixed(model):
    assert langs(model, TEXT["ko"][0] + " " + TEXT["de"][0] + "\n" + TEXT["ja"][0]) == {"ko", "de", "ja"}
    assert langs(model, TEXT["ko"][0][:-1] + " " + TEXT["fr"][0]) == {"ko", "fr"}


def test_no_stops_at_all(model):
    text = " ".join(x.rstrip(".") for x in TEXT["en"] * 6) + " " + " ".join(x.rstrip(".") for x in TEXT["de"] * 6)
    assert langs(model, text) == {"en", "de"}
    parts = langid.segments("가" * 5000)
    assert len(parts) > 10 and "".join(p for _, _, p in parts) == "가" * 5000


@pytest.mark.parametrize("text", ["", " ", "12,400 / 3.5 %", "2021-04 : 33", "doc: 2020S-213-6 | ERP, VAT, PG | Kymbra", "...", "ERP VAT", "미르푸드"])
def test_no_sentence(text):
    assert langid.segments(langid.clean(text)) == []


def test_names_inside_a_sentence_stay_with_it(model):
    assert langs(model, "Sandreth 및 Tessory 사이의 거래는 시가보다 낮은 가격으로 이루어졌다.") == {"ko"}
    assert langs(model, "LuranoはHalvernに対して市場価格より安い値段で商品を売っていました。") == {"ja"}


LABELS = {"ko": "ko", " KO ": "ko", "kor": "ko", "Korean": "ko", "ko-KR": "ko", "ko_KR": "ko", "en-us": "en", "zh-Hans-CN": "zh", "xx": None, "": None, None: None, "unknown": None, "korea": None, "ko-": None}


def test_labels(spark, codes):
    df = spark.createDataFrame([(k,) for k in LABELS], "l string")
    got = {r.l: r.y for r in df.select("l", langid.label_language(df["l"], codes).alias("y")).collect()}
    assert got == LABELS


def test_cases(spark, docs, codes):
    base = 10_000
    more = [(base, TEXT["ko"][0], "en", "x"), (base + 1, TEXT["ko"][0] + " " + TEXT["en"][0], "ko", "x"), (base + 2, TEXT["ko"][0], "KOR", "x"), (base + 3, None, "ko", "x"), (base + 4, "", None, "x"), (base + 5, "12 %", "en", "x"), (base + 6, TEXT["fr"][0], None, "x"), (base + 7, TEXT["fr"][0] * 3000, "de", "x")]
    all_docs = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = {(r.doc_id - base, r.lang) for r in langid.wrong_labels(all_docs, codes).where(f"doc_id >= {base}").collect()}
    assert got == {(0, "ko"), (1, "ko"), (1, "en"), (6, "fr"), (7, "fr")}
    assert langid.wrong_labels(docs.limit(0), codes).count() == 0


def test_segments(spark, model, docs):
    df = spark.createDataFrame([(1, TEXT["ko"][0] + " " + TEXT["ko"][1] + "\n" + TEXT["de"][0]), (2, None)], "doc_id long, text string")
    rows = langid.label_segments(df, model).orderBy("seg_no").collect()
    assert [(r.seg_no, r.lang) for r in rows] == [(1, "ko"), (2, "de")] and all(0.5 < r.confidence <= 1 for r in rows)
    got = {r.lang: r.share for r in langid.document_languages(langid.label_segments(df, model)).collect()}
    assert round(sum(got.values()), 6) == 1 and set(got) == {"ko", "de"}


def test_every_text_has_a_language(spark, model):
    """Texts without a full sentence come out as well, flagged; only blank ones don't."""
    texts = {1: "감사합니다", 2: "12,400 %", 3: "", 4: " \n", 5: None, 6: "We paid it.", 7: TEXT["ko"][0]}
    df = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.label_segments(df, model).collect()}
    assert set(got) == {1, 2, 6, 7}
    assert (got[1].lang, got[1].ambiguous, got[1].sentence) == ("ko", True, False) and got[6].lang == "en" and not got[6].sentence
    assert (got[2].lang, got[2].confidence, got[2].ambiguous) == ("und", 0.0, True) and got[7].sentence


def test_all_letters_of_a_text_without_sentences_are_judged(spark, model):
    """Neither figures nor a beginning in another language decide, however long they are."""
    figures = "12,400 | 3.5 % | " * 60
    short = {"de": "Das Konto der\n", "en": "The ledger of\n", "ko": "거래처 원장\n"}
    texts = {1: (figures + short["de"], "de"), 2: (figures + short["ko"], "ko"), 3: (short["en"] * 20 + short["de"] * 200, "de"), 4: (short["de"] * 20 + short["en"] * 200, "en"), 5: (short["ko"] * 40 + short["en"] * 400, "en")}
    df = spark.createDataFrame([(k, t) for k, (t, _) in texts.items()], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.label_segments(df, model).collect()}
    assert {k: (r.lang, r.start, r.end, r.sentence) for k, r in got.items()} == {k: (lang, 0, len(t), False) for k, (t, lang) in texts.items()}


def test_long_texts_are_judged_block_by_block(model, monkeypatch):
    texts = ["Das Konto der " * 300 + "The ledger", "거래처 원장 " * 77, "a" * 1001]
    want = [model.margins([t]) for t in texts]
    memo = {}
    for block in (1, 7, 100, 1000):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert all(np.allclose(model.margins([t]), w, atol=1e-3) for t, w in zip(texts, want))
        assert np.allclose(model.margins(texts), np.concatenate(want), atol=1e-3)
        langid._label_batch(model, ["The ledger\n" * 300], memo, {})
    assert max(map(len, memo), default=0) <= 2 * langid.WINDOW


def test_segments_cut_the_text_itself(spark, model):
    """Places are those of the text as it is, however its characters are written."""
    parts = ["Ｔｈｅ ａｕｄｉｔｏｒｓ ｃｏｍｐａｒｅｄ ｔｈｅ ｌｅｄｇｅｒ ｗｉｔｈ ｔｈｅ ｓｔａｔｅｍｅｎｔ㎏.", "\u200b".join(TEXT["ko"][0]), unicodedata.normalize("NFD", TEXT["fr"][0]), TEXT["de"][0]]
    text = " ".join(parts)
    rows = langid.label_segments(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).orderBy("seg_no").collect()
    assert [r.lang for r in rows] == ["en", "ko", "fr", "de"]
    assert [text[r.start : r.end].strip(" .") for r in rows] == [p.strip(" .") for p in parts]


def test_a_language_with_a_quarter_of_its_labels_right():
    rest = {lang: [(60, lang)] for lang in TEXT}
    m = langid.fit(*zip(*labelled(**rest, sv=[(15, "sv"), *[(9, x) for x in list(TEXT)[:5]]])))
    assert "sv" in m.languages and all(langs(m, s) == {"sv"} for s in SWEDISH)


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    """Documents of one language with a usable label, by another sample than the fit: nearly all get their label or are mislabelled."""
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    codes = spark.read.parquet(f"{DATA}/lang_codes.parquet")
    odd, even = d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0")
    model = langid.fit_on(odd, codes)
    got = langid.document_languages(langid.label_segments(even, model)).where("share = 1.0").join(even.select("doc_id", langid.label_language(even["lang"], codes).alias("named")), "doc_id").where("named is not null").toPandas()
    assert len(got) > 150 and (got.lang == got.named).mean() > 0.9
