import zlib

import numpy as np
import pytest

from reelframe.llm import language

SYLLABLES = {"en": ["the", "ing", "and", "er"], "de": ["sch", "ung", "ein", "ä"], "fr": ["eau", "oi", "é", "que"], "es": ["ción", "ar", "ñ", "ez"], "tlh": ["q'a", "vlh", "tgh"]}


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(1)
    rows = [
        (i, " ".join("".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(rng.integers(8, 60))), lang, "s")
        for i in range(600) for lang in [list(SYLLABLES)[i % 5]]
    ]
    rows += [(700, None, "en", "s"), (701, "12 34 !?", "en", "s"), (702, "", "de", "s"), (None, "the and ing", "en", None), (703, "the ing", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'x' AS score", "'y' AS lang_pred", "'z' AS text_")


def test_held_out_accuracy(labelled):
    model = language.train(labelled)
    assert model.family.classes == ["germanic", "others 0", "romance"]
    got = {r.doc_id: r for r in language.identify(labelled, model).collect()}
    truth = {r.doc_id: r.lang for r in labelled.collect()}
    assert len(got) == 605
    for i, r in got.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    unseen = [i for i, r in got.items() if r.held_out and i < 600]
    assert len(unseen) > 100 and np.mean([got[i].lang_pred == truth[i] for i in unseen]) > 0.98
    assert [(got[i].lang_pred, got[i].score) for i in (700, 701, 702)] == [("und", 0.0)] * 3


def test_rejected_documents_go_and_others_stay_as_they_are(labelled):
    model = language.train(labelled)
    kept = language.keep_identified(labelled, model)
    assert kept.columns == labelled.columns
    assert sorted(map(str, kept.collect())) == sorted(map(str, labelled.where("doc_id is null or doc_id not in (700, 701, 702)").collect()))


def test_training_sees_neither_held_out_rows_nor_other_columns(labelled):
    from pyspark.sql import functions as F

    other = labelled.withColumn("lang", F.when(language.held_out(F.col("doc_id")), F.lit("zz")).otherwise(F.col("lang")))
    a, b = language.train(labelled), language.train(other)
    assert b.family.classes == a.family.classes and np.array_equal(a.family.weights, b.family.weights)


def test_features_in_chunks_agree(monkeypatch):
    for text in ("Été — où l'eau,  schön 123 end " * 50, "a", "  b  ", "Σας ΟΔΟΣ" * 30, "İI" * 40):
        monkeypatch.setattr(language, "CHUNK", 1 << 20)
        whole = language.features(text)
        for chunk in (1, 2, 3, 7, 997):
            monkeypatch.setattr(language, "CHUNK", chunk)
            assert np.array_equal(language.features(text), whole)
    assert language.features("1 2") is None


def test_features_against_brute_force():
    text = "Ab, ça!  x"
    plain = " ab ça x"
    total = np.zeros((language.ORDERS, language.BUCKETS))
    for k in range(language.ORDERS):
        for i in range(len(plain) - k):
            gram = 0
            for c in plain[i : i + k + 1]:
                gram = (gram * 0x01000193 ^ ord(c) * 0x9E3779B1) % 2**32
            total[k, (gram * 0x85EBCA6B) % 2**32 >> 21] += 1
    want = np.sqrt(total / total.sum(1, keepdims=True) / language.ORDERS).astype(np.float32).ravel()
    assert np.allclose(language.features(text), want)


def test_a_hot_repeated_text_hides_no_label(spark):
    words = {"es": "cada gato come pan", "en": "the cat eats bread and"}
    rows = [(i, words["es"], "es") for i in range(20_000)] + [(100_000 + i, words["en"] + " " + "x" * (i % 40), "en") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert sorted(c for w in model.within.values() for c in w.classes) == ["en", "es"]
    got = {r.doc_id: r.lang_pred for r in language.identify(df, model).where("doc_id in (1, 100001)").collect()}
    assert got == {1: "es", 100_001: "en"}


def test_no_cap_on_labels(spark):
    rng = np.random.default_rng(3)
    rows = []
    for k in range(60):
        own = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(4)]
        rows += [(k * 100 + i, " ".join(rng.choice(own, 12)), f"l{k:02d}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert len({c for w in model.within.values() for c in w.classes}) == 60
    got = language.identify(df, model).where("held_out").collect()
    assert np.mean([r.lang_pred == f"l{r.doc_id // 100:02d}" for r in got]) > 0.8


def test_one_label_and_no_label(spark, none):
    one = spark.createDataFrame([(i, "some words here", "en") for i in range(4)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify(one, language.train(one)).collect()} == {("en", 1.0)}
    model = language.train(none)
    assert language.identify(none, model).count() == 0 and language.identify(one, model).first().lang_pred == "und"


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x @ [1, -2, 0, 0.5, 0] > 0.3, 1.0, -1.0)
    w = language.train_svm(x, y)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.97
