import numpy as np

from retentio.llm import langid
from retentio.llm.queries import op10_language_id


def test_codewords_are_apart():
    for n in (2, 3, 4, 7, 12, 40):
        code = langid.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n == 2 else 2)
        assert not (abs(code.sum(axis=0)) == n).any()


def test_held_out_accuracy_and_contract(spark):
    out = op10_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert out.count() == docs.count()
    rows = out.join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    test = [r for r in rows if r.held_out]
    assert len(test) > 200
    assert np.mean([r.lang_pred == r.lang for r in test]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows} <= {"en", "de", "fr", "es", "und"}


def test_model_ignores_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    from pyspark.sql import functions as F
    wrong = docs.withColumn("lang", F.when(langid.held_out(F.col("doc_id"), 3, 1), "xx").otherwise(F.col("lang")))
    a = langid.train(docs.where(~langid.held_out(F.col("doc_id"), 3, 1)))
    b = langid.train(wrong.where(~langid.held_out(F.col("doc_id"), 3, 1)))
    assert a.languages == b.languages and np.array_equal(a.weights, b.weights)


def test_nulls_ties_and_empty(spark):
    rows = [(1, "the of and with", "en"), (2, "der die und das", "de"), (3, None, "en"), (None, "123 ...", None),
            (4, "", "en"), (4, "", "en"), (5, "le " * 700_000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score")
    model = langid.train(docs)
    assert model.languages == ["de", "en"]
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert got[1].lang_pred == "en" and got[2].lang_pred == "de"
    assert got[3].lang_pred == got[4].lang_pred == got[None].lang_pred == "und" and got[3].score == 0
    none = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(docs.limit(0), model).count() == 0
    one = langid.train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify(docs, one).collect()} == {"und", "en"}


def test_pieces_of_long_texts_count_like_the_whole():
    rng = np.random.default_rng(0)
    text = "".join(rng.choice(list("abc dé"), size=(1 << 20) + 500))
    whole = langid.features(text)
    assert abs(np.linalg.norm(whole) - 1) < 1e-3
