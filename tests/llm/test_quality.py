import re

import numpy as np

from retentio.llm import linear, quality, quality_rules
from retentio.llm import textfeat as tf
from retentio.llm.queries import op4_quality_rules, op6_quality_classifier

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    cover = set()
    for i, g in enumerate(grams):
        if grams.count(g) > 1:
            cover |= {i, i + 1, i + 2}
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover))


def test_base_measures_against_brute_force():
    texts = ["", " ", "a b c a b c a b", "é x é x\n\n\nz\nz\nz ", "a a a a", "x\ty\x0bz\x0c", "##* $ | <>&%",
             "one two three\none two three\n one two three", "\r\n\r\n a\r\na\r\n", "a b", "你好 🙂 你好 🙂 你好 🙂"]
    group = [t.encode() for t in texts]
    c = quality_rules.counts(tf.words(group), group)
    for i, t in enumerate(texts):
        assert tuple(int(c[k][i]) for k in quality_rules.COUNTS) == brute(t), t


def test_rules_query(spark):
    out = {r.doc_id: r for r in op4_quality_rules(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(out) == len(docs)
    kept = {0: [], 1: []}
    for d in docs:
        r = out[d.doc_id]
        if len(d.text) < 6000:
            n, _, _, _, repeat = want = brute(d.text)
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (r.base_failed and r.kept)
        if d.doc_id in labels and not r.base_failed:
            kept[labels[d.doc_id]].append(r.kept)
    assert np.mean(kept[1]) > 0.97 and np.mean(kept[0]) < 0.1


def test_classifier_query(spark):
    out = {r.doc_id: r for r in op6_quality_classifier(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(x.quality, out[x.doc_id].predicted) for x in labels if out[x.doc_id].held_out]
    assert len(held) > 50 and np.mean([a == b for a, b in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())


def test_nulls_repeats_long_and_empty(spark):
    rows = [(1, None, 0), (None, "a b", 1), (2, "", 0), (2, "", 0), (3, "word " * 300_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, 1), (3, 0), (None, 1), (1, None)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    assert quality.score(docs, model, ["doc_id"]).count() == 5
    rules = quality_rules.train(docs, labels)
    got = quality_rules.judge(docs, rules).collect()
    assert sum(r.base_failed for r in got) == 5 and max(r.n_words for r in got) == 300_000
    empty = labels.limit(0)
    assert {r.score for r in quality.score(docs, quality.train(docs, empty), ["doc_id"]).collect()} == {0.5}
    assert quality_rules.judge(docs.limit(0), quality_rules.train(docs, empty)).count() == 0


def test_views_score_like_sparse_rows():
    group = ["Ab cd cd, 12 é".encode(), b"", b"x", b"the the THE the!! " * 50]
    w = tf.words(group)
    views = linear.word_views(w, 12) + linear.char_views(w, group, 12)
    weights = np.random.default_rng(0).normal(size=1 << 12).astype(np.float32)
    fast = linear.scores(views, weights, 0.5)
    for i in range(len(group)):
        k, x = linear.sparse_row(views, i)
        assert abs(fast[i] - (weights[k] @ x + 0.5)) < 1e-4
        alone = tf.words([group[i]])
        one = linear.word_views(alone, 12) + linear.char_views(alone, [group[i]], 12)
        assert abs(linear.scores(one, weights, 0.5)[0] - fast[i]) < 1e-4


def test_platt_and_ftrl_learn():
    rng = np.random.default_rng(1)
    f = rng.normal(size=4000)
    y = (rng.random(4000) < linear.sigmoid(2 * f - 1)).astype(float)
    a, b = linear.platt(f, y)
    assert abs(a - 2) < 0.3 and abs(b + 1) < 0.3
    keys = [np.array([int(rng.integers(0, 5)) + 10 * int(c)]) for c in (y > 0)]
    w, bias = linear.ftrl(linear.Rows(keys, [np.ones(1)] * len(y), y), 32)
    assert np.mean([(w[k[0]] + bias > 0) == (c > 0) for k, c in zip(keys, y)]) == 1
