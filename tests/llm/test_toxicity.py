import random

import numpy as np
from pyspark.sql import functions as F

from retentio.llm import toxicity, training
from retentio.llm.queries import op12_toxicity

SF = "/root/testdata/sf0.1"


def brute_segments(s):
    """Maximal scoring segments by their definition: the best one (shortest, leftmost), then left and right of it."""
    best = None
    for i in range(len(s)):
        total = 0
        for j in range(i, len(s)):
            total += s[j]
            if total > 0 and (best is None or total > best[2] or (total == best[2] and j + 1 - i < best[1] - best[0])):
                best = (i, j + 1, total)
    if best is None:
        return []
    a, b, _ = best
    right = [(x + b, y + b, t) for x, y, t in brute_segments(s[b:])]
    return brute_segments(s[:a]) + [best] + right


def test_segments_against_definition():
    rng = random.Random(3)
    for _ in range(400):
        # distinct powers keep sums apart, so the definition has one answer
        s = [rng.choice([-1, -1, 1]) * (1 + rng.random()) for _ in range(rng.randrange(0, 25))]
        got = toxicity.segments(np.array(s))
        want = brute_segments(s)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert np.allclose([t for *_, t in got], [t for *_, t in want])


def test_segments_are_linear():
    s = np.tile([1.0, -1.0, 1.5, -1.4], 100_000)
    assert len(toxicity.segments(s)) >= 1
    assert len(toxicity.segments(np.tile([1.0, -2.0], 200_000))) == 200_000


def test_rate_solves_its_equation():
    scores, weights = np.array([-1.0, -0.5, 2.0]), np.array([60.0, 30.0, 10.0])
    rate = toxicity._root(scores, weights)
    assert abs((weights / 100 * np.exp(rate * scores)).sum() - 1) < 1e-6


def words(ids):
    return " ".join(f"{'abcdefghij'[i % 10]}{i}" for i in ids).encode()


def test_extreme_values_bound_chance_segments():
    """In clean text, segments as strong as the limit are about as rare as the calibration says."""
    rng = np.random.default_rng(5)
    clean = [rng.integers(0, 2000, rng.integers(50, 800)) for _ in range(1500)]
    toxic = [np.concatenate([rng.integers(0, 2000, 200), rng.integers(5000, 5010, 3)]) for _ in range(150)]
    model = toxicity.fit([words(t) for t in clean + toxic], np.array([0.0] * len(clean) + [1.0] * len(toxic)))

    def found(ids):
        h, _ = toxicity.tokens([words(ids)])
        return toxicity.evidence(toxicity.segments(toxicity.token_scores(h, model)), len(ids), model)

    hits = [len(found(rng.integers(0, 2000, 400))[0]) for _ in range(1000)]
    assert np.mean(hits) < 2 * toxicity.MAX_EXPECTED
    for _ in range(50):
        t = np.concatenate([rng.integers(0, 2000, 300), rng.permutation(np.arange(5000, 5010))[:3], rng.integers(0, 2000, 300)])
        assert any(a < 303 and b > 300 for a, b, _ in found(t)[0])


def test_unknown_words_take_the_value_of_their_beginning():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 300, 60)) + (f" vilest{i}" if i % 5 == 0 else "") for i in range(300)]
    model = toxicity.fit([t.encode() for t in texts], np.array([float(i % 5 == 0) for i in range(300)]))
    h, _ = toxicity.tokens([b"Vilestnew w5 quite unknown"])
    score = toxicity.token_scores(h, model)
    assert score[0] > 1 and (score[1:] < 0).all()


def test_query_on_held_out_labels(spark):
    out = {r.doc_id: r for r in op12_toxicity(spark, SF).collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [(x.toxic, out[x.doc_id].predicted) for x in labels if x.doc_id in out and out[x.doc_id].held_out]
    bad, good = [p for t, p in held if t], [p for t, p in held if not t]
    assert len(bad) > 50 and np.mean(bad) > 0.9 and np.mean(good) < 0.01  # 5 of the 120 hold no toxic word
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())


def test_nulls_repeats_long_and_empty(spark):
    rows = [(1, None, 0), (None, "a b", 1), (2, "", 0), (2, "", 0), (3, "vile word " * 200_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int").withColumn("passages", F.lit(1))
    labels = spark.createDataFrame([(2, 0), (3, 1), (None, 1), (1, None), (3, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.detect(docs, model, ["doc_id", "score"]).collect()
    assert len(got) == 5 and max(r.n_tokens for r in got) == 400_000 and all(0 <= r.score <= 1 for r in got)
    flat = toxicity.train(docs, labels.limit(0))
    assert {r.score for r in toxicity.detect(docs, flat, ["doc_id"]).collect()} == {0.5}
    one = toxicity.train(docs, labels.where("toxic = 1"))
    assert len({r.score for r in toxicity.detect(docs, one, ["doc_id"]).collect()}) == 1
    assert toxicity.detect(docs.limit(0), flat, ["doc_id"]).count() == 0


def test_sample_is_bounded_with_repeated_ids(spark):
    docs = spark.createDataFrame([(1, f"t{i % 7}") for i in range(500)] + [(i, f"x{i}") for i in range(2, 50)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(1, i % 2) for i in range(300)] + [(i, 0) for i in range(2, 50)], "doc_id long, toxic int")
    rows = training.labelled_rows(docs, labels, lambda texts: texts, 20, "toxic")
    assert len(rows) <= 20 and len({x for x, _, _ in rows}) == len(rows)
    every = training.labelled_rows(docs, labels, lambda texts: texts, 1000, "toxic")
    assert len(every) == 49 and sum(y for _, y, _ in every) == 1  # id 1: one row, the greatest label
    again = training.labelled_rows(docs.repartition(7), labels.repartition(3), lambda texts: texts, 20, "toxic")
    assert again == rows
