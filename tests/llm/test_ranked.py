import math
import random
import re
from collections import Counter

import numpy as np

from retentio.llm import ranked
from retentio.llm.queries import SQL, op11_ranked_search

SF = "/root/testdata/sf0.01"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """[(item_id, rank, doc_id, score)] by scoring every document for every item."""
    listed = [(d, terms(t)) for d, t in docs]
    n_docs, length = sum(bool(t) for _, t in listed), sum(len(t) for _, t in listed)
    df = Counter(x for _, t in listed for x in set(t))
    counted = [(d, len(t), Counter(t)) for d, t in listed if t]
    out = []
    for item, text in items:
        asked, scored = Counter(terms(text)), []
        for d, n, tf in counted:
            m, s = 100 - 25 + 25 * n * n_docs // length, 0
            for x, times in asked.items():
                if tf[x]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1)))
                    s += times * w * (1_000_000_000 * tf[x] // (1000 * tf[x] + 12 * m))
            if s > 0:
                scored.append((-s, d is None, d))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(60)] + ["é", "数学", "x1"]
    weight = [1 / (i + 1) for i in range(len(vocabulary))]
    return [(i, " ".join(rng.choices(vocabulary, weight, k=rng.choice([0, 1, 5, 20, 80])))) for i in range(n)]


def rows(frame):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in frame.collect()), key=str)


def test_search_against_brute_force(spark):
    docs = corpus(400, 1)
    docs += [(1000 + i, "w3 w4 W5, é") for i in range(40)] + [(7, "w3 é"), (7, "w3 é"), (None, "w3 é"), (5000, None), (5001, "")]
    items = [(0, "W3 w4; é w3 w3"), (1, "w0"), (2, "nothing known"), (3, ""), (4, None), (5, "w1 w2 w59 数学 x1"), (5, "w1"), (None, "é")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items, 20)
    assert rows(ranked.search(d, q)) == want
    # many shards, item blocks and no vocabulary filter give the same
    assert rows(ranked.search(d, q, max_vocabulary=3, shard_postings=200, block_items=3)) == want
    assert rows(ranked.search(d, q, k=3)) == brute(docs, items, 3)


def test_query_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(SQL["op11_ranked_search"]).fetchall()
    assert rows(op11_ranked_search(spark, SF)) == sorted(want, key=str)
    assert len(want) == 20 * 40


def test_scan_stops_early_and_keeps_ties():
    n = 50_000
    rng = np.random.default_rng(2)
    tfs = rng.integers(1, 50, n)
    docs = [np.array([1, 2] if i % 2 else [1], np.int64) for i in range(n)]
    counts = [np.full(len(t), tfs[i], np.int64) for i, t in enumerate(docs)]
    shard = ranked.Shard(docs, counts, np.full(n, 100, np.int64), np.array([1, 2]))
    found, score, accesses = shard.search(np.array([1, 2]), np.array([1000, 3000]), 10)
    full = np.array([sum((1000, 3000)[t - 1] * (10**9 * c // (1000 * c + 1200)) for t, c in zip(docs[i], counts[i]))
                     for i in range(n)])
    kth = np.sort(full)[-10]
    assert set(found) == set(np.flatnonzero(full >= kth)) and (full[found] == score).all()
    assert accesses < n / 4
    again, _, _ = shard.search(np.array([1, 2]), np.array([1000, 3000]), 10)
    assert set(again) == set(found)  # nothing of a search remains for the next


def test_empty_tables_and_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a b", 3, 4)], "doc_id long, text string, row int, terms int")
    q = spark.createDataFrame([(1, "a", 3, 4)], "item_id long, text string, item int, n int")
    assert len(rows(ranked.search(d, q))) == 1
    assert ranked.search(d.limit(0), q).count() == 0 and ranked.search(d, q.limit(0)).count() == 0
    assert ranked.search(spark.createDataFrame([(1, "..."), (2, None)], "doc_id long, text string"), q).count() == 0
    long = spark.createDataFrame([(1, "a b " * 200_000), (2, "a")], "doc_id long, text string")
    assert rows(ranked.search(long, q)) == brute([(1, "a b " * 200_000), (2, "a")], [(1, "a")], 20)
