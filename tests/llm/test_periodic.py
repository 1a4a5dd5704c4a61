import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from retentio.llm import periodic
from retentio.llm import textfeat as tf
from retentio.llm.queries import op13_periodic_runs

SF = "/root/testdata/sf0.001"


def brute(words):
    """All runs by their definition: maximal q-periodic stretches for every q, without those of a smaller period."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(24, 3 * q):
                found.setdefault((i, length), q)  # periods ascend, so the smallest stays
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts():
    rng = random.Random(4)
    out = ["a " * 23, "a " * 24, "a b " * 12, "a b " * 12 + "a", "", " \n", "x", "a b c d e f g h i " * 3,
           "a b c d e f g h i " * 2 + "a b c d e f g h", "é ü z " * 30]
    for _ in range(150):
        words = []
        while len(words) < rng.choice([30, 90, 300, 900]):
            block = [rng.choice("abcdefgh"[:rng.choice([1, 2, 3, 8])]) for _ in range(rng.choice([1, 2, 5, 8, 15, 16, 17, 40, 90]))]
            words += block * rng.choice([1, 1, 2, 3, 4, 9])
            if rng.random() < 0.3:
                words += [f"u{rng.random()}"]
            if rng.random() < 0.1:  # a block of blocks
                words += words[-60:] * 3
        out.append(" ".join(words))
    return out


def test_runs_against_brute_force(spark):
    docs = texts()
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in periodic.find_runs(frame).collect()}
    assert len(got) == len(docs)
    n = 0
    for i, t in enumerate(docs):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        want = brute(words)
        n += len(want)
        assert [tuple(r) for r in got[i].runs] == want, (i, t[:200])
        assert got[i].n_words == len(words) and got[i].collapsed == collapse(words, want)
    assert n > 150


def test_query_against_brute_force(spark):
    out = {r.doc_id: r for r in op13_periodic_runs(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(out) == len(docs)
    with_runs = 0
    for d in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", d.text or "")
        n, h = len(words), zlib.crc32(str(d.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        if n > 3000:
            continue
        runs, r = brute(words), out[d.doc_id]
        with_runs += bool(runs)
        best = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if runs else (None,) * 3
        assert r.n_runs == len(runs) and (r.start, r.length, r.period) == best
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapse(words, runs).encode()).hexdigest()
    assert with_runs >= 10


def test_nulls_repeats_long_and_clashing_columns(spark):
    long = " ".join(f"w{i % 7919}" for i in range(60_000))  # seven rounds of a long period
    rows = [(1, None, 0), (None, "a " * 30, 1), (2, "a " * 30, 2), (2, "a " * 30, 2), (3, long, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumn("runs", F.lit("x"))
    got = sorted((r.doc_id or 0, r.n_words, tuple(tuple(x) for x in r.runs), len(r.collapsed))
                 for r in periodic.find_runs(docs).collect())
    assert got[:4] == [(0, 30, ((0, 30, 1),), 1), (1, 0, (), 0), (2, 30, ((0, 30, 1),), 1), (2, 30, ((0, 30, 1),), 1)]
    assert got[4][2] == ((0, 60_000, 7919),)
    assert periodic.find_runs(docs.limit(0)).count() == 0


def test_z_function_against_definition():
    rng = np.random.default_rng(0)
    for _ in range(200):
        s = rng.integers(0, 3, rng.integers(1, 40)).tolist()
        for i, z in enumerate(periodic.z_function(s)):
            assert s[i:i + z] == s[:z] and (i + z == len(s) or s[z] != s[i + z])


def test_plain_prose_makes_no_tiles():
    group = [" ".join(f"w{(i * i) % 10007}x{i}" for i in range(5000)).encode(), b"a b c d e f g h " * 2, b"a"]
    assert periodic.suspicious(tf.words(group)).tolist() == [False, True, False]
    assert periodic.tiles(tf.words([b"a b"]).hashes) == []


@pytest.mark.parametrize("period", [1, 7, 8, 15, 16, 31, 32, 33, 100, 257])
def test_every_period_at_every_offset_of_the_grid(period):
    for lead in (0, 1, 5, 13, 40):
        for tail in (0, 1, 9):
            length = max(24, 3 * period) + tail
            words = [f"p{i}" for i in range(lead)] + [f"b{i % period}" for i in range(length)] + ["z"]
            hashes = tf.words([" ".join(words).encode()]).hashes
            spans = {}
            for t in periodic.tiles(hashes):
                for p, s, e in periodic.fragments(np.frombuffer(t["words"], np.int32).tolist(),
                                                  np.frombuffer(t["bounds"], np.int64).tolist(), t["lo"], t["scale"]):
                    if p == period:
                        a, b = spans.get(p, (s, e))
                        spans[p] = (min(a, s), max(b, e))
            assert spans[period] == (lead, lead + length)
