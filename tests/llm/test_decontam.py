import random
import re
from collections import Counter

from pyspark.sql import functions as F

from retentio.llm import decontam
from retentio.llm.queries import op7_decontamination


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())


def shingles(w):
    n = min(5, len(w))
    return Counter(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = split(text)
        for item, t in items:
            b = split(t)
            if not b:
                continue
            want = shingles(b)
            for s in range(len(w) - len(b) + 1):
                got = shingles(w[s:s + len(b)])
                both, either = sum((got & want).values()), sum((got | want).values())
                if 100 * both >= 75 * either:
                    out[d, item] = max(out.get((d, item), 0), both / either)
    return {(d, i, round(v, 6)) for (d, i), v in out.items()}


def run(spark, docs, items):
    d = spark.createDataFrame([(k, t, "c") for k, t in docs], "doc_id long, text string, m string")
    b = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, start int")
    return {(r.doc_id, r.item_id, round(r.similarity, 6)) for r in decontam.find_leaks(d, b).collect()}


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"v{i}é" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(15, 60)))) for i in range(25)]
    items += [(90, "tiny one"), (91, "le le le le le le le le le le le le"), (92, None), (93, ""),
              (95, items[3][1]), (96, items[3][1])]
    docs = []
    for k in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(5, 150))]
        if k % 2:
            leak = rng.choice(items[:25])[1].upper().split()
            kind = k % 5
            if kind == 1:
                leak[rng.randrange(len(leak))] = "edit"
            elif kind == 2:
                leak = leak[: len(leak) - len(leak) // 12]
            elif kind == 3:
                leak.insert(len(leak) // 2, "extra")
            at = rng.randrange(len(w))
            w[at:at] = leak
        docs.append((k, ("\n" if k % 3 else " ").join(w)))
    docs += [(500, None), (501, ""), (502, "le " * 300), (503, "a tiny  one here"), (None, items[0][1]),
             (504, items[1][1]), (504, items[1][1])]
    want, got = brute(docs, items), run(spark, docs, items)
    assert got <= want
    assert len(got) >= 0.98 * len(want)
    exact = {(d, i) for d, i, v in want if v > 0.85}
    assert exact <= {(d, i) for d, i, _ in got}


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c d e f")]) == set()
    assert run(spark, [(1, "a b c d e f")], []) == set()
    assert run(spark, [(1, "a b c d e f")], [(1, None)]) == set()


def test_blocks_guarantee_the_radius(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), decontam.RADIUS):
            b ^= 1 << bit
        rows.append((a - (1 << 63), b - (1 << 63)))
    rows = [(i, 9, [a, 0], [b, -1]) for i, (a, b) in enumerate(rows)]
    df = spark.createDataFrame(rows, "item_key long, m int, a array<bigint>, b array<bigint>")
    got = decontam._candidates(df.select("m", F.col("a").alias("prints")),
                               df.select("item_key", "m", F.col("b").alias("prints"))).collect()
    found = {(tuple(r.prints), r.item_key) for r in got}
    assert len(found) == len(got) and {(tuple(a), i) for i, _, a, _ in rows} <= found
    close = {(tuple(a), i) for _, _, a, _ in rows for i, _, _, b in rows
             if ((a[0] ^ b[0]) & (1 << 64) - 1).bit_count() <= decontam.RADIUS}
    assert found == close


def test_simhash_is_the_bit_majority(spark):
    rng = random.Random(6)
    lists = [[rng.getrandbits(64) - (1 << 63) for _ in range(n)] for n in (1, 2, 5, 40)]
    df = spark.createDataFrame([(x,) for x in lists], "h array<bigint>")
    for x, r in zip(lists, df.select("h", decontam.simhash(F.col("h")).alias("s")).collect()):
        want = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in r.h) > len(r.h))
        assert r.s & (1 << 64) - 1 == want


def test_few_pairs_of_a_size_meet(spark):
    rng = random.Random(8)
    some = [[(i, 9, [rng.getrandbits(64) - (1 << 63) for _ in range(decontam.PRINTS)]) for i in range(400)] for _ in "ab"]
    a, b = (spark.createDataFrame(x, "item_key long, m int, prints array<bigint>") for x in some)
    keys = a.select(F.explode(decontam._parts(F.col("prints"))).alias("x")).select("x.part", "x.value")
    probes = b.select(F.explode(decontam._parts(F.col("prints"))).alias("x")).select(
        "x.part", F.explode(decontam._close_values(F.col("x.value"))).alias("value"))
    assert keys.join(probes, ["part", "value"]).count() < 0.1 * 400 * 400


def test_recall_close_to_the_threshold(spark):
    rng = random.Random(9)
    items, docs = [], []
    for k in range(400):
        w = [f"u{rng.getrandbits(40)}" for _ in range(rng.randint(25, 60))]
        grams = len(w) - 4
        cut = next(c for c in range(len(w)) if 100 * (grams - c - 1) < 75 * (grams + c + 1))
        items.append((k, " ".join(w)))
        docs.append((k, " ".join(w[:len(w) - cut] + [f"u{rng.getrandbits(40)}" for _ in range(cut)])))
    got = run(spark, docs, items)
    want = {k for k in range(400) if brute([docs[k]], [items[k]])}
    found = {d for d, i, _ in got if d == i}
    assert found <= want and len(want) > 380
    assert len(found) >= 0.99 * len(want)


def test_simhash_of_more_words_than_a_16_bit_count(spark):
    df = spark.range(1).select(F.array_repeat(F.lit(-1).cast("long"), 70_000).alias("h"))
    assert df.select(decontam.simhash(F.col("h"))).first()[0] == -1


def test_query_finds_planted_items(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in op7_decontamination(spark, sf).collect()}
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    cand = set()
    grams = {}
    for i, t in items:
        for s in shingles(split(t)):
            grams.setdefault(s, set()).add(i)
    by_id = dict(items)
    for d, t in docs:
        close = set().union(*(grams.get(s, set()) for s in shingles(split(t)))) if t else set()
        cand |= {(x[0], x[1]) for x in brute([(d, t)], [(i, by_id[i]) for i in close])} if len(t) < 20000 else set()
    assert cand and cand <= got


def test_windows_at_the_edges_and_in_short_documents(spark):
    item = [f"i{k}" for k in range(50)]
    prose = [f"p{k}" for k in range(120)]
    docs = {1: prose + item[:45], 2: item[5:] + prose, 3: item[:-1], 4: item[2:-1], 5: prose + item,
            6: prose + item[25:] + item[:25] + prose, 7: item[25:] + item[:25], 8: prose + item[:40], 9: item[:30]}
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in docs.items()], "doc_id long, text string")
    b = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (r.start_word, r.n_words, round(r.similarity, 3)) for r in decontam.find_leaks(d, b).collect()}
    assert got == {1: (115, 50, round(41 / 51, 3)), 2: (0, 50, round(41 / 51, 3)), 3: (0, 49, round(45 / 46, 3)),
                   4: (0, 47, round(43 / 46, 3)), 5: (120, 50, 1.0), 6: (120, 50, round(42 / 50, 3)),
                   7: (0, 50, round(42 / 50, 3))}
