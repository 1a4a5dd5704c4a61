import random
import re

from pyspark.sql import functions as F

from retentio.llm.components import connected_components
from retentio.llm.neardup import near_duplicates


def brute(docs, threshold=75):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= threshold * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(docs):
        ids = [docs[j][0] for j in range(len(docs)) if find(j) == find(i) and docs[j][0] is not None]
        comp = min(ids, default=None) if sets[i] else d
        out.append((d, len(sets[i]), comp, comp is None or d == comp))
    return sorted(out, key=repr)


def run(spark, docs):
    df = spark.createDataFrame([(d, t, "clash") for d, t in docs], "doc_id long, text string, bands string")
    return sorted((tuple(r)[:4] for r in near_duplicates(df.repartition(3)).collect()), key=repr)


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = [f"w{i}é" for i in range(400)]

    def text(n):
        return [rng.choice(vocab) for _ in range(n)]

    docs, k = [], 0
    for size, copies, edits in ((60, 6, 1), (200, 12, 4), (400, 5, 8), (9, 4, 1), (3, 3, 0), (6000, 3, 60)):
        base = text(size)
        for c in range(copies):
            w = list(base)
            for _ in range(edits if c else 0):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            docs.append((k, (" " if c % 2 else "\n").join(w)))
            k += 1
    docs += [(100 + i, " ".join(text(50))) for i in range(20)]
    docs += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "a b c d"), (206, "a b c d e"),
             (50, " ".join(text(30))), (7, docs[7][1]), (None, docs[0][1]), (None, "only without id here now"),
             (None, None)]
    assert run(spark, docs) == brute(docs)


def test_empty(spark):
    assert run(spark, []) == []


def test_copies_with_many_edits_join_through_their_source(spark):
    """Copies that resemble the source (0.75+) but not one another form one component."""
    rng = random.Random(1)
    base = [f"t{i}" for i in range(200)]
    docs = [(500, " ".join(base))]
    for c in range(60):
        w = list(base)
        for at in rng.sample(range(5, 195), 5):
            w[at] = f"x{rng.random()}"
        docs.append((c, " ".join(w)))
    assert run(spark, docs) == brute(docs)


def test_components_chain_and_hub(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(40)] + [("900", f"{i}") for i in range(901, 960)]
    edges += [("b", "a"), ("a", "b"), ("c", "c"), (None, "d")]
    got = {r.node: r.root for r in connected_components(
        spark.createDataFrame(edges, "u string, v string")).collect()}
    assert all(got[f"{i:03}"] == "000" for i in range(41))
    assert all(got[f"{i}"] == "900" for i in range(900, 960))
    assert got["b"] == got["a"] == "a" and "c" not in got and "d" not in got


def test_large_group_of_near_copies_is_compared_in_linear_work(spark, monkeypatch):
    from retentio.llm import neardup

    rng = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    docs = []
    for i in range(500):  # a dozen places differ or not, so about half of the pairs are linked and no member is near all
        w = list(base)
        for place in range(6, 150, 12):
            if rng.random() < 0.25:
                w[place] = "other"
        docs.append((i, " ".join(w)))
    compared = []

    def counting(pairs, sets, threshold, inner=neardup._verified):
        pairs = neardup.cut_lineage(pairs)
        compared.append(pairs.count())
        return inner(pairs, sets, threshold)

    monkeypatch.setattr(neardup, "_verified", counting)
    assert run(spark, docs) == brute(docs)
    assert len(compared) >= 2 and sum(compared) < 20 * len(docs), compared


def test_only_classes_in_pairs_have_their_sets_made(spark, monkeypatch):
    from retentio.llm import neardup

    rng = random.Random(4)
    frame = [f"f{i}" for i in range(40)]  # shared by all, so all meet in buckets
    docs = [(i, " ".join([*frame, *(f"own{rng.random()}" for _ in range(80))])) for i in range(60)]
    copy = [f"c{i}" for i in range(80)]
    docs += [(100, " ".join(copy)), (101, " ".join([*copy, "end"]))]
    made, inner = [], neardup.cut_lineage

    def written(df, *a):
        out = inner(df, *a)
        if "shingles" in out.columns:
            made.append(out.count())
        return out

    monkeypatch.setattr(neardup, "cut_lineage", written)
    assert run(spark, docs) == brute(docs)
    assert made and max(made) <= 4, made


def test_components_of_long_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 7), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, **{1000 + i: 1000 for i in range(200)}, 2000: 2000, 2001: 2000}


def test_edited_copies_just_outside_a_group_are_not_compared_pair_by_pair(spark, monkeypatch):
    """60 copies with one edit and 60 with six; of the latter some share edits with one another."""
    from retentio.llm import neardup

    rng = random.Random(6)
    base = [f"b{i}" for i in range(200)]
    docs = [(0, " ".join(base))]
    for i in range(1, 121):
        w = list(base)
        for place in rng.sample(range(6, 190, 6), 1 if i <= 60 else 6):
            w[place] = f"x{i}"
        docs.append((i, " ".join(w)))
    for i in range(121, 127):  # a copy of an outer copy, linked with that one only
        w = docs[i - 20][1].split()
        w[rng.choice(range(3, 190, 6))] = f"x{i}"
        docs.append((i, " ".join(w)))
    compared, inner = [], neardup._rest

    def counting(*a):
        pairs = neardup.cut_lineage(inner(*a))
        compared.append(pairs.count())
        return pairs

    monkeypatch.setattr(neardup, "_rest", counting)
    assert run(spark, docs) == brute(docs)
    assert sum(compared) < 3 * len(docs), compared


def test_only_wanted_texts_are_moved(spark):
    """rows nobody asks for stay where they are; wanted ones with and without id come through."""
    from retentio.llm import neardup

    rows = spark.createDataFrame([(i if i % 2 else None, f"text {i}", i * 7) for i in range(3000)] + [(1, "text 1", 7)],
                                 "doc_id long, text string, text_hash long")
    wanted = neardup._keyed(rows.where("text_hash < 70").select("doc_id", "text_hash"))
    passed = [r.text_hash for r in neardup._likely(rows, wanted).select("text_hash").collect()]
    assert {i * 7 for i in range(10)} <= set(passed) and len(passed) < 50
    chosen = rows.distinct().select(F.concat(F.lit("d"), "text_hash").alias("digest"), "doc_id", "text_hash")
    sets = neardup._full_sets(rows.select("doc_id", "text", "text_hash"), chosen, chosen.where("text_hash < 70").select("digest")).collect()
    assert sorted(r.digest for r in sets) == sorted(f"d{i * 7}" for i in range(10))


def test_only_classes_that_share_a_bucket_carry_their_bits(spark, monkeypatch):
    """of 150 texts two are near copies; bucket rows name a class by a number, not by its digest."""
    from retentio.llm import neardup

    rng = random.Random(8)
    docs = [(i, " ".join(f"own{rng.random()}" for _ in range(40))) for i in range(150)]
    copy = [f"c{i}" for i in range(80)]
    docs += [(200, " ".join(copy)), (201, " ".join([*copy, "end"])), (202, " ".join(copy))]
    carried, keys, inner = [], [], neardup.cut_lineage

    def written(df, *a):
        out = inner(df, *a)
        if "bits" in out.columns and "text_hash" not in out.columns:
            carried.append(out.count())
        if "band" in out.columns:
            keys.extend(kind for _, kind in out.dtypes if kind in ("string", "binary"))
        return out

    monkeypatch.setattr(neardup, "cut_lineage", written)
    assert run(spark, docs) == brute(docs)
    assert carried and max(carried) <= 4 and not keys, (carried, keys)
