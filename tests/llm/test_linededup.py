import random
import re
from collections import Counter, defaultdict

from retentio.llm import linededup as ld
from retentio.llm.queries import op5_line_dedup


def brute(docs):
    """{(doc_id, text): kept text} by the same definitions on plain Python values."""
    seen = {}
    for d, text in docs:
        if text is None or (d, text) in seen:
            continue
        lines = []
        for at, line in enumerate(text.split("\n")):
            t = tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[0-9]+", "<*>", line)))
            if len(t) >= ld.MIN_TOKENS:
                lines.append((at, t, (len(t), t[: ld.DEPTH])))
        seq = tuple(x[2] for x in lines)
        seen[d, text] = [(at, t, leaf, (seq[i - 1] if i else None, seq[i + 1] if i + 1 < len(seq) else None), seq)
                         for i, (at, t, leaf) in enumerate(lines)]
    leaves = defaultdict(Counter)
    for lines in seen.values():
        for _, t, leaf, _, _ in lines:
            leaves[leaf][t] += 1
    templates = {t: t for different in leaves.values() for t in different}
    nodes = dict(leaves)
    while nodes:
        parts = defaultdict(Counter)
        for node, different in nodes.items():
            if len(different) == 1 and node in leaves:
                continue
            n = len(next(iter(different)))
            agreed, squares = [], {}
            for p in range(n):
                c = Counter()
                for t, w in different.items():
                    c[t[p]] += w
                top = max(c.items(), key=lambda x: (x[1], x[0].encode()))
                agreed.append(top[0] if 2 * top[1] > sum(c.values()) else None)
                if p >= ld.DEPTH and agreed[p] is None:
                    squares[p] = sum(x * x for x in c.values())
            for t, w in different.items():
                fits = sum(a == b for a, b in zip(t[ld.DEPTH:], agreed[ld.DEPTH:]))
                if 100 * fits >= ld.SIMILARITY * (n - ld.DEPTH):
                    templates[t] = ("*", node)
                else:
                    differ = [p for p in range(ld.DEPTH, n) if agreed[p] not in (None, t[p])]
                    split = differ[0] if differ else max(squares, key=lambda p: (squares[p], -p))
                    parts[node, split, t[split]][t] += w
        nodes = {k: v for k, v in parts.items() if len(v) > 1}
    contexts, carriers, independent = defaultdict(set), defaultdict(set), defaultdict(set)
    for lines in seen.values():
        for _, t, leaf, context, seq in lines:
            contexts[templates[t]].add(context)
            carriers[templates[t]].add(seq)
    for lines in seen.values():
        own = sum(len(t) for _, t, _, _, _ in lines if len(carriers[templates[t]]) < ld.MIN_CONTEXTS)
        if 100 * own >= ld.OWN_SHARE * sum(len(t) for _, t, _, _, _ in lines):
            for _, t, _, _, seq in lines:
                independent[templates[t]].add(seq)
    drop = {x for x in contexts if len(independent[x]) >= ld.MIN_CONTEXTS
            or len(contexts[x]) >= ld.MIN_CONTEXTS and 100 * len(contexts[x]) >= ld.DIVERSITY * len(carriers[x])}
    out = {}
    for (d, text), lines in seen.items():
        gone = {at for at, t, _, _, _ in lines if templates[t] in drop}
        out[d, text] = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return out


def compare(spark, docs):
    df = spark.createDataFrame([(d, t, 7) for d, t in docs], "doc_id long, text string, places int")
    got = ld.dedup_lines(df.repartition(3))
    assert got.columns == ["doc_id", "text", "places", "n_lines", "n_dropped"]
    want = brute(docs)
    rows = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
    assert rows == sorted(((d, None if t is None else want[d, t]) for d, t in docs), key=repr)
    return got


def test_against_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(300)]

    def line(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    passage, boiler = line(60), "Page {} of {} printed for {} today"
    docs = []
    for k in range(80):
        lines = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 8))]
        if k % 3 == 0:
            lines.insert(rng.randrange(len(lines) + 1), boiler.format(k, k + 9, rng.choice(vocab)))
        if k % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), passage)
        docs.append((k, "\n".join(lines)))
    copy = "\n".join(line(12) for _ in range(6))
    docs += [(200 + i, copy) for i in range(12)]
    docs += [(300, None), (301, ""), (302, "\n\n"), (302, "\n\n"), (None, docs[0][1]), (303, "and ornd")]
    docs += [(400 + i, f"one two three four\n{line(5)}") for i in range(5)] + [(500, "a b c d " * 20_000)]
    got = compare(spark, docs)
    assert got.where("doc_id = 0").first().n_dropped == 2
    assert got.where("doc_id BETWEEN 200 AND 211 AND n_dropped > 0").count() == 0  # whole copies stay whole


def words_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(n))


def test_all_lines_of_a_passage_go_from_unrelated_documents(spark):
    rng = random.Random(1)
    passage = "\n".join(words_of(rng, 14) for _ in range(4))
    docs = [(k, "\n".join([words_of(rng, 20), passage, words_of(rng, 18 + k % 5), words_of(rng, 11)])) for k in range(60)]
    docs += [(100, passage), (101, passage + "\n" + words_of(rng, 9))]
    got = {r.doc_id: r for r in compare(spark, docs).collect()}
    assert all(r.n_dropped == 4 for r in got.values()) and got[100].text == ""


def test_a_line_goes_though_many_edited_copies_carry_it(spark):
    rng = random.Random(2)
    line = words_of(rng, 12)
    docs = [(k, "\n".join([words_of(rng, 15), line, words_of(rng, 15)])) for k in range(10)]
    base = [words_of(rng, 12 + i) for i in range(9)]
    for k in range(120):
        copy = list(base)
        copy[k % 9] = words_of(rng, 12 + k % 9)  # edited: another line
        docs.append((1000 + k, "\n".join([*copy[:5], line, *copy[5:]])))
    got = {r.doc_id: r for r in compare(spark, docs).collect()}
    assert all(r.n_dropped == 1 and line not in r.text for r in got.values())  # the copies keep all else


def test_edited_copies_alone_stay_whole(spark):
    rng = random.Random(3)
    base = [words_of(rng, 12 + i) for i in range(9)]
    docs = []
    for k in range(90):
        copy = list(base)
        copy[k % 9] = words_of(rng, 12 + k % 9)
        docs.append((k, "\n".join(copy)))
    assert all(r.n_dropped == 0 for r in compare(spark, docs).collect())


def test_several_formats_in_one_leaf(spark):
    rng = random.Random(4)
    formats = ["note to all {} users stay away until noon", "note to all {} guests please come back soon",
               "note to all {} staff doors open again later"]
    docs = [(k, "\n".join([words_of(rng, 15), formats[k % 3].format(words_of(rng, 1)), words_of(rng, 15)]))
            for k in range(60)]
    docs += [(100 + k, "\n".join([words_of(rng, 15), f"note to all {words_of(rng, 6)}", words_of(rng, 16)]))
             for k in range(12)]  # other lines of the same leaf
    got = {r.doc_id: r.n_dropped for r in compare(spark, docs).collect()}
    assert all(got[k] == 1 for k in range(60)) and all(got[100 + k] == 0 for k in range(12))


def test_documents_that_would_be_emptied_can_be_spared(spark):
    line = "all rights are reserved here"
    docs = [(i, f"{c} begins this little text\n{line}\n{c * 2} and then it ends") for i, c in enumerate("abcdef")]
    docs += [(9, line), (8, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in ld.dedup_lines(df).collect()}
    spared = {r.doc_id: r for r in ld.dedup_lines(df, spare_emptied=True).collect()}
    assert got[9].text == "" and got[9].n_dropped == 1
    assert spared[9].text == line and spared[9].n_dropped == 0
    assert all(line not in spared[i].text for i in range(6)) and spared[8].text is None


def test_empty(spark):
    assert compare(spark, []).count() == 0


def test_query_takes_planted_lines_out(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs)
    got = {r.doc_id: r.text for r in op5_line_dedup(spark, sf).collect()}
    assert len(got) == len(docs) and all(got[d] == want[d, t] for d, t in docs)
    assert sum(got[d] != t for d, t in docs) > 100
