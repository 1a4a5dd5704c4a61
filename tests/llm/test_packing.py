import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from retentio.llm import packing
from retentio.llm.queries import op9_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_first_fit(lengths, capacity):
    free, out = [], [None] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        for b, room in enumerate(free):
            if room >= lengths[i]:
                break
        else:
            b = len(free)
            free.append(capacity)
        out[i] = (b, capacity - free[b])
        free[b] -= lengths[i]
    return out


def test_tournament_tree_is_first_fit_decreasing():
    rng = random.Random(3)
    for n in (0, 1, 2, 5, 64, 301):
        sizes = [rng.choice([1, 2, 7, 50, 99, 100, rng.randint(1, 100)]) for _ in range(n)]
        bins, offsets = packing.first_fit_decreasing(np.array(sizes, dtype=np.int64), 100)
        assert list(zip(bins.tolist(), offsets.tolist())) == plain_first_fit(sizes, 100)


def test_cached_words_encode_like_whole_texts():
    whole = Tokenizer.from_file(PATH)
    enc = packing.WordEncoder(PATH)
    texts = ["Hello, world's BEST... don't!!", "é É ñ̃ ñ ́x İstanbul ŞIK", "a1b2 3.14 x_y", "",
             " \t\n", "<|endoftext|> a<|startoftext|>b <|endoftext|", "||| ### $$$ wor|d| end|", "日本語 テキスト。 ok。",
             "a\x1cb\x85c d e", "I'll we've 'S 'T it's. they're, O'", "ÀB. ßß, ǅ! 🙂. x🙂."]
    for _ in range(2):
        got = enc.encode([t.encode() for t in texts])
        for t, g in zip(texts, got):
            assert np.frombuffer(g, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_every_letter_before_every_tail_sign():
    whole, enc = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    letters = [c for c in map(chr, range(0x30000)) if c.isalpha() and not "\ud800" <= c <= "\udfff"]
    for at in range(0, len(letters), 500):
        for form in ("{}{}", "a{}{}b{}"):
            words = [form.format(c, t, c) for c in letters[at: at + 500] for t in packing._TAIL]
            got = np.frombuffer(enc.encode([" ".join(words).encode()])[0], "<u4").tolist()
            if got != whole.encode(" ".join(words), add_special_tokens=False).ids:
                wrong = [w for w in words if np.frombuffer(enc.encode([w.encode()])[0], "<u4").tolist()
                         != whole.encode(w, add_special_tokens=False).ids]
                raise AssertionError(wrong[:20])


def test_cache_may_be_emptied_between_groups(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE_WORDS", 3)
    whole, enc = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    for text in ("a b c d e f", "a g h", "b a g", "c, a. h!"):
        got = enc.encode([text.encode(), text.upper().encode()])
        want = whole.encode(text, add_special_tokens=False).ids
        assert [np.frombuffer(g, "<u4").tolist() for g in got] == [want, want]


def check(rows, docs, max_tokens):
    whole = Tokenizer.from_file(PATH)
    ids = {d: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for d, t in docs}
    at = {d: 0 for d in ids}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["start"])):
        part = ids[r["doc_id"]][r["start"]: r["start"] + r["length"]]
        assert r["start"] == at[r["doc_id"]] and len(part) == r["length"] > 0
        assert r["doc_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        at[r["doc_id"]] += r["length"]
    assert at == {d: len(x) for d, x in ids.items()}
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padded = total = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= max_tokens
        total += end
        padded += 0 if end & (end - 1) == 0 else max_tokens - end
    return padded / max(1, total)


def test_query_covers_every_id_once(spark):
    rows = op9_packing(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert check(rows, [tuple(d) for d in docs], packing.MAX_TOKENS) < 0.01


def test_nulls_repeats_long_and_empty(spark, monkeypatch):
    docs = [(1, None), (2, ""), (3, "word " * 9000), (4, "a b c")]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, length int")
    monkeypatch.setattr(packing, "GROUP_PIECES", 3)
    rows = packing.pack(df, PATH, max_tokens=64, with_ids=True).collect()
    check(rows, docs, 64)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    twice = packing.pack(df.union(df).selectExpr("nullif(doc_id, 4) AS doc_id", "text"), PATH).collect()
    assert len(twice) == 2 * len(packing.pack(df, PATH).collect())
    assert sum(r["doc_id"] is None for r in twice) == 2
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_workers_hand_memory_back_after_every_batch(monkeypatch):
    import pyarrow as pa

    given = []

    class Pool:
        release_unused = staticmethod(lambda: given.append(1))

    batches = [pa.RecordBatch.from_pydict({"uid": [i], "doc_id": [i], "text": ["a b c"]}) for i in range(3)]
    run = packing._pieces(public_tokenizers.path("word_bpe_49k.json"), 4096, 2, False)
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    assert sum(b.num_rows for b in run(iter(batches))) == 3
    assert len(given) == 3


def test_a_task_leaves_no_encoder_behind(monkeypatch):
    """a Python worker lives on after its task; the caches must not wait for the garbage collector."""
    import gc
    import weakref

    import pyarrow as pa
    import public_tokenizers

    seen = []

    class Watched(packing.WordEncoder):
        def __init__(self, path):
            super().__init__(path)
            seen.append(weakref.ref(self))

    monkeypatch.setattr(packing, "WordEncoder", Watched)
    batch = pa.RecordBatch.from_arrays(
        [pa.array([0, 1]), pa.array([7, 8]), pa.array(["some words here", None])], names=["uid", "doc_id", "text"])
    gc.collect()
    gc.disable()
    try:
        out = list(packing._pieces(public_tokenizers.path("word_bpe_49k.json"), 4096, 2, False)(iter([batch])))
        assert sum(b.num_rows for b in out) == 2
        assert seen and all(ref() is None for ref in seen)
    finally:
        gc.enable()
