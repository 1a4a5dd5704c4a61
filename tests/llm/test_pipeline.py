import corpus_pipeline as cp
from retentio.session import cut_lineage
from tests.llm import test_decontam, test_linededup, test_neardup, test_packing

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    out = [docs]
    for name, stage in cp.STAGES:
        out.append(cut_lineage(stage(spark, out[-1], SF)))
        assert name == "packing" or out[-1].columns == columns
    texts = [[(r.doc_id, r.text) for r in o.select("doc_id", "text").collect()] for o in out[:-1]]

    known = {d for d, t in texts[0] if any(c.isalpha() for c in t)}
    assert {d for d, _ in texts[1]} <= known and len(texts[1]) >= 0.99 * len(known)
    want = test_linededup.brute(texts[1])
    assert dict(texts[2]) == {d: want[d, t] if want[d, t].split() else t for d, t in texts[1]}
    kept = {d for d, _, _, k in test_neardup.brute(texts[2]) if k}
    assert {d for d, _ in texts[3]} == kept
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    leaking = {d for d, _, _ in test_decontam.brute([x for x in texts[3] if len(x[1]) < 20_000], items)}
    assert {d for d, _ in texts[4]} == kept - leaking
    assert test_packing.check(out[5].collect(), texts[4], 4096) < 0.05


def test_clashing_columns_nulls_repeats_and_empty(spark):
    rows = [(1, "the cat sat on the mat", "en", "s", 22, "x"), (1, "the cat sat on the mat", "en", "s", 22, "x"),
            (None, "the dog sat on the mat", "en", "s", 22, "y"), (2, None, None, None, None, None),
            (3, "12 34", "en", None, 5, "z"), (4, "", None, "s", 0, "z")]
    docs = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, places string")
    for frame in (docs, docs.limit(0)):
        left = frame
        for _, stage in cp.STAGES[:-1]:
            left = cut_lineage(stage(spark, left, SF))
            assert left.columns == docs.columns
        ids = sorted((r.doc_id for r in left.collect()), key=repr)
        assert ids == ([1, None] if frame is docs else [])
        assert cp.STAGES[-1][1](spark, left, SF).count() == len(ids)


def test_rows_without_id_and_shared_ids_are_judged_by_their_text(spark):
    item = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()), key=len)
    copy = " ".join(f"alpha{i} beta{i}" for i in range(40))
    rows = [(1, copy), (None, copy), (None, copy + " end"), (2, "quite another clean text stands here"),
            (3, item), (3, "the same id holds a clean text too"), (None, item), (None, "no id and nothing wrong here"),
            (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    deduped = {(r.doc_id, r.text) for r in cp.drop_near_duplicates(spark, docs, SF).collect()}
    assert deduped == set(rows) - {(None, copy), (None, copy + " end"), (None, item)}
    clean = {(r.doc_id, r.text) for r in cp.drop_contaminated(spark, docs, SF).collect()}
    assert clean == set(rows) - {(3, item), (None, item)}
