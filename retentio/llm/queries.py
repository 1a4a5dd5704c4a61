"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm import (
    decontam,
    langid,
    licenses,
    linededup,
    neardup,
    packing,
    periodic,
    pii,
    quality,
    quality_rules,
    ranked,
    toxicity,
    urls,
)
from retentio.sources.tables import read_table

# fixed values: the url rules the task states
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


_WORDS = r"[^\x20\x09-\x0D]+"


def _url_rules(spark: SparkSession) -> DataFrame:
    rows = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(host, path, verdict)")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of the fixed url rules for every page."""
    pages = read_table(spark, sf_dir, "pages", "page_id", "url")
    return urls.judge_urls(pages, _url_rules(spark))


def _joined_spans(found: Column) -> Column:
    one = F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of personal data in every document."""
    found = pii.scan(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("found", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    kinds = F.transform("found", lambda s: s["kind"])
    counts = [(F.size("found") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}")
              for k in pii.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined_spans(base), 256).alias("base_sha256"),
                        _joined_spans(F.col("found")).alias("spans"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component and kept flag of every document."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return neardup.near_duplicates(docs).drop("text_hash")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base quality measures and the calibrated verdict of every document."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_rules.train(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))
    return quality_rules.judge(docs, model)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its recurring lines."""
    return linededup.dedup_lines(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; learned from labels that are not held out."""
    docs = (read_table(spark, sf_dir, "documents", "doc_id", "text")
            .withColumn("held_out", langid.held_out(F.col("doc_id"), 5, 0)))
    labels = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    model = quality.train(docs, labels.where(~langid.held_out(F.col("doc_id"), 5, 0)))
    scored = quality.score(docs, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) pair where the document holds the item."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    leaks = decontam.find_leaks(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return leaks.withColumn("contaminated", F.lit(True))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every licence notice in every document."""
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned from rows that are not held out."""
    docs = (read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
            .withColumn("held_out", langid.held_out(F.col("doc_id"), 3, 1)))
    model = langid.train(docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out")).select("text", "lang"))
    return langid.identify(docs, model, keep=["doc_id", "held_out"])


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for every benchmark item."""
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return ranked.search(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text"), k=20)


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; learned from labels that are not held out."""
    docs = (read_table(spark, sf_dir, "documents", "doc_id", "text")
            .withColumn("held_out", langid.held_out(F.col("doc_id"), 4, 2)))
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = toxicity.train(docs, labels.where(~langid.held_out(F.col("doc_id"), 4, 2)))
    scored = toxicity.detect(docs, model, keep=["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def _with_periodic_tails(docs: DataFrame) -> DataFrame:
    """Every tenth document (by crc32 of its id) with its words from a chosen place on replaced by a repeated block."""
    h = F.crc32(F.col("doc_id").cast("string"))
    listed = docs.select("doc_id", "text", h.alias("h"), F.when(
        h % 10 == 0, F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0))).alias("w"))
    placed = (listed.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10))
              .withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
              .withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)")))
    tail = F.flatten(F.array_repeat(F.expr("slice(w, int(a + 1), int(p))"), F.expr("int((n - a) div p + 1)")))
    words = F.slice(F.concat(F.expr("slice(w, 1, int(a))"), tail), F.lit(1), F.col("n"))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document: their number, the strongest, and digests of all runs and of the collapsed text."""
    found = periodic.find_runs(_with_periodic_tails(read_table(spark, sf_dir, "documents", "doc_id", "text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    best = found.withColumn("best", periodic.strongest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_url_filters": op3_url_filters,
    "op4_quality_rules": op4_quality_rules,
    "op5_line_dedup": op5_line_dedup,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_decontamination": op7_decontamination,
    "op8_license_scan": op8_license_scan,
    "op9_packing": op9_packing,
    "op10_language_id": op10_language_id,
    "op11_ranked_search": op11_ranked_search,
    "op12_toxicity": op12_toxicity,
    "op13_periodic_runs": op13_periodic_runs,
}

_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""

SQL: dict[str, str] = {
    "op2_minhash_near_dedup": f"""
        WITH RECURSIVE toks AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                            'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS w
          FROM documents),
        shingles AS (
          SELECT DISTINCT doc_id, sh FROM (
            SELECT doc_id, unnest([array_to_string(w[i:i + 4], ' ')
                                   for i in range(1, greatest(len(w) - 4, 1) + 1)]) AS sh
            FROM toks WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        links AS (
          SELECT a.doc_id AS u, b.doc_id AS v
          FROM shingles a JOIN shingles b ON a.sh = b.sh AND a.doc_id <> b.doc_id
          JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, x.n, y.n
          HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
        reach(doc_id, other) AS (
          SELECT doc_id, doc_id FROM documents
          UNION SELECT r.doc_id, l.v FROM reach r JOIN links l ON l.u = r.other)
        SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id,
               r.doc_id = min(r.other) AS kept
        FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op3_url_filters": f"""
        WITH rules(r_host, r_path, r_verdict) AS (VALUES {_RULE_ROWS}),
        rest AS (
          SELECT row_number() OVER () AS rid, page_id,
                 CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
          FROM pages),
        parts AS (
          SELECT rid, page_id,
                 translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                           'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
          FROM rest),
        fit AS (
          SELECT p.rid, r_host || r_path AS rule, r_verdict,
                 row_number() OVER (PARTITION BY p.rid
                   ORDER BY length(r_host || r_path) DESC, length(r_host) DESC) AS rn
          FROM parts p JOIN rules r
            ON (p.host = r_host OR ends_with(p.host, '.' || r_host)) AND starts_with(p.path, r_path))
        SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.r_verdict, 'allow') AS verdict
        FROM parts p LEFT JOIN fit f ON f.rid = p.rid AND f.rn = 1""",
    "op11_ranked_search": f"""
        WITH listed AS (
          SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
        totals AS (
          SELECT count(*) FILTER (WHERE len(w) > 0) AS docs, coalesce(sum(len(w)), 0)::BIGINT AS terms FROM listed),
        asked AS (
          SELECT i, item_id, t, count(*) AS times
          FROM (SELECT i, item_id, unnest(w) AS t
                FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark))
          GROUP BY i, item_id, t),
        found AS (
          SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM listed)
          WHERE t IN (SELECT t FROM asked) GROUP BY r, t),
        weights AS (
          SELECT t, floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
          FROM found, totals GROUP BY t, docs),
        lengths AS (
          SELECT r, doc_id, 100 - 25 + ((25 * len(w) * docs) // terms) AS m FROM listed, totals WHERE len(w) > 0),
        scored AS (
          SELECT a.i, a.item_id, l.doc_id, l.r,
                 sum(a.times * x.w * ((1000000000 * f.tf) // (1000 * f.tf + 12 * l.m)))::BIGINT AS score
          FROM asked a JOIN found f ON f.t = a.t JOIN weights x ON x.t = a.t JOIN lengths l ON l.r = f.r
          GROUP BY a.i, a.item_id, l.doc_id, l.r),
        ranked AS (
          SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank,
                 doc_id, score
          FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20""",
}
