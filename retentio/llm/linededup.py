"""Line dedup with a log-template tree (SQL functions only).

Lines are parsed like log messages.  Runs of digits are masked; a line then
falls into the leaf of a fixed-depth tree named by its number of tokens and
its first ``DEPTH`` tokens.  Inside a leaf the tokens most of its lines agree
on form the leaf's template, every other place is a variable field; a line
that agrees with the template in at least ``similarity`` percent of the tokens
behind the leading ones belongs to it.  The lines that do not fit are parted by
the token with which they first differ from the template (if they do not, by
the token at the variable place where the leaf varies least), and every part
that holds several wordings votes again, until none is left: a leaf holds as
many templates as it has formats.  A line that fits none is a template of its
own.

Lines of fewer than ``MIN_TOKENS`` tokens recur by chance and take no part.  A
template *recurs* when either holds:

* At least ``min_contexts`` different documents that are *independent* carry
  it.  A document is independent when at least ``own_share`` percent of its
  tokens stand in lines that fewer than ``min_contexts`` different documents
  hold.  With a third of its words its own, it shares at most half of its
  shingles with any other document, so it is no copy, whatever else of it
  recurs: all lines of a passage count, and so does a line that a large group
  of copies carries as well.
* It stands in at least ``min_contexts`` different contexts (the leaves before
  and after it in the document), and its contexts number at least ``diversity``
  percent of the different documents that carry it: also documents of shared
  lines alone.

Copies of whole documents repeat a line in one and the same context and have
little of their own; they are left to document dedup.  Documents differ when
their sequences of leaves do.  Recurring lines are dropped from every document.

Scale: one row of hashes per line is written and shuffled by leaf.  Tokens are
only needed where a leaf that can recur holds several different lines; a
bitmap of such leaves (fixed size, one equi-join with a broadcast of at most
1 MB) keeps all other lines out of the shuffle, an exact join follows.  Counts
are of distinct (template, context) and (template, document) pairs, so a line in
a third of all documents is combined before and after the shuffle and never
gathered.  A further vote covers only lines that fitted no template so far, and
a part has at most half of the votes of the group it came from, so the rounds
grow with the logarithm of the largest leaf.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.session import cut_lineage

DEPTH = 3
MIN_TOKENS = 4
MIN_CONTEXTS = 3
DIVERSITY = 75
OWN_SHARE = 33
SIMILARITY = 75
BITMAP_BITS = 1 << 23
_SPACE = r"[\x20\x09-\x0D]+"


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(line, "[0-9]+", "<*>"), _SPACE), lambda t: t != "")


def _leaf(tokens: Column) -> Column:
    return F.xxhash64(F.size(tokens), F.slice(tokens, 1, DEPTH))


def _parsed(rows: DataFrame) -> DataFrame:
    """One row per line of ``MIN_TOKENS`` tokens or more: place, tokens, leaf, literal, context, and the document's
    sequence (all hashes) and number of tokens in such lines."""
    listed = rows.select("doc_id", "text_hash", F.transform(F.split("text", "\n"), _tokens).alias("lines"))
    named = listed.select("doc_id", "text_hash", F.filter(F.transform("lines", lambda t, i: F.struct(
        i.alias("at"), F.size(t).alias("n"),
        _leaf(t).alias("leaf"), F.xxhash64(t).alias("literal"))),
        lambda x: x["n"] >= MIN_TOKENS).alias("lines"))
    placed = named.select(
        "doc_id", "text_hash", "lines", F.xxhash64(F.transform("lines", lambda x: x["leaf"])).alias("sequence"),
        F.aggregate("lines", F.lit(0).cast("long"), lambda total, x: total + x["n"]).alias("words"))
    around = F.transform("lines", lambda x, i: F.struct(
        x["at"].alias("at"), x["n"].alias("n"), x["leaf"].alias("leaf"), x["literal"].alias("literal"),
        F.xxhash64(F.when(i > 0, F.get("lines", i - 1)["leaf"]), F.lit(0), F.get("lines", i + 1)["leaf"])
        .alias("context")))
    return (placed.select("doc_id", "text_hash", "sequence", "words", F.explode(around).alias("x"))
            .select("doc_id", "text_hash", "sequence", "words", "x.*"))


def _only_leaves(lines: DataFrame, leaves: DataFrame) -> DataFrame:
    """``lines`` without most of those whose leaf is not in ``leaves`` (a bitmap of fixed size)."""
    at = F.pmod("leaf", F.lit(BITMAP_BITS)) + 1
    bitmap = leaves.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap"))  # at most 256 rows of 4 KB
    place = F.bitmap_bit_position(at).cast("int")
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), place % 8 + 1))
    return (lines.withColumn("bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bitmap), "bucket")
            .where(held != 0).drop("bucket", "bitmap"))


def _vote(lines: DataFrame, similarity: int) -> DataFrame:
    """``lines`` with ``fits`` (the template of its ``node``) and ``split``: where a line that does not fit first
    differs from the template, or else the variable place where the node varies least."""
    votes = (lines.select("node", "weight", F.posexplode("tokens").alias("place", "token"))
             .groupBy("node", "place", "token").agg(F.sum("weight").alias("votes")))
    squares = F.sum(F.col("votes").cast("double") * F.col("votes"))
    places = (votes.groupBy("node", "place")
              .agg(F.max(F.struct("votes", "token")).alias("top"), F.sum("votes").alias("all"),
                   squares.alias("squares"))
              .select("node", "place", "squares",
                      F.when(F.col("top.votes") * 2 > F.col("all"), F.col("top.token")).alias("token")))
    nodes = places.groupBy("node").agg(
        F.array_sort(F.collect_list(F.struct("place", "token"))).alias("template"),
        F.max(F.when(F.col("token").isNull() & (F.col("place") >= DEPTH),
                     F.struct("squares", (-F.col("place")).alias("before")))).alias("least"))
    agreed = F.size(F.filter(
        F.zip_with("tokens", "template", lambda t, x: (x["place"] >= DEPTH) & t.eqNullSafe(x["token"])), lambda ok: ok))
    differ = F.filter(F.zip_with("tokens", "template", lambda t, x: F.when(
        (x["place"] >= DEPTH) & (t != x["token"]), x["place"])), lambda place: place.isNotNull())
    behind = F.size("tokens") - DEPTH
    return lines.join(nodes, "node").select(
        *lines.columns, (agreed * 100 >= behind * similarity).alias("fits"),
        F.coalesce(F.get(differ, 0), -F.col("least.before")).alias("split"))


def _templates(rows: DataFrame, lines: DataFrame, similarity: int) -> DataFrame:
    """(leaf, literal) -> template of the lines that fit one of their leaf's templates."""
    different = cut_lineage(lines.groupBy("leaf", "literal").agg(F.count("*").alias("weight")))
    several = cut_lineage(different.groupBy("leaf").agg(F.count("*").alias("n")).where("n > 1").select("leaf"))
    texts = (rows.select(F.explode(F.transform(F.split("text", "\n"), _tokens)).alias("tokens"))
             .where(F.size("tokens") >= MIN_TOKENS)
             .select(_leaf(F.col("tokens")).alias("leaf"), F.xxhash64("tokens").alias("literal"), "tokens"))
    left = cut_lineage(_only_leaves(texts, several).dropDuplicates(["leaf", "literal"])
                       .join(different, ["leaf", "literal"]).join(several, "leaf", "left_semi")
                       .withColumn("node", F.col("leaf")))
    general = None
    while general is None or not left.isEmpty():
        judged = cut_lineage(_vote(left, similarity))
        named = judged.where("fits").select("leaf", "literal", F.xxhash64("node", F.lit("*")).alias("general"))
        general = named if general is None else general.union(named)
        parted = (judged.where(~F.col("fits")).drop("fits").withColumn(
            "node", F.xxhash64("node", "split", F.get("tokens", F.col("split")))).drop("split"))
        open_nodes = parted.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
        left = cut_lineage(parted.join(open_nodes, "node", "left_semi"))
    return general


def _independent(named: DataFrame, carriers: DataFrame, min_contexts: int, own_share: int) -> DataFrame:
    """``template, independent``: the different documents that carry it and have enough of their own."""
    shared = carriers.where(F.col("carriers") >= min_contexts).select("template")
    held = cut_lineage(named.select("text_hash", "sequence", "words", "at", "n", "template").distinct()
                       .join(shared, "template", "left_semi"))
    other = F.aggregate("shared", F.lit(0).cast("long"), lambda total, x: total + x["n"])
    alone = (held.groupBy("text_hash").agg(F.max("words").alias("words"),
                                           F.collect_set(F.struct("at", "n")).alias("shared"))
             .where((F.col("words") - other) * 100 >= F.col("words") * own_share).select("text_hash"))
    return (held.join(alone, "text_hash", "left_semi").select("template", "sequence").distinct()
            .groupBy("template").agg(F.count("*").alias("independent")))


def recurring_lines(docs: DataFrame, min_contexts: int = MIN_CONTEXTS, diversity: int = DIVERSITY,
                    similarity: int = SIMILARITY, own_share: int = OWN_SHARE) -> DataFrame:
    """``doc_id, text_hash, places``: the 0-based lines of each document whose template recurs."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).where("text IS NOT NULL")
    parsed = cut_lineage(_parsed(rows))
    can_recur = (parsed.select("leaf", "context", "sequence").distinct().groupBy("leaf")
                 .agg(F.count("*").alias("different")).where(F.col("different") >= min_contexts).select("leaf"))
    lines = cut_lineage(parsed.join(can_recur, "leaf", "left_semi"))
    named = cut_lineage(lines.join(_templates(rows, lines, similarity), ["leaf", "literal"], "left").select(
        "doc_id", "text_hash", "at", "n", F.coalesce("general", "literal").alias("template"), "context", "sequence",
        "words"))
    contexts = named.select("template", "context").distinct().groupBy("template").agg(F.count("*").alias("contexts"))
    carriers = cut_lineage(named.select("template", "sequence").distinct()
                           .groupBy("template").agg(F.count("*").alias("carriers")))
    independent = _independent(named, carriers, min_contexts, own_share)
    varied = ((F.col("contexts") >= min_contexts)
              & (F.col("contexts") * 100 >= F.col("carriers") * diversity))
    recurring = (contexts.join(carriers, "template").join(independent, "template", "left")
                 .where(varied | (F.coalesce("independent", F.lit(0)) >= min_contexts)).select("template"))
    return (named.join(recurring, "template", "left_semi")
            .groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("places")))


def dedup_lines(docs: DataFrame, spare_emptied: bool = False, **options: int) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text``; adds ``n_lines`` and ``n_dropped`` (long).

    NULL text stays NULL with 0 lines; an empty text is one empty line; lines
    of fewer than four tokens are never dropped (short lines recur by chance);
    repeated rows lose the same lines and count as one document; rows with a
    NULL id are treated like others; an empty table gives an empty result;
    columns of ``docs`` named like the added ones are replaced.  With
    ``spare_emptied`` a document that would be left without a word keeps its
    whole text (``n_dropped`` 0): it is one for document dedup to judge.
    """
    places = recurring_lines(docs, **options).select(
        F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), "places")
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    base = docs.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(rest)], F.col("doc_id").alias("d_id"),
                       F.col("text").alias("d_text"), F.xxhash64("text").alias("d_hash"))
    joined = base.join(places, F.col("d_id").eqNullSafe(F.col("p_id")) & (F.col("d_hash") == F.col("p_hash")), "left")
    lines = F.split("d_text", "\n")
    left = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("places", i)), "\n")
    if spare_emptied:
        joined = joined.withColumn("places", F.when(left.rlike(r"[^\x20\x09-\x0D]"), F.col("places")))
    order = [F.when(F.col("places").isNull(), F.col("d_text")).otherwise(left).alias("text") if c == "text"
             else F.col(f"c_{rest.index(c)}").alias(c) for c in docs.columns if c == "text" or c in rest]
    return joined.select(
        *order, F.when(F.col("d_text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("places").isNull(), 0).otherwise(F.size("places")).cast("long").alias("n_dropped"))
