"""Benchmark decontamination with SimHash over item-sized windows (SQL functions only).

A document holds a benchmark item when some window of exactly the item's
number of words (the whole text, if that is shorter) is similar to it: weighted
Jaccard of 5-word shingles, a shingle weighing as often as it occurs, at
``threshold`` or more.

1. Windows.  Every document shingle found among the items' shingles (a hit)
   places windows of the sizes at which items hold that shingle: at the offset
   at which the item holds it, and beginning with the hit where enough hits
   follow to reach the threshold.  A window that overhangs an edge is moved
   inside.  No other window is more similar: one that does not begin with a hit
   loses nothing by moving to the right, up to the next hit or the last window,
   and one that does not end with a hit nothing by moving to the left.
   From there on a window no longer knows any item.
2. SimHash.  Each window and each item gets ``PRINTS`` independent 64-bit
   fingerprints of its words, summed bit by bit in packed counters.
3. Candidates.  Fingerprints are cut into ``BLOCKS`` blocks of 16 bits; two within
   ``RADIUS`` bits differ by at most ``NEAR`` bits in at least one block.  Items are
   listed under all values so near (697 a block), windows under their own, equal
   fingerprints of windows once; equi-joining on (size, part, value) and checking
   the distance finds all pairs within the radius in either fingerprint.  The join
   looks at 4 % of the pairs of one size per fingerprint and carries no texts.
4. Confirmation on the exact shingles of window and item, counted by one grouping.

The radius is 15 of 64 bits: a window that just reaches 0.75 differs from its
item in 4 to 10 bits on average, 3 to 5 % of such windows in more than 15; both
fingerprints miss one in a few hundred of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.session import cut_lineage

SHINGLE = 5
PRINTS = 2
RADIUS = 15
BLOCKS = 4
BLOCK_BITS = 64 // BLOCKS
NEAR = RADIUS // BLOCKS
MAX_BROADCAST_ROWS = 1_000_000  # distinct (shingle, size, offset) rows of the benchmark, under 64 MB
_SPREAD = 1 | 1 << 31   # puts two bits into two 32-bit lanes, more than an array has elements
_LANES = 1 | 1 << 32


def words(text: Column) -> Column:
    """Lower-cased words between ASCII white space; an empty array for NULL."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def _shingles(w: Column, n: int) -> Column:
    """Hash of every n consecutive words of the array column ``w``."""
    all_starts = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, n)]))
    return F.slice(all_starts, 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))


def simhash(hashes: Column) -> Column:
    """64-bit SimHash of an array of 64-bit hashes: majority of each bit."""
    bits = F.lit(0).cast("long")
    n = F.size(hashes)
    for j in range(32):
        total = _lane_total(hashes, j)
        for lane in range(2):
            count = F.shiftrightunsigned(total, 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
            bits = bits.bitwiseOR(F.when(count * 2 > n, F.lit(_signed(1 << (2 * j + lane)))).otherwise(
                F.lit(0).cast("long")))
    return bits


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _lane_total(hashes: Column, j: int) -> Column:
    def add(acc: Column, h: Column) -> Column:
        pair = F.shiftrightunsigned(h, 2 * j).bitwiseAND(F.lit(3).cast("long"))
        return acc + (pair * F.lit(_SPREAD)).bitwiseAND(F.lit(_LANES))

    return F.aggregate(hashes, F.lit(0).cast("long"), add)


def _with_prints(rows: DataFrame) -> DataFrame:
    """``rows`` with the fingerprints of the words ``w`` in place of ``w``: one for every seed."""
    def hashes(seed: int) -> Column:
        return F.transform("w", lambda x: F.xxhash64(x, F.lit(seed)))

    seeds = range(PRINTS)
    hashed = rows.select("*", *[hashes(s).alias(f"hashes_{s}") for s in seeds])
    return hashed.select(*[c for c in rows.columns if c != "w"],
                         F.array(*[simhash(F.col(f"hashes_{s}")) for s in seeds]).alias("prints"))


def _parts(prints: Column) -> Column:
    """The blocks of all fingerprints: which one, its value and its whole fingerprint."""
    return F.array(*[
        F.struct(F.lit(s * BLOCKS + b).alias("part"), prints[s].alias("fingerprint"),
                 F.shiftrightunsigned(prints[s], b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("value"))
        for s in range(PRINTS) for b in range(BLOCKS)])


def _close_values(value: Column) -> Column:
    """All values of a block that differ from ``value`` by at most ``NEAR`` bits."""
    flips = ",".join(str(x) for x in range(1 << BLOCK_BITS) if x.bit_count() <= NEAR)
    return F.transform(F.split(F.lit(flips), ",").cast("array<bigint>"), lambda x: x.bitwiseXOR(value))


def _candidates(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(m, prints, item_key): windows' and items' fingerprints of one size within the radius, each pair once."""
    theirs = (items.select("item_key", "m", F.explode(_parts(F.col("prints"))).alias("x"))
              .select("item_key", "m", "x.part", F.col("x.fingerprint").alias("item_fingerprint"),
                      F.explode(_close_values(F.col("x.value"))).alias("value")))
    own = (windows.select("m", "prints").distinct()
           .select("m", "prints", F.explode(_parts(F.col("prints"))).alias("x")).select("m", "prints", "x.*"))
    apart = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_fingerprint")))
    # merged: Catalyst cannot see how many rows the listing makes, and they grow with the benchmark
    return own.join(theirs.hint("merge"), ["m", "part", "value"]).where(apart <= RADIUS).select("m", "prints", "item_key").distinct()


def _per_size(w: str, sizes: list[int], size: Column) -> Column:
    """The shingles of ``w``: of ``SHINGLE`` words, or of all its words when it has fewer."""
    out = F.array().cast("array<bigint>")
    for n in sizes:
        out = F.when(F.least(size, F.lit(SHINGLE)) == n, _shingles(F.col(w), n)).otherwise(out)
    return out


def _window_starts(n_words: Column, m: Column, threshold: int) -> Column:
    """Starts of the windows to build in a document from ``ats`` (sorted hits) and ``starts`` (offsets of items)."""
    last = F.greatest(n_words - m, F.lit(0))
    per_item = m - F.least(m, F.lit(SHINGLE)) + 1
    per_window = F.least(m, n_words) - F.least(m, F.lit(SHINGLE)) + 1
    need = F.greatest(F.ceil((per_item + per_window) * threshold / (100 + threshold)).cast("int"), F.lit(1))
    none = F.array().cast("array<int>")

    def worth(a: Column, i: Column) -> Column:
        # Without a hit at its end, a window loses nothing by moving left to a hit next to it.
        enough = F.get("ats", i + need - 1) - a < per_window
        ends = F.array_contains(F.slice(F.col("ats"), i + need, F.greatest(per_window - need + 1, F.lit(0))), a + per_window - 1)
        return (a <= last) & enough & (ends | ~F.coalesce(F.get("ats", i - 1) == a - 1, F.lit(False)))

    begun = F.transform(F.filter(F.transform("ats", lambda a, i: F.struct(a.alias("a"), worth(a, i).alias("worth"))),
                                 lambda x: x["worth"]), lambda x: x["a"])
    ends = F.get("ats", F.size("ats") - 1) == last + per_window - 1
    at_end = F.when((F.get("ats", F.size("ats") - need) >= last) & (ends | ~F.array_contains("ats", last - 1)),
                    F.array(last)).otherwise(none)
    return F.array_distinct(F.concat(F.transform("starts", lambda s: F.greatest(F.least(s, last), F.lit(0))),
                                     begun, at_end))


def _held(docs: DataFrame, benchmark: DataFrame, threshold: int) -> DataFrame | None:
    """``doc_id, text_hash, item_id, start, n, both, either`` of every window that holds an item; None without items."""
    items = cut_lineage(
        benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
        .withColumn("m", F.size("w")).distinct())
    sizes = sorted(r[0] for r in items.select(F.least("m", F.lit(SHINGLE)).alias("n")).distinct().collect())
    items = cut_lineage(
        items.withColumn("shingles", _per_size("w", sizes, F.col("m")))
        .withColumn("item_key", F.monotonically_increasing_id())
        .transform(_with_prints))
    anchors = cut_lineage(
        items.select("m", F.posexplode("shingles").alias("q", "shingle")).distinct())
    small = anchors.count() <= MAX_BROADCAST_ROWS  # beyond that the join shuffles

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    listed = rows.select("doc_id", "text_hash", words(F.col("text")).alias("w"))
    found = None
    for n in sizes:
        here = listed.select(
            "doc_id", "text_hash", F.size("w").alias("n_words"), F.posexplode(_shingles(F.col("w"), n)).alias("at", "shingle"))
        of_size = anchors.where(F.least("m", F.lit(SHINGLE)) == n)
        hits = here.join(F.broadcast(of_size) if small else of_size, "shingle").select(
            "doc_id", "text_hash", "n_words", "m", "at", (F.col("at") - F.col("q")).alias("start"))
        found = hits if found is None else found.union(hits)
    if found is None:  # no item, nothing to find
        return None
    places = cut_lineage(
        found.groupBy("doc_id", "text_hash", "n_words", "m")
        .agg(F.sort_array(F.collect_set("at")).alias("ats"), F.collect_set("start").alias("starts"))
        .select("doc_id", "text_hash", "m", F.explode(
            _window_starts(F.col("n_words"), F.col("m"), threshold)).alias("start"))
        .groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "m")).alias("places")))

    p = places.select(F.col("doc_id").alias("p_id"), F.col("text_hash").alias("p_hash"), "places")
    held = (
        rows.join(p, rows.doc_id.eqNullSafe(p.p_id) & (rows.text_hash == p.p_hash))
        .select("doc_id", "text_hash", "places", words(F.col("text")).alias("w"))
        .select("doc_id", "text_hash", F.explode(F.transform("places", lambda x: F.struct(
            x["start"].alias("start"), x["m"].alias("m"),
            F.slice(F.col("w"), x["start"] + 1, x["m"]).alias("w")))).alias("x"))
        .select("doc_id", "text_hash", "x.*"))
    windows = cut_lineage(
        held.select("doc_id", "text_hash", "start", "m", F.size("w").alias("n"),
                    _per_size("w", sizes, F.col("m")).alias("own_shingles"), "w").transform(_with_prints)
        .withColumn("window_key", F.monotonically_increasing_id()))

    near = (windows.join(_candidates(windows, items), ["m", "prints"])
            .join(items.select("item_key", "item_id", F.col("shingles").alias("item_shingles")), "item_key"))
    place = ["window_key", "item_key"]
    counted = (
        near.select(*place, "doc_id", "text_hash", "item_id", "start", "n", F.explode(F.concat(
            F.transform("own_shingles", lambda x: F.struct(x.alias("shingle"), F.lit(1).alias("own"), F.lit(0).alias("theirs"))),
            F.transform("item_shingles", lambda x: F.struct(x.alias("shingle"), F.lit(0).alias("own"), F.lit(1).alias("theirs"))),
        )).alias("x"))
        .repartition(*place)  # both groupings below use it
        .groupBy(*place, "doc_id", "text_hash", "item_id", "start", "n", "x.shingle")
        .agg(F.sum("x.own").alias("own"), F.sum("x.theirs").alias("theirs")))
    return (counted.groupBy(*place, "doc_id", "text_hash", "item_id", "start", "n")
            .agg(F.sum(F.least("own", "theirs")).alias("both"), F.sum(F.greatest("own", "theirs")).alias("either"))
            .where(F.col("both") * 100 >= F.col("either") * threshold))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: int = 75) -> DataFrame:
    """One row per (document, item) held: ``doc_id, item_id, start_word, n_words, similarity``.

    The best window is reported (highest similarity, then the first); a text
    shorter than an item is one window, ``n_words`` its length.  NULL or
    empty documents and items hold and are nothing; items of fewer than five
    words are one shingle of all their words; repeated rows give one row per
    (doc_id, item_id); rows with a NULL id are judged and reported with a NULL
    id; empty tables give an empty result; other columns are ignored.
    """
    hit = _held(docs, benchmark, threshold)
    if hit is None:
        ids = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
        return docs.sparkSession.createDataFrame([], "doc_id {}, item_id {}, start_word int, n_words int, "
                                                     "similarity double".format(*ids))
    return (
        hit.groupBy("doc_id", "item_id")
        .agg(F.max(F.struct((F.col("both") / F.col("either")).alias("similarity"), (-F.col("start")).alias("first"),
                            F.col("n").alias("n"))).alias("best"))
        .select("doc_id", "item_id", (-F.col("best.first")).alias("start_word"), F.col("best.n").alias("n_words"),
                F.col("best.similarity").alias("similarity")))


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: int = 75) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, judged row by row.

    Of rows that share an id only those that hold an item go, and rows with a
    NULL id go like others; NULL and empty texts stay; without items all stay.
    """
    hit = _held(docs, benchmark, threshold)
    if hit is None:
        return docs
    gone = hit.select(F.col("doc_id").alias("g_id"), F.col("text_hash").alias("g_hash")).distinct()
    return docs.join(gone, docs.doc_id.eqNullSafe(gone.g_id) & (F.xxhash64(docs.text) == gone.g_hash), "left_anti")
