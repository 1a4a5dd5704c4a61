"""Near-duplicate documents by b-bit MinHash over 5-word shingles.

1. One Arrow pass per text: the set of shingle hashes, a digest of that set,
   512 minima, one key per band of 4 of the first 128 of them, and the 4 low
   bits of every (scrambled) minimum packed into 32 longs.
2. Rows with the same digest collapse to one *class* before anything is
   compared, so thousands of exact copies cost one node.  From here on a class is
   a number, and only classes that share a bucket carry their packed bits.
3. Classes that share a band key are candidates.  Instead of all pairs of a
   band bucket, every class is first compared with one *centre*: among the
   centres of its buckets the one that meets most other classes.  Confirmed
   links are closed to components.
4. While buckets hold more pairs across components than a small multiple of
   their rows, and the last round made fewer, another round compares the classes
   outside a bucket's largest component with a member of it, drawn anew in every
   bucket, and closes the links again.  A round is linear in the rows of buckets.
5. The exact rest: in buckets that still hold several components, classes
   outside the largest one meet all classes of other components.  A pair is
   looked at in the first band it shares only, and sizes too far apart are left.
   Two classes measured against one centre share at most the smaller of their
   overlaps with it, and what both have outside it; pairs that this bound keeps
   below the threshold are no candidates, so of many edited copies of one text
   only those meet that share an edit.
6. All rounds estimate the similarity from the packed bits (bit counts,
   corrected for chance agreement) before the full sets are fetched, and a
   link counts only when the full sets reach the threshold.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm import textfeat as tf
from retentio.llm.components import connected_components
from retentio.session import cut_lineage

N_MINIMA = 512      # the packed estimate's standard error at similarity 0.75 is 0.02
BANDED = 128
ROWS_PER_BAND = 4   # a pair at similarity 0.75 shares none of 32 bands with probability 5e-6
BITS = 4
LONGS = N_MINIMA * BITS // 64
MARGIN = 0.08       # four standard errors
BATCH_BYTES = 8 << 20  # of Arrow data: pairs carry two full sets each
GROUP_BYTES = 1 << 18  # texts are hashed in groups of about this many bytes; a group's arrays take 30 times that
BITMAP_WORDS = 1 << 18  # of 64 bits, broadcast: 4 MB at most
ENOUGH = 4          # pairs across components per row of open buckets that the exact rest may start with

_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, N_MINIMA, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _rng.integers(0, 1 << 32, N_MINIMA, dtype=np.uint64).astype(np.uint32)[:, None]
_BAND_MULT = (_rng.integers(1, 1 << 63, ROWS_PER_BAND, dtype=np.uint64) | np.uint64(1))[None, :]
_BAND_SEED = _rng.integers(1, 1 << 63, BANDED // ROWS_PER_BAND, dtype=np.uint64)


def minima(shingles: np.ndarray) -> np.ndarray:
    """The minima (uint32) of a set of shingle hashes."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)[None, :]
    best = np.full(N_MINIMA, 0xFFFFFFFF, dtype=np.uint32)
    for at in range(0, x.shape[1], 256):  # the products stay in cache
        np.minimum(best, (x[:, at: at + 256] * _A + _B).min(axis=1), out=best)
    return best


def band_keys(m: np.ndarray) -> np.ndarray:
    rows = m[:BANDED].reshape(-1, ROWS_PER_BAND).astype(np.uint64)
    return tf.mix((rows * _BAND_MULT).sum(axis=1, dtype=np.uint64) ^ _BAND_SEED).view(np.int64)


def packed_bits(m: np.ndarray) -> np.ndarray:
    low = ((m * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint8) & np.uint8((1 << BITS) - 1)
    return (low[0::2] | (low[1::2] << np.uint8(BITS))).view(np.int64)


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tf.handed_back(batches):
        texts = tf.utf8(batch.column("text"))
        ids, hashes = batch.column("doc_id"), batch.column("text_hash")
        for at, group in tf.groups([t.lower() for t in texts], GROUP_BYTES):
            w = tf.words(group)
            sizes, digests, bands, packs = [], [], [], []
            for i in range(len(group)):
                s = tf.shingles(w, i)
                sizes.append(len(s))
                if len(s):
                    m = minima(s)
                    digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest())
                    bands.append(band_keys(m))
                    packs.append(packed_bits(m))
                else:
                    digests.append(None)
                    bands.append(None)
                    packs.append(None)
            n = len(group)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, n), hashes.slice(at, n), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(packs, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n_shingles", "digest", "bands", "bits"])


def _sets(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tf.handed_back(batches):
            texts, keys = tf.utf8(batch.column("text")), batch.column(key)
            for at, group in tf.groups([t.lower() for t in texts], GROUP_BYTES):
                w = tf.words(group)
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(at, len(group)),
                     pa.array([tf.shingles(w, i).tobytes() for i in range(len(group))], pa.binary())],
                    names=[key, "shingles"])
    return run


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tf.handed_back(batches):
            linked, shared, outside = [], [], []
            for a, b in zip(batch.column("set_u"), batch.column("set_v")):
                x = np.frombuffer(a.as_buffer(), dtype=np.uint64)
                y = np.frombuffer(b.as_buffer(), dtype=np.uint64)
                common = np.intersect1d(x, y, assume_unique=True)
                both = len(common)
                linked.append(100 * both >= threshold * (len(x) + len(y) - both))
                shared.append(both)
                outside.append(np.setdiff1d(x, common, assume_unique=True).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_()), pa.array(shared, pa.int64()),
                 pa.array(outside, pa.list_(pa.int64()))], names=["u", "v", "linked", "both", "outside"])
    return run


def estimate(a: str, b: str) -> Column:
    """Similarity estimate of two packed signatures, corrected for agreement by chance."""
    nibble = F.lit(int("1" * 16, 16))

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        for j in (1, 2):  # fold every 4-bit lane into its lowest bit
            z = z.bitwiseOR(F.shiftrightunsigned(z, j))
        return F.bit_count(z.bitwiseAND(nibble))

    differ = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda total, x: total + x)
    chance = 1 / (1 << BITS)
    return (1 - differ / N_MINIMA - chance) / (1 - chance)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_hash, ...) with the key columns ``no_id``, ``id`` and a place in the bitmap of keys."""
    at = F.pmod(F.xxhash64("text_hash", "doc_id"), F.lit(64 * BITMAP_WORDS))
    return rows.select(
        F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), "text_hash",
        F.shiftright(at, 6).alias("word"), (at % 64).cast("int").alias("bit"), *(c for c in rows.columns if c not in ("doc_id", "text_hash")))


def _likely(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows with a wanted key and few others, without a shuffle: a bitmap of the keys, bounded in size, goes to all tasks."""
    bitmap = wanted.groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("set"))
    return (_keyed(rows).join(F.broadcast(bitmap), "word")
            .where(F.call_function("shiftrightunsigned", "set", "bit").bitwiseAND(F.lit(1)) == 1))


def _full_sets(rows: DataFrame, chosen: DataFrame, classes: DataFrame) -> DataFrame:
    """The key of ``classes`` and the ``shingles`` of each; ``chosen`` names a row (doc_id, text_hash) of every class."""
    (name, kind), = classes.dtypes
    wanted = cut_lineage(_keyed(chosen.join(classes, name)))
    key = ["no_id", "id", "text_hash"]
    return cut_lineage(
        _likely(rows, wanted).select(*key, "text").join(wanted.select(*key, name), key).dropDuplicates(key)
        .select(name, "text").mapInArrow(_sets(name), f"{name} {kind}, shingles binary"))


def _verified(pairs: DataFrame, full_sets: Callable[[DataFrame], DataFrame], threshold: int) -> DataFrame:
    """The (u, v) pairs by their full sets: ``linked`` (the threshold is reached), ``both`` (shared shingles) and
    ``outside`` (those of u that v lacks); only classes in a pair have their sets made."""
    pairs = cut_lineage(pairs)
    sets = full_sets(pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct())
    full = (
        pairs.join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("set_v")), "v")
        .join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("set_u")), "u")
    )
    return full.select("u", "v", "set_u", "set_v").mapInArrow(
        _confirm(threshold), "u long, v long, linked boolean, both long, outside array<long>")


def near_duplicates(docs: DataFrame, threshold: int = 75) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): component and kept flag.

    Returns ``doc_id``, ``n_shingles``, ``component_id``, ``kept``,
    ``text_hash`` (xxhash64 of the text).  Two documents are linked when 100 * |A & B| >= threshold *
    |A | B| over their distinct lower-cased (A-Z) 5-word shingles.

    * NULL, empty or white-space text: no shingles, linked with nothing, its
      own component, kept;
    * fewer than five words: the whole sequence is the only shingle;
    * repeated rows: each row is returned; equal ids share their component;
    * a row without doc_id is never a component's name; when its whole
      component has none, ``component_id`` is NULL and the row is kept;
    * an empty table gives an empty result; other columns are ignored.
    """
    with tf.arrow_batches(docs.sparkSession, BATCH_BYTES):
        signed, classes, labels = _classes(docs, threshold)
    linked = labels.join(classes.select("node", "first_id"), "node")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = (classes.select("digest", "node", "first_id")
                 .join(linked.join(smallest, "root").select("node", "component_id"), "node", "left")
                 .select("digest", F.coalesce("component_id", "first_id").alias("component_id")))
    return (
        signed.select("doc_id", "n_shingles", "digest", "text_hash").join(component, "digest", "left")
        .withColumn("component_id", F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
        .withColumn("kept", F.col("component_id").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select("doc_id", "n_shingles", "component_id", "kept", "text_hash")
    )


def _classes(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signature rows, classes of equal sets and (node, root) of the linked classes, all written."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = cut_lineage(rows.mapInArrow(
        _signatures, "doc_id long, text_hash long, n_shingles long, digest string, "
                     "bands array<long>, bits array<long>"))
    sets = signed.where("digest IS NOT NULL")
    classes = cut_lineage(
        sets.groupBy("digest")
        .agg(F.min("doc_id").alias("first_id"), F.min(F.struct(
            F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("sample"),
            F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()))
    full_sets = functools.partial(_full_sets, rows, classes.select("node", "sample.doc_id", "sample.text_hash"))

    probes = classes.select("node", F.explode("bands").alias("band"))
    shared = probes.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    members = cut_lineage(probes.join(shared, "band"))
    reps = cut_lineage(_signed_members(sets, classes, members))
    weight, bits = reps.select("node", "weight"), reps.select("node", "bits")

    centres = (members.join(weight, "node").groupBy("band")
               .agg(F.max(F.struct("weight", "node")).alias("c")))
    star = (members.join(centres, "band").groupBy("node").agg(F.max("c").alias("c"))
            .select(F.col("node").alias("u"), F.col("c.node").alias("v")).where("u <> v"))
    measured = cut_lineage(_verified(_estimated(star, bits, threshold), full_sets, threshold))
    labels = connected_components(measured.where("linked").select("u", "v"))

    before, turn = None, 0
    while True:
        named = _named(members, labels)
        open_bands = cut_lineage(_open(named))
        across, held = open_bands.agg(F.sum("across"), F.sum("held")).first()
        if not across or across <= ENOUGH * held or (before is not None and 8 * across > 7 * before):
            break
        before, turn = across, turn + 1
        labels = cut_lineage(_joined(labels, _verified(
            _estimated(_drawn(named, open_bands, turn), bits, threshold), full_sets, threshold).where("linked")))
    if across:
        more = _verified(_rest(named, open_bands, reps, measured, threshold), full_sets, threshold).where("linked")
        labels = cut_lineage(_joined(labels, more))
    return signed, classes, labels


def _signed_members(sets: DataFrame, classes: DataFrame, members: DataFrame) -> DataFrame:
    """(node, n, weight, bands, bits) of every class in ``members``: the rows of its buckets together, the buckets in
    order, and from the signature rows ``sets`` the packed bits."""
    held = members.groupBy("node").agg(F.sum("size").alias("weight"), F.sort_array(F.collect_list("band")).alias("bands"))
    known = classes.select("node", "digest", "n").join(held, "node")
    return sets.select("digest", "bits").dropDuplicates(["digest"]).join(known, "digest").drop("digest")


def _named(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, node, root) of every class in a bucket; a class without a link is its own root."""
    return (members.select("band", "node").join(labels, "node", "left")
            .withColumn("root", F.coalesce("root", "node")))


def _open(named: DataFrame) -> DataFrame:
    """Buckets of several components: rows, pairs across components and the largest component."""
    parts = named.groupBy("band", "root").agg(F.count("*").alias("n"))
    return (parts.groupBy("band").agg(F.count("*").alias("parts"), F.sum("n").alias("held"),
                                      F.sum(F.col("n") * F.col("n")).alias("squares"), F.max(F.struct("n", "root")).alias("m"))
            .where("parts > 1")
            .select("band", "held", F.expr("(held * held - squares) div 2").alias("across"), F.col("m.root").alias("main")))


def _drawn(named: DataFrame, open_bands: DataFrame, turn: int) -> DataFrame:
    """(u, v): every class outside its bucket's largest component with one member of that, drawn by the turn."""
    inside = named.join(open_bands.select("band", "main"), "band")
    drawn = (inside.where("root = main").groupBy("band")
             .agg(F.min(F.struct(F.xxhash64("node", "band", F.lit(turn)).alias("h"), "node")).alias("c")))
    return (inside.where("root <> main").join(drawn, "band")
            .select(F.col("node").alias("u"), F.col("c.node").alias("v")).distinct())


def _reaches(both: Column, n_u: str, n_v: str, threshold: int) -> Column:
    """Whether sets of these sizes that share ``both`` elements reach the threshold."""
    return 100 * both >= threshold * (F.col(n_u) + F.col(n_v) - both)


def _rest(named: DataFrame, open_bands: DataFrame, reps: DataFrame, measured: DataFrame, threshold: int) -> DataFrame:
    """(u, v): all pairs of a bucket from different components that may be linked, once each.

    ``measured`` has the overlap of a class u with one centre v, and u's
    shingles outside of it.  Where both classes have the same centre, their sets
    share at most the smaller overlap and the shingles that both have outside.
    """
    known = measured.select(F.col("u").alias("node"), F.col("v").alias("centre"), "both")
    before = F.slice("bands", F.lit(1), F.array_position("bands", F.col("band")).cast("int") - 1)
    held = cut_lineage(
        named.join(open_bands.select("band", "main"), "band").join(reps, "node").join(known, "node", "left")
        .select("band", "main", "node", "root", "n", "centre", "both", before.alias("before"), "bits"))
    columns = ("node", "root", "n", "centre", "both", "before", "bits")
    a = held.where("root <> main").select("band", *(F.col(c).alias(f"{c}_u") for c in columns))
    b = held.select(F.col("band").alias("band_v"), "main", *(F.col(c).alias(f"{c}_v") for c in columns))
    first = ~F.arrays_overlap("before_u", "before_v")
    sizes = 100 * F.least("n_u", "n_v") >= threshold * F.greatest("n_u", "n_v")
    # a class and its centre were measured already; two classes of one centre need the overlaps alone or meet below
    settled = F.coalesce(F.col("centre_u") == F.col("node_v"), F.lit(False)) | F.coalesce(
        F.col("centre_v") == F.col("node_u"), F.lit(False)) | F.coalesce(
        (F.col("centre_u") == F.col("centre_v")) & ~_reaches(F.least("both_u", "both_v"), "n_u", "n_v", threshold), F.lit(False))
    # two classes outside the largest component meet twice; the smaller node leads
    once = (F.col("root_v") == F.col("main")) | (F.col("node_u") < F.col("node_v"))
    pairs = a.join(b, (F.col("band") == F.col("band_v")) & (F.col("root_u") != F.col("root_v")) & once & sizes & ~settled
                   & (estimate("bits_u", "bits_v") >= threshold / 100 - MARGIN) & first)

    marks = (held.where("centre IS NOT NULL").select("node", "root", "n", "both").distinct()
             .join(measured.select(F.col("u").alias("node"), F.col("v").alias("centre"), "outside"), "node")
             .select("node", "root", "n", "both", "centre", F.explode("outside").alias("mark")))
    mixed = marks.groupBy("centre", "mark").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    marks = cut_lineage(marks.join(mixed.select("centre", "mark"), ["centre", "mark"]))
    u, v = (marks.select("centre", "mark", *(F.col(c).alias(f"{c}_{end}") for c in ("node", "root", "n", "both"))) for end in "uv")
    sharing = (
        u.join(v, ["centre", "mark"]).where((F.col("root_u") != F.col("root_v")) & (F.col("node_u") < F.col("node_v")) & sizes)
        .groupBy("node_u", "node_v", "n_u", "n_v", "both_u", "both_v").agg(F.count("*").alias("shared"))
        .where(_reaches(F.least("both_u", "both_v") + F.col("shared"), "n_u", "n_v", threshold)))
    ends = F.col("node_u").alias("u"), F.col("node_v").alias("v")
    return pairs.select(*ends).union(_estimated(sharing.select(*ends), reps, threshold)).distinct()


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, root) after further links (u, v) between their components."""
    def root(end: str) -> DataFrame:
        return labels.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))

    edges = (links.join(root("u"), "u", "left").join(root("v"), "v", "left")
             .select("u", "v", F.coalesce("root_u", "u").alias("root_u"), F.coalesce("root_v", "v").alias("root_v")))
    edges = cut_lineage(edges)
    over = connected_components(edges.select(F.col("root_u").alias("u"), F.col("root_v").alias("v")))
    nodes = (labels.union(edges.select("u", "root_u")).union(edges.select("v", "root_v"))).distinct()
    return (nodes.join(over.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
            .select("node", F.coalesce("top", "root").alias("root")))


def _estimated(pairs: DataFrame, bits: DataFrame, threshold: int) -> DataFrame:
    both = (pairs.join(bits.select(F.col("node").alias("u"), F.col("bits").alias("bits_u")), "u")
            .join(bits.select(F.col("node").alias("v"), F.col("bits").alias("bits_v")), "v"))
    return both.where(estimate("bits_u", "bits_v") >= threshold / 100 - MARGIN).select("u", "v")
