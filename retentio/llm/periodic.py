"""Periodic runs of words: maximal stretches that repeat with a small period.

1. *Tiles.*  One Arrow pass numbers the words of every text.  A run of period p
   repeats an 8-word gram at distance p at every boundary inside it, so only
   boundaries (every P words, P the scale of a period octave [P, 2P)) whose gram
   recurs at a distance of that octave are kept, and a text whose grams are all
   different gives no tile at all.  The kept boundaries of a stretch form one
   tile: the words around them, with as much overlap as the octave needs.
2. *Solving.*  Tiles are dealt over the cluster, whatever document they come
   from.  At each boundary a Z-function forwards and one backwards give, for
   all periods of the octave at once, how far the text agrees with itself
   shifted by p.  That yields fragments (document, period, start, end).
3. *Stitching.*  Fragments meet by (document, period).  Two that overlap by a
   period or more belong to one run; what is long enough after stitching is a
   run, complete to its last word on either side.

Scales: spacing 8 serves the periods 1 to 15, spacing P = 16, 32, ... serves
[P, 2P).  A fragment reaches at most P words back and 2P words beyond the
shifted boundary, so neighbouring fragments of one run overlap by p + 8 words at
least, and a run of three periods (and of 24 words) always holds a boundary
with an agreeing gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm import textfeat as tf
from retentio.session import cut_lineage

MIN_WORDS = 24
MIN_PERIODS = 3
GRAM = 8           # words that must agree at a boundary
BASE = 8           # boundary spacing of the smallest scale (periods 1 to 15)
TILE_WORDS = 1024  # words of a tile without its overlap, or four periods

RUN = "struct<start:long,length:long,period:long>"
_TILE = pa.list_(pa.struct([("scale", pa.int32()), ("lo", pa.int64()), ("bounds", pa.binary()), ("words", pa.binary())]))


def octaves(n: int) -> Iterator[tuple[int, int]]:
    """(scale, smallest period) of every octave a text of n words can hold runs in."""
    if n >= MIN_WORDS:
        yield BASE, 1
    scale = 2 * BASE
    while MIN_PERIODS * scale <= n:
        yield scale, scale
        scale *= 2


def suspicious(w: tf.Words) -> np.ndarray:
    """Whether each text holds some 8-word gram twice."""
    h = tf.window_hashes(w.hashes, GRAM)
    doc = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    at = np.flatnonzero(doc[: len(h)] == doc[GRAM - 1:]) if len(h) else np.zeros(0, np.int64)
    keys = tf.mix(h[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    twice = order[1:][keys[order[1:]] == keys[order[:-1]]]
    out = np.zeros(len(w.first) - 1, dtype=bool)
    out[doc[at[twice]]] = True
    return out


def tiles(hashes: np.ndarray) -> list[dict]:
    """Tiles of one text: per octave the boundaries whose gram recurs, with the words around them."""
    n = len(hashes)
    words = np.unique(hashes, return_inverse=True)[1].astype(np.int32)
    grams = np.unique(tf.window_hashes(hashes, GRAM), return_inverse=True)[1].astype(np.int64)
    if not len(grams):
        return []
    order = np.argsort(grams, kind="stable")
    places = np.append(grams[order] * (n + 1) + order, np.iinfo(np.int64).max)  # sorted (gram, position)
    out = []
    for scale, shortest in octaves(n):
        b = np.arange(0, len(grams), scale)
        row = grams[b] * (n + 1)
        next_place = places[np.searchsorted(places, row + np.minimum(b + shortest, n))]
        b = b[next_place <= row + np.minimum(b + 2 * scale - 1, n)]
        core = b // max(TILE_WORDS, 4 * scale)
        for part in np.split(b, np.flatnonzero(np.diff(core)) + 1) if len(b) else []:
            lo, hi = max(0, part[0] - scale), min(n, part[-1] + 4 * scale)
            out.append({"scale": scale, "lo": int(lo), "bounds": part.astype(np.int64).tobytes(),
                        "words": words[lo:hi].tobytes()})
    return out


def z_function(s: list[int]) -> list[int]:
    """z[i]: how many leading elements of s agree with those from i on."""
    n = len(s)
    z = [n] + [0] * (n - 1)
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _primitive(p: int, z: list[int]) -> bool:
    """Whether the first p elements are no power of a shorter block."""
    q = 1
    while q * q <= p:
        if p % q == 0 and any(d < p and z[d] >= p - d for d in (q, p // q)):
            return False
        q += 1
    return True


def fragments(words: list[int], bounds: list[int], lo: int, scale: int) -> list[tuple[int, int, int]]:
    """(period, start, end) found at the boundaries of one tile; those of one run are joined."""
    shortest = 1 if scale == BASE else scale
    done, open_ = [], {}
    for b in bounds:
        x = b - lo
        ahead = words[x: x + 4 * scale]
        z = z_function(ahead)
        periods = [p for p in range(shortest, min(2 * scale, len(ahead))) if z[p] >= GRAM and _primitive(p, z)]
        if not periods:
            continue
        before = words[max(0, x - scale): x]
        longest = periods[-1]
        back = z_function([*before[::-1], -1, *words[max(0, x - scale): x + longest][::-1]])
        for p in periods:
            behind = min(back[len(before) + 1 + longest - p], scale) if before else 0
            forward = min(z[p], 2 * scale)
            if behind + forward < scale + GRAM:
                continue
            start, end = b - behind, b + p + forward
            if p in open_ and start <= open_[p][1] - p:
                open_[p] = (open_[p][0], max(open_[p][1], end))
            else:
                if p in open_:
                    done.append((p, *open_[p]))
                open_[p] = (start, end)
    return done + [(p, *span) for p, span in open_.items()]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = tf.utf8(batch.column("text"))
        for at, group in tf.groups(texts):
            w = tf.words(group)
            twice = suspicious(w)
            found = [tiles(w.hashes[w.of(i)]) if twice[i] else [] for i in range(len(group))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").slice(at, len(group)), batch.column("doc_id").slice(at, len(group)),
                 pa.array(np.diff(w.first), pa.int64()),
                 pa.array([b" ".join(t.split()) for t in group], pa.binary()).cast(pa.string()),
                 pa.array([bool(f) for f in found], pa.bool_()), pa.array(found, _TILE)],
                names=["row", "doc_id", "n_words", "text", "tiled", "tiles"])


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            words = np.frombuffer(r["words"], np.int32).tolist()
            bounds = np.frombuffer(r["bounds"], np.int64).tolist()
            out += [(r["row"], *f) for f in fragments(words, bounds, r["lo"], r["scale"])]
        columns = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                         names=["row", "period", "start", "end"])


def stitch(pieces: DataFrame) -> DataFrame:
    """``row`` and ``runs`` (by start, then period) from fragments (row, period, start, end)."""
    order = Window.partitionBy("row", "period").orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (F.col("reached").isNull() | (F.col("start") > F.col("reached") - F.col("period"))).cast("int")
    runs = (
        pieces.withColumn("reached", reached)
        .withColumn("run", F.sum(opens).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .withColumn("length", F.col("end") - F.col("start"))
        .where(F.col("length") >= F.greatest(F.lit(MIN_WORDS), MIN_PERIODS * F.col("period")))
    )
    one = F.struct("start", "length", "period")
    return (runs.groupBy("row").agg(F.collect_list(F.struct("start", "period", one.alias("run"))).alias("r"))
            .select("row", F.transform(F.array_sort("r"), lambda x: x["run"]).alias("runs")))


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, runs, n in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(),
                                 batch.column("n_words").to_pylist()):
            gone = np.zeros(n + 1, dtype=np.int64)
            for r in runs:
                gone[r["start"] + r["period"]] += 1
                gone[r["start"] + r["length"]] -= 1
            keep = np.cumsum(gone[:n]) == 0
            texts.append(" ".join([x for x, k in zip(text.split(" "), keep.tolist()) if k]) if runs else text)
        at = batch.schema.get_field_index("text")
        yield batch.set_column(at, "text", pa.array(texts, pa.string())).rename_columns(
            ["doc_id", "n_words", "runs", "collapsed"])


def find_runs(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` (array of start, length, period) and ``collapsed`` of every row of ``docs``.

    A run is a stretch of consecutive words with smallest period q and at least
    max(24, 3 q) words that no neighbouring word extends; ``collapsed`` joins the
    words by one space, without those that lie in some run after its first q
    words.

    * NULL, empty or white-space text: no words, no runs, empty ``collapsed``;
    * repeated rows and rows with a NULL id are judged each for itself;
    * runs of different periods may overlap; all are returned, by start, then period;
    * an empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    cut = cut_lineage(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(_cut, "row long, doc_id long, n_words long, text string, tiled boolean, "
                          "tiles array<struct<scale:int,lo:long,bounds:binary,words:binary>>"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = (cut.where("tiled").select("row", F.explode("tiles").alias("t")).select("row", "t.*")
             .repartition(parts, "row", "scale", "lo"))
    runs = stitch(dealt.mapInArrow(_solve, "row long, period long, start long, end long"))
    none = F.array().cast(f"array<{RUN}>")
    plain = cut.where("NOT tiled").select("doc_id", "n_words", none.alias("runs"), F.col("text").alias("collapsed"))
    tiled = (cut.where("tiled").select("row", "doc_id", "n_words", "text").join(runs, "row", "left")
             .select("doc_id", "n_words", F.coalesce("runs", none).alias("runs"), "text"))
    return plain.union(tiled.mapInArrow(
        _collapse, f"doc_id long, n_words long, runs array<{RUN}>, collapsed string"))


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period (ties: smallest start, then period); NULL without runs."""
    def first(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return (F.when(x != y, F.when(x > y, -1).otherwise(1))
                .when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1))
                .otherwise(F.signum(a["period"] - b["period"]).cast("int")))

    return F.get(F.array_sort(runs, first), F.lit(0))
