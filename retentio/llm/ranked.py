"""Ranked lexical search: best positions on impact lists.

1. One Arrow pass per text: its number of terms and, for the terms the items
   ask for, their occurrences.  Totals, document frequencies and from them the
   integer weights are aggregates over that table.
2. Documents are dealt at random into shards of a bounded number of postings,
   items into blocks; every shard meets every block once.
3. In a shard each term has an *impact list*, its documents by falling impact.
   For an item, sorted access proceeds on all its lists; every document met is
   looked up in the other lists at once (direct access), which marks its places
   there as seen too.  A list's *best position* is the end of its gapless seen
   prefix.  No unseen document can score more than the sum of the impacts at the
   first unseen places; the scan stops when that sum lies strictly below the
   kth score (a document that only equals it could win by its id).
4. The shards' lists are merged by one ranked window (k rows per shard and item).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from retentio.llm import textfeat as tf
from retentio.session import cut_lineage

MAX_VOCABULARY = 1 << 20   # item terms sent to the scan as a filter; with more, the scan keeps every term
SHARD_POSTINGS = 1 << 20
BLOCK_ITEMS = 4096
FIRST_STEP = 64            # sorted accesses per list in the first round; doubles each round

_OTHER = np.ones(256, dtype=bool)
_OTHER[ord("0"): ord("9") + 1] = _OTHER[ord("A"): ord("Z") + 1] = _OTHER[ord("a"): ord("z") + 1] = False
_OTHER[0x80:] = False


def term_spans(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased (A-Z) bytes of a group of texts, start and end of each term, first term of each text.

    Terms are runs of ASCII letters, digits and everything beyond ASCII.
    """
    buf = np.frombuffer((b"\n".join(texts) + b"\n").lower(), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(_OTHER[buf].view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return buf, starts, ends, np.searchsorted(starts, offsets)


def term_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all terms, first of each text."""
    buf, starts, ends, first = term_spans(texts)
    return tf.span_hashes(buf, starts, ends).view(np.int64), first


def _counted(vocabulary: np.ndarray | None):
    """Arrow pass: (passed columns, n, terms, tfs) of every text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at_text = batch.schema.get_field_index("text")
            for at, group in tf.groups(tf.utf8(batch.column("text"))):
                h, first = term_hashes(group)
                known = np.unique(h) if vocabulary is None else vocabulary
                doc = np.repeat(np.arange(len(group)), np.diff(first))
                place = np.searchsorted(known, h)
                hit = known[np.minimum(place, len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                pairs, counts = np.unique(doc[hit] * max(1, len(known)) + place[hit], return_counts=True)
                owner, place = np.divmod(pairs, max(1, len(known)))
                ends = pa.array(np.searchsorted(owner, np.arange(len(group) + 1)), pa.int32())
                rest = batch.slice(at, len(group)).remove_column(at_text)
                yield pa.RecordBatch.from_arrays(
                    [*rest.columns, pa.array(np.diff(first), pa.int64()),
                     pa.ListArray.from_arrays(ends, pa.array(known[place], pa.int64())),
                     pa.ListArray.from_arrays(ends, pa.array(counts, pa.int64()))],
                    names=[*rest.schema.names, "n", "terms", "tfs"])
    return run


class Shard:
    """Impact lists of one shard, by term and by document."""

    def __init__(self, terms: list[np.ndarray], tfs: list[np.ndarray], m: np.ndarray, wanted: np.ndarray):
        sizes = [len(t) for t in terms]
        t = np.concatenate([np.zeros(0, np.int64), *terms])
        occurrences = np.concatenate([np.zeros(0, np.int64), *tfs])
        doc = np.repeat(np.arange(len(sizes)), sizes)
        self.wanted = wanted
        place = np.searchsorted(wanted, t)
        hit = wanted[np.minimum(place, len(wanted) - 1)] == t if len(wanted) else np.zeros(len(t), bool)
        self.term, doc, occurrences = place[hit], doc[hit], occurrences[hit]
        self.impact = 1_000_000_000 * occurrences // (1000 * occurrences + 12 * m[doc])
        self.of_doc = np.searchsorted(doc, np.arange(len(sizes) + 1))
        self.by_impact = np.lexsort((doc, -self.impact, self.term))
        self.list_at = np.searchsorted(self.term[self.by_impact], np.arange(len(wanted) + 1))
        self.place = np.empty(len(doc), dtype=np.int64)  # of every posting in the concatenated lists
        self.place[self.by_impact] = np.arange(len(doc))
        self.doc = doc
        self.seen = np.zeros(len(doc), dtype=bool)
        self.asked = np.zeros(len(wanted), dtype=np.int64)  # weight of each list for the item at hand

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, sorted and direct accesses): all documents that can be among the k best, ties included."""
        at = np.searchsorted(self.wanted, terms)
        at, weights = at[weights > 0], weights[weights > 0]
        filled = self.list_at[at + 1] > self.list_at[at]
        at, weights = at[filled], weights[filled]
        lo, hi = self.list_at[at], self.list_at[at + 1]
        self.asked[at] = weights
        best = lo.copy()  # first unseen place of every list
        met = np.zeros(len(self.of_doc) - 1, dtype=bool)
        docs, scores, accesses, step = [], [], 0, FIRST_STEP
        kth = 0
        while len(at):
            places = np.concatenate([np.arange(b, min(b + step, h)) for b, h in zip(best, hi)])
            new = np.unique(self.doc[self.by_impact[places]])
            new = new[~met[new]]
            met[new] = True
            # direct accesses: every posting of the new documents
            start, size = self.of_doc[new], self.of_doc[new + 1] - self.of_doc[new]
            ends = np.cumsum(size)
            postings = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
            accesses += len(places) + len(postings)
            run = np.concatenate(([0], np.cumsum(self.asked[self.term[postings]] * self.impact[postings])))
            self.seen[self.place[postings]] = True
            docs.append(new)
            scores.append(run[ends] - run[ends - size])
            for j in range(len(at)):
                rest = self.seen[best[j]: hi[j]]
                gap = int(np.argmin(rest)) if len(rest) else 0
                best[j] = hi[j] if not len(rest) or rest[gap] else best[j] + gap
            open_ = best < hi
            bound = int((weights[open_] * self.impact[self.by_impact[best[open_]]]).sum())
            if sum(map(len, scores)) >= k:
                kth = int(np.partition(np.concatenate(scores), -k)[-k])
            if bound < max(kth, 1):
                break
            at, weights, lo, hi, best = at[open_], weights[open_], lo[open_], hi[open_], best[open_]
            step *= 2
        self.asked[np.searchsorted(self.wanted, terms)] = 0
        found = np.concatenate([np.zeros(0, np.int64), *docs])
        start, size = self.of_doc[found], self.of_doc[found + 1] - self.of_doc[found]
        ends = np.cumsum(size)
        postings = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)
        self.seen[self.place[postings]] = False
        score = np.concatenate([np.zeros(0, np.int64), *scores])
        good = (score > 0) & (score >= kth)
        return found[good], score[good], accesses


def _search(k: int):
    def run(docs: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        out = {"item": [], "no_id": [], "doc_id": [], "score": []}
        if len(docs) and len(items):
            wanted = np.unique(np.concatenate(list(items["terms"])))
            shard = Shard(list(docs["terms"]), list(docs["tfs"]), docs["m"].to_numpy(np.int64), wanted)
            ids, no_id = docs["doc_id"].to_numpy(np.int64), docs["no_id"].to_numpy(bool)
            for item, terms, weights in zip(items["item"], items["terms"], items["weights"]):
                found, score, _ = shard.search(np.asarray(terms), np.asarray(weights), k)
                first = np.lexsort((ids[found], no_id[found], -score))[:k]
                out["item"].append(np.full(len(first), item))
                out["no_id"].append(no_id[found[first]])
                out["doc_id"].append(ids[found[first]])
                out["score"].append(score[first])
        empty = {"no_id": bool}
        return pd.DataFrame({c: np.concatenate([np.zeros(0, empty.get(c, np.int64)), *v]) for c, v in out.items()})
    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20, max_vocabulary: int = MAX_VOCABULARY,
           shard_postings: int = SHARD_POSTINGS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """``item_id``, ``rank``, ``doc_id``, ``score``: the ``k`` best rows of ``docs`` (doc_id, text) for every row of ``items`` (item_id, text).

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's m is
    75 + (25 n N) div L, its score the sum of weight * ((10^9 tf) div (1000 tf + 12 m))
    over the item's terms, repeats included; all but the logarithm in 64-bit
    integers.  Terms are told apart by a 64-bit hash.

    * NULL or empty texts have no terms: such documents count nowhere, such items
      (and items none of whose terms occurs) give no row;
    * every row is a document or an item of its own: repeated documents are ranked
      next to each other, repeated items answered each;
    * ties go to the smaller doc_id, rows without an id come last;
    * empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    asked = cut_lineage(
        items.select(F.monotonically_increasing_id().alias("item"), F.col("item_id").cast("long").alias("item_id"), "text")
        .mapInArrow(_counted(None), "item long, item_id long, n long, terms array<long>, tfs array<long>"))
    lists = asked.select("item", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select(
        "item", F.col("t.terms").alias("term"), F.col("t.tfs").alias("asked"))
    terms = [r["term"] for r in lists.select("term").distinct().limit(max_vocabulary + 1).collect()]
    vocabulary = np.unique(np.array(terms, dtype=np.int64)) if len(terms) <= max_vocabulary else None

    counted = cut_lineage(
        docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        .mapInArrow(_counted(vocabulary), "row long, doc_id long, n long, terms array<long>, tfs array<long>"))
    n_docs, length, postings = counted.agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    n_items = asked.count()
    shards, blocks = max(1, -(-postings // shard_postings)), max(1, -(-n_items // block_items))

    df = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1)))
    weighted = (lists.join(df, "term").withColumn("weight", F.col("asked") * weight)
                .groupBy("item").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
                .select("item", F.col("t.term").alias("terms"), F.col("t.weight").alias("weights")))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    asked_in = weighted.withColumn("block", block).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    searched = (
        counted.where("size(terms) > 0")
        .select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"),
                F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"),
                (75 + F.expr(f"(25 * n * {n_docs}) div {max(1, length)}")).alias("m"), "terms", "tfs"))
    best = (searched.groupBy("shard", "block").cogroup(asked_in.groupBy("shard", "block"))
            .applyInPandas(_search(k), "item long, no_id boolean, doc_id long, score long"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "no_id", "doc_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (ranked.join(asked.select("item", "item_id"), "item")
            .select("item_id", "rank", F.when(~F.col("no_id"), F.col("doc_id")).alias("doc_id"), "score"))
