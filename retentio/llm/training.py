"""Bounded samples of labelled documents as sparse feature rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm import textfeat as tf
from retentio.llm.linear import Rows, View, sparse_row

Views = Callable[[tf.Words, list[bytes]], list[View]]
Encode = Callable[[list[bytes]], list[bytes]]


def labelled_rows(docs: DataFrame, labels: DataFrame, encode: Encode, train_rows: int, label: str,
                  seed: int = 5) -> list[tuple[bytes, int, float]]:
    """(encoded text, label, stable draw in [0, 1)) of at most ``train_rows`` labelled documents, by draw.

    The sample is drawn from the distinct ids of ``labels`` by a hash, so only
    that bounded table is joined to the scan of ``docs`` and every id gives one
    row at most: of different labels the greatest holds, of different texts the
    one with the smallest hash.  Rows with a NULL id or label teach nothing.
    """
    usable = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
              .groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y")))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30))
    chosen = usable.withColumn("draw", draw).orderBy("draw", "doc_id").limit(train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in tf.groups(tf.utf8(batch.column("text"))):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("y").slice(at, len(group)), batch.column("draw").slice(at, len(group)),
                     pa.array(encode(group), pa.binary())], names=["y", "draw", "x"])

    one = (docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
           .groupBy("doc_id", "y", "draw").agg(F.min_by("text", F.xxhash64("text")).alias("text")))
    rows = one.select("text", "y", "draw").mapInArrow(run, "y int, draw long, x binary").collect()
    rows.sort(key=lambda r: (r["draw"], r["y"], r["x"]))
    return [(r["x"], r["y"], (r["draw"] * 2654435761 % (1 << 32)) / (1 << 32)) for r in rows]


def labelled_sample(docs: DataFrame, labels: DataFrame, views: Views, train_rows: int, label: str,
                    seed: int = 5) -> tuple[Rows, np.ndarray]:
    """The sample of :func:`labelled_rows` as sparse feature rows, with the draw of each."""
    def encode(texts: list[bytes]) -> list[bytes]:
        v = views(tf.words(texts), texts)
        rows = [sparse_row(v, i) for i in range(len(texts))]
        return [k.astype(np.int32).tobytes() + x.astype(np.float32).tobytes() for k, x in rows]

    rows = labelled_rows(docs, labels, encode, train_rows, label, seed)
    half = [len(x) // 2 for x, _, _ in rows]
    return (Rows([np.frombuffer(x[:h], np.int32) for (x, _, _), h in zip(rows, half)],
                 [np.frombuffer(x[h:], np.float32) for (x, _, _), h in zip(rows, half)],
                 np.array([y for _, y, _ in rows], dtype=float)),
            np.array([d for _, _, d in rows]))
