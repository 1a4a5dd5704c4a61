"""Quality score: hashed word n-grams, logistic regression by FTRL updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from retentio.llm import linear, training
from retentio.llm import textfeat as tf

BITS = 18
TRAIN_ROWS = 4000


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def _views(w: tf.Words, _: list[bytes]) -> list[linear.View]:
    return linear.word_views(w, BITS)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, label: str = "quality") -> Model:
    """Fit on at most ``train_rows`` rows of ``labels`` (doc_id, label); no rows give an even score."""
    rows, _ = training.labelled_sample(docs, labels, _views, train_rows, label)
    if not len(rows):
        return Model(np.zeros(1 << BITS, np.float32), 0.0)
    return Model(*linear.ftrl(rows, 1 << BITS))


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns and ``score`` (0 to 1) of every whole text.

    NULL, empty or white-space text scores the model's bias; repeated rows and
    NULL ids stay; an empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in tf.groups(tf.utf8(batch.column("text"))):
                s = linear.sigmoid(linear.scores(_views(tf.words(group), group), model.weights, model.bias))
                rows = batch.slice(at, len(group))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in keep), pa.array(s, pa.float64())], names=[*keep, "score"])

    keep = [c for c in keep if c != "score"]
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, docs.select(*keep).schema.add("score", "double"))
