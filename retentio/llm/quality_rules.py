"""Quality rules: counted base rules, then a calibrated n-gram classifier.

The classifier is a logistic regression over hashed word and character
n-grams, fitted on labelled rows and calibrated on a part of them it has not
seen; its probability is held against a fixed threshold.  Base rules always
win: what fails them is never kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from retentio.llm import linear, training
from retentio.llm import textfeat as tf

BITS = 16
TRAIN_ROWS = 3000
CALIBRATION_SHARE = 0.25
MIN_PROBABILITY = 0.5   # fixed threshold on the calibrated probability
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
REPEAT_WINDOW = 3

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


def _views(w: tf.Words, group: list[bytes]) -> list[linear.View]:
    return linear.word_views(w, BITS) + linear.char_views(w, group, BITS)


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, label: str = "quality") -> Model:
    """Fit and calibrate on at most ``train_rows`` labelled rows; no rows give probability one half."""
    rows, draw = training.labelled_sample(docs, labels, _views, train_rows, label)
    if not len(rows):
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, 0.0)
    held = draw < CALIBRATION_SHARE
    if held.all() or not held.any():
        held[:] = False
    fit = [i for i in range(len(rows)) if not held[i]]
    part = linear.Rows([rows.keys[i] for i in fit], [rows.values[i] for i in fit], rows.labels[fit])
    weights, bias = linear.logistic(part, 1 << BITS)
    check = [i for i in range(len(rows)) if held[i]] or fit
    f = np.array([weights[rows.keys[i]] @ rows.values[i] + bias for i in check])
    return Model(weights, bias, *linear.platt(f, rows.labels[check]))


def counts(w: tf.Words, group: list[bytes]) -> dict[str, np.ndarray]:
    """The base measures of every text of a group."""
    offsets = np.cumsum([0, *(len(t) + 1 for t in group)])

    def per_text(mask: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(mask)))
        return run[offsets[1:]] - run[offsets[:-1]]

    in_word = np.zeros(len(w.buf) + 1, dtype=np.int8)
    in_word[w.starts] += 1
    in_word[w.ends] -= 1
    in_word = np.cumsum(in_word[:-1]) > 0
    points = in_word & ((w.buf & 0xC0) != 0x80)
    dup, repeat = [], []
    for i, text in enumerate(group):
        seen, n = set(), 0
        for line in text.split(b"\n"):
            if line.strip(b" \t\n\r\x0b\x0c"):
                n += line in seen
                seen.add(line)
        dup.append(n)
        h = tf.window_hashes(w.hashes[w.of(i)], REPEAT_WINDOW)
        covered = 0
        if len(h):
            _, where, times = np.unique(h, return_inverse=True, return_counts=True)
            again = times[where] > 1
            cover = np.zeros(len(h) + REPEAT_WINDOW - 1, dtype=bool)
            for j in range(REPEAT_WINDOW):
                cover[j: j + len(h)] |= again
            covered = int(cover.sum())
        repeat.append(covered)
    return {"n_words": np.diff(w.first), "word_chars": per_text(points), "n_symbols": per_text(_SYMBOL[w.buf]),
            "n_dup_lines": np.array(dup), "n_repeat_words": np.array(repeat)}


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, the base measures, ``base_failed``, ``probability`` and ``kept`` of every whole text.

    NULL text counts as no words (and so fails the base rules); repeated rows
    and NULL ids stay; an empty table gives an empty result; other columns are
    ignored.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in tf.groups(tf.utf8(batch.column("text"))):
                w = tf.words(group)
                c = counts(w, group)
                failed = (c["n_words"] < MIN_WORDS) | (
                    100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
                f = linear.scores(_views(w, group), model.weights, model.bias)
                p = linear.sigmoid(model.slope * f + model.offset)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(group)), *(pa.array(c[k], pa.int64()) for k in COUNTS),
                     pa.array(failed), pa.array(p), pa.array(~failed & (p >= MIN_PROBABILITY))],
                    names=["doc_id", *COUNTS, "base_failed", "probability", "kept"])

    schema = (f"doc_id {dict(docs.dtypes)['doc_id']}, " + ", ".join(f"{k} long" for k in COUNTS)
              + ", base_failed boolean, probability double, kept boolean")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
