"""Toxicity: maximum-scoring segments over token log-odds.

*Model.*  For the words of a bounded sample of labelled texts, and for their
prefixes of 3 to 8 bytes, the texts that hold them are counted per class.  The
share of toxic texts at a beginning is smoothed by a Dirichlet prior centred on
the next shorter one.  Its value is its log-odds against the whole sample, moved
towards zero by the standard error; while too few texts hold it, or its log-odds
agree with the shorter beginning's value within that error, that value stands.
A token's score is the value of its longest known beginning, less a drift that
makes the mean score of clean text negative.

*Segments.*  One linear scan of a text finds all maximal scoring segments (the
disjoint stretches that no extension or cut improves).  With lambda the positive
root of E[exp(lambda * score)] = 1 under the clean tokens, the best segment of n
clean tokens exceeds S with probability about 1 - exp(-K n exp(-lambda S)); K is
fitted on the clean sample.  A segment is *significant* if that many tokens let
fewer than ``max_expected`` such segments arise by chance.

*Score.*  The evidence of a text is the sum, over its segments that are expected
less than once, of -ln(expected number).  A logistic fit on the sample turns it
into a probability; each third of it is scored by the others' model for that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, StructType

from retentio.llm import linear
from retentio.llm import textfeat as tf
from retentio.llm.ranked import term_spans
from retentio.llm.training import labelled_rows

NOTHING = np.uint64(0)  # the key of beginnings that do not exist
TRAIN_ROWS = 4000
PREFIXES = (3, 4, 5, 6, 7, 8)  # bytes; then the whole word
PRIOR = 4.0           # texts the Dirichlet prior counts for
SUPPORT = 5           # texts that must hold a beginning
DRIFT = 0.5           # subtracted from every token's score, plus what a negative mean needs
MAX_EXPECTED = 0.05

PASSAGES = ArrayType(StructType().add("start", "long").add("end", "long").add("score", "double"))


@dataclass
class Model:
    keys: np.ndarray     # sorted 64-bit hashes of the beginnings that have a value of their own
    scores: np.ndarray   # float32, of each
    unknown: float       # score of a token without a known beginning
    rate: float          # lambda
    log_k: float
    slope: float
    offset: float


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed beginnings of every token (a row for each length, the whole token last), and the first token of each text.

    A beginning is shorter than its token; where there is none, the place is NOTHING.
    """
    buf, starts, ends, first = term_spans(texts)
    rows = []
    for i, n in enumerate((*PREFIXES, None)):
        h = tf.span_hashes(buf, starts, ends if n is None else np.minimum(starts + n, ends))
        h = tf.mix(h ^ np.uint64(i * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        rows.append(h if n is None else np.where(ends - starts > n, h, NOTHING))
    return np.stack(rows), first


def table_scores(keys: np.ndarray, model: Model) -> np.ndarray:
    """The score of every column of beginnings: that of the longest one that has a value."""
    out = np.full(keys.shape[1], model.unknown, dtype=np.float32)
    if len(model.keys):
        for row in keys:
            at = np.minimum(np.searchsorted(model.keys, row), len(model.keys) - 1)
            out = np.where(model.keys[at] == row, model.scores[at], out)
    return out


def token_scores(keys: np.ndarray, model: Model) -> np.ndarray:
    """The score of every token; one that only repeats the token before it adds no evidence."""
    out = table_scores(keys, model)
    again = keys[-1][1:] == keys[-1][:-1]
    out[1:][again] = np.minimum(out[1:][again], np.float32(model.unknown))
    return out


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum), left to right, in linear time.

    The list holds disjoint candidates with the running total before and after
    each.  A new positive score joins the nearest candidate to its left whose
    left total is smaller, if that one's right total is smaller than the new
    right total, along with everything in between; otherwise it stands alone.
    """
    at = np.flatnonzero(scores > 0)
    run = np.concatenate(([0.0], np.cumsum(scores, dtype=np.float64)))
    found, below = [], []  # found: (start, end, left, right); below: nearest with a smaller left total
    for i, left, total in zip(at.tolist(), run[at].tolist(), run[at + 1].tolist()):
        start = i
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = below[j]
            if j < 0 or found[j][3] >= total:
                break
            start, left = found[j][0], found[j][2]
            del found[j:], below[j:]
            j = len(found) - 1
        found.append((start, i + 1, left, total))
        below.append(j)
    return [(a, b, right - left) for a, b, left, right in found]


def _log_odds(table: np.ndarray, doc: np.ndarray, word: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, log-odds) of the beginnings that have a value of their own, one level after the other.

    ``table``: the beginnings of every different word; (``doc``, ``word``): which text holds which.
    """
    here = labels[np.unique(doc)]
    n_bad, n_good = here.sum() + 1.0, (here == 0).sum() + 1.0
    # share of toxic texts and value at the longest beginning so far, for every word
    above = np.full(table.shape[1], n_bad / (n_bad + n_good))
    held = np.zeros(table.shape[1])
    keys, values = [], []
    for level in table:
        nodes, at, node = np.unique(level, return_index=True, return_inverse=True)
        owner, held_node = np.divmod(np.unique(doc * len(nodes) + node[word]), len(nodes))
        bad = np.bincount(held_node, weights=labels[owner], minlength=len(nodes))
        good = np.bincount(held_node, minlength=len(nodes)) - bad
        b, g = bad + PRIOR * above[at], good + PRIOR * (1 - above[at])
        odds = np.log(b / g) - np.log(n_bad / n_good)
        error = np.sqrt(1 / (bad + 1) + 1 / (good + 1))
        own = (bad + good >= SUPPORT) & (np.abs(odds - held[at]) > error) & (nodes != NOTHING)
        value = np.where(own, np.sign(odds) * np.maximum(0, np.abs(odds) - error), held[at])
        keys.append(nodes[own])
        values.append(value[own])
        real = level != NOTHING
        above, held = np.where(real, (b / (b + g))[node], above), np.where(real, value[node], held)
    return np.concatenate(keys), np.concatenate(values)


def _root(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive lambda with mean exp(lambda * score) = 1 (negative mean, some positive scores)."""
    p = weights / weights.sum()
    lo, hi = 0.0, 1.0
    top = float(scores.max())
    while (p * np.exp(np.minimum(hi * scores, 600.0))).sum() < 1 and hi * top < 500:
        lo, hi = hi, 2 * hi
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * scores, 600.0))).sum() < 1 else (lo, mid)
    return max((lo + hi) / 2, 1e-6)


def evidence(found: list[tuple[int, int, float]], n: int, model: Model, max_expected: float = MAX_EXPECTED):
    """The significant ones of a text's segments, and the sum of -ln(expected number) over those expected less than once."""
    chance = max(0.0, model.log_k + float(np.log(max(n, 1))))
    x = model.rate * np.array([s for *_, s in found]) - chance
    return [f for f, v in zip(found, x.tolist()) if v > -np.log(max_expected)], float(x[x > 0].sum())


@dataclass
class Sample:
    table: np.ndarray   # beginnings of every different word
    word: np.ndarray    # of every token, in text order
    doc: np.ndarray
    labels: np.ndarray


def _model(sample: Sample, chosen: np.ndarray) -> Model:
    """Token scores, lambda and K from the chosen texts of a sample."""
    used = chosen[sample.doc]
    keys, odds = _log_odds(sample.table, sample.doc[used], sample.word[used], sample.labels)
    order = np.argsort(keys)
    model = Model(keys[order], odds[order].astype(np.float32), 0.0, 1.0, 0.0, 1.0, 0.0)
    by_word = table_scores(sample.table, model)
    clean = np.bincount(sample.word[used & (sample.labels[sample.doc] == 0)], minlength=len(by_word)).astype(float)
    drift = DRIFT + max(0.0, float((by_word * clean).sum() / max(1.0, clean.sum())))
    model.scores, model.unknown, by_word = model.scores - np.float32(drift), -drift, by_word - np.float32(drift)
    best = by_word.max(initial=0.0)
    if best > 0:
        model.rate = _root(np.append(by_word[clean > 0], best).astype(float), np.append(clean[clean > 0], 0.5))
    # the best segment of a clean text: K n exp(-lambda S) is one on average
    tails = [len(r) * np.exp(-model.rate * max((s for *_, s in f), default=0.0))
             for i, r, f in _segmented(sample, model, chosen & (sample.labels == 0)) if len(r)]
    model.log_k = -float(np.log(max(np.mean(tails), 1e-12))) if tails else 0.0
    return model


def _segmented(sample: Sample, model: Model, chosen: np.ndarray):
    """(text, token scores, segments) of the chosen texts."""
    by_word = table_scores(sample.table, model)
    ends = np.searchsorted(sample.doc, np.arange(len(sample.labels) + 1))
    for i in np.flatnonzero(chosen).tolist():
        w = sample.word[ends[i]: ends[i + 1]]
        r = by_word[w]
        r[1:][w[1:] == w[:-1]] = np.minimum(r[1:][w[1:] == w[:-1]], np.float32(model.unknown))
        yield i, r, segments(r)


def fit(texts: list[bytes], labels: np.ndarray, folds: int = 3) -> Model:
    """Model from a sample of labelled texts; the probability is fitted on texts that did not score themselves."""
    labels = np.asarray(labels, dtype=float)
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Model(np.zeros(0, np.uint64), np.zeros(0, np.float32), -DRIFT, 1.0, 0.0, 1.0, float(np.log(share / (1 - share))))
    parts = [tokens(group) for _, group in tf.groups(texts)]
    sizes = np.concatenate([np.diff(first) for _, first in parts])
    _, one, word = np.unique(np.concatenate([k[-1] for k, _ in parts]), return_index=True, return_inverse=True)
    table = np.stack([np.concatenate([k[i] for k, _ in parts])[one] for i in range(len(PREFIXES) + 1)])
    sample = Sample(table, word, np.repeat(np.arange(len(texts)), sizes), labels)
    fold = np.arange(len(labels)) % folds
    total = np.zeros(len(labels))
    for f in range(folds):
        model = _model(sample, fold != f)
        for i, r, found in _segmented(sample, model, fold == f):
            total[i] = evidence(found, len(r), model)[1]
    model = _model(sample, np.ones(len(labels), dtype=bool))
    model.slope, model.offset = linear.platt(total, labels)
    return model


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, label: str = "toxic") -> Model:
    """Fit on at most ``train_rows`` labelled rows; no rows or one class only give the same score to every text."""
    rows = labelled_rows(docs, labels, lambda texts: texts, train_rows, label)
    return fit([x for x, _, _ in rows], np.array([y for _, y, _ in rows], dtype=float))


def detect(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns, ``n_tokens``, ``passages`` (significant: start, end in tokens, score) and ``score`` of every text.

    NULL, empty or token-free text: no passage, the score of a text without
    evidence.  Repeated rows and NULL ids stay; an empty table gives an empty
    result; columns named like a result column are replaced.
    """
    keep = [c for c in keep if c not in ("n_tokens", "passages", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, group in tf.groups(tf.utf8(batch.column("text"))):
                h, first = tokens(group)
                score = token_scores(h, model)
                passages, total = [], np.zeros(len(group))
                for i in range(len(group)):
                    n = int(first[i + 1] - first[i])
                    found = segments(score[first[i]: first[i + 1]])
                    kept, total[i] = evidence(found, n, model)
                    passages.append([{"start": a, "end": b, "score": s} for a, b, s in kept])
                rows = batch.slice(at, len(group))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in keep), pa.array(np.diff(first), pa.int64()),
                     pa.array(passages, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))),
                     pa.array(linear.sigmoid(model.slope * total + model.offset), pa.float64())],
                    names=[*keep, "n_tokens", "passages", "score"])

    schema = docs.select(*keep).schema.add("n_tokens", "long").add("passages", PASSAGES).add("score", "double")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
