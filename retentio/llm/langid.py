"""Language identification with error-correcting output codes.

Every language gets a codeword of +1/-1 bits; one logistic classifier per bit
predicts it from hashed character n-grams (1-3, over letters, everything else
one boundary sign).  A text belongs to the codeword with the smallest summed
logistic loss, bits weighted by how well they were learned.  Codes are
exhaustive up to seven languages and random dense codes with the widest
minimum distance beyond.

Fitting uses a bounded sample of labelled rows (``train_rows``, spread evenly
over the languages by a hash of the row); scoring covers every whole text in
one map without a shuffle.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm import textfeat as tf

UNDETERMINED = "und"
DIMS = 4096
NGRAMS = (1, 2, 3)
MAX_EXHAUSTIVE = 7
_BOUNDARY = 32
_FOLD: list[np.ndarray] = []


def _fold_table() -> np.ndarray:
    """Code point -> lower-case letter or mark, all else the boundary."""
    if not _FOLD:
        table = np.full(0x110000, _BOUNDARY, dtype=np.uint32)
        for cp in range(0x30000):  # letters and marks beyond plane 2 keep their code below
            c = chr(cp)
            if unicodedata.category(c)[0] in "LM":
                table[cp] = ord(c.lower()[0])
        table[0x30000:0xE0000] = np.arange(0x30000, 0xE0000, dtype=np.uint32)
        _FOLD.append(table)
    return _FOLD[0]


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """L2-normalised log counts of hashed character n-grams (float32, DIMS)."""
    counts = np.zeros(DIMS)
    table = _fold_table()
    step = 1 << 20
    for at in range(0, len(text), step):  # long texts in pieces that overlap by the longest n-gram
        raw = np.frombuffer(f" {text[max(0, at - 2): at + step]} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = table[raw]
        blank = codes == _BOUNDARY
        codes = codes[~(blank & np.concatenate(([False], blank[:-1])))]
        gram = np.zeros(len(codes), dtype=np.uint32)
        for n in NGRAMS:
            if len(codes) < n:
                break
            gram = gram[: len(codes) - n + 1] * np.uint32(0x01000193) + codes[n - 1:] + np.uint32(1)
            h = (gram ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            counts += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(DIMS - 1), minlength=DIMS)
    x = np.log1p(counts)
    norm = np.sqrt((x * x).sum())
    return (x / norm if norm else x).astype(np.float32)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """An (n, bits) matrix of +1/-1 codewords."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= MAX_EXHAUSTIVE:
        columns = [[1 if i == 0 else 1 - 2 * ((c >> (i - 1)) & 1) for i in range(n)]
                   for c in range(1, 1 << (n - 1))]
        return np.array(columns, dtype=float).T
    bits = int(np.ceil(10 * np.log2(n)))
    rng, best, widest = np.random.default_rng(seed), None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], size=(n, bits))
        if (abs(code.sum(axis=0)) == n).any():
            continue
        apart = (bits - code @ code.T) / 2 + np.eye(n) * bits
        if apart.min() > widest:
            best, widest = code, apart.min()
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray      # languages x bits
    weights: np.ndarray   # DIMS x bits
    bias: np.ndarray      # bits
    trust: np.ndarray     # bits

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its probability, the runner-up's probability) of each row."""
        f = x @ self.weights + self.bias
        loss = np.stack([(self.trust * np.logaddexp(0, -f * c)).sum(axis=1) for c in self.code], axis=1)
        p = np.exp(loss.min(axis=1, keepdims=True) - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = loss.argmin(axis=1)
        top = p[np.arange(len(p)), best]
        rest = p.copy()
        rest[np.arange(len(p)), best] = 0
        return best, top, rest.max(axis=1)


def fit(x: np.ndarray, labels: list[str], rounds: int = 300, rate: float = 4.0, l2: float = 1e-5) -> Model:
    """All bit classifiers at once by accelerated full-batch gradient steps (classes weighted evenly)."""
    names = sorted(set(labels))
    code = codewords(len(names))
    if len(names) < 2:
        return Model(names, code, np.zeros((DIMS, 1), np.float32), np.full(1, 9.0), np.ones(1))
    at = {name: i for i, name in enumerate(names)}
    which = np.array([at[v] for v in labels])
    share = 1.0 / np.bincount(which, minlength=len(names))[which]
    share = (share / share.sum())[:, None].astype(np.float32)
    y = code[which].astype(np.float32)
    w, b = np.zeros((DIMS, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        f = x @ (w + 0.9 * vw) + b + 0.9 * vb
        g = -y * share / (1 + np.exp(np.clip(y * f, -30, 30)))
        vw = 0.9 * vw - rate * (x.T @ g + l2 * w)
        vb = 0.9 * vb - rate * 0.1 * g.sum(axis=0)
        w, b = w + vw, b + vb
    right = ((x @ w + b) * y > 0)
    trust = np.clip((right * share).sum(axis=0) * 2 - 1, 0.05, 1.0)
    return Model(names, code, w, b, trust)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32(doc_id as text) mod folds is ``fold``; a NULL id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, train_rows: int = 2000, seed: int = 11) -> Model:
    """Fit on at most ``train_rows`` rows of (text, lang), spread evenly over the languages.

    Rows without a language or without a letter teach nothing.  The sample is
    chosen by a hash of the whole text, so it does not depend on partitioning.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model([], np.ones((0, 1)), np.zeros((DIMS, 1), np.float32), np.zeros(1), np.ones(1))
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30))
    each = max(1, train_rows // len(sizes))
    wanted = F.lit(False)
    for lang, n in sizes.items():
        wanted = wanted | ((F.col("lang") == lang) & (F.col("draw") <= int(min(1.0, each / n) * (1 << 30))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = [features(t).tobytes() if has_letter(t) else None for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("draw"), pa.array(x, pa.binary())], names=["lang", "draw", "x"])

    rows = (
        usable.withColumn("draw", draw).where(wanted)
        .mapInArrow(run, "lang string, draw long, x binary").where("x IS NOT NULL")
        .orderBy("draw", "lang", "x").limit(2 * train_rows).select("lang", "x").collect())
    if not rows:
        return Model([], np.ones((0, 1)), np.zeros((DIMS, 1), np.float32), np.zeros(1), np.ones(1))
    x = np.stack([np.frombuffer(r["x"], dtype=np.float32) for r in rows])
    return fit(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model, min_score: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with ``lang_pred``, ``score``, ``ambiguous`` added (same-named columns are replaced).

    NULL text or a text without a letter: ``und``, score 0, ambiguous.  With no
    learned language every text is ``und``.  Ambiguous: the best codeword's
    probability is below ``min_score``.  Repeated rows and NULL ids stay.
    """
    kept = [c for c in keep or docs.columns if c not in ("lang_pred", "score", "ambiguous")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tf.handed_back(batches):
            for at in range(0, batch.num_rows, 256):
                part = batch.column("text").slice(at, 256).to_pylist()
                known = [i for i, t in enumerate(part) if t and model.languages and has_letter(t)]
                lang, score = [UNDETERMINED] * len(part), np.zeros(len(part))
                if known:
                    best, top, _ = model.decode(np.stack([features(part[i]) for i in known]))
                    for i, b, p in zip(known, best, top):
                        lang[i], score[i] = model.languages[b], p
                rows = batch.slice(at, len(part))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in kept), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                     pa.array(score < min_score, pa.bool_())],
                    names=[*kept, "lang_pred", "score", "ambiguous"])

    schema = docs.select(*kept).schema.add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return docs.select(*dict.fromkeys([*kept, "text"])).mapInArrow(run, schema)
