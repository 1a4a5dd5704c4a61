"""Hashed n-gram views of texts and linear models over them.

A *view* lists, for a group of texts, the hashed feature of every position
(word n-grams, word-shape n-grams, character n-grams).  A text's features are
the relative frequencies of a view's hashes, so its score is the bias plus,
per view, the mean weight of its positions: one gather and one running sum per
view score a whole group, and the length of a text does not matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from retentio.llm import textfeat as tf

SCALE = 8.0  # weight of one view's frequencies in the input vector


@dataclass
class View:
    index: np.ndarray  # hashed feature of every position
    lo: np.ndarray     # first position of each text
    hi: np.ndarray     # end position of each text


_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a"): ord("z") + 1] = 1
_CLASS[128:] = 1
_CLASS[ord("A"): ord("Z") + 1] = 2
_CLASS[ord("0"): ord("9") + 1] = 3


def shape_hashes(w: tf.Words) -> np.ndarray:
    """A hash of each word's shape: runs of lower-case, upper-case, digits and each other sign."""
    kind = _CLASS[w.buf]
    new = np.ones(len(kind), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    if len(w.starts):
        new[w.starts] = True
    rank = np.concatenate(([0], np.cumsum(new)))
    return tf.span_hashes(kind[new], rank[w.starts], rank[w.ends])


def _view(h: np.ndarray, seed: int, bits: int, lo: np.ndarray, hi: np.ndarray) -> View:
    mixed = tf.mix(h ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    return View((mixed >> np.uint64(64 - bits)).astype(np.int64), lo, np.maximum(lo, hi))


def word_views(w: tf.Words, bits: int) -> list[View]:
    """Words, word pairs, word shapes and shape pairs (a pair also says whether the word repeats)."""
    lo, hi = w.first[:-1], w.first[1:]
    h, s = w.hashes, shape_hashes(w)
    m0, m1 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
    pair = h[:-1] * m0 + h[1:] * m1
    shapes = s[:-1] * m0 + s[1:] * m1 + (h[:-1] == h[1:]).astype(np.uint64)
    return [_view(h, 1, bits, lo, hi), _view(pair, 2, bits, lo, hi - 1),
            _view(s, 3, bits, lo, hi), _view(shapes, 4, bits, lo, hi - 1)]


def char_views(w: tf.Words, texts: list[bytes], bits: int, sizes: tuple[int, ...] = (2, 3, 4)) -> list[View]:
    """Character n-grams of the UTF-8 bytes, spaces included."""
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    lo, hi = offsets[:-1], offsets[1:] - 1
    out, gram = [], w.buf.astype(np.uint64)
    done = 1
    for n in sorted(sizes):
        while done < n:
            gram = gram[:-1] * np.uint64(257) + w.buf[done:]
            done += 1
        out.append(_view(gram, 10 + n, bits, lo, hi - n + 1))
    return out


def scores(views: list[View], weights: np.ndarray, bias: float) -> np.ndarray:
    total = np.full(len(views[0].lo), bias)
    for v in views:
        run = np.concatenate(([0.0], np.cumsum(weights[v.index], dtype=np.float64)))
        n = v.hi - v.lo
        total += SCALE * (run[v.hi] - run[v.lo]) / np.maximum(n, 1)
    return total


def sparse_row(views: list[View], i: int) -> tuple[np.ndarray, np.ndarray]:
    """(features, values) of text i."""
    keys, values = [], []
    for v in views:
        part = v.index[v.lo[i]: v.hi[i]]
        if len(part):
            k, n = np.unique(part, return_counts=True)
            keys.append(k)
            values.append(SCALE * n / len(part))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0)
    both, where = np.unique(np.concatenate(keys), return_inverse=True)
    return both, np.bincount(where, weights=np.concatenate(values), minlength=len(both))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Rows:
    """Sparse labelled rows for fitting (int32 features, float32 values)."""

    keys: list[np.ndarray]
    values: list[np.ndarray]
    labels: np.ndarray

    def __len__(self) -> int:
        return len(self.labels)


def ftrl(rows: Rows, dims: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05,
         epochs: int = 6, seed: int = 3) -> tuple[np.ndarray, float]:
    """Follow-the-regularised-leader updates, one example at a time, per-coordinate rates."""
    z, n = np.zeros(dims + 1), np.zeros(dims + 1)  # the last coordinate is the bias

    def leader(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        w = -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zz) <= l1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = np.append(rows.keys[i], dims)
            x = np.append(rows.values[i], 1.0)
            w = leader(at)
            g = (sigmoid(w @ x) - rows.labels[i]) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    w = leader(np.arange(dims + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def logistic(rows: Rows, dims: int, rounds: int = 200, rate: float = 0.1, l2: float = 1e-4, enough: float = 0.02,
             chunk: int = 128) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam steps on the full batch; the two classes weigh the same.

    Rows stay in the compact form they came in; each step visits them in
    chunks.  Steps end after ``rounds`` or at a mean loss below ``enough``.
    """
    y = rows.labels.astype(float)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w, m, v = np.zeros(dims + 1), np.zeros(dims + 1), np.zeros(dims + 1)  # the last coordinate is the bias
    for t in range(1, rounds + 1):
        g, loss = l2 * w, 0.0
        for at in range(0, len(rows), chunk):
            lengths = [len(k) for k in rows.keys[at: at + chunk]]
            keys, values = np.concatenate(rows.keys[at: at + chunk]), np.concatenate(rows.values[at: at + chunk])
            owner = np.repeat(np.arange(len(lengths)), lengths)
            f = np.bincount(owner, weights=values * w[keys], minlength=len(lengths)) + w[-1]
            yy, ss = y[at: at + chunk], share[at: at + chunk]
            loss += float((ss * np.logaddexp(0, np.where(yy > 0, -f, f))).sum())
            e = (sigmoid(f) - yy) * ss
            g[:-1] += np.bincount(keys, weights=values * e[owner], minlength=dims)
            g[-1] += e.sum()
        if loss < enough:
            break
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w[:-1].astype(np.float32), float(w[-1])


def platt(f: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """(slope, offset) so that sigmoid(slope * f + offset) is calibrated, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):  # Newton steps on two numbers
        p = sigmoid(a * f + b)
        g, h = p - t, np.maximum(p * (1 - p), 1e-9)
        H = np.array([[(h * f * f).sum() + 1e-6, (h * f).sum()], [(h * f).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(H, [(g * f).sum() + 1e-6 * a, g.sum()])
        a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        if abs(da) + abs(db) < 1e-9:
            break
    return max(float(a), 1e-3), float(b)
