"""Vectorised word hashing over batches of texts (numpy, inside Spark tasks).

Words are maximal runs of bytes other than ``\\x20 \\x09-\\x0D``.  A word's hash
is a polynomial over its bytes modulo 2**64, finalised by a bit mixer, so a
whole batch is hashed with a handful of array operations and no per-word
Python.  Batches are cut by bytes, never by truncating a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession

CHUNK_BYTES = 1 << 20  # texts are hashed in groups of about this many bytes

_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_WORD_MULT = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3,
     0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], dtype=np.uint64)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the hash base and of its inverse, kept between calls."""
    if len(_POWERS[0]) < n:
        size = max(n, 2 * len(_POWERS[0]))
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Bit mixer on uint64 (so that every output bit depends on every input bit)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """Words of a group of texts: byte spans, hashes, and each text's first word index."""

    buf: np.ndarray      # uint8, the texts joined by newlines
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray   # uint64
    first: np.ndarray    # len(texts) + 1

    def of(self, i: int) -> slice:
        return slice(int(self.first[i]), int(self.first[i + 1]))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hash of each span [start, end) of a uint8 array."""
    p, inverse = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * p[: len(values)], out=total[1:])
    h = (total[ends] - total[starts]) * inverse[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def words(texts: list[bytes]) -> Words:
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = _SPACE[buf]
    edge = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    starts, ends = edge[0::2], edge[1::2]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(buf, starts, ends, span_hashes(buf, starts, ends), np.searchsorted(starts, offsets))


def shingles(w: Words, i: int, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingle hashes of text i (fewer words: the whole sequence as one)."""
    h = w.hashes[w.of(i)]
    if not len(h):
        return h
    n = min(k, len(h))
    s = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        s += h[j: len(h) - n + 1 + j] * _WORD_MULT[j]
    return np.unique(mix(s + np.uint64(n)))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (empty when there are fewer)."""
    if len(h) < n:
        return h[:0]
    s = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for j in range(n):
        s += h[j: len(h) - n + 1 + j] * _WORD_MULT[j]
    return mix(s + np.uint64(n))


def groups(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(position of the first, texts) in groups of about ``limit`` bytes."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield at, texts[at: i + 1]
            at, size = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


@contextmanager
def arrow_batches(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of about ``size`` bytes for the jobs run inside (a task holds a batch several times over)."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def handed_back(batches: Iterator) -> Iterator:
    """The batches; after each, memory that Arrow no longer uses goes back to the system.

    A Python worker lives on after its task and would keep the largest task's
    memory beside the executor's heap through all later stages.
    """
    import pyarrow as pa

    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def utf8(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; NULL is empty."""
    import pyarrow as pa

    return [b"" if v is None else v for v in column.cast(pa.binary()).to_pylist()]
