"""Sequence packing: first-fit decreasing over a tournament tree of bin capacities.

1. Every whole text becomes token ids (closed by an end id).  A document of
   more than ``max_tokens`` ids is cut at multiples of it, so every piece but a
   document's last fills a sequence alone.
2. Pieces are dealt at random (a hash of a row number, never of a key) into
   groups of about ``GROUP_TOKENS`` tokens.  More data means more groups, not
   larger ones, and no key can make a group hot.
3. Each group is packed on its own: pieces in decreasing length, each into the
   first bin that still has room - found by walking down a tree whose nodes
   hold the largest free capacity below them.
"""

from __future__ import annotations

import os
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retentio.llm import textfeat as tf
from retentio.session import cut_lineage

MAX_TOKENS = 4096
END_ID = 2
GROUP_TOKENS = MAX_TOKENS * 512
GROUP_PIECES = 50_000
BATCH_BYTES = 8 << 20  # of Arrow data
_CACHE_WORDS = 400_000
_TAIL = ".,!?;:#$%&*|"


class _Recent(dict):
    """A bounded memo of ``compute`` in two generations: what is in use survives a turnover."""

    def __init__(self, compute, limit: int):
        super().__init__()
        self.compute, self.limit, self.older = compute, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def _byte_letters() -> list[str]:
    """The letter a byte-level vocabulary writes for each byte (a rule of such tokenizers):
    printable Latin-1 bytes are themselves, the others follow from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def _stays_letter(c: str) -> bool:
    """Whether a character is one letter before and after normalisation and lower-casing."""
    if c.isascii():
        return c.isalpha()
    low = unicodedata.normalize("NFC", unicodedata.normalize("NFC", c).lower())
    return c.isalpha() and len(low) == 1 and low.isalpha()


class WordEncoder:
    """Token ids (little-endian uint32 bytes) of texts, word by word with a bounded cache.

    Only for tokenizers whose pieces never span white space (checked by tests
    against encoding whole texts): then a text's ids are its words' ids.  A
    word's trailing punctuation is looked up apart from its letters, because
    such a tokenizer separates letters from signs before it merges; not after a
    letter that normalisation turns into several signs (a letter and a mark),
    since such a mark joins the punctuation.  Runs of
    Latin letters go straight to the tokenizer's merge model; that short cut is
    tried on probe words first and left out if it does not give equal ids.
    """

    PROBES = ("a", "Zebra", "naïve", "Straße", "ÉTÉ", "mañana", "Œuvre", "x" * 40, "the", "ÿŸ")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.letters = self.tokenizer.model.tokenize, _byte_letters()
        self.words = _Recent(self._word, _CACHE_WORDS)
        self.parts = _Recent(self._part, _CACHE_WORDS)
        self.short_cut = all(self._merged(p) == self._encoded(p) for p in self.PROBES)

    def _encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _merged(self, letters: str) -> bytes:
        low = letters.lower()
        if not low.isascii():
            low = "".join([self.letters[b] for b in low.encode()])
        ids = array("I", [t.id for t in self.merge(low)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _part(self, text: str) -> bytes:
        latin = text.isalpha() and max(text) < "\u0180" and "\u0130" not in text  # U+0130 lowers to two
        return self._merged(text) if latin and self.short_cut else self._encoded(text)

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        head = text.rstrip(_TAIL)
        if not head or not _stays_letter(head[-1]):
            return self.parts[text]
        key = head.lower() if head.isascii() and "<|" not in head else head
        return self.parts[key] + self.parts[text[len(head):]] if len(head) < len(text) else self.parts[key]

    def close(self) -> None:
        """Gives the caches back at once: they and the encoder hold one another, so they would outlive its last use."""
        self.words = self.parts = None

    def encode(self, texts: list[bytes]) -> list[bytes]:
        get = self.words.__getitem__
        return [b"".join(map(get, t.split())) for t in texts]


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of every piece; ties keep their order.

    The tournament tree holds, per node, the largest free capacity of its
    bins.  A piece walks from the root to the leftmost bin with room; unopened
    bins are leaves of full capacity, so a new bin is just the next leaf.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, offsets
    leaves = 1
    while leaves < n:
        leaves *= 2
    free = [capacity] * (2 * leaves)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = 1
        while at < leaves:
            at *= 2
            if free[at] < size:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - free[at]
        free[at] -= size
        while at > 1:
            at //= 2
            left, right = free[2 * at], free[2 * at + 1]
            free[at] = left if left > right else right
    return bins, offsets


def _pieces(path: str, max_tokens: int, end_id: int, with_ids: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        for batch in tf.handed_back(batches):
            for at, group in tf.groups(tf.utf8(batch.column("text"))):
                rows, starts, lengths, crcs, totals, ids = [], [], [], [], [], []
                for i, code in enumerate(encoder.encode(group)):
                    code += end
                    total = len(code) // 4
                    for start in range(0, total, max_tokens):
                        part = code[4 * start: 4 * (start + max_tokens)]
                        rows.append(at + i)
                        starts.append(start)
                        lengths.append(len(part) // 4)
                        crcs.append(zlib.crc32(part))
                        totals.append(total)
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32) if with_ids else None)
                pick = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("uid").take(pick), batch.column("doc_id").take(pick), pa.array(starts, pa.int64()),
                     pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64()), pa.array(totals, pa.int64()),
                     pa.array(ids, pa.list_(pa.int32()))],
                    names=["uid", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])
        encoder.close()

    return run


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: where it comes from, and its sequence and place there.

    Returns ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset`` and, with ``with_ids``, the piece's token ids.  ``ids_crc32`` is
    over the ids as little-endian unsigned 32-bit numbers.

    NULL or empty text is the end id alone; repeated rows are packed each;
    NULL ids stay NULL; an empty table gives an empty result; other columns are
    ignored.  ``tokenizer_path`` must exist on every executor.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    with tf.arrow_batches(docs.sparkSession, BATCH_BYTES):
        pieces = cut_lineage(
            docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text").mapInArrow(
                _pieces(tokenizer_path, max_tokens, end_id, with_ids),
                f"uid long, doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>"))
    total, count = pieces.agg(F.sum("length"), F.count("*")).first()
    groups = max(1, -(-(total or 0) // (GROUP_TOKENS * max_tokens // MAX_TOKENS or 1)), -(-count // GROUP_PIECES))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["uid", "start"], ignore_index=True)
        bins, offset = first_fit_decreasing(pdf["length"].to_numpy(), max_tokens)
        return pdf.assign(sequence_id=(pdf["grp"].to_numpy() << 32) + bins, offset=offset)[out]

    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    schema = (f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, "
              f"sequence_id long, offset long" + ", ids array<int>" * with_ids)
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("uid", "start"), F.lit(groups)))
    return (dealt if with_ids else dealt.drop("ids")).groupBy("grp").applyInPandas(fill, schema)
