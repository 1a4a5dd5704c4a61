"""Licence scans by conditional compression.

A *candidate block* is a stretch of words around licence cues.  Every block is
compressed alone and with each template as a raw zstandard dictionary; the
bytes a template saves, relative to its own compressed size, rank the
templates.  Each template that saves enough is then confirmed on the exact
wording: its words are aligned with the block's, and the words missing,
changed or put in between are reported.  Where confirmed templates overlap,
the one with more matched words (then fewer differences) wins.
"""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from retentio.llm.license_templates import TEMPLATES

CUES = ("licens", "licenc", "rights reserved", "copyright", "permission is hereby", "permission to use",
        "free software", "public domain", "creative commons", "redistribut")
MIN_SAVED = 0.15       # of the template's own compressed size; a three-word notice in prose saves about 0.25
MAX_DIFFERENT = 0.10   # of the template's words
SHORT = 90             # words; longer templates look at blocks of their own, wide ones hide what a short one saves
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_CUE = re.compile("|".join(map(re.escape, CUES)))


def _fold(word: str) -> str:
    return word.strip("\"'()[]*#/;:,.!").lower()


class Scanner:
    """Compressors and word lists of the templates; built once per Python worker."""

    def __init__(self, templates: dict[str, str], level: int = 9):
        self.words = {k: [w for w in map(_fold, _WORD.findall(t)) if w] for k, t in templates.items()}
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        short = [k for k, w in self.words.items() if len(w) <= SHORT]
        self.classes = [(max(len(self.words[k]) for k in names), names)
                        for names in (short, [k for k in self.words if k not in short]) if names]
        plain = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.size = lambda text: len(plain.compress(text))
        self.own = {k: self.size(" ".join(w).encode()) for k, w in self.words.items()}
        self.primed = {
            k: zstandard.ZstdCompressor(level=level, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
                " ".join(w).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for k, w in self.words.items()}

    def blocks(self, text: str, reach: int) -> Iterator[list[tuple[str, int, int]]]:
        """Stretches of (folded word, start, end) that reach ``reach`` words around each cue."""
        lower = text.lower()
        if not any(c in lower for c in CUES):
            return
        words = [(f, m.start(), m.end()) for m in _WORD.finditer(text) if (f := _fold(m.group()))]
        folded = [w[0] for w in words]
        ends, line = [], 0  # cues may span words, so they are looked up in the folded words
        for w in folded:
            line += len(w) + 1
            ends.append(line)
        first = last = None
        at = 0
        for cue in _CUE.finditer(" ".join(folded)):
            while ends[at] <= cue.start():
                at += 1
            if first is not None and at - reach > last + reach:
                yield words[max(0, first - reach): last + reach + 1]
                first = None
            first, last = at if first is None else first, at
        if first is not None:
            yield words[max(0, first - reach): last + reach + 1]

    def ranked(self, block: list[str], names: list[str]) -> list[tuple[float, str]]:
        """(saved share, template) from the largest size reduction down."""
        data = " ".join(block).encode()
        alone = self.size(data)
        saved = ((max(0, alone - len(c.compress(data))) / max(1, self.own[k]), k)
                 for k, c in ((k, self.primed[k]) for k in names))
        return sorted((x for x in saved if x[0] >= MIN_SAVED), key=lambda x: (-x[0], x[1]))

    def confirm(self, name: str, block: list[str]) -> Iterator[tuple[int, int, int, list[str]]]:
        """(first word, end word, matched words, differences) of each place with the template's wording."""
        want = self.words[name]
        n, at = len(want), 0
        allowed = int(MAX_DIFFERENT * n)
        first = set(want[: allowed + 1])
        while at < len(block):
            if block[at] not in first:  # a place starts at one of the template's first words
                at += 1
                continue
            piece = block[at: at + n + allowed]
            if (Counter(piece) & self.counts[name]).total() < n - allowed:  # no alignment matches more words
                at += 1
                continue
            ops = difflib.SequenceMatcher(None, want, piece, autojunk=False).get_opcodes()
            begin = next((j1 for tag, _, _, j1, _ in ops if tag == "equal"), 0)
            if begin:  # words before the wording are none of its own
                piece = block[at + begin: at + begin + n + allowed]
                again = difflib.SequenceMatcher(None, want, piece, autojunk=False).get_opcodes()
                if sum(x[2] - x[1] for x in again if x[0] == "equal") >= n - allowed:
                    at, ops = at + begin, again
                else:
                    piece = block[at: at + n + allowed]
            used = max((j2 for tag, _, _, _, j2 in ops if tag == "equal"), default=0)
            differences, matched = [], 0
            for tag, i1, i2, j1, j2 in ops:
                if tag == "equal":
                    matched += i2 - i1
                else:
                    differences += [f"-{w}" for w in want[i1:i2]]
                    differences += [f"+{w}" for w in piece[j1:min(j2, used)]]
            if len(differences) <= allowed * 2 and n - matched <= allowed:
                yield at, at + used, matched, differences
                at += used
            else:
                at += 1

    def scan(self, text: str | None) -> list[dict]:
        out, found = [], []
        for reach, names in self.classes:
            for block in self.blocks(text or "", reach):
                folded = [w[0] for w in block]
                for rank, (saved, name) in enumerate(self.ranked(folded, names), 1):
                    for a, b, matched, differences in self.confirm(name, folded):
                        found.append((matched, -len(differences), -rank, block[a][1], block[b - 1][2], name, saved, rank,
                                      differences))
        taken: list[tuple[int, int]] = []
        for matched, _, _, a, b, name, saved, rank, differences in sorted(found, reverse=True, key=lambda x: x[:6]):
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append({"license_id": name, "start": a, "end": b, "saved": saved, "rank": rank, "n_words": matched,
                            "exact": not differences, "differences": differences})
        return sorted(out, key=lambda x: (x["start"], x["license_id"]))


_COLUMNS = (("license_id", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("saved", pa.float64()),
            ("rank", pa.int64()), ("n_words", pa.int64()), ("exact", pa.bool_()),
            ("differences", pa.list_(pa.string())))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per licence notice found in the whole texts of ``docs``.

    ``start`` / ``end`` are code points, ``saved`` the share of the template's
    compressed size it saves on the block, ``rank`` its place among the
    templates of its length class, ``differences`` the words left out (-) or put in (+).  NULL or
    empty texts give no rows; repeated rows give repeated rows; a NULL id stays
    NULL; an empty table or no templates give an empty result; other columns
    are ignored.  ``templates`` is a small fixed table carried to the tasks.
    """
    chosen = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen)
        for batch in batches:
            owner, rows = [], []
            for i, text in enumerate(batch.column("text")):
                got = scanner.scan(text.as_py())
                owner += [i] * len(got)
                rows += got
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(owner, pa.int64())),
                 *(pa.array([r[k] for r in rows], t) for k, t in _COLUMNS)],
                names=["doc_id", *(k for k, _ in _COLUMNS)])

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {dict(docs.dtypes)['doc_id']}, license_id string, start long, end long, saved double, "
             "rank long, n_words long, exact boolean, differences array<string>")
