"""Personal data: anchors found by Aho-Corasick, expanded by local parsers.

An automaton finds the places that can start something personal - at-signs,
plus signs, url schemes and identifier cues.  At each anchor a small
deterministic parser expands to the boundaries of the value and validates it.
Digit runs are their own anchor (network addresses, card numbers).  Every
parser only looks at its own run of characters, so the work is linear in the
text even for runs of a million digits or letters.

Base kinds (fixed by the contract): ``email``, ``ip``, ``card``, ``phone``.
Kinds the method adds:

* ``account`` - the value after an identifier cue (``iban``, ``account``,
  ``token``, ``password`` ...): an IBAN passing mod 97, or a run of at least 6
  identifier characters holding a digit; and every single number of 14-19
  digits passing Luhn inside a longer chain of digit groups that the base rule
  rejects as a whole;
* ``url`` - a web address from its scheme to the last character that is no
  closing punctuation, when its host has a dot or is ``localhost``;
* ``address`` - an email address written with ``(at)`` / ``[at]`` and
  ``(dot)`` / ``[dot]`` or ``.``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "url", "address")
_RANK = {k: i for i, k in enumerate(KINDS)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
_DIGITS = re.compile(r"[0-9]++(?:[ -]?[0-9]++)*")
_IPV4_PARTS = 4

_CUES = ("iban", "account", "acct", "routing", "passport", "ssn", "token", "secret", "password", "passwd",
         "api_key", "apikey", "api key", "license key", "customer id", "user id")
_AFTER_CUE = re.compile(
    r"(?:\s{0,3}(?:no\.?|number|nr\.?|id|#))?\s{0,3}(?:is\b|[:=#])\s{0,3}[\"']?([A-Za-z0-9](?:[ -]?[A-Za-z0-9_+/=])*+)",
    re.IGNORECASE)
_ID_RUN = re.compile(r"[A-Za-z0-9_+/=-]{6,}+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}+")
_URL = re.compile(r"[^\s<>\"'`|\\^{}]+")
_AT_WORDS = ("(at)", "[at]", " (at) ", " [at] ")
_SPELT = re.compile(r"[A-Za-z0-9-]++(?:(?:\.| ?[(\[]dot[)\]] ?)[A-Za-z0-9-]++)+", re.IGNORECASE)


def _cased(word: str) -> set[str]:
    return {word, word.upper(), word.title(), word.capitalize()}


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", "@"))
    a.add_word("+", ("plus", "+"))
    for scheme in ("http://", "https://", "ftp://"):
        for form in _cased(scheme):
            a.add_word(form, ("scheme", form))
    for cue in _CUES:
        for form in _cased(cue):
            a.add_word(form, ("cue", form))
    for word in ("(at)", "[at]", "(AT)", "[AT]"):
        a.add_word(word, ("spelt", word))
    a.make_automaton()
    return a


_ANCHORS: list[ahocorasick.Automaton] = []


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _iban_ok(value: str) -> bool:
    v = value.replace(" ", "")
    if not 15 <= len(v) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at`` that starts at or after ``floor``."""
    start = at
    while start > floor and text[start - 1] in _LOCAL:
        start -= 1
    if start == at:
        return None
    domain = _DOMAIN.match(text, at + 1)
    return (start, domain.end()) if domain else None


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        at = m.start()
        parts = m.group().split(".")
        for i in range(0, len(parts) - _IPV4_PARTS + 1, _IPV4_PARTS):
            four = parts[i: i + _IPV4_PARTS]
            end = at + sum(map(len, four)) + _IPV4_PARTS - 1
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def _cards(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() < 14:
            continue
        chain = m.group()
        digits = chain.replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19:
            if luhn(digits):
                yield "card", m.start(), m.end()
        elif len(digits) > 19:
            for run in re.finditer(r"[0-9]++", chain):
                if 14 <= run.end() - run.start() <= 19 and luhn(run.group()):
                    yield "account", m.start() + run.start(), m.start() + run.end()


def _account(text: str, end: int) -> tuple[int, int] | None:
    """The identifier that follows a cue ending at ``end``."""
    after = _AFTER_CUE.match(text, end, min(len(text), end + 200))
    if not after:
        return None
    start = after.start(1)
    iban = _IBAN.match(text, start, min(len(text), start + 64))
    if iban and _iban_ok(iban.group()):
        return start, iban.end()
    run = _ID_RUN.match(text, start)
    if run and any("0" <= c <= "9" for c in run.group()):
        return start, run.end()
    return None


def _url(text: str, start: int, scheme: str) -> tuple[int, int] | None:
    m = _URL.match(text, start + len(scheme))
    if not m:
        return None
    body = m.group().rstrip(".,;:!?)]*&%$#")
    host = re.split(r"[/?#]", body, maxsplit=1)[0]
    if "." not in host.strip(".") and host.lower() != "localhost":
        return None
    return start, m.start() + len(body)


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Every span as (kind, start, end) in code points, by start, then kind as listed."""
    if not text:
        return []
    if not _ANCHORS:
        _ANCHORS.append(_automaton())
    found: set[tuple[str, int, int]] = set()
    mail_end = phone_end = url_end = 0
    for last, (what, word) in _ANCHORS[0].iter(text):
        start = last - len(word) + 1
        if what == "at":
            if start >= mail_end and (m := _email(text, start, mail_end)):
                mail_end = m[1]
                found.add(("email", *m))
        elif what == "plus":
            if start >= phone_end and (p := _PHONE.match(text, start)):
                phone_end = p.end()
                if 10 <= sum("0" <= c <= "9" for c in p.group()) <= 15:
                    found.add(("phone", start, p.end()))
        elif what == "scheme":
            if start >= url_end and (u := _url(text, start, word)):
                url_end = u[1]
                found.add(("url", *u))
        elif what == "cue":
            before = text[start - 1: start]
            if not before.isalnum() and (a := _account(text, last + 1)):
                found.add(("account", *a))
        else:  # an at-sign spelt out
            left = start
            while left > 0 and text[left - 1] == " " and start - left < 2:
                left -= 1
            begin = left
            while begin > 0 and text[begin - 1] in _LOCAL and left - begin < 64:
                begin -= 1
            right = last + 1 + (text[last + 1: last + 2] == " ")
            domain = _SPELT.match(text, right)
            if begin < left and domain:
                found.add(("address", begin, domain.end()))
    found.update(("ip", *s) for s in _ips(text))
    found.update(_cards(text))
    return sorted(found, key=lambda s: (s[1], _RANK[s[0]], s[2]))


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``found``, the spans (kind, start, end, value) of every whole text.

    One map over the rows: no shuffle, one row out per row in.  NULL or empty
    text gives an empty list; a NULL doc_id stays NULL; repeated rows stay;
    an empty table gives an empty result; other columns are ignored.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("text"):
                text = value.as_py()
                out.append([{"kind": k, "start": s, "end": e, "value": text[s:e]} for k, s, e in find_spans(text)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(out, pa.list_(kind))], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, found array<struct<kind:string,start:long,end:long,value:string>>")


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
