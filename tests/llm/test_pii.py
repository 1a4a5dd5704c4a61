import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from retentio.llm import pii
from retentio.llm.queries import op1_pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def slow_luhn(d):
    digits = [int(c) for c in d][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(digits)) % 10 == 0


def brute(text):
    """The contract's patterns with the standard regular expression engine."""
    text = text or ""
    spans = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    spans += [("ip", m.start(), m.end()) for m in IP.finditer(text)
              if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[ -]", "", m.group())
        if 14 <= len(d) <= 19 and slow_luhn(d):
            spans.append(("card", m.start(), m.end()))
    spans += [("phone", m.start(), m.end()) for m in PHONE.finditer(text)
              if 10 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(spans, key=lambda s: (s[1], pii.BASE_KINDS.index(s[0])))


def base(text):
    return [s for s in pii.find_spans(text) if s[0] in pii.BASE_KINDS]


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1234567890@.+-() é%_A\n", max_size=80))
def test_base_spans_match_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", "x@y", "1.2.3.4", "256.1.1.1", ".", "4111111111111111", " ", "-",
                                 "+1 (415) 555-2671", "+", "0", "é", "token = \"", "000.001.2.003", "))"]), max_size=14))
def test_base_spans_of_glued_pieces(parts):
    text = "".join(parts)
    assert base(text) == brute(text)


def test_long_runs_are_linear():
    for run in ("a" * 300_000, "9" * 300_000, "1." * 150_000, "+1" * 100_000, "1 " * 100_000, "a@" * 50_000,
                "+1" + "." * 300_000, "token = " * 30_000):
        pii.find_spans(run)


def test_added_spans():
    kinds = lambda t: [(k, t[s:e]) for k, s, e in pii.find_spans(t)]
    assert kinds('x token = "f3ef4d6b2755" y') == [("account", "f3ef4d6b2755")]
    assert kinds("IBAN: DE89 3704 0044 0532 0130 00 end")[0][0] == "account"
    assert ("account", "4111111111111111") in kinds("4111111111111111 4012888888881881")
    assert kinds("see http://a.example.com/x?y=1.") == [("url", "http://a.example.com/x?y=1")]
    assert kinds("mail jo (at) ex [dot] org now") == [("address", "jo (at) ex [dot] org")]
    assert kinds("a broken tokenizer, http://x y") == []


def test_query_over_whole_table(spark):
    got = {r.doc_id: r for r in op1_pii(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        want, r = brute(d.text), got[d.doc_id]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(
            sum(s[0] == k for s in want) for k in pii.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(pii.join_spans(want).encode()).hexdigest()
        assert r.spans == pii.join_spans(pii.find_spans(d.text))


def test_nulls_repeats_and_empty_tables(spark):
    rows = [(1, None, "c"), (None, "a@b.co", "c"), (2, "", "c"), (2, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = sorted(((r.doc_id, [tuple(x) for x in r.found]) for r in pii.scan(df).collect()), key=repr)
    assert got == sorted([(1, []), (None, [("email", 0, 6, "a@b.co")]), (2, []), (2, [])], key=repr)
    assert pii.scan(df.limit(0)).count() == 0
