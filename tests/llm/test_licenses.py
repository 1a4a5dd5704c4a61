import random
import re
from collections import Counter

from retentio.llm import licenses
from retentio.llm.license_templates import TEMPLATES
from retentio.llm.queries import op8_license_scan

SCANNER = licenses.Scanner(TEMPLATES)


def prose(rng, n):
    return " ".join("".join(rng.choice(["tion", "er", "the", "on", "wh"]) for _ in range(rng.randint(1, 4)))
                    for _ in range(n))


def test_every_template_is_found_verbatim():
    rng = random.Random(0)
    for name, text in TEMPLATES.items():
        found = SCANNER.scan(f"{prose(rng, 40)}\n{text}\n{prose(rng, 300)}")
        assert [(f["license_id"], f["exact"]) for f in found] == [(name, True)], name
        start = found[0]["start"]
        assert found[0]["rank"] >= 1 and found[0]["saved"] >= licenses.MIN_SAVED and start > 40


def test_wording_differences_are_reported():
    text = TEMPLATES["MIT"].replace("person obtaining", "human obtaining").replace("free of charge, ", "")
    found = SCANNER.scan(f"x y\n# {text}")
    assert [f["license_id"] for f in found] == ["MIT"] and not found[0]["exact"]
    assert {"-person", "+human", "-free", "-of", "-charge"} <= set(found[0]["differences"])
    text = TEMPLATES["MIT"].split()
    assert SCANNER.scan(" ".join(text[::3])) == []
    assert SCANNER.scan("the license plate and the driving licence expired; free software rocks") == []


def test_several_notices_in_one_block():
    found = SCANNER.scan("All rights reserved. Licensed under CC BY-NC 4.0.\nReleased under the MIT License. "
                         "All rights reserved.")
    assert [f["license_id"] for f in found] == [
        "all-rights-reserved", "CC-BY-NC-4.0-notice", "MIT-notice", "all-rights-reserved"]


def test_query_finds_all_planted_lines(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = Counter()
    for d in docs:
        for name, text in TEMPLATES.items():
            if name.endswith("notice") or name == "all-rights-reserved":
                want[d.doc_id, name] += len(re.findall(re.escape(text), d.text))
    got = Counter((r.doc_id, r.license_id) for r in op8_license_scan(spark, sf).collect())
    assert +want == +got and sum(want.values()) > 10


def test_nulls_repeats_long_and_empty(spark):
    mit = "Released under the MIT License."
    rows = [(1, None, 0), (2, "", 0), (None, mit, 0), (3, mit, 0), (3, mit, 0), (4, "license " * 20_000, 0),
            (5, "the word " * 50_000 + mit, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rank int")
    got = Counter(r.doc_id for r in licenses.scan_licenses(docs).collect())
    assert got == {None: 1, 3: 2, 5: 1}
    assert licenses.scan_licenses(docs.limit(0)).count() == 0
    assert licenses.scan_licenses(docs, {}).count() == 0


def test_licences_that_share_wording_get_their_own_ids():
    names = ("MIT", "ISC", "Apache-2.0", "Apache-1.1", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause",
             "GPL-2.0-or-later", "GPL-3.0-or-later", "AGPL-3.0-or-later", "LGPL-2.1-or-later", "LGPL-3.0-or-later",
             "MPL-2.0", "EPL-2.0", "CC0-1.0", "BSL-1.0", "Zlib", "GPL-3.0-title", "AGPL-3.0-title", "LGPL-2.1-title")
    for name in names:
        lead = "we wrote in the past and for the fun of it and in the end the whole of the work is for the reader"
        found = SCANNER.scan(f"{lead}\n{TEMPLATES[name]}\n{lead}")
        assert [(f["license_id"], f["exact"]) for f in found] == [(name, True)], name
    opening = TEMPLATES["BSD-2-Clause"].split(" 1. ")[0]
    assert [f["license_id"] for f in SCANNER.scan(opening)] == ["BSD-family-opening"]
    lgpl = TEMPLATES["LGPL-2.1-or-later"].split(" This library is distributed")[0]
    assert [f["license_id"] for f in SCANNER.scan(lgpl)] == ["LGPL-2.1-or-later-opening"]
