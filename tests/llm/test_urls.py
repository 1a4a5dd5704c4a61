from pyspark.sql import Row

from retentio.llm.queries import URL_RULES
from retentio.llm.urls import judge_urls

RULES = "host string, path string, verdict string"


def judge(spark, urls, rules=URL_RULES):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = judge_urls(pages, spark.createDataFrame(list(rules), RULES))
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    return {r.page_id: r for r in out.collect()}


def brute(url, rules):
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_against_brute_force(spark):
    urls = ["http://a.example.com/en/1", "https://WWW.Example.COM/en/x?y=/z", "http://example.com", None, "",
            "no scheme", "http://b.net/es/1#f", "http://b.net/fr", "http://net/fr/", "http://xnet/fr/1",
            "ftp://example.org/en/", "http://example.com?/en/", "http://a..com//en/", "x://y://example.com/en/",
            "http://www.example.com/en/" + "a" * 50_000, "http://" + "a." * 5_000 + "com/q", "http://É.com/E"]
    got = judge(spark, urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute(u, URL_RULES)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u


def test_url_ties_empty_and_repeats(spark):
    rules = [("a.com", "/x", "allow"), ("a.com", "/x", "block"), ("com", None, "block"), (None, "/", "block")]
    got = judge(spark, ["http://a.com/x", "http://b.com", "http://b.org"], rules)
    assert got[0].verdict == "block" and got[1].rule == "com" and got[2].rule is None
    assert got[2].verdict == "allow"
    none = spark.createDataFrame([], RULES)
    rows = spark.createDataFrame([Row(page_id=1, url="http://a.com/")] * 2)
    out = judge_urls(rows, none).collect()
    assert [r.verdict for r in out] == ["allow", "allow"]
    assert judge_urls(rows.limit(0), none).count() == 0
