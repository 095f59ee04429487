import re

import pytest
from pyspark.sql import functions as F

from pricequarry.llm import url_filter as U


def slow(url):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and host and (best is None or len(h + p) > len(best[1])):
            best = verdict, h + p
    return host, path, best


URLS = [None, "", "x", "http://", "http://net", "http://net/", "http://a.net/x", "HTTPS://WWW.Example.NET/en/1?x=/de/", "http://example.net/en", "http://notexample.com/de/1", "http://example.com/de/1#y", "http://a.b.org/fr/", "http://org/fr/x", "http://x.org?/fr/", "http://example.net#/en/", "ftp://u@h.example.com:8/de/x", "http://É.net/é", "a://b://c.net/d", "http://shop.example/cart", "http://x.doubleclick.net/y", "http://x/login.php", "http://x/Login"]


def test_rules_against_all_of_them(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string").withColumns({"host": F.lit("h"), "Verdict": F.lit(1)})
    for r in U.judge_urls(df).collect():
        host, path, best = slow(r["url"])
        assert (r["_host"], r["path"], r["rule"]) == (host, path, best and best[1])
        if best:
            assert r["_verdict"] == best[0]
        else:
            blocked = any(re.search(p.pattern, host + path) for p in U.PAGES)
            assert r["_verdict"] == ("block" if blocked else "allow")


@pytest.mark.parametrize(
    ("pattern", "tokens"),
    [(r"^(?:[^/]*\.)?doubleclick\.net/", {"net"}), (r"/ads/banner[0-9]+\.", {"ads"}), (r"/a|/b", set()), (r"/track.*/", set()), (r"/x?yz/", set()), (r"/shop/cart$", {"shop", "cart"}), (r"colou?r", set())],
)
def test_tokens_are_in_every_match(pattern, tokens):
    assert U.literal_tokens(pattern) == tokens


def test_a_rule_is_filed_under_its_rarest_token():
    rules = (U.Rule("block", "r", r"/common/rare/"),)
    assert U.file_rules(rules, {"common": 100, "rare": 2}) == {"rare": [0]}


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert U.judge_urls(df, sites=(), pages=()).first()["verdict"] == "allow"
    assert U.judge_urls(df.limit(0)).count() == 0


def test_many_rules_in_passes(spark):
    """As one pass has it, whatever the size of a pass."""
    sites = (*U.SITES, U.Rule.site("block", "a.net/x"), U.Rule("allow", "b.net/x", r"^a\.net/x"), U.Rule("block", "a.net/y", r"^a\.net/"))
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")
    want = sorted(map(str, U.judge_urls(df, sites=sites).collect()))
    assert any("a.net/x" in w for w in want)
    for n in (1, 2, 3):
        assert sorted(map(str, U.judge_urls(df, sites=sites, most_rules=n).collect())) == want
    thousands = (*sites, *(U.Rule.site("block", f"h{i}.example/p{i}/") for i in range(3000)))
    got = U.judge_urls(df.unionByName(spark.createDataFrame([(99, "http://h7.example/p7/x")], "page_id long, url string")), sites=thousands).collect()
    assert next(r for r in got if r["page_id"] == 99)["rule"] == "h7.example/p7/"
    assert sorted(str(r) for r in got if r["page_id"] != 99) == want


def test_very_long_urls_and_repeated_rows(spark):
    long = "http://a.net/" + "x/" * 200_000 + "cart"
    df = spark.createDataFrame([(1, long), (1, long), (2, "http://a.org/" + "y" * 500_000)], "page_id long, url string")
    got = sorted(U.judge_urls(df).collect(), key=lambda r: r["page_id"])
    assert [(r["rule"], r["pattern"], r["verdict"]) for r in got] == [("net/", "shop page", "block")] * 2 + [(None, None, "allow")]
    assert len(got[0]["path"]) == len(long) - len("http://a.net")
