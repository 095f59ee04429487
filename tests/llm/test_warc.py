import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from pricequarry.llm import warc as W

SCHEMA = "page_id long, url string, html string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [(i, f"http://{'www.' if i % 3 else ''}h{i % 5}.example.{'net' if i % 2 else 'org'}/p/{i}?q#f", f"<p>{rng.randrange(12)}</p>" * rng.randrange(1, 40)) for i in range(300)]
    out += [(500, None, None), (501, "", ""), (502, "no scheme", None), (503, "http://a\r\nb/ \u00e9", "\u00e9\r\n\r\nx"), (504, "http://big.example/", "y" * 500_000), (505, "HTTP://BIG.example:80", "y" * 500_000)]
    out += [(506, "http://twice.example/", "same"), (506, "http://twice.example/", "same"), (None, "http://nobody.example/", "same"), (None, None, "same")]
    return out


@pytest.fixture(scope="module")
def directory(spark, rows, tmp_path_factory):
    pages = spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit(1), "key": F.lit("x")}).repartition(5)
    return W.write_archive(pages, f"file://{tmp_path_factory.mktemp('warc')}", rows_per_file=60)


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def test_every_page_comes_back(directory, rows):
    got = W.read_archive(directory).collect()
    first = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    want = []
    seen = set()
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        p = (html or "").encode()
        revisit = first[html or ""] != i or (i, html) in seen
        seen.add((i, html))
        want.append((i, len(p), sha(p), "revisit" if revisit else "response", first[html or ""] if revisit else None))
    assert sorted(map(str, ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got))) == sorted(map(str, want))
    payloads = {r["payload_digest"]: bytes(r["payload"]) for r in got if r["record_type"] == "response"}
    assert payloads == {sha((html or "").encode()): (html or "").encode() for _, _, html in rows}


def test_look_up_finds_all_captures_and_only_those(spark, directory, rows, monkeypatch):
    asked = [r[1] for r in rows[::7]] + ["http://absent.example/", "http://twice.example/", "", "http://zzz.example/x"]
    got = W.look_up(directory, spark.createDataFrame([(u,) for u in asked], "url string")).collect()
    keys = {W.capture_key(u or "") for u in asked}
    want = sorted(str(i) for i, u, _ in rows if W.capture_key(u or "") in keys)
    assert sorted({(str(r["page_id"]), W.capture_key(r["asked"])) for r in got}) == sorted({(str(i), W.capture_key(u or "")) for i, u, _ in rows if W.capture_key(u or "") in keys})
    assert set(want) == {str(r["page_id"]) for r in got}


def test_keys_put_a_domains_hosts_together():
    assert W.capture_key("http://WWW.example.net:80/A?b") == "net,example,www:80)/A?b"
    assert W.capture_key("nothing") == ")nothing"


def test_damage_is_noticed():
    data = W.make_record(1, 0, "http://a/", b"payload", sha(b"other"))
    with pytest.raises(ValueError, match="damaged"):
        W.parse_record(data)


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], SCHEMA)
    assert W.read_archive(W.write_archive(pages, f"file://{tmp_path}")).count() == 0


def test_look_up_splits_ranges_and_hot_questions(spark, directory, rows):
    urls = [r[1] for r in rows] + [None, "", "http://absent.example/"]
    asked = spark.createDataFrame([(u,) for u in [*urls, *urls]], "url string")
    seen = {(W.capture_key(u or ""), str(i)) for i, u, _ in rows}
    for most, each in ((1, 7), (2, 50), (10_000, 1)):
        got = W.look_up(directory, asked, most_ranges=most, questions=each).collect()
        assert {(W.capture_key(r["asked"]), str(r["page_id"])) for r in got} == seen
        assert all(r["asked"] is not None for r in got)
    assert W.look_up(directory, asked.limit(0)).count() == 0
