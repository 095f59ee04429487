import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from pricequarry.llm import exact_dedup as X


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        t = text or ""
        groups["".join(c for c in t if c not in " \t\n\x0b\x0c\r")].append((doc_id, len(t)))
    return {k: (min(v, key=lambda x: (-x[1], x[0] is None, x[0]))[0], len(v)) for k, v in groups.items()}


def test_every_row_and_its_group(docs, edge_rows):
    want = brute(edge_rows)
    got = X.exact_copies(docs).collect()
    assert len(got) == len(edge_rows)
    by = {hashlib.sha256(k.encode()).digest(): v for k, v in want.items()}
    for r in got:
        keep, n = by[bytes(r["digest"])]
        assert (r["keep_id"], r["group_size"]) == (keep, n)
        assert not r["kept"] or r["doc_id"] == keep


def test_a_full_filter_only_costs_time(docs, monkeypatch):
    monkeypatch.setattr(X, "HASHES", 1)
    want = sorted(map(tuple, X.exact_copies(docs).drop("digest").collect()), key=str)
    assert sorted(map(tuple, X.exact_copies(docs, most_slots=1 << 20).drop("digest").collect()), key=str) == want


def test_dedup_keeps_one_of_each_and_all_columns(docs, edge_rows):
    more = docs.withColumns({"digest": F.lit(1), "Maybe": F.lit("x"), "length": F.lit(None).cast("int")})
    got = X.exact_dedup(more)
    assert got.columns == more.columns
    rows = got.collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == sorted((v[0] for v in brute(edge_rows).values()), key=str)
    assert {r["text"] for r in rows} <= {r[1] for r in edge_rows}


def test_empty_table(empty):
    assert X.exact_copies(empty).count() == 0
    assert X.exact_dedup(empty).count() == 0
