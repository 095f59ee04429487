import hashlib
import re

import numpy as np
import pytest

from pricequarry.llm import minhash as M

from .conftest import prose


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_hashes_stand_for_shingles():
    texts = ["", " ", "a", "a b c d e", "a B c d e f", prose(1, 300), "x" * 300_000 + " y", prose(2, 40_000)]
    alone = [M.shingle_hashes([t.encode()])[0] for t in texts]
    for a, b, t in zip(M.shingle_hashes([t.encode() for t in texts]), alone, texts, strict=True):
        assert (a == b).all()
        assert t.startswith("xx") or len(set(a.tolist())) == len(shingles(t))


@pytest.mark.parametrize("n", [300, 30_000])
def test_signatures_estimate_jaccard(n):
    base = prose(4, n)
    other = " ".join(base.split(" ")[n // 8 :]) + " " + prose(5, n // 8)
    family = M.Permutations(1024)
    fp = M.fingerprint(family.signatures(M.shingle_hashes([base.encode(), other.encode()])))
    assert abs(M.likeness(fp[:1], fp[1:])[0] - jaccard(shingles(base), shingles(other))) < 0.06


def test_each_document_beside_the_next(docs, edge_rows):
    got = M.fingerprint_documents(docs).collect()
    order = sorted(((r[0], r[1] or "") for r in edge_rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want = {}
    for (i, t), (_, following) in zip(order, [*order[1:], order[0]], strict=True):
        n = len(t) // 4
        want.setdefault(i, []).append((len(t), hashlib.sha256((t[: len(t) - n] + following[:n]).encode()).hexdigest()))
    assert len(got) == len(edge_rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_chars"], r["edited_sha256"]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert {k: sorted(v) for k, v in by.items()} == {k: sorted(v) for k, v in want.items()}
    same = {}
    text = {r[0]: r[1] or "" for r in edge_rows if r[0] is not None}
    for r in got:
        if r["doc_id"] is not None:
            assert same.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]


def likeness_of(a, b):
    """From two hexadecimal fingerprints, by the definition."""
    a, b = bytes.fromhex(a), bytes.fromhex(b)
    share = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    return min(1.0, max(0.0, (share - 1 / 256) / (1 - 1 / 256)))


def test_likenesses_are_those_of_the_fingerprints_and_near_jaccard(spark):
    rows = [(i, prose(60 + i // 3, 400).replace("river", "lake", 4 * (i % 3))) for i in range(30)] + [(30, None), (31, "one two")]
    got = M.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    text = dict(rows)
    for r, n in zip(got, [*got[1:], got[0]], strict=True):
        own, following = text[r["doc_id"]] or "", text[n["doc_id"]] or ""
        cut = len(own) // 4
        edited = own[: len(own) - cut] + following[:cut]
        # the edited text's fingerprint is what that text has as a document of its own
        alone = M.fingerprint(M.Permutations().signatures(M.shingle_hashes([edited.encode()])))[0].tobytes().hex()
        assert r["edited_fingerprint"] == alone
        assert r["near_edited"] == pytest.approx(likeness_of(r["fingerprint"], r["edited_fingerprint"]))
        assert r["near_next"] == pytest.approx(likeness_of(r["fingerprint"], n["fingerprint"]))
        # four standard deviations of 128 permutations
        assert abs(r["near_edited"] - jaccard(shingles(own), shingles(edited))) < 0.18
        assert abs(r["near_next"] - jaccard(shingles(own), shingles(following))) < 0.18


def test_string_ids(spark):
    rows = [("b", "one two three"), ("a", "four five six"), (None, "x"), ("ä", None)]
    got = {r["doc_id"]: r for r in M.fingerprint_documents(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert set(got) == {"a", "b", "ä", None}
    assert got["a"]["edited_sha256"] == hashlib.sha256(b"four five one").hexdigest()


def test_near_copies_are_the_components_of_exact_similarity(docs, edge_rows, spark):
    rows = [(i, prose(50 + i % 4, 200).replace("river", "lake", i // 4)) for i in range(40)] + [(100, None), (101, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component"] for r in M.near_copies(df).collect()}
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if jaccard(sets[a], sets[b]) >= 0.8:
                    label[a] = label[b] = min(label[a], label[b])
    for a in sets:
        for b in sets:
            assert (got[a] == got[b]) == (label[a] == label[b])


def test_documents_that_share_a_passage_are_not_near_and_hide_none(spark, monkeypatch):
    """Buckets of many classes that are not near their least one, with near pairs among them, in chunks and in one."""
    passage = prose(9, 300)
    rows = [(i, f"{passage} {prose(700 + i // 2, 120 if i < 60 else 100)}{' lake' * (i % 2)}") for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if b > a and jaccard(sets[a], sets[b]) >= 0.75 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if v == high else v for k, v in label.items()}
    assert 1 < len(set(label.values())) < 120
    for chunk in (10_000, 7):
        monkeypatch.setattr(M, "CHUNK_CLASSES", chunk)
        got = {r["doc_id"]: r["component"] for r in M.near_copies(df, similarity=0.75).collect()}
        assert all((got[a] == got[b]) == (label[a] == label[b]) for a in sets for b in sets)


def test_one_document_and_none(spark, empty):
    one = spark.createDataFrame([(5, "a b c d e f g h")], "doc_id long, text string")
    r = M.fingerprint_documents(one).collect()[0]
    assert r["near_next"] == 1.0
    assert M.fingerprint_documents(empty).count() == 0
    assert M.near_copies(empty).count() == 0
    assert np.isfinite(r["near_edited"])
