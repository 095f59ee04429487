import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pricequarry.llm import simhash as S


def slow_fingerprint(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(ids, fps, radius):
    label = list(range(len(ids)))
    near = [[bin(a ^ b).count("1") <= radius for b in fps] for a in fps]
    while True:
        new = [min(label[j] for j in range(len(ids)) if near[i][j]) for i in range(len(ids))]
        if new == label:
            break
        label = new
    least = {}
    for i, k in enumerate(label):
        if ids[i] is not None:
            least[k] = min(least.get(k, ids[i]), ids[i])
    return [least.get(k) for k in label]


def test_fingerprints_and_components(docs, edge_rows):
    fps = [slow_fingerprint(r[1]) for r in edge_rows]
    want = sorted(zip([r[0] for r in edge_rows], fps, slow_components([r[0] for r in edge_rows], fps, 4), strict=True), key=str)
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in S.simhash_groups(docs).collect()]
    assert sorted(got, key=str) == want


@pytest.mark.parametrize("radius", [0, 3, 6])
def test_tiles_find_every_link(spark, radius, monkeypatch):
    monkeypatch.setattr(S, "TILE_ROWS", 64)
    rng = np.random.default_rng(radius)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([seeds, seeds.repeat(6) ^ (np.uint64(1) << rng.integers(0, 64, 240).astype(np.uint64))]))
    ids = np.arange(len(fps))
    table = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long").repartition(5)
    labels = {int(f): int(i) for f, i in zip(fps.view(np.int64), ids, strict=True)}
    from pricequarry.llm.components import union_pairs

    got = np.arange(len(fps))
    pairs = S.near_links(table, radius, block_rows=50).collect()
    union_pairs(got, np.array([labels[p["a"]] for p in pairs], int), np.array([labels[p["b"]] for p in pairs], int))
    want = np.arange(len(fps))
    i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
    union_pairs(want, i, j)
    assert (got == want).all()


def test_a_block_skips_no_tile_within_reach():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    b = a ^ (np.uint64(1) << rng.integers(0, 64, len(a)).astype(np.uint64))
    block = S.Block(a, 1)
    linked, _ = block.links(b)
    later = S.cells_of(b) >= S.cells_of(a)
    assert set(b[later].tolist()) <= set(linked.tolist())


def test_dedup_keeps_the_smallest_id_and_all_columns(docs):
    more = docs.withColumns({"gone": F.lit(1), "fp": F.lit("x"), "component_id": F.lit(0)})
    got = S.simhash_dedup(more)
    assert got.columns == more.columns
    ids = [r["doc_id"] for r in got.collect()]
    kept = {r["component_id"] for r in S.simhash_groups(docs).collect()} - {None}
    assert sorted(i for i in ids if i is not None) == sorted(kept)


def test_empty_table(empty):
    assert S.simhash_groups(empty).count() == 0
    assert S.simhash_dedup(empty).count() == 0
