import math
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricequarry.llm import sharding as H


def test_sizes_slots_and_rows(docs, edge_rows):
    more = docs.withColumns({"shard": F.lit("mine"), "key": F.lit(1), "Slot": F.lit(2), "at": F.lit(3)})
    got = H.shuffle_into_shards(more, 7, block_rows=3)
    assert got.columns == [*more.columns, "_shard", "_Slot".lower()]
    rows = got.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r[0], r[1]) for r in edge_rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r["_shard"]].append(r["_slot"])
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = H.shuffle_into_shards(more, 7, block_rows=3).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_more_shards_than_rows_and_no_rows(spark, empty):
    few = spark.createDataFrame([(i,) for i in range(5)], "doc_id long")
    assert sorted(r["shard"] for r in H.shuffle_into_shards(few, 40).collect()) == [0, 1, 2, 3, 4]
    assert H.shuffle_into_shards(empty, 40).count() == 0


def test_matrix_has_the_law_of_a_uniform_shuffle():
    parts, shards = np.array([3, 0, 5, 4]), np.array([4, 4, 4])
    rng, n = np.random.default_rng(0), 4000
    total = np.zeros((4, 3))
    square = 0.0
    for _ in range(n):
        m = H.communication_matrix(parts, shards, rng)
        assert (m.sum(axis=1) == parts).all() and (m.sum(axis=0) == shards).all()
        total += m
        square += (m[2, 0] - 5 / 3) ** 2
    assert np.abs(total / n - np.outer(parts, shards) / 12).max() < 0.06
    # the variance of one count: n K/N (1 - K/N) (N - n) / (N - 1)
    assert abs(square / n - 5 * (1 / 3) * (2 / 3) * 7 / 11) < 0.06


def test_large_populations_are_drawn_exactly():
    rng = np.random.default_rng(1)
    left = np.array([2_000_000_000, 1_000_000_000])
    drawn = sum(H._marginals(left, 300, rng) for _ in range(50))
    assert drawn.sum() == 15_000 and abs(drawn[0] / 15_000 - 2 / 3) < 0.03
    # 1e12 rows in groups of a billion: in time that does not grow with the rows, sums exact
    began = time.monotonic()
    parts, shards = np.full(20, 10**9, np.int64), H.shard_sizes(2 * 10**10, 40)
    m = H.communication_matrix(parts, shards, rng)
    assert (m.sum(axis=1) == parts).all() and (m.sum(axis=0) == shards).all() and (m >= 0).all()
    assert time.monotonic() - began < 20
    # four standard deviations of 800 counts of mean 2.5e7
    assert abs(m - 25_000_000).max() < 5 * 25_000_000**0.5


@pytest.mark.parametrize("good, bad, n", [(7, 5, 4), (3, 9, 12), (50, 2, 30), (1, 1, 1), (0, 6, 3), (6, 0, 3), (40, 60, 0), (100, 300, 77)])
def test_hypergeometric_chances(good, bad, n):
    rng = np.random.default_rng(5)
    draws = 20_000
    seen = np.bincount([H.hypergeometric(good, bad, n, rng) for _ in range(draws)], minlength=n + 1)
    chance = np.array([math.comb(good, k) * math.comb(bad, n - k) for k in range(n + 1)], float) / math.comb(good + bad, n)
    assert (seen[chance == 0] == 0).all()
    assert np.abs(seen - draws * chance).max() < 5 * (draws / 4) ** 0.5


def test_places_are_uniform(spark):
    few = spark.createDataFrame([(i,) for i in range(12)], "doc_id long").repartition(3).cache()
    seen = np.zeros((12, 12))
    for seed in range(60):
        for r in H.shuffle_into_shards(few, 3, seed=seed).collect():
            seen[r["doc_id"], 4 * r["shard"] + r["slot"]] += 1
    # chi-squared over 144 places with 121 degrees of freedom
    assert ((seen - 5) ** 2 / 5).sum() < 190


def test_groups_of_partitions_draw_what_all_together_would(spark):
    few = spark.createDataFrame([(i,) for i in range(12)], "doc_id long").repartition(4).cache()
    seen = np.zeros((12, 3))
    for seed in range(60):
        rows = H.shuffle_into_shards(few, 3, seed=seed, groups=2).collect()
        assert sorted(Counter(r["shard"] for r in rows).values()) == [4, 4, 4]
        for r in rows:
            seen[r["doc_id"], r["shard"]] += 1
    # chi-squared over 36 counts of 20 each with 22 degrees of freedom
    assert ((seen - 20) ** 2 / 20).sum() < 55


def test_long_texts_make_more_blocks(spark):
    rows = [(i, "x" * (50_000 if i % 10 == 0 else 10)) for i in range(200)]
    got = H.shuffle_into_shards(spark.createDataFrame(rows, "doc_id long, text string"), 2, block_bytes=100_000).collect()
    for s in (0, 1):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(100))
