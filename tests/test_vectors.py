"""Nearest vectors by the index of cells and rings against all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from pricequarry.operators import search, vectors

SCHEMA = "id long, v array<double>, c string"


def drawn(seed, n=400, dims=8):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in rng.choice(middles)], rng.choice(["Meat", "Dairy", "x", None])) for i in range(n)]
    # repeats, scaled and opposite ones, and what has no angle
    rows += [(1000 + i, [x * 3.0 for x in v], c) for i, v, c in rows[:20]] + [(2000, [-x for x in rows[0][1]], "Meat")]
    rows += [(3000, None, "Meat"), (3001, [0.0] * dims, "Meat"), (3002, [math.nan] * dims, "Dairy"), (3003, [None] * dims, "x"), (3004, [math.inf] * dims, "x")]
    return rows


@pytest.mark.parametrize("seed, cells, rows_of_ring", ((1, None, 4096), (2, 1, 4096), (3, 7, 5)))
def test_same_as_all_pairs(spark, seed, cells, rows_of_ring, monkeypatch):
    monkeypatch.setattr(vectors, "RING_ROWS", rows_of_ring)
    rows = drawn(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("q", F.lit("clash"))
    asked = df.where("id % 5 = 0").withColumnRenamed("id", "k")
    index = vectors.angular_index(df, "id", "v", "c", cells)

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a)) / math.sqrt(sum(x * x for x in b))

    fine = [r for r in rows if r[1] and None not in r[1] and all(map(math.isfinite, r[1])) and any(r[1])]
    for least in (0.9, 0.3):
        got = {r["k"]: (r["id"], round(r["similarity"], 9)) for r in vectors.nearest_by_angle(asked, index, "k", "id", "v", "c", lambda _, x=least: F.lit(x), others_only=True).collect()}
        want = {}
        for i, v, c in fine:
            if i % 5 == 0:
                near = max(((cosine(v, w), j) for j, w, d in fine if c == d and i != j), default=(0, 0))
                if near[0] >= least:
                    want[i] = near
        assert got.keys() == want.keys()
        assert all(abs(got[i][1] - want[i][0]) < 1e-8 for i in want)


def test_same_as_the_exact_way_with_limits_of_categories(spark):
    df = spark.createDataFrame([r for r in drawn(4) if r[0] < 3000 and r[2]], SCHEMA)
    asked = df.where("id % 3 = 0").withColumnRenamed("id", "k")
    want = {(r["k"], round(r["similarity"], 9)) for r in search.nearest_vector(asked, df, "k", "id", "v", "c", others_only=True).collect()}
    index = vectors.angular_index(df, "id", "v", "c")
    assert {(r["k"], round(r["similarity"], 9)) for r in vectors.nearest_by_angle(asked, index, "k", "id", "v", "c", others_only=True).collect()} == want and want


def test_fewer_pairs_than_all(spark):
    df = spark.createDataFrame([r for r in drawn(5, 1200) if r[0] < 1000], SCHEMA)
    index = vectors.angular_index(df, "id", "v")
    held = index.rows.groupBy("cell", "ring").count().collect()
    assert sum(r["count"] for r in held) == df.count() and len(held) > 20


def test_nothing_to_index(spark):
    assert vectors.angular_index(spark.createDataFrame([(1, None, "x"), (2, [0.0], "x")], SCHEMA), "id", "v") is None


def test_questions_go_to_cells_not_rings(spark):
    df = spark.createDataFrame([r for r in drawn(6, 60) if r[0] < 1000], SCHEMA)
    near = vectors.nearest_by_angle(df.withColumnRenamed("id", "k"), vectors.angular_index(df, "id", "v", "c"), "k", "id", "v", "c")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" in plan and "ring" not in plan.split("CoGroups")[0]
