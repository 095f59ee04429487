import math

import numpy as np
import pytest

from pricequarry.llm.embedding_dedup import SIMILARITY, MultiIndex, near_vectors, nearest_cells, op13_embedding_dedup, units

SCHEMA = "vec_id long, embedding array<float>, label int"


def turned(rng, x, cosine):
    """A vector of another length at this cosine from x."""
    y = rng.normal(size=len(x))
    u = x / np.linalg.norm(x)
    y -= (y @ u) * u
    return (cosine * u + math.sqrt(1 - cosine**2) * y / np.linalg.norm(y)) * rng.uniform(0.5, 3)


def usable(e, label):
    return label is not None and e is not None and len(e) > 0 and all(v is not None and math.isfinite(v) for v in e) and any(e)


def brute(rows):
    ok = [usable(e, label) for _, e, label, *_ in rows]
    links = [set() for _ in rows]
    for i, (_, a, la, *_) in enumerate(rows):
        for j in range(i):
            _, b, lb, *_ = rows[j]
            if ok[i] and ok[j] and la == lb and len(a) == len(b):
                x, y = (np.array(v, np.float32).astype(np.float64) for v in (a, b))
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= SIMILARITY:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        least = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), least, rows[i][0] == least))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    vectors = [rng.normal(size=16) for _ in range(400)]
    rows = [(i, v, i % 3) for i, v in enumerate(vectors)]
    rows += [(1000 + i, turned(rng, vectors[i], c), i % 3) for i, c in zip(range(0, 300, 3), np.linspace(0.95, 0.999, 100), strict=True)]
    rows += [(2000 + i, turned(rng, vectors[3], 0.99), 0) for i in range(150)]  # a large group of near copies
    rows += [(3000 + i, vectors[4], 1) for i in range(60)]  # and one of copies
    chain = [turned(rng, vectors[5], 0.985)]
    for _ in range(6):
        chain.append(turned(rng, chain[-1], 0.985))
    rows += [(4000 - i, v, 2) for i, v in enumerate(chain)]
    out = [(i, [float(np.float32(x)) for x in v], label) for i, v, label in rows]
    one = out[7][1]
    return [
        *out,
        (5000, None, 1),
        (5001, one, None),
        (5002, [0.0] * 16, 1),
        (5003, [*one[:-1], None], 1),
        (5004, [*one[:-1], math.nan], 1),
        (5005, [*one[:-1], math.inf], 1),
        (5006, [], 1),
        (5007, [1.0], 1),
        (5008, [2.0], 1),
        (5009, [-1.0], 1),
        (5010, one[:8], 1),
        (5011, one, 2),
        (5012, [x * 2.0**60 for x in one], 1),
        (7, one, 1),
        (None, one, 1),
        (None, None, None),
        (None, [0.0], 4),
    ]


@pytest.mark.parametrize("cell_rows, held, callers", [(512, 4096, 65_536), (512, 16, 40), (4, 16, 20)])
def test_against_all_pairs(spark, rows, cell_rows, held, callers):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(near_vectors(df, target=0.9999, cell_rows=cell_rows, held=held, callers=callers)) == brute(rows)


def test_recall_by_an_index_with_many_cells(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(6000, 32))
    y = np.array([turned(rng, v, c) for v, c in zip(x, np.linspace(0.98, 0.9999, len(x)), strict=True)])
    index = MultiIndex(x[:3000], 16)
    (a, ahead), (b, back) = index.place(x), index.place(y)
    met = [i == j or j in v or i in w for i, j, v, w in zip(a, b, ahead, back, strict=True)]
    assert np.mean(met) >= 0.995
    assert np.mean([len(v) for v in ahead]) < 64  # of 256
    assert all(c > i for i, v in zip(a, ahead, strict=True) for c in v)


def test_traversal_gives_all_cells_within_in_order():
    rng = np.random.default_rng(2)
    for _ in range(50):
        first, second = rng.random(7), rng.integers(0, 3, 5) / 2
        first[rng.integers(7)] = 0
        got = list(nearest_cells(first, second, 0.8))
        assert [s for *_, s in got] == sorted(s for *_, s in got)
        assert {(i, j) for i, j, _ in got} == {(i, j) for i in range(7) for j in range(5) if first[i] + second[j] <= 0.8}
        assert len({(i, j) for i, j, _ in got}) == len(got)


def test_reach_never_passes_the_true_distance():
    rng = np.random.default_rng(4)
    x = units(rng.normal(size=(800, 12)))
    index = MultiIndex(x, 8)
    _, first, _ = index.reach(x)
    own = first.argmin(axis=1)
    d = ((x[:, None, :6] - x[None, :, :6]) ** 2).sum(axis=2)
    assert (first[:, own] <= d + 1e-9).all()


def test_clashing_names_string_labels_and_empty_table(spark, rows):
    some = [(str(i), e, f"l:{label}", 1, 2, 3) for i, e, label in rows[:450] if i is not None]
    df = spark.createDataFrame(some, "vec_id string, embedding array<double>, label string, key int, cell int, n int")
    assert result(near_vectors(df)) == brute(some)
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_query(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert result(op13_embedding_dedup(spark, str(tmp_path))) == brute(rows)
