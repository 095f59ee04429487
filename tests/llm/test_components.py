import random

from pricequarry.llm.components import components


def slow(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_chains_hubs_and_cliques(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(1000, 1001 + i) for i in range(300)]
    loose = [(rng.randrange(-50, 0), rng.randrange(-50, 0)) for _ in range(30)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in chain + hub + loose if a != b]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == slow(edges)


def test_no_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
