import random

from pingscape.llm.components import connected, leaders, salted


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def test_random_graphs_paths_and_stars(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(50)]
    edges += [(100 + i, 101 + i) for i in range(60)] + [(300, 301 + i) for i in range(200)] + [(900 - i, 901 - i) for i in range(40)] + [(5, 5), (5, 6), (6, 5)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = brute([e for e in edges if e[0] != e[1]])
    assert got == want


def test_no_edges(spark):
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def test_leaders_of_a_hot_key(spark):
    rows = [(7, i) for i in range(1000, 3000)] + [(8, 5), (8, 5), (9, 1)]
    df = spark.createDataFrame(rows, "k long, id long")
    led = leaders(df, ["k"], "id")
    joined = salted(df, "id").join(led, ["k", "salt"]).select("k", "id", "leader", "size").collect()
    assert len(joined) == len(rows)
    assert {(r.k, r.leader, r["size"]) for r in joined} == {(7, 1000, 2000), (8, 5, 2), (9, 1, 1)}
