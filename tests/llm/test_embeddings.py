import numpy as np
import pytest

from pingscape.llm import catalog, embeddings

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.98):
    """{id: (links, component)} over all pairs in double precision."""
    usable = []
    for i, v, label in rows:
        good = i is not None and label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        usable.append(np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) if good else None)
    links, parent = [0] * len(rows), {r[0]: r[0] for r in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = usable[a], usable[b]
            if x is not None and y is not None and rows[a][2] == rows[b][2] and len(x) == len(y) and x @ y >= threshold:
                links[a] += 1
                links[b] += 1
                ra, rb = find(rows[a][0]), find(rows[b][0])
                parent[max(ra, rb)] = min(ra, rb)
    return {r[0]: (links[n], find(r[0])) for n, r in enumerate(rows)}


def planted(seed, d=64, groups=12, alone=300):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        base = rng.standard_normal(d)
        for _ in range(int(rng.integers(2, 40 if g == 0 else 8))):
            v = base / np.linalg.norm(base) + rng.standard_normal(d) * rng.choice([0.0, 0.005, 0.012, 0.02, 0.03])
            out.append(v)
    out += list(rng.standard_normal((alone, d)))
    order = rng.permutation(len(out))
    return [(n, [float(np.float32(x)) for x in out[i]], int(i % 2) if i % 5 else 0) for n, i in enumerate(order.tolist())]


def collect(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_links_are_found_and_none_is_invented(spark):
    rows = planted(1)
    got, want = collect(embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA))), brute(rows)
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(v[0] for v in got.values()) >= 0.98 * sum(v[0] for v in want.values())


@pytest.mark.parametrize("rows_per_label", [10**6, 10**9])
def test_links_are_found_at_the_widths_of_large_inputs(spark, rows_per_label):
    rows = planted(4)
    layout = embeddings.table_layout(rows_per_label, 0.98, embeddings.TARGET_RECALL)
    assert layout[0] >= 18
    got, want = collect(embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), layout=layout)), brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(v[0] for v in got.values()) >= 0.98 * sum(v[0] for v in want.values())


def test_blocks_count_every_pair_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(i, [float(np.float32(x)) for x in base + 0.01 * rng.standard_normal(16)], 1) for i in range(90)]
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 8)
    got = collect(embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    want = brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(v[0] for v in got.values()) >= 0.98 * sum(v[0] for v in want.values())
    assert {v[1] for v in got.values()} == {0}


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [1.0, 0.0], 1), (10, [2.0, -0.0], 1),
            (11, [1.0, 0.0, 0.0], 1), (12, [1.0, 0.0], 2), (13, [1e-30, 0.0], 1), (14, [3e38, 0.0], 1), (15, [-1.0, 0.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows] + [(None, [1.0, 0.0], 1, "x", 1)], SCHEMA + ", size string, links int")
    out = embeddings.near_duplicates(df).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in out if r.vec_id is not None}
    assert got == brute(rows)
    assert [(r.n_links, r.component_id, r.kept) for r in out if r.vec_id is None] == [(0, None, True)]
    assert all(r.kept == (r.vec_id == r.component_id) for r in out if r.vec_id is not None)


def test_query_on_the_smoke_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert collect(catalog.op5_embedding_dedup(spark, sf)) == brute(rows)


def test_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rotation_lowers_the_quantisation_loss():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 8)) @ rng.standard_normal((8, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    loss = lambda p: ((np.where(x @ p >= 0, 1, -1) - x @ p) ** 2).sum()
    start, learned = embeddings.fit_rotations(x, 16, rounds=0), embeddings.fit_rotations(x, 16)
    assert loss(learned) < loss(start)
    bits = x @ learned >= 0
    assert np.abs(bits.mean(axis=0) - 0.5).max() < 0.3


@pytest.mark.parametrize("rows", [10, 5000, 10**6, 10**9])
def test_tables_reach_the_recall_aimed_at(rows):
    bits, tables = embeddings.table_layout(rows, 0.98, 0.99)
    agree = (1 - np.arccos(0.98) / np.pi) ** bits
    assert 1 - (1 - agree) ** tables >= 0.99 and bits >= 8
