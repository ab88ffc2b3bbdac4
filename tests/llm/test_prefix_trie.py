"""Prefix trie against a trie of dictionaries."""

import hashlib
import random

import numpy as np
import pytest

from pingscape.llm import ordering, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, rep string, depth string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)


def brute(rows, more=()):
    order = lambda x: (x is not None, x)
    convs = {c: [] for c in more if c is not None}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((order(turn), role or "", text or ""))
    paths = {c: [t[1:] for t in sorted(turns)] for c, turns in convs.items()}
    members, ends = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)

    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, [])
        leaves[node] = sum(leaves[k] for k in below) or 1
        saved[node] = sum(saved[k] for k in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
        for n, m in members.items()
    )


def got(spark, rows, more=None, weight=prefix_trie.LOCAL_WEIGHT):
    extra = None if more is None else spark.createDataFrame([(c,) for c in more], "conv_id long")
    nodes, ends = prefix_trie.prefix_trie(frame(spark, rows), extra, local_weight=weight)
    digests = {(r.node, r.depth): r.ends_sha256 for r in prefix_trie.end_digests(ends).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, digests.get((r.conv_id, r.depth), nothing)) for r in nodes.collect())


def conversations(seed, n, alphabet, longest):
    rng, out = random.Random(seed), []
    for c in range(n):
        turns = [(rng.choice("ua"), "t" * rng.randrange(alphabet)) for _ in range(rng.randrange(longest + 1))]
        if out and rng.random() < 0.5:
            head = rng.choice(out)
            turns = head[: rng.randrange(len(head) + 1)] + turns
        out.append(turns)
    return [(c, i, *t) for c, turns in enumerate(out) for i, t in enumerate(turns)], list(range(n))


def subtree(parent, values):
    out = values.copy()
    for v in range(len(parent) - 1, 0, -1):
        out[parent[v]] += out[v]
    return out


@pytest.mark.parametrize("shape", ["random", "path", "star", "broom"])
@pytest.mark.parametrize("n", [1, 2, 3, 50, 700])
def test_centroid_rollup(shape, n):
    rng = np.random.default_rng(n)
    parent = {"random": lambda v: int(rng.integers(0, v)), "path": lambda v: v - 1, "star": lambda v: 0, "broom": lambda v: min(v - 1, n // 2)}[shape]
    parents = np.array([-1] + [parent(v) for v in range(1, n)])
    values = rng.integers(0, 100, (n, 2))
    assert (prefix_trie.roll_up(parents, values) == subtree(parents, values)).all()


def test_trie_in_one_task(spark):
    rows, ids = conversations(1, 80, 3, 4)
    assert got(spark, rows, ids) == brute(rows, ids)


def test_trie_in_distributed_rounds(spark):
    rows, ids = conversations(2, 40, 3, 4)
    assert got(spark, rows, ids, weight=12) == brute(rows, ids)


def test_one_long_conversation_over_all_partitions(spark):
    rows = [(7, i, "u", f"t{i % 5}") for i in range(400)] + [(8, i, "u", f"t{i % 5}") for i in range(200)] + [(9, 0, "u", "t0")]
    assert got(spark, rows, weight=300) == brute(rows)


def test_equal_conversations_and_ties(spark):
    rows = [(c, t, "u", "same") for c in range(30) for t in range(3)] + [(50, 1, "u", "b"), (50, 1, "u", "a"), (50, None, "u", "z"), (50, 1, "u", "a"), (51, None, "u", "z"), (51, 0, "u", "a")]
    assert got(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [(None, 0, "u", "x"), (3, 0, None, None), (4, 0, "", ""), (5, None, "u", "ää\U0001f600"), (6, None, "u", "ää\U0001f600"), (-2, 0, "u", "x" * 100_000), (-1, 0, "u", "x" * 100_000)]
    assert got(spark, rows, [None, 99, -5, 3]) == brute(rows, [None, 99, -5, 3])
    assert got(spark, [], [4, 9]) == brute([], [4, 9])
    assert got(spark, []) == []


def test_running_numbers_across_partitions(spark):
    rows = [(k, i, i * 7919 + k) for k, n in [(1, 3), (2, 500), (3, 1), (4, 300)] for i in range(n)]
    df = spark.createDataFrame(rows, "k long, o long, x long").repartition(5)
    got_ = {(r.k, r.o): (r.pos, r.x) for r in ordering.running(df, "k", ["o"], ["x"]).collect()}
    want, total = {}, {}
    for k, o, x in rows:
        total[k] = total.get(k, 0) ^ x
        want[k, o] = (o, total[k])
    assert got_ == want


def test_query_rebuilds_conversations(spark):
    from zlib import crc32

    from pingscape.llm.catalog import _rebuilt

    rng = random.Random(4)
    own = {c: [("u", f"{c}.{i}") for i in range(rng.randrange(1, 9))] for c in [*range(0, 12), 100, 101, 150, 203, 250]}
    rows = [(c, i, *t) for c, turns in own.items() for i, t in enumerate(turns)]
    got_ = {}
    for r in sorted(_rebuilt(frame(spark, rows)).collect(), key=lambda r: r.pos):
        got_.setdefault(r.conv_id, []).append((r.role, r.text))
    for c, turns in own.items():
        h = crc32(str(c).encode()) % 6
        assert got_.get(c, []) == own.get(c - c % 100, [])[:h] + turns[h:]
