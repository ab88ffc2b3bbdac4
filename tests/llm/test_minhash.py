import random
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np

from pingscape.llm import catalog, minhash

from .helpers import CLASHING, documents


def labelled(text):
    """Labelled shingles of a text, by tuples instead of hashes."""
    w = (text or "").encode().split()
    grams = [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    seen, out = Counter(), []
    for g in grams:
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b):
            diagonal, row[j + 1] = row[j + 1], diagonal + 1 if x == y else max(row[j], row[j + 1])
    return row[-1]


def brute(rows, similarity=0.8):
    """Components over all pairs (small inputs only)."""
    docs = {i: labelled(t) for i, t in rows if i is not None}
    parent = {i: i for i in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(docs)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = docs[a], docs[b]
            if not x or not y or min(len(x), len(y)) < similarity * max(len(x), len(y)) or find(a) == find(b):
                continue
            if sum((Counter(x) & Counter(y)).values()) < similarity / (1 + similarity) * (len(x) + len(y)) - 1e-9:
                continue
            m = lcs(x, y)
            if m >= similarity * (len(x) + len(y) - m) - 1e-9:
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in docs}


def groups_of_copies(seed, n_groups=14, biggest=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    shared = [word() for _ in range(60)]
    rows, doc = [], 0
    for g in range(n_groups):
        base = [word() for _ in range(rng.choice([3, 12, 60, 200]))]
        if g % 3 == 0:
            base += shared
        for _ in range(biggest if g == 0 else rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                i = rng.randrange(len(w))
                rng.choice([lambda: w.__setitem__(i, word()), lambda: w.insert(i, word()), lambda: w.pop(i) if len(w) > 2 else None])()
            rows.append((doc, " ".join(w)))
            doc += 1
    rng.shuffle(rows)
    return [(i, t) for i, (_, t) in enumerate(rows)]


def test_planted_groups_equal_brute_force(spark):
    rows = groups_of_copies(3)
    got = {r.doc_id: r for r in minhash.near_duplicates(documents(spark, rows, CLASHING)).collect()}
    want = brute(rows)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.kept == (i == want[i]) for i, r in got.items())
    texts = dict(rows)
    first = {}
    for i in sorted(texts):
        first.setdefault(texts[i].split().__str__(), i)
    assert {i: r.class_id for i, r in got.items()} == {i: first[texts[i].split().__str__()] for i in texts}


def spun_copies(seed, n=300, planted=30, slots=20, variants=4):
    """One template whose slots are filled by chance, so that members share sketches but are not linked,
    and `planted` members that differ from an earlier one in just as many slots as a link allows."""
    rng = random.Random(seed)
    fixed = [[f"w{s}x{i}" for i in range(14)] for s in range(slots)]
    filled = [[rng.randrange(variants) for _ in range(slots)] for _ in range(n)]
    for i in range(planted):
        near = list(filled[i])
        for s in rng.sample(range(slots), 6):
            near[s] = (near[s] + 1) % variants
        filled.append(near)
    rng.shuffle(filled)
    return [(i, " ".join(" ".join([*fixed[s], f"slot{s}is{v}"]) for s, v in enumerate(f))) for i, f in enumerate(filled)]


def test_planted_links_in_a_large_group_of_unlinked_members(spark):
    rows = spun_copies(7)
    want = brute(rows)
    assert 25 <= len(rows) - len(set(want.values())) <= 60
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == want


def test_blocks_of_a_bucket_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 20)
    monkeypatch.setattr(minhash, "MARKED_MEMBERS", 32)
    monkeypatch.setattr(minhash, "STEP_SHINGLES", 64)
    rows = spun_copies(8, n=120, planted=15)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(documents(spark, rows)).collect()} == brute(rows)


def test_query_equals_brute_force_on_the_smoke_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in catalog.op3_order_minhash(spark, sf).collect()}
    assert got == brute(rows)


def test_awkward_rows(spark):
    same = " ".join(f"w{i}" for i in range(30))
    rows = [(None, same), (None, None), (1, None), (2, ""), (3, " \n"), (4, same), (5, same.replace(" ", "\n")), (5, same), (6, "a"), (7, "a"), (8, "a b"), (9, "b a"), (10, "x " * 20_000), (11, "x " * 20_001), (12, "z" * 100_000)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(documents(spark, rows)).collect()), key=str)
    want = {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 10, 12: 12}
    assert got == sorted([(i, None if i is None else want[i], i is None or want[i] == i) for i, _ in rows], key=str)


def test_empty_table(spark):
    assert minhash.near_duplicates(documents(spark, [])).collect() == []


def test_aligned_is_the_longest_common_sequence():
    rng = random.Random(2)
    for _ in range(400):
        a = rng.sample(range(60), rng.randint(1, 40))
        b = [x for x in a if rng.random() < 0.9]
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(b) + 1)
            b.insert(i, 100 + i)
        b = list(dict.fromkeys(b))
        if rng.random() < 0.3:
            k = rng.randrange(len(b) + 1)
            b = b[k:] + b[:k]
        m, total = lcs(a, b), len(a) + len(b)
        got = minhash.similar(np.array(a, np.uint64), np.array(b, np.uint64)) if b else False
        assert got == (bool(b) and m >= 0.8 * (total - m) - 1e-9)


def test_order_matters():
    a = [f"w{i}" for i in range(100)]
    moved = a[50:] + a[:50]
    x, y = ([hash(s) & (2**63 - 1) for s in labelled(" ".join(w))] for w in (a, moved))
    common = len(set(x) & set(y)) / len(set(x) | set(y))
    assert common > 0.8 and not minhash.similar(np.array(x, np.uint64), np.array(y, np.uint64))
    assert SequenceMatcher(None, a, moved).ratio() < 0.6


def test_sketches_keep_text_order_and_find_similar_texts():
    import pyarrow as pa

    from pingscape.llm import text as tx

    rng = random.Random(4)
    hits = defaultdict(int)
    for _ in range(60):
        a = [f"w{rng.randint(0, 9999)}" for _ in range(200)]
        near = list(a)
        near[rng.randrange(200)] = "edit"
        texts = [" ".join(a), " ".join(near), " ".join(a[100:] + a[:100]), " ".join(f"v{rng.randint(0, 9999)}" for _ in range(200))]
        _, _, buf, offs = next(tx.slices(pa.array(texts)))
        plain, lab, begin, _ = minhash.shingles(buf, offs)
        keys = minhash.order_sketches(plain, lab, begin)
        for i, name in ((1, "near"), (2, "moved"), (3, "other")):
            hits[name] += int((keys[0] == keys[i]).sum())
    assert hits["near"] > 0.85 * 60 * 16 and hits["moved"] < 0.75 * hits["near"] and hits["other"] == 0


def test_parity_bitmaps_lose_no_similar_pair():
    rng = np.random.default_rng(5)
    found = dropped = 0
    for _ in range(300):
        n = int(rng.integers(1, 300))
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        keep = a[rng.random(n) < rng.choice([0.6, 0.9, 1.0])]
        b = np.concatenate([keep, rng.integers(0, 1 << 63, int(rng.integers(0, n // 3 + 2))).astype(np.uint64)])
        if not len(b):
            continue
        keys = np.arange(16)
        members = [(i, i, keys, len(x), minhash.parity_marks(x)) for i, x in enumerate((a, b))]
        i, j = minhash.close_members(members[:1], members[1:], 0)
        assert (len(i), len(j)) in ((0, 0), (1, 1)) and len(minhash.close_members(members, None, 0)[0]) == len(i)
        common = len(np.intersect1d(a, b))
        linked = common >= 0.8 * (len(a) + len(b) - common) - 1e-9
        assert len(i) or not linked
        found += linked
        dropped += not len(i)
    assert found > 50 and dropped > 80


def test_close_members_leave_pairs_of_an_earlier_sketch_and_of_one_component():
    x = np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    marks, keys = minhash.parity_marks(x), np.arange(16)
    assert [v.tolist() for v in minhash.close_members([(1, 1, keys, 100, marks)], [(2, 2, keys, 100, marks)], 3)] == [[], []]
    later = np.where(np.arange(16) < 3, -1, keys)
    assert [v.tolist() for v in minhash.close_members([(1, 1, keys, 100, marks)], [(2, 2, later, 100, marks)], 3)] == [[0], [0]]
    assert [v.tolist() for v in minhash.close_members([(1, 1, keys, 100, marks)], [(2, 1, later, 100, marks)], 3)] == [[], []]
