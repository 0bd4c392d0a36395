import random

import numpy as np

from gridloom.llm import neardup

from .conftest import documents


def brute(rows):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [shingles(t) for _, t, _ in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= 85 * len(a | b) and find(i) != find(j):
                parent[find(i)] = find(j)
    out = []
    for i, (doc_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc_id))
    return out


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6)))
    rows, passage = [], [word() for _ in range(40)]
    for base in range(12):
        words = [word() for _ in range(rng.choice([4, 7, 30, 120]))] + passage * (base % 2)
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                copy[rng.randrange(len(copy))] = word()
            rows.append((rng.randrange(10_000), " ".join(copy).title() if rng.random() < 0.3 else "\t".join(copy), "s"))
    middle = [word() for _ in range(150)]
    for i in range(60):
        copy = list(middle)
        for at in rng.sample(range(150), i % 7):
            copy[at] = word() + str(i)
        rows.append((20_000 + i, " ".join(copy), "s"))
    rows += [(rows[0][0], rows[0][1], "s"), (77, None, None), (78, "", "s"), (79, " \n ", "s"), (None, rows[5][1], "s"), (80, "one", "s"), (81, "ONE", "s"), (82, "x y z w v " * 3000, "s")]
    return rows


def test_against_brute_force(spark):
    rows = corpus()
    df = documents(spark, rows).selectExpr("*", "'x' as kept", "1 as digest", "2 as bucket", "'k' as key", "3 as component")
    out = neardup.near_duplicates(df).collect()
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=key) == sorted(brute(rows), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    left = neardup.deduplicate(df)
    assert left.columns == df.columns
    assert left.count() == len({(r.key) for r in out if r.kept})


def test_shuffled_joins_and_empty(spark):
    df = documents(spark, corpus())
    few = neardup.MinHash(broadcast_keys=0)
    assert sorted(map(str, neardup.near_duplicates(df, p=few).collect())) == sorted(map(str, neardup.near_duplicates(df).collect()))
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def test_signature_is_minhash():
    """Agreement of coordinates estimates similarity without bias."""
    rng = np.random.default_rng(1)
    c = neardup.circulant(neardup.MinHash(bands=50))
    agree = []
    for _ in range(60):
        u = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64) * np.uint64(2))
        a, b = u[:240], u[60:]
        agree.append(np.mean(c.signature(a) == c.signature(b)))
        assert np.isin(c.signature(a), a).all()
    assert abs(np.mean(agree) - 180 / 300) < 0.03
