import hashlib
import random

import numpy as np
import pytest

from basketry.llm import centroid_clustering as C

SHAPE = "vec_id long, embedding array<float>, near int, cluster string, _v int"


def brute(rows, k, rounds, dims, factor=64, seed=1):
    kept = [(i, [int(np.floor(float(np.float32(x)) * factor)) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and np.isfinite(np.float32(x)) for x in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cen, x = np.array([v for _, v in order[:k]]), np.array([v for _, v in kept])

    def assigned():
        d = ((x[:, None, :] - cen[None]) ** 2).sum(-1)
        return d.argmin(1), d.min(1)

    for _ in range(rounds):
        a, _ = assigned()
        for c in range(len(cen)):
            if (a == c).any():
                cen[c] = x[a == c].sum(0) // (a == c).sum()
    a, d = assigned()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cen.tolist()]
    return [(i, int(a[j]), int(d[j]), int(d[a == a[j]].sum()), int(d.sum()), sha[a[j]]) for j, (i, _) in enumerate(kept)]


def key(r):
    return tuple((v is not None, v) if v is not None else (False, 0) for v in r)


def test_matches_brute_force(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in e.collect()]
    for k, rounds in ((16, 3), (40, 6), (1, 2)):
        got = [tuple(r) for r in C.cluster(e, k=k, rounds=rounds).collect()]
        assert sorted(got) == sorted(brute(rows, k, rounds, 64))


def test_odd_rows(spark):
    r = random.Random(5)
    rows = [(i % 40 if i % 9 else None, [r.randrange(-3, 4) / 64 for _ in range(4)]) for i in range(300)]  # many ties and repeats
    rows += [(500, None), (501, [0.0, 1.0]), (502, [0.0, None, 1.0, 2.0]), (503, [float("nan"), 0.0, 0.0, 0.0]), (504, [float("-inf"), 0.0, 0.0, 0.0]), (None, [-0.001, 0.001, 1e3, -1e3])]
    df = spark.createDataFrame([(*x, 1, "c", 2) for x in rows], SHAPE)
    for k, rounds in ((7, 4), (400, 2)):
        got = [tuple(x) for x in C.cluster(df, k=k, rounds=rounds, dims=4).collect()]
        assert sorted(got, key=key) == sorted(brute(rows, k, rounds, 4), key=key)
    assert C.cluster(df.limit(0), dims=4).collect() == [] and C.cluster(df, dims=5).collect() == []


def test_huge_components_are_refused(spark):
    with pytest.raises(Exception, match="exceeds"):
        C.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<float>"), dims=2).collect()


def test_bounds_save_searches_and_stay_exact():
    r = np.random.default_rng(3)
    hearts = r.integers(-2000, 2000, (12, 8))
    x = hearts[r.integers(0, 12, 3000)] + r.integers(-60, 60, (3000, 8))
    points = x[:12].copy()
    cen, state, searched = C.Centroids(points), (np.zeros(3000, np.int64), np.ones(3000, np.int64), np.full(3000, np.inf), np.zeros(3000)), []
    for _ in range(12):
        *state, n = C.search(x, cen, *state)
        searched.append(n)
        d = ((x[:, None, :] - cen.points[None]) ** 2).sum(-1)
        assert (state[0] == d.argmin(1)).all()
        moved = np.array([x[state[0] == c].sum(0) // max(1, (state[0] == c).sum()) if (state[0] == c).any() else cen.points[c] for c in range(12)])
        cen = C.Centroids(moved, cen.points)
    assert searched[0] == 3000 and searched[-1] < 300
