"""k-means with adaptive bounds against plain k-means in Python's integers."""

import hashlib
import math

import numpy as np
import pytest

from chronofold.llm import centroids

SCHEMA = "vec_id long, embedding array<double>, label int, near int, cluster string"


def brute(rows, k, rounds, width, factor):
    kept = [(i, [math.floor(factor * x) for x in e]) for i, e in rows if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e)]
    name = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    now = [v for _, v in sorted(kept, key=lambda r: (*name(r[0]), r[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((gap(v, c), j) for j, c in enumerate(now))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(now)):
            if members := [v for (_, v), c in zip(kept, own, strict=True) if c == j]:
                now[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    found = [(i, *nearest(v)) for i, v in kept]
    of = {j: sum(d for _, d, c in found if c == j) for j in range(len(now))}
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in now]
    return sorted(((i, c, d, of[c], sum(of.values()), told[c]) for i, d, c in found), key=repr)


def run(spark, rows, **how):
    frame = spark.createDataFrame([(i, e, 1, 2, "x") for i, e in rows], SCHEMA)
    found = centroids.cluster(frame, **how)
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def clumps(n, width, seed):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(9, width))
    return [(int(i), [float(x) for x in centers[rng.integers(9)] + rng.normal(scale=0.2, size=width)]) for i in rng.permutation(n)]


@pytest.mark.parametrize(("k", "rounds"), [(1, 2), (2, 3), (7, 4), (24, 6), (40, 5)])
def test_same_as_plain(spark, k, rounds):
    rows = clumps(300, 5, k)
    assert run(spark, rows, k=k, rounds=rounds, width=5, factor=16) == brute(rows, k, rounds, 5, 16)


def test_edges(spark):
    """Ties between centroids on a small grid, copies, null ids, rows that take no part."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(120)]
    rows += [rows[0]] * 60 + [(7, [0.5, -0.5, 1.5]), (None, [1.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(500, None), (501, []), (502, [1.0, None, 1.0]), (503, [1.0, float("nan"), 1.0]), (504, [float("inf"), 0.0, 0.0]), (505, [1.0, 2.0])]
    assert run(spark, rows, k=12, rounds=4, width=3, factor=1) == brute(rows, 12, 4, 3, 1)
    assert run(spark, rows[:3], k=12, rounds=2, width=3, factor=1) == brute(rows[:3], 12, 2, 3, 1)
    nameless = [(None, [float(i), 0.0, 1.0]) for i in range(6)] + rows[:2]
    assert run(spark, nameless, k=4, rounds=2, width=3, factor=1) == brute(nameless, 4, 2, 3, 1)
    assert run(spark, [], k=12, rounds=2, width=3, factor=1) == []
    assert run(spark, [(1, [1.0])], k=12, rounds=2, width=3, factor=1) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float((i * 37) % 11 * 10**8 + i), float(-(i % 7) * 10**8)]) for i in range(60)]
    assert run(spark, rows, k=5, rounds=3, width=2, factor=1) == brute(rows, 5, 3, 2, 1)
    with pytest.raises(Exception, match="64 bits"):
        run(spark, [(1, [1e18, 0.0]), (2, [-1e18, 0.0]), (3, [1e18, 5.0])], k=1, rounds=1, width=2, factor=1)


def test_bounds_spare_distances():
    """After some rounds most vectors keep their centroid unseen, and few are measured against all."""
    rows = clumps(3000, 8, 1)
    x = np.array([[math.floor(64 * c) for c in e] for _, e in rows], float)
    now = x[:24].copy()
    found, moved, full = centroids.Bounds.none(x, 6), np.zeros(24), []
    for _ in range(12):
        found.full = 0
        found.assign(now, moved)
        full.append(found.full)
        want = centroids.squared(x, now)
        assert (found.near[:, 0] == want.argmin(1)).all()
        own = found.near[:, 0]
        after = np.array([np.floor(x[own == j].mean(0)) if (own == j).any() else now[j] for j in range(24)])
        moved, now = np.sqrt(((after - now) ** 2).sum(1)), after
        assert (np.sqrt(want.min(1)) <= found.up * (1 + 1e-9) + 1e-9).all()
    assert full[0] == 3000 and full[-1] < 300
    less = found.narrowed(3)
    assert less.near.shape == (3000, 4) and less.low.shape == (3000, 4)
    less.assign(now, moved)
    assert (less.near[:, 0] == centroids.squared(x, now).argmin(1)).all()
