"""Centroid clustering against a plain integer k-means, odd rows, and that the filter rules centroids out."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from barloom.llm import clusters as cl

from .frames import frame

ROWS = "vec_id long, embedding array<float>, label int"


def plain(rows, k=cl.K, rounds=cl.ROUNDS, length=cl.LENGTH, scale=cl.SCALE):
    kept = []
    for vec_id, e, _ in rows:
        if e is not None and len(e) == length and all(x is not None and np.isfinite(x) for x in e):
            kept.append((vec_id, [int(np.floor(scale * np.float64(np.float32(x)))) for x in e]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest()))
    centres = [list(v) for _, v in order[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        groups: dict = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        for i, members in groups.items():
            centres[i] = [sum(c) // len(members) for c in zip(*members)]
    return centres, [(vec_id, *near(v)[::-1]) for vec_id, v in kept]


def check(spark, rows, **how):
    got = cl.clusters(frame(spark, rows, ROWS), **how).collect()
    centres, want = plain(rows, **how)
    assert sorted(map(str, ((r["vec_id"], r["cluster"], r["distance"]) for r in got))) == sorted(map(str, want))
    inertia: dict = {}
    for _, i, d in want:
        inertia[i] = inertia.get(i, 0) + d
    for r in got:
        assert r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_odd_rows(spark):
    rng = random.Random(3)
    vector = lambda: [rng.gauss(0, 0.2) for _ in range(64)]
    rows = [(i, vector(), i % 3) for i in range(60)]
    rows += [(60, None, 1), (61, [], 1), (62, [0.1] * 63, 1), (63, [0.1] * 63 + [None], 1), (64, [0.1] * 63 + [float("nan")], 1),
             (65, [float("inf")] + [0.0] * 63, None), (66, [0.0] * 64, None), (None, vector(), None), rows[5], rows[5], (67, rows[5][1], 2), (68, rows[7][1], 0)]
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 5, 8])
def test_fewer_vectors_than_centroids(spark, n):
    check(spark, [(i, [float(i == j) for j in range(64)], 0) for i in range(n)])


def test_ties_and_equal_vectors(spark):
    rows = [(i, [float(i % 2)] + [0.0] * 63, 0) for i in range(40)]
    check(spark, rows)
    check(spark, [(i, [0.5] * 64, 0) for i in range(20)])


def test_large_components(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.randint(-3, 4) for _ in range(64)], 0) for i in range(40)]
    check(spark, rows, rounds=3)
    assert cl.clusters(frame(spark, [(1, [1e30] * 64, 0), (2, [0.0] * 64, 0)], ROWS)).count() == 1


def test_empty(spark):
    assert cl.clusters(frame(spark, [], ROWS)).count() == 0
    assert cl.clusters(frame(spark, [(1, None, None)], ROWS)).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_filter_rules_out_far_centroids():
    rng = np.random.default_rng(1)
    centres = rng.integers(-2000, 2000, (8, 64))
    x = centres[rng.integers(0, 8, 500)] + rng.integers(-100, 100, (500, 64))
    axes = np.linalg.eigh(np.cov(x.T))[1][:, ::-1]
    how = cl.Rotated(x.mean(0), axes, cl.LEADING)
    lead, rest = how.of(x.astype(float))
    cluster, distance, measured = cl.nearest(x.astype(np.int32), lead, rest, centres, how)
    every = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert measured == len(x)  # one exact distance a vector, the others ruled out
