"""Hard negatives against brute force: many tiles, ties, repeated rows, odd rows; the tree and its bounds alone."""

from __future__ import annotations

import random

import numpy as np
import pytest

from barloom.llm import hardneg as hn

from .frames import frame

ROWS = "vec_id long, embedding array<double>, label int"


def plain(rows, step=hn.ANCHOR_STEP):
    usable = set()
    for vec_id, e, label in rows:
        if vec_id is not None and label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e):
            q = tuple(int(np.floor(256 * x)) for x in e)
            if sum(x * x for x in q) < 2**62:
                usable.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, q))
    out = []
    for a, label, q in usable:
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, e)), i, k) for i, k, e in usable if i != a and len(e) == len(q))
        for s, p, _ in [r for r in scored if r[2] == label][:5]:
            hard = [(i, n) for n, i, k in scored if k != label and 50 * -s <= 100 * -n <= 95 * -s][:3]
            out += [(a, p, r + 1, i, -s, -n) for r, (i, n) in enumerate(hard)]
    return sorted(out)


def check(spark, rows, **how):
    got = hn.mine(frame(spark, rows, ROWS).repartition(3), **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = plain(rows, how.get("step", hn.ANCHOR_STEP))
    assert sorted(map(tuple, got.collect())) == want
    return want


def test_many_tiles(spark):
    rng = random.Random(2)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(centres)], rng.randrange(4)) for i in range(400)]
    assert check(spark, rows, step=10, tile=40)


def test_ties_and_crowded_tiles(spark):
    rng = random.Random(4)
    rows = [(i, [1.0, 0.5, float(rng.choice([0, 0, 0, 1]))], rng.randrange(2)) for i in range(200)] + [(i, [0.8, 0.5, 0.1], 3) for i in range(200, 240)]
    assert check(spark, rows, step=10, tile=20)


def test_odd_rows(spark):
    rng = random.Random(5)
    vector = lambda n=6: [rng.gauss(0.3, 0.5) for _ in range(n)]
    rows = [(i, vector(), i % 3) for i in range(120)]
    rows += [(200, None, 1), (250, [], 1), (251, [], 1), (252, [], 2), (300, [0.1, None], 1), (350, [float("nan")] * 6, 1), (400, [float("inf")] + [0.0] * 5, 1),
             (450, vector(), None), (None, vector(), 1), (500, vector(7), 1), (501, vector(7), 1), (502, vector(7), 2), rows[50], rows[3], rows[3],
             (100, vector(), 1), (550, [-1.0] * 6, 2), (600, [0.0] * 6, 0), (601, [1e200] * 6, 0), (650, [3e5] * 6, 0), (651, [2e5] * 6, 0), (652, [1.5e5] * 6, 1)]
    assert check(spark, rows)


@pytest.mark.parametrize("rows", [[], [(0, [1.0], 1)], [(0, [1.0], 1), (1, [1.0], 1)], [(None, None, None)]])
def test_empty_and_alone(spark, rows):
    assert check(spark, rows) == []


def test_tree(monkeypatch):
    monkeypatch.setattr(hn, "LEAF", 16)
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.integers(-50, 50, (30, 5)) + c for c in rng.integers(-900, 900, (40, 5))]).astype(np.int32)
    label = rng.integers(0, 3, len(x))
    tree = hn.Tree(np.arange(len(x)), label, x)
    leaves = 0
    known = tree.scores

    def counted(leaf, q):
        nonlocal leaves
        leaves += 1
        return known(leaf, q)

    tree.scores = counted
    for i in range(0, len(x), 37):
        q = x[i].astype(np.int64)
        scores = x.astype(np.int64) @ q
        low, high = int(np.quantile(scores, 0.7)), int(np.quantile(scores, 0.9))
        for same, window in ((True, (hn.LEAST, hn.MOST)), (False, (low, high))):
            [got] = tree.search(i, label[i], q, [window], 4, same)
            fits = [j for j in range(len(x)) if j != i and (label[j] == label[i]) == same and window[0] <= scores[j] <= window[1]]
            assert got == sorted((-int(scores[j]), j) for j in fits)[:4]
        least, most = hn.interval(tree.low, tree.high, q.astype(float))
        for leaf, start in enumerate(tree.starts):
            s = tree.x[start:start + 16].astype(np.int64) @ q
            assert least[leaf] <= s.min() and s.max() <= most[leaf]
    assert leaves < 0.4 * 2 * len(range(0, len(x), 37)) * len(tree.starts)  # most boxes are pruned
