"""Substring dedup against brute force: planted passages, copies, branches, periodic texts, odd rows; rows past 64-bit chunk limits."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from barloom.llm import substrings as sub

from .frames import DOCS, edited, frame, odd_rows, prose

LAST = float("inf")


def plain(rows, width=sub.WIDTH):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    least: dict = {}
    for r, w in zip(rows, words):
        for p in range(len(w) - width + 1):
            k = tuple(w[p:p + width])
            least[k] = min(least.get(k, LAST), LAST if r[0] is None else r[0])
    out = []
    for r, w in zip(rows, words):
        gone: set = set()
        for p in range(len(w) - width + 1):
            if least[tuple(w[p:p + width])] < (LAST if r[0] is None else r[0]):
                gone.update(range(p, p + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(spark, rows):
    got = sub.dedup(frame(spark, rows, DOCS).repartition(5))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def docs(texts):
    return [(i, t, "en", "a", 0) for i, t in texts]


def test_odd_rows(spark):
    check(spark, odd_rows() + docs([(20, " ".join(prose(1, 60).split())), (21, prose(1, 60)), (22, prose(1, 60).replace(" ", " \n\x0b")), (None, prose(1, 40)),
                                    (20, prose(9, 30)), (20, prose(9, 30)), (7, prose(9, 40)), (30, " ".join(["a"] * 40)), (31, " ".join(["a"] * 20)), (32, "a b " * 30)]))


@pytest.mark.parametrize("seed", [1, 2])
def test_planted_passages(spark, seed):
    rng = random.Random(seed)
    common = [prose(100 + i, rng.choice([12, 13, 14, 40, 120])) for i in range(6)]
    texts = []
    for i in range(60):
        parts = []
        for j in range(rng.randint(1, 4)):
            parts.append(prose(1000 * seed + 10 * i + j, rng.randint(0, 60)))
            c = rng.choice(common).split()
            a, b = sorted(rng.choices(range(len(c) + 1), k=2))
            parts.append(" ".join(c if rng.random() < 0.5 else c[a:b]))
        texts.append((rng.randrange(1000), " ".join(parts)))
    texts += [(1000 + i, edited(texts[i][1], i, 0.03)) for i in range(20)] + [(2000 + i, texts[i][1]) for i in range(20)]
    rng.shuffle(texts)
    check(spark, docs(texts))


def test_few_words_branch_and_repeat(spark):
    rng = random.Random(8)
    check(spark, docs([(i, " ".join(rng.choice("ab") for _ in range(rng.randint(10, 80)))) for i in range(80)]))


def test_small_chunks(spark, monkeypatch):
    monkeypatch.setattr(sub, "CHUNK", 50)
    base = prose(3, 50)
    check(spark, docs([(i, prose(200 + i, i % 7) + " " + base + " " + prose(300 + i, i % 5)) for i in range(60, 0, -1)]))


def test_empty(spark):
    assert sub.dedup(frame(spark, [], DOCS)).count() == 0
    check(spark, docs([(1, None), (2, ""), (3, "one two")]))


def test_paths_compact(spark):
    """A passage of 40 words in three documents is one path; only its two ends are joined back."""
    edges = spark.createDataFrame(
        [(p, p, 1, 1, p, True) for p in range(10, 38)] + [(100 + p, p, 1, 1, p, p != 61) for p in range(60, 64)] + [(200, 1, 2, 1, 10, True)],
        "e1 long, e2 long, src long, src_t long, p int, plain boolean")
    got = sorted(tuple(r)[2:] for r in sub.paths(edges).collect())
    assert got == [(1, 1, 10, 28, 0), (1, 1, 10, 28, 27), (1, 1, 60, 1, 0), (1, 1, 61, 1, 0), (1, 1, 62, 2, 0), (1, 1, 62, 2, 1), (2, 1, 10, 1, 0)]
