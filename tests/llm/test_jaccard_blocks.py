"""The near-duplicate join where buckets take several blocks and nodes several salts."""

import random

import numpy as np
import pytest

from tapeloom.llm import jaccard_join
from tests.llm.test_llm import brute_components, prose, word_sets


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_blocks_and_salts_lose_no_link(spark, monkeypatch, k, percent):
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "HUB_PAIRS", 3)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 5)
    r = random.Random(11)
    rows = []
    for g in range(3):
        base = prose(r, 200).split()
        for _ in range(30):  # links, near misses, and others that share a half
            w = base[: r.choice((100, 200, 200))]
            for _ in range(r.randint(0, 6)):
                w[r.randrange(len(w))] = prose(r, 1)
            rows.append((len(rows), " ".join(w)))
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k=k, percent=percent).collect()
    want = brute_components(word_sets(rows, k), percent)
    assert len(set(want.values())) < len(rows) - 10
    assert {x["doc_id"]: x["component_id"] for x in found} == want


def test_distances_of_folded_sketches():
    rng = np.random.default_rng(2)
    size = np.array([5, 40, 300, 3000, 2900, 45])
    x = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in size]
    x[4][:2000], x[5][:30] = x[3][:2000], x[1][:30]
    width = jaccard_join.sketch_words(size, 80)
    flat = jaccard_join.flat_sketch(np.concatenate(x), np.repeat(np.arange(6), size), width)
    side = (flat, np.cumsum(width) - width, width)
    p, q = map(np.ravel, np.meshgrid(np.arange(6), np.arange(6)))
    d = jaccard_join._distances(side, side, p, q)
    for i, j, got in zip(p.tolist(), q.tolist(), d.tolist(), strict=True):
        w = int(min(width[i], width[j]))
        odd = [np.bincount((s % np.uint64(64 * w)).astype(np.int64), minlength=64 * w) % 2 for s in (x[i], x[j])]
        assert got == int((odd[0] != odd[1]).sum()) <= len(np.setxor1d(x[i], x[j]))


def test_forest_spans_with_the_best_edges():
    a, b = np.array([0, 1, 0, 3, 4, 3]), np.array([1, 2, 2, 4, 5, 5])
    assert jaccard_join._forest(a, b, 7).tolist() == [0, 1, 3, 4]
    assert not len(jaccard_join._forest(np.array([2]), np.array([2]), 3))
