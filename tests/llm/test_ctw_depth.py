"""The context tree of bytes against one that a plain loop builds, bit by bit."""

import math
from collections import defaultdict

import numpy as np
import pytest

from tapeloom.llm import ctw

TEXTS = ["the theory", "", "xxabcdef then xxabcdeg", "Привет", "при the", None]


def path(before):
    """The contexts of a decision from the root on: three of classes, then the last three bytes to the last DEPTH."""
    b = before[::-1]
    classes = (int(ctw._FINE[b[0]]), int(ctw._FINE[b[1]]), int(ctw._COARSE[b[2]]))
    return [(), classes[:1], classes[:2], classes, *[("bytes", *b[:d]) for d in range(3, ctw.DEPTH + 1)]]


def decisions(text):
    data = [255] * ctw.DEPTH + list((text or "").encode()) + [255]
    for at in range(ctw.DEPTH, len(data)):
        for k in range(8):
            yield path(data[at - ctw.DEPTH : at]), (k, data[at] >> (8 - k)), data[at] >> (7 - k) & 1


def log_kt(z, o):
    return math.lgamma(z + 0.5) + math.lgamma(o + 0.5) - math.lgamma(z + o + 1) - math.log(math.pi)


def loop_scores(train, texts):
    counts, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for t in train:
        for contexts, node, bit in decisions(t):
            for i, c in enumerate(contexts):
                counts[i, c, node][bit] += 1
                if i:
                    children[i - 1, contexts[i - 1], node].add((i, c, node))
    last, block = 3 + ctw.DEPTH - 2, {}

    def log_all(x):
        if x not in block:
            own = log_kt(*counts[x])
            block[x] = own if x[0] == last else np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(map(log_all, children[x])))
        return block[x]

    out = []
    for t in texts:
        total = 0.0
        for contexts, node, bit in decisions(t):
            p, rest = 0.0, 1.0
            for i, c in enumerate(contexts):
                z, o = counts.get((i, c, node), (0, 0))
                w = 1.0 if i == last else math.exp(math.log(0.5) + log_kt(z, o) - log_all((i, c, node)))
                p, rest = p + rest * w * ((o if bit else z) + 0.5) / (z + o + 1), rest * (1 - w)
            total += math.log10(p)
        out.append(total)
    return out


@pytest.mark.parametrize("hot", [ctw.HOT_CONTEXTS, 10, 0])
def test_scores_mix_all_depths_of_bytes(spark, monkeypatch, hot):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    train = [TEXTS[i] for i in (0, 2, 3)] * 4
    got = {r["doc_id"]: r["score"] for r in ctw.score(df, spark.createDataFrame(list(enumerate(train)), "doc_id long, text string"), hot_contexts=hot).collect()}
    assert [got[i] for i in range(len(TEXTS))] == pytest.approx(loop_scores(train, TEXTS), rel=1e-5)


def test_bytes_beyond_the_third_and_single_characters_tell(spark):
    train = spark.createDataFrame([(i, t) for i, t in enumerate(["k123z", "m123q"] * 50)], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in ctw.score(spark.createDataFrame([(0, "k123z"), (1, "k123q")], "doc_id long, text string"), train).collect()}
    assert got[0] > got[1] + 1
