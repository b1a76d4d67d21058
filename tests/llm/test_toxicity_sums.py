"""The law of sums of high scores, and its parameters, against simulation."""

import math

import numpy as np

from tapeloom.llm import toxicity


def model(factor=0.2, decay=0.7):
    return toxicity.Lexicon(np.array([1]), np.array([2.0]), -0.5, decay, factor, (1.0, 0.0))


def test_more_passages_tell_more():
    m, n = model(), np.array([200, 200, 200, 200])
    cuts = [[(0, 1, 9.0)], [(0, 1, 9.0), (5, 6, 9.0)], [(0, 1, 9.0), (5, 6, 9.0), (9, 10, 0.1)], []]
    x = m.evidence(cuts, n)
    assert x[0] == m.significance(np.array([9.0]), n[:1])[0] and x[1] > x[0] and x[2] == x[1] and x[3] == 0
    total = 2 * (0.7 * 9 - math.log(0.2 * 200))
    p = math.exp(-total) * total / 2 * 4  # r! (r - 1)! = 2, and twice a factor of two
    assert np.isclose(x[1], max(-math.log10(p), x[0]))
    assert len(m.evidence([], np.zeros(0))) == 0


def test_factor_is_found_again():
    rng, m = np.random.default_rng(4), model(0.03, 0.9)
    size = rng.integers(20, 400, 20_000).astype(float)
    best = (np.log(m.factor * size) - np.log(-np.log(rng.random(len(size))))) / m.decay  # Gumbel
    found = toxicity._factor(best, size, m)
    assert 0.9 < found / m.factor < 1.1
    assert toxicity._factor(np.zeros(0), np.zeros(0), m) == 0.1
