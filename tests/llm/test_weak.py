import numpy as np
import pytest

from lattica.llm import weak


def cast(rnd, accuracy, spoken, n, prior=0.5):
    truth = np.where(rnd.random(n) < prior, 1, -1)
    right = rnd.random((n, len(accuracy))) < accuracy
    return truth, np.where(rnd.random((n, len(accuracy))) < spoken, np.where(right, truth[:, None], -truth[:, None]), 0)


def test_planted_accuracies_are_recovered():
    accuracy = np.array([0.95, 0.9, 0.8, 0.7, 0.6])
    truth, votes = cast(np.random.default_rng(4), accuracy, np.array([0.9, 0.5, 0.9, 0.8, 0.9]), 40_000)
    pattern, counts = np.unique(weak.encode(votes), return_counts=True)
    rows = weak.decode(pattern, 5)
    got = weak.fit(rows, counts)
    assert got == pytest.approx(accuracy, abs=0.03)
    assert (weak.fit(rows[::-1], counts[::-1]) == pytest.approx(got))
    # the posterior is Bayes' rule, and as often right as it says
    p = weak.posterior(votes, got)
    one = votes[0]
    likely = np.prod([[a if v == y else 1 - a for v, a in zip(one, got) if v] for y in (1, -1)], axis=1)
    assert p[0] == pytest.approx(likely[0] / likely.sum())
    for low in (0.5, 0.7, 0.9):
        near = (p >= low) & (p < low + 0.1)
        assert (truth[near] > 0).mean() == pytest.approx(p[near].mean(), abs=0.03)


def test_bounds_and_lone_votes():
    assert weak.fit(np.array([[1, 0], [0, -1]]), [100, 100]) == pytest.approx([weak.START] * 2)
    assert weak.fit(np.zeros((0, 3)), []) == pytest.approx([weak.START] * 3)
    rnd = np.random.default_rng(1)
    _, votes = cast(rnd, np.array([0.99, 0.99, 0.5]), np.ones(3), 20_000)
    pattern, counts = np.unique(weak.encode(votes), return_counts=True)
    got = weak.fit(weak.decode(pattern, 3), counts)
    assert got[2] == pytest.approx(0.5, abs=0.02) and (got >= weak.LEAST).all() and (got <= weak.MOST).all()
    assert weak.posterior(np.zeros((1, 3)), got)[0] == 0.5


def test_patterns_round_trip():
    votes = np.array([[1, 0, -1, 1], [-1, -1, -1, -1], [0, 0, 0, 0]])
    assert (weak.decode(weak.encode(votes), 4) == votes).all()
