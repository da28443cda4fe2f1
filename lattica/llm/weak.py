"""Weak supervision: labelers vote or abstain, expectation-maximisation estimates how far to trust each."""

from __future__ import annotations

import numpy as np

#: Bounds of a labeler's accuracy (at one half it says nothing), and the belief it starts from with the weight of so
#: many votes.
LEAST, MOST, START, START_VOTES = 0.5, 0.995, 0.85, 20.0


def encode(votes: np.ndarray) -> np.ndarray:
    """One number for each row of votes in {-1, 0, 1}: digits of base 3."""
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


def decode(pattern: np.ndarray, n: int) -> np.ndarray:
    return (np.asarray(pattern, np.int64)[:, None] // 3 ** np.arange(n, dtype=np.int64)) % 3 - 1


def fit(votes: np.ndarray, counts: np.ndarray, prior: float = 0.5, rounds: int = 100) -> np.ndarray:
    """Accuracies from distinct vote rows and how often each occurs.

    An abstention says nothing, and a lone vote cannot tell how good its labeler is, so only rows with two
    votes or more count; a labeler that never meets another keeps the starting belief. ``prior``, the share
    of positives, is given, as otherwise a large class would outvote every lone accusation. The input has at
    most 3**labelers rows, whatever the size of the corpus.
    """
    accuracy = np.full(votes.shape[1], START)
    met = (votes != 0).sum(1) >= 2
    votes, counts = votes[met], np.asarray(counts, float)[met][:, None]
    total = ((votes != 0) * counts).sum(0) + START_VOTES
    for _ in range(rounds):
        p = posterior(votes, accuracy, prior)[:, None]
        right = ((votes > 0) * p + (votes < 0) * (1 - p)) * counts
        new, before = np.clip((right.sum(0) + START * START_VOTES) / total, LEAST, MOST), accuracy
        accuracy = new
        if np.abs(new - before).max() < 1e-7:
            break
    return accuracy


def posterior(votes: np.ndarray, accuracy: np.ndarray, prior: float = 0.5) -> np.ndarray:
    """Probability that the truth is positive for each row of votes."""
    odds = votes @ np.log(accuracy / (1 - accuracy)) + np.log(prior / (1 - prior))
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
