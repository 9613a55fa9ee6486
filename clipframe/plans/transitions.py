"""Transition matrices of hidden Markov models."""

from __future__ import annotations

import numpy as np


def _spread(n: int, stay: np.ndarray, p: float) -> np.ndarray:
    """p where ``stay`` holds, the rest of each row evenly elsewhere."""
    rest = np.full((n, n), (1.0 - p) / max(n - 1, 1))
    return np.where(stay, p, rest) if n > 1 else np.ones((n, n))


def transition_uniform(n: int) -> np.ndarray:
    return np.full((n, n), 1.0 / n) if n else np.zeros((0, 0))


def transition_loop(n: int, p: float) -> np.ndarray:
    return _spread(n, np.eye(n, dtype=bool), p)


def transition_cycle(n: int, p: float) -> np.ndarray:
    """p from each state to the next one in the round."""
    return _spread(n, np.roll(np.eye(n, dtype=bool), 1, axis=1), p)


def transition_local(n: int, p: float) -> np.ndarray:
    """p to stay, the rest halved between the neighbours; at the ends the missing half stays."""
    m = p * np.eye(n) + (1.0 - p) / 2.0 * (np.eye(n, k=1) + np.eye(n, k=-1))
    for i in {0, n - 1} if n else ():
        m[i, i] += (1.0 - p) / 2.0 if n > 1 else 1.0 - p
    return m
