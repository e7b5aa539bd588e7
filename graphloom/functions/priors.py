"""The tilt of missing nodes over centrality bins, solved for a target rank correlation; plain numbers, no data."""

from __future__ import annotations

import math

import numpy as np

BETA_BOUND = 50.0


def tilt(beta: float, k: int) -> np.ndarray:
    """Shares of k bins, log-linear in the standardised bin number."""
    z = np.arange(k) - (k - 1) / 2
    z = beta * z / np.sqrt((z * z).mean())
    q = np.exp(z - z.max())
    return q / q.sum()


def expected_rho(beta: float, k: int, n: float, n_missing: float) -> float:
    """Tau-b between bin and missingness if n kept nodes are spread evenly and the missing ones by the tilt."""
    if n_missing == 0:
        return 0.0
    q, bins = tilt(beta, k), np.arange(k)
    up = n / k * n_missing
    concordant, discordant = float(up * (q @ bins)), float(up * (q @ bins[::-1]))
    same_bin = n * n_missing / k
    same_kind = n * n * (k - 1) / (2 * k) + n_missing**2 / 2 * (1 - float(q @ q))
    both = concordant + discordant
    d = (both + same_bin) * (both + same_kind)
    return (concordant - discordant) / math.sqrt(d) if d > 0 else 0.0


def solve_tilt(rho: float, k: int, n: float, n_missing: float, tol: float = 1e-4, rounds: int = 100) -> tuple[float, str]:
    """Beta whose expected correlation is ``rho``, and ``converged`` or, where no tilt reaches it, ``ceiling_hit``."""
    if not -1 < rho < 1 or k < 2:
        raise ValueError("rho must lie in (-1, 1) and there must be two bins or more")
    if abs(rho) <= tol:
        return 0.0, "converged"
    if n_missing == 0:
        return 0.0, "ceiling_hit"
    end = math.copysign(BETA_BOUND, rho)
    if abs(expected_rho(end, k, n, n_missing)) < abs(rho):
        return end, "ceiling_hit"
    lo, hi = min(0.0, end), max(0.0, end)
    for _ in range(rounds):
        beta = (lo + hi) / 2
        got = expected_rho(beta, k, n, n_missing)
        if abs(got - rho) <= tol:
            return beta, "converged"
        lo, hi = (beta, hi) if got < rho else (lo, beta)
    return (lo + hi) / 2, "failed_other"


def tau_b(score: np.ndarray, flag: np.ndarray) -> float:
    """Kendall's tau-b between a score and a yes/no array, from counts by score."""
    _, y = np.unique(score, return_inverse=True)
    m, o = np.bincount(y, flag.astype(float)), np.bincount(y, (~flag).astype(float))
    below = np.cumsum(o) - o
    cd = float(m @ (below - (o.sum() - below - o)))
    pairs = lambda x: x * (x - 1) / 2
    n0 = pairs(len(score))
    d = (n0 - pairs(m.sum()) - pairs(o.sum())) * (n0 - float(pairs(m + o).sum()))
    return cd / math.sqrt(d) if d > 0 else 0.0


def weighted_draw(weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k places without replacement in proportion to the weights, by exponential keys."""
    with np.errstate(divide="ignore"):
        keys = np.where(weights > 0, rng.exponential(size=len(weights)) / weights, np.inf)
    k = min(k, int((weights > 0).sum()))
    return np.argpartition(keys, k - 1)[:k] if k > 0 else np.zeros(0, int)
