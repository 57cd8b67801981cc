"""Weak supervision: expectation-maximisation over the votes of overlapping labelers.

A vote is 1, 0 or -1 (no vote).  Rows with the same votes are alike, so the estimation needs
only the counts of vote patterns, at most 3 ** labelers of them, gathered over all rows.
"""

from __future__ import annotations

import numpy as np

ROUNDS = 200


class Reliabilities:
    """Binary labels, votes independent given the label: P(1), and each labeler's P(vote | label)."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, prior: float = 0.5, guess: np.ndarray | None = None, share: tuple[float, float] = (0.0, 1.0)):
        """guess: first posteriors of the patterns (a majority of their votes if None); share: bounds of P(1)."""
        v, n = np.asarray(patterns, np.int64), np.asarray(counts, np.float64)
        if guess is None:
            up, down = (v == 1).sum(axis=1), (v == 0).sum(axis=1)
            guess = (up + 2 * prior) / (up + down + 2)
        q, self.prior = np.asarray(guess, np.float64), prior
        self.p = np.full((2, v.shape[1] if v.ndim == 2 else 0, 3), 1 / 3)
        for _ in range(ROUNDS if len(n) else 0):
            weight = np.stack([n * (1 - q), n * q])
            self.prior = float(np.clip((weight[1].sum() + 1) / (n.sum() + 2), *share))
            for vote in (-1, 0, 1):
                self.p[:, :, vote + 1] = (weight @ (v == vote) + 0.5) / (weight.sum(axis=1, keepdims=True) + 1.5)
            new = self.posterior(v)
            done, q = np.abs(new - q).max() < 1e-9, new
            if done:
                break

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(label is 1 | votes) of each pattern; a missing vote counts as evidence too."""
        v = np.asarray(patterns, np.int64)
        at = np.arange(v.shape[1])
        logs = np.log(self.p)
        up, down = logs[1][at, v + 1].sum(axis=1) + np.log(self.prior), logs[0][at, v + 1].sum(axis=1) + np.log1p(-self.prior)
        return 1 / (1 + np.exp(np.clip(down - up, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """P(vote is right | it votes) of each labeler."""
        right = self.prior * self.p[1, :, 2] + (1 - self.prior) * self.p[0, :, 1]
        wrong = self.prior * self.p[1, :, 1] + (1 - self.prior) * self.p[0, :, 2]
        return right / (right + wrong)


def logistic(rows: list[np.ndarray], targets: np.ndarray, buckets: int, values: list[np.ndarray] | None = None, epochs: int = 8, rate: float = 0.3, decay: float = 1e-5, seed: int = 0) -> np.ndarray:
    """Weights (the last is the bias) of a logistic scorer over hashed features, from soft targets.

    AdaGrad over batches of 64 rows; row i has the features rows[i] with values[i] (1 if None).
    """
    w, g = np.zeros(buckets + 1), np.full(buckets + 1, 1e-6)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            at = np.concatenate([rows[i] for i in part]) if len(part) else np.zeros(0, np.int64)
            lengths = np.array([len(rows[i]) for i in part])
            x = np.ones(len(at)) if values is None else np.concatenate([values[i] for i in part])
            owner = np.repeat(np.arange(len(part)), lengths)
            z = np.bincount(owner, weights=w[at] * x, minlength=len(part)) + w[-1]
            miss = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - targets[part]
            grad = np.bincount(at, weights=miss[owner] * x, minlength=buckets + 1) / len(part)
            grad[-1] = miss.mean()
            used = np.flatnonzero(grad)
            grad[used] += decay * w[used]
            g[used] += grad[used] ** 2
            w[used] -= rate * grad[used] / np.sqrt(g[used])
    return w
