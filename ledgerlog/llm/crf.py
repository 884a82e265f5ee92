"""A linear-chain conditional random field with two labels, in numpy, for many sequences at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    """``emit`` (features x 2) and ``move`` (from x to) are log-potentials."""

    emit: np.ndarray
    move: np.ndarray


def _padded(features: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequences x longest x features) and its mask, from all sequences one after the other."""
    mask = np.arange(lengths.max(initial=0)) < lengths[:, None]
    out = np.zeros((*mask.shape, features.shape[1]))
    out[mask] = features
    return out, mask


def _step(score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Of each row, for each next label, the log of the sum over the two labels before it."""
    return np.logaddexp(score[:, :1] + move[0], score[:, 1:] + move[1])


def fit(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, steps: int = 150, rate: float = 0.1, ridge: float = 1e-3) -> Chain:
    """Maximum of the penalised conditional likelihood by Adam; the gradient by forward-backward."""
    x, mask = _padded(features, lengths)
    y = np.zeros(mask.shape, int)
    y[mask] = labels
    n, longest, width = x.shape
    seen = np.eye(2)[y] * mask[..., None]
    both = mask[:, 1:]
    flat = x.reshape(-1, width).T
    seen_emit = flat @ seen.reshape(-1, 2)
    seen_move = (seen[:, :-1] * both[..., None]).reshape(-1, 2).T @ seen[:, 1:].reshape(-1, 2)
    theta = np.zeros(2 * width + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    total = max(1, int(mask.sum()))
    for step in range(1, steps + 1):
        emit, move = theta[: 2 * width].reshape(width, 2), theta[2 * width :].reshape(2, 2)
        score = x @ emit
        ahead, behind = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        ahead[:, 0] = score[:, 0]
        for t in range(1, longest):
            new = _step(ahead[:, t - 1], move) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = _step(score[:, t + 1] + behind[:, t + 1], move.T)
            behind[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        z = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        one = np.exp(ahead + behind - z[:, None, None]) * mask[..., None]
        two = np.exp(ahead[:, :-1, :, None] + move + (score + behind)[:, 1:, None, :] - z[:, None, None, None]) * both[..., None, None]
        grad = np.concatenate([(seen_emit - flat @ one.reshape(-1, 2)).ravel(), (seen_move - two.sum((0, 1))).ravel()]) / total - ridge * theta
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta = theta + rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Chain(theta[: 2 * width].reshape(width, 2), theta[2 * width :].reshape(2, 2))


def viterbi(chain: Chain, features: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The likeliest labels of all sequences, which lie one after the other in ``features``."""
    labels = np.zeros(len(features), np.int8)
    score = features @ chain.emit
    begin = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    size, begin = lengths[order], begin[order]
    longest = int(size[0]) if len(size) else 0
    alive = np.searchsorted(-size, -np.arange(longest), "left")  # sequences longer than t come first
    if not longest:
        return labels
    best = score[begin[: alive[0]]]
    back = np.zeros((len(features), 2), np.int8)
    for t in range(1, longest):
        k = alive[t]
        into = best[:k, :, None] + chain.move
        back[begin[:k] + t] = into.argmax(1)
        best[:k] = into.max(1) + score[begin[:k] + t]
    now = best.argmax(1).astype(np.int8)
    for t in range(longest - 1, -1, -1):
        k = alive[t]
        at = begin[:k] + t
        labels[at] = now[:k]
        if t:
            now[:k] = back[at, now[:k]]
    return labels
