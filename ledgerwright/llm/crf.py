"""Conditional random fields in numpy: fitting a linear chain, fitting by pseudo-likelihood, and loopy message passing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


@dataclass
class Field:
    """tables: one (values, labels) weight table for each feature; trans: (labels, labels); skip: weights between linked tokens."""

    tables: list[np.ndarray]
    trans: np.ndarray
    skip: np.ndarray | None = None

    def emit(self, features: list[np.ndarray]) -> np.ndarray:
        out = self.tables[0][features[0]]
        for table, values in zip(self.tables[1:], features[1:], strict=True):
            out = out + table[values]
        return out


def fit_chain(features: np.ndarray, labels: np.ndarray, sizes: list[int], n_labels: int, rounds: int = 60, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Maximum likelihood of a linear chain over windows of one length, by Adagrad with forward and backward sums.

    features: (windows, length, features); labels: (windows, length).
    """
    n, length, _ = features.shape
    field = Field([np.zeros((s, n_labels)) for s in sizes], np.zeros((n_labels, n_labels)))
    square = [np.full_like(t, 1e-6) for t in [*field.tables, field.trans]]
    truth = np.eye(n_labels)[labels]
    pair_truth = np.einsum("wta,wtb->ab", truth[:, :-1], truth[:, 1:])
    flat = features.reshape(n * length, -1)
    for _ in range(rounds):
        emit = field.emit(list(flat.T)).reshape(n, length, n_labels)
        ahead, behind = emit.copy(), np.zeros_like(emit)
        for t in range(1, length):
            ahead[:, t] += log_sum(ahead[:, t - 1, :, None] + field.trans, 1)
        for t in range(length - 2, -1, -1):
            behind[:, t] = log_sum(field.trans + (emit[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
        total = log_sum(ahead[:, -1], 1)
        share = np.exp(ahead + behind - total[:, None, None])
        pairs = np.exp(ahead[:, :-1, :, None] + field.trans + (emit[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]).sum((0, 1))
        error = (truth - share).reshape(n * length, n_labels)
        for table, values, seen in zip(field.tables, flat.T, square, strict=False):
            slope = np.stack([np.bincount(values, error[:, k], len(table)) for k in range(n_labels)], 1) / n - decay * table
            seen += slope**2
            table += rate * slope / np.sqrt(seen)
        slope = (pair_truth - pairs) / n - decay * field.trans
        square[-1] += slope**2
        field.trans += rate * slope / np.sqrt(square[-1])
    return field


def fit_pseudo(features: np.ndarray, labels: np.ndarray, chain: np.ndarray, skip: np.ndarray, sizes: list[int], n_labels: int, rounds: int = 80, rate: float = 0.5, decay: float = 1e-3) -> Field:
    """Pseudo-likelihood of a field with ``chain`` and ``skip`` edges, (edges, 2) each: every token given its neighbours' labels."""
    field = Field([np.zeros((s, n_labels)) for s in sizes], np.zeros((n_labels, n_labels)), np.zeros((n_labels, n_labels)))
    n = len(labels)
    square = [np.full_like(t, 1e-6) for t in [*field.tables, field.trans, field.skip]]
    truth = np.eye(n_labels)[labels]
    context = []
    for edges in (chain, skip):
        before, after = np.zeros((n, n_labels)), np.zeros((n, n_labels))
        np.add.at(before, edges[:, 1], truth[edges[:, 0]])
        np.add.at(after, edges[:, 0], truth[edges[:, 1]])
        context.append((before, after))
    for _ in range(rounds):
        score = field.emit(list(features.T)) + context[0][0] @ field.trans + context[0][1] @ field.trans.T + (context[1][0] + context[1][1]) @ field.skip
        share = np.exp(score - log_sum(score, 1)[:, None])
        error = truth - share
        slopes = [np.stack([np.bincount(values, error[:, k], len(table)) for k in range(n_labels)], 1) for table, values in zip(field.tables, features.T, strict=True)]
        slopes.append(context[0][0].T @ error + error.T @ context[0][1])
        both = (context[1][0] + context[1][1]).T @ error
        slopes.append((both + both.T) / 2)
        for table, slope, seen in zip([*field.tables, field.trans, field.skip], slopes, square, strict=True):
            slope = slope / n - decay * table
            seen += slope**2
            table += rate * slope / np.sqrt(seen)
    return field


def beliefs(emit: np.ndarray, edges: list[tuple[np.ndarray, np.ndarray]], rounds: int = 12, damping: float = 0.3) -> np.ndarray:
    """Marginals by loopy sum-product. edges: pairs of an (m, 2) array and the (labels, labels) weights between its ends."""
    n, k = emit.shape
    ends = [(e[:, 0], e[:, 1], w) for e, w in edges if len(e)] + [(e[:, 1], e[:, 0], w.T) for e, w in edges if len(e)]
    if not n or not ends:
        return np.exp(emit - log_sum(emit, 1)[:, None]) if n else emit
    source = np.concatenate([s for s, _, _ in ends])
    target = np.concatenate([t for _, t, _ in ends])
    half = len(source) // 2
    opposite = np.concatenate((np.arange(half) + half, np.arange(half)))
    message = np.zeros((len(source), k))
    cuts = np.cumsum([0, *[len(s) for s, _, _ in ends]])
    for _ in range(rounds):
        total = emit + np.stack([np.bincount(target, message[:, x], n) for x in range(k)], 1)
        out = total[source] - message[opposite]
        new = np.concatenate([log_sum(out[a:b, :, None] + w, 1) for (a, b), (_, _, w) in zip(zip(cuts[:-1], cuts[1:], strict=True), ends, strict=True)])
        new -= log_sum(new, 1)[:, None]
        message = damping * message + (1 - damping) * new
    total = emit + np.stack([np.bincount(target, message[:, x], n) for x in range(k)], 1)
    return np.exp(total - log_sum(total, 1)[:, None])
