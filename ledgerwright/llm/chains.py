"""Viterbi decoding of many label chains at once, in numpy."""

from __future__ import annotations

import numpy as np


def viterbi(emit: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best labels of the chains that begin where ``first`` is true.

    emit: (n, labels) scores; trans: (labels, labels) finite scores from one label to the next.
    A position whose best label leads by more than twice the spread of ``trans`` has that label on every best
    path, since changing it there costs at most two transitions. Such positions cut the chains exactly; only the
    runs between them are decoded, all runs of a length side by side.
    """
    n, k = emit.shape
    small = np.uint8 if k <= 256 else np.uint32
    if not n:
        return np.zeros(0, small)
    labels = emit.argmax(1).astype(small)
    if k == 1:
        return labels
    top = np.partition(emit, k - 2, axis=1)[:, k - 2 :]
    open_ = np.flatnonzero(top[:, 1] - top[:, 0] <= 2 * (trans.max() - trans.min()))
    if not len(open_):
        return labels
    begins = np.ones(len(open_), bool)
    begins[1:] = (np.diff(open_) > 1) | first[open_[1:]]
    start = open_[begins]
    length = np.diff(np.append(np.flatnonzero(begins), len(open_)))
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    end = start + length
    inside = np.flatnonzero(~first[start])
    score = emit[start].astype(np.float32)
    score[inside] += trans[labels[start[inside] - 1]]
    active = len(start) - np.searchsorted(length[::-1], np.arange(length[0]), side="right")  # runs longer than t
    back = [None]
    for t in range(1, length[0]):
        m = active[t]
        through = score[:m, :, None] + trans
        best = through.argmax(1).astype(small)
        score[:m] = np.take_along_axis(through, best[:, None, :].astype(np.intp), 1)[:, 0] + emit[start[:m] + t]
        back.append(best)
    follows = np.flatnonzero((end < n) & ~first[np.minimum(end, n - 1)])
    score[follows] += trans[:, labels[end[follows]]].T
    now = score.argmax(1).astype(small)
    rows = np.arange(len(start))
    for t in range(length[0] - 1, -1, -1):
        m = active[t]
        labels[start[:m] + t] = now[:m]
        if t:
            now[:m] = back[t][rows[:m], now[:m]]
    return labels
