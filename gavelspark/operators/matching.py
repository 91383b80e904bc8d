"""Matching characters of many pairs of texts at once, as difflib counts them: the
longest run that both have, the first of equal ones, then the same on either side of it."""

from __future__ import annotations

import difflib

import numpy as np

#: Cells (characters of one text by those of the other) that are filled in at once, and in which one pair is left to difflib.
CELLS, LONG = 1 << 22, 1 << 20


def ratios(texts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """difflib's ratio (without junk) of texts[i] and texts[j] for arrays of places."""
    size = np.array([len(t) for t in texts], np.int64)
    both = size[i] + size[j]
    return np.where(both > 0, 2.0 * matching(texts, i, j) / np.maximum(both, 1), 1.0)


def matching(texts: list[str], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Matching characters of texts[i] and texts[j]. All pairs go on together: a
    level takes the longest run of each part that is open."""
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size) - size
    letters, flat = np.unique(np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), return_inverse=True)
    flat = np.append(flat + 1, 0).astype(np.min_scalar_type(len(letters) + 2))  # 0 and the last number are no letters
    total, long = np.zeros(len(i), np.int64), size[i] * size[j] > LONG
    match = difflib.SequenceMatcher(autojunk=False)
    for at in np.flatnonzero(long):
        match.set_seqs(texts[i[at]], texts[j[at]])
        total[at] = sum(block.size for block in match.get_matching_blocks())
    own = np.flatnonzero(~long & (size[i] > 0) & (size[j] > 0))
    open_ = np.stack([start[i[own]], size[i[own]], start[j[own]], size[j[own]], own])
    while open_.shape[1]:
        widest = np.maximum(open_[1], open_[3])
        order = np.argsort(widest, kind="stable")
        open_, widest, low, parts = open_[:, order], widest[order], 0, []
        while low < len(widest):
            high = min(low + max(1, CELLS // int(widest[low]) ** 2), len(widest))
            high = min(high, low + max(1, CELLS // int(widest[high - 1]) ** 2))
            parts.append(_longest_runs(flat, open_[:, low:high], total))
            low = high
        open_ = np.concatenate(parts, axis=1)
    return total


def _longest_runs(flat: np.ndarray, open_: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Adds the length of each part's longest run to its pair's total; what is on
    both sides of the runs. A part: start and size in one text, in the other, pair."""
    s, n, t, m, pair = open_
    each = np.arange(len(pair))

    def cut(at: np.ndarray, size: np.ndarray, past: int) -> np.ndarray:
        row = np.arange(int(size.max()))[:, None]
        return np.where(row < size, flat[np.minimum(at + row, len(flat) - 1)], flat.dtype.type(past))

    a, b = cut(s, n, np.iinfo(flat.dtype).max), cut(t, m, 0)
    runs = np.zeros((len(a), len(b) + 1, len(pair)), np.uint8 if min(len(a), len(b)) < 255 else np.int32)  # that end here
    longest, before = np.empty((len(a), len(pair)), runs.dtype), np.zeros(runs.shape[1:], runs.dtype)
    for at, letter in enumerate(a):
        here = runs[at, 1:]
        np.add(before[:-1], 1, out=here)
        here *= b == letter
        np.max(here, axis=0, out=longest[at])
        before = runs[at]
    x = longest.argmax(axis=0)
    k = longest[x, each].astype(np.int64)
    y = runs[x, :, each].argmax(axis=1) - 1
    np.add.at(total, pair, k)
    left = np.stack([s, x - k + 1, t, y - k + 1, pair])
    right = np.stack([s + x + 1, n - x - 1, t + y + 1, m - y - 1, pair])
    return np.concatenate([side[:, (k > 0) & (side[1] > 0) & (side[3] > 0)] for side in (left, right)], axis=1)
