"""Smith-Waterman local alignment of many word sequences at once, over anti-diagonals."""

from __future__ import annotations

import numpy as np

MATCH, MISMATCH, GAP = 2, -1, -1
CELLS = 1 << 16  # cells of one anti-diagonal over all pairs of a batch
PADDED = 1 << 20  # words of all padded sequences of a batch


def smith_waterman(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each pair (a, b) of hash sequences: score, equal words, and the aligned range of b (start, end). Empty ones give zeros."""
    out = np.zeros((len(pairs), 4), np.int64)
    todo = [i for i, (a, b) in enumerate(pairs) if len(a) and len(b)]
    todo.sort(key=lambda i: (len(pairs[i][0]), len(pairs[i][1])))
    at = 0
    while at < len(todo):
        take, longest = [todo[at]], len(pairs[todo[at]][1])
        while at + len(take) < len(todo):
            a, b = pairs[todo[at + len(take)]]
            if (len(take) + 1) * (len(a) + 1) > CELLS or (len(take) + 1) * (max(longest, len(b)) + 2 * len(a)) > PADDED:
                break
            take.append(todo[at + len(take)])
            longest = max(longest, len(b))
        out[take] = _batch([pairs[i] for i in take])
        at += len(take)
    return out


def _batch(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    n, la, lb = len(pairs), max(len(a) for a, _ in pairs), max(len(b) for _, b in pairs)
    a, b = np.zeros((n, la), np.uint64), np.zeros((n, lb + 2 * la), np.uint64)
    has_a, has_b = np.zeros((n, la), bool), np.zeros((n, lb + 2 * la), bool)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)], has_a[i, : len(x)] = x, True
        end = la + lb  # b is stored backwards, so that a diagonal is a slice
        b[i, end - len(y) : end], has_b[i, end - len(y) : end] = y[::-1], True
    shape = (n, la + 1)
    older, old = (tuple(np.zeros(shape, np.int32) for _ in range(3)) for _ in range(2))  # score, equal words, start in b
    best = np.zeros((n, 4), np.int64)
    rows = np.arange(n)
    for d in range(2, la + lb + 1):
        j = d - np.arange(1, la + 1)  # column of each row i = 1 .. la, from 1
        cut = slice(la + lb - (d - 1), la + lb - (d - 1) + la)
        real = has_a & has_b[:, cut]
        equal = real & (a == b[:, cut])
        fresh = older[0][:, :-1] == 0
        diagonal = older[0][:, :-1] + np.where(equal, MATCH, MISMATCH)
        up, left = old[0][:, :-1] + GAP, old[0][:, 1:] + GAP
        score = np.maximum(np.maximum(diagonal, np.maximum(up, left)), 0)
        score[~real] = 0
        by_diagonal, by_up = score == diagonal, score == up
        count = np.where(by_diagonal, older[1][:, :-1] + equal, np.where(by_up, old[1][:, :-1], old[1][:, 1:]))
        start = np.where(by_diagonal, np.where(fresh, j - 1, older[2][:, :-1]), np.where(by_up, old[2][:, :-1], old[2][:, 1:]))
        now = tuple(np.zeros(shape, np.int32) for _ in range(3))
        now[0][:, 1:], now[1][:, 1:], now[2][:, 1:] = score, np.where(score > 0, count, 0), start
        top = score.argmax(1)
        high = score[rows, top]
        better = np.flatnonzero(high > best[:, 0])
        if len(better):
            k = top[better]
            best[better] = np.stack([high[better], now[1][better, k + 1], now[2][better, k + 1], j[k]], 1)
        older, old = old, now
    return best
