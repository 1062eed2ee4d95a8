"""Likeness of short texts in blocks: difflib's matching blocks, for pairs whose bounds leave them a chance.

What matches of two texts is no longer than what their characters have in common, and no longer than their longest common
subsequence.  The first bound is a product of matrices, the second is computed on the bits of a word; only pairs that both
leave go to difflib.
"""

from __future__ import annotations

import difflib

import numpy as np

#: Labels that are compared with a block at once, and pairs whose subsequences are computed at once.
ROWS, PAIRS = 256, 1 << 16


def score_of_size(size, len_a, len_b):
    """The score of two texts of which `size` characters match: the share of both, or from 0.8 of the first on mostly its share."""
    of_a, of_both = size / len_a, 2 * size / (len_a + len_b)
    return np.where(of_a >= 0.8, 0.8 + 0.15 * of_a + 0.05 * of_both, of_both)


def _coded(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """Characters as numbers from 0, one row a text, padded with the number of different characters."""
    points = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in a + b]
    alphabet, at = np.unique(np.concatenate(points), return_inverse=True)
    lengths = np.array([len(p) for p in points])
    out = np.full((len(points), lengths.max()), len(alphabet), np.int32)
    out[np.arange(out.shape[1]) < lengths[:, None]] = at
    return out[: len(a)], out[len(a) :], len(alphabet)


def _counts(codes: np.ndarray, n: int) -> np.ndarray:
    flat = codes + np.arange(len(codes))[:, None] * (n + 1)
    return np.bincount(flat.ravel(), minlength=len(codes) * (n + 1)).reshape(len(codes), n + 1)[:, :n]


def _unary(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as ones, so that the product of two rows is the size of their common characters."""
    most = np.minimum(a.max(0), b.max(0))
    column, level = np.repeat(np.arange(len(most)), most), np.concatenate([np.arange(m) for m in most] + [np.zeros(0, int)])
    return (a[:, column] > level).astype(np.float32), (b[:, column] > level).astype(np.float32)


def _subsequences(masks: np.ndarray, p: np.ndarray, codes: np.ndarray, q: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The length of the longest common subsequence of each pair, the first of at most 64 characters."""
    state, columns = np.full(len(p), ~np.uint64(0)), codes[q].T
    for column in columns:
        u = state & masks[p, column]
        state = (state + u) | (state - u)
    return np.bitwise_count(~state & (~np.uint64(0) >> (64 - lengths[p]).astype(np.uint64)))


def contained(a: list[str], b: list[str]) -> list[tuple[int, int, float]]:
    """Pairs (k of a, k of b, score) that are equal (1) or of which one holds the other (0.9 on)."""
    out = []
    for p, q, _ in _common(a, b, lambda common, at, len_a, len_b: common >= np.minimum(len_a, len_b)):
        for i, j in zip(p.tolist(), q.tolist(), strict=True):
            x, y = (a[i], b[j]) if len(a[i]) <= len(b[j]) else (b[j], a[i])
            if x in y:
                out.append((i, j, 1.0 if len(x) == len(y) else 0.9 + 0.1 * len(x) / len(y)))
    return out


def alike(a: list[str], b: list[str], least: np.ndarray) -> list[tuple[int, int, float]]:
    """Pairs (k of a, k of b, score) of four characters or more, neither of which holds the other, whose score reaches least[k of a]."""
    codes_a, codes_b, n = _coded(a, b)
    lengths = np.array([len(x) for x in a])
    out: list[tuple[int, int, float]] = []

    def possible(common, at, len_a, len_b):
        return (score_of_size(common, len_a, len_b) >= least[at, None]) & (np.minimum(len_a, len_b) >= 4)

    matcher = difflib.SequenceMatcher(None)
    for p, q, start in _common(a, b, possible):
        some = min(ROWS, len(a) - start)
        masks = np.zeros((some, n + 1), np.uint64)
        for k in range(min(64, codes_a.shape[1])):
            np.bitwise_or.at(masks, (np.arange(some), codes_a[start : start + some, k]), np.uint64(1) << np.uint64(k))
        masks[:, n] = 0  # padding
        for cut in range(0, len(p), PAIRS):
            i, j = p[cut : cut + PAIRS], q[cut : cut + PAIRS]
            fits = lengths[i] <= 64
            size = np.full(len(i), np.iinfo(np.int64).max)
            size[fits] = _subsequences(masks, i[fits] - start, codes_b, j[fits], lengths[start : start + some])
            size = np.minimum(size, lengths[i])
            left = score_of_size(size, lengths[i], np.array([len(b[x]) for x in j.tolist()])) >= least[i]
            i, j = i[left], j[left]
            for x, y in zip(*(v[np.argsort(j, kind="stable")].tolist() for v in (i, j)), strict=True):
                if a[x] in b[y] or b[y] in a[x]:
                    continue
                if matcher.b is not b[y]:
                    matcher.set_seq2(b[y])
                matcher.set_seq1(a[x])
                size_xy = sum(m.size for m in matcher.get_matching_blocks())
                score = float(score_of_size(size_xy, len(a[x]), len(b[y])))
                if score >= least[x]:
                    out.append((x, y, score))
    return out


def _common(a: list[str], b: list[str], test):
    """Places (of a, of b) of pairs that pass a test of the size of their common characters, ROWS of a at a time."""
    codes_a, codes_b, n = _coded(a, b)
    ones_a, ones_b = _unary(_counts(codes_a, n), _counts(codes_b, n))
    len_a, len_b = (np.array([len(t) for t in x]) for x in (a, b))
    for start in range(0, len(a), ROWS):
        at = np.arange(start, min(start + ROWS, len(a)))
        common = ones_a[at] @ ones_b.T
        p, q = np.nonzero(test(common, at, len_a[at, None], len_b[None, :]))
        yield p + start, q, start
