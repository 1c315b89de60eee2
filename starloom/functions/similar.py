"""Weighted similarity of many pairs of rows at once: Jaro-Winkler over arrays, behind bounds that lose no pair.

A text's letters are counted as tokens (letter, how often so far), one bit each, so the letters that two texts share are
a popcount. With k shared letters, lengths n and m and the true common prefix, Jaro-Winkler is at most what it would be
if all k matched in order. Pairs whose bounded score misses the threshold are never scored.
"""

from __future__ import annotations

import numpy as np

from starloom.functions.text import jaro_winkler_one

TILE = 512
CELLS = 2_000_000  # of the arrays that a batch of pairs needs
LONG = 256  # characters beyond which pairs are scored one by one


class Field:
    """One text column of a chunk of rows: distinct values, and what the bounds need of each."""

    def __init__(self, values: list[str]):
        self.texts = sorted(set(values))
        place = {t: i for i, t in enumerate(self.texts)}
        self.of = np.array([place[v] for v in values], np.int64)
        tokens: dict[tuple[str, int], int] = {}
        bits = []
        for t in self.texts:
            seen: dict[str, int] = {}
            own = []
            for c in t:
                seen[c] = seen.get(c, 0) + 1
                own.append(tokens.setdefault((c, seen[c]), len(tokens)))
            bits.append(own)
        self.mask = np.zeros((len(self.texts), max(1, -(-len(tokens) // 64))), np.uint64)
        for i, own in enumerate(bits):
            for b in own:
                self.mask[i, b // 64] |= np.uint64(1 << (b % 64))
        self.length = np.array([len(t) for t in self.texts], np.int64)
        # the first four letters; what is absent differs from everything
        self.lead = np.array([[ord(t[k]) if k < len(t) else -1 for k in range(4)] for t in self.texts], np.int64).reshape(-1, 4)

    def bound(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Upper bounds of the similarity of all pairs of two lists of values, as a matrix."""
        shared = np.zeros((len(x), len(y)), np.int64)
        for w in range(self.mask.shape[1]):
            shared += np.bitwise_count(self.mask[x, w][:, None] & self.mask[y, w])
        n, m = self.length[x][:, None], self.length[y]
        prefix, same = np.zeros(shared.shape), np.ones(shared.shape, bool)
        for k in range(4):
            same &= (self.lead[x, k][:, None] == self.lead[y, k]) & (self.lead[y, k] >= 0)
            prefix += same
        jaro = np.where(shared > 0, (shared / np.maximum(n, 1) + shared / np.maximum(m, 1) + 1) / 3, 0.0)
        out = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
        out[x[:, None] == y] = 1.0
        return out

    def similarity(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of pairs of values: equal 1, one of them empty 0."""
        code, which = np.unique(x * len(self.texts) + y, return_inverse=True)
        a, b = code // len(self.texts), code % len(self.texts)
        out = np.where(a == b, 1.0, 0.0)
        todo = np.flatnonzero((a != b) & (self.length[a] > 0) & (self.length[b] > 0))
        wide = np.maximum(self.length[a[todo]], self.length[b[todo]])
        for i in todo[wide > LONG].tolist():
            out[i] = jaro_winkler_one(self.texts[a[i]], self.texts[b[i]])
        short = todo[wide <= LONG]
        short = short[np.argsort(np.maximum(self.length[a[short]], self.length[b[short]]), kind="stable")]
        at = 0
        while at < len(short):
            per = max(1, CELLS // int(max(self.length[a[short[at]]], self.length[b[short[at]]]) * 8))
            part = short[at : at + per]
            out[part] = jaro_winkler_many([self.texts[i] for i in a[part]], [self.texts[i] for i in b[part]])
            at += per
        return out[which]


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    length = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), int(length.max(initial=1))), np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(out.shape[1]) < length[:, None]] = flat
    return out, length


def jaro_winkler_many(left: list[str], right: list[str]) -> np.ndarray:
    """Jaro-Winkler of pairs of texts that are not empty; equal to jaro_winkler_one on each."""
    a, n = _codes(left)
    b, m = _codes(right)
    pairs = np.arange(len(left))
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    at = np.arange(b.shape[1])
    used, mine = np.zeros(b.shape, bool), np.zeros(a.shape, bool)
    inside = at < m[:, None]
    for i in range(a.shape[1]):
        fits = (b == a[:, i][:, None]) & inside & ~used & (np.abs(at - i) <= reach[:, None]) & (i < n)[:, None]
        j = fits.argmax(axis=1)
        hit = fits[pairs, j]
        used[pairs[hit], j[hit]] = True
        mine[hit, i] = True
    k = mine.sum(axis=1)
    # matched letters of both sides, in order, next to each other
    swaps = np.zeros(len(left), np.int64)
    rows, i = np.nonzero(mine)
    _, j = np.nonzero(used)
    np.add.at(swaps, rows, a[rows, i] != b[rows, j])
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(k > 0, (k / n + k / m + (k - swaps // 2) / k) / 3, 0.0)
    prefix, same = np.zeros(len(left), np.int64), np.ones(len(left), bool)
    for c in range(min(4, a.shape[1], b.shape[1])):
        same &= (a[:, c] == b[:, c]) & (c < n) & (c < m)
        prefix += same
    out = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return np.where((n == m) & (k == n) & (swaps == 0), 1.0, out)


def scored(columns: list[list[str]], weights: list[float], side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, score) of pairs of rows whose score reaches the threshold (less a rounding of six places): all pairs, or those between side 0 and 1."""
    fields = [Field(c) for c in columns]
    n = len(columns[0])
    first = np.arange(n) if side is None else np.flatnonzero(side == 0)
    second = first if side is None else np.flatnonzero(side == 1)
    # rows of equal first values next to each other, so that tiles repeat less
    first, second = (r[np.argsort(fields[0].of[r], kind="stable")] for r in (first, second))
    need, out = threshold - 1e-6, []
    for i in range(0, len(first), TILE):
        x = first[i : i + TILE]
        for j in range(0 if side is not None else i, len(second), TILE):
            y = second[j : j + TILE]
            bounds = []
            for f in fields:  # of distinct values, spread over the rows
                xs, xi = np.unique(f.of[x], return_inverse=True)
                ys, yi = np.unique(f.of[y], return_inverse=True)
                bounds.append(f.bound(xs, ys)[xi][:, yi])
            most = sum(b * w for b, w in zip(bounds, weights))
            hit = most >= need
            if side is None and i == j:
                hit = np.triu(hit, 1)
            p, q = np.nonzero(hit)
            score, best = np.zeros(len(p)), most[p, q]
            for f, w, bound in zip(fields, weights, bounds):
                s = f.similarity(f.of[x[p]], f.of[y[q]])
                score, best = score + s * w, best - w * (bound[p, q] - s)
                ok = best >= need - 1e-9
                p, q, score, best = p[ok], q[ok], score[ok], best[ok]
            out.append((x[p], y[q], score))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*out))
