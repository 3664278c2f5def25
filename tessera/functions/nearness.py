"""Nearest names of two lists by edit distance or by the score of matching, as arrays.

Not every pair is compared: letters and pairs of neighbouring letters in common bound the distance from below and the score from
above (one matrix product each), and only pairs whose bound reaches the best found are. The outcome is that of comparing all.
"""

from __future__ import annotations

import numpy as np

ROWS, PAIRS = 256, 1 << 14  # of the bounds looked at and of pairs compared at once


class Names:
    """Names as rows of letters, numbered by an alphabet that both lists share."""

    def __init__(self, names: list[str], width: int):
        self.size = np.array([len(n) for n in names], dtype=np.int64)
        self.letters = np.array(names, dtype=f"U{width}").view(np.uint32).reshape(len(names), width).astype(np.int64)
        self.there = np.arange(width) < self.size[:, None]

    @staticmethod
    def both(a: list[str], b: list[str]) -> tuple[Names, Names, int]:
        width = max(1, *map(len, a), *map(len, b))
        x, y = Names(a, width), Names(b, width)
        known = np.unique(np.concatenate([x.letters[x.there], y.letters[y.there]]))
        for s in (x, y):
            s.letters = np.where(s.there, np.searchsorted(known, s.letters), len(known))
        return x, y, len(known) + 1

    def tokens(self, alphabet: int, q: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers of the letters (q is 1) or pairs of neighbours (q is 2)."""
        made = self.letters if q == 1 else self.letters[:, :-1] * alphabet + self.letters[:, 1:]
        rows, at = np.nonzero(self.there[:, q - 1 :])
        return rows, made[rows, at]


def in_common(a: Names, b: Names, alphabet: int, q: int) -> np.ndarray:
    """Tokens that each two names have in common, counted as often as in both."""
    (ra, ta), (rb, tb) = a.tokens(alphabet, q), b.tokens(alphabet, q)
    known = np.intersect1d(ta, tb)
    counts = []
    for rows, tokens, n in ((ra, ta, len(a.size)), (rb, tb, len(b.size))):
        keep = np.isin(tokens, known)
        flat = np.bincount(rows[keep] * len(known) + np.searchsorted(known, tokens[keep]), minlength=n * len(known))
        counts.append(flat.reshape(n, len(known)))
    out = np.zeros((len(a.size), len(b.size)), dtype=np.float32)
    least = np.minimum(counts[0].max(axis=0, initial=0), counts[1].max(axis=0, initial=0))
    for k in range(1, int(least.max(initial=0)) + 1):
        some = least >= k
        out += (counts[0][:, some] >= k).astype(np.float32) @ (counts[1][:, some] >= k).astype(np.float32).T
    return out


def least_distances(a: Names, b: Names, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """A lower bound of each distance, and the letters in common: an edit changes one letter and two pairs at most."""
    longest = np.maximum(a.size[:, None], b.size[None, :]).astype(np.float32)
    letters = in_common(a, b, alphabet, 1)
    return np.maximum(longest - letters, np.ceil((longest - 1 - in_common(a, b, alphabet, 2)) / 2)).astype(np.int32), letters


def edit_distances(a: Names, b: Names, alphabet: int, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """Levenshtein distances of the pairs, a column of bits at once (Myers); names beyond 64 letters as Python's integers."""
    n, width = a.letters.shape
    kind = np.uint64 if a.size.max(initial=0) <= 64 else object
    one = kind(1) if kind is np.uint64 else 1
    where = np.zeros((n, alphabet), dtype=kind)  # the bits at which a letter stands
    for i in range(int(a.size.max(initial=0))):
        rows = np.nonzero(a.there[:, i])[0]
        where[rows, a.letters[rows, i]] |= one << (kind(i) if kind is np.uint64 else i)
    out = np.empty(len(ia), dtype=np.int64)
    for lo in range(0, len(ia), PAIRS):
        x, y = ia[lo : lo + PAIRS], ib[lo : lo + PAIRS]
        size, other = a.size[x], b.size[y]
        top = np.array([0 if m == 0 else 1 << (m - 1) for m in range(int(a.size.max(initial=0)) + 1)], dtype=kind)[size]
        score = size.copy()
        minus = np.zeros(len(x), dtype=kind)
        plus = np.full(len(x), ~minus[0] if kind is np.uint64 else -1, dtype=kind)
        for j in range(int(other.max(initial=0))):
            eq = where[x, b.letters[y, j]]
            v = eq | minus
            h = (((eq & plus) + plus) ^ plus) | eq
            up, down = minus | ~(h | plus), plus & h
            live = j < other
            score += live & ((up & top) != 0)
            score -= live & ((down & top) != 0)
            up, down = (up << one) | one, down << one
            plus, minus = down | ~(v | up), up & v
        out[lo : lo + PAIRS] = np.where(size == 0, other, score)
    return out


def jaro_similarities(a: Names, b: Names, ia: np.ndarray, ib: np.ndarray) -> np.ndarray:
    """``text.jaro`` of the pairs."""
    out = np.empty(len(ia))
    at = np.arange(b.letters.shape[1])
    for lo in range(0, len(ia), PAIRS):
        x, y = a.letters[ia[lo : lo + PAIRS]], b.letters[ib[lo : lo + PAIRS]]
        m, n = a.size[ia[lo : lo + PAIRS]], b.size[ib[lo : lo + PAIRS]]
        reach = np.maximum(np.maximum(m, n) // 2 - 1, 0)
        free, every = b.there[ib[lo : lo + PAIRS]].copy(), np.arange(len(x))
        hit = np.zeros(x.shape, dtype=bool)
        for i in range(int(m.max(initial=0))):
            near = free & (y == x[:, i : i + 1]) & (abs(at - i) <= reach[:, None]) & (i < m)[:, None]
            first = near.argmax(axis=1)
            found = near[every, first]
            free[every[found], first[found]] = False
            hit[:, i] = found
        taken = b.there[ib[lo : lo + PAIRS]] & ~free
        order = [np.argsort(~t, axis=1, kind="stable") for t in (hit, taken)]
        k = hit.sum(axis=1)
        apart = np.take_along_axis(x, order[0], 1) != np.take_along_axis(y, order[1], 1)
        moved = (apart & (at < k[:, None])).sum(axis=1) // 2
        with np.errstate(divide="ignore", invalid="ignore"):
            s = (k / m + k / n + (k - moved) / k) / 3
        same = (m == n) & (x == y).all(axis=1)
        out[lo : lo + PAIRS] = np.where(same, 1.0, np.where(k == 0, 0.0, s))
    return out


def _parts(n: int):
    return (np.arange(lo, min(n, lo + ROWS)) for lo in range(0, n, ROWS))


def nearest(a: list[str], b: list[str], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k nearest b of each a; of equal distances, the first in b."""
    x, y, alphabet = Names.both(a, b)
    least, _ = least_distances(x, y, alphabet)
    k, out = min(k, len(b)), []
    for rows in _parts(len(a)):
        some = least[rows]
        tried = np.argpartition(some, k - 1, axis=1)[:, :k]
        reach = edit_distances(x, y, alphabet, np.repeat(rows, k), tried.ravel()).reshape(-1, k).max(axis=1)
        i, ib = np.nonzero(some <= reach[:, None])
        d = edit_distances(x, y, alphabet, rows[i], ib)
        order = np.lexsort((ib, d, i))
        i, ib, d = i[order], ib[order], d[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        out.append((rows[i[first]], ib[first], d[first]))
    return tuple(map(np.concatenate, zip(*out)))


def most_similar(a: list[str], b: list[str], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, score) of the best b of each a that reaches the threshold; of equal scores, the first in b.

    The score is 50 times Jaro's similarity and 50 times the edit similarity.
    """
    x, y, alphabet = Names.both(a, b)
    least, letters = least_distances(x, y, alphabet)
    longest = lambda i, j: np.maximum(np.maximum(x.size[i], y.size[j]), 1)
    edits = lambda i, j, d: 50 * np.maximum(0, 1 - d / longest(i, j))
    part = lambda c, n: np.where(n > 0, c / np.maximum(n, 1), 1.0)
    most = lambda i, j, c: 50 * (part(c, x.size[i]) + part(c, y.size[j]) + 1) / 3
    every, slack, out = np.arange(len(b)), 1e-6, []
    for rows in _parts(len(a)):
        jaro = most(rows[:, None], every, letters[rows].astype(float))
        bound = jaro + edits(rows[:, None], every, least[rows])
        tried = bound.argmax(axis=1)
        found = 50 * jaro_similarities(x, y, rows, tried) + edits(rows, tried, edit_distances(x, y, alphabet, rows, tried))
        reach = np.maximum(found, threshold) - slack
        i, ib = np.nonzero(bound >= reach[:, None])
        e = edits(rows[i], ib, edit_distances(x, y, alphabet, rows[i], ib))
        keep = jaro[i, ib] + e >= reach[i]
        i, ib, e = i[keep], ib[keep], e[keep]
        s = 50 * jaro_similarities(x, y, rows[i], ib) + e
        keep = s >= threshold
        i, ib, s = i[keep], ib[keep], s[keep]
        order = np.lexsort((ib, -s, i))
        i, ib, s = i[order], ib[order], s[order]
        first = np.arange(len(i)) == np.searchsorted(i, i)
        out.append((rows[i[first]], ib[first], s[first]))
    return tuple(map(np.concatenate, zip(*out)))
