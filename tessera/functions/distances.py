"""String distances by name, as similarities between 0 and 1, for names that are compared within blocks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .text import jaro


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    s, n = jaro(a, b), 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    return s + n * weight * (1 - s)


def _edit(a: str, b: str, swaps: bool) -> int:
    """Edit distance; with swaps of neighbours counted as one edit, if asked."""
    rows = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(rows[-1][j] + 1, row[-1] + 1, rows[-1][j - 1] + (x != y))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, rows[-2][j - 2] + 1)
            row.append(best)
        rows.append(row)
    return rows[-1][-1]


def _common(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def _grams(s: str, q: int = 2) -> Counter:
    return Counter(s[i : i + q] for i in range(len(s) - q + 1))


def _share(n: float, whole: float) -> float:
    return 1.0 if not whole else max(0.0, 1 - n / whole)


def _cosine(a: str, b: str) -> float:
    x, y = _grams(a), _grams(b)
    size = (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5
    return sum(v * y[k] for k, v in x.items()) / size if size else float(a == b)


METHODS: dict[str, Callable[[str, str], float]] = {
    "jaro": jaro,
    "jw": jaro_winkler,
    "lv": lambda a, b: _share(_edit(a, b, False), max(len(a), len(b))),
    "osa": lambda a, b: _share(_edit(a, b, True), max(len(a), len(b))),
    "lcs": lambda a, b: _share(len(a) + len(b) - 2 * _common(a, b), len(a) + len(b)),
    "qgram": lambda a, b: _share(sum(((_grams(a) - _grams(b)) + (_grams(b) - _grams(a))).values()), sum(_grams(a).values()) + sum(_grams(b).values())),
    "cosine": _cosine,
    "jaccard": lambda a, b: len(set(_grams(a)) & set(_grams(b))) / len(u) if (u := set(_grams(a)) | set(_grams(b))) else float(a == b),
    "hamming": lambda a, b: _share(sum(x != y for x, y in zip(a, b)), len(a)) if len(a) == len(b) else 0.0,
}


def similarity(a: Column, b: Column, method: str) -> Column:
    """The similarity of two text columns; ``soundex`` compares their codes."""
    if method == "soundex":
        return (F.soundex(a) == F.soundex(b)).cast("double")
    f = METHODS[method]

    @F.pandas_udf(DoubleType())
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else f(p, q) for p, q in zip(x, y)], dtype="float64")

    return run(a, b)
