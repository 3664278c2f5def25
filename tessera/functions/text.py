"""Names and text: standard forms, accents, similarity."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Numerals that stand for numbers where they are whole words.
ROMAN = {
    "IX": "9",
    "VIII": "8",
    "VII": "7",
    "VI": "6",
    "V": "5",
    "IV": "4",
    "III": "3",
    "II": "2",
    "I": "1",
}


def _fold_table() -> tuple[str, str]:
    """Latin letters with marks, and the letters without them."""
    marked = [chr(c) for c in range(0xC0, 0x250) if len(b := unicodedata.normalize("NFD", chr(c))[0]) == 1 and b.isascii() and b.isalpha()]
    return "".join(marked), "".join(unicodedata.normalize("NFD", c)[0] for c in marked)


MARKED, PLAIN = _fold_table()
LIGATURES = {"Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "ß": "ss", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ł": "L", "ł": "l"}


def fold_accents(x: Column) -> Column:
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), LIGATURES.items(), F.translate(x, MARKED, PLAIN))


def squish(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def standardize_name(name: Column | str, sort_tokens: bool = True) -> Column:
    """Upper case, punctuation to spaces, accents folded, numerals to digits, words sorted with numbers last. Null gives an empty text where words are sorted."""
    x = F.col(name) if isinstance(name, str) else name
    x = F.upper(x)
    x = squish(F.regexp_replace(x, r"[\p{P}]", " "))
    x = F.regexp_replace(fold_accents(x), r"\p{Zs}+", " ")
    x = reduce(lambda c, kv: F.regexp_replace(c, rf"\b{kv[0]}\b", kv[1]), ROMAN.items(), x)
    if not sort_tokens:
        return x
    words = F.split(F.coalesce(x, F.lit("")), " +")
    number = lambda w: w.rlike("^[0-9]+$")
    return F.array_join(F.concat(F.array_sort(F.filter(words, lambda w: ~number(w))), F.array_sort(F.filter(words, number))), " ")


def clean_name(x: Column | str) -> Column:
    """Upper case without surrounding or repeated spaces."""
    return F.upper(squish(F.col(x) if isinstance(x, str) else x))


def jaro(a: str, b: str) -> float:
    """Jaro similarity: matches within a window, less the transpositions, of which two displaced letters make one (an odd one makes none)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, first = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                first.append(c)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [c for c, f in zip(b, free) if not f]
    moved = sum(x != y for x, y in zip(first, second)) // 2
    return (m / len(a) + m / len(b) + (m - moved) / m) / 3


@F.pandas_udf(DoubleType())
def jaro_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict = {}
    out = []
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = None if pair[0] is None or pair[1] is None else jaro(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def edit_similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length, not below 0."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.greatest(F.lit(0.0), 1 - F.levenshtein(a, b) / longest)
