"""Similarity of names across Arabic and Latin script."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import DIACRITICS, fold_arabic

__all__ = ["DIACRITICS", "LATIN", "SOUNDS", "VOWELS", "consonants", "latin", "partner_similarity", "sequence_ratio", "skeleton", "spans", "token_overlap"]

# Arabic letters and how they are written in Latin letters.
LATIN = {
    "ا": "a", "ب": "b", "ت": "t", "ث": "th", "ج": "j", "ح": "h", "خ": "kh", "د": "d", "ذ": "th", "ر": "r", "ز": "z", "س": "s", "ش": "sh", "ص": "s",
    "ض": "d", "ط": "t", "ظ": "z", "ع": "a", "غ": "gh", "ف": "f", "ق": "q", "ك": "k", "ل": "l", "م": "m", "ن": "n", "ه": "h", "و": "w", "ي": "y", "ء": "",
}

# Two letters that are one consonant, and how it is written here. No pair begins in another.
SOUNDS = (("ph", "f"), ("kh", "x"), ("gh", "g"), ("sh", "s"), ("th", "t"))
#: What is no consonant: vowels, w, and y behind the first place.
VOWELS = "(?<!^)y|[aeiouw]"


def consonants(latin: str) -> str:
    """What ``skeleton`` keeps of a name whose sounds are written as one letter."""
    return re.sub("[^a-z0-9]", "", re.sub(VOWELS, "", latin))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; 0 if either is empty. No built-in function has it."""
    return pd.Series([SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(a, b)], dtype="float64")


def latin(text: Column, hamza: str = "") -> Column:
    """Arabic letters written in Latin ones, white space collapsed."""
    written = LATIN | {"ء": hamza}
    out = fold_arabic(text)
    for letter in (k for k, v in written.items() if len(v) > 1):
        out = F.replace(out, F.lit(letter), F.lit(written[letter]))
    single = "".join(v for v in written.values() if len(v) == 1)
    # translate() removes the letters that have no counterpart.
    out = F.translate(out, "".join(sorted((k for k, v in written.items() if len(v) < 2), key=lambda k: not written[k])), single)
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def skeleton(text: Column, relaxed: bool = False) -> Column:
    """Consonants of a name as they sound; ``relaxed`` writes doubled ones once."""
    out = latin(text)
    for pair, sound in SOUNDS:
        out = F.replace(out, F.lit(pair), F.lit(sound))
    out = F.regexp_replace(F.regexp_replace(out, VOWELS, ""), "[^a-z0-9]", "")
    return F.regexp_replace(out, r"(.)\1+", "$1") if relaxed else out


def spans(text: Column, most: int = 4, tokens: int = 120) -> Column:
    """Runs of one to ``most`` words of the first ``tokens`` words; one empty string for no words."""
    words = F.slice(F.filter(F.split(F.trim(fold_arabic(text)), r"\s+"), lambda w: w != ""), 1, tokens)

    def runs_of(n: int) -> Column:
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))

    runs = [runs_of(n) for n in range(1, most + 1)]
    return F.when(F.size(words) > 0, F.concat(*runs)).otherwise(F.array(F.lit("")))


def token_overlap(a: Column, b: Column) -> Column:
    """Shared distinct words over the larger number of distinct words."""
    x, y = (F.array_distinct(F.filter(F.split(t, r"\s+"), lambda w: w != "")) for t in (a, b))
    most = F.greatest(F.size(x), F.size(y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / most)


def partner_similarity(query: Column, candidate: Column) -> Column:
    """The better of native and Latin spelling (three parts sequence ratio, one part shared words), .15 more if one contains the other, 1 at most."""
    native = 0.75 * sequence_ratio(query, candidate) + 0.25 * token_overlap(query, candidate)
    ql, cl = latin(query), latin(candidate)
    cross = 0.75 * sequence_ratio(ql, cl) + 0.25 * token_overlap(ql, cl)
    within = F.when(query.contains(candidate) | candidate.contains(query), 0.15).otherwise(0.0)
    return F.when((query == "") | (candidate == ""), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(native, cross) + within))
