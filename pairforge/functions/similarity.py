"""Similarity columns and the integer rules that equal 'similarity of 0.9 or more'."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def popcount(words: Column) -> Column:
    """Number of set bits of a fingerprint kept as 64-bit words; null for null."""
    return F.aggregate(words, F.lit(0), lambda n, w: n + F.bit_count(w))


def overlap(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), F.lit(0), lambda n, w: n + F.bit_count(w))


def tanimoto(a: Column, b: Column) -> Column:
    """Shared over united bits; null if either is null, 0 if neither has a bit."""
    both = overlap(a, b)
    union = popcount(a) + popcount(b) - both
    return F.when(union > 0, both / union).when(union == 0, F.lit(0.0))


def tanimoto_090(a: Column, b: Column) -> Column:
    """Tanimoto of 0.9 or more, in integers; null fingerprints never match."""
    both = overlap(a, b)
    union = popcount(a) + popcount(b) - both
    return F.coalesce((union > 0) & (both * 10 >= union * 9), F.lit(False))


def lev_090(a: Column, b: Column) -> Column:
    """Edit similarity of 0.9 or more, in integers, with bounded edit distance."""
    longest = F.greatest(F.length(a), F.length(b))
    bound = F.floor(longest / 10).cast("int")
    return F.coalesce((F.abs(F.length(a) - F.length(b)) * 10 <= longest) & (lev_within(a, b, bound) >= 0), F.lit(False))


def lev_within(a: Column, b: Column, bound: Column) -> Column:
    """Edit distance, -1 if it is above ``bound`` (a column)."""
    return F.call_function("levenshtein", a, b, bound)


def lev_similarity(a: Column, b: Column) -> Column:
    """1 - distance / length of the longer text (at least 1)."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))
