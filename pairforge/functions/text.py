"""String columns.  Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """All Unicode white space removed at both ends (``trim`` only removes U+0020)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def str_or_empty(c: Column) -> Column:
    """Stripped text; null becomes the empty text."""
    return F.coalesce(strip(c.cast("string")), F.lit(""))


def blank_key(c: Column) -> Column:
    """A grouping key: no outer blanks (U+0020), lower case, null as the empty text."""
    return F.lower(F.trim(F.coalesce(c, F.lit(""))))


def fragment_tokens(c: Column) -> Column:
    """Dot-separated tokens, stripped, empty ones left out, repeats kept.  Null gives an empty array."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[.]"), strip), lambda x: x != "")


def fragment_set(c: Column) -> Column:
    """The distinct tokens of ``fragment_tokens``."""
    return F.array_distinct(fragment_tokens(c))


def fragment_list(c: Column) -> Column:
    """Tokens as the scorers read them: only U+0020 is removed (anywhere), repeats kept."""
    return F.filter(F.split(F.replace(F.coalesce(c, F.lit("")), F.lit(" "), F.lit("")), "[.]"), lambda x: x != "")


def fragment_count(c: Column) -> Column:
    """Number of ``fragment_tokens``, repeats counted; null counts 0."""
    return F.size(fragment_tokens(c))


def fragment_join(tokens: Column) -> Column:
    """Tokens in code-point order, joined by dots."""
    return F.array_join(F.array_sort(tokens), ".")


def py_repr(c: Column) -> Column:
    """Python's quoting of a printable text: backslashes doubled; double quotes only if the text holds ' and no "."""
    body = F.regexp_replace(c, r"\\", r"\\\\")
    body = F.replace(F.replace(F.replace(body, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t"))
    has_single, has_double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return F.when(has_single & ~has_double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def char_ngrams(c: Column, n: int) -> Column:
    """Sliding character n-grams; an empty array for texts shorter than ``n``."""
    return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: c.substr(i, F.lit(n)))).when(c.isNotNull(), F.array().cast("array<string>"))


def cell_fragments(c: Column) -> Column:
    """Fragments of a delivered cell: a null, blank or ``nan`` cell (any case) holds none; else the parts between dots
    without outer blanks (U+0020), empty parts left out, repeats kept."""
    nothing = c.isNull() | F.lower(F.trim(c)).isin("", "nan")
    parts = F.filter(F.transform(F.split(c, "[.]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(nothing, F.array().cast("array<string>")).otherwise(parts)
