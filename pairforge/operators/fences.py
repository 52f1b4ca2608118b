"""Quantile fences and the filters built on them.

Fences are global.  Those of lengths and counts come from one aggregate, whose state holds as many values as there are
distinct lengths; those of properties, where every value may differ, from the distributed selection of ``skew``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import fragment_tokens
from pairforge.operators.skew import key_interpolated
from pairforge.schema import PROPERTIES, require_columns

#: Longest and most fragments when a fence cannot be computed; tokens of this length and more are too long.
TOO_LONG, MAX_COUNT, MIN_POINTS = 28, 4, 4

#: What the fragment filters read.
NEEDED = ["n_common_safe", "n_only_toxic_safe", "n_only_nontoxic_safe", "only_toxic_safe_fragments", "only_nontoxic_safe_fragments"]


def upper_fence(x: Column, min_points: int = MIN_POINTS) -> Column:
    """Q3 + 1.5 IQR of an aggregate with linear interpolation; null with fewer points or without spread."""
    q = F.percentile(x.cast("double"), F.array(F.lit(0.25), F.lit(0.75)))
    iqr = q[1] - q[0]
    return F.when((F.count(x) >= min_points) & (iqr > 0), q[1] + 1.5 * iqr)


def two_sided_fences(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Per column Q1 - 1.5 IQR and Q3 + 1.5 IQR without guards: with no spread both are Q1.  Texts that are no number and
    NaN count as missing; a column without numbers has no fences.  All columns go through one selection."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).try_cast("double").alias("x")) for c in columns])).alias("s")).select("s.*")
    found = key_interpolated(long.where("x IS NOT NULL AND NOT isnan(x)"), ["name"], F.col("x"), [0.25, 0.75]).collect()  # one row per column
    return {r["name"]: (r["q"][0] - 1.5 * (r["q"][1] - r["q"][0]), r["q"][1] + 1.5 * (r["q"][1] - r["q"][0])) for r in found}


def core_filter(df: DataFrame) -> DataFrame:
    """Pairs with a common fragment and a difference."""
    return df.where("n_common_safe <> 0 AND NOT (n_only_toxic_safe = 0 AND n_only_nontoxic_safe = 0)")


def only_tokens() -> Column:
    return F.concat(fragment_tokens(F.col("only_toxic_safe_fragments")), fragment_tokens(F.col("only_nontoxic_safe_fragments")))


def length_fence(df: DataFrame, fallback: float) -> float:
    """Upper fence of the lengths of all tokens of one side only, one number."""
    row = df.select(F.explode(only_tokens()).alias("t")).agg(upper_fence(F.length("t")).alias("fence")).first()
    return fallback if row["fence"] is None else row["fence"]


def fragment_filters(df: DataFrame, use_iqr: bool = True, too_long: int = TOO_LONG, max_count: int = MAX_COUNT) -> DataFrame:
    """Core filter, then token length, then token counts of both sides.

    With ``use_iqr`` a token may be as long as the fence of the rows left by the core filter (``too_long`` - 1 if there
    is none), and counts as high as the fences of the rows left by that (``max_count`` if there are none).  Else the
    fixed values hold.  ``df`` should be a materialised table: it is read three times.
    """
    require_columns(df, NEEDED, "pairs")
    rows = core_filter(df)
    longest = length_fence(rows, too_long - 1.0) if use_iqr else too_long - 1.0
    rows = rows.where(~F.exists(only_tokens(), lambda t: F.length(t) > longest))
    most = {c: float(max_count) for c in ("n_only_toxic_safe", "n_only_nontoxic_safe")}
    if use_iqr:
        row = rows.agg(*[upper_fence(F.col(c)).alias(c) for c in most]).first()
        most = {c: m if row[c] is None else row[c] for c, m in most.items()}
    return rows.where(reduce(lambda a, b: a & b, [F.col(c) <= m for c, m in most.items()]))


def property_deltas(pairs: DataFrame, profile: DataFrame, properties: list[str] | None = None) -> DataFrame:
    """``toxic_P``, ``nontoxic_P``, ``delta_P`` (nontoxic - toxic) and ``delta_abs_P``; null unless both are finite numbers.

    ``profile``: ``smiles`` and a struct ``props``; it is reduced to one row per molecule and joined once per side.
    """
    properties = properties or PROPERTIES
    known = {f.lower(): f for f in profile.schema["props"].dataType.fieldNames()}
    props = profile.select("smiles", *[F.col("props").getField(known[p.lower()]).cast("double").alias(p) for p in properties]).groupBy("smiles").agg(*[F.min(p).alias(p) for p in properties])
    for side in ("toxic", "nontoxic"):
        cols = props.select(F.col("smiles").alias("__k"), *[F.col(p).alias(f"{side}_{p}") for p in properties])
        pairs = pairs.join(cols, F.col(f"{side}_smiles") == F.col("__k"), "left").drop("__k")
    fine = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c))
    pairs = pairs.withColumns({f"delta_{p}": fine(f"nontoxic_{p}") - fine(f"toxic_{p}") for p in properties})
    return pairs.withColumns({f"delta_abs_{p}": F.abs(f"delta_{p}") for p in properties})


def drop_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without any of ``columns`` outside its two-sided fence; missing values and missing fences exclude nothing.
    All fences come from the same rows; ``df`` should be a materialised table, as it is read several times."""
    require_columns(df, columns, "pairs")
    bad = [F.lit(False)]
    for c, (lower, upper) in two_sided_fences(df, columns).items():
        x = F.col(c).try_cast("double")
        bad.append(F.coalesce((x < lower) | ((x > upper) & ~F.isnan(x)), F.lit(False)))
    return df.where(~reduce(lambda a, b: a | b, bad))
