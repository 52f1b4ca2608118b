"""The engine's functions for ``spark.sql``: SQL functions that Catalyst inlines, no Python in them."""

from __future__ import annotations

from pyspark.sql import SparkSession

_STRIP = r"regexp_replace(x, r'(?U)^\s+|\s+$', '')"
_LIST = "filter(split(replace(coalesce({}, ''), ' ', ''), '[.]'), x -> x <> '')"
_SET = "array_distinct(" + _LIST + ")"
_HIT = f"size(array_intersect({_SET.format('gold')}, {_SET.format('pred')}))"
_NG, _NP = f"size({_SET.format('gold')})", f"size({_SET.format('pred')})"
_COUNT = "(length({0}) - length(replace({0}, c, '')))"

FUNCTIONS = {
    "fragment_set(s STRING) RETURNS ARRAY<STRING>": f"array_distinct(filter(transform(split(coalesce(s, ''), '[.]'), x -> {_STRIP}), x -> x <> ''))",
    "fragment_list(s STRING) RETURNS ARRAY<STRING>": _LIST.format("s"),
    "set_f1(gold STRING, pred STRING) RETURNS DOUBLE": f"CASE WHEN {_NG} = 0 AND {_NP} = 0 THEN 1D WHEN {_NG} = 0 OR {_NP} = 0 THEN 0D ELSE 2D * {_HIT} / ({_NG} + {_NP}) END",
    "bleu1(gold STRING, pred STRING) RETURNS DOUBLE": f"CASE WHEN length(gold) > 0 AND length(pred) > 0 THEN aggregate(array_distinct(split(pred, '')), 0, (n, c) -> n + least({_COUNT.format('pred')}, {_COUNT.format('gold')})) / length(pred) ELSE 0D END",
    "fragment_levenshtein(gold STRING, pred STRING) RETURNS DOUBLE": f"CASE WHEN size({_LIST.format('gold')}) = 0 OR size({_LIST.format('pred')}) = 0 THEN cast(levenshtein(coalesce(gold, ''), coalesce(pred, '')) AS DOUBLE) ELSE aggregate(transform({_LIST.format('pred')}, p -> array_min(transform({_LIST.format('gold')}, g -> levenshtein(p, g)))), 0D, (s, v) -> s + v) / size({_LIST.format('pred')}) END",
    "tanimoto_words(a ARRAY<BIGINT>, b ARRAY<BIGINT>) RETURNS DOUBLE": "CASE WHEN aggregate(zip_with(a, b, (x, y) -> x | y), 0, (n, w) -> n + bit_count(w)) > 0 THEN aggregate(zip_with(a, b, (x, y) -> x & y), 0, (n, w) -> n + bit_count(w)) / aggregate(zip_with(a, b, (x, y) -> x | y), 0, (n, w) -> n + bit_count(w)) WHEN a IS NOT NULL AND b IS NOT NULL THEN 0D END",
}


def register(spark: SparkSession) -> None:
    """Make the functions known to this session under their names."""
    for head, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
