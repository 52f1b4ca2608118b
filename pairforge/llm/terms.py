"""Frequency of every fragment and n-gram of fragments (problem 3).

Yamamoto and Church's counting over a suffix array: the suffixes of all records in one global order, an n-gram's
occurrences as the width of its common-prefix interval, and its records as the occurrences less the duplicate
adjacencies – neighbours in a record's own suffix order that share the n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Held by fewer records than this is rare; by more than this percentage of all records, common.
RARE_RECORDS, COMMON_PERCENT = 3, 2

_OUT = "ngram array<string>, n int, occurrences bigint"


def _suffixes(tokens: Column, max_n: int | None) -> Column:
    return F.transform(tokens, lambda _, i: F.slice(tokens, i + 1, F.size(tokens) if max_n is None else max_n))


def intervals(max_n: int | None):
    """Partition function over sorted, distinct suffixes with weights: one row per n-gram and run of suffixes that begin
    with it.  A run may go on in the next batch or partition; the parts are summed afterwards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            suffix, weight = b.column(0), b.column(1).to_numpy()
            lens = np.diff(suffix.offsets.to_numpy())
            codes = suffix.flatten().dictionary_encode().indices.to_numpy()
            first = np.cumsum(lens) - lens
            # Longest common prefix of each suffix with the one before it.
            lcp = np.zeros(len(lens), np.int64)
            alive = np.ones(len(lens), bool)
            alive[:1] = False
            most = int(lens.max(initial=0)) if max_n is None else max_n
            for k in range(most):
                rows = np.nonzero(alive)[0]
                if not len(rows):
                    break
                rows = rows[(lens[rows] > k) & (lens[rows - 1] > k)]
                rows = rows[codes[first[rows] + k] == codes[first[rows - 1] + k]]
                lcp[rows] += 1
                alive[:] = False
                alive[rows] = True
            for n in range(1, most + 1):
                long = np.nonzero(lens >= n)[0]
                if not len(long):
                    continue
                # Suffixes too short for n break no interval: they sort before all that extend them.
                opens = lcp[long] < n
                begin = np.nonzero(opens)[0]
                sums = np.add.reduceat(weight[long], begin)
                grams = pc.list_slice(suffix.take(pa.array(long[begin])), 0, n, return_fixed_size_list=False)
                yield pa.RecordBatch.from_arrays([grams, pa.array(np.full(len(begin), n, np.int32)), pa.array(sums)], names=["ngram", "n", "occurrences"])

    return run


def _repeats(cells: list[Column], max_n: int) -> Column:
    """The n-grams of a record's duplicate adjacencies, one entry per adjacency."""
    order = F.array_sort(reduce(F.concat, [_suffixes(c, max_n) for c in cells]))

    def repeated(n: int) -> Column:
        heads = F.transform(F.filter(order, lambda s: F.size(s) >= n), lambda s: F.slice(s, 1, n))
        return F.filter(heads, lambda h, i: (i > 0) & (h == F.get(heads, i - 1)))

    return F.concat(*[repeated(n) for n in range(1, max_n + 1)])


def _all_repeats(several: DataFrame, cells: list[Column]) -> DataFrame:
    """The same for n-grams of every length: all that the common prefix of an adjacency begins with."""
    ordered = several.select(F.array_sort(reduce(F.concat, [_suffixes(c, None) for c in cells])).alias("order"))

    def common(a: Column, b: Column) -> Column:
        other = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        return F.slice(b, 1, F.when(other > 0, other - 1).otherwise(F.size(b)).cast("int"))

    heads = ordered.select(F.explode(F.transform("order", lambda s, i: F.when(i > 0, common(F.get("order", i - 1), s)))).alias("head")).where(F.size("head") > 0)
    return heads.select("head", F.explode(F.sequence(F.lit(1), F.size("head"))).alias("n")).select(F.slice("head", 1, F.col("n")).alias("ngram"))


def ngram_counts(df: DataFrame, cells: list[Column], max_n: int | None = None, report_n: int | None = None) -> DataFrame:
    """``ngram``, ``n``, ``occurrences``, ``n_records`` of every run of tokens inside a cell, whatever its length; of runs
    of up to ``max_n`` tokens only if that is asked for.  A cell of T tokens has T (T + 1) / 2 runs, each of which is an answer; with
    ``report_n`` suffixes are ordered whole, but only intervals of up to so many tokens are answered.

    ``cells`` are token arrays of one record each; n-grams do not cross cells, and a record holds an n-gram if any of
    its cells does.  Equal suffixes are combined before the shuffle that sorts them, so a token that makes up a third
    of everything is one weighted row.  Null and empty cells hold nothing; a row counts as a record even if it equals
    another; other columns of ``df`` are left out.
    """
    upto = min((n for n in (max_n, report_n) if n is not None), default=None)
    named = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cells)])
    cols = [F.coalesce(F.col(f"c{i}"), F.array().cast("array<string>")) for i in range(len(cells))]
    # One suffix per row, so that no row holds all suffixes of a long cell.
    cell = named.select(F.explode(F.filter(F.array(*cols), lambda c: F.size(c) > 0)).alias("cell")).select("cell", F.explode(F.sequence(F.lit(1), F.size("cell"))).alias("at"))
    suffix = cell.select(F.slice("cell", F.col("at"), F.size("cell") if max_n is None else F.lit(max_n)).alias("suffix")).groupBy("suffix").agg(F.count("*").alias("weight"))
    ordered = suffix.repartitionByRange("suffix").sortWithinPartitions("suffix")
    occurrences = ordered.mapInArrow(intervals(upto), _OUT).withColumn("repeats", F.lit(0).cast("bigint"))
    several = named.where(sum((F.size(c) for c in cols), F.lit(0)) > 1)
    twice = _all_repeats(several, cols) if upto is None else several.select(F.explode(_repeats(cols, upto)).alias("ngram"))
    again = twice.select("ngram", F.size("ngram").alias("n"), F.lit(0).cast("bigint").alias("occurrences"), F.lit(1).cast("bigint").alias("repeats"))
    both = occurrences.unionByName(again).groupBy("ngram", "n").agg(F.sum("occurrences").alias("occurrences"), F.sum("repeats").alias("repeats"))
    return both.select("ngram", "n", "occurrences", (F.col("occurrences") - F.col("repeats")).alias("n_records"))


def with_mark(counts: DataFrame, n_records: int) -> DataFrame:
    """``mark``: ``rare``, ``common`` or null; what is both is rare."""
    held = F.col("n_records")
    return counts.withColumn("mark", F.when(held < RARE_RECORDS, "rare").when(held * 100 > F.lit(n_records) * COMMON_PERCENT, "common"))
