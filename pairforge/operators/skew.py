"""Figures for every key when a few keys hold most rows (problem 4).

Nothing here gathers the values of a key: rows meet only as mergeable counts, so a hot key costs what its number of
distinct bins costs.  Exact quantiles come from histograms that are refined until each wanted rank is resolved.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairforge.storage import materialize, release

#: A state table of at most this many rows is broadcast; beyond it the join is salted.
BROADCAST_ROWS = 50_000
SALTS = 32


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def _with_state(rows: DataFrame, state: DataFrame, keys: list[str], n_state: int) -> DataFrame:
    """Rows joined to the open intervals of their key: broadcast if small, else replicated over salts."""
    if n_state <= BROADCAST_ROWS:
        return rows.alias("r").join(F.broadcast(state.alias("s")), _same("r", "s", keys))
    salted = state.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = rows.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return spread.alias("r").join(salted.alias("s"), _same("r", "s", keys) & (F.col("r.salt") == F.col("s.salt")))


def _part(bins: int, by_size: bool) -> Column:
    """The bin of ``v`` in its interval: equal parts of the values, or of their magnitudes (signed logarithms), so that
    neither evenly spread nor heavy-tailed values need many rounds.  Both keep the order; infinities stand at the ends;
    where an interval has no measurable width its least value is set apart."""

    def place(c: str) -> Column:
        x = F.greatest(F.lit(-1.7e308), F.least(F.lit(1.7e308), F.col(c)))
        return F.signum(x) * (F.ln(F.abs(x) + 5e-324) + 745) if by_size else x / 2

    width = place("hi") - place("lo")
    inside = F.floor((place("v") - place("lo")) / F.when(width > 0, width) * bins)
    return F.when(width > 0, F.greatest(F.lit(0), F.least(F.lit(bins - 1), inside))).when(F.col("v") == F.col("lo"), 0).otherwise(1).cast("int")


def _coarse(v: Column) -> Column:
    """A bin of the first histogram, the same for all keys: the sign and eighths of a power of two of the magnitude, so at
    most some 34,000 bins whatever the values.  It keeps the order; infinities share a bin with the greatest values."""
    size = F.floor(F.log2(F.least(F.abs(v), F.lit(1.7e308))) * 8) + 9000
    return (F.signum(v) * F.when(v == 0, 0).otherwise(size)).cast("int")


def key_ranks(df: DataFrame, keys: list[str], value: Column, wanted: list[Column], bins: int = 256) -> DataFrame:
    """Per key: ``n_rows``, ``n_values``, ``v_min``, ``v_max`` and ``q`` – the exact values of the ``wanted`` ranks (columns
    made of ``n_values``, from 1).

    All figures come from histograms whose counts are mergeable and combined before the shuffle.  The first has the same
    bins for all keys and one more for missing values; its sums are the row counts, and it opens an interval for each rank.  Round by round each open
    interval of a key is cut into ``bins`` parts, by value and by magnitude in turn; per part only count, least and
    greatest value are kept, and the part that holds the rank becomes the next interval,
    until it holds one value.  Null and NaN values count as rows but not as values; a key without values has null ``q``; null keys
    form a group of their own.  An empty table gives an empty result.  Other columns of ``df`` are not read.
    """
    v = value.cast("double")
    rows = df.select(*keys, F.when(~F.isnan(v), v).alias("v"))
    first = materialize(rows.groupBy(*keys, _coarse(F.col("v")).alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")), "histogram")
    totals = first.groupBy(*keys).agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(F.col("part").isNotNull(), F.col("n"))), F.lit(0)).alias("n_values"), F.min("least").alias("v_min"), F.max("most").alias("v_max"))
    totals = materialize(totals, "totals")
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), w.cast("bigint").alias("rank")) for i, w in enumerate(wanted)]))
    ranks = totals.where("n_values > 0").select(*keys, asked.alias("w")).select(*keys, "w.*")
    counts = first.where("part IS NOT NULL").withColumn("upto", F.sum("n").over(W.partitionBy(*keys).orderBy("part")))
    opened = ranks.alias("t").join(counts.alias("c"), _same("t", "c", keys) & F.expr("t.rank <= c.upto AND t.rank > c.upto - c.n"))
    inside_of = [*[F.col(f"t.{k}").alias(k) for k in keys], "t.i", F.expr("t.rank - (c.upto - c.n)").alias("rank"), F.col("c.least").alias("lo"), F.col("c.most").alias("hi")]
    state, done = materialize(opened.select(*inside_of), "ranks"), []
    release(first)
    values = rows.where("v IS NOT NULL")
    by_size = False
    while True:
        done.append(state.where("lo = hi").select(*keys, "i", F.col("lo").alias("q")))
        todo = state.where("lo < hi")
        spans = materialize(todo.select(*keys, "lo", "hi").distinct(), "spans")
        n_spans = spans.count()
        if not n_spans:
            release(spans)
            break
        inside = _with_state(values, spans, keys, n_spans).where("v >= lo AND v <= hi")
        counts = inside.select(*[F.col(f"r.{k}").alias(k) for k in keys], "lo", "hi", _part(bins, by_size).alias("part"), "v").groupBy(*keys, "lo", "hi", "part").agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        counts = counts.withColumn("upto", F.sum("n").over(W.partitionBy(*keys, "lo", "hi").orderBy("part")))
        hit = todo.alias("t").join(counts.alias("c"), _same("t", "c", keys) & F.expr("t.lo = c.lo AND t.hi = c.hi AND t.rank <= c.upto AND t.rank > c.upto - c.n"))
        after = materialize(hit.select(*inside_of), "ranks")
        release(spans)
        state, by_size = after, not by_size
    resolved = reduce(DataFrame.unionByName, done).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))
    return totals.alias("t").join(resolved.alias("d"), _same("t", "d", keys), "left").select(*[F.col(f"t.{k}").alias(k) for k in keys], "n_rows", "n_values", "v_min", "v_max", "q")


def key_histogram_quantiles(df: DataFrame, keys: list[str], value: Column, quantiles: list[float], bins: int = 256) -> DataFrame:
    """``key_ranks`` of quantiles: p is the value of rank ``max(1, ceil(p n))`` among the values."""
    return key_ranks(df, keys, value, [F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n_values"))) for p in quantiles], bins)


def key_interpolated(df: DataFrame, keys: list[str], value: Column, quantiles: list[float], bins: int = 256) -> DataFrame:
    """The same with ``q`` interpolated between the two ranks next to p (n - 1), as ``percentile`` does; no state holds all distinct
    values of a key."""
    at = [F.lit(float(p)) * (F.col("n_values") - 1) for p in quantiles]
    ranked = key_ranks(df, keys, value, [x for a in at for x in (F.floor(a) + 1, F.ceil(a) + 1)], bins)

    def between(i: int, a: Column) -> Column:
        lo, hi = F.get("q", F.lit(2 * i)), F.get("q", F.lit(2 * i + 1))
        return F.when(lo == hi, lo).otherwise((F.ceil(a) - a) * lo + (a - F.floor(a)) * hi)

    return ranked.withColumn("q", F.when(F.col("q").isNotNull(), F.array(*[between(i, a) for i, a in enumerate(at)])))


def hot_keys(figures: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """The keys that hold at least ``percent`` % of all rows, from the row counts of the histograms; compared in integers."""
    total = figures.agg(F.sum("n_rows")).first()[0] or 0
    return figures.where(F.col("n_rows") * 100 >= F.lit(total) * percent).select(*keys)


def distinct_per_key(df: DataFrame, keys: list[str], value: Column, n_distinct: str, n_all: str) -> DataFrame:
    """Per key the number of distinct and of all non-null values, in two steps: the first shuffle is on key and value,
    so a hot key is spread over all tasks; the second moves one row per key and task."""
    return df.select(*keys, value.alias("v")).where("v IS NOT NULL").groupBy(*keys, "v").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.count("*").alias(n_distinct), F.sum("n").alias(n_all))


def key_figures(df: DataFrame, keys: list[str], molecule: Column, fragments: Column, value: Column, quantiles: list[float]) -> DataFrame:
    """One row per key: rows, distinct molecules, fragment occurrences, distinct fragments, exact quantiles of ``value``.

    Null molecules are not counted as a molecule; null or empty fragment arrays hold nothing.
    """
    base = key_histogram_quantiles(df, keys, value, quantiles)
    mols = distinct_per_key(df, keys, molecule, "n_molecules", "n_with_molecule")
    frags = distinct_per_key(df.select(*keys, F.explode(fragments).alias("f")), keys, F.col("f"), "n_distinct_fragments", "n_fragments")
    out = base.alias("a").join(mols.alias("m"), _same("a", "m", keys), "left").join(frags.alias("f"), _same("a", "f", keys), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in ("n_molecules", "n_fragments", "n_distinct_fragments")]
    return out.select(*[F.col(f"a.{k}").alias(k) for k in keys], "n_rows", *zero, *[F.get("q", F.lit(i)).alias(f"q{round(100 * p):02d}") for i, p in enumerate(quantiles)])
