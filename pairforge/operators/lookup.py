"""Join rows to one value per key although a key may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more rows than this is hot.  Of N rows at most N / HOT_ROWS keys can be, which bounds the broadcast.
HOT_ROWS = 100_000
BROADCAST_ROWS = 100_000


def lookup(rows: DataFrame, groups: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (``inner`` or ``left``) to ``groups`` (one row per ``key``, with its number of rows in ``n``; read twice).

    Rows of hot keys find their group by broadcast and stay where they are; all others are shuffled.  If more than
    BROADCAST_ROWS keys are hot, all are shuffled and skewed partitions are left to adaptive execution.
    """
    hot = groups.where(F.col(n) > HOT_ROWS)
    n_hot = hot.count()
    if not 0 < n_hot <= BROADCAST_ROWS:
        return rows.join(groups, key, how)
    near = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.col(n) <= HOT_ROWS), key, how)
    return near.unionByName(rest)


def with_counts(rows: DataFrame, groups: DataFrame, key: str, n: str = "__n") -> DataFrame:
    """``groups`` with the number of ``rows`` of each key, for ``lookup``; combined before the shuffle."""
    return groups.join(rows.groupBy(key).agg(F.count("*").alias(n)), key)
