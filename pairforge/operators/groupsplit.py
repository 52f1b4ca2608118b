"""Split whole groups into train and test, smallest groups first."""

from __future__ import annotations

import random
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairforge.operators.lookup import lookup
from pairforge.sources.files import ordered_ids
from pairforge.storage import materialize


def smallest_first_split(df: DataFrame, row_id: str, group: Column, test_share: float = 0.1) -> DataFrame:
    """``df`` with ``split``: groups are visited by size, then by first row, and go to test while the running total stays
    within ``test_share`` of all rows.  Rows with a null group go to train but count as rows; an empty text is a group.

    Sizes do not decrease, so once one group misses no later one fits and the running sum of sizes decides.  It is taken
    in two levels: over the distinct sizes (at most sqrt(2 N) of them), then inside the one size that straddles the
    budget, whose groups are numbered by range.
    """
    rows = df.withColumn("__g", group)
    groups = materialize(rows.where("__g IS NOT NULL").groupBy("__g").agg(F.count("*").alias("n"), F.min(row_id).alias("first")), "groups")
    budget = test_share * df.count()
    whole, room, edge = 0, budget, None
    for r in groups.groupBy("n").agg(F.count("*").alias("k")).orderBy("n").toLocalIterator():
        if r["n"] * r["k"] > room:
            edge = r["n"]
            break
        whole, room = r["n"], room - r["n"] * r["k"]
    chosen = groups.where(F.col("n") <= whole).select("__g", "n")
    if edge is not None and room >= edge:
        last = ordered_ids(groups.where(F.col("n") == edge), ["first"], "__rank").where(F.col("__rank") < int(room // edge)).select("__g", "n")
        chosen = chosen.unionByName(last)
    marked = materialize(groups.join(chosen.select("__g", F.lit("test").alias("s")), "__g", "left").select("__g", "n", F.coalesce("s", F.lit("train")).alias("split")), "split")
    known = lookup(rows.where("__g IS NOT NULL").drop("split"), marked, "__g", "n").drop("__g", "n")
    return known.unionByName(rows.where("__g IS NULL").drop("__g", "split").withColumn("split", F.lit("train")))


def window_split(df: DataFrame, row_id: str, group: Column, test_share: float = 0.1) -> DataFrame:
    """The same as a running sum in one window: for small tables, and to check the other against."""
    rows = df.withColumn("__g", group)
    groups = rows.where("__g IS NOT NULL").groupBy("__g").agg(F.count("*").alias("n"), F.min(row_id).alias("first"))
    upto = F.sum("n").over(W.orderBy("n", "first").rowsBetween(W.unboundedPreceding, W.currentRow))
    test = groups.withColumn("upto", upto).where(F.col("upto") <= test_share * df.count()).select("__g", F.lit("test").alias("split"))
    return rows.drop("split").join(test, "__g", "left").withColumn("split", F.coalesce("split", F.lit("train"))).drop("__g")


def seeded_permutation(df: DataFrame, order_by: str, seed: int | None) -> DataFrame:
    """``df`` with a new ``id``: positions 0.. in ``order_by`` order, shuffled as Python's generator with this seed shuffles a
    list; unchanged without a seed.

    That shuffle is one sequence of draws, so one task makes it, as a packed array of 8 bytes a row which it hands on in
    batches: ``df`` should be the rows of one file.
    """
    if seed is None:
        return df
    n = df.count()

    def shuffled(batches):
        for _ in batches:
            places = array("q", range(n))
            random.Random(seed).shuffle(places)
            for at in range(0, n, 1 << 16):
                part = places[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(range(at, at + len(part)), pa.int64())], names=["__p", "__id"])

    table = df.sparkSession.range(1).repartition(1).mapInArrow(shuffled, "__p long, __id long")
    return ordered_ids(df, [order_by], "__p").join(table, "__p").withColumn("id", F.col("__id")).drop("__p", "__id")
