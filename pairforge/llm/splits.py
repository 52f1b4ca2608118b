"""Splits that keep related records together (problem 2).

Records are linked by the molecule, the canonical form and the scaffold they stand for.  Components come from parallel
hooking and shortcutting over a parent table; a subset-sum bitset over the multiplicities of component sizes picks the
components of each split so that its total is as close to its share as can be.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from math import gcd, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairforge.operators.lookup import lookup, with_counts
from pairforge.storage import materialize, release

PROPORTIONS = {"test": 0.1, "valid": 0.1, "train": 0.8}
#: Components per bucket when they are numbered inside their size.
BUCKET = 50_000


def digest(c: Column) -> Column:
    """128 bits that stand for a text in joins, so that long texts are not shuffled."""
    return F.unhex(F.md5(c))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``root`` (least node of its component) of every node in ``edges`` (``a``, ``b`` bigint).

    Each round hooks every root that has a smaller neighbour onto the smallest of them, shortcuts the parent table
    until all chains are flat, and carries the edges over to the roots, dropping loops and repeats; it ends when no
    edge is left.  Rounds are cut by tables in the shared folder.  Loops give a component of one; nulls are dropped.
    """
    whole = edges.where("a IS NOT NULL AND b IS NOT NULL")
    parents = materialize(whole.select(F.col("a").alias("node")).union(whole.select("b")).distinct().withColumn("root", F.col("node")), "parents")
    live, first = materialize(_facing(whole), "edges"), True
    while not live.isEmpty():
        hooks = materialize(live.groupBy("a").agg(F.min("b").alias("root"), F.count("*").alias("n_a")).withColumnRenamed("a", "node"), "hooks")
        # Chains only grow where a hooked node is hooked onto; in stars there is none.
        while not hooks.join(hooks.select(F.col("node").alias("root")), "root", "left_semi").isEmpty():
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            # Many nodes may hang on one root.
            jumped = materialize(lookup(hooks, with_counts(hooks, up, "root"), "root", "__n", "left").select("node", F.coalesce("above", "root").alias("root"), "n_a"), "hooks")
            release(hooks)
            hooks = jumped
        over = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
        # In the first round every node is its own root; later a root may stand for a large part of all nodes.
        counted = over.withColumn("__n", F.lit(1)) if first else materialize(with_counts(parents, over, "root"), "counted")
        nearer = materialize(lookup(parents, counted, "root", "__n", "left").select("node", F.coalesce("above", "root").alias("root")), "parents")
        ends = hooks.select(F.col("node").alias("a"), F.col("root").alias("ra"), "n_a")
        half = lookup(live, ends, "a", "n_a", "left").select(F.coalesce("ra", "a").alias("a"), "b")
        ends = hooks.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = lookup(half, materialize(with_counts(live, ends, "b"), "ends"), "b", "__n", "left").select("a", F.coalesce("rb", "b").alias("b"))
        fewer = materialize(_facing(moved), "edges")
        release(parents, live, hooks)
        parents, live, first = nearer, fewer, False
    release(live)
    return parents


def _facing(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def molecules(rows: DataFrame, row_id: str, text: str, profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows as ``row_id``, ``m`` (the digest of the trimmed molecule), and one row per molecule: ``m``, ``id`` (its least
    row), ``n`` (its rows), ``c`` and ``s`` (digests of canonical form and scaffold, null if unknown)."""
    held = rows.select(F.col(row_id).alias("row_id"), digest(F.nullif(F.trim(F.col(text)), F.lit(""))).alias("m"), *[c for c in rows.columns if c == "split"])
    known = profile.select(digest(F.col("smiles")).alias("m"), digest(F.col("canonical")).alias("c"), digest(F.col("scaffold")).alias("s")).groupBy("m").agg(F.min("c").alias("c"), F.min("s").alias("s"))
    mols = held.where("m IS NOT NULL").groupBy("m").agg(F.min("row_id").alias("id"), F.count("*").alias("n"))
    return held, materialize(mols.join(known, "m", "left"), "molecules")


def star_edges(mols: DataFrame, keys: Column) -> DataFrame:
    """Edges from each molecule to the least one with which it shares one of ``keys`` (an array)."""
    keyed = mols.select("id", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"))
    groups = materialize(keyed.groupBy("key").agg(F.min("id").alias("b"), F.count("*").alias("n_key")), "keys")
    return lookup(keyed, groups, "key", "n_key").select(F.col("id").alias("a"), "b")


def straddling(rows: DataFrame, row_id: str, text: str, profile: DataFrame) -> DataFrame:
    """``row_id`` of the rows whose delivered ``split`` is not null and whose entity – scaffold, else canonical form, else
    the trimmed molecule – has rows in two or more splits.  Rows without a molecule have no entity."""
    held, mols = molecules(rows, row_id, text, profile)
    roots = components(star_edges(mols, F.array(F.coalesce("s", "c", "m"))))
    of = materialize(mols.join(roots, F.col("id") == F.col("node")).select("m", "root", "n"), "roots")
    placed = lookup(held.where("m IS NOT NULL AND split IS NOT NULL"), of, "m", "n").select("row_id", "split", "root")
    per = materialize(placed.groupBy("root").agg(F.min("split").alias("least"), F.max("split").alias("most"), F.count("*").alias("n_rows")), "splits")
    return lookup(placed, per.where("least <> most"), "root", "n_rows").select(F.col("row_id").alias(row_id))


def least_miss(sizes: Iterable[int], target: int) -> int:
    """No total of components of these sizes is nearer to ``target``: all are multiples of the greatest common divisor."""
    step = gcd(*sizes)
    return min(target % step, -target % step) if step else target


def closest(sizes: Mapping[int, int], target: int) -> dict[int, int]:
    """How many components of each size to take so that their total is as close to ``target`` as possible.

    The set of reachable totals is one bitset, in steps of the sizes' greatest common divisor; each size enters with its
    multiplicity in doubling bundles, until no total can be closer.  Of the earlier bitsets, which tell what a total is made of, only
    every so many-th is kept (the square root of their number); those between are made again.  A tie goes to the smaller total.
    """
    usable = {s: m for s, m in sizes.items() if m > 0 and s <= 2 * target}
    step = gcd(*usable)
    if not step:
        return {}
    bits = 2 * target // step + 1
    limit = (1 << bits) - 1
    bundles = []
    for size in sorted(usable, reverse=True):
        left, bundle = usable[size], 1
        while left:
            take = min(bundle, left)
            if size * take < bits * step:
                bundles.append((size, take))
            left, bundle = left - take, bundle * 2
    grow = lambda reach, k: reach | (reach << (bundles[k][0] * bundles[k][1] // step)) & limit
    best = min((target // step, -(-target // step)), key=lambda t: (abs(t * step - target), t))
    every = isqrt(len(bundles)) + 1
    kept, reach, n = [], 1, 0
    while n < len(bundles) and not reach >> best & 1:
        if n % every == 0:
            kept.append(reach)
        reach, n = grow(reach, n), n + 1
    # The nearest reachable totals on both sides of the target.
    below = (reach & ((1 << target // step + 1) - 1)).bit_length() - 1
    above = reach >> target // step + 1
    options = [below] + ([target // step + (above & -above).bit_length()] if above else [])
    total = min(options, key=lambda t: (abs(t * step - target), t))
    chosen: dict[int, int] = {}
    for block in range(len(kept) - 1, -1, -1):
        part = [kept[block]]
        for k in range(block * every, min(n, (block + 1) * every) - 1):
            part.append(grow(part[-1], k))
        for k in range(block * every + len(part) - 1, block * every - 1, -1):
            if not part[k - block * every] >> total & 1:
                size, take = bundles[k]
                chosen[size] = chosen.get(size, 0) + take
                total -= size * take // step
    return chosen


def allot(sizes: Mapping[int, int], proportions: Mapping[str, float]) -> dict[str, dict[int, int]]:
    """Components of each size for every split but the last, which gets the rest.

    A share of every size is set first, so that each split has small and large components alike; the bitset then
    settles what is left.  While that misses the target by more than it must, half of what is set is released, until nothing
    is, so that the miss is the least there can be.
    """
    total = sum(s * m for s, m in sizes.items())
    free, out = dict(sizes), {}
    for name in list(proportions)[:-1]:
        target = round(total * proportions[name])
        share = {s: min(int(m * proportions[name]), free[s]) for s, m in sizes.items()}
        found, miss, bound = {}, None, least_miss([s for s, m in free.items() if m], target)
        while True:
            more = closest({s: free[s] - share[s] for s in free if free[s] > share[s]}, max(0, target - sum(s * k for s, k in share.items())))
            other = {s: share[s] + more.get(s, 0) for s in free}
            off = abs(sum(s * k for s, k in other.items()) - target)
            if miss is None or off < miss:
                found, miss = other, off
            if miss <= bound or not any(share.values()):
                break
            share = {s: k // 2 for s, k in share.items()}
        out[name] = {s: k for s, k in found.items() if k}
        free = {s: m - out[name].get(s, 0) for s, m in free.items()}
    return out


def group_split(rows: DataFrame, row_id: str, text: str, profile: DataFrame, proportions: Mapping[str, float] = PROPORTIONS) -> DataFrame:
    """``row_id``, ``component`` (its least row), ``new_split`` for every row.

    Rows that share a molecule, a canonical form or a scaffold, directly or through others, stay together.  A row
    without a molecule is a component of its own.  Only the distinct component sizes reach the driver: for N rows at
    most sqrt(2 N) numbers.
    """
    spark = rows.sparkSession
    held, mols = molecules(rows, row_id, text, profile)
    roots = components(star_edges(mols, F.array("m", "c", "s")))
    of = materialize(mols.join(roots, F.col("id") == F.col("node")).select("m", "root", "n"), "roots")
    lone = held.where("m IS NULL").select(F.col("row_id").alias("root"), F.lit(1).cast("bigint").alias("size"))
    comps = materialize(of.groupBy("root").agg(F.sum("n").alias("size")).unionByName(lone), "components")
    sizes = {r["size"]: r["m"] for r in comps.groupBy("size").agg(F.count("*").alias("m")).collect()}
    chosen = allot(sizes, proportions)
    last = list(proportions)[-1]
    bounds, at = [], dict.fromkeys(sizes, 0)
    for name, part in chosen.items():
        for s, k in part.items():
            bounds.append((s, name, at[s], at[s] + k))
            at[s] += k
    bucket = comps.withColumn("bucket", F.pmod(F.xxhash64("root"), F.lit(max(1, sum(sizes.values()) // BUCKET))))
    over = W.partitionBy("size").orderBy("bucket")
    base = bucket.groupBy("size", "bucket").agg(F.count("*").alias("k")).select("size", "bucket", (F.sum("k").over(over) - F.col("k")).alias("base"))
    inside = W.partitionBy("size", "bucket").orderBy(F.xxhash64("root"), "root")
    numbered = bucket.join(base, ["size", "bucket"]).withColumn("rank", F.col("base") + F.row_number().over(inside) - 1)
    ranges = spark.createDataFrame(bounds or [], "size bigint, new_split string, lo bigint, hi bigint").alias("b")
    placed = numbered.alias("c").join(ranges, F.expr("c.size = b.size AND rank >= lo AND rank < hi"), "left").select("root", F.coalesce("new_split", F.lit(last)).alias("new_split"))
    placed = materialize(placed, "new")
    # A component may have a large part of all molecules.
    by_root = lookup(of, materialize(with_counts(of, placed, "root"), "counted"), "root", "__n").select("m", "n", F.col("root").alias("component"), "new_split")
    by_mol = materialize(by_root, "placed")
    with_mol = lookup(held.where("m IS NOT NULL"), by_mol, "m", "n").select("row_id", "component", "new_split")
    without = held.where("m IS NULL").select("row_id").join(placed, F.col("row_id") == F.col("root")).select("row_id", F.col("root").alias("component"), "new_split")
    return with_mol.unionByName(without).select(F.col("row_id").alias(row_id), "component", "new_split")
