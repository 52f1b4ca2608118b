"""Mix sources to target weights (problem 7).

Sizes are tokens of the WordPunct tokenizer.  The order of the mixture comes from Pfair scheduling: block i of a source
of weight w is released at floor((i - 1) / w) and due at ceil(i / w), and the earliest deadline goes first.  A block is a
number of tokens that does not depend on the data, so the schedule grows with the mixture; it is made in frames, each on its own.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pairforge.storage import materialize

WORD_PUNCT = r"\w+|[^\w\s]+"
#: Tokens in a block.
BLOCK_TOKENS = 1024
#: Slots that one task schedules on its own, at least.
FRAME = 1 << 16
#: Records per bucket of the running totals.
BUCKET = 50_000


def token_counts(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """``doc_id``, ``source``, ``tokens``; a null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(WORD_PUNCT).findall
        for b in batches:
            sizes = [len(find(x)) if x else 0 for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, source string, tokens bigint")


@dataclass
class Share:
    source: str
    target_share: float
    max_repeats: int
    tokens: int
    limited: bool
    quota: int


def shares(counts: DataFrame, weights: DataFrame) -> list[Share]:
    """The token quota of every weighted source, one entry each.

    The mixture aims at as many tokens as the documents of all weighted sources have.  A source whose tokens times its
    repeats are fewer than its share of that is ``limited`` and gives all it may.  Sources without documents count 0
    tokens; null or repeated sources in ``weights`` are dropped or taken once (least share).
    """
    per_source = counts.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    weighted = weights.where("source IS NOT NULL").groupBy("source").agg(F.min_by(F.struct("target_share", "max_repeats"), F.struct("target_share", "max_repeats")).alias("w"))
    rows = weighted.join(per_source, "source", "left").select("source", "w.*", F.coalesce("tokens", F.lit(0)).alias("tokens")).collect()
    total = sum(r["tokens"] for r in rows)
    out = []
    for r in sorted(rows, key=lambda r: r["source"]):
        share, repeats = r["target_share"] or 0.0, max(0, r["max_repeats"] or 0)
        limited = r["tokens"] * repeats < share * total
        out.append(Share(r["source"], share, repeats, r["tokens"], limited, r["tokens"] * repeats if limited else int(share * total)))
    return out


def _advance(blocks: list[int], done: list[int], start: int, stop: int, last: list[int] | None = None) -> list[tuple[int, int]]:
    """Slots ``start`` to ``stop`` by earliest deadline first among the released blocks: (source, block) for each; ``done`` is brought up
    to date.  With ``last``, every source ends with so many blocks done."""
    total = sum(blocks)
    waiting, ready, out = [], [], []

    def queue(s: int) -> None:
        i = done[s] + 1
        if i <= (blocks if last is None else last)[s]:
            heapq.heappush(waiting, (max(start, (i - 1) * total // blocks[s]), s))

    for s in range(len(blocks)):
        queue(s)
    for now in range(start, stop):
        while waiting and waiting[0][0] <= now:
            s = heapq.heappop(waiting)[1]
            due = -(-(done[s] + 1) * total // blocks[s])
            heapq.heappush(ready, (due if last is None else min(due, stop), s))
        s = heapq.heappop(ready)[1]
        out.append((s, done[s]))
        done[s] += 1
        queue(s)
    return out


def longest_window(blocks: list[int]) -> int:
    """No window from release to deadline is longer."""
    return -(-sum(blocks) // min(blocks)) + 2


def done_before(blocks: list[int], slot: int) -> list[int]:
    """How many blocks of each source stand before ``slot``: within one of its share, and such that frames cut there can be kept.

    The schedule is begun a longest window earlier, where each source has its share rounded down or up: up where the next
    deadline is earliest, from which every later deadline can be met.  Blocks still open at ``slot`` are then released after the
    beginning, so that every earlier release can be kept as well.
    """
    total, start = sum(blocks), max(0, slot - longest_window(blocks))
    done = [b * start // total for b in blocks]
    early = sorted((-(-(d + 1) * total // b), s) for s, (b, d) in enumerate(zip(blocks, done)) if b * start % total)
    for _, s in early[: start - sum(done)]:
        done[s] += 1
    _advance(blocks, done, start, slot)
    return done


def frame_of(blocks: list[int], start: int, stop: int) -> list[tuple[int, int]]:
    """(source, block number) of the slots from ``start`` to ``stop``; frames fit together whatever their borders."""
    last = blocks if stop == sum(blocks) else done_before(blocks, stop)
    return _advance(blocks, done_before(blocks, start), start, stop, last)


def pfair_schedule(spark: SparkSession, quotas: dict[str, int], block: int = BLOCK_TOKENS, frame: int = FRAME) -> DataFrame:
    """``source``, ``block`` (from 0), ``slot`` (from 0): every source has as many blocks as its quota of tokens fills, the last in part, and is
    never a whole block away from its share of the blocks so far."""
    names = sorted(s for s, q in quotas.items() if q > 0)
    blocks = [-(-quotas[s] // block) for s in names]
    total = sum(blocks)
    frame = max(frame, longest_window(blocks)) if blocks else frame

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in b.column(0).to_pylist():
                made = frame_of(blocks, k * frame, min(total, (k + 1) * frame))
                for at in range(0, len(made), 1 << 16):
                    part = made[at : at + (1 << 16)]
                    first = k * frame + at
                    yield pa.RecordBatch.from_arrays([pa.array([names[s] for s, _ in part], pa.string()), pa.array([n for _, n in part], pa.int64()), pa.array(range(first, first + len(part)), pa.int64())], names=["source", "block", "slot"])

    n_frames = -(-total // frame)
    return spark.range(0, n_frames, 1, max(1, min(n_frames, 10_000))).mapInArrow(run, "source string, block bigint, slot bigint")


def running_totals(counts: DataFrame) -> DataFrame:
    """``before``: tokens of the same source that come earlier in a fixed pseudo-random order of its records.

    Two levels: totals per source and bucket are summed over buckets, then inside each bucket, so that no window holds
    a whole source.
    """
    n = counts.count()
    rows = counts.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // BUCKET))))
    order = W.partitionBy("source").orderBy("bucket")
    base = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("sum")).select("source", "bucket", (F.sum("sum").over(order) - F.col("sum")).alias("base"))
    inside = W.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    return rows.join(base, ["source", "bucket"]).withColumn("before", F.col("base") + F.sum("tokens").over(inside) - F.col("tokens")).drop("bucket", "base")


def mixture(docs: DataFrame, doc_id: str, text: str, source: str, weights: DataFrame, block: int = BLOCK_TOKENS, frame: int = FRAME) -> tuple[list[Share], DataFrame]:
    """The shares, and every use of a record: ``doc_id``, ``copy`` (from 0), ``source``, ``tokens``, ``slot`` and ``place`` (tokens of
    the slot's block before it); by slot and place the uses stand in the order of the mixture.

    Whole passes over a source come first, then the records of one more pass whose running total still fits, so a
    source misses its quota by less than one record.  Records go with the block in which they begin.  Records without tokens are
    used once per whole pass.  Null and unweighted sources take no part; with no tokens at all the result is empty.
    """
    spark = docs.sparkSession
    counts = materialize(token_counts(docs.join(weights.select(F.col("source").alias(source)).distinct(), source, "left_semi"), doc_id, text, source), "tokens")
    found = shares(counts, weights)
    quota = spark.createDataFrame([(s.source, s.tokens, s.quota) for s in found if s.tokens] or [], "source string, all_tokens bigint, quota bigint")
    rows = running_totals(counts).join(F.broadcast(quota), "source")  # one row per weighted source
    whole = F.expr("quota div all_tokens")
    fits = F.expr("before + tokens <= quota % all_tokens AND tokens > 0").cast("bigint")
    uses = rows.withColumn("copies", whole + fits).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    uses = uses.withColumn("start", F.expr("copy * all_tokens + before"))
    # A record without tokens at the very end of its source can start past the last block.
    uses = uses.withColumn("block", F.least(F.expr(f"start div {block}"), F.expr(f"(quota + {block - 1}) div {block} - 1"))).where("quota > 0")
    plan = pfair_schedule(spark, {s.source: s.quota for s in found if s.tokens}, block, frame)
    placed = uses.join(plan, ["source", "block"])
    return found, placed.select("doc_id", "copy", "source", "tokens", "slot", (F.col("start") - F.col("block") * block).alias("place"))


def exhausted(shares: list[Share], uses: DataFrame) -> DataFrame:
    """``source`` of the sources that stay under their share although every record of theirs is used as often as it may be."""
    used = uses.groupBy("source").agg(F.sum("tokens").alias("used"))
    asked = uses.sparkSession.createDataFrame([(s.source, s.tokens * s.max_repeats) for s in shares if s.limited] or [], "source string, most bigint")
    return asked.join(used, "source", "left").where(F.coalesce("used", F.lit(0)) == F.col("most")).select("source")
