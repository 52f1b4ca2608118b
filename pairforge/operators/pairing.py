"""Pair positive with near-identical negative records inside a group: an exact similarity join, blocked, never n x m.

A pair is kept if any of three similarities reaches 0.9: fingerprint, scaffold fingerprint, text.  Each rule has its own
candidate join on a key that no such pair can miss; the union is made distinct.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.functions.similarity import lev_090, lev_similarity, popcount, tanimoto, tanimoto_090
from pairforge.schema import PAIR_COLUMNS, PAIRS, require_columns
from pairforge.storage import materialize, release

KEYS = ["dataset_name", "endpoint"]
#: Levels of a sketch.
LEVELS = 8
#: Blocks of length per factor of 10 / 9; characters that are put into sketches, and words of fingerprints that are taken apart, at a time.
FINE, SLICE, WORDS = 2, 1 << 20, 1 << 16


def sides(molecules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct positives (label 1) and negatives (label 0); other labels, null keys and null molecules are left out."""
    require_columns(molecules, [*KEYS, "smiles", "label"], "molecules")
    rows = molecules.where("dataset_name IS NOT NULL AND endpoint IS NOT NULL AND smiles IS NOT NULL")
    cols = [c for c in ("fp", "scaffold_fp") if c in molecules.columns]
    pick = lambda label, name: rows.where(F.col("label") == label).select(*KEYS, F.col("smiles").alias(f"{name}_smiles"), *[F.col(c).alias(f"{name}_{c}") for c in cols]).dropDuplicates([*KEYS, f"{name}_smiles"])
    return pick(1, "toxic"), pick(0, "nontoxic")


def _named(df: DataFrame, side: str) -> DataFrame:
    """Molecules of one side with ``id``, 64 bits that stand for group and text while candidates are looked for."""
    return df.withColumn(f"{side}_id", F.xxhash64(*KEYS, f"{side}_smiles"))


def _back(pairs: DataFrame, toxic: DataFrame, nontoxic: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Candidate ids with groups and molecules again; what only shares an id with a candidate is judged like one.  Sorted, never broadcast."""
    t = toxic.select(*[F.col(k).alias(f"__t_{k}") for k in KEYS], "toxic_id", "toxic_smiles", *[f"toxic_{c}" for c in columns or []])
    n = nontoxic.select(*KEYS, "nontoxic_id", "nontoxic_smiles", *[f"nontoxic_{c}" for c in columns or []])
    same = F.expr(" AND ".join(f"__t_{k} = {k}" for k in KEYS))
    return pairs.hint("merge").join(t, "toxic_id").hint("merge").join(n, "nontoxic_id").where(same)


def _slices(batch: pa.RecordBatch, size: pa.Array, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces that hold about ``most``, given the size of each row: this bounds the arrays made of them."""
    ends = np.cumsum(size.to_numpy(zero_copy_only=False))
    cuts = [0, *(np.nonzero(np.diff(ends // most))[0] + 1), batch.num_rows]
    return (batch.slice(x, y - x) for x, y in zip(cuts, cuts[1:]) if y > x)


def _sketches(texts: list[str]) -> np.ndarray:
    """Per text 2 x LEVELS words of 64 bits, two of them a level: a bit of level l says that more than l of the text's pairs of neighbouring
    characters fall into its class, of 128 classes."""
    flat, size = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64), np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), size)
    inner = owner[1:] == owner[:-1]
    pair, owner = (flat[:-1] * np.uint64(0x100000001B3) + flat[1:])[inner] * np.uint64(0x9E3779B97F4A7C15), owner[:-1][inner]
    pair = (pair ^ (pair >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    held = np.bincount(owner * 128 + (pair >> np.uint64(40) & np.uint64(127)).astype(np.int64), minlength=len(texts) * 128).reshape(-1, 128)
    return np.concatenate([np.packbits(held > level, axis=1, bitorder="little").view("<i8").T for level in range(LEVELS)])


def _sketched(df: DataFrame, side: str) -> DataFrame:
    """Groups and molecules of one side with their lengths and sketches, one column a word."""
    text = f"{side}_smiles"
    rows = df.select(*KEYS, text)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, pc.utf8_length(b.column(text)), SLICE):
                words = map(pa.array, _sketches(part.column(text).to_pylist()))
                yield pa.RecordBatch.from_arrays([*part.columns, pc.utf8_length(part.column(text)), *words], names=schema.names)

    schema = T.StructType([*rows.schema, T.StructField(f"{side}_length", T.IntegerType(), False), *[T.StructField(f"{side}_{i}", T.LongType(), False) for i in range(2 * LEVELS)]])
    return rows.mapInArrow(sketch, schema)


def _sketches_near() -> Column:
    """True if so few pairs of neighbouring characters differ as the edits allowed leave.

    One edit takes away two pairs at most (one if it puts a character in) and adds as many, and no class can show more missing pairs than there are.
    """
    most = F.expr("2 * (greatest(toxic_length, nontoxic_length) div 10)")
    missing = lambda a, b: reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}_{i}").bitwiseAND(F.bitwise_not(f"{b}_{i}"))) for i in range(2 * LEVELS)])
    return (missing("toxic", "nontoxic") <= most) & (missing("nontoxic", "toxic") <= most)


def length_candidates(toxic: DataFrame, nontoxic: DataFrame) -> DataFrame:
    """Pairs with a text similarity of 0.9 or more, by blocks of length.

    A molecule looks for partners in the blocks that its partners' lengths fall into, narrow ones, so that a hot group falls into many keys.  What meets
    is judged by length, then by sketches in a few machine instructions, and only what these leave by edit distance.  Sorted, never broadcast:
    Spark takes the rows for about as small as the table they come from, not counting copies and sketches.
    """
    fine = lambda n: F.floor(F.ln(F.greatest(n, F.lit(1)).cast("double")) / F.ln(F.lit(10 / 9)) * FINE).cast("int")
    t = _sketched(toxic, "toxic").withColumn("block", F.explode(F.sequence(fine(F.expr("(9 * toxic_length + 9) div 10")), fine(F.expr("10 * toxic_length div 9")))))
    n = _sketched(nontoxic, "nontoxic").withColumn("block", fine(F.col("nontoxic_length")))
    near = F.expr("abs(toxic_length - nontoxic_length) * 10 <= greatest(toxic_length, nontoxic_length)")
    met = t.hint("merge").join(n, [*KEYS, "block"]).where(near & _sketches_near())
    return met.where(lev_090(F.col("toxic_smiles"), F.col("nontoxic_smiles"))).select(*PAIR_COLUMNS)


def text_candidates(toxic: DataFrame, nontoxic: DataFrame) -> DataFrame:
    """The same pairs, without those of two empty texts.

    A join on shared pieces of text would move every negative once per substring, and pieces are common to most molecules: blocks of length
    move a row once per block, and meeting is cheap.
    """
    return length_candidates(*[df.where(f"{s}_smiles <> ''") for s, df in (("toxic", toxic), ("nontoxic", nontoxic))])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _set_bits(prints: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Of every bit that is set in some fingerprints: which of them it is in, and its number there."""
    words, size = prints.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(prints).to_numpy(zero_copy_only=False)
    at, bit = np.nonzero(np.unpackbits(words.view(np.uint8), bitorder="little").reshape(-1, 64))
    return np.repeat(np.arange(len(size)), size)[at], (np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size))[at] * 64 + bit


def _held(prints: DataFrame) -> dict[int, int]:
    """In how many fingerprints (column ``w``) each bit is set: as many entries as a fingerprint has bits, whatever the data."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, pc.list_value_length(b.column("w")), WORDS):
                held = np.bincount(_set_bits(part.column("w"))[1])
                bits = np.nonzero(held)[0]
                yield pa.RecordBatch.from_arrays([pa.array(bits, pa.int64()), pa.array(held[bits], pa.int64())], names=["bit", "n"])

    return {r["bit"]: r["n"] for r in prints.select("w").mapInArrow(count, "bit bigint, n bigint").groupBy("bit").agg(F.sum("n").alias("n")).collect()}


def _keyed(prints: DataFrame, side: str, ranks: np.ndarray) -> DataFrame:
    """``key`` of every part in which a partner may be equal, with the number of differing bits (``{side}_most``) that such a partner may have, and all
    words of the fingerprint put together by XOR (``{side}_fold``).

    Fingerprints of Tanimoto 0.9, the larger of x bits, differ in floor(2 x / 19) bits at most.  So of one part more than that at least one is the same
    in both.  Bits are dealt to the parts by their place in an order of frequency, so that each part tells about as much.
    """

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b, pc.list_value_length(b.column("w")), WORDS):
                owner, bit = _set_bits(part.column("w"))
                mark, place = _mixed(bit.astype(np.uint64)), ranks[bit]
                group, n = part.column("group").to_numpy().view(np.uint64), part.column("n").to_numpy().astype(np.int64)
                fold = np.bitwise_xor.reduceat(part.column("w").flatten().to_numpy(), np.cumsum(size := pc.list_value_length(part.column("w")).to_numpy()) - size)
                low, high = 2 * n // 19, 2 * (10 * n // 9) // 19  # of partners that are smaller or as large, and of the largest partner
                for most in range(low.min(), high.max() + 1):
                    if not len(rows := np.nonzero((low <= most) & (most <= high))[0]):
                        continue
                    new = np.full(len(n), -1)
                    new[rows] = np.arange(len(rows))
                    mine = new[owner] >= 0
                    held = np.zeros(len(rows) * (most + 1), np.uint64)
                    np.add.at(held, new[owner[mine]] * (most + 1) + place[mine] % (most + 1), mark[mine])
                    scheme = _mixed(np.arange(most + 1, dtype=np.uint64) + np.uint64(most << 32))
                    keys = _mixed(held + _mixed(group[rows][:, None] + scheme[None, :]).ravel())
                    every = np.repeat(rows, most + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), part.column("id").take(pa.array(every)), pa.array(n[every], pa.int32()), pa.array(np.full(len(every), most), pa.int32()), pa.array(fold[every])], names=["key", *[f"{side}_{c}" for c in ("id", "n", "most", "fold")]])

    return prints.select(F.xxhash64(*KEYS).alias("group"), F.col(f"{side}_id").alias("id"), F.col(f"{side}_n").alias("n"), F.col(f"{side}_w").alias("w")).mapInArrow(key, f"key bigint, {side}_id bigint, {side}_n int, {side}_most int, {side}_fold bigint")


def bit_candidates(toxic: DataFrame, nontoxic: DataFrame, column: str) -> DataFrame:
    """Pairs whose fingerprints reach 0.9, written down.

    Fingerprints are looked at once per group, however many molecules share one (a scaffold's, say).  They meet in parts that are equal
    in both, and what meets is judged where it meets, by its sizes and by words put together, in which no more bits can differ than in the
    fingerprints: only what passes (for fingerprints of one word, only pairs) is written and judged on all words, and molecules are joined to what is left.
    """
    toxic, nontoxic = [df.where(f"{s}_{column} IS NOT NULL").withColumn(f"{s}_id", F.xxhash64(*KEYS, f"{s}_{column}")) for s, df in (("toxic", toxic), ("nontoxic", nontoxic))]

    def prints(df: DataFrame, s: str) -> DataFrame:
        one = df.select(*KEYS, f"{s}_id", F.col(f"{s}_{column}").alias(f"{s}_w")).distinct()
        return one.withColumn(f"{s}_n", popcount(F.col(f"{s}_w"))).where(f"{s}_n > 0")

    t, n = materialize(prints(toxic, "toxic"), "prints"), materialize(prints(nontoxic, "nontoxic"), "prints")
    held = _held(t.select(F.col("toxic_w").alias("w")).unionByName(n.select(F.col("nontoxic_w").alias("w"))))
    if not held:
        release(t, n)
        return toxic.sparkSession.createDataFrame([], PAIRS)
    ranks = np.zeros(max(held) + 1, np.int64)
    ranks[sorted(held, key=lambda b: (held[b], b))] = np.arange(len(held))
    near = F.expr("10 * least(toxic_n, nontoxic_n) >= 9 * greatest(toxic_n, nontoxic_n) AND toxic_most = nontoxic_most AND toxic_most = 2 * greatest(toxic_n, nontoxic_n) div 19 AND 19 * bit_count(toxic_fold ^ nontoxic_fold) <= toxic_n + nontoxic_n")
    # Sorted, never broadcast: Spark takes the keys for about as small as the table of fingerprints they come from.
    met = _keyed(t, "toxic", ranks).hint("merge").join(_keyed(n, "nontoxic", ranks), "key").where(near).select("toxic_id", "nontoxic_id").distinct()
    judged = met.hint("merge").join(t.select("toxic_id", "toxic_w"), "toxic_id").hint("merge").join(n.select("nontoxic_id", "nontoxic_w"), "nontoxic_id").where(tanimoto_090(F.col("toxic_w"), F.col("nontoxic_w")))
    out = _back(judged.select("toxic_id", "nontoxic_id", "toxic_w", "nontoxic_w"), toxic, nontoxic, [column])
    found = materialize(out.where(F.expr(f"toxic_w = toxic_{column} AND nontoxic_w = nontoxic_{column}")).select(*PAIR_COLUMNS), "found")
    release(t, n)
    return found


def pair_molecules(molecules: DataFrame, compat: bool = False, by_length: bool = False) -> DataFrame:
    """Distinct pairs (``dataset_name``, ``endpoint``, ``toxic_smiles``, ``nontoxic_smiles``) of a positive and a negative
    molecule of one group for which any rule holds.

    Fingerprint rules apply where the columns ``fp`` and ``scaffold_fp`` are there and not null.  ``compat`` drops groups in
    which no negative has a fingerprint.  Groups with one label only and an empty table give no pairs.  With several rules, the sides and the
    pairs of each rule are written down, so that the driver never holds a plan of all rules.
    """
    toxic, nontoxic = sides(molecules)
    if compat and "fp" in molecules.columns:
        usable = nontoxic.where("nontoxic_fp IS NOT NULL").select(*KEYS).distinct()
        toxic = toxic.join(usable, KEYS, "left_semi")
    by_text, columns = length_candidates if by_length else text_candidates, [c for c in ("fp", "scaffold_fp") if c in molecules.columns]
    if not columns:
        return by_text(toxic, nontoxic).dropDuplicates()
    toxic, nontoxic = materialize(toxic, "toxic"), materialize(nontoxic, "nontoxic")
    out = materialize(by_text(toxic, nontoxic), "found")
    for column in columns:
        out = out.unionByName(bit_candidates(toxic, nontoxic, column))
    release(toxic, nontoxic)
    return out.dropDuplicates()


def with_scores(pairs: DataFrame, molecules: DataFrame) -> DataFrame:
    """Pairs with ``text_similarity`` and, where ``molecules`` has fingerprints, ``fp_similarity`` and ``scaffold_fp_similarity`` (null where one is
    missing): the scores themselves, for the sink of scored pairs.  Pairs, then the fingerprints of their molecules are written down, so that neither what
    finds pairs nor the other molecules lie on disk beside the scores."""
    columns = [c for c in ("fp", "scaffold_fp") if c in molecules.columns]
    if columns:
        pairs = materialize(pairs, "pairs")
        named = pairs.select(F.col("toxic_smiles").alias("smiles")).union(pairs.select("nontoxic_smiles")).distinct()
        paired = molecules.select("smiles", *columns).join(named, "smiles", "left_semi")
        one = materialize(paired.groupBy("smiles").agg(*[F.first(c, True).alias(c) for c in columns]), "prints")
    out = pairs.withColumn("text_similarity", lev_similarity(F.col("toxic_smiles"), F.col("nontoxic_smiles")))
    if columns:
        for s in ("toxic", "nontoxic"):
            out = out.join(one.select(F.col("smiles").alias(f"{s}_smiles"), *[F.col(c).alias(f"__{s}_{c}") for c in columns]), f"{s}_smiles", "left")
        out = out.withColumns({f"{c}_similarity": tanimoto(F.col(f"__toxic_{c}"), F.col(f"__nontoxic_{c}")) for c in columns}).drop(*[f"__{s}_{c}" for s in ("toxic", "nontoxic") for c in columns])
    return out
