"""Same or near-same records across splits (problem 5).

A weighted cosine join between two sides of texts.  A text's vector has a term for each run of content-defined chunks and
the weight of the term's rarity.  If two texts are at most k edits apart, the product of their vectors can fall short of
a vector's squared norm by at most what k edits can destroy of it; this gives each vector the least product a partner
must reach.  Inverted lists hold, rarest term first, only as much of each vector as needed for the residual norm to stay
under that product; a term that the other side lacks has maximum weight 0 there and is left out.  Sums over the lists
plus the residual prune candidates, the rest are judged by exact products and then by exact edit distance.

Entries meet by term and block of length, and a sketch of their texts is compared before anything is summed up: texts from
a small vocabulary share terms by chance, in numbers that grow with the square of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.storage import materialize, release

EDITS = 3
#: A chunk ends where the hash of two neighbouring characters falls into one of so many classes; a term is so many chunks.
CHUNK, RUN = 5, 3
#: Terms beyond the least prefix: they make the sums over the lists tell more.
EXTRA = 2
#: Cells of the rarity table.  Its size is fixed, whatever the number of terms; shared cells only blur the order.
CELL_BITS = 20
CELLS = 1 << CELL_BITS
#: Terms of the tiers for texts too short for chunk runs: plain character runs of these lengths, then deletion variants.
SHORT_RUNS = (4, 2)
#: Classes of the sketches (two words), and lengths in a block.
CLASSES, BLOCK = 128, 12
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
#: A pair of similar first texts with more pairs of second texts than this gets them from a similarity join, too.
HOT_PAIRS = 1_000
#: Rows of one text pair per salt when their pairs are made, and how many text pairs with more are broadcast at most.
HOT_ROWS, BROADCAST_ROWS = 2_000, 100_000


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


class Terms:
    """Terms of a batch of texts: ``text`` (index), ``start``, ``term`` (hash, with its number of occurrence in the text)
    and ``lost``, the most terms that one edit can destroy in each text (by weight, once weights are known)."""

    def __init__(self, texts: list[str], run: int = 0):
        codes = [np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in texts]
        self.length = np.fromiter(map(len, codes), np.int64, len(codes))
        zero = np.zeros(1, np.uint32)
        flat = np.concatenate([x for c in codes for x in (zero, c)] + [zero])
        self.begin = np.cumsum(self.length + 1) - self.length
        n = self.total = len(flat)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _ODD)]), dtype=np.uint64)
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, _INVERSE)]), dtype=np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * power, dtype=np.uint64)])
        owner = np.repeat(np.arange(len(texts)), self.length + 1)
        if run:  # character runs
            at = np.arange(n - 1)
            at = at[flat[:-1] != 0]
            who = owner[at]
            ok = at + run <= (self.begin + self.length)[who]
            s, who = at[ok], who[ok]
            e = s + run
            self.lo, self.hi = s, e - 1  # an edit inside the run destroys it
        else:  # runs of chunks
            pair = flat[:-1].astype(np.uint64) * np.uint64(0x100000001B3) + flat[1:].astype(np.uint64)
            cut = np.nonzero((_mix(pair * _ODD) % np.uint64(CHUNK) == 0) & (flat[:-1] != 0) & (flat[1:] != 0))[0] + 1
            cut = np.unique(np.concatenate([cut, self.begin, self.begin + self.length]))
            # A text's end (its closing zero) belongs to it, not to the next.
            who_of = np.searchsorted(self.begin, cut, side="right") - 1
            a = np.arange(max(0, len(cut) - RUN))
            a = a[who_of[a] == who_of[a + RUN]] if len(a) else a
            s, e, who = cut[a], cut[a + RUN], who_of[a]
            self.lo, self.hi = s - 1, e  # its borders depend on the character before and the one after
        self.who, self.start = who, s - self.begin[who]
        base = _mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(run))
        # The n-th occurrence of a term in a text is a term of its own, so that vectors have weights but no counts.
        order = np.lexsort((s, base, who))
        same = np.zeros(len(order), bool)
        same[1:] = (base[order][1:] == base[order][:-1]) & (who[order][1:] == who[order][:-1])
        where = np.arange(len(order))
        nth = where - np.maximum.accumulate(np.where(same, 0, where)) if len(order) else where
        number = np.empty(len(order), np.int64)
        number[order] = nth
        self.term = np.where(number > 0, _mix(base + number.astype(np.uint64) * _ODD), base)
        # All occurrences of a term share its cell, hence its weight.
        self.cell = (base >> np.uint64(64 - CELL_BITS)).astype(np.int64)
        # A term that occurs again may meet another occurrence of itself, so its place says nothing.
        again = same.copy()
        again[:-1] |= same[1:]
        self.start[order[again]] = -1

    def lost(self, weight: np.ndarray) -> np.ndarray:
        """Per text, the most weight of terms that one edit can destroy.  A changed or dropped character destroys the
        terms that reach over it, one put in before it no more than those."""
        diff = np.bincount(self.lo, weight, self.total + 2) - np.bincount(self.hi + 1, weight, self.total + 2)
        reach = np.rint(np.cumsum(diff)).astype(np.int64)
        if not len(self.length):
            return np.zeros(0, np.int64)
        # From the zero before a text to its last character, and the zero after it.
        return np.maximum(np.maximum.reduceat(reach[: self.total], self.begin - 1), reach[self.begin + self.length])


def parities(texts: list[str]) -> np.ndarray:
    """Per text a word of 64 bits for each half of the classes: whether an odd number of its pairs of neighbouring characters fall into
    a class.  One edit takes away two pairs at most and adds as many, so it turns at most four bits."""
    flat, size = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64), np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), size)
    inner = owner[1:] == owner[:-1]
    pair = _mix((flat[:-1] * np.uint64(0x100000001B3) + flat[1:])[inner])
    held = np.bincount(owner[:-1][inner] * CLASSES + (pair >> np.uint64(40)).astype(np.int64) % CLASSES, minlength=len(texts) * CLASSES)
    return np.packbits(held.reshape(-1, CLASSES) % 2 == 1, axis=1, bitorder="little").view("<i8").T


def _texts(batch: pa.RecordBatch) -> list[str]:
    return batch.column(batch.schema.get_field_index("text")).to_pylist()


def _slices(batches: Iterator[pa.RecordBatch], chars: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut to about ``chars`` characters, which bounds the arrays of a task."""
    for b in batches:
        lens = pc.utf8_length(b.column(b.schema.get_field_index("text"))).to_numpy(zero_copy_only=False)
        group = (np.cumsum(lens) - lens) // chars
        cuts = [0, *(np.nonzero(np.diff(group))[0] + 1), len(lens)]
        for x, y in zip(cuts, cuts[1:]):
            if y > x:
                yield b.slice(x, y - x)


def _flags(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("in_a", "in_b"))


def rarity(texts: DataFrame, run: int) -> np.ndarray:
    """How many texts of either side hold terms of each cell: an array (2, CELLS) counted over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, CELLS), np.int64)
        for b in _slices(batches):
            t, flags = Terms(_texts(b), run), _flags(b)
            for side in (0, 1):
                sums[side] += np.bincount(t.cell[flags[side][t.who]], minlength=CELLS)
        at = np.nonzero(sums.any(axis=0))[0]
        for x in range(0, len(at), 1 << 16):
            part = at[x : x + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(sums[0, part]), pa.array(sums[1, part])], names=["cell", "a", "b"])

    table = texts.mapInArrow(count, "cell int, a bigint, b bigint").groupBy("cell").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toArrow()
    out = np.zeros((2, CELLS), np.int64)
    out[:, table["cell"].to_numpy()] = [table["a"].to_numpy(), table["b"].to_numpy()]
    return out


def cell_weights(held: np.ndarray, n: int) -> np.ndarray:
    """Squared weight of the terms of each cell, an integer: 16, and up to 8 more the rarer they are.  Near to each other
    on purpose: what edits can destroy is judged by the heaviest terms they touch."""
    return 16 + np.floor(np.log2(max(1, n) / np.maximum(1, held)) / 2).clip(0, 8).astype(np.int64)


_POSTING = "term bigint, id bigint, start int, length int, weight int, last double, slack int, sketch_0 bigint, sketch_1 bigint, in_a boolean, in_b boolean, short boolean"


def postings(texts: DataFrame, run: int, edits: int, cells: np.ndarray, n: int) -> DataFrame:
    """The inverted lists' entries of every text, with what is needed to prune: the place ``last`` in the global order up
    to which a vector is in the lists, and ``slack``, the product a partner must reach inside the lists."""
    spark = texts.sparkSession
    # As large as the rarity table, whatever the data.
    shared = spark.sparkContext.broadcast((cells.sum(axis=0).clip(0, 1 << 20).astype(np.uint32), cells > 0))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, there = shared.value
        weights = cell_weights(held, n)
        for b in _slices(batches):
            ids = b.column(b.schema.get_field_index("id")).to_numpy(zero_copy_only=False)
            in_a, in_b = _flags(b)
            texts = _texts(b)
            t, sketch = Terms(texts, run), parities(texts)
            cell = t.cell
            w = weights[cell].astype(np.float64)
            who, m = t.who, len(ids)
            needed = np.bincount(who, w, m) - edits * t.lost(w)
            # The other side's maximum weight of a term is 0 if it has none in the cell.
            usable = (in_a[who] & there[1][cell]) | (in_b[who] & there[0][cell])
            who, w, term, start, cell = who[usable], w[usable], t.term[usable], t.start[usable], cell[usable]
            # Global order: rarest cell first, then by hash; as one number that double precision keeps exactly.
            place = held[cell].astype(np.float64) * 4294967296.0 + (term & np.uint64(0xFFFFFFFF)).astype(np.float64)
            order = np.lexsort((place, who))
            who, w, term, start, place = who[order], w[order], term[order], start[order], place[order]
            size = np.bincount(who, minlength=m)
            first = np.cumsum(size) - size
            run_w = np.cumsum(w)
            upto = run_w - (run_w[first[who]] - w[first[who]]) if len(w) else run_w
            reach = np.bincount(who, w, m)
            residual_before = reach[who] - (upto - w)
            # Keep a term while what is left without it could still make up the needed product, and EXTRA more.
            keep = residual_before >= needed[who]
            kept = np.bincount(who[keep], minlength=m)
            nth = np.arange(len(who)) - first[who]
            keep = nth < (kept + EXTRA)[who]
            possible = reach >= needed
            keep &= possible[who]
            mass = np.bincount(who[keep], w[keep], m)
            last = np.full(m, np.inf)
            n_kept = np.bincount(who[keep], minlength=m)
            ends = n_kept < size
            at = first + n_kept - 1
            cut = ends & (n_kept > 0)
            last[cut] = place[at[cut]]
            slack = needed - (reach - mass)
            k = np.nonzero(keep)[0]
            wk = who[k]
            cols = [term[k].view(np.int64), ids[wk], start[k].astype(np.int32), t.length[wk].astype(np.int32), w[k].astype(np.int32), last[wk], slack[wk].astype(np.int32), sketch[0][wk], sketch[1][wk], in_a[wk], in_b[wk]]
            short = np.nonzero(needed <= 0)[0]
            null = lambda kind: pa.nulls(len(short), kind)
            tail = [null(pa.int64()), pa.array(ids[short]), null(pa.int32()), pa.array(t.length[short].astype(np.int32)), null(pa.int32()), null(pa.float64()), null(pa.int32()), null(pa.int64()), null(pa.int64()), pa.array(in_a[short]), pa.array(in_b[short])]
            arrays = [pa.concat_arrays([pa.array(x), y]) for x, y in zip(cols, tail)] + [pa.array(np.arange(len(k) + len(short)) >= len(k))]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in _POSTING.split(", ")])

    return texts.mapInArrow(post, _POSTING)


def met_entries(lists: DataFrame, edits: int) -> DataFrame:
    """Entries of either side for one term, at near places of texts whose lengths and sketches allow ``edits``."""
    live = lists.where("NOT short")
    cols = ["id", "start", "length", "weight", "last", "slack", "sketch_0", "sketch_1"]
    blocks = F.explode(F.expr(f"sequence(greatest(length - {edits}, 0) div {BLOCK}, (length + {edits}) div {BLOCK})"))
    a = live.where("in_a").withColumn("block", F.expr(f"length div {BLOCK}")).select(F.xxhash64("term", "block").alias("key"), *[F.col(c).alias(f"{c}_a") for c in cols])
    b = live.where("in_b").withColumn("block", blocks).select(F.xxhash64("term", "block").alias("key"), *[F.col(c).alias(f"{c}_b") for c in cols])
    near = f"abs(length_a - length_b) <= {edits} AND (abs(start_a - start_b) <= {edits} OR start_a < 0 OR start_b < 0) AND id_a <> id_b"
    return a.join(b, "key").where(f"{near} AND bit_count(sketch_0_a ^ sketch_0_b) + bit_count(sketch_1_a ^ sketch_1_b) <= {4 * edits}")


def listed_pairs(lists: DataFrame, edits: int) -> DataFrame:
    """``a``, ``b``: the pairs that the inverted lists cannot rule out."""
    # Of the vector whose part in the lists ends first, all common terms are either in both parts or in its residual.
    need = F.when(F.col("last_a") <= F.col("last_b"), F.col("slack_a")).otherwise(F.col("slack_b"))
    sums = met_entries(lists, edits).groupBy("id_a", "id_b").agg(F.sum("weight_a").alias("got"), F.min(need).alias("need"))
    return sums.where("got >= need").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))


def deletion_pairs(texts: DataFrame, edits: int) -> DataFrame:
    """Pairs of very short texts: at most ``edits`` apart means a common variant after at most so many deletions."""

    def variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import combinations

        for b in batches:
            ids = b.column(b.schema.get_field_index("id")).to_pylist()
            rows = [(i, v) for i, x in zip(ids, _texts(b)) for v in {"".join(x[j] for j in kept) for k in range(min(edits, len(x)) + 1) for kept in combinations(range(len(x)), len(x) - k)}]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["id", "variant"])

    v = texts.select("id", "text").mapInArrow(variants, "id bigint, variant string")
    a = v.join(texts.where("in_a").select("id"), "id", "left_semi").withColumnRenamed("id", "a")
    b = v.join(texts.where("in_b").select("id"), "id", "left_semi").withColumnRenamed("id", "b")
    return a.join(b, "variant").where("a <> b").select("a", "b").distinct()


_JUDGED = "key_a binary, key_b binary, text_a string, text_b string, cosine double"


def exact_products(pairs: DataFrame, run: int, edits: int, cells: np.ndarray, n: int) -> DataFrame:
    """Exact products of the vectors of text pairs: keeps the pairs that reach what both vectors need, with the cosine."""
    shared = pairs.sparkSession.sparkContext.broadcast(cells.sum(axis=0).clip(0, 1 << 20).astype(np.uint32))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = cell_weights(shared.value, n)
        for b in batches:
            m = b.num_rows
            a, c = Terms(b.column(2).to_pylist(), run), Terms(b.column(3).to_pylist(), run)
            wa, wc = weights[a.cell].astype(np.float64), weights[c.cell].astype(np.float64)
            common = np.isin(_mix(a.term + _mix(a.who.astype(np.uint64))), _mix(c.term + _mix(c.who.astype(np.uint64))))
            dot = np.bincount(a.who[common], wa[common], m)
            na, nc = np.bincount(a.who, wa, m), np.bincount(c.who, wc, m)
            keep = pa.array((dot >= na - edits * a.lost(wa)) & (dot >= nc - edits * c.lost(wc)))
            cosine = dot / np.sqrt(np.maximum(na * nc, 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cosine)], names=[f.split()[0] for f in _JUDGED.split(", ")]).filter(keep)

    return pairs.select("key_a", "key_b", "text_a", "text_b").mapInArrow(multiply, _JUDGED)


def _named(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.where("in_a").select(F.col("id").alias("a"), F.col("key").alias("key_a"), F.col("text").alias("text_a"))
    right = texts.where("in_b").select(F.col("id").alias("b"), F.col("key").alias("key_b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b")


def similar_texts(texts: DataFrame, edits: int = EDITS) -> DataFrame:
    """``key_a``, ``key_b``, ``edits``, ``cosine`` of every pair of different texts, one of side a and one of side b, at
    most ``edits`` apart; none is missing.

    ``texts``: ``key`` (one per text, not null), ``id`` (a 64-bit hash of it), ``text``, ``in_a``, ``in_b``.  Texts that
    share an id are judged together, so nothing is lost.  A pair is found at the first tier at which one of its vectors
    must keep something; texts that can lose all of it go on to the next tier, and the last of them, of a few
    characters, to deletion variants (null cosine).
    """
    out, live = None, texts
    for run in (0, *SHORT_RUNS):
        n = live.count()
        if not n:
            break
        cells = rarity(live, run)
        lists = materialize(postings(live, run, edits, cells, n), "postings")
        found = materialize(exact_products(_named(listed_pairs(lists, edits), live), run, edits, cells, n).withColumn("edits", F.levenshtein("text_a", "text_b", edits)).where("edits >= 0").select("key_a", "key_b", "edits", "cosine"), "similar")
        out = found if out is None else out.unionByName(found)
        live = materialize(live.join(lists.where("short").select("id").distinct(), "id", "left_semi"), "short")
        release(lists)
    else:
        if live.count():
            last = _named(deletion_pairs(live, edits), live).withColumn("edits", F.levenshtein("text_a", "text_b", edits)).where("edits >= 0")
            out = out.unionByName(last.select("key_a", "key_b", "edits", F.lit(None).cast("double").alias("cosine")))
    if out is None:
        return texts.sparkSession.createDataFrame([], "key_a binary, key_b binary, edits int, cosine double")
    # Texts that can lose all of a tier may meet there and again at the next.
    return out.groupBy("key_a", "key_b").agg(F.min("edits").alias("edits"), F.max("cosine").alias("cosine"))


def _key(c: str) -> Column:
    return F.unhex(F.md5(F.col(c)))


def _distinct_texts(rows: DataFrame, key: str, text: str) -> DataFrame:
    return materialize(rows.groupBy(F.col(key).alias("key")).agg(F.first(text).alias("text"), F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b")).withColumn("id", F.xxhash64("text")), "texts")


def _with_same(similar: DataFrame, texts: DataFrame) -> DataFrame:
    same = texts.where("in_a AND in_b").select(F.col("key").alias("key_a"), F.col("key").alias("key_b"), F.lit(0).alias("edits"), F.lit(1.0).alias("cosine"))
    return similar.unionByName(same)


def overlaps(df: DataFrame, row_id: str, first: str, second: str, in_a: Column, in_b: Column, edits: int = EDITS) -> DataFrame:
    """``id_a``, ``id_b``, ``edits_1``, ``edits_2``, ``cosine``: every row of side a and row of side b whose first texts and
    whose second texts are each at most ``edits`` apart, compared without outer blanks (U+0020).

    Rows with a null or empty text take no part, nor do rows of neither side; equal rows all come out.  Texts are
    joined once each, whatever the number of their rows.  Where similar first texts have very many second texts between
    them, those are found by a second similarity join, so that no hot first text is compared pair by pair.
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.trim(F.col(first)).alias("t1"), F.trim(F.col(second)).alias("t2"), F.coalesce(in_a, F.lit(False)).alias("in_a"), F.coalesce(in_b, F.lit(False)).alias("in_b"))
    rows = rows.where("t1 <> '' AND t2 <> '' AND (in_a OR in_b)").withColumn("k1", _key("t1")).withColumn("k2", _key("t2"))
    texts = _distinct_texts(rows, "k1", "t1")
    near = materialize(_with_same(similar_texts(texts, edits), texts), "near")
    release(texts)
    slim = materialize(rows.select("row_id", "k1", "k2", F.length("t2").alias("l2"), "in_a", "in_b"), "rows")  # texts stay behind
    held = slim.groupBy("k1", "k2").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"), F.first("l2").alias("l2"), F.count("*").alias("n"))
    held = materialize(held, "pairs")
    a = held.where("in_a").select(F.col("k1").alias("key_a"), F.col("k2").alias("k2_a"), F.col("l2").alias("l2_a"))
    b = held.where("in_b").select(F.col("k1").alias("key_b"), F.col("k2").alias("k2_b"), F.col("l2").alias("l2_b"))
    counted = near.join(a.groupBy("key_a").agg(F.count("*").alias("n_a")), "key_a").join(b.groupBy("key_b").agg(F.count("*").alias("n_b")), "key_b")
    counted = materialize(counted, "counted")
    release(near)
    few, many = counted.where(F.col("n_a") * F.col("n_b") <= HOT_PAIRS), counted.where(F.col("n_a") * F.col("n_b") > HOT_PAIRS)
    met = few.join(a, "key_a").join(b, "key_b").where(f"abs(l2_a - l2_b) <= {edits}")
    quads = materialize(met.select("key_a", "key_b", "k2_a", "k2_b", F.col("edits").alias("edits_1"), "cosine"), "met")
    second_pairs = quads.where("k2_a <> k2_b").select("k2_a", "k2_b").distinct()
    texts2 = rows.select("k2", "t2").groupBy("k2").agg(F.first("t2").alias("t2"))
    judged = second_pairs.join(texts2.select(F.col("k2").alias("k2_a"), F.col("t2").alias("ta")), "k2_a").join(texts2.select(F.col("k2").alias("k2_b"), F.col("t2").alias("tb")), "k2_b")
    judged = judged.select("k2_a", "k2_b", F.levenshtein("ta", "tb", edits).alias("edits_2")).where("edits_2 >= 0")
    found = quads.where("k2_a = k2_b").withColumn("edits_2", F.lit(0)).unionByName(quads.join(judged, ["k2_a", "k2_b"]))
    if not many.isEmpty():
        keys = many.select(F.col("key_a").alias("k1")).union(many.select("key_b")).distinct()
        hot = _distinct_texts(rows.join(keys, "k1", "left_semi"), "k2", "t2")
        near2 = materialize(_with_same(similar_texts(hot, edits), hot).select(F.col("key_a").alias("k2_a"), F.col("key_b").alias("k2_b"), F.col("edits").alias("edits_2")), "near")
        # From the side with fewer second texts, so that a hot first text is not spread over its neighbours.
        more = many.where("n_a <= n_b").join(a, "key_a").join(near2, "k2_a").join(b, ["key_b", "k2_b"])
        more = more.unionByName(many.where("n_a > n_b").join(b, "key_b").join(near2, "k2_b").join(a, ["key_a", "k2_a"]))
        found = found.unionByName(more.select("key_a", "key_b", "k2_a", "k2_b", F.col("edits").alias("edits_1"), "cosine", "edits_2"))
    return _rows_of(found, slim, held)


def _rows_of(found: DataFrame, slim: DataFrame, held: DataFrame) -> DataFrame:
    """The row pairs of pairs of text pairs.  Rows of a text pair that very many rows share are spread over salts, so that no
    task makes all their pairs."""
    hot = held.where(F.col("n") > HOT_ROWS).select("k1", "k2", F.ceil(F.col("n") / HOT_ROWS).cast("int").alias("salts"))
    n_hot = hot.count()
    row, ka, kb = slim.withColumn("salt", F.lit(0)), ["key_a", "k2_a", "salt_a"], ["key_b", "k2_b", "salt_b"]
    found = found.withColumns({"salt_a": F.lit(0), "salt_b": F.lit(0)})
    if n_hot:
        # At most one text pair in HOT_ROWS rows is hot.
        few = (lambda df: F.broadcast(df)) if n_hot <= BROADCAST_ROWS else (lambda df: df)
        salts = F.coalesce("salts", F.lit(1))
        row = slim.join(few(hot), ["k1", "k2"], "left").withColumn("salt", F.pmod(F.xxhash64("row_id"), salts).cast("int"))
        for s in ("a", "b"):
            named = hot.select(F.col("k1").alias(f"key_{s}"), F.col("k2").alias(f"k2_{s}"), "salts")
            found = found.join(few(named), [f"key_{s}", f"k2_{s}"], "left").withColumn(f"salt_{s}", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    side = lambda s: row.where(f"in_{s}").select(F.col("k1").alias(f"key_{s}"), F.col("k2").alias(f"k2_{s}"), F.col("salt").alias(f"salt_{s}"), F.col("row_id").alias(f"id_{s}"))
    return found.join(side("a"), ka).join(side("b"), kb).where("id_a <> id_b").select("id_a", "id_b", "edits_1", "edits_2", "cosine")
