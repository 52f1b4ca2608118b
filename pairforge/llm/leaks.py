"""Evaluation texts leaking into training text (problem 6).

Item-sized windows of both sides – as long as the item, up to the passage of 12 words – have 64-bit SimHash fingerprints.  Four blocks
of 16 bits index those of the items: whatever lies within three bits shares a block with it, so all such windows are found,
those with the same words among them.  Exact weighted-shingle similarity, on 64-bit hashes of the words, then verifies the candidates.

A window of similarity 0.8 that is not the same lies about seven bits away, so fingerprints alone miss most partial leaks.  For
these (``partial``) the shingles of the items' windows are indexed as well: a document window looks up its rarest shingles, as
many as could not all be missing from a window that is similar enough, so none is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.llm.canonical import with_form
from pairforge.storage import materialize, release

WINDOW = 12
SHINGLE = 5
SIMILAR = 0.8
RADIUS, BLOCKS, BLOCK_BITS = 3, 4, 16
#: About as many windows of items are in one index; documents look into one after the other.
PART_WINDOWS = 400_000
#: Longer items are cut into pieces of so many windows, which overlap by a window less one word.
PIECE = 50_000
#: About as many candidates are made at once, unless one document window has more.
CANDIDATES = 500_000
#: A table of so many bits of a shingle's hash tells most shingles that no item has.
MAYBE_BITS = 20
#: Words looked up at once, which bounds the memory of a task whatever the length of a text.
STRIDE = 60_000


def bare_words(forms: pa.Array) -> pa.Array:
    """The longest runs of a-z and 0-9 in the lower-cased forms, joined by single blanks.

    Of the characters outside ASCII that a form can hold only U+0130 has such letters in its lower case: an i and a mark.
    """
    return pc.utf8_trim(pc.replace_substring_regex(pc.ascii_lower(pc.replace_substring(forms, "\u0130", "i ")), "[^a-z0-9]+", " "), " ")


def words_of(df: DataFrame, key: str, text: str, lookalikes: DataFrame) -> DataFrame:
    """``key`` and ``words``: the words of the form, in lower case, joined by single blanks.  Null, empty and wordless texts are left out."""
    return with_form(df, text, lookalikes, [key], then=bare_words).withColumnRenamed("form", "words").where("words <> ''")


def rarest_weight(n_docs: int) -> int:
    """The weight of a word that one document holds, or none."""
    return min(8, 1 + (max(1, n_docs).bit_length() - 1) // 2)


def word_weights(docs: DataFrame, n_docs: int) -> DataFrame:
    """``word``, ``weight`` of the words of the documents that weigh less than the rarest: 1 to 7 by the share of all documents
    that hold it.  All words of items and documents not among them have the rarest weight.

    A word weighs less than 8 only if more than one document in 16,384 holds it, so these are at most 16,384 times as
    many as the words of a mean document, however many documents there are.
    """
    df = docs.select(F.explode(F.array_distinct(F.split("words", " "))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    # Powers of four in integers, so that no logarithm rounds.
    weight = sum((F.when(F.col("df") * 4**k <= n_docs, 1).otherwise(0) for k in range(1, 8)), F.lit(1))
    return df.select("word", weight.cast("int").alias("weight")).where(F.col("weight") < rarest_weight(n_docs))


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[str]) -> np.ndarray:
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def signed_bits(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per word of a vocabulary its weight, signed by the bits of its hash."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int16)
    return (2 * bits - 1) * weights.astype(np.int16)[:, None]


def fingerprints(signed: np.ndarray, codes: np.ndarray, window: int) -> np.ndarray:
    """SimHash of every window of a stream of words, given as rows of ``signed``.  Sums wrap around in 16 bits, which the
    differences (at most weight times window) undo."""
    n = len(codes) - window + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums = np.zeros((len(codes) + 1, 64), np.int16)
    np.cumsum(signed[codes], axis=0, dtype=np.int16, out=sums[1:])
    return np.packbits((sums[window:] - sums[:n]) > 0, axis=1, bitorder="little").view(np.uint64).ravel()


@dataclass
class Items:
    """An index of item windows of one length: windows without repeats, a place and the items of each; fingerprints, the windows of
    each and their block index; for partial leaks the windows of each shingle."""

    window: int
    ids: np.ndarray
    hashes: np.ndarray
    weights: np.ndarray
    place: np.ndarray
    first: np.ndarray
    owners: np.ndarray
    prints: np.ndarray
    print_first: np.ndarray
    print_windows: np.ndarray
    index: list[tuple[np.ndarray, np.ndarray]]
    grams: np.ndarray
    maybe: np.ndarray
    gram_first: np.ndarray
    gram_windows: np.ndarray
    heaviest: int


def spans_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` words in a stream."""
    n = max(0, len(hashes) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


def sums_of(values: np.ndarray, k: int) -> np.ndarray:
    """The sum of every run of ``k`` values in a stream."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[k:] - total[: max(0, len(total) - k)]


def _lists(keys: np.ndarray, values: np.ndarray, n_keys: int, n_values: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each key, one key after the other, and where each key begins."""
    both = np.unique(keys * np.int64(max(1, n_values)) + values)
    return np.concatenate([[0], np.cumsum(np.bincount(both // max(1, n_values), minlength=n_keys))]).astype(np.int64), both % max(1, n_values)


def build(rows: list[tuple[int, str]], weight: dict[str, int], window: int, shingle: int = SHINGLE, rarest: int = 8, partial: bool = True) -> Items:
    ids, lens, words = [], [], []
    for key, text in rows:
        ids.append(key)
        ws = text.split(" ")
        lens.append(len(ws))
        words += ws
    vocab = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.fromiter((vocab[w] for w in words), np.int64, len(words))
    hashes, weights = word_hashes(list(vocab)), np.fromiter((weight.get(w, rarest) for w in vocab), np.int64, len(vocab))
    owners = np.repeat(np.arange(len(ids)), lens)
    prints = fingerprints(signed_bits(hashes, weights), codes, window)
    hashes, weights = hashes[codes], weights[codes]
    start = np.nonzero(owners[: len(prints)] == owners[window - 1 :])[0] if len(prints) else np.zeros(0, np.int64)
    keys, at, inv = np.unique(spans_of(hashes, window)[start], return_index=True, return_inverse=True)
    place = start[at]
    first, owners = _lists(inv.astype(np.int64), owners[start], len(keys), len(ids))
    uniq, which = np.unique(prints[place], return_inverse=True)
    print_first, print_windows = _lists(which.astype(np.int64), np.arange(len(place)), len(uniq), len(place))
    index = [block_index(uniq, b) for b in range(BLOCKS)]
    k = min(shingle, window)
    inside = place[:, None] + np.arange(window - k + 1)
    heaviest = int(sums_of(weights, k)[inside].sum(axis=1).max(initial=0))
    grams, gram_first, gram_windows = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64)
    maybe = np.zeros(1 << MAYBE_BITS if partial else 1, bool)
    if partial:
        grams, which = np.unique(spans_of(hashes, k)[inside], return_inverse=True)
        gram_first, gram_windows = _lists(which.ravel().astype(np.int64), np.repeat(np.arange(len(keys)), window - k + 1), len(grams), len(keys))
        maybe[(grams & np.uint64(len(maybe) - 1)).astype(np.int64)] = True
    return Items(window, np.array(ids, np.int64), hashes, weights, place, first, owners, uniq, print_first, print_windows, index, grams, maybe, gram_first, gram_windows, heaviest)


def block_of(prints: np.ndarray, b: int) -> np.ndarray:
    return ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


def block_index(prints: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints in the order of one block, and where each value of it begins."""
    part = block_of(prints, b)
    return np.argsort(part, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(part, minlength=1 << BLOCK_BITS))]).astype(np.int64)


def _expand(begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges [begin, begin + count): the range each member belongs to, and the members."""
    which = np.repeat(np.arange(len(begin)), count)
    offset = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    return which, begin[which] + offset


def within_radius(items: Items, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (print, item print) index pairs at most RADIUS bits apart, each once."""
    found: list[np.ndarray] = []
    m = np.int64(max(1, len(items.prints)))
    for b, (order, offsets) in enumerate(items.index):
        part = block_of(prints, b)
        begin, count = offsets[part], offsets[part + 1] - offsets[part]
        group = np.cumsum(count) // CANDIDATES
        cuts = [0, *(np.nonzero(np.diff(group))[0] + 1), len(prints)]
        for lo, hi in zip(cuts, cuts[1:]):
            which, at = _expand(begin[lo:hi], count[lo:hi])
            which, other = which + lo, order[at]
            near = np.nonzero(np.bitwise_count(prints[which] ^ items.prints[other]) <= RADIUS)[0]
            found.append(which[near] * m + other[near])
    both = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return both // m, both % m


def near_windows(items: Items, prints: np.ndarray, start: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document windows (places in ``start``, with their fingerprints) and item windows with fingerprints within the radius."""
    which, other = within_radius(items, prints)
    count = items.print_first[other + 1] - items.print_first[other]
    group = np.cumsum(count) // STRIDE
    cuts = [0, *(np.nonzero(np.diff(group))[0] + 1), len(which)]
    for lo, hi in zip(cuts, cuts[1:]):
        at, place = _expand(items.print_first[other[lo:hi]], count[lo:hi])
        yield start[which[lo + at]], items.print_windows[place]


def candidates(items: Items, hashes: np.ndarray, weights: np.ndarray, start: np.ndarray, shingle: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Document windows (places in ``start``) and item windows, with every pair of similarity ``least`` or more among them.

    With weights A and B of all shingles of two windows, and a and b of those that the other lacks, the similarity is
    (A + B - a - b) / (A + B + a + b), so it reaches ``least`` only if a <= (A + B) (1 - least) / (1 + least).  Shingles of the document window
    are taken from the rarest on until their weight is over that for the heaviest B: a similar window has one of them.
    """
    window, k = items.window, min(shingle, items.window)
    spans, mass = spans_of(hashes, k), sums_of(weights, k)
    seen = np.nonzero(items.maybe[(spans & np.uint64(len(items.maybe) - 1)).astype(np.int64)])[0]
    at = np.minimum(np.searchsorted(items.grams, spans[seen]), max(0, len(items.grams) - 1))
    real = items.grams[at] == spans[seen] if len(items.grams) else np.zeros(len(seen), bool)
    seen, at = seen[real], at[real]
    gram, count = np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64)
    gram[seen], count[seen] = at, items.gram_first[at + 1] - items.gram_first[at]
    run = window - k + 1
    spare = (sums_of(mass, run)[start] + items.heaviest) * (1 - least) / (1 + least) + 1e-6
    open_ = sums_of(np.where(count > 0, 0, mass), run)[start] <= spare
    start, spare = start[open_], spare[open_]
    inside = start[:, None] + np.arange(run)
    inside = np.take_along_axis(inside, np.argsort(count[inside], axis=1, kind="stable"), axis=1)
    before = np.cumsum(mass[inside], axis=1) - mass[inside]
    needed = (before <= spare[:, None]) & (count[inside] > 0)
    group = np.cumsum((count[inside] * needed).sum(axis=1)) // CANDIDATES
    cuts = [0, *(np.nonzero(np.diff(group))[0] + 1), len(start)]
    for lo, hi in zip(cuts, cuts[1:]):
        row, col = np.nonzero(needed[lo:hi])
        g = gram[inside[lo + row, col]]
        which, place = _expand(items.gram_first[g], items.gram_first[g + 1] - items.gram_first[g])
        both = np.unique(row[which] * np.int64(max(1, len(items.place))) + items.gram_windows[place])
        for cut in range(0, len(both), STRIDE):
            part = both[cut : cut + STRIDE]
            yield start[lo + part // len(items.place)], part % len(items.place)


def judge(items: Items, hashes: np.ndarray, weights: np.ndarray, at: np.ndarray, place: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact weighted-shingle similarity of document windows and item windows, and whether their words (64-bit hashes of them) are the same."""
    window = items.window
    grid = np.arange(window)
    a, b = hashes[at[:, None] + grid], items.hashes[place[:, None] + grid]
    same = (a == b).all(axis=1)
    out = np.ones(len(at))
    rest = np.nonzero(~same)[0]
    a, b = a[rest], b[rest]
    k = min(shingle, window)
    spans = np.arange(window - k + 1)[:, None] + np.arange(k)
    sa, sb = np.zeros((len(rest), len(spans)), np.uint64), np.zeros((len(rest), len(spans)), np.uint64)
    for i in range(k):
        sa = _mix(sa * np.uint64(0x9E3779B97F4A7C15) + a[:, spans[:, i]])
        sb = _mix(sb * np.uint64(0x9E3779B97F4A7C15) + b[:, spans[:, i]])
    wa, wb = weights[at[rest][:, None] + grid][:, spans].sum(axis=2), items.weights[place[rest][:, None] + grid][:, spans].sum(axis=2)
    hit = sa[:, :, None] == sb[:, None, :]
    shared = ((wa * hit.any(axis=2)).sum(axis=1) + (wb * hit.any(axis=1)).sum(axis=1)) / 2
    total = wa.sum(axis=1) + wb.sum(axis=1) - shared
    out[rest] = shared / np.maximum(total, 1)
    return out, same


def search(parts: list, weight: dict[str, int], shingle: int, least: float, rarest: int = 8, partial: bool = True):
    """The partition function: Arrow batches of (key, words) to (key, item, similarity, exact, window).  ``parts`` give an index each when they
    are called; every stretch of text is fingerprinted once for all indexes of one window length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only = parts[0]() if len(parts) == 1 else None
        known: dict[str, int] = {}
        hash_of, weight_of, signed = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((0, 64), np.int16)
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            found: dict[tuple[int, int], tuple[float, bool, int]] = {}
            for lo, part in _groups(texts):
                words = pc.split_pattern(part, " ")
                flat = words.flatten().dictionary_encode()
                vocab = flat.dictionary.to_pylist()
                if len(known) > 300_000:
                    known.clear()
                    hash_of, weight_of, signed = hash_of[:0], weight_of[:0], signed[:0]
                fresh = [w for w in vocab if w not in known]
                if fresh:
                    known.update(zip(fresh, range(len(known), len(known) + len(fresh))))
                    new_hash, new_weight = word_hashes(fresh), np.fromiter((weight.get(w, rarest) for w in fresh), np.int64, len(fresh))
                    hash_of, weight_of = np.concatenate([hash_of, new_hash]), np.concatenate([weight_of, new_weight])
                    signed = np.concatenate([signed, signed_bits(new_hash, new_weight)])
                codes = np.fromiter((known[w] for w in vocab), np.int64, len(vocab))[flat.indices.to_numpy()]
                lens = np.diff(words.offsets.to_numpy())
                row = np.repeat(np.arange(len(lens)), lens)
                printed: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
                for load in parts:
                    items = only or load()
                    window = items.window
                    for at in range(0, max(1, len(codes) - window + 1), STRIDE):
                        c, r = codes[at : at + STRIDE + window - 1], row[at : at + STRIDE + window - 1]
                        if len(c) < window:
                            continue
                        if (window, at) not in printed:
                            start = np.nonzero(r[: len(c) - window + 1] == r[window - 1 :])[0]
                            printed[window, at] = start, fingerprints(signed, c, window)[start]
                        start, prints = printed[window, at]
                        h, w = hash_of[c], weight_of[c]
                        sources = [near_windows(items, prints, start)] + ([candidates(items, h, w, start, shingle, least)] if partial else [])
                        for i, win in (x for s in sources for x in s):
                            sim, same = judge(items, h, w, i, items.place[win], shingle)
                            hit = np.nonzero(sim >= least)[0]
                            k, own = _expand(items.first[win[hit]], items.first[win[hit] + 1] - items.first[win[hit]])
                            hit = hit[k]
                            code, at_pair = np.unique(r[i[hit]] * len(items.ids) + items.owners[own], return_inverse=True)
                            best, full = np.zeros(len(code)), np.zeros(len(code), bool)
                            np.maximum.at(best, at_pair, sim[hit])
                            np.logical_or.at(full, at_pair, same[hit])
                            for x, s, e in zip(code.tolist(), best.tolist(), full.tolist()):
                                pair = (int(keys[lo + x // len(items.ids)]), int(items.ids[x % len(items.ids)]))
                                old = found.get(pair, (0.0, False, 0))
                                found[pair] = (max(old[0], s), old[1] or e, window)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[0] for x in found.values()], pa.float64()),
                    pa.array([x[1] for x in found.values()], pa.bool_()), pa.array([x[2] for x in found.values()], pa.int32()),
                ],
                names=["doc_id", "item_id", "similarity", "exact", "window"],
            )

    return run


def _groups(texts: pa.Array, size: int = 8 << 20) -> Iterator[tuple[int, pa.Array]]:
    """Slices of about ``size`` characters."""
    lens = pc.utf8_length(texts).to_numpy(zero_copy_only=False)
    group = (np.cumsum(lens) - lens) // size
    cuts = [0, *(np.nonzero(np.diff(group))[0] + 1), len(lens)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield int(a), texts.slice(a, b - a)


_FOUND = "doc_id bigint, item_id bigint, similarity double, exact boolean, window int"


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, question: str, lookalikes: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, similar: float = SIMILAR, partial: bool = True) -> DataFrame:
    """``doc_id``, ``item_id``, ``similarity`` (of the most similar windows), ``exact`` (a whole window in the same unbroken order in
    common) and ``window`` (its words: as many as the item has, ``window`` at most) of every document and item with windows of
    weighted-shingle similarity ``similar`` or more.  All of them are found; without ``partial`` those whose fingerprints are
    within the radius, among them all that are exact.

    Items go through the documents in one pass: they are indexed in parts of bounded size, which every task reads in turn; documents are
    never shuffled.  Texts without words take no part; a document shorter than an item's window does not hold it; an empty side gives an empty
    result; an item or document that holds a passage twice comes out once.
    """
    spark = docs.sparkSession
    known = materialize(words_of(docs, doc_id, text, lookalikes).select(F.col(doc_id).cast("bigint").alias("doc_id"), "words"), "words")
    words = F.split("words", " ")
    asked = words_of(items, item_id, question, lookalikes).select(F.col(item_id).cast("bigint").alias("item_id"), words.alias("w"), F.least(F.size(words), F.lit(window)).alias("window"))
    # Pieces of long items overlap, so that no window is lost between them.
    begin = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - F.col("window") + 1), F.lit(PIECE))
    pieces = asked.select("item_id", "window", "w", F.explode(begin).alias("at")).select("item_id", "window", F.slice("w", F.col("at"), F.lit(PIECE - 1) + F.col("window")).alias("w"))
    pieces = materialize(pieces.select("item_id", "window", F.array_join("w", " ").alias("words"), F.size("w").alias("n"), F.xxhash64("item_id", "w").alias("h")), "items")
    sizes = pieces.groupBy("window").agg(F.sum("n").alias("n")).orderBy("window").collect()  # one row per length
    if not sizes:
        return spark.createDataFrame([], _FOUND)
    n_docs = known.count()
    rarest, weight = rarest_weight(n_docs), {r["word"]: r["weight"] for r in word_weights(known, n_docs).collect()}
    parts = []
    for r in sizes:
        n_parts = -(-r["n"] // PART_WINDOWS)
        of_length = pieces.where(F.col("window") == r["window"])
        for p in range(n_parts):
            rows = [(x["item_id"], x["words"]) for x in of_length.where(F.pmod("h", F.lit(n_parts)) == p).select("item_id", "words").orderBy("item_id", "h").collect()]
            if rows:
                parts.append(_reader(spark.sparkContext.broadcast(build(rows, weight, r["window"], shingle, rarest, partial))))
    release(pieces)
    return known.mapInArrow(search(parts, weight, shingle, similar, rarest, partial), _FOUND)


def _reader(shared):
    """Reads a broadcast index without keeping it, so that a task holds one at a time."""
    return lambda: shared.load_from_path(shared._path)
