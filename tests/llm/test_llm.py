"""Operators of the llm subpackage against brute force on small fixtures, with nulls, ties, empty and long texts."""

import itertools
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from pairforge.llm import canonical, leaks, mixing, overlap, splits, terms

LOOKS = {"а": "a", "е": "e", "о": "o", "ⅼ": "l", "’": "'", "⁄": "/"}


def looks_df(spark):
    return spark.createDataFrame([(ord(k), k, v) for k, v in LOOKS.items()], "code_point int, looks string, plain string")


# -- canonical ---------------------------------------------------------------------------------------------------------

TEXTS = [
    (1, "plain text"), (2, "plаin  text "), (3, "ｐｌａｉｎ text"), (4, "café ½"), (5, "café 1⁄2"), (6, None), (7, ""), (8, "​﻿"),
    (9, "pla​in­ text"), (10, "plain text"), (11, "ё̣x"), (12, "ё̣x"), (13, "ẹ̈x"), (14, "ﬁne print️"), (15, "한글 각"), (16, "a\x85b\x0bc\n\nd"),
    (17, "x" * 200_000 + "а"), (18, "'quoted’ \\ \0 end"), (19, "͏̈́ẛ̣"),
]


def test_forms_match_their_definition(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in TEXTS], "doc_id bigint, text string, form string")
    got = {r["doc_id"]: r["form"] for r in canonical.with_form(docs, "text", looks_df(spark), ["doc_id"]).collect()}
    assert got == {i: canonical.form_of(t, LOOKS) for i, t in TEXTS}
    assert got[2] == got[3] == got[9] == "plain text" and got[12] == got[13] and got[4] == got[5]


def test_random_forms():
    import pyarrow as pa

    rnd = random.Random(1)
    pool = [chr(c) for c in range(1, 0x3000) if unicodedata.category(chr(c)) not in ("Cs", "Cn")] + ["ﬃ", "㎏", "…", "가", "각"] + list(LOOKS) * 20
    texts = ["".join(rnd.choices(pool, k=rnd.randrange(30))) for _ in range(800)]
    former = canonical.Former(LOOKS)
    for part in ([t] for t in texts[:50]):
        assert former(pa.array(part)).to_pylist() == [canonical.form_of(t, LOOKS) for t in part]
    assert former(pa.array(texts)).to_pylist() == [canonical.form_of(t, LOOKS) for t in texts]


def test_all_characters_at_once(monkeypatch):
    import pyarrow as pa

    every = [chr(c) for c in range(1, 0x110000) if unicodedata.category(chr(c)) not in ("Cs", "Cn", "Co")]
    texts = ["".join(every[i : i + 50]) + " x" for i in range(0, len(every), 50)] + ["".join(f"a{c} " for c in every)]
    want = [canonical.form_of(t, LOOKS) for t in texts]
    assert canonical.Former(LOOKS)(pa.array(texts)).to_pylist() == want
    compat = [c for c in every if len(unicodedata.normalize("NFKD", c)) > 1 and not unicodedata.combining(c)]
    assert len(compat) > 2000
    texts = ["-".join(compat)] * 3 + [None, ""]
    former = canonical.Former(LOOKS)
    monkeypatch.setattr(former, "forms", lambda part: former.embedded(part))  # no plain path
    assert former(pa.array(texts)).to_pylist() == [canonical.form_of(t, LOOKS) for t in texts]


def test_long_documents(monkeypatch):
    import duckdb
    import pyarrow as pa

    texts = ["é ﬁ а  " * 200_000] * 10 + ["x"] * 1000 + [None, "", "ﬃ" * 3_000_000]
    former = canonical.Former(LOOKS)
    want = {t: canonical.form_of(t, LOOKS) for t in set(texts)}
    assert former(pa.array(texts)).to_pylist() == [want[t] for t in texts]

    def full(part):
        raise duckdb.OutOfMemoryException("full")

    monkeypatch.setattr(former, "embedded", full)
    assert former(pa.array(texts[9:14])).to_pylist() == [want[t] for t in texts[9:14]]


def test_lookalikes_of_several_characters(spark):
    import pyarrow as pa

    looks = {**LOOKS, "rn": "m", "rnn": "mn", "ｖｖ": "w"}
    texts = ["corner rnn ｒｎ vv", "ｖｖ", None, "а"]
    assert canonical.Former(looks)(pa.array(texts)).to_pylist() == [canonical.form_of(t, looks) for t in texts]
    assert canonical.form_of("corner rnn ｒｎ", looks) == "comer mn m"
    df = spark.createDataFrame([(None, k, v) for k, v in [*looks.items(), ("", "x"), ("y", None)]], "code_point int, looks string, plain string")
    assert canonical.look_map(df) == looks


def test_chained_lookalikes_and_marks_take_the_plain_path():
    import pyarrow as pa

    for looks in ({"а": "б", "б": "c"}, {"́": "x"}):
        assert canonical.Former(looks)(pa.array(["аб ẹ́"])).to_pylist() == [canonical.form_of("аб ẹ́", looks)]


def test_texts_with_nul_are_whole():
    import pyarrow as pa

    texts = ["é\0tail one", "é\0tail two", "plаin \0 ﬁne", "é  no nul", None, "\0", "е\0é\0\0  x"]
    for looks in (LOOKS, {**LOOKS, "\0": "0"}, {**LOOKS, "ж": "\0"}):
        for part in (texts, [*texts, "ж é tail"]):
            assert canonical.Former(looks)(pa.array(part)).to_pylist() == [canonical.form_of(t, looks) for t in part]


def test_lookalike_pairs_and_classes(spark, monkeypatch):
    monkeypatch.setattr(canonical, "PER_SALT", 2)
    docs = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    forms = {i: canonical.form_of(t, LOOKS) for i, t in TEXTS}
    text = dict(TEXTS)
    want = {(a, b) for a, b in itertools.combinations(sorted(forms), 2) if forms[a] and forms[a] == forms[b] and text[a] != text[b]}
    got = [tuple(r) for r in canonical.lookalike_pairs(docs, "doc_id", "text", looks_df(spark)).collect()]
    assert set(got) == want and len(got) == len(want)
    classes = {r["doc_id"]: r["class_id"] for r in canonical.form_classes(docs, "doc_id", "text", looks_df(spark)).collect()}
    assert classes == {i: min(j for j in forms if forms[j] == f) for i, f in forms.items() if f}
    assert canonical.lookalike_pairs(docs.limit(0), "doc_id", "text", looks_df(spark)).count() == 0


# -- mixing ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(40))
def test_schedule_deviates_by_less_than_a_block(seed):
    """Every frame on its own, cut anywhere; together they are one schedule in which no source strays by a block."""
    rnd = random.Random(seed)
    blocks = [[500, 300, 150, 50, 1], [1], [3, 3, 3], [1, 1, 1, 997]][seed] if seed < 4 else [rnd.choice([1, 2, rnd.randrange(1, 60), rnd.randrange(1, 400)]) for _ in range(rnd.randrange(1, 9))]
    total = sum(blocks)
    cuts = sorted({0, total, *(rnd.randrange(total + 1) for _ in range(rnd.randrange(8)))})
    order = [x for a, b in zip(cuts, cuts[1:]) for x in mixing.frame_of(blocks, a, b)]
    done = [0] * len(blocks)
    for t, (s, b) in enumerate(order, 1):
        assert b == done[s]
        done[s] += 1
        assert all(abs(n * total - t * w) < total for n, w in zip(done, blocks))
    assert done == blocks


def test_schedule_table(spark):
    quotas = {"a": 5000, "b": 3000, "c": 1500, "d": 499, "e": 1, "none": 0}
    rows = mixing.pfair_schedule(spark, quotas, 10, frame=1).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    assert {s: sorted(r["block"] for r in rows if r["source"] == s) for s in "abcde"} == {s: list(range(-(-q // 10))) for s, q in quotas.items() if q}
    assert mixing.pfair_schedule(spark, {}, 10).count() == 0


def test_mixture(spark):
    rnd = random.Random(2)
    rows = [(i, rnd.choice(["alpha beta, gamma", "x", "", None, "é _a1-- b"]), rnd.choice(["big"] * 8 + ["small", None, "other"])) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    weights = spark.createDataFrame([("big", 0.5, 2), ("small", 0.4, 3), ("none", 0.1, 5), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    found, uses = mixing.mixture(docs, "doc_id", "text", "source", weights, block=40, frame=7)
    size = {i: len(re.findall(mixing.WORD_PUNCT, t or "")) for i, t, _ in rows}
    tokens = {s: sum(size[i] for i, _, x in rows if x == s) for s in ("big", "small", "none")}
    total = sum(tokens.values())
    assert {s.source: (s.tokens, s.limited) for s in found} == {s: (tokens[s], tokens[s] * m < w * total) for s, w, m in (("big", 0.5, 2), ("small", 0.4, 3), ("none", 0.1, 5))}
    got = uses.collect()
    assert all(r["tokens"] == size[r["doc_id"]] for r in got)
    for s in found:
        mine = [r for r in got if r["source"] == s.source]
        assert max([r["copy"] for r in mine], default=0) < max(1, s.max_repeats)
        assert len({(r["doc_id"], r["copy"]) for r in mine}) == len(mine)
        used = sum(r["tokens"] for r in mine)
        assert used <= s.quota and (not s.tokens or s.quota - used < max(size.values()))
    blocks = {}
    for r in sorted(got, key=lambda r: (r["slot"], r["place"])):
        blocks.setdefault(r["source"], []).append((r["slot"], r["place"], r["tokens"]))
        assert 0 <= r["place"] <= 40
    for mine in blocks.values():  # in the order of the mixture a source's records follow each other without gaps
        at = [40 * i + p for i, p in zip(itertools.accumulate((a[0] != b[0] for a, b in zip(mine, mine[1:])), initial=0), (x[1] for x in mine))]
        assert at == sorted(at)
    assert {r[0] for r in mixing.exhausted(found, uses).collect()} == {s.source for s in found if s.limited}
    empty, none = mixing.mixture(docs.limit(0), "doc_id", "text", "source", weights)
    assert none.count() == 0 and all(s.tokens == 0 for s in empty)


# -- leaks -------------------------------------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    rnd = random.Random(3)
    vocab = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choices(vocab, k=rnd.choice([5, 12, 40])))) for i in range(40)] + [(40, None), (41, ""), (42, "a " * 30)]
    docs = []
    for i in range(300):
        words = rnd.choices(vocab, k=rnd.randrange(60))
        if i % 3 == 0:
            src = (rnd.choice(items)[1] or "").split()
            k = rnd.choice([11, 12, 13, 40])
            at = rnd.randrange(max(1, len(src) - k + 1))
            words[5:5] = src[at : at + k]
        docs.append((i, ", ".join(w.upper() if i % 2 else w for w in words)))
    docs += [(300, None), (301, ""), (302, "a " * 100_000), (303, docs[0][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id bigint, question string")
    words = lambda t: re.findall("[a-z0-9]+", (canonical.form_of(t, LOOKS) or "").lower())

    def runs(t, n=12):
        w = words(t)
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    length = {j: min(12, len(words(t))) for j, t in items if words(t)}
    a, b = {n: {i: runs(t, n) for i, t in docs} for n in set(length.values())}, {j: runs(t, length[j]) for j, t in items if j in length}
    want = {(i, j) for j in b for i, _ in docs if a[length[j]][i] & b[j]}
    got = leaks.leaks(d, "doc_id", "text", q, "item_id", "question", looks_df(spark)).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["exact"]} == want and {r["window"] for r in got} == {5, 12} and all(r["window"] == length[r["item_id"]] for r in got)
    quick = leaks.leaks(d, "doc_id", "text", q, "item_id", "question", looks_df(spark), partial=False).collect()
    assert {(r["doc_id"], r["item_id"]) for r in quick if r["exact"]} == want and {tuple(r) for r in quick} <= {tuple(r) for r in got}
    assert len({(r["doc_id"], r["item_id"]) for r in got}) == len(got) and all(r["similarity"] >= 0.8 for r in got)
    assert leaks.leaks(d, "doc_id", "text", q.limit(0), "item_id", "question", looks_df(spark)).count() == 0
    assert leaks.leaks(d.limit(0), "doc_id", "text", q, "item_id", "question", looks_df(spark)).count() == 0


def test_words_of_every_character():
    import pyarrow as pa

    every = [c for c in map(chr, range(1, 0x110000)) if unicodedata.category(c) != "Cs"]
    forms = [canonical.form_of(f"A{c}b9 {c}", {}) for c in every] + ["", "  ", None]
    want = [None if f is None else " ".join(re.findall("[a-z0-9]+", f.lower())) for f in forms]
    assert leaks.bare_words(pa.array(forms)).to_pylist() == want


def test_no_similar_windows_are_missed():
    """Every pair of similarity 0.8 or more, with its best similarity, against brute force over all windows."""
    import pyarrow as pa

    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(60)]
    weight = {w: rnd.randrange(1, 9) for w in vocab}
    items = [(i, rnd.choices(vocab, k=rnd.choice([12, 14, 20]))) for i in range(40)] + [(40, ["w1"] * 15), (41, ["w1"] * 5 + vocab[2:12]), (42, ["w1", "w2"] * 8)]
    docs = []
    for i in range(200):
        words = rnd.choices(vocab, k=rnd.randrange(20))
        src = list(rnd.choice(items)[1])
        for _ in range(rnd.randrange(3)):
            src[rnd.choice([0, 1, -1, -2, rnd.randrange(12)])] = rnd.choice(["new", *vocab])
        words[5:5] = src[rnd.randrange(2) :]
        docs.append((i, words))

    def windows(words):
        return [words[i : i + 12] for i in range(len(words) - 11)]

    def similarity(a, b):
        a, b = [[tuple(x[i : i + 5]) for i in range(8)] for x in (a, b)]
        mass = lambda shingles: sum(weight.get(w, 8) for s in shingles for w in s)
        shared = (mass([s for s in a if s in b]) + mass([s for s in b if s in a])) / 2
        return shared / (mass(a) + mass(b) - shared)

    want = {(i, j): max((similarity(x, y) for x in windows(a) for y in windows(b)), default=0) for i, a in docs for j, b in items}
    want = {k: v for k, v in want.items() if v >= 0.8}
    found = leaks.build([(i, " ".join(w)) for i, w in items], weight, 12)
    batch = pa.record_batch({"doc_id": [i for i, _ in docs], "words": [" ".join(w) for _, w in docs]})
    out = [r for b in leaks.search([lambda: found], weight, 5, 0.8)(iter([batch])) for r in b.to_pylist()]
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in out} == pytest.approx(want) and len(out) == len(want)
    assert sum(not r["exact"] for r in out) > 5


def test_similarity_depends_neither_on_passes_nor_on_which_words_items_have(spark, monkeypatch):
    rnd = random.Random(13)
    vocab = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rnd.choices(vocab, k=14))) for i in range(30)]
    docs = [(i, " ".join(["common", *rnd.choice(items)[1].split()[rnd.randrange(3) :][:11], rnd.choice(["common", "rare", "w1"]), *rnd.choices(vocab, k=9)])) for i in range(300)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame(items, "item_id bigint, question string")
    held = [set(t.split()) for _, t in docs]
    weight = {w: min(8, 1 + int(math.log2(len(docs) / max(1, sum(w in x for x in held))) / 2)) for w in [*vocab, "common", "rare"]}

    def similarity(a, b):
        a, b = [[tuple(x[i : i + 5]) for i in range(8)] for x in (a, b)]
        mass = lambda shingles: sum(weight[w] for s in shingles for w in s)
        shared = (mass([s for s in a if s in b]) + mass([s for s in b if s in a])) / 2
        return shared / (mass(a) + mass(b) - shared)

    windows = lambda t: [t.split()[i : i + 12] for i in range(len(t.split()) - 11)]
    want = {(i, j): max(similarity(x, y) for x in windows(a) for y in windows(b)) for i, a in docs for j, b in items if set(a.split()) & set(b.split())}
    want = {k: v for k, v in want.items() if v >= 0.8}
    for most, piece in ((leaks.PART_WINDOWS, leaks.PIECE), (100, 2)):
        monkeypatch.setattr(leaks, "PART_WINDOWS", most)
        monkeypatch.setattr(leaks, "PIECE", piece)
        got = leaks.leaks(d, "doc_id", "text", q, "item_id", "question", looks_df(spark)).collect()
        assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in got} == pytest.approx(want) and len(got) == len(want)
    assert any(v < 1 for v in want.values())


def test_all_fingerprints_within_the_radius():
    import numpy as np

    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 2**63, 200).astype(np.uint64)
    items = leaks.build([(i, " ".join(f"{i}x{j}" for j in range(20))) for i in range(30)], {}, 12)
    items.prints = np.unique(base)
    items.index = [leaks.block_index(items.prints, b) for b in range(leaks.BLOCKS)]
    query = items.prints.copy()
    for k in range(3):
        query ^= np.uint64(1) << rnd.integers(0, 64, len(query)).astype(np.uint64)
    i, j = leaks.within_radius(items, query)
    want = {(a, b) for a in range(len(query)) for b in range(len(items.prints)) if int(query[a] ^ items.prints[b]).bit_count() <= 3}
    assert set(zip(i.tolist(), j.tolist())) == want and len(want) >= len(query)


# -- terms -------------------------------------------------------------------------------------------------------------


def test_ngrams(spark):
    rnd = random.Random(5)
    rows = [([rnd.choice("abcde") for _ in range(rnd.randrange(6))] or None, ["a"] * rnd.randrange(4), i) for i in range(300)] + [(None, None, 300), (["a"] * 500, [], 301)]
    df = spark.createDataFrame(rows, "x array<string>, y array<string>, occurrences int").repartition(5)
    want = {}
    for i, (x, y, _) in enumerate(rows):
        for cell in (x or [], y or []):
            for n in (1, 2, 3):
                for at in range(len(cell) - n + 1):
                    want.setdefault(tuple(cell[at : at + n]), []).append(i)
    got = terms.ngram_counts(df, [F.col("x"), F.col("y")], 3).collect()
    assert {tuple(r["ngram"]): (r["n"], r["occurrences"], r["n_records"]) for r in got} == {g: (len(g), len(v), len(set(v))) for g, v in want.items()}
    assert len(got) == len(want) and terms.ngram_counts(df.limit(0), [F.col("x")]).count() == 0


def test_ngrams_of_every_length(spark):
    rnd = random.Random(12)
    rows = [([rnd.choice("ab") for _ in range(rnd.randrange(12))] or None, [rnd.choice("ab")] * rnd.randrange(8)) for _ in range(120)] + [(None, None), (["a"] * 60, []), (["a", "b"] * 9, ["b", "a"] * 9)]
    df = spark.createDataFrame(rows, "x array<string>, y array<string>").repartition(5)
    want = {}
    for i, cells in enumerate(rows):
        for cell in cells:
            for n in range(1, len(cell or []) + 1):
                for at in range(len(cell) - n + 1):
                    want.setdefault(tuple(cell[at : at + n]), []).append(i)
    got = terms.ngram_counts(df, [F.col("x"), F.col("y")]).collect()
    assert {tuple(r["ngram"]): (r["n"], r["occurrences"], r["n_records"]) for r in got} == {g: (len(g), len(v), len(set(v))) for g, v in want.items()}
    assert len(got) == len(want) and max(map(len, want)) == 60 and terms.ngram_counts(df.limit(0), [F.col("x")]).count() == 0


def test_fragments_of_long_cells(spark):
    """Whole suffixes, but only the intervals of one token are answered: a cell of thousands of tokens has few of those."""
    rnd = random.Random(14)
    cells = [[rnd.choice("abcdef") for _ in range(3000)], ["a"] * 2000, None, [], ["z"]] + [[rnd.choice("abcz")] * rnd.randrange(4) for _ in range(50)]
    df = spark.createDataFrame([(c,) for c in cells], "x array<string>").repartition(3)
    got = {(r["ngram"][0], r["n"]): (r["occurrences"], r["n_records"]) for r in terms.ngram_counts(df, [F.col("x")], report_n=1).collect()}
    assert got == {(t, 1): (sum((c or []).count(t) for c in cells), sum(t in (c or []) for c in cells)) for t in "abcdefz"}


def test_marks(spark):
    df = spark.createDataFrame([(["x"], 1, 1, 2), (["y"], 1, 3, 3), (["z"], 1, 9, 2)], "ngram array<string>, n int, occurrences int, n_records int")
    assert [r["mark"] for r in terms.with_mark(df, 100).orderBy("ngram").collect()] == ["rare", "common", "rare"]


# -- splits ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [100_000, 3])
def test_components(spark, monkeypatch, hot):
    from pairforge.operators import lookup

    monkeypatch.setattr(lookup, "HOT_ROWS", hot)
    rnd = random.Random(6)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(120)] + [(300 + i, 301 + i) for i in range(60)] + [(500, 500 + i) for i in range(50)] + [(900, 900)] + [(500 + 7 * i, 501 + 7 * i) for i in range(9)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = spark.createDataFrame(edges + [(None, 3)], "a bigint, b bigint")
    assert {r["node"]: r["root"] for r in splits.components(df).collect()} == {x: find(x) for x in root}
    assert splits.components(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_closest_total(seed):
    rnd = random.Random(seed)
    sizes = {rnd.randrange(1, 30): rnd.randrange(1, 5) for _ in range(rnd.randrange(1, 6))}
    target = rnd.randrange(80)
    totals = {0}
    for s, m in sizes.items():
        totals = {t + s * k for t in totals for k in range(m + 1)}
    got = splits.closest(sizes, target)
    assert all(0 < k <= sizes[s] for s, k in got.items())
    assert abs(sum(s * k for s, k in got.items()) - target) == min(abs(t - target) for t in totals)


def test_closest_total_needs_little_memory():
    """Many sizes of one divisor and a target that none of their totals meets."""
    import tracemalloc

    sizes = {2 * i: 3 for i in range(1, 2001)}
    tracemalloc.start()
    got = splits.closest(sizes, 1_000_001)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(s * k for s, k in got.items()) == 1_000_000 and peak < 20e6
    rnd = random.Random(1)
    sizes = {rnd.randrange(1, 4000) * 7: rnd.randrange(1, 4) for _ in range(300)}
    got = splits.closest(sizes, 300_003)
    assert all(k <= sizes[s] for s, k in got.items()) and abs(sum(s * k for s, k in got.items()) - 300_003) == splits.least_miss(sizes, 300_003)
    assert splits.closest({5: 1}, 0) == splits.closest({}, 9) == {}


def test_first_split_is_closest_whatever_is_set_beforehand():
    for seed in range(100):
        rnd = random.Random(seed)
        sizes = {rnd.randrange(1, 60): rnd.randrange(1, 40) for _ in range(rnd.randrange(1, 5))}
        totals = {0}
        for s, m in sizes.items():
            totals = {t + s * k for t in totals for k in range(m + 1)}
        target = round(sum(s * m for s, m in sizes.items()) * 0.3)
        got = splits.allot(sizes, {"test": 0.3, "train": 0.7})["test"]
        assert all(0 < k <= sizes[s] for s, k in got.items())
        assert abs(sum(s * k for s, k in got.items()) - target) == min(abs(t - target) for t in totals)


def test_group_split(spark):
    rnd = random.Random(7)
    mols = [f"M{i}" for i in range(150)]
    profile = [(m, rnd.choice([m, f"C{rnd.randrange(60)}", None]), rnd.choice([None, f"S{rnd.randrange(60)}"])) for m in mols[:120]]
    rows = [(i, rnd.choice([" ", ""]) + rnd.choice(mols), rnd.choice(["train", "valid", "test", None])) for i in range(600)] + [(600 + i, rnd.choice([None, " "]), "train") for i in range(20)]
    df = spark.createDataFrame(rows, "cliff_id bigint, toxic_smiles string, split string")
    prof = spark.createDataFrame(profile, "smiles string, canonical string, scaffold string")
    known = {m: (c, s) for m, c, s in profile}
    entity, by = {}, {}
    for i, t, split in rows:
        m = (t or "").strip()
        c, s = known.get(m, (None, None))
        entity[i] = s or c or m or None
        if split and entity[i]:
            by.setdefault(entity[i], set()).add(split)
    want = {i for i, t, split in rows if split and entity[i] and len(by[entity[i]]) > 1}
    got = [r[0] for r in splits.straddling(df, "cliff_id", "toxic_smiles", prof).collect()]
    assert set(got) == want and len(got) == len(want)
    out = {r["cliff_id"]: (r["component"], r["new_split"]) for r in splits.group_split(df, "cliff_id", "toxic_smiles", prof).collect()}
    assert set(out) == {r[0] for r in rows}
    seen = {}
    for i, t, _ in rows:
        m = (t or "").strip()
        for key in {m, *known.get(m, ())} - {None, ""}:
            seen.setdefault(key, set()).add(out[i])
    assert all(len(v) == 1 for v in seen.values())
    assert all(out[i][0] == i for i in range(600, 620))
    sizes = [sum(1 for c, s in out.values() if s == name) for name in ("test", "valid")]
    assert sizes == [62, 62]


# -- overlap -----------------------------------------------------------------------------------------------------------


def edit(text, k, rnd):
    for _ in range(k):
        at, what = rnd.randrange(len(text) + 1), rnd.random()
        text = text[:at] + rnd.choice("CNO()=1é") + text[at + (what < 0.5) :] if what < 0.8 else text[:at] + text[at + 1 :]
    return text


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("hot", [1000, 0])
def test_overlaps_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(overlap, "HOT_PAIRS", hot)
    monkeypatch.setattr(overlap, "HOT_ROWS", 2_000 if hot else 2)
    rnd = random.Random(8)
    parts = ["C(C)", "c1ccccc1", "N(C)C", "C(=O)", "S(=O)(=O)", "OC", "[NH2+]", "CCCCCCCC"]
    rows = []
    for base in range(45):
        size = rnd.choice([1, 1, 2, 3, 5, 9, 20])
        t, n = "".join(rnd.choices(parts, k=size)), "".join(rnd.choices(parts, k=size))
        if base % 5 == 0:
            t = t[: rnd.randrange(1, 9)]
        for _ in range(5):
            rows.append((len(rows), edit(t, rnd.randrange(5), rnd) + rnd.choice(["", " "]), edit(n, rnd.randrange(4), rnd), rnd.choice(["train", "train", "test", "valid", None])))
    rows += [(len(rows) + i, rows[0][1], rows[0][2], ["train", "test"][i % 2]) for i in range(12)]
    rows += [(len(rows) + i, t, n, s) for i, (t, n, s) in enumerate([(None, "C", "train"), ("C", None, "test"), ("", "C", "test"), ("  ", "C", "train"), ("C" * 3000, "C", "train"), ("C" * 3001, "CN", "test")])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "cliff_id bigint, toxic_smiles string, nontoxic_smiles string, split string, term string")
    clean = [(i, (t or "").strip(" "), (n or "").strip(" "), s) for i, t, n, s in rows]
    near = lambda a, b: abs(len(a) - len(b)) <= 3 and (a == b or len(a) < 900 and distance(a, b) <= 3 or len(a) > 900)
    want = {(a[0], b[0]) for a in clean if a[3] == "train" and a[1] and a[2] for b in clean if b[3] in ("test", "valid") and b[1] and b[2] and near(a[1], b[1]) and near(a[2], b[2])}
    run = lambda x: overlap.overlaps(x, "cliff_id", "toxic_smiles", "nontoxic_smiles", F.col("split") == "train", F.col("split").isin("valid", "test"))
    got = [(r["id_a"], r["id_b"]) for r in run(df).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20
    assert run(df.limit(0)).count() == 0


def test_edits_turn_few_bits_of_a_sketch():
    rnd = random.Random(10)
    for _ in range(400):
        a = "".join(rnd.choices(["C(C)", "c1cc", "N", "OC", "C", "=", "é"], k=rnd.randrange(1, 30)))
        k = rnd.randrange(4)
        turned = [(int(x) ^ int(y)) & (1 << 64) - 1 for x, y in overlap.parities([a, edit(a, k, rnd)]).tolist()]
        assert sum(x.bit_count() for x in turned) <= 4 * k


def test_terms_shared_by_chance_are_not_summed(spark):
    rnd = random.Random(11)
    parts = ["C(C)(C)", "c1ccccc1", "N(C)", "C(=O)", "S(=O)(=O)", "OC", "c1ccncc1", "C(F)", "C#C", "C(Br)", "c1ccsc1", "[NH2+]", "P(=O)", "n1cccc1", "C1CC1", "[C@H](C)", "C(Cl)", "C=C", "C(S)"]
    rows = [("".join(rnd.choices(parts, k=16)), i % 2 == 0) for i in range(1500)]
    rows += [(edit(t, 3, rnd), not a) for t, a in rows[:40]]
    texts = spark.createDataFrame([(i, t, a, not a) for i, (t, a) in enumerate(rows)], "id bigint, text string, in_a boolean, in_b boolean")
    lists = overlap.postings(texts, 0, 3, overlap.rarity(texts, 0), len(rows)).cache()
    met = {tuple(r) for r in overlap.met_entries(lists, 3).select("id_a", "id_b").collect()}
    live = lists.where("NOT short")
    shared = live.where("in_a").alias("a").join(live.where("in_b").alias("b"), F.expr("a.term = b.term AND abs(a.length - b.length) <= 3 AND (abs(a.start - b.start) <= 3 OR a.start < 0 OR b.start < 0)")).select("a.id", "b.id").distinct().count()
    close = {(x, y) for x, y in ((i, 1500 + i) if rows[i][1] else (1500 + i, i) for i in range(40))}
    found = {(r["a"], r["b"]) for r in overlap.listed_pairs(lists, 3).collect()}
    short = {r["id"] for r in lists.where("short").select("id").distinct().collect()}
    assert {x for x in close if not short.issuperset(x)} <= found
    assert shared > 1000 and len(met - close) < 0.05 * shared
    lists.unpersist()


def test_shuffle_files_go_with_the_write(spark):
    from pairforge.storage import CLEANUP, materialize

    files = lambda: {f.getName() for f in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle")}
    before, was = files(), spark.conf.get(CLEANUP, None)
    out = materialize(spark.range(100_000).groupBy((F.col("id") % 5_000).alias("k")).agg(F.count("*").alias("n")), "step")
    assert not files() - before and spark.conf.get(CLEANUP, None) == was
    assert out.count() == 5_000


def test_bound_holds_for_vectors():
    """What k random edits take from a vector is never more than k times what one edit can destroy at most."""
    import numpy as np

    rnd = random.Random(9)
    for run in (0, *overlap.SHORT_RUNS):
        for _ in range(150):
            a = "".join(rnd.choices(["C(C)", "c1cc", "N", "OC", "C", "="], k=rnd.randrange(1, 30)))
            k = rnd.randrange(1, 4)
            b = edit(a, k, rnd)
            if not b:
                continue
            ta, tb = overlap.Terms([a, "xyzzy"], run), overlap.Terms([b], run)
            weight = 16 + ta.cell % 9
            kept = weight[(ta.who == 0) & np.isin(ta.term, tb.term)].sum()
            assert kept >= weight[ta.who == 0].sum() - k * ta.lost(weight)[0]


def test_empty_tables(spark):
    rows = spark.createDataFrame([], "cliff_id bigint, toxic_smiles string, split string")
    prof = spark.createDataFrame([], "smiles string, canonical string, scaffold string")
    assert splits.group_split(rows, "cliff_id", "toxic_smiles", prof).count() == 0
    assert splits.straddling(rows, "cliff_id", "toxic_smiles", prof).count() == 0
    lone = spark.createDataFrame([(1, "C", "train"), (2, "C", "test")], rows.schema)
    assert {r[0] for r in splits.straddling(lone, "cliff_id", "toxic_smiles", prof).collect()} == {1, 2}
