"""Loading lines and rows, and key figures, with nulls, ties, long texts and clashing names."""

import csv
import io
import math
import random
import re

from pyspark.sql import functions as F

from pairforge.operators import records, skew

ATOMS = re.compile(r"(Cl|Br|[BCNOPSFI]|[bcnops]|\[[A-Za-z0-9@+\-:]+\]|[-=#:/\\.]|[()]|[0-9]|%[0-9][0-9])+")


def smiles_ok(s):
    s = (s or "").strip(" ")
    if not ATOMS.fullmatch(s):
        return False
    out = re.sub(r"\[[^\]]*\]", "", s)
    depth = 0
    for c in out:
        depth += {"(": 1, ")": -1}.get(c, 0)
        if depth < 0:
            return False
    labels = re.findall(r"%[0-9][0-9]|[0-9]", out)
    return depth == 0 and all(labels.count(x) % 2 == 0 for x in labels)


def cells_of(line):
    """Fields under RFC 4180, or None; a plain automaton."""
    out, i = [], 0
    while True:
        if line[i : i + 1] == '"':
            i, cell = i + 1, ""
            while True:
                if i >= len(line):
                    return None
                if line[i] == '"':
                    if line[i + 1 : i + 2] == '"':
                        cell, i = cell + '"', i + 2
                        continue
                    i += 1
                    break
                cell, i = cell + line[i], i + 1
            if i < len(line) and line[i] != ",":
                return None
        else:
            j = line.find(",", i)
            j = len(line) if j < 0 else j
            cell, i = line[i:j], j
            if '"' in cell:
                return None
        out.append(cell)
        if i >= len(line):
            return out
        i += 1


def reason_of(line):
    if line is None:
        return "columns"
    cells = cells_of(line)
    if cells is None:
        return "quoting"
    if len(cells) != 4:
        return "columns"
    return "smiles" if not smiles_ok(cells[2]) else "label" if cells[3].strip(" ") not in ("0", "1") else None


LINES = [
    None, "", ",", "a,b,CC,1", "a,b,CC, 1 ", '"a","b","CC","0"', '"a,x",b,CC,1', '"a""q",b,CC,1', 'a"b,c,CC,1', '"a"b,c,CC,1', '"a,b,CC,1', 'a,b,"CC",1"', "a,b,C(C,1", "a,b,C)C(,1",
    "a,b,C1CC,1", "a,b,C1CC1,1", "a,b,C%12CC%12,1", "a,b,C%1,1", "a,b,[NH2+]C,0", "a,b,[13C],01", "a,b,CC,01", "a,b,CC,+1", "a,b,CC,2", "a,b,CC,", "a,b,,1", "a,b, CC ,1", "a,b,Xx,1", "a,b,CC,1,", "a,b,C\n,1",
    "a\nb,c,CC,1", '"a\nb",c,CC,1', "a\r,b,CC,1", "a,b,CC,1\r", ",,CC,0", ' "a",b,CC,1', '"a" ,b,CC,1', '"",b,CC,1', '""x,b,CC,1', "," * 30000, "a,b," + "C" * 100000 + ",1", "a,b," + "(" * 5000 + "C" + ")" * 5000 + ",1", '"' + "x" * 100000,
    '"' + '""' * 50000 + '",b,CC,1', "a,b,Clc1ccccc1Br,1", "a,b,cl,1", "#c,b,CC,1", "a,b,CC,1.0", "é,ß,CC,0",
]


def test_lines(spark):
    rnd = random.Random(1)
    lines = LINES + ["".join(rnd.choices('a",C1 \\', k=rnd.randrange(14))) + rnd.choice(["", ",b,CC,1"]) for _ in range(400)]
    df = spark.createDataFrame([(i, x, "clash", "clash") for i, x in enumerate(lines)], "line_id bigint, line string, reason string, cells string").repartition(3)
    got = {r["rec_id"]: r for r in records.parse_lines(df, "line_id", "line").collect()}
    assert len(got) == len(lines)
    for i, x in enumerate(lines):
        r = got[i]
        assert r["reason"] == reason_of(x), (x and x[:60], r["reason"])
        if r["reason"] is None:
            want = cells_of(x)
            assert (r["dataset_name"], r["endpoint"], r["smiles"], r["label"], r["corrupt"]) == (want[0] or None, want[1] or None, want[2].strip(" "), int(want[3]), None)
        else:
            assert r["corrupt"] == x and r["smiles"] is None
    assert records.parse_lines(df.limit(0), "line_id", "line").count() == 0


def test_sound_lines_load_as_the_csv_module_reads_them(spark):
    lines = [x for x in LINES if x and reason_of(x) is None and "\n" not in x and "\r" not in x and len(x) < 1000]
    df = spark.createDataFrame(list(enumerate(lines)), "line_id bigint, line string")
    for r in records.parse_lines(df, "line_id", "line").collect():
        assert (r["dataset_name"] or "") == next(csv.reader(io.StringIO(lines[r["rec_id"]])))[0]


def test_typed_rows(spark):
    rows = [(1, "CC", 1, "x"), (2, " CC ", 0, "x"), (3, None, 1, "x"), (4, "", 1, "x"), (5, "C(", None, "x"), (6, "CC", None, "x"), (7, "CC", 2, "x"), (8, "CC", -1, "x")]
    df = spark.createDataFrame(rows, "mol_id bigint, smiles string, label int, reason string")
    got = {r["rec_id"]: r["reason"] for r in records.check_rows(df, "mol_id", ["smiles", "label"]).collect()}
    assert got == {1: None, 2: None, 3: "smiles", 4: "smiles", 5: "smiles", 6: "label", 7: "label", 8: "label"}


def test_key_quantiles(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(rnd.choice(["hot"] * 8 + ["a", "b", None]), rnd.choice([None, float("nan"), 1.0, 2.0, rnd.gauss(0, 1e6), rnd.random() * 1e-9])) for _ in range(4000)] + [("none", None), ("one", -0.0), ("same", 5.0), ("same", 5.0)]
    rows += [("wide", x) for x in (math.inf, -math.inf, 1.7e308, -1.7e308, 5e-324, 1e-323, 0.0, *(2.0**k for k in range(-1000, 1000, 7)))]
    df = spark.createDataFrame([(k, v, 1) for k, v in rows], "k string, v double, n_rows int").repartition(5)
    qs = [0.0, 0.25, 0.5, 0.99, 1.0]
    want = {}
    for k in {k for k, _ in rows}:
        vals = sorted(v for x, v in rows if x == k and v is not None and not math.isnan(v))
        want[k] = (sum(x == k for x, _ in rows), len(vals), [vals[max(1, math.ceil(p * len(vals))) - 1] for p in qs] if vals else None)
    for limit in (50_000, 0):  # by broadcast, and salted
        monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
        got = {r["k"]: (r["n_rows"], r["n_values"], r["q"]) for r in skew.key_histogram_quantiles(df, ["k"], F.col("v"), qs, bins=16).collect()}
        assert got == want
    assert skew.key_histogram_quantiles(df.limit(0), ["k"], F.col("v"), qs).count() == 0
    assert skew.hot_keys(skew.key_histogram_quantiles(df.limit(0), ["k"], F.col("v"), qs), ["k"], 3).count() == 0


def test_hot_key_border(spark):
    df = spark.createDataFrame([("a", 3), ("b", 2), ("c", 95)], "k string, n_rows bigint")
    assert {r[0] for r in skew.hot_keys(df, ["k"], 3).collect()} == {"a", "c"}


def test_lookup_of_hot_keys(spark, monkeypatch):
    from pairforge.operators import lookup

    monkeypatch.setattr(lookup, "HOT_ROWS", 5)
    rows = spark.createDataFrame([("h", i) for i in range(20)] + [("c", 99), ("gone", 1), (None, 2)], "k string, i int")
    groups = spark.createDataFrame([("h", 20, "x"), ("c", 1, "y")], "k string, n bigint, v string")
    got = sorted((r["i"], r["v"]) for r in lookup.lookup(rows, groups, "k", "n").collect())
    assert got == [(i, "x") for i in range(20)] + [(99, "y")]
    for limit, most in ((5, 100_000), (5, 0), (100, 100_000)):  # by broadcast; too many hot keys; none
        monkeypatch.setattr(lookup, "HOT_ROWS", limit)
        monkeypatch.setattr(lookup, "BROADCAST_ROWS", most)
        left = sorted(((r["i"], r["v"]) for r in lookup.lookup(rows, lookup.with_counts(rows, groups.drop("n"), "k", "n"), "k", "n", "left").collect()), key=repr)
        assert left == sorted(got + [(1, None), (2, None)], key=repr)
