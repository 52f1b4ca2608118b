"""The pair engine: hand-checked cases, traps and brute force."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from pairforge.functions import scoring, similarity, text
from pairforge.kernel import graph as G
from pairforge.kernel import safe as S
from pairforge.operators import descriptions, fences, fragments, groupsplit, inference, pairing, qa


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").repartition(1).sortWithinPartitions("i").select(*cols).collect()]


def test_fragment_readers(spark):
    c = F.col("x")
    got = values(spark, [(" b . a..b",), (None,), ("",), (" a . ",), ("a b.c",)], "x string", text.fragment_set(c), text.fragment_list(c), text.fragment_count(c), text.fragment_join(text.fragment_set(c)))
    assert got == [(["b", "a"], ["b", "a", "b"], 3, "a.b"), ([], [], 0, ""), ([], [], 0, ""), (["a"], ["a"], 1, "a"), (["a b", "c"], ["ab", "c"], 2, "a b.c")]


def test_cell_fragments(spark):
    got = values(spark, [(None,), ("  ",), (" NaN ",), ("a. b ..nan",), ("C1CC1.C1",)], "x string", text.cell_fragments(F.col("x")))
    assert got == [([],), ([],), ([],), (["a", "b", "nan"],), (["C1CC1", "C1"],)]


def test_strings(spark):
    c = F.col("x")
    rows = ["a\\b", "it's", 'say "it\'s"', "tab\t", "plain", "é"]
    assert [r[0] for r in values(spark, [(x,) for x in rows], "x string", text.py_repr(c))] == [repr(x) for x in rows]
    assert values(spark, [(" \t a\n",), (None,)], "x string", text.strip(c), text.str_or_empty(c), text.blank_key(c)) == [("a", "a", "\t a\n"), (None, "", "")]
    assert values(spark, [("abc",), ("a",), ("",), (None,)], "x string", text.char_ngrams(c, 2)) == [(["ab", "bc"],), ([],), ([],), (None,)]


SCORES = [
    # gold, pred, em, f1, bleu, lev
    ("a.b", "b.a", 1, 1, 1, 0), ("a.b", "a.b.b", 0, 1, 3 / 5, 0), ("a.b", "", 0, 0, 0, 3), ("", "", 0, 1, 0, 0), ("a.b", "a.a.c", 0, 0.5, 2 / 5, 1 / 3),
    ("bbb", "abbc", 0, 0, 0.5, 2), ("ab.ce", "ab.cd", 0, 0.5, 4 / 5, 0.5), ("abc", "", 0, 0, 0, 3), (".", "", 1, 1, 0, 1),
]


def test_scores(spark):
    g, p = F.col("g"), F.col("p")
    got = values(spark, [(a, b) for a, b, *_ in SCORES], "g string, p string", scoring.fragment_em(g, p), scoring.set_f1(g, p), scoring.bleu1(g, p), scoring.fragment_levenshtein(g, p))
    for row, (_, _, *want) in zip(got, SCORES):
        assert row == pytest.approx(tuple(want)), (row, want)


def test_bleu_of_any_tokens(spark):
    from collections import Counter

    g, p = F.col("g"), F.col("p")
    pairs = [(a, b) for a, b, *_ in SCORES] + [(None, "a"), ("a b.c", " ab.c "), ("abcabc", "bcabca")]
    grams = lambda s, n: [s[i : i + n] for i in range(len(s) - n + 1)]

    def want(a, b):
        a, b = Counter(a), Counter(b)
        return sum((a & b).values()) / sum(b.values()) if a and b else 0

    bare = lambda x: (x or "").strip().replace(" ", "")
    got = values(spark, pairs, "g string, p string", *[scoring.bleu(g, p, n) for n in (1, 2, 4)], scoring.bleu(g, p, characters=False))
    for row, (a, b) in zip(got, pairs):
        assert row == pytest.approx((*[want(grams(bare(a), n), grams(bare(b), n)) for n in (1, 2, 4)], want([x for x in bare(a).split(".") if x], [x for x in bare(b).split(".") if x])))


def test_score_queries_keep_every_row(spark, tmp_path):
    from pairforge.plans import pair_queries

    cells = [("C.é", "C.e"), ("naïve😀", "naive😀.C"), ("C\tN", "CN"), ("C.N", "C.N"), (None, "ß"), ("a\u0301", "á"), ("é.é", "é")]
    rows = [(i, "test", a, b) for i, (a, b) in enumerate(cells)]
    spark.createDataFrame(rows, "cliff_id bigint, split string, only_toxic_safe_fragments string, only_nontoxic_safe_fragments string").write.parquet(f"{tmp_path}/toxicitycliff.parquet")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    def scores(gold, pred):
        g, p = [[t for t in (x or "").split(".") if t] for x in (gold, pred)]
        lev = sum(min(distance(x, y) for y in g) for x in p) / len(p) if g and p else distance(gold or "", pred or "")
        bleu = sum(min(pred.count(c), gold.count(c)) for c in set(pred)) / len(pred) if gold and pred else 0.0
        both = len(set(g) & set(p))
        return (float(bool(gold) and sorted(g) == sorted(p)), 2 * both / (len(set(g)) + len(set(p))), bleu, lev)

    want = {i: scores(a, b) for i, (a, b) in enumerate(cells)}
    got = {r["cliff_id"]: (r["em"], r["f1"], r["bleu"], r["lev"]) for r in pair_queries.fragment_scores(spark, str(tmp_path)).collect()}
    assert got == {i: pytest.approx(v) for i, v in want.items()}
    assert sum(r["total"] for r in pair_queries.summary(spark, str(tmp_path)).collect()) == len(cells)
    assert max(r["total"] for r in pair_queries.summary_rollup(spark, str(tmp_path)).collect()) == len(cells)


def test_property_scores(spark):
    x = F.col("x")
    got = values(spark, [(0.0,), (0.5,)], "x double", *[scoring.from_difference(x, m) for m in ("exponential", "linear", "reciprocal")])
    assert got[0] == (1, 1, 1) and got[1] == pytest.approx((math.exp(-0.5), 0.5, 2 / 3))
    with pytest.raises(ValueError):
        scoring.from_difference(x, "other")
    rows = [(0.4, 0.9), (float("nan"), 0.5), (None, 0.5), (float("inf"), 0.1)]
    got = values(spark, rows, "t double, p double", scoring.prs(F.col("t"), F.col("p"))["score"])
    assert [r[0] for r in got] == pytest.approx([math.exp(-0.5), 0, 0, 0])
    mean = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,), (float("inf"),)], "x double").agg(F.avg(scoring.finite(x)), F.count(scoring.finite(x))).first()
    assert tuple(mean) == (2, 2)
    with pytest.raises(ValueError):
        scoring.metric_keys("task9", "single_step")
    assert scoring.metric_keys("task3_nontoxic_safe_generation", "multi_step")[0] == "exact_match"


def test_molecule_metrics(spark):
    cols = "task string, step string, g string, p string, cg string, cp string, ci string, ok boolean, sim double"
    mol = {"can_gold": F.col("cg"), "can_pred": F.col("cp"), "can_input": F.col("ci"), "valid": F.col("ok"), "morgan": F.col("sim"), "rdk": F.col("sim"), "maccs": F.col("sim"), "prs": F.col("sim")}
    m = scoring.task_metrics(F.col("task"), F.col("step"), F.col("g"), F.col("p"), mol)
    rows = [("task3", "single_step", "CC", "CC", "CC", "CC", "CC", True, 0.5), ("task3", "single_step", "CC", "x(", "CC", None, "CC", False, None), ("task1", "multi_step", "a", "a", None, None, None, None, None)]
    got = values(spark, rows, cols, *[m[k] for k in ("exact_match", "bleu", "levenshtein", "validity", "copy_rate", "prs_property_score", "fragment_EM", "fragment_F1")])
    assert got == [(1, 1, 0, 1, 1, 0.5, None, None), (0, 0, 0, 0, 0, 0, None, None), (None, None, None, None, None, None, 1, 1)]


def test_compare_and_filters(spark):
    rows = [("a.b.c", "b.c.d"), ("a.b", "b.a"), ("", "a"), ("a.b", "b." + "x" * 28), ("a.b", "b." + "x" * 27), ("a." + "b.c.d.e.f", "a"), (None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, toxic_safe string, nontoxic_safe string")
    out = fragments.compare_fragments(df)
    first = out.where("i = 0").first()
    assert (first["common_safe_fragments"], first["only_toxic_safe_fragments"], first["only_nontoxic_safe_fragments"], first["n_common_safe"], first["n_only_toxic_safe"], first["n_only_nontoxic_safe"], first["has_safe_diff"]) == ("b.c", "a", "d", 2, 1, 1, True)
    kept = lambda x: sorted(r["i"] for r in x.select("i").collect())
    assert kept(fences.core_filter(out)) == [0, 3, 4, 5]
    assert kept(fences.fragment_filters(out, use_iqr=False)) == [0, 4]
    assert kept(fences.fragment_filters(out.where("i < 3"))) == [0]
    assert kept(fences.fragment_filters(out.limit(0))) == []
    with pytest.raises(ValueError, match="toxic_safe"):
        fragments.compare_fragments(df.drop("toxic_safe"))


def test_fences(spark):
    one = lambda xs: spark.createDataFrame([(x,) for x in xs], "x double").agg(fences.upper_fence(F.col("x"))).first()[0]
    assert one([1.0, 2.0, 3.0]) is None and one([5.0] * 4) is None and one([1.0, 2.0, 4.0, 9.0, 11.5]) == 19.5
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, 5.0), (5, 6.0), (6, None), (7, float("nan"))], "i int, x double")
    assert sorted(r["i"] for r in fences.drop_outliers(df, ["x"]).collect()) == [1, 2, 3, 4, 6, 7]
    assert fences.drop_outliers(df.limit(0), ["x"]).count() == 0


def test_split_equals_greedy(spark):
    for seed in range(4):
        rnd = random.Random(seed)
        groups = [rnd.choice([None, "", *"abcdefghijklmnop"]) for _ in range(rnd.choice([10, 60]))] if seed else ["a", "b", "c", "c"] + ["d"] * 6
        df = spark.createDataFrame(list(enumerate(groups)), "row int, g string")
        by = {}
        for i, g in enumerate(groups):
            if g is not None:
                by.setdefault(g, []).append(i)
        test, budget = set(), 0.1 * len(groups)
        for rows in sorted(by.values(), key=lambda r: (len(r), r[0])):
            if len(test) + len(rows) <= budget:
                test |= set(rows)
        for split in (groupsplit.smallest_first_split, groupsplit.window_split):
            assert {r["row"] for r in split(df, "row", F.col("g")).where("split = 'test'").collect()} == test
    assert groupsplit.smallest_first_split(df.limit(0), "row", F.col("g")).count() == 0


def test_seeded_shuffle(spark):
    places = list(range(30))
    random.Random(7).shuffle(places)
    df = spark.createDataFrame([(i,) for i in range(30)], "id long").withColumn("was", F.col("id"))
    got = {r["id"]: r["was"] for r in groupsplit.seeded_permutation(df, "was", 7).collect()}
    assert [got[i] for i in range(30)] == places and groupsplit.seeded_permutation(df, "was", None) is df


def test_integer_rules_equal_float_rules():
    for longest in range(1, 400):
        for d in range(longest + 1):
            assert (1 - d / longest >= 0.9) == (10 * d <= longest) or abs(1 - d / longest - 0.9) < 1e-12


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_pairing_equals_brute_force(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(25):
        base = "".join(rnd.choices(["CC", "c1ccccc1", "N", "O(C)", "="], k=rnd.choice([1, 2, 4, 12, 25])))
        for _ in range(4):
            t = base
            for _ in range(rnd.randrange(0, 2 + len(base) // 9)):
                at = rnd.randrange(len(t) + 1)
                t = t[:at] + rnd.choice("CNO") + t[at + rnd.randrange(2) :]
            rate = rnd.choice([0.0, 0.03, 0.4])
            bits = [i % 2 ^ (rnd.random() < rate) for i in range(40)]
            rows.append((rnd.choice(["d", "d", "e"]), rnd.choice(["x", "x", None]), rnd.choice([t, t, t, None]), rnd.choice([0, 1, 0, 1, 2, None]), [sum(b << i for i, b in enumerate(bits)), -1] if rnd.random() < 0.7 else None))
    df = spark.createDataFrame([(*r, "clash") for r in rows], "dataset_name string, endpoint string, smiles string, label int, fp array<bigint>, piece string")
    tan = lambda a, b: a and b and (lambda z, u: 10 * z >= 9 * u)(sum(((x & y) % 2**64).bit_count() for x, y in zip(a, b)), sum(((x | y) % 2**64).bit_count() for x, y in zip(a, b)))
    rows = list({(d, e, s, lab): (d, e, s, lab, fp) for d, e, s, lab, fp in rows}.values())
    df = spark.createDataFrame([(*r, "clash") for r in rows], df.schema)
    usable = [r for r in rows if r[1] and r[2]]
    near = {(a[0], a[1], a[2], b[2]) for a in usable if a[3] == 1 for b in usable if b[3] == 0 and a[:2] == b[:2] and 10 * lev(a[2], b[2]) <= max(len(a[2]), len(b[2]))}
    bits = {(a[0], a[1], a[2], b[2]) for a in usable if a[3] == 1 for b in usable if b[3] == 0 and a[:2] == b[:2] and tan(a[4], b[4])}
    got = lambda x: {tuple(r) for r in x.collect()}
    assert got(pairing.pair_molecules(df.drop("fp"))) == near and near
    assert got(pairing.pair_molecules(df.drop("fp"), by_length=True)) == near
    assert got(pairing.pair_molecules(df)) == near | bits and bits - near
    assert pairing.pair_molecules(df.limit(0)).count() == 0


def test_sketches_lose_no_pair_and_spare_most_edit_distances(spark):
    rnd = random.Random(5)
    rows = []
    for _ in range(60):
        t = "".join(rnd.choices(["CC", "c1ccccc1", "N", "O(C)", "=", "S(=O)", "\U0001f600é"], k=rnd.choice([1, 3, 12, 30, 60])))
        for lab in (0, 1):
            for _ in range(rnd.randrange(0, 2 + len(t) // 10)):
                at = rnd.randrange(len(t) + 1)
                t = t[:at] + rnd.choice(["C", "N", ""]) + t[at + rnd.randrange(2) :]
            rows.append(("d", "e", t or "C", lab))
    toxic, nontoxic = pairing.sides(spark.createDataFrame(rows, "dataset_name string, endpoint string, smiles string, label int"))
    met = pairing._sketched(toxic, "toxic").crossJoin(pairing._sketched(nontoxic.toDF(*["k1", "k2"], "nontoxic_smiles").withColumnsRenamed({"k1": "dataset_name", "k2": "endpoint"}), "nontoxic").drop("dataset_name", "endpoint"))
    seen = [(r["toxic_smiles"], r["nontoxic_smiles"], r["ok"]) for r in met.withColumn("ok", pairing._sketches_near()).collect()]
    near = [ok for a, b, ok in seen if 10 * lev(a, b) <= max(len(a), len(b))]
    assert near and all(near) and sum(ok for *_, ok in seen) < len(seen) / 5


@pytest.mark.parametrize("by_length", [False, True])
def test_exploded_sides_are_never_broadcast(spark, tmp_path, by_length):
    """Spark estimates rows with their copies to be as small as their table, here far under its limit for a broadcast."""
    spark.createDataFrame([("d", "e", "CCO" * 9 + str(i), i % 2, [-1, 7]) for i in range(20)], "dataset_name string, endpoint string, smiles string, label int, fp array<bigint>").write.parquet(str(tmp_path / "m"))
    toxic, nontoxic = pairing.sides(spark.read.parquet(str(tmp_path / "m")))
    out = [(pairing.length_candidates if by_length else pairing.text_candidates)(toxic, nontoxic), pairing.bit_candidates(toxic, nontoxic, "fp")]
    for df in out:
        joins = [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "HashJoin [key" in x or "HashJoin [dataset_name" in x and "block" in x]
        assert joins == [] and df.count() == 100


def test_tanimoto(spark):
    got = values(spark, [([3, 0], [1, 0]), ([0, 0], [0, 0]), (None, [1, 1]), ([-1, -1], [-1, -1])], "a array<bigint>, b array<bigint>", similarity.tanimoto(F.col("a"), F.col("b")), similarity.tanimoto_090(F.col("a"), F.col("b")))
    assert got == [(0.5, False), (0.0, False), (None, False), (1.0, True)]
    assert values(spark, [("abcd", "abcf"), ("", "")], "a string, b string", similarity.lev_similarity(F.col("a"), F.col("b"))) == [(0.75,), (1.0,)]


def qa_rows(spark):
    rows = [(0, "ames", "", "a.b", "a.c", "b", "c", "C\\C", None, "CO"), (1, "", "", "a", "a", "b", "c", "C", "x", "CO"), (2, None, "Eye disorders", "a", "b", "", None, None, "CC", "C"), (3, "tox21", "NR-AR", "a", "b", "x.y", "z", "C", None, "C")]
    return spark.createDataFrame(rows, "source_index long, dataset_name string, endpoint string, toxic_safe string, nontoxic_safe string, only_toxic_safe_fragments string, only_nontoxic_safe_fragments string, toxic_smiles string, toxic_safe_decoded_smiles string, nontoxic_smiles string")


def test_records(spark):
    df = descriptions.with_description(qa_rows(spark), descriptions.dimension(spark))
    out = {(r["task"], r["id"]): r for r in qa.build_qa(df).collect()}
    assert {i for _, i in out} == {0, 2, 3} and len(out) == 15
    assert out["task1", 2]["step"] == "multi_step" and out["task1", 0]["step"] == "single_step" and out["task2", 0]["step"] == "single_step" and out["task1", 3]["step"] == "multi_step"
    r = out["task1", 0]
    assert "SMILES = 'C\\\\C'" in r["question"] and r["question"].endswith(" " + qa.ONE_KEY) and r["answer"]["answer"] == "b" and "mutations" in r["question"]
    assert out["task2", 0]["nontoxic_safe_decoded_smiles"] == "CO" and out["task1", 0]["nontoxic_safe_decoded_smiles"] is None
    assert out["task3_cot_safe_gen", 0]["answer"]["gold_only_toxic_safe_fragments"] == "b" and out["task3_cot_safe_gen", 0]["question"].endswith("\n\n" + qa.THREE_KEYS)
    assert out["task3_smiles_gen", 0]["answer"]["answer"] == "CO" and out["task3_safe_gen", 0]["answer"]["answer"] == "a.c"
    assert "SMILES = 'CC'" in out["task1", 2]["question"] and "SMILES" not in qa.build_qa(df, ["task1"], mode="only_safe").where("id = 0").first()["question"].split(qa.PREAMBLE)[1]
    bare = qa.build_qa(df, ["task1"], descriptions=False, output_format=False).where("id = 0").first()["question"]
    assert bare.startswith(qa.PREAMBLE) and not bare.endswith(qa.ONE_KEY)
    with pytest.raises(Exception, match="no description"):
        qa.build_qa(df.withColumn("description", F.lit(None).cast("string"))).collect()
    with pytest.raises(ValueError, match="toxic_safe_decoded_smiles or toxic_smiles"):
        qa.validate(df.drop("toxic_smiles", "toxic_safe_decoded_smiles"))


def test_descriptions(spark):
    keys = [("", ""), (None, "tox21_NR-AR"), (None, "TOX21_NR-AR"), ("x", "eye disorders"), ("x", "Eye disorders"), ("ames", "HERG_unified"), ("AMES", "?"), ("tox21", "SR-p53"), ("tox21", "?"), ("sider", "?"), ("sider", None), ("metabolism", "q"), ("?", "?")]
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "i int, dataset_name string, endpoint string")
    got = {r["i"]: r["description"] for r in descriptions.with_description(df, descriptions.dimension(spark)).collect()}
    assert got[0] == "" and "assay NR-AR " in got[1] and got[2] == descriptions.GENERIC_ASSAY and "class eye disorders." in got[3] and "class: Eye disorders." in got[4]
    assert "hERG" in got[5] and "mutations" in got[6] and "SR-p53" in got[7] and got[8] == descriptions.GENERIC_ASSAY and "class ?" in got[9] and got[10] == descriptions.GENERIC_ORGAN and "enzyme" in got[11] and got[12] is None


def test_replies(spark):
    raws = ['ok {"answer":"a"} bye', "no json", "", None, '{"answer": null}', '{"other": 1}', '"text"', "0", "[1, 2]", '{"answer": "x y "}', "{broken", '{"answer": "{\\"answer\\": 1}"}']
    got = values(spark, [(x,) for x in raws], "raw string", inference.answer_text(F.col("raw")), inference.answer_text(F.col("raw"), compat=True))
    assert [r[0] for r in got] == ["a", "no json", "", "", "", "", "text", "", "[1,2]", "x y", "{broken", '{"answer": 1}']
    assert got[4][1] == "None"
    got = values(spark, [(" C ", "q"), (None, "SMILES = 'CC' x"), ("", "none")], "t string, q string", inference.input_molecule(F.col("t"), F.col("q")))
    assert [r[0] for r in got] == ["C", "CC", ""]


def test_resume_and_models(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, question string")
    before = spark.createDataFrame([(1, "fine"), (2, "ERROR: x")], "id long, raw string")
    left = inference.unanswered(items, before)
    assert sorted(r["id"] for r in left.collect()) == [2, 3]
    got = {r["id"]: r["raw"] for r in inference.ask(left, inference.ReplayProvider({"b": "B"})).collect()}
    assert got == {2: "B", 3: "ERROR: no reply stored"}
    tried = []

    def flaky(system, q):
        tried.append(q)
        if q == "bad" or len(tried) == 1:
            raise RuntimeError("down")
        return q.upper()

    said = inference.RemoteProvider(flaky, workers=1, pause=0).generate("", ["a", "bad"])
    assert said == ["A", "ERROR: down"] and tried == ["a", "bad", "a", "bad", "bad"]
    both = before.unionByName(spark.createDataFrame([(2, "now")], "id long, raw string")).withColumn("at", F.monotonically_increasing_id())
    assert {r["id"]: r["raw"] for r in inference.latest(both, ["id"], "at").collect()} == {1: "fine", 2: "now"}
    assert [r["id"] for r in inference.first_questions(items, 2).collect()] == [1, 2]


def test_providers(tmp_path):
    import pickle

    assert isinstance(inference.load_provider("echo"), inference.EchoProvider) and isinstance(inference.load_provider(str(tmp_path)), inference.LocalProvider)
    chat = inference.load_provider("some-model", 0.1, 3)
    assert (chat.name, chat.temperature, chat.workers) == ("some-model", 0.1, 3)
    chat._client = object()
    assert pickle.loads(pickle.dumps(inference.load_provider(str(tmp_path)))).folder == str(tmp_path) and chat.__getstate__()["_client"] is None

    class Engine:
        def generate(self, prompts, sampling):
            return [type("R", (), {"outputs": [type("O", (), {"text": p + sampling})]}) for p in prompts]

    class Tokens:
        def apply_chat_template(self, talk, tokenize, add_generation_prompt):
            return "|".join(t["content"] for t in talk)

    local = inference.LocalProvider(str(tmp_path))
    local.load = lambda: (Tokens(), Engine(), "!")
    assert local.generate("s", ["a", "b"]) == ["s|a!", "s|b!"]

    class Calls:
        def create(self, model, messages, temperature, response_format):
            return type("R", (), {"choices": [type("C", (), {"message": type("M", (), {"content": messages[1]["content"] + model})})]})

    chat._client = type("C", (), {"chat": type("D", (), {"completions": Calls()})})
    assert chat.generate("s", ["q"]) == ["qsome-model"]


def test_molecule_answers_are_scored(spark):
    from pairforge.kernel.kernels import GraphKernel
    from pairforge.operators import evaluation

    toxic, gold = "CC(C)c1ccccc1CCO", "CC(C)c1ccccc1CCN"
    safe = S.smiles_to_safe(gold)
    asked = [
        ("task3", gold, '{"answer": "NCCc1ccccc1C(C)C"}', (1, 1, 1, 0, 1)), ("task3", gold, toxic, (0, 1, None, 1, None)), ("task3", gold, "C(", (0, 0, 0, 0, 0)), ("task3", "", gold, (0, 1, 0, 0, 0)), ("task3", gold, None, (0, 0, 0, 0, 0)),
        ("task3_nontoxic_safe_generation", safe, safe, (1, 1, 1, 0, 1)), ("task3_stepwise_cot_safe_generation", safe, '{"answer": "C1.C2("}', (0, 0, 0, 0, 0)), ("task1", "a", "a", (None,) * 5),
    ]
    df = spark.createDataFrame([(i, t, "single_step", (g,), r, f"SMILES = '{toxic}'") for i, (t, g, r, _) in enumerate(asked)], "id int, task string, step string, gold struct<answer: string>, raw string, question string")
    got = {r["id"]: r for r in evaluation.with_metrics(df).collect()}
    assert len(got) == len(asked)
    for i, (_, _, _, want) in enumerate(asked):
        r = got[i]
        for name, w in zip(("exact_match", "validity", "bleu", "copy_rate", "morgan_fts"), want):
            assert r[name] == w or w is None and (i == 1 or r[name] is None), (i, name, r[name])
    assert 0 < got[1]["rdk_fts"] < 1 and 0 < got[1]["maccs_fts"] <= 1 and 0 < got[1]["morgan_fts"] < 1 and got[7]["fragment_EM"] == 1
    assert set(evaluation.with_metrics(df.limit(0), GraphKernel(columns=evaluation.SCORING_FIELDS)).columns) >= {"exact_match", "copy_rate"}


def test_inference_run(spark, tmp_path):
    """Limit, resume, failures asked again, files and summaries."""
    from pairforge import cli
    from pairforge.operators import evaluation
    from pairforge.sources import files

    folder = tmp_path / "qa" / "test"
    folder.mkdir(parents=True)
    for name, n in (("test_task1_single", 5), ("test_task3_smiles_gen_multi", 3)):
        rows = [{"id": i, "question": f"q{i} SMILES = 'CCO'", "answer": {"answer": "CCN"}, "dataset_name": "d", "endpoint": "", "source_index": i} for i in range(n)]
        (folder / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    records = files.read_qa(spark, str(tmp_path / "qa"))

    class Sometimes(inference.EchoProvider):
        def generate(self, system, questions):
            assert system in inference.SYSTEM.values()
            return ["ERROR: busy" if q.startswith("q1 ") else '{"answer": "CCN"}' for q in questions]

    out = str(tmp_path / "out")
    first = {(r["task"], r["step"]): r for r in evaluation.run(records, Sometimes(), "a/m", out, limit=2).collect()}
    assert {k: (r["total"], r["inference_samples"]) for k, r in first.items()} == {("task1", "single_step"): (2, 2), ("task3", "multi_step"): (2, 2)}
    assert first["task3", "multi_step"]["metrics_mean"]["exact_match"] == 0.5 and first["task1", "single_step"]["metrics_mean"]["fragment_EM_Acc"] == 50

    class Fine(inference.EchoProvider):
        def generate(self, system, questions):
            assert not any(q.startswith("q0 ") for q in questions)
            return ['{"answer": "CCN"}' for _ in questions]

    second = {r["task"]: r for r in evaluation.run(records, Fine(), "a/m", out).collect()}
    assert {k: (r["total"], r["inference_samples"], r["metrics_mean"]["fragment_EM" if k == "task1" else "exact_match"]) for k, r in second.items()} == {"task1": (5, 4, 1), "task3": (3, 2, 1)}
    every = evaluation.read_predictions(spark, second["task1"]["predictions_path"])
    assert every.count() == 10 and {r["endpoint"] for r in every.select("endpoint").distinct().collect()} == {"d"}
    cli.main(["infer", "--qa", str(tmp_path / "qa"), "--model", "echo", "--out", str(tmp_path / "echo"), "--limit", "1"])
    made = sorted(p.name for p in (tmp_path / "echo").iterdir())
    assert made == ["predictions_echo", "summary_echo_test_task1_single_step.json", "summary_echo_test_task3_multi_step.json"]
    assert json.loads((tmp_path / "echo" / made[1]).read_text())["inference_samples"] == 1


def test_export(spark):
    from pairforge.schema import CLIFF_COLUMNS

    df = spark.createDataFrame([(*"de", " CO ", t, *"abcde", "x") for t in ("CC", "NaN", None, "?")], [*CLIFF_COLUMNS, "more"])
    profile = spark.createDataFrame([("CC", "C-C"), (" CO ", "OC"), ("?", None)], "smiles string, canonical string")
    out = fragments.for_export(df, profile)
    assert out.columns == CLIFF_COLUMNS and sorted((r["toxic_smiles"], r["nontoxic_smiles"]) for r in out.collect()) == [("OC", ""), ("OC", ""), ("OC", "?"), ("OC", "C-C")]
    with pytest.raises(ValueError, match="toxic_safe"):
        fragments.for_export(df.drop("toxic_safe"), profile)


def test_running_means(spark, tmp_path):
    from pairforge.schema import PREDICTIONS
    from pairforge.streaming import means

    for k in range(2):  # the second delivery repeats the first
        spark.createDataFrame([("m", "test", "task1", "single_step", i, float(i % 2)) for i in range(6 + 2 * k)], "model string, split string, task string, step string, id long, fragment_EM double").withColumn("asked_at", F.when(F.col("id") != 3, F.timestamp_seconds(F.col("id") + 1_700_000_000))).write.mode("append").json(f"{tmp_path}/in")
    for late in ("1 hour", None):
        name = f"means_{late is None}"
        q = means.running_means(means.prediction_stream(spark, f"{tmp_path}/in"), ["fragment_EM"], late).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert [(r["total"], r["fragment_EM"]) for r in spark.table(name).collect()] == [(8, 0.5)]
    assert "asked_at" in PREDICTIONS.fieldNames()


def test_bits_of_hot_groups(spark):
    """Many molecules with one fingerprint, fingerprints of a single bit, empty ones, and a size border."""
    def fp(bits):
        words = [0, 0]
        for b in bits:
            words[b // 64] |= 1 << b % 64
        return [w - (1 << 64) if w >> 63 else w for w in words]

    kinds = [[], [5], [127], list(range(9)), list(range(10)), list(range(11)), list(range(3, 40)), list(range(4, 40)), list(range(4, 45)), list(range(60, 128))]
    rows = [("d", "e", f"{lab}-{k}-{i}", lab, fp(b)) for k, b in enumerate(kinds) for lab in (0, 1) for i in range(4)]
    df = spark.createDataFrame(rows, "dataset_name string, endpoint string, smiles string, label int, fp array<bigint>")
    toxic, nontoxic = pairing.sides(df)
    got = [tuple(r)[2:] for r in pairing.bit_candidates(toxic, nontoxic, "fp").collect()]
    want = {(a[2], b[2]) for a in rows if a[3] for b in rows if not b[3] for x, y in [(set(kinds[int(a[2].split("-")[1])]), set(kinds[int(b[2].split("-")[1])]))] if x | y and 10 * len(x & y) >= 9 * len(x | y)}
    assert set(got) == want and len(got) == len(want)
    assert pairing.bit_candidates(toxic.limit(0), nontoxic.limit(0), "fp").count() == 0


def _shuffled(spark) -> dict[int, int]:
    """Records that each stage has written to shuffles so far."""
    found = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return {x.stageId(): x.shuffleWriteRecords() for x in map(found.apply, range(found.size()))}


def test_short_fingerprints_are_judged_where_they_meet(spark):
    """63 bits of uneven frequency, one hot group: what is shuffled follows the fingerprints, not the pairs that share some bits."""
    rnd = random.Random(31)
    rows = []
    for i in range(700):
        bits = sum((rnd.random() < 0.2 + 0.7 * b / 63) << b for b in range(63))
        other = bits ^ sum(1 << b for b in rnd.sample(range(63), rnd.randrange(6)))
        rows += [("d", "e", f"t{i}", 1, [bits]), ("d", "e", f"n{i}", 0, [other] if i % 50 else [other, 0])]
    toxic, nontoxic = pairing.sides(spark.createDataFrame(rows, "dataset_name string, endpoint string, smiles string, label int, fp array<bigint>"))
    before = _shuffled(spark)
    got = {tuple(r)[2:] for r in pairing.bit_candidates(toxic, nontoxic, "fp").collect()}
    moved = sum(n for k, n in _shuffled(spark).items() if k not in before)
    want = {(a[2], b[2]) for a in rows if a[3] for b in rows if not b[3] and len(b[4]) == 1 and 10 * (a[4][0] & b[4][0]).bit_count() >= 9 * (a[4][0] | b[4][0]).bit_count()}
    assert got == want and len(want) > 200
    assert moved < 30 * len(rows)


def test_only_molecules_of_pairs_are_scored(spark, tmp_path):
    rows = [("d", "e", f"{i:04}", i % 2, [i], None if i % 3 else [i, 1]) for i in range(3000)] + [("d", "f", "0003", 1, None, [7, 1])]
    spark.createDataFrame(rows, "dataset_name string, endpoint string, smiles string, label int, fp array<bigint>, scaffold_fp array<bigint>").write.parquet(str(tmp_path / "m"))
    pairs = spark.createDataFrame([("d", "e", "0007", "0006"), ("d", "e", "0009", "0012"), ("d", "e", "gone", "0000")], "dataset_name string, endpoint string, toxic_smiles string, nontoxic_smiles string")
    before = _shuffled(spark)
    scored = pairing.with_scores(pairs, spark.read.parquet(str(tmp_path / "m")))
    got = {r["toxic_smiles"]: (r["text_similarity"], r["fp_similarity"], r["scaffold_fp_similarity"]) for r in scored.collect()}
    assert got == {"0007": (0.75, 2 / 3, None), "0009": (0.5, 1 / 3, 0.5), "gone": (0.0, None, None)}
    assert sum(n for k, n in _shuffled(spark).items() if k not in before) < 100


def test_summary(spark):
    rows = [("m", "test", "task1", "single_step", 1.0, None, None), ("m", "test", "task1", "single_step", float("nan"), None, None), ("m", "test", "task3", "multi_step", None, None, None)]
    df = spark.createDataFrame(rows, "model string, split string, task string, step string, fragment_EM double, fragment_F1 double, fragment_Levenshtein double")
    df = df.withColumns({k: F.lit(None).cast("double") for k in ("exact_match", "bleu", "morgan_fts", "validity", "prs_property_score", "copy_rate")})
    got = {r["task"]: (r["total"], r["metrics_mean"]) for r in inference.summarise(df).collect()}
    assert got["task1"] == (2, {"fragment_EM": 1.0, "fragment_EM_Acc": 100.0})
    assert got["task3"][0] == 1 and got["task3"][1]["exact_match_Acc"] is None and len(got["task3"][1]) == 7


MOLS = ["CCO", "c1ccccc1CC(=O)N", "C[C@H](N)C(=O)O", "CC(C)(C)c1ccc(O)cc1", "C1CC2CCC1C2CCN", "[NH3+]CC.[Cl-]", "C1CC1C1CC1", "N#CCCCBr", "C%12CCCCC%12CC"]


@pytest.mark.parametrize("slicer", list(S.SLICERS))
def test_safe_round_trips(slicer):
    for m in MOLS:
        want = G.canonical(G.parse(m))
        assert G.canonical(G.parse(want)) == want
        for seed in range(5):
            assert G.canonical(S.Converter.randomize(G.parse(m), seed)) == want
        try:
            safe = S.Converter(slicer).encode(m)
        except S.FragmentationError:
            assert S.Converter(slicer).encode(m, allow_empty=True)
            continue
        assert S.Converter().decode(safe, canonical=True) == want
        assert S.Converter().decode(S.Converter(slicer).encode(m, randomize=True, seed=3), canonical=True) == want


def test_more_cuts_than_two_digits(spark):
    from pairforge.kernel.kernels import GraphKernel

    text = "CO" * 60 + "C"
    safe = S.smiles_to_safe(text, slicer="rotatable")
    assert safe.count(".") == 118 and "%(100)" in safe and "%99" in safe and G.ring_numbers("C%(100)C%12C3") == [100, 12, 3]
    assert S.safe_to_smiles(safe) == G.canonical(G.parse(text))
    assert S.Converter().decode("C%(123).C%(124).N%(123)", canonical=True) == G.canonical(G.parse("CN.C"))
    rows = spark.createDataFrame([(text,)], "smiles string")
    assert GraphKernel("rotatable").profile(rows).first()["safe"] == safe


def test_safe_details():
    c = S.Converter("rotatable")
    assert c.ensure_valid("CC1.C%10") == "CC1.C%10.[*:1]1.[*:10]%10" and G.ring_numbers("C1[13C]%12C1") == [1, 12, 1]
    assert c.decode("CC1", canonical=True) == G.canonical(G.parse("CC"))
    with pytest.raises(S.DecodeError):
        c.decode("C(")
    assert c.decode("C(", ignore_errors=True) is None
    with pytest.raises(S.EncodeError):
        c.encode("C(")
    with pytest.raises(S.FragmentationError):
        c.encode("CC")
    assert S.Converter(lambda g: [(1, 2)]).encode("CCCC").count(".") == 1
    assert S.Converter("rotatable").encode("CCCCCC", constraints=[{1, 2}]).count(".") == 2
    with pytest.raises(ValueError):
        S.Converter("recap?")
    assert G.canonical(G.scaffold(G.parse("CC(c1ccccc1)CCC1CC1"))) == G.canonical(G.parse("C(c1ccccc1)CCC1CC1")) and not G.scaffold(G.parse("CCC")).atoms
    for bad in ("", "C(", "C)", "C1", "=C", "C==C", "C.=C", "C11", "?"):
        with pytest.raises(G.ParseError):
            G.parse(bad)


# Published values: exact mass, logP, polar surface, donors, acceptors, rotatable bonds.
KNOWN = {
    "CC(=O)Oc1ccccc1C(=O)O": (180.0423, 1.3101, 63.60, 1, 3, 2), "Cn1c(=O)c2c(ncn2C)n(C)c1=O": (194.0804, -1.0293, 61.82, 0, 6, 0), "CC(=O)Nc1ccc(O)cc1": (151.0633, 1.3506, 49.33, 2, 2, 1), "c1ccccc1": (78.0470, 1.6866, 0, 0, 0, 0),
    "Cc1ccccc1": (92.0626, 1.9950, 0, 0, 0, 0), "CCO": (46.0419, -0.0014, 20.23, 1, 1, 0), "CC(C)Cc1ccc(cc1)C(C)C(=O)O": (206.1307, 3.0732, 37.30, 1, 1, 4), "c1ccncc1": (79.0422, 1.0816, 12.89, 0, 1, 0), "Nc1ccccc1": (93.0578, 1.2688, 26.02, 1, 1, 0),
}


@pytest.mark.parametrize("text", KNOWN)
def test_properties_of_known_molecules(text):
    from pairforge.kernel.properties import descriptors

    assert list(descriptors(G.parse(text)).values()) == pytest.approx(KNOWN[text], abs=6e-4)
    # However it is written.
    assert list(descriptors(G.parse(G.canonical(G.parse(text)))).values()) == pytest.approx(KNOWN[text], abs=6e-4)


def test_patterns():
    from pairforge.kernel.smarts import PatternError, View, pattern

    found = lambda p, text: sorted(pattern(p).matches(View(G.parse(text))))
    assert found("C=O", "CC(=O)O") == [(1, 2)] and found("[#6]!@[#8;D1]", "CC(=O)O") == [(1, 2), (1, 3)] and found("[OH]", "CC(=O)O") == [(3,)]
    assert found("[$(C=O)]-[O,N]", "CC(=O)NC") == [(1, 3)] and found("[!#6]", "CCO") == [(2,)] and found("c1ccccc1", "Cc1ccccc1")[0][0] == 1 and len(found("c1ccccc1", "c1ccccc1")) == 12
    assert found("[R]", "C1CC1C") == [(0,), (1,), (2,)] and found("[r3]", "C1CC1C1CCC1") == [(0,), (1,), (2,)] and found("[r4;R1]", "C1CC1C1CCC1")[0] == (3,)
    assert found("[N+;H3]", "[NH3+]C") == [(0,)] and found("[#7;+0,-]", "[NH3+]CN") == [(2,)] and found("[X4;!H0]", "CC(F)(F)F") == [(0,)] and found("A~a", "Cc1ccccc1") == [(0, 1)] and found("[v4]", "CO") == [(0,)]
    assert found("c-!@c", "c1ccccc1c1ccccc1") == [(5, 6), (6, 5)] and found("C/C=C/C", "CC=CC") == [(0, 1, 2, 3), (3, 2, 1, 0)] and found("[C@H](N)C", "CC(N)C")[0] == (1, 2, 0)
    for bad in ("", "C(", "[C", "C1", "[Q]", "[C;]", "C=", "$(C"):
        with pytest.raises(PatternError):
            pattern(bad)


def test_rules_for_cutting():
    cut = lambda text, slicer: sorted(S.Converter(slicer).fragment(G.parse(text), True))
    assert cut("CC(=O)Oc1ccccc1C(=O)O", "brics") == [(1, 3), (3, 4), (9, 10)] and cut("CCCC", "brics") == [] and cut("CCOCC", "brics") == [(1, 2), (2, 3)] and cut("CC=CC", "brics") == [(1, 2)]
    assert (1, 3) in cut("CC(=O)Nc1ccc(O)cc1", "recap") and cut("c1ccccc1c1ccccc1", "recap") == [(5, 6)]
    assert cut("CCOC", ["[#6]-[#8]"]) == [(1, 2), (2, 3)] and cut("CCOC", "C-O") == [(1, 2), (2, 3)]
    assert S.smiles_to_safe("CCOCC", constraints=["CO"], allow_empty=True).count(".") == 0
    hydrogens = S.with_hydrogens(G.parse("C[NH3+]"))
    assert len(hydrogens.atoms) == 8 and G.canonical(S.without_hydrogens(hydrogens)) == G.canonical(G.parse("C[NH3+]"))
    whole = S.smiles_to_safe("CO", slicer="attach")
    assert whole.count("[H]") == 4 and S.safe_to_smiles(whole) == G.canonical(G.parse("CO")) and "[H]" in S.safe_to_smiles(whole, remove_added_hs=False)
    assert S.Converter().decode("CO", as_graph=True).atoms == ["C", "O"]


#: What the kernel makes of a few texts: canonical form, fragments, scaffold.  These are its own and must not change by chance.
PROFILES = {
    "CC(=O)Oc1ccccc1C(=O)O": ("CC(=O)Oc1ccccc1C(O)=O", "c1ccc4c3c1.CC2=O.C3(O)=O.O24", "c1ccccc1"),
    "CC(C)Cc1ccc(cc1)C(C)C(=O)O": ("CC(C)Cc1ccc(C(C)C(O)=O)cc1", "c1cc3ccc12.CC3C(O)=O.CC(C)C2", "c1ccccc1"),
    "C[C@H](N)C(=O)O": ("C[C@H](C(O)=O)N", "", ""),
    "[NH3+]CC.[Cl-]": ("CC[NH3+].[Cl-]", "", ""),
    "C1CC2CCC1C2CCN": ("C1CC2CCC1C2CCN", "C1CC2CCC1C23.C3CN", "C1CC2CCC1C2"),
    "C1CC(": (None, None, None),
    "": (None, None, None),
}


def test_profiles_against_a_fixed_table(spark):
    from pairforge.kernel.kernels import GraphKernel

    df = spark.createDataFrame([(t,) for t in [*PROFILES, *PROFILES, None]], "smiles string").repartition(3)
    got = {r["smiles"]: r for r in GraphKernel(columns=[*("canonical", "safe", "scaffold", "fp", "path_fp", "keys_fp")]).profile(df).collect()}
    assert {t: (r["canonical"], r["safe"], r["scaffold"]) for t, r in got.items()} == PROFILES
    assert [len(got["C1CC2CCC1C2CCN"][c]) for c in ("fp", "path_fp", "keys_fp")] == [16, 32, 3] and got["C1CC2CCC1C2CCN"]["props"] is None


def test_kernels(spark):
    from pairforge.kernel.kernels import GraphKernel, TableKernel, register

    df = spark.createDataFrame([("CCO",), ("CCO",), ("c1ccccc1CCN",), ("bad(",), (None,)], "smiles string")
    got = {r["smiles"]: r for r in GraphKernel().profile(df).collect()}
    assert set(got) == {"CCO", "c1ccccc1CCN", "bad("} and got["bad("]["canonical"] is None and got["CCO"]["scaffold"] == "" and got["CCO"]["scaffold_fp"] is None
    assert len(got["CCO"]["fp"]) == 16 and got["CCO"]["props"]["MW"] == pytest.approx(46.0419, abs=1e-4) and got["CCO"]["props"]["HBD"] == 1 and got["CCO"]["props"]["logP"] == pytest.approx(-0.0014)
    table = spark.createDataFrame([("CCO", "OCC")], "smiles string, canonical string")
    got = {r["smiles"]: r["canonical"] for r in TableKernel(table).profile(df).collect()}
    assert got == {"CCO": "OCC", "c1ccccc1CCN": None, "bad(": None}
    register(spark)
    assert tuple(spark.sql("SELECT safe_to_smiles(smiles_to_safe('CCOCC')) = canonical_smiles('CCOCC'), smiles_to_safe('C(')").first()) == (True, None)
    assert tuple(spark.sql("SELECT safe_validity('C1.N1'), safe_validity('C1.N('), safe_validity(' '), safe_validity(NULL)").first()) == (1, 0, 0, 0)


def test_files(spark, tmp_path):
    from pairforge.sources import files
    from pairforge.schema import CLIFF_COLUMNS

    (tmp_path / "in.csv").write_text('dataset_name,endpoint,smiles,label\nd,"a,b",CC,1\nd,"x ""q""",C,\n')
    assert [tuple(r) for r in files.read_molecules(spark, str(tmp_path / "in.csv")).collect()] == [("d", "a,b", "CC", 1), ("d", 'x "q"', "C", None)]
    assert [(r["source_index"], r["label"]) for r in files.read_csv_texts(spark, str(tmp_path / "in.csv")).orderBy("source_index").collect()] == [(0, "1"), (1, None)]
    rows = spark.range(100).repartition(7).select(F.col("id"), (F.lit(100) - F.col("id")).alias("k"))
    assert {r["k"]: r["row_id"] for r in files.ordered_ids(rows, ["k"]).collect()} == {k: k - 1 for k in range(1, 101)}
    df = descriptions.with_description(qa_rows(spark), descriptions.dimension(spark)).withColumn("split", F.lit("test"))
    records = qa.build_qa(df)
    for _ in range(2):  # the second run replaces the first
        files.write_qa(records, str(tmp_path / "qa"))
    assert sorted(p.name for p in (tmp_path / "qa").iterdir()) == ["test"] and "test_task1_single.jsonl" in {p.name for p in (tmp_path / "qa" / "test").iterdir()}
    back = files.read_qa(spark, str(tmp_path / "qa"))
    named = records.replace(qa.TASKS, subset="task")
    assert sorted(map(str, back.select(*sorted(back.columns)).collect())) == sorted(map(str, named.select(*sorted(back.columns)).collect())) and back.count() == 15
    folder = tmp_path / "bundle" / "test"
    folder.mkdir(parents=True)
    (folder / "test_task3_cot_safe_gen_multi.jsonl").write_text(json.dumps({"id": 1, "question": "é", "answer": {"answer": "a"}}, ensure_ascii=False) + "\n\n")
    (folder / "other.jsonl").write_text("{}\n")
    assert [(r["split"], r["task"], r["step"], r["question"]) for r in files.read_qa(spark, str(tmp_path / "bundle")).collect()] == [("test", "task3_stepwise_cot_safe_generation", "multi_step", "é")]
    out = spark.createDataFrame([(2, *"abcdefghi"), (1, *"ABCDEFGHI")], ["n", *CLIFF_COLUMNS])
    files.write_csv(out, str(tmp_path / "out"), order_by="n", one_file=True)
    lines = next((tmp_path / "out").glob("*.csv")).read_text().splitlines()
    assert lines == [",".join(CLIFF_COLUMNS), "A,B,C,D,E,F,G,H,I", "a,b,c,d,e,f,g,h,i"]
    for _ in range(2):
        files.append_predictions(spark.range(2), str(tmp_path / "pred"))
    assert spark.read.json(str(tmp_path / "pred")).count() == 4
    paths = files.write_summary(spark.sql("SELECT 'm' AS model, 's' AS split, 't' AS task, 'single' AS step, 3 AS total"), str(tmp_path / "sum"))
    assert json.loads(open(paths[0]).read())["total"] == 3


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("parts", ["2", "8", "40"])
def test_row_numbers_do_not_hang_on_samples(spark, tmp_path, parts, adaptive):
    from pairforge.sources import files

    setting = {"spark.sql.shuffle.partitions": parts, "spark.sql.adaptive.enabled": adaptive, "spark.sql.execution.rangeExchange.sampleSizePerPartition": "2"}
    before = {k: spark.conf.get(k) for k in setting}
    try:
        for k, v in setting.items():
            spark.conf.set(k, v)
        rows = spark.range(5000, numPartitions=7).select(F.xxhash64("id").alias("k"), F.lit(None).cast("string").alias("__x"))
        want = {k: i for i, k in enumerate(sorted(r["k"] for r in rows.collect()))}
        got = files.ordered_ids(rows, ["k"]).collect()
        assert {r["k"]: r["row_id"] for r in got} == want and len(got) == 5000
        # Parts of a CSV count in order of their names, whatever their sizes.
        files.write_csv(files.ordered_ids(rows, ["k"]).select("row_id", F.col("k").cast("string").alias("k")).withColumn("n", F.col("row_id")), f"{tmp_path}/csv", order_by="row_id")
        assert all(int(r["n"]) == r["source_index"] for r in files.read_csv_texts(spark, f"{tmp_path}/csv").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_row_numbers_of_nothing(spark):
    from pairforge.sources import files

    assert files.ordered_ids(spark.range(0), ["id"]).count() == 0


def test_alias_lookup(spark):
    prof = spark.createDataFrame([("a", "A", "s1"), ("A", "A", "s2"), ("b", None, None)], "smiles string, canonical string, safe string")
    pairs = spark.createDataFrame([("a", "b"), ("zz", "A"), (None, "a")], "toxic_smiles string, nontoxic_smiles string")
    got = {(r["toxic_smiles"], r["nontoxic_smiles"]): (r["toxic_safe"], r["nontoxic_safe"]) for r in fragments.attach_safe(pairs, prof).collect()}
    assert got == {("a", "b"): ("s1", ""), ("zz", "A"): ("", "s2"), (None, "a"): ("", "s1")}


def test_sql_functions(spark):
    from pairforge.functions import sql

    sql.register(spark)
    df = spark.createDataFrame([(a, b) for a, b, *_ in SCORES] + [(" b . a..b", None)], "g string, p string")
    df.createOrReplaceTempView("scored")
    got = spark.sql("SELECT fragment_set(g), fragment_list(g), set_f1(g, p), bleu1(g, p), fragment_levenshtein(g, p), tanimoto_words(array(3L, 0L), array(1L, 0L)) FROM scored").collect()
    g, p = F.col("g"), F.col("p")
    want = df.select(text.fragment_set(g), text.fragment_list(g), scoring.set_f1(g, p), scoring.bleu1(g, p), scoring.fragment_levenshtein(g, p), F.lit(0.5)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


def test_commands(spark, tmp_path):
    from pairforge import cli

    mols = ["CC(C)c1ccccc1CCN(C)CCO", "CC(C)c1ccccc1CCN(C)CCN", "CC(C)c1ccccc1CCN(C)CCCl", "OCCN(C)CC1CC1", "OCCN(C)CC1CC1F"]
    (tmp_path / "m.csv").write_text("dataset_name,endpoint,smiles,label\n" + "\n".join(f"ames,ames,{m},{i % 2}" for i, m in enumerate(mols)) + "\n")
    run = lambda *a: cli.main(list(map(str, a)))
    run("pair", "--input", tmp_path / "m.csv", "--out", tmp_path / "pairs", "--no-iqr", "--keep-property-outliers")
    pairs = spark.read.option("header", True).csv(str(tmp_path / "pairs"))
    assert pairs.count() >= 2
    run("split", "--input", tmp_path / "pairs", "--out-dir", tmp_path / "split", "--test-share", 0.5)
    n = [spark.read.option("header", True).csv(str(tmp_path / "split" / f"{s}.csv")).count() for s in ("train", "test")]
    assert sum(n) == pairs.count()
    run("build", "--input", tmp_path / "pairs", "--out", tmp_path / "qa", "--task", "task1")
    from pairforge.sources import files

    records = files.read_qa(spark, str(tmp_path / "qa"))
    assert records.count() == pairs.count() and set(records.select("task").distinct().toPandas()["task"]) == {"task1"}
    rows = [{"model": "m", "split": "test", "task": "task1", "step": "single_step", "id": 1, "gold": {"answer": "a"}, "raw": '{"answer": "a"}'}, {"model": "m", "split": "test", "task": "task1", "step": "single_step", "id": 2, "gold": {"answer": "a"}, "raw": "b"}]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
    run("score", "--predictions", tmp_path / "p.jsonl", "--out", tmp_path / "sum")
    out = json.loads(next((tmp_path / "sum").iterdir()).read_text())
    assert out["total"] == 2 and out["metrics_mean"]["fragment_EM"] == 0.5


def test_views_go_with_their_molecules():
    import gc
    import weakref

    from pairforge.kernel.properties import descriptors
    from pairforge.kernel.smarts import View

    seen = []
    for text in ("C1CC1N", "OC1CC1", "c1ccccc1OC"):
        g = G.parse(text)
        v = View(g)
        assert descriptors(g, v) == descriptors(g)
        assert v.ring_sizes(0) == v.ring_sizes(0)
        seen.append(weakref.ref(v))
    del v, g
    gc.collect()
    assert not any(r() for r in seen)


def test_rules_are_written_down_one_by_one(spark):
    rnd = random.Random(12)
    rows = [("d", f"e{i % 2}", "".join(rnd.choices("CNOSF", k=12)) + str(i), i // 2 % 2, [rnd.getrandbits(62) for _ in range(16)]) for i in range(60)]
    rows += [(d, e, s + "C", 1 - x, [fp[0] ^ 1, *fp[1:]]) for d, e, s, x, fp in rows[:20]]
    df = spark.createDataFrame(rows, "dataset_name string, endpoint string, smiles string, label int, fp array<bigint>")
    out = pairing.pair_molecules(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    bits = lambda a, b: (sum((x & y).bit_count() for x, y in zip(a, b)), sum((x | y).bit_count() for x, y in zip(a, b)))
    got = {tuple(r) for r in out.collect()}
    want = {(a[0], a[1], a[2], b[2]) for a in rows for b in rows if a[:2] == b[:2] and a[3] == 1 and b[3] == 0 and 10 * (m := bits(a[4], b[4]))[0] >= 9 * m[1]}
    assert len(want) >= 20 and want <= got
    nothing = pairing.pair_molecules(df.withColumn("fp", F.lit(None).cast("array<bigint>")))
    assert {tuple(r) for r in nothing.collect()} <= got
