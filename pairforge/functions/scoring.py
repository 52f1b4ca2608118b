"""Scores of a predicted against a gold answer, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.functions.text import char_ngrams, fragment_list, strip


def finite(c: Column) -> Column:
    """The number, or null if it is null, NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def multiset_equal(gold: Column, pred: Column) -> Column:
    """The same fragments, as often, in any order."""
    return F.array_sort(fragment_list(gold)) == F.array_sort(fragment_list(pred))


def fragment_em(gold: Column, pred: Column) -> Column:
    """1 if the gold text is not empty and the fragments are the same multiset, else 0."""
    return F.when((F.coalesce(gold, F.lit("")) != "") & multiset_equal(gold, pred), 1.0).otherwise(0.0)


def set_prf(gold: Column, pred: Column) -> Column:
    """Precision, recall and F1 over fragment sets: all 1 if both are empty, all 0 if one is."""
    g, p = F.array_distinct(fragment_list(gold)), F.array_distinct(fragment_list(pred))
    hit = F.size(F.array_intersect(g, p)).cast("double")
    ng, np_ = F.size(g), F.size(p)
    both_empty, one_empty = (ng == 0) & (np_ == 0), (ng == 0) | (np_ == 0)
    side = lambda x: F.when(both_empty, 1.0).when(one_empty, 0.0).otherwise(x)
    return F.struct(side(hit / np_).alias("precision"), side(hit / ng).alias("recall"), side(2 * hit / (ng + np_)).alias("f1"))


def set_f1(gold: Column, pred: Column) -> Column:
    return set_prf(gold, pred)["f1"]


def bleu1(gold: Column, pred: Column) -> Column:
    """Clipped character precision without brevity penalty; 0 if either text is empty."""
    count = lambda s, c: F.length(s) - F.length(F.replace(s, c, F.lit("")))
    hits = F.aggregate(F.array_distinct(F.split(pred, "")), F.lit(0), lambda n, c: n + F.least(count(pred, c), count(gold, c)))
    return F.when((F.length(gold) > 0) & (F.length(pred) > 0), hits / F.length(pred)).otherwise(0.0)


def bleu(gold: Column, pred: Column, n: int = 1, characters: bool = True) -> Column:
    """Clipped precision over character n-grams of the texts without blanks (U+0020), or over fragments; 0 if either has none."""
    bare = lambda c: F.replace(strip(F.coalesce(c, F.lit(""))), F.lit(" "), F.lit(""))
    g, p = (char_ngrams(bare(gold), n), char_ngrams(bare(pred), n)) if characters else (fragment_list(gold), fragment_list(pred))
    count = lambda tokens, x: F.size(F.filter(tokens, lambda y: y == x))
    hits = F.aggregate(F.array_distinct(p), F.lit(0), lambda a, x: a + F.least(count(p, x), count(g, x)))
    return F.when((F.size(g) > 0) & (F.size(p) > 0), hits / F.size(p)).otherwise(0.0)


def fragment_levenshtein(gold: Column, pred: Column) -> Column:
    """Mean over predicted fragments of the distance to the nearest gold one; whole texts if either has no fragment."""
    g, p = fragment_list(gold), fragment_list(pred)
    nearest = F.transform(p, lambda x: F.array_min(F.transform(g, lambda y: F.levenshtein(x, y))))
    mean = F.aggregate(nearest, F.lit(0).cast("double"), lambda s, v: s + v) / F.size(p)
    whole = F.levenshtein(F.coalesce(gold, F.lit("")), F.coalesce(pred, F.lit(""))).cast("double")
    return F.when((F.size(g) == 0) | (F.size(p) == 0), whole).otherwise(mean)


def from_difference(x: Column, mode: str = "exponential") -> Column:
    """Score of an absolute difference: ``exponential``, ``linear`` or ``reciprocal``."""
    if mode == "exponential":
        return F.exp(-x)
    if mode == "linear":
        return F.greatest(F.lit(0.0), 1 - x)
    if mode == "reciprocal":
        return 1 / (1 + x)
    raise ValueError(f"unknown mode: {mode!r}")


def weighted_geomean(desirabilities: list[Column], weights: list[float]) -> Column:
    """exp of the weighted mean of logarithms; null if one is null or not positive."""
    logs = [w * F.when(d > 0, F.ln(d)) for d, w in zip(desirabilities, weights)]
    return F.exp(sum(logs[1:], logs[0]) / F.lit(float(sum(weights))))


#: Parameters a, b, c, d, e, f and the mean weight of each desirability function (Bickerton et al., 2012).
DESIRABILITY = {
    "MW": (2.817065973, 392.5754953, 290.7489764, 2.419764353, 49.22325677, 65.37051707, 104.9805561, 0.66),
    "logP": (3.172690585, 137.8624751, 2.534937431, 4.581497897, 0.822739154, 0.576295591, 131.3186604, 0.46),
    "HBA": (2.948620388, 160.4605972, 3.615294657, 4.435986202, 0.290141953, 1.300669958, 148.7763046, 0.05),
    "HBD": (1.618662227, 1010.051101, 0.985094388, 0.000000001, 0.713820843, 0.920922555, 258.1632616, 0.61),
    "TPSA": (1.876861559, 125.2232657, 62.90773554, 87.83366614, 12.01999824, 28.51324732, 104.5686167, 0.06),
    "RotB": (0.010000000, 272.4121427, 2.558379970, 1.565547684, 1.271567166, 2.758063707, 105.4420403, 0.65),
}


def desirability(x: Column, name: str) -> Column:
    """The double-sigmoid desirability of one property, scaled to at most 1."""
    a, b, c, d, e, f, most, _ = DESIRABILITY[name]
    rise = 1 + F.exp(-(x - c + d / 2) / e)
    fall = 1 + F.exp(-(x - c - d / 2) / f)
    return (a + b / rise * (1 - 1 / fall)) / most


def qed_six(props: dict[str, Column]) -> Column:
    """Weighted geometric mean of the desirabilities of six properties; null if one is missing."""
    return weighted_geomean([desirability(props[p], p) for p in DESIRABILITY], [v[-1] for v in DESIRABILITY.values()])


def prs(qed_input: Column, qed_pred: Column, mode: str = "exponential") -> Column:
    """Property score with its parts; all zero if either value is missing or not finite."""
    t, p = finite(qed_input), finite(qed_pred)
    known = t.isNotNull() & p.isNotNull()
    x = F.abs(t - p)
    zero = lambda c: F.when(known, c).otherwise(0.0)
    return F.struct(zero(from_difference(x, mode)).alias("score"), zero(x).alias("x_abs_diff"), zero(t).alias("qed6_toxic"), zero(p).alias("qed6_nontoxic"), F.lit(mode).alias("mode"))


def task_metrics(task: Column, step: Column, gold: Column, pred: Column, mol: dict[str, Column] | None = None) -> dict[str, Column]:
    """Metric columns of an answer; null where the task has no such metric.

    ``mol`` gives, for molecule tasks, ``can_gold``, ``can_pred``, ``can_input``, ``valid``, the similarity columns
    ``morgan``, ``rdk``, ``maccs`` and ``prs``; without it those metrics are null.
    """
    fragments, molecules = task.isin("task1", "task2"), task.startswith("task3")
    out = {
        "fragment_EM": F.when(fragments, fragment_em(gold, pred)),
        "fragment_F1": F.when(fragments & (step == "multi_step"), set_f1(gold, pred)),
        "fragment_Levenshtein": F.when(task == "task2", fragment_levenshtein(gold, pred)),
    }
    names = ("exact_match", "bleu", "levenshtein", "rdk_fts", "maccs_fts", "morgan_fts", "validity", "prs_property_score", "copy_rate")
    if mol is None:
        return out | {n: F.lit(None).cast("double") for n in names}
    g, p = mol["can_gold"], mol["can_pred"]
    both = g.isNotNull() & p.isNotNull()
    zero = lambda c: F.when(molecules, F.when(both, F.coalesce(c.cast("double"), F.lit(0.0))).otherwise(0.0))
    return out | {
        "exact_match": zero(g == p),
        "bleu": zero(bleu1(g, p)),
        "levenshtein": zero(F.levenshtein(g, p)),
        "rdk_fts": zero(mol["rdk"]),
        "maccs_fts": zero(mol["maccs"]),
        "morgan_fts": zero(mol["morgan"]),
        "validity": F.when(molecules, F.coalesce(mol["valid"].cast("double"), F.lit(0.0))),
        "prs_property_score": F.when(molecules, F.coalesce(finite(mol["prs"]), F.lit(0.0))),
        "copy_rate": F.when(molecules, F.coalesce((mol["can_input"] == p).cast("double"), F.lit(0.0))),
    }


#: Reported means by task family and step; the other metrics are written per row only.
REPORTED = {
    ("task1", "single_step"): ["fragment_EM"],
    ("task1", "multi_step"): ["fragment_EM", "fragment_F1"],
    ("task2", "single_step"): ["fragment_EM", "fragment_Levenshtein"],
    ("task2", "multi_step"): ["fragment_EM", "fragment_Levenshtein", "fragment_F1"],
    ("task3", "single_step"): ["exact_match", "bleu", "morgan_fts", "validity", "prs_property_score", "copy_rate"],
    ("task3", "multi_step"): ["exact_match", "bleu", "morgan_fts", "validity", "prs_property_score", "copy_rate"],
}


def metric_keys(task: str, step: str) -> list[str]:
    """The metrics whose means are reported; ValueError for an unknown task or step."""
    family = "task3" if task.startswith("task3") else task
    try:
        return REPORTED[family, step]
    except KeyError:
        raise ValueError(f"unknown task or step: {task!r}, {step!r}") from None
