"""Compare the fragment sets of a pair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import fragment_join, fragment_set, str_or_empty
from pairforge.schema import CLIFF_COLUMNS, require_columns


def attach_safe(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """``toxic_safe`` and ``nontoxic_safe`` by molecule text, else by its canonical form, else the empty text.

    ``profile``: ``smiles``, ``canonical``, ``safe``.  Two left joins per side; Spark picks broadcast by size.
    """
    direct = profile.groupBy("smiles").agg(F.min("safe").alias("direct"))
    by_form = profile.where("canonical IS NOT NULL").groupBy(F.col("canonical").alias("form")).agg(F.min("safe").alias("by_form"))
    forms = profile.groupBy(F.col("smiles")).agg(F.min("canonical").alias("form"))
    for side in ("toxic", "nontoxic"):
        key = F.col(f"{side}_smiles")
        pairs = pairs.join(direct.withColumnRenamed("smiles", "__k"), key == F.col("__k"), "left").drop("__k")
        pairs = pairs.join(forms.withColumnRenamed("smiles", "__k"), key == F.col("__k"), "left").drop("__k")
        pairs = pairs.withColumn("form", F.coalesce("form", key)).join(by_form, "form", "left")
        pairs = pairs.withColumn(f"{side}_safe", F.coalesce(F.nullif("direct", F.lit("")), "by_form", F.lit(""))).drop("direct", "by_form", "form")
    return pairs


def for_export(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """The nine columns of CLIFFS: both molecules in canonical form where the profile has one, else as they are without outer white space;
    null and ``nan`` (any case) become the empty text.  ValueError naming what is missing."""
    require_columns(pairs, CLIFF_COLUMNS, "pairs")
    forms = profile.where("canonical IS NOT NULL").groupBy("smiles").agg(F.min("canonical").alias("__c"))
    for side in ("toxic_smiles", "nontoxic_smiles"):
        bare = str_or_empty(F.col(side))
        pairs = pairs.join(forms.withColumnRenamed("smiles", "__k"), F.col(side) == F.col("__k"), "left")
        pairs = pairs.withColumn(side, F.when(F.lower(bare) == "nan", "").otherwise(F.coalesce("__c", bare))).drop("__k", "__c")
    return pairs.select(*CLIFF_COLUMNS)


def compare_fragments(pairs: DataFrame) -> DataFrame:
    """Nine more columns: sorted, dot-joined fragment sets (both, common, only), their sizes and whether they differ."""
    require_columns(pairs, ["toxic_safe", "nontoxic_safe"], "pairs")
    t, n = fragment_set(F.col("toxic_safe")), fragment_set(F.col("nontoxic_safe"))
    sets = {"toxic_safe_fragments": t, "nontoxic_safe_fragments": n, "common_safe_fragments": F.array_intersect(t, n), "only_toxic_safe_fragments": F.array_except(t, n), "only_nontoxic_safe_fragments": F.array_except(n, t)}
    out = pairs.withColumns({k: fragment_join(v) for k, v in sets.items()})
    sizes = {"n_common_safe": sets["common_safe_fragments"], "n_only_toxic_safe": sets["only_toxic_safe_fragments"], "n_only_nontoxic_safe": sets["only_nontoxic_safe_fragments"]}
    out = out.withColumns({k: F.size(v) for k, v in sizes.items()})
    return out.withColumn("has_safe_diff", (F.col("n_only_toxic_safe") > 0) | (F.col("n_only_nontoxic_safe") > 0))
