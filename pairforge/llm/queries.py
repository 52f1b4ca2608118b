"""Queries of the training-data operators (problems 2, 3, 5, 6, 7 and 8) over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.text import blank_key, cell_fragments
from pairforge.llm import canonical, leaks, mixing, overlap, splits, terms
from pairforge.llm.sql import SQL
from pairforge.sources.tables import table

__all__ = ["QUERIES", "SQL"]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.straddling(table(spark, d, "toxicitycliff"), "cliff_id", "toxic_smiles", table(spark, d, "mol_profile"))


def p2_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_split(table(spark, d, "toxicitycliff"), "cliff_id", "toxic_smiles", table(spark, d, "mol_profile"))


def p2_components(spark: SparkSession, d: str) -> DataFrame:
    return p2_split(spark, d).select("cliff_id", "component")


def p2_totals(spark: SparkSession, d: str) -> DataFrame:
    return p2_split(spark, d).groupBy("new_split").agg(F.count("*").alias("n_rows"))


def _cells(df: DataFrame) -> list:
    return [cell_fragments(F.col("only_toxic_safe_fragments")), cell_fragments(F.col("only_nontoxic_safe_fragments"))]


def _ngrams(spark: SparkSession, d: str, report_n: int | None) -> DataFrame:
    rows = table(spark, d, "toxicitycliff")
    return terms.with_mark(terms.ngram_counts(rows, _cells(rows), report_n=report_n), rows.count()).select(F.array_join("ngram", ".").alias("ngram"), "n", "occurrences", "n_records", "mark")


def p3_ngrams(spark: SparkSession, d: str) -> DataFrame:
    return _ngrams(spark, d, None)


def p3_fragments(spark: SparkSession, d: str) -> DataFrame:
    return _ngrams(spark, d, 1).select(F.col("ngram").alias("fragment"), "occurrences", "n_records", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_fragments(spark, d).where("mark IS NOT NULL").select("fragment", "mark")


def _overlaps(rows: DataFrame) -> DataFrame:
    return overlap.overlaps(rows, "cliff_id", "toxic_smiles", "nontoxic_smiles", F.col("split") == "train", F.col("split").isin("valid", "test"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _overlaps(table(spark, d, "toxicitycliff")).select(F.least("id_a", "id_b").alias("cliff_id_a"), F.greatest("id_a", "id_b").alias("cliff_id_b"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "toxicitycliff")
    named = rows.select(F.col("cliff_id").alias("id_b"), "split", blank_key(F.col("dataset_name")).alias("dataset_name"))
    return _overlaps(rows).join(named, "id_b").groupBy("split", "dataset_name").agg(F.count("*").alias("n_pairs"), F.count_distinct("id_b").alias("n_rows"), F.count_if(F.col("edits_1") + F.col("edits_2") == 0).alias("n_exact"))


def _leaks(spark: SparkSession, d: str, partial: bool) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "question", table(spark, d, "lookalikes"), partial=partial)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    # Twelve words in common: the same window, so its fingerprints are.
    return _leaks(spark, d, False).where(F.col("exact") & (F.col("window") == leaks.WINDOW)).select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, True).select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "exact", "window")


def _mixture(spark: SparkSession, d: str):
    return mixing.mixture(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "source_weights"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.exhausted(*_mixture(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)[1]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    found, uses = _mixture(spark, d)
    plan = spark.createDataFrame([(s.source, s.target_share, s.max_repeats, s.tokens, s.limited) for s in found], "source string, target_share double, max_repeats int, source_tokens bigint, limited boolean")
    used = uses.groupBy("source").agg(F.sum("tokens").alias("used_tokens"), F.count("*").alias("n_uses"))
    total = used.agg(F.sum("used_tokens")).first()[0] or 1
    zero = {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("used_tokens", "n_uses")}
    return plan.join(used, "source", "left").withColumns(zero).withColumn("reached_share", F.round(F.col("used_tokens") / F.lit(total), 9))


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """Per weighted source its tokens, whether it is limited, and whether its uses meet its quota to within one record."""
    found, uses = _mixture(spark, d)
    longest = mixing.token_counts(table(spark, d, "documents"), "doc_id", "text", "source").groupBy("source").agg(F.max("tokens").alias("longest"))
    used = uses.groupBy("source").agg(F.sum("tokens").alias("used"))
    plan = spark.createDataFrame([(s.source, s.tokens, s.limited, s.quota) for s in found], "source string, source_tokens bigint, limited boolean, quota bigint")
    short = F.col("quota") - F.coalesce("used", F.lit(0))
    return plan.join(longest, "source", "left").join(used, "source", "left").select("source", "source_tokens", "limited", ((short >= 0) & (short <= F.when(F.col("limited"), 0).otherwise(F.col("longest") - 1))).alias("met"))


def _docs(spark: SparkSession, d: str):
    return table(spark, d, "documents"), "doc_id", "text", table(spark, d, "lookalikes")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.lookalike_pairs(*_docs(spark, d))


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return canonical.form_classes(*_docs(spark, d))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    docs, key, text, looks = _docs(spark, d)
    return canonical.with_form(docs, text, looks, [key])


QUERIES = {f.__name__: f for f in (p2_found, p2_split, p2_components, p2_totals, p3_found, p3_fragments, p3_ngrams, p5_found, p5_report, p6_found, p6_leaks, p7_found, p7_mix, p7_shares, p7_limits, p8_found, p8_classes, p8_forms)}
