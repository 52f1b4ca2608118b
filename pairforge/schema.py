"""Column contracts.  NULL means missing everywhere inside the engine; sinks write the empty text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


MOLECULES = T.StructType([*_strings("dataset_name", "endpoint", "smiles"), T.StructField("label", T.IntegerType())])
PAIR_COLUMNS = ["dataset_name", "endpoint", "toxic_smiles", "nontoxic_smiles"]
PAIRS = T.StructType(_strings(*PAIR_COLUMNS))
CLIFF_COLUMNS = [*PAIR_COLUMNS, "toxic_safe", "nontoxic_safe", "only_toxic_safe_fragments", "only_nontoxic_safe_fragments", "common_safe_fragments"]
CLIFFS = T.StructType(_strings(*CLIFF_COLUMNS))
PROPERTIES = ["MW", "logP", "TPSA", "HBD", "HBA", "RotB"]
PROPS = T.StructType([T.StructField(p, T.DoubleType()) for p in PROPERTIES])
WORDS = T.ArrayType(T.LongType())
MOL_PROFILE = T.StructType([*_strings("smiles", "canonical", "safe", "scaffold"), T.StructField("fp", WORDS), T.StructField("scaffold_fp", WORDS), T.StructField("props", PROPS), T.StructField("path_fp", WORDS), T.StructField("keys_fp", WORDS)])
ANSWER = T.StructType(_strings("answer", "gold_only_toxic_safe_fragments", "gold_only_nontoxic_safe_fragments"))
QA = T.StructType([
    T.StructField("id", T.LongType()), *_strings("question"), T.StructField("answer", ANSWER), *_strings("dataset_name", "endpoint"),
    T.StructField("source_index", T.LongType()), *_strings("common_safe_fragments", "nontoxic_safe_decoded_smiles"),
])
METRICS = ["fragment_EM", "fragment_F1", "fragment_Levenshtein", "exact_match", "bleu", "morgan_fts", "validity", "prs_property_score", "copy_rate", "levenshtein", "rdk_fts", "maccs_fts"]
PREDICTIONS = T.StructType([
    *_strings("model", "split", "task", "step"), T.StructField("id", T.LongType()), *_strings("dataset_name", "endpoint"), T.StructField("source_index", T.LongType()),
    T.StructField("gold", ANSWER), *_strings("pred", "raw"), T.StructField("asked_at", T.TimestampType()), *[T.StructField(m, T.DoubleType()) for m in METRICS],
])


def require_columns(df: DataFrame, names: list[str], what: str = "input") -> DataFrame:
    """``df`` itself; ValueError naming what is missing."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df
