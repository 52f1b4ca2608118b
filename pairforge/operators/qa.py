"""Render question/answer records of five tasks from pairs: one scan, five projections, one routed write."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairforge.functions.text import fragment_count, py_repr, str_or_empty, strip

#: Tasks by the part of their file names.
TASKS = {
    "task1": "task1",
    "task2": "task2",
    "task3_smiles_gen": "task3",
    "task3_safe_gen": "task3_nontoxic_safe_generation",
    "task3_cot_safe_gen": "task3_stepwise_cot_safe_generation",
}
REQUIRED = ["dataset_name", "endpoint", "toxic_safe", "nontoxic_safe", "only_toxic_safe_fragments", "only_nontoxic_safe_fragments"]
EITHER = [("toxic_safe_decoded_smiles", "toxic_smiles"), ("nontoxic_safe_decoded_smiles", "nontoxic_smiles")]

# Our own wording; slots as in the record.
_PAIR = "Each pair holds a toxic molecule and a close neighbour that is not toxic. "
_KEEP = "Change as little as possible and keep weight, polarity and size near those of the toxic molecule. "
_SAFE = "SAFE writes a molecule as fragments joined by dots; equal ring numbers mark where fragments meet. "
PREAMBLE = _PAIR + _KEEP + _SAFE
ONE_KEY = 'Answer with one JSON object: {"answer": "..."}.'
THREE_KEYS = 'Answer with one JSON object with the keys "step1_only_toxic_safe_fragments", "step2_only_nontoxic_safe_fragments" and "answer".'
BODY = {
    "task1": ("Name the one fragment that makes the molecule toxic.", "Name all fragments that make the molecule toxic, joined by dots."),
    "task2": ("Name the one fragment that should replace it.", "Name all fragments that should replace them, joined by dots."),
    "task3_smiles_gen": ("Replace one fragment and write the whole molecule as SMILES.", "Replace the fragments concerned and write the whole molecule as SMILES."),
    "task3_safe_gen": ("Replace one fragment and write the whole molecule as SAFE.", "Replace the fragments concerned and write the whole molecule as SAFE."),
    "task3_cot_safe_gen": (
        "1. Find the one fragment that makes the molecule toxic.\n2. Choose the one fragment that should replace it.\n3. Write the whole molecule as SAFE.",
        "1. Find all fragments that make the molecule toxic.\n2. Choose the fragments that should replace them.\n3. Write the whole molecule as SAFE.",
    ),
}


def validate(df: DataFrame) -> DataFrame:
    """``df`` itself if it has the six required columns and one of each pair of aliases; else ValueError."""
    missing = [c for c in REQUIRED if c not in df.columns] + [" or ".join(p) for p in EITHER if not set(p) & set(df.columns)]
    if missing:
        raise ValueError(f"pairs lack columns: {', '.join(missing)}")
    return df


def normalised(df: DataFrame) -> DataFrame:
    """Texts stripped, null as empty; molecule columns coalesced over their aliases; common fragments default to empty.
    ``source_index`` is kept, or numbered from the file order by the source."""
    validate(df)
    col = lambda c: F.nullif(str_or_empty(F.col(c)), F.lit("")) if c in df.columns else F.lit(None).cast("string")
    texts = {c: str_or_empty(F.col(c)) for c in REQUIRED}
    texts |= {a: F.coalesce(col(a), col(b), F.lit("")) for a, b in EITHER}
    texts["common_safe_fragments"] = F.coalesce(col("common_safe_fragments"), F.lit(""))
    return df.select("source_index", *[v.alias(k) for k, v in texts.items()], *[c for c in ("split", "description") if c in df.columns])


def has_key(df: DataFrame) -> DataFrame:
    """Rows with a dataset or an endpoint."""
    return df.where("dataset_name <> '' OR endpoint <> ''")


def without_key(df: DataFrame) -> DataFrame:
    """The rows that ``has_key`` leaves out, to count them."""
    return df.where("dataset_name = '' AND endpoint = ''")


def step_of(task: str) -> Column:
    """single_step if there is exactly one toxic (task1) or one toxic and one other fragment; none at all is multi_step."""
    one = fragment_count(F.col("only_toxic_safe_fragments")) == 1
    if task != "task1":
        one = one & (fragment_count(F.col("only_nontoxic_safe_fragments")) == 1)
    return F.when(one, "single_step").otherwise("multi_step")


def molecule_block(mode: str = "both") -> Column:
    """The toxic molecule as it is shown: ``only_smiles``, ``only_safe`` or both; empty if there is nothing to show."""
    smiles, safe = F.col("toxic_safe_decoded_smiles"), F.col("toxic_safe")
    s, f = F.concat(F.lit("SMILES = "), py_repr(smiles)), F.concat(F.lit("SAFE = "), py_repr(safe))
    shown = {"only_smiles": F.when(smiles != "", s), "only_safe": F.when(safe != "", f), "both": F.nullif(F.concat_ws(", ", F.when(smiles != "", s), F.when(safe != "", f)), F.lit(""))}[mode]
    return F.coalesce(F.concat(F.lit("\nToxic molecule: "), shown), F.lit(""))


def description_block(enabled: bool, strict: bool) -> Column:
    """The endpoint's description and a line break; empty if switched off or without keys.  ``strict`` raises where keys
    have no description."""
    if not enabled:
        return F.lit("")
    missing = F.raise_error(F.concat(F.lit("no description for "), F.col("dataset_name"), F.lit(" / "), F.col("endpoint"))).cast("string") if strict else F.lit("")
    text = F.col("description")
    return F.when((F.col("dataset_name") == "") & (F.col("endpoint") == ""), F.lit("")).when(F.coalesce(text, F.lit("")) == "", missing).otherwise(F.concat(text, F.lit("\n")))


def render(df: DataFrame, task: str, mode: str = "both", descriptions: bool = True, output_format: bool = True, strict: bool = True) -> DataFrame:
    """Records of one task from ``normalised`` rows: ``split``, ``task``, ``step`` and the record's fields."""
    step = step_of(task)
    single, multi = BODY[task]
    body = F.when(step == "single_step", single).otherwise(multi)
    if task == "task1":
        body = F.concat(F.lit("SAFE of the toxic molecule: "), F.col("toxic_safe"), F.lit("\n"), body)
    if task == "task2":
        body = F.concat(F.lit("Fragments that make it toxic: "), F.col("only_toxic_safe_fragments"), F.lit("\n"), body)
    question = strip(F.concat(description_block(descriptions, strict), F.lit(PREAMBLE), molecule_block(mode), F.lit("\n"), body))
    if output_format:
        question = F.concat(question, F.lit("\n\n" + THREE_KEYS if task == "task3_cot_safe_gen" else " " + ONE_KEY))
    gold = {"task1": "only_toxic_safe_fragments", "task2": "only_nontoxic_safe_fragments", "task3_smiles_gen": "nontoxic_safe_decoded_smiles"}.get(task, "nontoxic_safe")
    steps = task == "task3_cot_safe_gen"
    extra = lambda c: (F.col(c) if steps else F.lit(None).cast("string"))
    answer = F.struct(F.col(gold).alias("answer"), extra("only_toxic_safe_fragments").alias("gold_only_toxic_safe_fragments"), extra("only_nontoxic_safe_fragments").alias("gold_only_nontoxic_safe_fragments"))
    more = lambda c: (F.col(c) if task == "task2" else F.lit(None).cast("string")).alias(c)
    return has_key(df).select(
        *[c for c in ("split",) if c in df.columns], F.lit(task).alias("task"), step.alias("step"), F.col("source_index").alias("id"), question.alias("question"), answer.alias("answer"),
        "dataset_name", "endpoint", "source_index", more("common_safe_fragments"), more("nontoxic_safe_decoded_smiles"),
    )


def build_qa(df: DataFrame, tasks: list[str] | None = None, **options) -> DataFrame:
    """All tasks of all rows in one frame, from one scan."""
    rows = normalised(df)
    return reduce(DataFrame.unionByName, [render(rows, t, **options) for t in tasks or TASKS])


def qa_file(split: Column, task: Column, step: Column) -> Column:
    """The name of a file of records, without its ending; it lies in a folder named after the split."""
    return F.concat_ws("_", split, task, F.when(step == "single_step", "single").otherwise("multi"))
