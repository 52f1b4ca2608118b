"""Five commands: pair, split, build, infer, score.  python -m pairforge.cli COMMAND --help"""

from __future__ import annotations

import argparse

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairforge.kernel.kernels import GraphKernel, TableKernel, distinct_molecules
from pairforge.operators import descriptions, evaluation, fences, groupsplit, inference, qa, stages
from pairforge.shipping import ship
from pairforge.schema import CLIFF_COLUMNS, CLIFFS, METRICS, PAIR_COLUMNS, PREDICTIONS
from pairforge.sources import files
from pairforge.storage import materialize


def kernel(spark: SparkSession, profile: str | None, *columns: str):
    return TableKernel(spark.read.parquet(profile)) if profile else GraphKernel(columns=columns)


def pair(spark: SparkSession, a) -> None:
    """Molecules to filtered pairs."""
    rows = files.read_molecules(spark, a.input).dropna(subset=["smiles"])
    out = stages.toxicity_cliffs(rows, lambda *columns: kernel(spark, a.profile, *columns), a.compat, not a.no_iqr, a.fragment_length, a.max_fragments, not a.keep_property_outliers)
    files.write_csv(files.ordered_ids(out, PAIR_COLUMNS), a.out, order_by="row_id", one_file=a.one_file)


def split(spark: SparkSession, a) -> None:
    """Pairs to train and test by the scaffold of the toxic molecule."""
    rows = files.numbered_csv(spark, a.input, CLIFFS, "row_id")
    profile = kernel(spark, a.profile, "scaffold").profile(distinct_molecules((rows, "toxic_smiles"))).select(F.col("smiles").alias("toxic_smiles"), "scaffold")
    parts = materialize(groupsplit.smallest_first_split(rows.join(profile, "toxic_smiles", "left"), "row_id", F.col("scaffold"), a.test_share), "parts")
    for name in ("train", "test"):
        files.write_csv(parts.where(F.col("split") == name).select("row_id", *CLIFF_COLUMNS), f"{a.out_dir}/{name}.csv", order_by="row_id")


def build(spark: SparkSession, a) -> None:
    """Pairs to question/answer records, per split."""
    bundle = (a.qa_set or "").strip().strip("/") or "default"
    if ".." in bundle.split("/"):
        raise ValueError("qa_set must lie below the output folder")
    bundle += "_no_desc" if a.no_desc and not bundle.endswith("_no_desc") else ""
    skipped = {}
    for name in ("train", "test") if a.split == "all" else (a.split,):
        source = {"train": a.train_input, "test": a.test_input}.get(name) or a.input
        if not source:
            raise ValueError(f"no input for the split {name}")
        rows = files.read_csv_texts(spark, source).withColumn("split", F.lit(name))
        rows = descriptions.with_description(rows, descriptions.dimension(spark))
        records = qa.build_qa(rows, a.task or None, descriptions=not a.no_desc)
        if a.shuffle:
            records = materialize(records, "records")
            parts = records.select("task", "step").distinct().collect()  # few: tasks and steps
            records = reduce(DataFrame.unionByName, [groupsplit.seeded_permutation(records.where((F.col("task") == r["task"]) & (F.col("step") == r["step"])), "id", a.shuffle_seed) for r in parts] or [records])
        files.write_qa(records, f"{a.out}/{bundle}")
        skipped[name] = qa.without_key(qa.normalised(rows)).count()
    print({"output": f"{a.out}/{bundle}", "skipped_without_dataset_and_endpoint": skipped})


def score(spark: SparkSession, a) -> None:
    """Predictions (with their replies and, for molecules, their questions) to scores and one summary per task and step."""
    rows = spark.read.schema(T.StructType([*PREDICTIONS.fields, T.StructField("question", T.StringType())])).json(a.predictions)
    scored = evaluation.with_metrics(rows.drop(*METRICS), kernel(spark, a.profile, *evaluation.SCORING_FIELDS), a.compat)
    files.write_summary(inference.summarise(scored), a.out)


def infer(spark: SparkSession, a) -> None:
    """Records to predictions and summaries; what is answered already is not asked again."""
    provider = inference.load_provider(a.model, a.temperature, a.workers, a.tensor_parallel_size)
    summary = evaluation.run(files.read_qa(spark, a.qa), provider, a.model, a.out, a.limit, kernel(spark, a.profile, *evaluation.SCORING_FIELDS), a.compat)
    for path in files.write_summary(summary, a.out):
        print(path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="pairforge", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("pair", help=pair.__doc__)
    c.add_argument("--input", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--profile", help="Parquet of profiles; else this package's own kernel")
    c.add_argument("--keep-property-outliers", action="store_true")
    c.add_argument("--no-iqr", action="store_true")
    c.add_argument("--fragment-length", type=int, default=fences.TOO_LONG)
    c.add_argument("--max-fragments", type=int, default=fences.MAX_COUNT)
    c.add_argument("--one-file", action="store_true", help="write one file, by one task")
    c.add_argument("--compat", action="store_true")
    c = sub.add_parser("split", help=split.__doc__)
    c.add_argument("--input", required=True)
    c.add_argument("--out-dir", required=True)
    c.add_argument("--profile")
    c.add_argument("--test-share", type=float, default=0.1)
    c = sub.add_parser("build", help=build.__doc__)
    c.add_argument("--input")
    c.add_argument("--train-input")
    c.add_argument("--test-input")
    c.add_argument("--split", default="test", choices=["train", "test", "all"])
    c.add_argument("--out", required=True)
    c.add_argument("--qa-set", help="folder of the records below the output folder")
    c.add_argument("--task", action="append", choices=list(qa.TASKS))
    c.add_argument("--no-desc", action="store_true")
    c.add_argument("--shuffle", action="store_true")
    c.add_argument("--shuffle-seed", type=int, default=42)
    c = sub.add_parser("score", help=score.__doc__)
    c.add_argument("--predictions", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--profile")
    c.add_argument("--compat", action="store_true")
    c = sub.add_parser("infer", help=infer.__doc__)
    c.add_argument("--qa", required=True)
    c.add_argument("--model", required=True)
    c.add_argument("--out", required=True)
    c.add_argument("--limit", type=int, default=0)
    c.add_argument("--temperature", type=float, default=0.7)
    c.add_argument("--workers", type=int, default=8)
    c.add_argument("--tensor-parallel-size", type=int, default=1)
    c.add_argument("--profile")
    c.add_argument("--compat", action="store_true")
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = ship(SparkSession.builder.appName("pairforge").getOrCreate())
    {"pair": pair, "split": split, "build": build, "infer": infer, "score": score}[a.command](spark, a)


if __name__ == "__main__":
    main()
