"""Score replies: from questions and replies to one row of metrics each, and from questions to a summary in one run."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.scoring import prs, qed_six, task_metrics
from pairforge.functions.similarity import tanimoto
from pairforge.functions.text import strip
from pairforge.kernel.kernels import GraphKernel, MolKernel, spread
from pairforge.kernel.safe import Converter, DecodeError
from pairforge.operators.inference import SYSTEM, Provider, answer_text, ask, first_questions, input_molecule, latest, summarise, unanswered
from pairforge.schema import PREDICTIONS
from pairforge.sources.files import append_predictions
from pairforge.storage import materialize

FILE = ["split", "task", "step"]
KEYS = [*FILE, "id"]
#: What scoring molecules takes from a kernel.
SCORING_FIELDS = ("canonical", "fp", "path_fp", "keys_fp", "props")


def decoded(texts: DataFrame) -> DataFrame:
    """``text``, ``safe`` (whether it is SAFE) and ``smiles``: SAFE decoded, other texts as they are; null if it cannot be decoded or is empty."""

    def run(parts):
        decode = Converter().decode
        for pdf in parts:
            out = []
            for text, safe in zip(pdf["text"], pdf["safe"]):
                try:
                    out.append((decode(text, canonical=True) if safe else text) or None)
                except DecodeError:
                    out.append(None)
            yield pd.DataFrame({"text": pdf["text"], "safe": pdf["safe"], "smiles": pd.Series(out, dtype=object)})

    return spread(texts).mapInPandas(run, "text string, safe boolean, smiles string")


def molecule_facts(texts: DataFrame, kernel: MolKernel) -> DataFrame:
    """One row per distinct ``text`` and ``safe``: ``canonical`` (null if it is no molecule), fingerprints and ``qed``."""
    smiles = materialize(decoded(texts.distinct()), "decoded")
    profile = kernel.profile(smiles)
    known = {f.lower(): f for f in profile.schema["props"].dataType.fieldNames()}
    qed = qed_six({p: F.col("props").getField(known[p.lower()]).cast("double") for p in ("MW", "logP", "TPSA", "HBD", "HBA", "RotB")})
    facts = profile.select("smiles", "canonical", "fp", "path_fp", "keys_fp", qed.alias("qed"))
    return materialize(smiles.join(facts, "smiles", "left").drop("smiles"), "facts")


def with_metrics(rows: DataFrame, kernel: MolKernel | None = None, compat: bool = False, toxic: Column | None = None) -> DataFrame:
    """``rows`` (task, step, gold, raw, question) with all metrics; null where a task has none.

    Molecules are worked out once per distinct text.  Answers that cannot be read as a molecule score 0; so do
    property scores where a property is unknown.  The molecule asked about is ``toxic``, else the one the question shows.
    """
    kernel = kernel or GraphKernel(columns=SCORING_FIELDS)
    molecules, is_safe = F.startswith("task", F.lit("task3")), F.startswith("task", F.lit("task3_"))
    texts = {"gold": strip(F.coalesce(F.col("gold.answer"), F.lit(""))), "pred": answer_text(F.col("raw"), compat), "input": input_molecule(toxic if toxic is not None else F.lit(None).cast("string"), F.col("question"))}
    rows = rows.withColumns({f"__{k}": v for k, v in texts.items()} | {"__safe": is_safe})
    rows = materialize(rows, "answers")
    kinds = {"gold": F.col("__safe"), "pred": F.col("__safe"), "input": F.lit(False)}
    asked = rows.where(molecules).select(F.explode(F.array(*[F.struct(F.col(f"__{k}").alias("text"), s.alias("safe")) for k, s in kinds.items()])).alias("t")).select("t.*").where("text <> ''")
    facts = molecule_facts(asked, kernel)
    out = rows
    for k, s in kinds.items():
        mine = facts.select(F.struct("canonical", "fp", "path_fp", "keys_fp", "qed").alias(f"__m_{k}"), F.col("text").alias("__t"), F.col("safe").alias("__s"))
        out = out.join(mine, molecules & (F.col(f"__{k}") == F.col("__t")) & (s == F.col("__s")), "left").drop("__t", "__s")
    g, p, i = (F.col(f"__m_{k}") for k in ("gold", "pred", "input"))
    near = {name: tanimoto(g[f], p[f]) for name, f in (("morgan", "fp"), ("rdk", "path_fp"), ("maccs", "keys_fp"))}
    mol = {"can_gold": g["canonical"], "can_pred": p["canonical"], "can_input": i["canonical"], "valid": p["canonical"].isNotNull(), "prs": prs(i["qed"], p["qed"])["score"], **near}
    return out.withColumns(task_metrics(F.col("task"), F.col("step"), F.col("__gold"), F.col("__pred"), mol)).drop(*[f"__{k}" for k in kinds], *[f"__m_{k}" for k in kinds], "__safe")


def as_predictions(rows: DataFrame, model: str) -> DataFrame:
    """Scored replies in the columns of PREDICTIONS; the endpoint falls back to the dataset."""
    made = {
        "model": F.lit(model), "endpoint": F.coalesce(F.nullif("endpoint", F.lit("")), "dataset_name"), "gold": F.col("answer"), "pred": answer_text(F.col("raw")), "asked_at": F.current_timestamp(),
    }
    return rows.withColumns(made).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in PREDICTIONS])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """All predictions appended to a folder; an empty table if there is none yet."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)
    return spark.read.schema(PREDICTIONS).json(path) if there else spark.createDataFrame([], PREDICTIONS)


def run(qa: DataFrame, provider: Provider, model: str, out: str, limit: int | None = None, kernel: MolKernel | None = None, compat: bool = False) -> DataFrame:
    """Ask, score, append and summarise: one summary row per split, task and step, with times.

    ``qa`` has ``split``, ``task``, ``step`` and the fields of a record.  Of each file the first ``limit`` records are asked, without those
    that have a reply in the folder of this model below ``out``; failed ones are asked again.  Replies are written down before they are
    scored, so that no task tried again asks twice.  A question asked again counts by its latest good reply; with ``compat`` every
    reply counts.
    """
    spark = qa.sparkSession
    path = f"{out.rstrip('/')}/predictions_{model.rstrip('/').split('/')[-1]}"
    before = read_predictions(spark, path)
    todo = materialize(unanswered(first_questions(qa, limit, FILE), before, KEYS), "todo")
    began = time.perf_counter()
    replies = materialize(ask(todo, provider, SYSTEM), "replies")
    took = time.perf_counter() - began
    scored = with_metrics(replies.withColumn("gold", F.col("answer")), kernel, compat)
    append_predictions(as_predictions(scored, model), path)
    every = spark.read.schema(PREDICTIONS).json(path)
    counted = every if compat else latest(every, ["model", *KEYS], "asked_at")
    new = replies.groupBy(*FILE).agg(F.count("*").alias("inference_samples"))
    total = max(1, replies.count())
    return (
        summarise(counted)
        .join(new, FILE, "left")
        .withColumn("inference_samples", F.coalesce("inference_samples", F.lit(0)))
        .withColumns({"inference_seconds": F.round(F.lit(took) * F.col("inference_samples") / total, 2), "predictions_path": F.lit(path)})
    )


