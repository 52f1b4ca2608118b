"""CSV and JSON-lines files with explicit schemas."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from pairforge.operators.inference import step_of_file, task_of_file
from pairforge.operators.qa import qa_file
from pairforge.schema import MOLECULES, QA
from pairforge.storage import materialize


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV with header under an explicit schema; quotes are doubled, fields may hold line breaks."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)


def read_molecules(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, MOLECULES)


def read_csv_texts(spark: SparkSession, path: str) -> DataFrame:
    """All columns as texts, with ``source_index``, the row's place in the file; a folder counts as its files in order of their names."""
    header = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).schema.names
    return numbered_csv(spark, path, T.StructType([T.StructField(c, T.StringType()) for c in header]))


def numbered_csv(spark: SparkSession, path: str, schema: T.StructType, name: str = "source_index") -> DataFrame:
    """``read_csv`` with every row's place.  Files are not cut while fields may hold line breaks, so one task reads all of
    a file, in order."""
    return _numbered(read_csv(spark, path, schema), F.col("_metadata.file_path"), name)


def _numbered(df: DataFrame, block: Column, name: str) -> DataFrame:
    """Rows with their place over all blocks, blocks in their order; the rows of a block stand together in one partition.

    Block and place are written down with the rows in one job, so that sizes and rows cannot come from different runs of
    the same plan: a range shuffle that is made twice samples its bounds twice.
    """
    tagged = materialize(df.withColumns({"__b": block, "__m": F.monotonically_increasing_id()}), "numbered")
    sizes = tagged.groupBy("__b").agg(F.count("*").alias("__n"), F.min("__m").alias("__first"))
    # One row per partition or file.
    start = sizes.select("__b", "__first", (F.sum("__n").over(W.orderBy("__b")) - F.col("__n")).alias("__start"))
    return tagged.join(start, "__b").withColumn(name, F.expr("__start + __m - __first").cast("bigint")).drop("__b", "__m", "__first", "__start")


def ordered_ids(df: DataFrame, by: list[str], name: str = "row_id") -> DataFrame:
    """A row number in the order of ``by``: sorted by range, numbered over the partitions without one global window.
    Equal rows are numbered in any order."""
    return _numbered(df.repartitionByRange(*by).sortWithinPartitions(*by), F.spark_partition_id(), name)


def write_csv(df: DataFrame, path: str, order_by: str | None = None, one_file: bool = False) -> None:
    """CSV with header, null as the empty text; parts follow each other in the order of ``order_by``, which is dropped.

    Every part is written by a task of its own and has the header; little data comes in one part.  ``one_file`` puts
    everything through one task, for readers that want that.
    """
    out = df
    if order_by:
        out = (df.coalesce(1) if one_file else df.repartitionByRange(order_by)).sortWithinPartitions(order_by).drop(order_by)
    elif one_file:
        out = df.coalesce(1)
    out.write.mode("overwrite").options(header=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


#: A file of records, or a folder of its parts: split folder and name.
_QA_FILE = r"([^/]+)/([^/]+)\.jsonl(?:/part-[^/]+)?$"


def read_qa(spark: SparkSession, path: str) -> DataFrame:
    """All JSON-lines files (or folders of parts) below ``path`` whose names hold a known task; ``split`` from the folder, ``task`` and
    ``step`` from the name.  Blank lines are skipped."""
    rows = spark.read.schema(QA).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json*").json(path)
    rows = rows.withColumn("__path", F.col("_metadata.file_path"))
    stem = F.regexp_extract("__path", _QA_FILE, 2)
    return rows.withColumns({"split": F.regexp_extract("__path", _QA_FILE, 1), "task": task_of_file(stem), "step": step_of_file(stem)}).where("task IS NOT NULL").drop("__path")


def write_qa(df: DataFrame, path: str) -> None:
    """One folder of parts per split, task and step, named as ``qa_file`` says; records in the order of their ids.

    All of them are written in one pass, then renamed; a folder of that name is replaced, others stay.
    """
    spark = df.sparkSession
    out = df.withColumn("__file", qa_file(F.col("split"), F.col("task"), F.col("step")))
    keys = ["split", "__file", "id"]
    staged = f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"
    out.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.col("split").alias("__split")).drop("split", "task", "step").write.partitionBy("__split", "__file").option("ignoreNullFields", True).json(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs
    source = hadoop.Path(staged)
    fs = source.getFileSystem(spark._jsc.hadoopConfiguration())
    for folder in fs.listStatus(source):
        if folder.isDirectory():
            for part in fs.listStatus(folder.getPath()):  # few: splits x tasks x steps
                split, name = folder.getPath().getName().split("=", 1)[1], part.getPath().getName().split("=", 1)[1]
                target = hadoop.Path(f"{path.rstrip('/')}/{split}/{name}.jsonl")
                fs.mkdirs(target.getParent())
                fs.delete(target, True)
                fs.rename(part.getPath(), target)
    fs.delete(source, True)


def append_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_summary(summary: DataFrame, folder: str) -> list[str]:
    """One pretty JSON object per row of a summary (a row per model, split, task and step)."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    out = []
    for r in summary.toLocalIterator():
        d = r.asDict(recursive=True)
        p = Path(folder, "summary_" + "_".join(str(d[k]).rstrip("/").split("/")[-1] for k in ("model", "split", "task", "step")) + ".json")
        p.write_text(json.dumps(d, ensure_ascii=False, indent=2), encoding="utf-8")
        out.append(str(p))
    return out


def write_scored_pairs(pairs: DataFrame, path: str) -> None:
    """Scored pairs by group, instead of dense matrices."""
    pairs.write.mode("overwrite").partitionBy("dataset_name", "endpoint").parquet(path)
