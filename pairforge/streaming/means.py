"""Running means over predictions as they are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairforge.functions.scoring import finite
from pairforge.schema import PREDICTIONS


def prediction_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(PREDICTIONS).json(folder)


def running_means(stream: DataFrame, metrics: list[str], late: str | None = "7 days") -> DataFrame:
    """Means over finite values per model, split, task and step, for output mode ``complete``.

    A prediction delivered again counts once if it comes within ``late`` of the first by ``asked_at``; keys older than that behind the
    latest are forgotten, which bounds the state, and predictions older than that are left out.  Without ``late`` every key is
    kept for ever and nothing is left out.  A prediction without ``asked_at`` counts as asked when it is read.
    """
    keys = ["model", "split", "task", "step", "id"]
    dated = stream.withColumn("asked_at", F.coalesce("asked_at", F.current_timestamp()))
    once = dated.withWatermark("asked_at", late).dropDuplicatesWithinWatermark(keys) if late else stream.dropDuplicates(keys)
    return once.groupBy("model", "split", "task", "step").agg(F.count("*").alias("total"), *[F.avg(finite(F.col(m))).alias(m) for m in metrics])
