"""Scoring of arriving feature rows: the batch scoring function on a stream."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import types as T

from retentio.operators.scoring import batch_score


def run_scoring(spark: SparkSession, model: PipelineModel, landing: str, path: str, checkpoint: str,
                schema: T.StructType, key: str = "login", files_per_trigger: int | None = None) -> None:
    """Score the feature files that have arrived in ``landing`` since the last
    run and append the scores to the table at ``path``. Every file is scored
    once: the checkpoint knows which have been, the table's log which output
    files a finished batch wrote. Rows are scored alone (no shuffle, no
    state)."""
    stream = spark.readStream.schema(schema)
    if files_per_trigger:
        stream = stream.option("maxFilesPerTrigger", files_per_trigger)
    (batch_score(model, stream.parquet(landing), key).writeStream.outputMode("append").format("parquet")
     .option("path", path).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())
