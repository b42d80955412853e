"""ML11 over Structured Streaming: score new rows as they land.

Scoring is row-wise (scale + linear/tree model transform), so the same
``score_batch`` plan runs unchanged on a streaming DataFrame; the sink is
a Parquet directory with its own checkpoint in the shared folder
(exactly-once file sink, restartable after executor or driver loss).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelforge.operators.regress import Fitted, score_batch


def score_stream(spark: SparkSession, source_dir: str, schema, fitted: Fitted, scaler: dict | None,
                 out_dir: str, checkpoint: str, out: str = "Predicted",
                 available_now: bool = True, max_files_per_trigger: int | None = None):
    """Start the scoring stream from Parquet files in ``source_dir``.
    ``available_now`` processes what is there and stops (batch-like
    backfill); otherwise it keeps running.  Returns the StreamingQuery."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    scored: DataFrame = score_batch(src, fitted, scaler, out)
    w = (scored.writeStream.format("parquet").option("path", out_dir)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
