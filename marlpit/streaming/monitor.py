"""Structured Streaming forms: request health by window, ingest of each request once, a contract gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from marlpit.operators.contracts import Expectation, split


def windowed_health(stream: DataFrame, ts: str = "scored_at", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Per window: executions, failed, mean_latency. A window is given out once the watermark has passed its end; rows later than that are dropped."""
    w = stream.withWatermark(ts, late).groupBy(F.window(ts, width))
    out = w.agg(F.count("*").alias("executions"), F.count_if(F.col("request_status") != "succeeded").alias("failed"), F.avg("request_latency_ms").alias("mean_latency"))
    return out.select(F.col("window.start").alias("bucket"), "executions", "failed", "mean_latency")


def once_per_key(stream: DataFrame, keys: Sequence[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key within the watermark: a request that is sent again is taken in once."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def contract_gate(stream: DataFrame, expectations: Sequence[Expectation], accepted: str, rejected: str) -> DataStreamWriter:
    """A writer that sends each micro-batch's accepted and rejected rows to two folders. A batch that runs again replaces what it wrote before; unique holds within a batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for side, path in zip(split(batch, expectations), (accepted, rejected), strict=True):
                side.write.mode("overwrite").parquet(f"{path}/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(write)


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process what is there and stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_table(df: DataFrame, path: str, checkpoint: str) -> None:
    run_available(df.writeStream.format("parquet").option("path", path).outputMode("append"), checkpoint)
