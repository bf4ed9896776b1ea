"""Incremental growth of a cohort from a folder into which observation files are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.matrix import VIEW

PARTS = ["assay", "haplotype", "strand", "chrom"]


def stream_observations(spark: SparkSession, folder: str, schema: str, output: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append new files of observations to a partitioned table, each file exactly once; a batch that is
    run again replaces its own folder, so a failure leaves no half batch behind."""

    def put(batch: DataFrame, epoch: int) -> None:
        x = batch.where(F.col("value").between(0, 10000)).repartitionByRange(*PARTS, "row_id").sortWithinPartitions(*PARTS, "row_id")
        x.write.mode("overwrite").partitionBy(*PARTS).parquet(f"{output}/batch={epoch}")

    w = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()


def running_counts(obs: DataFrame, late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Observed cells per view, sample and window of ``loaded_at``, for a stream or a table. Rows more
    than ``late`` behind are dropped by the watermark, as a stream must."""
    x = obs.withColumn("at", F.col("loaded_at").cast("timestamp"))
    if obs.isStreaming:
        x = x.withWatermark("at", late)
    return x.groupBy(F.window("at", window).alias("w"), *VIEW, "sample_id").agg(F.count(F.lit(1)).alias("n_observed")).select(
        F.col("w.start").alias("window_start"), *VIEW, "sample_id", "n_observed"
    )
