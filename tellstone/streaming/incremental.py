"""Incremental versions of batch operators. Each run takes what is new and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tellstone.operators import corrections, motifs


def stream_of(spark: SparkSession, folder: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def run_once(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Process all that is new in batches and stop; a batch may be repeated after a failure, so ``each`` must be idempotent."""
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start().awaitTermination()


def windowed_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window_start, kind, n of a stream; a window closes ``late`` after its end, later events are dropped."""
    stamped = events.select(F.col(at).cast("timestamp").alias("at"), F.col(kind).alias("kind")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", width).alias("w"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "kind", "n")


def append_corrections(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append new correction events to the log, a folder for each batch: a repeated batch overwrites itself.

    The current states are ``corrections.states`` over the log.
    """

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_once(stream, checkpoint, each)


def current_states(spark: SparkSession, path: str) -> DataFrame:
    return corrections.states(spark.read.schema(corrections.SCHEMA).option("basePath", path).parquet(f"{path}/batch=*"))


def count_motifs(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Motif counts of new texts (text_id, full), a folder for each batch; their sum is the count of all."""

    def each(batch: DataFrame, number: int) -> None:
        counts = motifs.motif_matches(batch).groupBy("motif_id").agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_once(stream, checkpoint, each)


def motif_totals(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("motif_id string, n_texts long, n long").parquet(f"{path}/batch=*")
    return rows.groupBy("motif_id").agg(F.sum("n_texts").alias("n_texts"), F.sum("n").alias("n"))
