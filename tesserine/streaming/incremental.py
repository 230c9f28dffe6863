"""The batch bodies on streams: incremental source classification and the operation log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.operators import corpus as S


def changes_against(state: DataFrame, batch: DataFrame) -> DataFrame:
    """status of each file of a batch against the state table (file, hash); nothing counts as deleted in a batch."""
    now = batch.select(F.col("source_file").alias("file"), S.content_hash(F.col("content")).alias("hash"))
    return S.classify_changes(now, state).filter("status <> 'deleted'")


def upsert(state: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """state with rows replacing those of the same key."""
    return state.join(rows.select(key), key, "left_anti").unionByName(rows.select(*state.columns))


def run_incremental(spark: SparkSession, source: DataFrame, state_dir: str, checkpoint: str, sink):
    """Classify each micro-batch of source (source_file, content) against versioned state and hand it to sink(df, epoch).

    The state of epoch n is written beside that of n-1, so a batch that is run
    again after a failure reads and writes the same versions.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        if epoch:
            state = spark.read.parquet(f"{state_dir}/v{epoch - 1}")
        else:
            state = spark.createDataFrame([], "file string, hash string")
        rows = batch.groupBy("source_file").agg(F.max("content").alias("content"))
        sink(changes_against(state, rows), epoch)
        fresh = rows.select(F.col("source_file").alias("file"), S.content_hash(F.col("content")).alias("hash"))
        upsert(state, fresh, "file").write.mode("overwrite").parquet(f"{state_dir}/v{epoch}")

    return source.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def daily_operations(operations: DataFrame, late: str = "1 day") -> DataFrame:
    """Operations by day and status of a stream with event time `at`; rows later than `late` are dropped."""
    return operations.withWatermark("at", late).groupBy(F.window("at", "1 day").alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "status", "n")
