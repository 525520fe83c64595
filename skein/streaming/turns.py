"""Turns as a stream: activity by windows of turns, and keyed upserts that agree with the batch result.

A turn's number is its event time: turn n lies n seconds after the epoch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def with_time(turns: DataFrame) -> DataFrame:
    return turns.withColumn("at", F.timestamp_seconds("turn_no"))


def activity_by_bucket(turns: DataFrame, width: int = 25, late: int = 50) -> DataFrame:
    """Turns and characters of each session in buckets of ``width`` turns; turns later than ``late`` behind are dropped."""
    own = with_time(turns).withWatermark("at", f"{late} seconds")
    return own.groupBy("session_id", F.window("at", f"{width} seconds").alias("w")).agg(F.count("*").alias("turns"), F.sum(F.char_length("text")).alias("chars")).select("session_id", F.unix_seconds("w.start").alias("from_turn"), "turns", "chars")


def activity_sessions(turns: DataFrame, gap: int = 20, late: int = 50) -> DataFrame:
    """Runs of turns of a session without a pause of ``gap`` turns."""
    own = with_time(turns).withWatermark("at", f"{late} seconds")
    return own.groupBy("session_id", F.session_window("at", f"{gap} seconds").alias("w")).agg(F.count("*").alias("turns")).select("session_id", F.unix_seconds("w.start").alias("first_turn"), "turns")


def upsert_stream(updates: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame], empty: DataFrame) -> StreamingQuery:
    """Fold each micro-batch into the table at ``path`` by ``merge(current, batch)``.

    Every batch writes a whole new version under its batch id, so a batch that runs twice
    after a lost executor overwrites its own version only. The version before the one that was read is removed.
    """
    spark = empty.sparkSession

    def fold(batch: DataFrame, number: int) -> None:
        current = empty if number == 0 else spark.read.schema(empty.schema).parquet(f"{path}/v{number - 1}")
        merge(current, batch).write.mode("overwrite").parquet(f"{path}/v{number}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{number - 2}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return updates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(fold).start()


def latest(spark, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v{number}")
