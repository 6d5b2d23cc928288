"""Event-time windows on a stream, with the same rules as the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events with a zoned timestamp and a watermark; a plain timestamp without zone cannot carry one."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def sliding_counts(events: DataFrame, width: str = "45 minutes", step: str = "15 minutes") -> DataFrame:
    """Events and their total value by type in sliding windows."""
    out = events.groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return out.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "cents")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """Sessions of each user: runs of events less than ``gap`` apart."""
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all data there is, write its complete result at ``path``, and return that table."""

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result")

    query = stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/result")
