"""Streaming runs of the event log, to be compared with batch SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.tables import shared_dir
from loomline.plans.timeline import MINUTE, MONTH
from loomline.sources.driver_tables import ANCHOR_US, EVENT_INTERVALS_SQL, table
from loomline.streaming.stateful import run_appended, stream_min_spacing, stream_stalls
from loomline.streaming.windows import run_to_table, sessions, sliding_counts, timed


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed(spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


def _place(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and value by type in 45-minute windows every 15 minutes, by a stream (2.13, A6)."""
    return run_to_table(sliding_counts(_stream(spark, sf_dir)), _place(spark))


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user with a gap of 30 minutes, by a stream (2.13, A16)."""
    return run_to_table(sessions(_stream(spark, sf_dir)), _place(spark))


def _arrivals(spark: SparkSession, sf_dir: str, op: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``op`` tells of the event log that arrives in three parts, rows up to five hours late, and a last row of another year, which moves the watermark past all
    others. After each part the stream stops and goes on from its checkpoint with the next."""
    place, out = _place(spark), _place(spark)
    events = table(spark, sf_dir, "events").withColumnRenamed("event_id", "id").withColumn("ts", F.col("ts").cast("timestamp"))
    arrival = F.unix_micros("ts") - ANCHOR_US + F.col("id") * 7919 % 7 * 3_000_000_000
    parts = events.withColumn("_part", F.least(F.lit(2), F.floor(arrival * 3 / MONTH)))
    end = events.agg((F.max("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).withColumns({"id": F.lit(-1).cast("long"), "user_id": F.lit(-1).cast("long"), "event_type": F.lit("end")})
    for k, part in enumerate((*(parts.where(F.col("_part") == i).drop("_part") for i in range(3)), end)):
        part.write.parquet(f"{place}/{k}")
        stream = spark.readStream.schema(events.schema).option("recursiveFileLookup", True).parquet(place).withWatermark("ts", "12 hours")
        told = run_appended(op(stream), out)
    return told


def stream_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user at least six hours after the last kept one, by a stream with state whose rows arrive out of order (W3, 2.13)."""
    return _arrivals(spark, sf_dir, lambda stream: stream_min_spacing(stream, "user_id", 360 * MINUTE)).where("user_id >= 0").select("id")


def stream_stalled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with the same event type three times in a row, by a stream with state whose rows arrive out of order (W10, 2.13)."""
    return _arrivals(spark, sf_dir, lambda stream: stream_stalls(stream, "user_id", "event_type", 3)).where("user_id >= 0").select(F.col("user_id").alias("key"), "stalled_at")


QUERIES = {f.__name__: f for f in (stream_sliding, stream_session, stream_spacing, stream_stalled)}

ORACLE_SQL = {
    "stream_spacing": f"""WITH {EVENT_INTERVALS_SQL}, l AS (SELECT key, list([{{'t': s, 'id': id}}] ORDER BY s, id) AS l FROM ivl GROUP BY key),
f AS (SELECT unnest(list_reduce(l, lambda acc, x: CASE WHEN x[1].t - acc[-1].t >= {360 * MINUTE} THEN list_concat(acc, x) ELSE acc END)) AS k FROM l) SELECT k.id AS id FROM f""",
    "stream_stalled": f"""WITH {EVENT_INTERVALS_SQL}, p AS (SELECT key, s, id, kind = lag(kind) OVER w AND kind = lag(kind, 2) OVER w AS same FROM ivl WINDOW w AS (PARTITION BY key ORDER BY s, id)) SELECT key, arg_min(id, (s, id)) AS stalled_at FROM p WHERE same GROUP BY key""",
    "stream_sliding": """WITH d AS (SELECT event_type, value, epoch_us(ts) AS t, unnest(range(epoch_us(ts) // 900000000 - 2, epoch_us(ts) // 900000000 + 1)) AS w FROM events)
SELECT w * 900000000 AS start_us, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM d WHERE t < w * 900000000 + 2700000000 GROUP BY 1, 2""",
    "stream_session": """WITH g AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 1800000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(t) AS start_us, max(t) + 1800000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
}
