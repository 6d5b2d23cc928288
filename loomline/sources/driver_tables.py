"""The driver's tables and the timeline views derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Microseconds of 2024-01-01 UTC; times are kept relative to it so that sums stay inside BIGINT.
ANCHOR_US = 1_704_067_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the driver."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as intervals (id, key, kind, s, e) in microseconds; ``value`` is the length in minutes."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(ANCHOR_US)
    length = F.round(F.col("value") * 100).cast("long") * 600_000
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.col("event_type").alias("kind"), start.alias("s"), (start + length).alias("e")
    )


EVENT_INTERVALS_SQL = """ivl AS (
  SELECT event_id AS id, user_id AS key, event_type AS kind,
         epoch_us(ts) - 1704067200000000 AS s,
         epoch_us(ts) - 1704067200000000 + CAST(round(value * 100) AS BIGINT) * 600000 AS e
  FROM events)"""


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns laid end to end (conv_id, turn, role, text, s, e), a character lasting one unit."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("text").cast("long")
    start = F.coalesce(F.sum(size).over(before), F.lit(0))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", start.alias("s"), (start + size).alias("e"))


UTTERANCES_SQL = """utt AS (
  SELECT conv_id, turn, role, text,
         CAST(coalesce(sum(length(text)) OVER w, 0) AS BIGINT) AS s,
         CAST(coalesce(sum(length(text)) OVER w, 0) + length(text) AS BIGINT) AS e
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def leaderboards(spark: SparkSession, sf_dir: str, size: int = 20) -> DataFrame:
    """Five lists of the best parts (item_id, list_id, rank, likes, views, title, author), some fields missing by list."""
    lines = table(spark, sf_dir, "lineitem")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    totals = lines.groupBy(F.col("l_partkey").alias("item_id")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
        F.sum(cents).alias("revenue"),
        F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("discount"),
        F.count(F.lit(1)).alias("n_orders"),
        F.count_if(F.col("l_returnflag") == "R").alias("returns"),
    )
    metrics = {1001: "quantity", 1002: "revenue", 1003: "discount", 1004: "n_orders", 1005: "returns"}
    parts = None
    for list_id, metric in metrics.items():
        top = totals.orderBy(F.desc(metric), "item_id").limit(size)
        top = top.select(F.lit(list_id).cast("long").alias("list_id"), "item_id", F.col(metric).alias("score"), "quantity", "revenue")
        parts = top if parts is None else parts.unionByName(top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("score"), "item_id")).cast("long"))
    named = ranked.join(table(spark, sf_dir, "part"), F.col("item_id") == F.col("p_partkey"))
    return named.select(
        "item_id",
        "list_id",
        "rank",
        F.when(F.col("list_id") != 1001, F.col("quantity")).alias("likes"),
        F.when(F.col("list_id").isin(1002, 1003), F.col("revenue")).alias("views"),
        F.when(F.col("list_id") != 1005, F.col("p_name")).alias("title"),
        F.col("p_brand").alias("author"),
    )


LEADERBOARDS_SQL = """totals AS (
  SELECT l_partkey AS item_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS revenue,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS discount,
         count(*) AS n_orders, count(*) FILTER (l_returnflag = 'R') AS returns
  FROM lineitem GROUP BY 1),
scored AS (
  SELECT 1001 AS list_id, item_id, quantity AS score, quantity, revenue FROM totals
  UNION ALL SELECT 1002, item_id, revenue, quantity, revenue FROM totals
  UNION ALL SELECT 1003, item_id, discount, quantity, revenue FROM totals
  UNION ALL SELECT 1004, item_id, n_orders, quantity, revenue FROM totals
  UNION ALL SELECT 1005, item_id, returns, quantity, revenue FROM totals),
ranked AS (SELECT *, row_number() OVER (PARTITION BY list_id ORDER BY score DESC, item_id) AS rank FROM scored),
lists AS (
  SELECT item_id, CAST(list_id AS BIGINT) AS list_id, rank,
         CASE WHEN list_id <> 1001 THEN quantity END AS likes,
         CASE WHEN list_id IN (1002, 1003) THEN revenue END AS views,
         CASE WHEN list_id <> 1005 THEN p_name END AS title, p_brand AS author
  FROM ranked JOIN part ON p_partkey = item_id WHERE rank <= 20)"""
