"""Tables written as the files that other tools leave, and read back; and a registered function."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions.registered import REGISTRY
from loomline.operators.tables import shared_dir
from loomline.plans.timeline import MINUTE
from loomline.sources import files
from loomline.sources.driver_tables import EVENT_INTERVALS_SQL, LEADERBOARDS_SQL, event_intervals, leaderboards, table

HOUR = 60 * MINUTE


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def leaderboard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five leaderboards as one JSON document each, read with their list and ranks."""
    path = _place(spark, "leaderboards")
    item = F.struct("rank", F.col("item_id").cast("string").alias("item_id"), F.col("title").alias("item_title"), F.col("author").alias("nick_name"), F.col("likes").alias("like_cnt"), F.col("views").alias("play_cnt"))
    lists = leaderboards(spark, sf_dir).groupBy(F.col("list_id").alias("list")).agg(F.array_sort(F.collect_list(item)).alias("objs"))
    lists.select("list", F.to_json(F.struct(F.lit(0).alias("code"), F.struct("objs").alias("data"))).alias("value")).write.partitionBy("list").text(path)
    return files.read_leaderboards(spark, path)


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a line log in which every tenth line is cut off, read without those."""
    path = _place(spark, "log")
    line = F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("tool"), F.col("value").alias("cost")))
    table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    rows = files.read_log(spark, path, T.StructType([T.StructField("id", T.LongType()), T.StructField("tool", T.StringType()), T.StructField("cost", T.DoubleType())]))
    return rows.groupBy("tool").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("cost") * 100).cast("long")).alias("cents"))


def csv_with_mark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as CSV with a byte order mark and fixed columns, read back."""
    path = _place(spark, "csv")
    files.write_csv(table(spark, sf_dir, "part").withColumn("p_brand", F.when(F.col("p_size") % 5 != 0, F.col("p_brand"))), path, ["p_partkey", "p_name", "p_brand"])
    return files.read_csv(spark, path, T.StructType([T.StructField("p_partkey", T.LongType()), T.StructField("p_name", T.StringType()), T.StructField("p_brand", T.StringType())]))


def envelopes_of_tool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of customers in a folder for each nation, those of one segment, read with folder and file."""
    path = _place(spark, "envelopes")
    rows = table(spark, sf_dir, "customer").select("c_nationkey", F.col("c_mktsegment").alias("tool"), F.col("c_custkey").cast("string").alias("source_id"), F.struct(F.round(F.col("c_acctbal") * 100).cast("long").alias("cents")).alias("output"))
    files.write_envelopes(rows, path, "c_nationkey")
    found = files.read_envelopes(spark, path, "BUILDING", "struct<cents:bigint>")
    return found.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.sum("output.cents").alias("cents"), F.countDistinct("file").alias("files"), F.bool_and(F.col("changed").isNotNull()).alias("dated"))


def vector_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as a vector store, read after its facts were checked against the rows."""
    path = _place(spark, "vectors")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("text"), "embedding")
    files.write_vectors(rows, path, "model-1")
    return files.read_vectors(spark, path, rows, "model-1").select("id", "text", F.size("embedding").cast("long").alias("dim"))


def device_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a device table and suppliers as their processes, both CSV, joined by uuid."""
    path, parts, lines = _place(spark, "devices"), table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    parts.select(F.concat(F.lit("GPU-"), "p_partkey").alias("uuid"), (F.col("p_size") * 40).alias("memory_mib"), (F.col("p_partkey") % 11).alias("load")).write.option("header", True).csv(f"{path}/devices")
    lines.where("l_orderkey % 40 = 0").select(F.concat(F.lit("GPU-"), "l_partkey").alias("uuid"), (F.col("l_suppkey") % 3).alias("pid")).write.option("header", True).csv(f"{path}/processes")
    devices = spark.read.schema("uuid string, memory_mib long, load long").option("header", True).csv(f"{path}/devices")
    processes = spark.read.schema("uuid string, pid long").option("header", True).csv(f"{path}/processes")
    return files.device_eligibility(devices, processes, [1]).select("uuid", "eligible")


def registered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping windows over each user's events by a registered skill, whose table function runs in SQL (2.13)."""
    spans = event_intervals(spark, sf_dir).groupBy("key").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    return REGISTRY.run("overlapping_windows", {"spans": "committed"}, spans=spans.withColumns({"width": F.lit(36 * HOUR).cast("long"), "shared": F.lit(6 * HOUR).cast("long")}))


QUERIES = {f.__name__: f for f in (leaderboard_documents, event_log, csv_with_mark, envelopes_of_tool, vector_store, device_tables, registered_windows)}

ORACLE_SQL = {
    "leaderboard_documents": f"WITH {LEADERBOARDS_SQL} SELECT CAST(item_id AS VARCHAR) AS item_id, list_id, rank, likes, views, title, author FROM lists",
    "event_log": "SELECT event_type AS tool, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events WHERE event_id % 10 <> 0 GROUP BY 1",
    "csv_with_mark": "SELECT p_partkey, p_name, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS p_brand FROM part",
    "envelopes_of_tool": "SELECT 'c_nationkey=' || c_nationkey AS folder, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents, CAST(1 AS BIGINT) AS files, true AS dated FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY 1",
    "vector_store": "SELECT vec_id AS id, CAST(label AS VARCHAR) AS text, len(embedding) AS dim FROM embeddings",
    "device_tables": """WITH p AS (SELECT l_partkey AS k, list(DISTINCT l_suppkey % 3) AS pids FROM lineitem WHERE l_orderkey % 40 = 0 GROUP BY 1)
SELECT 'GPU-' || p_partkey AS uuid, CASE WHEN pids IS NULL THEN p_size * 40 <= 1000 AND p_partkey % 11 <= 5 ELSE len(list_filter(pids, lambda x: x <> 1)) = 0 END AS eligible FROM part LEFT JOIN p ON k = p_partkey""",
    "registered_windows": f"""WITH {EVENT_INTERVALS_SQL}, b AS (SELECT key, min(s) AS lo, max(e) AS hi FROM ivl GROUP BY key),
w AS (SELECT key, lo, hi, unnest(range(greatest(1, CAST(ceil((hi - lo - {6 * HOUR}) / {30 * HOUR}::DOUBLE) AS BIGINT)))) AS i FROM b) SELECT key, i, lo + i * {30 * HOUR} AS s, least(hi, lo + i * {30 * HOUR} + {36 * HOUR}) AS e FROM w""",
}
