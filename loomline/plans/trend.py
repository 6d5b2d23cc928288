"""Leaderboards: merge, rank, pivot, categories, rolling days."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.ranking import NO_RANK, category_gaps, merge_records, top_by_category, top_records
from loomline.sources.driver_tables import LEADERBOARDS_SQL, leaderboards, table

LISTS = (1001, 1002, 1003, 1004, 1005)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_records(leaderboards(spark, sf_dir))


def trend_merge_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best merged records."""
    top = top_records(_merged(spark, sf_dir))
    return top.select("item_id", "title", "author", "likes", "views", F.concat_ws(",", F.transform("lists", lambda x: x.cast("string"))).alias("lists"), "final_rank")


MERGED_SQL = f"""{LEADERBOARDS_SQL},
ordered AS (SELECT *, CASE list_id WHEN 1001 THEN 0 WHEN 1002 THEN 1 WHEN 1005 THEN 2 WHEN 1003 THEN 3 ELSE 4 END AS p FROM lists),
merged AS (
  SELECT item_id,
         arg_min(title, p) FILTER (title IS NOT NULL) AS title, arg_min(author, p) FILTER (author IS NOT NULL) AS author,
         arg_min(likes, p) FILTER (likes IS NOT NULL) AS likes, arg_min(views, p) FILTER (views IS NOT NULL) AS views,
         string_agg(CAST(list_id AS VARCHAR), ',' ORDER BY p) AS lists, count(*) AS n_lists,
         max(CASE WHEN list_id = 1001 THEN rank END) AS r1001, max(CASE WHEN list_id = 1002 THEN rank END) AS r1002,
         max(CASE WHEN list_id = 1003 THEN rank END) AS r1003, max(CASE WHEN list_id = 1004 THEN rank END) AS r1004,
         max(CASE WHEN list_id = 1005 THEN rank END) AS r1005
  FROM ordered GROUP BY item_id)"""


def trend_csv_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged records with one rank column a list, as the CSV writer lays them out."""
    merged = _merged(spark, sf_dir)
    ranks = (F.coalesce(F.col("ranks")[F.lit(x).cast("long")].cast("string"), F.lit("")).alias(f"rank_{x}") for x in LISTS)
    return merged.select("item_id", F.coalesce("title", F.lit("")).alias("title"), F.size("lists").cast("long").alias("n_lists"), *ranks)


def _by_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.array_min(F.map_values("ranks"))
    merged = _merged(spark, sf_dir).select("item_id", F.col("author").alias("category"), F.size("lists").alias("n"), F.coalesce(best, F.lit(NO_RANK)).alias("best"), "likes")
    return top_by_category(merged, "category", [F.desc("n"), F.asc("best"), F.coalesce("likes", F.lit(-1)).desc(), F.asc("item_id")], 2)


def trend_topk_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two most popular merged records of each brand (K2)."""
    return _by_brand(spark, sf_dir).select("category", "item_id", "pick")


def trend_category_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each brand, how many of two places are filled (K2)."""
    return category_gaps(_by_brand(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_brand").alias("category")), "category", 2)


TOPK_SQL = f"""{MERGED_SQL},
picked AS (
  SELECT author AS category, item_id,
         row_number() OVER (PARTITION BY author ORDER BY n_lists DESC, least(r1001, r1002, r1003, r1004, r1005), coalesce(likes, -1) DESC, item_id) AS pick
  FROM merged)"""


def rolling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users seen in the last seven days of the log: freshest event, its type, days seen."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    last = events.agg(F.max("day").alias("last"))
    recent = events.join(F.broadcast(last), F.col("day") > F.date_sub("last", 7))
    return recent.groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("newest_type"), F.max("event_id").alias("newest_id"), F.count_distinct("day").alias("days")
    )


ROLLING_SQL = """WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events)
SELECT user_id, arg_max(event_type, (ts, event_id)) AS newest_type, max(event_id) AS newest_id, count(DISTINCT day) AS days
FROM e WHERE day > (SELECT max(day) FROM e) - 7 GROUP BY user_id"""

QUERIES = {f.__name__: f for f in (trend_merge_rank, trend_csv_pivot, trend_topk_per_category, trend_category_gap, rolling_candidates)}
ORACLE_SQL = {
    "trend_merge_rank": f"""WITH {MERGED_SQL}
SELECT item_id, title, author, likes, views, lists,
       row_number() OVER (ORDER BY n_lists DESC, coalesce(21 - r1001, 0) DESC, coalesce(21 - r1002, 0) DESC, coalesce(21 - r1005, 0) DESC, coalesce(likes, -1) DESC, item_id) AS final_rank
FROM merged QUALIFY final_rank <= 20""",
    "trend_csv_pivot": f"""WITH {MERGED_SQL}
SELECT item_id, coalesce(title, '') AS title, n_lists,
       {", ".join(f"coalesce(CAST(r{x} AS VARCHAR), '') AS rank_{x}" for x in LISTS)} FROM merged""",
    "trend_topk_per_category": f"WITH {TOPK_SQL} SELECT category, item_id, pick FROM picked WHERE pick <= 2",
    "trend_category_gap": f"""WITH {TOPK_SQL}
SELECT b.p_brand AS category, count(item_id) AS picked, 2 - count(item_id) AS gap
FROM (SELECT DISTINCT p_brand FROM part) b LEFT JOIN (SELECT * FROM picked WHERE pick <= 2) p ON p.category = b.p_brand GROUP BY 1""",
    "rolling_candidates": ROLLING_SQL,
}
