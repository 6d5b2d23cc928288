"""Merging records that appear in several ranked lists, and ranking the merged records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Lists in order of priority (fixed values).
PRIORITY = (1001, 1002, 1005, 1003, 1004)
LIST_SIZE = 20
NO_RANK = 1_000_000


def list_priority(list_id: Column, priority: tuple[int, ...] = PRIORITY) -> Column:
    """Place of a list in the order of priority; unknown lists come last."""
    return reduce(lambda c, p: c.when(list_id == p[1], p[0]), enumerate(priority), F.when(F.lit(False), 0)).otherwise(len(priority))


def merge_records(rows: DataFrame, fields: tuple[str, ...] = ("title", "author", "likes", "views")) -> DataFrame:
    """One row for each ``item_id``: its lists in order of priority, its rank in each, each field's first known value.

    Records of an item are ordered by (list priority, rank, list). Every field is one
    ``min_by`` over the rows where it is known, so partial aggregation keeps one row an item and task.
    """
    order = F.struct(list_priority(F.col("list_id")).alias("p"), "rank", "list_id")
    ordered = rows.withColumn("o", order)
    firsts = [F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col("o"))).alias(f) for f in fields]
    seen = F.array_sort(F.collect_set(F.struct("o.p", "list_id", "rank")))
    merged = ordered.groupBy("item_id").agg(*firsts, seen.alias("seen"))
    distinct = F.array_distinct(F.transform("seen", lambda x: x["list_id"]))
    ranks = F.aggregate(
        "seen", F.create_map().cast("map<bigint,bigint>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["list_id"]), F.create_map(x["list_id"], F.least(x["rank"], F.coalesce(m[x["list_id"]], x["rank"]))))
    )
    return merged.select("item_id", *fields, distinct.alias("lists"), ranks.alias("ranks"))


def rank_key(priority: tuple[int, ...] = PRIORITY[:3]) -> list[Column]:
    """Descending: number of lists, 21 - rank in each of the first lists (0 if unlisted), likes or -1; then smaller id."""
    points = [F.coalesce(F.lit(LIST_SIZE + 1) - F.col("ranks")[F.lit(p).cast("long")], F.lit(0)) for p in priority]
    return [F.desc(F.size("lists")), *(p.desc() for p in points), F.coalesce("likes", F.lit(-1)).desc(), F.col("item_id").asc()]


def top_records(merged: DataFrame, n: int = LIST_SIZE) -> DataFrame:
    """The first ``n`` merged records with ``final_rank``; the limit comes before the numbering, so each task keeps n rows."""
    best = merged.orderBy(*rank_key()).limit(n)
    return best.withColumn("final_rank", F.row_number().over(Window.orderBy(*rank_key())).cast("long"))


def top_by_category(rows: DataFrame, category: str, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each category with ``pick``; Spark keeps k rows a category and task before the shuffle."""
    place = F.row_number().over(Window.partitionBy(category).orderBy(*order)).cast("long")
    return rows.withColumn("pick", place).where(F.col("pick") <= k)


def category_gaps(picked: DataFrame, categories: DataFrame, category: str, k: int) -> DataFrame:
    """Every category with the number picked and the gap to ``k``."""
    counts = picked.groupBy(category).agg(F.count(F.lit(1)).alias("picked"))
    joined = categories.select(category).distinct().join(counts, category, "left")
    n = F.coalesce("picked", F.lit(0)).cast("long")
    return joined.select(category, n.alias("picked"), (F.lit(k) - n).cast("long").alias("gap"))
