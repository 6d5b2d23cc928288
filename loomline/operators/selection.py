"""Choosing under quotas: per kind, per partition, per combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators.tables import numbered


def quota_selection(df: DataFrame, keys: list[str], num: int, den: int, cap: int, total: int) -> DataFrame:
    """Greedy choice by score, then start: at most ``cap`` a ``part``, ``total`` in all, no overlap above num / den of the shorter.

    A key is one recording and its rows are windows on a fixed step, so the fold's list is bounded by
    the recording's length over the step.
    """
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "s", "id", "e", "part")))
    none = F.array().cast("array<struct<k:bigint,s:bigint,id:bigint,e:bigint,part:bigint>>")

    def clash(x, y):
        return (F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"])) * den > F.least(x["e"] - x["s"], y["e"] - y["s"]) * num

    def step(acc, x):
        full = (F.size(acc) >= total) | (F.size(F.filter(acc, lambda y: y["part"] == x["part"])) >= cap) | F.exists(acc, lambda y: clash(x, y))
        return F.when(full, acc).otherwise(F.concat(acc, F.array(x)))

    picked = df.groupBy(*keys).agg(F.aggregate(rows, none, step).alias("p"))
    return picked.select(*keys, F.explode("p").alias("p")).select(*keys, "p.id", "p.part", "p.s", "p.e")


def diversity_cap(df: DataFrame, keys: list[str], kind: str, n: int) -> DataFrame:
    """``n`` rows of each key: the best of every kind first, then the best of the rest (W2h)."""
    first = F.row_number().over(Window.partitionBy(*keys, kind).orderBy(F.desc("score"), "id"))
    marked = df.withColumn("_f", (first > 1).cast("int"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_f", F.desc("score"), "id"))
    return marked.withColumn("place", place.cast("long")).where(F.col("place") <= n).drop("_f")


def shortest_per_phase(df: DataFrame, keys: list[str], phase: str) -> DataFrame:
    """The shortest row of each phase, then the earliest (K8)."""
    order = Window.partitionBy(*keys, phase).orderBy((F.col("e") - F.col("s")).asc(), "s", "id")
    return df.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def shortlist(df: DataFrame, category: str, order: list[Column], k: int, unknown: int) -> DataFrame:
    """The first ``k`` of each category and the first ``unknown`` rows without one (K3)."""
    placed = df.withColumn("place", F.row_number().over(Window.partitionBy(category).orderBy(*order)).cast("long"))
    return placed.where(F.when(F.col(category).isNull(), F.col("place") <= unknown).otherwise(F.col("place") <= k))


def plan_ranking(plans: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Eligible plans first, then the weighted score, shorter, fewer parts, smaller id."""
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    order = [F.desc("eligible"), F.desc("total"), F.col("duration"), F.col("parts"), F.col("id")]
    return numbered(plans.withColumn("total", total), order).withColumn("place", F.col("pos") + 1).drop("pos")


def missing_uses(tasks: DataFrame, required: str, present: str) -> DataFrame:
    """Required uses that a task's evidence lacks, and whether none is."""
    lacking = F.array_sort(F.array_except(required, present))
    return tasks.withColumn("lacking", F.concat_ws(",", lacking)).withColumn("complete", F.size(lacking) == 0)


def pool_near_core(df: DataFrame, core: DataFrame, keys: list[str], n: int) -> DataFrame:
    """Rows of a key by distance from its core interval (lo, hi), nearest ``n``."""
    joined = df.join(core, keys)
    distance = F.greatest(F.lit(0), F.col("lo") - F.col("e"), F.col("s") - F.col("hi"))
    placed = joined.withColumn("distance", distance)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("distance", "s", "id"))
    return placed.withColumn("place", place.cast("long")).where(F.col("place") <= n)
