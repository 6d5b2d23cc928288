"""Order-dependent greedy selections, each as one fold over a bounded, independent stretch of a timeline.

A choice never depends on rows across a gap wider than the rule's reach, so timelines are first
cut into such islands; a hot key is thereby spread over as many groups as it has gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.operators.intervals import islands


def min_spacing(points: DataFrame, keys: list[str], spacing: int) -> DataFrame:
    """Keep a point (id, t) if it is ``spacing`` or more after the last kept one of its key.

    A point that far behind the point before it is always kept, so stretches without such a gap fold alone.
    """
    runs = islands(points.withColumn("s", F.col("t")).withColumn("e", F.col("t")), keys, spacing, strict=True, out="_run")
    rows = F.array_sort(F.collect_list(F.struct("t", "id")))
    none = F.array().cast("array<struct<t:bigint,id:bigint>>")
    kept = F.aggregate(rows, none, lambda acc, x: F.when((F.size(acc) == 0) | (x["t"] - F.element_at(acc, -1)["t"] >= spacing), F.concat(acc, F.array(x))).otherwise(acc))
    return runs.groupBy(*keys, "_run").agg(kept.alias("k")).select(*keys, F.explode("k").alias("k")).select(*keys, "k.id", "k.t")


def suppress_overlaps(df: DataFrame, keys: list[str], num: int, den: int) -> DataFrame:
    """Greedy suppression of intervals (id, s, e, score): best score first, then start, then id.

    A row is dropped if it shares more than num / den of the shorter length with a kept row of its
    key. Only overlapping rows compete, so each island of touching intervals folds alone.
    """
    runs = islands(df, keys, out="_run", strict=True)
    rows = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "s", "id", "e")))
    none = F.array().cast("array<struct<k:double,s:bigint,id:bigint,e:bigint>>")

    def clash(x, y):
        common = F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"])
        return common * den > F.least(x["e"] - x["s"], y["e"] - y["s"]) * num

    kept = F.aggregate(rows, none, lambda acc, x: F.when(F.exists(acc, lambda y: clash(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return runs.groupBy(*keys, "_run").agg(kept.alias("k")).select(*keys, F.explode("k").alias("k")).select(*keys, "k.id", "k.s", "k.e", (-F.col("k.k")).alias("score"))


def capped_merge(df: DataFrame, keys: list[str], gap: int, longest: int) -> DataFrame:
    """Sorted sweep: a row joins the current group if its start is less than ``gap`` after the group's end and the
    group stays within ``longest``; else it opens a new one. Rows ``gap`` or more apart never meet."""
    runs = islands(df, keys, gap, strict=True, out="_run")
    rows = F.array_sort(F.collect_list(F.struct("s", "e", "id")))
    none = F.array().cast("array<struct<s:bigint,e:bigint,n:bigint>>")
    one = F.lit(1).cast("long").alias("n")

    def step(acc, x):
        last = F.element_at(acc, -1)
        end = F.greatest(last["e"], x["e"])
        grown = F.struct(last["s"].alias("s"), end.alias("e"), (last["n"] + 1).alias("n"))
        fits = (x["s"] < last["e"] + gap) & (end - last["s"] <= longest)
        fresh = F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), one)))
        return F.when(F.size(acc) == 0, fresh).when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(fresh)

    return runs.groupBy(*keys, "_run").agg(F.aggregate(rows, none, step).alias("g")).select(*keys, F.explode("g").alias("g")).select(*keys, "g.s", "g.e", "g.n")


def anchored_groups(points: DataFrame, keys: list[str], reach: int) -> DataFrame:
    """Groups of points within ``reach`` of their first point (not of the one before): bursts, frame snapping."""
    runs = islands(points.withColumn("s", F.col("t")).withColumn("e", F.col("t")), keys, reach, out="_run")
    rows = F.array_sort(F.collect_list(F.col("t")))
    none = F.array().cast("array<struct<first:bigint,last:bigint,n:bigint>>")

    def step(acc, x):
        g = F.element_at(acc, -1)
        fresh = F.concat(acc, F.array(F.struct(x.alias("first"), x.alias("last"), F.lit(1).cast("long").alias("n"))))
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(g["first"].alias("first"), x.alias("last"), (g["n"] + 1).alias("n"))))
        return F.when(F.size(acc) == 0, fresh).when(x - g["first"] <= reach, grown).otherwise(fresh)

    return runs.groupBy(*keys, "_run").agg(F.aggregate(rows, none, step).alias("g")).select(*keys, F.explode("g").alias("g")).select(*keys, "g.first", "g.last", "g.n")
