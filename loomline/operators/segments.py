"""Cutting timelines into segments, quantising, validating and scoring them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def boundaries_to_segments(cuts: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Segments between the distinct cuts (t) strictly inside each span (lo, hi), ends included."""
    inside = cuts.join(spans, keys).where("t > lo AND t < hi").select(*keys, "t")
    points = inside.unionByName(spans.select(*keys, F.col("lo").alias("t"))).unionByName(spans.select(*keys, F.col("hi").alias("t"))).distinct()
    nxt = F.lead("t", 1).over(Window.partitionBy(*keys).orderBy("t"))
    return points.withColumn("e", nxt).where("e IS NOT NULL").select(*keys, F.col("t").alias("s"), "e")


def longest_in_order(segments: DataFrame, keys: list[str], n: int, shortest: int) -> DataFrame:
    """The ``n`` longest segments of each key not below ``shortest``, numbered by time."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy((F.col("s") - F.col("e")).asc(), "s"))
    kept = segments.where(F.col("e") - F.col("s") >= shortest).withColumn("_r", rank).where(F.col("_r") <= n).drop("_r")
    return kept.withColumn("shot", F.row_number().over(Window.partitionBy(*keys).orderBy("s")).cast("long"))


def merge_short(segments: DataFrame, keys: list[str], shortest: int) -> DataFrame:
    """Segments shorter than ``shortest`` join the one before them (the first joins nothing)."""
    order = Window.partitionBy(*keys).orderBy("s")
    opens = ((F.col("e") - F.col("s") >= shortest) | (F.row_number().over(order) == 1)).cast("long")
    marked = segments.withColumn("_o", opens).withColumn("_g", F.sum("_o").over(order))
    return marked.groupBy(*keys, "_g").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n")).drop("_g")


def classify_segments(segments: DataFrame, keys: list[str], shortest: int) -> DataFrame:
    """Short segments with a neighbour on both sides are transitions, the rest content; each kind is numbered."""
    order = Window.partitionBy(*keys).orderBy("s")
    flanked = (F.lag("e", 1).over(order) == F.col("s")) & (F.lead("s", 1).over(order) == F.col("e"))
    kind = F.when((F.col("e") - F.col("s") < shortest) & F.coalesce(flanked, F.lit(False)), "transition").otherwise("content")
    return segments.withColumn("kind", kind).withColumn("ordinal", F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("s")).cast("long"))


def frames_needed(need: Column, base: int = 17, rest: int = 5, most: int = 294) -> Column:
    """The smallest 17n + 5 frames that reach ``need``, within the limits."""
    n = F.greatest(F.lit(1), F.ceil((need - rest) / base).cast("long"))
    return F.least(n * base + rest, F.lit(most)).cast("long")


def split_sizes(length: Column) -> Column:
    """The next smaller window after a failure: 20, 16, 12, then none (I16)."""
    return F.when(length > 20, 20).when(length > 16, 16).when(length > 12, 12)


def render_window(s: Column, e: Column, most: int, pre: int = 300, post: int = 200) -> tuple[Column, Column]:
    """Pre-roll and post-roll around a core, trimmed evenly to ``most``."""
    lo, hi = F.greatest(s - pre, F.lit(0)), e + post
    over = F.greatest(F.lit(0), hi - lo - most)
    return lo + F.floor(over / 2), hi - (over - F.floor(over / 2))


def coverage_penalty(segments: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """Gaps between a key's segments plus what is missing at the tail of its span."""
    order = Window.partitionBy(*keys).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.greatest(F.lit(0), F.col("s") - F.coalesce(F.max("e").over(order), F.lit(0)))
    each = segments.withColumn("_gap", gap).groupBy(*keys).agg(F.sum("_gap").alias("gaps"), F.max("e").alias("_end"))
    return each.join(spans, keys).select(*keys, (F.col("gaps") + F.greatest(F.lit(0), F.col("hi") - F.col("_end"))).alias("penalty"))


def running_offsets(df: DataFrame, keys: list[str], order: str, length: Column) -> DataFrame:
    """Consecutive target intervals: each starts where the last one ended."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(length).over(w)
    return df.withColumn("target_e", end).withColumn("target_s", end - length)


def violations(df: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """For each row that breaks a rule, the names of the rules it breaks; a rule is a condition that must not hold."""
    broken = F.array_compact(F.array(*(F.when(c, F.lit(name)) for name, c in rules.items())))
    return df.withColumn("violations", broken).where(F.size("violations") > 0).select(*key, F.concat_ws(",", "violations").alias("violations"))


def timeline_checks(df: DataFrame, keys: list[str]) -> DataFrame:
    """Gap, overlap and order against the row before of the same key."""
    order = Window.partitionBy(*keys).orderBy("ordinal")
    before = F.lag("e", 1).over(order)
    checked = df.withColumn("gap", F.col("s") > before).withColumn("overlap", F.col("s") < before).withColumn("backwards", F.col("s") < F.lag("s", 1).over(order))
    return checked


def systematic(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """``n`` evenly spaced rows of each key: those at index int(i x size / n)."""
    w = Window.partitionBy(*keys)
    placed = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    step = F.floor((F.col("_i") * n + n - 1) / F.col("_n"))
    hit = (F.floor(step * F.col("_n") / n) == F.col("_i")) & (step < n)
    return placed.where((F.col("_n") <= n) | hit).drop("_i", "_n")


def presence_switches(df: DataFrame, keys: list[str], order: str, present: str) -> DataFrame:
    """Times a subject comes back after an absence, and its missing rows."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(present, 1).over(w)
    seen = F.max(F.col(present).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    back = F.col(present) & ~F.coalesce(before, F.lit(True)) & (seen == 1)
    return df.withColumn("_back", back).groupBy(*keys).agg(F.count_if("_back").alias("returns"), F.count_if(~F.col(present)).alias("absent"))


def stalls(df: DataFrame, keys: list[str], order: str, state: str, n: int) -> DataFrame:
    """Keys whose state stays the same for ``n`` rows in a row, with where that first happens."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.coalesce(F.col(state) != F.lag(state, 1).over(w), F.lit(True)).cast("long")
    runs = df.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(w))
    length = F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(order))
    return runs.withColumn("_l", length).where(F.col("_l") >= n).groupBy(*keys).agg(F.min(order).alias("stalled_at"))
