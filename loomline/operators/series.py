"""Sampled series: sliding windows, robust normalisation, signal events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sliding_means(samples: DataFrame, keys: list[str], width: int, step: int, values: list[str]) -> DataFrame:
    """Means of ``values`` in half-open windows of ``width`` every ``step``; samples have t.

    Windows start at 0 and stop with the first that reaches the key's last sample; empty ones are
    left out. A sample is dealt to the width / step windows that hold it, so the shuffle carries partial sums.
    """
    end = Window.partitionBy(*keys)
    first = F.greatest(F.lit(0), F.floor((F.col("t") - width) / step) + 1).cast("long")
    dealt = samples.withColumn("w", F.explode(F.sequence(first, F.floor(F.col("t") / step).cast("long"))))
    means = dealt.groupBy(*keys, "w").agg(*(F.avg(v).alias(v) for v in values), F.count(F.lit(1)).alias("n"), F.max("t").alias("_last"))
    top = F.max("_last").over(end)
    ends = F.col("w") * step + width
    out = means.withColumn("_top", top).where((ends - step < F.col("_top")) | (F.col("w") == 0))
    return out.select(*keys, (F.col("w") * step).alias("s"), ends.alias("e"), *values, "n")


def nearest_rank(values: Column, share: float) -> Column:
    """The element at index round-half-even((n - 1) x share) of the sorted array."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, (F.rint((F.size(ordered) - 1) * F.lit(share)) + 1).cast("int"))


def robust_normalise(df: DataFrame, keys: list[str], value: str, out: str, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """(v - p10) / (p90 - p10) within [0, 1] for each key; 0 where the spread is 0.

    The percentile rows are picked by rank, so only two numbers a key are joined back.
    """
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("_r", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    at = lambda share: F.max(F.when(F.col("_r") == F.rint((F.col("_n") - 1) * share) + 1, F.col(value))).over(w)
    both = ranked.withColumn("_lo", at(low)).withColumn("_hi", at(high))
    spread = F.col("_hi") - F.col("_lo")
    scaled = F.when(spread > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(value) - F.col("_lo")) / spread))).otherwise(F.lit(0.0))
    return both.withColumn(out, scaled).drop("_r", "_n", "_lo", "_hi")


def flashes(series: DataFrame, keys: list[str], value: str, jump: float = 40.0, floor: float = 8.0) -> DataFrame:
    """Samples that leave the mean of up to four earlier ones by more than ``jump`` and are back within four more.

    Back: within max(``floor``, a quarter of the jump) of that mean.
    """
    order = Window.partitionBy(*keys).orderBy("i")
    base = F.avg(value).over(order.rowsBetween(-4, -1))
    ahead = F.collect_list(value).over(order.rowsBetween(1, 4))
    out = series.withColumn("base", base).withColumn("_ahead", ahead).withColumn("jump", F.abs(F.col(value) - F.col("base")))
    near = F.greatest(F.lit(floor), F.col("jump") * 0.25)
    return out.where((F.col("jump") > jump) & F.exists("_ahead", lambda x: F.abs(x - F.col("base")) <= near)).drop("_ahead")


def hard_cuts(series: DataFrame, value: str, least: float = 28.0) -> DataFrame:
    """Boundaries whose difference reaches ``least``."""
    return series.where(F.col(value) >= least)


def freezes(series: DataFrame, keys: list[str], still: Column, least: int = 3) -> DataFrame:
    """Runs of ``least`` or more consecutive still boundaries: first, last, count (a count, not seconds)."""
    order = Window.partitionBy(*keys).orderBy("i")
    runs = series.withColumn("_still", still).withColumn("_run", F.col("i") - F.sum(F.col("_still").cast("long")).over(order)).where("_still")
    return runs.groupBy(*keys, "_run").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_run")


def speed_ramps(series: DataFrame, keys: list[str], value: str, up: float = 2.2, down: float = 0.45, offset: float = 0.3) -> DataFrame:
    """Places where the mean of the next five samples departs from the mean of the five before."""
    order = Window.partitionBy(*keys).orderBy("i")
    before, after = F.avg(value).over(order.rowsBetween(-5, -1)), F.avg(value).over(order.rowsBetween(0, 4))
    out = series.withColumn("before", before).withColumn("after", after)
    faster = F.col("after") > F.col("before") * up + offset
    slower = (F.col("before") > 0.5) & (F.col("after") < F.col("before") * down)
    return out.where(faster | slower).withColumn("kind", F.when(faster, "faster").otherwise("slower"))


def running_share(df: DataFrame, order_col: str, value: str) -> DataFrame:
    """How often a value has occurred so far, and its share of the rows so far, in the order given."""
    seen = F.count(F.lit(1)).over(Window.partitionBy(value).orderBy(order_col))
    return df.withColumn("seen", seen)
