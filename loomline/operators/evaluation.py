"""Evaluation: matching, rates, design weights, intervals of confidence, gates."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators.tables import durable, numbered

Z95 = 1.959964


def greedy_match(truth: DataFrame, pred: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """One-to-one matches of points: each truth (t_id, t) in order takes the nearest unused prediction (p_id, p) within ``tolerance``.

    Ties go to the smaller id. Candidates come from a bucketed join; points further apart than the
    tolerance never compete, so each chain of candidates folds alone.
    """
    width = max(1, tolerance)
    t = truth.withColumn("_b", F.explode(F.sequence(F.floor((F.col("t") - tolerance) / width), F.floor((F.col("t") + tolerance) / width))))
    p = pred.withColumn("_b", F.floor(F.col("p") / width))
    pairs = t.join(p, [*keys, "_b"]).where(F.abs(F.col("t") - F.col("p")) <= tolerance)
    order = Window.partitionBy(*keys).orderBy("t", "t_id")
    chained = pairs.withColumn("_far", F.coalesce(F.col("t") - F.lag("t", 1).over(order) > 2 * tolerance, F.lit(True)).cast("long")).withColumn("_run", F.sum("_far").over(order))
    rows = F.array_sort(F.collect_list(F.struct("t", "t_id", F.abs(F.col("t") - F.col("p")).alias("d"), "p_id")))
    none = F.array().cast("array<struct<t_id:bigint,p_id:bigint>>")

    def step(acc, x):
        taken = F.exists(acc, lambda y: (y["t_id"] == x["t_id"]) | (y["p_id"] == x["p_id"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(F.struct(x["t_id"].alias("t_id"), x["p_id"].alias("p_id")))))

    return chained.groupBy(*keys, "_run").agg(F.aggregate(rows, none, step).alias("m")).select(*keys, F.explode("m").alias("m")).select(*keys, "m.t_id", "m.p_id")


def precision_recall(matched: Column, n_truth: Column, n_pred: Column) -> tuple[Column, Column, Column]:
    """Precision, recall and F1, 0 where undefined."""
    p = F.when(n_pred > 0, matched / n_pred).otherwise(F.lit(0.0))
    r = F.when(n_truth > 0, matched / n_truth).otherwise(F.lit(0.0))
    return p, r, F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def stratified_sample(rows: DataFrame, strata: list[str], key: str, n: int) -> DataFrame:
    """The first ``n`` rows of each stratum by a hash of the key, with design weight N / n.

    The order is fixed, so a larger ``n`` appends without drawing again.
    """
    w = Window.partitionBy(*strata)
    order = F.row_number().over(w.orderBy(F.sha2(F.col(key).cast("string"), 256)))
    size = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("stratum_size"))
    return rows.withColumn("draw", order.cast("long")).where(F.col("draw") <= n).join(size, strata).withColumn("weight", F.col("stratum_size") / F.least(F.lit(n), F.col("stratum_size")))


def weighted_ratio(num: str, den: str, weight: str) -> tuple[Column, Column]:
    """Weighted ratio, and Kish's effective number (at least 1)."""
    wd = F.col(weight) * F.col(den)
    ratio = F.sum(F.col(weight) * F.col(num)) / F.sum(wd)
    return ratio, F.greatest(F.lit(1.0), F.sum(wd) * F.sum(wd) / F.sum(wd * wd))


def wilson(p: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson's interval; (0, 1) without observations."""
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), centre - half)).otherwise(F.lit(0.0)), F.when(n > 0, F.least(F.lit(1.0), centre + half)).otherwise(F.lit(1.0))


def three_state(low: Column, high: Column, threshold: float, false_merges: Column) -> Column:
    """FAIL on any false merge or an upper bound below the threshold, PASS from the lower bound on, else INSUFFICIENT_EVIDENCE."""
    return F.when((false_merges > 0) | (high < threshold), "FAIL").when(low >= threshold, "PASS").otherwise("INSUFFICIENT_EVIDENCE")


NEAR = 2_000_000  # rows up to which the values that draws look up are broadcast
DRAWS = 4_000_000  # draws of one task


def _draws(replicates: int):
    """Rows (stratum, its name, size, pos) -> (b, stratum, pos drawn), a batch a replicate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stratum, name, size, pos = batch.columns
            tails, sizes = [f"/{s}/{p}".encode() for s, p in zip(name.to_pylist(), pos.to_pylist(), strict=True)], size.to_numpy()
            for b in range(replicates):
                head = str(b).encode()
                marks = np.frombuffer(b"".join([md5(head + t).digest() for t in tails]), ">u4")[::4].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(marks), b)), stratum, pa.array(marks % sizes)], ["b", "stratum", "pos"])

    return run


def bootstrap_interval(rows: DataFrame, replicates: int = 2000) -> DataFrame:
    """Interval of a weighted ratio by resampling within strata, widened to Wilson's.

    ``rows``: (id, stratum, weight, num, den), of any number. Every replicate draws as many rows of each stratum, with
    replacement, as it has: draw j of replicate b takes the row at md5(b/stratum/j) modulo the stratum's size. Bounds are the sorted ratios at
    .025 n - 1 and .975 n; Wilson's interval at Kish's size keeps an all-success sample from claiming certainty. The work is rows x replicates, dealt out in tasks of ``DRAWS``; places
    are ranges, so that a stratum is many tasks, and the values of up to ``NEAR`` rows, which are counted first, are broadcast.
    """
    placed = durable(numbered(rows, [F.col("stratum"), F.col("id")]), "bootstrap-rows")
    strata = placed.groupBy("stratum").agg(F.min("pos").alias("_from"), F.count(F.lit(1)).alias("size"))
    sized = durable(placed.join(F.broadcast(strata), "stratum").withColumn("pos", F.col("pos") - F.col("_from")).drop("_from"), "bootstrap")
    n = sized.count()
    dealt = sized.select("stratum", F.col("stratum").cast("string").alias("name"), F.col("size").cast("long").alias("size"), F.col("pos").cast("long").alias("pos")).repartition(max(1, n * replicates // DRAWS))
    drawn = dealt.mapInArrow(_draws(replicates), f"b long, stratum {sized.schema['stratum'].dataType.simpleString()}, pos long")
    values = sized.select("stratum", "pos", (F.col("weight") * F.col("num")).alias("n"), (F.col("weight") * F.col("den")).alias("d"))
    hit = drawn.join(F.broadcast(values) if n <= NEAR else values, ["stratum", "pos"])
    ratios = hit.groupBy("b").agg(F.sum("n").alias("n"), F.sum("d").alias("d")).where("d > 0")
    boot = ratios.agg(F.array_sort(F.collect_list(F.col("n") / F.col("d"))).alias("r"))
    w = F.col("weight") * F.col("den")
    whole = sized.agg((F.sum(F.col("weight") * F.col("num")) / F.sum(w)).alias("estimate"), F.greatest(F.lit(1.0), F.pow(F.sum(w), 2) / F.sum(w * w)).alias("n_eff"))
    low, high = wilson(F.col("estimate"), F.col("n_eff"))
    n = F.size("r")
    at = lambda i: F.element_at("r", i + 1)
    first, last = F.greatest(F.lit(0), F.floor(n * 0.025).cast("int") - 1), F.least(n - 1, F.floor(n * 0.975).cast("int"))
    return boot.crossJoin(whole).select("estimate", F.least(at(first), low).alias("low"), F.greatest(at(last), high).alias("high"))


def ablation_gate(gain: Column, accuracy_loss: Column, calls: Column, base_calls: Column) -> Column:
    """A gain of .10, or a fifth fewer calls at an accuracy within .01."""
    return (gain >= 0.10) | ((accuracy_loss <= 0.01) & (calls <= 0.8 * base_calls))
