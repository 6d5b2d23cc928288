"""Acceptance gates, audits and checks that end in a verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gate(reasons: dict[str, Column]) -> tuple[Column, Column]:
    """(pass, reasons): a missing measurement counts as a failure."""
    failed = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in reasons.items())))
    return F.size(failed) == 0, F.concat_ws(",", failed)


def first_class(rules: dict[str, Column], default: str) -> Column:
    """The first rule that holds names the class."""
    out = F.when(F.lit(False), F.lit(""))
    for name, c in rules.items():
        out = out.when(c, F.lit(name))
    return out.otherwise(F.lit(default))


def tri_state(failed: Column, passed: Column, evidence: Column) -> Column:
    """Any failure is ineffective; all passed with evidence is effective; else unknown."""
    return F.when(failed, "ineffective").when(passed & evidence, "effective").otherwise("unknown")


def fault_scores(rows: DataFrame) -> DataFrame:
    """Detection and repair rates of faulty rows, false-positive rate of clean ones, by kind of fault."""
    return rows.groupBy("kind").agg(
        F.count_if("faulty").alias("faulty"),
        F.count_if(F.col("faulty") & F.col("flagged")).alias("detected"),
        F.count_if(F.col("faulty") & F.col("repaired")).alias("repaired"),
        F.count_if(~F.col("faulty")).alias("clean"),
        F.count_if(~F.col("faulty") & F.col("flagged")).alias("false_positives"),
    )


def arm_summary(rows: DataFrame) -> DataFrame:
    """By arm: tries, hits, failures, tokens (null if any is missing), mean latency."""
    tokens = F.when(F.count_if(F.col("tokens").isNull()) == 0, F.sum("tokens"))
    return rows.groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("hits"), F.count_if("failed").alias("failures"), tokens.alias("tokens"))


def sampling_audit(samples: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """Whether a key's sample times only rise and its rate lies within bounds; times in seconds."""
    w = Window.partitionBy(*keys).orderBy("i")
    step = F.col("t") - F.lag("t", 1).over(w)
    checked = samples.withColumn("_up", F.coalesce(step > 0, F.lit(True)))
    out = checked.groupBy(*keys).agg(F.bool_and("_up").alias("monotonic"), F.count(F.lit(1)).alias("n"), (F.max("t") - F.min("t")).alias("span"))
    rate = (F.col("n") - 1) / F.col("span")
    return out.withColumn("in_range", F.coalesce((rate >= low) & (rate <= high), F.lit(False)))


KINDS = 10_000  # kinds of a vocabulary at most


def unclaimed(claims: DataFrame, kinds: DataFrame, key: str) -> DataFrame:
    """Kinds that a key never claims: the vocabulary, one row of KINDS kinds at most, else it fails, less those seen."""
    if kinds.select("kind").distinct().limit(KINDS + 1).count() > KINDS:
        raise ValueError(f"more than {KINDS} kinds")
    every = kinds.agg(F.array_sort(F.collect_set("kind")).alias("_every"))
    seen = claims.groupBy(key).agg(F.collect_set("kind").alias("_seen")).crossJoin(F.broadcast(every))
    return seen.select(key, F.explode(F.array_except("_every", "_seen")).alias("kind"))


def design_join(rows: DataFrame, private: DataFrame, key: str) -> DataFrame:
    """Rows with their private design; a row without one is an error, not a loss."""
    joined = rows.join(private.withColumn("_there", F.lit(True)), key, "left")
    return joined.withColumn("weight", F.when(F.col("_there").isNull(), F.raise_error(F.lit("a sampled row has no design"))).otherwise(F.col("weight"))).drop("_there")


def point_in_interval(points: DataFrame, marks: DataFrame, keys: list[str], width: int) -> DataFrame:
    """The first labelled interval (s2, e2, label) that holds each point (id, t), ends included; none is null."""
    placed = marks.withColumn("_b", F.explode(F.sequence(F.floor(F.col("s2") / width), F.floor(F.col("e2") / width))))
    hits = points.withColumn("_b", F.floor(F.col("t") / width)).join(placed, [*keys, "_b"]).where("t >= s2 AND t <= e2")
    first = hits.groupBy(*keys, "id").agg(F.min_by("label", F.struct("s2", "label")).alias("label"))
    return points.join(first, [*keys, "id"], "left")


def upper_percentiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Interpolated median and the ninetieth percentile by rank."""
    return df.groupBy(*keys).agg(F.percentile(value, 0.5).alias("median"), F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY {value})").alias("p90"))


def rms_onsets(samples: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """The ``n`` largest rises of the mean square between neighbouring windows of each key."""
    energy = samples.groupBy(*keys, "w").agg(F.sum(F.col(value) * F.col(value)).alias("total"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("w")
    rise = energy.withColumn("rise", F.floor(F.col("total") / F.col("n")) - F.floor(F.lag("total", 1).over(order) / F.lag("n", 1).over(order)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rise"), "w"))
    return rise.where("rise > 0").withColumn("place", place.cast("long")).where(F.col("place") <= n)
