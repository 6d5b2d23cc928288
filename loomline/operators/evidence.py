"""Merging observations: text runs, events, occurrences, leads, registries, bindings, mentions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_text_runs(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Runs of rows (t, line) with the same normalised text as the row before: first, last, number."""
    order = Window.partitionBy(*keys).orderBy("t", "line")
    marked = df.withColumn("text_key", text)
    new = F.coalesce(F.col("text_key") != F.lag("text_key", 1).over(order), F.lit(True)).cast("long")
    runs = marked.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order))
    return runs.groupBy(*keys, "_run").agg(F.first("text_key").alias("text_key"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("occurrences")).drop("_run")


def merge_events(df: DataFrame, keys: list[str]) -> DataFrame:
    """Event candidates rolled up by ``keys``: hull, best score, distinct members in order; null keys are dropped."""
    known = df.where(F.col(keys[-1]).isNotNull())
    return known.groupBy(*keys).agg(
        F.min("s").alias("s"), F.max("e").alias("e"), F.max("score").alias("score"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("member")).alias("members")
    )


def predecessors(df: DataFrame, keys: list[str]) -> DataFrame:
    """The event before each one of its key, if it has ended by then."""
    order = Window.partitionBy(*keys).orderBy("s", "id")
    return df.withColumn("preceding", F.when(F.lag("e", 1).over(order) <= F.col("s"), F.lag("id", 1).over(order)))


def distinct_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order`` (occurrence banks, unique leads)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def binding_states(df: DataFrame, entity: str) -> DataFrame:
    """State of each entity from its observations (window, supported, conflict, confidence)."""
    out = df.groupBy(entity).agg(
        F.count_distinct(F.when(F.col("supported"), F.col("window"))).alias("windows"),
        F.count_if("conflict").alias("conflicts"),
        F.sum(F.when(F.col("supported"), F.col("confidence"))).alias("total"),
        F.count_if("supported").alias("n"),
    )
    state = F.when(F.col("conflicts") > 0, "conflict").when(F.col("windows") == 0, "unobserved").otherwise("supported")
    return out.withColumn("state", state).withColumn("confidence", F.when(F.col("n") > 0, F.col("total") / F.col("n"))).drop("total")


def entity_registry(df: DataFrame, entity: str) -> DataFrame:
    """Names of each entity in the order first seen, and its shots in numeric order."""
    names = df.groupBy(entity, "name").agg(F.min("shot").alias("at"))
    ordered = names.groupBy(entity).agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("n"))
    shots = df.groupBy(entity).agg(F.array_sort(F.collect_set("shot")).alias("shots"))
    return ordered.join(shots, entity).select(entity, F.transform("n", lambda x: x["name"]).alias("names"), "shots")


def shard_merge(shards: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row a key from overlapping shards: the earliest shard's value stays, a differing later one is a conflict."""
    first = F.min_by(value, "shard")
    return shards.groupBy(*keys).agg(first.alias(value), (F.count_distinct(value) > 1).alias("conflict"), F.count_distinct("shard").alias("shards"))


def mentions(utterances: DataFrame, names: DataFrame) -> DataFrame:
    """Every (utterance, name) whose text contains the name; ``names`` (entity, alias) is a dictionary.

    Words of the text meet words of the dictionary by an equality join on the alias's first word, then the
    whole alias is checked, so neither side is crossed with the other.
    """
    words = utterances.withColumn("first_word", F.explode(F.array_distinct(F.split("text", r"[^\p{L}\p{N}]+"))))
    keyed = names.withColumn("first_word", F.get(F.split("alias", r"[^\p{L}\p{N}]+"), 0))
    return words.join(keyed, "first_word").where(F.contains("text", "alias")).drop("first_word")


def role_views(events: DataFrame) -> DataFrame:
    """One row for each event, fact and role (actor, patient), with the uses that the role allows."""
    both = events.selectExpr("*", "stack(2, 'actor', actor, 'patient', patient) AS (role, character)").where("character IS NOT NULL")
    return both.withColumn("use", F.when(F.col("role") == "actor", "agency").otherwise("received_impact"))


def arm_pairs(rows: DataFrame, key: str, arm: str, arms: list[str], value: str) -> DataFrame:
    """One row a key with each arm's last value, and whether all arms are there."""
    wide = rows.groupBy(key).pivot(arm, arms).agg(F.max_by(value, "seq"))
    whole = F.lit(True)
    for a in arms:
        whole = whole & F.col(f"`{a}`").isNotNull()
    return wide.withColumn("complete", whole)


def missing(wanted: DataFrame, present: DataFrame, key: str, size: str | None = None) -> DataFrame:
    """Wanted rows that are absent, or present with another size."""
    if size is None:
        return wanted.join(present, key, "left_anti")
    there = present.select(F.col(key), F.col(size).alias("_size"))
    return wanted.join(there, key, "left").where(F.col("_size").isNull() | (F.col("_size") != F.col(size))).drop("_size")


def cost_report(rows: DataFrame) -> DataFrame:
    """For each tool: ok and error counts, sums over ok rows only, the largest peak."""
    ok = F.col("status") == "ok"
    return rows.groupBy("tool").agg(F.count_if(ok).alias("n_ok"), F.count_if(~ok).alias("n_error"), F.sum(F.when(ok, F.col("cost"))).alias("cost"), F.max("peak").alias("peak"))


def duration_bucket(seconds: Column) -> Column:
    """<10, <20, <40 or longer."""
    return F.when(seconds < 10, "<10").when(seconds < 20, "10-20").when(seconds < 40, "20-40").otherwise(">=40")
