"""Entities: alias resolution, shared identity, registries, layered attributes, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_entities(rows: DataFrame, windowed: DataFrame, sources: DataFrame, aliases: DataFrame) -> DataFrame:
    """Canonical id of each row (source, window, entity, name): the windowed id, else the source's, else the alias's, else the name.

    Three equality joins; a bare entity id is never joined without its source.
    """
    a = windowed.select("source", "window", "entity", F.col("canonical").alias("_w"))
    b = sources.select("source", "entity", F.col("canonical").alias("_s"))
    c = aliases.select(F.col("alias").alias("name"), F.col("canonical").alias("_a"))
    joined = rows.join(a, ["source", "window", "entity"], "left").join(b, ["source", "entity"], "left").join(c, "name", "left")
    return joined.withColumn("canonical", F.coalesce("_w", "_s", "_a", F.concat(F.lit("name:"), "name"))).drop("_w", "_s", "_a")


def shares_identity(a: Column, b: Column) -> Column:
    """The two key sets meet."""
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def merge_registries(auto: DataFrame, manual: DataFrame) -> DataFrame:
    """All entities of both; references united, the manual name wins."""
    m = manual.select("entity", F.col("name").alias("_n"), F.col("refs").alias("_r"))
    both = auto.join(m, "entity", "full_outer")
    none = F.array().cast("array<bigint>")
    refs = F.array_sort(F.array_union(F.coalesce("refs", none), F.coalesce("_r", none)))
    return both.select("entity", F.coalesce("_n", "name").alias("name"), refs.alias("refs"))


def layered(base: DataFrame, layers: list[DataFrame], key: str, fields: list[str]) -> DataFrame:
    """Left joins of layers in order; a later layer's known field replaces an earlier one."""
    out = base
    for i, layer in enumerate(layers):
        out = out.join(layer.select(key, *(F.col(f).alias(f"_{i}_{f}") for f in fields)), key, "left")
        out = out.withColumns({f: F.coalesce(f"_{i}_{f}", f) for f in fields}).drop(*(f"_{i}_{f}" for f in fields))
    return out


def identity_votes(votes: DataFrame, row: str, profile: str) -> DataFrame:
    """A row is bound to the one profile that says same in both directions; several are a conflict."""
    both = votes.groupBy(row, profile).agg(F.bool_and(F.col("verdict") == "same").alias("same"), F.count_distinct("direction").alias("n"))
    good = both.groupBy(row).agg(F.count_if(F.col("same") & (F.col("n") == 2)).alias("hits"), F.min(F.when(F.col("same") & (F.col("n") == 2), F.col(profile))).alias("bound"))
    state = F.when(F.col("hits") == 1, "verified").when(F.col("hits") > 1, "conflict").otherwise("uncertain")
    return good.select(row, state.alias("state"), F.when(F.col("hits") == 1, F.col("bound")).alias("bound"))


def runnable(tasks: DataFrame, needs: DataFrame, status: DataFrame) -> DataFrame:
    """Tasks none of whose preconditions is unmet."""
    unmet = needs.join(status, "need", "left").where("state IS NULL OR state <> 'ready'").select("task").distinct()
    return tasks.join(unmet, "task", "left_anti")


def next_units(units: DataFrame, group: str) -> DataFrame:
    """The lowest unfinished unit of each group."""
    return units.where("NOT done").groupBy(group).agg(F.min("unit").alias("unit"))
