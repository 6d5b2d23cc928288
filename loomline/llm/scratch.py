"""Durable intermediate tables and distributed running totals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; only a local session may do without and gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table.

    Cuts the lineage without depending on any executor's disk.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


CELLS = 1 << 22  # of a table that tells which keys may be there: 65,536 rows of 64 cells at most, whatever the input


def may_match(df: DataFrame, key: Column, keys: DataFrame, name: str) -> DataFrame:
    """Add ``may_match`` to ``df``: false where ``key`` is surely not in the column ``name`` of ``keys``, so that such rows need no join and no shuffle.

    Keys fall into ``CELLS`` cells by hash, 64 to a row, and the rows are broadcast: their number is bounded. A cell may hold other keys too, so what may match goes on to an exact join.
    """
    cell, bit = lambda c: F.pmod(F.xxhash64(c), F.lit(CELLS)), F.expr("cast(_cell & 63 as int)")
    full = keys.select(cell(F.col(name).cast("long")).alias("_cell")).groupBy(F.shiftright("_cell", 6).alias("_word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_bits"))
    here = df.withColumn("_cell", cell(key.cast("long"))).withColumn("_word", F.shiftright("_cell", 6)).join(F.broadcast(full), "_word", "left")
    there = F.call_function("shiftrightunsigned", F.col("_bits"), bit).bitwiseAND(F.lit(1)) == 1
    return here.withColumn("may_match", F.coalesce(there, F.lit(False))).drop("_cell", "_word", "_bits")


def in_order(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Range-partition a narrow table by ``order`` and add ``pos``, each row's index in that order.

    The order is cut into partitions by value ranges, so equal leading keys may span many
    partitions; per-partition counts (one row per partition) give each partition its offset.
    Also keeps ``tile`` (the partition) and ``tile_row`` (the index inside it).
    """
    tiles = durable(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("tile", F.spark_partition_id())
        .withColumn("tile_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))),
        name,
    )
    counts = tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("tile", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("tile_start"))
    return tiles.join(F.broadcast(offsets), "tile").withColumn("pos", F.col("tile_start") + F.col("tile_row")).drop("tile_start")


def running_total(tiles: DataFrame, value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows before this one in the order of ``in_order``."""
    sums = tiles.groupBy("tile").agg(F.sum(value).alias("n"))
    before = Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("tile", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("tile_start"))
    inside = Window.partitionBy("tile").orderBy("tile_row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        tiles.withColumn("tile_sum", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), "tile")
        .withColumn(out, F.col("tile_start") + F.col("tile_sum"))
        .drop("tile_start", "tile_sum")
    )
