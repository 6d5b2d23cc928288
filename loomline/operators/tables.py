"""Durable intermediate tables, ordered numbering, and running values over keys of any size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

HOT = 1_000_000  # rows of one key from which a running value is split over tiles


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``; only a local session may do without and gets a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="loomline-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table, whose lineage is the file."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tiled(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` cut into ranges of ``order`` and sorted in each: adds ``tile``, the range, and ``tile_row``, the place in it."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("tile", F.spark_partition_id())
    return durable(ranged.withColumn("tile_row", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), name)


def numbered(df: DataFrame, order: list[Column], out: str = "pos") -> DataFrame:
    """Add each row's place from 0 in ``order``: ranges sorted apart, and one offset a range; no task sees all rows."""
    tiles = tiled(df, order, "ordered")
    before = Window.orderBy("tile").rowsBetween(Window.unboundedPreceding, -1)
    counts = tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("_n")).select("tile", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return tiles.join(F.broadcast(counts), "tile").withColumn(out, F.col("_start") + F.col("tile_row")).drop("tile", "tile_row", "_start")


def largest_key(df: DataFrame, keys: list[str]) -> int:
    """Rows of the key that has most."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]], hot: int | None = None, most: int | None = None) -> DataFrame:
    """Add running values over the earlier rows of each key in ``order``, or over this and the later ones.

    ``values``: name -> (kind, value), kind one of ``max`` and ``sum`` (rows before this one), ``upto`` (the maximum up to this
    one) and ``after`` (the minimum from this one on). If no key has more than ``hot`` rows, each key is one window (``most`` is that number, if the caller knows it). Else rows are cut into ranges of
    (keys, order), so that a hot key is many windows, and what a range hands to the next is one row for each key that
    goes on in it: at most one a range, so it is broadcast.
    """
    if hot is None:
        hot = HOT
    most = largest_key(df, keys) if most is None else most
    use = {"max": F.max, "sum": F.sum, "upto": F.max, "after": F.min}
    rows = {"max": (Window.unboundedPreceding, -1), "sum": (Window.unboundedPreceding, -1), "upto": (Window.unboundedPreceding, 0), "after": (0, Window.unboundedFollowing)}
    if most <= hot:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({name: use[kind](value).over(w.rowsBetween(*rows[kind])) for name, (kind, value) in values.items()})
    tiles = tiled(df, [F.col(c) for c in (*keys, *order)], "running")
    over_tiles, inside = Window.partitionBy(*keys).orderBy("tile"), Window.partitionBy("tile", *keys).orderBy("tile_row")
    part = tiles.groupBy("tile", *keys).agg(*(use[kind](value).alias(name) for name, (kind, value) in values.items()))
    ahead = {n: (1, Window.unboundedFollowing) if k == "after" else (Window.unboundedPreceding, -1) for n, (k, _) in values.items()}
    handed = part.select("tile", *keys, F.count(F.lit(1)).over(Window.partitionBy(*keys)).alias("_tiles"), *(use[k](n).over(over_tiles.rowsBetween(*ahead[n])).alias(f"_{n}") for n, (k, _) in values.items()))
    handed = handed.where("_tiles > 1").drop("_tiles").withColumns({f"_k{i}": F.col(k) for i, k in enumerate(keys)}).withColumnRenamed("tile", "_tile").drop(*keys)
    same = [tiles["tile"] == handed["_tile"], *(tiles[k].eqNullSafe(handed[f"_k{i}"]) for i, k in enumerate(keys))]
    joined = tiles.join(F.broadcast(handed), same, "left")
    join = {"max": F.greatest, "upto": F.greatest, "after": F.least, "sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}
    out = joined.withColumns({name: join[kind](use[kind](value).over(inside.rowsBetween(*rows[kind])), F.col(f"_{name}")) for name, (kind, value) in values.items()})
    return out.select(*df.columns, *values)
