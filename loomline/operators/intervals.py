"""Interval algebra on (key, s, e) rows: predicates, bucketed joins, unions, gaps, windows.

Times are integers. Joins on overlap cut both sides into buckets and meet only in the bucket where
the later of the two starts, so each pair is found once without a cross join. Intervals longer than ``LONG``
buckets go by a second, coarser set of buckets, so none explodes without bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.operators.tables import largest_key, running

LONG = 64


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the common part, 0 if none."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2))


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """The two share more than a point."""
    return (F.least(e1, e2)) > F.greatest(s1, s2)


def contains(s1: Column, e1: Column, s2: Column, e2: Column, tolerance: int = 0) -> Column:
    """The first holds the second, within a tolerance at both ends."""
    return (s2 >= s1 - tolerance) & (e2 <= e1 + tolerance)


def hull_iou(s1: Column, e1: Column, s2: Column, e2: Column, tolerance: int = 0) -> Column:
    """Common part over hull; two points agree (1) if within the tolerance."""
    hull = F.greatest(e1, e2) - F.least(s1, s2)
    points = (s1 == e1) & (s2 == e2)
    near = (F.abs(s1 - s2) <= tolerance).cast("double")
    return F.when(points, near).when(hull > 0, overlap(s1, e1, s2, e2) / hull).otherwise(F.lit(0.0))


def overlap_share(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common part over the shorter length; 0 if that is not positive."""
    shorter = F.least(e1 - s1, e2 - s2)
    return F.when(shorter > 0, overlap(s1, e1, s2, e2) / shorter).otherwise(F.lit(0.0))


def is_hit(ps: Column, pe: Column, ts: Column, te: Column, share: float = 0.3) -> Column:
    """The prediction's centre lies inside the truth, or their hull IoU exceeds ``share``."""
    return ((ps + pe >= 2 * ts) & (ps + pe <= 2 * te)) | (hull_iou(ps, pe, ts, te) > share)


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], width: int, how: str = "inner") -> DataFrame:
    """Pairs of one key that overlap; ``left`` has s, e and ``right`` has s2, e2 (other names must differ).

    ``width``: about the 90th percentile of the lengths. Four passes, fine and coarse on each side,
    meet on (keys, bucket size, bucket); a pair counts only in the bucket of the later start.
    """

    def place(df: DataFrame, s: str, e: str, own: str) -> DataFrame:
        last = F.greatest(F.col(e) - 1, F.col(s))
        fine = F.sequence(F.floor(F.col(s) / width), F.floor(last / width))
        coarse_width = width * LONG
        coarse = F.sequence(F.floor(F.col(s) / coarse_width), F.floor(last / coarse_width))
        long = (F.floor(last / width) - F.floor(F.col(s) / width)) > LONG
        as_fine = F.transform(fine, lambda b: F.struct(F.lit(0).alias("level"), b.alias("bucket")))
        as_coarse = F.transform(coarse, lambda b: F.struct(F.lit(1).alias("level"), b.alias("bucket")))
        places = F.when(long, as_coarse).otherwise(F.concat(as_fine, as_coarse))
        return df.withColumn(f"{own}_long", long).withColumn(own, F.explode(places)).withColumn("_level", F.col(f"{own}.level")).withColumn("_bucket", F.col(f"{own}.bucket")).drop(own)

    a, b = place(left, "s", "e", "_a"), place(right, "s2", "e2", "_b")
    met = a.join(b, [*keys, "_level", "_bucket"])
    size = F.when(F.col("_level") == 0, F.lit(width)).otherwise(F.lit(width * LONG))
    either_long = F.col("_a_long") | F.col("_b_long")
    once = (F.col("_bucket") == F.floor(F.greatest("s", "s2") / size)) & (F.col("_level") == either_long.cast("int"))
    pairs = met.where(overlaps(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")) & once).drop("_level", "_bucket", "_a_long", "_b_long")
    if how == "inner":
        return pairs
    missing = left.join(pairs.select(*left.columns).distinct(), left.columns, "left_anti")
    return pairs.unionByName(missing, allowMissingColumns=True)


def islands(df: DataFrame, keys: list[str], gap: int = 0, strict: bool = False, out: str = "island") -> DataFrame:
    """Number the runs of each key whose starts lie within ``gap`` of the furthest end so far (strictly within, if asked)."""
    order = ["s", "e", "id"]
    reach = F.col("_reach") + gap
    apart = (F.col("s") >= reach) if strict else (F.col("s") > reach)
    most = largest_key(df, keys)
    marked = running(df, keys, order, {"_reach": ("max", F.col("e"))}, most=most).withColumn("_new", F.coalesce(apart, F.lit(True)).cast("long"))
    summed = running(marked, keys, order, {"_before": ("sum", F.col("_new"))}, most=most)
    return summed.withColumn(out, F.coalesce("_before", F.lit(0)) + F.col("_new")).drop("_reach", "_new", "_before")


def merge_within(df: DataFrame, keys: list[str], gap: int = 0) -> DataFrame:
    """The union of each key's intervals, merged across gaps of ``gap`` or less, with the number merged."""
    runs = islands(df, keys, gap)
    return runs.groupBy(*keys, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))


def clip(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """The parts of the intervals inside [lo, hi]; empty parts are dropped."""
    out = df.withColumn("s", F.greatest(F.col("s"), F.lit(lo))).withColumn("e", F.least(F.col("e"), F.lit(hi)))
    return out.where("e > s")


def gaps(union: DataFrame, keys: list[str], lo: int, hi: int) -> DataFrame:
    """What a union of disjoint intervals leaves uncovered of [lo, hi]."""
    edges = running(union.select(*keys, "s", "e"), keys, ["s"], {"before": ("max", F.col("e"))})
    inner = edges.select(*keys, F.coalesce("before", F.lit(lo).cast("long")).alias("s"), F.col("s").alias("e"))
    tail = union.groupBy(*keys).agg(F.max("e").alias("s")).withColumn("e", F.lit(hi).cast("long"))
    return inner.unionByName(tail).where("e > s")


def tumbling_blocks(spans: DataFrame, width: int) -> DataFrame:
    """Contiguous blocks of ``width`` over each row's [lo, hi], the last one clipped."""
    starts = F.explode(F.sequence(F.col("lo"), F.col("hi") - 1, F.lit(width).cast("long")))
    out = spans.where("hi > lo").withColumn("s", starts)
    return out.withColumn("e", F.least(F.col("s") + width, F.col("hi")))


def overlapping_windows(spans: DataFrame, width: int, shared: int, tail: str = "clip") -> DataFrame:
    """Windows of ``width`` that share ``shared`` with the next, until one reaches the end.

    ``tail``: ``clip`` cuts the last window at the end, ``shift`` moves it left to full width.
    """
    step = width - shared
    count = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo") - shared) / step).cast("long"))
    out = spans.where("hi > lo").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)))
    start = F.col("lo") + F.col("i") * step
    if tail == "shift":
        start = F.greatest(F.col("lo"), F.least(start, F.col("hi") - width))
    return out.withColumn("s", start).withColumn("e", F.least(F.col("s") + width, F.col("hi")))


def neighbour_rings(df: DataFrame, width: int, rings: int, hi: int) -> DataFrame:
    """Ranges of ``width`` beside each interval, ``rings`` on each side, clipped to [0, hi]; empty ones are dropped."""
    shape = F.array(*(F.struct(F.lit(side).alias("side"), F.lit(r).cast("long").alias("ring")) for r in range(1, rings + 1) for side in ("left", "right")))
    out = df.withColumn("r", F.explode(shape)).select("*", "r.side", "r.ring").drop("r")
    left = F.col("side") == "left"
    start = F.when(left, F.col("s") - F.col("ring") * width).otherwise(F.col("e") + (F.col("ring") - 1) * width)
    out = out.withColumn("ring_s", F.greatest(start, F.lit(0))).withColumn("ring_e", F.least(start + width, F.lit(hi)))
    return out.where("ring_e > ring_s")


def snap_outward(df: DataFrame, shots: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Each interval grown to the hull of the shots (s2, e2) it overlaps; unchanged without any."""
    hull = overlap_join(df, shots, keys, width).groupBy(*keys, "id").agg(F.min("s2").alias("lo"), F.max("e2").alias("hi"))
    joined = df.join(hull, [*keys, "id"], "left")
    return joined.withColumn("s", F.least("s", F.coalesce("lo", "s"))).withColumn("e", F.greatest("e", F.coalesce("hi", "e"))).drop("lo", "hi")


def best_overlap(df: DataFrame, other: DataFrame, keys: list[str], width: int, least: float = 0.5) -> DataFrame:
    """For each interval the other one with the largest share of its own length (at least ``least``); the first by (s2, id2) on ties."""
    pairs = overlap_join(df, other, keys, width).withColumn("share", overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")) / (F.col("e") - F.col("s")))
    best = pairs.where(F.col("share") >= least).groupBy(*keys, "id").agg(F.min(F.struct((-F.col("share")).alias("k"), "s2", "id2")).alias("b"))
    return best.select(*keys, "id", F.col("b.id2").alias("id2"), (-F.col("b.k")).alias("share"))


def nearest(points: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """For each point (id, t) the frame (t2) nearest in time, the earlier one on ties.

    One sort by (key, time) of both sides together: the last frame before and the first after each point.
    """
    sides = points.select(*keys, "id", "t", F.lit(None).cast("long").alias("t2")).unionByName(
        frames.select(*keys, F.lit(None).cast("long").alias("id"), F.col("t2").alias("t"), "t2")
    )
    sides = sides.withColumn("_side", F.col("t2").isNull().cast("int"))
    both = running(sides, keys, ["t", "_side"], {"_b": ("upto", F.col("t2")), "_a": ("after", F.col("t2"))}).where("id is not null")
    pick = F.when(F.col("_a").isNull() | (F.col("t") - F.col("_b") <= F.col("_a") - F.col("t")), F.coalesce("_b", "_a")).otherwise(F.col("_a"))
    return both.select(*keys, "id", "t", pick.alias("nearest"))


def near_any(points: DataFrame, anchors: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """The points (id, t) with an anchor (t2) of the same key within ``tolerance``: the nearest one decides."""
    return nearest(points, anchors, keys).where(F.abs(F.col("t") - F.col("nearest")) <= tolerance)
