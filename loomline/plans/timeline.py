"""Interval algebra on the event timeline of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import folds, intervals as iv
from loomline.sources.driver_tables import EVENT_INTERVALS_SQL, event_intervals

MINUTE = 60_000_000
MONTH = 30 * 24 * 60 * MINUTE
WIDTH = 120 * MINUTE  # bucket of overlap joins, about the 90th percentile of the lengths


def _side(df: DataFrame, kind: str | None = None) -> DataFrame:
    part = df if kind is None else df.where(F.col("kind") == kind)
    return part.select("key", F.col("id").alias("id2"), F.col("s").alias("s2"), F.col("e").alias("e2"))


def interval_union_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered time and number of islands of each user inside the month."""
    union = iv.merge_within(iv.clip(event_intervals(spark, sf_dir), 0, MONTH), ["key"])
    return union.groupBy("key").agg(F.sum(F.col("e") - F.col("s")).alias("covered"), F.count(F.lit(1)).alias("islands"))


def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncovered stretches of each user's month."""
    return iv.gaps(iv.merge_within(iv.clip(event_intervals(spark, sf_dir), 0, MONTH), ["key"]), ["key"], 0, MONTH)


def merge_within_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals merged across gaps of an hour or less (I8)."""
    return iv.merge_within(event_intervals(spark, sf_dir), ["key"], 60 * MINUTE).drop("island")


def merge_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted merge across gaps under an hour while the group stays within four hours."""
    return folds.capped_merge(event_intervals(spark, sf_dir), ["key"], 60 * MINUTE, 240 * MINUTE)


def neighbour_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two twenty-minute ranges on each side of every purchase."""
    bought = event_intervals(spark, sf_dir).where("kind = 'purchase'")
    return iv.neighbour_rings(bought, 20 * MINUTE, 2, MONTH).select("id", "side", F.col("ring").cast("long").alias("ring"), "ring_s", "ring_e")


def fixed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by blocks of 45 hours between first and last event."""
    ivl = event_intervals(spark, sf_dir)
    spans = ivl.groupBy("key").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    return iv.tumbling_blocks(spans, 45 * 60 * MINUTE).select("key", "s", "e")


def transport_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 60 minutes sharing 5 over the signups of an hour and more, last one clipped."""
    long = event_intervals(spark, sf_dir).where(f"kind = 'signup' AND e - s >= {60 * MINUTE}")
    return iv.overlapping_windows(long.select("id", F.col("s").alias("lo"), F.col("e").alias("hi")), 60 * MINUTE, 5 * MINUTE).select("id", "i", "s", "e")


def tail_aligned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the last window moved left to full width."""
    long = event_intervals(spark, sf_dir).where(f"kind = 'signup' AND e - s >= {60 * MINUTE}")
    return iv.overlapping_windows(long.select("id", F.col("s").alias("lo"), F.col("e").alias("hi")), 60 * MINUTE, 5 * MINUTE, "shift").select("id", "i", "s", "e")


def overlap_join_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views with the purchases of the same user they overlap, clipped."""
    ivl = event_intervals(spark, sf_dir)
    pairs = iv.overlap_join(ivl.where("kind = 'view'"), _side(ivl, "purchase"), ["key"], WIDTH)
    partial = (F.col("s2") < F.col("s")) | (F.col("e2") > F.col("e"))
    return pairs.select("key", "id", "id2", F.greatest("s", "s2").alias("clip_s"), F.least("e", "e2").alias("clip_e"), partial.alias("partial"))


def best_overlap_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each click the view that covers most of it, at least half."""
    ivl = event_intervals(spark, sf_dir).where("e > s")
    return iv.best_overlap(ivl.where("kind = 'click'"), _side(ivl, "view"), ["key"], WIDTH).select("id", "id2")


def bidirectional_coverage_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and errors where the overlap is half of the view or four fifths of the error."""
    ivl = event_intervals(spark, sf_dir).where("e > s")
    pairs = iv.overlap_join(ivl.where("kind = 'view'"), _side(ivl, "error"), ["key"], WIDTH)
    common = iv.overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))
    keep = (common * 2 >= F.col("e") - F.col("s")) | (common * 5 >= (F.col("e2") - F.col("s2")) * 4)
    return pairs.where(keep).select("id", "id2", common.alias("common"))


def nearest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error the start of the nearest view of the user."""
    ivl = event_intervals(spark, sf_dir)
    points = ivl.where("kind = 'error'").select("key", "id", F.col("s").alias("t"))
    return iv.nearest(points, ivl.where("kind = 'view'").select("key", F.col("s").alias("t2")), ["key"]).select("id", "nearest")


def tolerance_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors with a view of the user starting within an hour."""
    ivl = event_intervals(spark, sf_dir)
    points = ivl.where("kind = 'error'").select("key", "id", F.col("s").alias("t"))
    return iv.near_any(points, ivl.where("kind = 'view'").select("key", F.col("s").alias("t2")), ["key"], 60 * MINUTE).select("id")


def interval_hit_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user, views (truth) hit by a click (prediction): centre inside or hull IoU above .3."""
    ivl = event_intervals(spark, sf_dir)
    truth = ivl.where("kind = 'view'")
    pairs = iv.overlap_join(truth, _side(ivl, "click"), ["key"], WIDTH)
    hits = pairs.where(iv.is_hit(F.col("s2"), F.col("e2"), F.col("s"), F.col("e"))).select("id").distinct()
    marked = truth.join(hits.withColumn("hit", F.lit(1)), "id", "left")
    return marked.groupBy("key").agg(F.count(F.lit(1)).alias("truths"), F.count("hit").alias("hits"))


def snap_outward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases grown to the hull of the views they overlap."""
    ivl = event_intervals(spark, sf_dir)
    return iv.snap_outward(ivl.where("kind = 'purchase'"), _side(ivl, "view"), ["key"], WIDTH).select("id", "s", "e")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ivl = event_intervals(spark, sf_dir)
    return iv.overlap_join(ivl, _side(ivl), ["key"], WIDTH).where("id < id2")


def hull_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs of a user with their overlap over hull (I4)."""
    return _pairs(spark, sf_dir).select("id", "id2", iv.hull_iou(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")).alias("iou"))


def overlap_shorter_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping pairs of a user with their overlap over the shorter length."""
    return _pairs(spark, sf_dir).select("id", "id2", iv.overlap_share(F.col("s"), F.col("e"), F.col("s2"), F.col("e2")).alias("share"))


def min_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user at least six hours after the last kept one."""
    points = event_intervals(spark, sf_dir).select("key", "id", F.col("s").alias("t"))
    return folds.min_spacing(points, ["key"], 360 * MINUTE).select("id")


def suppress_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy suppression, longest first, of overlaps above a fifth of the shorter."""
    scored = event_intervals(spark, sf_dir).withColumn("score", (F.col("e") - F.col("s")).cast("double"))
    return folds.suppress_overlaps(scored, ["key"], 1, 5).select("id")


def refractory_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of three or more events within six hours of their first (W2g, I19)."""
    points = event_intervals(spark, sf_dir).select("key", "id", F.col("s").alias("t"))
    return folds.anchored_groups(points, ["key"], 360 * MINUTE).where("n >= 3")


def head_tail_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in the first day or the last two days of a user's timeline."""
    ivl = event_intervals(spark, sf_dir)
    ends = ivl.groupBy("key").agg(F.max("e").alias("duration"))
    zone = F.when(F.col("s") < 1440 * MINUTE, "head").when(F.col("e") > F.col("duration") - 2880 * MINUTE, "tail")
    return ivl.join(ends, "key").select("id", zone.alias("zone")).where("zone IS NOT NULL")


def zone_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarter of the month of each event's centre."""
    quarter = F.least(F.lit(3), F.greatest(F.lit(0), F.floor(4 * (F.col("s") + F.col("e")) / (2 * MONTH))))
    return event_intervals(spark, sf_dir).groupBy(quarter.cast("long").alias("quarter")).agg(F.count(F.lit(1)).alias("n"))


def context_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors widened by 20 minutes on each side within the month, at most 40 minutes past their own length."""
    ivl = event_intervals(spark, sf_dir).where("kind = 'error'")
    return ivl.select("id", F.greatest(F.col("s") - 20 * MINUTE, F.lit(0)).alias("s"), F.least(F.col("e") + 20 * MINUTE, F.lit(MONTH)).alias("e"))


QUERIES = {
    f.__name__: f
    for f in (
        interval_union_coverage, interval_gaps, merge_within_gap, merge_capped, neighbour_rings, fixed_blocks, transport_windows, tail_aligned_windows,
        overlap_join_clip, best_overlap_match, bidirectional_coverage_join, nearest_event, tolerance_semi, interval_hit_recall, snap_outward,
        hull_iou_pairs, overlap_shorter_pairs, min_spacing, suppress_overlaps, refractory_bursts, head_tail_zones, zone_quarters, context_expand,
    )
}

_IVL = f"WITH {EVENT_INTERVALS_SQL}"


def _union_sql(gap: int, source: str) -> str:
    return f"""reach AS (SELECT *, max(e) OVER (PARTITION BY key ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} AS r FROM {source}),
runs AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY s, e, id) AS run FROM reach),
merged AS (SELECT key, min(s) AS s, max(e) AS e, count(*) AS n FROM runs GROUP BY key, run)"""


_CLIP = f"clipped AS (SELECT id, key, greatest(s, 0) AS s, least(e, {MONTH}) AS e FROM ivl WHERE least(e, {MONTH}) > greatest(s, 0))"
_OVER = "least(a.e, b.e) > greatest(a.s, b.s)"
_COMMON = "(least(a.e, b.e) - greatest(a.s, b.s))"


def _windows_sql(shift: bool) -> str:
    w, o = 60 * MINUTE, 5 * MINUTE
    start = f"lo + i * {w - o}"
    start = f"greatest(lo, least({start}, hi - {w}))" if shift else start
    return f"""{_IVL}, spans AS (SELECT id, s AS lo, e AS hi FROM ivl WHERE kind = 'signup' AND e - s >= {w}),
dealt AS (SELECT *, unnest(range(0, greatest(1, CAST(ceil((hi - lo - {o}) / {w - o}) AS BIGINT)))) AS i FROM spans)
SELECT id, i, {start} AS s, least({start} + {w}, hi) AS e FROM dealt"""


ORACLE_SQL = {
    "interval_union_coverage": f"{_IVL}, {_CLIP}, {_union_sql(0, 'clipped')} SELECT key, CAST(sum(e - s) AS BIGINT) AS covered, count(*) AS islands FROM merged GROUP BY key",
    "interval_gaps": f"""{_IVL}, {_CLIP}, {_union_sql(0, "clipped")},
around AS (SELECT key, s, e, lag(e) OVER w AS b, lead(s) OVER w AS a FROM merged WINDOW w AS (PARTITION BY key ORDER BY s)),
found AS (SELECT key, coalesce(b, 0) AS s, s AS e FROM around UNION ALL SELECT key, e, {MONTH} FROM around WHERE a IS NULL)
SELECT key, s, e FROM found WHERE e > s""",
    "merge_within_gap": f"{_IVL}, {_union_sql(60 * MINUTE, 'ivl')} SELECT key, s, e, n FROM merged",
    "merge_capped": f"""{_IVL}, lists AS (SELECT key, list({{'s': s, 'e': e, 'id': id}} ORDER BY s, e, id) AS l FROM ivl GROUP BY key),
folded AS (SELECT key, list_reduce(l, lambda acc, x: CASE
    WHEN len(acc) > 0 AND x.s < acc[-1].e + {60 * MINUTE} AND greatest(acc[-1].e, x.e) - acc[-1].s <= {240 * MINUTE}
    THEN list_concat(acc[:-2], [{{'s': acc[-1].s, 'e': greatest(acc[-1].e, x.e), 'n': acc[-1].n + 1}}])
    ELSE list_concat(acc, [{{'s': x.s, 'e': x.e, 'n': CAST(1 AS BIGINT)}}]) END, []::STRUCT(s BIGINT, e BIGINT, n BIGINT)[]) AS g FROM lists),
flat AS (SELECT key, unnest(g) AS g FROM folded) SELECT key, g.s AS s, g.e AS e, g.n AS n FROM flat""",
    "neighbour_rings": f"""{_IVL}, r AS (SELECT * FROM (VALUES ('left', 1), ('left', 2), ('right', 1), ('right', 2)) t(side, ring)),
found AS (SELECT id, side, CAST(ring AS BIGINT) AS ring,
  CASE WHEN side = 'left' THEN s - CAST(ring AS BIGINT) * {20 * MINUTE} ELSE e + CAST(ring - 1 AS BIGINT) * {20 * MINUTE} END AS a FROM ivl, r WHERE kind = 'purchase')
SELECT id, side, ring, greatest(a, 0) AS ring_s, least(a + {20 * MINUTE}, {MONTH}) AS ring_e FROM found WHERE least(a + {20 * MINUTE}, {MONTH}) > greatest(a, 0)""",
    "fixed_blocks": f"""{_IVL}, spans AS (SELECT key, min(s) AS lo, max(e) AS hi FROM ivl GROUP BY key HAVING max(e) > min(s)),
dealt AS (SELECT key, hi, unnest(range(lo, hi, {45 * 60 * MINUTE})) AS s FROM spans) SELECT key, s, least(s + {45 * 60 * MINUTE}, hi) AS e FROM dealt""",
    "transport_windows": _windows_sql(False),
    "tail_aligned_windows": _windows_sql(True),
    "overlap_join_clip": f"""{_IVL} SELECT a.key, a.id, b.id AS id2, greatest(a.s, b.s) AS clip_s, least(a.e, b.e) AS clip_e, (b.s < a.s OR b.e > a.e) AS partial
FROM ivl a JOIN ivl b ON a.key = b.key AND a.kind = 'view' AND b.kind = 'purchase' AND {_OVER}""",
    "best_overlap_match": f"""{_IVL}, p AS (SELECT a.id, b.id AS id2, {_COMMON} / (a.e - a.s) AS share, b.s AS s2
FROM ivl a JOIN ivl b ON a.key = b.key AND a.kind = 'click' AND b.kind = 'view' AND a.e > a.s AND b.e > b.s AND {_OVER})
SELECT id, id2 FROM p WHERE share >= 0.5 QUALIFY row_number() OVER (PARTITION BY id ORDER BY share DESC, s2, id2) = 1""",
    "bidirectional_coverage_join": f"""{_IVL} SELECT a.id, b.id AS id2, {_COMMON} AS common
FROM ivl a JOIN ivl b ON a.key = b.key AND a.kind = 'view' AND b.kind = 'error' AND a.e > a.s AND b.e > b.s AND {_OVER}
WHERE {_COMMON} * 2 >= a.e - a.s OR {_COMMON} * 5 >= (b.e - b.s) * 4""",
    "nearest_event": f"""{_IVL}, p AS (SELECT a.id, b.s AS nearest, row_number() OVER (PARTITION BY a.id ORDER BY abs(a.s - b.s), b.s) AS n
FROM ivl a LEFT JOIN ivl b ON a.key = b.key AND b.kind = 'view' WHERE a.kind = 'error') SELECT id, nearest FROM p WHERE n = 1""",
    "tolerance_semi": f"""{_IVL} SELECT a.id FROM ivl a WHERE a.kind = 'error'
AND EXISTS (SELECT 1 FROM ivl b WHERE b.key = a.key AND b.kind = 'view' AND abs(a.s - b.s) <= {60 * MINUTE})""",
    "interval_hit_recall": f"""{_IVL}, h AS (SELECT DISTINCT a.id FROM ivl a JOIN ivl b ON a.key = b.key AND a.kind = 'view' AND b.kind = 'click' AND {_OVER}
WHERE (b.s + b.e >= 2 * a.s AND b.s + b.e <= 2 * a.e) OR {_COMMON} / (greatest(a.e, b.e) - least(a.s, b.s)) > 0.3)
SELECT key, count(*) AS truths, count(h.id) AS hits FROM ivl LEFT JOIN h USING (id) WHERE kind = 'view' GROUP BY key""",
    "snap_outward": f"""{_IVL}, h AS (SELECT a.id, min(b.s) AS lo, max(b.e) AS hi FROM ivl a JOIN ivl b ON a.key = b.key AND a.kind = 'purchase' AND b.kind = 'view' AND {_OVER} GROUP BY a.id)
SELECT id, least(s, coalesce(lo, s)) AS s, greatest(e, coalesce(hi, e)) AS e FROM ivl LEFT JOIN h USING (id) WHERE kind = 'purchase'""",
    "hull_iou_pairs": f"{_IVL} SELECT a.id, b.id AS id2, {_COMMON} / (greatest(a.e, b.e) - least(a.s, b.s)) AS iou FROM ivl a JOIN ivl b ON a.key = b.key AND a.id < b.id AND {_OVER}",
    "overlap_shorter_pairs": f"{_IVL} SELECT a.id, b.id AS id2, {_COMMON} / least(a.e - a.s, b.e - b.s) AS share FROM ivl a JOIN ivl b ON a.key = b.key AND a.id < b.id AND {_OVER}",
    "min_spacing": f"""{_IVL}, lists AS (SELECT key, list({{'t': s, 'id': id}} ORDER BY s, id) AS l FROM ivl GROUP BY key),
folded AS (SELECT list_reduce(l, lambda acc, x: CASE WHEN len(acc) = 0 OR x.t - acc[-1].t >= {360 * MINUTE} THEN list_append(acc, x) ELSE acc END, []::STRUCT(t BIGINT, id BIGINT)[]) AS k FROM lists),
flat AS (SELECT unnest(k) AS k FROM folded) SELECT k.id AS id FROM flat""",
    "suppress_overlaps": f"""{_IVL}, lists AS (SELECT key, list({{'s': s, 'e': e, 'id': id}} ORDER BY e - s DESC, s, id) AS l FROM ivl GROUP BY key),
folded AS (SELECT list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: (least(x.e, y.e) - greatest(x.s, y.s)) * 5 > least(x.e - x.s, y.e - y.s))) > 0 THEN acc ELSE list_append(acc, x) END,
  []::STRUCT(s BIGINT, e BIGINT, id BIGINT)[]) AS k FROM lists),
flat AS (SELECT unnest(k) AS k FROM folded) SELECT k.id AS id FROM flat""",
    "refractory_bursts": f"""{_IVL}, lists AS (SELECT key, list(s ORDER BY s) AS l FROM ivl GROUP BY key),
folded AS (SELECT key, list_reduce(l, lambda acc, x: CASE WHEN len(acc) > 0 AND x - acc[-1].first <= {360 * MINUTE}
  THEN list_concat(acc[:-2], [{{'first': acc[-1].first, 'last': x, 'n': acc[-1].n + 1}}])
  ELSE list_concat(acc, [{{'first': x, 'last': x, 'n': CAST(1 AS BIGINT)}}]) END, []::STRUCT("first" BIGINT, "last" BIGINT, n BIGINT)[]) AS g FROM lists),
flat AS (SELECT key, unnest(g) AS g FROM folded) SELECT key, g.first AS first, g.last AS last, g.n AS n FROM flat WHERE g.n >= 3""",
    "head_tail_zones": f"""{_IVL}, d AS (SELECT key, max(e) AS duration FROM ivl GROUP BY key),
z AS (SELECT id, CASE WHEN s < {1440 * MINUTE} THEN 'head' WHEN e > duration - {2880 * MINUTE} THEN 'tail' END AS zone FROM ivl JOIN d USING (key))
SELECT id, zone FROM z WHERE zone IS NOT NULL""",
    "zone_quarters": f"{_IVL} SELECT CAST(least(3, greatest(0, floor(4 * (s + e) / {2 * MONTH}))) AS BIGINT) AS quarter, count(*) AS n FROM ivl GROUP BY 1",
    "context_expand": f"{_IVL} SELECT id, greatest(s - {20 * MINUTE}, 0) AS s, least(e + {20 * MINUTE}, {MONTH}) AS e FROM ivl WHERE kind = 'error'",
}
