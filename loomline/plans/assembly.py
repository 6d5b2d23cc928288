"""Segments, selections, registries and checks over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import registry as rg
from loomline.operators import segments as sg
from loomline.operators import selection as sl
from loomline.sources.driver_tables import EVENT_INTERVALS_SQL, event_intervals, table

MINUTE = 60_000_000
HOUR = 60 * MINUTE
MONTH = 720 * HOUR
_IVL = f"WITH {EVENT_INTERVALS_SQL}"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's month cut at the starts of purchases."""
    ivl = event_intervals(spark, sf_dir)
    spans = ivl.select("key").distinct().select("key", F.lit(0).cast("long").alias("lo"), F.lit(MONTH).cast("long").alias("hi"))
    return sg.boundaries_to_segments(ivl.where("kind = 'purchase'").select("key", F.col("s").alias("t")), spans, ["key"])


SEGMENTS_SQL = f"""pts AS (SELECT DISTINCT key, s AS t FROM ivl WHERE kind = 'purchase' AND s > 0 AND s < {MONTH} UNION SELECT DISTINCT key, 0 FROM ivl UNION SELECT DISTINCT key, {MONTH} FROM ivl),
seg AS (SELECT key, t AS s, lead(t) OVER (PARTITION BY key ORDER BY t) AS e FROM pts QUALIFY e IS NOT NULL)"""


def boundaries_to_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between a user's purchases."""
    return _segments(spark, sf_dir)


def longest_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five longest segments of a day and more, in time order."""
    return sg.longest_in_order(_segments(spark, sf_dir), ["key"], 5, 24 * HOUR)


def merge_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments under twelve hours joined to the one before."""
    return sg.merge_short(_segments(spark, sf_dir), ["key"], 12 * HOUR)


def classify_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short flanked segments are transitions."""
    return sg.classify_segments(_segments(spark, sf_dir), ["key"], 6 * HOUR)


def coverage_penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uncovered time before, between and after each user's events."""
    ivl = event_intervals(spark, sf_dir)
    spans = ivl.select("key").distinct().withColumn("hi", F.lit(MONTH).cast("long"))
    return sg.coverage_penalty(ivl, spans, ["key"]).select("key", F.col("penalty").cast("long").alias("penalty"))


def frame_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames for each part's size as a need of 24 a unit."""
    return table(spark, sf_dir, "part").select("p_partkey", sg.frames_needed(F.col("p_size") * 24).alias("frames"))


def render_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups with pre-roll and post-roll, trimmed to an hour."""
    lo, hi = sg.render_window(F.col("s"), F.col("e"), HOUR, 10 * MINUTE, 5 * MINUTE)
    return event_intervals(spark, sf_dir).where("kind = 'signup'").select("id", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))


def adaptive_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window each event would be retried with (I16)."""
    return table(spark, sf_dir, "events").select("event_id", sg.split_sizes(F.col("value")).cast("long").alias("retry"))


def running_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order laid end to end by quantity."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("long").alias("q"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("o"))
    return sg.running_offsets(lines, ["l_orderkey"], "o", F.col("q")).groupBy("l_orderkey").agg(F.max("target_e").alias("length"), F.sum("target_s").alias("starts"))


def order_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that break a rule of their table."""
    rules = {
        "quantity": (F.col("l_quantity") < 2) | (F.col("l_quantity") > 49),
        "discount": F.col("l_discount") >= 0.1,
        "flag": ~F.col("l_returnflag").isin("A", "N", "R"),
        "tax": F.col("l_tax") > 0.079,
    }
    return sg.violations(table(spark, sf_dir, "lineitem"), rules, ["l_orderkey", "l_linenumber"]).groupBy("violations").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


def timeline_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and overlaps between a user's consecutive events."""
    ivl = event_intervals(spark, sf_dir).withColumn("ordinal", F.col("s"))
    return sg.timeline_checks(ivl, ["key"]).groupBy("key").agg(F.count_if("gap").alias("gaps"), F.count_if("overlap").alias("overlaps"), F.count_if("backwards").alias("backwards"))


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven evenly spaced events of each user."""
    return sg.systematic(event_intervals(spark, sf_dir), ["key"], ["s", "id"], 7).select("id")


def presence_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of large values after small ones, by user."""
    rows = event_intervals(spark, sf_dir).select("key", "id", (F.col("e") - F.col("s") >= 20 * MINUTE).alias("present"))
    return sg.presence_switches(rows, ["key"], "id", "present")


def stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with the same event type three times in a row."""
    return sg.stalls(event_intervals(spark, sf_dir), ["key"], "id", "kind", 3)


def quota_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long events by greedy choice: three a quarter, eight a user, overlaps up to a fifth."""
    ivl = event_intervals(spark, sf_dir)
    part = F.least(F.lit(3), F.floor(4 * F.col("s") / MONTH)).cast("long")
    return sl.quota_selection(ivl.withColumn("part", part).withColumn("score", F.col("e") - F.col("s")), ["key"], 1, 5, 3, 8).select("key", "id", "part")


def diversity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven events of each user, the longest of every kind first (W2h)."""
    return sl.diversity_cap(event_intervals(spark, sf_dir).withColumn("score", F.col("e") - F.col("s")), ["key"], "kind", 7).select("id", "place")


def shortest_per_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest event of each user and kind (K8)."""
    return sl.shortest_per_phase(event_intervals(spark, sf_dir), ["key"], "kind").select("id")


def audition_shortlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six freshest events of each kind but errors, twelve of those (K3)."""
    rows = event_intervals(spark, sf_dir).withColumn("category", F.when(F.col("kind") != "error", F.col("kind")))
    return sl.shortlist(rows, "category", [F.desc("s"), F.asc("id")], 6, 12).select("id", "place")


def plan_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as plans: eligible with a positive balance, weighted by balance and number."""
    plans = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), (F.col("s_acctbal") > 0).alias("eligible"), F.floor(F.col("s_acctbal") / 100).alias("a"), (F.col("s_suppkey") % 7).alias("b"),
        F.col("s_nationkey").alias("duration"), F.lit(1).alias("parts"),
    )
    return sl.plan_ranking(plans, {"a": 0.5, "b": 0.25}).select("id", "place")


def missing_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types that a user lacks for a full set."""
    have = table(spark, sf_dir, "events").where("value > 100").groupBy("user_id").agg(F.collect_set("event_type").alias("present"))
    need = F.array(*(F.lit(x) for x in ("click", "error", "purchase", "signup", "view")))
    return sl.missing_uses(have.withColumn("required", need), "required", "present").select("user_id", "lacking", "complete")


def pool_near_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five events nearest to each user's longest."""
    ivl = event_intervals(spark, sf_dir)
    core = ivl.groupBy("key").agg(F.max_by(F.struct("s", "e"), F.struct(F.col("e") - F.col("s"), "id")).alias("c")).select("key", F.col("c.s").alias("lo"), F.col("c.e").alias("hi"))
    return sl.pool_near_core(ivl, core, ["key"], 5).select("id", "distance", "place")


def resolve_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers resolved by nation and segment, by nation, by segment, else by name."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("source"), F.col("c_mktsegment").alias("window"), (F.col("c_custkey") % 5).alias("entity"), F.col("c_mktsegment").alias("name"), "c_custkey")
    nation = table(spark, sf_dir, "nation")
    windowed = nation.where("n_nationkey % 3 = 0").select(F.col("n_nationkey").alias("source"), F.lit("BUILDING").alias("window"), F.lit(1).cast("long").alias("entity"), F.concat(F.lit("w"), "n_nationkey").alias("canonical"))
    sources = nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("source"), F.lit(2).cast("long").alias("entity"), F.concat(F.lit("s"), "n_nationkey").alias("canonical"))
    aliases = spark.createDataFrame([("MACHINERY", "a-machinery")], "alias string, canonical string")
    return rg.resolve_entities(rows, windowed, sources, aliases).groupBy("canonical").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("keys"))


def merge_registries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations known from customers united with those from suppliers, whose names win."""
    a = table(spark, sf_dir, "customer").where("c_nationkey < 20").groupBy(F.col("c_nationkey").alias("entity")).agg(F.lit("auto").alias("name"), F.collect_set(F.col("c_custkey") % 10).alias("refs"))
    m = table(spark, sf_dir, "supplier").where("s_nationkey > 5").groupBy(F.col("s_nationkey").alias("entity")).agg(F.lit("manual").alias("name"), F.collect_set(F.col("s_suppkey") % 10).alias("refs"))
    out = rg.merge_registries(a, m)
    return out.select("entity", "name", F.concat_ws(",", F.transform("refs", lambda x: x.cast("string"))).alias("refs"))


def layered_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with quality from labels over a default of long texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 300).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))
    return rg.layered(docs, [table(spark, sf_dir, "labels")], "doc_id", ["quality", "toxic"])


def identity_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders bound to a supplier by votes of their lines in two directions."""
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4")
    votes = lines.select("l_orderkey", (F.col("l_suppkey") % 3).alias("profile"), (F.col("l_linenumber") % 2).alias("direction"), F.when(F.col("l_discount") < 0.08, "same").otherwise("different").alias("verdict"))
    return rg.identity_votes(votes, "l_orderkey", "profile").groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("bound").alias("bound"))


def runnable_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders all of whose suppliers have money."""
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task"))
    needs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_suppkey").alias("need"))
    status = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("need"), F.when(F.col("s_acctbal") > 0, "ready").otherwise("poor").alias("state"))
    return rg.runnable(tasks, needs, status)


def next_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first open order of each customer."""
    return rg.next_units(table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("unit"), (F.col("o_orderstatus") == "F").alias("done")), "o_custkey")


QUERIES = {
    f.__name__: f
    for f in (
        boundaries_to_segments, longest_in_order, merge_short, classify_segments, coverage_penalty, frame_counts, render_windows, adaptive_split, running_offsets,
        order_violations, timeline_checks, systematic_sample, presence_switches, stalls, quota_selection, diversity_cap, shortest_per_phase, audition_shortlist,
        plan_ranking, missing_uses, pool_near_core, resolve_entities, merge_registries, layered_attributes, identity_votes, runnable_tasks, next_units,
    )
}

ORACLE_SQL = {
    "boundaries_to_segments": f"{_IVL}, {SEGMENTS_SQL} SELECT key, s, e FROM seg",
    "longest_in_order": f"""{_IVL}, {SEGMENTS_SQL}, r AS (SELECT * FROM seg WHERE e - s >= {24 * HOUR} QUALIFY row_number() OVER (PARTITION BY key ORDER BY e - s DESC, s) <= 5)
SELECT key, s, e, row_number() OVER (PARTITION BY key ORDER BY s) AS shot FROM r""",
    "merge_short": f"""{_IVL}, {SEGMENTS_SQL}, g AS (SELECT *, CASE WHEN e - s >= {12 * HOUR} OR row_number() OVER (PARTITION BY key ORDER BY s) = 1 THEN 1 ELSE 0 END AS o FROM seg),
h AS (SELECT *, sum(o) OVER (PARTITION BY key ORDER BY s) AS g FROM g) SELECT key, min(s) AS s, max(e) AS e, count(*) AS n FROM h GROUP BY key, g""",
    "classify_segments": f"""{_IVL}, {SEGMENTS_SQL}, k AS (SELECT *, CASE WHEN e - s < {6 * HOUR} AND lag(e) OVER w = s AND lead(s) OVER w = e THEN 'transition' ELSE 'content' END AS kind FROM seg WINDOW w AS (PARTITION BY key ORDER BY s))
SELECT key, s, e, kind, row_number() OVER (PARTITION BY key, kind ORDER BY s) AS ordinal FROM k""",
    "coverage_penalty": f"""{_IVL}, g AS (SELECT key, e, greatest(0, s - coalesce(max(e) OVER (PARTITION BY key ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS gap FROM ivl)
SELECT key, CAST(sum(gap) + greatest(0, {MONTH} - max(e)) AS BIGINT) AS penalty FROM g GROUP BY key""",
    "frame_counts": "SELECT p_partkey, CAST(least(greatest(1, CAST(ceil((p_size * 24 - 5) / 17) AS BIGINT)) * 17 + 5, 294) AS BIGINT) AS frames FROM part",
    "render_windows": f"""{_IVL}, w AS (SELECT id, greatest(s - {10 * MINUTE}, 0) AS lo, e + {5 * MINUTE} AS hi FROM ivl WHERE kind = 'signup'), o AS (SELECT *, greatest(0, hi - lo - {HOUR}) AS over FROM w)
SELECT id, lo + over // 2 AS lo, hi - (over - over // 2) AS hi FROM o""",
    "adaptive_split": "SELECT event_id, CAST(CASE WHEN value > 20 THEN 20 WHEN value > 16 THEN 16 WHEN value > 12 THEN 12 END AS BIGINT) AS retry FROM events",
    "running_offsets": """WITH r AS (SELECT l_orderkey, CAST(l_quantity AS BIGINT) AS q, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS e FROM lineitem)
SELECT l_orderkey, CAST(max(e) AS BIGINT) AS length, CAST(sum(e - q) AS BIGINT) AS starts FROM r GROUP BY 1""",
    "order_violations": """WITH v AS (SELECT l_orderkey, array_to_string(list_filter([CASE WHEN l_quantity < 2 OR l_quantity > 49 THEN 'quantity' END, CASE WHEN l_discount >= 0.1::DOUBLE THEN 'discount' END,
CASE WHEN l_returnflag NOT IN ('A', 'N', 'R') THEN 'flag' END, CASE WHEN l_tax > 0.079::DOUBLE THEN 'tax' END], lambda x: x IS NOT NULL), ',') AS violations FROM lineitem)
SELECT violations, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS keys FROM v WHERE violations <> '' GROUP BY 1""",
    "timeline_checks": f"""{_IVL}, p AS (SELECT key, s, lag(e) OVER w AS b, lag(s) OVER w AS t FROM ivl WINDOW w AS (PARTITION BY key ORDER BY s))
SELECT key, count(*) FILTER (s > b) AS gaps, count(*) FILTER (s < b) AS overlaps, count(*) FILTER (s < t) AS backwards FROM p GROUP BY key""",
    "systematic_sample": f"""{_IVL}, p AS (SELECT id, key, row_number() OVER (PARTITION BY key ORDER BY s, id) - 1 AS i, count(*) OVER (PARTITION BY key) AS n FROM ivl)
SELECT id FROM p WHERE n <= 7 OR list_contains(list_transform(range(0, 7), lambda k: k * n // 7), i)""",
    "presence_switches": f"""{_IVL}, p AS (SELECT key, id, e - s >= {20 * MINUTE} AS present FROM ivl), b AS (SELECT *, lag(present) OVER (PARTITION BY key ORDER BY id) AS before,
bool_or(present) OVER (PARTITION BY key ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM p)
SELECT key, count(*) FILTER (present AND before = false AND seen) AS returns, count(*) FILTER (NOT present) AS absent FROM b GROUP BY key""",
    "stalls": f"""{_IVL}, p AS (SELECT key, id, kind = lag(kind) OVER w AND kind = lag(kind, 2) OVER w AS same FROM ivl WINDOW w AS (PARTITION BY key ORDER BY id))
SELECT key, min(id) AS stalled_at FROM p WHERE same GROUP BY key""",
    "quota_selection": f"""{_IVL}, l AS (SELECT key, list({{'s': s, 'e': e, 'id': id, 'part': least(3, 4 * s // {MONTH})}} ORDER BY e - s DESC, s, id) AS l FROM ivl GROUP BY key),
f AS (SELECT key, list_reduce(l, lambda acc, x: CASE WHEN len(acc) >= 8 OR len(list_filter(acc, lambda y: y.part = x.part)) >= 3
 OR len(list_filter(acc, lambda y: (least(x.e, y.e) - greatest(x.s, y.s)) * 5 > least(x.e - x.s, y.e - y.s))) > 0 THEN acc ELSE list_append(acc, x) END, []::STRUCT(s BIGINT, e BIGINT, id BIGINT, part BIGINT)[]) AS k FROM l),
u AS (SELECT key, unnest(k) AS k FROM f) SELECT key, k.id AS id, k.part AS part FROM u""",
    "diversity_cap": f"""{_IVL}, f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY key, kind ORDER BY e - s DESC, id) > 1 THEN 1 ELSE 0 END AS f FROM ivl)
SELECT id, row_number() OVER (PARTITION BY key ORDER BY f, e - s DESC, id) AS place FROM f QUALIFY place <= 7""",
    "shortest_per_phase": f"{_IVL} SELECT id FROM ivl QUALIFY row_number() OVER (PARTITION BY key, kind ORDER BY e - s, s, id) = 1",
    "audition_shortlist": f"""{_IVL}, p AS (SELECT id, kind, row_number() OVER (PARTITION BY CASE WHEN kind <> 'error' THEN kind END ORDER BY s DESC, id) AS place FROM ivl)
SELECT id, place FROM p WHERE place <= CASE WHEN kind = 'error' THEN 12 ELSE 6 END""",
    "plan_ranking": """SELECT s_suppkey AS id, row_number() OVER (ORDER BY (s_acctbal > 0) DESC, floor(s_acctbal / 100) * 0.5::DOUBLE + (s_suppkey % 7) * 0.25::DOUBLE DESC, s_nationkey, s_suppkey) AS place FROM supplier""",
    "missing_uses": """WITH h AS (SELECT user_id, list(DISTINCT event_type) AS p FROM events WHERE value > 100 GROUP BY 1),
m AS (SELECT user_id, list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda x: NOT list_contains(p, x)) AS l FROM h) SELECT user_id, array_to_string(l, ',') AS lacking, len(l) = 0 AS complete FROM m""",
    "pool_near_core": f"""{_IVL}, c AS (SELECT key, s AS lo, e AS hi FROM ivl QUALIFY row_number() OVER (PARTITION BY key ORDER BY e - s DESC, id DESC) = 1),
d AS (SELECT ivl.*, greatest(0, lo - e, s - hi) AS distance FROM ivl JOIN c USING (key))
SELECT id, distance, row_number() OVER (PARTITION BY key ORDER BY distance, s, id) AS place FROM d QUALIFY place <= 5""",
    "resolve_entities": """SELECT CASE WHEN c_nationkey % 3 = 0 AND c_mktsegment = 'BUILDING' AND c_custkey % 5 = 1 THEN 'w' || c_nationkey WHEN c_nationkey % 2 = 0 AND c_custkey % 5 = 2 THEN 's' || c_nationkey
WHEN c_mktsegment = 'MACHINERY' THEN 'a-machinery' ELSE 'name:' || c_mktsegment END AS canonical, count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS keys FROM customer GROUP BY 1""",
    "merge_registries": """WITH a AS (SELECT DISTINCT c_nationkey AS entity, c_custkey % 10 AS r, 'auto' AS name FROM customer WHERE c_nationkey < 20 UNION SELECT DISTINCT s_nationkey, s_suppkey % 10, 'manual' FROM supplier WHERE s_nationkey > 5)
SELECT entity, CASE WHEN bool_or(name = 'manual') THEN 'manual' ELSE 'auto' END AS name, array_to_string(list_sort(list(DISTINCT r)), ',') AS refs FROM a GROUP BY entity""",
    "layered_attributes": "SELECT doc_id, coalesce(l.quality, CASE WHEN n_chars > 300 THEN 1 ELSE 0 END) AS quality, l.toxic FROM documents LEFT JOIN labels l USING (doc_id)",
    "identity_votes": """WITH v AS (SELECT l_orderkey, l_suppkey % 3 AS p, bool_and(l_discount < 0.08::DOUBLE) AS same, count(DISTINCT l_linenumber % 2) AS n FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1, 2),
g AS (SELECT l_orderkey, count(*) FILTER (same AND n = 2) AS hits, min(p) FILTER (same AND n = 2) AS bound FROM v GROUP BY 1)
SELECT CASE WHEN hits = 1 THEN 'verified' WHEN hits > 1 THEN 'conflict' ELSE 'uncertain' END AS state, count(*) AS n, CAST(sum(CASE WHEN hits = 1 THEN bound END) AS BIGINT) AS bound FROM g GROUP BY 1""",
    "runnable_tasks": "SELECT o_orderkey AS task FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = o_orderkey AND (s_acctbal IS NULL OR NOT s_acctbal > 0))",
    "next_units": "SELECT o_custkey, min(o_orderkey) AS unit FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1",
}
