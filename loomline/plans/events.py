"""Series, windows and evidence over the event log, orders and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators import evidence as ev
from loomline.operators import series as se
from loomline.sources.driver_tables import EVENT_INTERVALS_SQL, UTTERANCES_SQL, event_intervals, table, utterances

HOUR = 3_600_000_000
_IVL = f"WITH {EVENT_INTERVALS_SQL}"
_UTT = f"WITH {UTTERANCES_SQL}"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event values in time order, i = 0, 1, ..., in hundredths."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    cents = F.round(F.col("value") * 100).cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("key"), (F.row_number().over(order) - 1).cast("long").alias("i"), F.col("event_id").alias("id"), cents.alias("v"), "event_type"
    )


SERIES_SQL = """series AS (
  SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, event_id AS id,
         CAST(round(value * 100) AS BIGINT) AS v, event_type FROM events)"""


def sliding_window_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and total of the events of each type in windows of 45 hours every 15."""
    samples = event_intervals(spark, sf_dir).select(F.col("kind").alias("key"), F.col("s").alias("t"), ((F.col("e") - F.col("s")) / 600_000).alias("cents"))
    out = se.sliding_means(samples, ["key"], 45 * HOUR, 15 * HOUR, ["cents"])
    return out.select("key", "s", "n", F.round("cents", 6).alias("mean_cents"))


def robust_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event values between the tenth and ninetieth percentile."""
    out = se.robust_normalise(_series(spark, sf_dir), ["key"], "v", "scaled")
    return out.select("id", "scaled")


def signal_flash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that leap from the mean of the four before and come back."""
    return se.flashes(_series(spark, sf_dir), ["key"], "v", 4000.0, 800.0).select("id")


def signal_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps between neighbouring values of 60 and more."""
    order = Window.partitionBy("key").orderBy("i")
    steps = _series(spark, sf_dir).withColumn("diff", F.abs(F.col("v") - F.lag("v", 1).over(order)))
    return se.hard_cuts(steps, "diff", 6000).select("id", "diff")


def signal_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three or more values below 20 (W2f)."""
    return se.freezes(_series(spark, sf_dir), ["key"], F.col("v") < 2000).select("key", "first", "last", "n")


def signal_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where the mean of five values leaves that of the five before (W2e)."""
    return se.speed_ramps(_series(spark, sf_dir), ["key"], "v").select("id", "kind")


def action_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene score of each user's day: share of purchases, errors and clicks, weighted."""
    day = F.to_date("ts")
    out = table(spark, sf_dir, "events").groupBy("user_id", day.alias("day")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count(F.lit(1)).alias("n")
    )
    return out.select("user_id", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("long").alias("day"), (5 * F.col("purchases") - 2 * F.col("errors") + F.col("n")).alias("points"))


def dialogue_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and digits of each conversation by stretches of 500 characters, dealt by overlap."""
    utt = utterances(spark, sf_dir).where("e > s")
    alnum = F.length(F.regexp_replace("text", "[^A-Za-z0-9]", "")).cast("long")
    cut = utt.withColumn("chars", alnum).withColumn("w", F.explode(F.sequence(F.floor(F.col("s") / 500), F.floor((F.col("e") - 1) / 500))))
    common = F.least(F.col("e"), (F.col("w") + 1) * 500) - F.greatest(F.col("s"), F.col("w") * 500)
    return cut.groupBy("conv_id", "w").agg(F.sum(F.floor(F.col("chars") * common / (F.col("e") - F.col("s")))).cast("long").alias("chars"))


def text_run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of turns of one role."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("t"), F.lit(0).alias("line"), "role")
    return ev.merge_text_runs(turns, ["conv_id"], F.lower("role")).select("conv_id", F.col("text_key").alias("role"), "first_t", "last_t", "occurrences")


def event_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user, day and kind as one: hull, count, longest (A10)."""
    ivl = event_intervals(spark, sf_dir)
    rows = ivl.select("key", F.floor(F.col("s") / (24 * HOUR)).alias("day"), "kind", "s", "e", (F.col("e") - F.col("s")).alias("score"), F.col("id").alias("member"))
    out = ev.merge_events(rows, ["key", "day", "kind"])
    return out.select("key", "day", "kind", "s", "e", "score", "n", F.concat_ws(",", F.transform("members", lambda x: x.cast("string"))).alias("members"))


def temporal_predecessor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event before each one of a user, if it has ended."""
    return ev.predecessors(event_intervals(spark, sf_dir), ["key"]).select("id", "preceding")


def entity_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities of each customer in the order first seen, and number of orders."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("shot"))
    out = ev.entity_registry(rows, "entity")
    return out.select("entity", F.concat_ws("|", "names").alias("names"), F.size("shots").cast("long").alias("shots"))


def binding_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each user: days with purchases, errors as conflicts."""
    rows = table(spark, sf_dir, "events").select(
        "user_id",
        (F.col("event_type") == "purchase").alias("supported"),
        ((F.col("event_type") == "error") & (F.col("value") > 100)).alias("conflict"),
        F.to_date("ts").alias("window"),
        F.round(F.col("value") * 100).cast("long").alias("confidence"),
    )
    return ev.binding_states(rows, "user_id").select("user_id", "windows", "conflicts", "state", "n")


def occurrence_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each distinct text, from the smallest document id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    best = docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
    return best


def unique_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leads of three sources, one for each (user, hour, kind); views first, then clicks, then errors."""
    ivl = event_intervals(spark, sf_dir).where("kind IN ('view', 'click', 'error')")
    rows = ivl.select("key", F.floor(F.col("s") / HOUR).alias("hour"), "kind", "id")
    rank = F.when(F.col("kind") == "view", 0).when(F.col("kind") == "click", 1).otherwise(2)
    return ev.distinct_first(rows, ["key", "hour"], [rank.asc(), F.asc("id")])


def shard_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each customer's order priority from monthly shards; a later differing one is a conflict."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_orderkey").alias("shard"))
    return ev.shard_merge(rows, ["o_custkey", "o_orderpriority"], "o_orderstatus")


def cost_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls by event type: ok and error counts, cost of ok ones, largest value (A2)."""
    cents = F.round(F.col("value") * 100).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("tool"), F.when(F.col("value") < 50, "ok").otherwise("error").alias("status"), cents.alias("cost"), cents.alias("peak"))
    return ev.cost_report(rows)


def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by length: under 10, 20, 40, more (A4)."""
    return table(spark, sf_dir, "events").groupBy(ev.duration_bucket(F.col("value")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def running_seq_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an order's priority has come up so far for its customer."""
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.count(F.lit(1)).over(w).alias("seen"))


def section_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and quantity of each ship mode-like flag by order status, and each one's share."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))
    return lines.withColumn("permille", F.floor(F.col("n") * 1000 / F.sum("n").over(Window.partitionBy("l_returnflag"))).cast("long"))


def role_perspective_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as facts between supplier (actor) and order (patient)."""
    rows = table(spark, sf_dir, "lineitem").select("l_linenumber", F.col("l_suppkey").alias("actor"), F.col("l_orderkey").alias("patient"))
    return ev.role_views(rows).groupBy("role", "use", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("character").alias("characters"))


def arm_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last event of each type for each user, and whether all types are there."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.col("event_id").alias("seq"), F.col("event_id").alias("v"))
    return ev.arm_pairs(rows, "user_id", "event_type", ["view", "click", "purchase", "signup", "error"], "v")


def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an order."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), "c_name")
    return ev.missing(customers, table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k")


def bpm_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper median of the gaps between a user's events within two minutes and ten hours."""
    order = Window.partitionBy("key").orderBy("s", "id")
    gaps = event_intervals(spark, sf_dir).withColumn("gap", F.col("s") - F.lag("s", 1).over(order)).where((F.col("gap") > 120_000_000) & (F.col("gap") < 10 * HOUR))
    w = Window.partitionBy("key").orderBy("gap", "id")
    placed = gaps.withColumn("r", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    return placed.where("n >= 4 AND r = n DIV 2 + 1").select("key", F.col("gap").alias("median_gap"))


QUERIES = {
    f.__name__: f
    for f in (
        sliding_window_means, robust_normalise, signal_flash, signal_cut, signal_freeze, signal_ramp, action_score, dialogue_density, text_run_merge, event_merge,
        temporal_predecessor, entity_registry, binding_state, occurrence_bank, unique_leads, shard_merge, cost_report, duration_buckets, running_seq_frequency,
        section_density, role_perspective_views, arm_pairing, anti_missing, bpm_from_events,
    )
}

ORACLE_SQL = {
    "sliding_window_means": f"""{_IVL}, d AS (SELECT kind AS key, s AS t, (e - s) / 600000 AS cents, unnest(range(greatest(0, CAST(floor((s - {45 * HOUR}) / {15 * HOUR}) AS BIGINT) + 1), CAST(floor(s / {15 * HOUR}) AS BIGINT) + 1)) AS w FROM ivl),
m AS (SELECT key, w, count(*) AS n, avg(cents) AS mean_cents, max(t) AS last FROM d GROUP BY key, w),
t AS (SELECT *, max(last) OVER (PARTITION BY key) AS top FROM m)
SELECT key, w * {15 * HOUR} AS s, n, round(mean_cents, 6) AS mean_cents FROM t WHERE w = 0 OR w * {15 * HOUR} + {30 * HOUR} < top""",
    "robust_normalise": f"""WITH {SERIES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY v) AS r, count(*) OVER (PARTITION BY key) AS n FROM series),
p AS (SELECT *, max(CASE WHEN r = round_even((n - 1) * 0.1, 0) + 1 THEN v END) OVER (PARTITION BY key) AS lo, max(CASE WHEN r = round_even((n - 1) * 0.9, 0) + 1 THEN v END) OVER (PARTITION BY key) AS hi FROM r)
SELECT id, CASE WHEN hi > lo THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, (v - lo) / (hi - lo))) ELSE 0.0::DOUBLE END AS scaled FROM p""",
    "signal_flash": f"""WITH {SERIES_SQL}, b AS (SELECT *, avg(v) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS base,
  list(v) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS ahead FROM series)
SELECT id FROM b WHERE abs(v - base) > 4000 AND len(list_filter(ahead, lambda x: abs(x - base) <= greatest(800, abs(v - base) * 0.25))) > 0""",
    "signal_cut": f"""WITH {SERIES_SQL}, d AS (SELECT id, abs(v - lag(v) OVER (PARTITION BY key ORDER BY i)) AS diff FROM series) SELECT id, diff FROM d WHERE diff >= 6000""",
    "signal_freeze": f"""WITH {SERIES_SQL}, r AS (SELECT key, i, i - row_number() OVER (PARTITION BY key ORDER BY i) AS run FROM series WHERE v < 2000)
SELECT key, min(i) AS first, max(i) AS last, count(*) AS n FROM r GROUP BY key, run HAVING count(*) >= 3""",
    "signal_ramp": f"""WITH {SERIES_SQL}, m AS (SELECT id, avg(v) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS b, avg(v) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS a FROM series)
SELECT id, CASE WHEN a > b * 2.2::DOUBLE + 0.3::DOUBLE THEN 'faster' ELSE 'slower' END AS kind FROM m WHERE a > b * 2.2::DOUBLE + 0.3::DOUBLE OR (b > 0.5 AND a < b * 0.45::DOUBLE)""",
    "action_score": """SELECT user_id, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS day,
CAST(5 * count(*) FILTER (event_type = 'purchase') - 2 * count(*) FILTER (event_type = 'error') + count(*) AS BIGINT) AS points FROM events GROUP BY user_id, CAST(ts AS DATE)""",
    "dialogue_density": f"""{_UTT}, c AS (SELECT conv_id, s, e, length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) AS chars, unnest(range(s // 500, (e - 1) // 500 + 1)) AS w FROM utt WHERE e > s)
SELECT conv_id, w, CAST(sum(CAST(floor(chars * (least(e, (w + 1) * 500) - greatest(s, w * 500)) / (e - s)) AS BIGINT)) AS BIGINT) AS chars FROM c GROUP BY conv_id, w""",
    "text_run_merge": """WITH m AS (SELECT conv_id, turn, lower(role) AS role, CASE WHEN lower(role) = lag(lower(role)) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS new FROM conversations),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM m)
SELECT conv_id, any_value(role) AS role, min(turn) AS first_t, max(turn) AS last_t, count(*) AS occurrences FROM r GROUP BY conv_id, run""",
    "event_merge": f"""{_IVL} SELECT key, CAST(floor(s / {24 * HOUR}) AS BIGINT) AS day, kind, min(s) AS s, max(e) AS e, max(e - s) AS score, count(*) AS n,
string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM ivl GROUP BY 1, 2, 3""",
    "temporal_predecessor": f"{_IVL} SELECT id, CASE WHEN lag(e) OVER w <= s THEN lag(id) OVER w END AS preceding FROM ivl WINDOW w AS (PARTITION BY key ORDER BY s, id)",
    "entity_registry": """WITH n AS (SELECT o_custkey AS entity, o_orderpriority AS name, min(o_orderkey) AS first_at FROM orders GROUP BY 1, 2),
c AS (SELECT o_custkey AS entity, count(DISTINCT o_orderkey) AS shots FROM orders GROUP BY 1)
SELECT entity, string_agg(name, '|' ORDER BY first_at, name) AS names, any_value(shots) AS shots FROM n JOIN c USING (entity) GROUP BY entity""",
    "binding_state": """WITH b AS (SELECT user_id, count(DISTINCT CASE WHEN event_type = 'purchase' THEN CAST(ts AS DATE) END) AS windows, count(*) FILTER (event_type = 'error' AND value > 100) AS conflicts,
count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY user_id)
SELECT user_id, windows, conflicts, CASE WHEN conflicts > 0 THEN 'conflict' WHEN windows = 0 THEN 'unobserved' ELSE 'supported' END AS state, n FROM b""",
    "occurrence_bank": "SELECT sha256(text) AS sha, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    "unique_leads": f"""{_IVL} SELECT key, CAST(floor(s / {HOUR}) AS BIGINT) AS hour, kind, id FROM ivl WHERE kind IN ('view', 'click', 'error')
QUALIFY row_number() OVER (PARTITION BY key, floor(s / {HOUR}) ORDER BY CASE kind WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, id) = 1""",
    "shard_merge": """SELECT o_custkey, o_orderpriority, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, count(DISTINCT o_orderstatus) > 1 AS conflict, count(DISTINCT o_orderkey) AS shards
FROM orders GROUP BY 1, 2""",
    "cost_report": """SELECT event_type AS tool, count(*) FILTER (value < 50) AS n_ok, count(*) FILTER (NOT value < 50) AS n_error,
CAST(sum(CAST(round(value * 100) AS BIGINT)) FILTER (value < 50) AS BIGINT) AS cost, max(CAST(round(value * 100) AS BIGINT)) AS peak FROM events GROUP BY 1""",
    "duration_buckets": "SELECT CASE WHEN value < 10 THEN '<10' WHEN value < 20 THEN '10-20' WHEN value < 40 THEN '20-40' ELSE '>=40' END AS bucket, count(*) AS n FROM events GROUP BY 1",
    "running_seq_frequency": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS seen FROM orders",
    "section_density": """WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS quantity FROM lineitem GROUP BY 1, 2)
SELECT *, CAST(floor(n * 1000 / sum(n) OVER (PARTITION BY l_returnflag)) AS BIGINT) AS permille FROM g""",
    "role_perspective_views": """WITH v AS (SELECT 'actor' AS role, 'agency' AS use, l_linenumber, l_suppkey AS c FROM lineitem UNION ALL SELECT 'patient', 'received_impact', l_linenumber, l_orderkey FROM lineitem)
SELECT role, use, l_linenumber, count(*) AS n, count(DISTINCT c) AS characters FROM v GROUP BY 1, 2, 3""",
    "arm_pairing": """WITH w AS (SELECT user_id, max(event_id) FILTER (event_type = 'view') AS "view", max(event_id) FILTER (event_type = 'click') AS click, max(event_id) FILTER (event_type = 'purchase') AS purchase,
max(event_id) FILTER (event_type = 'signup') AS signup, max(event_id) FILTER (event_type = 'error') AS error FROM events GROUP BY user_id)
SELECT *, "view" IS NOT NULL AND click IS NOT NULL AND purchase IS NOT NULL AND signup IS NOT NULL AND error IS NOT NULL AS complete FROM w""",
    "anti_missing": "SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)",
    "bpm_from_events": f"""{_IVL}, g AS (SELECT key, id, s - lag(s) OVER (PARTITION BY key ORDER BY s, id) AS gap FROM ivl),
p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY gap, id) AS r, count(*) OVER (PARTITION BY key) AS n FROM g WHERE gap > 120000000 AND gap < {10 * HOUR})
SELECT key, gap AS median_gap FROM p WHERE n >= 4 AND r = n // 2 + 1""",
}
