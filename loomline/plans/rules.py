"""Gates, patches, publication and release over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators import rules
from loomline.sources.driver_tables import EVENT_INTERVALS_SQL, event_intervals, table

MINUTE = 60_000_000


def pruned_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose valid lines are half of all or more."""
    return rules.prune_invalid(table(spark, sf_dir, "lineitem"), "l_orderkey", (F.col("l_quantity") <= 30) & (F.col("l_returnflag") != "R"))


def media_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Id of each user's first view and first purchase, as of streams of a file."""
    return rules.first_streams(event_intervals(spark, sf_dir), "key", ["s", "id"], {"video": "view", "audio": "purchase"}, "id")


def edit_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events an hour, share near a beat of seven minutes, mean length, by user and kind (A5)."""
    return rules.edit_metrics(event_intervals(spark, sf_dir), ["key", "kind"], 60 * MINUTE, 7 * MINUTE, MINUTE)


def boosted_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five longest events of each user, errors raised by two hours (K6)."""
    rows = event_intervals(spark, sf_dir)
    top = rules.boosted_top(rows, ["key"], (F.col("e") - F.col("s")) / (60 * MINUTE), F.col("kind") == "error", 5)
    return top.select("key", "place", "id")


def refinement_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six events of each user to look at again, one an hour (K7)."""
    rows = event_intervals(spark, sf_dir).withColumn("confidence", F.col("e") - F.col("s")).withColumns({"missed": F.col("kind") == "error", "unsure": F.col("e") - F.col("s") < 20 * MINUTE})
    return rules.refinement_queue(rows, ["key"], 60 * MINUTE, 6).select("key", "place", "id", F.col("priority").cast("long").alias("priority"))


def audio_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound of each conversation from the lengths of the assistant's later turns."""
    turns = table(spark, sf_dir, "conversations")
    slots = turns.where("role = 'assistant' AND turn > 1").select("conv_id", (F.col("turn") % 2 == 1).alias("live"), F.length("text").alias("length"))
    return rules.audio_mode(slots, turns, "conv_id", 200)


def comprehension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each conversation's user turns that an assistant's turn of some length follows."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "role", F.lead("role").over(order).alias("next"), F.lead(F.length("text")).over(order).alias("size")).where("role = 'user'")
    answered = F.count_if((F.col("next") == "assistant") & (F.col("size") >= 100))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("questions"), (answered / F.count(F.lit(1))).alias("coverage"))


def release_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep and false accept rates of a length rule by source."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").where("quality IS NOT NULL")
    return rules.release_decision(rows.select("source", (F.col("quality") == 1).alias("good"), (F.col("n_chars") >= 600).alias("accepted")), "source", 0.6, 0.5)


def transfer_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose lines are all cheap, small and taxed, with enough returned ones as transitions."""
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", (F.col("l_returnflag") != "N").alias("transition"), (F.col("l_discount") < 0.1).alias("cheap"), (F.col("l_quantity") < 49).alias("small"), (F.col("l_tax") >= 0).alias("taxed")
    )
    return rules.transfer_complete(rows, "l_orderkey", ["cheap", "small", "taxed"])


def task_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of each nation with debts block it."""
    suppliers = table(spark, sf_dir, "supplier")
    status = F.when(F.col("s_acctbal") < 0, "draft").otherwise("committed")
    nodes = suppliers.select((F.col("s_suppkey") + 1000).alias("node"), status.alias("status")).unionByName(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.lit("committed").alias("status")))
    deps = suppliers.select(F.col("s_nationkey").cast("long").alias("node"), (F.col("s_suppkey") + 1000).alias("upstream"))
    return rules.blockers(nodes, deps)


def revocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders derived from a revoked one, a customer's first that is open and small, along each customer's orders."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha"), F.lag("o_orderkey").over(order).alias("derived_from"), "o_orderstatus", "o_totalprice")
    bad = rows.where("derived_from IS NULL AND o_orderstatus = 'O' AND o_totalprice < 50000").select("sha")
    return rules.revoked(rows, bad).groupBy("seed").agg(F.count(F.lit(1)).alias("versions"), F.max("steps").cast("long").alias("steps"))


def published_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders all of whose parts are accepted, by what they lack."""
    claims = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("claim"), "p_size")
    refs = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event"), F.col("l_partkey").alias("claim"))
    return rules.publish(claims, refs, F.col("p_size") <= 40).groupBy("published", "lacking").agg(F.count(F.lit(1)).alias("n"))


def identity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of each user from two answers an event gives."""
    answer = lambda c: F.when(c % 3 == 0, "same").when(c % 7 == 0, "uncertain").otherwise("different")
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select(
        "user_id", (F.col("event_id") % 2).alias("form"), answer(F.col("event_id")).alias("forward"), answer(F.floor("value")).alias("reverse"), (F.col("value") > 200).alias("hard_negative")
    )
    return rules.identity_state(rows, "user_id")


def bound_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a large part of a small supplier and a shipped line."""
    lines = table(spark, sf_dir, "lineitem")
    occurrences = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("participant"), (F.col("s_acctbal") > 5000).alias("supported"))
    facts = lines.select(F.col("l_orderkey").alias("event"), (F.col("l_linestatus") == "F").alias("supported"))
    return rules.bound_events(occurrences, lines.select(F.col("l_orderkey").alias("event"), F.col("l_suppkey").alias("participant")), facts)


QUERIES = {
    f.__name__: f
    for f in (
        pruned_orders, media_streams, edit_metrics, boosted_frames, refinement_queue, audio_modes, comprehension, release_by_source, transfer_checks, task_blockers,
        revocation, published_orders, identity_states, bound_events,
    )
}

_IVL = f"WITH {EVENT_INTERVALS_SQL}"

ORACLE_SQL = {
    "pruned_orders": """WITH c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_quantity <= 30 AND l_returnflag <> 'R') AS kept FROM lineitem GROUP BY 1) SELECT *, kept >= greatest(1, n // 2) AS stands FROM c""",
    "media_streams": f"{_IVL} SELECT key, arg_min(id, (s, id)) FILTER (kind = 'view') AS video, arg_min(id, (s, id)) FILTER (kind = 'purchase') AS audio FROM ivl GROUP BY 1",
    "edit_metrics": f"""{_IVL} SELECT key, kind, count(*) AS n, count(*) * {60 * MINUTE}::DOUBLE / nullif(max(e) - min(s), 0) AS rate,
count(*) FILTER (least(s % {7 * MINUTE}, {7 * MINUTE} - s % {7 * MINUTE}) <= {MINUTE}) * 100.0::DOUBLE / count(*) AS on_beat, CAST(floor(sum(e - s) / count(*)) AS BIGINT) AS mean FROM ivl GROUP BY 1, 2""",
    "boosted_frames": f"""{_IVL}, p AS (SELECT key, id, row_number() OVER (PARTITION BY key ORDER BY (e - s) / {60 * MINUTE}::DOUBLE + CASE WHEN kind = 'error' THEN 2 ELSE 0 END DESC, s, id) AS place FROM ivl) SELECT * FROM p WHERE place <= 5""",
    "refinement_queue": f"""{_IVL}, a AS (SELECT *, 2 * CAST(kind = 'error' AS BIGINT) + CAST(e - s < {20 * MINUTE} AS BIGINT) AS priority FROM ivl),
o AS (SELECT *, row_number() OVER (PARTITION BY key, s // {60 * MINUTE} ORDER BY priority DESC, e - s, s, id) AS n FROM a WHERE priority > 0),
p AS (SELECT key, id, priority, row_number() OVER (PARTITION BY key ORDER BY priority DESC, e - s, s, id) AS place FROM o WHERE n = 1) SELECT * FROM p WHERE place <= 6""",
    "audio_modes": """WITH l AS (SELECT conv_id, count(*) AS n, count(*) FILTER (turn % 2 = 1 AND length(text) >= 200) AS k FROM conversations WHERE role = 'assistant' AND turn > 1 GROUP BY 1)
SELECT DISTINCT conv_id, CASE WHEN n IS NULL THEN 'dialogue' WHEN k > 0 THEN 'mix' ELSE 'bgm' END AS mode FROM conversations LEFT JOIN l USING (conv_id)""",
    "comprehension": """WITH t AS (SELECT conv_id, role, lead(role) OVER w AS next, lead(length(text)) OVER w AS size FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, count(*) AS questions, count(*) FILTER (next = 'assistant' AND size >= 100) / count(*) AS coverage FROM t WHERE role = 'user' GROUP BY 1""",
    "release_by_source": """WITH r AS (SELECT source, count(*) FILTER (quality = 1 AND n_chars >= 600) / nullif(count(*) FILTER (quality = 1), 0) AS keep_rate,
count(*) FILTER (quality <> 1 AND n_chars >= 600) / nullif(count(*) FILTER (quality <> 1), 0) AS false_accept FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY 1)
SELECT *, coalesce(keep_rate >= 0.6::DOUBLE AND coalesce(false_accept, 0) <= 0.5::DOUBLE, false) AS release FROM r""",
    "transfer_checks": """WITH c AS (SELECT l_orderkey, bool_and(l_discount < 0.1::DOUBLE) AS cheap, bool_and(l_quantity < 49) AS small, bool_and(l_tax >= 0) AS taxed, count(*) FILTER (l_returnflag <> 'N') AS transitions, count(*) AS n FROM lineitem GROUP BY 1),
r AS (SELECT *, transitions >= greatest(2, ceil(n * 3 / 5)) AND transitions <= n + 1 AS in_range FROM c) SELECT l_orderkey, cheap, small, taxed, transitions, in_range, in_range AND cheap AND small AND taxed AS complete FROM r""",
    "task_blockers": """WITH b AS (SELECT CAST(s_nationkey AS BIGINT) AS node, count(*) AS blockers, min(s_suppkey + 1000) AS first FROM supplier WHERE s_acctbal < 0 GROUP BY 1),
n AS (SELECT s_suppkey + 1000 AS node FROM supplier UNION ALL SELECT n_nationkey FROM nation) SELECT node, coalesce(blockers, 0) AS blockers, first FROM n LEFT JOIN b USING (node)""",
    "revocation": """WITH r AS (SELECT o_custkey, o_orderkey AS sha, o_orderstatus, o_totalprice, row_number() OVER w AS n, count(*) OVER (PARTITION BY o_custkey) AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT sha AS seed, c AS versions, c - 1 AS steps FROM r WHERE n = 1 AND o_orderstatus = 'O' AND o_totalprice < 50000""",
    "published_orders": """WITH l AS (SELECT l_orderkey, count(*) FILTER (p_partkey IS NULL) AS lacking FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size <= 40 GROUP BY 1)
SELECT lacking = 0 AS published, lacking, count(*) AS n FROM l GROUP BY 1, 2""",
    "identity_states": """WITH a AS (SELECT user_id, event_id % 2 AS form, CASE WHEN event_id % 3 = 0 THEN 'same' WHEN event_id % 7 = 0 THEN 'uncertain' ELSE 'different' END AS f,
CASE WHEN floor(value) % 3 = 0 THEN 'same' WHEN floor(value) % 7 = 0 THEN 'uncertain' ELSE 'different' END AS r, value > 200 AS hard FROM events WHERE event_type = 'error'),
g AS (SELECT user_id, count(DISTINCT form) FILTER (f = 'same' AND r = 'same') AS forms, bool_or(hard) AS hard, bool_or(f = 'uncertain' OR r = 'uncertain') AS open FROM a GROUP BY 1),
s AS (SELECT user_id, forms, CASE WHEN forms > 0 AND hard THEN 'conflict' WHEN forms > 0 THEN 'supported' WHEN open THEN 'uncertain' ELSE 'rejected' END AS state FROM g)
SELECT *, CASE WHEN state = 'supported' AND forms = 1 THEN 'identified' ELSE 'uncertain' END AS form_state FROM s""",
    "bound_events": """SELECT l_orderkey AS event, count(DISTINCT l_suppkey) AS participants FROM lineitem JOIN supplier ON s_suppkey = l_suppkey AND s_acctbal > 5000
WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F') GROUP BY 1""",
}
