"""Gates, audits and remaining joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import gates as gt
from loomline.operators import intervals as iv
from loomline.sources.driver_tables import EVENT_INTERVALS_SQL, event_intervals, table

HOUR = 3_600_000_000
_IVL = f"WITH {EVENT_INTERVALS_SQL}"


def delivery_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that may be delivered: not pending, priced, with lines; reasons against the rest."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("lines"))
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left")
    ok, why = gt.gate({"pending": F.col("o_orderstatus") == "P", "cheap": F.col("o_totalprice") < 20_000, "lines": F.col("lines") < 2})
    return rows.select(ok.alias("ok"), why.alias("why")).groupBy("ok", "why").agg(F.count(F.lit(1)).alias("n"))


def failure_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each event by the first rule that holds."""
    rules = {"timing": F.col("value") > 150, "identity": F.col("user_id") % 11 == 0, "rejected": F.col("event_type") == "error", "candidate": F.col("value") < 5}
    return table(spark, sf_dir, "events").groupBy(gt.first_class(rules, "evidence").alias("class")).agg(F.count(F.lit(1)).alias("n"))


def capability_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of each user as a capability: any large error fails, all purchases above 1 pass."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.bool_or((F.col("event_type") == "error") & (F.col("value") > 200)).alias("failed"), F.bool_and((F.col("event_type") != "purchase") | (F.col("value") > 1)).alias("passed"), F.count_if(F.col("event_type") == "purchase").alias("seen")
    )
    return rows.select("user_id", gt.tri_state(F.col("failed"), F.col("passed"), F.col("seen") > 0).alias("state"))


def fault_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bad documents by language found by their length and by capital letters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("kind"), (F.col("n_chars") < 700).alias("flagged"), (F.col("n_chars") < 400).alias("repaired"))
    return gt.fault_scores(docs.join(table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 0).alias("faulty")), "doc_id"))


def arm_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priorities as arms: closed orders are hits, pending ones failures, tokens known without the latter."""
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("arm"), (F.col("o_orderstatus") == "F").alias("hit"), (F.col("o_orderstatus") == "P").alias("failed"), F.when(F.col("o_orderkey") != 7, F.col("o_custkey")).alias("tokens")
    )
    return gt.arm_summary(rows)


def sampling_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's events rise in time and come at one to five an hour."""
    rows = event_intervals(spark, sf_dir).select("key", F.col("id").alias("i"), (F.col("s") / HOUR).alias("t"))
    return gt.sampling_audit(rows, ["key"], 0.05, 0.11).select("key", "monotonic", "n", "in_range")


def unclaimed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event kinds that a user has never had at a value above 120."""
    ivl = table(spark, sf_dir, "events").where("value > 120").select(F.col("user_id").alias("key"), F.col("event_type").alias("kind"))
    return gt.unclaimed(ivl, ivl.select("kind").distinct(), "key")


def design_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a weight by toxicity; a missing one would be an error."""
    labels = table(spark, sf_dir, "labels")
    private = labels.select("doc_id", (1 + F.col("toxic") * 4).cast("double").alias("weight"))
    return gt.design_join(labels.drop("weight"), private, "doc_id").groupBy("quality").agg(F.sum("weight").alias("weight"))


def point_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first view of the user that holds the start of each error."""
    ivl = event_intervals(spark, sf_dir)
    marks = ivl.where("kind = 'view'").select("key", F.col("s").alias("s2"), F.col("e").alias("e2"), F.col("id").alias("label"))
    return gt.point_in_interval(ivl.where("kind = 'error'").select("key", "id", F.col("s").alias("t")), marks, ["key"], 2 * HOUR).select("id", "label")


def gt_binding_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language classes against labels: unseen rows skipped, wrong ones counted."""
    pred = table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("said"))
    rows = table(spark, sf_dir, "labels").join(pred, "doc_id", "left")
    return rows.groupBy("toxic").agg(F.count("said").alias("seen"), F.count_if(F.col("said") == F.col("quality")).alias("right"), F.count_if(F.col("said").isNull()).alias("unseen"))


def upper_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and ninetieth percentile of each event type."""
    rows = table(spark, sf_dir, "events").select("event_type", F.round(F.col("value") * 100).cast("long").alias("v"))
    return gt.upper_percentiles(rows, ["event_type"], "v").select("event_type", "median", F.col("p90").cast("long").alias("p90"))


def rms_onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest rises of the mean square by day, for each user."""
    rows = event_intervals(spark, sf_dir).select("key", F.floor(F.col("s") / (24 * HOUR)).alias("w"), ((F.col("e") - F.col("s")) / 600_000).cast("long").alias("v"))
    return gt.rms_onsets(rows, ["key"], "v", 3).select("key", "w", F.col("rise").cast("long").alias("rise"))


def carrier_segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view of the user with the largest overlap with each click, the earlier one on ties."""
    ivl = event_intervals(spark, sf_dir)
    views = ivl.where("kind = 'view'").select("key", F.col("id").alias("id2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = iv.overlap_join(ivl.where("kind = 'click'"), views, ["key"], 2 * HOUR)
    common = iv.overlap(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"))
    return pairs.groupBy("id").agg(F.min_by("id2", F.struct((-common).alias("k"), "s2", "id2")).alias("id2"))


def contained_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of a user that lie wholly inside a view, distinct."""
    ivl = event_intervals(spark, sf_dir)
    views = ivl.where("kind = 'view'").select("key", F.col("id").alias("id2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = iv.overlap_join(ivl.where("kind = 'error'"), views, ["key"], 2 * HOUR)
    return pairs.where(iv.contains(F.col("s2"), F.col("e2"), F.col("s"), F.col("e"))).select("id").distinct()


def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a user's events that hit each other at a hull share of a half."""
    ivl = event_intervals(spark, sf_dir)
    other = ivl.select("key", F.col("id").alias("id2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = iv.overlap_join(ivl, other, ["key"], 2 * HOUR).where("id < id2")
    return pairs.where(iv.is_hit(F.col("s"), F.col("e"), F.col("s2"), F.col("e2"), 0.5)).groupBy("key").agg(F.count(F.lit(1)).alias("pairs"))


def forbidden_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose open properties hold the key k with a value of two digits or more."""
    return table(spark, sf_dir, "events").where(F.col("props").rlike(r'"k"\s*:\s*[0-9]{2}')).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def role_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most common sequences of line statuses of an order (A3)."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("x"))
    seq = F.concat_ws(">", F.transform("x", lambda x: x["l_returnflag"]))
    return rows.groupBy(seq.alias("sequence")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "sequence").limit(10)


def coverage_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covered time of each user by kind of event."""
    union = iv.merge_within(event_intervals(spark, sf_dir), ["key", "kind"])
    return union.groupBy("key", "kind").agg(F.sum(F.col("e") - F.col("s")).alias("covered"))


QUERIES = {
    f.__name__: f
    for f in (
        delivery_gate, failure_class, capability_states, fault_scores, arm_summary, sampling_audit, unclaimed_kinds, design_join, point_labels, gt_binding_eval,
        upper_percentiles, rms_onsets, carrier_segment, contained_utterances, duplicate_pairs, forbidden_keys, role_sequences, coverage_audit,
    )
}

_PAIR = "a.key = b.key AND least(a.e, b.e) > greatest(a.s, b.s)"
ORACLE_SQL = {
    "delivery_gate": """WITH l AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1), r AS (SELECT array_to_string(list_filter([CASE WHEN o_orderstatus = 'P' THEN 'pending' END, CASE WHEN o_totalprice < 20000 THEN 'cheap' END,
CASE WHEN coalesce(lines < 2, true) THEN 'lines' END], lambda x: x IS NOT NULL), ',') AS why FROM orders LEFT JOIN l ON l_orderkey = o_orderkey) SELECT coalesce(why, '') = '' AS ok, coalesce(why, '') AS why, count(*) AS n FROM r GROUP BY 1, 2""",
    "failure_class": """SELECT CASE WHEN value > 150 THEN 'timing' WHEN user_id % 11 = 0 THEN 'identity' WHEN event_type = 'error' THEN 'rejected' WHEN value < 5 THEN 'candidate' ELSE 'evidence' END AS "class", count(*) AS n FROM events GROUP BY 1""",
    "capability_states": """WITH r AS (SELECT user_id, bool_or(event_type = 'error' AND value > 200) AS f, bool_and(event_type <> 'purchase' OR value > 1) AS p, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY 1)
SELECT user_id, CASE WHEN f THEN 'ineffective' WHEN p AND n > 0 THEN 'effective' ELSE 'unknown' END AS state FROM r""",
    "fault_scores": """SELECT lang AS kind, count(*) FILTER (quality = 0) AS faulty, count(*) FILTER (quality = 0 AND n_chars < 700) AS detected, count(*) FILTER (quality = 0 AND n_chars < 400) AS repaired,
count(*) FILTER (quality <> 0) AS clean, count(*) FILTER (quality <> 0 AND n_chars < 700) AS false_positives FROM documents JOIN labels USING (doc_id) GROUP BY 1""",
    "arm_summary": """SELECT o_orderpriority AS arm, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) FILTER (o_orderstatus = 'P') AS failures,
CAST(CASE WHEN count(*) FILTER (o_orderkey = 7) = 0 THEN sum(o_custkey) END AS BIGINT) AS tokens FROM orders GROUP BY 1""",
    "sampling_audit": f"""{_IVL}, s AS (SELECT key, id, s / {HOUR} AS t, s / {HOUR} > lag(s / {HOUR}) OVER (PARTITION BY key ORDER BY id) AS up FROM ivl)
SELECT key, bool_and(coalesce(up, true)) AS monotonic, count(*) AS n, coalesce((count(*) - 1) / (max(t) - min(t)) BETWEEN 0.05::DOUBLE AND 0.11::DOUBLE, false) AS in_range FROM s GROUP BY key""",
    "unclaimed_kinds": """WITH c AS (SELECT DISTINCT user_id AS key, event_type AS kind FROM events WHERE value > 120)
SELECT k.key, t.kind FROM (SELECT DISTINCT key FROM c) k CROSS JOIN (SELECT DISTINCT kind FROM c) t WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.key = k.key AND c.kind = t.kind)""",
    "design_join": "SELECT quality, CAST(sum(1 + toxic * 4) AS DOUBLE) AS weight FROM labels GROUP BY 1",
    "point_labels": f"""{_IVL} SELECT a.id, (SELECT arg_min(b.id, (b.s, b.id)) FROM ivl b WHERE b.key = a.key AND b.kind = 'view' AND a.s >= b.s AND a.s <= b.e) AS label FROM ivl a WHERE a.kind = 'error'""",
    "gt_binding_eval": """SELECT toxic, count(d.doc_id) AS seen, count(*) FILTER (CASE WHEN n_chars > 500 THEN 1 ELSE 0 END = quality AND d.doc_id IS NOT NULL) AS right, count(*) FILTER (d.doc_id IS NULL) AS unseen
FROM labels l LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 <> 0) d USING (doc_id) GROUP BY 1""",
    "upper_percentiles": """WITH v AS (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events) SELECT event_type, quantile_cont(v, 0.5) AS median, CAST(quantile_disc(v, 0.9) AS BIGINT) AS p90 FROM v GROUP BY 1""",
    "rms_onsets": f"""{_IVL}, e AS (SELECT key, CAST(floor(s / {24 * HOUR}) AS BIGINT) AS w, CAST(sum(((e - s) // 600000) * ((e - s) // 600000)) AS BIGINT) // count(*) AS m FROM ivl GROUP BY 1, 2),
r AS (SELECT key, w, m - lag(m) OVER (PARTITION BY key ORDER BY w) AS rise FROM e) SELECT key, w, rise FROM r WHERE rise > 0 QUALIFY row_number() OVER (PARTITION BY key ORDER BY rise DESC, w) <= 3""",
    "carrier_segment": f"""{_IVL} SELECT a.id, b.id AS id2 FROM ivl a JOIN ivl b ON {_PAIR} AND a.kind = 'click' AND b.kind = 'view'
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY least(a.e, b.e) - greatest(a.s, b.s) DESC, b.s, b.id) = 1""",
    "contained_utterances": f"{_IVL} SELECT DISTINCT a.id FROM ivl a JOIN ivl b ON {_PAIR} AND a.kind = 'error' AND b.kind = 'view' WHERE a.s >= b.s AND a.e <= b.e",
    "duplicate_pairs": f"""{_IVL} SELECT a.key, count(*) AS pairs FROM ivl a JOIN ivl b ON {_PAIR} AND a.id < b.id
WHERE (a.s + a.e >= 2 * b.s AND a.s + a.e <= 2 * b.e) OR (least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)) > 0.5 GROUP BY a.key""",
    "forbidden_keys": """SELECT event_type, count(*) AS n FROM events WHERE regexp_matches(props, '"k"\\s*:\\s*[0-9]{2}') GROUP BY 1""",
    "role_sequences": """WITH r AS (SELECT l_orderkey, string_agg(l_returnflag, '>' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS sequence FROM lineitem GROUP BY 1)
SELECT sequence, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, sequence LIMIT 10""",
    "coverage_audit": f"""{_IVL}, r AS (SELECT *, max(e) OVER (PARTITION BY key, kind ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM ivl)
SELECT key, kind, CAST(sum(greatest(0, e - greatest(s, coalesce(r, s)))) AS BIGINT) AS covered FROM r GROUP BY 1, 2""",
}
