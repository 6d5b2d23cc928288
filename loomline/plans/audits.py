"""Versions, claims, suites, rhythm, pilots and other audits over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import text as tx
from loomline.operators import audits as au, intervals as iv, lineage as li
from loomline.plans.timeline import MINUTE, WIDTH
from loomline.sources.driver_tables import EVENT_INTERVALS_SQL, event_intervals, table

HOUR, WEEK = 60 * MINUTE, 7 * 24 * 60 * MINUTE
OPS = {"O": "draft", "F": "commit", "P": "revoke"}


def version_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of each customer's orders read as drafts, commits and revocations."""
    log = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "F", "commit").otherwise("revoke").alias("op"))
    return au.version_states(log, "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "state")


def ledger_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims on a customer's priority; a small one supersedes the order before it."""
    before = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    claims = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.col("o_orderpriority").alias("p"), F.col("o_orderstatus").alias("polarity"), F.when(F.col("o_totalprice") < 60_000, before).alias("supersedes"))
    return au.ledger_states(claims, ["o_custkey", "p"]).select("id", "state")


def catalogue_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as assets: uses by size and price, repeated names."""
    rows = table(spark, sf_dir, "part").select(F.lower(F.concat_ws(":", "p_brand", "p_name", F.col("p_size").cast("string"))).alias("id"), F.array(F.col("p_size") % 4, F.col("p_size") % 3).alias("yes"), F.array((F.col("p_partkey") % 5).cast("int")).alias("no"))
    return au.catalogue_faults(rows, "yes", "no", "brand#1").groupBy("faults").agg(F.count(F.lit(1)).alias("n"))


def reusable_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases whose answer a view of the same minute length and user parity holds."""
    rows = event_intervals(spark, sf_dir).withColumns({"observation": F.sha2(F.floor((F.col("e") - F.col("s")) / MINUTE).cast("string"), 256), "contract": F.col("key") % 2})
    return au.reusable(rows.where("kind = 'purchase'"), rows.where("kind = 'view'")).select("id", "reuse")


def resumable_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a shipped line are still to be done."""
    done = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"), F.lit("ok").alias("status"))
    return li.pending(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


def rhythm_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's weeks as sections: from its first event to the next week's, clicks as cuts, days as units."""
    rows = event_intervals(spark, sf_dir).withColumn("section", F.floor(F.col("s") / WEEK))
    spans = rows.groupBy("key", "section").agg(F.min("s").alias("s"), F.max("s").alias("e")).where("e > s")
    spans = spans.withColumn("units", (F.col("e") - F.col("s")) / float(24 * HOUR))
    return au.rhythm_grammar(spans, rows.where("kind = 'click'").select("key", "section", F.col("s").alias("t")), ["key"])


def pilot_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event of each user to try first."""
    rows = event_intervals(spark, sf_dir).select("key", "id", F.col("kind").alias("role"), (F.col("id") % 4).alias("missing"), F.floor((F.col("e") - F.col("s")) / HOUR).alias("cast"))
    return au.pilot(rows, ["key"], ["purchase", "signup"])


def next_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order line of each order to make next."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("span")).agg(
        F.count_if(F.col("l_returnflag") == "R").alias("missing"), F.count_if(F.col("l_returnflag") == "A").alias("partial"), F.bool_or(F.col("l_quantity") > 25).alias("needed")
    )
    return au.next_span(rows, ["l_orderkey"])


def goal_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user, week and kind the longest event not yet used by value."""
    rows = event_intervals(spark, sf_dir).select("key", F.floor(F.col("s") / WEEK).alias("section"), F.col("kind").alias("goal"), F.col("id"), (F.col("e") - F.col("s")).alias("n"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("key", "section", "goal").orderBy(F.desc("n"), "id")).cast("long")).where("place <= 3")
    return au.goal_plan(ranked, ["key"])


def nested_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose middle half, moved by their number, still nests."""
    size = F.col("e") - F.col("s")
    s, e = F.col("s") + F.floor(size / 4), F.col("e") - F.floor(size / 4)
    move = F.floor(size * (F.col("id") % 5) / 10)
    return event_intervals(spark, sf_dir).select("id", au.nested(F.col("s"), F.col("e"), s, e, s + move, e - move).alias("nested"))


def scope_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views against overlapping events of the user: held whole within a minute or not, and the part inside."""
    ivl = event_intervals(spark, sf_dir)
    pairs = iv.overlap_join(ivl.where("kind = 'view'").select("key", "id", "s", "e"), ivl.where("kind <> 'view'").select("key", F.col("id").alias("id2"), F.col("s").alias("s2"), F.col("e").alias("e2")), ["key"], WIDTH)
    held = iv.contains(F.col("s2"), F.col("e2"), F.col("s"), F.col("e"), MINUTE)
    return pairs.select("id", "id2", held.alias("held"), F.greatest("s", "s2").alias("lo"), F.least("e", "e2").alias("hi"))


def rule_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments between each user's events, named by the first of two hypotheses that has a name."""
    rows = event_intervals(spark, sf_dir).select("key", "id", F.col("s").alias("t"), F.array("kind", F.when(F.col("id") % 2 == 0, "view").otherwise("error")).alias("hypotheses"), (F.col("id") % 10 / 10.0).alias("confidence"))
    return au.rule_drafts(rows, ["key"], {"view": "show", "purchase": "pay"}, 0.4).select("id", "s", "e", "name", "confidence")


def pilot_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty events of each user to try: known, of high value round the kinds, by hash."""
    rows = event_intervals(spark, sf_dir).select("key", "id", "kind", (F.col("kind") == "error").alias("known"), F.floor((F.col("e") - F.col("s")) / MINUTE).alias("value"))
    return au.pilot_windows(rows, ["key"], 8, 6, 6)


def recall_at_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well each user's five longest clicks find the views within six hours (E5)."""
    ivl = event_intervals(spark, sf_dir)
    guesses = ivl.where("kind = 'click'").select("key", "id", F.col("s").alias("t"), (F.col("e") - F.col("s")).alias("strength"))
    return au.recall_at(guesses, ivl.where("kind = 'view'").select("key", F.col("s").alias("t2")), ["key"], 5, 6 * HOUR)


def story_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring lines of an order with nothing in common, a supplier's parts running backwards, or more discount than tax."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("idx")).agg(
        F.min("l_suppkey").alias("sup"), F.min("l_partkey").alias("s"), F.collect_set("l_returnflag").alias("entities"), F.max("l_tax").alias("length"), F.max("l_discount").alias("dialogue")
    )
    return au.story_faults(rows.withColumn("source", F.col("sup") % 3), ["l_orderkey"])


def box_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as boxes by quantity and supplier that cover each other by half."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).alias("id"), F.col("l_quantity").cast("long").alias("x"), (F.col("l_suppkey") % 50).alias("y"), (F.col("l_partkey") % 30 + 5).alias("w"), F.lit(20).cast("long").alias("h"))
    return au.box_overlap(rows, ["l_orderkey"], 0.5).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"), F.sum("common").alias("common"))


def series_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and large steps of each user's event lengths in minutes."""
    rows = event_intervals(spark, sf_dir).withColumn("v", F.floor((F.col("e") - F.col("s")) / MINUTE))
    return au.series_stats(rows, ["key"], "v", 30)


def shared_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that share a supplier with the customer's order before."""
    sets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("who"))
    rows = table(spark, sf_dir, "orders").join(sets, "o_orderkey")
    before = F.lag("who").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return rows.select("o_orderkey", F.coalesce(F.arrays_overlap("who", before), F.lit(False)).alias("shared"))


def clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of event properties as trimmed text and as whole numbers or null, and whether a name is concrete."""
    raw = F.when(F.col("event_id") % 4 == 0, F.lit("  ")).when(F.col("event_id") % 4 == 1, F.concat(F.lit(" "), F.floor("value").cast("string"), F.lit(" "))).when(F.col("event_id") % 4 == 2, F.lit("None.")).otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select(tx.trim_to_null(raw).alias("t"), tx.is_concrete(raw).alias("concrete"))
    return rows.groupBy(F.col("t").isNull().alias("blank"), "concrete").agg(F.count(F.lit(1)).alias("n"), F.sum(tx.int_or_null(F.col("t"))).alias("total"))


def scaled_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on a clock that runs at two thirds."""
    return event_intervals(spark, sf_dir).select("id", F.floor(F.col("s") * 2 / 3).alias("s"), F.floor(F.col("e") * 2 / 3).alias("e"))


def suite_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truth suite of each user's recording."""
    return au.suite_specs(event_intervals(spark, sf_dir).groupBy("key").agg(F.max("e").alias("hi")), "key")


QUERIES = {
    f.__name__: f
    for f in (
        version_states, suite_specs, ledger_states, catalogue_faults, reusable_answers, resumable_tasks, rhythm_grammar, pilot_shots, next_spans, goal_plans, nested_intervals,
        scope_relations, rule_drafts, pilot_windows, recall_at_five, story_faults, box_overlaps, series_stats, shared_parts, clean_values, scaled_intervals,
    )
}

_IVL = f"WITH {EVENT_INTERVALS_SQL}"

ORACLE_SQL = {
    "suite_specs": f"""WITH {EVENT_INTERVALS_SQL}, b AS (SELECT key, max(e) AS hi FROM ivl GROUP BY key), m AS (SELECT key, hi, id, md5('suite-1/' || key || '/' || id) AS m FROM b, range(144) t(id) WHERE hi > 0),
d AS (SELECT key, hi, id, CAST('0x' || substring(m, 1, 6) AS BIGINT) AS d1, CAST('0x' || substring(m, 7, 6) AS BIGINT) AS d2, CAST('0x' || substring(m, 13, 6) AS BIGINT) AS d3, CAST('0x' || substring(m, 19, 6) AS BIGINT) AS d4 FROM m),
l AS (SELECT *, 1 + d1 % greatest(1, hi // 10) AS len, CASE WHEN id < 96 THEN 'single' WHEN id < 120 THEN 'paired' ELSE 'compound' END AS kind FROM d), s AS (SELECT *, d2 % greatest(1, hi - len) AS s FROM l),
v AS (SELECT *, unnest(CASE WHEN kind = 'paired' THEN ['with', 'without'] ELSE ['with'] END) AS variant FROM s)
SELECT key, id, kind, CASE WHEN variant = 'with' THEN d3 % 12 END AS operation, CASE WHEN kind = 'compound' THEN (d3 % 12 + 1 + d4 % 11) % 12 END AS second, s, least(s + len, hi) AS e, variant FROM v""",
    "version_states": """WITH l AS (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'F' THEN 'commit' ELSE 'revoke' END AS op, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
x AS (SELECT a.o_orderkey, a.op, count(b.n) AS later, arg_min(b.op, b.n) FILTER (b.op <> 'draft') AS nxt FROM l a LEFT JOIN l b ON b.o_custkey = a.o_custkey AND b.n > a.n GROUP BY 1, 2)
SELECT o_orderkey, CASE WHEN op = 'revoke' THEN 'revocation' WHEN op = 'draft' AND later > 0 THEN 'superseded' WHEN op = 'draft' THEN 'draft' WHEN nxt = 'commit' THEN 'stale' WHEN nxt = 'revoke' THEN 'revoked' ELSE 'active' END AS state FROM x""",
    "ledger_states": """WITH c AS (SELECT *, CASE WHEN o_totalprice < 60000 THEN lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) END AS sup FROM orders),
a AS (SELECT *, o_orderkey NOT IN (SELECT sup FROM c WHERE sup IS NOT NULL) AS active FROM c), s AS (SELECT o_custkey, o_orderpriority, count(DISTINCT o_orderstatus) AS sides FROM a WHERE active GROUP BY 1, 2)
SELECT o_orderkey AS id, CASE WHEN NOT active THEN 'inactive' WHEN sides > 1 THEN 'contested' ELSE 'supported' END AS state FROM a LEFT JOIN s USING (o_custkey, o_orderpriority)""",
    "catalogue_faults": """WITH r AS (SELECT lower(concat_ws(':', p_brand, p_name, p_size)) AS id, p_partkey % 5 IN (p_size % 4, p_size % 3) AS bad FROM part), n AS (SELECT *, count(*) OVER (PARTITION BY id) AS c FROM r)
SELECT coalesce(array_to_string(list_filter([CASE WHEN c > 1 THEN 'repeated' END, CASE WHEN bad THEN 'contradicts' END, CASE WHEN NOT starts_with(id, 'brand#1') THEN 'namespace' END], lambda x: x IS NOT NULL), ','), '') AS faults, count(*) AS n FROM n GROUP BY 1""",
    "reusable_answers": f"""{_IVL} SELECT id, EXISTS (SELECT 1 FROM ivl b WHERE b.kind = 'view' AND (b.e - b.s) // {MINUTE} = (a.e - a.s) // {MINUTE} AND b.key % 2 = a.key % 2) AS reuse FROM ivl a WHERE kind = 'purchase'""",
    "resumable_tasks": "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')",
    "rhythm_grammar": f"""{_IVL}, x AS (SELECT *, CAST(floor(s / {WEEK}) AS BIGINT) AS section FROM ivl), g AS (SELECT key, section, min(s) AS s, max(s) AS e FROM x GROUP BY 1, 2 HAVING max(s) > min(s)),
c AS (SELECT g.key, g.section, count(x.id) AS cuts FROM g LEFT JOIN x ON x.key = g.key AND x.section = g.section AND x.kind = 'click' AND x.s > g.s AND x.s < g.e GROUP BY 1, 2),
r AS (SELECT key, section, (e - s) / sum(e - s) OVER (PARTITION BY key) AS ratio, cuts, cuts / ((e - s) / {24 * HOUR}::DOUBLE) AS rate FROM g JOIN c USING (key, section))
SELECT key, section, round(ratio, 6) AS ratio, round(greatest(0, ratio - 0.055::DOUBLE), 6) AS low, round(ratio + 0.065::DOUBLE, 6) AS high, cuts, CASE WHEN rate < 0.15 THEN 'sparse' WHEN rate < 0.4 THEN 'calm' WHEN rate < 0.8 THEN 'brisk' ELSE 'dense' END AS density FROM r""",
    "pilot_shots": f"""{_IVL} SELECT key, arg_min(id, (kind NOT IN ('purchase', 'signup'), id % 4, (e - s) // {HOUR}, CASE kind WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 ELSE 2 END, id)) AS pilot FROM ivl GROUP BY 1""",
    "next_spans": """WITH g AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS span, 2 * count(*) FILTER (l_returnflag = 'R') + CASE WHEN bool_or(l_quantity > 25) THEN count(*) FILTER (l_returnflag = 'A') ELSE 0 END AS need FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, arg_min(span, (-need, span)) AS span, CAST(max(need) AS BIGINT) AS need FROM g WHERE need > 0 GROUP BY 1""",
    "goal_plans": f"""{_IVL} SELECT key, CAST(floor(s / {WEEK}) AS BIGINT) AS section, kind AS goal, arg_min(id, (s - e, id)) AS id FROM ivl GROUP BY 1, 2, 3""",
    "nested_intervals": f"""{_IVL}, x AS (SELECT *, (e - s) // 4 AS q, (e - s) * (id % 5) // 10 AS m FROM ivl) SELECT id, s + q + m >= s + q AND e - q - m <= e - q AS nested FROM x""",
    "scope_relations": f"""{_IVL} SELECT a.id, b.id AS id2, a.s >= b.s - {MINUTE} AND a.e <= b.e + {MINUTE} AS held, greatest(a.s, b.s) AS lo, least(a.e, b.e) AS hi FROM ivl a JOIN ivl b ON a.key = b.key AND a.kind = 'view' AND b.kind <> 'view' AND least(a.e, b.e) > greatest(a.s, b.s)""",
    "rule_drafts": f"""{_IVL}, x AS (SELECT id, s, lead(s) OVER (PARTITION BY key ORDER BY s, id) AS e, CASE WHEN kind = 'view' THEN 'show' WHEN kind = 'purchase' THEN 'pay' WHEN id % 2 = 0 THEN 'show' END AS name, least(id % 10 / 10.0::DOUBLE, 0.4::DOUBLE) AS confidence FROM ivl)
SELECT * FROM x WHERE e > s AND name IS NOT NULL""",
    "pilot_windows": f"""{_IVL}, w AS (SELECT key, id, kind, kind = 'error' AS known, (e - s) // {MINUTE} AS value FROM ivl),
a AS (SELECT *, known AND row_number() OVER (PARTITION BY key ORDER BY known DESC, value DESC, id) <= 8 AS k FROM w), b AS (SELECT *, row_number() OVER (PARTITION BY key, kind ORDER BY k, value DESC, id) AS turn FROM a),
c AS (SELECT *, NOT k AND row_number() OVER (PARTITION BY key ORDER BY k, turn, kind, id) <= 6 AS h FROM b), d AS (SELECT *, NOT (k OR h) AND row_number() OVER (PARTITION BY key ORDER BY k OR h, sha256(CAST(id AS VARCHAR))) <= 6 AS o FROM c)
SELECT key, id, CASE WHEN k THEN 'known' WHEN h THEN 'high' ELSE 'other' END AS role FROM d WHERE k OR h OR o""",
    "recall_at_five": f"""{_IVL}, t AS (SELECT key, id, s AS t FROM ivl WHERE kind = 'click' QUALIFY row_number() OVER (PARTITION BY key ORDER BY e - s DESC, id) <= 5), v AS (SELECT key, s AS t2 FROM ivl WHERE kind = 'view'),
p AS (SELECT t.key, id, t2, abs(t - t2) AS d FROM t JOIN v USING (key)), n AS (SELECT key, id, min(d) AS d FROM p GROUP BY 1, 2),
h AS (SELECT key, count(*) FILTER (d <= {6 * HOUR}) / count(*) AS precision, CAST(floor(sum(d) / count(*)) AS BIGINT) AS error FROM n GROUP BY 1), f AS (SELECT key, count(DISTINCT t2) AS found FROM p WHERE d <= {6 * HOUR} GROUP BY 1),
a AS (SELECT key, count(DISTINCT t2) AS truths FROM v GROUP BY 1) SELECT key, coalesce(found, 0) / truths AS recall, precision, error FROM a LEFT JOIN h USING (key) LEFT JOIN f USING (key)""",
    "story_faults": """WITH g AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS idx, min(l_suppkey) % 3 AS source, min(l_partkey) AS s, list(DISTINCT l_returnflag) AS en, max(l_tax) AS length, max(l_discount) AS dialogue FROM lineitem GROUP BY 1, 2),
p AS (SELECT *, lag(en) OVER w AS pe, lag(source) OVER w AS ps, lag(s) OVER w AS pt FROM g WINDOW w AS (PARTITION BY l_orderkey ORDER BY idx)),
f AS (SELECT l_orderkey, idx, array_to_string(list_filter([CASE WHEN NOT list_has_any(pe, en) THEN 'entities' END, CASE WHEN source = ps AND s < pt THEN 'backwards' END, CASE WHEN dialogue > length THEN 'speech' END], lambda x: x IS NOT NULL), ',') AS faults FROM p)
SELECT * FROM f WHERE faults <> ''""",
    "box_overlaps": """WITH b AS (SELECT l_orderkey, l_linenumber * 100000 + l_partkey AS id, CAST(l_quantity AS BIGINT) AS x, l_suppkey % 50 AS y, l_partkey % 30 + 5 AS w FROM lineitem),
p AS (SELECT a.l_orderkey, greatest(0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0, least(a.y, c.y) + 20 - greatest(a.y, c.y)) AS common, least(a.w, c.w) * 20 AS small FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND a.id < c.id)
SELECT l_orderkey, count(*) AS pairs, CAST(sum(common) AS BIGINT) AS common FROM p WHERE common > 0.5::DOUBLE * small GROUP BY 1""",
    "series_stats": f"""{_IVL}, x AS (SELECT key, (e - s) // {MINUTE} AS v, abs((e - s) // {MINUTE} - lag((e - s) // {MINUTE}) OVER (PARTITION BY key ORDER BY s, id)) AS d FROM ivl)
SELECT key, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, count(*) FILTER (d > 30) AS active FROM x GROUP BY 1""",
    "shared_parts": """WITH s AS (SELECT l_orderkey AS o_orderkey, list(DISTINCT l_suppkey) AS who FROM lineitem GROUP BY 1)
SELECT o_orderkey, coalesce(list_has_any(who, lag(who) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), false) AS shared FROM orders JOIN s USING (o_orderkey)""",
    "clean_values": """WITH r AS (SELECT event_id % 4 AS k, CAST(floor(value) AS BIGINT) AS v FROM events) SELECT k = 0 AS blank, k IN (1, 3) AS concrete, count(*) AS n, CAST(sum(v) FILTER (k = 1) AS BIGINT) AS total FROM r GROUP BY 1, 2""",
    "scaled_intervals": f"{_IVL} SELECT id, s * 2 // 3 AS s, e * 2 // 3 AS e FROM ivl",
}
