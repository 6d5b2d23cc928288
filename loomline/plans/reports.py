"""Reports and validators over users' events, orders as templates and plans, and documents as a library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import wording as wd
from loomline.operators import reports as rp
from loomline.operators.tables import durable
from loomline.plans.timeline import MINUTE, MONTH, WIDTH
from loomline.sources.driver_tables import EVENT_INTERVALS_SQL, event_intervals, table

HOUR, DAY = 60 * MINUTE, 24 * 60 * MINUTE
_IVL = f"WITH {EVENT_INTERVALS_SQL}"


def content_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose events pass as a programme: all nine conditions, story coverage among them."""
    rows = event_intervals(spark, sf_dir)
    n, some = F.count(F.lit(1)), lambda kind: F.count_if(F.col("kind") == kind)
    made = rows.groupBy("key").agg(
        F.max_by("kind", F.struct(F.col("e") - F.col("s"), "id")).alias("category"), some("purchase").alias("events"), (some("click") >= 12).alias("goal"), (F.max_by("kind", F.struct("s", "id")) != "error").alias("end"),
        (F.count_distinct(F.floor(F.col("s") / DAY)) / 30.0).alias("coverage"), (1 - some("error") / n).alias("clarity"), (1 - some("signup") / n).alias("confidence"),
        F.min(F.when(F.col("kind") == "purchase", F.col("s"))).alias("first"), F.max(F.when(F.col("kind") == "purchase", F.col("e"))).alias("last"),
    )
    row = {
        "eligible": F.when(F.col("key") % 9 != 0, F.col("key") % 8 != 0), "category": F.col("category"), "events": F.col("events"), "has_goal": F.col("goal"), "has_resolution": F.col("end"), "coverage": F.col("coverage"),
        "clarity": F.col("clarity"), "confidence": F.col("confidence"), "pure_sensory": F.when(F.col("key") % 7 != 0, F.lit(False)), "covered": wd.temporal_coverage(F.col("first"), F.col("last"), F.lit(MONTH)),
    }
    return made.select("key", rp.passes_content_gate(row, ("view", "click", "purchase")).alias("passes"))


def identity_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of parts from two votes on their names and a file title (X11)."""
    k, size = F.col("p_partkey"), F.col("p_size")
    a = {"title": F.col("p_name"), "confidence": size % 10 / 10.0, "recognised": size % 4 != 0}
    b = {"title": F.when(k % 3 == 0, F.concat(F.upper("p_name"), F.lit("!"))).when(k % 3 == 1, F.col("p_brand")).otherwise(F.col("p_name")), "confidence": k % 10 / 10.0, "recognised": size % 6 != 0}
    meta = F.when(k % 5 == 0, "").when(k % 5 == 1, F.concat("p_name", F.lit(".4K"))).when(k % 5 == 2, "山 林间小路2 2019.4K").when(k % 5 == 3, F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", rp.identity_tier(a, b, meta).alias("tier"), rp.title_from_file(meta).alias("title"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.create_map(*(F.lit(x) for x in ("A", "setup", "N", "twist", "R", "ending"))), F.col("l_returnflag"))
    idx = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", idx.cast("long").alias("idx"), role.alias("role"), F.col("l_quantity").cast("long").alias("length"), "l_linestatus", "l_partkey")


def template_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How fit each order is as a template, its lines being segments (A3)."""
    rows = _segments(spark, sf_dir)
    made = rows.groupBy("l_orderkey").agg(F.floor(F.sum("length") / 4).alias("duration"), F.count_if(F.col("l_linestatus") == "F").alias("fixed"), F.count_if(F.col("l_linestatus") == "O").alias("replaceable"))
    return rp.template_suitability(made.withColumn("parsed", F.col("l_orderkey") % 4 != 0), rows, "l_orderkey", 6)


def template_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What orders as templates have in common (A3)."""
    rows, parts = _segments(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit(" "), F.upper("p_name")).alias("element"))
    return rp.template_report(rows, rows.join(parts, "l_partkey").select("l_orderkey", "idx", "element"), "l_orderkey")


def library_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the documents hold: rows, sources, lengths, and forty of them."""
    docs = table(spark, sf_dir, "documents")
    return rp.library_summary(docs.select(F.col("doc_id").alias("id"), "source", F.col("n_chars").alias("length"), F.when(F.col("doc_id") % 5 != 0, F.substring("text", 1, 20)).alias("caption")))


ARMS = {"A": "view", "B": "click", "C": "purchase"}


def _arms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = event_intervals(spark, sf_dir)
    arm = F.element_at(F.create_map(*(F.lit(x) for a, k in ARMS.items() for x in (k, a))), F.col("kind"))
    truth = rows.where("kind = 'error'").select("key", F.col("id").alias("t"), F.col("s").alias("s2"), F.col("e").alias("e2"), (F.col("id") % 3).alias("goal"))
    return rows.withColumn("arm", arm).where("arm IS NOT NULL").select("arm", "key", "id", "s", "e"), truth


def browse_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views, clicks and purchases as three arms that look for errors."""
    found, truth = _arms(spark, sf_dir)
    return rp.browse_arms(found, truth, ["key"], list(ARMS), 90 * MINUTE, WIDTH)


def goal_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of each arm for each kind of error."""
    found, truth = _arms(spark, sf_dir)
    return rp.goal_recall(found, truth, ["key"], WIDTH)


def _plan_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, k = _segments(spark, sf_dir), F.col("l_partkey")
    roles = F.array(*map(F.lit, rp.ARC_ROLES))
    status = F.when(k % 5 == 0, "unsupported").when(k % 7 == 0, "uncertain").when(k % 41 == 0, "lost").otherwise("supported")
    return rows.select("l_orderkey", "idx", status.alias("status"), F.get(roles, ((F.col("idx") - 1 + F.when(k % 11 == 0, 3).otherwise(0)) % 8).cast("int")).alias("role"), (k % 3).alias("source"), k.alias("s"),
        (k + F.col("length")).alias("e"), (k % 40).alias("target"), F.when(k % 7 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k % 4, k % 6)).alias("entities"))


def preflight_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of orders read as story plans, all six kinds."""
    slots = _plan_slots(spark, sf_dir)
    lines = slots.where("s % 2 = 0").select("l_orderkey", "idx", (F.col("s") + F.col("s") % 10 - 1).alias("line_s"), (F.col("s") + F.col("s") % 50).alias("line_e"))
    return rp.preflight_faults(slots, lines, ["l_orderkey"])


def plan_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that orders read as story plans break."""
    rows = _plan_slots(spark, sf_dir).withColumn("end", F.sum(F.col("e") - F.col("s")).over(Window.partitionBy("l_orderkey").orderBy("idx")))
    k = F.col("s")
    slots = rows.select("l_orderkey", F.when(k % 53 == 0, F.col("idx")).otherwise(F.col("idx") - 1).alias("slot"), "role", "status", (F.col("end") - (F.col("e") - k) + F.when(k % 13 == 0, 1).otherwise(0)).alias("s"), F.col("end").alias("e"),
        F.when(k % 17 != 0, F.col("source").cast("string")).alias("source"), k.alias("source_s"), F.when(k % 19 == 0, k).otherwise(F.col("e")).alias("source_e"), F.when(k % 23 == 0, "unexplained").otherwise("cut").alias("transition"))
    plans = rows.groupBy("l_orderkey").agg((F.max("end") + F.max(F.when(k % 29 == 0, 2).otherwise(0))).alias("duration"))
    return rp.plan_violations(plans, slots, "l_orderkey", 10, 200, 0)


def template_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors and warnings of users' views and clicks read as templates, purchases being their cuts, sign-ups their beats and errors the known ones."""
    rows = event_intervals(spark, sf_dir)
    templates = rows.groupBy("key").agg((F.max("s") - 12 * HOUR).alias("duration"))
    segments = rows.where("kind IN ('view', 'click')").select("key", "id", (F.col("s") - F.when(F.col("id") % 31 == 0, 40 * DAY).otherwise(0)).alias("s"), "e", F.when(F.col("key") % 5 == 0, "setup").otherwise(F.col("kind")).alias("role"))
    points = lambda kind, name: rows.where(F.col("kind") == kind).select("key", "id", F.col("s").alias(name))
    return rp.template_violations(templates, segments, points("purchase", "t"), points("signup", "t"), points("error", "t2"), "key", 36 * HOUR, ("view", "setup"))


def recipe_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that orders read as edit recipes break: suppliers are assets, ship-flag tracks, lines operations that depend on the line before."""
    rows, k = durable(_segments(spark, sf_dir), "recipe-lines"), F.col("l_partkey")
    text = lambda c: c.cast("string")
    recipes = rows.groupBy("l_orderkey").agg(F.sum("length").alias("duration"), F.min("l_partkey").alias("k"))
    recipes = recipes.select("l_orderkey", "duration", F.when(F.col("k") % 61 != 0, F.col("k") % 59).alias("fps"), F.when(F.col("k") % 7 != 0, F.sha2(text(F.col("k")), 256)).otherwise("ab").alias("digest"))
    assets = rows.where("idx <= 2").select("l_orderkey", F.concat(F.lit("a"), text(k % 5)).alias("id"), F.when(k % 31 != 0, F.lit("file")).alias("uri"), F.when(k % 3 != 0, k % 11).alias("s"), F.when(k % 3 != 0, k % 13).alias("e"))
    tracks = rows.where("idx <> 1").select("l_orderkey", F.col("l_linestatus").alias("id"), F.when(k % 17 == 0, "smoke").otherwise("video").alias("type"), F.when(k % 19 != 0, F.col("idx")).alias("z")).dropDuplicates(["l_orderkey", "id", "type", "z"])
    operations = rows.select(
        "l_orderkey", F.concat(F.lit("o"), text(F.when(k % 43 == 0, 1).otherwise(F.col("idx")))).alias("id"), "role", F.when(k % 5 == 0, "uncertain").when(k % 41 == 0, "lost").otherwise("supported").alias("status"), (k % 9 - 1).alias("s"),
        (k % 9 - 1 + k % 4).alias("e"), F.col("l_linestatus").alias("track"), (k % 23 / 20.0).alias("confidence"), F.when(k % 6 == 0, F.array().cast("array<string>")).when(k % 11 == 0, F.array(F.lit(""))).otherwise(F.array(F.lit("frame"))).alias("evidence"),
        F.array(F.concat(F.lit("a"), text(k % 5))).alias("inputs"), F.when(F.col("idx") > 1, F.array(F.concat(F.lit("o"), text(F.when(k % 3 == 0, F.col("idx") + 1).otherwise(F.col("idx") - 1))))).otherwise(F.array().cast("array<string>")).alias("depends"),
    ).withColumnRenamed("role", "type")
    return rp.recipe_violations(recipes, assets, tracks, operations, "l_orderkey", ("setup", "twist"), ("twist",), ("video",))


def percentile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ninetieth percentile of event values by user, by five rules."""
    rows = event_intervals(spark, sf_dir).select("key", F.floor((F.col("e") - F.col("s")) / MINUTE).alias("v"))
    got = rp.percentiles(rows, ["key"], "v", 90)
    return got.select("key", "even", "floor", "upper", F.round("linear", 6).alias("linear"), "ceil")


def grid_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences between neighbouring vectors of a label, read as frames of eight by eight, over all and by quarters."""
    rows = table(spark, sf_dir, "embeddings").withColumn("v", F.transform("embedding", lambda x: F.floor(x * 1000).cast("double")))
    before = rows.withColumn("before", F.lag("v").over(Window.partitionBy("label").orderBy("vec_id"))).where("before IS NOT NULL")
    whole, cells = rp.grid_difference(F.col("before"), F.col("v"), 8, 2, 2, 8)
    return before.select("vec_id", whole.alias("whole"), F.concat_ws(",", F.transform(cells, lambda x: F.format_string("%.4f", x))).alias("cells"))


QUERIES = {
    f.__name__: f
    for f in (
        content_gates, identity_tiers, template_fit, template_report, library_summary, browse_arms, goal_recall, preflight_faults, plan_violations, template_violations, recipe_violations, percentile_rules,
        grid_differences,
    )
}

_SEG = """seg AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS idx,
 CASE l_returnflag WHEN 'A' THEN 'setup' WHEN 'N' THEN 'twist' ELSE 'ending' END AS role, CAST(l_quantity AS BIGINT) AS length, l_linestatus, l_partkey FROM lineitem),
tpl AS (SELECT l_orderkey, string_agg(role, '→' ORDER BY idx) AS seq, count(*) AS n, CAST(sum(length) AS BIGINT) AS total, min(idx) FILTER (role = 'twist') - 1 AS twist FROM seg GROUP BY 1)"""
_SLOTS = f"""{_SEG}, pl AS (SELECT l_orderkey, idx, CASE WHEN l_partkey % 5 = 0 THEN 'unsupported' WHEN l_partkey % 7 = 0 THEN 'uncertain' WHEN l_partkey % 41 = 0 THEN 'lost' ELSE 'supported' END AS status,
 {list(rp.ARC_ROLES)}[(idx - 1 + CASE WHEN l_partkey % 11 = 0 THEN 3 ELSE 0 END) % 8 + 1] AS role, l_partkey % 3 AS source, l_partkey AS s, l_partkey + length AS e, l_partkey % 40 AS target,
 CASE WHEN l_partkey % 7 = 0 THEN [] ELSE [l_partkey % 4, l_partkey % 6] END AS en FROM seg)"""
_NORM = "regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _agree(a: str, b: str) -> str:
    x, y = _NORM.format(a), _NORM.format(b)
    return f"({x} <> '' AND {y} <> '' AND (contains({x}, {y}) OR contains({y}, {x})))"


def _rule(rows: str, name: str, condition: str, where: str = "true") -> str:
    return f"SELECT key, '{name}' AS violation, count(*) AS n FROM {rows} WHERE {where} AND ({condition}) GROUP BY key"


ORACLE_SQL = {
    "content_gates": f"""{_IVL}, g AS (SELECT key, arg_max(kind, (e - s, id)) AS category, count(*) FILTER (kind = 'purchase') AS ev, count(*) FILTER (kind = 'click') >= 12 AS goal, arg_max(kind, (s, id)) <> 'error' AS fin, count(DISTINCT s // {DAY}) / 30.0::DOUBLE AS cov,
 1 - count(*) FILTER (kind = 'error') / count(*)::DOUBLE AS clarity, 1 - count(*) FILTER (kind = 'signup') / count(*)::DOUBLE AS conf, min(s) FILTER (kind = 'purchase') AS a, max(e) FILTER (kind = 'purchase') AS z FROM ivl GROUP BY key)
SELECT key, coalesce((key % 9 = 0 OR key % 8 <> 0) AND category IN ('view', 'click', 'purchase') AND ev >= 3 AND goal AND fin AND cov >= 0.8::DOUBLE AND clarity >= 0.7::DOUBLE AND conf >= 0.65::DOUBLE AND key % 7 <> 0 AND a * 10 <= {MONTH} * 3 AND z * 10 >= {MONTH} * 7 AND (z - a) * 2 >= {MONTH}, false) AS passes FROM g""",
    "identity_tiers": f"""WITH p AS (SELECT p_partkey AS k, p_name AS ta, p_size % 10 / 10.0::DOUBLE AS ca, p_size % 4 <> 0 AND p_name <> '' AS va, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) || '!' WHEN 1 THEN p_brand ELSE p_name END AS tb, p_partkey % 10 / 10.0::DOUBLE AS cb, p_size % 6 <> 0 AS vb,
 CASE p_partkey % 5 WHEN 1 THEN p_name || '.4K' WHEN 2 THEN '山 林间小路2 2019.4K' WHEN 3 THEN p_brand ELSE '' END AS m FROM part),
q AS (SELECT *, {_agree("ta", "tb")} AS same, (va AND {_agree("ta", "m")}) OR (vb AND {_agree("tb", "m")}) AS hit FROM p)
SELECT k AS p_partkey, CASE WHEN m <> '' AND (va OR vb) AND NOT hit AND NOT (va AND ca < 0.4::DOUBLE) AND NOT (vb AND cb < 0.4::DOUBLE) THEN 'identity_conflict' WHEN same AND (ca + cb) / 2 >= 0.85::DOUBLE THEN 'model_prior' WHEN hit AND m <> '' THEN 'model_prior'
 WHEN NOT va AND NOT vb AND k % 5 = 2 THEN 'metadata_prior' WHEN (same AND (ca + cb) / 2 >= 0.4::DOUBLE) OR greatest(ca, cb) >= 0.7::DOUBLE THEN 'search' ELSE 'unknown' END AS tier, CASE WHEN k % 5 = 2 THEN '林间小路2' ELSE '' END AS title FROM q""",
    "template_fit": f"""WITH {_SEG}, d AS (SELECT l_orderkey, sum(length) // 4 AS duration, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linestatus = 'O') AS o FROM seg GROUP BY 1),
u AS (SELECT l_orderkey, sum(length) AS upto FROM seg JOIN tpl USING (l_orderkey) WHERE idx <= twist + 1 GROUP BY 1),
x AS (SELECT l_orderkey, seq, row_number() OVER (PARTITION BY seq ORDER BY l_orderkey) / (SELECT count(*) FROM d)::DOUBLE AS freq, CASE WHEN duration > 0 AND upto / duration::DOUBLE <= 0.6::DOUBLE THEN 1.0::DOUBLE ELSE 0.0 END AS early, CASE WHEN duration BETWEEN 8 AND 35 THEN 1.0::DOUBLE ELSE 0.0 END AS fit,
 o / (o + f)::DOUBLE AS ratio, CASE WHEN l_orderkey % 4 <> 0 THEN 1.0::DOUBLE ELSE 0.0 END AS ok FROM d JOIN tpl USING (l_orderkey) LEFT JOIN u USING (l_orderkey))
SELECT l_orderkey, seq, round(0.3::DOUBLE * freq + 0.2::DOUBLE * early + 0.2::DOUBLE * fit + 0.2::DOUBLE * ratio + 0.1::DOUBLE * ok, 6) AS score, round(freq, 6) AS seq_freq, early AS early_twist, fit AS duration_fit, round(ratio, 6) AS replaceable_share FROM x""",
    "template_report": f"""WITH {_SEG}, e AS (SELECT lower(p_name) AS item, count(*) AS n, min((l_orderkey, idx)) AS first FROM seg JOIN part ON p_partkey = l_partkey GROUP BY 1), q AS (SELECT lower(seq) AS item, count(*) AS n, min(l_orderkey) AS first FROM tpl GROUP BY 1)
SELECT 'element' AS part, item, n::DOUBLE AS value, row_number() OVER (ORDER BY n DESC, first) AS place FROM e QUALIFY place <= 15
UNION ALL SELECT 'sequence', item, n::DOUBLE, row_number() OVER (ORDER BY n DESC, first) AS place FROM q QUALIFY place <= 10
UNION ALL SELECT 'role', role, count(*)::DOUBLE, NULL FROM seg GROUP BY role
UNION ALL SELECT 'segments', 'mean', round(avg(n), 6), NULL FROM tpl UNION ALL SELECT 'segments', 'min', min(n)::DOUBLE, NULL FROM tpl UNION ALL SELECT 'segments', 'max', max(n)::DOUBLE, NULL FROM tpl
UNION ALL SELECT 'segments', 'twist', round(avg(twist / n::DOUBLE), 6), NULL FROM tpl""",
    "library_summary": """WITH n AS (SELECT count(*) AS n, count(DISTINCT source) AS sources, list(n_chars ORDER BY n_chars) AS l FROM documents), c AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS m FROM documents WHERE doc_id % 5 <> 0 AND substring(text, 1, 20) <> '')
SELECT 'rows' AS part, 0::BIGINT AS place, n AS value FROM n UNION ALL SELECT 'sources', 0, sources FROM n UNION ALL SELECT 'p50', 0, l[least(n - 1, n * 50 // 100) + 1] FROM n UNION ALL SELECT 'p90', 0, l[least(n - 1, n * 90 // 100) + 1] FROM n
UNION ALL SELECT 'sample', pos // greatest(1, m // 40), doc_id FROM c WHERE pos % greatest(1, m // 40) = 0 AND pos // greatest(1, m // 40) < 40""",
    "browse_arms": f"""{_IVL}, c AS (SELECT CASE kind WHEN 'view' THEN 'A' WHEN 'click' THEN 'B' ELSE 'C' END AS arm, key, id, s, e FROM ivl WHERE kind IN ('view', 'click', 'purchase')),
m AS (SELECT arm, CASE WHEN s <= max(e) OVER (PARTITION BY arm, key ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {90 * MINUTE} THEN 0 ELSE 1 END AS new FROM c),
u AS (SELECT arm, count(*) AS candidates, CAST(sum(new) AS BIGINT) AS "unique" FROM m GROUP BY arm),
h AS (SELECT arm, count(DISTINCT t.id) AS hits FROM c JOIN ivl t ON t.key = c.key AND t.kind = 'error' AND least(c.e, t.e) > greatest(c.s, t.s) GROUP BY arm),
r AS (SELECT arm, candidates, "unique", round(1 - "unique" / candidates::DOUBLE, 6) AS duplicate_rate, round(coalesce(hits, 0) / (SELECT count(*) FROM ivl WHERE kind = 'error')::DOUBLE, 6) AS recall FROM u LEFT JOIN h USING (arm)),
d AS (SELECT max(recall) FILTER (arm = 'A') AS a, max(recall) FILTER (arm = 'B') AS b, max(recall) FILTER (arm = 'C') AS c FROM r)
SELECT r.*, CASE WHEN a = b AND b = c THEN CASE WHEN a >= 0.8 THEN 'cheapest arm suffices' ELSE 'shared bottleneck' END WHEN b > a THEN 'sampling bottleneck' WHEN c > b THEN 'compression bottleneck' ELSE 'mixed bottleneck' END AS diagnosis FROM r, d""",
    "goal_recall": f"""{_IVL}, c AS (SELECT CASE kind WHEN 'view' THEN 'A' WHEN 'click' THEN 'B' ELSE 'C' END AS arm, * FROM ivl WHERE kind IN ('view', 'click', 'purchase')), t AS (SELECT *, id % 3 AS goal FROM ivl WHERE kind = 'error'),
n AS (SELECT goal, count(*) AS n FROM t GROUP BY goal), h AS (SELECT arm, goal, count(DISTINCT t.id) AS hits FROM c JOIN t ON t.key = c.key AND least(c.e, t.e) > greatest(c.s, t.s) GROUP BY 1, 2)
SELECT arm, goal, round(coalesce(hits, 0) / n::DOUBLE, 6) AS recall FROM (SELECT DISTINCT arm FROM c) CROSS JOIN n LEFT JOIN h USING (arm, goal)""",
    "preflight_faults": f"""WITH {_SLOTS}, g AS (SELECT *, lag(en) OVER w AS pe, lag(source) OVER w AS ps, lag(s) OVER w AS pt FROM pl WHERE status = 'supported' WINDOW w AS (PARTITION BY l_orderkey ORDER BY idx)),
l AS (SELECT l_orderkey, idx, s, e, target, s + s % 10 - 1 AS a, s + s % 50 AS z FROM pl WHERE s % 2 = 0),
p AS (SELECT l_orderkey, bool_or(status = 'supported' AND role = 'resolution') AS fin, bool_or(status = 'supported' AND role = 'conflict') AS con, bool_or(status = 'supported' AND role IN ('context', 'choice')) AS cause FROM pl GROUP BY 1),
f AS (SELECT l_orderkey, idx, 'entity switch' AS fault FROM g WHERE len(pe) > 0 AND len(en) > 0 AND NOT list_has_any(pe, en) UNION ALL SELECT l_orderkey, idx, 'causal order' FROM g WHERE source = ps AND s < pt
UNION ALL SELECT l_orderkey, NULL, 'missing resolution' FROM p WHERE NOT coalesce(fin, false) UNION ALL SELECT l_orderkey, NULL, 'missing cause' FROM p WHERE con AND NOT coalesce(cause, false)
UNION ALL SELECT l_orderkey, idx, 'subtitle timing' FROM l WHERE z <= s OR a < s OR z > e UNION ALL SELECT l_orderkey, idx, 'dialogue cut' FROM l WHERE z - s > target)
SELECT l_orderkey, idx, fault, count(*) AS n FROM f GROUP BY 1, 2, 3""",
    "plan_violations": f"""WITH {_SLOTS}, c AS (SELECT *, sum(e - s) OVER (PARTITION BY l_orderkey ORDER BY idx) AS fin FROM pl),
d AS (SELECT l_orderkey, max(fin) + max(CASE WHEN s % 29 = 0 THEN 2 ELSE 0 END) AS duration FROM c GROUP BY 1),
x AS (SELECT l_orderkey, CASE WHEN s % 53 = 0 THEN idx ELSE idx - 1 END AS slot, list_position({list(rp.ARC_ROLES)}, role) AS ro, status, fin - (e - s) + CASE WHEN s % 13 = 0 THEN 1 ELSE 0 END AS a, fin AS z, s % 17 = 0 AS nosrc, s % 19 = 0 AS noivl, s % 23 = 0 AS unex, duration, idx FROM c JOIN d USING (l_orderkey)),
y AS (SELECT *, row_number() OVER w - 1 AS n, coalesce(lag(z) OVER w, 0) AS pz, last_value(ro IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY slot, a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pr FROM x WINDOW w AS (PARTITION BY l_orderkey ORDER BY slot, a, z)),
b AS (SELECT l_orderkey, arg_max(z, (slot, z)) AS fin, any_value(duration) AS duration FROM y GROUP BY 1)
SELECT l_orderkey, slot, unnest(list_filter([CASE WHEN slot <> n THEN 'slot number' END, CASE WHEN ro IS NULL THEN 'role' END, CASE WHEN ro < pr THEN 'role order' END, CASE WHEN a <> pz OR z <= a OR z > duration THEN 'not continuous' END, CASE WHEN status = 'lost' THEN 'status' END,
 CASE WHEN status = 'supported' AND nosrc THEN 'no source' END, CASE WHEN status = 'supported' AND noivl THEN 'source interval' END, CASE WHEN status = 'supported' AND unex THEN 'unexplained' END], lambda q: q IS NOT NULL)) AS violation FROM y
UNION ALL SELECT l_orderkey, NULL, 'duration' FROM d WHERE NOT duration BETWEEN 10 AND 200 UNION ALL SELECT l_orderkey, NULL, 'no full cover' FROM b WHERE fin <> duration""",
    "template_violations": f"""{_IVL}, t AS (SELECT key, max(s) - {12 * HOUR} AS d FROM ivl GROUP BY key), r AS (SELECT i.key, id, s - CASE WHEN id % 31 = 0 THEN {40 * DAY} ELSE 0 END AS s, e, CASE WHEN i.key % 5 = 0 THEN 'setup' ELSE kind END AS role, d FROM ivl i JOIN t USING (key) WHERE kind IN ('view', 'click')),
v AS (SELECT *, s >= 0 AND s <= d + {18 * HOUR} AND e > s AND e <= d + {18 * HOUR} AS ok FROM r), g AS (SELECT *, lag(e) OVER (PARTITION BY key ORDER BY s, id) AS b FROM v WHERE ok),
x AS (SELECT g.key, g.id, min(abs(g.s - p.s)) AS far FROM g JOIN ivl p ON p.key = g.key AND p.kind = 'purchase' GROUP BY 1, 2), z AS (SELECT key, arg_max(e, (s, id)) AS fin, any_value(d) AS d FROM g GROUP BY key),
c AS (SELECT key, count(*) AS n, count(DISTINCT role) AS k, min(role) AS role, any_value(d) AS d FROM v GROUP BY key), bt AS (SELECT a.key, a.id, min(abs(a.s - p.s)) AS far FROM ivl a LEFT JOIN ivl p ON p.key = a.key AND p.kind = 'error' WHERE a.kind = 'signup' GROUP BY 1, 2)
{_rule("v", "interval", "NOT ok")} UNION ALL {_rule("g", "overlap", f"s < b - {36 * HOUR // 100}")} UNION ALL {_rule("g", "role", "role NOT IN ('view', 'setup')")} UNION ALL {_rule("x", "far from an edge", f"far > {18 * HOUR}")} UNION ALL {_rule("g", "gap", f"s - b > {18 * HOUR}")}
UNION ALL {_rule("z", "tail", f"d - fin > {36 * HOUR}")} UNION ALL {_rule("c", "not divided", f"d > {216 * HOUR} AND n < 3")} UNION ALL {_rule("c", "one role", f"d > {216 * HOUR} AND k = 1 AND role IN ('setup', 'other')")} UNION ALL {_rule("bt", "beat", f"coalesce(far > {36 * HOUR // 20}, true)")}""",
    "recipe_violations": f"""WITH RECURSIVE {_SEG}, rc AS (SELECT l_orderkey, sum(length) AS duration, min(l_partkey) AS k FROM seg GROUP BY 1),
a AS (SELECT l_orderkey, 'a' || l_partkey % 5 AS id, l_partkey AS k FROM seg WHERE idx <= 2), t AS (SELECT DISTINCT l_orderkey, l_linestatus AS id, l_partkey % 17 = 0 AS bad, CASE WHEN l_partkey % 19 <> 0 THEN idx END AS z FROM seg WHERE idx <> 1),
o AS (SELECT l_orderkey, 'o' || CASE WHEN l_partkey % 43 = 0 THEN 1 ELSE idx END AS id, idx, role, l_partkey AS k, l_linestatus AS track, CASE WHEN l_partkey % 5 = 0 THEN 'uncertain' WHEN l_partkey % 41 = 0 THEN 'lost' ELSE 'supported' END AS status,
 'a' || l_partkey % 5 AS input, CASE WHEN idx > 1 THEN 'o' || CASE WHEN l_partkey % 3 = 0 THEN idx + 1 ELSE idx - 1 END END AS dep FROM seg),
ed AS (SELECT DISTINCT l_orderkey, id AS x, dep AS y FROM o WHERE dep IS NOT NULL AND (l_orderkey, dep) IN (SELECT (l_orderkey, id) FROM o)), reach AS (SELECT * FROM ed UNION SELECT r.l_orderkey, r.x, e.y FROM reach r JOIN ed e ON e.l_orderkey = r.l_orderkey AND e.x = r.y),
v AS (SELECT l_orderkey, 'recipe' AS part, NULL AS id, unnest([CASE WHEN k % 61 = 0 OR k % 59 = 0 THEN 'fps' END, CASE WHEN k % 7 = 0 THEN 'digest' END]) AS violation FROM rc
UNION ALL SELECT l_orderkey, 'asset', id, unnest([CASE WHEN k % 31 = 0 THEN 'no uri' END, CASE WHEN k % 3 <> 0 AND k % 13 <= k % 11 THEN 'range' END]) FROM a
UNION ALL SELECT l_orderkey, 'track', id, unnest([CASE WHEN bad THEN 'type' END, CASE WHEN z IS NULL THEN 'no order' END]) FROM t
UNION ALL SELECT o.l_orderkey, 'operation', id, unnest([CASE WHEN role = 'ending' THEN 'type' END, CASE WHEN status = 'lost' THEN 'status' END, CASE WHEN o.k % 9 < 1 OR o.k % 9 - 1 + o.k % 4 > duration THEN 'outside' END, CASE WHEN o.k % 4 = 0 AND role <> 'twist' THEN 'no length' END,
 CASE WHEN o.k % 23 > 20 THEN 'confidence' END, CASE WHEN status = 'supported' AND o.k % 6 = 0 THEN 'no evidence' END, CASE WHEN o.k % 6 <> 0 AND o.k % 11 = 0 THEN 'no source' END]) FROM o JOIN rc USING (l_orderkey)
UNION ALL SELECT l_orderkey, 'recipe', NULL, 'no tracks' FROM rc WHERE l_orderkey NOT IN (SELECT l_orderkey FROM t)
UNION ALL SELECT l_orderkey, 'asset', id, 'repeated id' FROM a GROUP BY 1, 3 HAVING count(*) > 1 UNION ALL SELECT l_orderkey, 'track', id, 'repeated id' FROM t GROUP BY 1, 3 HAVING count(*) > 1 UNION ALL SELECT l_orderkey, 'operation', id, 'repeated id' FROM o GROUP BY 1, 3 HAVING count(*) > 1
UNION ALL SELECT l_orderkey, 'operation', id, 'unknown track' FROM o WHERE (l_orderkey, track) NOT IN (SELECT (l_orderkey, id) FROM t)
UNION ALL SELECT l_orderkey, 'operation', id, 'unknown input' FROM o WHERE (l_orderkey, input) NOT IN (SELECT (l_orderkey, id) FROM a)
UNION ALL SELECT l_orderkey, 'operation', id, 'unknown dependency' FROM o WHERE dep IS NOT NULL AND (l_orderkey, dep) NOT IN (SELECT (l_orderkey, id) FROM o)
UNION ALL SELECT l_orderkey, 'operation', x, 'cycle' FROM reach WHERE x = y)
SELECT l_orderkey, part, id, violation, count(*) AS n FROM v WHERE violation IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "percentile_rules": f"""{_IVL}, g AS (SELECT key, list(v ORDER BY v) AS l, count(*) AS n FROM (SELECT key, (e - s) // {MINUTE} AS v FROM ivl) GROUP BY key)
SELECT key, l[CAST(round_even((n - 1) * 0.9::DOUBLE, 0) AS BIGINT) + 1] AS even, l[least(n - 1, n * 90 // 100) + 1] AS floor, l[n // 2 + 1] AS upper, round(l[(n - 1) * 90 // 100 + 1] + (l[least(n - 1, (n - 1) * 90 // 100 + 1) + 1] - l[(n - 1) * 90 // 100 + 1]) * ((n - 1) * 0.9::DOUBLE - (n - 1) * 90 // 100), 6) AS linear,
 l[greatest(0, CAST(ceil(n * 90 / 100.0::DOUBLE) AS BIGINT) - 1) + 1] AS ceil FROM g""",
    "grid_differences": """WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 1000)) AS v FROM embeddings), b AS (SELECT *, lag(v) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM v),
d AS (SELECT vec_id, list_transform(range(1, 65), lambda i: abs(v[i] - b[i])) AS d FROM b WHERE b IS NOT NULL),
c AS (SELECT vec_id, d, list_transform(range(4), lambda k: list_sum(list_filter(d, lambda x, i: (i - 1) // 32 * 2 + (i - 1) % 8 // 4 = k)) / 16) AS c FROM d)
SELECT vec_id, list_sum(d) / 64 AS whole, array_to_string(list_transform(c, lambda x: printf('%.4f', x)), ',') AS cells FROM c""",
}
