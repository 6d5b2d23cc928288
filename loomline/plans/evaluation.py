"""Evaluation statistics and lineage graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import evaluation as el
from loomline.operators import lineage as li
from loomline.sources.driver_tables import EVENT_INTERVALS_SQL, event_intervals, table

HOUR = 3_600_000_000


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", (F.col("n_chars") >= 500).cast("int").alias("pred"))
    return table(spark, sf_dir, "labels").join(docs, "doc_id")


def recipe_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views matched to clicks of a user within an hour, one to one: counts by user."""
    ivl = event_intervals(spark, sf_dir)
    truth = ivl.where("kind = 'view'").select("key", F.col("id").alias("t_id"), F.col("s").alias("t"))
    pred = ivl.where("kind = 'click'").select("key", F.col("id").alias("p_id"), F.col("s").alias("p"))
    pairs = el.greedy_match(truth, pred, ["key"], HOUR)
    n = truth.groupBy("key").agg(F.count(F.lit(1)).alias("truths"))
    hit = pairs.groupBy("key").agg(F.count(F.lit(1)).alias("matched"))
    return n.join(hit, "key", "left").select("key", "truths", F.coalesce("matched", F.lit(0)).alias("matched"))


def classifier_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of long texts as a sign of quality, by language."""
    both = _labelled(spark, sf_dir).groupBy("lang").agg(
        F.count_if((F.col("quality") == 1) & (F.col("pred") == 1)).alias("tp"), F.count_if(F.col("quality") == 1).alias("truth"), F.count_if(F.col("pred") == 1).alias("said")
    )
    p, r, f1 = el.precision_recall(F.col("tp"), F.col("truth"), F.col("said"))
    return both.select("lang", "tp", F.round(p, 9).alias("precision"), F.round(r, 9).alias("recall"), F.round(f1, 9).alias("f1"))


def stratified_design(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight documents of each (quality, toxic) stratum by hash order, with weights."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return el.stratified_sample(labels, ["quality", "toxic"], "doc_id", 8).select("doc_id", "draw", "weight")


def _sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir).withColumn("den", F.col("quality")).withColumn("num", F.col("quality") * F.col("pred"))
    return el.stratified_sample(rows, ["quality", "toxic"], "doc_id", 40)


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratio, n_eff = el.weighted_ratio("num", "den", "weight")
    return _sampled(spark, sf_dir).agg(ratio.alias("ratio"), n_eff.alias("n_eff"))


def weighted_ratio_kish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted recall of the sample and Kish's effective number."""
    return _rates(spark, sf_dir).select(F.round("ratio", 6).alias("ratio"), F.round("n_eff", 6).alias("n_eff"))


def wilson_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wilson's interval of the weighted recall."""
    low, high = el.wilson(F.col("ratio"), F.col("n_eff"))
    return _rates(spark, sf_dir).select(F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def three_state_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the recall by language is shown to reach .8."""
    rows = _labelled(spark, sf_dir).where("quality = 1").groupBy("lang").agg(F.avg(F.col("pred").cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))
    low, high = el.wilson(F.col("p"), F.col("n"))
    return rows.select("lang", el.three_state(low, high, 0.8, F.lit(0)).alias("state"))


def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of the share of long texts among good ones, by toxicity, toxic ones weighing more."""
    rows = _labelled(spark, sf_dir).where("quality = 1")
    rows = rows.select(F.col("doc_id").alias("id"), F.col("toxic").alias("stratum"), (1 + F.col("toxic")).cast("double").alias("weight"), F.col("pred").alias("num"), F.lit(1).alias("den"))
    return el.bootstrap_interval(rows).select(*(F.round(c, 6).alias(c) for c in ("estimate", "low", "high")))


def ablation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether dropping short texts helps each language: gain in precision or fewer rows."""
    rows = _labelled(spark, sf_dir).groupBy("lang").agg(
        F.avg(F.col("quality").cast("double")).alias("base"), F.avg(F.when(F.col("pred") == 1, F.col("quality").cast("double"))).alias("kept"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == 1).alias("m")
    )
    return rows.select("lang", el.ablation_gate(F.col("kept") - F.col("base"), F.col("base") - F.col("kept"), F.col("m"), F.col("n")).alias("passes"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers lead to nations, nations to regions, suppliers to nations; node names carry their kind."""
    nation = table(spark, sf_dir, "nation")
    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    a = nation.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
    b = table(spark, sf_dir, "supplier").select(name("n", "s_nationkey").alias("src"), name("s", "s_suppkey").alias("dst"))
    return a.unionByName(b)


EDGES_SQL = """edges AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier)"""


def downstream_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything downstream of the regions, with its distance."""
    seeds = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("node"))
    return li.closure(_edges(spark, sf_dir), seeds).select("seed", "node", F.col("steps").cast("long").alias("steps"))


def effective_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of each node when nations with a number divisible by seven are drafts."""
    edges = _edges(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    number = F.substring("node", 2, 20).cast("int")
    versions = nodes.withColumn("status", F.when(F.col("node").startswith("n") & (number % 7 == 0), "draft").otherwise("committed"))
    return li.effective_status(versions, edges.select(F.col("dst").alias("node"), F.col("src").alias("upstream"))).select("node", "effective")


def cycle_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes on cycles once supplier 1 is made to lead back to its region's first nation (G1)."""
    edges = _edges(spark, sf_dir)
    back = edges.where("dst = 's1'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return li.on_cycle(edges.unionByName(back))


def claim_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one customer and priority that say opposite things about being open."""
    claims = table(spark, sf_dir, "orders").where("o_orderstatus IN ('O', 'F')").select(
        F.col("o_custkey").alias("c"), F.col("o_orderpriority").alias("p"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("polarity"), F.lit(True).alias("active")
    )
    return li.conflict_counts(claims, ["c", "p"])


def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest order of each customer."""
    log = table(spark, sf_dir, "orders")
    return li.latest_versions(log, "o_custkey", F.struct("o_orderdate", "o_orderkey")).select("o_custkey", "o_orderkey")


QUERIES = {
    f.__name__: f
    for f in (
        recipe_accuracy, classifier_rates, stratified_design, weighted_ratio_kish, wilson_ci, three_state_gate, bootstrap_ci, ablation_gate,
        downstream_invalidation, effective_status, cycle_check, claim_conflicts, latest_versions,
    )
}

_LAB = "WITH lab AS (SELECT l.doc_id, quality, toxic, lang, CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END AS pred FROM labels l JOIN documents d USING (doc_id))"
_DRAWN = f"""{_LAB}, drawn AS (SELECT *, quality AS den, quality * pred AS num, row_number() OVER (PARTITION BY quality, toxic ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS draw, count(*) OVER (PARTITION BY quality, toxic) AS size FROM lab),
w AS (SELECT *, size / least(40, size) AS weight FROM drawn WHERE draw <= 40)"""
_SAMPLE = f"""{_DRAWN}, r AS (SELECT sum(weight * num) / sum(weight * den) AS p, greatest(1.0, sum(weight * den) ^ 2 / sum((weight * den) ^ 2)) AS n FROM w)"""
_WILSON = """(p + 3.841458881296 / (2 * n)) / (1 + 3.841458881296 / n) {0} 1.959964::DOUBLE * sqrt(p * (1 - p) / n + 3.841458881296 / (4 * n * n)) / (1 + 3.841458881296 / n)"""

ORACLE_SQL = {
    "recipe_accuracy": f"""WITH {EVENT_INTERVALS_SQL}, p AS (SELECT a.key, a.id AS t_id, a.s AS t, b.id AS p_id, abs(a.s - b.s) AS d FROM ivl a JOIN ivl b ON a.key = b.key AND a.kind = 'view' AND b.kind = 'click' AND abs(a.s - b.s) <= {HOUR}),
l AS (SELECT key, list({{'t_id': t_id, 'p_id': p_id}} ORDER BY t, t_id, d, p_id) AS l FROM p GROUP BY key),
f AS (SELECT key, len(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.t_id = x.t_id OR y.p_id = x.p_id)) > 0 THEN acc ELSE list_append(acc, x) END, []::STRUCT(t_id BIGINT, p_id BIGINT)[])) AS matched FROM l)
SELECT key, count(*) AS truths, coalesce(any_value(matched), 0) AS matched FROM ivl LEFT JOIN f USING (key) WHERE kind = 'view' GROUP BY key""",
    "classifier_rates": f"""{_LAB}, c AS (SELECT lang, count(*) FILTER (quality = 1 AND pred = 1) AS tp, count(*) FILTER (quality = 1) AS t, count(*) FILTER (pred = 1) AS s FROM lab GROUP BY lang)
SELECT lang, tp, round(tp / s, 9) AS precision, round(tp / t, 9) AS recall, round(2 * (tp / s) * (tp / t) / (tp / s + tp / t), 9) AS f1 FROM c""",
    "stratified_design": """WITH d AS (SELECT doc_id, row_number() OVER (PARTITION BY quality, toxic ORDER BY sha256(CAST(doc_id AS VARCHAR))) AS draw, count(*) OVER (PARTITION BY quality, toxic) AS size FROM labels)
SELECT doc_id, draw, size / least(8, size) AS weight FROM d WHERE draw <= 8""",
    "weighted_ratio_kish": f"{_SAMPLE} SELECT round(p, 6) AS ratio, round(n, 6) AS n_eff FROM r",
    "wilson_ci": f"{_SAMPLE} SELECT round(greatest(0.0, {_WILSON.format('-')}), 6) AS low, round(least(1.0, {_WILSON.format('+')}), 6) AS high FROM r",
    "three_state_gate": f"""{_LAB}, g AS (SELECT lang, avg(CAST(pred AS DOUBLE)) AS p, count(*) AS n FROM lab WHERE quality = 1 GROUP BY lang),
b AS (SELECT lang, {_WILSON.format("-")} AS low, {_WILSON.format("+")} AS high FROM g)
SELECT lang, CASE WHEN high < 0.8 THEN 'FAIL' WHEN low >= 0.8 THEN 'PASS' ELSE 'INSUFFICIENT_EVIDENCE' END AS state FROM b""",
    "bootstrap_ci": f"""{_LAB}, r AS (SELECT toxic AS stratum, 1.0::DOUBLE + toxic AS weight, pred AS num, row_number() OVER (PARTITION BY toxic ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY toxic) AS size FROM lab WHERE quality = 1),
d AS (SELECT b, stratum, CAST('0x' || left(md5(b || '/' || stratum || '/' || pos), 8) AS BIGINT) % size AS pos FROM r, range(2000) t(b)),
v AS (SELECT b, sum(weight * num) / sum(weight) AS x FROM d JOIN r USING (stratum, pos) GROUP BY b), l AS (SELECT list_sort(list(x)) AS r FROM v),
w AS (SELECT sum(weight * num) / sum(weight) AS p, greatest(1.0, sum(weight) ^ 2 / sum(weight * weight)) AS n FROM r)
SELECT round(p, 6) AS estimate, round(least(r[greatest(0, CAST(floor(len(r) * 0.025::DOUBLE) AS INT) - 1) + 1], greatest(0.0, {_WILSON.format("-")})), 6) AS low,
round(greatest(r[least(len(r) - 1, CAST(floor(len(r) * 0.975::DOUBLE) AS INT)) + 1], least(1.0, {_WILSON.format("+")})), 6) AS high FROM l, w""",
    "ablation_gate": f"""{_LAB}, g AS (SELECT lang, avg(CAST(quality AS DOUBLE)) AS base, avg(CAST(quality AS DOUBLE)) FILTER (pred = 1) AS kept, count(*) AS n, count(*) FILTER (pred = 1) AS m FROM lab GROUP BY lang)
SELECT lang, kept - base >= 0.1::DOUBLE OR (base - kept <= 0.01::DOUBLE AND m <= 0.8::DOUBLE * n) AS passes FROM g""",
    "downstream_invalidation": f"""WITH RECURSIVE {EDGES_SQL}, c(seed, node, steps) AS (SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0 FROM region UNION SELECT c.seed, e.dst, c.steps + 1 FROM c JOIN edges e ON e.src = c.node)
SELECT seed, node, CAST(min(steps) AS BIGINT) AS steps FROM c GROUP BY 1, 2""",
    "effective_status": f"""WITH RECURSIVE {EDGES_SQL}, nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
v AS (SELECT node, CASE WHEN left(node, 1) = 'n' AND CAST(substring(node, 2) AS INT) % 7 = 0 THEN 'draft' ELSE 'committed' END AS status FROM nodes),
t(node) AS (SELECT node FROM v WHERE status <> 'committed' UNION SELECT e.dst FROM t JOIN edges e ON e.src = t.node)
SELECT node, CASE WHEN status <> 'committed' THEN status WHEN node IN (SELECT node FROM t) THEN 'stale' ELSE 'committed' END AS effective FROM v""",
    "cycle_check": f"""WITH RECURSIVE {EDGES_SQL}, e2 AS (SELECT * FROM edges UNION ALL SELECT dst, src FROM edges WHERE dst = 's1'),
c(seed, node) AS (SELECT src, dst FROM e2 UNION SELECT c.seed, e.dst FROM c JOIN e2 e ON e.src = c.node)
SELECT DISTINCT seed AS node FROM c WHERE seed = node""",
    "claim_conflicts": """SELECT a.o_custkey AS c, a.o_orderpriority AS p, count(*) AS pairs, min(a.o_orderkey) AS first FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderpriority = b.o_orderpriority
AND a.o_orderkey < b.o_orderkey AND a.o_orderstatus <> b.o_orderstatus WHERE a.o_orderstatus IN ('O', 'F') AND b.o_orderstatus IN ('O', 'F') GROUP BY 1, 2""",
    "latest_versions": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1",
}
