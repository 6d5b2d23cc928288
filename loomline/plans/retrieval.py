"""Vector retrieval and constrained selection over the embeddings."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import retrieval as rt
from loomline.sources.driver_tables import table


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("long").alias("label"))


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("query"), F.col("label").alias("wanted"))


def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every twentieth one (V1)."""
    return rt.cosine_top_k(_rows(spark, sf_dir), _queries(spark, sf_dir), 5).select("qid", "rank", "id")


def slot_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine with a bonus for role, speech and length, at least .18, best twelve (V5); every row is scored in full."""
    bonus = lambda row, query: rt.role_bonus(row["label"], query["wanted"]) + rt.speech_bonus(row["id6"], row["id9"] + 1.0, 5.0)
    rows = _rows(spark, sf_dir).withColumns({"id6": F.col("id") % 6, "id9": F.col("id") % 9})
    return rt.cosine_top_k(rows, _queries(spark, sf_dir), 12, bonus=bonus, least=0.18).select("qid", F.col("rank").alias("place"), "id")


def asset_slots_action_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine with a bonus for an action level near the middle, best two long enough, then the others as relaxed picks (V3)."""
    bonus = lambda row, query: rt.action_fit(row["label"] / 10.0, 0.5) - np.where(row["length"] >= 45, 0.0, 10.0)
    rows = _rows(spark, sf_dir).withColumn("length", F.col("id") * 37 % 100)
    picks = rt.cosine_top_k(rows, _queries(spark, sf_dir), 2, bonus=bonus)
    return picks.select("qid", F.col("rank").alias("place"), "id", F.when(F.col("score") < -5, "relaxed").otherwise("").alias("reason"))


def retrieve_no_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans of five queries each, in which no vector is picked twice (V2, V4)."""
    top = rt.cosine_top_k(_rows(spark, sf_dir), _queries(spark, sf_dir), 5)
    step = F.floor(F.col("qid") / 20)
    plans = top.select(F.floor(step / 5).alias("plan"), (step % 5).alias("qid"), "rank", "id")
    return rt.pick_without_reuse(plans, 5)


def viterbi_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best path through the five slots of each sixty vectors, twelve a slot: own label over ten, .25 for staying in a label (V6)."""
    states = _rows(spark, sf_dir).select(F.floor(F.col("id") / 60).alias("plan"), F.floor(F.col("id") % 60 / 12).cast("int").alias("slot"), "id", "label")
    a = states.select("plan", (F.col("slot") + 1).alias("slot"), F.col("id").alias("from_id"), F.col("label").alias("l1"))
    steps = a.join(states, ["plan", "slot"]).select("plan", "slot", "from_id", "id", F.when(F.col("l1") == F.col("label"), 25).otherwise(-5).alias("bonus"))
    best = rt.best_path(states.select("plan", "slot", "id", (F.col("label") * 10).alias("score")), steps, 5)
    return best.select("plan", F.col("total").cast("long").alias("total"), F.concat_ws(",", F.transform("path", lambda x: x.cast("string"))).alias("path"))


def _seg(step: str = "qid") -> list:
    return [F.floor(F.col(step) / 100).alias("plan"), (F.floor(F.col(step) / 20) % 5).alias("seg")]


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries(spark, sf_dir).select(*_seg(), (F.col("qid") % 90 / 100.0).alias("need"), F.col("qid"), F.col("wanted"))


def segment_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots of plans of five segments each: by cosine, with a bonus for a query word in the caption, never one of the last two (V2)."""
    top = rt.cosine_top_k(_rows(spark, sf_dir), _queries(spark, sf_dir), 20)
    shots = _rows(spark, sf_dir).select("id", F.concat(F.lit("a label"), F.col("label"), F.lit(" in tone"), F.col("id") % 7).alias("caption"), (F.col("id") * 37 % 100 / 100.0).alias("length"))
    asked = _segments(spark, sf_dir).withColumn("text", F.concat(F.lit("The Tone"), F.col("qid") / 20 % 7, F.lit(", or label"), F.col("wanted"), F.lit(" and so on")))
    asked = asked.withColumn("text", F.regexp_replace("text", r"\.0", ""))
    words = F.slice(F.filter(F.split(F.lower("text"), r"\W+"), lambda w: F.length(w) > 3), 1, 6)
    found = top.join(shots, "id").join(asked.select("qid", "plan", "seg", words.alias("words")), "qid")
    score = F.col("score") + F.when(F.exists("words", lambda w: F.contains("caption", w)), 0.05).otherwise(0.0)
    return rt.retrieve_segments(found.select("plan", "seg", "rank", "id", score.alias("score"), "length"), asked.select("plan", "seg", "need"))


def asset_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets of plans of five slots each: cosine with a bonus for the wanted action, long enough, not one of the last two, else relaxed or insufficient (V3)."""
    rows = _rows(spark, sf_dir).withColumn("length", F.col("id") * 37 % 100 / 100.0)
    asked = _queries(spark, sf_dir).withColumns({"action": F.col("wanted") / 10.0, "need": F.col("qid") % 90 / 100.0})
    fit = lambda row, query: rt.action_fit(row["label"] / 10.0, query["action"])
    long_ = lambda row, query: fit(row, query) - np.where(row["length"] >= np.minimum(query["need"], 0.45), 0.0, 10.0)
    good = rt.cosine_top_k(rows, asked, 3, bonus=long_, digits=4).where("score > -5").select("qid", "rank", "id", "score", F.lit(True).alias("fits"))
    best = rt.cosine_top_k(rows, asked, 1, bonus=fit, digits=4).select("qid", (F.col("rank") + 3).alias("rank"), "id", "score", F.lit(False).alias("fits"))
    return rt.fill_asset_slots(good.unionByName(best).select(*_seg(), "rank", "id", "score", "fits"), asked.select(*_seg()))


def shot_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shots of plans of five segments each, none twice, no junk, long enough or relaxed (V4)."""
    top = rt.cosine_top_k(_rows(spark, sf_dir), _queries(spark, sf_dir), 4)
    found = top.select(*_seg(), "rank", "id", (F.col("id") * 37 % 100 / 100.0).alias("length"), (F.col("id") % 3 == 0).alias("junk"))
    return rt.pick_shots(found, _segments(spark, sf_dir).select("plan", "seg", "need"), 0.6)


QUERIES = {f.__name__: f for f in (cosine_topk, slot_candidates, asset_slots_action_fit, retrieve_no_reuse, viterbi_path, segment_retrieval, asset_slots, shot_picks)}

_TOP = """WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings),
s AS (SELECT q.id AS qid, q.label AS wanted, r.id, r.label, list_inner_product(r.v, q.v) AS score FROM e r, e q WHERE q.id % 20 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s)"""

def _walk(choose: str, reason: str, used: str) -> str:
    """A recursion step a segment of each plan over its candidates ``rows`` in order; ``c`` has plan, seg, need, rows."""
    return f"""walk(plan, seg, used, id, reason) AS (SELECT DISTINCT plan, -1::BIGINT, []::BIGINT[], NULL::BIGINT, '' FROM c
UNION ALL SELECT plan, seg, CASE WHEN pick IS NULL THEN used ELSE {used} END, pick, reason FROM (SELECT *, {reason} AS reason FROM (SELECT *, {choose} AS pick FROM (SELECT walk.plan, c.seg, used, need, rows FROM walk JOIN c ON c.plan = walk.plan AND c.seg = walk.seg + 1))))
SELECT plan, seg, id, reason FROM walk WHERE seg >= 0"""


_FRESH = "list_filter(rows, lambda r: NOT list_contains(used, r.id))"
_STOP = f"coalesce(nullif(list_position(list_transform({_FRESH}, lambda r: r.score < 0.18::DOUBLE), true), 0) - 1, 1000)"
_GOOD = f"list_filter(({_FRESH})[:{_STOP}], lambda r: r.length >= greatest(need * 0.8::DOUBLE, 0.4::DOUBLE))[1].id"
_OPEN = f"list_filter({_FRESH}, lambda r: r.id % 3 <> 0)"
_FIT = "list_filter(rows, lambda r: r.fits AND r.score >= 0.18::DOUBLE AND NOT list_contains(used, r.id))[1].id"
_ASK = "qid // 100 AS plan, qid // 20 % 5 AS seg, any_value(qid % 90 / 100.0::DOUBLE) AS need"

ORACLE_SQL = {
    "segment_retrieval": f"""{_TOP.replace("WITH e", "WITH RECURSIVE e")}, b AS (SELECT qid, id, rank, score + CASE WHEN contains('a label' || label || ' in tone' || id % 7, 'tone' || qid // 20 % 7) OR contains('a label' || label || ' in tone' || id % 7, 'label' || wanted) THEN 0.05::DOUBLE ELSE 0 END AS score FROM t WHERE rank <= 20),
c AS (SELECT {_ASK}, list({{'id': id, 'score': score, 'length': id * 37 % 100 / 100.0::DOUBLE}} ORDER BY rank) AS rows FROM b GROUP BY qid),
{_walk(f"coalesce({_GOOD}, CASE WHEN rows[1].score >= 0.18::DOUBLE THEN rows[1].id END)", f"CASE WHEN {_GOOD} IS NOT NULL THEN '' WHEN rows[1].score >= 0.18::DOUBLE THEN 'too short' ELSE 'insufficient' END", "list_append(used, pick)[-2:]")}""",
    "asset_slots": f"""{_TOP.replace("WITH e", "WITH RECURSIVE e")}, b AS (SELECT qid, id, round(score + 0.08::DOUBLE * (1 - abs(label / 10.0::DOUBLE - wanted / 10.0::DOUBLE)), 4) AS score, id * 37 % 100 / 100.0::DOUBLE >= least(qid % 90 / 100.0::DOUBLE, 0.45::DOUBLE) AS fits FROM s),
c AS (SELECT {_ASK}, list({{'id': id, 'score': score, 'fits': fits}} ORDER BY score DESC, id) AS rows FROM b GROUP BY qid),
{_walk(f"coalesce({_FIT}, CASE WHEN rows[1].score >= 0.18::DOUBLE THEN rows[1].id END)", f"CASE WHEN {_FIT} IS NOT NULL THEN '' WHEN pick IS NOT NULL THEN 'relaxed' ELSE 'insufficient' END", "list_append(used, pick)[-2:]")}""",
    "shot_picks": f"""{_TOP.replace("WITH e", "WITH RECURSIVE e")}, c AS (SELECT {_ASK}, list({{'id': id, 'length': id * 37 % 100 / 100.0::DOUBLE}} ORDER BY rank) AS rows FROM t WHERE rank <= 4 GROUP BY qid),
{_walk(f"coalesce(list_filter({_OPEN}, lambda r: r.length >= least(need, 0.6::DOUBLE))[1].id, ({_OPEN})[1].id)", f"CASE WHEN len(list_filter({_OPEN}, lambda r: r.length >= least(need, 0.6::DOUBLE))) > 0 THEN '' WHEN pick IS NOT NULL THEN 'relaxed' ELSE 'black' END", "list_append(used, pick)")}""",
    "cosine_topk": f"{_TOP} SELECT qid, rank, id FROM t WHERE rank <= 5",
    "slot_candidates": f"""{_TOP}, b AS (SELECT qid, id, score + CASE WHEN label = wanted THEN 0.05::DOUBLE WHEN abs(label - wanted) = 1 THEN 0.02::DOUBLE ELSE 0.0::DOUBLE END
+ least(0.08::DOUBLE, 0.02::DOUBLE * (id % 6)) + 0.08::DOUBLE * least(1.0::DOUBLE, (id % 9 + 1) / 5.0::DOUBLE) AS total FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY total DESC, id) AS place FROM b WHERE total >= 0.18) SELECT qid, place, id FROM p WHERE place <= 12""",
    "asset_slots_action_fit": f"""{_TOP}, p AS (SELECT qid, id, id * 37 % 100 >= 45 AS long, row_number() OVER (PARTITION BY qid ORDER BY id * 37 % 100 >= 45 DESC, score + 0.08::DOUBLE * (1 - abs(label / 10.0::DOUBLE - 0.5::DOUBLE)) DESC, id) AS place FROM s)
SELECT qid, place, id, CASE WHEN long THEN '' ELSE 'relaxed' END AS reason FROM p WHERE place <= 2""",
    "retrieve_no_reuse": f"""{_TOP}, l AS (SELECT qid // 100 AS plan, list({{'qid': qid // 20 % 5, 'id': id}} ORDER BY qid, rank) AS l FROM t WHERE rank <= 5 GROUP BY 1),
f AS (SELECT plan, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.id = x.id OR y.qid = x.qid)) > 0 THEN acc ELSE list_append(acc, x) END, []::STRUCT(qid BIGINT, id BIGINT)[]) AS k FROM l),
u AS (SELECT plan, unnest(k) AS k FROM f) SELECT plan, k.qid AS qid, k.id AS id FROM u""",
    "viterbi_path": """WITH s AS (SELECT vec_id // 60 AS plan, vec_id AS id, vec_id % 60 // 12 AS slot, CAST(label AS BIGINT) AS l FROM embeddings),
p AS (SELECT plan, a.id AS a, b.id AS b, c.id AS c, d.id AS d, e.id AS e,
 10 * (a.l + b.l + c.l + d.l + e.l) + CASE WHEN a.l = b.l THEN 25 ELSE -5 END + CASE WHEN b.l = c.l THEN 25 ELSE -5 END + CASE WHEN c.l = d.l THEN 25 ELSE -5 END + CASE WHEN d.l = e.l THEN 25 ELSE -5 END AS total
 FROM s a JOIN s b USING (plan) JOIN s c USING (plan) JOIN s d USING (plan) JOIN s e USING (plan) WHERE a.slot = 0 AND b.slot = 1 AND c.slot = 2 AND d.slot = 3 AND e.slot = 4)
SELECT plan, CAST(total AS BIGINT) AS total, concat_ws(',', a, b, c, d, e) AS path FROM p QUALIFY row_number() OVER (PARTITION BY plan ORDER BY total DESC, a, b, c, d, e) = 1""",
}
