"""Plans filled from the events of each user and the turns of each conversation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators import planning as pl
from loomline.operators.intervals import overlap_join
from loomline.plans.timeline import MINUTE, WIDTH
from loomline.sources.driver_tables import EVENT_INTERVALS_SQL, event_intervals, table

HOUR, DAY = 60 * MINUTE, 24 * 60 * MINUTE
_IVL = f"WITH RECURSIVE {EVENT_INTERVALS_SQL}"

#: The pattern that every user's plan follows: threshold, forms, group, required, may be fused, modes.
PATTERN = (
    (0, 70, ["view", "click"], "lead", True, True, ["clip"]),
    (1, 60, ["view"], "lead", True, True, ["clip", "hold"]),
    (2, 96, ["purchase"], None, False, True, ["hold"]),
    (3, 96, ["purchase"], None, True, True, ["clip"]),
    (4, 50, ["error"], None, True, False, ["clip"]),
    (5, 40, ["click", "instant"], "lead", True, True, ["hold", "clip"]),
    (6, 97, ["error"], "other", False, True, ["clip"]),
    (7, 97, ["error"], "other", True, True, ["clip"]),
)


def _fits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = event_intervals(spark, sf_dir)
    pattern = F.array(*(F.struct(F.lit(s).cast("long").alias("slot"), F.lit(t).cast("long").alias("threshold"), F.array(*map(F.lit, f)).alias("forms"), F.lit(g).cast("string").alias("grp"), F.lit(r).alias("required"), F.lit(u).alias("fusable"), F.array(*map(F.lit, m)).alias("modes")) for s, t, f, g, r, u, m in PATTERN))
    slots = rows.select("key").distinct().select("key", F.inline(pattern))
    fit = (F.col("id") * 37 + F.floor(F.col("slot") / 2) * 11) % 101
    units = rows.select(
        "key", "id", F.when(F.col("kind") == "signup", "instant").otherwise(F.col("kind")).alias("form"), F.when(F.col("id") % 4 < 3, F.col("id") % 4).alias("subject"), (F.col("id") % 10).alias("strength"),
        (F.col("id") * 7 % 13).alias("confidence"), "s", "e", (F.col("s") - F.col("id") % 3 * 10 * MINUTE).alias("box_s"), (F.col("e") + F.col("id") % 5 * 10 * MINUTE).alias("box_e"),
    )
    return units.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(PATTERN) - 1).cast("long")))).withColumn("fit", fit), slots


def slot_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's pattern of eight slots filled from the user's events, with locked subjects and fused slots."""
    fits, slots = _fits(spark, sf_dir)
    return pl.assign_slots(fits, slots, ["key"], len(PATTERN), 4 * HOUR, 20 * MINUTE, 10 * MINUTE, (18 * MINUTE, 90 * MINUTE))


def slot_plan_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each user's filled plan stands: required slots and total length."""
    return pl.plan_verdicts(slot_assignment(spark, sf_dir), ["key"], 4 * HOUR, 12 * HOUR)


def contract_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best path through the weeks of each user's events under one identity, with its hypothesis (V6, V7)."""
    rows = event_intervals(spark, sf_dir)
    slots = rows.select("key").distinct().select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("slot"))
    slots = slots.withColumns({"required": F.col("slot").isin(1, 3), "hard": F.col("slot").isin(2, 4)})
    names = F.when(F.col("id") % 11 == 0, F.array().cast("array<string>")).when(F.col("id") % 2 == 0, F.array(F.concat(F.lit("char:"), F.col("id") % 4), F.concat(F.lit("win:"), F.col("id") % 3))).otherwise(F.array(F.concat(F.lit("win:"), F.col("id") % 5)))
    found = rows.select(
        "key", F.floor(F.col("s") / (7 * DAY)).alias("slot"), "id", (F.col("id") * 31 % 97).alias("score"), names.alias("names"), F.col("kind").alias("source"), "s", (F.col("id") % 7).alias("event"),
        F.array(F.col("id") * 3 % 7).alias("causes"), F.array(F.col("id") * 5 % 7).alias("precedes"),
    ).where("slot <> 2 OR key % 3 <> 0")
    best = pl.contract_paths(found, slots, ["key"])
    return best.select("key", "hypothesis", "covered", "score", "n_hypotheses", F.concat_ws(",", F.transform("path", lambda x: F.concat(x["slot"], F.lit(":"), x["id"]))).alias("path"))


def _around(spark: SparkSession, sf_dir: str, kinds: list[str], reach: int):
    """A layer: the user's events of ``kinds`` within ``reach`` of the ask's start that share its identity."""
    pool = event_intervals(spark, sf_dir).where(F.col("kind").isin(kinds))

    def layer(asks: DataFrame) -> DataFrame:
        spans = asks.select("key", "ask", (F.col("t") - reach).alias("s"), (F.col("t") + reach).alias("e"))
        points = pool.select("key", "id", F.col("s").alias("s2"), (F.col("s") + 1).alias("e2"), F.col("e").alias("end"))
        met = overlap_join(spans, points, ["key"], 2 * reach).where("id % 3 = ask % 3")
        return met.select("ask", F.col("key").alias("source"), "id", F.col("s2").alias("s"), F.col("end").alias("e"), (F.col("id") * 13 % 101).alias("score"))

    return layer


def layered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each error another event of the user in its place, searched ever wider, away from purchases and sign-ups (V8)."""
    rows = event_intervals(spark, sf_dir)
    asks = rows.where("kind = 'error'").select("key", F.col("id").alias("ask"), F.col("s").alias("t"))
    spans = asks.select("key", "ask", (F.col("t") - 12 * DAY).alias("s"), (F.col("t") + 12 * DAY).alias("e"))
    taken = rows.where("kind IN ('purchase', 'signup')").select("key", F.col("s").alias("s2"), F.col("e").alias("e2"))
    blocked = overlap_join(spans, taken, ["key"], 12 * DAY).select("ask", F.col("key").alias("source"), "s2", "e2")
    layers = [_around(spark, sf_dir, ["view"], 12 * HOUR), _around(spark, sf_dir, ["view", "click"], 3 * DAY), _around(spark, sf_dir, ["view", "click"], 10 * DAY)]
    return pl.search_in_layers(asks, layers, blocked, 90 * MINUTE, WIDTH).select("ask", "layer", "id", "s", "score")


def clique_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three events of each user that agree both ways, from the first purchase, and one that differs from all; answers are known for the six events that follow each."""
    rows = event_intervals(spark, sf_dir).withColumn("t", F.col("s"))
    order = Window.partitionBy("key").orderBy("t", "id")
    following = rows.withColumn("others", F.array(*(F.lead("id", k).over(order) for k in range(1, 7))))
    pairs = following.select("key", F.col("id").alias("a"), F.explode("others").alias("other")).where("other IS NOT NULL")
    pairs = pairs.select("key", F.explode(F.array(F.struct(F.col("a").alias("left"), F.col("other").alias("right")), F.struct(F.col("other").alias("left"), F.col("a").alias("right")))).alias("p")).select("key", "p.*")
    same = F.col("left") % 3 == F.col("right") % 3
    result = F.when(same, F.when((F.col("left") + 2 * F.col("right")) % 7 == 6, "unsure").otherwise("same")).otherwise(F.when((F.col("left") + 3 * F.col("right")) % 5 == 0, "unsure").otherwise("different"))
    seeds = rows.where("kind = 'purchase'").groupBy("key").agg(F.min(F.struct("t", "id")).alias("f")).select("key", "f.id", "f.t")
    hints = rows.withColumn("hint", F.when(F.col("id") % 4 == 0, "possible").when(F.col("id") % 4 == 1, "hard").otherwise("unsure"))
    out = pl.directed_clique(seeds, hints.select("key", "id", "t", "hint"), pairs.withColumn("result", result), ["key"], 2 * HOUR)
    return out.select("key", F.concat_ws(",", F.transform("ids", lambda x: x.cast("string"))).alias("ids"), "negative", "passed")


def _options(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_intervals(spark, sf_dir).where("kind <> 'signup'")
    return rows.groupBy("key", F.col("kind").alias("part"), F.floor(F.col("s") / (7 * DAY)).alias("option")).agg(F.array_sort(F.collect_set(F.col("id") % 9)).alias("events"))


def option_combinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One week of each kind of each user's events, or none, so that the weeks together hold most different marks."""
    out = pl.best_combination(_options(spark, sf_dir), ["key"])
    return out.select("key", F.concat_ws(",", F.transform("chosen", lambda x: F.concat(x["part"], F.lit(":"), x["option"]))).alias("chosen"), "n_parts", "n_events", "n_repeats")


def _turn_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("slot"), ((F.col("conv_id") % 5 + 3) * 700).alias("total"), size.alias("evidence"), (F.floor(size / 2) + F.col("turn") * 37).alias("speech"),
        F.floor(size * 2 / 3).alias("source"), (F.col("role") == "user").alias("required"),
    )


def refitted_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation refitted to what they hold, within a fifth over the plan's length."""
    return pl.refit_slots(_turn_slots(spark, sf_dir), ["conv_id"], 300, 1500, 6000)


def roughcut_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of each conversation at the length they need, a short plan extended by its optional turns."""
    return pl.refit_roughcut(_turn_slots(spark, sf_dir), ["conv_id"], 3000, 4500)


QUERIES = {f.__name__: f for f in (slot_assignment, slot_plan_verdicts, contract_plans, layered_search, clique_examples, option_combinations, refitted_slots, roughcut_slots)}


def _sql(v: object) -> str:
    if v is None:
        return "NULL"
    return f"[{', '.join(map(_sql, v))}]" if isinstance(v, list) else f"'{v}'" if isinstance(v, str) else str(v).lower()


#: One recursion step a slot, over all fitting units in order.
_ASSIGNED = f"""{_IVL}, slots(slot, thr, forms, grp, required, fusable, modes) AS (VALUES {', '.join(f"({', '.join(map(_sql, p))})" for p in PATTERN)}),
f AS (SELECT key, slot, id, (id * 37 + slot // 2 * 11) % 101 AS fit, CASE WHEN kind = 'signup' THEN 'instant' ELSE kind END AS form, CASE WHEN id % 4 < 3 THEN id % 4 END AS subject, id % 10 AS strength, id * 7 % 13 AS confidence, s, e,
 greatest(s - id % 3 * {10 * MINUTE}, s - {20 * MINUTE}) AS l, least(e + id % 5 * {10 * MINUTE}, e + {10 * MINUTE}) AS r, slots.* EXCLUDE (slot) FROM ivl, slots WHERE (id * 37 + slot // 2 * 11) % 101 >= thr),
o AS (SELECT *, greatest(0, r - l - {4 * HOUR}) AS over FROM f), q AS (SELECT *, l + least(s - l, over // 2) AS lo, r - (over - least(s - l, over // 2)) AS hi,
 CASE WHEN form = 'instant' AND list_contains(modes, 'hold') THEN 'hold' WHEN list_contains(modes, 'clip') THEN 'clip' ELSE modes[1] END AS mode FROM o),
u AS (SELECT key, slot, count(*) AS n_fit, count(*) FILTER (NOT list_contains(forms, form)) AS n_form,
 coalesce(list({{'id': id, 'subject': subject, 'mode': mode, 'l': lo, 'r': hi, 'length': CASE WHEN mode = 'hold' THEN least({4 * HOUR}, greatest({18 * MINUTE}, least({90 * MINUTE}, hi - lo))) ELSE hi - lo END, 'shown': e - s <= {4 * HOUR} AND lo <= s AND hi >= e}}
 ORDER BY fit DESC, strength DESC, confidence DESC, s, id) FILTER (list_contains(forms, form) AND (grp IS NULL OR subject IS NOT NULL)), []) AS units FROM q GROUP BY key, slot),
p AS (SELECT k.key, slots.*, coalesce(n_fit, 0) AS n_fit, coalesce(n_form, 0) AS n_form, coalesce(units, []) AS units FROM (SELECT DISTINCT key FROM ivl) k CROSS JOIN slots LEFT JOIN u ON u.key = k.key AND u.slot = slots.slot),
step(key, slot, used, locks, picked, verdict, reason, id, segment, mode, s, e, length, n_fit, n_form) AS (
 SELECT DISTINCT key, -1, []::STRUCT(id BIGINT, segment BIGINT, slot BIGINT)[], []::STRUCT(grp VARCHAR, subject BIGINT)[], 0::BIGINT, '', '', 0::BIGINT, 0::BIGINT, '', 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM ivl
 UNION ALL SELECT key, slot, CASE WHEN verdict IN ('picked', 'fused') THEN list_append(list_filter(used, lambda y: y.id <> unit.id), {{'id': unit.id, 'segment': seg, 'slot': slot::BIGINT}}) ELSE used END,
  CASE WHEN verdict = 'picked' AND grp IS NOT NULL AND lock IS NULL THEN list_append(locks, {{'grp': grp, 'subject': unit.subject}}) ELSE locks END, picked + CASE WHEN verdict = 'picked' THEN 1 ELSE 0 END, verdict,
  CASE WHEN verdict IN ('picked', 'fused') THEN NULL WHEN unit IS NULL THEN 'no unit' WHEN old IS NOT NULL THEN 'used' ELSE 'core too long' END, CASE WHEN verdict IN ('picked', 'fused') THEN unit.id END, seg,
  CASE WHEN verdict = 'picked' THEN unit.mode END, CASE WHEN verdict = 'picked' THEN unit.l END, CASE WHEN verdict = 'picked' THEN unit.r END, CASE WHEN verdict = 'picked' THEN unit.length END, n_fit, n_form
 FROM (SELECT *, CASE WHEN verdict = 'picked' THEN picked WHEN verdict = 'fused' THEN old.segment END AS seg FROM
 (SELECT *, CASE WHEN unit IS NOT NULL AND old IS NULL AND unit.shown THEN 'picked' WHEN old IS NOT NULL AND old.slot = slot - 1 AND fusable THEN 'fused' WHEN required THEN 'missing' ELSE 'skipped' END AS verdict FROM
 (SELECT *, list_filter(used, lambda y: y.id = unit.id)[1] AS old FROM (SELECT *, coalesce(list_filter(serve, lambda v: len(list_filter(used, lambda y: y.id = v.id)) = 0)[1], serve[1]) AS unit FROM
 (SELECT *, list_filter(units, lambda v: lock IS NULL OR v.subject = lock) AS serve FROM
 (SELECT step.key, p.slot, used, locks, picked, p.grp, p.required, p.fusable, p.units, p.n_fit, p.n_form, list_filter(locks, lambda g: g.grp = p.grp)[1].subject AS lock FROM step JOIN p ON p.key = step.key AND p.slot = step.slot + 1)))))))"""


def _move(a: str, b: str) -> str:
    return f"""(CASE WHEN list_has_any({a}.names, {b}.names) THEN 25 ELSE 0 END + CASE WHEN {a}.source = {b}.source THEN 5 ELSE 0 END + CASE WHEN {a}.s <= {b}.s THEN 8 ELSE 0 END
 + CASE WHEN list_contains({b}.causes, {a}.event) THEN 25 WHEN list_contains({b}.precedes, {a}.event) THEN 10 ELSE 0 END - CASE WHEN list_contains({a}.causes, {b}.event) THEN 35 ELSE 0 END - CASE WHEN {a}.id = {b}.id THEN 30 ELSE 0 END)"""


_TOP = "list_sort(list_transform(live, lambda p: {'total': p.total, 'k': p.k, 'path': p.path}), 'DESC')[1].path"


def _layer_sql(n: int, kinds: str, reach: int) -> str:
    return f"""l{n} AS (SELECT a.ask, {n} AS layer, c.id, c.s, c.id * 13 % 101 AS score FROM a{n} a JOIN ivl c ON c.key = a.key AND c.kind IN ({kinds}) AND c.id % 3 = a.ask % 3 AND c.s >= a.t - {reach} AND c.s < a.t + {reach}
 WHERE NOT EXISTS (SELECT 1 FROM ivl b WHERE b.key = a.key AND b.kind IN ('purchase', 'signup') AND b.s < a.t + {12 * DAY} AND b.e > a.t - {12 * DAY} AND least(b.e, c.e) + {90 * MINUTE} > greatest(b.s, c.s) - {90 * MINUTE})
 QUALIFY row_number() OVER (PARTITION BY a.ask ORDER BY score DESC, c.s, c.id) = 1), a{n + 1} AS (SELECT * FROM a{n} WHERE ask NOT IN (SELECT ask FROM l{n}))"""


_TURNS = "SELECT conv_id, turn AS slot, (conv_id % 5 + 3) * 700 AS total, length(text)::BIGINT AS evidence, (length(text) // 2 + turn * 37)::BIGINT AS speech, (length(text) * 2 // 3)::BIGINT AS source, role = 'user' AS required FROM conversations"

ORACLE_SQL = {
    "slot_assignment": f"{_ASSIGNED} SELECT key, slot, verdict, reason, id, segment, mode, s, e, length, n_fit, n_form FROM step WHERE slot >= 0",
    "slot_plan_verdicts": f"""{_ASSIGNED}, w AS (SELECT key, CAST(coalesce(sum(length), 0) AS BIGINT) AS length, count(*) FILTER (verdict = 'picked') AS segments, coalesce(string_agg(CASE WHEN verdict = 'missing' THEN slot END, ',' ORDER BY slot), '') AS missing FROM step WHERE slot >= 0 GROUP BY key)
SELECT *, CASE WHEN missing <> '' THEN 'required slots missing' WHEN length < {4 * HOUR} THEN 'below the least length' WHEN length > {12 * HOUR} THEN 'over the longest' ELSE 'passed' END AS reason FROM w""",
    "contract_plans": f"""{_IVL}, c AS (SELECT key, s // {7 * DAY} AS slot, id, id * 31 % 97 AS score, CASE WHEN id % 11 = 0 THEN []::VARCHAR[] WHEN id % 2 = 0 THEN ['char:' || id % 4, 'win:' || id % 3] ELSE ['win:' || id % 5] END AS names,
 kind AS source, s, id % 7 AS event, [id * 3 % 7] AS causes, [id * 5 % 7] AS precedes FROM ivl), t AS (SELECT * FROM c WHERE slot <> 2 OR key % 3 <> 0 QUALIFY row_number() OVER (PARTITION BY key, slot ORDER BY score DESC, s, id) <= 12),
sl AS (SELECT key, slot, slot IN (1, 3) AS required, slot IN (2, 4) AS hard FROM (SELECT DISTINCT key FROM ivl), range(6) r(slot)),
first AS (SELECT key, min(slot) AS slot FROM t JOIN sl USING (key, slot) WHERE required GROUP BY key),
names AS (SELECT key, name, min((-score, s, id, name)) AS turn FROM (SELECT key, score, s, id, unnest(names) AS name FROM t JOIN first USING (key, slot)) GROUP BY key, name),
hyp AS (SELECT k.key, name AS hypothesis, count(name) OVER (PARTITION BY k.key) AS n, row_number() OVER (PARTITION BY k.key ORDER BY turn) AS nth FROM (SELECT DISTINCT key FROM ivl) k LEFT JOIN names USING (key)),
g AS (SELECT h.key, h.hypothesis, h.n, h.nth, sl.slot, any_value(sl.hard) AS hard, coalesce(list({{'id': id, 'score': score, 'names': names, 'source': source, 's': s, 'event': event, 'causes': causes, 'precedes': precedes}} ORDER BY score DESC, s, id)
 FILTER (id IS NOT NULL AND (hypothesis IS NULL OR NOT required OR list_contains(names, hypothesis))), []) AS rows FROM hyp h JOIN sl ON sl.key = h.key LEFT JOIN t ON t.key = h.key AND t.slot = sl.slot GROUP BY 1, 2, 3, 4, 5),
walk(key, hypothesis, n, nth, slot, live, done) AS (SELECT key, hypothesis, n, nth, -1::BIGINT, list_transform(rows[:0], lambda r: {{'total': 0::BIGINT, 'k': 0::BIGINT, 'path': [{{'slot': 0::BIGINT, 'id': 0::BIGINT, 'score': 0::BIGINT}}], 'row': r}}), []::STRUCT(slot BIGINT, id BIGINT, score BIGINT)[] FROM g WHERE slot = 0
 UNION ALL SELECT key, hypothesis, n, nth, slot, new, CASE WHEN len(new) = 0 AND len(live) > 0 THEN list_concat(done, {_TOP}) ELSE done END FROM
 (SELECT w.key, w.hypothesis, w.n, w.nth, g.slot, w.live, w.done, list_filter(list_transform(g.rows, lambda r, i: CASE WHEN len(w.live) = 0 THEN {{'total': r.score, 'k': -i, 'path': [{{'slot': g.slot, 'id': r.id, 'score': r.score}}], 'row': r}} ELSE
  list_transform(list_sort(list_transform(list_filter(w.live, lambda p: NOT g.hard OR list_has_any(p.row.names, r.names)), lambda p: {{'total': p.total + {_move("p.row", "r")}, 'k': p.k, 'path': p.path}}), 'DESC')[:1],
   lambda b: {{'total': b.total + r.score, 'k': -i, 'path': list_append(b.path, {{'slot': g.slot, 'id': r.id, 'score': r.score}}), 'row': r}})[1] END), lambda x: x IS NOT NULL) AS new
  FROM walk w JOIN g ON g.key = w.key AND g.nth = w.nth AND g.slot = w.slot + 1)),
e AS (SELECT key, hypothesis, n, nth, CASE WHEN len(live) > 0 THEN list_concat(done, {_TOP}) ELSE done END AS path FROM walk WHERE slot = 5)
SELECT key, hypothesis, len(path) AS covered, CAST(coalesce(list_sum(list_transform(path, lambda x: x.score)), 0) AS BIGINT) AS score, n AS n_hypotheses, array_to_string(list_transform(path, lambda x: x.slot || ':' || x.id), ',') AS path
FROM e QUALIFY row_number() OVER (PARTITION BY key ORDER BY covered DESC, coalesce(hypothesis LIKE 'char:%', false) DESC, score DESC, nth) = 1""",
    "layered_search": f"""{_IVL}, a1 AS (SELECT key, id AS ask, s AS t FROM ivl WHERE kind = 'error'), {_layer_sql(1, "'view'", 12 * HOUR)}, {_layer_sql(2, "'view', 'click'", 3 * DAY)}, {_layer_sql(3, "'view', 'click'", 10 * DAY)}
SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3 UNION ALL SELECT ask, NULL, NULL, NULL, NULL FROM a4""",
    "clique_examples": f"""{_IVL}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s, id) AS r FROM ivl), pr AS (SELECT a.key, a.id AS l, b.id AS r FROM n a JOIN n b ON a.key = b.key AND abs(a.r - b.r) BETWEEN 1 AND 6),
ans AS (SELECT key, l, r, CASE WHEN l % 3 = r % 3 THEN CASE WHEN (l + 2 * r) % 7 = 6 THEN 'unsure' ELSE 'same' END WHEN (l + 3 * r) % 5 = 0 THEN 'unsure' ELSE 'different' END AS x FROM pr),
m AS (SELECT a.key, a.l, a.r, a.x FROM ans a JOIN ans b ON a.key = b.key AND a.l = b.r AND a.r = b.l AND a.x = b.x),
seed AS (SELECT key, id, s FROM ivl WHERE kind = 'purchase' QUALIFY row_number() OVER (PARTITION BY key ORDER BY s, id) = 1),
cand AS (SELECT i.key, i.id, i.s, CASE i.id % 4 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 1 END AS h, abs(i.s - seed.s) AS far FROM ivl i JOIN seed ON seed.key = i.key AND i.id <> seed.id),
ord AS (SELECT key, list({{'id': id, 's': s}} ORDER BY h, far, s, id) AS l FROM cand GROUP BY key),
same AS (SELECT key, l, list(r) AS rs FROM m WHERE x = 'same' GROUP BY key, l), sm AS (SELECT key, map(list(l), list(rs)) AS sm FROM same GROUP BY key),
z AS (SELECT ord.key, list_reduce(l, lambda acc, y: CASE WHEN len(acc) = 3 OR len(list_filter(acc, lambda p: abs(p.s - y.s) < {2 * HOUR} OR NOT coalesce(list_contains(sm[p.id], y.id), false))) > 0 THEN acc ELSE list_append(acc, y) END, [{{'id': seed.id, 's': seed.s}}]) AS ps FROM ord JOIN seed USING (key) LEFT JOIN sm USING (key)),
v AS (SELECT key, list_transform(ps, lambda p: p.id) AS ids FROM z),
neg AS (SELECT v.key, c.id FROM v JOIN cand c USING (key) WHERE len(ids) = 3 AND NOT list_contains(ids, c.id) AND (SELECT count(*) FROM m WHERE m.key = v.key AND m.r = c.id AND m.x = 'different' AND list_contains(v.ids, m.l)) = 3
 QUALIFY row_number() OVER (PARTITION BY v.key ORDER BY CASE WHEN h = 2 THEN 0 ELSE 1 END, far, s, c.id) = 1)
SELECT v.key, array_to_string(ids, ',') AS ids, neg.id AS negative, len(ids) = 3 AND neg.id IS NOT NULL AS passed FROM v LEFT JOIN neg USING (key)""",
    "option_combinations": f"""{_IVL}, o AS (SELECT key, kind AS part, s // {7 * DAY} AS option, list_sort(list_distinct(list(id % 9))) AS events FROM ivl WHERE kind <> 'signup' GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY key, part ORDER BY option) AS turn FROM o), w AS (SELECT * FROM r UNION ALL SELECT DISTINCT key, part, NULL, []::BIGINT[], 0 FROM ivl, (VALUES ('click'), ('error'), ('purchase'), ('view')) p(part) WHERE kind <> 'signup'),
x AS (SELECT a.key, list_filter([a, b, c, d], lambda y: y.option IS NOT NULL) AS l, [a.turn, b.turn, c.turn, d.turn] AS turn FROM w a JOIN w b ON a.key = b.key AND a.part = 'click' AND b.part = 'error' JOIN w c ON c.key = a.key AND c.part = 'purchase' JOIN w d ON d.key = a.key AND d.part = 'view'),
y AS (SELECT key, turn, l, list_transform(l, lambda q: q.events) AS es FROM x),
z AS (SELECT key, turn, l, len(l) AS n_parts, len(list_distinct(flatten(es))) AS n_events, len(flatten(es)) - len(list_distinct(flatten(es))) AS n_repeats FROM y WHERE len(list_distinct(es)) = len(es))
SELECT key, array_to_string(list_transform(l, lambda q: q.part || ':' || q.option), ',') AS chosen, n_parts, n_events, n_repeats FROM z QUALIFY row_number() OVER (PARTITION BY key ORDER BY n_parts DESC, n_events DESC, n_repeats, turn) = 1""",
    "refitted_slots": f"""WITH t AS ({_TURNS}), a AS (SELECT *, total // count(*) OVER w AS equal FROM t WINDOW w AS (PARTITION BY conv_id)),
n AS (SELECT *, least(1500, greatest(300, equal, evidence, speech)) AS need FROM a),
l AS (SELECT conv_id, list({{'slot': slot, 'need': need, 'low': need <= equal}} ORDER BY slot) AS l, sum(need) - least(any_value(total) * 120 // 100, 6000) AS slack FROM n GROUP BY conv_id),
f AS (SELECT conv_id, list_reduce(l, lambda acc, x: {{'slack': acc.slack - CASE WHEN x.low THEN greatest(0, least(x.need - 300, acc.slack)) ELSE 0 END, 'nth': acc.nth + x.need - CASE WHEN x.low THEN greatest(0, least(x.need - 300, acc.slack)) ELSE 0 END,
 'out': list_append(acc.out, {{'slot': x.slot, 's': acc.nth, 'e': acc.nth + x.need - CASE WHEN x.low THEN greatest(0, least(x.need - 300, acc.slack)) ELSE 0 END}})}}, {{'slack': slack::BIGINT, 'nth': 0::BIGINT, 'out': []::STRUCT(slot BIGINT, s BIGINT, e BIGINT)[]}}) AS z FROM l),
u AS (SELECT conv_id, unnest(z.out) AS o, z.nth AS plan_length FROM f) SELECT conv_id, o.slot AS slot, o.e - o.s AS length, o.s AS s, o.e AS e, plan_length FROM u""",
    "roughcut_slots": f"""WITH t AS ({_TURNS}), a AS (SELECT *, greatest(evidence, speech, source) AS need FROM t),
p AS (SELECT conv_id, CAST(sum(need) AS BIGINT) AS total, CAST(coalesce(sum(source) FILTER (NOT required), 0) AS BIGINT) AS context, list({{'slot': slot, 'need': need}} ORDER BY slot) AS l FROM a GROUP BY conv_id),
q AS (SELECT *, CASE WHEN total < 3000 THEN least(4500, greatest(total, least(3000, total + context))) - total ELSE 0 END AS rest FROM p),
f AS (SELECT conv_id, total <= 4500 AS ok, total + rest AS plan_length, list_reduce(l, lambda acc, x: {{'rest': acc.rest - acc.rest // acc.n, 'n': acc.n - 1, 'nth': acc.nth + x.need + acc.rest // acc.n, 'out': list_append(acc.out, {{'slot': x.slot, 's': acc.nth, 'e': acc.nth + x.need + acc.rest // acc.n}})}},
 {{'rest': rest::BIGINT, 'n': len(l)::BIGINT, 'nth': 0::BIGINT, 'out': []::STRUCT(slot BIGINT, s BIGINT, e BIGINT)[]}}) AS z FROM q),
u AS (SELECT conv_id, ok, plan_length, unnest(z.out) AS o FROM f)
SELECT conv_id, o.slot AS slot, CASE WHEN ok THEN o.e - o.s END AS length, CASE WHEN ok THEN o.s END AS s, CASE WHEN ok THEN o.e END AS e, CASE WHEN ok THEN plan_length END AS plan_length, ok AS feasible FROM u""",
}
