"""Edits planned over the event timeline of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators import editing as ed
from loomline.plans.timeline import MINUTE, MONTH, WIDTH
from loomline.sources.driver_tables import EVENT_INTERVALS_SQL, event_intervals, table

HOUR, DAY = 60 * MINUTE, 24 * 60 * MINUTE


def _ivl(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    rows = event_intervals(spark, sf_dir)
    return rows if kind is None else rows.where(F.col("kind") == kind)


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ivl(spark, sf_dir)
    return rows.select("key", "id", "s", "e", (F.col("id") % 2).alias("form"), F.col("kind").alias("action"), F.array(F.col("id") % 5).alias("attrs"), (F.col("e") - F.col("s") > HOUR).alias("needed"))


def merge_compatible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions of one form that share an action or attribute, merged into the first near group."""
    out = ed.merge_first_match(_regions(spark, sf_dir), ["key"], 20 * MINUTE)
    return out.select("key", "s", "e", "form", "action", F.concat_ws(",", F.transform(F.array_sort("attrs"), lambda x: x.cast("string"))).alias("attrs"), "n")


def merge_gap_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping questions of one type merged, required if one is."""
    out = ed.merge_first_match(_regions(spark, sf_dir).withColumn("form", F.lit(0).cast("long")).withColumn("attrs", F.array().cast("array<bigint>")), ["key"], 0, strict=True)
    return out.select("key", "s", "e", "action", "needed", "n")


def role_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user grouped into units of one to three hours by kind."""
    return ed.group_by_role(_ivl(spark, sf_dir).select("key", "s", "id", (F.col("e") - F.col("s")).alias("length"), F.col("kind").alias("role")), ["key"], HOUR, 3 * HOUR)


def split_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views cut at the clicks inside them."""
    cuts = _ivl(spark, sf_dir).where("kind <> 'view'").select("key", F.col("s").alias("t"))
    return ed.split_at(_ivl(spark, sf_dir, "view"), cuts, ["key"], WIDTH).select("id", "part", "s", "e")


def tiled_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each user's views leave of the month's ends."""
    return ed.tile_to_ends(_ivl(spark, sf_dir, "view"), ["key"], 0, MONTH, HOUR)


def flat_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks of each user as one timeline; a click's type is the kind of the longest event."""
    content = _ivl(spark, sf_dir, "view").withColumn("type", F.col("kind"))
    moves = _ivl(spark, sf_dir, "click").withColumn("type", F.lit(None).cast("string"))
    longest = _ivl(spark, sf_dir).groupBy("key").agg(F.max_by("kind", F.struct(F.col("e") - F.col("s"), "id")).alias("type"))
    return ed.flatten_timeline(content, moves, longest, ["key"]).select("id", "type", "place")


def fitted_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sub-intervals of events on the user's clock, and fitted to a quarter to one hour inside the event (I32)."""
    size = F.col("e") - F.col("s")
    inner_s, inner_e = F.floor(size * (F.col("id") % 4) / 5), F.floor(size * (F.col("id") % 7) / 5)
    relative = F.col("id") % 3 != 0
    s, e, ok = ed.normalise_interval(F.when(relative, inner_s).otherwise(F.col("s") + inner_s), F.when(relative, inner_e).otherwise(F.col("s") + inner_e), relative, F.col("s"), F.col("e"), MINUTE)
    rows = _ivl(spark, sf_dir).select("id", F.col("s").alias("lo"), F.col("e").alias("hi"), s.alias("s"), e.alias("e"), ok.alias("ok")).where("ok")
    a, b = ed.fit_interval(F.col("s"), F.col("e"), F.col("lo"), F.col("hi"), 15 * MINUTE, HOUR)
    return rows.select("id", "s", "e", a.alias("fit_s"), b.alias("fit_e"))


def issue_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the views that errors fall in, eight a user."""
    cuts = _ivl(spark, sf_dir, "view").withColumn("idx", F.row_number().over(Window.partitionBy("key").orderBy("s", "id")).cast("long"))
    return ed.first_cut(_ivl(spark, sf_dir, "error").select("key", "id", F.col("s").alias("t")), cuts, ["key"], 5 * MINUTE, WIDTH, 8).select("key", "idx", "place")


def covered_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors that one long event of the user covers from end to end."""
    support = _ivl(spark, sf_dir).where("kind <> 'error'").withColumn("visible", F.col("e") - F.col("s") > 30 * MINUTE)
    return ed.covered_whole(_ivl(spark, sf_dir, "error").select("key", "id", "s", "e"), support, ["key"], WIDTH).select("id", "sufficient")


def beat_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the month between purchases, an hour at least, twelve a user."""
    return ed.cut_plan(_ivl(spark, sf_dir, "purchase").select("key", F.col("s").alias("t")), ["key"], MONTH, HOUR, 12)


def evidence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run of turns of each conversation, 400 characters at most, that shares most with its first turn (V9)."""
    turns = table(spark, sf_dir, "conversations")
    shots = turns.where("turn > 0").select("conv_id", F.col("turn").alias("idx"), F.length("text").cast("long").alias("length"), "text")
    return ed.evidence_window(shots, ["conv_id"], turns.where("turn = 0").select("conv_id", "text"), 400)


#: Sections of the month and their shares of a plan: ratio, least, most.
SHAPE = ((0, 0.3, 0.1, 0.45), (1, 0.25, 0.1, 0.4), (2, 0.2, 0.05, 0.35), (3, 0.15, 0.0, 0.3), (4, 0.1, 0.0, 0.3))


def _plan_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ivl(spark, sf_dir).withColumns({"section": F.least(F.lit(4), F.floor(F.col("s") * 5 / MONTH)), "phase": F.col("kind"), "take": F.col("id") % 2})
    shape = spark.createDataFrame(SHAPE, "section long, ratio double, least double, most double")
    phases = shape.select("section", F.explode(F.array(F.lit("view"), F.lit("click"), F.lit("purchase"))).alias("phase"))
    return ed.plan_scores(ed.candidate_plans(rows, ["key"], phases), ["key"], shape, HOUR, 2 * HOUR, 60 * HOUR)


def edit_plan_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and problems of each plan of each user: one event of each kind for each fifth of the month."""
    return _plan_scores(spark, sf_dir)


def edit_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best legal plan of each user."""
    return ed.select_plan(_plan_scores(spark, sf_dir), ["key"])


def role_montage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Montage of each user's events by kind."""
    units = _ivl(spark, sf_dir).select("key", "id", "s", "e", F.col("kind").alias("role"), F.floor((F.col("e") - F.col("s")) / MINUTE % 97).alias("value"))
    return ed.montage(units, ["key"], ["view", "click", "purchase"], 8, 6 * HOUR, 2 * HOUR, 10 * HOUR)


def phase_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations whose turns alternate exactly as asked, each of a legal length."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), F.col("role").alias("phase"), F.length("text").alias("length"))
    asked = F.array(*(F.lit(x) for x in ("user", "assistant", "user", "assistant")))
    return ed.partition_phases(turns, ["conv_id"], asked, 4, 1500)


def watch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve windows of each user around events other than views, covering all kinds, and three quiet ones at short views."""
    rows = _ivl(spark, sf_dir)
    seen = rows.where("kind <> 'view'").select("key", "id", F.col("s").alias("t"), F.array("kind").alias("types"), (F.col("id") % 100 / 100.0).alias("confidence"))
    quiet = rows.where("kind = 'view'").select("key", F.col("s").alias("t"), (F.col("e") - F.col("s")).alias("act"))
    out = ed.plan_windows(seen, quiet, ["key"], 30 * MINUTE, 25 * MINUTE, 125 * MINUTE, 12, 3, HOUR, 2 * HOUR, MONTH)
    return out.select("key", "s", "e", F.concat_ws(",", F.array_sort("types")).alias("types"), "confidence", "n", "control")


QUERIES = {
    f.__name__: f
    for f in (
        watch_windows, merge_compatible, merge_gap_questions, role_units, split_shots, tiled_ends, flat_timeline, fitted_intervals, issue_cuts, covered_claims, beat_cuts,
        evidence_windows, edit_plans, edit_plan_problems, role_montage, phase_partitions,
    )
}

_IVL = f"WITH {EVENT_INTERVALS_SQL}"


def _merge_sql(form: str, attrs: str, near: str) -> str:
    """All rows of a key in one fold: what is far apart cannot meet, so it gives the same groups as stretches do."""
    return f"""{_IVL}, l AS (SELECT key, list({{'s': s, 'e': e, 'form': {form}, 'action': kind, 'attrs': {attrs}, 'needed': e - s > {HOUR}, 'n': 1::BIGINT}} ORDER BY s, e, id) AS l FROM ivl GROUP BY key),
f AS (SELECT key, list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda g: {near} AND g.form = y[1].form AND (g.action = y[1].action OR list_has_any(g.attrs, y[1].attrs)))) = 0 THEN list_concat(acc, y)
ELSE list_transform(acc, lambda g, i: CASE WHEN i = list_position(list_transform(acc, lambda g: {near} AND g.form = y[1].form AND (g.action = y[1].action OR list_has_any(g.attrs, y[1].attrs))), true)
THEN {{'s': least(g.s, y[1].s), 'e': greatest(g.e, y[1].e), 'form': g.form, 'action': g.action, 'attrs': list_distinct(list_concat(g.attrs, y[1].attrs)), 'needed': g.needed OR y[1].needed, 'n': g.n + 1}} ELSE g END) END) AS g FROM l),
u AS (SELECT key, unnest(g) AS g FROM f)"""


_HAN = "regexp_replace({0}, '[^\\p{{Han}}]', '', 'g')"


def _shingles_sql(x: str) -> str:
    han = _HAN.format(x)
    return f"list_distinct(list_concat(CASE WHEN len({han}) < 2 THEN []::VARCHAR[] ELSE list_transform(range(1, len({han})), lambda i: substring({han}, i, 2)) END, regexp_extract_all(lower({x}), '[a-z0-9]+')))"


_PLANS_SQL = f"""{_IVL}, shape(section, ratio, lo, hi) AS (VALUES {', '.join(str(x) for x in SHAPE)}), m AS (SELECT *, least(4, s * 5 // {MONTH}) AS section, id % 2 AS take FROM ivl WHERE kind IN ('view', 'click', 'purchase')),
p AS (SELECT key, 'shortest' AS strategy, section, id, s, e, take FROM m QUALIFY row_number() OVER (PARTITION BY key, section, kind ORDER BY e - s, s, id) = 1
UNION ALL SELECT key, 'longest', section, id, s, e, take FROM m QUALIFY row_number() OVER (PARTITION BY key, section, kind ORDER BY e - s DESC, s, id) = 1
UNION ALL SELECT key, 'earliest', section, id, s, e, take FROM m QUALIFY row_number() OVER (PARTITION BY key, section, kind ORDER BY s, id) = 1),
o AS (SELECT *, greatest(0, lag(e) OVER (PARTITION BY key, strategy, section ORDER BY s, id) - s) AS over, count(*) OVER (PARTITION BY key, strategy) AS c FROM p),
t AS (SELECT DISTINCT a.key, a.strategy FROM o a JOIN o b ON a.key = b.key AND a.strategy = b.strategy AND a.take = b.take AND a.id <> b.id AND a.s < b.e AND b.s < a.e),
x AS (SELECT key, strategy, section, sum(e - s) AS span, coalesce(sum(over), 0) AS over, count(*) AS n FROM o WHERE c = 15 GROUP BY 1, 2, 3),
w AS (SELECT key, strategy, any_value(total) AS total, sum(over) AS over, sum(n) AS n, bool_or(NOT span / greatest(total, 1) BETWEEN lo - 0.05::DOUBLE AND hi + 0.05::DOUBLE) AS outside, sum(abs(span / greatest(total, 1) - ratio::DOUBLE)) AS error
 FROM (SELECT *, sum(span) OVER (PARTITION BY key, strategy) AS total FROM x) JOIN shape USING (section) GROUP BY 1, 2),
z AS (SELECT key, strategy, array_to_string(list_filter([CASE WHEN NOT total BETWEEN {2 * HOUR} AND {60 * HOUR} THEN 'length' END, CASE WHEN outside THEN 'section budget' END, CASE WHEN (key, strategy) IN (SELECT (key, strategy) FROM t) THEN 'overlap in a take' END], lambda q: q IS NOT NULL), ',') AS problems,
 round(least(n, 12) / 12.0::DOUBLE * 2 - over / {HOUR}::DOUBLE - 1.5::DOUBLE * error, 4) AS score FROM w)"""

ORACLE_SQL = {
    "watch_windows": f"""{_IVL}, l AS (SELECT key, list([{{'s': s - {30 * MINUTE}, 'e': s + {30 * MINUTE}, 'types': [kind], 'confidence': id % 100 / 100.0::DOUBLE, 'n': 1::BIGINT}}] ORDER BY s, id) AS l FROM ivl WHERE kind <> 'view' GROUP BY key),
f AS (SELECT key, list_sort(list_reduce(l, lambda acc, y: CASE WHEN y[1].s - acc[-1].e < {25 * MINUTE} AND y[1].e - acc[-1].s <= {125 * MINUTE}
THEN list_concat(acc[:-2], [{{'s': acc[-1].s, 'e': greatest(acc[-1].e, y[1].e), 'types': list_distinct(list_concat(acc[-1].types, y[1].types)), 'confidence': greatest(acc[-1].confidence, y[1].confidence), 'n': acc[-1].n + 1}}]) ELSE list_concat(acc, y) END)) AS w FROM l),
a AS (SELECT key, w, list_distinct(flatten(list_transform(w, lambda x: x.types))) AS every FROM f),
c AS (SELECT key, w, CASE WHEN len(w) <= 12 THEN []::BIGINT[] ELSE (list_reduce(list_transform(every, lambda z: {{'covered': []::VARCHAR[], 'kept': []::BIGINT[]}}), lambda acc, z: CASE WHEN len(acc.covered) >= len(every) OR len(acc.kept) >= 12 THEN acc ELSE
 list_transform([-list_sort(list_filter(list_transform(w, lambda x, i: {{'new': len(list_filter(x.types, lambda q: NOT list_contains(acc.covered, q))), 'confidence': x.confidence, 'k': -i}}), lambda r: NOT list_contains(acc.kept, -r.k)), 'DESC')[1].k],
 lambda p: {{'covered': list_distinct(list_concat(acc.covered, w[p].types)), 'kept': list_append(acc.kept, p)}})[1] END, {{'covered': []::VARCHAR[], 'kept': []::BIGINT[]}})).kept END AS first FROM a),
k AS (SELECT key, list_sort(list_transform(list_concat(first, (list_filter(list_transform(list_sort(list_transform(w, lambda x, i: {{'c': -x.confidence, 'i': i}})), lambda r: r.i), lambda i: NOT list_contains(first, i)))[1:12 - len(first)]), lambda i: {{'s': greatest(w[i].s, 0), 'e': least(w[i].e, {MONTH}), 'types': w[i].types, 'confidence': w[i].confidence, 'n': w[i].n}})) AS w FROM c),
q AS (SELECT key, list(s ORDER BY e - s, s) AS t FROM ivl WHERE kind = 'view' GROUP BY key),
z AS (SELECT key, list_reduce(list_transform(coalesce(t, []), lambda v: [{{'s': v, 'e': v, 'types': []::VARCHAR[], 'confidence': 0.0::DOUBLE, 'n': 0::BIGINT}}]), lambda acc, y: CASE WHEN len(list_filter(acc, lambda x: x.n = 0)) >= 3
 OR len(list_filter(acc, lambda x: x.s - {HOUR} <= y[1].s AND y[1].s <= x.e + {HOUR})) > 0 OR (y[1].s < acc[-1].e AND len(list_filter(acc, lambda x: x.n = 0 AND abs(2 * y[1].s - x.s - x.e) < {4 * HOUR})) > 0) THEN acc
 ELSE list_concat(acc, list_transform(y, lambda x: {{'s': greatest(0, x.s - {30 * MINUTE}), 'e': least({MONTH}, x.s + {30 * MINUTE}), 'types': x.types, 'confidence': x.confidence, 'n': x.n}})) END, w) AS w FROM k LEFT JOIN q USING (key)),
u AS (SELECT key, unnest(w) AS x FROM z) SELECT key, x.s AS s, x.e AS e, array_to_string(list_sort(x.types), ',') AS types, x.confidence AS confidence, x.n AS n, x.n = 0 AS control FROM u""",
    "merge_compatible": f"""{_merge_sql("id % 2", "[id % 5]", f"y[1].s <= g.e + {20 * MINUTE} AND g.s <= y[1].e + {20 * MINUTE}")}
SELECT key, g.s AS s, g.e AS e, g.form AS form, g.action AS action, array_to_string(list_sort(g.attrs), ',') AS attrs, g.n AS n FROM u""",
    "merge_gap_questions": f"""{_merge_sql("0::BIGINT", "[]::BIGINT[]", "y[1].s < g.e AND g.s < y[1].e")} SELECT key, g.s AS s, g.e AS e, g.action AS action, g.needed AS needed, g.n AS n FROM u""",
    "role_units": f"""{_IVL}, l AS (SELECT key, list({{'length': e - s, 'role': kind, 'n': 1::BIGINT}} ORDER BY s, id) AS l FROM ivl GROUP BY key),
f AS (SELECT key, list_reduce(list_transform(l, lambda x: [x]), lambda acc, y: CASE WHEN acc[-1].length + y[1].length <= {3 * HOUR} AND (acc[-1].length < {HOUR} OR acc[-1].role = y[1].role)
THEN list_concat(acc[:-2], [{{'length': acc[-1].length + y[1].length, 'role': y[1].role, 'n': acc[-1].n + 1}}]) ELSE list_concat(acc, y) END) AS g FROM l),
u AS (SELECT key, unnest(g) AS g, generate_subscripts(g, 1) - 1 AS unit FROM f) SELECT key, unit, g.length AS length, g.role AS role, g.n AS n FROM u""",
    "split_shots": f"""{_IVL}, b AS (SELECT a.id, list_sort(list_concat([a.s, a.e], coalesce(list(DISTINCT c.s) FILTER (c.s IS NOT NULL), []))) AS b FROM ivl a LEFT JOIN ivl c ON c.key = a.key AND c.kind <> 'view' AND c.s > a.s AND c.s < a.e WHERE a.kind = 'view' GROUP BY a.id, a.s, a.e),
p AS (SELECT id, b, unnest(range(1, len(b))) AS i FROM b) SELECT id, i - 1 AS part, b[i] AS s, b[i + 1] AS e FROM p""",
    "tiled_ends": f"""{_IVL}, x AS (SELECT key, min(s) AS f, max(e) AS l FROM ivl WHERE kind = 'view' GROUP BY key), u AS (SELECT key, 'head' AS side, 0 AS s, f AS e FROM x UNION ALL SELECT key, 'tail', l, {MONTH} FROM x) SELECT * FROM u WHERE e - s > {HOUR}""",
    "flat_timeline": f"""{_IVL}, m AS (SELECT key, arg_max(kind, (e - s, id)) AS type FROM ivl GROUP BY key)
SELECT id, CASE WHEN kind = 'view' THEN kind ELSE type END AS type, row_number() OVER (PARTITION BY key ORDER BY s, e, id) AS place FROM ivl JOIN m USING (key) WHERE kind IN ('view', 'click')""",
    "fitted_intervals": f"""{_IVL}, a AS (SELECT id, s AS lo, e AS hi, s + (e - s) * (id % 4) // 5 AS s, s + (e - s) * (id % 7) // 5 AS e FROM ivl),
b AS (SELECT id, lo, hi, s, CASE WHEN e = s THEN s + {MINUTE} ELSE e END AS e FROM a), c AS (SELECT *, least(greatest(e - s, {15 * MINUTE}), {HOUR}, hi - lo) AS n FROM b WHERE s >= lo AND e <= hi AND e > s),
d AS (SELECT *, greatest(lo, least(CASE WHEN e - s < n THEN CAST(floor((s + e - n) / 2) AS BIGINT) ELSE s END, hi - n)) AS f FROM c) SELECT id, s, e, f AS fit_s, f + n AS fit_e FROM d""",
    "issue_cuts": f"""{_IVL}, c AS (SELECT key, s, e, row_number() OVER (PARTITION BY key ORDER BY s, id) AS idx FROM ivl WHERE kind = 'view'),
h AS (SELECT i.key, i.id, min(idx) AS idx FROM ivl i JOIN c ON c.key = i.key AND i.s >= c.s - {5 * MINUTE} AND i.s <= c.e + {5 * MINUTE} WHERE i.kind = 'error' GROUP BY 1, 2)
SELECT key, idx, row_number() OVER (PARTITION BY key ORDER BY idx) AS place FROM (SELECT DISTINCT key, idx FROM h) QUALIFY place <= 8""",
    "covered_claims": f"""{_IVL} SELECT id, EXISTS (SELECT 1 FROM ivl b WHERE b.key = a.key AND b.kind <> 'error' AND b.e - b.s > {30 * MINUTE} AND b.s <= a.s AND b.e >= a.e AND least(a.e, b.e) > greatest(a.s, b.s)) AS sufficient FROM ivl a WHERE kind = 'error'""",
    "beat_cuts": f"""{_IVL}, b AS (SELECT key, list_sort(list_distinct(list_concat([0, {MONTH}], list(s)))) AS b FROM ivl WHERE kind = 'purchase' AND s > 0 AND s < {MONTH} GROUP BY key),
p AS (SELECT key, list_filter(list_transform(range(1, len(b)), lambda i: {{'s': b[i], 'e': b[i + 1]}}), lambda x: x.e - x.s >= {HOUR}) AS p FROM b),
t AS (SELECT key, CASE WHEN len(p) <= 12 THEN p ELSE list_transform(range(0, 12), lambda i: p[i * len(p) // 12 + 1]) END AS p FROM p), u AS (SELECT key, unnest(p) AS x, generate_subscripts(p, 1) - 1 AS i FROM t) SELECT key, i, x.s AS s, x.e AS e FROM u""",
    "evidence_windows": f"""WITH q AS (SELECT conv_id, {_shingles_sql("text")} AS q FROM conversations WHERE turn = 0),
r AS (SELECT conv_id, turn AS idx, length(text) AS n, len(list_intersect({_shingles_sql("text")}, q)) AS h FROM conversations JOIN q USING (conv_id) WHERE turn > 0),
w AS (SELECT a.conv_id, a.idx AS first, b.idx AS last, sum(c.n) AS n, sum(c.h) AS h FROM r a JOIN r b ON b.conv_id = a.conv_id AND b.idx >= a.idx JOIN r c ON c.conv_id = a.conv_id AND c.idx BETWEEN a.idx AND b.idx GROUP BY 1, 2, 3)
SELECT conv_id, first, last, round(h / (last - first + 1), 6) AS score FROM w WHERE first = last OR n <= 400 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY h / (last - first + 1) DESC, least(n, 400) DESC, first, last) = 1""",
    "edit_plan_problems": f"{_PLANS_SQL} SELECT key, strategy, problems, score FROM z",
    "edit_plans": f"""{_PLANS_SQL} SELECT key, strategy, score FROM z WHERE problems = '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, list_position(['shortest', 'longest', 'earliest'], strategy)) = 1""",
    "role_montage": f"""{_IVL}, u AS (SELECT key, id, s, e, kind AS role, CAST(floor((e - s) / {MINUTE}::DOUBLE % 97) AS BIGINT) AS value FROM ivl), k AS (SELECT *, CASE WHEN role IN ('view', 'click', 'purchase') AND row_number() OVER (PARTITION BY key, role ORDER BY value DESC, s, id) = 1 THEN 1 ELSE 0 END AS lead FROM u),
l AS (SELECT key, list({{'length': e - s, 'roles': [role], 'ids': [id], 'lead': lead}} ORDER BY lead DESC, value DESC, s, id) AS l FROM k GROUP BY key),
f AS (SELECT key, list_reduce(l, lambda acc, x: CASE WHEN x.lead = 0 AND (len(acc.ids) >= 8 OR acc.length + x.length > {10 * HOUR} OR (acc.length >= {2 * HOUR} AND len(acc.roles) >= 3 AND acc.length + x.length > {6 * HOUR})) THEN acc
ELSE {{'length': acc.length + x.length, 'roles': list_distinct(list_concat(acc.roles, x.roles)), 'ids': list_concat(acc.ids, x.ids), 'lead': 0}} END, {{'length': 0::BIGINT, 'roles': []::VARCHAR[], 'ids': []::BIGINT[], 'lead': 0}}) AS p FROM l)
SELECT key, len(p.ids) AS n, p.length AS length, array_to_string(list_sort(p.ids), ',') AS ids, CASE WHEN len(p.ids) < 3 THEN 'few' WHEN NOT list_contains(p.roles, 'view') THEN 'no hook' WHEN len(p.roles) < 3 THEN 'few roles' WHEN p.length < {2 * HOUR} THEN 'short' WHEN p.length > {10 * HOUR} THEN 'long' ELSE 'passed' END AS verdict FROM f""",
    "phase_partitions": """WITH g AS (SELECT conv_id, array_to_string(list(role ORDER BY turn), '>') AS phases, bool_and(length(text) BETWEEN 4 AND 1500) AS in_range FROM conversations GROUP BY 1)
SELECT conv_id, phases, in_range, phases = 'user>assistant>user>assistant' AS complete FROM g""",
}
