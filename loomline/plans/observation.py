"""Windows, merged texts and new claims over the event timeline of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import observation as ob
from loomline.plans.timeline import MINUTE, MONTH
from loomline.sources.driver_tables import EVENT_INTERVALS_SQL, event_intervals

HOUR = 60 * MINUTE
_IVL = f"WITH RECURSIVE {EVENT_INTERVALS_SQL}"


def aligned_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 24 windows of each user's month, bounded by purchases and sign-ups and, in long stretches, by clicks; every fifth user has no cuts."""
    rows = event_intervals(spark, sf_dir)
    spans = rows.select("key").distinct().withColumn("hi", F.lit(MONTH).cast("long"))
    cuts = rows.where("kind IN ('purchase', 'signup', 'click') AND key % 5 <> 0").select("key", F.col("s").alias("t"), (F.col("kind") != "click").alias("hard"))
    return ob.event_windows(spans, cuts, ["key"], 36 * HOUR, 8 * HOUR, 24)


def merged_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts seen at views and errors of each user and heard at the other events, each once."""
    rows, n = event_intervals(spark, sf_dir), (F.col("id") % 12).cast("string")
    seen = rows.where("kind IN ('view', 'error')").withColumn("text", F.when(F.col("id") % 3 == 0, F.concat(F.lit("ＩＴＥＭ "), n)).otherwise(F.concat(F.lit("Item-"), n, F.lit("!"))))
    said = F.when(F.col("id") % 4 == 0, F.concat(F.lit("item "), n)).when(F.col("id") % 4 == 1, F.concat(F.lit("The item "), n, F.lit(" again.")))
    said = said.when(F.col("id") % 4 == 2, F.concat(F.lit("item"), (F.col("id") % 7).cast("string"))).otherwise(F.concat(F.lit("note "), (F.col("id") % 50).cast("string")))
    heard = rows.where("kind NOT IN ('view', 'error')").withColumn("text", said)
    return ob.merge_signals(seen.select("key", "id", "text", "s", "e"), heard.select("key", "id", "text", "s", "e"), ["key"])


def new_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user, with 18 hours on both sides, that no earlier one of their kind covers in time and marks (2.8)."""
    rows = event_intervals(spark, sf_dir).select("key", "id", (F.col("s") - 18 * HOUR).alias("s"), (F.col("e") + 18 * HOUR).alias("e"), F.array_distinct(F.array(F.col("id") % 2, F.col("id") % 3)).alias("goals"), F.when(F.col("kind") != "signup", F.col("kind")).alias("relation"))
    return ob.unique_claims(rows, ["key"]).select("key", "id", "relation")


QUERIES = {f.__name__: f for f in (aligned_windows, merged_signals, new_claims)}

_TEXT = "lower(regexp_replace(translate({0}, 'ＩＴＥＭ', 'ITEM'), '[^\\p{{L}}\\p{{N}}]', '', 'g'))"

ORACLE_SQL = {
    "aligned_windows": f"""{_IVL}, k AS (SELECT DISTINCT key FROM ivl),
c AS (SELECT key, s AS t, bool_or(kind <> 'click') AS hard FROM ivl WHERE kind IN ('purchase', 'signup', 'click') AND key % 5 <> 0 AND s > 0 AND s < {MONTH} GROUP BY 1, 2),
h AS (SELECT key, t FROM c WHERE hard UNION ALL SELECT DISTINCT key, 0 FROM c), p AS (SELECT key, t AS lo, coalesce(lead(t) OVER (PARTITION BY key ORDER BY t), {MONTH}) AS hi FROM h),
q AS (SELECT p.key, lo, hi, coalesce(list(c.t ORDER BY c.t) FILTER (c.t IS NOT NULL), []) AS cuts FROM p LEFT JOIN c ON c.key = p.key AND NOT c.hard AND c.t > lo AND c.t < hi GROUP BY 1, 2, 3),
b AS (SELECT key, lo, hi, list_append(list_reduce(list_transform(cuts, lambda t: [t]), lambda acc, x: CASE WHEN x[1] - acc[-1] >= {8 * HOUR} AND hi - x[1] >= {8 * HOUR} THEN list_concat(acc, x) ELSE acc END, [lo]), hi) AS b FROM q),
w AS (SELECT key, lo, hi, CASE WHEN hi - lo <= {36 * HOUR} THEN [{{'s': lo, 'e': hi}}] ELSE list_reduce(list_transform(range(1, len(b)), lambda i: [{{'s': b[i], 'e': b[i + 1]}}]), lambda acc, x: CASE WHEN x[1].e - acc[-1].s <= {36 * HOUR}
 THEN list_concat(acc[:-2], [{{'s': acc[-1].s, 'e': x[1].e}}]) ELSE list_concat(acc, x) END) END AS w FROM b),
l AS (SELECT key, flatten(list(w ORDER BY lo)) AS l FROM w GROUP BY key),
short(key, l) AS (SELECT key, l FROM l UNION ALL SELECT key, CASE WHEN i > 1 AND (i = len(l) OR l[i - 1].e - l[i - 1].s <= l[i + 1].e - l[i + 1].s) THEN list_concat(list_concat(l[:i - 2], [{{'s': l[i - 1].s, 'e': l[i].e}}]), l[i + 1:]) ELSE list_concat(list_concat(l[:i - 1], [{{'s': l[i].s, 'e': l[i + 1].e}}]), l[i + 2:]) END
 FROM (SELECT key, l, list_position(list_transform(l, lambda x: x.e - x.s < {8 * HOUR}), true) AS i FROM short WHERE len(l) > 1) WHERE i > 0),
long_(key, l) AS (SELECT key, l FROM short WHERE len(l) = 1 OR len(list_filter(l, lambda x: x.e - x.s < {8 * HOUR})) = 0),
many(key, l) AS (SELECT key, l FROM long_ UNION ALL SELECT key, list_concat(list_concat(l[:i - 1], [{{'s': l[i].s, 'e': l[i + 1].e}}]), l[i + 2:]) FROM
 (SELECT key, l, list_position(cost, list_min(cost)) AS i FROM (SELECT key, l, list_transform(range(1, len(l)), lambda j: l[j + 1].e - l[j].s) AS cost FROM many WHERE len(l) > 24))),
u AS (SELECT key, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS idx FROM many WHERE len(l) <= 24)
SELECT key, idx, x.s AS s, x.e AS e, EXISTS (SELECT 1 FROM c WHERE c.key = u.key AND c.hard AND c.t IN (x.s, x.e)) AS hard, EXISTS (SELECT 1 FROM c WHERE c.key = u.key AND NOT c.hard AND c.t IN (x.s, x.e)) AS soft FROM u
UNION ALL SELECT key, i, {MONTH} * i // n, {MONTH} * (i + 1) // n, false, false FROM k, (SELECT least(24, ceil({MONTH} / {36 * HOUR}::DOUBLE))::BIGINT AS n), range(n) r(i) WHERE key NOT IN (SELECT key FROM c)""",
    "merged_signals": f"""{_IVL}, m AS (SELECT key, id, s, e, CASE WHEN id % 3 = 0 THEN 'ＩＴＥＭ ' || id % 12 ELSE 'Item-' || id % 12 || '!' END AS text FROM ivl WHERE kind IN ('view', 'error')),
a AS (SELECT key, id, s, e, CASE id % 4 WHEN 0 THEN 'item ' || id % 12 WHEN 1 THEN 'The item ' || id % 12 || ' again.' WHEN 2 THEN 'item' || id % 7 ELSE 'note ' || id % 50 END AS text FROM ivl WHERE kind NOT IN ('view', 'error')),
g AS (SELECT key, {_TEXT.format("text")} AS t, min(id) AS id, arg_min(text, id) AS text, min(s) AS s, max(e) AS e, count(*) AS n FROM m GROUP BY 1, 2),
seen AS (SELECT key, list({{'t': t, 'text': text, 's': s, 'e': e, 'nm': n, 'ns': 0::BIGINT}} ORDER BY id) AS l FROM g GROUP BY key),
heard AS (SELECT key, list({{'t': {_TEXT.format("text")}, 'text': text, 's': s, 'e': e, 'nm': 0::BIGINT, 'ns': 1::BIGINT}} ORDER BY id) AS h FROM a GROUP BY key),
f AS (SELECT key, list_reduce(list_transform(coalesce(h, []), lambda x: [x]), lambda acc, y: list_transform([coalesce(nullif(list_position(list_transform(acc, lambda z: z.t), y[1].t), 0),
  list_position(list_transform(acc, lambda z: (contains(z.t, y[1].t) OR contains(y[1].t, z.t)) AND least(z.e, y[1].e) > greatest(z.s, y[1].s)), true))], lambda p: CASE WHEN coalesce(p, 0) = 0 THEN list_concat(acc, y) ELSE
  list_transform(acc, lambda z, i: CASE WHEN i = p THEN {{'t': z.t, 'text': z.text, 's': least(z.s, y[1].s), 'e': greatest(z.e, y[1].e), 'nm': z.nm, 'ns': z.ns + 1}} ELSE z END) END)[1], coalesce(l, [])) AS o FROM seen FULL JOIN heard USING (key)),
u AS (SELECT key, unnest(o) AS x, generate_subscripts(o, 1) - 1 AS entry FROM f) SELECT key, entry, x.text AS text, x.s AS s, x.e AS e, x.nm AS n_marks, x.ns AS n_speech FROM u""",
    "new_claims": f"""{_IVL}, r AS (SELECT key, id, s - {18 * HOUR} AS s, e + {18 * HOUR} AS e, list_distinct([id % 2, id % 3]) AS goals, CASE WHEN kind = 'signup' THEN 'uncertain' ELSE kind END AS relation FROM ivl),
l AS (SELECT key, relation, list([{{'id': id, 's': s, 'e': e, 'goals': goals}}] ORDER BY id) AS l FROM r GROUP BY 1, 2),
f AS (SELECT key, relation, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: list_has_all(y.goals, x[1].goals) AND (x[1].s + x[1].e BETWEEN 2 * y.s AND 2 * y.e
 OR 2 * greatest(0, least(x[1].e, y.e) - greatest(x[1].s, y.s)) > greatest(x[1].e, y.e) - least(x[1].s, y.s)))) > 0 THEN acc ELSE list_concat(acc, x) END) AS k FROM l),
u AS (SELECT key, relation, unnest(k) AS k FROM f) SELECT key, k.id AS id, relation FROM u""",
}
