"""Words, captions, identifiers and patches over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions import wording as wd
from loomline.functions.text import tags
from loomline.operators import rules
from loomline.plans.timeline import MONTH
from loomline.sources.driver_tables import EVENT_INTERVALS_SQL, event_intervals, table

LANGUAGES, MOODS = ("EN", "FR"), ("CLICK", "VIEW")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with the text of the turn before."""
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").withColumn("before", F.lag("text").over(order))


def story_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose purchases run through the month."""
    spans = event_intervals(spark, sf_dir).where("kind = 'purchase' AND e > s").groupBy("key").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return spans.select("key", wd.temporal_coverage(F.col("s"), F.col("e"), F.lit(MONTH)).alias("covered"))


def junk_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by source and whether their text has a mark of junk."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source", wd.is_junk(F.col("text"), ("|", "&&&", "###")).alias("junk")).agg(F.count(F.lit(1)).alias("n"))


def library_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of two libraries, one whole and one of a language, by name (F8)."""
    docs = table(spark, sf_dir, "documents").withColumn("name", F.concat_ws("__", "source", "lang"))
    return docs.where(wd.in_library(F.col("name"), "src1, src2__fr")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


def suppressed_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that use one of the first sixty long words of the benchmark and name no nation."""
    item = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{6,}"), F.lit(0))).alias("term"))
    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"))
    kept = rules.drop_suppressed(table(spark, sf_dir, "conversations").withColumn("text", F.lower("text")), "text", item, names, 60)
    return kept.groupBy("role", "dropped").agg(F.count(F.lit(1)).alias("n"))


def grounded_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles that each turn shares with the one before, and whether they ground it."""
    rows = _turns(spark, sf_dir).where("before IS NOT NULL")
    return rows.select("conv_id", "turn", wd.shared_shingles(F.col("text"), F.col("before")).alias("shared"), wd.is_grounded(F.col("text"), F.col("before")).alias("grounded"))


def surface_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stems of each turn that the turn before has too."""
    rows = _turns(spark, sf_dir).where("before IS NOT NULL").select("conv_id", "turn", wd.leaks(F.col("text"), F.col("before"), ("where",)).alias("l"))
    return rows.select("conv_id", "turn", F.size("l").cast("long").alias("n"), F.concat_ws(",", "l").alias("stems"))


def event_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, mood and event tags of marked-up event names."""
    marked = F.concat(F.lit("<|"), "event_type", F.lit("|> text <|"), F.when(F.col("user_id") % 2 == 0, "en").otherwise("laughter"), F.lit("|><|bgm|>"))
    rows = table(spark, sf_dir, "events").select(wd.split_tags(tags(marked), LANGUAGES, MOODS).alias("t"))
    return rows.select("t.language", "t.mood", F.concat_ws(",", "t.events").alias("events")).groupBy("language", "mood", "events").agg(F.count(F.lit(1)).alias("n"))


def title_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose name agrees with a cut, shouted or foreign title."""
    k = F.col("p_partkey") % 4
    other = F.when(k == 0, F.concat(F.upper("p_name"), F.lit(" !"))).when(k == 1, F.substring("p_name", 1, 4)).when(k == 2, F.col("p_brand")).otherwise(F.lit("--"))
    return table(spark, sf_dir, "part").select("p_partkey", wd.titles_agree(F.col("p_name"), other).alias("agrees"))


def canonical_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical ids of parts, and the hash of what they stand for."""
    kind = F.when(F.col("p_size") % 2 == 0, "prop")
    return table(spark, sf_dir, "part").select("p_partkey", wd.canonical_id(kind, F.col("p_brand"), F.col("p_name")).alias("cid"), wd.content_hash(F.col("p_brand"), F.col("p_name"), F.col("p_size")).alias("mark"))


def namespaced_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ids made unique by the day."""
    rows = event_intervals(spark, sf_dir).select("id", F.floor(F.col("s") / 86_400_000_000).cast("int").alias("day"))
    return rows.select("id", wd.namespaced(F.col("day"), F.col("id").cast("string")).alias("name"))


def frame_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame nearest to size over price class, by part."""
    height = F.floor(F.col("p_retailprice") / 50) % 30 + 1
    return table(spark, sf_dir, "part").select("p_partkey", wd.nearest_ratio(F.col("p_size").cast("double"), height.cast("double")).alias("frame"))


def boundary_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundaries of each user's log: another kind of event, ten minutes or more after the last."""
    order = Window.partitionBy("key").orderBy("s", "id")
    rows = event_intervals(spark, sf_dir).select("key", "id", "kind", F.lag("kind").over(order).alias("before"), (F.col("s") - F.lag("s").over(order)).alias("apart"))
    return rows.select("id", wd.differing(F.col("kind"), F.col("before"), F.col("apart") < 600_000_000).alias("boundary"))


def dimension_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags of an order's lines, then the line statuses not yet named, in the order of the lines."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"))), lambda x: x)
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(lines.alias("l"))
    both = F.array_union(F.array_distinct(F.transform("l", lambda x: x["l_returnflag"])), F.transform("l", lambda x: x["l_linestatus"]))
    return rows.select("l_orderkey", F.concat_ws(",", both).alias("dims"))


def patch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches made of events, by kind and whether they are allowed."""
    index = (F.col("user_id") % 7).cast("string")
    field = {"view": "/params/size", "click": "/status", "signup": "/interval", "error": "/name"}
    path = F.concat(F.lit("/assets/"), index, F.lit("/uri"))
    for kind, end in field.items():
        path = F.when(F.col("event_type") == kind, F.concat(F.lit("/operations/"), index, F.lit(end))).otherwise(path)
    value = F.when(F.col("value") >= 1, F.col("value"))
    ok = wd.patch_allowed(path, value, F.lit(5), F.lit(3))
    return table(spark, sf_dir, "events").groupBy("event_type", ok.alias("ok")).agg(F.count(F.lit(1)).alias("n"))


def patch_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's patches to one interval in time order: those that would empty it are rejected and the rest go on."""
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.when(F.col("event_type").isin("view", "click"), "s").otherwise("e").alias("field"), F.when(F.col("event_type") != "error", F.floor("value").cast("long")).alias("value"))
    return rules.apply_patches(rows, ["user_id"], ["ts", "event_id"], 0, 100)


QUERIES = {
    f.__name__: f
    for f in (
        story_coverage, junk_captions, library_scope, suppressed_terms, grounded_turns, surface_leaks, event_tags, title_agreement, canonical_ids,
        namespaced_events, frame_ratios, boundary_verdicts, dimension_union, patch_checks, patch_runs,
    )
}

_TURNS = "WITH t AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)"
_HAN = "regexp_replace({0}, '[^\\p{{Han}}]', '', 'g')"
_BIGRAMS = "CASE WHEN len({0}) < 2 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, len({0})), lambda i: substring({0}, i, 2))) END"


def _shingles_sql(x: str) -> str:
    return f"list_distinct(list_concat({_BIGRAMS.format(_HAN.format(x))}, regexp_extract_all(lower({x}), '[a-z0-9]+')))"


def _stems_sql(x: str) -> str:
    return f"list_transform(list_distinct(regexp_extract_all(lower({x}), '[a-z]{{5,}}|[\\x{{4e00}}-\\x{{9fff}}]{{2,}}')), lambda w: CASE WHEN len(w) >= 7 THEN regexp_replace(w, '(ing|ed|es|s)$', '') ELSE w END)"


_NORM = "regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
_SLUG = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'item')"

ORACLE_SQL = {
    "story_coverage": f"""WITH {EVENT_INTERVALS_SQL}, g AS (SELECT key, min(s) AS s, max(e) AS e FROM ivl WHERE kind = 'purchase' AND e > s GROUP BY key)
SELECT key, s * 10 <= {MONTH} * 3 AND e * 10 >= {MONTH} * 7 AND (e - s) * 2 >= {MONTH} AS covered FROM g""",
    "junk_captions": "SELECT source, coalesce(contains(text, '|') OR contains(text, '&&&') OR contains(text, '###'), false) AS junk, count(*) AS n FROM documents GROUP BY 1, 2",
    "library_scope": "SELECT concat_ws('__', source, lang) AS name, count(*) AS n FROM documents WHERE concat_ws('__', source, lang) IN ('src1', 'src2__fr') OR starts_with(concat_ws('__', source, lang), 'src1__') OR starts_with(concat_ws('__', source, lang), 'src2__fr__') GROUP BY 1",
    "suppressed_terms": """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{6,}')) AS term FROM benchmark), terms AS (SELECT list(term) AS l FROM (SELECT term FROM w ORDER BY term LIMIT 60)),
names AS (SELECT list(lower(n_name)) AS l FROM nation)
SELECT role, coalesce(len(list_filter(terms.l, lambda x: contains(lower(text), x))) > 0 AND len(list_filter(names.l, lambda x: contains(lower(text), x))) = 0, false) AS dropped, count(*) AS n FROM conversations, terms, names GROUP BY 1, 2""",
    "grounded_turns": f"""{_TURNS}, c AS (SELECT conv_id, turn, text, len(list_intersect({_shingles_sql("text")}, {_shingles_sql("before")})) AS shared FROM t WHERE before IS NOT NULL)
SELECT conv_id, turn, shared, shared >= CASE WHEN len(text) <= 2 THEN 1 ELSE 2 END AS grounded FROM c""",
    "surface_leaks": f"""{_TURNS}, c AS (SELECT conv_id, turn, list_sort(list_distinct(list_filter(list_intersect({_stems_sql("text")}, {_stems_sql("before")}), lambda x: x <> 'where'))) AS l FROM t WHERE before IS NOT NULL)
SELECT conv_id, turn, len(l) AS n, array_to_string(l, ',') AS stems FROM c""",
    "event_tags": """WITH x AS (SELECT upper(event_type) AS k, user_id % 2 = 0 AS en FROM events)
SELECT CASE WHEN en THEN 'EN' END AS language, CASE WHEN k IN ('CLICK', 'VIEW') THEN k END AS mood,
array_to_string(list_sort(list_filter(['BGM', CASE WHEN k NOT IN ('CLICK', 'VIEW') THEN k END, CASE WHEN NOT en THEN 'LAUGHTER' END], lambda t: t IS NOT NULL)), ',') AS events, count(*) AS n FROM x GROUP BY ALL""",
    "title_agreement": f"""WITH p AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) || ' !' WHEN 1 THEN substring(p_name, 1, 4) WHEN 2 THEN p_brand ELSE '--' END AS b FROM part),
n AS (SELECT p_partkey, {_NORM.format("a")} AS a, {_NORM.format("b")} AS b FROM p) SELECT p_partkey, coalesce(a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)), false) AS agrees FROM n""",
    "canonical_ids": f"""SELECT p_partkey, concat_ws(':', CASE WHEN p_size % 2 = 0 THEN 'prop' ELSE 'char' END, {_SLUG.format("p_brand")}, {_SLUG.format("p_name")}) AS cid,
sha256(CAST(to_json({{'p_brand': p_brand, 'p_name': p_name, 'p_size': p_size}}) AS VARCHAR)) AS mark FROM part""",
    "namespaced_events": f"WITH {EVENT_INTERVALS_SQL} SELECT id, format('w{{:03d}}_', CAST(floor(s / 86400000000) AS INT)) || id AS name FROM ivl",
    "frame_ratios": """WITH f(n, i, r) AS (VALUES ('16:9', 0, 16::DOUBLE / 9), ('9:16', 1, 9::DOUBLE / 16), ('1:1', 2, 1::DOUBLE), ('4:3', 3, 4::DOUBLE / 3), ('3:4', 4, 3::DOUBLE / 4), ('21:9', 5, 21::DOUBLE / 9))
SELECT p_partkey, arg_min(n, (abs(r - CAST(p_size AS DOUBLE) / (floor(p_retailprice / 50) % 30 + 1)), i)) AS frame FROM part, f GROUP BY 1""",
    "boundary_verdicts": f"""WITH {EVENT_INTERVALS_SQL}, o AS (SELECT id, kind, lag(kind) OVER w AS before, s - lag(s) OVER w AS apart FROM ivl WINDOW w AS (PARTITION BY key ORDER BY s, id))
SELECT id, coalesce(kind <> before AND NOT apart < 600000000, false) AS boundary FROM o""",
    "dimension_union": """WITH l AS (SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) || list(l_linestatus ORDER BY l_linenumber, l_partkey, l_returnflag, l_linestatus) AS l FROM lineitem GROUP BY 1)
SELECT l_orderkey, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS dims FROM l""",
    "patch_checks": """SELECT event_type, value >= 1 AND CASE event_type WHEN 'error' THEN false WHEN 'purchase' THEN user_id % 7 < 3 ELSE user_id % 7 < 5 END AS ok, count(*) AS n FROM events GROUP BY 1, 2""",
    "patch_runs": """WITH l AS (SELECT user_id, list({'f': CASE WHEN event_type IN ('view', 'click') THEN 's' ELSE 'e' END, 'v': CASE WHEN event_type <> 'error' THEN CAST(floor(value) AS BIGINT) END} ORDER BY ts, event_id) AS l FROM events GROUP BY 1),
f AS (SELECT user_id, list_reduce(list_transform(l, lambda x: {'s': CASE WHEN x.f = 's' THEN x.v END, 'e': CASE WHEN x.f = 'e' THEN x.v END, 'a': 0::BIGINT, 'r': 0::BIGINT}), lambda acc, x:
 CASE WHEN coalesce(coalesce(x.s, CASE WHEN x.e IS NOT NULL THEN acc.s END) < coalesce(x.e, acc.e), false) THEN {'s': coalesce(x.s, acc.s), 'e': coalesce(x.e, acc.e), 'a': acc.a + 1, 'r': acc.r} ELSE {'s': acc.s, 'e': acc.e, 'a': acc.a, 'r': acc.r + 1} END,
 {'s': 0::BIGINT, 'e': 100::BIGINT, 'a': 0::BIGINT, 'r': 0::BIGINT}) AS z FROM l)
SELECT user_id, z.s AS s, z.e AS e, z.a AS applied, z.r AS rejected FROM f""",
}
