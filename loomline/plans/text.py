"""Scalar text functions, triage and dictionary joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as tx
from loomline.operators import evidence as ev
from loomline.sources.driver_tables import table


def metadata_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons against each document: length outside 200 to 20,000, ad words, no source (F1)."""
    n = F.length("text")
    reasons = F.array_compact(
        F.array(
            F.when((n < 200) | (n > 20_000), F.lit("length")),
            F.when(F.lower("text").rlike("rights reserved|licensed under"), F.lit("license")),
            F.when(F.col("source").isNull(), F.lit("source")),
        )
    )
    docs = table(spark, sf_dir, "documents").withColumn("r", reasons)
    return docs.select("doc_id", F.concat_ws(",", "r").alias("reasons"), (F.size("r") == 0).alias("eligible"))


#: Words that vote for a category (fixed values).
CATEGORY_WORDS = {"en": ("the", "and", "with"), "de": ("der", "und", "mit"), "fr": ("les", "une", "avec"), "es": ("las", "una", "para")}


def category_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category with most contained words; the earlier one on ties; none without a vote (F2)."""
    text = F.lower("text")
    votes = [sum((F.contains(text, F.lit(f" {w} ")).cast("int") for w in words), F.lit(0)) for words in CATEGORY_WORDS.values()]
    best = F.greatest(*votes)
    pick = F.when(best == 0, None)
    for name, vote in zip(CATEGORY_WORDS, votes, strict=True):
        pick = pick.when(vote == best, name)
    return table(spark, sf_dir, "documents").select("doc_id", pick.alias("category"), best.cast("long").alias("votes"))


def content_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a known language, three lines and a length."""
    docs = table(spark, sf_dir, "documents").withColumn("lines", F.size(F.split("text", "\n", -1)))
    return docs.where(F.col("lang").isin("en", "fr", "de") & (F.col("lines") >= 3) & (F.col("n_chars") >= 400)).select("doc_id", F.col("lines").cast("long").alias("lines"))


def usable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation roles with sentinels taken as missing."""
    shown = F.when(F.col("turn") % 5 == 4, F.lit(" Unknown ")).otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(tx.usable(shown), F.lit("-")).alias("role"))


def bigram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of each benchmark item to the one after it."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("t"))
    nxt = items.select((F.col("item_id") - 1).alias("item_id"), F.col("t").alias("u"))
    both = items.join(nxt, "item_id")
    return both.select("item_id", F.size(F.array_intersect(tx.bigrams(F.col("t")), tx.bigrams(F.col("u")))).cast("long").alias("common"), tx.bigram_jaccard(F.col("t"), F.col("u")).alias("similarity"))


def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters and digits of the role and solid length of each turn."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(F.regexp_replace("text", r"\s", "")).cast("long").alias("solid"), tx.normalised(F.col("role")).alias("role"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token estimate, safe names, cut at the second marker, FNV-1a, time code."""
    pages = table(spark, sf_dir, "pages")
    return pages.select(
        "page_id",
        tx.token_estimate(F.col("url")).alias("tokens"),
        tx.snake_case(F.col("url")).alias("name"),
        tx.cut_repetition(F.col("html"), "<a ").alias("cut"),
        tx.fnv1a(F.col("url")).alias("fnv"),
        tx.time_code(F.col("page_id") * 37.25).alias("code"),
    )


def mention_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that contain the first word of a benchmark item."""
    names = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("entity"), F.regexp_extract("text", r"^[A-Za-z]+", 0).alias("alias")).where("alias <> ''")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return ev.mentions(turns, names).select("conv_id", "turn", "entity").distinct()


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page and its title's length, by pattern."""
    links = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", F.size(links).cast("long").alias("links"), F.length(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).cast("long").alias("title"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number inside each event's open JSON properties."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


QUERIES = {
    f.__name__: f
    for f in (metadata_triage, category_votes, content_gate, usable_text, bigram_jaccard, normalised_text, text_functions, mention_index, page_links, event_props)
}

_VOTES = {k: " + ".join(f"CASE WHEN contains(lower(text), ' {w} ') THEN 1 ELSE 0 END" for w in v) for k, v in CATEGORY_WORDS.items()}
_GRAMS = "list_distinct(list_transform(range(1, length({0})), lambda i: substring({0}, i, 2)))"

ORACLE_SQL = {
    "metadata_triage": """WITH r AS (SELECT doc_id, list_filter([CASE WHEN length(text) < 200 OR length(text) > 20000 THEN 'length' END,
CASE WHEN regexp_matches(lower(text), 'rights reserved|licensed under') THEN 'license' END, CASE WHEN source IS NULL THEN 'source' END], lambda x: x IS NOT NULL) AS r FROM documents)
SELECT doc_id, coalesce(array_to_string(r, ','), '') AS reasons, len(r) = 0 AS eligible FROM r""",
    "category_votes": f"""WITH v AS (SELECT doc_id, {", ".join(f"{e} AS v_{k}" for k, e in _VOTES.items())} FROM documents),
b AS (SELECT *, greatest({", ".join(f"v_{k}" for k in _VOTES)}) AS best FROM v)
SELECT doc_id, CASE WHEN best = 0 THEN NULL {" ".join(f"WHEN v_{k} = best THEN '{k}'" for k in _VOTES)} END AS category, CAST(best AS BIGINT) AS votes FROM b""",
    "content_gate": "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS lines FROM documents WHERE lang IN ('en', 'fr', 'de') AND len(string_split(text, chr(10))) >= 3 AND n_chars >= 400",
    "usable_text": "SELECT conv_id, turn, CASE WHEN turn % 5 = 4 THEN '-' WHEN trim(role) = '' THEN '-' ELSE trim(role) END AS role FROM conversations",
    "bigram_jaccard": f"""WITH t AS (SELECT item_id, text AS t FROM benchmark), p AS (SELECT a.item_id, {_GRAMS.format("a.t")} AS x, {_GRAMS.format("b.t")} AS y FROM t a JOIN t b ON b.item_id = a.item_id + 1)
SELECT item_id, CAST(len(list_intersect(x, y)) AS BIGINT) AS common, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) AS similarity FROM p""",
    "normalised_text": "SELECT conv_id, turn, length(regexp_replace(text, '\\s', '', 'g')) AS solid, regexp_replace(lower(role), '[^\\p{L}\\p{N}]', '', 'g') AS role FROM conversations",
    "text_functions": """WITH p AS (SELECT *, string_split(html, '<a ') AS parts, CAST(round(page_id * 37250) AS BIGINT) AS ms FROM pages)
SELECT page_id, CAST(floor(length(url) * 0.3::DOUBLE) AS BIGINT) AS tokens,
 coalesce(nullif(trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'variant') AS name,
 array_to_string(parts[1:2], '<a ') AS cut,
 list_reduce([CAST(ord(c) AS BIGINT) FOR c IN string_split(url, '')], lambda h, b: ((xor(h, b)) * 16777619) & 4294967295, 2166136261::BIGINT) AS fnv,
 printf('%02d:%02d:%02d,%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS code FROM p""",
    "mention_index": """WITH n AS (SELECT item_id AS entity, regexp_extract(text, '^[A-Za-z]+') AS alias FROM benchmark WHERE regexp_extract(text, '^[A-Za-z]+') <> '')
SELECT DISTINCT conv_id, turn, entity FROM conversations, n WHERE list_contains(regexp_split_to_array(text, '[^\\p{L}\\p{N}]+'), alias) AND contains(text, alias)""",
    "page_links": "SELECT page_id, len(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS links, length(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages",
    "event_props": "SELECT event_type, CAST(sum(TRY_CAST(props::JSON->>'$.k' AS BIGINT)) AS BIGINT) AS total, count(TRY_CAST(props::JSON->>'$.k' AS BIGINT)) AS n FROM events GROUP BY 1",
}
