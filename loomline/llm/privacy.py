"""Personal data: pattern spans, and terms whose co-occurrence in the corpus reveals a protected entity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.native import SPAN, let, spans_of
from loomline.llm.scratch import durable

#: Patterns in Java's syntax. Possessive repeats and the run-start guards change no match; they keep
#: the search linear: a match starts where a run of its first class starts or the last match ended.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET = r"(?<![A-Za-z0-9_])(?=(?:[0-9_]*+[A-Za-z]){4})(?=(?:[A-Za-z_]*+[0-9]){4})[A-Za-z0-9_]{32,}+"
KINDS = ("email", "ip", "card", "phone")
ENTITIES = (*KINDS, "secret")  # what terms may disclose; secrets are keys and tokens: 32 letters and digits or more, four of each at least
TERM = "term"
LETTER = r"\p{L}\p{M}"
TERM_PATTERN = rf"[{LETTER}]{{3,}}+"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """The check sum of a card number of 16 to 19 digits."""

    def total(digits: Column) -> Column:
        doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
        return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0

    def check(d: Column) -> Column:
        places = F.sequence(F.lit(1), F.length(d))
        return F.length(d).between(16, 19) & let(F.transform(places, lambda i: F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")), total)

    return let(_digits(value), check)


def _ip_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.coalesce(p.try_cast("long") <= 255, F.lit(False)))


def base_spans(text: Column) -> dict[str, Column]:
    """The base spans of each kind; matches that fail their check are dropped without a retry."""
    none = F.array().cast(f"array<{SPAN}>")
    found = {
        "email": F.when(F.contains(text, F.lit("@")), spans_of(text, EMAIL)),
        "ip": F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(spans_of(text, IP), lambda x: _ip_parts(x["value"]))),
        "card": F.when(text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]"), F.filter(spans_of(text, CARD), lambda x: _luhn(x["value"]))),
        "phone": F.when(F.contains(text, F.lit("+")), F.filter(spans_of(text, PHONE), lambda x: F.length(_digits(x["value"])).between(8, 15))),
    }
    return {k: F.coalesce(v, none) for k, v in found.items()}


def _secrets(text: Column) -> Column:
    return F.coalesce(F.when(text.rlike("[A-Za-z0-9_]{32}"), spans_of(text, SECRET)), F.array().cast(f"array<{SPAN}>"))


def _term_key(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _terms(rows: DataFrame, text: Column, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``term``: one row for each different word of three letters or more of each row's text."""
    words = rows.select(*keep, F.explode(F.array_distinct(F.split(F.lower(text), rf"[^{LETTER}]++"))).alias("word"))
    return words.where(F.length("word") > 2).select(*keep, F.xxhash64("word").alias("term"))


def _entities(spans: dict[str, Column]) -> Column:
    """Keys of the different normalised entities of a row."""
    norm = {"email": F.lower, "ip": lambda v: v, "card": _digits, "phone": _digits, "secret": lambda v: v}
    keys = lambda k: lambda x: F.xxhash64(F.lit(k), norm[k](x["value"]))
    return F.array_distinct(F.concat(*(F.transform(v, keys(k)) for k, v in spans.items())))


FEW = 300_000  # terms up to which their keys are broadcast


def _alike(rows: DataFrame, name: str, least: int) -> tuple[DataFrame, DataFrame]:
    """(copy, class) and (class, docs) of what stands in ``least`` texts or more: things that stand in the same texts are one class, told by their number and a sum of hashes."""
    sums = rows.groupBy(name).agg(F.count(F.lit(1)).alias("docs"), F.bit_xor(F.xxhash64("copy")).alias("a"), F.bit_xor(F.xxhash64("copy", F.lit(1))).alias("b")).where(F.col("docs") >= least)
    of = durable(sums.select(name, F.xxhash64("docs", "a", "b").alias(f"{name}_class"), F.col("docs").alias(f"{name}_docs")), f"private-{name}")
    return rows.join(of, name).select("copy", f"{name}_class", f"{name}_docs").distinct(), of


def disclosing_terms(docs: DataFrame, text_col: str = "text", support: int = 3, share: float = 0.5, bits: float = 4.0, prior: float = 8.0) -> DataFrame:
    """One row (term) for the key of each term that discloses an entity, or a kind of entities, by the rule of ``find_private``.

    Pairs come only from texts that hold an entity. Entities that stand in the same texts are one, as are terms, so a directory that comes
    in several versions is one pair instead of all its names with all its addresses. The terms of these pairs alone are counted in all
    texts, by their broadcast keys up to FEW terms, beyond that by adding up all terms before the join. A text that stands in c rows weighs 1 / c in each, so every different
    text counts once without moving the texts: what is joined to them is the table of repeated texts' keys.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(text.alias("text"), F.xxhash64(text).alias("copy"))
    grouped = durable(rows.groupBy("copy").agg(F.count(F.lit(1)).alias("c")), "private-copies")
    copies, repeated = grouped.count(), durable(grouped.where("c > 1"), "private-repeated")
    spans = base_spans(F.col("text")) | {"secret": _secrets(F.col("text"))}

    def told(x: Column) -> Column:
        kinds = F.array_compact(F.array(*(F.when(F.size(x[k]) > 0, k) for k in spans)))
        row = F.struct(_entities({k: x[k] for k in spans}).alias("entities"), kinds.alias("kinds"))
        return F.when(F.size(kinds) > 0, F.array(row))

    # a generator instead of a filter, which Spark would push below the patterns and so search each text again
    searched = let(F.struct(*(v.alias(k) for k, v in spans.items())), told)
    found = rows.select("text", "copy", F.explode_outer(searched).alias("found")).where("found IS NOT NULL").select("text", "copy", "found.*")
    places = durable(found.dropDuplicates(["copy"]), "private-places")
    bare = F.regexp_replace(F.regexp_replace("text", EMAIL, " "), SECRET, " ")
    beside = durable(_terms(places, bare, "copy", "kinds"), "private-beside")
    per_kind = places.select(F.explode("kinds").alias("kind")).groupBy("kind").agg((F.count(F.lit(1)) / F.lit(float(max(1, copies)))).alias("p_kind"))
    by_kind = beside.select("term", F.explode("kinds").alias("kind")).groupBy("kind", "term").agg(F.count(F.lit(1)).alias("both")).join(per_kind, "kind")
    by_kind = durable(by_kind.where(F.col("both") * (1 - share) >= prior * (share - F.col("p_kind"))), "private-kinds")  # no term in fewer texts can reach the share
    entities, _ = _alike(places.select("copy", F.explode("entities").alias("entity")), "entity", support)
    entities = durable(entities, "private-entities")
    terms, of_term = _alike(beside.select("copy", "term").join(entities.select("copy").distinct(), "copy", "left_semi"), "term", support)
    pairs = terms.join(entities, "copy").groupBy("entity_class", "term_class").agg(F.count(F.lit(1)).alias("both"), F.first("entity_docs").alias("e_docs"))
    pairs = durable(pairs.where(F.col("both") >= support), "private-pairs")
    named = durable(of_term.join(pairs.select("term_class").distinct(), "term_class", "left_semi").select("term", "term_class"), "private-named")
    asked = durable(named.select("term").unionByName(by_kind.select("term")).distinct(), "private-terms")
    weighed = rows.join(repeated, "copy", "left").select("text", (F.lit(1.0) / F.coalesce("c", F.lit(1))).alias("weight"))
    words, few = _terms(weighed, F.col("text"), "weight"), asked.count() <= FEW
    counted = (words.join(F.broadcast(asked), "term", "left_semi") if few else words).groupBy("term").agg(F.round(F.sum("weight")).alias("t_docs"))
    counted = durable(counted if few else counted.join(asked, "term", "left_semi"), "private-counted")
    odds = F.col("both") / F.col("t_docs")
    telling = named.join(counted, "term").join(pairs, "term_class").where((odds >= share) & (F.log2(odds / (F.col("e_docs") / F.lit(copies))) >= bits))
    smooth = (F.col("both") + prior * F.col("p_kind")) / (F.col("t_docs") + prior)
    of_kinds = by_kind.join(counted, "term").where((smooth >= share) & (F.log2(smooth / F.col("p_kind")) >= bits))
    return durable(telling.select("term").unionByName(of_kinds.select("term")).distinct(), "private-telling")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 3, share: float = 0.5, bits: float = 4.0, prior: float = 8.0) -> DataFrame:
    """Base spans and secrets of every whole text and all places of the terms that disclose an entity or a kind of them.

    An entity is the normalised value of a base span or a secret (a long key of letters and digits). Over all different texts
    (copies of a text count once), a term t discloses an entity e if at least ``support`` texts hold both, if p(e | t) =
    texts with both / texts with t is at least ``share``, and if log2(p(e | t) / p(e)) is at least ``bits``. It discloses a kind k (say, that
    a secret stands there) by the same thresholds on p(k | t) = (texts with both + ``prior`` p(k)) / (texts with t + ``prior``), which a few
    chance meetings do not lift. Every place of such a term, in any text, becomes a span of kind ``term``, unless it overlaps another span. Base spans always stay.

    Returns ``id_col`` and, by kind, arrays of (start, end, value) in code points, end exclusive, sorted; ties do not
    arise, since spans of a kind do not overlap.
    Co-occurrence is joins and aggregations of narrow rows; texts are joined to the terms that they hold by a key of the text.
    Null and empty texts have no spans; ids may be null or repeat and each row has its own spans; an empty table gives no
    rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    bare = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("copy"))
    telling = disclosing_terms(docs, text_col, support, share, bits, prior)
    marked = _terms(bare, F.col("text"), "copy").join(telling, "term").groupBy("copy").agg(F.collect_set("term").alias("terms"))
    marked = durable(marked, "private-marked")
    spans = bare.join(marked, "copy", "left").select("id", "text", "terms", *(v.alias(k) for k, v in base_spans(F.col("text")).items()), _secrets(F.col("text")).alias("secret"))
    clear = lambda x: reduce(lambda a, b: a & b, (~F.exists(F.col(k), lambda y: (y["start"] < x["end"]) & (y["end"] > x["start"])) for k in ENTITIES))
    found = F.filter(spans_of(F.col("text"), TERM_PATTERN), lambda x: F.array_contains("terms", _term_key(x["value"])) & clear(x))
    return spans.select(F.col("id").alias(id_col), *ENTITIES, F.when(F.col("terms").isNotNull(), found).otherwise(F.array().cast(f"array<{SPAN}>")).alias(TERM))


def span_text(kinds: tuple[str, ...]) -> Column:
    """``kind:start:end`` of all spans, by kind as listed, then start, joined by commas."""

    def of(kind: str) -> Column:
        return F.transform(F.col(kind), lambda x: F.concat_ws(":", F.lit(kind), x["start"].cast("string"), x["end"].cast("string")))

    return F.concat_ws(",", F.concat(*(of(k) for k in kinds)))


def redact(text: Column, kinds: tuple[str, ...] = (*ENTITIES, TERM)) -> Column:
    """``text`` with every span of ``find_private``'s columns generalised to its kind in brackets; of overlapping spans the first stays."""
    tagged = F.array_sort(F.concat(*(F.transform(F.col(k), _tag(k)) for k in kinds)))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def add(acc: Column, x: Column) -> Column:
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int"))
        return F.when(x["start"] < acc["at"], acc).otherwise(F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, x["tag"]).alias("out")))

    return F.aggregate(tagged, start, add, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))


def _tag(kind: str):
    return lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("tag"))
