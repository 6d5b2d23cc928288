"""Mixing sources to target weights by Efraimidis-Spirakis sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.scratch import durable, in_order, running_total

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def word_count(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII white spaces; null text has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), SPACE, " " * len(SPACE))
    return F.size(F.array_remove(F.split(plain, " ", -1), "")).cast("long")


def quality_weight(text: Column) -> Column:
    """0.25 to 1: one less four times the share of symbols, so marked-up junk comes later."""
    n = F.greatest(F.length(text), F.lit(1))
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    return F.greatest(F.lit(0.25), F.coalesce(1.0 - 4.0 * symbols / n, F.lit(1.0)))


def sampling_key(seed: str, doc: Column, text: Column, weight: Column | None = None) -> Column:
    """An exponential variable of rate weight, by a hash of seed, id and text."""
    u = (F.xxhash64(F.lit(seed), doc, text).bitwiseAND(F.lit((1 << 52) - 1)) + F.lit(0.5)) / float(1 << 52)
    return -F.log(u) / (quality_weight(text) if weight is None else weight)


def source_targets(sizes: DataFrame, cap: int = 3, cycle: int = 3) -> DataFrame:
    """Word targets of the sources, given one row (source, source_size) each; adds rank, target and source_start.

    Sources by code point, null last, weigh 1, 2, ..., ``cycle``, repeating, and share the sum of
    all sizes; a target stops at ``cap`` times its source's size and the excess is shared anew by
    weight. The fixed point is min(weight x level, cap x size): sources ordered by
    cap x size / weight reach their cap first, so one pass of running sums finds the level. Both orders are
    cut into ranges, so that any number of sources fits; ``source_start`` is the sum of the sizes before a source.
    """
    placed = in_order(sizes, [F.col("source").cast("binary").asc_nulls_last()], "mix-sources")
    ranked = running_total(placed, "source_size", "source_start").withColumn("rank", F.col("pos") + 1).drop("pos", "tile", "tile_row")
    ranked = ranked.withColumn("weight", ((F.col("rank") - 1) % cycle + 1).cast("double")).withColumn("most", F.col("source_size") * float(cap))
    by_level = in_order(ranked, [F.col("most") / F.col("weight"), F.col("rank")], "mix-levels")
    w = running_total(running_total(by_level, "most", "full_before"), "weight", "weight_before")
    all_of = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    level = (F.lit(float(all_of.words or 0)) - F.col("full_before")) / (F.lit(all_of.weight or 1.0) - F.col("weight_before"))
    opened = w.withColumn("level", level).where(F.col("weight") * F.col("level") <= F.col("most"))
    first = opened.agg(F.min_by("level", "pos").alias("level")).first().level
    target = F.col("most") if first is None else F.least(F.col("weight") * F.lit(first), F.col("most"))
    return ranked.select(*sizes.columns, "rank", "source_start", target.alias("target"))


MANY = 100_000  # rows of a table of sources up to which it is broadcast
SALTS = 64


def join_sources(rows: DataFrame, sources: DataFrame, source: Column, key: str, spread: Column) -> DataFrame:
    """``rows`` with the row of ``sources`` whose ``key`` is ``source`` (null is a source).

    Up to MANY sources are broadcast. More are joined by (source, salt), each given to SALTS salts, so that a
    source of a third of all rows is many tasks; ``spread`` deals the rows over the salts.
    """
    if sources.count() <= MANY:
        return rows.join(F.broadcast(sources), source.eqNullSafe(F.col(key)))
    dealt = sources.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_own", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    return salted.join(dealt, source.eqNullSafe(F.col(key)) & (F.col("_own") == F.col("_salt"))).drop("_own", "_salt")


def mix_sources(
    docs: DataFrame, seed: str = "mix-1", cap: int = 3, cycle: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None
) -> DataFrame:
    """How many whole copies of each document the mix takes.

    A source first gives complete epochs (target // size copies of every document). What its
    target still lacks comes from one Efraimidis-Spirakis order: keys -ln(u) / weight ascending,
    u a hash of ``seed``, id and text; sizes are summed in that order and documents are
    taken once more until the rest is filled. Of the one document at the border, ``taken`` counts
    the words that still fit, so a source's taken words equal its target, rounded; ``copies`` are
    whole copies and count the border document if more than half of it fits.

    Returns ``id_col``, size, source, source_size, target, epochs, copies, taken and ``key``. Reruns agree: the order is total up to rows that are equal. Null and empty texts
    have size 0 and get the complete epochs only; an empty table gives no rows; a null
    source is a source of its own. ``weight`` replaces the text's own quality weight (above 0).
    """
    text = F.col(text_col).cast("string")
    rows = durable(
        docs.select(
            F.col(id_col).alias("id"),
            F.col(source_col).cast("string").alias("source"),
            word_count(text).alias("size"),
            sampling_key(seed, F.col(id_col), text, weight).alias("key"),
            F.xxhash64(text).alias("mark"),
        ),
        "mix-rows",
    )
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = durable(source_targets(sizes, cap, cycle), "mix-targets")
    order = [F.col("source").cast("binary").asc_nulls_last(), *(F.col(c) for c in ("key", "id", "mark", "size"))]
    summed = running_total(in_order(rows, order, "mix-order"), "size", "sum_before")
    t = targets.withColumnRenamed("source", "t_source")
    joined = join_sources(summed, t, F.col("source"), "t_source", F.col("pos"))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.round(rest).cast("long") - (F.col("sum_before") - F.col("source_start"))))
    return joined.select(
        F.col("id").alias(id_col),
        "size",
        "source",
        "source_size",
        "target",
        epochs.alias("epochs"),
        (epochs + F.when(more * 2 > F.col("size"), 1).otherwise(0)).cast("long").alias("copies"),
        (epochs * F.col("size") + more).cast("long").alias("taken"),
        "key",
    )


def mixed_documents(docs: DataFrame, seed: str = "mix-1", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every row of ``docs``, all columns, as many times as ``mix_sources`` takes whole copies.

    A source's extra copies are those up to its border key, so a table of one row a source decides
    each document where it stands; texts are not shuffled. Rows of the border key itself (equal ids and texts) are numbered, and as many of them
    as ``mix_sources`` takes go on: only these few are written on their own. Null and empty texts come with the complete epochs only; null
    sources are one source; an empty table gives no rows; names of ``docs`` that start with ``mix_`` must not be used.
    """
    mixed = mix_sources(docs, seed, id_col=id_col, text_col=text_col, source_col=source_col)
    mixed = durable(mixed.select("source", "key", "epochs", (F.col("copies") > F.col("epochs")).alias("extra")), "mix-taken")
    borders = mixed.groupBy(F.col("source").alias("mix_source")).agg(F.max("epochs").alias("mix_epochs"), F.max(F.when(F.col("extra"), F.col("key"))).alias("mix_border"))
    borders = durable(borders, "mix-borders")
    ties = join_sources(mixed, borders, F.col("source"), "mix_source", F.col("key")).where(F.col("key") == F.col("mix_border"))
    ties = ties.groupBy("mix_source").agg(F.count_if("extra").alias("mix_some"), F.count(F.lit(1)).alias("mix_all"))
    borders = borders.join(ties.withColumnRenamed("mix_source", "mix_tied"), F.col("mix_source").eqNullSafe(F.col("mix_tied")), "left").drop("mix_tied")
    borders = durable(borders, "mix-borders")
    text = F.col(text_col).cast("string")
    key = sampling_key(seed, F.col(id_col), text)
    joined = join_sources(docs, borders, F.col(source_col).cast("string"), "mix_source", text).withColumn("mix_key", key)
    some = word_count(text) > 0
    split = F.coalesce((F.col("mix_key") == F.col("mix_border")) & (F.col("mix_some") < F.col("mix_all")), F.lit(False)) & some
    extra = F.coalesce(F.col("mix_key") <= F.col("mix_border"), F.lit(False)) & some
    copies = (F.col("mix_epochs") + F.when(extra, 1).otherwise(0)).cast("int")
    plain = joined.where(~split).withColumn("mix_copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*docs.columns)
    if borders.where("mix_some < mix_all").isEmpty():
        return plain
    rows = joined.where(split).select(F.struct(*docs.columns).alias("mix_row"), *borders.columns, "mix_key")
    tied = in_order(rows, [F.col("mix_source").asc_nulls_last(), F.col("mix_key")], "mix-ties")
    first = tied.groupBy(F.col("mix_source").alias("mix_of")).agg(F.min("pos").alias("mix_first"))
    tied = join_sources(tied, durable(first, "mix-first"), F.col("mix_source"), "mix_of", F.col("pos"))
    times = (F.col("mix_epochs") + F.when(F.col("pos") - F.col("mix_first") < F.col("mix_some"), 1).otherwise(0)).cast("int")
    return plain.unionByName(tied.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(0), times))).select("mix_row.*"))
