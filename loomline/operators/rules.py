"""Rules over groups of rows: pruning, patches, coverage, transfer, publication, release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators.lineage import closure


NAMES = 10_000  # names of a library at most, as each text is searched for all of them


def drop_suppressed(rows: DataFrame, text: str, terms: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """Mark rows (``dropped``) whose text has one of the first ``most`` terms and none of the names.

    Terms are cut to ``most``; names are the entities of one library, NAMES at most, else it fails. Both are one row each when they meet the texts.
    """
    if names.select("name").distinct().limit(NAMES + 1).count() > NAMES:
        raise ValueError(f"more than {NAMES} names")
    few = terms.select("term").distinct().orderBy("term").limit(most).agg(F.collect_list("term").alias("_terms"))
    known = names.agg(F.collect_set("name").alias("_names"))
    joined = rows.crossJoin(F.broadcast(few)).crossJoin(F.broadcast(known))
    hit = lambda c: F.exists(c, lambda x: F.contains(F.col(text), x))
    return joined.withColumn("dropped", F.coalesce(hit("_terms") & ~hit("_names"), F.lit(False))).drop("_terms", "_names")


def apply_patches(patches: DataFrame, keys: list[str], order: list[str], low: int, high: int) -> DataFrame:
    """Apply each key's patches (field s or e, value) to the interval [low, high] one after another.

    A patch without a value, or after which the interval would be empty, is rejected; the next goes on from the state before it.
    """
    rows = F.array_sort(F.collect_list(F.struct(*order, "field", "value")))
    start = F.struct(F.lit(low).cast("long").alias("s"), F.lit(high).cast("long").alias("e"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("rejected"))

    def step(acc: Column, x: Column) -> Column:
        s, e = F.when(x["field"] == "s", x["value"]).otherwise(acc["s"]), F.when(x["field"] == "e", x["value"]).otherwise(acc["e"])
        good = F.struct(s.alias("s"), e.alias("e"), (acc["applied"] + 1).alias("applied"), acc["rejected"].alias("rejected"))
        bad = F.struct(acc["s"].alias("s"), acc["e"].alias("e"), acc["applied"].alias("applied"), (acc["rejected"] + 1).alias("rejected"))
        return F.when(F.coalesce(s < e, F.lit(False)), good).otherwise(bad)

    return patches.groupBy(*keys).agg(F.aggregate(rows, start, step).alias("z")).select(*keys, "z.*")


def prune_invalid(children: DataFrame, key: str, valid: Column) -> DataFrame:
    """Each parent's valid children counted; it stands if they are one and half of all or more."""
    counts = children.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(valid).alias("kept"))
    return counts.withColumn("stands", F.col("kept") >= F.greatest(F.lit(1), F.floor(F.col("n") / 2)))


def first_streams(streams: DataFrame, key: str, order: list[str], kinds: dict[str, str], value: str) -> DataFrame:
    """The value of the first stream of each kind, null without one (X27): name -> kind."""
    return streams.groupBy(key).agg(*(F.min_by(F.when(F.col("kind") == kind, F.col(value)), F.when(F.col("kind") == kind, F.struct(*order))).alias(name) for name, kind in kinds.items()))


def edit_metrics(ops: DataFrame, keys: list[str], per: int, beat: int, tolerance: int) -> DataFrame:
    """Operations for each ``per`` of covered time, share within ``tolerance`` of a beat, mean length (A5); lengths are integers."""
    off = F.pmod(F.col("s"), F.lit(beat))
    on_beat = F.least(off, beat - off) <= tolerance
    span = F.max("e") - F.min("s")
    return ops.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) * float(per) / F.nullif(span, F.lit(0))).alias("rate"), (F.count_if(on_beat) * 100.0 / F.count(F.lit(1))).alias("on_beat"), F.floor(F.sum(F.col("e") - F.col("s")) / F.count(F.lit(1))).alias("mean")
    )


def boosted_top(rows: DataFrame, keys: list[str], score: Column, marked: Column, n: int) -> DataFrame:
    """The ``n`` best rows of a key by score plus 2 for a mark, then the earlier (K6)."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy((score + F.when(marked, 2).otherwise(0)).desc(), "s", "id"))
    return rows.withColumn("place", place.cast("long")).where(F.col("place") <= n)


def refinement_queue(rows: DataFrame, keys: list[str], grain: int, n: int) -> DataFrame:
    """What to look at again: 2 for a missed layer and 1 for low confidence, then the less sure, then the earlier (K7).

    Rows whose start falls on the same multiple of ``grain`` count once, the first in that order; ``n`` a key.
    """
    first = [F.desc("priority"), F.col("confidence"), F.col("s"), F.col("id")]
    asked = rows.withColumn("priority", 2 * F.col("missed").cast("int") + F.col("unsure").cast("int")).where("priority > 0").withColumn("_at", F.floor(F.col("s") / grain))
    once = asked.withColumn("_n", F.row_number().over(Window.partitionBy(*keys, "_at").orderBy(*first))).where("_n = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*first)).cast("long")).where(F.col("place") <= n).drop("_n", "_at")


def audio_mode(slots: DataFrame, keys: DataFrame, key: str, least: int) -> DataFrame:
    """dialogue without slots, mix if a live slot lasts ``least`` or more, else bgm."""
    long = slots.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("live") & (F.col("length") >= least)).alias("_long"))
    return keys.select(key).distinct().join(long, key, "left").select(key, F.when(F.col("_n").isNull(), "dialogue").when(F.col("_long") > 0, "mix").otherwise("bgm").alias("mode"))


def release_decision(rows: DataFrame, key: str, keep: float, false_accept: float) -> DataFrame:
    """Keep rate of good cases and accept rate of bad ones, and whether both gates hold."""
    rates = rows.groupBy(key).agg(F.try_divide(F.count_if(F.col("good") & F.col("accepted")), F.count_if("good")).alias("keep_rate"), F.try_divide(F.count_if(~F.col("good") & F.col("accepted")), F.count_if(~F.col("good"))).alias("false_accept"))
    return rates.withColumn("release", F.coalesce((F.col("keep_rate") >= keep) & (F.coalesce("false_accept", F.lit(0.0)) <= false_accept), F.lit(False)))


def transfer_complete(rows: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """Whether all rows of a key pass every check, and its transitions number max(2, .6 n rounded up) to n + 1."""
    n, moves = F.count(F.lit(1)), F.count_if("transition")
    low = F.greatest(F.lit(2), F.ceil(n * 3 / 5))
    return rows.groupBy(key).agg(*(F.bool_and(c).alias(c) for c in checks), moves.alias("transitions"), ((moves >= low) & (moves <= n + 1)).alias("in_range")).withColumn("complete", F.col("in_range") & sum((F.col(c).cast("int") for c in checks), F.lit(0)).eqNullSafe(len(checks)))


def blockers(versions: DataFrame, deps: DataFrame) -> DataFrame:
    """What each node waits for: needed nodes that are missing or not committed; none means its goal is met."""
    state = versions.select(F.col("node").alias("upstream"), "status")
    waiting = deps.join(state, "upstream", "left").where(F.coalesce(F.col("status") != "committed", F.lit(True)))
    counts = waiting.groupBy("node").agg(F.count(F.lit(1)).alias("blockers"), F.min("upstream").alias("first"))
    return versions.select("node").join(counts, "node", "left").withColumn("blockers", F.coalesce("blockers", F.lit(0)))


def revoked(sources: DataFrame, bad: DataFrame) -> DataFrame:
    """Every version derived, by any number of steps, from a revoked one (G6): ``sources`` (sha, derived_from), ``bad`` (sha)."""
    edges = sources.select(F.col("derived_from").alias("src"), F.col("sha").alias("dst")).where("src IS NOT NULL")
    return closure(edges, bad.select(F.col("sha").alias("node")))


def publish(claims: DataFrame, refs: DataFrame, accepted: Column) -> DataFrame:
    """Events all of whose claims are accepted are published; the rest are limitations with the number they lack.

    ``claims``: (claim, ...); ``refs``: (event, claim). A claim that does not exist is not accepted.
    """
    ok = claims.where(accepted).select("claim").distinct().withColumn("_ok", F.lit(1))
    return refs.join(ok, "claim", "left").groupBy("event").agg(F.count_if(F.col("_ok").isNull()).alias("lacking")).withColumn("published", F.col("lacking") == 0)


def identity_state(comparisons: DataFrame, key: str) -> DataFrame:
    """Identity from comparisons in both directions (X12): (key, form, forward, reverse, hard_negative).

    A form that is the same both ways supports the identity; a hard negative beside it is a conflict; without one any uncertain answer leaves it open, else it is rejected.
    """
    same = (F.col("forward") == "same") & (F.col("reverse") == "same")
    open_ = (F.col("forward") == "uncertain") | (F.col("reverse") == "uncertain")
    got = comparisons.groupBy(key).agg(F.count_distinct(F.when(same, F.col("form"))).alias("forms"), F.bool_or("hard_negative").alias("_hard"), F.bool_or(open_).alias("_open"))
    state = F.when((F.col("forms") > 0) & F.col("_hard"), "conflict").when(F.col("forms") > 0, "supported").when(F.col("_open"), "uncertain").otherwise("rejected")
    form = F.when((state == "supported") & (F.col("forms") == 1), "identified").otherwise("uncertain")
    return got.select(key, "forms", state.alias("state"), form.alias("form_state"))


def bound_events(occurrences: DataFrame, participants: DataFrame, facts: DataFrame) -> DataFrame:
    """Events with a supported participant and a supported fact, with the number of such participants."""
    known = occurrences.where("supported").select("participant").distinct()
    met = participants.join(known, "participant", "left_semi").groupBy("event").agg(F.count_distinct("participant").alias("participants"))
    return met.join(facts.where("supported").select("event").distinct(), "event", "left_semi")
