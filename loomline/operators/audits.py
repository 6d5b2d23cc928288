"""Versions, claims, catalogues, generated suites, rhythm, pilots and other audits of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def version_states(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """State of every version in an append-only log of drafts, commits and revocations.

    A commit is active until a later commit makes it stale or a later revocation revokes it; a draft is superseded by any later row of its key.
    """
    rows = Window.partitionBy(key).orderBy(*order)
    more = F.lead("op").over(rows).isNotNull()
    nxt = F.first(F.when(F.col("op") != "draft", F.col("op")), True).over(rows.rowsBetween(1, Window.unboundedFollowing))
    state = F.when(F.col("op") == "revoke", "revocation").when((F.col("op") == "draft") & more, "superseded").when(F.col("op") == "draft", "draft")
    return log.withColumn("state", state.when(nxt == "commit", "stale").when(nxt == "revoke", "revoked").otherwise("active"))


def ledger_states(claims: DataFrame, keys: list[str]) -> DataFrame:
    """State of every claim (id, supersedes, polarity): inactive if superseded, contested if an active one of its thing says the opposite, else supported."""
    old = claims.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("id")).distinct().withColumn("_old", F.lit(True))
    marked = claims.join(old, "id", "left").withColumn("active", F.col("_old").isNull()).drop("_old")
    sides = marked.where("active").groupBy(*keys).agg(F.count_distinct("polarity").alias("_sides"))
    joined = marked.join(sides, keys, "left")
    return joined.withColumn("state", F.when(~F.col("active"), "inactive").when(F.col("_sides") > 1, "contested").otherwise("supported")).drop("_sides")


def catalogue_faults(assets: DataFrame, allowed: str, forbidden: str, namespace: str) -> DataFrame:
    """Faults of an asset catalogue (id, allowed and forbidden uses): repeated ids, uses both allowed and forbidden, ids outside the namespace."""
    n = assets.groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
    faults = F.array(
        F.when(F.col("_n") > 1, "repeated"), F.when(F.size(F.array_intersect(allowed, forbidden)) > 0, "contradicts"), F.when(~F.startswith("id", F.lit(namespace)), "namespace")
    )
    return assets.join(n, "id").withColumn("faults", F.concat_ws(",", F.array_compact(faults))).drop("_n")


def reusable(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """Whether a cached answer may be used again: the same observation hash and contract."""
    held = cache.select("observation", "contract").distinct().withColumn("_held", F.lit(True))
    return wanted.join(held, ["observation", "contract"], "left").withColumn("reuse", F.col("_held").isNotNull()).drop("_held")


def suite_specs(sources: DataFrame, key: str, single: int = 96, paired: int = 24, compound: int = 24, operations: int = 12, seed: str = "suite-1") -> DataFrame:
    """A truth suite for each recording (``key``, hi): single, paired and compound cases inside [0, hi], drawn by md5 of seed, recording and number.

    A paired case comes twice at one place, with its operation and without; a compound one has a second operation, never the same. Rows: key, id, kind, variant, operation, second, s, e.
    Draws follow the hash, so a rerun, or a suite with more cases of the last kind, gives the same ones again.
    """
    rows = sources.where("hi > 0").select(key, "hi", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(single + paired + compound - 1).cast("long"))).alias("id"))
    kind = F.when(F.col("id") < single, "single").when(F.col("id") < single + paired, "paired").otherwise("compound")
    mark = F.md5(F.concat_ws("/", F.lit(seed), F.col(key).cast("string"), F.col("id").cast("string")))
    draw = lambda at, n: F.conv(F.substring(mark, at, 6), 16, 10).cast("long") % n
    length = 1 + draw(1, F.greatest(F.lit(1), F.floor(F.col("hi") / 10)))
    start = draw(7, F.greatest(F.lit(1), F.col("hi") - length))
    first = draw(13, F.lit(operations))
    second = F.when(kind == "compound", (first + 1 + draw(19, F.lit(operations - 1))) % operations)
    cases = rows.select(key, "id", kind.alias("kind"), first.alias("operation"), second.alias("second"), start.alias("s"), F.least(start + length, F.col("hi")).alias("e"))
    variants = F.when(F.col("kind") == "paired", F.array(F.lit("with"), F.lit("without"))).otherwise(F.array(F.lit("with")))
    out = cases.withColumn("variant", F.explode(variants))
    return out.withColumn("operation", F.when(F.col("variant") == "with", F.col("operation")))


def rhythm_grammar(sections: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Each section's share of its key's length with a tolerated range, cuts strictly inside it, and a density label.

    ``sections``: (keys, section, s, e) that tile a line; a point belongs to the section that its number ``section`` names. Rates are cuts a unit of length.
    """
    inside = points.join(sections.select(*keys, "section", "s", "e"), [*keys, "section"]).where((F.col("t") > F.col("s")) & (F.col("t") < F.col("e")))
    cuts = inside.groupBy(*keys, "section").agg(F.count(F.lit(1)).alias("cuts"))
    length = F.col("e") - F.col("s")
    ratio = length / F.sum(length).over(Window.partitionBy(*keys))
    rows = sections.join(cuts, [*keys, "section"], "left").withColumn("cuts", F.coalesce("cuts", F.lit(0))).withColumn("ratio", ratio)
    rate = F.col("cuts") / F.col("units")
    label = F.when(rate < 0.15, "sparse").when(rate < 0.4, "calm").when(rate < 0.8, "brisk").otherwise("dense")
    return rows.select(*keys, "section", F.round("ratio", 6).alias("ratio"), F.round(F.greatest(F.lit(0.0), F.col("ratio") - 0.055), 6).alias("low"), F.round(F.col("ratio") + 0.065, 6).alias("high"), "cuts", label.alias("density"))


def pilot(shots: DataFrame, keys: list[str], roles: list[str]) -> DataFrame:
    """The shot to try first: of the given roles, or of all where none has one; fewest missing references, then cast, then role order, then id."""
    rank = F.coalesce(*(F.when(F.col("role") == r, i) for i, r in enumerate(roles)), F.lit(len(roles)))
    order = F.struct((rank == len(roles)).alias("other"), "missing", "cast", rank.alias("rank"), "id")
    return shots.groupBy(*keys).agg(F.min_by("id", order).alias("pilot"))


def next_span(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The span to shoot next: the first of the largest 2 x missing + partial above 0; a partial one that needs nothing counts as covered."""
    need = 2 * F.col("missing") + F.when(F.col("needed"), F.col("partial")).otherwise(0)
    return spans.withColumn("need", need).where("need > 0").groupBy(*keys).agg(F.min_by("span", F.struct((-F.col("need")).alias("k"), "span")).alias("span"), F.max("need").alias("need"))


def goal_plan(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """For each (section, goal) in order its first candidate that no earlier one took (V19): rows (section, goal, place, id).

    A key is one plan, whose candidates are a short ranked list for each goal.
    """
    rows = F.array_sort(F.collect_list(F.struct("section", "goal", "place", "id")))
    start = F.array().cast("array<struct<section:bigint,goal:string,id:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda y: (y["id"] == x["id"]) | ((y["section"] == x["section"]) & (y["goal"] == x["goal"])))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(F.struct(x["section"].alias("section"), x["goal"].alias("goal"), x["id"].alias("id")))))

    return candidates.groupBy(*keys).agg(F.aggregate(rows, start, step).alias("p")).select(*keys, F.explode("p").alias("p")).select(*keys, "p.*")


def nested(outer_s: Column, outer_e: Column, mid_s: Column, mid_e: Column, core_s: Column, core_e: Column) -> Column:
    """Observation holds render, render holds core."""
    return (outer_s <= mid_s) & (mid_s <= core_s) & (core_e <= mid_e) & (mid_e <= outer_e)


def rule_drafts(bounds: DataFrame, keys: list[str], names: dict[str, str], cap: float) -> DataFrame:
    """Segments between consecutive bounds (t, hypotheses, confidence), each named by its first mappable hypothesis at a confidence of ``cap`` at most."""
    mapped = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    name = F.get(F.filter(F.transform("hypotheses", lambda h: mapped[h]), lambda x: x.isNotNull()), 0)
    after = F.lead("t").over(Window.partitionBy(*keys).orderBy("t", "id"))
    return bounds.select(*keys, "id", F.col("t").alias("s"), after.alias("e"), name.alias("name"), F.least("confidence", F.lit(cap)).alias("confidence")).where("e > s AND name IS NOT NULL")


def pilot_windows(windows: DataFrame, keys: list[str], known: int, high: int, other: int) -> DataFrame:
    """Windows to try: the best ``known`` of each key, then ``high`` of high value dealt round the kinds, then ``other`` by hash order."""
    place = lambda order, part=(): F.row_number().over(Window.partitionBy(*keys, *part).orderBy(*order))
    first = windows.withColumn("_k", place([F.desc("known"), F.desc("value"), F.col("id")])).withColumn("_known", F.col("known") & (F.col("_k") <= known))
    dealt = first.withColumn("_turn", place([F.col("_known"), F.desc("value"), F.col("id")], ("kind",)))
    second = dealt.withColumn("_h", place([F.col("_known"), F.col("_turn"), F.col("kind"), F.col("id")])).withColumn("_high", ~F.col("_known") & (F.col("_h") <= high))
    third = second.withColumn("_o", place([F.col("_known") | F.col("_high"), F.sha2(F.col("id").cast("string"), 256)])).withColumn("_other", ~(F.col("_known") | F.col("_high")) & (F.col("_o") <= other))
    role = F.when(F.col("_known"), "known").when(F.col("_high"), "high").when(F.col("_other"), "other")
    return third.withColumn("role", role).where("role IS NOT NULL").select(*keys, "id", "role")


def recall_at(predictions: DataFrame, truth: DataFrame, keys: list[str], k: int, tolerance: int) -> DataFrame:
    """Recall and precision of each key's ``k`` strongest predictions (id, t, strength), and their mean distance to the nearest truth (t2) (E5)."""
    top = predictions.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("strength"), "id"))).where(F.col("_n") <= k)
    pairs = top.join(truth, keys).withColumn("d", F.abs(F.col("t") - F.col("t2")))
    near = pairs.groupBy(*keys, "id").agg(F.min("d").alias("d"))
    found = pairs.where(F.col("d") <= tolerance).groupBy(*keys).agg(F.count_distinct("t2").alias("found"))
    totals = truth.groupBy(*keys).agg(F.count_distinct("t2").alias("truths"))
    hits = near.groupBy(*keys).agg((F.count_if(F.col("d") <= tolerance) / F.count(F.lit(1))).alias("precision"), F.floor(F.sum("d") / F.count(F.lit(1))).alias("error"))
    return totals.join(hits, keys, "left").join(found, keys, "left").select(*keys, (F.coalesce("found", F.lit(0)) / F.col("truths")).alias("recall"), "precision", "error")


def story_faults(slots: DataFrame, keys: list[str]) -> DataFrame:
    """Faults between neighbouring slots (idx, source, s, length, entities, dialogue): no common entity, time running backwards in a source, speech longer than the slot."""
    order = Window.partitionBy(*keys).orderBy("idx")
    prev = slots.withColumns({"_e": F.lag("entities").over(order), "_src": F.lag("source").over(order), "_s": F.lag("s").over(order)})
    apart = (F.size("_e") > 0) & (F.size("entities") > 0) & ~F.arrays_overlap("_e", "entities")
    checks = {"entities": apart, "backwards": (F.col("source") == F.col("_src")) & (F.col("s") < F.col("_s")), "speech": F.col("dialogue") > F.col("length")}
    names = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in checks.items())))
    return prev.withColumn("faults", F.concat_ws(",", names)).where("faults <> ''").select(*keys, "idx", "faults")


def box_overlap(boxes: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Pairs of a key's boxes (id, x, y, w, h) whose common area exceeds ``share`` of the smaller one (X19); a key is one frame."""
    names = ("id", "x", "y", "w", "h")
    a, b = (boxes.select(*keys, *(F.col(c).alias(f"{c}{n}") for c in names)) for n in (1, 2))
    wide = F.least(F.col("x1") + F.col("w1"), F.col("x2") + F.col("w2")) - F.greatest("x1", "x2")
    high = F.least(F.col("y1") + F.col("h1"), F.col("y2") + F.col("h2")) - F.greatest("y1", "y2")
    common = F.greatest(F.lit(0), wide) * F.greatest(F.lit(0), high)
    return a.join(b, keys).where("id1 < id2").withColumn("common", common).where(F.col("common") > share * F.least(F.col("w1") * F.col("h1"), F.col("w2") * F.col("h2"))).select(*keys, "id1", "id2", "common")


def series_stats(rows: DataFrame, keys: list[str], value: str, changed: int) -> DataFrame:
    """Mean and standard deviation of a key's values and the number of steps that change by more than ``changed``."""
    step = F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy("s", "id")))
    return rows.withColumn("_d", step).groupBy(*keys).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.stddev_pop(value), 6).alias("std"), F.count_if(F.col("_d") > changed).alias("active"))
