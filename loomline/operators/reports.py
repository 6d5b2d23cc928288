"""Reports and validators: content gates, identity tiers, templates, libraries, browse arms, faults and violations of plans, percentiles, grids."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.wording import titles_agree
from loomline.operators.intervals import merge_within, nearest, overlap_join
from loomline.operators.lineage import on_cycle_by
from loomline.operators.tables import durable, numbered, running

#: Roles of a story in their order, statuses of its slots, and a title in a file's name (fixed values).
ARC_ROLES = ("hook", "context", "conflict", "choice", "climax", "consequence", "resolution")
STATUSES = ("supported", "uncertain", "unsupported")
TITLE = "[一-鿿]{2,}[0-9ⅠⅡⅢ]?"


def passes_content_gate(row: Mapping[str, Column], categories: tuple[str, ...]) -> Column:
    """The conjunction of a programme's nine conditions (F3, F4): eligible, category, three events, goal and resolution known to be there, coverage .80, clarity .70, confidence .65, known not to be purely sensory, story told across the film (``covered``).

    A missing value fails, but for ``eligible``, which is true unless said otherwise.
    """
    conditions = [
        F.coalesce(row["eligible"], F.lit(True)), row["category"].isin(*categories), row["events"] >= 3, row["has_goal"], row["has_resolution"], row["coverage"] >= 0.80, row["clarity"] >= 0.70,
        row["confidence"] >= 0.65, ~row["pure_sensory"], row["covered"],
    ]
    return reduce(lambda a, b: a & b, (F.coalesce(c, F.lit(False)) for c in conditions))


def title_from_file(name: Column) -> Column:
    """The longest run of two Chinese characters or more in a file's name, with a number after it; the first of equally long ones; empty without one."""
    runs = F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(TITLE), F.lit(0))
    best = F.array_max(F.transform(runs, lambda r, i: F.struct(F.length(r).alias("n"), (-i).alias("i"), r.alias("r"))))
    return F.coalesce(best["r"], F.lit(""))


def identity_tier(a: Mapping[str, Column], b: Mapping[str, Column], meta: Column, high: float = 0.85, low: float = 0.4) -> Column:
    """Tier of an identity from two votes (title, confidence, recognised) and the file's title (X11).

    identity_conflict if votes with a title contradict the file, all of at least ``low`` confidence; model_prior if the votes agree at a mean of ``high`` or one agrees with the
    file; metadata_prior without a vote if the file names a title; search if they agree at ``low`` or one is sure to .7; else unknown.
    """
    same, sure = titles_agree(a["title"], b["title"]), [F.coalesce(v["confidence"], F.lit(0.0)) for v in (a, b)]
    mean, known = (sure[0] + sure[1]) / 2, F.coalesce(F.trim(meta), F.lit(""))
    cast = [F.coalesce(v["recognised"], F.lit(False)) & (F.coalesce(v["title"], F.lit("")) != "") for v in (a, b)]
    agrees = [c & titles_agree(v["title"], known) for c, v in zip(cast, (a, b), strict=True)]
    weak = [c & (s < low) for c, s in zip(cast, sure, strict=True)]
    any_cast, match = cast[0] | cast[1], (known != "") & (agrees[0] | agrees[1])
    conflict = (known != "") & any_cast & ~match & ~weak[0] & ~weak[1]
    return (
        F.when(conflict, "identity_conflict").when(same & (mean >= high), "model_prior").when(match, "model_prior")
        .when(~any_cast & (title_from_file(known) != ""), "metadata_prior").when((same & (mean >= low)) | (F.greatest(*sure) >= 0.7), "search").otherwise("unknown")
    )


def top_elements(elements: DataFrame, order: list[str], n: int) -> DataFrame:
    """The ``n`` commonest elements, lower-case and trimmed, ties to the one seen first in ``order`` (A3): element, n, place."""
    counts = elements.withColumn("element", F.lower(F.trim("element"))).groupBy("element").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(*order)).alias("first"))
    top = counts.orderBy(F.desc("n"), "first").limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "first")).cast("long")).select("element", "n", "place")


def role_sequences(segments: DataFrame, key: str) -> DataFrame:
    """Each template's roles in order (idx) as one text, with their number, total length, first twist and the length up to its end."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "role", "length")))
    lists = segments.groupBy(key).agg(rows.alias("l"))
    at = F.array_position(F.transform("l", lambda x: x["role"]), "twist")
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x["length"])
    upto = F.when(at > 0, total(F.slice("l", F.lit(1), F.greatest(at, F.lit(1)).cast("int"))))
    return lists.select(key, F.concat_ws("→", F.transform("l", lambda x: x["role"])).alias("seq"), F.size("l").cast("long").alias("segments"), total(F.col("l")).alias("total"), F.when(at > 0, at - 1).alias("twist"), upto.alias("upto"))


def template_suitability(templates: DataFrame, segments: DataFrame, key: str, digits: int = 3) -> DataFrame:
    """How fit each template is for reuse, with its parts (A3).

    ``templates``: key, duration, fixed, replaceable (numbers), parsed. .3 x how often its role sequence came up to it, in order of key, among all templates, .2 for a twist that ends
    within .6 of the duration, .2 for 8 to 35 units, .2 x the replaceable share, .1 if parsed. The running count is by sequence and survives a sequence that most templates have.
    """
    seqs = templates.join(role_sequences(segments, key), key, "left").withColumn("seq", F.coalesce("seq", F.lit("")))
    counted = running(seqs, ["seq"], [key], {"before": ("sum", F.lit(1))})
    freq = (F.coalesce("before", F.lit(0)) + 1) / F.lit(float(max(1, templates.count())))
    early = F.when(F.coalesce((F.col("duration") > 0) & (F.col("upto") / F.col("duration") <= 0.6), F.lit(False)), 1.0).otherwise(0.0)
    fit = F.when(F.col("duration").between(8, 35), 1.0).otherwise(0.0)
    ratio = F.coalesce(F.try_divide("replaceable", F.col("replaceable") + F.col("fixed")), F.lit(0.0))
    score = 0.3 * freq + 0.2 * early + 0.2 * fit + 0.2 * ratio + 0.1 * F.when(F.col("parsed"), 1.0).otherwise(0.0)
    return counted.select(key, "seq", F.round(score, digits).alias("score"), F.round(freq, digits).alias("seq_freq"), early.alias("early_twist"), fit.alias("duration_fit"), F.round(ratio, digits).alias("replaceable_share"))


def template_report(segments: DataFrame, elements: DataFrame, key: str, most: int = 15, sequences: int = 10) -> DataFrame:
    """What templates have in common, as rows (part, item, value, place): commonest elements and sequences, roles, segments and where the first twist lies (A3).

    ``segments``: key, idx, role, length; ``elements``: key, idx, element. The cuts to ``most`` and ``sequences`` are the report's.
    """
    seqs = durable(role_sequences(segments, key), "template-sequences")
    none = F.lit(None).cast("long")
    rows = lambda df, part, item, value, place: df.select(F.lit(part).alias("part"), item.cast("string").alias("item"), value.cast("double").alias("value"), place.alias("place"))
    top = rows(top_elements(elements, [key, "idx"], most), "element", F.col("element"), F.col("n"), F.col("place"))
    named = rows(top_elements(seqs.withColumnRenamed("seq", "element"), [key], sequences), "sequence", F.col("element"), F.col("n"), F.col("place"))
    roles = rows(segments.groupBy("role").agg(F.count(F.lit(1)).alias("n")), "role", F.col("role"), F.col("n"), none)
    stats = seqs.agg(F.avg("segments").alias("mean"), F.min("segments").alias("min"), F.max("segments").alias("max"), F.avg(F.col("twist") / F.col("segments")).alias("twist"))
    spread = stats.select(F.explode(F.create_map(*(x for c in ("mean", "min", "max", "twist") for x in (F.lit(c), F.round(F.col(c).cast("double"), 6))))).alias("item", "value"))
    return reduce(DataFrame.unionByName, [top, named, roles, rows(spread, "segments", F.col("item"), F.col("value"), none)])


def library_summary(rows: DataFrame, sample: int = 40) -> DataFrame:
    """What a library holds, as rows (part, place, value): its rows, sources, median and ninetieth percentile of length by index, and ids of evenly spaced rows with a caption.

    ``rows``: id, source, length, caption. Ranks are value ranges with one offset each; no task sees all rows.
    """
    n = rows.count()
    facts = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("source").alias("sources"))
    counts = facts.select(F.explode(F.create_map(F.lit("rows"), F.col("rows"), F.lit("sources"), F.col("sources"))).alias("part", "value")).select("part", F.lit(0).cast("long").alias("place"), "value")
    ranked = numbered(rows.select("length"), [F.col("length")])
    at = {"p50": min(n - 1, n * 50 // 100), "p90": min(n - 1, n * 90 // 100)}
    marks = [ranked.where(F.col("pos") == k).select(F.lit(p).alias("part"), F.lit(0).cast("long").alias("place"), F.col("length").cast("long").alias("value")) for p, k in at.items()]
    told = rows.where(F.coalesce("caption", F.lit("")) != "").select("id")
    step = max(1, told.count() // sample)
    picked = numbered(told, [F.col("id")]).where((F.col("pos") % step == 0) & (F.col("pos") / step < sample))
    return reduce(DataFrame.unionByName, [counts, *marks, picked.select(F.lit("sample").alias("part"), F.floor(F.col("pos") / step).alias("place"), F.col("id").cast("long").alias("value"))])


def browse_arms(candidates: DataFrame, truth: DataFrame, keys: list[str], arms: list[str], gap: int, width: int, enough: float = 0.8) -> DataFrame:
    """Three arms of a search compared, cheapest first, by what they find of the truth.

    ``candidates``: arm, keys, id, s, e; ``truth``: keys, t, s2, e2. By arm: candidates, how many are left merged within ``gap``, the share that is duplicate, and recall: truths that a
    candidate overlaps. The diagnosis is one for all: all recalls equal means the cheapest suffices (``enough``) or all share a bottleneck; the second better than the first, sampling;
    the third worse than the second, compression; else mixed; no truth, pending.
    """
    n_truth = truth.count()
    unique = merge_within(candidates, ["arm", *keys], gap).groupBy("arm").agg(F.count(F.lit(1)).alias("unique"))
    hit = overlap_join(candidates, truth, keys, width).groupBy("arm").agg(F.count_distinct(F.struct(*keys, "t")).alias("hits"))
    names = candidates.sparkSession.createDataFrame([(a,) for a in arms], "arm string")
    rows = names.join(candidates.groupBy("arm").agg(F.count(F.lit(1)).alias("candidates")), "arm", "left").join(unique, "arm", "left").join(hit, "arm", "left").na.fill(0)
    rate = F.coalesce(F.round(1 - F.try_divide("unique", "candidates"), 6), F.lit(0.0))
    recall = F.round(F.col("hits") / F.lit(n_truth), 6) if n_truth else F.lit(None).cast("double")
    made = rows.select("arm", "candidates", "unique", rate.alias("duplicate_rate"), recall.alias("recall"))
    r = {a: x for a, x in made.select("arm", "recall").collect()}
    a, b, c = (r[x] for x in arms)
    if not n_truth:
        diagnosis = "pending truth"
    elif a == b == c:
        diagnosis = "cheapest arm suffices" if a >= enough else "shared bottleneck"
    else:
        diagnosis = "sampling bottleneck" if b > a else "compression bottleneck" if c > b else "mixed bottleneck"
    return made.withColumn("diagnosis", F.lit(diagnosis))


def goal_recall(candidates: DataFrame, truth: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Recall of each arm for each ``goal`` of the truth."""
    hit = overlap_join(candidates, truth, keys, width).groupBy("arm", "goal").agg(F.count_distinct(F.struct(*keys, "t")).alias("hits"))
    every = truth.groupBy("goal").agg(F.count(F.lit(1)).alias("n"))
    arms = candidates.select("arm").distinct().withColumn("goals", F.lit([r.goal for r in every.select("goal").collect()])).select("arm", F.explode("goals").alias("goal"))
    return arms.join(every, "goal").join(hit, ["arm", "goal"], "left").select("arm", "goal", F.round(F.coalesce("hits", F.lit(0)) / F.col("n"), 6).alias("recall"))


def preflight_faults(slots: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Faults of story plans that need no judge, as rows (keys, idx, fault, n); idx is null for those of a whole plan.

    ``slots``: keys, idx, status, role, source, s, e, target (length), entities; ``lines``: keys, idx, line_s, line_e. Neighbours are supported slots in order: they share an entity,
    unless one has none, and do not run backwards in a source. A plan has a supported resolution, and a supported context or choice if it has a supported conflict. A line lies in its slot's
    source interval and ends within the target's length.
    """
    order = Window.partitionBy(*keys).orderBy("idx")
    good = slots.where("status = 'supported'").withColumns({"_e": F.lag("entities").over(order), "_source": F.lag("source").over(order), "_s": F.lag("s").over(order)})
    apart = (F.size("_e") > 0) & (F.size("entities") > 0) & ~F.arrays_overlap("_e", "entities")
    back = (F.col("source") == F.col("_source")) & (F.col("s") < F.col("_s"))
    has = lambda *roles: F.bool_or((F.col("status") == "supported") & F.col("role").isin(*roles))
    plan = slots.groupBy(*keys).agg(has("resolution").alias("end"), has("conflict").alias("conflict"), has("context", "choice").alias("cause"))
    said = lines.join(slots.select(*keys, "idx", "s", "e", "target"), [*keys, "idx"])
    outside = (F.col("line_e") <= F.col("s")) | (F.col("line_s") < F.col("s")) | (F.col("line_e") > F.col("e"))
    parts = [
        (good, {"entity switch": apart, "causal order": back}, F.col("idx")),
        (plan, {"missing resolution": ~F.col("end"), "missing cause": F.col("conflict") & ~F.col("cause")}, F.lit(None)),
        (said, {"subtitle timing": outside, "dialogue cut": F.col("line_e") - F.col("s") > F.col("target")}, F.col("idx")),
    ]
    found = [df.select(*keys, idx.cast("long").alias("idx"), F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), name) for name, c in rules.items())))).alias("fault")) for df, rules, idx in parts]
    return reduce(DataFrame.unionByName, found).groupBy(*keys, "idx", "fault").agg(F.count(F.lit(1)).alias("n"))


def plan_violations(plans: DataFrame, slots: DataFrame, key: str, low: int, high: int, tolerance: int) -> DataFrame:
    """Rules that story plans break, as rows (key, slot, violation); slot is null for those of a whole plan.

    ``plans``: key, duration. ``slots``: key, slot, role, status, s, e (target), source, source_s, source_e, transition. Slots are numbered from 0, their roles known and in story order (against the last known
    one), their targets follow one another within ``tolerance`` and end with the plan, statuses are known, and a supported slot names a source and an interval and explains its transition.
    """
    order = Window.partitionBy(key).orderBy("slot", "s", "e")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    role = F.array_position(F.array(*map(F.lit, ARC_ROLES)), F.col("role"))
    rows = slots.join(plans.select(key, "duration"), key).withColumn("_role", F.when(role > 0, role))
    rows = rows.withColumns({"_n": F.row_number().over(order) - 1, "_end": F.coalesce(F.lag("e").over(order), F.lit(0)), "_last": F.last("_role", True).over(before)})
    ok = F.col("status") == "supported"
    rules = {
        "slot number": F.col("slot") != F.col("_n"), "role": F.col("_role").isNull(), "role order": F.col("_role") < F.col("_last"),
        "not continuous": (F.abs(F.col("s") - F.col("_end")) > tolerance) | (F.col("e") <= F.col("s")) | (F.col("e") > F.col("duration") + tolerance) | F.col("s").isNull() | F.col("e").isNull(),
        "status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "no source": ok & (F.coalesce(F.trim("source"), F.lit("")) == ""),
        "source interval": ok & (F.coalesce("source_e", F.lit(0)) <= F.coalesce("source_s", F.lit(0))), "unexplained": ok & (F.col("transition") == "unexplained"),
    }
    ends = slots.groupBy(key).agg(F.max_by("e", F.struct("slot", "e")).alias("end"))
    whole = plans.join(ends, key, "left")
    overall = {
        "duration": ~F.col("duration").between(low, high), "no slots": F.col("end").isNull(), "no full cover": F.abs(F.col("end") - F.col("duration")) > tolerance,
    }
    names = lambda rules: F.explode(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items())))).alias("violation")
    return rows.select(key, F.col("slot").cast("long").alias("slot"), names(rules)).unionByName(whole.select(key, F.lit(None).cast("long").alias("slot"), names(overall)))


def template_violations(templates: DataFrame, segments: DataFrame, edges: DataFrame, beats: DataFrame, known: DataFrame, key: str, unit: int, roles: tuple[str, ...]) -> DataFrame:
    """Errors and warnings of templates, as rows (key, violation, n); ``unit`` is a second.

    ``templates``: key, duration; ``segments``: key, id, s, e, role; ``edges``: key, t, cuts that starts should be near; ``beats``: key, id, t, each of which has to be one of ``known`` (key, t2).
    Errors: an interval outside [0, duration + .5 s] or empty, a start before the end of the last valid one, an unknown role, a beat farther than .05 s from all known ones. Warnings: a start farther
    than .5 s from the nearest edge, gaps above .5 s, more than 1 s left at the end, fewer than three segments over 6 s, all segments one opening role.
    """
    rows = segments.join(templates, key)
    limit = F.col("duration") + unit // 2
    valid = F.coalesce((F.col("s") >= 0) & (F.col("s") <= limit) & (F.col("e") > F.col("s")) & (F.col("e") <= limit), F.lit(False))
    marked = durable(rows.withColumn("valid", valid), "template-segments")
    good = marked.where("valid").withColumn("before", F.lag("e").over(Window.partitionBy(key).orderBy("s", "id")))
    near = nearest(good.select(key, "id", F.col("s").alias("t")), edges.select(key, F.col("t").alias("t2")), [key])
    heard = nearest(beats.select(key, "id", "t"), known.select(key, "t2"), [key])
    by = good.groupBy(key).agg(F.max_by("e", F.struct("s", "id")).alias("end"), F.first("duration").alias("duration"))
    counts = marked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("role").alias("roles"), F.min("role").alias("role"), F.first("duration").alias("duration"))
    found = [
        (marked, "interval", ~F.col("valid")), (good, "overlap", F.col("s") < F.col("before") - unit // 100), (good, "role", ~F.coalesce(F.col("role").isin(*roles), F.lit(False))),
        (near, "far from an edge", F.abs(F.col("t") - F.col("nearest")) > unit // 2), (good, "gap", F.col("s") - F.col("before") > unit // 2), (by, "tail", F.col("duration") - F.col("end") > unit),
        (counts, "not divided", (F.col("duration") > 6 * unit) & (F.col("n") < 3)), (counts, "one role", (F.col("duration") > 6 * unit) & (F.col("roles") == 1) & F.col("role").isin("setup", "other")),
        (heard, "beat", F.coalesce(F.abs(F.col("t") - F.col("nearest")) > unit // 20, F.lit(True))),
    ]
    parts = [df.where(F.coalesce(c, F.lit(False))).groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, F.lit(name).alias("violation"), "n") for df, name, c in found]
    return reduce(DataFrame.unionByName, parts)


def recipe_violations(recipes: DataFrame, assets: DataFrame, tracks: DataFrame, operations: DataFrame, key: str, types: tuple[str, ...], points: tuple[str, ...], track_types: tuple[str, ...]) -> DataFrame:
    """Rules that edit recipes break, as rows (key, part, id, violation, n).

    ``recipes``: key, duration, fps, digest; ``assets``: key, id, uri, s, e (a range may be null); ``tracks``: key, id, type, z; ``operations``: key, id, type, status, s, e, track, confidence, evidence (array of
    sources), inputs, depends (arrays of ids). Ids are there and stand once; types and statuses are known; intervals lie in the recipe and last, but for ``points``; tracks, inputs (assets or operations) and dependencies
    exist: ids are counted once, and all references meet the counts in one join; a supported operation has evidence, each with a source; no operation depends on itself by any way, by ``on_cycle_by``.
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""

    def rows(df: DataFrame, part: str, name: Column, rules: Mapping[str, Column]) -> DataFrame:
        names = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items())))
        return df.select(key, F.lit(part).alias("part"), name.cast("string").alias("id"), F.explode(names).alias("violation"))

    def defined(df: DataFrame, part: str) -> DataFrame:
        return df.select(key, F.col("id").cast("string").alias("id"), *(F.lit(int(p == part)).alias(p) for p in places))

    def refs(df: DataFrame, ref: Column, why: str, *there: str) -> DataFrame:
        return df.select(key, ref.alias("id"), F.col("id").cast("string").alias("of"), F.lit(why).alias("why"), F.array(*map(F.lit, there)).alias("there"))

    places = ("asset", "track", "operation")
    ops = operations.join(recipes.select(key, "duration"), key)
    ids = reduce(DataFrame.unionByName, (defined(df, part) for df, part in ((assets, "asset"), (tracks, "track"), (operations, "operation"))))
    ids = ids.groupBy(key, "id").agg(*(F.sum(p).alias(p) for p in places))
    asked = refs(operations, F.col("track").cast("string"), "unknown track", "track").unionByName(refs(operations, F.explode(F.col("inputs").cast("array<string>")), "unknown input", "asset", "operation")).unionByName(refs(operations, F.explode(F.col("depends").cast("array<string>")), "unknown dependency", "operation"))
    there = reduce(Column.__or__, (F.array_contains("there", p) & (F.coalesce(F.col(p), F.lit(0)) > 0) for p in places))
    lost = asked.join(ids, [key, "id"], "left").where(~there).select(key, F.lit("operation").alias("part"), F.col("of").alias("id"), F.col("why").alias("violation"))
    repeated = ids.where(~blank(F.col("id"))).select(key, F.explode(F.array_compact(F.array(*(F.when(F.col(p) > 1, p) for p in places)))).alias("part"), "id", F.lit("repeated id").alias("violation"))
    circles = on_cycle_by(operations.select(key, F.col("id").cast("string").alias("src"), F.explode(F.col("depends").cast("array<string>")).alias("dst")), key)
    starts, ends = F.col("s"), F.col("e")
    parts = [
        rows(recipes, "recipe", F.lit(None), {"duration": F.coalesce(F.col("duration") <= 0, F.lit(True)), "fps": F.coalesce(F.col("fps") <= 0, F.lit(True)), "digest": F.col("digest").isNull() | ((F.col("digest") != "") & (F.length("digest") != 64))}),
        rows(assets, "asset", F.col("id"), {"no id": blank(F.col("id")), "no uri": blank(F.col("uri")), "range": (starts.isNull() != ends.isNull()) | (ends <= starts)}),
        rows(tracks, "track", F.col("id"), {"no id": blank(F.col("id")), "type": ~F.coalesce(F.col("type").isin(*track_types), F.lit(False)), "no order": F.col("z").isNull()}),
        rows(ops, "operation", F.col("id"), {
            "no id": blank(F.col("id")), "type": ~F.coalesce(F.col("type").isin(*types), F.lit(False)), "status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "interval": starts.isNull() | ends.isNull(),
            "outside": (starts < 0) | (ends < starts) | (ends > F.col("duration")), "no length": (starts == ends) & ~F.coalesce(F.col("type").isin(*points), F.lit(False)),
            "confidence": F.coalesce(~F.col("confidence").between(0, 1), F.lit(True)), "no evidence": (F.col("status") == "supported") & (F.coalesce(F.size("evidence"), F.lit(0)) <= 0),
            "no source": F.exists("evidence", lambda x: blank(x)),
        }),
        recipes.join(tracks.select(key).distinct(), key, "left_anti").select(key, F.lit("recipe").alias("part"), F.lit(None).cast("string").alias("id"), F.lit("no tracks").alias("violation")),
        repeated, lost, circles.select(key, F.lit("operation").alias("part"), F.col("node").alias("id"), F.lit("cycle").alias("violation")),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy(key, "part", "id", "violation").agg(F.count(F.lit(1)).alias("n"))


def percentiles(df: DataFrame, keys: list[str], value: str, percent: int) -> DataFrame:
    """A percentile of each key by five rules (X17): ``even`` takes the index (n - 1) p rounded half to even, ``floor`` int(n p), ``upper`` the upper median, ``linear`` interpolates, ``ceil`` is the nearest rank.

    Different values are counted first and ranked by running sums, so a key of any size needs one row a value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = running(counts, keys, [value], {"_before": ("sum", F.col("_n"))}).withColumn("_before", F.coalesce("_before", F.lit(0)))
    sized = ranked.join(counts.groupBy(*keys).agg(F.sum("_n").alias("_all")), keys)
    n, p = F.col("_all"), percent / 100.0
    at = {
        "even": F.rint((n - 1) * p), "floor": F.least(n - 1, F.floor(n * percent / 100)), "upper": F.floor(n / 2), "_lo": F.floor((n - 1) * percent / 100), "_hi": F.least(n - 1, F.floor((n - 1) * percent / 100) + 1),
        "ceil": F.greatest(F.lit(0), F.ceil(n * percent / 100) - 1),
    }
    pick = lambda k: F.max(F.when((F.col("_before") <= k) & (k < F.col("_before") + F.col("_n")), F.col(value)))
    got = sized.groupBy(*keys).agg(*(pick(k).alias(name) for name, k in at.items()), F.first("_all").alias("_all"))
    part = (n - 1) * p - F.floor((n - 1) * percent / 100)
    return got.select(*keys, "even", "floor", "upper", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part).alias("linear"), "ceil")


def grid_difference(a: Column, b: Column, width: int, rows: int, columns: int, height: int) -> tuple[Column, Column]:
    """Mean absolute difference of two frames of ``height`` x ``width`` values, as flat arrays, and of each cell of a grid of ``rows`` x ``columns``."""
    change = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    tall, wide = height // rows, width // columns
    mean = lambda c, n: F.aggregate(c, F.lit(0.0), lambda s, x: s + x) / float(n)
    at = lambda i: F.floor(i / (width * tall)) * columns + F.floor(i % width / wide)
    cells = F.transform(F.sequence(F.lit(0), F.lit(rows * columns - 1)), lambda k: mean(F.filter(change, lambda x, i: at(i) == k), tall * wide))
    return mean(change, width * height), cells


def rotation(side_data: Column) -> Column:
    """Degrees, 0 to 359, of the first entry that has a rotation; 0 without one (X15). ``side_data``: array of structs with ``rotation``."""
    first = F.get(F.filter(side_data, lambda x: x["rotation"].isNotNull()), F.lit(0))["rotation"]
    return F.coalesce(F.pmod(first.cast("int"), F.lit(360)), F.lit(0))


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: "".join(c.lower() for c in unicodedata.normalize("NFKC", t) if c.isalnum()), na_action="ignore")


def name_key(name: Column) -> Column:
    """A name for comparison (X2): compatibility forms folded (NFKC), letters and digits only, lower case. Plain ASCII stays in the JVM; Spark has no function for the rest."""
    return F.when(name.rlike(r"^[\x00-\x7F]*$"), F.lower(F.regexp_replace(name, "[^A-Za-z0-9]", ""))).otherwise(F.pandas_udf(_nfkc, "string")(name))
