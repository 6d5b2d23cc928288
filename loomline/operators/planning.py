"""Filling the slots of a plan: assignment with locks and fusion, paths under an identity contract, layered search, cliques, combinations, lengths."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators.intervals import overlap_join
from loomline.operators.tables import durable


def render_choice(fits: DataFrame, longest: int, before: int, after: int, hold: tuple[int, int]) -> DataFrame:
    """How a unit (s, e) inside its container (box_s, box_e) would be shown in a slot: adds ``mode``, ``left``, ``right``, ``length`` and ``shown``.

    The core gets ``before`` and ``after`` around it inside the container; what exceeds ``longest`` goes from the front first, half of it at most, then from the
    back, and a unit whose core would be cut is not shown. An instant is held if the slot allows that, within ``hold`` and ``longest``.
    """
    left = F.greatest(F.col("box_s"), F.col("s") - before)
    right = F.least(F.col("box_e"), F.col("e") + after)
    out = fits.withColumns({"left": left, "right": right}).withColumn("_over", F.greatest(F.lit(0), F.col("right") - F.col("left") - longest))
    out = out.withColumn("_front", F.least(F.col("s") - F.col("left"), F.floor(F.col("_over") / 2)))
    out = out.withColumns({"left": F.col("left") + F.col("_front"), "right": F.col("right") - (F.col("_over") - F.col("_front"))})
    wanted = F.when((F.col("form") == "instant") & F.array_contains("modes", "hold"), "hold").otherwise("clip")
    mode = F.when(F.array_contains("modes", wanted), wanted).otherwise(F.get("modes", F.lit(0)))
    size = F.col("right") - F.col("left")
    held = F.least(F.lit(longest), F.greatest(F.lit(hold[0]), F.least(F.lit(hold[1]), size))).cast("long")
    whole = (F.col("e") - F.col("s") <= longest) & (F.col("left") <= F.col("s")) & (F.col("right") >= F.col("e"))
    return out.withColumns({"mode": mode, "shown": whole}).withColumn("length", F.when(F.col("mode") == "hold", held).otherwise(size)).drop("_over", "_front")


def assign_slots(fits: DataFrame, slots: DataFrame, keys: list[str], most: int, longest: int, before: int, after: int, hold: tuple[int, int]) -> DataFrame:
    """Fill each plan's slots in order with the best unit not used yet.

    ``slots``: keys, slot (0, 1, ...), threshold, forms, grp, required, fusable, modes; at most ``most`` a plan, else it fails.
    ``fits``: keys, slot, id, fit, form, subject, strength, confidence, s, e, box_s, box_e.
    A unit serves a slot if its fit reaches the threshold and its form is allowed; best is fit, strength, confidence, then the earlier start, then id. The first pick of a
    group locks its subject for the group's later slots. If all that serve are used, the best one is fused with its segment if that ended in the slot before and the
    slot allows it. A unit whose core cannot be shown whole is rejected.

    Returns for each slot: verdict (picked, fused, missing, skipped: missing but not required), reason, id, segment, mode, s, e, length, n_fit and n_form (units that
    fit, and those of them excluded by form). At most ``most`` units can be used, so the ``most`` best of each slot, and of each
    subject that a group may lock, decide: these are all that one fold a plan sees, however many units fit.
    """
    if (slots.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) > most:
        raise ValueError(f"a plan has more than {most} slots")
    bars = slots.groupBy("slot").agg(F.min("threshold").alias("_bar"))  # what reaches no plan's threshold is not sent
    fits = fits.join(F.broadcast(bars), "slot").where(F.col("fit") >= F.col("_bar")).select(fits.columns)
    joined = fits.join(slots, [*keys, "slot"]).where(F.col("fit") >= F.col("threshold"))
    allowed = F.array_contains("forms", F.col("form"))
    counts = joined.groupBy(*keys, "slot").agg(F.count(F.lit(1)).alias("n_fit"), F.count_if(~allowed).alias("n_form"))
    serving = render_choice(joined.where(allowed & (F.col("grp").isNull() | F.col("subject").isNotNull())), longest, before, after, hold)
    order = [F.desc("fit"), F.desc("strength"), F.desc("confidence"), "s", "id"]
    place = lambda *by: F.row_number().over(Window.partitionBy(*keys, "slot", *by).orderBy(*order))
    first = serving.withColumn("_place", place()).where(F.col("_place") <= most).drop("_place")
    may_lock = first.where("grp IS NOT NULL").select(*keys, "grp", "subject").distinct()
    of_subject = serving.where("grp IS NOT NULL").withColumn("_place", place("subject")).where(F.col("_place") <= most).drop("_place")
    kept = first.unionByName(of_subject.join(may_lock, [*keys, "grp", "subject"], "left_semi").select(first.columns)).dropDuplicates([*keys, "slot", "id"])
    best = F.struct((-F.col("fit")).alias("f"), (-F.col("strength")).alias("g"), (-F.col("confidence")).alias("c"), "s", "id", "subject", "mode", "left", "right", "length", "shown")
    lists = kept.groupBy(*keys, "slot").agg(F.array_sort(F.collect_list(best)).alias("units"))
    none = F.array().cast(lists.schema["units"].dataType)
    whole = slots.join(lists, [*keys, "slot"], "left").join(counts, [*keys, "slot"], "left").withColumn("units", F.coalesce("units", none))
    row = F.struct("slot", "grp", "required", "fusable", "units", F.coalesce("n_fit", F.lit(0)).alias("n_fit"), F.coalesce("n_form", F.lit(0)).alias("n_form"))
    kinds = {f.name: f.dataType.simpleString() for f in fits.schema.fields}
    kind = slots.schema["slot"].dataType.simpleString()
    made = f"slot:{kind},verdict:string,reason:string,id:{kinds['id']},segment:bigint,mode:string,s:bigint,e:bigint,length:bigint,n_fit:bigint,n_form:bigint"
    used = f"id:{kinds['id']},segment:bigint,slot:{kind}"
    start = F.struct(
        F.array().cast(f"array<struct<{used}>>").alias("used"), F.array().cast(f"array<struct<grp:string,subject:{kinds['subject']}>>").alias("locks"), F.array().cast(f"array<struct<{made}>>").alias("out")
    )

    def step(acc: Column, x: Column) -> Column:
        lock = F.get(F.filter(acc["locks"], lambda g: g["grp"] == x["grp"]), F.lit(0))["subject"]
        serve = F.filter(x["units"], lambda u: lock.isNull() | (u["subject"] == lock))
        fresh = F.filter(serve, lambda u: ~F.exists(acc["used"], lambda y: y["id"] == u["id"]))
        unit = F.coalesce(F.get(fresh, F.lit(0)), F.get(serve, F.lit(0)))
        old = F.get(F.filter(acc["used"], lambda y: y["id"] == unit["id"]), F.lit(0))
        fuse = old.isNotNull() & (old["slot"] == x["slot"] - 1) & x["fusable"]
        pick = unit.isNotNull() & old.isNull() & unit["shown"]
        verdict = F.when(pick, "picked").when(fuse, "fused").when(x["required"], "missing").otherwise("skipped")
        reason = F.when(pick | fuse, F.lit(None)).when(unit.isNull(), "no unit").when(old.isNotNull(), "used").otherwise("core too long")
        segment = F.when(pick, F.size(F.filter(acc["out"], lambda o: o["verdict"] == "picked")).cast("long")).when(fuse, old["segment"])
        row = F.struct(
            x["slot"].alias("slot"), verdict.alias("verdict"), reason.alias("reason"), F.when(pick | fuse, unit["id"]).alias("id"), segment.alias("segment"), F.when(pick, unit["mode"]).alias("mode"),
            F.when(pick, unit["left"]).alias("s"), F.when(pick, unit["right"]).alias("e"), F.when(pick, unit["length"]).alias("length"), x["n_fit"].alias("n_fit"), x["n_form"].alias("n_form"),
        )
        mine = F.struct(unit["id"].alias("id"), segment.alias("segment"), x["slot"].alias("slot"))
        others = F.filter(acc["used"], lambda y: y["id"] != unit["id"])
        locks = F.when(pick & x["grp"].isNotNull() & lock.isNull(), F.concat(acc["locks"], F.array(F.struct(x["grp"].alias("grp"), unit["subject"].alias("subject"))))).otherwise(acc["locks"])
        return F.struct(F.when(pick | fuse, F.concat(others, F.array(mine))).otherwise(acc["used"]).alias("used"), locks.alias("locks"), F.concat(acc["out"], F.array(row)).alias("out"))

    folded = whole.groupBy(*keys).agg(F.aggregate(F.array_sort(F.collect_list(row)), start, step)["out"].alias("o"))
    return folded.select(*keys, F.explode("o").alias("o")).select(*keys, "o.*")


def plan_verdicts(assigned: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """Length, missing slots and the first reason against each plan of ``assign_slots``: slots missing, too short, too long, else passed."""
    missing = F.array_sort(F.collect_list(F.when(F.col("verdict") == "missing", F.col("slot"))))
    whole = assigned.groupBy(*keys).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("length"), F.count_if(F.col("verdict") == "picked").alias("segments"), missing.alias("_missing"))
    reason = F.when(F.size("_missing") > 0, "required slots missing").when(F.col("length") < least, "below the least length").when(F.col("length") > most, "over the longest").otherwise("passed")
    return whole.select(*keys, "length", "segments", F.concat_ws(",", F.transform("_missing", lambda x: x.cast("string"))).alias("missing"), reason.alias("reason"))


def transition_score(left: Column, right: Column) -> Column:
    """Points for following ``left`` by ``right``: a shared name 25, the same source 5, not earlier in time 8, caused 25 or else preceded 10, against the cause -35, the same row -30."""
    part = lambda test, points: F.when(F.coalesce(test, F.lit(False)), points).otherwise(0)
    caused, preceded = F.array_contains(right["causes"], left["event"]), F.array_contains(right["precedes"], left["event"])
    return (
        part(F.arrays_overlap(left["names"], right["names"]), 25)
        + part(left["source"] == right["source"], 5)
        + part(left["s"] <= right["s"], 8)
        + F.when(F.coalesce(caused, F.lit(False)), 25).when(F.coalesce(preceded, F.lit(False)), 10).otherwise(0)
        - part(F.array_contains(left["causes"], right["event"]), 35)
        - part(left["id"] == right["id"], 30)
    ).cast("long")


def chain_path(groups: Column, kind: str) -> Column:
    """The best path through candidate groups in order, as an array of (slot, id, score), by a fold over slots that keeps one path a candidate (V6).

    A group is a struct (slot, hard, rows), rows structs of type ``kind`` in order of preference. Into a ``hard`` slot a candidate has to share a name with the one before. A
    slot that no candidate can reach, or that has none, is left out, and a new chain starts after it; each chain takes its best path, ties to the earlier candidate, last slot first.
    """
    picked = "array<struct<slot:bigint,id:bigint,score:bigint>>"
    state = f"array<struct<total:bigint,k:bigint,path:{picked},row:{kind}>>"
    start = F.struct(F.array().cast(state).alias("live"), F.array().cast(picked).alias("done"))
    top = lambda live: F.array_max(F.transform(live, lambda p: F.struct(p["total"].alias("total"), p["k"].alias("k"), p["path"].alias("path"))))["path"]

    def reach(acc: Column, x: Column, row: Column, i: Column) -> Column:
        own = F.array(F.struct(x["slot"].cast("long").alias("slot"), row["id"].alias("id"), row["score"].alias("score")))
        ways = F.filter(acc["live"], lambda p: ~x["hard"] | F.coalesce(F.arrays_overlap(p["row"]["names"], row["names"]), F.lit(False)))
        best = F.array_max(F.transform(ways, lambda p: F.struct((p["total"] + transition_score(p["row"], row)).alias("total"), p["k"].alias("k"), p["path"].alias("path"))))
        fresh = F.size(acc["live"]) == 0
        total = F.when(fresh, row["score"]).otherwise(best["total"] + row["score"])
        path = F.when(fresh, own).otherwise(F.concat(best["path"], own))
        return F.struct(total.alias("total"), (-i).cast("long").alias("k"), path.alias("path"), row.alias("row"))

    def step(acc: Column, x: Column) -> Column:
        live = F.filter(F.transform(x["rows"], lambda row, i: reach(acc, x, row, i)), lambda p: p["total"].isNotNull())
        ended = (F.size(live) == 0) & (F.size(acc["live"]) > 0)
        return F.struct(live.alias("live"), F.when(ended, F.concat(acc["done"], top(acc["live"]))).otherwise(acc["done"]).alias("done"))

    return F.aggregate(groups, start, step, lambda acc: F.when(F.size(acc["live"]) > 0, F.concat(acc["done"], top(acc["live"]))).otherwise(acc["done"]))


def contract_paths(candidates: DataFrame, slots: DataFrame, keys: list[str], per_slot: int = 12) -> DataFrame:
    """The best path of each plan under one identity: each name in the first required slot is a hypothesis that later required slots must hold (V6, V7).

    ``slots``: keys, slot, required, hard. ``candidates``: keys, slot, id, score (points, whole numbers), names, source, s, event, causes, precedes; the ``per_slot`` best a
    slot count (score, then the earlier start, then id). Hypotheses are rows: each plan is multiplied by the names of its first required slot that has candidates, at
    most those of ``per_slot`` rows, and every copy is one fold of its slots. The winner covers most slots, then is a canonical name
    (``char:``), then has the larger sum of scores, then came first. A plan without names or required slots has one copy without restriction.

    Returns keys, hypothesis (null if none), covered, score, n_hypotheses and ``path`` (slot, id, score).
    """
    kind = candidates.select(F.struct("id", "score", "names", "source", "s", "event", "causes", "precedes").alias("r")).schema["r"].dataType.simpleString()
    place = F.row_number().over(Window.partitionBy(*keys, "slot").orderBy(F.desc("score"), "s", "id"))
    rows = candidates.withColumn("place", place).where(F.col("place") <= per_slot)
    rows = rows.groupBy(*keys, "slot").agg(F.array_sort(F.collect_list(F.struct("place", F.struct("id", "score", "names", "source", "s", "event", "causes", "precedes").alias("row")))).alias("rows"))
    groups = slots.join(rows.withColumn("rows", F.transform("rows", lambda x: x["row"])), [*keys, "slot"], "left").withColumn("rows", F.coalesce("rows", F.array().cast(f"array<{kind}>")))
    plans = durable(groups.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", "required", "hard", "rows"))).alias("groups")), "contract-plans")
    first = F.get(F.filter("groups", lambda g: g["required"] & (F.size(g["rows"]) > 0)), F.lit(0))["rows"]
    names = F.coalesce(F.array_distinct(F.flatten(F.transform(first, lambda r: F.array_sort(F.coalesce(r["names"], F.array().cast("array<string>")))))), F.array().cast("array<string>"))
    asked = plans.withColumn("names", names).select("*", F.posexplode_outer("names").alias("at", "hypothesis"))
    held = F.transform(
        "groups",
        lambda g: F.struct(
            g["slot"].alias("slot"), g["hard"].alias("hard"),
            F.filter(g["rows"], lambda r: F.col("hypothesis").isNull() | ~g["required"] | F.coalesce(F.array_contains(r["names"], F.col("hypothesis")), F.lit(False))).alias("rows"),
        ),
    )
    paths = asked.select(*keys, "at", "hypothesis", F.size("names").cast("long").alias("n_hypotheses"), chain_path(held, kind).alias("path"))
    score = F.aggregate("path", F.lit(0).cast("long"), lambda a, x: a + x["score"])
    rank = F.struct(F.size("path").alias("covered"), F.coalesce(F.col("hypothesis").startswith("char:"), F.lit(False)).alias("canonical"), score.alias("score"), (-F.coalesce("at", F.lit(0))).alias("first"))
    best = paths.groupBy(*keys).agg(F.max_by(F.struct("hypothesis", "n_hypotheses", "path", rank.alias("rank")), rank).alias("b"))
    return best.select(*keys, "b.hypothesis", F.col("b.rank.covered").cast("long").alias("covered"), "b.rank.score", "b.n_hypotheses", "b.path")


def search_in_layers(asks: DataFrame, layers: list[Callable[[DataFrame], DataFrame]], blocked: DataFrame, radius: int, width: int) -> DataFrame:
    """For each ask its best candidate of the first layer that has one away from all blocked places (V8).

    ``asks``: ask and what layers need. A layer gets the asks still open, so that none is scored for one that is served, and returns (ask, source, id, s, e, score).
    ``blocked``: (ask, source, s2, e2), places taken or rejected: a candidate within ``radius`` of one on both sides is out, by an anti join on intervals. Best: score, the earlier
    start, id. Returns ask, layer (1, 2, ...; null if none), source, id, s, e, score. Each layer is written, and the next reads only the asks left.
    """
    found, left = [], asks
    walls = blocked.select("ask", "source", (F.col("s2") - radius).alias("s2"), (F.col("e2") + radius).alias("e2"))
    for number, layer in enumerate(layers, 1):
        rows = durable(layer(left).select("ask", "source", "id", "s", "e", "score"), "search-rows")
        grown = rows.select("ask", "source", "id", (F.col("s") - radius).alias("s"), (F.col("e") + radius).alias("e"))
        near_walls = walls.join(rows.select("ask").distinct(), "ask", "left_semi")  # only asks that this layer has candidates for
        near = overlap_join(grown, near_walls, ["ask", "source"], width).select("ask", "source", "id").distinct()
        free = rows.join(near, ["ask", "source", "id"], "left_anti")
        best = free.groupBy("ask").agg(F.min_by(F.struct("source", "id", "s", "e", "score"), F.struct((-F.col("score")).alias("k"), "s", "id")).alias("b"))
        served = durable(best.select("ask", F.lit(number).cast("long").alias("layer"), "b.*"), "search-layer")
        found.append(served)
        left = durable(left.join(served.select("ask"), "ask", "left_anti"), "search-left")
    out = reduce(DataFrame.unionByName, found)
    return out.unionByName(left.select("ask"), allowMissingColumns=True)


def directed_clique(seeds: DataFrame, candidates: DataFrame, answers: DataFrame, keys: list[str], spacing: int, want: int = 3) -> DataFrame:
    """A clique of ``want`` that answer "same" of each other in both directions, and one row that answers "different" to and from all of them.

    ``seeds``: keys, id, t; ``candidates``: keys, id, t, hint; ``answers``: keys, left, right, result (same, different or else), one row a directed pair.
    Candidates come by hint (possible, unsure, hard), distance from the seed, time, id; each joins if it is ``spacing`` or more from all members and agrees with all. What was passed
    over before a member came stays out, as more members only ask more of it, so each member is one join with the answers of the member before, and no list is folded. The
    counter-example comes from the other candidates, hard ones first, then by distance and time. Returns keys, ids (seed first), negative, passed.
    """
    told = answers.where("result IN ('same', 'different')").select(*keys, F.least("left", "right").alias("lo"), F.greatest("left", "right").alias("hi"), "left", "right", "result")
    forth, back = (F.max(F.when(c, F.col("result"))) for c in (F.col("left") <= F.col("right"), F.col("left") >= F.col("right")))
    mutual = told.groupBy(*keys, "lo", "hi").agg(forth.alias("result"), back.alias("back")).where("result = back").drop("back")
    mutual = durable(mutual, "clique-answers")  # one row for both directions, from one shuffle
    ways = F.array_distinct(F.array(F.struct(F.col("lo").alias("member"), F.col("hi").alias("id")), F.struct(F.col("hi").alias("member"), F.col("lo").alias("id"))))
    both = mutual.select(*keys, "result", F.explode(ways).alias("w")).select(*keys, "w.member", "w.id", "result")
    hints = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for x in ("possible", 0, "unsure", 1, "hard", 2))), F.col("hint")), F.lit(1))
    seed = seeds.select(*keys, F.col("id").alias("seed_id"), F.col("t").alias("seed_t"))
    far = F.abs(F.col("t") - F.col("seed_t"))
    ranked = candidates.join(seed, keys).where("id <> seed_id").select(*keys, "id", "t", "hint", F.struct(hints.alias("h"), far.alias("far"), "t", "id").alias("turn"), far.alias("far"))
    ranked = durable(ranked, "clique-candidates")
    open_, members = ranked, seed.select(*keys, F.col("seed_id").alias("member"), F.col("seed_t").alias("member_t"), F.lit(0).alias("at"))
    found, newest = [members], members
    for at in range(1, want):
        agree = newest.join(both.where("result = 'same'"), [*keys, "member"]).select(*keys, "id", "member_t")
        open_ = durable(open_.join(agree, [*keys, "id"]).where(F.abs(F.col("t") - F.col("member_t")) >= spacing).drop("member_t"), "clique-open")
        first = open_.groupBy(*keys).agg(F.min("turn").alias("turn"))
        newest = first.select(*keys, F.col("turn.id").alias("member"), F.col("turn.t").alias("member_t"), F.lit(at).alias("at"))
        found.append(newest)
    members = durable(reduce(DataFrame.unionByName, found), "clique-members")
    whole = members.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "member"))).alias("m")).select(*keys, F.transform("m", lambda x: x["member"]).alias("ids"))
    against = members.join(both.where("result = 'different'"), [*keys, "member"]).groupBy(*keys, "id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == want)
    others = ranked.join(against, [*keys, "id"]).groupBy(*keys).agg(F.min(F.struct(F.when(F.col("hint") == "hard", 0).otherwise(1).alias("h"), "far", "t", "id")).alias("b"))
    out = whole.join(others, keys, "left")
    complete = F.size("ids") == want
    return out.select(*keys, "ids", F.when(complete, F.col("b.id")).alias("negative"), (complete & F.col("b.id").isNotNull()).alias("passed"))


def best_combination(options: DataFrame, keys: list[str]) -> DataFrame:
    """One option or none of each part, so that most parts have one, then most different events are held, then fewest are held twice.

    ``options``: keys, part, option, events (array). No two chosen options may hold equal event lists. Parts are taken in order, one join each; ties go to the combination that is first in order,
    none before any option. This is branch and bound: a greedy choice gives each key a score to beat, and a partial combination goes on only if its
    count, its events with the most that the remaining parts can add, and its repeats so far can still reach that score. The product of all options is not built.

    Returns keys, chosen (array of part and option), n_parts, n_events, n_repeats and n_built, the partial combinations built for the key.
    """
    order = Window.partitionBy(*keys).orderBy("part")
    parts = options.groupBy(*keys, "part").agg(F.array_sort(F.collect_list(F.struct("option", "events"))).alias("options"), F.max(F.size(F.array_distinct("events"))).alias("most"))
    after = order.rowsBetween(1, Window.unboundedFollowing)
    parts = parts.withColumns({"at": F.row_number().over(order), "parts_left": F.count(F.lit(1)).over(after), "most_left": F.coalesce(F.sum("most").over(after), F.lit(0))})
    parts = durable(parts, "combination-parts")
    kind = parts.schema["options"].dataType.elementType
    opt, events = kind["option"].dataType.simpleString(), kind["events"].dataType.simpleString()
    part = parts.schema["part"].dataType.simpleString()

    start = F.struct(F.array().cast(f"array<struct<part:{part},option:{opt}>>").alias("chosen"), F.array().cast(f"array<{events}>").alias("lists"), F.array().cast(events).alias("held"), F.lit(0).alias("total"), F.array().cast("array<int>").alias("turn"))

    def take(acc: Column, p: Column, x: Column, i: Column) -> Column:
        return F.struct(
            F.concat(acc["chosen"], F.array(F.struct(p["part"].alias("part"), x["option"].alias("option")))).alias("chosen"), F.concat(acc["lists"], F.array(x["events"])).alias("lists"),
            F.array_union(acc["held"], x["events"]).alias("held"), (acc["total"] + F.size(x["events"])).alias("total"), F.concat(acc["turn"], F.array(i + 1)).alias("turn"),
        )

    skip = lambda acc: F.struct(acc["chosen"].alias("chosen"), acc["lists"].alias("lists"), acc["held"].alias("held"), acc["total"].alias("total"), F.concat(acc["turn"], F.array(F.lit(0))).alias("turn"))
    free = lambda acc, x: ~F.array_contains(acc["lists"], x["events"])
    score = lambda acc: F.struct(F.size(acc["chosen"]).alias("n"), F.size(acc["held"]).alias("events"), (F.size(acc["held"]) - acc["total"]).alias("repeats"))

    def greedy(acc: Column, p: Column) -> Column:
        ways = F.filter(F.transform(p["options"], lambda x, i: F.when(free(acc, x), F.struct(F.size(F.array_except(x["events"], acc["held"])).alias("new"), (-i).alias("k")))), lambda w: w.isNotNull())
        at = -F.array_max(ways)["k"]
        return F.when(F.size(ways) == 0, skip(acc)).otherwise(take(acc, p, F.get(p["options"], at), at))

    listed = parts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "part", "options"))).alias("p"))
    lead = durable(listed.select(*keys, F.aggregate("p", start, greedy).alias("g")).select(*keys, score(F.col("g")).alias("beat")), "combination-bound")
    state, built = lead.select(*keys, "beat", start.alias("acc")), []
    depth = parts.agg(F.max("at")).first()[0] or 0
    done = []
    for at in range(1, depth + 1):
        here = parts.where(F.col("at") == at).select(*keys, F.struct("part", "options").alias("p"), "parts_left", "most_left")
        met = state.join(here, keys)
        ways = F.concat(F.array(skip(F.col("acc"))), F.transform("p.options", lambda x, i: F.when(free(F.col("acc"), x), take(F.col("acc"), F.col("p"), x, i))))
        grown = met.select(*keys, "beat", "parts_left", "most_left", F.explode(F.filter(ways, lambda w: w.isNotNull())).alias("acc"))
        acc = F.col("acc")
        reach = F.struct((F.size(acc["chosen"]) + F.col("parts_left")).cast("int").alias("n"), (F.size(acc["held"]) + F.col("most_left")).cast("int").alias("events"), (F.size(acc["held"]) - acc["total"]).alias("repeats"))
        kept = durable(grown.where(reach >= F.col("beat")), "combination-level")
        built.append(kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
        done.append(kept.where("parts_left = 0").select(*keys, "acc"))
        state = kept.where("parts_left > 0").select(*keys, "beat", "acc")
    if not done:
        none = lead.select(*keys, start.alias("acc"))
        done, built = [none], [none.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))]
    best = reduce(DataFrame.unionByName, done).groupBy(*keys).agg(F.min_by("acc", F.struct((-F.size("acc.chosen")).alias("a"), (-F.size("acc.held")).alias("b"), (F.col("acc.total") - F.size("acc.held")).alias("c"), "acc.turn")).alias("acc"))
    counts = reduce(DataFrame.unionByName, built).groupBy(*keys).agg(F.sum("n").alias("n_built"))
    acc = F.col("acc")
    sizes = {"n_parts": F.size(acc["chosen"]), "n_events": F.size(acc["held"]), "n_repeats": acc["total"] - F.size(acc["held"])}
    return best.join(counts, keys).select(*keys, F.col("acc.chosen").alias("chosen"), *(x.cast("long").alias(n) for n, x in sizes.items()), "n_built")


def refit_slots(slots: DataFrame, keys: list[str], floor: int, most: int, longest: int, percent: int = 120) -> DataFrame:
    """Lengths of a plan's slots by what they have to show, and their places end to end.

    ``slots``: keys, slot, total (the plan's length), evidence, speech (lengths). A slot gets the largest of an equal share, its evidence and its speech, within [``floor``, ``most``]. If the
    sum exceeds ``percent`` of the plan's length, or ``longest``, slots of no more than the equal share give up to ``floor``, first ones first, until it fits; a running sum of what each
    can give tells how much it gives. Where that is not enough the plan stays longer. Returns keys, slot, length, s, e and plan_length.
    """
    plan, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("slot")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = slots.withColumn("equal", F.floor(F.col("total") / F.count(F.lit(1)).over(plan)))
    rows = rows.withColumn("need", F.least(F.lit(most), F.greatest(F.lit(floor), "equal", F.coalesce("evidence", F.lit(0)), F.coalesce("speech", F.lit(0)))))
    rows = rows.withColumn("slack", F.sum("need").over(plan) - F.least(F.floor(F.col("total") * percent / 100), F.lit(longest)))
    rows = rows.withColumn("spare", F.when(F.col("need") <= F.col("equal"), F.col("need") - floor).otherwise(F.lit(0)))
    given = F.greatest(F.lit(0), F.least(F.col("spare"), F.col("slack") - F.coalesce(F.sum("spare").over(before), F.lit(0))))
    fitted = rows.withColumn("length", (F.col("need") - given).cast("long"))
    end = F.sum("length").over(order)
    return fitted.select(*keys, "slot", "length", (end - F.col("length")).alias("s"), end.alias("e"), F.sum("length").over(plan).alias("plan_length"))


def refit_roughcut(slots: DataFrame, keys: list[str], least: int, longest: int) -> DataFrame:
    """As ``refit_slots`` for a rough cut: every slot gets all it has to show, and only the rest of the budget is shared.

    ``slots``: keys, slot, evidence, speech, source (lengths), required. A slot needs the longest of the three. A plan whose needs exceed ``longest`` is infeasible (no lengths). One below ``least`` is
    extended by as much as its optional slots' sources are long, up to ``least``, shared out evenly, later slots getting what does not divide. Returns keys, slot, length, s, e, plan_length, feasible.
    """
    plan, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("slot")
    lengths = [F.coalesce(c, F.lit(0)) for c in ("evidence", "speech", "source")]
    rows = slots.withColumn("need", F.greatest(*lengths)).withColumns({"n": F.count(F.lit(1)).over(plan), "at": F.row_number().over(order), "sum": F.sum("need").over(plan)})
    context = F.sum(F.when(F.col("required"), 0).otherwise(lengths[2])).over(plan)
    rows = rows.withColumn("rest", F.when(F.col("sum") < least, F.greatest(F.lit(0), F.least(F.lit(longest), F.least(F.lit(least), F.col("sum") + context)) - F.col("sum"))).otherwise(F.lit(0)))
    share = F.floor(F.col("rest") / F.col("n")) + (F.col("at") > F.col("n") - F.col("rest") % F.col("n")).cast("long")
    ok = F.col("sum") <= longest
    fitted = rows.withColumn("length", F.when(ok, F.col("need") + share).cast("long"))
    end = F.sum("length").over(order)
    return fitted.select(*keys, "slot", "length", (end - F.col("length")).alias("s"), end.alias("e"), F.sum("length").over(plan).alias("plan_length"), ok.alias("feasible"))
