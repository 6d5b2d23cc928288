"""Planning edits over timelines: merging, grouping, splitting, tiling, choosing windows and plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.functions.text import mixed_shingles
from loomline.operators.intervals import islands, overlap_join


def merge_first_match(df: DataFrame, keys: list[str], tolerance: int, strict: bool = False) -> DataFrame:
    """Sorted by (s, e, id), each row joins the first earlier group that is compatible and near, else it opens one.

    Compatible: same ``form``, and the same ``action`` or a shared one of ``attrs``. Near: within ``tolerance`` of the group's extent as it has
    grown (``strict``: overlapping by more than a point). A group keeps its first action, the union of attributes, whether any row is ``needed``, and n.
    This is no transitive closure: groups never merge. Rows farther apart than the tolerance cannot meet, so each such stretch folds alone.
    """
    runs = islands(df, keys, tolerance, strict=strict, out="_run")
    rows = F.array_sort(F.collect_list(F.struct("s", "e", "id", "form", "action", "attrs", "needed")))
    none = F.array().cast("array<struct<s:bigint,e:bigint,form:bigint,action:string,attrs:array<bigint>,needed:boolean,n:bigint>>")

    def fits(g: Column, x: Column) -> Column:
        near = (x["s"] < g["e"]) & (g["s"] < x["e"]) if strict else (x["s"] <= g["e"] + tolerance) & (g["s"] <= x["e"] + tolerance)
        return near & (g["form"] == x["form"]) & ((g["action"] == x["action"]) | F.arrays_overlap(g["attrs"], x["attrs"]))

    def grown(g: Column, x: Column) -> Column:
        return F.struct(
            F.least(g["s"], x["s"]).alias("s"), F.greatest(g["e"], x["e"]).alias("e"), g["form"].alias("form"), g["action"].alias("action"),
            F.array_union(g["attrs"], x["attrs"]).alias("attrs"), (g["needed"] | x["needed"]).alias("needed"), (g["n"] + 1).alias("n"),
        )

    def step(acc: Column, x: Column) -> Column:
        at = F.array_position(F.transform(acc, lambda g: fits(g, x)), True)
        fresh = F.struct(*(x[c].alias(c) for c in ("s", "e", "form", "action", "attrs", "needed")), F.lit(1).cast("long").alias("n"))
        return F.when(at == 0, F.concat(acc, F.array(fresh))).otherwise(F.transform(acc, lambda g, i: F.when(i + 1 == at, grown(g, x)).otherwise(g)))

    return runs.groupBy(*keys, "_run").agg(F.aggregate(rows, none, step).alias("g")).select(*keys, F.explode("g").alias("g")).select(*keys, "g.*")


def group_by_role(df: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    """Segments in order (s, id) grouped: absorb until ``least`` long, then while the role stays, never beyond ``most``.

    Returns each group's number, length, last role and count. A key is one timeline of segments, whose groups are a list in one fold.
    """
    rows = F.array_sort(F.collect_list(F.struct("s", "id", "length", "role")))
    none = F.array().cast("array<struct<length:bigint,role:string,n:bigint>>")

    def step(acc: Column, x: Column) -> Column:
        g = F.element_at(acc, -1)
        fits = (g["length"] + x["length"] <= most) & ((g["length"] < least) | (g["role"] == x["role"]))
        more = F.struct((g["length"] + x["length"]).alias("length"), x["role"].alias("role"), (g["n"] + 1).alias("n"))
        fresh = F.struct(x["length"].alias("length"), x["role"].alias("role"), F.lit(1).cast("long").alias("n"))
        return F.when(F.size(acc) == 0, F.array(fresh)).when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(more))).otherwise(F.concat(acc, F.array(fresh)))

    return df.groupBy(*keys).agg(F.aggregate(rows, none, step).alias("g")).select(*keys, F.posexplode("g").alias("unit", "g")).select(*keys, F.col("unit").cast("long").alias("unit"), "g.*")


def split_at(shots: DataFrame, cuts: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Shots (id, s, e) cut at the points (t) strictly inside them; the children keep the shot's id."""
    points = cuts.select(*keys, F.col("t").alias("s2"), (F.col("t") + 1).alias("e2"))
    inside = overlap_join(shots.select(*keys, "id", "s", "e"), points, keys, width).where((F.col("s2") > F.col("s")) & (F.col("s2") < F.col("e")))
    found = inside.groupBy(*keys, "id").agg(F.array_sort(F.collect_set("s2")).alias("_cuts"))
    bounds = F.concat(F.array("s"), F.coalesce("_cuts", F.array().cast("array<bigint>")), F.array("e"))
    whole = shots.join(found, [*keys, "id"], "left").withColumn("_b", bounds)
    parts = whole.select(*keys, "id", "_b", F.explode(F.sequence(F.lit(0), F.size("_b") - 2)).alias("part"))
    return parts.select(*keys, "id", F.col("part").cast("long").alias("part"), F.get("_b", F.col("part")).alias("s"), F.get("_b", F.col("part") + 1).alias("e"))


def tile_to_ends(shots: DataFrame, keys: list[str], lo: int, hi: int, least: int) -> DataFrame:
    """The pieces of [lo, hi] before the first and after the last shot of a key, if longer than ``least``."""
    ends = shots.groupBy(*keys).agg(F.min("s").alias("first"), F.max("e").alias("last"))
    head = ends.select(*keys, F.lit("head").alias("side"), F.lit(lo).cast("long").alias("s"), F.col("first").alias("e"))
    return head.unionByName(ends.select(*keys, F.lit("tail").alias("side"), F.col("last").alias("s"), F.lit(hi).cast("long").alias("e"))).where(F.col("e") - F.col("s") > least)


def flatten_timeline(content: DataFrame, transitions: DataFrame, montage: DataFrame, keys: list[str]) -> DataFrame:
    """Content and transitions as one timeline in order (s, e, id); a missing type is the montage's."""
    rows = content.select(*keys, "id", "s", "e", "type").unionByName(transitions.select(*keys, "id", "s", "e", "type"))
    typed = rows.join(montage.withColumnRenamed("type", "_type"), keys, "left").withColumn("type", F.coalesce("type", "_type")).drop("_type")
    return typed.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("s", "e", "id")).cast("long"))


def normalise_interval(s: Column, e: Column, relative: Column, lo: Column, hi: Column, point: int) -> tuple[Column, Column, Column]:
    """(start, end, valid) on the container's clock: relative times are moved to its start, a point gets ``point``, and both ends must lie inside (I32)."""
    start = F.when(relative, lo + s).otherwise(s)
    end = F.when(relative, lo + e).otherwise(e)
    end = F.when(end == start, start + point).otherwise(end)
    return start, end, (start >= lo) & (end <= hi) & (end > start)


def fit_interval(s: Column, e: Column, lo: Column, hi: Column, least: int, most: int) -> tuple[Column, Column]:
    """An interval grown about its middle to ``least``, or cut from its start to ``most``, and moved into [lo, hi] (I32)."""
    length = F.least(F.greatest(e - s, F.lit(least)), F.lit(most), hi - lo)
    start = F.when(e - s < length, F.floor((s + e - length) / 2)).otherwise(s)
    start = F.greatest(lo, F.least(start, hi - length))
    return start, start + length


def first_cut(issues: DataFrame, cuts: DataFrame, keys: list[str], tolerance: int, width: int, n: int) -> DataFrame:
    """Numbers of the cuts that issues (id, t) fall in, within ``tolerance``: the first of each issue, distinct, ``n`` a key."""
    wide = cuts.select(*keys, F.col("idx"), (F.col("s") - tolerance).alias("s2"), (F.col("e") + tolerance + 1).alias("e2"))
    hit = overlap_join(issues.select(*keys, "id", F.col("t").alias("s"), (F.col("t") + 1).alias("e")), wide, keys, width).groupBy(*keys, "id").agg(F.min("idx").alias("idx"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("idx"))
    return hit.select(*keys, "idx").distinct().withColumn("place", place.cast("long")).where(F.col("place") <= n)


def covered_whole(claims: DataFrame, support: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Claims (id, s, e) that one visible support interval covers from end to end."""
    pairs = overlap_join(claims, support.where("visible").select(*keys, F.col("s").alias("s2"), F.col("e").alias("e2")), keys, width)
    ok = pairs.where((F.col("s2") <= F.col("s")) & (F.col("e2") >= F.col("e"))).select("id").distinct()
    return claims.join(ok.withColumn("_ok", F.lit(True)), "id", "left").withColumn("sufficient", F.coalesce("_ok", F.lit(False))).drop("_ok")


def cut_plan(beats: DataFrame, keys: list[str], hi: int, least: int, most: int) -> DataFrame:
    """Pieces between 0, the beats and ``hi``, those of ``least`` or more, thinned evenly to ``most`` (I18): piece i of most is floor(i n / most)."""
    bounds = F.array_sort(F.array_union(F.array(F.lit(0).cast("long"), F.lit(hi).cast("long")), F.collect_set("t")))
    pieces = beats.where((F.col("t") > 0) & (F.col("t") < hi)).groupBy(*keys).agg(bounds.alias("b"))
    made = F.filter(F.transform(F.sequence(F.lit(0), F.size("b") - 2), lambda i: F.struct(F.get("b", i).alias("s"), F.get("b", i + 1).alias("e"))), lambda x: x["e"] - x["s"] >= least)
    n = F.size("p")
    thin = F.when(n <= most, F.col("p")).otherwise(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get("p", F.floor(i * n / most).cast("int"))))
    return pieces.withColumn("p", made).select(*keys, F.posexplode(thin).alias("i", "x")).select(*keys, F.col("i").cast("long").alias("i"), "x.s", "x.e")


def evidence_window(shots: DataFrame, keys: list[str], wanted: DataFrame, budget: int) -> DataFrame:
    """The run of consecutive shots (idx, length, text) within ``budget`` that shares most shingles a shot with the wanted text (V9).

    One shot alone may exceed the budget. Ties go to the longer run, then to the earlier start, then to the shorter one. A run's end
    lies within ``budget`` of its start in the running sum, so starts meet ends in the same or the next stretch of that length, not in the whole key.
    """
    query = wanted.select(*keys, mixed_shingles(F.col("text")).alias("_q"))
    order = Window.partitionBy(*keys).orderBy("idx")
    hits = F.size(F.array_intersect(mixed_shingles(F.col("text")), F.col("_q"))).cast("long")
    rows = shots.join(query, keys).select(*keys, "idx", "length", hits.alias("hits"), F.sum("length").over(order).alias("sum"), F.sum(hits).over(order).alias("sum_hits"))
    lo, lo_hits = F.col("sum") - F.col("length"), F.col("sum_hits") - F.col("hits")
    alone = rows.select(*keys, F.col("idx").alias("first"), F.col("idx").alias("last"), lo.alias("lo"), lo_hits.alias("lo_hits"), "sum", "sum_hits")
    at = F.floor(lo / budget)
    a = rows.select(*keys, F.col("idx").alias("first"), lo.alias("lo"), lo_hits.alias("lo_hits"), F.explode(F.array(at, at + 1)).alias("_at"))
    b = rows.select(*keys, F.col("idx").alias("last"), "sum", "sum_hits", F.floor(F.col("sum") / budget).alias("_at"))
    longer = a.join(b, [*keys, "_at"]).where((F.col("last") > F.col("first")) & (F.col("sum") - F.col("lo") <= budget))
    runs = alone.unionByName(longer.drop("_at"))
    score = (F.col("sum_hits") - F.col("lo_hits")) / (F.col("last") - F.col("first") + 1)
    best = runs.groupBy(*keys).agg(F.min(F.struct((-score).alias("k"), (-F.least(F.col("sum") - F.col("lo"), F.lit(budget))).alias("l"), "first", "last")).alias("b"))
    return best.select(*keys, "b.first", "b.last", F.round(-F.col("b.k"), 6).alias("score"))


def candidate_plans(moments: DataFrame, keys: list[str], phases: DataFrame) -> DataFrame:
    """Three plans a key, of the shortest, longest and earliest moment of each (section, phase); incomplete ones are left out."""
    length = F.col("e") - F.col("s")
    orders = {"shortest": F.struct(length.alias("k"), "s", "id"), "longest": F.struct((-length).alias("k"), "s", "id"), "earliest": F.struct(F.lit(0).cast("long").alias("k"), "s", "id")}
    asked = moments.join(phases, ["section", "phase"], "left_semi")
    picks = None
    for name, order in orders.items():
        part = asked.groupBy(*keys, "section", "phase").agg(F.min_by(F.struct("id", "s", "e", "take"), order).alias("m")).select(*keys, F.lit(name).alias("strategy"), "section", "phase", "m.*")
        picks = part if picks is None else picks.unionByName(part)
    counts = picks.groupBy(*keys, "strategy").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(phases.count()))
    return picks.join(counts.where("_n = _all").drop("_n", "_all"), [*keys, "strategy"])


STRATEGIES = ("shortest", "longest", "earliest")


def plan_scores(plans: DataFrame, keys: list[str], shape: DataFrame, unit: int, low: int, high: int, slack: float = 0.05) -> DataFrame:
    """Problems and score of every plan of ``candidate_plans`` with a ``take`` a moment.

    ``shape``: (section, ratio, least, most), the sections' shares of the whole as the reference has them. A plan must last [``low``, ``high``], each section keep its
    range within ``slack``, and no two moments of a take overlap, anywhere in the plan. The score is 2 x variety (moments, up to 12, of 12) - overlap inside sections in
    ``unit`` - 1.5 x the sum of how far shares are from the given ratios.
    """
    section = Window.partitionBy(*keys, "strategy", "section").orderBy("s", "id")
    take = Window.partitionBy(*keys, "strategy", "take").orderBy("s", "e")
    rows = plans.withColumns({"over": F.greatest(F.lit(0), F.lag("e").over(section) - F.col("s")), "clash": F.coalesce(F.lead("s").over(take) < F.col("e"), F.lit(False))})
    sections = rows.groupBy(*keys, "strategy", "section").agg(F.sum(F.col("e") - F.col("s")).alias("span"), F.sum("over").alias("over"), F.count(F.lit(1)).alias("n"), F.bool_or("clash").alias("clash"))
    total = F.sum("span").over(Window.partitionBy(*keys, "strategy"))
    shares = sections.withColumn("total", total).join(shape, "section", "left").withColumn("share", F.col("span") / F.greatest(F.col("total"), F.lit(1)))
    outside = ~F.col("share").between(F.col("least") - slack, F.col("most") + slack)
    whole = shares.groupBy(*keys, "strategy").agg(
        F.first("total").alias("total"), F.sum(F.coalesce("over", F.lit(0))).alias("over"), F.sum("n").alias("n"), F.bool_or("clash").alias("clash"),
        F.bool_or(F.coalesce(outside, F.lit(False))).alias("outside"), F.sum(F.abs(F.col("share") - F.col("ratio"))).alias("error"),
    )
    problems = F.array_compact(F.array(F.when(~F.col("total").between(low, high), "length"), F.when(F.col("outside"), "section budget"), F.when(F.col("clash"), "overlap in a take")))
    score = F.least(F.col("n"), F.lit(12)) / 12.0 * 2.0 - F.col("over") / float(unit) - 1.5 * F.coalesce("error", F.lit(0.0))
    return whole.select(*keys, "strategy", F.concat_ws(",", problems).alias("problems"), F.round(score, 4).alias("score"))


def select_plan(scored: DataFrame, keys: list[str]) -> DataFrame:
    """The best plan of a key without a problem; of equal ones the first strategy (V12). A key without a legal plan has no row."""
    turn = F.array_position(F.array(*map(F.lit, STRATEGIES)), F.col("strategy"))
    legal = scored.where("problems = ''")
    return legal.groupBy(*keys).agg(F.min(F.struct((-F.col("score")).alias("k"), turn.alias("turn"), "strategy")).alias("b")).select(*keys, F.col("b.strategy").alias("strategy"), (-F.col("b.k")).alias("score"))


def montage(units: DataFrame, keys: list[str], roles: list[str], fill: int, preferred: int, least: int, most: int) -> DataFrame:
    """The best unit of each role, then the best others up to ``fill`` while they fit ``most``; beyond ``preferred`` only while short or lacking roles.

    Best: value, then the earlier start, then id. A key is one recording, whose units are one sorted list.
    """
    pick = F.row_number().over(Window.partitionBy(*keys, "role").orderBy(F.desc("value"), "s", "id"))
    marked = units.withColumn("lead", ((pick == 1) & F.col("role").isin(*roles)).cast("int"))
    rows = F.array_sort(F.collect_list(F.struct((1 - F.col("lead")).alias("k"), (-F.col("value")).alias("v"), "s", "id", "e", "role", "lead")))
    start = F.struct(F.lit(0).cast("long").alias("length"), F.array().cast("array<string>").alias("roles"), F.array().cast("array<bigint>").alias("ids"))

    def step(acc: Column, x: Column) -> Column:
        total = acc["length"] + x["e"] - x["s"]
        skip = (F.size(acc["ids"]) >= fill) | (total > most) | ((acc["length"] >= least) & (F.size(acc["roles"]) >= 3) & (total > preferred))
        taken = F.struct(total.alias("length"), F.array_union(acc["roles"], F.array(x["role"])).alias("roles"), F.concat(acc["ids"], F.array(x["id"])).alias("ids"))
        return F.when((x["lead"] == 0) & skip, acc).otherwise(taken)

    made = units.sparkSession.createDataFrame([(r,) for r in roles], "role string").agg(F.collect_list("role").alias("_roles"))
    plan = marked.groupBy(*keys).agg(F.aggregate(rows, start, step).alias("p")).crossJoin(F.broadcast(made))
    why = F.when(F.size("p.ids") < 3, "few").when(~F.array_contains("p.roles", F.get("_roles", 0)), "no hook").when(F.size("p.roles") < 3, "few roles").when(F.col("p.length") < least, "short").when(F.col("p.length") > most, "long")
    return plan.select(*keys, F.size("p.ids").cast("long").alias("n"), "p.length", F.concat_ws(",", F.transform(F.array_sort("p.ids"), lambda x: x.cast("string"))).alias("ids"), F.coalesce(why, F.lit("passed")).alias("verdict"))


def partition_phases(units: DataFrame, keys: list[str], required: Column, low: int, high: int) -> DataFrame:
    """Whether a key's units, in order, hold exactly the required phases, each unit within [low, high]."""
    rows = F.array_sort(F.collect_list(F.struct("idx", "phase")))
    got = units.groupBy(*keys).agg(F.transform(rows, lambda x: x["phase"]).alias("phases"), F.bool_and(F.col("length").between(low, high)).alias("in_range"))
    return got.withColumn("complete", F.col("phases") == required).withColumn("phases", F.concat_ws(">", "phases"))


def plan_windows(candidates: DataFrame, activity: DataFrame, keys: list[str], pad: int, gap: int, longest: int, cap: int, controls: int, apart: int, between: int, hi: int) -> DataFrame:
    """Windows to watch around candidates (id, t, types, confidence), and quiet ones for control from ``activity`` (t, act).

    Candidates in time order join the last window if they start less than ``gap`` after it and it stays within ``longest``. Of more than ``cap``
    windows, those that add most types not yet covered (then the surest, then the earliest) come first, then the surest. The quietest points
    ``apart`` or more from every window, control ones included, become ``controls`` more; a point before the end of the window taken last
    also has to be ``between`` from the middle of every control window. Windows are clipped to [0, hi]. A key is one recording, whose windows are one list.
    """
    spans = candidates.withColumns({"s": F.col("t") - pad, "e": F.col("t") + pad})
    runs = islands(spans, keys, gap, strict=True, out="_run")
    rows = F.array_sort(F.collect_list(F.struct("t", "id", "types", "confidence")))
    kind = "struct<s:bigint,e:bigint,types:array<string>,confidence:double,n:bigint>"
    none = F.array().cast(f"array<{kind}>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        fits = (x["t"] - pad - last["e"] < gap) & (x["t"] + pad - last["s"] <= longest)
        fresh = F.struct((x["t"] - pad).alias("s"), (x["t"] + pad).alias("e"), x["types"].alias("types"), x["confidence"].alias("confidence"), F.lit(1).cast("long").alias("n"))
        more = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["t"] + pad).alias("e"), F.array_union(last["types"], x["types"]).alias("types"), F.greatest(last["confidence"], x["confidence"]).alias("confidence"), (last["n"] + 1).alias("n"))
        return F.when(F.size(acc) == 0, F.array(fresh)).when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(more))).otherwise(F.concat(acc, F.array(fresh)))

    made = runs.groupBy(*keys, "_run").agg(F.aggregate(rows, none, step).alias("w")).select(*keys, F.explode("w").alias("w"))
    listed = made.groupBy(*keys).agg(F.array_sort(F.collect_list("w")).alias("w")).withColumn("every", F.array_distinct(F.flatten(F.transform("w", lambda x: x["types"]))))
    start = F.struct(F.array().cast("array<string>").alias("covered"), F.array().cast("array<int>").alias("kept"))

    def cover(acc: Column, _: Column) -> Column:
        worth = lambda x, i: F.struct(F.size(F.array_except(x["types"], acc["covered"])).alias("new"), x["confidence"].alias("confidence"), (-i).alias("k"))
        at = -F.array_max(F.transform("w", lambda x, i: F.when(~F.array_contains(acc["kept"], i), worth(x, i))))["k"]
        more = F.struct(F.array_union(acc["covered"], F.get("w", at)["types"]).alias("covered"), F.concat(acc["kept"], F.array(at)).alias("kept"))
        return F.when((F.size(acc["covered"]) >= F.size("every")) | (F.size(acc["kept"]) >= cap), acc).otherwise(more)

    first = F.when(F.size("w") > cap, F.aggregate(F.sequence(F.lit(1), F.size("every")), start, cover)["kept"]).otherwise(F.array().cast("array<int>"))
    by_sureness = F.transform(F.array_sort(F.transform("w", lambda x, i: F.struct((-x["confidence"]).alias("c"), i.alias("i")))), lambda x: x["i"])
    picked = listed.withColumn("first", first).withColumn("kept", F.concat("first", F.slice(F.array_except(by_sureness, F.col("first")), 1, F.greatest(F.lit(0), F.lit(cap) - F.size("first")))))
    chosen = picked.select(*keys, F.array_sort(F.transform("kept", lambda i: F.get("w", i))).alias("w"))
    quiet = activity.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("act", "t"))), lambda x: x["t"]).alias("_t"))

    def control(acc: Column, t: Column) -> Column:
        near = F.exists(acc, lambda x: (x["s"] - apart <= t) & (t <= x["e"] + apart))
        beside = (t < F.get(acc, F.size(acc) - 1)["e"]) & F.exists(acc, lambda x: (x["n"] == 0) & (F.abs(2 * t - x["s"] - x["e"]) < 2 * between))
        fresh = F.struct(F.greatest(t - pad, F.lit(0)).alias("s"), F.least(t + pad, F.lit(hi)).alias("e"), F.array().cast("array<string>").alias("types"), F.lit(0.0).alias("confidence"), F.lit(0).cast("long").alias("n"))
        return F.when(near | beside | (F.size(F.filter(acc, lambda x: x["n"] == 0)) >= controls), acc).otherwise(F.concat(acc, F.array(fresh)))

    inside = F.transform("w", lambda x: F.struct(F.greatest(x["s"], F.lit(0)).alias("s"), F.least(x["e"], F.lit(hi)).alias("e"), x["types"].alias("types"), x["confidence"].alias("confidence"), x["n"].alias("n")))
    whole = chosen.withColumn("w", inside).join(quiet, keys, "left").select(*keys, F.aggregate(F.coalesce("_t", F.array().cast("array<bigint>")), F.col("w"), control).alias("w"))
    rows = whole.select(*keys, F.explode("w").alias("w")).select(*keys, "w.*")
    return rows.withColumn("control", F.col("n") == 0)
