"""What is observed of a recording: windows aligned with its cuts, texts of two kinds merged, claims told apart."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators.intervals import islands
from loomline.operators.tables import durable


def equal_windows(spans: DataFrame, target: int, most: int) -> DataFrame:
    """Windows over each row's [0, hi]: equal parts of about ``target``, or ``most`` windows of ``target`` spread evenly over a longer span."""
    n = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.col("hi") / target))).cast("long")
    rows = spans.where("hi > 0").withColumn("n", n).withColumn("idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    whole = F.col("hi") <= F.col("n") * target
    s = F.when(whole, F.floor(F.col("hi") * F.col("idx") / F.col("n"))).otherwise(F.floor((F.col("hi") - target) * F.col("idx") / F.greatest(F.lit(1), F.col("n") - 1)))
    e = F.when(whole, F.floor(F.col("hi") * (F.col("idx") + 1) / F.col("n"))).otherwise(s + target)
    return rows.withColumns({"s": s, "e": e}).drop("n")


def _absorb_short(spans: Column, least: int) -> Column:
    """Spans shorter than ``least`` join the shorter neighbour, the left one on ties, from left to right: what came before is long enough, so one pass does."""
    state = "struct<out:array<struct<s:bigint,e:bigint>>,s:bigint>"
    start = F.struct(F.array().cast("array<struct<s:bigint,e:bigint>>").alias("out"), F.lit(None).cast("long").alias("s")).cast(state)

    def step(acc: Column, x: Column) -> Column:
        s, last = F.coalesce(acc["s"], x["s"]), F.element_at(F.concat(F.array(F.lit(None).cast("struct<s:bigint,e:bigint>")), acc["out"]), -1)
        mine = F.struct(s.alias("s"), x["e"].alias("e"))
        long_ = x["e"] - s >= least
        to_left = last.isNotNull() & (x["next"].isNull() | (last["e"] - last["s"] <= x["next"]))
        grown = F.concat(F.slice(acc["out"], 1, F.size(acc["out"]) - 1), F.array(F.struct(last["s"].alias("s"), x["e"].alias("e"))))
        none = F.lit(None).cast("long")
        return F.when(long_ | (last.isNull() & x["next"].isNull()), F.struct(F.concat(acc["out"], F.array(mine)).alias("out"), none.alias("s"))).when(to_left, F.struct(grown.alias("out"), none.alias("s"))).otherwise(F.struct(acc["out"].alias("out"), s.alias("s")))

    rows = F.transform(spans, lambda x, i: F.struct(x["s"].alias("s"), x["e"].alias("e"), (F.get(spans, i + 1)["e"] - F.get(spans, i + 1)["s"]).alias("next")))
    return F.aggregate(rows, start, step, lambda acc: acc["out"])


def _split_long(lo: Column, hi: Column, cuts: Column, target: int, least: int) -> Column:
    """A span cut at the soft cuts that leave ``least`` on both sides, then neighbours joined again, left to right, while they stay within ``target``."""
    kept = F.aggregate(
        cuts,
        F.array(lo),
        lambda acc, c: F.when((c - F.element_at(acc, -1) >= least) & (hi - c >= least), F.concat(acc, F.array(c))).otherwise(acc),
        lambda acc: F.concat(acc, F.array(hi)),
    )
    pieces = F.transform(F.sequence(F.lit(0), F.size(kept) - 2), lambda i: F.struct(F.get(kept, i).alias("s"), F.get(kept, i + 1).alias("e")))
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")

    def join(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["s"].alias("s"), x["e"].alias("e"))))
        return F.when(F.size(acc) == 0, F.array(x)).when(x["e"] - last["s"] <= target, grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(pieces, none, join)


def cheapest_merges(starts: list[int], end: int, most: int) -> list[int]:
    """Which of contiguous spans stay when the adjacent pair of least total length is joined, the earlier on ties, until ``most`` are left: a queue over linked spans."""
    n = len(starts)
    ends = [*starts[1:], end]
    after, before, alive = [*range(1, n), -1], [*range(-1, n - 1)], [True] * n
    queue = [(ends[i + 1] - starts[i], i, i + 1) for i in range(n - 1)]
    heapq.heapify(queue)
    left = n
    while left > most and queue:
        cost, i, j = heapq.heappop(queue)
        if not alive[i] or after[i] != j or ends[j] - starts[i] != cost:
            continue
        ends[i], alive[j], after[i] = ends[j], False, after[j]
        left -= 1
        if after[i] >= 0:
            before[after[i]] = i
            heapq.heappush(queue, (ends[after[i]] - starts[i], i, after[i]))
        if before[i] >= 0:
            heapq.heappush(queue, (ends[i] - starts[before[i]], before[i], i))
    return [i for i in range(n) if alive[i]]


def event_windows(spans: DataFrame, cuts: DataFrame, keys: list[str], target: int, least: int, most: int) -> DataFrame:
    """Windows to observe of each recording [0, hi], aligned with its cuts (t, hard).

    Hard cuts bound windows; a stretch between them longer than ``target`` is also cut at soft ones that leave ``least`` on both sides, and what fits ``target`` together is joined
    again. Windows shorter than ``least`` join the shorter neighbour; of more than ``most`` the adjacent pair of least total length is joined, again and again. Recordings without a cut get equal windows.

    Stretches between hard cuts are rows of their own, so the splitting of a long recording is many tasks; the last two steps need its windows in one list, which
    ``hi`` / ``least`` bounds for the second. Returns keys, idx, s, e, hard and soft (whether an end is such a cut). Cuts outside of (0, hi) are ignored; hard wins at equal times.
    """
    inside = cuts.join(spans.select(*keys, "hi"), keys).where((F.col("t") > 0) & (F.col("t") < F.col("hi")))
    points = durable(inside.groupBy(*keys, "t").agg(F.bool_or("hard").alias("hard")), "window-cuts")
    cut_keys = points.select(*keys).distinct()
    hard = points.where("hard").select(*keys, "t").unionByName(cut_keys.withColumn("t", F.lit(0).cast("long")))
    order = Window.partitionBy(*keys).orderBy("t")
    pieces = hard.join(spans.select(*keys, "hi"), keys).select(*keys, F.col("t").alias("lo"), F.coalesce(F.lead("t").over(order), "hi").alias("up"))
    soft = points.where("NOT hard").select(*keys, "t")
    placed = soft.unionByName(pieces.select(*keys, F.col("lo").alias("t"), F.col("lo").alias("piece")), allowMissingColumns=True)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    of_piece = placed.withColumn("lo", F.last("piece", True).over(upto)).where("piece IS NULL").groupBy(*keys, "lo").agg(F.array_sort(F.collect_list("t")).alias("cuts"))
    joined = pieces.join(of_piece, [*keys, "lo"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<bigint>")))
    whole = F.array(F.struct(F.col("lo").alias("s"), F.col("up").alias("e")))
    parts = joined.select(*keys, F.explode(F.when(F.col("up") - F.col("lo") <= target, whole).otherwise(_split_long(F.col("lo"), F.col("up"), F.col("cuts"), target, least))).alias("w"))
    lists = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("w")).alias("w")).select(*keys, _absorb_short(F.col("w"), least).alias("w"))

    @F.pandas_udf("array<int>")
    def staying(windows: pd.Series) -> pd.Series:
        return windows.map(lambda w: cheapest_merges([x["s"] for x in w], w[-1]["e"], most))

    starts = lists.withColumn("_k", F.when(F.size("w") > most, staying("w")).otherwise(F.sequence(F.lit(0), F.size("w") - 1)))
    bounds = F.transform("_k", lambda i, n: F.struct(F.get("w", i)["s"].alias("s"), F.coalesce(F.get("w", F.get("_k", n + 1))["s"], F.element_at("w", -1)["e"]).alias("e")))
    made = starts.select(*keys, F.posexplode(bounds).alias("idx", "x")).select(*keys, F.col("idx").cast("long").alias("idx"), "x.s", "x.e")
    ends = made.select(*keys, "idx", F.explode(F.array("s", "e")).alias("t")).join(points, [*keys, "t"]).groupBy(*keys, "idx").agg(F.bool_or("hard").alias("hard"), F.bool_or(~F.col("hard")).alias("soft"))
    no = F.lit(False)
    aligned = made.join(ends, [*keys, "idx"], "left").withColumns({"hard": F.coalesce("hard", no), "soft": F.coalesce("soft", no)})
    even = equal_windows(spans.join(cut_keys, keys, "left_anti"), target, most).select(*keys, "idx", "s", "e", no.alias("hard"), no.alias("soft"))
    return aligned.unionByName(even)


def text_key(text: Column) -> Column:
    """A text for comparison: full-width ASCII folded, letters and digits only, lower case."""
    wide = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
    folded = F.translate(text, wide, "".join(map(chr, range(0x21, 0x7F))))
    return F.lower(F.regexp_replace(folded, r"[^\p{L}\p{N}]", ""))


def _related(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(norm, other) of one recording where one text holds the other. A shorter text asks by its rarest bigram there, a longer one offers all of its own, so
    only texts that share a rare bigram meet."""
    grams = lambda c: F.when(F.length(c) < 2, F.array(c)).otherwise(F.array_distinct(F.flatten(F.array(F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2))), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(1)))))))
    offered = texts.select(*keys, F.col("norm").alias("long"), F.explode(grams(F.col("norm"))).alias("gram"))
    counts = offered.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("n"))
    wanted = offered.where((F.length("gram") == 2) | (F.length("long") == 1)).join(counts, [*keys, "gram"])
    asked = wanted.groupBy(*keys, F.col("long").alias("short")).agg(F.min(F.struct("n", "gram")).alias("g")).select(*keys, "short", F.col("g.gram").alias("gram"))
    pairs = asked.join(offered, [*keys, "gram"]).where((F.col("short") != F.col("long")) & F.contains("long", "short")).select(*keys, "short", "long")
    return pairs.select(*keys, F.col("short").alias("norm"), F.col("long").alias("other")).unionByName(pairs.select(*keys, F.col("long").alias("norm"), F.col("short").alias("other")))


RECORDINGS = 64  # that a task has as Python objects at a time


def _merge(seen: list[dict] | None, heard: list[dict] | None) -> list[tuple]:
    """The entries (text, s, e, n_marks, n_speech) of one recording."""
    out = [[x["text"], x["s"], x["e"], x["n"], 0] for x in seen or ()]
    place = {x["norm"]: i for i, x in enumerate(seen or ())}
    for x in heard or ():
        at = place.get(x["norm"])
        if at is None:
            near = sorted(place[k] for k in x["others"] if k in place)
            at = next((i for i in near if min(out[i][2], x["e"]) > max(out[i][1], x["s"])), None)
        if at is None:
            place[x["norm"]] = len(out)
            out.append([x["text"], x["s"], x["e"], 0, 1])
        else:
            old = out[at]
            old[1], old[2], old[4] = min(old[1], x["s"]), max(old[2], x["e"]), old[4] + 1
    return out


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Recordings (keys, seen, heard) -> keys, entry and its columns, RECORDINGS at a time, so that what Python holds does not grow with a batch."""
    kinds = (pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4)
    for batch in batches:
        for lo in range(0, batch.num_rows, RECORDINGS):
            part = batch.slice(lo, RECORDINGS)
            lists = zip(part.column("seen").to_pylist(), part.column("heard").to_pylist(), strict=True)
            rows = [(r, i, *x) for r, (seen, heard) in enumerate(lists) for i, x in enumerate(_merge(seen, heard))]
            of, *columns = (pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * 7, kinds, strict=True))
            own = part.drop_columns(["seen", "heard"])
            yield pa.RecordBatch.from_arrays([*(c.take(of) for c in own.columns), *columns], [*own.schema.names, "entry", "text", "s", "e", "n_marks", "n_speech"])


def merge_signals(marks: DataFrame, speech: DataFrame, keys: list[str]) -> DataFrame:
    """Texts seen (``marks``) and heard (``speech``), each id, text, s, e, as one list a recording in which every text stands once.

    Marks of one key (``text_key``) are one entry: the hull of their intervals, their number, the first text. Speech in order of id joins the entry of its key,
    or else the first entry whose key holds its own or is held by it and whose interval, as it has grown, overlaps; or else it opens an entry. Texts without letters or digits are left out.

    Only related texts can meet: which ones are is found by a join on rare bigrams, not between all pairs, and the fold then runs over the recording's
    speech with the related keys of each. A recording's texts are bounded by its length. Returns keys, entry (from 0), text, s, e, n_marks, n_speech.
    """
    seen = marks.withColumn("norm", text_key(F.col("text"))).where("norm <> ''")
    entries = seen.groupBy(*keys, "norm").agg(F.min(F.struct("id", "text")).alias("f"), F.min("s").alias("s"), F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))
    heard = durable(speech.withColumn("norm", text_key(F.col("text"))).where("norm <> ''").select(*keys, "id", "text", "s", "e", "norm"), "signals-heard")
    entries = durable(entries, "signals-seen")
    texts = entries.select(*keys, "norm").unionByName(heard.select(*keys, "norm")).distinct()
    related = _related(texts, keys).join(heard.select(*keys, "norm").distinct(), [*keys, "norm"], "left_semi").groupBy(*keys, "norm").agg(F.collect_list("other").alias("others"))
    asked = heard.join(related, [*keys, "norm"], "left")
    known = entries.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("f.id", "norm", "f.text", "s", "e", "n"))).alias("seen"))
    lines = asked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("id", "norm", "text", "s", "e", F.coalesce("others", F.array().cast("array<string>")).alias("others")))).alias("heard"))

    whole = known.join(lines, keys, "full").select(*keys, "seen", "heard")
    kinds = ", ".join(f"`{k}` {whole.schema[k].dataType.simpleString()}" for k in keys)
    return whole.mapInArrow(_merged, f"{kinds}, entry long, text string, s long, e long, n_marks long, n_speech long")


def unique_claims(claims: DataFrame, keys: list[str], num: int = 1, den: int = 2) -> DataFrame:
    """Claims (id, s, e, goals, relation) that say something new, in order of id (2.8).

    A claim goes if an earlier kept one of its relation has all its goals and its time: its centre lies in that interval, or their common part exceeds ``num`` / ``den`` of
    their hull. One claim at a time with another goal stays. Only claims of a relation that touch compete, so each island of touching intervals folds alone; a null relation is "uncertain".
    """
    rows = claims.withColumns({"relation": F.coalesce("relation", F.lit("uncertain")), "goals": F.coalesce("goals", F.array().cast(claims.schema["goals"].dataType))})
    runs = islands(rows, [*keys, "relation"], out="_run")
    kind = runs.select(F.struct("id", "s", "e", "goals").alias("x")).schema["x"].dataType.simpleString()

    def hit(x: Column, y: Column) -> Column:
        common = F.greatest(F.lit(0), F.least(x["e"], y["e"]) - F.greatest(x["s"], y["s"]))
        centre = x["s"] + x["e"]
        return ((centre >= 2 * y["s"]) & (centre <= 2 * y["e"])) | (common * den > (F.greatest(x["e"], y["e"]) - F.least(x["s"], y["s"])) * num)

    told = lambda acc, x: F.exists(acc, lambda y: hit(x, y) & (F.size(F.array_except(x["goals"], y["goals"])) == 0))
    kept = F.aggregate(F.array_sort(F.collect_list(F.struct("id", "s", "e", "goals"))), F.array().cast(f"array<{kind}>"), lambda acc, x: F.when(told(acc, x), acc).otherwise(F.concat(acc, F.array(x))))
    return runs.groupBy(*keys, "relation", "_run").agg(kept.alias("k")).select(*keys, "relation", F.explode("k").alias("k")).select(*keys, "relation", "k.*")
