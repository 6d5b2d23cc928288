"""Vector retrieval: cosine scores of a bounded query set against all rows, and picks from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators.tables import durable, numbered

QUERY_BLOCK = 1024  # queries broadcast at a time; a block's size is bounded by this and the dimension
ROW_BLOCK = 512  # rows scored at a time in a task


def _padded(matrix: np.ndarray, n: int) -> np.ndarray:
    """``matrix`` with rows of zeros up to ``n``, so that equal vectors give equal products wherever they stand."""
    return np.concatenate([matrix, np.zeros((n - len(matrix), matrix.shape[1]))]) if len(matrix) < n else matrix


def _best(qs: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best triples of each query, best first, ties to the smaller id."""
    order = np.lexsort((ids, -scores, qs))
    qs, ids, scores = qs[order], ids[order], scores[order]
    first = np.searchsorted(qs, qs)
    keep = np.arange(len(qs)) - first < k
    return qs[keep], ids[keep], scores[keep]


def _block_scores(queries: Broadcast, k: int, bonus: Callable | None, least: float | None, digits: int | None):
    """Rows (id, embedding, tags...) -> each task's ``k`` best (qid, id, score) of every query of the block.

    Scores stand for ``ROW_BLOCK`` rows at a time, however large a batch is; of those only the ones that reach a query's k-th best are sorted.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix, wanted = queries.value
        n, dim = matrix.shape
        matrix = _padded(matrix, -(-n // 64) * 64)
        wanted = {name: c[:, None] for name, c in wanted.items()}
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        bar = np.full(n, -np.inf)  # the k-th best score of each query, once there are k
        for batch in (b.slice(i, ROW_BLOCK) for b in batches for i in range(0, b.num_rows, ROW_BLOCK)):
            rows = batch.num_rows
            flat = _padded(batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim), ROW_BLOCK)
            score = (matrix @ flat.T)[:n, :rows]
            if bonus is not None:
                score = score + bonus({name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names[2:]}, wanted)
            if digits is not None:
                score = np.round(score, digits)
            score = np.where(np.isnan(score), -np.inf, score)
            reach = np.maximum(bar, np.partition(score, rows - k, axis=1)[:, rows - k]) if rows > k else bar
            if least is not None:
                reach = np.maximum(reach, least)
            q, r = np.nonzero(score >= reach[:, None])
            found = q, batch.column(0).to_numpy()[r], score[q, r]
            best = _best(*(np.concatenate(pair) for pair in zip(best, found, strict=True)), k)
            full = np.flatnonzero(np.bincount(best[0], minlength=n) == k)
            bar[full] = best[2][np.searchsorted(best[0], full, "right") - 1]
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[0]]), pa.array(best[1]), pa.array(best[2])], ["qid", "id", "score"])

    return run


def cosine_top_k(rows: DataFrame, queries: DataFrame, k: int, query_block: int = QUERY_BLOCK, bonus: Callable | None = None, least: float | None = None, digits: int | None = None) -> DataFrame:
    """The ``k`` best rows (id, embedding, tags...) for each query (qid, query, tags...), by inner product of unit vectors, ties to the smaller id.

    Queries are a stated set, and every row is scored for every query: a block of ``query_block`` queries is one broadcast matrix,
    each pass reads the rows once, and a task sends on k rows a query, so the passes grow with the queries only. ``bonus`` (arrays of row tags and
    columns of query tags -> matrix) is added before the choice, and scores are rounded to ``digits`` then; scores below ``least`` are dropped. Rows with null vectors must be left out.
    """
    spark = rows.sparkSession
    placed = durable(numbered(queries, [F.col("qid")]).withColumn("_block", F.floor(F.col("pos") / query_block)), "queries")
    schema, out = "qid long, id long, score double", None
    for r in placed.groupBy("_block").count().orderBy("_block").collect():
        part = placed.where(F.col("_block") == r["_block"]).orderBy("pos").toArrow()
        tags = {n: part[n].to_numpy() for n in queries.columns[2:]}
        block = part["qid"].to_numpy(), np.array(part["query"].to_pylist(), np.float64), tags
        scored = rows.mapInArrow(_block_scores(spark.sparkContext.broadcast(block), k, bonus, least, digits), schema)
        out = scored if out is None else out.unionByName(scored)
    if out is None:
        out = spark.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    return out.withColumn("rank", place.cast("long")).where(F.col("rank") <= k)


def action_fit(action: np.ndarray, wanted: np.ndarray | float) -> np.ndarray:
    """A bonus for an action level near the one wanted."""
    return 0.08 * (1 - np.abs(action - wanted))


def role_bonus(role: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """.05 for the same role, .02 for a neighbouring one."""
    return np.where(role == wanted, 0.05, np.where(np.abs(role - wanted) == 1, 0.02, 0.0))


def speech_bonus(lines: np.ndarray, length: np.ndarray, budget: float) -> np.ndarray:
    """.02 for each line of speech up to .08, and up to .08 for filling the budget."""
    return np.minimum(0.08, 0.02 * lines) + 0.08 * np.minimum(1.0, length / budget)


def pick_without_reuse(candidates: DataFrame, n_queries: int) -> DataFrame:
    """For each query of a plan in order, its best candidate that no earlier query of the plan took.

    ``candidates``: (plan, qid 0.., rank, id), the top k of each query with k at least the number
    of queries, so a free one always remains and the fold sees a bounded list.
    """
    rows = F.array_sort(F.collect_list(F.struct("qid", "rank", "id")))
    start = F.array().cast("array<struct<qid:bigint,id:bigint>>")

    def step(acc, x):
        taken = F.exists(acc, lambda y: (y["id"] == x["id"]) | (y["qid"] == x["qid"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(F.struct(x["qid"].alias("qid"), x["id"].alias("id")))))

    return candidates.groupBy("plan").agg(F.aggregate(rows, start, step).alias("p")).select("plan", F.explode("p").alias("p")).select("plan", "p.qid", "p.id")


def _picks(candidates: DataFrame, segments: DataFrame, row: list[str], state: str, choose: Callable[[Column, Column], Column], keep: Callable[[Column, Column], Column]) -> DataFrame:
    """A fold over the segments of each plan: ``choose(used, segment)`` gives a struct (id, reason), ``keep(used, id)`` what is used from then on. A plan is a short list of segments, each with a bounded number of candidates."""
    lists = candidates.groupBy("plan", "seg").agg(F.array_sort(F.collect_list(F.struct("rank", *row))).alias("rows"))
    whole = segments.join(lists, ["plan", "seg"], "left").withColumn("rows", F.coalesce("rows", F.array().cast(lists.schema["rows"].dataType)))
    start = F.struct(F.array().cast(state).alias("used"), F.array().cast("array<struct<seg:bigint,id:bigint,reason:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        pick = choose(acc["used"], x)
        told = F.struct(x["seg"].cast("long").alias("seg"), pick["id"].alias("id"), pick["reason"].alias("reason"))
        return F.struct(F.when(pick["id"].isNull(), acc["used"]).otherwise(keep(acc["used"], pick["id"])).alias("used"), F.concat(acc["out"], F.array(told)).alias("out"))

    folded = whole.groupBy("plan").agg(F.aggregate(F.array_sort(F.collect_list(F.struct("seg", *(c for c in segments.columns if c not in ("plan", "seg")), "rows"))), start, step)["out"].alias("o"))
    return folded.select("plan", F.explode("o").alias("o")).select("plan", "o.*")


def _first(rows: Column, ok: Callable[[Column], Column]) -> Column:
    return F.get(F.filter(rows, ok), F.lit(0))


def _lately(n: int) -> Callable[[Column, Column], Column]:
    """The last ``n`` picks."""
    return lambda used, x: F.slice(F.concat(used, F.array(x)), F.greatest(F.lit(1), F.size(used) + 2 - n), n)


def retrieve_segments(candidates: DataFrame, segments: DataFrame, least: float = 0.18, window: int = 2, shortest: float = 0.4) -> DataFrame:
    """The shot of each segment of a plan (V2).

    ``segments``: plan, seg, need. ``candidates``: plan, seg, rank (by cosine), id, score (cosine with a bonus for a word in the caption), length; the four times k best by cosine. Those are
    tried by rank: a shot of the last ``window`` picks is passed over, one that scores below ``least`` ends the search, and the first of ``shortest`` and four fifths of the need or longer is taken. Else
    the best by cosine is taken as "too short", unless it scores below ``least`` or there is none: "insufficient". Returns plan, seg, id, reason.
    """

    def choose(used: Column, x: Column) -> Column:
        fresh = F.filter(x["rows"], lambda r: ~F.array_contains(used, r["id"]))
        stop = F.array_position(F.transform(fresh, lambda r: r["score"] < least), True)
        tried = F.when(stop > 0, F.slice(fresh, F.lit(1), F.greatest(stop - 1, F.lit(0)).cast("int"))).otherwise(fresh)
        good = _first(tried, lambda r: r["length"] >= F.greatest(x["need"] * 0.8, F.lit(shortest)))
        best = F.get(x["rows"], F.lit(0))
        poor = F.coalesce(best["score"] < least, F.lit(True))
        return F.struct(F.coalesce(good["id"], F.when(~poor, best["id"])).alias("id"), F.when(good.isNotNull(), "").when(poor, "insufficient").otherwise("too short").alias("reason"))

    return _picks(candidates, segments, ["id", "score", "length"], "array<bigint>", choose, _lately(window))


def fill_asset_slots(candidates: DataFrame, segments: DataFrame, least: float = 0.18, window: int = 2) -> DataFrame:
    """The asset of each slot of a plan (V3).

    ``segments``: plan, seg. ``candidates``: plan, seg, rank, id, score, fits (long enough): the ``window`` + 1 best that fit and the best of all decide. Taken is the best that fits, was not among the
    last ``window`` picks and scores ``least``; else the best of all as "relaxed", if it scores that; else none: "insufficient". Returns plan, seg, id, reason.
    """

    def choose(used: Column, x: Column) -> Column:
        good = _first(x["rows"], lambda r: r["fits"] & (r["score"] >= least) & ~F.array_contains(used, r["id"]))
        best = _first(x["rows"], lambda r: r["score"] >= least)
        return F.struct(F.coalesce(good["id"], best["id"]).alias("id"), F.when(good.isNotNull(), "").when(best.isNotNull(), "relaxed").otherwise("insufficient").alias("reason"))

    return _picks(candidates, segments, ["id", "score", "fits"], "array<bigint>", choose, _lately(window))


def pick_shots(candidates: DataFrame, segments: DataFrame, shortest: float) -> DataFrame:
    """A shot no earlier segment of the plan took for each segment (V4).

    ``segments``: plan, seg, need. ``candidates``: plan, seg, rank, id, length, junk; the best by cosine that are looked at. First one of ``shortest`` or the need is taken, else any as "relaxed"; junk
    captions never. A segment without one is "black". Returns plan, seg, id, reason.
    """

    def choose(used: Column, x: Column) -> Column:
        open_ = F.filter(x["rows"], lambda r: ~r["junk"] & ~F.array_contains(used, r["id"]))
        good = _first(open_, lambda r: r["length"] >= F.least(x["need"], F.lit(shortest)))
        other = F.get(open_, F.lit(0))
        return F.struct(F.coalesce(good["id"], other["id"]).alias("id"), F.when(good.isNotNull(), "").when(other.isNotNull(), "relaxed").otherwise("black").alias("reason"))

    return _picks(candidates, segments, ["id", "length", "junk"], "array<bigint>", choose, lambda used, x: F.concat(used, F.array(x)))


def best_path(states: DataFrame, steps: DataFrame, n_slots: int) -> DataFrame:
    """Max-sum path: one candidate a slot, candidate scores plus transition scores.

    ``states``: (plan, slot, id, score); ``steps``: (plan, slot, from_id, id, bonus) into ``slot``. Each slot
    joins the best paths so far with its candidates and keeps one path a candidate, so the work is
    slots x candidates^2 rows a plan. Ties go to the smaller path.
    """
    best = states.where("slot = 0").select("plan", F.col("id"), F.col("score").alias("total"), F.array("id").alias("path"))
    for slot in range(1, n_slots):
        here = states.where(F.col("slot") == slot).select("plan", F.col("id").alias("next"), "score")
        into = steps.where(F.col("slot") == slot).select("plan", F.col("from_id").alias("id"), F.col("id").alias("next"), "bonus")
        moved = best.join(into, ["plan", "id"]).join(here, ["plan", "next"])
        total = F.col("total") + F.col("score") + F.col("bonus")
        ranked = moved.select("plan", "next", total.alias("total"), F.concat("path", F.array("next")).alias("path"))
        best = ranked.groupBy("plan", "next").agg(F.min(F.struct((-F.col("total")).alias("k"), "path")).alias("b"))
        best = best.select("plan", F.col("next").alias("id"), (-F.col("b.k")).alias("total"), F.col("b.path").alias("path"))
    top = best.groupBy("plan").agg(F.min(F.struct((-F.col("total")).alias("k"), "path")).alias("b"))
    return top.select("plan", (-F.col("b.k")).alias("total"), F.col("b.path").alias("path"))
