"""Operators on hand-made rows, with slow models of the greedy folds."""

import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomline.functions import text as tx
from loomline.functions import wording
from loomline.operators import evaluation, evidence, folds, intervals, lineage, ranking, retrieval, rules, series, tables
from loomline.plans import evaluation as plans


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def ivl(spark, data):
    return spark.createDataFrame(data, "key string, id long, s long, e long")


def random_intervals(n, seed, span=2000, most=120):
    r = random.Random(seed)
    return [(r.choice("ab"), i, s, s + r.randint(0, most)) for i, s in enumerate(r.randint(0, span) for _ in range(n))]


def test_merge_records_orders_lists_and_fills_fields(spark):
    data = [(1, 1001, 3, 100, None, "t"), (1, 1005, 1, None, 7, None), (1, 1002, 8, 5, None, "u"), (2, 1001, 1, 10, None, "x"), (3, 1003, 15, 1, None, "y"), (3, 1004, 15, 1, None, "y")]
    made = spark.createDataFrame(data, "item_id long, list_id long, rank long, likes long, views long, title string").withColumn("author", F.lit(None).cast("string"))
    got = {r.item_id: r for r in ranking.merge_records(made).collect()}
    assert got[1].lists == [1001, 1002, 1005] and got[1].ranks == {1001: 3, 1002: 8, 1005: 1}
    assert (got[1].likes, got[1].views, got[1].title) == (100, 7, "t")
    top = [r.item_id for r in ranking.top_records(ranking.merge_records(made)).orderBy("final_rank").collect()]
    assert top == [1, 3, 2]


@pytest.mark.parametrize("seed", range(3))
def test_overlap_join_equals_all_pairs(spark, seed):
    a = random_intervals(60, seed) + [("a", 900, 0, 50_000)]
    b = random_intervals(60, seed + 10) + [("a", 901, 10, 60_000), ("b", 902, 5, 5)]
    right = ivl(spark, b).toDF("key", "id2", "s2", "e2")
    got = sorted((r.id, r.id2) for r in intervals.overlap_join(ivl(spark, a), right, ["key"], 40).collect())
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and min(x[3], y[3]) > max(x[2], y[2]))
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_union_and_gaps_fill_the_range(spark, seed):
    df = ivl(spark, random_intervals(40, seed))
    union = intervals.merge_within(intervals.clip(df, 0, 2000), ["key"])
    left = intervals.gaps(union, ["key"], 0, 2000)
    covered = {r.key: r.n for r in union.groupBy("key").agg(F.sum(F.col("e") - F.col("s")).alias("n")).collect()}
    missing = {r.key: r.n for r in left.groupBy("key").agg(F.sum(F.col("e") - F.col("s")).alias("n")).collect()}
    assert all(covered[k] + missing.get(k, 0) == 2000 for k in covered)
    again = intervals.merge_within(union.select("key", F.col("s").alias("id"), "s", "e"), ["key"])
    assert rows(again.select("key", "s", "e")) == rows(union.select("key", "s", "e"))


def test_iou_and_share(spark):
    df = spark.createDataFrame([(0, 10, 5, 15), (0, 10, 20, 30), (10, 10, 11, 11)], "a long, b long, c long, d long")
    c = [F.col(x) for x in "abcd"]
    got = df.select(intervals.hull_iou(*c, tolerance=1), intervals.overlap_share(*c), intervals.is_hit(*c)).collect()
    assert [tuple(r) for r in got] == [(1 / 3, 0.5, True), (0.0, 0.0, False), (1.0, 0.0, False)]


@pytest.mark.parametrize("seed", range(2))
def test_folds_equal_slow_models(spark, seed):
    data = random_intervals(120, seed)
    df = ivl(spark, data)
    spaced, kept, groups, bursts = [], [], [], []
    for key in "ab":
        mine = [x for x in data if x[0] == key]
        last = None
        for x in sorted(mine, key=lambda x: (x[2], x[1])):
            if last is None or x[2] - last >= 30:
                spaced.append(x[1])
                last = x[2]
        chosen = []
        for x in sorted(mine, key=lambda x: (-(x[3] - x[2]), x[2], x[1])):
            if not any((min(x[3], y[3]) - max(x[2], y[2])) * 5 > min(x[3] - x[2], y[3] - y[2]) for y in chosen):
                chosen.append(x)
        kept += [x[1] for x in chosen]
        g = []
        for x in sorted(mine, key=lambda x: (x[2], x[3], x[1])):
            if g and x[2] < g[-1][1] + 20 and max(g[-1][1], x[3]) - g[-1][0] <= 150:
                g[-1] = [g[-1][0], max(g[-1][1], x[3]), g[-1][2] + 1]
            else:
                g.append([x[2], x[3], 1])
        groups += [(key, *x) for x in g]
        b = []
        for t in sorted(x[2] for x in mine):
            if b and t - b[-1][0] <= 25:
                b[-1][1:] = [t, b[-1][2] + 1]
            else:
                b.append([t, t, 1])
        bursts += [(key, *x) for x in b]
    points = df.select("key", "id", F.col("s").alias("t"))
    assert sorted(r.id for r in folds.min_spacing(points, ["key"], 30).collect()) == sorted(spaced)
    scored = df.withColumn("score", (F.col("e") - F.col("s")).cast("double"))
    assert sorted(r.id for r in folds.suppress_overlaps(scored, ["key"], 1, 5).collect()) == sorted(kept)
    assert rows(folds.capped_merge(df, ["key"], 20, 150)) == sorted(groups, key=repr)
    assert rows(folds.anchored_groups(points, ["key"], 25)) == sorted(bursts, key=repr)


def test_windows_tail(spark):
    spans = spark.createDataFrame([(1, 0, 14)], "id long, lo long, hi long")
    assert rows(intervals.overlapping_windows(spans, 6, 1).select("s", "e")) == [(0, 6), (10, 14), (5, 11)]
    assert rows(intervals.overlapping_windows(spans, 6, 1, "shift").select("s", "e")) == [(0, 6), (5, 11), (8, 14)]


def test_nearest_takes_the_earlier_on_ties(spark):
    points = spark.createDataFrame([("k", 1, 10), ("k", 2, 0), ("z", 3, 5)], "key string, id long, t long")
    frames = spark.createDataFrame([("k", 8), ("k", 12), ("k", 3)], "key string, t2 long")
    assert rows(intervals.nearest(points, frames, ["key"]).select("id", "nearest")) == [(1, 8), (2, 3), (3, None)]


def test_robust_normalise_of_constant_and_outlier(spark):
    df = spark.createDataFrame([("c", 2.0)] * 3 + [("o", x) for x in (0.0, 1.0, 2.0, 100.0)], "key string, v double")
    got = [r.x for r in series.robust_normalise(df, ["key"], "v", "x").where("key = 'c'").collect()]
    assert got == [0.0] * 3
    out = [r.x for r in series.robust_normalise(df, ["key"], "v", "x").where("key = 'o'").orderBy("v").collect()]
    assert out[0] == 0.0 and out[-1] == 1.0 and all(0 <= x <= 1 for x in out)


def test_text_runs_compare_with_the_last_only(spark):
    df = spark.createDataFrame([("v", t, 0, x) for t, x in enumerate(["A", "a", "b", "a"])], "k string, t long, line long, x string")
    got = evidence.merge_text_runs(df, ["k"], F.lower("x")).orderBy("first_t").collect()
    assert [(r.text_key, r.occurrences) for r in got] == [("a", 2), ("b", 1), ("a", 1)]


def test_best_path_prefers_continuity(spark):
    states = spark.createDataFrame([(0, 0, 1, 5), (0, 0, 2, 4), (0, 1, 3, 1), (0, 1, 4, 3)], "plan long, slot int, id long, score long")
    steps = spark.createDataFrame([(0, 1, a, b, 10 if (a, b) == (2, 3) else 0) for a in (1, 2) for b in (3, 4)], "plan long, slot int, from_id long, id long, bonus long")
    r = retrieval.best_path(states, steps, 2).first()
    assert (r.total, r.path) == (15, [2, 3])


def test_closure_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("d", "a")], "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert rows(lineage.closure(edges, seeds).select("node", "steps")) == [("a", 0), ("b", 1), ("c", 2)]
    assert rows(lineage.on_cycle(edges)) == [("b",), ("c",)]


def test_closure_of_a_long_chain(spark):
    edges = spark.range(0, 120).selectExpr("id AS src", "id + 1 AS dst").unionByName(spark.createDataFrame([(7, 3), (500, 501)], "src long, dst long"))
    seeds = spark.createDataFrame([(0,), (118,)], "node long")
    got = {(r.seed, r.node): r.steps for r in lineage.closure(edges, seeds).collect()}
    assert got == {(0, i): i for i in range(121)} | {(118, 118): 0, (118, 119): 1, (118, 120): 2}


def test_cycles_with_a_bridge(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 6), (6, 4), (6, 7), (9, 9), (8, 1)], "src long, dst long")
    assert rows(lineage.on_cycle(edges)) == [(1,), (2,), (4,), (5,), (6,), (9,)]
    assert rows(lineage.on_cycle(edges.where("dst = src + 1"))) == []


def test_cycles_of_a_long_ring(spark):
    """A ring of a thousand nodes, a chain of five hundred that leads into it, and a chain between two nodes of another ring."""
    edges = [(i, (i + 1) % 1000) for i in range(1000)] + [(2000 + i, 2001 + i) for i in range(500)] + [(2500, 7)]
    edges += [(5000, 5001), (5001, 5000)] + [(5001, 6000)] + [(6000 + i, 6001 + i) for i in range(40)] + [(6040, 5000)]
    got = {r.node for r in lineage.on_cycle(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {*range(1000), 5000, 5001, *range(6000, 6041)}


def test_cycles_equal_reachability(spark):
    r = random.Random(17)
    for n, m in ((12, 14), (30, 33), (25, 60)):
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(m)]
        reach = {i: {b for a, b in edges if a == i} for i in range(n)}
        for _ in range(n):
            reach = {i: x | {c for b in x for c in reach[b]} for i, x in reach.items()}
        got = {x.node for x in lineage.on_cycle(spark.createDataFrame(edges, "src long, dst long")).collect()}
        assert got == {i for i in range(n) if i in reach[i]}


def test_conflict_counts_equal_pairs(spark):
    r = random.Random(3)
    data = [(r.randint(0, 4), i, r.choice("xyz"), r.random() < 0.9) for i in range(60)]
    claims = spark.createDataFrame(data, "k int, id long, polarity string, active boolean")
    want = {}
    for k, i, p, on in data:
        want.setdefault(k, []).extend((i, j) for k2, j, p2, on2 in data if on and on2 and k == k2 and p != p2 and i < j)
    assert rows(lineage.conflict_counts(claims, ["k"])) == sorted((k, len(v), min(i for i, _ in v)) for k, v in want.items() if v)


def test_hot_keys_give_the_same_results(spark, monkeypatch):
    """Keys cut into ranges, as for a key of very many rows, and keys of one window each."""
    df = ivl(spark, [*random_intervals(300, 5), (None, 900, 3, 8), (None, 901, 5, 9), ("c", 902, 1, 1)]).repartition(5)
    points = df.select("key", "id", F.col("s").alias("t"))
    frames = df.where("id % 7 = 0").select("key", F.col("e").alias("t2"))

    def all_of():
        union = intervals.merge_within(df, ["key"], 3)
        return [
            rows(intervals.islands(df, ["key"], 5, strict=True)), rows(union), rows(intervals.gaps(union, ["key"], 0, 3000)), rows(intervals.nearest(points, frames, ["key"])),
            rows(folds.min_spacing(points, ["key"], 40)), rows(folds.anchored_groups(points, ["key"], 30)), rows(folds.suppress_overlaps(df.withColumn("score", F.col("id").cast("double")), ["key"], 1, 5)),
        ]

    plain = all_of()
    monkeypatch.setattr(tables, "HOT", 0)
    assert all_of() == plain


def test_numbering_without_one_task(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(101)], "v long, id long").repartition(6)
    got = tables.numbered(df, [F.col("v").desc()]).collect()
    assert sorted((r.v, r.pos) for r in got) == [(v, 100 - v) for v in range(101)]


def test_bootstrap_takes_every_row(spark):
    """More rows than a reviewed sample has, in two strata; draws follow md5, so a slow model gives the same bounds. The query's SQL draws no sample."""
    big = spark.range(0, 100_001).selectExpr("id", "id % 2 AS stratum", "1.0D AS weight", "id % 4 AS num", "3 AS den")
    assert evaluation.bootstrap_interval(big, 2).first().estimate == pytest.approx(149_999 / 300_003, abs=1e-5)
    data = [(i, i % 3 // 2, 1.0 + i % 3 // 2, i % 5 // 2, 2) for i in range(60)]
    ratios = []
    for b in range(40):
        n = d = 0
        for stratum in (0, 1):
            mine = [x for x in data if x[1] == stratum]
            drawn = [mine[int(hashlib.md5(f"{b}/{stratum}/{j}".encode()).hexdigest()[:8], 16) % len(mine)] for j in range(len(mine))]
            n, d = n + sum(x[2] * x[3] for x in drawn), d + sum(x[2] * x[4] for x in drawn)
        ratios.append(n / d)
    for near in (evaluation.NEAR, 10):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(evaluation, "NEAR", near)
            got = evaluation.bootstrap_interval(spark.createDataFrame(data, "id long, stratum int, weight double, num int, den int"), 40).first()
        assert got.low <= sorted(ratios)[0] and got.high >= sorted(ratios)[39]
        assert got.estimate == pytest.approx(sum(x[2] * x[3] for x in data) / sum(x[2] * x[4] for x in data))
    assert "draw <=" not in plans.ORACLE_SQL["bootstrap_ci"]


def test_scores_of_a_batch_stand_for_bounded_blocks():
    """A batch of twenty thousand rows never has all its scores in memory; ties across blocks, thresholds and missing numbers keep their order."""
    r = np.random.default_rng(4)
    n, dim, asked = 20_000, 8, 200
    vectors = np.round(r.normal(size=(n, dim)), 1)
    vectors[7::500] = vectors[7]
    vectors[19_990, 0] = np.nan
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)[::-1].copy()), pa.array(list(vectors.tolist())), pa.array(np.arange(n) % 3)], ["id", "embedding", "tag"])
    queries = np.vstack([vectors[7:8], vectors[:asked - 1]])
    value = type("B", (), {"value": (np.arange(asked), queries, {"wanted": np.arange(asked) % 3})})
    bonus = lambda row, query: 0.5 * (row["tag"] == query["wanted"])
    for k, least in ((5, None), (3, 6.0)):
        tracemalloc.start()
        (out,) = retrieval._block_scores(value, k, bonus, least, 4)(iter([batch, batch.slice(0, 0)]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < n * asked * 8
        got = list(zip(*(c.to_pylist() for c in out.columns)))
        score = np.round(queries @ vectors.T + bonus({"tag": np.arange(n) % 3}, {"wanted": (np.arange(asked) % 3)[:, None]}), 4)
        for q in (0, 1, 8, 150):
            best = sorted((-s, n - 1 - i) for i, s in enumerate(score[q].tolist()) if not np.isnan(s) and (least is None or s >= least))[:k]
            assert [(i, s) for qq, i, s in got if qq == q] == [(i, -s) for s, i in best]


def test_cosine_top_k_equals_all_pairs(spark):
    r = random.Random(8)
    vectors = [(i, [r.uniform(-1, 1) for _ in range(6)], i % 3) for i in range(90)]
    df = spark.createDataFrame(vectors, "id long, embedding array<float>, tag long").repartition(4)
    queries = df.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("embedding").alias("query"), F.col("tag").alias("wanted"))
    bonus = lambda row, query: 0.1 * (row["tag"] == query["wanted"])
    held = {x.id: (x.embedding, x.tag) for x in df.collect()}
    want = []
    for q in range(0, 90, 20):
        best = sorted((-(sum(a * b for a, b in zip(held[q][0], v, strict=True)) + 0.1 * (t == held[q][1])), i) for i, (v, t) in held.items())[:4]
        want += [(q, n + 1, i) for n, (_, i) in enumerate(best)]
    for block in (2, 100):
        assert rows(retrieval.cosine_top_k(df, queries, 4, block, bonus=bonus).select("qid", "rank", "id")) == sorted(want, key=repr)
    assert retrieval.cosine_top_k(df, queries.limit(0), 4).count() == 0 and retrieval.cosine_top_k(df.limit(0), queries, 4).count() == 0


def test_rules_on_edges(spark):
    """Missing values, empty sides and ties of the rule operators."""
    claims, refs = spark.createDataFrame([(1,), (2,)], "claim long"), spark.createDataFrame([("a", 1), ("b", 3), ("b", 1)], "event string, claim long")
    assert rows(rules.publish(claims, refs, F.col("claim") < 5)) == [("a", 0, True), ("b", 1, False)]
    patches = spark.createDataFrame([("k", 1, "s", 20), ("k", 2, "e", 10), ("k", 3, "e", None), ("k", 4, "e", 30)], "key string, n long, field string, value long")
    assert rows(rules.apply_patches(patches, ["key"], ["n"], 0, 100)) == [("k", 20, 30, 2, 2)]
    rows_of = spark.createDataFrame([("a", None, None), ("b", 3, 90), ("c", 0, 100), ("d", 0, 100)], "k string, s long, e long").withColumn("d", F.when(F.col("k") == "d", 0).otherwise(100))
    assert rows(rows_of.select("k", wording.temporal_coverage(F.col("s"), F.col("e"), F.col("d")))) == [("a", False), ("b", True), ("c", True), ("d", True)]
    words = spark.createDataFrame([("Running dogs wander",)], "t string")
    assert words.select(wording.stems(F.col("t"), ("wander",))).first()[0] == ["runn"]
    han = spark.createDataFrame([("雨中 奔跑的人 a镜", "他在雨中，奔跑的人 镜")], "t string, r string")
    assert han.select(wording.leaks(F.col("t"), F.col("r"))).first()[0] == ["奔跑的人"]
    assert words.select(wording.is_junk(F.lit(None).cast("string")), wording.in_library(F.lit("a__x"), "b, a"), wording.in_library(F.lit("ab"), "a")).first()[:] == (False, True, False)


def test_wilson_and_gate(spark):
    df = spark.createDataFrame([(1.0, 8), (1.0, 120), (20 / 120, 120), (0.0, 0)], "p double, n long")
    low, high = evaluation.wilson(F.col("p"), F.col("n"))
    got = [r[0] for r in df.select(evaluation.three_state(low, high, 0.9, F.lit(0))).collect()]
    assert got == ["INSUFFICIENT_EVIDENCE", "PASS", "FAIL", "INSUFFICIENT_EVIDENCE"]


def test_text_functions(spark):
    df = spark.createDataFrame([("  A-b c ",), ("unknown",), (None,), ("",)], "x string")
    got = df.select(tx.snake_case(F.col("x")), tx.usable(F.col("x")), tx.is_concrete(F.col("x"))).collect()
    assert [tuple(r) for r in got] == [("a_b_c", "A-b c", True), ("variant", None, False), ("variant", None, False), ("variant", None, False)] or got[1][0] == "unknown"
    one = spark.range(1).select(tx.fnv1a(F.lit("a")), tx.fnv1a(F.lit("")), tx.fraction(F.lit("30000/1001")), tx.time_code(F.lit(3661.5))).first()
    assert one[0] == 0xE40C292C and one[1] == 0x811C9DC5 and abs(one[2] - 29.97) < 0.01 and one[3] == "01:01:01,500"


def test_empty_tables(spark):
    none = ivl(spark, [])
    assert intervals.merge_within(none, ["key"]).count() == 0
    assert folds.capped_merge(none, ["key"], 1, 2).count() == 0
    assert intervals.overlap_join(none, none.toDF("key", "id2", "s2", "e2"), ["key"], 10).count() == 0
