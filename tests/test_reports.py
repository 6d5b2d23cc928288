"""Reports and validators on planted rows."""

import math
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from loomline.operators import lineage as li
from loomline.operators import reports as rp


def test_every_condition_of_the_content_gate_counts(spark):
    good = {"eligible": None, "category": "story", "events": 3, "has_goal": True, "has_resolution": True, "coverage": 0.8, "clarity": 0.7, "confidence": 0.65, "pure_sensory": False, "covered": True}
    bad = {"eligible": False, "category": "ad", "events": 2, "has_goal": None, "has_resolution": False, "coverage": 0.79, "clarity": 0.69, "confidence": None, "pure_sensory": None, "covered": False}
    rows = [good, *({**good, k: v} for k, v in bad.items())]
    kinds = "eligible boolean, category string, events long, has_goal boolean, has_resolution boolean, coverage double, clarity double, confidence double, pure_sensory boolean, covered boolean"
    df = spark.createDataFrame([(i, *r.values()) for i, r in enumerate(rows)], f"i long, {kinds}")
    got = df.select("i", rp.passes_content_gate({k: F.col(k) for k in good}, ("story",)).alias("ok")).collect()
    assert {r.i: r.ok for r in got} == {i: i == 0 for i in range(len(rows))}


@pytest.mark.parametrize(
    "a,b,meta,tier",
    [
        (("Alpha", 0.9, True), ("ALPHA!", 0.85, True), "", "model_prior"), (("Alpha", 0.5, True), ("Alpha", 0.5, True), "", "search"), (("Alpha", 0.2, True), ("Beta", 0.1, True), "", "unknown"),
        (("Alpha", 0.5, True), ("Beta", 0.2, True), "alpha.4K", "model_prior"), (("Alpha", 0.5, True), ("Beta", 0.5, True), "gamma", "identity_conflict"), (("Alpha", 0.5, True), ("Beta", 0.3, True), "gamma", "unknown"),
        ((None, None, False), ("", 0.0, False), "林间小路2 2019.4K", "metadata_prior"), ((None, None, None), (None, None, None), "road.2019", "unknown"), (("A", 0.75, True), ("B", 0.1, True), None, "search"),
    ],
)
def test_identity_tiers(spark, a, b, meta, tier):
    df = spark.createDataFrame([(*a, *b, meta)], "ta string, ca double, ra boolean, tb string, cb double, rb boolean, meta string")
    vote = lambda s: {"title": F.col(f"t{s}"), "confidence": F.col(f"c{s}"), "recognised": F.col(f"r{s}")}
    assert df.select(rp.identity_tier(vote("a"), vote("b"), F.col("meta"))).first()[0] == tier


def test_percentiles_by_five_rules(spark):
    r = random.Random(1)
    data = {k: sorted(r.choice([r.randint(0, 9), r.randint(0, 999)]) for _ in range(n)) for k, n in enumerate((1, 2, 3, 5, 10, 11, 40, 101))}
    df = spark.createDataFrame([(k, v) for k, l in data.items() for v in l] + [(99, None)], "k long, v long")
    for p in (50, 90):
        got = {x.k: x for x in rp.percentiles(df, ["k"], "v", p).collect()}
        assert set(got) == set(data)
        for k, l in data.items():
            n, at = len(l), (len(l) - 1) * p / 100
            lo = int(at)
            want = l[round(at)], l[min(n - 1, n * p // 100)], l[n // 2], l[lo] + (l[min(n - 1, lo + 1)] - l[lo]) * (at - lo), l[max(0, math.ceil(n * p / 100) - 1)]
            assert (got[k].even, got[k].floor, got[k].upper, pytest.approx(got[k].linear), got[k].ceil) == want


def test_grids_and_rotations(spark):
    a, b = [float(i) for i in range(24)], [float(i * i % 7) for i in range(24)]
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    whole, cells = rp.grid_difference(F.col("a"), F.col("b"), 6, 2, 3, 4)
    got = df.select(whole.alias("w"), cells.alias("c")).first()
    d = [abs(x - y) for x, y in zip(a, b, strict=True)]
    want = [sum(d[r * 6 + c] for r in range(4) for c in range(6) if (r // 2, c // 2) == (i, j)) / 4 for i in range(2) for j in range(3)]
    assert got.w == pytest.approx(sum(d) / 24) and got.c == pytest.approx(want)
    sides = spark.createDataFrame([([(None,), (-90,)],), ([(180,), (90,)],), ([],), (None,)], "s array<struct<rotation:int>>")
    assert [x[0] for x in sides.select(rp.rotation(F.col("s"))).collect()] == [270, 180, 0, 0]


def test_names_are_folded_as_unicode_has_it(spark):
    names = ["Ａｌｐｈａ－１", "ﬁlm ①", "Straße", "plain-Name 7", "ｶﾞﾝﾀﾞﾑ", "", None, "罗小黑１"]
    got = [x[0] for x in spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i long, n string").orderBy("i").select(rp.name_key(F.col("n"))).collect()]
    assert got == [None if n is None else "".join(c.lower() for c in unicodedata.normalize("NFKC", n) if c.isalnum()) for n in names]


def test_faults_of_a_story_plan(spark):
    slots = [(1, 0, "supported", "conflict", "v", 10, 20, 5, ["a"]), (1, 1, "uncertain", "choice", "v", 1, 2, 5, ["z"]), (1, 2, "supported", "climax", "v", 5, 9, 9, ["b"]), (2, 0, "supported", "resolution", "w", 0, 9, 9, [])]
    lines = [(1, 0, 9, 12), (1, 0, 12, 19), (2, 0, 0, 9)]
    got = rp.preflight_faults(
        spark.createDataFrame(slots, "p long, idx long, status string, role string, source string, s long, e long, target long, entities array<string>"), spark.createDataFrame(lines, "p long, idx long, line_s long, line_e long"), ["p"]
    )
    assert sorted(map(tuple, got.collect()), key=repr) == [(1, 0, "dialogue cut", 1), (1, 0, "subtitle timing", 1), (1, 2, "causal order", 1), (1, 2, "entity switch", 1), (1, None, "missing cause", 1), (1, None, "missing resolution", 1)]


def test_plans_that_break_no_rule_have_no_row(spark):
    kinds = "p long, slot long, role string, status string, s long, e long, source string, source_s long, source_e long, transition string"
    good = [(1, 0, "hook", "supported", 0, 10, "v", 0, 5, "cut"), (1, 1, "conflict", "uncertain", 10, 30, None, None, None, None), (1, 2, "conflict", "supported", 30, 40, "v", 1, 2, "cut")]
    bad = [(2, 0, "conflict", "supported", 0, 10, " ", 5, 5, "unexplained"), (2, 2, "hook", "gone", 12, 12, "v", 1, 2, "cut"), (2, 3, None, "supported", 12, 20, "v", 0, 1, "cut")]
    plans = spark.createDataFrame([(1, 40), (2, 25), (3, 500)], "p long, duration long")
    got = rp.plan_violations(plans, spark.createDataFrame(good + bad, kinds), "p", 20, 100, 0)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [(2, 0, "no source"), (2, 0, "source interval"), (2, 0, "unexplained"), (2, 2, "slot number"), (2, 2, "role order"), (2, 2, "not continuous"), (2, 2, "status"), (2, 3, "slot number"), (2, 3, "role"), (2, None, "no full cover"), (3, None, "duration"), (3, None, "no slots")], key=repr
    )


def test_templates_and_arms(spark):
    segments = spark.createDataFrame([(1, 1, 0, 10, "a"), (1, 2, 9, 20, "a"), (1, 3, 31, 30, "b"), (2, 4, 0, 700, "setup")], "k long, id long, s long, e long, role string")
    points = lambda *rows: spark.createDataFrame([*rows], "k long, id long, t long")
    got = rp.template_violations(spark.createDataFrame([(1, 500), (2, 700)], "k long, duration long"), segments, points((1, 1, 0), (2, 2, 0)), points((1, 7, 100), (2, 8, 5)), points((1, 9, 100)).withColumnRenamed("t", "t2"), "k", 100, ("a", "setup"))
    assert sorted(map(tuple, got.collect())) == [(1, "interval", 1), (1, "tail", 1), (2, "beat", 1), (2, "not divided", 1), (2, "one role", 1)]
    empty = spark.createDataFrame([], "key long, t long, s2 long, e2 long, goal long")
    arms = spark.createDataFrame([("A", 1, 1, 0, 10), ("A", 1, 2, 5, 12), ("B", 1, 3, 0, 4)], "arm string, key long, id long, s long, e long")
    pending = {r.arm: r for r in rp.browse_arms(arms, empty, ["key"], ["A", "B", "C"], 1, 10).collect()}
    assert pending["A"].duplicate_rate == 0.5 and pending["C"].candidates == 0 and pending["A"].diagnosis == "pending truth"
    truth = spark.createDataFrame([(1, 1, 11, 12, 0)], empty.schema)
    assert {r.arm: (r.recall, r.diagnosis) for r in rp.browse_arms(arms, truth, ["key"], ["A", "B", "C"], 1, 10).collect()} == {"A": (1.0, "mixed bottleneck"), "B": (0.0, "mixed bottleneck"), "C": (0.0, "mixed bottleneck")}


def test_recipes_with_planted_faults(spark):
    recipes = spark.createDataFrame([(1, 100, 25.0, "a" * 64), (2, 0, None, "short"), (3, 10, 1.0, "")], "k long, duration long, fps double, digest string")
    assets = spark.createDataFrame([(1, "x", "file", None, None), (1, "y", " ", 5, 5), (1, "x", "file", 0, 9)], "k long, id string, uri string, s long, e long")
    tracks = spark.createDataFrame([(1, "v", "video", 0), (3, "v", "fog", None)], "k long, id string, type string, z long")
    kinds = "k long, id string, type string, status string, s long, e long, track string, confidence double, evidence array<string>, inputs array<string>, depends array<string>"
    good = (1, "o1", "cut", "supported", 5, 5, "v", 1.0, ["frame"], ["x"], [])
    bad = [
        (1, "o2", "zoom", "supported", 5, 5, "v", 0.5, [], ["o1", "q"], ["o4"]), (1, "o3", "warp", "lost", -1, 101, "w", 1.5, [""], [], ["o9"]), (1, "o4", "zoom", "uncertain", None, 7, "v", None, None, None, ["o5"]),
        (1, "o5", "zoom", "uncertain", 1, 7, "v", 0.0, None, None, ["o2"]), (3, "", "zoom", "uncertain", 1, 7, "v", 0.0, None, None, ["o2"]),
    ]
    got = rp.recipe_violations(recipes, assets, tracks, spark.createDataFrame([good, *bad], kinds), "k", ("cut", "zoom"), ("cut",), ("video", "audio"))
    want = {
        (1, "asset", "x", "repeated id"), (1, "asset", "y", "no uri"), (1, "asset", "y", "range"), (1, "operation", "o2", "no length"), (1, "operation", "o2", "no evidence"), (1, "operation", "o2", "unknown input"),
        (1, "operation", "o3", "type"), (1, "operation", "o3", "status"), (1, "operation", "o3", "outside"), (1, "operation", "o3", "confidence"), (1, "operation", "o3", "no source"), (1, "operation", "o3", "unknown track"),
        (1, "operation", "o3", "unknown dependency"), (1, "operation", "o4", "interval"), (1, "operation", "o4", "confidence"), *((1, "operation", f"o{i}", "cycle") for i in (2, 4, 5)),
        (2, "recipe", None, "duration"), (2, "recipe", None, "fps"), (2, "recipe", None, "digest"), (2, "recipe", None, "no tracks"), (3, "track", "v", "type"), (3, "track", "v", "no order"), (3, "operation", "", "no id"),
        (3, "operation", "", "unknown dependency"),
    }
    assert {(r.k, r.part, r.id, r.violation) for r in got.collect()} == want


def test_many_small_graphs_are_searched_as_rows(spark, monkeypatch):
    """Graphs of at most ``most`` edges never start the search by rounds; larger ones do; both agree with reachability."""
    r = random.Random(5)
    edges, want = [], set()
    for k in range(60):
        m = 40 if k % 20 == 0 else r.randint(1, 9)
        mine = [(f"o{r.randrange(m)}", f"o{r.randrange(m)}") for _ in range(m)]
        edges += [(k, a, b) for a, b in mine]
        reach = {x: {b for a, b in mine if a == x} for p in mine for x in p}
        for _ in reach:
            reach = {x: y | {c for b in y for c in reach[b]} for x, y in reach.items()}
        want |= {(k, x) for x in reach if x in reach[x]}
    df = spark.createDataFrame([*edges, (99, None, "o1"), (99, "o1", None)], "k long, src string, dst string")
    assert {tuple(x) for x in li.on_cycle_by(df, "k", 20).collect()} == want
    monkeypatch.setattr(li, "on_cycle", lambda edges: pytest.fail("rounds for small graphs"))
    got = [tuple(x) for x in li.on_cycle_by(df, "k", 40).collect()]
    assert len(got) == len(want) and set(got) == want


def test_recipes_of_small_graphs_take_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(li, "on_cycle", lambda edges: pytest.fail("rounds for small graphs"))
    monkeypatch.setattr(rp, "on_cycle", lambda edges: pytest.fail("rounds for small graphs"), raising=False)
    recipes = spark.createDataFrame([(1, 10, 25.0, "")], "k long, duration long, fps double, digest string")
    none = spark.createDataFrame([], "k long, id string, uri string, s long, e long, type string, z long")
    kinds = "k long, id string, type string, status string, s long, e long, track string, confidence double, evidence array<string>, inputs array<string>, depends array<string>"
    ops = spark.createDataFrame([(1, f"o{i}", "cut", "uncertain", 1, 2, None, 1.0, ["x"], [], [f"o{3 - i}"]) for i in (1, 2)], kinds)
    got = rp.recipe_violations(recipes, none, none, ops, "k", ("cut",), (), ("video",))
    assert {(r.id, r.violation) for r in got.collect()} == {("o1", "cycle"), ("o2", "cycle"), ("o1", "unknown track"), ("o2", "unknown track"), (None, "no tracks")}
