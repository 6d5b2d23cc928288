"""Slots, paths, layers, cliques, combinations, windows, texts, claims, streams and skills: planted cases and slow models."""

import itertools
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomline.functions.registered import REGISTRY, Registry, Skill, SkillBlocked, register_table_functions
from loomline.operators import observation as ob
from loomline.operators import planning as pl
from loomline.streaming.stateful import GROUPS, run_appended, stream_min_spacing, stream_stalls

SLOT = "plan long, slot long, threshold long, forms array<string>, grp string, required boolean, fusable boolean, modes array<string>"
FIT = "plan long, slot long, id long, fit long, form string, subject long, strength long, confidence long, s long, e long, box_s long, box_e long"


def assigned(spark, slots, fits, most=5):
    made = pl.assign_slots(spark.createDataFrame(fits, FIT), spark.createDataFrame(slots, SLOT), ["plan"], most, 100, 10, 5, (3, 15))
    return {(r.plan, r.slot): r for r in made.collect()}, made


def fit(slot, id, fit, form="clip", subject=1, s=0, e=50, plan=0):
    return (plan, slot, id, fit, form, subject, 0, 0, s, e, s - 100, e + 100)


def slot(n, grp=None, required=True, fusable=True, forms=("clip",), modes=("clip",), plan=0):
    return (plan, n, 70, list(forms), grp, required, fusable, list(modes))


def test_subject_is_locked_by_the_first_pick(spark):
    got, _ = assigned(spark, [slot(0, "a"), slot(1, "a"), slot(2)], [fit(0, 1, 90, subject=7), fit(0, 2, 80, subject=8), fit(1, 3, 99, subject=8), fit(1, 4, 71, subject=7), fit(2, 5, 75, subject=None), fit(0, 6, 99, subject=None)])
    assert [got[0, k].id for k in range(3)] == [1, 4, 5]
    assert got[0, 0].n_fit == 3 and got[0, 0].mode == "clip" and (got[0, 0].s, got[0, 0].e) == (-10, 55)


def test_the_locked_subject_is_found_beyond_the_best_units(spark):
    fits = [fit(0, 1, 99, subject=7)] + [fit(1, 100 + i, 98, subject=8, s=i) for i in range(50)] + [fit(1, 999, 71, subject=7)]
    assert assigned(spark, [slot(0, "a"), slot(1, "a")], fits, most=2)[0][0, 1].id == 999


def test_adjacent_slots_fuse_and_others_are_missing(spark):
    slots = [slot(0), slot(1), slot(2, fusable=False), slot(3, required=False), slot(4)]
    got, made = assigned(spark, slots, [fit(k, 1, 90) for k in range(4)] + [fit(4, 2, 90, s=0, e=101)])
    assert [got[0, k].verdict for k in range(5)] == ["picked", "fused", "missing", "skipped", "missing"]
    assert [got[0, k].reason for k in range(5)] == [None, None, "used", "used", "core too long"]
    assert got[0, 1].segment == 0 and got[0, 1].length is None
    v = pl.plan_verdicts(made, ["plan"], 10, 100).first()
    assert (v.length, v.segments, v.missing, v.reason) == (65, 1, "2,4", "required slots missing")


def test_forms_holds_and_budgets(spark):
    got, made = assigned(spark, [slot(0, forms=("instant",), modes=("clip", "hold")), slot(1, forms=("clip",))], [fit(0, 1, 90, "instant", s=0, e=50), fit(1, 2, 90, "speech"), fit(1, 3, 70, "clip", s=0, e=92)])
    assert (got[0, 0].mode, got[0, 0].length) == ("hold", 15) and (got[0, 1].n_fit, got[0, 1].n_form) == (2, 1)
    assert got[0, 1].e - got[0, 1].s == 100 and (got[0, 1].s, got[0, 1].e) == (-7, 93)
    assert pl.plan_verdicts(made, ["plan"], 200, 300).first().reason == "below the least length"
    assert pl.plan_verdicts(made, ["plan"], 1, 50).first().reason == "over the longest"
    with pytest.raises(ValueError, match="more than 1"):
        assigned(spark, [slot(0), slot(1)], [], most=1)
    assert {r.verdict for r in assigned(spark, [slot(0), slot(1, required=False)], [])[0].values()} == {"missing", "skipped"}


CAND = "plan long, slot long, id long, score long, names array<string>, source string, s long, event long, causes array<long>, precedes array<long>"


def contract(spark, slots, rows):
    c = spark.createDataFrame([(0, s, i, sc, n, "v", i, i, [], []) for s, i, sc, n in rows], CAND)
    r = pl.contract_paths(c, spark.createDataFrame([(0, *x) for x in slots], "plan long, slot long, required boolean, hard boolean"), ["plan"]).first()
    return r.hypothesis, r.covered, [x.id for x in r.path], r.n_hypotheses


def test_identity_outranks_similarity(spark):
    """The better scored rows of another identity are no way out: the hypothesis that covers all slots wins."""
    rows = [(0, 1, 90, ["char:b"]), (0, 2, 10, ["char:a"]), (1, 3, 50, []), (2, 4, 5, ["char:a"]), (2, 5, 99, ["char:c"])]
    assert contract(spark, [(0, True, False), (1, False, False), (2, True, False)], rows) == ("char:a", 3, [2, 3, 4], 2)


def test_canonical_names_and_order_break_ties(spark):
    rows = [(0, 1, 50, ["win:1", "char:a"]), (0, 2, 50, ["char:b"])]
    assert contract(spark, [(0, True, False)], rows)[0] == "char:a"
    assert contract(spark, [(0, False, False)], rows)[0] is None


def test_chain_starts_again_after_a_dead_slot(spark):
    rows = [(0, 1, 50, ["x"]), (1, 2, 50, ["y"]), (2, 3, 10, ["z"]), (2, 4, 60, ["w"]), (4, 5, 1, ["z"])]
    got = contract(spark, [(0, False, False), (1, False, True), (2, False, True), (3, False, False), (4, False, True)], rows)
    assert got == (None, 3, [1, 4, 5], 0)  # slot 1 shares no name with 0, so 2 starts anew; 3 is empty, so 4 does


def brute_path(groups, hard):
    """All ways through groups that are never dead."""
    def move(a, b):
        return (25 if set(a[2]) & set(b[2]) else 0) + 5 + (8 if a[0] <= b[0] else 0) - (30 if a[0] == b[0] else 0)

    ways = [w for w in itertools.product(*groups) if all(not h or set(a[2]) & set(b[2]) for a, b, h in zip(w, w[1:], hard[1:], strict=False))]
    return max(sum(x[1] for x in w) + sum(move(a, b) for a, b in zip(w, w[1:], strict=False)) for w in ways) if ways else None


def test_paths_equal_all_ways(spark):
    r = random.Random(3)
    for _ in range(4):
        groups = [[(10 * g + i, r.randint(0, 60), ["p", *r.sample(["q", "s"], r.randint(0, 2))]) for i in range(4)] for g in range(4)]
        hard = [False, r.random() < 0.5, r.random() < 0.5, False]
        rows = [(g, *x) for g, group in enumerate(groups) for x in group]
        _, covered, ids, _ = contract(spark, [(g, False, hard[g]) for g in range(4)], rows)
        by = {x[0]: x for group in groups for x in group}
        assert covered == 4 and brute_path([[by[i]] for i in ids], hard) == brute_path(groups, hard)


def test_layers_stop_at_the_first_free_place(spark):
    asks = spark.createDataFrame([(1,), (2,), (3,)], "ask long")
    seen = []

    def layer(rows):
        def run(open_):
            seen.append(sorted(r.ask for r in open_.collect()))
            return spark.createDataFrame(rows, "ask long, source long, id long, s long, e long, score long").join(open_, "ask", "left_semi")

        return run

    first = [(1, 0, 10, 0, 10, 5), (1, 0, 11, 100, 110, 4), (2, 0, 12, 0, 10, 9)]
    second = [(1, 0, 90, 500, 510, 99), (2, 0, 13, 200, 210, 1), (2, 0, 14, 300, 310, 1), (3, 0, 15, 19, 20, 1)]
    blocked = spark.createDataFrame([(1, 0, 12, 20), (2, 0, 10, 11), (3, 0, 22, 23)], "ask long, source long, s2 long, e2 long")
    got = {r.ask: (r.layer, r.id) for r in pl.search_in_layers(asks, [layer(first), layer(second)], blocked, 2, 50).collect()}
    assert got == {1: (1, 11), 2: (2, 13), 3: (None, None)} and seen == [[1, 2, 3], [2, 3]]


def brute_clique(seed, cands, said, spacing):
    both = lambda a, b, x: said.get((a, b)) == x == said.get((b, a))
    hint = {"possible": 0, "unsure": 1, "hard": 2}
    order = sorted((c for c in cands if c[0] != seed[0]), key=lambda c: (hint[c[2]], abs(c[1] - seed[1]), c[1], c[0]))
    got = [seed]
    for c in order:
        if len(got) < 3 and all(abs(c[1] - p[1]) >= spacing and both(p[0], c[0], "same") for p in got):
            got.append(c)
    ids = [p[0] for p in got]
    rest = sorted((c for c in order if c[0] not in ids), key=lambda c: (c[2] != "hard", abs(c[1] - seed[1]), c[1], c[0]))
    return ids, next((c[0] for c in rest if len(ids) == 3 and all(both(p, c[0], "different") for p in ids)), None)


def test_cliques_equal_a_greedy_walk(spark):
    r = random.Random(5)
    seeds, cands, answers, want = [], [], [], {}
    for k in range(25):
        rows = [(k * 100 + i, r.randint(0, 60), r.choice(["possible", "unsure", "hard"])) for i in range(14)]
        said = {(a[0], b[0]): r.choices(["same", "different", "unsure"], [6, 5, 1])[0] if r.random() < 0.9 else "unsure" for a in rows for b in rows if a != b}
        said |= {(b, a): x for (a, b), x in said.items() if a < b and r.random() < 0.8}
        want[k] = brute_clique(rows[0], rows, said, 3)
        seeds.append((k, rows[0][0], rows[0][1]))
        cands += [(k, *x) for x in rows]
        answers += [(k, a, b, x) for (a, b), x in said.items()]
    got = pl.directed_clique(spark.createDataFrame(seeds, "key long, id long, t long"), spark.createDataFrame(cands, "key long, id long, t long, hint string"), spark.createDataFrame(answers, "key long, left long, right long, result string"), ["key"], 3)
    rows = {x.key: (x.ids, x.negative) for x in got.collect()}
    assert rows == want and any(n for _, n in want.values()) and any(len(i) < 3 for i, _ in want.values())


def brute_combination(parts):
    best, score = None, (-1, -1, -1)
    for combo in itertools.product(*([None, *options] for options in parts)):
        chosen = [o for o in combo if o is not None]
        lists = [tuple(o[2]) for o in chosen]
        if len(set(lists)) != len(lists):
            continue
        every = [e for o in lists for e in o]
        now = (len(chosen), len(set(every)), len(set(every)) - len(every))
        if now > score:
            best, score = [(o[0], o[1]) for o in chosen], now
    return best, score


def test_combinations_equal_the_product_and_build_less(spark):
    r = random.Random(9)
    rows, want, product = [], {}, 0
    for k in range(30):
        parts = [[(p, o, sorted(r.sample(range(7), r.randint(1, 3)))) for o in range(r.randint(1, 4))] for p in range(4)]
        rows += [(k, p, o, e) for part in parts for p, o, e in part]
        want[k] = brute_combination(parts)
        product += sum(len(list(itertools.islice(itertools.product(*([None, *x] for x in parts[:d])), 10_000))) for d in range(1, 5))
    got = pl.best_combination(spark.createDataFrame(rows, "key long, part long, option long, events array<long>"), ["key"]).collect()
    assert {x.key: ([tuple(c) for c in x.chosen], (x.n_parts, x.n_events, -x.n_repeats)) for x in got} == want
    assert sum(x.n_built for x in got) < product / 3
    same = spark.createDataFrame([(0, p, 0, [1, 2]) for p in range(3)], "key long, part long, option long, events array<long>")
    assert pl.best_combination(same, ["key"]).first().n_parts == 1


def brute_refit(total, needs, floor, most, longest):
    equal = total // len(needs)
    got = [min(most, max(floor, equal, a, b)) for a, b in needs]
    slack = sum(got) - min(total * 120 // 100, longest)
    for i, n in enumerate(got):
        if n <= equal and slack > 0:
            give = min(n - floor, slack)
            got[i], slack = n - give, slack - give
    return got


def test_refit_equals_the_squeeze(spark):
    r = random.Random(4)
    plans = {k: (r.randint(1000, 9000), [(r.choice([0, r.randint(0, 4000)]), r.randint(0, 1500)) for _ in range(r.randint(1, 9))]) for k in range(60)}
    rows = spark.createDataFrame([(k, i, t, a, b) for k, (t, needs) in plans.items() for i, (a, b) in enumerate(needs)], "key long, slot long, total long, evidence long, speech long")
    got = {}
    for x in sorted(pl.refit_slots(rows, ["key"], 300, 1500, 6000).collect(), key=lambda x: (x.key, x.slot)):
        assert x.s == sum(got.setdefault(x.key, [])) and x.e - x.s == x.length and 300 <= x.length <= 1500
        got[x.key].append(x.length)
    assert got == {k: brute_refit(t, needs, 300, 1500, 6000) for k, (t, needs) in plans.items()}


def test_roughcut_shares_what_is_left(spark):
    rows = spark.createDataFrame([(0, 0, 100, 0, 50, True), (0, 1, 0, 120, 700, False), (0, 2, None, 5, 5, True), (1, 0, 9000, 0, 0, True)], "key long, slot long, evidence long, speech long, source long, required boolean")
    got = {(x.key, x.slot): (x.length, x.plan_length, x.feasible) for x in pl.refit_roughcut(rows, ["key"], 1000, 5000).collect()}
    assert got == {(0, 0): (165, 1000, True), (0, 1): (765, 1000, True), (0, 2): (70, 1000, True), (1, 0): (None, None, False)}


def brute_windows(hi, hard, soft, target, least, most):
    hard = sorted({t for t in hard if 0 < t < hi})
    soft = sorted({t for t in soft if 0 < t < hi} - set(hard))
    spans = []
    for lo, up in itertools.pairwise([0, *hard, hi]):
        if up - lo <= target:
            spans.append([lo, up])
            continue
        cuts = [lo]
        for t in soft:
            if lo < t < up and t - cuts[-1] >= least and up - t >= least:
                cuts.append(t)
        joined = []
        for a, b in itertools.pairwise([*cuts, up]):
            if joined and b - joined[-1][0] <= target:
                joined[-1][1] = b
            else:
                joined.append([a, b])
        spans += joined
    size = lambda x: x[1] - x[0]
    while len(spans) > 1 and (i := next((i for i, x in enumerate(spans) if size(x) < least), None)) is not None:
        if i and (i == len(spans) - 1 or size(spans[i - 1]) <= size(spans[i + 1])):
            spans[i - 1][1] = spans[i][1]
        else:
            spans[i + 1][0] = spans[i][0]
        del spans[i]
    while len(spans) > most:
        i = min(range(len(spans) - 1), key=lambda i: size(spans[i]) + size(spans[i + 1]))
        spans[i][1] = spans[i + 1][1]
        del spans[i + 1]
    return [(a, b, a in hard or b in hard, a in soft or b in soft) for a, b in spans]


def test_windows_equal_a_slow_model(spark):
    r = random.Random(7)
    plans = {k: (hi := r.randint(50, 400), [r.randint(-5, hi + 5) for _ in range(r.choice([0, 1, 5, 40]))], [r.randint(0, hi) for _ in range(r.choice([1, 10, 90]))]) for k in range(60)}
    spans = spark.createDataFrame([(k, p[0]) for k, p in plans.items()], "key long, hi long")
    cuts = spark.createDataFrame([(k, t, h) for k, p in plans.items() for h, ts in ((True, p[1]), (False, p[2])) for t in ts], "key long, t long, hard boolean")
    got = {}
    for x in sorted(ob.event_windows(spans, cuts, ["key"], 40, 8, 6).collect(), key=lambda x: (x.key, x.idx)):
        got.setdefault(x.key, []).append((x.s, x.e, x.hard, x.soft))
    want = {k: brute_windows(*p, 40, 8, 6) for k, p in plans.items()}
    assert {k: got[k] for k in want if any(0 < t < plans[k][0] for t in plans[k][1] + plans[k][2])} == {k: w for k, w in want.items() if any(0 < t < plans[k][0] for t in plans[k][1] + plans[k][2])}


def test_windows_without_cuts_are_equal_or_spread(spark):
    spans = spark.createDataFrame([(0, 100), (1, 1000), (2, 0), (3, 5)], "key long, hi long")
    got = {}
    for x in sorted(ob.event_windows(spans, spark.createDataFrame([], "key long, t long, hard boolean"), ["key"], 30, 8, 4).collect(), key=lambda x: (x.key, x.idx)):
        got.setdefault(x.key, []).append((x.s, x.e))
    assert got == {0: [(0, 25), (25, 50), (50, 75), (75, 100)], 1: [(0, 30), (323, 353), (646, 676), (970, 1000)], 3: [(0, 5)]}


def brute_signals(marks, speech):
    norm = lambda t: "".join(c.lower() for c in (chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in t) if c.isalnum())
    out = {}
    for _, t, s, e in sorted(marks):
        if k := norm(t):
            if k in out:
                out[k] = [out[k][0], min(out[k][1], s), max(out[k][2], e), out[k][3] + 1, 0]
            else:
                out[k] = [t, s, e, 1, 0]
    for _, t, s, e in sorted(speech):
        k = norm(t)
        if not k:
            continue
        at = k if k in out else next((o for o, x in out.items() if (o in k or k in o) and min(x[2], e) > max(x[1], s)), None)
        if at is None:
            out[k] = [t, s, e, 0, 1]
        else:
            x = out[at]
            out[at] = [x[0], min(x[1], s), max(x[2], e), x[3], x[4] + 1]
    return [tuple(x) for x in out.values()]


def test_signals_equal_a_slow_model(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("ab漢Ａ１ -!") for _ in range(r.randint(0, 6)))
    rows = {k: ([(i, word(), s := r.randint(0, 50), s + r.randint(1, 9)) for i in range(r.randint(0, 12))], [(100 + i, word(), s := r.randint(0, 50), s + r.randint(1, 9)) for i in range(r.randint(0, 25))]) for k in range(40)}
    frame = lambda j: spark.createDataFrame([(k, *x) for k, p in rows.items() for x in p[j]], "key long, id long, text string, s long, e long")
    got = {}
    for x in sorted(ob.merge_signals(frame(0), frame(1), ["key"]).collect(), key=lambda x: (x.key, x.entry)):
        got.setdefault(x.key, []).append((x.text, x.s, x.e, x.n_marks, x.n_speech))
    want = {k: w for k, p in rows.items() if (w := brute_signals(*p))}
    assert got == want


def test_claims_equal_a_slow_model(spark):
    r = random.Random(2)
    rows = [(k, i, s := r.randint(0, 60), s + r.randint(0, 12), r.sample([1, 2, 3], r.randint(0, 2)), r.choice(["x", "y", None])) for k in range(8) for i in range(60)]
    want, seen = set(), {}
    for k, i, s, e, goals, relation in rows:
        known = seen.setdefault((k, relation or "uncertain"), [])
        hit = lambda p: 2 * p[0] <= s + e <= 2 * p[1] or (max(e, p[1]) > min(s, p[0]) and 2 * max(0, min(e, p[1]) - max(s, p[0])) > max(e, p[1]) - min(s, p[0]))  # noqa: B023, E731
        if not any(hit(p) and set(goals) <= set(p[2]) for p in known):
            known.append((s, e, goals))
            want.add((k, i))
    got = ob.unique_claims(spark.createDataFrame(rows, "key long, id long, s long, e long, goals array<long>, relation string"), ["key"])
    assert {(x.key, x.id) for x in got.collect()} == want and len(want) < len(rows)


def test_late_rows_are_left_out_and_state_goes(spark, tmp_path):
    """Rows behind the watermark change nothing; shuffled ones before it count in order of time."""
    hour = 3600
    parts = [[(1, 0), (3, 5 * hour), (2, 2 * hour)], [(4, 30 * hour)], [(5, 3 * hour), (6, 29 * hour), (7, 40 * hour)], [(8, 900 * hour)]]
    kept = None
    for k, part in enumerate(parts):
        frame = spark.createDataFrame([(9, i, t + 24 * hour) for i, t in part], "user long, id long, t long").select("user", "id", F.timestamp_seconds("t").alias("ts"))
        frame.write.parquet(str(tmp_path / "in" / str(k)))
        stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).withWatermark("ts", "4 hours")
        kept = run_appended(stream_min_spacing(stream, "user", 4 * hour * 1_000_000), str(tmp_path / "out"))
    assert sorted(r.id for r in kept.collect()) == [1, 3, 6, 7]


def test_stream_state_is_a_row_for_many_keys(spark, tmp_path):
    """Rows of state and calls are bounded by the groups, not by the keys; a null key and one beyond 2^53 keep their own."""
    keys = [None, (1 << 60) + 1, (1 << 60) + 2, *range(2 * GROUPS)]
    rows = [(n * 10 + j, k, datetime(2024, 1, 1, 3 * j), "ab"[j // 2 if k in keys[:2] else j % 2]) for n, k in enumerate(keys) for j in range(3)]
    frame = spark.createDataFrame(rows, "id long, user long, ts timestamp, kind string")
    frame.write.parquet(str(tmp_path / "in/0"))
    spark.createDataFrame([(-1, -1, datetime(2025, 1, 1), "end")], frame.schema).write.parquet(str(tmp_path / "in/1"))

    def told(op, name):
        stream = spark.readStream.schema(frame.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).withWatermark("ts", "4 hours")
        q = op(stream).writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= GROUPS
        return spark.table(name).collect()

    kept = {(r.user, r.id) for r in told(lambda x: stream_min_spacing(x, "user", 5 * 3_600_000_000), "spaced")}
    assert kept == {(k, n * 10 + j) for n, k in enumerate(keys) for j in (0, 2)}
    assert {(r.user, r.stalled_at) for r in told(lambda x: stream_stalls(x, "user", "kind", 2), "stalled")} == {(None, 1), (keys[1], 11)}


def test_texts_merge_a_few_recordings_at_a_time():
    """However many recordings a batch has, few are Python objects at once; nothing seen, nothing heard and neither are recordings too."""
    import pyarrow as pa

    seen = [{"id": 1, "norm": "ab", "text": "Ab", "s": 0, "e": 5, "n": 2}]
    heard = [{"id": 2, "norm": "abc", "text": "abc", "s": 4, "e": 9, "others": ["ab"]}, {"id": 3, "norm": "z", "text": "z", "s": 1, "e": 2, "others": []}]
    n = 3 * ob.RECORDINGS + 1
    batch = pa.RecordBatch.from_pydict({"key": list(range(n)), "seen": [None if k % 3 == 1 else seen for k in range(n)], "heard": [None if k % 3 == 2 else heard for k in range(n)]})
    parts = list(ob._merged(iter([batch])))
    assert len(parts) == 4 and all(len(set(p.column("key").to_pylist())) <= ob.RECORDINGS for p in parts)
    want = {0: [("Ab", 0, 9, 2, 1), ("z", 1, 2, 0, 1)], 1: [("abc", 4, 9, 0, 1), ("z", 1, 2, 0, 1)], 2: [("Ab", 0, 5, 2, 0)]}
    rows = [tuple(r.values()) for p in parts for r in p.to_pylist()]
    assert rows == [(k, i, *x) for k in range(n) for i, x in enumerate(want[k % 3])]
    assert ob._merge(None, None) == []


def test_clique_answers_are_one_row_a_pair(spark, monkeypatch):
    """What is written of the answers is a row for both directions of those that can be used; a row that answers of itself counts once."""
    kept, real = {}, pl.durable
    monkeypatch.setattr(pl, "durable", lambda df, name: kept.setdefault(f"{name}-{len(kept)}", real(df, name)))
    said = {(1, 2): "same", (1, 3): "unsure", (2, 3): "different", (3, 3): "same"}
    rows = [(0, a, b, x) for (a, b), x in said.items()] + [(0, b, a, x) for (a, b), x in said.items() if a != b] + [(0, 1, 4, "same"), (0, 4, 1, "different"), (0, 5, 1, "same")]
    people = spark.createDataFrame([(0, k, 10 * k, "possible") for k in range(1, 6)], "key long, id long, t long, hint string")
    got = pl.directed_clique(people.where("id = 1").select("key", "id", "t"), people, spark.createDataFrame(rows, "key long, left long, right long, result string"), ["key"], 3, 2).collect()
    answers = next(v for k, v in kept.items() if k.startswith("clique-answers"))
    assert sorted(tuple(r) for r in answers.select("lo", "hi", "result").collect()) == [(1, 2, "same"), (2, 3, "different"), (3, 3, "same")]
    assert [(r.ids, r.negative, r.passed) for r in got] == [([1, 2], None, False)]


def test_layers_meet_walls_of_asks_with_candidates_only(spark, monkeypatch):
    """Places taken go into a layer's join only for asks that have a candidate in it."""
    met, real = [], pl.overlap_join
    monkeypatch.setattr(pl, "overlap_join", lambda left, right, keys, width: met.append({r.ask for r in right.collect()}) or real(left, right, keys, width))
    asks = spark.createDataFrame([(k,) for k in range(4)], "ask long")
    kind = "ask long, source long, id long, s long, e long, score long"
    layers = [lambda a, rows=rows: spark.createDataFrame(rows, kind).join(a, "ask") for rows in ([(0, 7, 1, 0, 5, 1), (1, 7, 2, 0, 5, 1)], [(1, 7, 3, 90, 95, 1), (2, 7, 4, 50, 55, 1)])]
    blocked = spark.createDataFrame([(k, 7, 2, 3) for k in (1, 2, 3)], "ask long, source long, s2 long, e2 long")
    got = {r.ask: (r.layer, r.id) for r in pl.search_in_layers(asks, layers, blocked, 2, 50).collect()}
    assert got == {0: (1, 1), 1: (2, 3), 2: (2, 4), 3: (None, None)}
    assert met == [{1}, {1, 2}]


def test_skills_fail_before_any_job(spark):
    spans = spark.createDataFrame([(1, 0, 10, 4, 1)], "key long, lo long, hi long, width long, shared long")
    states = {"spans": "committed"}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("skills", "no job may run")
    for code, call in {
        "unknown_skill": lambda: REGISTRY.run("nothing", states, spans=spans),
        "input": lambda: REGISTRY.run("overlapping_windows", states, spans=spans.withColumn("lo", F.col("lo").cast("int"))),
        "precondition": lambda: REGISTRY.run("overlapping_windows", {"spans": "stale"}, spans=spans),
    }.items():
        with pytest.raises(SkillBlocked) as e:
            call()
        assert e.value.code == code
    with pytest.raises(SkillBlocked, match="takes the tables"):
        REGISTRY.run("overlapping_windows", states, rows=spans)
    assert not tracker.getJobIdsForGroup("skills")
    got = REGISTRY.run("overlapping_windows", states, spans=spans).collect()
    assert [tuple(x) for x in sorted(got)] == [(1, 0, 0, 4), (1, 1, 3, 7), (1, 2, 6, 10)]


def test_skills_check_rows_cost_and_output(spark):
    r = Registry()
    r.register(Skill("half", lambda t: t.selectExpr("id", "id / 2 AS h"), {"t": {"id": "bigint"}}, {"id": "bigint", "h": "double"}, checks={"small": "h < 2"}))
    r.register(Skill("dear", lambda t: t, {"t": {"id": "bigint"}}, {"id": "bigint"}, cost="expensive"))
    r.register(Skill("wrong", lambda t: t, {"t": {"id": "bigint"}}, {"h": "double"}, requires={"base": "exists"}))
    assert r.runnable({}) == ["half"] and r.runnable({"base": "stale"}, "any") == ["dear", "half", "wrong"]
    assert r.run("half", t=spark.range(3)).count() == 3
    with pytest.raises(Exception, match="a row fails small"):
        r.run("half", t=spark.range(9)).collect()
    with pytest.raises(SkillBlocked, match="budget_gate"):
        r.run("dear", t=spark.range(1))
    with pytest.raises(SkillBlocked, match="output"):
        r.run("wrong", {"base": "exists"}, t=spark.range(1))


def test_table_function_in_sql(spark):
    register_table_functions(spark)
    assert [tuple(x) for x in spark.sql("SELECT * FROM loom_windows(5, 5, 2, 1)").collect()] == []
    assert [tuple(x) for x in spark.sql("SELECT * FROM loom_windows(5, 6, 20, 1)").collect()] == [(0, 5, 6)]


def test_fits_below_every_threshold_are_dropped_before_the_join(spark):
    from loomline.plans import planning as plans

    plan = plans.slot_assignment(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "fit" in plan and ">= _bar" in plan
