"""Quality rules: text statistics and a learned decision list over them."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.native import SPACE, SYMBOLS, count_chars, let, words_of
from loomline.llm.scratch import durable

UPPER, DIGITS, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?"
FEATURES = ("n_words", "symbol_share", "repeat_share", "dup_line_share", "upper_share", "digit_share", "mark_share", "distinct_share", "mean_word")


def repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text, the first time included.

    Windows are compared by a 64-bit hash; sorted with their places, equal ones are neighbours.
    """

    def covered(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1))), lambda x: x["i"]))

        def length(p: Column) -> Column:
            steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1), x + 3) - x))
            return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(placed, twice), length))

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows(words), covered)).cast("long")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row of statistics for every row of ``docs``: counts, shares, base_failed.

    Null and empty texts have no words, so base_failed is true and the shares are 0. Ids may be
    null or repeat; other columns are ignored.
    """
    t = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.length(F.translate(x, SPACE, "")) > 0)

    def on_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct"), repeat_words(w).alias("repeat"))

    def on_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("distinct"))

    base = docs.select(
        F.col(id_col).alias("id"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        count_chars(t, SYMBOLS).alias("n_symbols"),
        count_chars(t, UPPER).alias("n_upper"),
        count_chars(t, DIGITS).alias("n_digits"),
        count_chars(t, MARKS).alias("n_marks"),
        let(words_of(t), on_words).alias("w"),
        let(lines, on_lines).alias("l"),
    )
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    flat = base.select(
        "id", "word_chars", "n_symbols", "n_upper", "n_digits", "n_marks",
        F.col("w.n").alias("n_words"), F.col("w.distinct").alias("n_distinct"), F.col("w.repeat").alias("n_repeat_words"),
        F.col("l.n").alias("n_lines"), (F.col("l.n") - F.col("l.distinct")).alias("n_dup_lines"),
    )
    return flat.withColumns(
        {
            "symbol_share": share("n_symbols", "word_chars"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "upper_share": share("n_upper", "word_chars"),
            "digit_share": share("n_digits", "word_chars"),
            "mark_share": share("n_marks", "word_chars"),
            "distinct_share": share("n_distinct", "n_words"),
            "mean_word": share("word_chars", "n_words"),
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        }
    )


@dataclass(frozen=True)
class Literal:
    """``feature`` above (or not above) ``edge``."""

    feature: str
    above: bool
    edge: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value > self.edge if self.above else value <= self.edge

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.edge:.6g}"


def holds(rule: list[Literal]) -> Column:
    return reduce(lambda a, b: a & b, (x.column() for x in rule), F.lit(True))


def decision_list(rules: list[list[Literal]]) -> Column:
    """The number of the first rule that holds, 0 if none does: one ordered conditional expression."""
    out = F.when(F.lit(False), F.lit(0))
    for k, rule in enumerate(rules, 1):
        out = out.when(holds(rule), F.lit(k))
    return out.otherwise(F.lit(0))


def learn_rules(rows: DataFrame, features: tuple[str, ...] = FEATURES, max_rules: int = 32, max_literals: int = 4, cuts: int = 16, precision: float = 0.9, least: int = 5) -> list[list[Literal]]:
    """Sequential covering of the rows with ``bad`` = 1 by conjunctions of thresholds.

    ``rows``: narrow statistics with id and bad (0 or 1). Two thirds grow, a third (by a hash of the
    id) prunes. A rule grows by the literal of highest gain until it covers no good row, at most
    ``max_literals``; its last literals are dropped while that does not lower (p - n) / (p + n) on the pruning rows.
    A rule is accepted if it covers ``least`` bad growing rows and has ``precision`` on both sets; its rows
    are then taken away. After a rule that fails, the next starts with another feature or direction, until none is
    left. Equal gains go to fewer good rows, then to the later feature name, ``>`` before ``<=``, the lower edge.
    Every step is one aggregation over all rows to a count for each feature, bin and class; only those counts reach the driver.
    """
    fold = F.pmod(F.xxhash64("id"), F.lit(3))
    grow, prune = rows.where(fold != 0), rows.where(fold == 0)
    asked = [F.percentile_approx(F.col(f).cast("double"), [i / cuts for i in range(1, cuts)]).alias(f) for f in features]
    edges: dict[str, set] = {f: set() for f in features}
    for r in rows.groupBy("bad").agg(*asked).collect():
        for f in features:
            edges[f] |= set(r[f] or [])
    marks = {f: sorted(x) for f, x in edges.items()}
    if not any(marks.values()):
        return []

    def place(f: str) -> Column:
        value = F.col(f).cast("double")
        above = F.aggregate(F.array(*(F.lit(float(e)) for e in marks[f])), F.lit(0), lambda a, e: a + (value > e).cast("int"))
        return F.struct(F.lit(f).alias("f"), above.alias("bin"))

    bins = F.array(*(place(f) for f in features if marks[f]))

    def literal(taken: Column, rule: list[Literal], barred: set) -> tuple[Literal, int, int] | None:
        counts = grow.where(taken & holds(rule)).select("bad", F.explode(bins).alias("b")).groupBy("b.f", "b.bin", "bad").agg(F.count(F.lit(1)).alias("n")).collect()
        tally: dict[tuple, list[int]] = {}
        for r in counts:
            tally.setdefault((r.f, r.bad), [0] * (len(marks[r.f]) + 1))[r.bin] += r.n
        best = None
        for f in features:
            bad, good = (tally.get((f, k), [0] * (len(marks[f]) + 1)) for k in (1, 0))
            p0, n0 = sum(bad), sum(good)
            if not p0:
                continue
            for j, edge in enumerate(marks[f]):
                for above in (True, False):
                    p, n = (sum(x[j + 1 :]) if above else sum(x[: j + 1]) for x in (bad, good))
                    if p < least or (p, n) == (p0, n0) or (f, above) in barred:
                        continue
                    gain = p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))
                    key = (round(gain, 9), -n, f, above, -j)
                    if gain > 1e-9 and (best is None or key > best[0]):
                        best = (key, Literal(f, above, float(edge)), p, n)
        return best and best[1:]

    def pruned(rule: list[Literal], taken: Column) -> list[Literal]:
        """The rule without its last literals as far as the pruning rows allow; empty if they do not bear it out."""
        sizes = range(1, len(rule) + 1)
        seen = prune.agg(*(F.sum((taken & holds(rule[:k]) & (F.col("bad") == b)).cast("long")).alias(f"{k}_{b}") for k in sizes for b in (1, 0))).first()
        count = {k: (seen[f"{k}_1"] or 0, seen[f"{k}_0"] or 0) for k in sizes}
        size = max(sizes, key=lambda k: ((count[k][0] - count[k][1]) / max(1, sum(count[k])), -k))
        return rule[:size] if count[size][0] >= precision * sum(count[size]) else []

    rules: list[list[Literal]] = []
    left, barred = F.lit(True), set()
    while len(rules) < max_rules:
        rule, p, n = [], 0, 1
        while n and len(rule) < max_literals and (found := literal(left, rule, set() if rule else barred)):
            rule.append(found[0])
            p, n = found[1:]
        if not rule:
            break
        short = pruned(rule, left) if p >= precision * (p + n) else []
        if short:
            rules.append(short)
            left, barred = left & ~holds(short), set()
        else:
            barred.add((rule[0].feature, rule[0].above))
    return rules


def apply_quality_rules(docs: DataFrame, labels: DataFrame | None, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and verdict of every row of ``docs``: base_failed, rule (0 if none fires) and kept.

    The rules are learned from all labelled rows that pass the base rules, which decide the others anyway (label 0 is bad).
    Null labels and ids do not teach; an id with several labels is bad if one of them is; every row of a repeated id teaches
    and gets its own verdict. Without labels there are no rules. An empty table gives no rows; null and empty texts
    fail the base.
    """
    stats = durable(text_statistics(docs, id_col, text_col), "quality-stats")
    rules: list[list[Literal]] = []
    if labels is not None:
        known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("k"))
        known = known.agg(F.max((F.col(label_col) == 0).cast("int")).alias("bad"))
        passed = stats.where("not base_failed").join(known, F.col("id") == F.col("k"))
        rules = learn_rules(durable(passed.select("id", "bad", *FEATURES), "quality-labelled"))
    out = stats.withColumn("rule", decision_list(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
    return out.withColumnRenamed("id", id_col)
