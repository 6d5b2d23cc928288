"""Dependency graphs: closures, effective status, cycles, conflicts, versions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomline.operators.tables import durable


HOPS = 4  # steps of a search that one written table covers


def closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Nodes reachable from each seed along (src, dst), with the least number of steps; the seeds are at 0.

    Breadth first, without a limit of depth: each round goes HOPS steps on from the newest nodes and is written as a table, so
    the plan stays small however long the paths, and the search ends when a round finds nothing new.
    """
    edges = durable(edges.select("src", "dst").distinct(), "closure-edges")
    rounds = [durable(seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("steps")).distinct(), "closure")]
    newest, step = rounds[0], 0
    while not newest.isEmpty():
        seen = reduce(DataFrame.unionByName, rounds).select("seed", "node")
        layer, layers = newest.select("seed", "node"), []
        for _ in range(HOPS):
            step += 1
            found = layer.join(edges, F.col("node") == F.col("src")).select("seed", F.col("dst").alias("node")).distinct()
            layer = found.join(seen, ["seed", "node"], "left_anti")
            layers.append(layer.withColumn("steps", F.lit(step)))
        new = durable(reduce(DataFrame.unionByName, layers).groupBy("seed", "node").agg(F.min("steps").alias("steps")), "closure")
        newest = new.where(F.col("steps") == step)
        rounds.append(new)
        if len(rounds) > 16:  # one table of all rounds so far, so that the next joins read one
            rounds = [durable(reduce(DataFrame.unionByName, rounds), "closure-seen")]
    return reduce(DataFrame.unionByName, rounds)


def _contract(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(edges without their chains, chains, rings): nodes of one edge in and one out are joined to chains (node, first, last), whose edge first -> last takes their place; rings are (node, part).

    Each round doubles how far a node of a chain sees, so that a chain takes as many rounds as its length has digits; what still sees a chain's
    node after them lies on a ring of such nodes, whose part is the least node seen. None if there is no such node.
    """
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.first("dst").alias("last")).where("n = 1").drop("n")
    back = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.first("src").alias("first")).where("n = 1").drop("n")
    links = durable(out.join(back, "node").withColumn("low", F.col("node")), "cycle-links")
    n = links.count()
    if not n:
        return None
    inner = links.select("node")
    for _ in range(n.bit_length()):
        ahead = links.select(F.col("node").alias("last"), F.col("last").alias("next"), F.col("low").alias("next_low"))
        behind = links.select(F.col("node").alias("first"), F.col("first").alias("before"))
        jumped = links.join(ahead, "last", "left").join(behind, "first", "left")
        links = durable(jumped.select("node", F.coalesce("before", "first").alias("first"), F.coalesce("next", "last").alias("last"), F.least("low", "next_low").alias("low")), "cycle-links")
        if links.join(inner.toDF("last"), "last", "left_semi").isEmpty():
            break
    rings = links.join(inner.toDF("last"), "last", "left_semi").select("node", F.col("low").alias("part"))
    chains = links.join(inner.toDF("last"), "last", "left_anti").select("node", "first", "last")
    rest = edges.join(inner.toDF("src"), "src", "left_anti").join(inner.toDF("dst"), "dst", "left_anti").select("src", "dst")
    kept = rest.unionByName(chains.where("first <> last").select(F.col("first").alias("src"), F.col("last").alias("dst"))).distinct()
    return durable(kept, "cycle-edges"), durable(chains, "cycle-chains"), durable(rings, "cycle-rings")


def _peel(edges: DataFrame, steps: int) -> DataFrame:
    """Without the edges from nodes that none leads to and to nodes that lead to none, ``steps`` times."""
    for _ in range(steps):
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return durable(edges, "cycle-edges")


def on_cycle(edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves: those of strongly connected parts of two nodes or more, and of loops.

    Chains become one edge (``_contract``), and nodes without an edge in or out leave. Then every node takes the largest name that reaches it; what a name's
    own node is reached from among those of its name is a strongly connected part, which is taken away. A chain lies on a cycle if its ends are one node or in one part.
    Each table covers several steps, so that long chains and rings take few.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("node")).distinct()
    left, chains = durable(edges.where("src <> dst").select("src", "dst").distinct(), "cycle-edges"), []
    parts = [loops.withColumn("part", F.col("node")).limit(0)]
    while not left.isEmpty():
        n = left.count()
        while (found := _contract(left)) is not None:
            left = found[0]
            chains.append(found[1])
            parts.append(found[2])
        left = _peel(left, 2)
        after = left.count()
        if not after or after < n:
            continue
        names = durable(left.select(F.col("src").alias("node")).distinct().withColumn("name", F.col("node")), "cycle-names")
        while True:
            step = names
            for _ in range(HOPS):
                moved = left.join(step, F.col("src") == F.col("node")).select(F.col("dst").alias("node"), "name")
                step = step.unionByName(moved).groupBy("node").agg(F.max("name").alias("name"))
            reached = durable(step, "cycle-names")
            same = reached.join(names, ["node", "name"], "left_anti").isEmpty()
            names = reached
            if same:
                break
        inside = left.join(names.toDF("src", "name"), "src").join(names.toDF("dst", "to_name"), "dst").where("name = to_name").select("src", "dst")
        back = closure(inside.select(F.col("dst").alias("src"), F.col("src").alias("dst")), names.where("node = name").select("node"))
        back = durable(back.select(F.col("seed").alias("part"), "node"), "cycle-parts")
        large = back.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("part")
        parts.append(back.join(large, "part", "left_semi").select("node", "part"))
        gone = back.select("node").distinct()
        kept = left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst")
        left = durable(kept, "cycle-edges")
    known = durable(reduce(DataFrame.unionByName, parts), "cycle-known")
    for chain in reversed(chains):
        ends = chain.join(known.toDF("first", "a"), "first", "left").join(known.toDF("last", "b"), "last", "left").where("first = last OR a = b")
        node = ends.select("node", F.coalesce("a", "first").alias("part"))
        end = ends.where("a IS NULL").select(F.col("first").alias("node"), F.col("first").alias("part")).distinct()
        known = durable(known.unionByName(node).unionByName(end), "cycle-known")
    return known.select("node").unionByName(loops).distinct()


SMALL = 1000  # edges of one key up to which its graph is searched as one row


def _circles(src: list[str], dst: list[str]) -> list[str]:
    """Nodes of one small graph that reach themselves: Tarjan's strongly connected parts, with a stack in place of recursion."""
    out: dict[str, list[str]] = {}
    for a, b in zip(src, dst, strict=True):
        out.setdefault(a, []).append(b)
    number, low, open_, waiting, found = {}, {}, set(), [], {a for a, b in zip(src, dst, strict=True) if a == b}
    for root in out:
        if root in number:
            continue
        stack = [(root, iter(out[root]))]
        number[root] = low[root] = len(number)
        waiting.append(root)
        open_.add(root)
        while stack:
            node, ahead = stack[-1]
            step = next(ahead, None)
            if step is None:
                stack.pop()
                if stack:
                    low[stack[-1][0]] = min(low[stack[-1][0]], low[node])
                if low[node] == number[node]:
                    part = waiting[waiting.index(node):]
                    del waiting[-len(part):]
                    open_.difference_update(part)
                    found.update(part if len(part) > 1 else ())
            elif step not in number:
                number[step] = low[step] = len(number)
                waiting.append(step)
                open_.add(step)
                stack.append((step, iter(out.get(step, ()))))
            elif step in open_:
                low[node] = min(low[node], number[step])
    return sorted(found)


def _search_small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, src, dst), both arrays of strings -> (key, node)."""
    for batch in batches:
        keys, src, dst = batch.columns
        at, a, b = src.offsets.to_pylist(), src.values.to_pylist(), dst.values.to_pylist()
        nodes = [_circles(a[i:j], b[i:j]) for i, j in zip(at, at[1:])]
        rows = np.repeat(np.arange(len(nodes)), [len(n) for n in nodes])
        yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array([x for n in nodes for x in n], pa.string())], ["key", "node"])


def on_cycle_by(edges: DataFrame, key: str, most: int = SMALL) -> DataFrame:
    """``on_cycle`` for graphs that no edge leaves: edges (``key``, src, dst), src and dst strings; returns (``key``, node).

    The graph of a key of up to ``most`` edges is one row and is searched where it lies, so that many small graphs cost one pass; those of more go through ``on_cycle``.
    """
    edges = edges.select(key, "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL")
    large = durable(edges.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(F.col(key).alias("_key")), "large-graphs")
    is_large, some = F.col(key).eqNullSafe(F.col("_key")), not large.isEmpty()
    small = edges.join(large, is_large, "left_anti") if some else edges
    rows = small.groupBy(key).agg(F.collect_set(F.struct("src", "dst")).alias("e")).select(F.col(key).alias("key"), F.col("e.src").alias("src"), F.col("e.dst").alias("dst"))
    kind = edges.schema[key].dataType.simpleString()
    found = rows.mapInArrow(_search_small, f"key {kind}, node string").withColumnRenamed("key", key)
    if not some:
        return found
    node = lambda c: F.struct(F.col(key).alias("key"), F.col(c).alias("id"))
    rest = on_cycle(edges.join(large, is_large, "left_semi").select(node("src").alias("src"), node("dst").alias("dst")))
    return found.unionByName(rest.select(F.col("node.key").alias(key), F.col("node.id").alias("node")))


def effective_status(versions: DataFrame, deps: DataFrame) -> DataFrame:
    """committed only if the node is and everything upstream is; else stale (or its own status)."""
    bad = versions.where("status <> 'committed'").select("node")
    tainted = closure(deps.select(F.col("upstream").alias("src"), F.col("node").alias("dst")), bad).select("node").distinct()
    joined = versions.join(tainted.withColumn("tainted", F.lit(True)), "node", "left")
    status = F.when(F.col("status") != "committed", F.col("status")).when(F.col("tainted"), "stale").otherwise("committed")
    return joined.withColumn("effective", status).drop("tainted")


def conflict_counts(claims: DataFrame, keys: list[str]) -> DataFrame:
    """How many pairs of active claims of each thing contradict each other, and the first claim in one: from counts by polarity, not pairs."""
    by = claims.where("active").groupBy(*keys, "polarity").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    whole = by.groupBy(*keys).agg(F.sum("n").alias("all"), F.sum(F.col("n") * F.col("n")).alias("same"), F.min("id").alias("first"))
    pairs = ((F.col("all") * F.col("all") - F.col("same")) / 2).cast("long")
    return whole.select(*keys, pairs.alias("pairs"), "first").where("pairs > 0")


def latest_versions(log: DataFrame, key: str, order: Column) -> DataFrame:
    """The active row of each key in an append-only log."""
    return log.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))).where("_n = 1").drop("_n")


def pending(tasks: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Tasks without a recorded success."""
    return tasks.join(ledger.where("status = 'ok'"), key, "left_anti")
