"""Near-duplicate groups: fast similarity sketches, banding, exact verification."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.components import connected_components
from loomline.llm.scratch import durable, may_match
from loomline.llm.textblocks import U64, blocks, list_array, mix, shingle_sets, utf8

BLOCK = 256  # texts on each side of a verification task
EMPTY = np.iinfo(np.uint64).max


def banding(percent: int, miss: float = 1e-6, most: int = 48) -> tuple[int, int]:
    """(bands, rows): the longest bands whose chance to miss a pair at the threshold is below ``miss``."""
    s, found = percent / 100, (1, 1)
    for rows in range(1, 17):
        bands = max(1, math.ceil(math.log(miss) / math.log(1 - min(s, 1 - 1e-9) ** rows)))
        if bands <= most:
            found = (bands, rows)
    return found


def fast_sketch(values: np.ndarray, row: np.ndarray, n_rows: int, t: int) -> np.ndarray:
    """Fast similarity sketches (rows x t) of the sets in ``values`` (row numbers ascending).

    In round i < t every element is thrown into one of t bins by a hash of its own; in round
    t + j every element goes to bin j, so after 2t rounds no bin of a set with elements is empty.
    A bin keeps the smallest (round, hash), and a set stops once all its bins are filled: after
    about t ln t / |set| rounds. Bins of two sets agree with the probability of their Jaccard
    similarity, concentrated as for independent draws or better.
    """
    out = np.full((n_rows, t), EMPTY, U64)
    flat = out.reshape(-1)
    for i in range(2 * t):
        if not len(values):
            break
        with np.errstate(over="ignore"):
            h = mix(values ^ mix(np.array([i + 1], U64) * U64(0xA0761D6478BD642F)))
        bins = ((h >> U64(32)) * U64(t) >> U64(32)).astype(np.int64) if i < t else np.full(len(values), i - t)
        np.minimum.at(flat, row * t + bins, (U64(i) << U64(32)) | (h & U64(0xFFFFFFFF)))
        if i < 4 or i % 4 == 0 or i >= t:
            live = (out == EMPTY).any(axis=1)
            keep = live[row]
            if not keep.all():
                values, row = values[keep], row[keep]
    return out


def _sketches(k: int, bands: int, rows: int):
    width = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(101, 101 + bands * rows, dtype=U64)).reshape(bands, rows) | U64(1)
        for batch in batches:
            data, off = utf8(batch.column(1))
            for lo, hi in blocks(off):
                sets = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                if len(full):
                    values = np.concatenate([sets[i] for i in full])
                    sketch = fast_sketch(values, np.repeat(np.arange(len(full)), sizes[full]), len(full), width)
                    with np.errstate(over="ignore"):
                        keys = mix((mix(sketch.reshape(-1, bands, rows)) * salt).sum(axis=2, dtype=U64) + salt[:, 0])
                    keys = iter(keys.view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        pa.array(sizes, pa.int64()),
                        pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        list_array([next(keys) if n else np.zeros(0, np.int64) for n in sizes], pa.int64()),
                        batch.column(2).slice(lo, hi - lo),
                    ],
                    ["id", "n", "cls", "bands", "mark"],
                )

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(batch.schema.get_field_index("text")))
            rest = batch.drop_columns(["text"])
            for lo, hi in blocks(off):
                sets = shingle_sets(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], k)
                part = rest.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, list_array([s.view(np.int64) for s in sets], pa.int64())], [*part.schema.names, "shingles"])

    return run


def linked(sets: list[np.ndarray], side: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 x intersection >= percent x union.

    ``side``: pairs inside one side are left out when there are two sides.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    values, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(n), sizes)
    keep = count[at] > 1
    column = np.cumsum(count > 1) - 1
    row, at = row[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    common = np.zeros((n, n), np.float32)
    step = 4096
    for lo in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        a, b = np.searchsorted(at, [lo, lo + step])
        m = np.zeros((n, min(step, int(at[-1]) + 1 - lo)), np.float32)
        m[row[a:b], at[a:b] - lo] = 1
        common += m @ m.T
    both = sizes[:, None] + sizes[None, :] - common
    good = np.triu(100 * common.astype(np.float64) >= percent * both, 1)
    if len(set(side.tolist())) == 2:
        good &= side[:, None] != side[None, :]
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i, j in np.argwhere(good).tolist():
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((i, j))
    return found


def _verify(percent: int):
    """Rows (task, side, id, shingles) sorted by task -> linked ids; holds one task's rows at a time."""

    def links(ids: list, side: list, sets: list) -> list[tuple[int, int]]:
        if len(ids) < 2:
            return []
        return [(ids[i], ids[j]) for i, j in linked(sets, np.array(side), percent)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, ids, side, sets, out = None, [], [], [], []
        for batch in batches:
            tasks, sides, keys = (batch.column(i).to_pylist() for i in range(3))
            lists = batch.column(3)
            flat, off = lists.values.to_numpy(), lists.offsets.to_numpy()
            for i, t in enumerate(tasks):
                if t != task:
                    out += links(ids, side, sets)
                    task, ids, side, sets = t, [], [], []
                ids.append(keys[i])
                side.append(sides[i])
                sets.append(flat[off[i] : off[i + 1]].copy())
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])
                out = []
        out += links(ids, side, sets)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def _links(tasks: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) found by comparing the rows (task, side, id, shingles) of each task."""
    rows = tasks.select("task", "side", "id", "shingles").repartition("task").sortWithinPartitions("task")
    return rows.mapInArrow(_verify(percent), "a long, b long")


def _parts(df: DataFrame, of: list[str]) -> DataFrame:
    """Each group's number of blocks of about BLOCK rows."""
    return df.groupBy(*of).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))


def _large_links(sets: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links inside clusters of more than BLOCK classes; ``sets``: (id, component, level, shingles).

    First every class is compared with one hub only, the one it shares most bands with: n comparisons for n near
    copies. What is linked to a hub is settled among itself. Then only classes that share a band with a class of another
    group go on, in blocks of a group and a size level; blocks of one large group are not compared with each other.
    """
    ids = sets.select("id", "component", "level")
    mine = classes.join(ids.select(F.col("id").alias("rep")), "rep", "left_semi")  # a band's classes are all in one cluster
    keys = durable(mine.select("rep", F.explode("bands").alias("key")), "dup-keys")
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"))
    shared = keys.join(hubs, "key").where("rep <> hub").groupBy(F.col("rep").alias("id"), "hub").agg(F.count(F.lit(1)).alias("bands"))
    star = shared.groupBy("id").agg(F.max(F.struct("bands", (-F.col("hub")).alias("k"))).alias("b")).select("id", (-F.col("b.k")).alias("hub"))
    star = durable(star, "dup-star")
    parts = _parts(star, ["hub"])
    name = lambda part: F.concat_ws("/", F.col("hub").cast("string"), part.cast("string"))
    ends = star.join(parts, "hub").select("id", name(F.pmod(F.xxhash64("id"), F.col("parts"))).alias("task"), F.lit("m").alias("side"))
    heads = parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("hub").alias("id"), name(F.col("part")).alias("task"), F.lit("h").alias("side"))
    first = durable(_links(sets.join(ends.unionByName(heads), "id"), percent), "dup-star-links")

    groups = connected_components(first, "dup-groups").select(F.col("node").alias("id"), F.col("component").alias("group"))
    named = durable(ids.join(groups, "id", "left").withColumn("group", F.coalesce("group", "id")), "dup-named")
    keyed = keys.join(named.select(F.col("id").alias("rep"), "group"), "rep")
    mixed = keyed.groupBy("key").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("key")
    left = named.join(keyed.join(mixed, "key", "left_semi").select(F.col("rep").alias("id")).distinct(), "id", "left_semi")
    left = durable(left, "dup-left")
    wide = left.groupBy("component", "group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= BLOCK).drop("n").withColumn("label", F.col("group").cast("string"))
    left = left.join(wide, ["component", "group"], "left").withColumn("label", F.coalesce("label", F.lit("all")))  # all: small groups together
    sides = _parts(left, ["component", "label", "level"])
    shape = sides.groupBy("component").agg(F.collect_list(F.struct("label", "level", "parts")).alias("sides"))
    side = lambda label, level, part: F.concat_ws(".", label, level.cast("string"), part.cast("string"))
    own = side(F.col("label"), F.col("level"), F.pmod(F.xxhash64("id"), F.col("parts")))
    placed = left.join(sides, ["component", "label", "level"]).select("id", "component", "label", "level", own.alias("side"))
    near = lambda x: (F.abs(x["level"] - F.col("level")) <= 1) & ((x["label"] != F.col("label")) | (x["label"] == "all"))
    every = lambda x: F.transform(F.sequence(F.lit(0), x["parts"] - 1), lambda j: side(x["label"], x["level"], j))
    partners = F.flatten(F.transform(F.filter("sides", near), every))
    dealt = placed.join(shape, "component").select("id", "component", "side", F.explode(partners).alias("partner"))
    task = F.concat_ws("/", F.col("component").cast("string"), F.least("side", "partner"), F.greatest("side", "partner"))
    return first.unionByName(_links(sets.select("id", "shingles").join(dealt.select("id", "side", task.alias("task")), "id"), percent))


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The near-duplicate component of every document.

    Two texts are linked if their sets of ``shingle``-word shingles (ASCII-lower-cased words between
    white space; a shorter text is one shingle) have 100 x intersection >= ``percent`` x union. Equal
    sets form one class, represented by its smallest id, so copies never pair up. Classes that
    share a band of their sketches form candidate clusters. The full sets of a cluster of up to BLOCK classes are
    compared in one task; in larger ones hubs are verified first, and only classes in a band with another group go on, in tasks of
    at most two blocks of about BLOCK classes: clusters of any size are checked
    whole, only blocks whose sizes rule out a link are skipped, and each task sends on a spanning
    forest of its links, not the pairs.

    Returns ``id_col``, n_shingles, component_id (smallest id reachable), kept (id equals
    component_id) and text_hash (xxhash64 of the row's text, which tells rows of one id apart). Null and empty texts have no shingles, link with nothing and are kept; rows of
    one id count as one document in the links; a row with a null id keeps a null
    component_id and is kept; an empty table gives no rows; other columns are ignored.
    """
    bands, rows = banding(percent)
    table = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    marked = table.withColumn("mark", F.xxhash64("text"))
    sketches = durable(marked.mapInArrow(_sketches(shingle, bands, rows), "id long, n long, cls binary, bands array<long>, mark long"), "dup-sketches")
    classes = durable(
        sketches.where("n > 0 and id is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "dup-classes"
    )
    keys = classes.select("rep", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub <> top")
    candidates = keys.join(hubs.select("key", "hub"), "key").where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    clusters = connected_components(candidates, "dup-candidates")

    size_step = math.log(100 / min(percent, 99))
    members = clusters.join(classes.groupBy(F.col("rep").alias("node")).agg(F.max("n").alias("n")), "node")
    members = durable(members.withColumn("level", F.floor(F.log(F.col("n").cast("double")) / size_step).cast("int")), "dup-members")
    total = members.groupBy("component").agg(F.count(F.lit(1)).alias("total"))
    placed = members.join(total, "component").select(F.col("node").alias("id"), "component", "total", "level")
    asked = may_match(table, F.col("id"), members, "node").where("may_match").drop("may_match")  # most texts are in no cluster and stay where they are
    sets = placed.hint("merge").join(asked, "id").select("id", "component", "total", "level", "text")
    sets = durable(sets.mapInArrow(_sets(shingle), "id long, component long, total long, level int, shingles array<long>"), "dup-sets")
    links = _links(sets.where(F.col("total") <= BLOCK).select(F.col("component").cast("string").alias("task"), F.lit("").alias("side"), "id", "shingles"), percent)
    large = sets.where(F.col("total") > BLOCK).select("id", "component", "level", "shingles")
    if not large.isEmpty():
        links = links.unionByName(_large_links(large, classes, percent))
    groups = connected_components(links, "dup-links")
    named = classes.select("cls", "rep").join(groups, F.col("rep") == F.col("node"), "left").select("cls", F.coalesce("component", "rep").alias("component"))
    return sketches.join(named, "cls", "left").select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "id") == F.col("id"), F.lit(True)).alias("kept"),
        F.col("mark").alias("text_hash"),
    )
