"""Sharding on a consistent-hash ring with virtual nodes and bounded loads."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.scratch import durable, in_order

RING = 1 << 14  # places on the ring; fixed, so the plan's size does not depend on the data


def ring_owners(shards: int, vnodes: int) -> list[int]:
    """The shard that owns each ring place: that of the first virtual node at or after it, clockwise.

    A shard's virtual nodes depend on its own number only, so one more shard moves only the
    places that its own nodes take.
    """
    node: dict[int, tuple[bytes, int]] = {}
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.sha256(f"{shard}/{v}".encode()).digest()
            place = int.from_bytes(digest[:8], "big") % RING
            node[place] = min(node.get(place, (digest, shard)), (digest, shard))
    places = sorted(node)
    owners, k = [], 0
    for place in range(RING):
        while k < len(places) and places[k] < place:
            k += 1
        owners.append(node[places[k % len(places)]][1])
    return owners


def load_plan(counts: dict[int, int], shards: int, vnodes: int) -> list[tuple[int, int, int, int, int]]:
    """Cut each place's keys into runs (place, lo, hi, shard, first slot) under the load bounds.

    The bounds add up to the number of keys: every shard gets n // shards, and the n % shards
    shards with most keys of their own get one more. Each shard first takes keys of its own
    places, clockwise; keys that find it full continue clockwise to the next shard with room.
    """
    owners = ring_owners(shards, vnodes)
    own = [0] * shards
    for place, n in counts.items():
        own[owners[place]] += n
    total = sum(counts.values())
    room = [total // shards] * shards
    for shard in sorted(range(shards), key=lambda s: (-own[s], s))[: total % shards]:
        room[shard] += 1
    used, runs, over = [0] * shards, [], []

    def take(place: int, lo: int, most: int, shard: int) -> int:
        n = min(most, room[shard] - used[shard])
        if n:
            runs.append((place, lo, lo + n, shard, used[shard]))
            used[shard] += n
        return n

    for place in sorted(counts):
        got = take(place, 0, counts[place], owners[place])
        if got < counts[place]:
            over.append((place, got))
    for place, lo in over:
        at = place
        while lo < counts[place]:
            lo += take(place, lo, counts[place] - lo, owners[at % RING])
            at += 1
    return runs


def shard_documents(docs: DataFrame, shards: int = 24, vnodes: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put every row of ``docs`` into one of ``shards`` shards whose row counts differ by one at most.

    A document's place on the ring is the hash of its text, so equal texts share a place and
    stay together as far as the bounds allow; a group larger than a shard continues clockwise.
    Only the number of keys at each of the fixed ring places reaches the driver. Returns ``id_col``, size
    (UTF-8 bytes plus 8), text_crc32, shard and slot (0, 1, ... in each shard).

    Null text counts as empty (size 8, crc 0); null ids are placed like others; repeated rows
    each get a slot; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keys = durable(
        docs.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("mark"),
        )
        .withColumn("place", F.pmod("mark", F.lit(RING)).cast("int"))
        .withColumn("turn", F.xxhash64("id")),
        "shard-keys",
    )
    counts = {r.place: r.n for r in keys.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, starts, at = load_plan(counts, shards, vnodes), {}, 0
    for place in sorted(counts):
        starts[place] = at
        at += counts[place]
    plan = docs.sparkSession.createDataFrame(
        [(p, starts[p] + lo, starts[p] + hi, s, first) for p, lo, hi, s, first in runs],
        "place int, lo long, hi long, shard int, first long",
    )
    ranked = in_order(keys, [F.col(c) for c in ("place", "mark", "turn", "id", "size")], "shard-order")
    return (
        ranked.join(F.broadcast(plan), "place")
        .where((F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("hi")))
        .select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("pos") - F.col("lo")).alias("slot"))
    )
