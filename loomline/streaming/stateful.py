"""Order-dependent rules on a stream: rows wait in state until the watermark has passed them, then the rule runs over them in order of time."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


GROUPS = 512  # of keys: a group is one row of state and one call a batch, so calls do not grow with the keys; fixed for the life of a stream's checkpoint


def _waiting(waiting: list[list], chunks: Iterator[pd.DataFrame], mark: int) -> tuple[list[tuple], list[tuple]]:
    """(rows that no later one can precede, rows that still wait) as (time, id, key, tag), each in order of (time, id); rows behind the watermark are late and left out, as Spark itself does with those at it."""
    rows = list(zip(*waiting, strict=True))
    for chunk in chunks:
        new = zip(*(chunk[c].tolist() for c in ("t", "id", "name", "tag")), strict=True)
        rows += [r for r in new if r[0] >= mark]
    rows.sort(key=lambda r: r[:2])
    at = bisect_left(rows, mark, key=lambda r: r[0])
    return rows[:at], rows[at:]


def _columns(rows: list[tuple], n: int) -> tuple[list, ...]:
    return tuple(map(list, zip(*rows, strict=True))) if rows else ([],) * n


def _later(state: GroupState, t: int, mark: int) -> None:
    """Come back once the watermark has passed ``t`` microseconds."""
    state.setTimeoutTimestamp(max(t // 1000 + 1, mark // 1000 + 1))


def _run(stream: DataFrame, key: str, tag: Column, func, out: str, memory: str, groups: int) -> DataFrame:
    """``func`` over groups of keys, told apart by their text, which keeps nulls and long numbers as they are; a key's rows are all in one group."""
    rows = stream.select(F.pmod(F.xxhash64(key), F.lit(groups)).alias("_group"), F.col(key).cast("string").alias("name"), "id", F.unix_micros("ts").alias("t"), tag.alias("tag"), "ts")
    buffer = "times array<bigint>, ids array<bigint>, names array<string>, tags array<string>"
    told = rows.groupBy("_group").applyInPandasWithState(func, f"name string, {out}", f"{buffer}, {memory}", "append", GroupStateTimeout.EventTimeTimeout)
    return told.select(F.col("name").cast(stream.schema[key].dataType).alias(key), *(c for c in told.columns if c != "name"))


def stream_min_spacing(events: DataFrame, key: str, spacing: int, groups: int = GROUPS) -> DataFrame:
    """As the batch ``min_spacing`` for a stream (``key``, id, ts with a watermark): keep a row ``spacing`` microseconds or more after the last kept one.

    State by group of keys: the rows not yet behind the watermark and each key's last kept time. A key goes when the watermark is ``spacing`` past that time, a group when nothing waits
    and no key is left.
    """

    def step(name: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = max(0, state.getCurrentWatermarkMs()) * 1000
        *waiting, known, lasts = state.get if state.exists else ([],) * 6
        last = dict(zip(known, lasts, strict=True))
        ready, rest = _waiting(waiting, chunks, mark)
        kept = []
        for t, i, k, _ in ready:
            before = last.get(k)
            if before is None or t - before >= spacing:
                kept.append((k, i, t))
                last[k] = t
        last = {k: t for k, t in last.items() if mark < t + spacing}
        if rest or last:
            state.update((*_columns(rest, 4), list(last), list(last.values())))
            _later(state, rest[0][0] if rest else max(last.values()) + spacing, mark)
        elif state.exists:
            state.remove()
        if kept:
            yield pd.DataFrame(kept, columns=["name", "id", "t"])

    return _run(events, key, F.lit(""), step, "id long, t long", "known array<string>, lasts array<bigint>", groups)


def stream_stalls(events: DataFrame, key: str, tag: str, n: int, groups: int = GROUPS) -> DataFrame:
    """Keys whose ``tag`` stays the same for ``n`` rows in a row in order of time, once, with the id of the n-th row (W10): state by group of keys is the waiting rows, and each key's run (tag and length) and whether it was told."""

    def step(name: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = max(0, state.getCurrentWatermarkMs()) * 1000
        *waiting, known, tags, lengths, told = state.get if state.exists else ([],) * 8
        runs = dict(zip(known, zip(tags, lengths, told, strict=True), strict=True))
        ready, rest = _waiting(waiting, chunks, mark)
        found = []
        for _, i, k, g in ready:
            run, length, was_told = runs.get(k, (None, 0, False))
            length = length + 1 if g == run else 1
            if length >= n and not was_told:
                found.append((k, i))
                was_told = True
            runs[k] = g, length, was_told
        state.update((*_columns(rest, 4), list(runs), *_columns(list(runs.values()), 3)))
        if rest:
            _later(state, rest[0][0], mark)
        if found:
            yield pd.DataFrame(found, columns=["name", "stalled_at"])

    return _run(events, key, F.col(tag), step, "stalled_at long", "known array<string>, runs array<string>, lengths array<bigint>, told array<boolean>", groups)


def run_appended(stream: DataFrame, path: str) -> DataFrame:
    """Run a stream over all data there is, append what it tells to a table at ``path``, and return that table; a batch that is told twice after a failure is written once."""
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/result").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/result")
