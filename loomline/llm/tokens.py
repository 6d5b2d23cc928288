"""Token counts by a finite-state tokenizer: a transducer over bytes whose transitions emit token counts; maps of chunks compose by a scan."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.textblocks import utf8

#: Unicode White_Space, as the pre-tokenizer's \s.
WS = r"\t-\r \x85\xa0  -     　"
#: The byte-level pre-tokenizer's pattern.
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WS}\p{{L}}\p{{N}}]+|[{WS}]+(?![^{WS}])|[{WS}]+")
SYNC = re.compile(rf"(?<=[^{WS}])(?=[{WS}])")
PLAIN = re.compile(rf"[{WS}] |[\x85\xa0  -     　]")
IS_WS = re.compile(rf"[{WS}]").match
MAX_STATES, MAX_UNITS = 400_000, 800_000  # of a worker's tables, which are compiled anew beyond
CHUNK, LONG, FAN = 1 << 16, 1 << 20, 64  # characters of a chunk; bytes of a text that is cut into rows; chunk maps composed at a time


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 is itself, the rest follow from 256."""
    same = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(same)]
    return {chr(b): b for b in same} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    """A deterministic transducer over the bytes of one pre-token, compiled as inputs need it.

    A merge encoding is valid exactly if each adjacent pair of tokens is, hence the encoding of a prefix ends in the one
    token that fits the last token of the place where it starts. What follows depends only on the places where a token may still be
    open: a state is, for each suffix of the input that some token goes on from, that suffix, the last token before it, and
    how many tokens the encoding has since then. These are finitely many, whatever the input's length. A transition appends
    a byte and emits the change of the number of tokens, which may be negative. States beyond ``MAX_STATES`` are dropped
    all at once between two inputs and compiled anew when needed.
    """

    def __init__(self, vocab: dict[str, int], merges: list) -> None:
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in merges)
        self.rank = {(as_bytes(a), as_bytes(b)): i for i, (a, b) in enumerate(pairs)}
        tokens = [as_bytes(t) for t in vocab if all(c in letters for c in t)]
        self.stable = {t: None for t in tokens}
        self.open = {t[:i] for t in tokens for i in range(1, len(t))}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ((b"", b"", 0),)
        self.states, self.number = [start], {start: 0}
        self.go: dict[int, int] = {}  # state and byte -> next state and emitted count + 128

    def merge(self, word: bytes) -> list[bytes]:
        """The encoding of a short byte string by its merges in order of rank."""
        parts = [word[i : i + 1] for i in range(len(word))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), 1 << 30), i))
            pair = (parts[best], parts[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def is_token(self, t: bytes) -> bool:
        known = self.stable.get(t, False)
        if known is None:
            known = self.stable[t] = self.merge(t) == [t]
        return known

    def pair_fits(self, a: bytes, b: bytes) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) > MAX_UNITS:
                self.fits.clear()
            known = self.fits[a, b] = self.merge(a + b) == [a, b]
        return known

    def step(self, state: int, byte: int) -> int:
        """Compile the transition from ``state`` on ``byte``: the next state, and what it emits."""
        end, places = bytes([byte]), self.states[state]
        for suffix, last, since in places:
            token = suffix + end
            if token in self.stable and self.is_token(token) and (not last or self.pair_fits(last, token)):
                break
        emitted = since + 1
        after = (*((s + end, t, n - emitted) for s, t, n in places if s + end in self.open), (b"", token, 0))
        to = self.number.get(after)
        if to is None:
            to = self.number[after] = len(self.states)
            self.states.append(after)
        self.go[state << 8 | byte] = to << 8 | emitted + 128
        return to << 8 | emitted + 128

    def count(self, word: bytes) -> int:
        """The sum of what the transitions over ``word`` emit."""
        if len(self.states) > MAX_STATES:
            self.reset()
        state, total, go = 0, 0, self.go
        for byte in word:
            arc = go.get(state << 8 | byte)
            if arc is None:
                arc = self.step(state, byte)
            state = arc >> 8
            total += (arc & 255) - 128
        return total


class Counter:
    """Token counts of texts; chunk maps of long texts are composed by a prefix scan."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.transducer = Transducer(spec["model"]["vocab"], spec["model"]["merges"])
        special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.units: dict[str, int] = {}

    def unit(self, text: str) -> int:
        """Tokens of a text that starts and ends at synchronising places."""
        n = self.units.get(text)
        if n is None:
            if len(self.units) >= MAX_UNITS:
                self.units.clear()
            n = sum(self.transducer.count(p.encode("utf-8", "surrogatepass")) for p in PIECE.findall(text))
            if len(text) <= 64:
                self.units[text] = n
        return n

    def closed(self, text: str) -> int:
        """Tokens of a closed stretch: no pre-token spans a place where white space follows other characters."""
        if not text:
            return 0
        if PLAIN.search(text):
            return sum(map(self.unit, SYNC.split(text)))
        first, *rest = text.split(" ")
        n, get, unit = self.unit(first) if first else 0, self.units.get, self.unit
        for word in rest:
            key = " " + word
            k = get(key)
            n += unit(key) if k is None else k
        return n

    def chunk_map(self, chunk: str) -> tuple:
        """A chunk as a map of states: what is pending before it -> (tokens, what is pending after it).

        Between two pre-tokens every state is the start, so a chunk that synchronises maps a pending text p to
        (tokens of p + head, plus ``tokens``; tail), written (head, tokens, tail); one that does not maps p to (0, p + head), written (head, None).
        """
        first = SYNC.search(chunk)
        if first is None:
            return chunk, None
        lo, hi = first.start(), len(chunk) - 1
        while not IS_WS(chunk[hi]) or IS_WS(chunk[hi - 1]):
            hi -= 1
        return chunk[:lo], self.closed(chunk[lo:hi]), chunk[hi:]

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of two adjacent stretches; associative, so any bracketing of a scan agrees."""
        if a[1] is None and b[1] is None:
            return a[0] + b[0], None
        if a[1] is None:
            return a[0] + b[0], b[1], b[2]
        if b[1] is None:
            return a[0], a[1], a[2] + b[0]
        return a[0], a[1] + self.closed(a[2] + b[0]) + b[1], b[2]

    def scan(self, maps: list[tuple]) -> tuple:
        """The composition of adjacent maps, pair by pair."""
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return maps[0]

    def finish(self, whole: tuple) -> int:
        """Tokens of a text from its map: nothing is pending before it, and what is pending after it ends."""
        return self.closed(whole[0]) + (whole[1] + self.closed(whole[2]) if whole[1] is not None else 0)

    def plain(self, text: str, chunk: int = CHUNK) -> int:
        if len(text) <= chunk:
            return self.closed(text)
        return self.finish(self.scan([self.chunk_map(text[i : i + chunk]) for i in range(0, len(text), chunk)]))

    def stretches(self, text: str) -> list[str]:
        """The text between special strings, which are one token each, as the library's default has it."""
        return [text] if self.special is None or "<" not in text else self.special.split(text)

    def __call__(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text."""
        parts = self.stretches(text)
        return sum(self.plain(p, chunk) for p in parts) + len(parts) - 1


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            data, off = utf8(batch.column(1))
            raw = data.tobytes()
            n = [count(raw[a:b].decode("utf-8", "replace")) for a, b in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(off[1:] - off[:-1], pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"]
            )

    return run


MAPS = "row long, stretch long, seq long, head string, n long, tail string"


def _cut(path: str, chunk: int):
    """(row, id, text) of long texts -> a row for each chunk of each stretch between special strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for k, part in enumerate(count.stretches(text)):
                    for lo in range(0, max(1, len(part)), chunk * FAN):
                        piece = [part[i : i + chunk] for i in range(lo, min(len(part), lo + chunk * FAN), chunk)] or [""]
                        n, seq = len(piece), lo // chunk
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row] * n), pa.array([k] * n), pa.array(range(seq, seq + n), pa.int64()), pa.array(piece, pa.string())], ["row", "stretch", "seq", "chunk"]
                        )

    return run


def _map_chunks(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            maps = [count.chunk_map(c) for c in batch.column(3).to_pylist()]
            ends = [pa.array([m[0] for m in maps], pa.string()), pa.array([m[1] for m in maps], pa.int64()), pa.array([m[2] if m[1] is not None else None for m in maps], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *ends], ["row", "stretch", "seq", "head", "n", "tail"])

    return run


def _compose(path: str):
    """(row, stretch, seq, maps) -> the composition of the maps in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            out = []
            for maps in batch.column(3).to_pylist():
                parts = [(m["head"], m["n"], m["tail"]) if m["n"] is not None else (m["head"], None) for m in sorted(maps, key=lambda m: m["seq"])]
                out.append((*count.scan(parts), None)[:3])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True))], [x.split()[0] for x in MAPS.split(", ")])

    return run


def _finish(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            maps = zip(*(batch.column(i).to_pylist() for i in (3, 4, 5)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([count.finish(m) for m in maps], pa.int64())], ["row", "stretch", "n"])

    return run


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, long: int = LONG) -> DataFrame:
    """Bytes and tokens of every whole text under the byte-level BPE vocabulary at ``path``.

    A map over rows, without a shuffle. A text of more than ``long`` bytes is cut into rows of ``chunk`` characters that any task maps; the maps
    are composed in groups of FAN, and these groups once more, so that one very long text is many tasks. Null and empty texts have 0 bytes and tokens; ids may be null or repeat;
    an empty table gives no rows; other columns are ignored.
    """
    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = table.schema["id"].dataType.simpleString()
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    short = table.where(size <= long).mapInArrow(_count(path), f"id {kind}, n_bytes long, n_tokens long")
    whole = table.where(size > long).withColumn("row", F.monotonically_increasing_id())
    chunks = whole.select("row", "id", "text").mapInArrow(_cut(path, chunk), "row long, stretch long, seq long, chunk string").repartition("row", "stretch", "seq")
    maps = chunks.mapInArrow(_map_chunks(path), MAPS)
    for _ in range(2):
        grouped = maps.groupBy("row", "stretch", F.floor(F.col("seq") / FAN).alias("at")).agg(F.collect_list(F.struct("seq", "head", "n", "tail")).alias("maps"))
        maps = grouped.mapInArrow(_compose(path), MAPS)
    top = maps.groupBy("row", "stretch", F.lit(0).cast("long").alias("at")).agg(F.collect_list(F.struct("seq", "head", "n", "tail")).alias("maps")).mapInArrow(_compose(path), MAPS)
    counts = top.mapInArrow(_finish(path), "row long, stretch long, n long").groupBy("row").agg((F.sum("n") + F.count(F.lit(1)) - 1).alias("n_tokens"))
    sizes = whole.select("row", "id", F.octet_length("text").cast("long").alias("n_bytes"))
    return short.unionByName(sizes.join(counts, "row").select("id", "n_bytes", "n_tokens")).withColumnRenamed("id", id_col)
