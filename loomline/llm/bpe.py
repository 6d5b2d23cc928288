"""Byte-level BPE: merges by a priority queue over a doubly linked list of symbols, decoding by vocabulary strings."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.textblocks import utf8
from loomline.llm.tokens import PIECE, PLAIN, SYNC, byte_letters

MAX_UNITS, MAX_UNIT = 500_000, 64  # encodings of each of the two generations that a worker remembers, and the characters of the longest one
ROWS = 256  # documents of an Arrow batch of ids


class Codec:
    """Encoder and decoder of a byte-level vocabulary; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters, added = spec["model"]["vocab"], byte_letters(), spec.get("added_tokens", [])
        self.size = 1 + max(vocab.values())
        self.first = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        self.merges: dict[int, tuple[int, int]] = {}  # left id * size + right id -> rank, merged id
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[a] * self.size + vocab[b], (rank, vocab[a + b]))
        self.bytes_of = {i: bytes(letters[c] for c in t) if all(c in letters for c in t) else t.encode() for t, i in vocab.items()}
        self.bytes_of |= {t["id"]: t["content"].encode() for t in added}
        self.special = {t["content"]: t["id"].to_bytes(4, "little") for t in added}
        strings = sorted(self.special, key=len, reverse=True)
        self.split = re.compile(f"({'|'.join(map(re.escape, strings))})").split if strings else None
        self.four = [i.to_bytes(4, "little") for i in range(max(self.bytes_of) + 1)]
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, word: bytes) -> list[int]:
        """The ids of one pre-token: the pair of lowest rank, leftmost first, merges until none can.

        Symbols form a doubly linked list; the queue holds rank and place of each pair that can merge. An entry whose pair has changed since is stale and skipped.
        """
        merges, size, n = self.merges, self.size, len(word)
        symbol = [self.first[b] for b in word]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            m = merges.get(symbol[i] * size + symbol[i + 1])
            if m:
                queue.append(m[0] << 32 | i)
        heapify(queue)
        while queue:
            entry = heappop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j == n:
                continue
            m = merges.get(symbol[i] * size + symbol[j])
            if m is None or m[0] != entry >> 32:
                continue
            symbol[i], symbol[j] = m[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = merges.get(symbol[i] * size + symbol[k])
                if m:
                    heappush(queue, m[0] << 32 | i)
            h = before[i]
            if h >= 0:
                m = merges.get(symbol[h] * size + symbol[i])
                if m:
                    heappush(queue, m[0] << 32 | h)
        return [s for s in symbol if s >= 0]

    def known(self, text: str) -> bytes | None:
        """The remembered ids of a stretch. Of two generations the old one goes when the young one is full, so what keeps coming stays."""
        ids = self.young.get(text)
        if ids is None:
            ids = self.old.get(text)
            if ids is not None:
                self.keep(text, ids)
        return ids

    def keep(self, text: str, ids: bytes) -> bytes:
        if len(text) <= MAX_UNIT:
            if len(self.young) >= MAX_UNITS:
                self.old, self.young = self.young, {}
            self.young[text] = ids
        return ids

    def unit(self, text: str) -> bytes:
        """The ids of a stretch that no pre-token leaves, which is remembered, as are its pre-tokens."""
        ids = self.known(text)
        if ids is None:
            pieces, four = PIECE.findall(text), self.four
            if len(pieces) == 1:
                ids = self.keep(text, b"".join([four[i] for i in self.merge(text.encode("utf-8", "surrogatepass"))]))
            else:
                ids = self.keep(text, b"".join([self.unit(p) for p in pieces]))
        return ids

    def plain(self, text: str) -> list[bytes]:
        """The ids of a text without special strings, a stretch each; none spans a place where white space follows another character."""
        if not text:
            return []
        units = SYNC.split(text) if PLAIN.search(text) else [(" " if i else "") + w for i, w in enumerate(text.split(" "))]
        out = []
        for u in units:
            ids = self.young.get(u)
            out.append(self.unit(u) if ids is None else ids)
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a whole text; a special string is its one id, as the library's default has it."""
        if self.split is None:
            return b"".join(self.plain(text))
        parts = self.split(text) if "<" in text or any("<" not in s for s in self.special) else [text]
        return b"".join(b"".join(self.plain(p)) if i % 2 == 0 else self.special[p] for i, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        """The vocabulary strings of the ids joined; bytes that are not UTF-8 become replacement characters. An unknown id stands for nothing, as in the library."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = codec(path).encode
        for batch in batches:
            data, off = utf8(batch.column(1))
            for lo in range(0, batch.num_rows, ROWS):
                at = off[lo : lo + ROWS + 1]
                ids = [encode(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, ROWS), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["id", "ids", "n_tokens"])

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path).decode
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                texts = [decode(x or b"") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["id", "ids", "n_tokens", "text"])

    return run


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``ids`` (little-endian unsigned 32-bit integers as binary) and n_tokens of every whole text, without added special tokens, truncation or padding.

    A map over rows, without a shuffle; a worker's memory is bounded by its longest text and MAX_UNITS remembered stretches. Null and empty texts have no ids;
    row ids may be null or repeat; an empty table gives no rows; other columns are ignored.
    """
    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return table.mapInArrow(_encode(path), f"id {table.schema['id'].dataType.simpleString()}, ids binary, n_tokens long")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """Add ``text``, the decoded ids, to the rows of ``encode_documents``; null and empty ids give an empty text."""
    return encoded.select("id", "ids", "n_tokens").mapInArrow(_decode(path), f"id {encoded.schema['id'].dataType.simpleString()}, ids binary, n_tokens long, text string")
