"""Words and hashes of whole columns of text with numpy, a block of a few megabytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2_000_000
U64 = np.uint64
#: ASCII white space as `[\x20\x09-\x0D]`.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
SAME_CASE = np.arange(256, dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64): every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


_POS = mix(np.arange(1, 1025, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_FAR = U64(0xD6E8FEB86659FD93)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def blocks(off: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer row is a range of its own."""
    lo = 0
    while lo < len(off) - 1:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        yield lo, hi
        lo = hi


def span_hashes(values: np.ndarray, inside: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash the runs of ``inside`` cells that do not cross rows: hashes, starts, and run bounds by row."""
    if not len(values):
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    bounds = np.searchsorted(starts, off)
    if not len(starts):
        return np.zeros(0, U64), starts, bounds
    run = np.cumsum(first) - 1
    at = np.arange(len(values)) - starts[np.maximum(run, 0)]
    with np.errstate(over="ignore"):
        part = (values.astype(U64) + U64(1)) * (_POS[at & 1023] + (at >> 10).astype(U64) * _FAR)
        part *= inside
        hashes = np.add.reduceat(part, starts)
        hashes += np.add.reduceat(inside, starts, dtype=np.int64).astype(U64) * U64(0x9E3779B97F4A7C15)
    return mix(hashes), starts, bounds


def word_hashes(data: np.ndarray, off: np.ndarray, fold: np.ndarray = ASCII_LOWER) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the white-space separated words, and the bounds of each row's words."""
    hashes, _, bounds = span_hashes(fold[data], ~IS_SPACE[data], off)
    return hashes, bounds


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct hashes of ``k`` consecutive words; shorter texts are one shingle."""
    words, bounds = word_hashes(data, off)
    mult = mix(np.arange(11, 11 + k, dtype=U64)) | U64(1)
    with np.errstate(over="ignore"):
        if len(words) >= k:
            rolled = words[: len(words) - k + 1] * mult[0]
            for j in range(1, k):
                rolled = rolled + words[j : len(words) - k + 1 + j] * mult[j]
            rolled = mix(rolled)
        else:
            rolled = np.zeros(0, U64)
        sets = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= k:
                sets.append(np.unique(rolled[a : b - k + 1]))
            elif b > a:
                short = (words[a:b] * mult[: b - a]).sum(dtype=U64) + U64(int(b - a)) * _FAR
                sets.append(mix(np.array([short], U64)))
            else:
                sets.append(np.zeros(0, U64))
    return sets


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column of numpy arrays."""
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat, kind))


#: Code points below LETTERS_TOP that are letters, and their one-character lower case.
LETTERS_TOP = 0x33000
_TABLES: list[np.ndarray] = []


def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """(is a letter, lower case) by code point, built once for each worker; larger code points are not letters."""
    if not _TABLES:
        chars = [chr(c) for c in range(LETTERS_TOP)]
        _TABLES.append(np.array([c.isalpha() for c in chars]))
        low = (c.lower() for c in chars)
        _TABLES.append(np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(low)], np.uint32))
    return _TABLES[0], _TABLES[1]


def code_points(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of UTF-8 rows and each row's offsets in them."""
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32), heads[off]


def letter_words(data: np.ndarray, off: np.ndarray, digits: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of letters (and ASCII digits if asked), lower-cased: hashes, first cells, lengths, bounds by row, and the cells."""
    cells, at = code_points(data, off)
    letter, lower = letter_tables()
    small = np.minimum(cells, LETTERS_TOP - 1)
    inside = letter[small] & (cells < LETTERS_TOP)
    if digits:
        inside |= (cells >= 48) & (cells < 58)
    cells = np.where(inside, lower[small], cells)
    hashes, starts, bounds = span_hashes(cells, inside, at)
    lengths = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    return hashes, starts, lengths, bounds, cells


def padded(cells: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans laid end to end, each between two border cells: cells, starts, lengths."""
    wide = lengths + 2
    at = np.zeros(len(wide), np.int64)
    np.cumsum(wide[:-1], out=at[1:])
    out = np.full(int(wide.sum()), 7, np.uint64)
    source = np.repeat(starts - at - 1, wide) + np.arange(len(out))
    inner = np.ones(len(out), bool)
    inner[at], inner[at + wide - 1] = False, False
    out[inner] = cells[source[inner]].astype(np.uint64) + U64(11)
    return out, at, wide


def gram_buckets(cells: np.ndarray, at: np.ndarray, wide: np.ndarray, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all n-grams of padded spans (n at most a span's width), and each one's span."""
    if len(cells) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(cells) - n + 1, n, U64)
        for j in range(n):
            h = h * U64(0x100000001B3) + cells[j : len(cells) - n + 1 + j] * _POS[j]
        h = mix(h)
    span = np.repeat(np.arange(len(at)), wide)[: len(h)]
    inside = np.arange(len(h)) + n <= (at + wide)[span]
    return (h[inside] % U64(buckets)).astype(np.int64), span[inside]
