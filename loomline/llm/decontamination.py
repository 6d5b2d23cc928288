"""Benchmark decontamination: latent semantic candidates, then common-subsequence and answer checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.scratch import durable, in_order
from loomline.llm.textblocks import blocks, letter_words, list_array, utf8

LISTED = 4  # one part in so many of the words needed of a copied passage must be listed ones, its rarest
PASSAGE = 128  # words of a benchmark passage at most; longer items are cut into even parts
ALIGNED, SHORT = 7, 4  # words aligned at least; items of fewer count as an unbroken run of all their words, below SHORT not at all
PASSAGES = 1000  # benchmark passages that share a latent space
TOGETHER = 4  # latent spaces searched in one pass over the documents
SHARED_RANK = 8  # passages to a latent dimension at most, where that is more than the rank asked for
ANSWER = 5  # one part in so many of a passage's words, the rarest, three at least, stands for its answer
STEP = 8  # words of the finest grid of windows
LIKENESS = 0.35  # share of a passage's latent weight that a candidate window holds at least
WEIGHT = 0.4  # share of a passage's idf that an aligned paraphrase holds at least
ROWS = 4096  # windows compared with all passages of a space at a time


@dataclass
class Index:
    """The passages of one block in their latent space. PASSAGES x PASSAGE words bound its size, however long the items."""

    local: np.ndarray  # this block's word number for each word of the whole benchmark, -1 for those of other blocks
    idf: np.ndarray
    basis: np.ndarray  # words x rank, each row times its idf
    items: np.ndarray
    passages: list[np.ndarray]  # word numbers of each passage
    counts: list[tuple[np.ndarray, np.ndarray]]  # the sorted distinct words of each passage and how often each stands in it
    latent: np.ndarray  # unit latent vectors of the passages
    strength: np.ndarray  # latent lengths of the passages
    answers: list[np.ndarray]
    mass: np.ndarray  # sums of the passages' idf
    member: np.ndarray  # sorted passage x (words + 1) + word of the words that passages have
    lists: tuple[np.ndarray, np.ndarray]  # passages by listed word: offsets and passage numbers
    least: np.ndarray  # places of listed words that a window must have to hold a copy
    window: np.ndarray  # words of a passage's windows: a power of two above its length, and a half
    sizes: np.ndarray  # how often STEP doubles to give the passage's grid: a window is three steps, a passage two at most


def common_subsequence(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence of two number sequences, by bit rows; -1 matches nothing."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b.tolist():
        hit = row & where.get(x, 0) if x >= 0 else 0
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct word hashes of a task's texts."""
    for batch in batches:
        data, off = utf8(batch.column(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(letter_words(data, off, digits=True)[0]).view(np.int64))], ["word"])


def number_words(words: np.ndarray, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place in ``words`` (sorted hashes; -1: absent) of every word of UTF-8 rows, and the rows' bounds."""
    hashes, _, _, bounds, _ = letter_words(data, off, digits=True)
    if not len(words):
        return np.full(len(hashes), -1, np.int32), bounds
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return np.where(words[at] == hashes, at, -1).astype(np.int32), bounds


def _number(shared: Broadcast):
    """(id, text) -> (id, numbers): each text as the benchmark's word numbers, 4 bytes a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for lo, hi in blocks(off):
                numbers, bounds = number_words(shared.value, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), hi - lo, [None, pa.py_buffer(bounds.astype(np.int64) * 4), pa.py_buffer(numbers)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), raw.cast(pa.binary())], ["id", "numbers"])

    return run


def _numbers_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a ``numbers`` column, end to end, and the rows' bounds."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 4
    return np.frombuffer(column.buffers()[2] or b"", np.int32)[off[0] : off[-1]], off - off[0]


def _document_frequency(n_words: int, shared: Broadcast | None = None):
    """Documents of the task that hold each word, as rows (word, n), with (-1, n) for all documents.

    The rows end with their numbers, or, with the ``shared`` words, with texts: then the worker that numbers them also counts,
    for two Python operators in a stage are two workers a core, which Spark keeps.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = np.zeros(n_words, np.int64), 0
        for batch in _number(shared)(batches) if shared else batches:
            numbers, bounds = _numbers_of(batch.column(batch.num_columns - 1))
            seen += len(bounds) - 1
            hit = np.flatnonzero(numbers >= 0)
            doc = np.searchsorted(bounds, hit, "right")
            count += np.bincount(np.unique(doc * n_words + numbers[hit]) % n_words, minlength=n_words)
        at = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(count[at], seen))], ["word", "n"])

    return run


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column end to end, as a view of its buffer, and the rows' bounds."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    off = lists.offsets.to_numpy()
    return lists.values.to_numpy()[off[0] : off[-1]], off - off[0]


def randomised_basis(rows: DataFrame, n_words: int, rank: int, rounds: int = 2, seed: int = 5) -> np.ndarray:
    """An orthonormal basis (words x rank) of the leading right singular space of sparse rows.

    ``rows``: (at array<int>, weight array<double>), one a passage. Randomised range finding on the
    word side: each round multiplies a words x (rank + 8) block by A^T A, a sum over rows that Spark adds up
    by word; only the block and its small Gram matrix reach the driver, in buffers of numbers.
    """
    width = min(rank + 8, n_words)
    block = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_words, width)))[0]

    def products(q: np.ndarray, gram: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((width if gram else n_words, width))
            for batch in batches:
                (at_all, off), weights = _flat(batch.column(0)), _flat(batch.column(1))[0]
                for lo, hi in zip(off[:-1], off[1:], strict=True):
                    at, weight = at_all[lo:hi], weights[lo:hi]
                    y = weight @ q[at]
                    if gram:
                        total += np.outer(y, y)
                    else:
                        total[at] += np.outer(weight, y)
            keep = np.flatnonzero(np.abs(total).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), list_array(list(total[keep]), pa.float64())], ["row", "values"])

        parts = rows.mapInArrow(run, "row long, values array<double>")
        sums = parts.groupBy("row").agg(F.array(*(F.sum(F.col("values")[j]) for j in range(width))).alias("values")).toArrow()
        out = np.zeros((width if gram else n_words, width))
        if len(sums):
            out[sums["row"].to_numpy()] = _flat(sums["values"].combine_chunks())[0].reshape(-1, width)
        return out

    for _ in range(rounds):
        block = np.linalg.qr(products(block, False))[0]
    value, vector = np.linalg.eigh(products(block, True))
    order = np.argsort(value)[::-1][:rank]
    return block @ vector[:, order[value[order] > 1e-9]]


def _needed(length: int, part: float) -> int:
    """Words of a passage that a match aligns at least."""
    return min(length, max(ALIGNED, int(np.ceil(part * length - 1e-9))))


def _cut(shared: Broadcast):
    """(item, text) -> (item, part, numbers): items of SHORT words or more in even parts of PASSAGE words at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            numbers, bounds = number_words(shared.value, data, off)
            for i, item in enumerate(batch.column(0).to_pylist()):
                mine = numbers[bounds[i] : bounds[i + 1]]
                if len(mine) >= SHORT:
                    parts = [p.tobytes() for p in np.array_split(mine, -(-len(mine) // PASSAGE))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int64()), pa.array(parts, pa.binary())], ["item", "part", "numbers"])

    return run


def build_index(rows: list, words: np.ndarray, idf: np.ndarray, spark: SparkSession, rank: int, copied: float) -> Index:
    """The latent index of one block of passages (item, numbers).

    ``words`` and ``idf``: of the whole benchmark. The rarest words of a passage are listed, so many that any part of
    ``copied`` of its words holds ``least`` places of them.
    """
    passages, of = [np.frombuffer(r.numbers, np.int32) for r in rows], [r.item for r in rows]
    mine = np.unique(np.concatenate(passages))
    local = np.full(len(words), -1, np.int32)
    local[mine] = np.arange(len(mine))
    idf = idf[mine]
    numbers = [local[p] for p in passages]
    sparse = [np.unique(x, return_counts=True) for x in numbers]
    norms = np.array([float(np.sqrt(((c * idf[a]) ** 2).sum())) for a, c in sparse])
    table = [(a.tolist(), (c * idf[a] / n).tolist()) for (a, c), n in zip(sparse, norms, strict=True)]
    sparse_rows = spark.createDataFrame(table, "at array<int>, weight array<double>")
    basis = randomised_basis(sparse_rows, len(mine), min(max(rank, len(passages) // SHARED_RANK), len(passages)))
    latent = np.array([np.array(w) @ basis[a] for a, w in table])
    held = np.maximum(np.linalg.norm(latent, axis=1), 1e-9)
    listed, least, answers = [], np.ones(len(sparse), np.int64), []
    for k, (a, c) in enumerate(sparse):
        order = np.argsort(-idf[a], kind="stable")
        answers.append(np.sort(a[order[: max(3, len(numbers[k]) // ANSWER)]]))
        needed = _needed(len(numbers[k]), copied)
        upto = np.cumsum(c[order])
        last = int(np.searchsorted(upto, upto[-1] - needed + max(1, needed // LISTED)))
        least[k] = needed - (upto[-1] - upto[last])
        listed += [(w, k) for w in a[order][: last + 1].tolist()]
    pairs = np.array(sorted(listed))
    lists = np.searchsorted(pairs[:, 0], np.arange(len(mine) + 1)), pairs[:, 1].copy()
    doubled = np.maximum(0, np.ceil(np.log2(np.array([len(x) for x in numbers]) / (2 * STEP)))).astype(np.int64)
    mass = np.array([(c * idf[a]).sum() for a, c in sparse])
    member = np.concatenate([k * (len(mine) + 1) + a.astype(np.int64) for k, (a, _) in enumerate(sparse)])
    return Index(
        local, idf, (basis * idf[:, None]).astype(np.float32), np.array(of), numbers, sparse, (latent / held[:, None]).astype(np.float32),
        (norms * held).astype(np.float32), answers, mass, member, lists, least, 3 * STEP * 2**doubled, doubled,
    )


def _copies(index: Index, numbers: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(document, passage, starts) of all windows that may hold a copy of a passage, overlapping ones together.

    Every place of every document where a listed word stands starts a window of each passage that lists
    it. Windows with fewer such places than any copy of the passage has are left out, so none that holds one is lost.
    """
    offsets, passages = index.lists
    hit = np.flatnonzero(numbers >= 0)
    count = offsets[numbers[hit] + 1] - offsets[numbers[hit]]
    hit, count = hit[count > 0], count[count > 0]
    if not len(hit):
        return
    passage = passages[np.repeat(offsets[numbers[hit]] - np.cumsum(count) + count, count) + np.arange(count.sum())]
    at = np.repeat(hit, count)
    doc = np.searchsorted(bounds, at, "right") - 1
    apart = int(index.window.max())
    place = at + doc * apart
    key = passage * int(place.max() + 2 * apart) + place
    order = np.argsort(key, kind="stable")
    key, passage, doc, at = key[order], passage[order], doc[order], at[order]
    held = np.searchsorted(key, key + index.window[passage]) - np.arange(len(key))
    good = np.flatnonzero(held >= index.least[passage])
    if not len(good):
        return
    passage, doc, at = passage[good], doc[good], at[good]
    new = (np.diff(passage, prepend=-1) != 0) | (np.diff(doc, prepend=-1) != 0) | (np.diff(at, prepend=0) > index.window[passage])
    heads = np.flatnonzero(new).tolist()
    for lo, hi in zip(heads, [*heads[1:], len(good)], strict=True):
        yield int(doc[lo]), int(passage[lo]), at[lo:hi]


def _near(index: Index, numbers: np.ndarray, bounds: np.ndarray, cosine: float) -> Iterator[tuple[int, int, np.ndarray]]:
    """(document, passage, starts) of all windows near a passage in the latent space.

    Every document is cut into steps of STEP words, and of twice, four times as many; three adjacent steps are a window,
    so a passage lies in a window of its own grid wherever it stands. A window is near if its cosine is at least ``cosine``,
    its dot product LIKENESS of the passage's own length, and its words, taken as a bag, hold WEIGHT of the passage's idf.
    """
    top = 1 << int(index.sizes.max())
    steps = -(-np.diff(bounds) // (STEP * top)) * top  # each document's steps, filled up to the largest grid
    first = np.concatenate([[0], np.cumsum(steps)])
    hit = np.flatnonzero(numbers >= 0)
    if not len(hit):
        return
    doc = np.searchsorted(bounds, hit, "right") - 1
    cells = np.full((int(first[-1]) + 3 * top) * STEP, len(index.idf), np.int32)  # words by step; the last number stands for none
    cells[first[doc] * STEP + hit - bounds[doc]] = numbers[hit]
    grid = cells[: int(first[-1]) * STEP].reshape(-1, STEP)
    basis, idf = np.vstack([index.basis, np.zeros((1, index.basis.shape[1]), np.float32)]), np.append(index.idf, 0).astype(np.float32)
    sums = basis[grid[:, 0]]
    for j in range(1, STEP):
        sums += basis[grid[:, j]]
    of = np.repeat(np.arange(len(steps)), steps)
    for k in range(int(index.sizes.max()) + 1):
        if k:
            sums, of = sums[0::2] + sums[1::2], of[::2]
        mine = np.flatnonzero(index.sizes == k)
        if not len(mine):
            continue
        window = sums.copy()
        for j in (1, 2):
            window[:-j] += sums[j:] * (of[j:] == of[:-j])[:, None]
        length = np.sqrt(np.einsum("ij,ij->i", window, window))
        need = LIKENESS * index.strength[mine]
        rows = np.flatnonzero(length >= need.min())
        texts = np.lib.stride_tricks.sliding_window_view(cells, 3 * STEP << k)
        found = []
        for lo in range(0, len(rows), ROWS):
            part = rows[lo : lo + ROWS]
            dot = window[part] @ index.latent[mine].T
            row, p = np.nonzero(dot >= np.maximum(cosine * length[part][:, None], need[None, :]))
            row, p = part[row], mine[p]
            held = np.zeros(len(row), np.float32)
            for i in range(0, len(row), ROWS):
                words = texts[(row[i : i + ROWS] << k) * STEP]
                key = p[i : i + ROWS, None] * len(idf) + words
                has = index.member[np.minimum(np.searchsorted(index.member, key), len(index.member) - 1)] == key
                held[i : i + ROWS] = (idf[words] * has).sum(axis=1)
            good = held >= WEIGHT * index.mass[p] - 1e-3
            found.append(np.stack([row[good], p[good]]))
        if not found:
            continue
        row, p = np.concatenate(found, axis=1)
        if not len(row):
            continue
        start = (row - (first[of[row]] >> k)) * (STEP << k)
        order = np.lexsort((start, p, of[row]))
        d, p, start = of[row][order], p[order], start[order]
        heads = np.flatnonzero((np.diff(d, prepend=-1) != 0) | (np.diff(p, prepend=-1) != 0)).tolist()
        for lo, hi in zip(heads, [*heads[1:], len(d)], strict=True):
            yield int(d[lo]), int(p[lo]), start[lo:hi]


def _cosine(index: Index, p: int, window: np.ndarray) -> float:
    """Cosine of a passage and the benchmark words of a window in the latent space."""
    vector = index.basis[window[window >= 0]].sum(axis=0)
    return float(vector @ index.latent[p] / max(np.linalg.norm(vector), 1e-9))


def _unbroken(passage: np.ndarray, around: np.ndarray) -> bool:
    """Whether the words stand in a text one after another."""
    return len(around) >= len(passage) and bool((np.lib.stride_tricks.sliding_window_view(around, len(passage)) == passage).all(axis=1).any())


def _align(index: Index, numbers: np.ndarray, p: int, starts: np.ndarray, copied: float, shared: float) -> tuple[float, float, float] | None:
    """The best (lcs share, answer share, cosine) of a document's windows at ``starts`` that hold passage ``p``.

    Each window is aligned with as many words around it as the passage has. A copy holds ``copied`` of the passage's words in
    order; a paraphrase ``shared`` of them, a word of its answer, and WEIGHT of its idf, a word counting as often as in the passage at most.
    """
    passage, (words, most), wide = index.passages[p], index.counts[p], int(index.window[p])
    n = len(passage)
    least = _needed(n, min(copied, shared))
    lo = max(0, int(starts[0]) - n)
    around = numbers[lo : int(starts[-1]) + wide + n]
    at = np.minimum(np.searchsorted(words, around), len(words) - 1)
    place = np.flatnonzero(words[at] == around)
    found, at = around[place], at[place]
    if np.minimum(np.bincount(at, minlength=len(words)), most).sum() < least:
        return None
    best, seen = None, set()
    for a, i, j in zip(starts.tolist(), np.searchsorted(place, starts - n - lo).tolist(), np.searchsorted(place, starts + wide + n - lo).tolist(), strict=True):
        if (i, j) in seen or j - i < least:
            continue
        seen.add((i, j))
        held = np.minimum(np.bincount(at[i:j], minlength=len(words)), most)
        if held.sum() < least:
            continue
        lcs = common_subsequence(passage, found[i:j])
        if lcs < least or (n < ALIGNED and not _unbroken(passage, around[max(0, a - n - lo) : a + wide + n - lo])):
            continue
        answer = float((held[np.searchsorted(words, index.answers[p])] > 0).mean())
        if lcs >= copied * n - 1e-9 or (answer > 0 and (held * index.idf[words]).sum() >= WEIGHT * index.mass[p]):
            best = max(best or (0.0, 0.0, -1.0), (lcs / n, answer, _cosine(index, p, numbers[a : a + wide])))
    return best


def indexes(frequency: DataFrame, items: DataFrame, words: np.ndarray, rank: int, copied: float) -> Iterator[Index]:
    """The indexes of the benchmark's blocks of PASSAGES passages, with the tasks' document frequencies (word, n) of all documents."""
    spark = frequency.sparkSession
    df, n_docs = np.zeros(len(words)), 0
    for r in frequency.groupBy("word").agg(F.sum("n").alias("n")).collect():
        if r.word < 0:
            n_docs = r.n
        else:
            df[r.word] = r.n
    idf = np.log(1 + (n_docs + 1) / (df + 1))
    passages = items.mapInArrow(_cut(spark.sparkContext.broadcast(words)), "item long, part long, numbers binary")
    placed = durable(in_order(passages, [F.col("item"), F.col("part"), F.col("numbers")], "leak-items").withColumn("block", F.floor(F.col("pos") / PASSAGES)), "leak-blocks")
    for r in placed.groupBy("block").count().orderBy("block").collect():
        yield build_index(placed.where(F.col("block") == r.block).orderBy("pos").collect(), words, idf, spark, rank, copied)


def matches(found: list[Index], numbers: np.ndarray, bounds: np.ndarray, cosine: float, copied: float, shared: float) -> Iterator[tuple]:
    """(row, item, cosine, lcs share, answer share) of the passages that the numbered texts hold."""
    for index in found:
        mine = np.where(numbers >= 0, index.local[numbers], -1)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for d, p, starts in _copies(index, mine, bounds):
            held = _align(index, mine[bounds[d] : bounds[d + 1]], p, starts - bounds[d], copied, copied)
            if held:
                best[d, p] = max(held, best.get((d, p), held))
        for d, p, starts in _near(index, mine, bounds, cosine):
            if (d, p) not in best:
                held = _align(index, mine[bounds[d] : bounds[d + 1]], p, starts, copied, shared)
                if held:
                    best[d, p] = held
        for (d, p), (lcs, answer, close) in best.items():
            yield d, int(index.items[p]), close, lcs, answer


def _groups(found: Iterator[Index]) -> Iterator[list[Index]]:
    while part := list(islice(found, TOGETHER)):
        yield part


def _benchmark(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, np.ndarray]:
    """The items (item, text) with an id, and the sorted hashes of all their words; these grow with the benchmark, not with the corpus."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null")
    rows = items.select("text").mapInArrow(_words, "word long").distinct().toArrow()
    return items, np.sort(rows["word"].to_numpy().view(np.uint64))


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    rank: int = 64,
    cosine: float = 0.3,
    copied: float = 0.8,
    shared: float = 0.4,
) -> DataFrame:
    """Documents that hold a benchmark item: one row (``id_col``, ``item_col``, cosine, lcs_share, answer_share) for each pair.

    All texts are numbered once by the benchmark's words. Blocks of PASSAGES passages each get a latent space by distributed
    randomised SVD of their TF-IDF passages (document frequencies of all ``docs``; ``rank`` dimensions, more for a block of many
    passages), and TOGETHER blocks are searched in one pass. All windows of all documents are projected; those within ``cosine`` of a
    passage are candidates. The words around a candidate are aligned with the passage: the longest common subsequence must hold
    ``copied`` of its words; or ``shared`` of them with a word of the answer (the passage's rarest words) and WEIGHT of its idf.
    Copies do not depend on the latent space: windows that can hold ``copied`` of a passage's words are all aligned.

    Items over PASSAGE words are cut into even parts, and a document that holds a part holds the item.
    A match aligns ALIGNED words at least; shorter items must stand in the text unbroken, and items of fewer than SHORT words,
    which ordinary text holds by chance, match nothing. Null and empty texts and items match nothing; repeated rows and ids each give their own rows, merged to the best
    for each (id, item); null ids are left out; an empty table on either side gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    schema = "id long, item long, cosine double, lcs_share double, answer_share double"
    out = spark.createDataFrame([], schema)
    items, words = _benchmark(benchmark, item_col, text_col)
    if len(words):
        table = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
        numbered = durable(table.mapInArrow(_number(spark.sparkContext.broadcast(words)), "id long, numbers binary"), "leak-numbers")

        def search(shared_part: Broadcast):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    numbers, bounds = _numbers_of(batch.column(1))
                    for lo, hi in blocks(bounds):
                        rows = list(matches(shared_part.value, numbers[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], cosine, copied, shared))
                        if rows:
                            at, *rest = zip(*rows, strict=True)
                            kinds = [pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                            ids = batch.column(0).slice(lo, hi - lo).take(pa.array(at))
                            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(rest, kinds, strict=True))], [x.split()[0] for x in schema.split(", ")])

            return run

        frequency = numbered.select("numbers").mapInArrow(_document_frequency(len(words)), "word long, n long")
        for part in _groups(indexes(frequency, items, words, rank, copied)):
            out = out.unionByName(numbered.where("id is not null").mapInArrow(search(spark.sparkContext.broadcast(part)), schema))
    best = out.groupBy("id", "item").agg(F.max(F.struct("lcs_share", "answer_share", "cosine")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "m.cosine", "m.lcs_share", "m.answer_share")


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", rank: int = 64, cosine: float = 0.3, copied: float = 0.8, shared: float = 0.4
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item by the rule of ``find_contamination``; a map, without a shuffle of texts.

    Rows with null or empty texts stay, as do null ids; each of several equal rows stays or goes like the others.
    """
    spark = docs.sparkSession
    items, words = _benchmark(benchmark, item_col, "text")
    if not len(words):
        return docs
    shared_words = spark.sparkContext.broadcast(words)
    texts = docs.select(F.lit(0).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    frequency = texts.mapInArrow(_document_frequency(len(words), shared_words), "word long, n long")
    parts = [spark.sparkContext.broadcast(part) for part in _groups(indexes(frequency, items, words, rank, copied))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(batch.schema.get_field_index(text_col)))
            good = np.ones(batch.num_rows, bool)
            for lo, hi in blocks(off):
                numbers, bounds = number_words(shared_words.value, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                for part in parts:
                    for row in matches(part.value, numbers, bounds, cosine, copied, shared):
                        good[lo + row[0]] = False
            yield batch.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema) if parts else docs
