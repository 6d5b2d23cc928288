"""A quality classifier on hashed word and character n-gram vectors, trained by stochastic gradient descent."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.textblocks import IS_SPACE, blocks, code_points, gram_buckets, padded, span_hashes, utf8

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
REPEAT = 0  # the feature of a word that repeats the word before it
SHRINK = 30  # features' worth of a zero vector in every text's average, so short texts stay near the bias


def span_features(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature buckets of words (itself and its character n-grams with borders, case kept) and each one's word, by word."""
    spans = padded(cells, starts, lengths)
    found = [((hashes % np.uint64(BUCKETS)).astype(np.int64), np.arange(len(hashes)))]
    found += [gram_buckets(*spans, n, BUCKETS) for n in GRAMS]
    bucket, span = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    return bucket, span


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space: hashes, first characters, lengths, bounds by row, and the characters."""
    cells, at = code_points(data, off)
    inside = ~IS_SPACE[np.minimum(cells, 255)]
    hashes, starts, bounds = span_hashes(cells, inside, at)
    lengths = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    return hashes, starts, lengths, bounds, cells


@dataclass
class QualityModel:
    """Each feature's part of the logit (its vector times the output weights), and the bias."""

    weight: np.ndarray
    bias: float


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = 8, epochs: int = 8, rate: float = 0.5, seed: int = 1) -> QualityModel:
    """Fit vectors and a two-class softmax on bags (buckets, counts) by SGD, one document a step."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    out, bias = np.zeros((2, dim), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            bucket, count = bags[i]
            lr = rate * (1 - done / steps)
            done += 1
            share = count / (count.sum() + SHRINK)
            hidden = share @ vectors[bucket] if len(count) else np.zeros(dim, np.float32)
            logits = out @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = p @ out
            out -= lr * np.outer(p, hidden)
            bias -= 0.1 * lr * p
            if len(count):
                vectors[bucket] -= (lr * min(1e3, 0.05 / float((share * share).sum()))) * share[:, None] * back[None, :]
    return QualityModel((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, label) -> the model, as one row; sees a bounded sample."""
    bags, labels = [], []
    for batch in batches:
        data, off = utf8(batch.column(0))
        labels += batch.column(1).to_pylist()
        for a, b in zip(off[:-1], off[1:], strict=True):
            text = data[a:b]
            hashes, starts, lengths, _, cells = word_spans(text, np.array([0, len(text)]))
            key, first, count = np.unique(hashes, return_index=True, return_counts=True)
            bucket, span = span_features(key, starts[first], lengths[first], cells)
            repeats = int((hashes[1:] == hashes[:-1]).sum())
            ids, at = np.unique(np.append(bucket, REPEAT), return_inverse=True)
            bags.append((ids.astype(np.int32), np.bincount(at, np.append(count[span], repeats), minlength=len(ids)).astype(np.float32)))
    order = sorted(range(len(bags)), key=lambda i: (len(bags[i][0]), bags[i][0].tobytes(), labels[i]))
    model = train([bags[i] for i in order], np.array([labels[i] for i in order], int))
    yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], ["weight", "bias"])


def train_quality_model(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_rows: int = 6000
) -> QualityModel:
    """Train on at most ``max_rows`` labelled rows, the first by a hash of their id, with their whole texts.

    The sample is bounded, so it is broadcast to find its texts and one task fits the model. An id counts once, however often it
    stands in ``labels`` (the smallest label) or in ``docs`` (the text of the smallest hash, found before the texts move). Rows
    with a null label or id are left out; without labelled rows the model scores 0.5.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("k"), F.col(label_col).cast("int").alias("label"))
    sample = known.groupBy("k").agg(F.min("label").alias("label")).orderBy(F.xxhash64("k"), "k").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("k"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "k")
    once = texts.groupBy("k").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("label").alias("label"))
    rows = once.select("text", "label").repartition(1).mapInArrow(_fit, "weight binary, bias double").collect()
    if not rows:
        return QualityModel(np.zeros(BUCKETS, np.float32), 0.0)
    return QualityModel(np.frombuffer(rows[0].weight, np.float32), rows[0].bias)


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and score (0 to 1, higher: label 1 likelier) of every whole text.

    Null and empty texts have no features and get the score of the bias. Ids may be null or
    repeat; an empty table gives no rows; other columns are ignored.
    """
    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, off = utf8(batch.column(1))
            for lo, hi in blocks(off):
                hashes, starts, lengths, bounds, cells = word_spans(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                logit = np.full(hi - lo, m.bias)
                if len(hashes):
                    key, first, at = np.unique(hashes, return_index=True, return_inverse=True)
                    bucket, span = span_features(key, starts[first], lengths[first], cells)
                    part = np.bincount(span, m.weight[bucket], minlength=len(key))[at]
                    size = np.bincount(span, minlength=len(key))[at]
                    again = np.zeros(len(hashes), bool)
                    again[1:] = hashes[1:] == hashes[:-1]
                    full = np.flatnonzero(bounds[1:] > bounds[:-1])
                    again[bounds[full]] = False
                    part, size = part + again * m.weight[REPEAT], size + again
                    logit[full] += np.add.reduceat(part, bounds[full]) / (np.add.reduceat(size, bounds[full]) + SHRINK)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(1 / (1 + np.exp(-logit)))], ["id", "score"])

    kind = table.schema["id"].dataType.simpleString()
    return table.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
