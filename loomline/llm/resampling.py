"""Importance resampling towards a target: hashed n-gram features by a ring of running CRC states, gains by bucket, Gumbel top-k."""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.scratch import durable, in_order
from loomline.llm.textblocks import list_array, utf8

#: Words over UTF-8 bytes after A-Z are lower-cased: ASCII digits, small letters and all bytes of other characters.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def feature_states(text: bytes, n: int) -> tuple[list[int], int]:
    """CRC-32 of every run of 1 to ``n`` words joined by one space, and the number of words, in one scan.

    The ring holds the running states of the last ``n`` starts. A word extends each by a space and itself and opens its own; the oldest leaves.
    """
    out: list[int] = []
    ring: list[int] = []
    words = WORD.findall(text.lower())
    if n == 1:
        return list(map(crc32, words)), len(words)
    for word in words:
        spaced = b" " + word
        ring = [crc32(spaced, state) for state in ring]
        ring.append(crc32(word))
        out += ring
        if len(ring) == n:
            del ring[0]
    return out, len(words)


def _features(n: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            raw, words, total, ids, counts = data.tobytes(), [], [], [], []
            for a, b in zip(off[:-1], off[1:], strict=True):
                states, w = feature_states(raw[a:b], n)
                found, times = np.unique(np.array(states, np.int64) % buckets, return_counts=True)
                words.append(w)
                total.append(len(states))
                ids.append(found)
                counts.append(times)
            columns = [batch.column(0), pa.array(words, pa.int64()), pa.array(total, pa.int64()), list_array(ids, pa.int32()), list_array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "bucket", "n"])

    return run


def bucket_features(docs: DataFrame, n: int = 2, buckets: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, n_words, n_features and the document's buckets with their counts: arrays of ``buckets`` entries at most, however long the text.

    Null and empty texts, and texts without a word, have empty arrays; ids may be null or repeat; an empty table gives no rows; other columns are ignored.
    """
    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = table.schema["id"].dataType.simpleString()
    return table.mapInArrow(_features(n, buckets), f"id {kind}, n_words long, n_features long, bucket array<int>, n array<long>")


def bucket_counts(features: DataFrame, out: str) -> DataFrame:
    """Features of all documents by bucket; counts are added up before the shuffle, which has at most one row a bucket and task."""
    return features.select(F.inline(F.arrays_zip("bucket", "n"))).groupBy("bucket").agg(F.sum("n").alias(out))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln(p_target / p_corpus)) of every bucket, both probabilities with one more count a bucket: ``buckets`` numbers."""
    s, t = bucket_counts(corpus, "s"), bucket_counts(target, "t")
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = durable(every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0), "resample-buckets")
    total = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    part = (F.col("t") + 1.0) * F.lit(float(total.s + buckets)) / ((F.col("s") + 1.0) * F.lit(float(total.t + buckets)))
    gains = np.zeros(buckets, np.int64)
    for bucket, gain in both.select("bucket", F.floor(F.log(part) * 1000.0).alias("gain")).collect():
        gains[bucket] = gain
    return gains


def _weigh(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = batch.column(3), batch.column(4)
            off = np.asarray(ids.offsets, np.int64)
            lo, hi = off[0], off[-1]
            values = gains[np.asarray(ids.values, np.int64)[lo:hi]] * np.asarray(counts.values, np.int64)[lo:hi]
            upto = np.concatenate([[0], np.cumsum(values)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(upto[off[1:] - lo] - upto[off[:-1] - lo], pa.int64())], ["id", "n_words", "n_features", "weight"])

    return run


def gumbel(seed: str, doc: Column) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first eight hex digits of the SHA-256 of ``seed:doc``; a null id is the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.log(-F.log((h + 0.5) / 4294967296.0)) * -1000.0)


def importance_resample(
    docs: DataFrame, target: DataFrame, n: int = 2, buckets: int = 10_000, percent: int = 10, least: int = 20, seed: str = "2024",
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Draw ``percent`` of the documents of ``least`` words or more so that their n-grams look like the target's.

    Every document's weight is the sum of its features' gains; weight plus Gumbel noise is its score, and the highest scores are drawn
    without replacement. Documents are scanned once; what is kept of each is bounded by ``buckets``. Scores are ranked by value ranges, with one offset a range.

    Returns ``id_col``, n_words, n_features, weight, score and rank (from 1, null if not drawn). Null and empty texts weigh 0 and are never drawn;
    ties go to the smaller id (null last), rows of one id to the larger n_features, equal rows to either; an empty table or target counts as no features; other columns are ignored.
    """
    features = durable(bucket_features(docs, n, buckets, id_col, text_col), "resample-features")
    gains = bucket_gains(features, bucket_features(target, n, buckets, target_col, target_col), buckets)
    kind = features.schema["id"].dataType.simpleString()
    weighed = features.mapInArrow(_weigh(gains), f"id {kind}, n_words long, n_features long, weight long")
    scored = durable(weighed.withColumn("score", F.col("weight") + gumbel(seed, F.col("id"))), "resample-scores")
    open_ = F.col("n_words") >= least
    drawn = scored.where(open_).count() * percent // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features").desc(), F.col("n_words").desc()]
    ranked = in_order(scored.where(open_), order, "resample-order").withColumn("rank", F.when(F.col("pos") < drawn, F.col("pos") + 1))
    columns = [F.col("id").alias(id_col), "n_words", "n_features", "weight", "score"]
    return ranked.select(*columns, "rank").unionByName(scored.where(~open_).select(*columns, F.lit(None).cast("long").alias("rank")))


def resampled_documents(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The drawn rows of ``docs``, all columns; rows of the same id and number of features stay or go together. ``options`` are those of ``importance_resample``."""
    scored = importance_resample(docs, target, id_col=id_col, text_col=text_col, **options)
    drawn = scored.where("rank IS NOT NULL").select(F.col(id_col).alias("drawn_id"), F.col("score").alias("drawn_score")).distinct()
    return docs.join(drawn, F.col(id_col).eqNullSafe(F.col("drawn_id")), "left_semi")
