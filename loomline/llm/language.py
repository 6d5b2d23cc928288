"""Language identification: known words by log frequency, else progressively shorter character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.scratch import durable
from loomline.llm.textblocks import blocks, gram_buckets, letter_words, padded, utf8

GRAMS = (1, 2, 3, 4)
BUCKETS = 1 << 16
KNOWN = 2.0**-18  # least share of a language's running words that makes a word known: 2^18 known words a language at most
UNSEEN = 0.01  # share of a word's or n-gram's frequency that every language keeps


@dataclass
class LanguageModel:
    """Sorted word hashes, the log frequencies of the languages that know each, and a table for each n-gram length.

    ``word_floor`` is what a word scores in the languages that do not know it.
    """

    langs: list[str]
    words: np.ndarray
    word_floor: np.ndarray
    word_bounds: np.ndarray
    word_langs: np.ndarray
    word_scores: np.ndarray
    grams: dict[int, np.ndarray]
    gram_known: dict[int, np.ndarray]

    def span_scores(self, hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Scores (spans x languages): the word's own if known, else the mean of its longest known n-grams."""
        out = np.zeros((len(hashes), len(self.langs)), np.float64)
        at = np.minimum(np.searchsorted(self.words, hashes), max(len(self.words) - 1, 0))
        known = self.words[at] == hashes if len(self.words) else np.zeros(len(hashes), bool)
        if known.any():
            row, word = np.flatnonzero(known), at[known]
            out[row] = self.word_floor[word, None]
            n = self.word_bounds[word + 1] - self.word_bounds[word]
            entry = np.repeat(self.word_bounds[word] - np.cumsum(n) + n, n) + np.arange(n.sum())
            out[np.repeat(row, n), self.word_langs[entry]] = self.word_scores[entry]
        rest = np.flatnonzero(~known)
        for n in reversed(GRAMS):
            if not len(rest):
                break
            bucket, span = gram_buckets(*padded(cells, starts[rest], lengths[rest]), n, BUCKETS)
            seen = self.gram_known[n][bucket]
            bucket, span = bucket[seen], span[seen]
            count = np.bincount(span, minlength=len(rest))
            got = count > 0
            for k in range(len(self.langs)):
                total = np.bincount(span, self.grams[n][bucket, k], minlength=len(rest))
                out[rest[got], k] = total[got] / count[got]
            rest = rest[~got]
        return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> rows (lang, n, key, count): n = 0 words by hash, else n-gram buckets, summed in the task."""
    words: dict[str, list] = {}
    grams: dict[str, dict[int, np.ndarray]] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang in list(words):
            found = [(0, *_merged(words.pop(lang)))]
            for n, table in grams.pop(lang).items():
                at = np.flatnonzero(table)
                found.append((n, at, table[at]))
            for n, key, count in found:
                for lo in range(0, len(key), 200_000):
                    k, c = key[lo : lo + 200_000], count[lo : lo + 200_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(k)), pa.array(np.full(len(k), n, np.int32)), pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))],
                        ["lang", "n", "key", "count"],
                    )

    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        data, off = utf8(batch.column(1))
        for lo, hi in blocks(off):
            hashes, starts, lengths, bounds, cells = letter_words(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            here, code = np.unique(langs[lo:hi].astype(str), return_inverse=True)
            of = np.repeat(code, np.diff(bounds))
            for k, lang in enumerate(here):
                mine = np.flatnonzero(of == k)
                key, first, count = np.unique(hashes[mine], return_index=True, return_counts=True)
                words.setdefault(lang, []).append((key, count))
                held += len(key)
                tables = grams.setdefault(lang, {n: np.zeros(BUCKETS) for n in GRAMS})
                spans = padded(cells, starts[mine[first]], lengths[mine[first]])
                for n in GRAMS:
                    bucket, span = gram_buckets(*spans, n, BUCKETS)
                    tables[n] += np.bincount(bucket, count[span], minlength=BUCKETS)
            if held > 1_500_000:
                for lang in words:
                    words[lang] = [_merged(words[lang])]
                held = sum(len(v[0][0]) for v in words.values())
                if held > 750_000 or len(words) > 64:
                    yield from flush()
                    held = 0
    yield from flush()


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([p[0] for p in parts])
    keys, at = np.unique(key, return_inverse=True)
    return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), minlength=len(keys))


def _scores(freq: np.ndarray) -> np.ndarray:
    """Log frequencies (cells x languages), smoothed by a share of the cell's own total."""
    return np.log(freq + UNSEEN * freq.sum(axis=1, keepdims=True) + 1e-300)


def train_language_model(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = 2, known_share: float = KNOWN) -> LanguageModel:
    """Count words and character n-grams of all rows with a non-null ``lang_col``.

    A word is known in a language if it occurs there ``min_count`` times and is at least the share ``known_share`` of
    its running words; the rest are unseen words, which the n-grams score. Up to ``min_count`` / ``known_share`` running words the count decides,
    beyond that the share. Since shares add up to one, a language has at most 1 / ``known_share`` known words: the model that
    reaches the driver and the workers is bounded by the number of languages. Each n-gram length
    has a table of ``BUCKETS`` cells. Null texts count nothing; without languages the model knows none.
    """
    table = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string"), F.col(text_col).cast("string"))
    counts = durable(
        table.mapInArrow(_counts, "lang string, n int, key long, count long").groupBy("lang", "n", "key").agg(F.sum("count").alias("count")), "lang-counts"
    )
    totals = {(r.lang, r.n): r.t for r in counts.groupBy("lang", "n").agg(F.sum("count").alias("t")).collect()}
    langs = sorted({lang for lang, _ in totals})
    code = {lang: k for k, lang in enumerate(langs)}
    known = F.lit(False)
    for lang in langs:
        known = known | ((F.col("lang") == lang) & (F.col("count") >= max(min_count, known_share * totals.get((lang, 0), 0))))
    rows = counts.where("n = 0").where(known).select("lang", "key", "count").toArrow()
    key = rows["key"].to_numpy().view(np.uint64)
    lang_of = np.array([code[x] for x in rows["lang"].to_pylist()], np.int64)
    freq = rows["count"].to_numpy() / np.array([max(1, totals.get((x, 0), 1)) for x in langs])[lang_of] if len(key) else np.zeros(0)
    order = np.lexsort((lang_of, key))
    key, lang_of, freq = key[order], lang_of[order], freq[order]
    words, first = np.unique(key, return_index=True)
    bounds = np.append(first, len(key)).astype(np.int64)
    floor = UNSEEN * np.add.reduceat(freq, first) if len(words) else np.zeros(0)
    scores = np.log(freq + np.repeat(floor, np.diff(bounds)))
    model = LanguageModel(langs, words, np.log(floor), bounds, lang_of, scores, {}, {})
    grams = counts.where("n > 0").select("lang", "n", "key", "count").toArrow()
    lang_of = np.array([code[x] for x in grams["lang"].to_pylist()], int)
    length, key, count = (grams[c].to_numpy() for c in ("n", "key", "count"))
    for n in GRAMS:
        mine = length == n
        freq = np.zeros((BUCKETS, len(langs)))
        seen = np.zeros(BUCKETS)
        np.add.at(seen, key[mine], count[mine])
        freq[key[mine], lang_of[mine]] = count[mine] / np.array([max(1, totals.get((x, n), 1)) for x in langs])[lang_of[mine]]
        model.grams[n], model.gram_known[n] = _scores(freq).astype(np.float32), seen >= min_count
    return model


def predict(m: LanguageModel, data: np.ndarray, off: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Language and score of each row of UTF-8 texts."""
    hashes, starts, lengths, bounds, cells = letter_words(data, off)
    langs, scores = ["und"] * (len(off) - 1), np.zeros(len(off) - 1)
    if m.langs and len(hashes):
        key, first, at = np.unique(hashes, return_index=True, return_inverse=True)
        each = m.span_scores(key, starts[first], lengths[first], cells)[at]
        full = np.flatnonzero(bounds[1:] > bounds[:-1])
        total = np.add.reduceat(each, bounds[full], axis=0)
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i, b, x in zip(full.tolist(), best.tolist(), share.tolist(), strict=True):
            langs[i], scores[i] = m.langs[b], x
    return langs, scores


def identify_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of every whole text: ``id_col``, lang_pred and score (the winner's share, 0 to 1).

    Scores of a text's words are summed and the languages' shares are their softmax; ties go to the
    first language by name. Null texts, texts without a letter, and all texts under a model without
    languages are ``und`` with score 0. Ids may be null or repeat; an empty table gives no rows; other columns are ignored.
    """
    table = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for lo, hi in blocks(off):
                langs, scores = predict(shared.value, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(langs, pa.string()), pa.array(scores)], ["id", "lang_pred", "score"])

    kind = table.schema["id"].dataType.simpleString()
    return table.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text has a language with a score of ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(batch.schema.get_field_index(text_col)))
            for lo, hi in blocks(off):
                langs, scores = predict(shared.value, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                good = (np.array(langs, object) != "und") & (scores >= least)
                yield batch.slice(lo, hi - lo).filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)


def fold_of(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; -1 for a null id."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % folds, F.lit(-1))
