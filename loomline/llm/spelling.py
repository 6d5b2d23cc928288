"""Spelling variants: near words by a rare-first prefix filter over positional bigrams, and the common form that a rare word leads to."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.scratch import durable
from loomline.llm.textblocks import utf8

LETTERS = "a-zÀ-ÿ"
PREFIX = 3  # bigrams of a word that are joined: one edit touches two at most, so near words share one of their three rarest
HOT = 100  # words under one key from which they are told apart by what one deletion leaves
FLUSH = 200_000  # different words that a task counts before it hands them on


def _count_words(least: int, drop_every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = re.compile(f"[{LETTERS}]{{{least},}}").findall
        counts: dict[str, int] = {}

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            data, off = utf8(batch.column(1))
            raw = data.tobytes().lower()  # bytes: A-Z only
            for doc, a, b in zip(batch.column(0).to_pylist(), off[:-1], off[1:], strict=True):
                start = crc32(f"{'' if doc is None else doc}:".encode())
                for word in runs(raw[a:b].decode("utf-8", "replace")):
                    if drop_every:
                        h = crc32(word.encode(), start)
                        if h % drop_every == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < least:
                                continue
                    counts[word] = counts.get(word, 0) + 1
                if len(counts) >= FLUSH:
                    yield handed()
        yield handed()

    return run


def corpus_words(docs: DataFrame, least: int = 7, times: int = 2, drop_every: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``: the runs of Latin letters of whole texts, A-Z lower-cased, of ``least`` code points or more that occur ``times`` times or more.

    With ``drop_every``, a run whose CRC-32 under the prefix ``<id>:`` is a multiple of it loses the code point at that hash modulo its length: planted
    misspellings. Tasks count before the shuffle. Null and empty texts have no words; a null id is the empty text; an empty table gives no rows.
    """
    table = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return table.mapInArrow(_count_words(least, drop_every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Every bigram's place in the global order, rarest first, ties by the bigram: at most the square of the alphabet's 90 letters."""
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", i, 2))).alias("gram"))
    found = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("times")).collect()
    return {r.gram: i for i, r in enumerate(sorted(found, key=lambda r: (r.times, r.gram)))}


def rarest(word: str, ranks: dict[str, int]) -> list[tuple[str, int]]:
    """The PREFIX rarest bigrams of ``word`` with their places; copies of one bigram from left to right."""
    grams = sorted((ranks[word[i : i + 2]], i) for i in range(len(word) - 1))
    return [(word[i : i + 2], i) for _, i in grams[:PREFIX]]


def _prefixes(ranks: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rarest(word, ranks) for word in batch.column(0).to_pylist()]
            grams, places = [[g for g, _ in f] for f in found], [[at for _, at in f] for f in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.string())), pa.array(places, pa.list_(pa.int32()))], ["word", "gram", "at"])

    return run


def _keys(prefixes: DataFrame, longer: bool) -> DataFrame:
    """(word, key, edits): a row for each rare bigram and each half that an edit may leave as it is.

    The key is bigram, place, length and half of the shorter word; ``longer`` gives a word the keys of words it has one code point more than. Its bigrams stand
    at the same place there or one before; inside the half that is the same only one of these is possible. ``edits`` are the places of the other half.
    """
    rows = prefixes.select("word", F.inline(F.arrays_zip("gram", "at")))
    extra = 1 if longer else 0
    size = F.length("word") - extra
    half = F.floor(size / 2).cast("int")
    inside = (F.col("at") + 2 <= half, F.col("at") >= half + 1)
    option = lambda side, back: F.struct(F.lit(side).alias("side"), F.lit(back).alias("back"))
    if longer:
        sides = F.concat(
            F.when(inside[0], F.array(option(0, 0))).otherwise(F.array(option(0, 0), option(0, 1))),
            F.when(inside[1], F.array(option(1, 1))).otherwise(F.array(option(1, 0), option(1, 1))),
        )
    else:
        sides = F.array(option(0, 0), option(1, 0))
    same = F.when(F.col("o.side") == 0, F.substring("word", F.lit(1), half)).otherwise(F.substring("word", half + 1 + extra, size))
    edits = F.when(F.col("o.side") == 0, F.sequence(half + 1, size + extra)).otherwise(F.sequence(F.lit(1), half + extra))
    spread = rows.withColumn("o", F.explode(sides)).where(F.col("at") >= F.col("o.back"))
    return spread.select("word", F.xxhash64("gram", F.col("at") - F.col("o.back"), size, "o.side", same).alias("key"), edits.alias("edits"))


def _parted(rows: DataFrame, hot: DataFrame | None, replaced: bool, inserted: str) -> DataFrame:
    """(key, word), a row each, or under a hot key a row for each place that an edit may have: the key with what is left without that code point."""
    if hot is None:
        return rows.select("key", "word")
    word = F.col("word")
    without = lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word)))
    parts = [F.transform("edits", lambda i: F.xxhash64("key", without(i), i))] if replaced else []
    if inserted == "whole":
        parts.append(F.array(F.xxhash64("key", word, F.lit(0))))
    elif inserted == "without":
        parts.append(F.array_distinct(F.transform("edits", lambda i: F.xxhash64("key", without(i), F.lit(0)))))
    keys = F.when(F.col("is_hot"), F.concat(*parts)).otherwise(F.array("key"))
    return rows.join(hot, "key", "left").select("word", F.explode(keys).alias("key"))


def near_pairs(words: DataFrame, hot: int | None = None) -> DataFrame:
    """Pairs (a, b) of words that differ by exactly one inserted, deleted or replaced code point; b is the longer one, or the later of equal length.

    Bigrams are ordered by how many words hold them. Of each word only the three rarest are joined: an edit touches at most two, so
    two near words share one of these, at the same place in both or one further on in the longer one. One half of the word is the same in both, so the key is
    bigram, place, length and that half; each pair that meets is verified by its edit distance. Words under a key of more than ``hot`` words also have to agree in what is
    left without one code point of the other half, which near words do: such a key costs a few rows a word instead of a pair for each two words.
    """
    hot = HOT if hot is None else hot
    prefixes = durable(words.select("word").mapInArrow(_prefixes(gram_ranks(words)), "word string, gram array<string>, at array<int>"), "spelling-prefixes")
    base, longer = _keys(prefixes, False), _keys(prefixes, True)
    counts = base.select("key").unionByName(longer.select("key")).groupBy("key").agg(F.count(F.lit(1)).alias("_n"))
    many = durable(counts.where(F.col("_n") > hot).select("key", F.lit(True).alias("is_hot")), "spelling-hot")
    many = None if many.isEmpty() else many
    left = _parted(base, many, True, "whole").withColumnRenamed("word", "a")
    right = _parted(base, many, True, "").unionByName(_parted(longer, many, False, "without")).withColumnRenamed("word", "b")
    met = left.join(right, "key").where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b")))
    return met.where(F.levenshtein("a", "b", 1) == 1).select("a", "b").distinct()


def spelling_groups(words: DataFrame, ratio: int = 10, hot: int | None = None) -> DataFrame:
    """Each word's form, the near word of largest n (ties: smallest in code-point order) if that is at least ``ratio`` times its own, and the root its forms lead to.

    ``words`` has one row (word, n) a word, at least four code points each; other columns are ignored. n grows ``ratio``-fold along forms, so the way to the root is
    short, and each round doubles the steps taken. Returns word, form, root, n, n_near, form_n; no word gives no rows.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, so that forms lead to an end")
    words = durable(words.select("word", "n"), "spelling-words")
    if not words.where(F.length("word") < PREFIX + 1).isEmpty():
        raise ValueError(f"words of fewer than {PREFIX + 1} code points have too few bigrams")
    pairs = durable(near_pairs(words, hot), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near")))
    near = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(near, "word", "left")
    formed = F.coalesce(-F.col("best.less") >= F.col("n") * ratio, F.lit(False))
    table = durable(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(formed, F.col("best.near")).alias("form"),
            F.when(formed, -F.col("best.less")).alias("form_n"),
        ),
        "spelling-forms",
    )
    most = table.agg(F.max("n")).first()[0] or 1
    steps = durable(table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-steps")
    for _ in range(math.ceil(math.log2(1 + math.log(max(most, 2), ratio)))):
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = durable(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-steps")
    return table.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
