"""Small Spark expressions on text that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once for each row."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Runs of characters other than the six ASCII white spaces."""
    return F.array_remove(F.split(F.translate(text, SPACE, " " * len(SPACE)), " ", -1), "")


def count_chars(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


SPAN = "struct<start:long,end:long,value:string>"
STRETCH = 256  # matches whose places are added up in one fold


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>: code points from 0, end exclusive.

    The text between the matches and the matches themselves alternate, so their lengths add up to places. A fold adds
    up each stretch of STRETCH matches from 0 and another one the stretches, so that appending stays cheap in a text of many matches.
    """
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast(f"array<{SPAN}>")
    zero = F.lit(0).cast("long")
    shift = lambda at, x: F.struct((at + x["start"]).alias("start"), (at + x["end"]).alias("end"), x["value"].alias("value"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))).alias("spans"))

    def stretches(pairs: Column) -> Column:
        first = F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / STRETCH).cast("int"))
        return F.transform(first, lambda k: F.aggregate(F.slice(pairs, k * STRETCH + 1, F.lit(STRETCH)), F.struct(zero.alias("at"), empty.alias("spans")), add))

    def follow(acc: Column, x: Column) -> Column:
        placed = F.struct(acc["at"].alias("at"), x["spans"].alias("spans"))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.concat(acc["all"], F.array(placed)).alias("all"))

    def joined(pairs: Column) -> Column:
        start = F.struct(zero.alias("at"), F.array().cast(f"array<struct<at:long,spans:array<{SPAN}>>>").alias("all"))
        placed = F.aggregate(stretches(pairs), start, follow, lambda acc: acc["all"])
        return F.flatten(F.transform(placed, lambda p: F.transform(p["spans"], lambda x: shift(p["at"], x))))

    pairs = F.filter(F.arrays_zip(between.alias("gap"), found.alias("value")), lambda x: x["value"].isNotNull())
    return let(pairs, lambda p: F.when(F.size(p) == 0, empty).otherwise(joined(p)))
