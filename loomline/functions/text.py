"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that stand for a missing value (fixed values).
SENTINELS = ("uncertain", "unknown", "not_applicable")


def trim_to_null(x: Column) -> Column:
    """Trimmed text; blank is null."""
    return F.nullif(F.trim(x), F.lit(""))


def int_or_null(x: Column) -> Column:
    """Whole part of a number in text; null for anything else."""
    return F.try_cast(x, "double").cast("long") if hasattr(F, "try_cast") else x.try_cast("double").try_cast("long")


def usable(x: Column) -> Column:
    """Null for a blank or a sentinel (the whole text, never a part of it)."""
    t = trim_to_null(x)
    return F.when(~F.lower(t).isin(*SENTINELS), t)


def normalised(x: Column) -> Column:
    """Lower case letters and digits only, full-width ASCII folded."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    narrow = "".join(chr(c) for c in range(0x21, 0x7F))
    return F.regexp_replace(F.lower(F.translate(x, wide, narrow)), r"[^\p{L}\p{N}]", "")


def bigrams(x: Column) -> Column:
    """Distinct pairs of neighbouring characters."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    return F.when(F.length(x) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def bigram_jaccard(x: Column, y: Column) -> Column:
    """Common over all distinct bigrams; 0 without any."""
    a, b = bigrams(x), bigrams(y)
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def mixed_shingles(x: Column) -> Column:
    """Bigrams of the Han characters taken together, and the lower-case ASCII words."""
    han = F.regexp_replace(x, r"[^\p{IsHan}]", "")
    words = F.regexp_extract_all(F.lower(x), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.concat(bigrams(han), words))


def token_estimate(x: Column) -> Column:
    """Han characters plus 0.3 for every other one, rounded down."""
    han = F.length(F.regexp_replace(x, r"[^\p{IsHan}]", ""))
    return F.floor(han + (F.length(x) - han) * 0.3).cast("long")


def snake_case(x: Column, default: str = "variant") -> Column:
    """Lower case ASCII words joined by underscores; ``default`` if nothing is left."""
    joined = F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))


def cut_repetition(x: Column, marker: str) -> Column:
    """The text before the second occurrence of ``marker``."""
    return F.substring_index(x, marker, 2)


def tags(x: Column) -> Column:
    """Names in <|NAME|> marks, upper case, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(x, F.lit(r"<\|([^|]+)\|>"), F.lit(1)), lambda t: F.upper(t))))


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a of the UTF-8 bytes."""
    hexed = F.hex(F.encode(x, "UTF-8"))
    octets = F.transform(F.sequence(F.lit(1), F.length(hexed), F.lit(2)), lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))
    start = F.lit(0x811C9DC5).cast("long")
    folded = F.aggregate(octets, start, lambda h, b: ((h.bitwiseXOR(b)) * F.lit(0x01000193)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.when(F.length(hexed) > 0, folded).otherwise(start)


def time_code(seconds: Column) -> Column:
    """HH:MM:SS,mmm."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000), F.floor(ms / 60_000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def fraction(x: Column) -> Column:
    """A rate such as 30000/1001; null if it is none or divides by zero."""
    parts = F.split(x, "/")
    top, bottom = F.get(parts, 0).try_cast("double"), F.coalesce(F.get(parts, 1), F.lit("1")).try_cast("double")
    return F.when(bottom != 0, top / F.nullif(bottom, F.lit(0.0)))


def is_concrete(x: Column, deny: tuple[str, ...] = ("n/a", "none", "unknown", "something")) -> Column:
    """Has a letter or digit after cleaning and is no placeholder."""
    t = F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, r"[\p{P}\s]+$|^[\p{P}\s]+", ""), r"\s+", " ")))
    return F.coalesce(t.rlike(r"[\p{L}\p{N}]") & ~t.isin(*deny), F.lit(False))
