"""Column expressions on words, captions and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import mixed_shingles, normalised, snake_case

#: Caption marks of interviews, press events and bonus reels, which are no footage (fixed values).
JUNK_MARKS = ("访谈", "采访", "花絮", "幕后", "制作特辑", "对镜头说", "面向镜头", "记者", "发布会", "首映礼")
#: Width over height of the frames on offer (fixed values).
RATIOS = {"16:9": 16 / 9, "9:16": 9 / 16, "1:1": 1.0, "4:3": 4 / 3, "3:4": 3 / 4, "21:9": 21 / 9}


def is_junk(caption: Column, marks: tuple[str, ...] = JUNK_MARKS) -> Column:
    """The caption holds one of the marks; a null one holds none."""
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(F.coalesce(caption, F.lit("")), F.lit(m))
    return found


def in_library(name: Column, scope: str) -> Column:
    """``name`` is one of a comma list, or one of them and two underscores start it; an empty list takes all (F8)."""
    parts = [p.strip() for p in scope.split(",") if p.strip()]
    found = F.lit(not parts)
    for p in parts:
        found = found | (name == p) | F.startswith(name, F.lit(f"{p}__"))
    return found


def shared_shingles(x: Column, y: Column) -> Column:
    """How many mixed shingles two texts share."""
    return F.size(F.array_intersect(mixed_shingles(x), mixed_shingles(y))).cast("long")


def is_grounded(text: Column, evidence: Column) -> Column:
    """Two shared shingles, or one if the text has two characters at most."""
    return shared_shingles(text, evidence) >= F.when(F.length(text) <= 2, 1).otherwise(2)


def titles_agree(a: Column, b: Column) -> Column:
    """Normalised titles are equal or one holds the other; empty ones agree with nothing."""
    x, y = normalised(a), normalised(b)
    return F.coalesce((x != "") & (y != "") & (F.contains(x, y) | F.contains(y, x)), F.lit(False))


def stems(x: Column, allowed: tuple[str, ...] = ()) -> Column:
    """Distinct lower-case words of five letters or more and runs of two Chinese characters or more, sorted; of words of seven letters or more a final ing, ed, es or s goes."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(x), F.lit("[a-z]{5,}|[\u4e00-\u9fff]{2,}"), F.lit(0)))
    cut = F.transform(words, lambda w: F.when(F.length(w) >= 7, F.regexp_replace(w, "(ing|ed|es|s)$", "")).otherwise(w))
    return F.array_sort(F.array_except(cut, F.array(*map(F.lit, allowed)).cast("array<string>")))


def leaks(text: Column, reference: Column, allowed: tuple[str, ...] = ()) -> Column:
    """The stems that a text shares with its reference; any is a leak."""
    return F.array_intersect(stems(text, allowed), stems(reference, allowed))


def split_tags(marks: Column, languages: tuple[str, ...], moods: tuple[str, ...]) -> Column:
    """(language, mood, events) of upper-case tags: the first known language and mood, and the other tags, sorted."""
    first = lambda names: F.get(F.filter(marks, lambda t: t.isin(*names)), 0)
    return F.struct(first(languages).alias("language"), first(moods).alias("mood"), F.filter(marks, lambda t: ~t.isin(*languages, *moods)).alias("events"))


def canonical_id(kind: Column, franchise: Column, name: Column) -> Column:
    """``kind:franchise:slug``; the kind defaults to char and the slug to item."""
    return F.concat_ws(":", F.coalesce(kind, F.lit("char")), snake_case(franchise, "item"), snake_case(name, "item"))


def namespaced(window: Column, event_id: Column) -> Column:
    """An event id made unique by its window's number."""
    return F.concat(F.format_string("w%03d_", window), event_id)


def nearest_ratio(width: Column, height: Column) -> Column:
    """The frame on offer nearest to width over height, the first one on ties."""
    choices = F.array(*(F.struct(F.abs(F.lit(r) - width / height).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("n")) for i, (n, r) in enumerate(RATIOS.items())))
    return F.array_min(choices)["n"]


def temporal_coverage(first: Column, last: Column, duration: Column) -> Column:
    """The story starts in the first 30 %, ends in the last 30 % and spans half the duration or more.

    Without a duration it passes; without an interval it fails.
    """
    known = (first * 10 <= duration * 3) & (last * 10 >= duration * 7) & ((last - first) * 2 >= duration)
    return F.when(F.coalesce(duration <= 0, F.lit(True)), True).otherwise(F.coalesce(known, F.lit(False)))


def differing(x: Column, before: Column, same_event: Column) -> Column:
    """A boundary: the functions differ and it is not one event."""
    return F.coalesce((x != before) & ~same_event, F.lit(False))


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the fields as one JSON object with sorted names: a key of our own, stable across runs."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def patch_allowed(path: Column, value: Column, n_operations: Column, n_assets: Column) -> Column:
    """A patch names an allowed field of an operation or asset that exists, and has a value."""
    operation = F.regexp_extract(path, r"^/operations/(\d+)/(?:params/[^/]+|status|confidence|interval)$", 1).try_cast("long")
    asset = F.regexp_extract(path, r"^/assets/(\d+)/(?:source_range|uri)$", 1).try_cast("long")
    return F.coalesce(value.isNotNull() & F.coalesce(operation < n_operations, asset < n_assets), F.lit(False))
