"""Exact spans behind numbered sentinels, and their return.

Counting and checking are native. Masking works span by span along the text, so it runs in Arrow batches in linear time;
an array fold in a column would copy the text at every span."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.columns import count_of, java
from .arrow import by_row

_LOCKED = [re.compile(p) for p in fixed.LOCKED.values()]
SENTINEL = java(fixed.SENTINEL, "ud")
#: Further spans of a text, as an entity recogniser would give them; none is installed, so the default finds nothing.
Recogniser = Callable[[str], list[tuple[int, int]]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Distinct spans in order; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(set(spans)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def spans_of(text: str, recogniser: Recogniser | None = None) -> list[tuple[int, int]]:
    found = [m.span() for p in _LOCKED for m in p.finditer(text) if m.end() > m.start()]
    return merged(found + (recogniser(text) if recogniser else []))


def mask(text: str, recogniser: Recogniser | None = None) -> tuple[str, list[str]]:
    parts, kept, at = [], [], 0
    for s, e in spans_of(text, recogniser):
        parts += [text[at:s], fixed.SENTINEL_FORMAT % len(kept)]
        kept.append(text[s:e])
        at = e
    return "".join([*parts, text[at:]]), kept


def mapping_of(kept: Column) -> Column:
    """sentinel -> original span, from the spans in order."""
    return F.map_from_entries(F.transform(kept, lambda x, i: F.struct(F.format_string(fixed.SENTINEL_FORMAT, i).alias("key"), x.alias("value"))))


def lock(df: DataFrame, text: str = "text", recogniser: Recogniser | None = None) -> DataFrame:
    """df with masked and mapping (sentinel -> original span)."""
    out = df.withColumn("lock_", by_row(lambda t: mask(t or "", recogniser), "struct<masked:string,kept:array<string>>")(F.col(text)))
    return out.withColumns({"masked": F.col("lock_.masked"), "mapping": mapping_of(F.col("lock_.kept"))}).drop("lock_")


def restore(masked: Column, mapping: Column) -> Column:
    """Sentinels replaced by their spans, unknown ones left, in one pass: restored text is not looked at again."""
    pieces = F.split(masked, SENTINEL, -1)
    marks = F.regexp_extract_all(masked, F.lit(SENTINEL), F.lit(0))
    back = F.transform(marks, lambda s: F.coalesce(F.try_element_at(mapping, s), s))
    return F.array_join(F.flatten(F.transform(F.arrays_zip(pieces.alias("a"), back.alias("b")), lambda x: F.array(x["a"], F.coalesce(x["b"], F.lit(""))))), "")


def sentinels(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTINEL), F.lit(0)))


def same_sentinels(text: Column, mapping: Column) -> Column:
    found, asked = sentinels(text), F.map_keys(mapping)
    return (F.size(F.array_except(found, asked)) == 0) & (F.size(F.array_except(asked, found)) == 0)


def missing_sentinels(text: Column, mapping: Column) -> Column:
    return F.array_except(F.map_keys(mapping), sentinels(text))


def pattern_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the matches of each locked pattern, before merging."""
    return df.withColumns({f"n_{k}": count_of(F.coalesce(F.col(text), F.lit("")), java(p, "ud")) for k, p in fixed.LOCKED.items()})


def merge_spans(spans: Column) -> Column:
    """An array of struct(s, e), distinct and in order, with overlapping and touching spans joined (native; for short arrays)."""
    kind = "array<struct<s:int,e:int>>"
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x["s"] <= F.element_at(acc, -1)["e"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e"))))).otherwise(F.concat(acc, F.array(x)))
    first = F.array_sort(F.array_distinct(spans)).cast(kind)
    return F.when(F.size(first) > 0, F.aggregate(F.slice(first, 2, F.greatest(F.size(first) - 1, F.lit(0))), F.slice(first, 1, 1), step)).otherwise(first)
