"""Small column helpers that the other functions share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column, places: int = 0) -> Column:
    """Rounds halves of the double up (-2.5 to -2): what the domain's own figures are rounded by."""
    scale = float(10**places)
    return F.floor(x * scale + 0.5) / scale


def rounded(x: Column, places: int = 2) -> Column:
    """A sum or mean for a report: to the eighth place, where the order of its terms shows no more, and then halves away from zero, as decimals are."""
    return F.round(x.cast("decimal(38,8)"), places).cast("double")


def lookup(table: Mapping, key: Column) -> Column:
    """The value of a fixed table, null for other keys."""
    if not table:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return any_of(F.contains(text, F.lit(w)) for w in words)


def words_of(*words: str) -> Column:
    return F.array(*[F.lit(w) for w in words])


def among(words: Column, known: Iterable[str]) -> Column:
    """Those of an array's words that are known, repeats included."""
    known = list(known)
    return F.filter(words, lambda w: w.isin(known))


def share(part: Column, whole: Column) -> Column:
    """100 part / whole; null where the whole is 0."""
    return F.try_divide(part * 100.0, whole)


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out a single time, which also keeps the generated code small."""
    return F.element_at(F.transform(F.array(value), use), 1)
