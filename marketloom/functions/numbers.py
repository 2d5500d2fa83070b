"""Rounding, safe numeric parsing and alias coalescing."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom import fixed


def round_half_up(value: Column, digits: int) -> Column:
    """Round a double on its decimal digits, halves away from zero."""
    return F.round(value.cast("decimal(28,10)"), digits).cast("double")


def exact_sum(value: Column) -> Column:
    """Order-independent sum of a money or volume column."""
    return F.sum(value.cast("decimal(38,6)")).cast("double")


def exact_avg(value: Column) -> Column:
    """Order-independent mean: exact sum divided by the non-null count."""
    return F.try_divide(exact_sum(value), F.count(value).cast("double"))


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def ratio_or_null(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, round_half_up(part.cast("double") / whole.cast("double"), digits))


def relative_diff(a: Column, b: Column) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1e-12))


def present(*candidates: Column) -> Column:
    """First candidate that is neither null nor the empty string."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in candidates])


def number(*candidates: Column) -> Column:
    """First present candidate as a double, null when it is not a number."""
    parsed = present(*candidates).try_cast("double")
    return F.when(~F.isnan(parsed), parsed)


def plain_number(text: Column) -> Column:
    """Number with thousands separators removed."""
    return F.regexp_replace(text.cast("string"), ",", "").try_cast("double")


def flag(candidate: Column, default: bool = False) -> Column:
    """Boolean from mixed text, with a default for absent or unknown words."""
    text = F.lower(F.trim(candidate.cast("string")))
    return (
        F.when(text.isin(fixed.TRUE_TEXT), True)
        .when(text.isin(fixed.FALSE_TEXT), False)
        .when(text.try_cast("double").isNotNull(), text.try_cast("double") != 0)
        .otherwise(F.lit(default))
    )


def is_missing(text: Column) -> Column:
    return text.isNull() | F.trim(text.cast("string")).isin(fixed.MISSING_TOKENS)


def chinese_number(text: Column) -> Column:
    """Number with an optional magnitude character and percent sign."""
    cleaned = F.translate(F.trim(text.cast("string")), "％,", "%")
    scale = lookup(F.regexp_extract(cleaned, "[亿万千]$", 0), fixed.MAGNITUDES, F.lit(1.0))
    loose = F.regexp_extract(F.regexp_replace(cleaned, "%?[亿万千]?$", ""), r"[-+]?\d+(?:\.\d+)?", 0).try_cast("double")
    # Plain numbers, the usual case, are settled by the first cast alone.
    value = F.coalesce(cleaned.try_cast("double"), loose * scale)
    return F.when(~F.isnan(value), value)


def lookup(key: Column, table: dict, default: Column | None = None) -> Column:
    """Value for a key in a small fixed table."""
    pairs = [F.lit(item) for pair in table.items() for item in pair]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, default)


def any_contains(text: Column, words: Iterable[str]) -> Column:
    """True when the text contains any of the words literally."""
    test: Column = F.lit(False)
    for word in words:
        test = test | F.contains(text, F.lit(word))
    return F.coalesce(test, F.lit(False))


def contained(text: Column, words: Iterable[str]) -> Column:
    """Array of the words that the text contains, in list order."""
    return F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))
