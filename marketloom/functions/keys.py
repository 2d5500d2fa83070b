"""Idempotency keys and stable hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def joined_key(*parts: Column) -> Column:
    """Parts joined by colons, blanks as underscores, nulls as ``None``."""
    texts = [F.coalesce(F.replace(p.cast("string"), F.lit(" "), F.lit("_")), F.lit("None")) for p in parts]
    return F.concat_ws(":", *texts)


def text_hash(text: Column, length: int = 16) -> Column:
    """Leading hex digits of the hash of a JSON string literal."""
    quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.substring(F.sha2(quoted, 256), 1, length)


def row_hash(*columns: Column) -> Column:
    """Content hash of several columns; equal rows get equal ids on every run."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def request_key(
    module: Column,
    request_type: Column,
    provider: Column,
    tickers: Column,
    universe: Column,
    exchanges: Column,
    start: Column,
    end: Column,
    frequency: Column,
    adjust: Column,
    fields: Column,
    providers: Column | None = None,
    version: str = "v0.1",
) -> Column:
    """Key of a data request; list slots are sorted, absent slots read ``none``."""

    def slot(value: Column) -> Column:
        return F.coalesce(F.nullif(value.cast("string"), F.lit("")), F.lit("none"))

    def listed(values: Column) -> Column:
        return slot(F.array_join(F.array_sort(F.filter(values, lambda v: v != "")), ","))

    def day(value: Column) -> Column:
        return slot(F.replace(value.cast("string"), F.lit("-"), F.lit("")))

    identity = (
        F.when(F.coalesce(F.size(tickers), F.lit(0)) > 0, listed(tickers))
        .when(F.coalesce(universe, F.lit("")) != "", universe)
        .otherwise(listed(exchanges))
    )
    parts = [module, request_type, provider, identity, day(start), day(end), slot(frequency), slot(adjust), listed(fields)]
    if providers is not None:
        parts.append(listed(providers))
    return F.concat_ws(":", *parts, F.lit(version))
