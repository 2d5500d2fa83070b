"""Dates, instants, buckets, windows and the trading calendar."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions.numbers import lookup


def _iso(raw: Column) -> Column:
    """Trimmed text with ``yyyyMMdd`` spelled as an ISO date."""
    return F.regexp_replace(F.trim(raw.cast("string")), r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3")


def trade_date(raw: Column) -> Column:
    """Date from ``yyyyMMdd`` or ISO text; null when neither parses."""
    return F.regexp_extract(_iso(raw), r"^\d{4}-\d{2}-\d{2}(?=$|[T ])", 0).try_cast("date")


def instant(raw: Column, timezone: str = fixed.MARKET_TIMEZONE) -> Column:
    """UTC instant of a text time; texts without an offset are local to ``timezone``."""
    text = _iso(raw)
    parsed = text.try_cast("timestamp")
    offset = text.rlike(r"[T ].*(Z|[+-]\d{2}:?\d{2})$")
    return F.when(offset, parsed).otherwise(F.to_utc_timestamp(parsed, timezone))


def flexible_date(raw: Column) -> Column:
    """Date text that may use Chinese date characters, slashes or loose digits."""
    text = F.trim(raw.cast("string"))
    plain = F.regexp_replace(F.translate(text, "年月/日", "---"), r"-$", "")
    digits = F.regexp_replace(text, r"\D", "")
    loose = F.when(F.length(digits) >= 8, F.to_date(F.try_to_timestamp(F.substring(digits, 1, 8), F.lit("yyyyMMdd"))))
    return F.coalesce(trade_date(text), trade_date(plain), loose)


def partial_date(raw: Column) -> Column:
    """Timestamp from full, day, month or year text."""
    formats = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy-MM", "yyyy"]
    return F.coalesce(*[F.try_to_timestamp(raw, F.lit(f)) for f in formats])


def bar_bounds(day: Column, frequency: Column, started: Column, timezone: str = fixed.MARKET_TIMEZONE) -> Column:
    """Struct of UTC start and end instants of a bar."""
    opened = F.to_utc_timestamp(day.cast("timestamp") + F.expr("INTERVAL '9:30' HOUR TO MINUTE"), timezone)
    closed = F.to_utc_timestamp(day.cast("timestamp") + F.expr("INTERVAL '15' HOUR"), timezone)
    minutes = lookup(frequency, fixed.MINUTE_FREQUENCIES)
    begin = F.when(minutes.isNull(), opened).otherwise(F.coalesce(started, opened))
    finish = F.when(minutes.isNull(), closed).otherwise(begin + F.make_dt_interval(mins=minutes))
    return F.struct(begin.alias("bar_start"), finish.alias("bar_end"))


def second_bucket(moment: Column, seconds: int = fixed.QUOTE_BUCKET_SECONDS) -> Column:
    epoch = F.unix_timestamp(moment)
    return F.timestamp_seconds(epoch - epoch % seconds)


def minute_bucket(moment: Column, minutes: int | Column) -> Column:
    """Floor to a multiple of minutes within the day; buckets may exceed an hour."""
    width = F.lit(minutes) if isinstance(minutes, int) else minutes
    elapsed = F.hour(moment) * 60 + F.minute(moment)
    return F.date_trunc("day", moment) + F.make_dt_interval(mins=elapsed - elapsed % width)


def local_day_range(day: Column, timezone: str = fixed.MARKET_TIMEZONE) -> Column:
    """Struct of the UTC half-open range that one local calendar day covers."""
    return F.struct(
        F.to_utc_timestamp(day.cast("timestamp"), timezone).alias("from_utc"),
        F.to_utc_timestamp(F.date_add(day, 1).cast("timestamp"), timezone).alias("until_utc"),
    )


def is_trading_day(day: Column, holidays: list[str] | None = None, extra_days: list[str] | None = None) -> Column:
    """Weekdays trade unless listed as holidays; listed extra days always trade."""
    text = day.cast("string")
    weekday = F.weekday(day) < 5
    return text.isin(extra_days or []) | (weekday & ~text.isin(holidays or []))


def market_phase(local: Column, trading: Column) -> Column:
    clock = F.date_format(local, "HH:mm:ss")
    phase: Column = F.lit("off_hours")
    for name, start, end in reversed(fixed.MARKET_WINDOWS):
        phase = F.when((clock >= f"{start}:00") & (clock < f"{end}:00"), name).otherwise(phase)
    return F.when(trading, phase).otherwise("non_trading_day")


def window_days(text: Column) -> Column:
    """Days in ``30d`` / ``12w`` / ``6m`` / ``1y``."""
    return _scaled(text, r"^\s*(\d+)\s*([dwmy])\s*$", fixed.WINDOW_DAYS)


def window_minutes(text: Column) -> Column:
    """Minutes in ``10m`` / ``4h`` / ``1d`` or a bare number of minutes."""
    bare = F.trim(text).try_cast("int")
    return F.coalesce(_scaled(text, r"^\s*(\d+)([mhd])\s*$", fixed.WINDOW_MINUTES), bare)


def _scaled(text: Column, pattern: str, units: dict[str, int]) -> Column:
    lowered = F.lower(text)
    amount = F.regexp_extract(lowered, pattern, 1).try_cast("int")
    return amount * lookup(F.regexp_extract(lowered, pattern, 2), units)


def quarters_between(start: Column, end: Column) -> Column:
    """Array of ``yyyyQn`` labels of every quarter touched by the date range."""
    first, last = F.trunc(start, "quarter"), F.trunc(end, "quarter")
    steps = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 3 MONTH"))).otherwise(F.array())
    return F.transform(steps, lambda d: F.concat(F.year(d), F.lit("Q"), F.quarter(d)))


def last_quarters(end: Column, count: int = fixed.LOOKBACK_QUARTERS) -> Column:
    """Labels of the ``count`` quarters that end with the one holding ``end``."""
    return quarters_between(F.add_months(F.trunc(end, "quarter"), -3 * (count - 1)), end)


def default_window(end: Column, kind: str) -> Column:
    """Start date used when a request names only its end."""
    days = fixed.LOOKBACK_DAYS if kind == "market" else max(fixed.LOOKBACK_QUARTERS * 100, 400)
    return F.date_sub(end, days)


def cadence_due(cadence: Column, anchor: Column, day: Column) -> Column:
    """Whether a daily, weekly, monthly or quarterly demand is due on a date."""
    names = {"mon": 0, "tue": 1, "wed": 2, "thu": 3, "fri": 4, "sat": 5, "sun": 6}
    weekday = lookup(F.lower(F.substring(anchor, 1, 3)), names, F.lit(4))
    due_day = F.dayofmonth(day) == F.coalesce(anchor.try_cast("int"), F.lit(1))
    kind = F.lower(F.coalesce(cadence, F.lit("daily")))
    return (
        F.when(kind == "weekly", F.weekday(day) == weekday)
        .when(kind == "monthly", due_day)
        .when(kind == "quarterly", due_day & F.month(day).isin(1, 4, 7, 10))
        .otherwise(F.lit(True))
    )


def active_on(day: Column, start: Column, end: Column) -> Column:
    """Whether a validity interval with open null ends holds the date."""
    return (start.isNull() | (start <= day)) & (end.isNull() | (end >= day))
