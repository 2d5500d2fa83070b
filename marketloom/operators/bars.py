"""Price bars: validity, readers, point-in-time adjustment and roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions.numbers import exact_sum, round_half_up
from marketloom.operators.hotkeys import asof_join, latest_by_key

PRICES = ["open", "high", "low", "close", "pre_close"]
GROUP = ["ticker", "effective_provider"]


def bar_errors() -> Column:
    """Array of the reasons why a bar row is not acceptable."""
    o, h, lo, c = (F.col(name) for name in ("open", "high", "low", "close"))
    checks = [
        F.when(~F.col("adjust").isin("none", "qfq", "hfq"), "invalid_adjust"),
        F.when((h < F.greatest(o, c, lo)) | (lo > F.least(o, c, h)), "ohlc_out_of_order"),
        F.when(F.least(o, h, lo, c) < 0, "negative_price"),
        F.when((F.col("volume") < 0) | (F.col("amount") < 0), "negative_volume_or_amount"),
    ]
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def split_valid(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid bars, and rejected bars with their reasons."""
    checked = bars.withColumn("reject_reasons", bar_errors())
    good = checked.where(F.size("reject_reasons") == 0).drop("reject_reasons")
    return good, checked.where(F.size("reject_reasons") > 0)


def trading_ready(bars: DataFrame, minimum_quality: float = fixed.MINIMUM_TRADING_QUALITY) -> DataFrame:
    return bars.where((F.col("validation_status") != "quarantined") & (F.col("data_quality") >= minimum_quality))


def query_bars(
    bars: DataFrame,
    start: str,
    end: str,
    frequency: str = "1d",
    adjust: str = "none",
    tickers: Sequence[str] | None = None,
    ready: bool = False,
) -> DataFrame:
    """Bars of a date range, frequency and adjustment, for some or all tickers."""
    found = bars.where(
        F.col("trade_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
        & (F.col("frequency") == frequency)
        & (F.col("adjust") == adjust)
    )
    if tickers is not None:
        found = found.where(F.col("ticker").isin(list(tickers)))
    return trading_ready(found) if ready else found


POOLED = "*"


def _keyed_factors(factors: DataFrame) -> DataFrame:
    """Factors under their own provider and again under a pooled key, one per ticker, key and day.

    Several providers may publish a factor on one day; in the pool the last provider by name decides.
    """
    named = factors.withColumn("factor_provider", F.col("effective_provider")).drop("effective_provider")
    keyed = named.withColumn("factor_key", F.explode(F.array("factor_provider", F.lit(POOLED))))
    return latest_by_key(keyed, ["ticker", "factor_key", "trade_date"], ["factor_provider"])


def adjust_prices(bars: DataFrame, factors: DataFrame, adjust: str, span: tuple[str, str]) -> DataFrame:
    """Forward (qfq) or backward (hfq) adjusted view of the raw bars of a date span, for every ticker at once.

    Each bar takes the latest factor row at or before its date, from its own provider if that has any
    for the ticker, else from all providers. A provider group in which no bar found a factor takes the
    next factor row instead.
    """
    if adjust not in ("qfq", "hfq"):
        return bars
    owners = factors.select("ticker", "effective_provider").distinct().withColumn("_own", F.lit(True))
    known = bars.where("effective_provider is not null").join(owners, GROUP, "left")
    probes = known.withColumn("factor_key", F.when(F.col("_own"), F.col("effective_provider")).otherwise(POOLED)).drop("_own")
    names = ["adj_factor", "fore_adjust_factor", "back_adjust_factor", "factor_method", "factor_provider"]
    matched = asof_join(probes, _keyed_factors(factors), ["ticker", "factor_key"], "trade_date", names, span)
    own_factor = F.col("adj_factor") if "adj_factor" in bars.columns else F.lit(None).cast("double")

    def seen(side: str) -> list[Column]:
        adj = F.coalesce(F.col(f"{side}.adj_factor"), own_factor)
        fore, back = F.col(f"{side}.fore_adjust_factor"), F.col(f"{side}.back_adjust_factor")
        source = F.lower(F.concat_ws("|", f"{side}.factor_provider", f"{side}.factor_method"))
        return [
            F.coalesce(F.bool_or(F.coalesce(adj, fore, back).isNotNull()), F.lit(False)).alias(f"{side}_any_factor"),
            F.coalesce(F.bool_or(fore.isNotNull()), F.lit(False)).alias(f"{side}_any_fore"),
            F.coalesce(F.bool_or(adj.isNotNull()), F.lit(False)).alias(f"{side}_any_adj"),
            F.coalesce(F.bool_or(source.contains("baostock")), F.lit(False)).alias(f"{side}_direct"),
            F.max_by(adj, F.when(adj.isNotNull(), F.col("trade_date"))).alias(f"{side}_last_adj"),
        ]

    facts = ["any_fore", "any_adj", "direct", "last_adj"]
    stats = matched.groupBy(*GROUP).agg(*seen("prev"), *seen("next"))
    group = stats.select(
        *GROUP,
        F.col("prev_any_factor").alias("backward"),
        *[F.when(F.col("prev_any_factor"), F.col(f"prev_{n}")).otherwise(F.col(f"next_{n}")).alias(n) for n in facts],
    )
    rows = matched.join(group, GROUP)
    pick = F.when(F.col("backward"), F.col("prev")).otherwise(F.col("next"))
    adj = F.coalesce(pick["adj_factor"], own_factor)
    if adjust == "hfq":
        factor = F.coalesce(pick["back_adjust_factor"], adj)
    else:
        use_fore = F.col("any_fore") & (F.col("direct") | ~F.col("any_adj"))
        base = F.coalesce(F.nullif("last_adj", F.lit(0.0)), F.lit(1.0))
        factor = F.when(use_fore, pick["fore_adjust_factor"]).otherwise(adj / base)
    # Intervals cover the whole span of every ticker with factors, so no interval means no factors.
    has_factor = F.col("prev").isNotNull() | F.col("next").isNotNull()
    applied = F.when(has_factor, F.coalesce(factor, F.lit(1.0)))
    prices = [p for p in PRICES if p in bars.columns]
    return rows.withColumn("applied_adjust_factor", applied).select(
        *[
            (F.col(c) * F.coalesce("applied_adjust_factor", F.lit(1.0))).alias(c) if c in prices else F.col(c)
            for c in bars.columns
            if c != "adjust"
        ],
        *[F.col(c).alias(f"raw_{c}") for c in prices],
        "applied_adjust_factor",
        F.lit(adjust).alias("adjust"),
        F.when(F.col("applied_adjust_factor").isNotNull(), "calculated_from_raw_bars_and_adj_factor")
        .otherwise("no_adj_factor_available_raw_prices_returned")
        .alias("adjustment_source"),
    )


def adjusted_bars(bars: DataFrame, factors: DataFrame, start: str, end: str, adjust: str, ready: bool = True) -> DataFrame:
    """Stored adjusted bars where a ticker has any in range, computed ones for all other tickers."""
    stored = query_bars(bars, start, end, adjust=adjust, ready=ready)
    raw = query_bars(bars, start, end, adjust="none", ready=ready)
    missing = raw.join(stored.select("ticker").distinct(), "ticker", "left_anti").select(*raw.columns)
    return stored.unionByName(adjust_prices(missing, factors, adjust, (start, end)), allowMissingColumns=True)


def rollup(ticks: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """Bars from finer rows: first open, last close, extremes, exact sums, return and vwap."""
    bars = ticks.groupBy(*keys).agg(
        F.min_by("open", sequence).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", sequence).alias("close"),
        exact_sum(F.col("volume")).alias("volume"),
        exact_sum(F.col("amount")).alias("amount"),
    )
    return bars.withColumn(
        "return_window", F.coalesce(F.try_divide("close", "open") - 1, F.lit(0.0))
    ).withColumn("vwap", F.try_divide("amount", "volume"))


def previous_close(daily: DataFrame, key: str = "ticker") -> DataFrame:
    """Close of the trading day before, per day; one key has one row per calendar day."""
    by_day = Window.partitionBy(key).orderBy("trade_date")
    return daily.withColumn("prev_close", F.lag("close").over(by_day))


def pct_change(series: DataFrame, key: str, day: str, value: str, periods: Sequence[int] = (1, 5, 20)) -> DataFrame:
    """Percent change over n non-null observations; one key has one value per calendar day."""
    by_day = Window.partitionBy(key).orderBy(day)
    out = series.where(F.col(value).isNotNull())
    for n in periods:
        base = F.nullif(F.lag(value, n).over(by_day), F.lit(0.0))
        out = out.withColumn(f"change_{n}d", round_half_up((F.col(value) / base - 1.0) * 100.0, 4))
    return out


def trading_neighbours(calendar: DataFrame, keys: Sequence[str] = ("exchange",)) -> DataFrame:
    """Previous and next open day of every calendar day."""
    by_day = Window.partitionBy(*keys).orderBy("calendar_date")
    back = Window.partitionBy(*keys).orderBy(F.desc("calendar_date"))
    open_day = F.when(F.col("is_open"), F.col("calendar_date"))
    others = (Window.unboundedPreceding, -1)
    return calendar.withColumn("prev_trade_date", F.max(open_day).over(by_day.rowsBetween(*others))).withColumn(
        "next_trade_date", F.min(open_day).over(back.rowsBetween(*others))
    )
