"""Intraday feature rows from bucketed bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions import market
from marketloom.functions.numbers import round_half_up
from marketloom.operators.bars import previous_close


def same_bucket_ratio(buckets: DataFrame, minimum_days: int = fixed.SAME_BUCKET_MIN_DAYS) -> DataFrame:
    """Amount of a bucket over the mean of the same time of day on all earlier days with turnover.

    A (ticker, time of day) group has at most one row per calendar day.
    """
    earlier = (
        Window.partitionBy("ticker", "bucket_clock").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, -1)
    )
    traded = F.when(F.col("amount") > 0, F.col("amount").cast("decimal(28,6)"))
    days, total = F.count(traded).over(earlier), F.sum(traded).over(earlier).cast("double")
    usable = (days >= minimum_days) & (F.col("amount") > 0)
    return buckets.withColumn("amount_ratio", F.when(usable, round_half_up(F.col("amount") / (total / days), 4)))


def day_range(buckets: DataFrame) -> DataFrame:
    """High and low of the whole day next to every bucket, and the close's position between them."""
    day = Window.partitionBy("ticker", "trade_date")
    ranged = buckets.withColumn("day_high", F.max("high").over(day)).withColumn("day_low", F.min("low").over(day))
    position = market.position_in_range(F.col("close"), F.col("day_low"), F.col("day_high"))
    return ranged.withColumn("position_in_range", position)


def build(buckets: DataFrame, daily: DataFrame, status: DataFrame) -> DataFrame:
    """Feature rows: buckets with ratio, day range, previous close, limits, score and emission reasons.

    ``buckets`` has ticker, trade_date, bucket_clock and rolled-up bars; ``daily`` one close per
    ticker and day; ``status`` one row per ticker with is_st and is_suspended.
    """
    closes = previous_close(daily).select("ticker", "trade_date", "prev_close")
    rows = (
        day_range(same_bucket_ratio(buckets))
        .join(closes, ["ticker", "trade_date"], "left")
        .join(status, "ticker", "left")
        .withColumn("is_st", F.coalesce("is_st", F.lit(False)))
        .withColumn("is_suspended", F.coalesce("is_suspended", F.lit(False)))
    )
    close, prev = F.col("close"), F.nullif("prev_close", F.lit(0.0))
    rows = rows.withColumn("limit_pct", F.when(prev.isNotNull(), market.limit_pct(F.col("ticker"), F.col("is_st"))))
    for side, upper in (("up", True), ("down", False)):
        rows = rows.withColumn(f"limit_{side}", market.limit_price(prev, F.col("limit_pct"), upper))
        rows = rows.withColumn(f"distance_{side}", market.limit_distance(close, F.col(f"limit_{side}"), upper))
    rows = (
        rows.withColumn("day_return", round_half_up(close / prev - 1, 6))
        .withColumn("hit_up", F.coalesce(close >= F.col("limit_up") - 1e-6, F.lit(False)))
        .withColumn("hit_down", F.coalesce(close <= F.col("limit_down") + 1e-6, F.lit(False)))
    )
    c = F.col
    rows = rows.withColumn(
        "abnormality_score",
        market.abnormality(
            c("return_window"), c("amount"), c("amount_ratio"), c("distance_up"), c("distance_down"), c("hit_up") | c("hit_down")
        ),
    )
    reasons = market.emit_reasons(
        c("abnormality_score"), c("return_window"), c("amount_ratio"), c("distance_up"), c("distance_down"),
        c("hit_up"), c("hit_down"), c("is_suspended"),
    )
    return (
        rows.withColumn("reasons", reasons)
        .withColumn("emit", F.size("reasons") > 0)
        .withColumn("risk_review", market.needs_risk_review(F.col("reasons")))
    )
