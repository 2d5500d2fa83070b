"""Intraday price-limit, abnormality and emission formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions.numbers import clamp01, round_half_up


def limit_pct(ticker: Column, is_st: Column) -> Column:
    code = F.split_part(ticker, F.lit("."), F.lit(1))
    growth = code.rlike(f"^({'|'.join(fixed.GROWTH_PREFIXES)})")
    bse = code.rlike(f"^[{''.join(fixed.BSE_PREFIXES)}]") & (F.length(code) == 6)
    return (
        F.when(is_st, fixed.LIMIT_PCT["st"])
        .when(growth, fixed.LIMIT_PCT["growth"])
        .when(bse, fixed.LIMIT_PCT["bse"])
        .otherwise(fixed.LIMIT_PCT["main"])
    )


def limit_price(prev_close: Column, pct: Column, upper: bool) -> Column:
    return round_half_up(prev_close * (1 + pct if upper else 1 - pct), 2)


def limit_distance(close: Column, limit: Column, upper: bool) -> Column:
    gap = limit - close if upper else close - limit
    return F.when((close != 0) & limit.isNotNull(), round_half_up(F.greatest(F.lit(0.0), gap / close), 6))


def abnormality(ret: Column, amount: Column, ratio: Column, up: Column, down: Column, hit: Column) -> Column:
    """Largest of the return, amount-ratio and limit-proximity components."""
    limits = fixed.FEATURE_THRESHOLDS
    lift = F.when(amount > 0, 0.05).otherwise(0.0)

    def capped(value: Column) -> Column:
        return F.when(value.isNotNull(), clamp01(value))

    parts = [
        capped(F.abs(ret) / limits["return_abs"] * fixed.ABNORMALITY_SCALE + lift),
        capped(ratio / limits["amount_ratio"] * fixed.ABNORMALITY_SCALE),
        capped(1 - up / limits["limit_distance"]),
        capped(1 - down / limits["limit_distance"]),
        F.when(hit, 1.0),
    ]
    return round_half_up(F.greatest(*parts), 4)


def emit_reasons(
    score: Column, ret: Column, ratio: Column, up: Column, down: Column, hit_up: Column, hit_down: Column, halted: Column
) -> Column:
    """Array of every reason for which a feature row must be reported."""
    limits = fixed.FEATURE_THRESHOLDS
    candidates = [
        F.when(score >= limits["score"], f"abnormality_score>={limits['score']}"),
        F.when(F.abs(ret) >= limits["return_abs"], f"abs(return)>={limits['return_abs']}"),
        F.when(ratio >= limits["amount_ratio"], f"amount_ratio>={limits['amount_ratio']}"),
        F.when(up <= limits["limit_distance"], f"distance_to_limit_up<={limits['limit_distance']}"),
        F.when(down <= limits["limit_distance"], f"distance_to_limit_down<={limits['limit_distance']}"),
        F.when(hit_up | hit_down, "hit_limit"),
        F.when(ret <= fixed.RISK_RETURN, f"return<={fixed.RISK_RETURN}(risk_review)"),
        F.when(hit_down, "hit_limit_down(risk_review)"),
        F.when(halted, "suspended(risk_review)"),
    ]
    return F.filter(F.array(*candidates), lambda reason: reason.isNotNull())


def needs_risk_review(reasons: Column) -> Column:
    return F.exists(reasons, lambda reason: reason.endswith("(risk_review)"))


def degraded_from(bucket: Column, source: Column) -> Column:
    """Tag of a feature computed from bars coarser than its bucket."""
    wanted = F.regexp_replace(bucket, "m+$", "").try_cast("int")
    got = F.regexp_replace(source, "m+$", "").try_cast("int")
    return F.when((source != bucket) & (got > wanted), F.concat(bucket, F.lit("_to_"), source))


def position_in_range(close: Column, low: Column, high: Column) -> Column:
    return F.when(high > low, round_half_up((close - low) / (high - low), 4))
