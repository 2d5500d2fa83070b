"""Volume, amount and currency conversion, and small price formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions.numbers import chinese_number, is_missing, lookup, plain_number, round_half_up


def _unit(unit: Column, provider: Column, provider_default: str) -> Column:
    given = F.lower(F.coalesce(unit, F.lit("")))
    return F.when((given == "") & (provider == "tushare"), F.lit(provider_default)).otherwise(given)


def volume_shares(value: Column, unit: Column, provider: Column) -> Column:
    """Volume in shares; null for an unsupported unit."""
    return plain_number(value) * lookup(_unit(unit, provider, "hand"), fixed.VOLUME_UNITS)


def amount_base(value: Column, unit: Column, provider: Column) -> Column:
    """Amount in whole currency units; null for an unsupported unit."""
    return plain_number(value) * lookup(_unit(unit, provider, "thousand_cny"), fixed.AMOUNT_UNITS)


def amount_currency(unit: Column) -> Column:
    return F.when(F.lower(unit).isin(fixed.HKD_UNITS), "HKD").otherwise("CNY")


def unit_error(unit: Column, supported: dict[str, float]) -> Column:
    known = F.coalesce(F.lower(unit), F.lit("")).isin(list(supported))
    return F.when(~known, F.lit("NORMALIZATION_FAILED"))


def currency(value: Column) -> Column:
    upper = F.upper(F.trim(value))
    blank = upper.isNull() | (upper == "")
    return F.when(blank, F.lit("CNY")).otherwise(lookup(upper, fixed.CURRENCY_ALIASES, upper))


def vwap(amount: Column, volume: Column) -> Column:
    return F.when(volume != 0, amount / volume)


def estimated_amount(open_: Column, high: Column, low: Column, close: Column, hands: Column) -> Column:
    """Mean of the quoted prices times volume in hands times 100 shares."""
    prices = F.array(*[chinese_number(p) for p in (open_, high, low, close)])
    mean = F.aggregate(
        prices,
        F.struct(F.lit(0.0).alias("total"), F.lit(0).alias("n")),
        lambda acc, p: F.when(p.isNull(), acc).otherwise(F.struct((acc["total"] + p).alias("total"), (acc["n"] + 1).alias("n"))),
        lambda acc: F.when(acc["n"] > 0, acc["total"] / acc["n"]),
    )
    return mean * chinese_number(hands) * 100.0


def amount_or_estimate(actual: Column, estimate: Column) -> Column:
    """Struct of the amount and whether it had to be estimated."""
    missing = is_missing(actual)
    return F.struct(
        F.when(missing, estimate).otherwise(chinese_number(actual)).alias("amount"),
        (missing & estimate.isNotNull()).alias("amount_is_estimated"),
    )


def net_inflow(bought: Column, sold: Column) -> Column:
    known = bought.isNotNull() | sold.isNotNull()
    return F.when(known, F.coalesce(bought, F.lit(0.0)) - F.coalesce(sold, F.lit(0.0)))


def quote_spread(bid: Column, ask: Column) -> Column:
    return ask - bid


def limit_distance_pct(latest: Column, limit: Column, upper: bool) -> Column:
    gap = limit - latest if upper else latest - limit
    return F.when((latest != 0) & (limit != 0), gap / latest * 100)


def ah_premium_pct(a_price: Column, h_price: Column, fx: Column) -> Column:
    """Percent by which the A-share price in HKD exceeds the H-share price."""
    usable = (a_price != 0) & (h_price != 0) & (fx != 0)
    return F.when(usable, round_half_up((a_price * fx / h_price - 1.0) * 100, 4))


def token_cost(input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column) -> Column:
    return round_half_up((input_tokens * input_price + output_tokens * output_price) / 1_000_000, 6)
