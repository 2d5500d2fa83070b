"""Ticker normalisation, market predicates and provider symbol dialects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions.numbers import lookup

A_SHARE_EXCHANGES = ["SH", "SZ", "BJ"]


def _owned(exchange: str) -> str:
    """Pattern of the six-digit codes an A-share exchange owns."""
    prefixes = fixed.CODE_PREFIXES[exchange]
    return f"(?:{'|'.join(prefixes)})[0-9]{{{6 - len(prefixes[0])}}}"


VALID = "|".join([rf"{_owned(e)}\.{e}" for e in A_SHARE_EXCHANGES] + [r"[0-9]{5}\.HK"])


def infer_exchange(code: Column) -> Column:
    """Exchange that owns a six-digit A-share code, null when none does."""
    owner: Column = F.lit(None).cast("string")
    for exchange in A_SHARE_EXCHANGES:
        owner = F.when(code.rlike(f"^{_owned(exchange)}$"), exchange).otherwise(owner)
    return owner


def normalize(raw: Column) -> Column:
    """Canonical ``code.EXCHANGE``; null when the text is not a valid ticker.

    Most texts are canonical already and pass after one match; the others are respelled step by step.
    """
    given = raw.cast("string")
    text = F.upper(F.translate(F.trim(given), "_-", ".."))
    text = F.regexp_replace(text, r"^(SH|SZ|BJ|HK)\.?([0-9]+)$", "$2.$1")
    for exchange in (*A_SHARE_EXCHANGES, "HK"):
        aliases = [a for a, e in fixed.EXCHANGE_ALIASES.items() if e == exchange and a != exchange]
        text = F.regexp_replace(text, rf"^([0-9]+)\.(?:{'|'.join(aliases)})$", f"$1.{exchange}")
    for exchange in A_SHARE_EXCHANGES:
        text = F.regexp_replace(text, f"^({_owned(exchange)})$", f"$1.{exchange}")
    # The only match of all, or null: to test a text for emptiness and return it would respell it twice.
    respelled = F.get(F.regexp_extract_all(text, F.lit(f"^(?:{VALID})$"), F.lit(0)), F.lit(0))
    # Not $, which also matches before a line break at the end.
    return F.when(given.rlike(rf"^(?:{VALID})\z"), given).otherwise(respelled)


def ticker_error(raw: Column) -> Column:
    return F.when(normalize(raw).isNull(), F.lit("INVALID_TICKER"))


def is_a_share(raw: Column) -> Column:
    return F.coalesce(normalize(raw).rlike(r"\.(SH|SZ|BJ)$"), F.lit(False))


def is_hk(raw: Column) -> Column:
    return F.coalesce(normalize(raw).endswith(".HK"), F.lit(False))


def provider_symbol(ticker: Column, dialect: str) -> Column:
    """Symbol a provider expects for a canonical ticker; null when it has none."""
    code, exchange = F.split_part(ticker, F.lit("."), F.lit(1)), F.split_part(ticker, F.lit("."), F.lit(2))
    if dialect == "tushare":
        return ticker
    if dialect == "baostock":
        return F.when(exchange.isin("SH", "SZ"), F.concat(F.lower(exchange), F.lit("."), code))
    if dialect == "akshare":
        return F.concat(F.lower(exchange), code)
    if dialect == "joinquant":
        suffix = lookup(exchange, {"SH": "XSHG", "SZ": "XSHE", "BJ": "XBSE"})
        return F.concat(code, F.lit("."), suffix)
    raise ValueError(f"unknown provider dialect {dialect}")


def index_symbol(raw: Column) -> Column:
    """Index code without exchange suffix, prefixed by its market."""
    code = F.regexp_replace(F.upper(F.trim(raw)), r"\.(SH|SZ)", "")
    prefixed = F.lower(code)
    return (
        F.when(prefixed.rlike("^(sh|sz|bj)"), prefixed)
        .when(code.startswith("000"), F.concat(F.lit("sh"), prefixed))
        .otherwise(F.concat(F.lit("sz"), prefixed))
    )


def registry_ticker(raw: Column) -> Column:
    """Upper-cased ticker with Hong Kong codes padded to five digits."""
    text = F.upper(F.trim(raw))
    padded = F.concat(F.lpad(F.split_part(text, F.lit("."), F.lit(1)), 5, "0"), F.lit(".HK"))
    return F.when(text.rlike(r"^\d{4,5}\.HK$"), padded).otherwise(text)


def target_id(explicit: Column, ticker: Column, name: Column, kind: str = "company") -> Column:
    """Stable research target id: explicit, else from the ticker, else from the name."""
    hashed = F.concat(F.lit(f"{kind}_"), F.substring(F.sha2(F.concat(F.lit('"'), name, F.lit('"')), 256), 1, 8))
    if kind != "company":
        return F.coalesce(explicit, hashed)
    code = F.split_part(ticker, F.lit("."), F.lit(1))
    from_ticker = F.when(
        ticker.rlike(r"(?i)^\d{4,5}\.HK$"), F.concat(F.lit("company_hk_"), F.lpad(code, 5, "0"))
    ).otherwise(F.concat(F.lit("company_"), code))
    return F.coalesce(explicit, from_ticker, hashed)
