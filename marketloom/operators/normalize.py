"""Raw provider rows to canonical records: declarative alias maps, lineage and completeness.

Each record type lists its columns as (name, kind, aliases, default). A raw row is a
map from provider column name to text, so any provider's spelling reaches one select.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions import numbers, tickers, times, units
from marketloom.operators.hotkeys import first_by_key


@dataclass(frozen=True)
class Field:
    """One canonical column: how to read it and from which raw names, first present wins."""

    name: str
    kind: str
    aliases: tuple[str, ...] = field(default=())
    default: str | None = None


# Provider column names that carry each canonical field.
TICKER_ALIASES = ("normalized_ticker", "ts_code", "provider_symbol", "symbol", "code", "证券代码", "股票代码")
SYMBOL_ALIASES = ("provider_symbol", "ts_code", "symbol", "code", "证券代码", "股票代码")
RECORD_FIELDS: dict[str, list[Field]] = {
    "security_master": [
        Field("name", "text", ("name", "股票简称", "简称")),
        Field("company_full_name", "text", ("fullname", "company_full_name", "公司全称")),
        Field("list_status", "text", ("list_status", "上市状态"), "L"),
        Field("board", "text", ("board", "板块")),
        Field("area", "text", ("area", "地区")),
        Field("industry", "text", ("industry", "行业")),
        Field("main_business", "text", ("main_business", "主营业务")),
        Field("list_date", "date", ("list_date", "上市日期")),
        Field("delist_date", "date", ("delist_date", "退市日期")),
        Field("total_share", "double", ("total_share", "总股本")),
        Field("float_share", "double", ("float_share", "流通股本")),
        Field("currency", "currency", ("currency",)),
    ],
    "trade_calendar": [
        Field("exchange", "text", ("exchange", "交易所"), "SSE"),
        Field("calendar_date", "date", ("calendar_date", "cal_date", "trade_date", "date", "日期")),
        Field("prev_trade_date", "date", ("prev_trade_date", "pretrade_date", "上一交易日")),
        Field("next_trade_date", "date", ("next_trade_date", "下一交易日")),
        Field("is_open", "flag", ("is_open", "is_trade", "open", "是否开市")),
    ],
    "trading_status": [
        Field("trade_date", "date", ("trade_date", "date", "日期")),
        Field("is_suspended", "flag", ("is_suspended", "suspended", "停牌")),
        Field("is_st", "flag", ("is_st", "ST")),
        Field("is_star_st", "flag", ("is_star_st", "*ST")),
        Field("has_delisting_risk", "flag", ("has_delisting_risk", "退市风险")),
        Field("hit_limit_up", "flag", ("hit_limit_up", "是否触及涨停")),
        Field("hit_limit_down", "flag", ("hit_limit_down", "是否触及跌停")),
        Field("limit_up_price", "double", ("limit_up_price", "涨停价")),
        Field("limit_down_price", "double", ("limit_down_price", "跌停价")),
        Field("suspend_reason", "text", ("suspend_reason", "停牌原因")),
        Field("list_status", "text", ("list_status", "上市状态")),
        Field("not_tradable_reason", "text", ("not_tradable_reason", "不可交易原因")),
    ],
    "bar": [
        Field("trade_date", "date", ("trade_date", "日期", "date")),
        Field("timestamp", "instant", ("timestamp", "time", "datetime", "trade_date", "日期", "date")),
        Field("frequency", "text", ("frequency",), "1d"),
        Field("adjust", "text", ("adjust",), "none"),
        Field("trading_session", "text", ("trading_session",), "regular"),
        Field("open", "double", ("open", "开盘")),
        Field("high", "double", ("high", "最高")),
        Field("low", "double", ("low", "最低")),
        Field("close", "double", ("close", "收盘")),
        Field("pre_close", "double", ("pre_close", "preclose", "昨收")),
        Field("change", "double", ("change", "涨跌额")),
        Field("pct_change", "double", ("pct_chg", "pct_change", "pctChg", "涨跌幅")),
        Field("turnover_rate", "double", ("turnover_rate", "turn", "换手率")),
        Field("turnover_rate_free_float", "double", ("turnover_rate_free_float", "自由流通换手率")),
        Field("adj_factor", "double", ("adj_factor",)),
        Field("volume", "volume", ("vol", "volume", "成交量")),
        Field("amount", "amount", ("amount", "money", "成交额")),
        Field("currency", "currency", ("currency",)),
    ],
    "realtime_quote": [
        Field("quote_time", "instant", ("quote_time", "time", "timestamp", "报价时间")),
        Field("latest_price", "double", ("latest_price", "price", "最新价", "close")),
        Field("open", "double", ("open", "开盘")),
        Field("high", "double", ("high", "最高")),
        Field("low", "double", ("low", "最低")),
        Field("pre_close", "double", ("pre_close", "昨收")),
        Field("bid1_price", "double", ("bid1_price", "买一价")),
        Field("ask1_price", "double", ("ask1_price", "卖一价")),
        Field("limit_up_price", "double", ("limit_up_price", "涨停价")),
        Field("limit_down_price", "double", ("limit_down_price", "跌停价")),
        Field("volume", "volume", ("vol", "volume", "成交量")),
        Field("amount", "amount", ("amount", "money", "成交额")),
    ],
    "adj_factor": [
        Field("trade_date", "date", ("trade_date", "date", "factor_event_date", "dividOperateDate")),
        Field("factor_event_date", "date", ("factor_event_date", "dividOperateDate")),
        Field("adj_factor", "double", ("adj_factor", "factor")),
        Field("fore_adjust_factor", "double", ("fore_adjust_factor", "foreAdjustFactor")),
        Field("back_adjust_factor", "double", ("back_adjust_factor", "backAdjustFactor")),
        Field("event_adjust_factor", "double", ("event_adjust_factor", "adjustFactor")),
        Field("factor_method", "text", ("factor_method",)),
    ],
    "financial_statement": [
        Field("report_period", "text", ("report_period", "end_date", "statDate", "报告期")),
        Field("statement_type", "text", ("statement_type",), "income_statement"),
        Field("report_type", "text", ("report_type",), "standard"),
        Field("report_date", "date", ("report_date", "statDate", "报告日期")),
        Field("announcement_date", "date", ("ann_date", "announcement_date", "pubDate", "公告日期")),
        Field("operating_revenue", "double", ("operating_revenue", "revenue", "MBRevenue", "营业收入")),
        Field("operating_profit", "double", ("operating_profit", "营业利润")),
        Field("net_profit", "double", ("net_profit", "netProfit", "净利润")),
        Field("parent_net_profit", "double", ("parent_net_profit", "n_income_attr_p", "归母净利润")),
        Field("total_assets", "double", ("total_assets", "总资产")),
        Field("total_liabilities", "double", ("total_liabilities", "总负债")),
        Field("parent_equity", "double", ("parent_equity", "归母权益")),
        Field("operating_cash_flow", "double", ("operating_cash_flow", "经营现金流")),
    ],
    "financial_indicator": [
        Field("report_period", "text", ("report_period", "end_date", "statDate", "报告期")),
        Field("report_date", "date", ("report_date", "statDate", "报告日期")),
        Field("announcement_date", "date", ("ann_date", "announcement_date", "pubDate", "公告日期")),
        Field("roe", "double", ("roe", "roeAvg", "dupontROE", "ROE")),
        Field("roa", "double", ("roa", "ROA")),
        Field("gross_margin", "double", ("gross_margin", "gpMargin", "grossprofit_margin", "毛利率")),
        Field("net_margin", "double", ("net_margin", "npMargin", "dupontNitogr", "netprofit_margin", "净利率")),
        Field("revenue_yoy", "double", ("revenue_yoy", "or_yoy", "营收同比")),
        Field("net_profit_yoy", "double", ("net_profit_yoy", "YOYNI", "YOYPNI", "净利润同比")),
        Field("debt_asset_ratio", "double", ("debt_asset_ratio", "liabilityToAsset", "资产负债率")),
        Field("current_ratio", "double", ("current_ratio", "currentRatio", "流动比率")),
        Field("ocf_to_net_profit", "double", ("ocf_to_net_profit", "CFOToNP", "经营现金流净利润比")),
        Field("eps", "double", ("eps", "epsTTM", "EPS")),
        Field("bps", "double", ("bps", "BPS")),
    ],
    "valuation_metric": [
        Field("trade_date", "date", ("trade_date", "date")),
        Field("pe", "double", ("pe", "PE")),
        Field("pe_ttm", "double", ("pe_ttm", "peTTM", "PE_TTM")),
        Field("pb", "double", ("pb", "pbMRQ", "PB")),
        Field("ps", "double", ("ps", "PS")),
        Field("ps_ttm", "double", ("ps_ttm", "psTTM", "PS_TTM")),
        Field("pcf_ncf_ttm", "double", ("pcf_ncf_ttm", "pcfNcfTTM", "PCF_NCF_TTM")),
        Field("dividend_yield", "double", ("dividend_yield", "股息率")),
        Field("total_market_value", "double", ("total_market_value", "total_mv", "总市值")),
        Field("float_market_value", "double", ("float_market_value", "circ_mv", "流通市值")),
        Field("turnover_rate", "double", ("turnover_rate", "turn", "换手率")),
        Field("volume_ratio", "double", ("volume_ratio", "量比")),
        Field("amount", "amount", ("amount", "money", "成交额")),
    ],
    "industry_membership": [
        Field("industry_system", "text", ("industry_system", "行业体系")),
        Field("industry_code", "text", ("industry_code", "行业代码")),
        Field("industry_name", "text", ("industry_name", "industry", "行业名称", "行业")),
        Field("industry_level", "text", ("industry_level", "行业层级"), "1"),
        Field("parent_industry_code", "text", ("parent_industry_code", "父行业代码")),
        Field("source_methodology", "text", ("source_methodology", "口径说明")),
        Field("effective_date", "date", ("effective_date", "生效日期")),
        Field("end_date", "date", ("end_date", "结束日期")),
    ],
    "concept_membership": [
        Field("concept_code", "text", ("concept_code", "概念代码")),
        Field("concept_name", "text", ("concept_name", "概念名称")),
        Field("evidence", "text", ("evidence", "证据")),
        Field("source_methodology", "text", ("source_methodology", "口径说明")),
        Field("concept_strength", "double", ("concept_strength", "关联强度")),
        Field("effective_date", "date", ("effective_date", "生效日期")),
        Field("end_date", "date", ("end_date", "结束日期")),
    ],
    "money_flow": [
        Field("trade_date", "date", ("trade_date", "date")),
        Field("frequency", "text", ("frequency",), "1d"),
        Field("source_methodology", "text", ("source_methodology", "口径说明")),
        Field("main_net_inflow", "double", ("main_net_inflow", "主力净流入")),
        Field("super_large_net_inflow", "double", ("super_large_net_inflow", "超大单净流入")),
        Field("large_net_inflow", "double", ("large_net_inflow", "大单净流入")),
        Field("medium_net_inflow", "double", ("medium_net_inflow", "中单净流入")),
        Field("small_net_inflow", "double", ("small_net_inflow", "小单净流入")),
        Field("main_net_inflow_ratio", "double", ("main_net_inflow_ratio", "主力净流入占比")),
    ],
    "index": [
        Field("index_code", "text", ("index_code", "ts_code", "指数代码")),
        Field("index_name", "text", ("index_name", "name", "指数名称")),
        Field("exchange", "text", ("exchange", "交易所")),
        Field("market", "text", ("market",), "A_share"),
        Field("index_provider", "text", ("index_provider",)),
        Field("list_date", "date", ("list_date", "上市日期")),
    ],
    "index_bar": [
        Field("index_code", "text", ("index_code", "ts_code", "指数代码")),
        Field("index_name", "text", ("index_name", "指数名称")),
        Field("frequency", "text", ("frequency",), "1d"),
        Field("trade_date", "date", ("trade_date", "date")),
        Field("timestamp", "instant", ("timestamp", "time", "trade_date", "date")),
        Field("open", "double", ("open",)),
        Field("high", "double", ("high",)),
        Field("low", "double", ("low",)),
        Field("close", "double", ("close",)),
        Field("pre_close", "double", ("pre_close",)),
        Field("change", "double", ("change",)),
        Field("pct_change", "double", ("pct_change", "pct_chg")),
        Field("volume", "double", ("volume", "vol")),
        Field("amount", "double", ("amount",)),
    ],
    "index_constituent": [
        Field("index_code", "text", ("index_code", "index_ts_code", "指数代码")),
        Field("index_name", "text", ("index_name", "指数名称")),
        Field("weight", "double", ("weight", "权重")),
        Field("effective_date", "date", ("effective_date", "in_date", "成分生效日期")),
        Field("end_date", "date", ("end_date", "out_date", "成分结束日期")),
    ],
    "corporate_action": [
        Field("action_type", "text", ("action_type", "类型"), "dividend"),
        Field("announcement_date", "date", ("announcement_date", "ann_date", "dividPlanAnnounceDate", "dividPreNoticeDate", "公告日期")),
        Field("record_date", "date", ("record_date", "dividRegistDate", "股权登记日")),
        Field("ex_date", "date", ("ex_date", "float_date", "dividOperateDate", "除权除息日", "解禁日期")),
        Field("dividend_payment_date", "date", ("dividend_payment_date", "pay_date", "dividPayDate", "派息日")),
        Field("cash_dividend_per_share", "double", ("cash_dividend_per_share", "cash_div_tax", "cash_div", "dividCashPsBeforeTax", "每股现金分红")),
        Field("stock_bonus_ratio", "double", ("stock_bonus_ratio", "stk_div", "送股比例")),
        Field("rights_issue_ratio", "double", ("rights_issue_ratio", "dividReserveToStockPs", "配股比例")),
        Field("rights_issue_price", "double", ("rights_issue_price", "配股价格")),
    ],
}
WITHOUT_IDENTITY = ("trade_calendar", "index", "index_bar")


def raw_value(raw: Column, *aliases: str) -> Column:
    """First alias that a raw row, held as a map of non-empty texts, carries."""
    return F.coalesce(*[F.try_element_at(raw, F.lit(a)) for a in aliases])


def present_values(raw: Column) -> Column:
    """A raw row without its null and empty values."""
    return F.map_filter(raw, lambda _, value: value.isNotNull() & (value != ""))


def _read(spec: Field, provider: Column) -> Column:
    value = F.col(f"_t_{spec.name}")
    if spec.kind == "double":
        return numbers.number(value)
    if spec.kind == "flag":
        return numbers.flag(value, default=False)
    if spec.kind == "date":
        return times.trade_date(value)
    if spec.kind == "instant":
        return times.instant(value)
    if spec.kind == "volume":
        implied = F.when(provider == "akshare", "hand")
        return units.volume_shares(value, F.coalesce(raw_value(F.col("raw"), "volume_unit"), implied), provider)
    if spec.kind == "amount":
        return units.amount_base(value, raw_value(F.col("raw"), "amount_unit"), provider)
    if spec.kind == "currency":
        return units.currency(value)
    return F.coalesce(value, F.lit(spec.default)) if spec.default else value


def standardise(raw_rows: DataFrame, record_type: str) -> DataFrame:
    """Canonical rows of one record type from raw rows.

    ``raw_rows`` has provider, source_api, raw (map of text) and the lineage columns
    raw_payload_id, raw_payload_ref, raw_row_index, request_id, ingested_at. Aliases are resolved
    to one text column per field first, then converted, which keeps both projections small.
    """
    raw_rows = raw_rows.withColumn("raw", present_values(F.col("raw")))
    raw = F.col("raw")
    fields = RECORD_FIELDS[record_type]
    texts = {f"_t_{f.name}": raw_value(raw, *f.aliases) for f in fields}
    columns = {f.name: _read(f, F.col("provider")) for f in fields}
    if record_type not in WITHOUT_IDENTITY:
        members = ("normalized_ticker", "con_code", "stock_code", "ts_code")
        named = raw_value(raw, *(members if record_type == "index_constituent" else TICKER_ALIASES))
        raw_rows = raw_rows.withColumn("_named", named)
        texts |= {
            "_ticker": tickers.normalize(F.col("_named")),
            "_symbol": raw_value(raw, *SYMBOL_ALIASES),
            "_exchange": raw_value(raw, "exchange", "交易所"),
        }
        ticker = F.col("_ticker")
        exchange = F.coalesce("_exchange", F.split_part(ticker, F.lit("."), F.lit(2)))
        for long, short in (("SSE", "SH"), ("SZSE", "SZ"), ("BSE", "BJ")):
            exchange = F.replace(exchange, F.lit(long), F.lit(short))
        identity = {
            "normalized_ticker": ticker,
            "provider_symbol": F.coalesce("_symbol", ticker),
            "exchange": exchange,
            "market": F.coalesce(raw_value(raw, "market", "市场"), F.lit("A_share")),
            "asset_type": F.coalesce(raw_value(raw, "asset_type"), F.lit("stock")),
        }
        columns = {**identity, **columns}
    rows = raw_rows.withColumns(texts).withColumns(columns).drop("_named", *texts)
    return _derived(rows, record_type)


def _derived(rows: DataFrame, record_type: str) -> DataFrame:
    """Columns that follow from others of the same canonical row."""
    c = F.col
    if record_type == "bar":
        bounds = times.bar_bounds(c("trade_date"), c("frequency"), c("timestamp"))
        given = numbers.number(raw_value(c("raw"), "vwap"))
        complete = numbers.flag(raw_value(c("raw"), "is_complete"), default=True)
        rows = rows.withColumn("vwap", F.coalesce(given, units.vwap(c("amount"), c("volume"))))
        rows = rows.withColumn("_b", bounds).select("*", "_b.bar_start", "_b.bar_end").drop("_b")
        return rows.withColumn("is_complete", complete)
    if record_type == "realtime_quote":
        return (
            rows.withColumn("quote_time_bucket", times.second_bucket(c("quote_time")))
            .withColumn("bid_ask_spread", units.quote_spread(c("bid1_price"), c("ask1_price")))
            .withColumn("distance_to_limit_up_pct", units.limit_distance_pct(c("latest_price"), c("limit_up_price"), True))
            .withColumn("distance_to_limit_down_pct", units.limit_distance_pct(c("latest_price"), c("limit_down_price"), False))
        )
    if record_type == "trading_status":
        trading = numbers.flag(raw_value(c("raw"), "is_trading", "交易"), default=False)
        stated = raw_value(c("raw"), "is_trading", "交易").isNotNull()
        rows = rows.withColumn("is_trading", F.when(stated, trading).otherwise(~c("is_suspended")))
        tradable = F.when(c("is_trading") & ~c("is_suspended"), "tradable").otherwise("not_tradable")
        return rows.withColumn("tradability_status", F.coalesce(raw_value(c("raw"), "tradability_status"), tradable))
    if record_type == "corporate_action":
        parts = [F.coalesce(numbers.number(raw_value(c("raw"), n)), F.lit(0.0)) for n in ("stk_bo_rate", "stk_co_rate")]
        summed = F.nullif(parts[0] + parts[1], F.lit(0.0))
        return rows.withColumn("stock_bonus_ratio", F.coalesce("stock_bonus_ratio", summed))
    if record_type in ("industry_membership", "concept_membership", "money_flow"):
        method = F.concat_ws(":", "provider", "source_api")
        rows = rows.withColumn("source_methodology", F.coalesce("source_methodology", method))
        if record_type == "industry_membership":
            rows = rows.withColumn("industry_system", F.coalesce("industry_system", "provider"))
        return rows
    if record_type == "index":
        return rows.withColumn("index_provider", F.coalesce("index_provider", "provider"))
    return rows


def with_lineage(rows: DataFrame, business: Sequence[str], record_type: str, canonical: str = "tushare") -> DataFrame:
    """Provenance per filled business field, audit columns and a content-derived record id."""
    source = F.struct(
        "provider",
        "source_api",
        F.when(F.col("provider") == canonical, "canonical").otherwise("validator").alias("source_role"),
        "raw_payload_id",
        "raw_payload_ref",
        "raw_row_index",
    )
    filled = F.filter(
        F.array(*[F.when(F.col(b).isNotNull(), F.lit(b)) for b in business]), lambda name: name.isNotNull()
    )
    return (
        rows.withColumn("record_type", F.lit(record_type))
        .withColumn("effective_provider", F.col("provider"))
        .withColumn("merge_method", F.when(F.col("provider") == canonical, "canonical_only").otherwise("fallback_single_source"))
        .withColumn("validation_status", F.lit("unvalidated"))
        .withColumn("field_provenance", F.map_from_arrays(filled, F.transform(filled, lambda _: source)))
        .withColumn("record_id", F.sha2(F.to_json(F.struct("record_type", "provider", "raw_payload_id", "raw_row_index")), 256))
    )


def unproven_fields(business: Sequence[str], provenance: Column) -> Column:
    """Filled business fields that carry no provenance."""
    filled = F.filter(
        F.array(*[F.when(F.col(b).isNotNull(), F.lit(b)) for b in business]), lambda name: name.isNotNull()
    )
    return F.array_except(filled, F.map_keys(provenance))


def has_some_factor() -> Column:
    names = ["adj_factor", "fore_adjust_factor", "back_adjust_factor", "event_adjust_factor"]
    return F.coalesce(*names).isNotNull()


def any_date_in_range(dates: Sequence[Column], start: str | None, end: str | None, every: bool = False) -> Column:
    """Whether any (or every) filled date of a row lies in a range; rows without dates fail."""
    filled = F.filter(F.array(*dates), lambda d: d.isNotNull())

    def inside(d: Column) -> Column:
        test = F.lit(True)
        if start:
            test = test & (d >= F.lit(start).cast("date"))
        if end:
            test = test & (d <= F.lit(end).cast("date"))
        return test

    if not start and not end:
        return F.lit(True)
    return (F.size(filled) > 0) & (F.forall(filled, inside) if every else F.exists(filled, inside))


# --- source-shaped rows --------------------------------------------------------------------


def overlay(limits: DataFrame, suspensions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Price limits with suspensions laid over them per ticker and date."""
    s = suspensions.select(*keys, F.upper("suspend_type").alias("_type"), F.col("suspend_timing").alias("_timing"))
    halted = F.coalesce(F.col("_type") == "S", F.lit(False))
    return (
        limits.join(s, list(keys), "full_outer")
        .withColumn("is_suspended", halted)
        .withColumn("is_trading", ~halted)
        .withColumn("tradability_status", F.when(halted, "not_tradable").otherwise("tradable"))
        .withColumn("suspend_reason", F.coalesce("_timing", "_type"))
        .drop("_type", "_timing")
    )


def fill_suspension_grid(wanted: DataFrame, suspended: DataFrame, start: str, end: str) -> DataFrame:
    """A status row for every wanted ticker and day; days without a report are tradable.

    The day grid is exploded from each ticker's own row, and meets the reports on (ticker, date).
    """
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("INTERVAL 1 DAY"))
    grid = wanted.select("ticker").withColumn("trade_date", F.explode(days))
    reports = suspended.select("ticker", "trade_date", "suspend_reason", F.lit(True).alias("_s"))
    return (
        grid.join(reports, ["ticker", "trade_date"], "left")
        .withColumn("is_suspended", F.coalesce("_s", F.lit(False)))
        .withColumn(
            "tradability_status", F.when(F.col("_s"), "suspended").otherwise("tradable_or_not_reported_suspended")
        )
        .drop("_s")
    )


def enrich(base: DataFrame, extra: DataFrame, key: str, prefer_extra: Sequence[str], prefer_base: Sequence[str]) -> DataFrame:
    """Left enrichment with per-field precedence between two master tables."""
    fields = [*prefer_extra, *prefer_base]
    joined = base.join(extra.select(key, *[F.col(f).alias(f"_x_{f}") for f in fields]), key, "left")
    for f in prefer_extra:
        joined = joined.withColumn(f, numbers.present(F.col(f"_x_{f}"), F.col(f)).cast(base.schema[f].dataType))
    for f in prefer_base:
        joined = joined.withColumn(f, numbers.present(F.col(f), F.col(f"_x_{f}")).cast(base.schema[f].dataType))
    return joined.drop(*[f"_x_{f}" for f in fields])


def expand_calendar(days: DataFrame, exchanges: Sequence[str] = ("SSE", "SZSE", "BSE")) -> DataFrame:
    """One common calendar repeated per exchange, the Beijing one marked as derived."""
    expanded = days.withColumn("exchange", F.explode(F.array(*[F.lit(e) for e in exchanges])))
    derived = F.when(F.col("exchange") == "BSE", "derived_from_sse_trade_calendar")
    return expanded.withColumn("calendar_derivation", derived).dropDuplicates(["exchange", "calendar_date"])


# Positions of the numbers in a comma-separated daily money-flow line.
KLINE_PLACES = {
    "main_net_inflow": 1, "small_net_inflow": 2, "medium_net_inflow": 3, "large_net_inflow": 4,
    "super_large_net_inflow": 5, "main_net_inflow_ratio": 6, "close": 11, "pct_change": 12,
}


def split_klines(rows: DataFrame, line: str) -> DataFrame:
    """Trade date and named numbers of comma-separated daily lines; null where a line is too short."""
    parts = F.split(line, ",")
    return (
        rows.withColumn("_parts", F.when(F.size(parts) >= 13, parts))
        .withColumn("_numbers", F.transform("_parts", numbers.chinese_number))
        .withColumn("trade_date", times.flexible_date(F.get("_parts", F.lit(0))))
        .withColumns({name: F.get("_numbers", F.lit(place)) for name, place in KLINE_PLACES.items()})
        .drop("_parts", "_numbers")
    )


def coalesce_endpoints(rows: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """One row per key from several endpoint rows; the later non-null value of each column wins."""
    return rows.groupBy(*keys).agg(
        *[F.max_by(v, F.when(F.col(v).isNotNull(), F.col(order))).alias(v) for v in values]
    )


def decorate_statements(rows: DataFrame) -> DataFrame:
    """Canonical amount names for income, balance-sheet and cash-flow rows by their endpoint."""
    api = F.col("source_api")

    def only(endpoint: str, value: Column) -> Column:
        return F.when(api == endpoint, value)

    return (
        rows.withColumn(
            "statement_type",
            numbers.lookup(api, {"income": "income_statement", "balancesheet": "balance_sheet", "cashflow": "cash_flow"}),
        )
        .withColumn("operating_revenue", only("income", F.coalesce("revenue", "total_revenue")))
        .withColumn("net_profit", only("income", F.col("n_income")))
        .withColumn("total_liabilities", only("balancesheet", F.col("total_liab")))
        .withColumn("operating_cash_flow", only("cashflow", F.col("n_cashflow_act")))
    )


def listing_union(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union of listing-status partitions, one row per key, the earlier partition first."""
    numbered = [p.withColumn("_part", F.lit(i)) for i, p in enumerate(parts)]
    united = numbered[0]
    for part in numbered[1:]:
        united = united.unionByName(part, allowMissingColumns=True)
    return first_by_key(united, keys, ["_part"]).drop("_part")
