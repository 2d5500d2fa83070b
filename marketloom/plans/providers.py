"""Queries on provider comparison, merging, scoring, raw landing and table storage."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions import keys
from marketloom.functions.numbers import lookup, round_half_up
from marketloom.operators import normalize, providers
from marketloom.operators.hotkeys import latest_by_key
from marketloom.plans.registry import query, r
from marketloom.plans import comparison, views
from marketloom.plans.comparison import TYPES
from marketloom.plans.views import cycle, cycle_sql
from marketloom.session import scratch_root
from marketloom.sources import directory, raw_store, tables

FIELDS = ["close", "volume", "amount", "vwap", "name", "is_suspended"]


def _numeric(field: str, rel: str, absolute: str | None, level: str) -> str:
    gap = f"abs(a.{field} - b.{field}) / greatest(abs(a.{field}), abs(b.{field}), 1e-12::double)"
    within = f"{gap} <= {rel}::double" + (f" or abs(a.{field} - b.{field}) <= {absolute}::double" if absolute else "")
    return f"""select a.comparison_key, a.provider as canonical_provider, b.provider as other_provider, '{field}' as field_name,
      a.{field} = b.{field} as same, case when not ({within}) then {level.format(gap=gap)} end as severity
      from c_base a join c_other b using (comparison_key) where a.{field} is not null and b.{field} is not null"""


_EST = "and a.source_api not like '%stock_zh_a_hist_tx%' and b.source_api not like '%stock_zh_a_hist_tx%'"
_NAME = "regexp_replace(regexp_replace(lower({t}), '\\s+', '', 'g'), 'ltd[.]$', '')"
_CHECKS = f"""
c_canon as (select * from v_quotes where provider = 'tushare'),
c_theirs as (select * from v_quotes where provider <> 'tushare'),
c_stand as (select * exclude (rn) from (select *, row_number() over (partition by comparison_key order by provider) as rn
            from c_theirs where comparison_key not in (select comparison_key from c_canon)) where rn = 1),
c_base0 as (select *, 1 as canon from c_canon union all select *, 0 from c_stand),
c_other as (select * from c_theirs where (comparison_key, provider) not in (select (comparison_key, provider) from c_stand)),
c_base as (select b.* exclude (vwap, canon), case when b.vwap is null and b.canon = 1 then s.v else b.vwap end as vwap, canon,
                  b.vwap is null and b.canon = 1 and s.v is not null as filled
           from c_base0 b left join (select comparison_key, arg_min(vwap, provider) filter (where vwap is not null) as v from c_other group by 1) s
           using (comparison_key)),
checks as (
 {_numeric("close", "0.0001", "0.01", "case when {gap} > 0.2::double then 'critical' else 'high' end")}
 union all {_numeric("volume", "0.005", None, "'high'")}
 union all {_numeric("amount", "0.01", None, "case when {gap} > 10.0::double then 'critical' else 'high' end")} {_EST}
 union all select a.comparison_key, a.provider, b.provider, 'vwap', a.vwap = b.vwap,
   case when cast(a.vwap as varchar) <> cast(b.vwap as varchar) then 'low' end
   from c_base a join c_other b using (comparison_key) where a.vwap is not null and b.vwap is not null {_EST}
 union all select a.comparison_key, a.provider, b.provider, 'name', a.name = b.name,
   case when {_NAME.format(t="a.name")} <> {_NAME.format(t="b.name")} then 'low' end
   from c_base a join c_other b using (comparison_key)
 union all select a.comparison_key, a.provider, b.provider, 'is_suspended', a.is_suspended = b.is_suspended,
   case when a.is_suspended <> b.is_suspended then 'critical' end
   from c_base a join c_other b using (comparison_key))"""


def _met(v, whitelist=()):
    return providers.meet(v.quotes(), "tushare", FIELDS, whitelist, rows_per_task=3 * views.PART_ROWS)  # a part has up to three records


# Comparing only against present canonical rows; the stand-in rows appear in the merge queries.
_CANON_CHECKS = _CHECKS + ", k as (select * from checks where canonical_provider = 'tushare')"


def _unfilled(text: str) -> str:
    """The same checks before missing fields are filled."""
    return text.replace("case when b.vwap is null and b.canon = 1 then s.v else b.vwap end as vwap", "b.vwap as vwap")


@query(
    "J5 J6 F33 A17",
    "v_quotes",
    "with " + _unfilled(_CANON_CHECKS) + """ select comparison_key, other_provider, field_name, severity from k where severity is not null""",
)
def provider_conflicts(v):
    found = providers.conflicts(_met(v)).where("has_canonical")
    return found.select("comparison_key", "other_provider", "field_name", "severity")


@query(
    "J5 A14",
    "v_quotes",
    "with "
    + _unfilled(_CANON_CHECKS)
    + """ select comparison_key, other_provider, count(*) as checked_fields, count(*) filter (where severity is null) as matched_fields,
    count(severity) as conflicted_fields, case when count(severity) = 0 then 'matched' else 'conflicted' end as status
    from k group by 1, 2""",
)
def provider_comparisons(v):
    counts = [F.col(c).cast("long").alias(c) for c in ("checked_fields", "matched_fields", "conflicted_fields")]
    return providers.comparison_results(_met(v)).select("comparison_key", "other_provider", *counts, "status")


@query(
    "A14 P10",
    "v_quotes",
    "with "
    + _unfilled(_CANON_CHECKS)
    + """ select field_name, severity, count(*) as conflicts from k where severity is not null and contains(comparison_key, 'P1') group by 1, 2""",
)
def conflict_summary(v):
    found = providers.conflicts(_met(v)).where(F.col("has_canonical") & F.contains("comparison_key", F.lit("P1")))
    return found.groupBy("field_name", "severity").agg(F.count("*").alias("conflicts"))


_MERGE = (
    "with "
    + _CHECKS
    + """,
rank as (select *, case severity when 'low' then 1 when 'medium' then 2 when 'high' then 3 when 'critical' then 4 end as rk,
         case severity when 'low' then -0.05 when 'medium' then -0.12 when 'high' then -0.25 when 'critical' then -0.50 end as pen from checks),
worst as (select comparison_key, max(rk) as worst, count(severity) as bad, cast(sum(pen) as double) as penalty from rank group by 1),
supp as (select comparison_key, count(*) as supplements from c_other group by 1),
vals as (select comparison_key, field_name, count(*) as votes, count(severity) as bad from checks group by 1, 2),
m as (select b.*, coalesce(s.supplements, 0) as supplements, w.worst, coalesce(w.bad, 0) as bad, w.penalty
      from c_base b left join supp s using (comparison_key) left join worst w using (comparison_key)),
mm as (select *, case when canon = 0 and supplements = 0 then 'fallback_single_source' when canon = 0 and bad = 0 then 'fallback_multi_source_agreed'
       when canon = 0 then 'manual_review_required' when supplements = 0 then 'canonical_only'
       when bad = 0 and filled then 'fill_missing_from_supplement' when bad = 0 then 'canonical_validated'
       when worst >= 3 then 'quarantined_due_to_conflict' else 'canonical_with_warning' end as merge_method from m),
st as (select *, case when merge_method in ('fallback_single_source', 'canonical_only', 'fill_missing_from_supplement') then 'validated_with_warning'
       when merge_method in ('fallback_multi_source_agreed', 'canonical_validated') then 'validated'
       when merge_method = 'quarantined_due_to_conflict' then 'quarantined' when merge_method = 'manual_review_required' then merge_method
       when worst = 2 then 'conflicted_medium' else 'conflicted_low' end as validation_status from mm),
q as (select *, case worst when 1 then 0.85::double when 2 then 0.70::double when 3 then 0.45::double when 4 then 0.10::double else 1.0::double end as cons,
      case when has_provenance then 1.0::double else 0.0::double end as prov from st),
sc as (select *, greatest(0.0::double, least(1.0::double, greatest(0.0::double, least(1.0::double,
        0.25::double * ((case when open is null then 0 else 1 end + case when close is null then 0 else 1 end
        + case when volume is null then 0 else 1 end + case when amount is null then 0 else 1 end) / 4.0::double) + 0.3::double * cons + 0.15::double
        + 0.1::double * case provider when 'tushare' then 0.9::double when 'akshare' then 0.75::double else 0.7::double end
        + 0.1::double * case when cons >= 0.7::double then 1.0::double else 0.5::double end
        + 0.1::double * case when raw_payload_ref is not null then prov else least(prov, 0.4::double) end))
        + case merge_method when 'canonical_validated' then 0.08::double when 'canonical_only' then -0.05::double
          when 'fallback_single_source' then -0.15::double when 'fallback_multi_source_agreed' then -0.08::double else 0.0::double end
        + coalesce(penalty, 0.0::double) + case when raw_payload_ref is not null then 0.0::double else -0.3::double end
        + case when has_provenance then 0.0::double else -0.2::double end)) as data_quality from q)
"""
)


def _merged(v):
    return providers.merge(_met(v, ["vwap"]))


@query(
    "F34 P27",
    "v_quotes",
    _MERGE
    + """, sus as (select c.comparison_key from (select comparison_key, field_name, min(v) as lo, max(v) as hi, count(*) as votes, max(o) as ours, count(severity) as bad
      from (select k.*, case k.field_name when 'close' then cast(b.close as varchar) when 'volume' then cast(b.volume as varchar)
              when 'amount' then cast(b.amount as varchar) when 'vwap' then cast(b.vwap as varchar) when 'name' then b.name else cast(b.is_suspended as varchar) end as v,
            case k.field_name when 'close' then cast(a.close as varchar) when 'volume' then cast(a.volume as varchar)
              when 'amount' then cast(a.amount as varchar) when 'vwap' then cast(a.vwap as varchar) when 'name' then a.name else cast(a.is_suspended as varchar) end as o
            from checks k join c_base a on a.comparison_key = k.comparison_key
            join c_other b on b.comparison_key = k.comparison_key and b.provider = k.other_provider) group by 1, 2) c
      join supp s using (comparison_key) where bad > 0 and supplements >= 2 and votes = supplements and lo = hi and lo <> ours group by 1)
    select comparison_key, provider, supplements, merge_method, validation_status,
      canon = 1 and comparison_key in (select comparison_key from sus) as canonical_value_suspect,
      """ + r("vwap", 6) + """ as vwap, filled as was_filled from st""",
)
def merged_records(v):
    return _merged(v).select(
        "comparison_key", "provider", F.size("supplements").cast("long").alias("supplements"), "merge_method", "validation_status", "canonical_value_suspect",
        round_half_up(F.col("vwap"), 6).alias("vwap"), (F.size("supplement_flags") > 0).alias("was_filled"),
    )


@query("F32 A17", "v_quotes", _MERGE + f"select comparison_key, merge_method, {r('data_quality', 6)} as data_quality from sc")
def quality_scores(v):
    scored = providers.rescore(_merged(v), "bar")
    return scored.select("comparison_key", "merge_method", round_half_up(F.col("data_quality"), 6).alias("data_quality"))


@query(
    "A15",
    "v_quotes",
    _MERGE
    + f"""select count(*) as records, {r("cast(sum(cast(data_quality as decimal(20,10))) as double) / count(*)", 6)} as data_quality_score,
    {r("avg(case when has_provenance and raw_payload_ref is not null then 1 else 0 end)", 6)} as provenance_score,
    case when (select count(*) from checks where severity is not null) > 0 then 0.0::double else 1.0::double end as consistency_score,
    case when (select count(*) from checks where severity is not null) > 0 then 0.5::double else 1.0::double end as anomaly_score from sc""",
)
def run_quality_report(v):
    report = providers.quality_report(providers.rescore(_merged(v), "bar"))
    return report.select(
        "records",
        round_half_up(F.col("data_quality_score"), 6).alias("data_quality_score"),
        round_half_up(F.col("provenance_score"), 6).alias("provenance_score"),
        "consistency_score",
        "anomaly_score",
    )


_FETCH = """
with fetches as (select 'req' || cast(user_id % 40 as varchar) as request_id, provider, event_type as source_api, k as rows_fetched,
   ['success', 'success', 'failed', 'unavailable', 'empty_result'][cast(k % 5 as int) + 1] as status,
   case k % 5 when 2 then 'PROVIDER_TIMEOUT' when 3 then 'PROVIDER_UNAVAILABLE' when 4 then 'EMPTY_RESULT' end as error_code, event_id from v_events)"""


def _fetches(v):
    codes = {2: "PROVIDER_TIMEOUT", 3: "PROVIDER_UNAVAILABLE", 4: "EMPTY_RESULT"}
    return v.events().select(
        F.concat(F.lit("req"), (F.col("user_id") % 40).cast("string")).alias("request_id"),
        "provider",
        F.col("event_type").alias("source_api"),
        F.col("k").cast("long").alias("rows_fetched"),
        cycle(F.col("k"), ["success", "success", "failed", "unavailable", "empty_result"]).alias("status"),
        lookup((F.col("k") % 5).cast("int"), codes).alias("error_code"),
        "event_id",
        "confidence",
    )


@query(
    "A13",
    "v_events",
    _FETCH + "select provider, source_api, status, count(*) as calls, cast(sum(rows_fetched) as bigint) as rows_fetched from fetches group by all",
)
def fetch_summary(v):
    return _fetches(v).groupBy("provider", "source_api", "status").agg(
        F.count("*").alias("calls"), F.sum("rows_fetched").alias("rows_fetched")
    )


@query(
    "A16",
    "v_events",
    _FETCH
    + """select request_id, provider, cast(sum(rows_fetched) as bigint) as rows_fetched,
     case when sum(rows_fetched) = 0 and bool_or(error_code is not null) then 'failed'
          when sum(rows_fetched) = 0 or coalesce(bool_or(error_code <> 'EMPTY_RESULT'), false) or bool_or(status in ('failed', 'unavailable'))
          then 'partial_success' else 'success' end as response_status from fetches group by all""",
)
def response_statuses(v):
    return providers.response_status(_fetches(v), ["request_id", "provider"])


@query(
    "A27",
    "v_events",
    """with runs as (select user_id as run_id, bool_or(k = 99) as crit, bool_or(k = 98) as high, bool_or(k = 97) as blocked,
       avg(confidence) < 0.8::double as below, max(case when k < 50 then 'success' else 'partial_success' end) as status from v_events group by 1)
    select run_id, case when crit or blocked then 'quarantine' when high then 'accept_with_review' when below then 'accept_degraded'
       when status = 'partial_success' then 'accept_degraded' when status = 'success' then 'accept' else 'reject' end as decision,
       case when crit or blocked then 'P0' when high then 'P1' when below or status = 'partial_success' then 'P2' when status = 'success' then 'P3' else 'P1' end as severity
    from runs""",
)
def quality_gate_decisions(v):
    runs = v.events().groupBy(F.col("user_id").alias("run_id")).agg(
        F.bool_or(F.col("k") == 99).alias("crit"),
        F.bool_or(F.col("k") == 98).alias("high"),
        F.bool_or(F.col("k") == 97).alias("blocked"),
        (F.avg("confidence") < 0.8).alias("below"),
        F.max(F.when(F.col("k") < 50, "success").otherwise("partial_success")).alias("status"),
    )
    gate = providers.quality_gate(*[F.col(c) for c in ("crit", "high", "blocked", "below", "status")])
    return runs.select("run_id", gate["decision"].alias("decision"), gate["severity"].alias("severity"))


@query(
    "F34",
    "v_members",
    """select 'provider_specific_append' as merge_method, 'validated_with_warning' as validation_status, pool_layer, count(*) as n
    from v_members group by pool_layer""",
)
def provider_specific_memberships(v):
    kept = providers.append_provider_specific(v.members())
    return kept.groupBy("merge_method", "validation_status", "pool_layer").agg(F.count("*").alias("n"))


# --- canonical records ---------------------------------------------------------------------


def _raw_bars(v):
    """Events as raw bar rows, spelled differently by provider."""
    e = v.events()
    chinese, value = F.col("provider") == "akshare", F.col("value").cast("string")
    money = F.when(F.col("k") % 4 == 0, "rmb").when(F.col("k") % 4 == 1, "hk_dollar").otherwise("")
    raw = F.create_map(
        F.lit("ts_code"), "ticker",
        F.when(F.col("event_id") % 2 == 0, "日期").otherwise("trade_date"), F.date_format("trade_date", "yyyyMMdd"),
        F.when(chinese, "开盘").otherwise("open"), value,
        F.lit("high"), (F.col("value") + 1).cast("string"),
        F.lit("low"), F.lit(""),
        F.lit("最低"), F.col("confidence").cast("string"),
        F.lit("close"), value,
        F.when(chinese, "成交量").otherwise("vol"), F.col("k").cast("string"),
        F.lit("amount"), value,
        F.lit("currency"), money,
    )
    return e.select(
        "provider",
        F.col("event_type").alias("source_api"),
        raw.alias("raw"),
        F.concat(F.lit("pay"), F.col("user_id").cast("string")).alias("raw_payload_id"),
        F.concat(F.lit("raw://"), F.col("user_id").cast("string")).alias("raw_payload_ref"),
        F.col("event_id").alias("raw_row_index"),
    )


@query(
    "P1 P2 F11 F12 S6",
    "v_events",
    f"""select event_id as raw_row_index, ticker as normalized_ticker, cast(trade_date as varchar) as trade_date, value as open, value + 1 as high,
      confidence as low, value as close, k * case provider when 'baostock' then 1.0::double else 100.0::double end as volume,
      value * case provider when 'tushare' then 1000.0::double else 1.0::double end as amount,
      case when k % 4 = 0 then 'CNY' when k % 4 = 1 then 'HKD' else 'CNY' end as currency,
      case when k > 0 then {r("(value * case provider when 'tushare' then 1000.0::double else 1.0::double end) / (k * case provider when 'baostock' then 1.0::double else 100.0::double end)", 6)} end as vwap,
      strftime(trade_date + interval 90 minute, '%Y-%m-%d %H:%M:%S') as bar_start from v_events where
      regexp_matches(ticker, '^(600|601|603|605|688|689|900|000|001|002|003|200|300|301|43|82|83|87|88|89)')""",
)
def canonical_bars(v):
    rows = normalize.standardise(_raw_bars(v), "bar").where("normalized_ticker is not null")
    return rows.select(
        "raw_row_index", "normalized_ticker", F.col("trade_date").cast("string").alias("trade_date"), "open", "high", "low", "close",
        "volume", "amount", "currency", round_half_up(F.col("vwap"), 6).alias("vwap"),
        F.date_format("bar_start", "yyyy-MM-dd HH:mm:ss").alias("bar_start"),
    )


@query(
    "P3 P5",
    "v_events",
    """select provider, case when provider = 'tushare' then 'canonical' else 'validator' end as source_role,
      case when provider = 'tushare' then 'canonical_only' else 'fallback_single_source' end as merge_method,
      cast(5 as bigint) as fields, count(*) as n, cast(0 as bigint) as unproven from v_events
      where regexp_matches(ticker, '^(600|601|603|605|688|689|900|000|001|002|003|200|300|301|43|82|83|87|88|89)') group by all""",
)
def record_lineage(v):
    business = ["open", "high", "low", "close", "pre_close", "volume"]
    rows = normalize.with_lineage(normalize.standardise(_raw_bars(v), "bar").where("normalized_ticker is not null"), business, "bar")
    role = F.try_element_at("field_provenance", F.lit("close"))["source_role"]
    unproven = F.size(normalize.unproven_fields(business, F.col("field_provenance")))
    return rows.groupBy(
        "provider", role.alias("source_role"), "merge_method", F.size(F.map_keys("field_provenance")).cast("long").alias("fields")
    ).agg(F.count("*").alias("n"), F.sum(unproven).alias("unproven"))


def _raw_of(v, kind: str):
    """Raw rows in one provider's spelling for the record types besides bars."""
    e = v.events()
    value, k, day = F.col("value").cast("string"), F.col("k").cast("string"), F.date_format("trade_date", "yyyy-MM-dd")
    code = F.lit("ts_code"), F.col("ticker")
    # One spelling per record type.
    spellings = {
        "security_master": [code, ("股票简称", F.col("event_type")), ("list_date", day), ("总股本", value)],
        "trade_calendar": [("cal_date", day), ("is_open", (F.col("k") % 2).cast("string")), ("exchange", F.lit("SSE"))],
        "trading_status": [code, ("date", day), ("停牌", F.when(F.col("k") % 3 == 0, "是").otherwise("否")), ("涨停价", value)],
        "realtime_quote": [code, ("time", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), ("最新价", value), ("买一价", value), ("vol", k), ("amount", value)],
        "adj_factor": [code, ("dividOperateDate", day), ("foreAdjustFactor", value)],
        "financial_statement": [code, ("statDate", day), ("MBRevenue", value), ("netProfit", k)],
        "financial_indicator": [code, ("end_date", day), ("roeAvg", value), ("epsTTM", k)],
        "valuation_metric": [code, ("trade_date", day), ("peTTM", value), ("总市值", k), ("amount", value)],
        "industry_membership": [code, ("行业名称", F.col("event_type")), ("生效日期", day)],
        "concept_membership": [code, ("概念名称", F.col("event_type")), ("关联强度", value)],
        "money_flow": [code, ("date", day), ("主力净流入", value)],
        "index": [("指数代码", F.col("ticker")), ("name", F.col("event_type")), ("list_date", day)],
        "index_bar": [("index_code", F.col("ticker")), ("date", day), ("open", value), ("close", value), ("vol", k)],
        "index_constituent": [("con_code", F.col("ticker")), ("index_code", F.col("event_type")), ("权重", value), ("in_date", day)],
        "corporate_action": [code, ("dividOperateDate", day), ("cash_div", value), ("stk_bo_rate", value), ("stk_co_rate", k)],
    }
    pairs = [x if not isinstance(x, str) else F.lit(x) for pair in spellings[kind] for x in pair]
    return e.select(
        "provider",
        F.col("event_type").alias("source_api"),
        F.create_map(*pairs).alias("raw"),
        F.lit("pay").alias("raw_payload_id"),
        F.lit("raw://pay").alias("raw_payload_ref"),
        F.col("event_id").alias("raw_row_index"),
    )


# Per type: the number column and the day column whose totals are compared.
_SHOWN = {
    "security_master": ("total_share", "list_date"),
    "trade_calendar": ("is_open", "calendar_date"),
    "trading_status": ("limit_up_price", "trade_date"),
    "realtime_quote": ("latest_price", "quote_time"),
    "adj_factor": ("fore_adjust_factor", "trade_date"),
    "financial_statement": ("operating_revenue", "report_date"),
    "financial_indicator": ("roe", "report_period"),
    "valuation_metric": ("pe_ttm", "trade_date"),
    "industry_membership": ("industry_name", "effective_date"),
    "concept_membership": ("concept_strength", "effective_date"),
    "money_flow": ("main_net_inflow", "trade_date"),
    "index": ("index_name", "list_date"),
    "index_bar": ("close", "trade_date"),
    "index_constituent": ("weight", "effective_date"),
    "corporate_action": ("stock_bonus_ratio", "ex_date"),
}


def _type_sql() -> str:
    total = "cast(sum(cast({} as decimal(18,2))) as double)"
    parts = []
    for kind, (number, day) in _SHOWN.items():
        amount = {"is_open": "k % 2", "stock_bonus_ratio": "value + k"}.get(number, "value")
        shown = "null::double" if number in ("industry_name", "index_name") else total.format(amount)
        days = "cast(0 as bigint)" if kind == "concept_membership" else "count(distinct trade_date)"
        parts.append(f"select '{kind}' as record_type, count(*) as records, {shown} as total, {days} as days from ok" if kind not in
                     ("trade_calendar", "index", "index_bar") else
                     f"select '{kind}', count(*), {shown}, {days} from v_events")
    return " union all ".join(parts)


@query(
    "P2 S11",
    "v_events",
    """with ok as (select * from v_events where
      regexp_matches(ticker, '^(600|601|603|605|688|689|900|000|001|002|003|200|300|301|43|82|83|87|88|89)')) """
    + _type_sql(),
)
def canonical_record_types(v):
    """Every record type besides bars from one provider spelling, with totals per type."""
    # A type without records still has its row.
    nothing = [F.lit(False).alias("kept"), F.lit(None).cast("decimal(18,2)").alias("value"), F.lit(None).cast("date").alias("day")]
    parts = v.spark.range(1).select(F.explode(F.array(*map(F.lit, _SHOWN))).alias("record_type"), *nothing)
    for kind, (number, day) in _SHOWN.items():
        rows = normalize.standardise(_raw_of(v, kind), kind)
        # Counted by condition: a filter is pushed below the projections and respells a ticker once per alias.
        kept = F.lit(True) if kind in normalize.WITHOUT_IDENTITY else F.col("normalized_ticker").isNotNull()
        value = F.col(number).cast("int") if number == "is_open" else F.col(number).try_cast("double")
        when = F.to_date(F.col(day)) if day == "quote_time" else F.col(day)
        if day == "quote_time":  # local times before eight fall on the previous UTC day
            when = F.to_date(F.from_utc_timestamp(F.col(day), fixed.MARKET_TIMEZONE))
        if number in ("industry_name", "index_name"):
            value = F.lit(None).cast("double")
        one = rows.select(
            F.lit(kind).alias("record_type"), kept.alias("kept"), F.when(kept, value.cast("decimal(18,2)")).alias("value"),
            F.when(kept, when.cast("date")).alias("day"),
        )
        parts = parts.unionByName(one)
    return parts.groupBy("record_type").agg(
        F.count_if("kept").alias("records"), F.sum("value").cast("double").alias("total"), F.count_distinct("day").alias("days")
    )


@query(
    "P6",
    "v_fact",
    "select effective_provider, count(*) as n, count(*) filter (where coalesce(adj_factor, fore_adjust_factor, back_adjust_factor) is not null) as valid from v_fact group by 1",
)
def factor_validity(v):
    rows = v.factors().withColumn("event_adjust_factor", F.lit(None).cast("double"))
    return rows.groupBy("effective_provider").agg(F.count("*").alias("n"), F.count_if(normalize.has_some_factor()).alias("valid"))


@query(
    "P11",
    "",
    """with d as (select l_orderkey, l_linenumber, cast(l_shipdate as date) as a, case when l_quantity > 10 then cast(l_shipdate as date) + 20 end as b from lineitem)
    select l_orderkey, count(*) filter (where a between date '1997-01-01' and date '1997-06-30' or b between date '1997-01-01' and date '1997-06-30') as any_in,
      count(*) filter (where a between date '1997-01-01' and date '1997-06-30' and coalesce(b between date '1997-01-01' and date '1997-06-30', true)) as all_in
    from d group by 1""",
)
def action_dates_in_range(v):
    a = F.to_date("l_shipdate")
    dates = [a, F.when(F.col("l_quantity") > 10, F.date_add(a, 20))]
    span = ("1997-01-01", "1997-06-30")
    return v.table("lineitem").groupBy("l_orderkey").agg(
        F.count_if(normalize.any_date_in_range(dates, *span)).alias("any_in"),
        F.count_if(normalize.any_date_in_range(dates, *span, every=True)).alias("all_in"),
    )


@query(
    "J9",
    "",
    """select s_suppkey, coalesce(nullif(c_mktsegment, ''), s_name) as industry, coalesce(nullif(s_name, ''), c_name) as full_name,
      coalesce(c_acctbal, s_acctbal) as total_share
    from supplier left join customer on s_suppkey = c_custkey + 5""",
)
def enriched_master(v):
    base = v.table("supplier").select(
        "s_suppkey", F.col("s_name").alias("industry"), F.col("s_name").alias("full_name"), F.col("s_acctbal").alias("total_share")
    )
    extra = v.table("customer").select(
        (F.col("c_custkey") + 5).alias("s_suppkey"),
        F.col("c_mktsegment").alias("industry"),
        F.col("c_name").alias("full_name"),
        F.col("c_acctbal").alias("total_share"),
    )
    return normalize.enrich(base, extra, "s_suppkey", ["industry", "total_share"], ["full_name"])


@query(
    "J10",
    "",
    """select r_name as board_name, n_name as industry_name, s_suppkey from region join nation on r_regionkey = n_regionkey
    join supplier on s_nationkey = n_nationkey""",
)
def board_memberships(v):
    boards = v.table("region").join(v.table("nation"), F.col("r_regionkey") == F.col("n_regionkey"))
    rows = boards.join(v.table("supplier"), F.col("n_nationkey") == F.col("s_nationkey"))
    return rows.select(F.col("r_name").alias("board_name"), F.col("n_name").alias("industry_name"), "s_suppkey")


@query(
    "A34",
    "v_events",
    """select user_id, cast(trade_date as varchar) as trade_date, arg_max(value, event_id) filter (where event_type = 'click') as roe,
      arg_max(k, event_id) filter (where event_type = 'view') as eps, arg_max(confidence, event_id) filter (where event_type = 'error') as roa
    from v_events group by 1, 2""",
)
def quarterly_bundles(v):
    def of(kind, name):
        return F.when(F.col("event_type") == kind, F.col(name))

    rows = v.events().select(
        "user_id", F.col("trade_date").cast("string").alias("trade_date"), "event_id",
        of("click", "value").alias("roe"), of("view", "k").alias("eps"), of("error", "confidence").alias("roa"),
    )
    return normalize.coalesce_endpoints(rows, ["user_id", "trade_date"], "event_id", ["roe", "eps", "roa"])


@query(
    "F43",
    "v_events",
    """with s as (select *, ['income', 'balancesheet', 'cashflow'][cast(event_id % 3 as int) + 1] as api, case when k % 2 = 0 then value end as revenue from v_events)
    select api as source_api, case api when 'income' then 'income_statement' when 'balancesheet' then 'balance_sheet' else 'cash_flow' end as statement_type,
      count(*) as n, cast(sum(cast(case when api = 'income' then coalesce(revenue, confidence) end as decimal(18,4))) as double) as operating_revenue,
      cast(sum(cast(case when api = 'balancesheet' then value end as decimal(18,4))) as double) as total_liabilities,
      cast(sum(cast(case when api = 'cashflow' then value end as decimal(18,4))) as double) as operating_cash_flow from s group by 1, 2""",
)
def decorated_statements(v):
    e = v.events().select(
        cycle(F.col("event_id"), ["income", "balancesheet", "cashflow"]).alias("source_api"),
        F.when(F.col("k") % 2 == 0, F.col("value")).alias("revenue"),
        F.col("confidence").alias("total_revenue"),
        *[F.col("value").alias(n) for n in ("n_income", "total_liab", "n_cashflow_act")],
    )
    def total(name):
        return F.sum(F.col(name).cast("decimal(18,4)")).cast("double").alias(name)

    return normalize.decorate_statements(e).groupBy("source_api", "statement_type").agg(
        F.count("*").alias("n"), total("operating_revenue"), total("total_liabilities"), total("operating_cash_flow")
    )


@query(
    "U6",
    "v_members",
    """select ticker, status, min(member_id) as member_id from (
      select ticker, status, member_id from v_members union all select ticker, status, member_id + 100000 from v_members where sellability = 'sellable') group by 1, 2""",
)
def listing_partitions(v):
    m = v.members().select("ticker", "status", "member_id")
    again = v.members().where("sellability = 'sellable'").select("ticker", "status", (F.col("member_id") + 100000).alias("member_id"))
    return normalize.listing_union([m, again], ["ticker", "status"])


# --- storage -------------------------------------------------------------------------------


def _work(v, name: str) -> str:
    return f"{scratch_root(v.spark)}/{name}-{uuid.uuid4().hex}"


_LINE_COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus"
_LATEST_LINE = f"""select {_LINE_COLUMNS}, cast(cast(l_shipdate as date) as varchar) as ship from (
  select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc,
    l_extendedprice desc, l_discount desc, l_tax desc, l_returnflag desc, l_linestatus desc) as rn from lineitem) where rn = 1"""


def _line(v):
    columns = [c.strip() for c in _LINE_COLUMNS.split(",")]
    return v.table("lineitem").select(*columns, F.to_date("l_shipdate").cast("string").alias("ship"))


def _ordered(df):
    rest = "l_orderkey l_linenumber ship l_partkey l_suppkey l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus"
    return df.select(*rest.split())


@query("W1", "", _LATEST_LINE)
def latest_line_per_key(v):
    return latest_by_key(_ordered(_line(v)), ["l_orderkey", "l_linenumber"], ["ship"])


@query("S5 S9", "", _LATEST_LINE.replace("partition by l_orderkey, l_linenumber", "partition by l_orderkey, l_linenumber, l_linestatus"))
def upserted_lines(v):
    """Two overlapping batches merged into one partitioned table; the latest row per key stays."""
    lines = _ordered(_line(v))
    path = _work(v, "upsert")
    key = ["l_linestatus", "l_orderkey", "l_linenumber"]
    tables.upsert(lines.where("l_quantity <= 30"), path, ["l_linestatus"], key, "ship")
    tables.upsert(lines.where("l_quantity > 20"), path, ["l_linestatus"], key, "ship")
    return tables.read(v.spark, path).select(*lines.columns)


@query(
    "S10",
    "",
    """with a as (select l_orderkey, l_linenumber, min(l_quantity) as q from lineitem where l_returnflag = 'A' group by 1, 2),
    b as (select l_orderkey, l_linenumber, min(l_quantity) as q from lineitem where l_returnflag <> 'A' group by 1, 2)
    select l_orderkey, l_linenumber, q as l_quantity from a union all
    select l_orderkey, l_linenumber, q from b where (l_orderkey, l_linenumber) not in (select (l_orderkey, l_linenumber) from a)""",
)
def inserted_if_absent(v):
    lines = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    path = _work(v, "insert")
    key = ["l_orderkey", "l_linenumber"]
    for part in (lines.where("l_returnflag = 'A'"), lines.where("l_returnflag <> 'A'")):
        tables.insert_absent(part.drop("l_returnflag"), path, key, ["l_quantity"])
    return tables.read(v.spark, path)


@query(
    "S10",
    "",
    """with a as (select l_orderkey, l_linenumber, min(l_quantity) as q from lineitem where l_returnflag = 'A' group by 1, 2),
    b as (select l_orderkey, l_linenumber, min(l_quantity) as q from lineitem where l_returnflag <> 'A' group by 1, 2)
    select l_orderkey, l_linenumber, q as l_quantity from a union all
    select l_orderkey, l_linenumber, q from b where (l_orderkey, l_linenumber) not in (select (l_orderkey, l_linenumber) from a)""",
)
def bucketed_inserts(v):
    """The same inserts into a table of key buckets with filters; the second batch reads only buckets that may hold its keys."""
    lines = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    path = _work(v, "insert")
    for part in (lines.where("l_returnflag = 'A'"), lines.where("l_returnflag <> 'A'")):
        tables.insert_absent_bucketed(part.drop("l_returnflag"), path, ["l_orderkey", "l_linenumber"], ["l_quantity"])
    return tables.read(v.spark, path).drop("bucket")


@query(
    "S9",
    "",
    """with a as (select l_returnflag, count(*) as n from lineitem group by 1), b as (select l_returnflag, count(*) as n from
      (select distinct l_orderkey, l_linenumber, l_returnflag from lineitem) group by 1)
    select l_returnflag, a.n as left_rows, b.n as right_rows, a.n = b.n as matches from a join b using (l_returnflag)""",
)
def row_count_reconciliation(v):
    lines = v.table("lineitem")
    deduped = lines.select("l_orderkey", "l_linenumber", "l_returnflag").distinct()
    return tables.row_count_gaps(lines, deduped, ["l_returnflag"])


@query(
    "S11",
    "v_events",
    "select event_type as record_type, count(*) as n, cast(sum(cast(value as decimal(18,2))) as double) as total from v_events group by 1",
)
def routed_records(v):
    """Events routed to one directory per type and read back."""
    path = _work(v, "routed")
    tables.write_routed(v.events().select("event_id", "value", F.col("event_type").alias("record_type")), path)
    rows = tables.read(v.spark, path)
    return rows.groupBy("record_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("total"))


def _landed(v):
    d = v.table("documents")
    return d.select(
        F.concat(F.lit("pay_"), F.col("source")).alias("raw_payload_id"),
        cycle(F.crc32("source"), ["tushare", "akshare"]).alias("provider"),
        F.lit("news").alias("request_type"),
        F.lit("2024-01-01").alias("date"),
        F.col("lang").alias("source_api"),
        F.col("source").alias("request_id"),
        F.col("doc_id").cast("string").alias("provider_symbol"),
        F.to_json(F.struct("doc_id", "text")).alias("raw_data"),
        F.col("doc_id").alias("fetch_order"),
    )


@query("S1 S2 S3 S4", "", "select 'pay_' || source as raw_payload_id, count(*) as records, true as intact from documents group by source")
def landed_payloads(v):
    """Documents appended twice to a landing zone, listed and verified: the second append adds nothing."""
    path = _work(v, "raw")
    landed = _landed(v)
    raw_store.append(landed, path, "fetch_order")
    raw_store.append(landed, path, "fetch_order")
    lines = raw_store.scan(v.spark, path)
    counts = raw_store.records(lines).groupBy("raw_payload_id").agg(F.count("*").alias("records"))
    return raw_store.verify(lines).join(counts, "raw_payload_id").select("raw_payload_id", "records", "intact")


@query(
    "S3 S1",
    "",
    """with n as (select 'pay_' || source as raw_payload_id, row_number() over (partition by source order by doc_id) - 1 as raw_row_index, cast(doc_id as varchar) as provider_symbol, text from documents),
    p as (select distinct raw_payload_id from n order by 1 limit 3)
    select raw_payload_id, raw_row_index, provider_symbol, cast(length(text) as int) as characters from n join p using (raw_payload_id) where raw_row_index in (0, 5)""",
)
def raw_rows_looked_up(v):
    """Rows of three payloads by their index; rows that are not stored have no result."""
    path = _work(v, "raw")
    raw_store.append(_landed(v), path, "fetch_order")
    listed = raw_store.indexed_catalogue(v.spark, path).select("raw_payload_id").orderBy("raw_payload_id").limit(3).collect()
    found = raw_store.rows_at(v.spark, path, [(r["raw_payload_id"], i) for r in listed for i in (0, 5, 10**9)])
    return found.select("raw_payload_id", "raw_row_index", "provider_symbol", F.length(F.get_json_object("raw_data", "$.text")).alias("characters"))


@query(
    "S3 S4",
    "",
    "select 'pay_' || source as raw_payload_id, count(*) as rows from documents group by source",
)
def payload_catalogue(v):
    """Payloads and their rows from the index, appended in two overlapping halves."""
    path = _work(v, "raw")
    landed = _landed(v)
    raw_store.append(landed.where("length(raw_payload_id) % 2 = 0"), path, "fetch_order")
    raw_store.append(landed, path, "fetch_order")
    return raw_store.indexed_catalogue(v.spark, path).select("raw_payload_id", "rows")


_LEVELS = """select p, i // 1024 as i, sha256(string_agg(h, '' order by i)) as h from {} group by p, i // 1024"""


@query(
    "S4",
    "",
    f"""with l0 as (select source as p, row_number() over (partition by source order by doc_id) - 1 as i, sha256(text) as h from documents),
    l1 as ({_LEVELS.format("l0")}), l2 as ({_LEVELS.format("l1")}), l3 as ({_LEVELS.format("l2")}), l4 as ({_LEVELS.format("l3")})
    select p as source, 'sha256:' || h as raw_hash from l4""",
)
def payload_hashes(v):
    rows = raw_store.number_rows(v.table("documents").select("source", "doc_id", "text"), "source", "doc_id")
    return raw_store.payload_hashes(rows, "source", "raw_row_index", F.col("text"))


@query(
    "F35",
    "v_events",
    """with k as (select event_id, 'stock_data:historical_bars:' || provider || ':' || ticker || ':' || strftime(trade_date, '%Y%m%d') || ':none:1d:none:close,open:v0.1' as request_key,
      'run:' || replace(event_type || ' x', ' ', '_') || ':' || cast(k as varchar) || ':None' as run_key, event_type, k from v_events)
    select request_key, run_key, min(event_id) as first_event, count(*) as repeats from k group by 1, 2""",
)
def idempotent_requests(v):
    """Requests collapsed on their key; the first one is the run that later ones reuse."""
    e = v.events()
    none = F.lit(None).cast("string")
    request = keys.request_key(
        F.lit("stock_data"), F.lit("historical_bars"), F.col("provider"), F.array("ticker"), none, F.lit(None).cast("array<string>"),
        F.col("trade_date"), none, F.lit("1d"), none, F.array(F.lit("open"), F.lit("close")),
    )
    run = keys.joined_key(F.lit("run"), F.concat("event_type", F.lit(" x")), F.col("k"), none)
    return e.groupBy(request.alias("request_key"), run.alias("run_key")).agg(
        F.min("event_id").alias("first_event"), F.count("*").alias("repeats")
    )


@query(
    "P3",
    "v_events",
    """select 'rec' || cast(event_id as varchar) as record_id, event_type as record_type, 'raw://' || cast(user_id as varchar) as raw_payload_ref, k % 10 = 0 as quarantined
    from v_events where k in (7, 17, 20) and event_type in ('click', 'view', 'error')""",
)
def record_lineage_lookup(v):
    """Lineage columns of several record tables united, then looked up by record."""
    def lineage(kind):
        return v.events().where(F.col("event_type") == kind).select(
            F.concat(F.lit("rec"), F.col("event_id").cast("string")).alias("record_id"),
            F.col("event_type").alias("record_type"),
            F.concat(F.lit("raw://"), F.col("user_id").cast("string")).alias("raw_payload_ref"),
            (F.col("k") % 10 == 0).alias("quarantined"),
            "k",
        )

    united = lineage("click").unionByName(lineage("view")).unionByName(lineage("error"))
    return united.where(F.col("k").isin(7, 17, 20)).drop("k")


_SOUGHT = [f"{provider}:{part}:1" for provider in ("tushare", "akshare", "baostock") for part in range(1, 41)]


@query(
    "J25 P5",
    "",
    f"""select provider || ':' || p_partkey || ':1' as record_id, {cycle_sql("p_partkey", TYPES)} as record_type, 'raw://' || (p_partkey % 19) as raw_payload_ref,
      p_partkey as raw_row_index, {cycle_sql("p_partkey", TYPES)} in ('bar', 'trading_status') and p_partkey % 4 = 0 as is_quarantined,
      case when {cycle_sql("p_partkey", TYPES)} in ('bar', 'security_master', 'valuation_metric', 'financial_indicator') then '{{"all":"' || provider || '"}}' end as field_provenance
    from part cross join (values ('tushare', 11), ('akshare', 13), ('baostock', 7)) s(provider, gap) where p_partkey % gap <> 0 and p_partkey <= 40""",
)
def records_looked_up(v):
    """Lineage, quarantine flag and provenance of records of all types by their ids."""
    path = _work(v, "directory")
    part = F.split_part("record_id", F.lit(":"), F.lit(2)).cast("long")
    rows = comparison.records(v).select(
        "record_id", "record_type", F.concat(F.lit("pay"), (part % 19).cast("string")).alias("raw_payload_id"),
        F.concat(F.lit("raw://"), (part % 19).cast("string")).alias("raw_payload_ref"), part.alias("raw_row_index"),
        F.when(part % 4 == 0, "quarantined").otherwise("validated").alias("validation_status"),
        F.create_map(F.lit("all"), F.col("provider")).alias("field_provenance"),
    )
    directory.add(rows, path)
    directory.add(rows.withColumn("raw_payload_ref", F.lit("later")), path)
    return directory.look_up(v.spark, path, _SOUGHT).drop("raw_payload_id")


@query(
    "S17 S6",
    "v_events",
    """select event_id, '{"ticker":"' || ticker || '","k":' || cast(k as varchar) || ',"tags":["' || event_type || '","' || provider || '"]}' as result from v_events""",
)
def json_results(v):
    e = v.events().withColumn("tags", F.array("event_type", "provider"))
    return tables.nested_to_json(e.select("event_id", F.struct("ticker", "k", "tags").alias("result")))


@query(
    "P9",
    "",
    "select p_partkey, p_name, p_brand, p_retailprice from part where p_brand = 'Brand#2' and p_type = 'ECONOMY'",
)
def keyed_lookup(v):
    found = v.table("part").where((F.col("p_brand") == "Brand#2") & (F.col("p_type") == "ECONOMY"))
    return found.select("p_partkey", "p_name", "p_brand", "p_retailprice")

