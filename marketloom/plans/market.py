"""Queries on bars, factors, features and the trading calendar."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import market, times, units
from marketloom.functions.numbers import round_half_up
from marketloom.operators import bars, features, normalize, readers, research
from marketloom.operators.hotkeys import latest_by_key
from marketloom.plans.registry import query, r
from marketloom.plans.views import cycle
from marketloom.sources import series, tables

RANGE = ("2024-01-02", "2024-01-29")

# Both directions of the point-in-time match, and the group switches, for bars in the requested range.
_ADJUST = """
with ready as (select * from v_bars where trade_date between date '2024-01-02' and date '2024-01-29' {ready}),
named as (select *, effective_provider as fp from v_fact),
borrow as (select distinct ticker, effective_provider from ready
           where (ticker, effective_provider) not in (select (ticker, effective_provider) from v_fact)),
pooled as (select n.ticker, b.effective_provider, n.trade_date, n.adj_factor, n.fore_adjust_factor, n.back_adjust_factor,
                  n.factor_method, n.fp from named n join borrow b on n.ticker = b.ticker),
allf as (select ticker, effective_provider, trade_date, adj_factor, fore_adjust_factor, back_adjust_factor, factor_method, fp
         from named union all select * from pooled),
f as (select * exclude (rn) from (select *, row_number() over (partition by ticker, effective_provider, trade_date
      order by fp desc) as rn from allf) where rn = 1),
back as (select b.ticker, b.effective_provider, b.trade_date, b.open, b.high, b.low, b.close,
                f.adj_factor as a, f.fore_adjust_factor as fo, f.back_adjust_factor as ba, f.fp, f.factor_method as m
         from ready b asof left join f on b.ticker = f.ticker and b.effective_provider = f.effective_provider
              and b.trade_date >= f.trade_date),
fwd as (select b.ticker, b.effective_provider, b.trade_date, f.adj_factor as a2, f.fore_adjust_factor as fo2,
               f.back_adjust_factor as ba2, f.fp as fp2, f.factor_method as m2
        from ready b asof left join f on b.ticker = f.ticker and b.effective_provider = f.effective_provider
             and b.trade_date <= f.trade_date),
chosen as (select *, max(case when coalesce(a, fo, ba) is not null then 1 else 0 end)
                     over (partition by ticker, effective_provider) = 1 as use_back
           from back join fwd using (ticker, effective_provider, trade_date)),
p as (select ticker, effective_provider, trade_date, open, high, low, close,
             case when use_back then a else a2 end as adj, case when use_back then fo else fo2 end as fore,
             case when use_back then ba else ba2 end as bak, case when use_back then fp else fp2 end as fprov,
             case when use_back then m else m2 end as method from chosen),
g as (select *, bool_or(fore is not null) over w as any_fore, bool_or(adj is not null) over w as any_adj,
             bool_or(lower(concat_ws('|', fprov, method)) like '%baostock%') over w as direct,
             arg_max(adj, trade_date) filter (where adj is not null) over w as last_adj,
             ticker in (select ticker from v_fact) as has_factor
      from p window w as (partition by ticker, effective_provider)),
applied as (select *, case when has_factor then coalesce({factor}, 1.0::double) end as applied from g)
select ticker, effective_provider, cast(trade_date as varchar) as trade_date, close as raw_close,
       """ + r("applied", 8) + """ as applied_adjust_factor, """ + r("close * coalesce(applied, 1.0::double)", 6) + """ as close,
       """ + r("open * coalesce(applied, 1.0::double)", 6) + """ as open,
       case when has_factor then 'calculated_from_raw_bars_and_adj_factor'
            else 'no_adj_factor_available_raw_prices_returned' end as adjustment_source
from applied"""
_QFQ = "case when any_fore and (direct or not any_adj) then fore else adj / coalesce(nullif(last_adj, 0), 1) end"
_HFQ = "coalesce(bak, adj)"
_READY = "and validation_status <> 'quarantined' and data_quality >= 0.8::double"


def _shown(adjusted):
    return adjusted.select(
        "ticker",
        "effective_provider",
        F.col("trade_date").cast("string").alias("trade_date"),
        "raw_close",
        round_half_up(F.col("applied_adjust_factor"), 8).alias("applied_adjust_factor"),
        round_half_up(F.col("close"), 6).alias("close"),
        round_half_up(F.col("open"), 6).alias("open"),
        "adjustment_source",
    )


@query("J1 J2 J3 W8 P7", "v_bars v_fact", _ADJUST.format(ready=_READY, factor=_QFQ))
def adjusted_bars_qfq(v):
    ready = bars.query_bars(v.bars(), *RANGE, ready=True)
    return _shown(bars.adjust_prices(ready, v.factors(), "qfq", RANGE))


@query("J1 J2 J3", "v_bars v_fact", _ADJUST.format(ready="", factor=_HFQ))
def adjusted_bars_hfq(v):
    return _shown(bars.adjust_prices(bars.query_bars(v.bars(), *RANGE), v.factors(), "hfq", RANGE))


_STORED = """
union all select ticker, effective_provider, cast(trade_date as varchar), null, null, """ + r("close", 6) + ", " + r("open", 6) + """, null
from v_bars where ticker like '%.BJ' and trade_date between date '2024-01-02' and date '2024-01-29'"""


@query("J4 U1", "v_bars v_fact", _ADJUST.format(ready="and ticker not like '%.BJ'", factor=_QFQ) + _STORED)
def stored_or_computed_bars(v):
    """Tickers of one exchange have stored adjusted rows; all others are computed."""
    raw = v.bars()
    stored = raw.where(F.col("ticker").endswith(".BJ")).withColumn("adjust", F.lit("qfq"))
    both = raw.unionByName(stored)
    return _shown(bars.adjusted_bars(both, v.factors(), *RANGE, "qfq", ready=False))


@query(
    "S7 S8 P8",
    "v_bars",
    """select ticker, effective_provider, cast(trade_date as varchar) as trade_date, open, high, low, close, volume
    from v_bars where trade_date between date '2024-01-05' and date '2024-01-15' and ticker in
    ('600008.SH', '300009.SZ', '688010.SH', '430011.BJ')""",
)
def bars_for_tickers(v):
    wanted = ["600008.SH", "300009.SZ", "688010.SH", "430011.BJ"]
    found = tables.read_date_range(v.bars(), "trade_date", "2024-01-05", "2024-01-15", wanted, "ticker")
    return found.select(
        "ticker", "effective_provider", F.col("trade_date").cast("string").alias("trade_date"), "open", "high", "low", "close", "volume"
    )


@query(
    "P4",
    "",
    """with b as (select l_quantity as open, l_extendedprice / 1000 as high, l_discount * 100 as low, l_tax * 100 as close,
       l_quantity - 5 as volume, case l_returnflag when 'A' then 'none' when 'N' then 'qfq' else 'bad' end as adjust
       from lineitem),
    e as (select concat_ws('|', case when adjust not in ('none', 'qfq', 'hfq') then 'invalid_adjust' end,
       case when high < greatest(open, close, low) or low > least(open, close, high) then 'ohlc_out_of_order' end,
       case when least(open, high, low, close) < 0 then 'negative_price' end,
       case when volume < 0 then 'negative_volume_or_amount' end) as reasons from b)
    select reasons, count(*) as n from e group by reasons""",
)
def bar_rejections(v):
    li = v.table("lineitem")
    kinds = F.when(F.col("l_returnflag") == "A", "none").when(F.col("l_returnflag") == "N", "qfq").otherwise("bad")
    rows = li.select(
        F.col("l_quantity").alias("open"),
        (F.col("l_extendedprice") / 1000).alias("high"),
        (F.col("l_discount") * 100).alias("low"),
        (F.col("l_tax") * 100).alias("close"),
        (F.col("l_quantity") - 5).alias("volume"),
        F.col("l_extendedprice").alias("amount"),
        kinds.alias("adjust"),
    )
    good, bad = bars.split_valid(rows)
    reasons = good.select(F.lit("").alias("reasons")).unionByName(bad.select(F.array_join("reject_reasons", "|").alias("reasons")))
    return reasons.groupBy("reasons").agg(F.count("*").alias("n"))


@query(
    "A1 F12",
    "v_buckets",
    f"""select ticker, cast(trade_date as varchar) as trade_date, bucket_clock, open, high, low, close, volume, amount,
    {r("return_window", 8)} as return_window, {r("vwap", 6)} as vwap from v_buckets""",
)
def intraday_bars(v):
    return v.buckets().select(
        "ticker",
        F.col("trade_date").cast("string").alias("trade_date"),
        "bucket_clock", "open", "high", "low", "close", "volume", "amount",
        round_half_up(F.col("return_window"), 8).alias("return_window"),
        round_half_up(F.col("vwap"), 6).alias("vwap"),
    )


_RATIO = (
    """select *, case when days >= 3 and amount > 0 then """ + r("amount / (total / days)", 4) + """ end as amount_ratio
    from (select *, count(case when amount > 0 then 1 end) over w as days,
          cast(sum(case when amount > 0 then cast(amount as decimal(28,6)) end) over w as double) as total
          from v_buckets
          window w as (partition by ticker, bucket_clock order by trade_date rows between unbounded preceding and 1 preceding))"""
)


@query(
    "A2 T3",
    "v_buckets",
    f"select ticker, cast(trade_date as varchar) as trade_date, bucket_clock, amount, amount_ratio from ({_RATIO})",
)
def same_bucket_amount_ratio(v):
    return features.same_bucket_ratio(v.buckets()).select(
        "ticker", F.col("trade_date").cast("string").alias("trade_date"), "bucket_clock", "amount", "amount_ratio"
    )


def _limit_sql(side: str, sign: str) -> str:
    return f"case when pc is not null then {r(f'pc * (1 {sign} limit_pct)', 2)} end as limit_{side}"


_FEATURES = f"""
with ratio as ({_RATIO}),
ranged as (select *, max(high) over d as day_high, min(low) over d as day_low from ratio window d as (partition by ticker, trade_date)),
closes as (select ticker, trade_date, lag(close) over (partition by ticker order by trade_date) as prev_close from v_daily),
joined as (select r.*, nullif(c.prev_close, 0) as pc, s.is_st, s.is_suspended
           from ranged r left join closes c using (ticker, trade_date) left join v_status s using (ticker)),
pct as (select *, case when pc is not null then case when is_st then 0.05::double
          when regexp_matches(split_part(ticker, '.', 1), '^(688|300|301)') then 0.2::double
          when regexp_matches(split_part(ticker, '.', 1), '^[48]') and length(split_part(ticker, '.', 1)) = 6 then 0.3::double
          else 0.1::double end end as limit_pct from joined),
lim as (select *, {_limit_sql("up", "+")}, {_limit_sql("down", "-")} from pct),
dist as (select *, case when close <> 0 and limit_up is not null then {r("greatest(0.0::double, (limit_up - close) / close)", 6)} end as distance_up,
                case when close <> 0 and limit_down is not null then {r("greatest(0.0::double, (close - limit_down) / close)", 6)} end as distance_down,
                coalesce(close >= limit_up - 1e-6::double, false) as hit_up, coalesce(close <= limit_down + 1e-6::double, false) as hit_down
         from lim),
scored as (select *, {r('''greatest(
      least(1.0::double, abs(return_window) / 0.02::double * 0.75::double + case when amount > 0 then 0.05::double else 0.0::double end),
      least(1.0::double, case when amount_ratio is not null then amount_ratio / 3.0::double * 0.75::double else 0.0::double end),
      case when distance_up is null then 0.0::double else least(1.0::double, greatest(0.0::double, 1 - distance_up / 0.015::double)) end,
      case when distance_down is null then 0.0::double else least(1.0::double, greatest(0.0::double, 1 - distance_down / 0.015::double)) end,
      case when hit_up or hit_down then 1.0::double else 0.0::double end)''', 4)} as abnormality_score from dist),
reasoned as (select *, concat_ws('|', case when abnormality_score >= 0.75::double then 'abnormality_score>=0.75' end,
      case when abs(return_window) >= 0.02::double then 'abs(return)>=0.02' end,
      case when amount_ratio >= 3.0::double then 'amount_ratio>=3.0' end,
      case when distance_up <= 0.015::double then 'distance_to_limit_up<=0.015' end,
      case when distance_down <= 0.015::double then 'distance_to_limit_down<=0.015' end,
      case when hit_up or hit_down then 'hit_limit' end,
      case when return_window <= -0.025::double then 'return<=-0.025(risk_review)' end,
      case when hit_down then 'hit_limit_down(risk_review)' end,
      case when is_suspended then 'suspended(risk_review)' end) as reasons from scored)
"""


def _features(v):
    return features.build(v.buckets(), v.daily(), v.status())


@query(
    "P23 F19 F20 W6 W7",
    "v_buckets v_daily v_status",
    _FEATURES
    + f"""select ticker, cast(trade_date as varchar) as trade_date, bucket_clock, close, pc as prev_close, limit_up, limit_down,
    case when pc is not null then {r("close / pc - 1", 6)} end as day_return,
    case when day_high > day_low then {r("(close - day_low) / (day_high - day_low)", 4)} end as position_in_range,
    abnormality_score, reasons, reasons <> '' as emit, reasons like '%(risk_review)%' as risk_review from reasoned""",
)
def intraday_features(v):
    return _features(v).select(
        "ticker",
        F.col("trade_date").cast("string").alias("trade_date"),
        "bucket_clock", "close", F.nullif("prev_close", F.lit(0.0)).alias("prev_close"), "limit_up", "limit_down", "day_return",
        "position_in_range", "abnormality_score", F.array_join("reasons", "|").alias("reasons"), "emit", "risk_review",
    )


@query(
    "K2 P15",
    "v_buckets v_daily v_status",
    _FEATURES
    + """select ticker, cast(trade_date as varchar) || 'T' || bucket_clock as bucket_start, abnormality_score
    from reasoned order by abnormality_score desc, ticker, bucket_start limit 10""",
)
def top_abnormal_features(v):
    start = F.concat_ws("T", F.col("trade_date").cast("string"), "bucket_clock").alias("bucket_start")
    return readers.top_features(_features(v).select("ticker", start, "abnormality_score"))


@query(
    "W4 J11",
    "v_cal",
    """select e as exchange, cast(calendar_date as varchar) as calendar_date, is_open,
       cast(max(case when is_open then calendar_date end) over (partition by e order by calendar_date
            rows between unbounded preceding and 1 preceding) as varchar) as prev_trade_date,
       cast(min(case when is_open then calendar_date end) over (partition by e order by calendar_date
            rows between 1 following and unbounded following) as varchar) as next_trade_date,
       case when e = 'BSE' then 'derived_from_sse_trade_calendar' end as calendar_derivation
    from v_cal, (values ('SSE'), ('SZSE'), ('BSE')) x(e)""",
)
def exchange_calendar(v):
    out = bars.trading_neighbours(normalize.expand_calendar(v.calendar()))
    days = ["calendar_date", "prev_trade_date", "next_trade_date"]
    return out.select("exchange", *[F.col(d).cast("string").alias(d) for d in days], "is_open", "calendar_derivation")


def _change_sql(n: int) -> str:
    lagged = f"nullif(lag(close, {n}) over (partition by ticker order by trade_date), 0)"
    return f"{r(f'(close / {lagged} - 1.0::double) * 100.0::double', 4)} as change_{n}d"


@query(
    "W5 S18",
    "v_daily",
    f"""select ticker, cast(trade_date as varchar) as day, close as value, {_change_sql(1)}, {_change_sql(5)}, {_change_sql(20)}
    from v_daily""",
)
def series_changes(v):
    named = v.daily().select("ticker", F.col("trade_date").cast("string").alias("日期"), F.col("close").cast("string").alias("收盘"))
    changed = bars.pct_change(series.infer_series(named, keep=["ticker"]), "ticker", "day", "value")
    return changed.withColumn("day", F.col("day").cast("string"))


@query(
    "J7",
    "v_events",
    """with l as (select ticker, trade_date, max(value) as limit_up_price from v_events where event_type = 'click' group by all),
    s as (select ticker, trade_date, case when k % 2 = 0 then 'S' else 'R' end as t, case when k % 3 = 0 then '09:30' end as tm
          from (select *, row_number() over (partition by ticker, trade_date order by event_id desc) as rn
                from v_events where event_type = 'error') where rn = 1)
    select ticker, cast(trade_date as varchar) as trade_date, limit_up_price, coalesce(t = 'S', false) as is_suspended,
           not coalesce(t = 'S', false) as is_trading,
           case when coalesce(t = 'S', false) then 'not_tradable' else 'tradable' end as tradability_status,
           coalesce(tm, t) as suspend_reason
    from l full join s using (ticker, trade_date)""",
)
def limit_and_suspension_overlay(v):
    e = v.events()
    keys = ["ticker", "trade_date"]
    limits = e.where("event_type = 'click'").groupBy(*keys).agg(F.max("value").alias("limit_up_price"))
    halts = latest_by_key(e.where("event_type = 'error'").select(*keys, "event_id", "k"), keys, ["event_id"]).select(
        *keys,
        F.when(F.col("k") % 2 == 0, "S").otherwise("R").alias("suspend_type"),
        F.when(F.col("k") % 3 == 0, "09:30").alias("suspend_timing"),
    )
    return normalize.overlay(limits, halts, keys).withColumn("trade_date", F.col("trade_date").cast("string"))


@query(
    "J8",
    "v_events",
    """with w as (select distinct ticker from v_events),
    s as (select ticker, trade_date, max(event_type) as reason from v_events where event_type = 'error' group by all)
    select w.ticker, cast(d as varchar) as trade_date, s.reason as suspend_reason, s.reason is not null as is_suspended,
           case when s.reason is not null then 'suspended' else 'tradable_or_not_reported_suspended' end as tradability_status
    from w, (select cast(unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) as date) as d) g
    left join s on s.ticker = w.ticker and s.trade_date = g.d""",
)
def suspension_grid(v):
    e = v.events()
    reports = e.where("event_type = 'error'").groupBy("ticker", "trade_date").agg(F.max("event_type").alias("suspend_reason"))
    grid = normalize.fill_suspension_grid(e.select("ticker").distinct(), reports, "2024-01-01", "2024-01-30")
    return grid.withColumn("trade_date", F.col("trade_date").cast("string"))


@query(
    "J26",
    "v_events",
    f"""with px as (select user_id, trade_date, max_by(value, event_id) as price from v_events group by all),
    fx as (select trade_date, 0.8::double + cast(count(*) % 10 as double) / 100 as rate from v_events group by all)
    select a.user_id as a_id, cast(a.trade_date as varchar) as trade_date,
           case when a.price <> 0 and h.price <> 0 then {r("(a.price * fx.rate / nullif(h.price, 0) - 1.0::double) * 100", 4)} end as ah_premium_pct
    from px a join px h on a.user_id % 2 = 0 and h.user_id = a.user_id + 1 and h.trade_date = a.trade_date
    join fx on fx.trade_date = a.trade_date""",
)
def ah_premium(v):
    """Even ids play the A share, the next odd id its H share; the rate is one row per day."""
    px = v.events().groupBy("user_id", "trade_date").agg(F.max_by("value", "event_id").alias("price"))
    fx = v.events().groupBy("trade_date").agg((0.8 + (F.count("*") % 10).cast("double") / 100).alias("rate"))
    a = px.where("user_id % 2 = 0").select(F.col("user_id").alias("a_id"), "trade_date", F.col("price").alias("a_price"))
    h = px.select((F.col("user_id") - 1).alias("a_id"), "trade_date", F.col("price").alias("h_price"))
    both = a.join(h, ["a_id", "trade_date"]).join(fx, "trade_date")
    premium = units.ah_premium_pct(F.col("a_price"), F.col("h_price"), F.col("rate"))
    return both.select("a_id", F.col("trade_date").cast("string").alias("trade_date"), premium.alias("ah_premium_pct"))


_HK_SQL = """
with comp as (select user_id, max_by(value, event_id) as last_price, cast(sum(cast(value as decimal(18,2))) as double) as turnover
              from v_events where event_type = 'signup' and trade_date <= date '2024-01-05' group by 1),
hold as (select user_id, max_by(value, event_id) as close_price, max_by(case when k % 2 = 0 then k end, event_id) as shares,
                max_by(case when k % 3 = 0 then value end, event_id) as pct
         from (select *, row_number() over (partition by user_id order by trade_date desc, event_id desc) as rn from v_events
               where event_type = 'purchase' and trade_date <= date '2024-01-20') where rn = 1 group by 1),
snap as (select lpad(cast(coalesce(c.user_id, h.user_id) as varchar), 5, '0') || '.HK' as ticker, c.user_id is not null as hk_connect_eligible,
                case when c.user_id is not null then last_price else close_price end as last_price_hkd, turnover as turnover_hkd,
                cast(shares as double) as southbound_holding_shares, pct as southbound_holding_pct
         from comp c full join hold h on c.user_id = h.user_id)
"""


def _hk(v, listed=True):
    e = v.events().withColumn("ticker", F.concat(F.lpad(F.col("user_id").cast("string"), 5, "0"), F.lit(".HK")))
    components = e.where("event_type = 'signup' and trade_date <= date'2024-01-05'").groupBy("ticker").agg(
        F.max_by("value", "event_id").alias("last_price"),
        F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("turnover"),
    )
    holdings = latest_by_key(
        e.where("event_type = 'purchase'").select(
            "ticker",
            F.col("trade_date").alias("holding_date"),
            "event_id",
            F.col("value").alias("close_price"),
            F.when(F.col("k") % 2 == 0, F.col("k").cast("double")).alias("southbound_holding_shares"),
            F.when(F.col("k") % 3 == 0, F.col("value")).alias("southbound_holding_pct"),
        ),
        ["ticker", "holding_date"],
        ["event_id"],
    ).drop("event_id")
    return research.hk_snapshots(components if listed else None, holdings, "2024-01-20")


@query(
    "J12",
    "v_events",
    _HK_SQL
    + """select lpad(cast(user_id as varchar), 5, '0') || '.HK' as ticker, true as hk_connect_eligible, close_price as last_price_hkd, cast(null as double) as turnover_hkd,
      cast(shares as double) as southbound_holding_shares, pct as southbound_holding_pct from hold""",
)
def hk_snapshots_without_components(v):
    """Snapshots from holding rows alone, as when the component list cannot be had."""
    return _hk(v, listed=False)


@query("J12 W16 S12", "v_events", _HK_SQL + "select * from snap")
def hk_connect_snapshots(v):
    return _hk(v)


@query(
    "A29 J17",
    "v_events",
    _HK_SQL
    + f"""select ticker, {r('''(case when last_price_hkd is not null then 1 else 0 end + case when turnover_hkd is not null then 1 else 0 end
      + case when southbound_holding_shares is not null then 1 else 0 end
      + case when southbound_holding_pct is not null then 1 else 0 end) / 4.0::double''', 4)} as completeness,
      concat_ws(',', case when last_price_hkd is null then 'last_price_hkd' end, case when turnover_hkd is null then 'turnover_hkd' end,
      case when southbound_holding_shares is null then 'southbound_holding_shares' end,
      case when southbound_holding_pct is null then 'southbound_holding_pct' end) as missing_fields from snap""",
)
def hk_completeness(v):
    fields = ["last_price_hkd", "turnover_hkd", "southbound_holding_shares", "southbound_holding_pct"]
    return research.hk_completeness(_hk(v), fields).select(
        "ticker", "completeness", F.array_join("missing_fields", ",").alias("missing_fields")
    )


@query(
    "A12",
    "v_bars",
    """select ticker, count(*) as rows, count(distinct trade_date) as trading_days, cast(min(trade_date) as varchar) as first_day,
    cast(max(trade_date) as varchar) as last_day from v_bars group by ticker""",
)
def bar_table_summary(v):
    days = [F.col(d).cast("string").alias(d) for d in ("first_day", "last_day")]
    return readers.table_summary(v.bars(), ["ticker"]).select("ticker", "rows", "trading_days", *days)


@query(
    "F5 F6 F7 F8",
    "v_events",
    """with f as (select event_id, ts, trade_date, ['1d', '5m', '30m', '60m'][cast(event_id % 4 as int) + 1] as frequency from v_events)
    select event_id, strftime(case when frequency = '1d' then trade_date + interval 90 minute else ts end, '%Y-%m-%d %H:%M:%S') as bar_start,
      strftime(case frequency when '1d' then trade_date + interval 420 minute when '5m' then ts + interval 5 minute
               when '30m' then ts + interval 30 minute else ts + interval 60 minute end, '%Y-%m-%d %H:%M:%S') as bar_end,
      strftime(to_timestamp(epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 3) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as quote_bucket,
      strftime(trade_date + to_minutes((hour(ts) * 60 + minute(ts)) // 120 * 120), '%Y-%m-%d %H:%M') as bucket_120m,
      strftime(trade_date - interval 8 hour, '%Y-%m-%d %H:%M') as day_from_utc
    from f""",
)
def time_buckets(v):
    e = v.events().withColumn("at", F.col("ts").cast("timestamp"))
    frequency = cycle(F.col("event_id"), ["1d", "5m", "30m", "60m"])
    full = "yyyy-MM-dd HH:mm:ss"
    bounds = times.bar_bounds(F.col("trade_date"), frequency, F.col("at"))
    return e.select(
        "event_id",
        F.date_format(bounds["bar_start"], full).alias("bar_start"),
        F.date_format(bounds["bar_end"], full).alias("bar_end"),
        F.date_format(times.second_bucket(F.col("at")), full).alias("quote_bucket"),
        F.date_format(times.minute_bucket(F.col("at"), 120), "yyyy-MM-dd HH:mm").alias("bucket_120m"),
        F.date_format(times.local_day_range(F.col("trade_date"))["from_utc"], "yyyy-MM-dd HH:mm").alias("day_from_utc"),
    )


HOLIDAYS, EXTRA_DAYS = ["2024-01-01", "2024-01-15"], ["2024-01-06"]


@query(
    "F9",
    "v_events",
    """with p as (select strftime(ts, '%H:%M:%S') as c, cast(trade_date as varchar) in ('2024-01-06')
         or (isodow(trade_date) < 6 and cast(trade_date as varchar) not in ('2024-01-01', '2024-01-15')) as t from v_events)
    select case when not t then 'non_trading_day' when c >= '08:00:00' and c < '09:25:00' then 'pre_market'
      when (c >= '09:30:00' and c < '11:30:00') or (c >= '13:00:00' and c < '15:00:00') then 'intraday'
      when c >= '11:30:00' and c < '13:00:00' then 'lunch_break' when c >= '15:00:00' and c < '20:30:00' then 'post_market'
      else 'off_hours' end as market_phase, count(*) as n from p group by 1""",
)
def market_phases(v):
    trading = times.is_trading_day(F.col("trade_date"), HOLIDAYS, EXTRA_DAYS)
    phase = times.market_phase(F.col("ts"), trading)
    return v.events().groupBy(phase.alias("market_phase")).agg(F.count("*").alias("n"))


@query(
    "F10",
    "v_cal",
    """select cast(year(calendar_date) as bigint) as year, count(*) as days, count(*) filter (where is_open) as open_days,
      count(*) filter (where not is_open) as closed_days,
      case when count(*) filter (where not is_open and isodow(calendar_date) < 6) = 0 then 'warning' else 'ok' end as status
    from v_cal group by 1""",
)
def calendar_year_report(v):
    c = v.calendar()
    weekday_closed = ~F.col("is_open") & (F.weekday("calendar_date") < 5)
    return c.groupBy(F.year("calendar_date").cast("long").alias("year")).agg(
        F.count("*").alias("days"),
        F.count_if("is_open").alias("open_days"),
        F.count_if(~F.col("is_open")).alias("closed_days"),
        F.when(F.count_if(weekday_closed) == 0, "warning").otherwise("ok").alias("status"),
    )


@query(
    "F41 F42 P17",
    "v_demands",
    """select demand_id, cadence, case cadence when 'daily' then true when 'weekly' then isodow(active_from) = 5
       when 'monthly' then day(active_from) = 1 else day(active_from) = 1 and month(active_from) in (1, 4, 7, 10) end as due,
       (select string_agg(cast(year(q) as varchar) || 'Q' || cast(quarter(q) as varchar), ',' order by q)
        from (select unnest(generate_series(date_trunc('quarter', active_from - interval 200 day), date_trunc('quarter', active_from),
              interval 3 month)) as q)) as quarters,
       cast(active_from - 400 as varchar) as market_start, cast(active_from - 800 as varchar) as financial_start
    from v_demands""",
)
def request_windows(v):
    day = F.col("active_from")
    return v.demands().select(
        "demand_id",
        "cadence",
        times.cadence_due(F.col("cadence"), F.lit(None).cast("string"), day).alias("due"),
        F.array_join(times.quarters_between(F.date_sub(day, 200), day), ",").alias("quarters"),
        times.default_window(day, "market").cast("string").alias("market_start"),
        times.default_window(day, "financial").cast("string").alias("financial_start"),
    )


@query(
    "F21",
    "v_events",
    """with b as (select ['10m', '30m', '60m'][cast(event_id % 3 as int) + 1] as bucket, ['5m', '15m', '60m', '1d'][cast(k % 4 as int) + 1] as src from v_events)
    select bucket, src, case when src <> bucket and try_cast(regexp_replace(src, 'm+$', '') as int) > cast(regexp_replace(bucket, 'm+$', '') as int)
      then bucket || '_to_' || src end as degraded_from, count(*) as n from b group by all""",
)
def degraded_features(v):
    e = v.events().select(cycle(F.col("event_id"), ["10m", "30m", "60m"]).alias("bucket"), cycle(F.col("k"), ["5m", "15m", "60m", "1d"]).alias("src"))
    tag = market.degraded_from(F.col("bucket"), F.col("src"))
    return e.groupBy("bucket", "src", tag.alias("degraded_from")).agg(F.count("*").alias("n"))


@query(
    "F17",
    "v_events",
    """select event_id, case when event_id % 9 <> 0 then cast(trade_date as varchar) end as trade_date,
      case when event_id % 9 <> 0 then value end as main_net_inflow, case when event_id % 9 <> 0 then value * 10000 end as small_net_inflow,
      case when event_id % 9 <> 0 then cast(k as double) end as main_net_inflow_ratio,
      case when k % 5 = 0 then null else coalesce(case when k % 2 = 0 then value end, 0) - coalesce(case when k % 3 = 0 then confidence end, 0) end as net
    from (select *, k % 2 <> 0 and k % 3 <> 0 as none_known from v_events)""".replace("k % 5 = 0", "none_known"),
)
def money_flow_lines(v):
    e = v.events()
    value = F.col("value").cast("string")
    head = F.concat_ws(",", F.date_format("trade_date", "yyyy年MM月dd日"), value, F.concat(value, F.lit("万")))
    tail = F.concat_ws(",", *[F.lit("1")] * 3, F.concat(F.col("k").cast("string"), F.lit("%")), *[F.lit("2")] * 6)
    line = F.when(F.col("event_id") % 9 != 0, F.concat_ws(",", head, tail)).otherwise(head)
    bought, sold = F.when(F.col("k") % 2 == 0, F.col("value")), F.when(F.col("k") % 3 == 0, F.col("confidence"))
    rows = e.select("event_id", line.alias("line"), units.net_inflow(bought, sold).alias("net"))
    day = F.col("trade_date").cast("string").alias("trade_date")
    return normalize.split_klines(rows, "line").select("event_id", day, "main_net_inflow", "small_net_inflow", "main_net_inflow_ratio", "net")


@query(
    "F18",
    "v_buckets",
    f"""select ticker, cast(trade_date as varchar) as trade_date, bucket_clock,
      case when volume > 1 then amount else (open + high + low + close) / 4 * volume * 100.0::double end as amount,
      volume <= 1 as amount_is_estimated from (select ticker, trade_date, bucket_clock, volume, {r("amount", 2)} as amount, open, high, low, close from v_buckets)""",
)
def estimated_amounts(v):
    b = v.buckets()
    actual = F.when(F.col("volume") > 1, round_half_up(F.col("amount"), 2).cast("string")).otherwise("--")
    guess = units.estimated_amount(F.col("open"), F.col("high"), F.col("low"), F.col("close"), F.col("volume"))
    filled = units.amount_or_estimate(actual, guess)
    return b.select(
        "ticker", F.col("trade_date").cast("string").alias("trade_date"), "bucket_clock", filled["amount"].alias("amount"),
        filled["amount_is_estimated"].alias("amount_is_estimated"),
    )


@query(
    "F22",
    "v_daily",
    f"""select ticker, cast(trade_date as varchar) as trade_date, {r("high - low", 4)} as bid_ask_spread,
      case when close <> 0 and high <> 0 then {r("(high - close) / close * 100", 6)} end as up_pct,
      case when close <> 0 and low <> 0 then {r("(close - low) / close * 100", 6)} end as down_pct from v_daily""",
)
def quote_distances(v):
    c = F.col
    return v.daily().select(
        "ticker",
        c("trade_date").cast("string").alias("trade_date"),
        round_half_up(units.quote_spread(c("low"), c("high")), 4).alias("bid_ask_spread"),
        round_half_up(units.limit_distance_pct(c("close"), c("high"), True), 6).alias("up_pct"),
        round_half_up(units.limit_distance_pct(c("close"), c("low"), False), 6).alias("down_pct"),
    )
