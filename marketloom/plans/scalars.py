"""Queries that run the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import numbers, text, tickers, times, units
from marketloom.functions.numbers import round_half_up
from marketloom.plans.registry import query, r
from marketloom.plans.views import cycle

_CODES = "['6' || c5, 'sz.0' || c5, '3' || c5 || '.XSHE', 'hk' || c5, c5 || '.HKEX', '43' || substr(c5, 1, 4) || '_BSE', 'sh6' || c5, '9x' || c5, '00' || c5 || '.SZ'][cast(p_partkey % 9 as int) + 1]"
_PREFIX = {"SH": "600|601|603|605|688|689|900", "SZ": "000|001|002|003|200|300|301", "BJ": "43|82|83|87|88|89"}
_INFER = "case " + " ".join(f"when regexp_matches(code, '^({p})') then '{e}'" for e, p in _PREFIX.items()) + " end"


def _raw_code():
    key = F.col("p_partkey")
    c5 = F.lpad((key * 37 % 100000).cast("string"), 5, "0")
    forms = [
        F.concat(F.lit("6"), c5), F.concat(F.lit("sz.0"), c5), F.concat(F.lit("3"), c5, F.lit(".XSHE")), F.concat(F.lit("hk"), c5), F.concat(c5, F.lit(".HKEX")),
        F.concat(F.lit("43"), F.substring(c5, 1, 4), F.lit("_BSE")), F.concat(F.lit("sh6"), c5), F.concat(F.lit("9x"), c5), F.concat(F.lit("00"), c5, F.lit(".SZ")),
    ]
    return F.get(F.array(*forms), (key % 9).cast("int"))


@query(
    "F1 F2",
    "",
    f"""with p as (select p_partkey, lpad(cast(p_partkey * 37 % 100000 as varchar), 5, '0') as c5 from part),
    raw as (select p_partkey, {_CODES} as raw from p),
    x as (select p_partkey, raw, regexp_extract(raw, '([0-9]{{5,7}})', 1) as code, case p_partkey % 9 when 1 then 'SZ' when 2 then 'SZ' when 3 then 'HK' when 4 then 'HK' when 5 then 'BJ' when 6 then 'SH' when 8 then 'SZ' end as given from raw),
    y as (select *, {_INFER} as owner from x),
    z as (select p_partkey, raw, case when p_partkey % 9 in (3, 4) then code || '.HK' when p_partkey % 9 = 7 or length(code) <> 6 then null
       when given is null and owner is not null then code || '.' || owner when given = owner then code || '.' || given end as ticker from y)
    select p_partkey, raw, ticker, case when ticker is null then 'INVALID_TICKER' end as error, coalesce(not ends_with(ticker, '.HK'), false) as a_share, coalesce(ends_with(ticker, '.HK'), false) as hk,
      case when ends_with(ticker, '.SH') or ends_with(ticker, '.SZ') then lower(split_part(ticker, '.', 2)) || '.' || split_part(ticker, '.', 1) end as baostock,
      lower(split_part(ticker, '.', 2)) || split_part(ticker, '.', 1) as akshare,
      split_part(ticker, '.', 1) || case split_part(ticker, '.', 2) when 'SH' then '.XSHG' when 'SZ' then '.XSHE' when 'BJ' then '.XBSE' end as joinquant from z""",
)
def normalised_tickers(v):
    rows = v.table("part").select("p_partkey", _raw_code().alias("raw")).withColumn("ticker", tickers.normalize(F.col("raw")))
    return rows.select(
        "p_partkey", "raw", "ticker", tickers.ticker_error(F.col("raw")).alias("error"), tickers.is_a_share(F.col("raw")).alias("a_share"),
        tickers.is_hk(F.col("raw")).alias("hk"),
        *[tickers.provider_symbol(F.col("ticker"), d).alias(d) for d in ("baostock", "akshare", "joinquant")],
    )


@query(
    "F47",
    "",
    """with p as (select p_partkey, ['000300.sh', 'SZ399001', '399006.SZ', '000016'][cast(p_partkey % 4 as int) + 1] as raw from part)
    select p_partkey, case p_partkey % 4 when 0 then 'sh000300' when 1 then 'sz399001' when 2 then 'sz399006' else 'sh000016' end as symbol from p""",
)
def index_symbols(v):
    raw = cycle(F.col("p_partkey"), ["000300.sh", "SZ399001", "399006.SZ", "000016"])
    return v.table("part").select("p_partkey", tickers.index_symbol(raw).alias("symbol"))


@query(
    "F3 F15 F27",
    "v_events",
    """select event_id, case event_id % 6 when 4 then null when 5 then null else cast(trade_date as varchar) end as trade_date,
      case event_id % 6 when 5 then null else cast(trade_date as varchar) end as flexible,
      case event_id % 6 when 0 then strftime(trade_date, '%Y-%m-%d') when 1 then strftime(ts, '%Y-%m-%d') when 4 then null when 5 then '2024-01-01' when 2 then null when 3 then strftime(trade_date, '%Y-%m-%d') end as partial from v_events""",
)
def parsed_dates(v):
    e = v.events()
    day, stamp = F.col("trade_date"), F.col("ts")
    raw = F.get(
        F.array(
            F.date_format(day, "yyyy-MM-dd"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.date_format(day, "yyyyMMdd"),
            F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(day, "yyyy年MM月dd日"), F.lit("2024-01"),
        ),
        (F.col("event_id") % 6).cast("int"),
    )
    return e.select(
        "event_id",
        times.trade_date(raw).cast("string").alias("trade_date"),
        times.flexible_date(raw).cast("string").alias("flexible"),
        F.date_format(times.partial_date(raw), "yyyy-MM-dd").alias("partial"),
    )


@query(
    "F4",
    "v_events",
    """select event_id, strftime(case event_id % 3 when 0 then date_trunc('second', ts) - interval 8 hour when 1 then date_trunc('second', ts) else trade_date - interval 8 hour end, '%Y-%m-%d %H:%M:%S') as instant from v_events""",
)
def parsed_instants(v):
    stamp = F.col("ts")
    raw = F.get(
        F.array(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")), F.date_format("trade_date", "yyyyMMdd")),
        (F.col("event_id") % 3).cast("int"),
    )
    return v.events().select("event_id", F.date_format(times.instant(raw), "yyyy-MM-dd HH:mm:ss").alias("instant"))


@query(
    "F11",
    "v_events",
    """select event_id, case event_id % 4 when 0 then value * 100 when 1 then value when 2 then null else value * case provider when 'tushare' then 100.0::double else 1.0::double end end as shares,
      case event_id % 5 when 0 then value when 1 then value * 1000 when 2 then value * 10000 when 3 then null else value * case provider when 'tushare' then 1000.0::double else 1.0::double end end as amount,
      case event_id % 5 when 0 then 'HKD' else 'CNY' end as currency, case event_id % 4 when 2 then 'NORMALIZATION_FAILED' end as unit_error from v_events""",
)
def converted_units(v):
    e = v.events()
    value, provider = F.col("value").cast("string"), F.col("provider")
    vol_unit = cycle(F.col("event_id"), ["手", "share", "barrel", None])
    amt_unit = cycle(F.col("event_id"), ["港元", "千元", "万", "gold", None])
    return e.select(
        "event_id",
        units.volume_shares(value, vol_unit, provider).alias("shares"),
        units.amount_base(value, amt_unit, provider).alias("amount"),
        units.amount_currency(amt_unit).alias("currency"),
        units.unit_error(vol_unit, {"手": 1.0, "share": 1.0, "": 1.0}).alias("unit_error"),
    ).withColumn("currency", F.coalesce("currency", F.lit("CNY")))


@query(
    "F13 F14",
    "v_events",
    f"""select event_id, case event_id % 6 when 0 then {r("k * 100000000.0::double", 2)} when 1 then {r("value * 10000.0::double", 2)} when 2 then cast(k as double) when 3 then null when 4 then k * 1000.0::double else cast(k as double) end as parsed,
      event_id % 6 = 3 as missing from v_events""",
)
def chinese_numbers(v):
    k, value = F.col("k").cast("string"), F.col("value").cast("string")
    raw = F.get(
        F.array(F.concat(k, F.lit("亿")), F.concat(value, F.lit("万")), F.concat(k, F.lit("%")), F.lit("--"), F.concat(k, F.lit("千")), F.concat(F.lit("约"), k, F.lit("家"))),
        (F.col("event_id") % 6).cast("int"),
    )
    return v.events().select(
        "event_id", round_half_up(numbers.chinese_number(raw), 2).alias("parsed"), numbers.is_missing(raw).alias("missing")
    )


@query(
    "F16",
    "",
    """select c_custkey, lower(replace(replace(c_name, ' ', ''), '#', '#')) as compare_form from customer""",
)
def compare_forms(v):
    """Names with full-width letters, spaces and company suffixes fold to one form."""
    odd = F.col("c_custkey") % 2 == 1
    wide = F.when(odd, F.concat(F.translate("c_name", "Custo", "Ｃｕｓｔｏ"), F.lit(" Ltd."))).otherwise(F.concat(F.lit(" "), F.col("c_name"), F.lit("有限公司")))
    return v.table("customer").select("c_custkey", text.compare_form(wide).alias("compare_form"))


@query(
    "F26",
    "v_events",
    """select event_id, case event_id % 5 when 0 then k when 1 then k * 7 when 2 then k * 30 when 3 then k * 365 end as days,
      case event_id % 5 when 0 then k * 1440 when 2 then k when 4 then k * 60 end as minutes from v_events""",
)
def window_lengths(v):
    raw = F.concat(F.col("k").cast("string"), cycle(F.col("event_id"), ["d", "w", "m", "y", "h"]))
    return v.events().select("event_id", times.window_days(raw).alias("days"), times.window_minutes(raw).alias("minutes"))


@query(
    "F44",
    "",
    "select c_custkey, array_to_string(list_filter([c_name, c_mktsegment, case when c_mktsegment <> 'BUILDING' then 'BUILDING' end], lambda x: x is not null), '|') as terms from customer",
)
def entity_terms(v):
    terms = F.array_distinct(F.flatten(F.array(F.array("c_name", F.lit("")), F.array("c_mktsegment"), F.array(F.lit("BUILDING"), F.col("c_name")))))
    return v.table("customer").select("c_custkey", F.array_join(F.filter(terms, lambda t: t != ""), "|").alias("terms"))


@query(
    "F38",
    "v_events",
    """select event_id, 1 as base_only, case when k % 2 = 0 then k else -1 end as shared, case when k % 2 = 0 then 2 end as override_only from v_events""",
)
def merged_settings(v):
    """Override maps laid over base maps; the override wins on shared names."""
    base = F.create_map(F.lit("base_only"), F.lit(1), F.lit("shared"), F.lit(-1))
    none = F.create_map().cast("map<string,int>")
    override = F.when(F.col("k") % 2 == 0, F.create_map(F.lit("shared"), F.col("k"), F.lit("override_only"), F.lit(2))).otherwise(none)
    kept = F.map_filter(base, lambda name, _: ~F.map_contains_key(override, name))
    merged = v.events().select("event_id", F.map_concat(kept, override).alias("m"))
    return merged.select("event_id", *[F.try_element_at("m", F.lit(n)).alias(n) for n in ("base_only", "shared", "override_only")])


@query(
    "F38",
    "v_events",
    """with b as (select event_id, k, event_type, '{"mode":"base","limits":{"rows":' || k || ',"deep":{"a":1,"b":{"x":' || (k % 3) || '}}},"tags":["t"]}' as base,
      case k % 4 when 0 then '{"limits":{"deep":{"b":{"x":9,"y":"' || event_type || '"}}}}' when 1 then '{"limits":"none","extra":{"k":' || k || '}}'
        when 2 then '{"mode":{"name":"m"},"tags":[]}' else '{}' end as override from v_events)
    select event_id, json_extract_string(m, '$.mode') as mode, json_extract_string(m, '$.limits.rows') as limit_rows, json_extract_string(m, '$.limits.deep.a') as deep_a,
      json_extract_string(m, '$.limits.deep.b.x') as deep_x, json_extract_string(m, '$.limits.deep.b.y') as deep_y, json_extract_string(m, '$.extra.k') as extra_k, json_extract_string(m, '$.tags') as tags
    from (select event_id, json_merge_patch(base, override) as m from b)""",
)
def merged_trees(v):
    """Override trees laid over base trees of any depth; where both have a map, their entries are merged in turn."""
    k = F.col("k")
    base = F.format_string('{"mode":"base","limits":{"rows":%d,"deep":{"a":1,"b":{"x":%d}}},"tags":["t"]}', k, k % 3)
    override = (
        F.when(k % 4 == 0, F.format_string('{"limits":{"deep":{"b":{"x":9,"y":"%s"}}}}', "event_type"))
        .when(k % 4 == 1, F.format_string('{"limits":"none","extra":{"k":%d}}', k))
        .when(k % 4 == 2, F.lit('{"mode":{"name":"m"},"tags":[]}'))
        .otherwise("{}")
    )
    merged = v.events().select("event_id", text.merge_trees(base, override).alias("m"))
    paths = {"mode": "mode", "limit_rows": "limits.rows", "deep_a": "limits.deep.a", "deep_x": "limits.deep.b.x", "deep_y": "limits.deep.b.y", "extra_k": "extra.k", "tags": "tags"}
    return merged.select("event_id", *[F.get_json_object("m", f"$.{p}").alias(n) for n, p in paths.items()])


@query(
    "P1",
    "v_events",
    """select event_id, case event_id % 4 when 0 then true when 1 then false when 2 then k <> 0 else false end as flag, coalesce(case when k % 3 = 0 then cast(k as varchar) end, event_type) as first_present from v_events""",
)
def flags_and_aliases(v):
    k = F.col("k").cast("string")
    words = F.get(F.array(F.lit("开市"), F.lit("停牌"), k, F.lit("maybe")), (F.col("event_id") % 4).cast("int"))
    picked = numbers.present(F.when(F.col("k") % 3 == 0, k).otherwise(""), F.col("event_type"))
    return v.events().select("event_id", numbers.flag(words).alias("flag"), picked.alias("first_present"))
