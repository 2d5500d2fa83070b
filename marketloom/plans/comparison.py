"""Queries that compare the providers of all record types."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.operators import cells
from marketloom.plans.registry import query
from marketloom.plans.views import DELTAS, cycle, cycle_sql

TYPES = list(fixed.COMPARED_FIELDS)
KINDS = {name: kind for kind, names in fixed.FIELDS_BY_CATEGORY.items() for name in names}
IDENTITY = (
    "normalized_ticker exchange calendar_date trade_date frequency timestamp adjust quote_time_bucket report_period statement_type"
    " report_type index_code effective_date action_type announcement_date ex_date"
).split()
SOURCES = [("tushare", 11, 1), ("akshare", 13, 1), ("akshare", 3, 2), ("baostock", 7, 1)]


def records(v):
    """Records of three providers, of a type that goes by the part; one provider has a second record of some parts."""
    key = F.col("p_partkey")
    deltas = F.array(*[F.lit(d).cast("double") for d in DELTAS])
    by_source = {
        ("tushare", 1): F.lit(0.0), ("akshare", 1): F.get(deltas, (key % 6).cast("int")),
        ("akshare", 2): F.lit(0.25), ("baostock", 1): F.get(deltas, (F.floor(key / 6) % 6).cast("int")),
    }
    sources = F.array(*[F.struct(F.lit(p).alias("provider"), F.lit(g).alias("gap"), F.lit(c).alias("copy"), by_source[p, c].alias("delta")) for p, g, c in SOURCES])
    rows = v.parts().withColumn("_s", F.explode(sources)).select("*", "_s.*").where((key % F.col("gap") != 0) & ((F.col("copy") == 1) | (key % 29 == 0)))
    provider, delta = F.col("provider"), F.col("delta")
    fields = [F.array(*[F.struct(F.lit(f).alias("name"), F.lit(KINDS.get(f, "generic")).alias("kind")) for f in names]) for names in fixed.COMPARED_FIELDS.values()]
    listed = F.get(F.array(*fields), (key % len(TYPES)).cast("int"))

    def value(field, o):
        place = key + o
        odd = (provider == "baostock") & (place % 17 == 0)
        flag = F.when((place % 5 == 0) != odd, "true").otherwise("false")
        free = F.when((provider == "akshare") & (place % 9 == 0), "other name").when((provider == "baostock") & (place % 10 == 0), F.concat(F.upper("p_name"), F.lit(" Ltd.")))
        number = F.when((provider == "baostock") & (place % 31 == 0), "n/a").otherwise((F.col("p_retailprice") * (1 + o) * (1 + delta)).cast("string"))
        empty = (place + F.col("gap")) % 7 == 0
        return F.when(field["kind"] == "status", flag).when(empty, None).when(field["kind"] == "generic", free.otherwise(F.col("p_name"))).otherwise(number)

    places = F.transform(listed, lambda f, o: F.struct(f["name"].alias("key"), value(f, o).alias("value")))
    own = F.map_from_entries(F.filter(places, lambda e: ~e["key"].isin(IDENTITY)))
    identity = F.map_from_entries(
        F.array(*[F.struct(F.lit(n).alias("key"), F.when((F.lit(n) != "timestamp") | (key % 2 == 1), F.concat_ws(":", F.lit(n), key.cast("string"))).alias("value")) for n in IDENTITY])
    )
    return rows.select(
        cycle(key, TYPES).alias("record_type"),
        "provider",
        F.concat_ws(":", "provider", key.cast("string"), F.col("copy").cast("string")).alias("record_id"),
        F.when((provider == "akshare") & (key % 5 == 0), fixed.ESTIMATED_AMOUNT_API).otherwise("daily").alias("source_api"),
        F.map_concat(own, identity).alias("data"),
    )


def _rules_sql() -> str:
    rows = []
    for kind, names in fixed.COMPARED_FIELDS.items():
        for o, name in enumerate(names):
            group, critical = KINDS.get(name, "generic"), name in fixed.CRITICAL_FIELDS
            limits = fixed.TOLERANCES.get(group, {})
            level = {"status": "high" if critical else "medium", "generic": "medium" if critical else "low"}.get(group, "high" if critical else "medium")
            if group == "status" and name in fixed.ALWAYS_CRITICAL_STATUS:
                level = "critical"
            gap = 0.2 if name in ("close", "adj_factor") else 10.0 if group == "amount" else "null"
            rows.append(f"('{kind}', {o}, '{name}', '{group}', {limits.get('absolute', 'null')}::double, {limits.get('relative', 'null')}::double, '{level}', {gap}::double, {name in IDENTITY})")
    return "(values " + ", ".join(rows) + ") rules(record_type, o, field_name, kind, absolute, relative, level, critical_gap, is_identity)"


def _key_sql() -> str:
    def name(n: str) -> str:
        return f"'{n}:' || k"

    keys = {
        "security_master": ["normalized_ticker"], "trade_calendar": ["exchange", "calendar_date"], "trading_status": ["normalized_ticker", "trade_date"],
        "bar": ["normalized_ticker", "frequency", None, "adjust"], "realtime_quote": ["normalized_ticker", "quote_time_bucket"],
        "adj_factor": ["normalized_ticker", "trade_date"], "financial_statement": ["normalized_ticker", "report_period", "statement_type", "report_type"],
        "financial_indicator": ["normalized_ticker", "report_period"], "valuation_metric": ["normalized_ticker", "trade_date"], "index": ["index_code"],
        "index_bar": ["index_code", "frequency", "?timestamp"], "index_constituent": ["index_code", "normalized_ticker", "effective_date"],
        "corporate_action": ["normalized_ticker", "action_type", "announcement_date", "ex_date"],
    }
    at = f"case when k % 2 = 1 then {name('timestamp')} else {{}} end"
    cases = []
    for kind, parts in keys.items():
        texts = [at.format(name("trade_date")) if p is None else at.format("'None'") if p.startswith("?") else name(p) for p in parts]
        cases.append(f"when '{kind}' then " + " || '|' || ".join(texts))
    return "case record_type " + " ".join(cases) + " end"


_CELLS = f"""
r as (
  select p_partkey as k, p_name, p_retailprice, provider, gap, copy, {cycle_sql("p_partkey", TYPES)} as record_type,
    provider || ':' || p_partkey || ':' || copy as record_id,
    case when provider = 'akshare' and p_partkey % 5 = 0 then '{fixed.ESTIMATED_AMOUNT_API}' else 'daily' end as source_api,
    case when provider = 'tushare' then 0.0::double when copy = 2 then 0.25::double
         when provider = 'akshare' then (cast({DELTAS!r} as double[]))[cast(p_partkey % 6 as int) + 1]
         else (cast({DELTAS!r} as double[]))[cast((p_partkey // 6) % 6 as int) + 1] end as delta
  from part cross join (values {", ".join(map(str, SOURCES))}) s(provider, gap, copy)
  where p_partkey % gap <> 0 and (copy = 1 or p_partkey % 29 = 0)),
c as (
  select r.*, {_key_sql()} as comparison_key, field_name, kind, absolute, relative, level, critical_gap,
    case when is_identity then field_name || ':' || k
         when kind = 'status' then case when ((k + o) % 5 = 0) <> (provider = 'baostock' and (k + o) % 17 = 0) then 'true' else 'false' end
         when (k + o + gap) % 7 = 0 then null
         when kind = 'generic' then case when provider = 'akshare' and (k + o) % 9 = 0 then 'other name'
              when provider = 'baostock' and (k + o) % 10 = 0 then upper(p_name) || ' Ltd.' else p_name end
         when provider = 'baostock' and (k + o) % 31 = 0 then 'n/a'
         else cast(p_retailprice * (1 + o) * (1 + delta) as varchar) end as value
  from r join {_rules_sql()} using (record_type)),
m as (
  select b.record_type, b.comparison_key, a.record_id as canonical_record_id, b.provider as other_provider, b.record_id as other_record_id,
    b.field_name, b.kind, b.level, b.absolute, b.relative, b.critical_gap, a.value as x, b.value as y, try_cast(a.value as double) as xn, try_cast(b.value as double) as yn,
    coalesce(a.value <> '' and b.value <> '', false)
      and not (b.field_name in ('amount', 'vwap') and (contains(a.source_api, '{fixed.ESTIMATED_AMOUNT_API}') or contains(b.source_api, '{fixed.ESTIMATED_AMOUNT_API}'))) as checked
  from c b join c a on a.provider = 'tushare' and b.provider <> 'tushare' and a.record_type = b.record_type and a.k = b.k and a.field_name = b.field_name),
g as (select *, abs(xn - yn) as d, abs(xn - yn) / greatest(abs(xn), abs(yn), 1e-12::double) as gap from m),
k as (
  select *, case when not checked then null
    when kind = 'status' then case when x <> y then level end
    when kind = 'generic' then case when regexp_replace(regexp_replace(lower(x), '\\s+', '', 'g'), 'ltd[.]$', '') <> regexp_replace(regexp_replace(lower(y), '\\s+', '', 'g'), 'ltd[.]$', '') then level end
    when xn is null and yn is null then null when xn is null or yn is null then 'medium'
    when coalesce(d <= absolute, false) or coalesce(gap <= relative, false) then null
    when gap > critical_gap then 'critical' else level end as severity
  from g)""".replace("None,", "null,").replace("None]", "null]")


def _compared(v):
    return cells.cells(records(v), "tushare")


@query(
    "J5 J6 F33 A17", "",
    f"with {_CELLS} select record_type, comparison_key, canonical_record_id, other_provider, other_record_id, field_name, severity from k where severity is not null",
)
def type_conflicts(v):
    """Conflicting fields of all record types."""
    found = _compared(v).where("severity is not null")
    return found.select("record_type", "comparison_key", "canonical_record_id", "other_provider", "other_record_id", "field_name", "severity")


@query(
    "J5 J6 A14", "",
    f"""with {_CELLS} select record_type, comparison_key, 'tushare' as canonical_provider, canonical_record_id, other_provider, other_record_id,
      count(*) filter (where checked) as checked_fields, count(*) filter (where checked) - count(severity) as matched_fields,
      count(severity) as conflicted_fields, case when count(severity) = 0 then 'matched' else 'conflicted' end as status
    from k group by 1, 2, 3, 4, 5, 6""",
)
def type_comparisons(v):
    """Result of every record that was held against a canonical one."""
    return cells.results(_compared(v))


@query(
    "A14 F33", "",
    f"""with {_CELLS} select record_type, field_name, count(*) filter (where checked) as checked,
      {", ".join(f"count(*) filter (where severity = '{s}') as {s}_conflicts" for s in fixed.SEVERITY_RANK)} from k group by 1, 2""",
)
def type_conflict_summary(v):
    """Conflicts of every compared field of every record type."""
    return cells.summary(_compared(v))
