"""Queries on keyed lookups, run logs, report sections, missed expectations and unreadable rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions import urls
from marketloom.operators import demands, normalize, readers, research
from marketloom.plans.documents import _type_case
from marketloom.plans.providers import _SHOWN, _raw_of
from marketloom.plans.registry import query, r
from marketloom.plans.research import _golden, _golden_sql
from marketloom.plans.views import cycle, cycle_sql
from marketloom.session import scratch_root
from marketloom.sources import tables

_READABLE = "regexp_matches(ticker, '^(600|601|603|605|688|689|900|000|001|002|003|200|300|301|43|82|83|87|88|89)')"
_ONE, _DAY = "600012.SH", "2024-01-10"

#: Lookups of single records: record type, wanted values, and their condition in SQL.
_LOOKUPS = {
    "securities_by_ticker": ("security_master", {"normalized_ticker": [_ONE, "300001.SZ"]}, f"ticker in ('{_ONE}', '300001.SZ')"),
    "security_by_ticker": ("security_master", {"normalized_ticker": _ONE}, f"ticker = '{_ONE}'"),
    "valuation_on_day": ("valuation_metric", {"normalized_ticker": _ONE, "trade_date": _DAY}, f"ticker = '{_ONE}' and trade_date = date '{_DAY}'"),
    "indicator_of_period": ("financial_indicator", {"normalized_ticker": _ONE, "report_period": _DAY}, f"ticker = '{_ONE}' and trade_date = date '{_DAY}'"),
    "industries_of_ticker": ("industry_membership", {"normalized_ticker": _ONE}, f"ticker = '{_ONE}'"),
    "concepts_of_ticker": ("concept_membership", {"normalized_ticker": _ONE}, f"ticker = '{_ONE}'"),
    "money_flow_in_range": ("money_flow", {"normalized_ticker": _ONE, "trade_date": ("2024-01-08", "2024-01-20")}, f"ticker = '{_ONE}' and trade_date between date '2024-01-08' and date '2024-01-20'"),
    "constituents_of_index": ("index_constituent", {"index_code": "purchase"}, "event_type = 'purchase'"),
}


def _lookup_query(name: str, kind: str, wanted: dict, condition: str):
    number, _ = _SHOWN[kind]
    shown = "event_type" if number in ("industry_name", "index_name") else "value"

    def build(v):
        rows = normalize.standardise(_raw_of(v, kind), kind).where("normalized_ticker is not null")
        found = readers.look_up(rows, **wanted)
        value = F.col(number) if shown == "event_type" else F.col(number).cast("double")
        return found.select("raw_row_index", "normalized_ticker", value.alias("shown"))

    build.__name__ = name
    build.__doc__ = f"Rows of {kind} by {', '.join(wanted)}."
    query("P9", "v_events", f"select event_id as raw_row_index, ticker as normalized_ticker, {shown} as shown from v_events where {_READABLE} and {condition}")(build)


for _name, (_kind, _wanted, _condition) in _LOOKUPS.items():
    _lookup_query(_name, _kind, _wanted, _condition)


@query(
    "P2 P31",
    "v_events",
    f"""select kind as record_type, case when event_id % 9 = 0 then '?' || ticker else ticker end as given, count(*) as rows
    from v_events cross join (values ('adj_factor'), ('valuation_metric'), ('money_flow')) t(kind) where event_id % 9 = 0 or not {_READABLE} group by 1, 2""",
)
def unreadable_tickers(v):
    """Raw rows whose ticker cannot be read, which canonical tables leave out, by type and spelling; every ninth is garbled."""
    parts = None
    for kind in ("adj_factor", "valuation_metric", "money_flow"):
        given = F.element_at("raw", "ts_code").alias("given")
        garbled = F.transform_values("raw", lambda k, x: F.when((k == "ts_code") & (F.col("raw_row_index") % 9 == 0), F.concat(F.lit("?"), x)).otherwise(x))
        raw = _raw_of(v, kind).withColumn("raw", garbled)
        rows = normalize.standardise(raw, kind).where("normalized_ticker is null").select(F.lit(kind).alias("record_type"), given)
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.groupBy("record_type", "given").agg(F.count("*").alias("rows"))


@query(
    "P15",
    "v_events",
    "select event_id, provider, strftime(ts, '%Y-%m-%d %H:%M:%S') as checked_at, value from v_events where provider = 'akshare' order by ts desc, event_id desc limit 10",
)
def capabilities_of_tool(v):
    """Newest capability checks of one tool."""
    found = readers.newest(v.events().select("event_id", "provider", "ts", "value"), ["ts", "event_id"], 10, provider="akshare")
    return found.select("event_id", "provider", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("checked_at"), "value")


@query(
    "P15",
    "v_events",
    f"""select event_id, event_type as feature_window, strftime(ts, '%Y-%m-%d %H:%M:%S') as bucket_start, value from v_events
    where ticker = '{_ONE}' and event_type = 'view' order by ts desc, event_id desc limit 100""",
)
def features_of_ticker(v):
    """Newest features of one ticker and window."""
    rows = v.events().select("event_id", F.col("event_type").alias("feature_window"), "ticker", "ts", "value")
    found = readers.newest(rows, ["ts", "event_id"], 100, ticker=_ONE, feature_window="view")
    return found.select("event_id", "feature_window", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("bucket_start"), "value")


@query(
    "P15",
    "v_demands",
    """select * from (select demand_id, 'demand' as part, status, cast(active_from as varchar) as at from v_demands where owner_id = 77 order by active_from desc, demand_id desc limit 20)
    union all select * from (select l_orderkey * 10 + l_linenumber, 'task', l_linestatus, cast(cast(l_shipdate as date) as varchar) from lineitem
      where l_suppkey = 77 order by cast(l_shipdate as date) desc, l_orderkey * 10 + l_linenumber desc limit 20)""",
)
def collection_status(v):
    """Newest demands and tasks of one owner."""
    own = readers.newest(v.demands(), ["active_from", "demand_id"], 20, owner_id=77)
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("task_id")
    tasks = v.table("lineitem").select(line, "l_suppkey", F.to_date("l_shipdate").alias("day"), F.col("l_linestatus").alias("status"))
    done = readers.newest(tasks, ["day", "task_id"], 20, l_suppkey=77)
    shown = own.select("demand_id", F.lit("demand").alias("part"), "status", F.col("active_from").cast("string").alias("at"))
    return shown.unionByName(done.select(F.col("task_id").alias("demand_id"), F.lit("task").alias("part"), "status", F.col("day").cast("string").alias("at")))


def _links(v):
    h = v.hits()
    return h.select(F.col("doc_id").alias("link_id"), "run_id", (F.col("doc_id") % 97).alias("triage_score"), cycle(F.col("doc_id"), ["read", "link_record_only", "skip_for_now"]).alias("triage_decision"))


_LINKS = f"l as (select doc_id as link_id, run_id, doc_id % 97 as triage_score, {cycle_sql('doc_id', ['read', 'link_record_only', 'skip_for_now'])} as triage_decision from v_hits)"


@query(
    "K7",
    "v_hits",
    f"""with {_LINKS}, f as (select min(run_id) as run_id from l)
    select * from (select 'all' as asked, l.* from l join f using (run_id) order by triage_score desc, link_id desc limit 20)
    union all select * from (select 'read', l.* from l join f using (run_id) where triage_decision = 'read' order by triage_score desc, link_id desc limit 5)""",
)
def links_of_run(v):
    """Best links of the first run, whatever their decision, and those to read."""
    links = _links(v)
    run = links.agg(F.min("run_id")).first()[0]
    parts = [readers.links_of_run(links, run, decision, limit).withColumn("asked", F.lit(asked)) for asked, decision, limit in (("all", None, 20), ("read", "read", 5))]
    return parts[0].unionByName(parts[1])


@query("J23", "v_hits", f"select domain, {_type_case('domain')} as source_type, count(*) as hits from v_hits group by 1, 2")
def types_of_all_hosts(v):
    """Hits by host with the type of its listed domain, or the default for hosts that are not listed."""
    return v.hits().groupBy("domain", urls.source_type(F.col("domain")).alias("source_type")).agg(F.count("*").alias("hits"))


# --- golden lists and run logs ---------------------------------------------------------------


def _undated(v):
    events = v.research_events().withColumn("summary", F.col("event_type")).withColumn("event_date", F.when(F.col("event_id") % 3 != 0, F.col("event_date")))
    return research.golden_matches(_golden(v), events, events.select("event_id", "tracking_variable"))


_MATCHED = _golden_sql() + "select g.expected_event_id, g.target_id, m.event_id, g.kw from g left join m on g.expected_event_id = m.expected_event_id and rn = 1"


@query("J15", "v_events", f"select expected_event_id, event_id as matched_event_id from ({_MATCHED})")
def golden_matches_undated(v):
    """Matches where a third of the events has no date and counts on the day it was created."""
    return _undated(v).select("expected_event_id", "matched_event_id")


@query("A30", "v_events", f"select expected_event_id, target_id from ({_MATCHED}) where event_id is null")
def golden_missed(v):
    """Expected events that nothing matches."""
    return research.golden_missed(_undated(v))


@query(
    "S20 A30",
    "v_events",
    f"""select kw as golden_file, count(*) as expected_count, count(event_id) as matched_count, {r("count(event_id) / cast(count(*) as double)", 4)} as recall,
      coalesce(string_agg(expected_event_id, ',' order by expected_event_id) filter (where event_id is null), '') as missed from ({_MATCHED}) group by 1""",
)
def golden_run_log(v):
    """Evaluation runs of five golden lists, recorded twice: ids come from the outcome, so the second adds nothing."""
    word = cycle(F.regexp_extract("expected_event_id", "([0-9]+)", 1).cast("long"), ["signup", "error", "click", "View", "purchase"])
    runs = research.golden_runs(_undated(v).withColumn("golden_file", word), ["golden_file"])
    path = f"{scratch_root(v.spark)}/golden-{uuid.uuid4().hex}"
    for _ in range(2):
        tables.append_once(runs, path, "run_id")
    return tables.read(v.spark, path).select("golden_file", "expected_count", "matched_count", "recall", "missed")


@query(
    "S21",
    "v_events",
    """with k as (select *, 'run:' || user_id || ':' || event_type as idempotency_key, case when k % 4 = 0 then 'failed' else 'success' end as status from v_events),
    first as (select * from (select *, row_number() over (partition by idempotency_key order by ts, event_id) as rn from k where trade_date < date '2024-01-15') where rn = 1)
    select k.event_id, case when first.status = 'success' then first.event_id end as reused_run_id from k left join first using (idempotency_key) where k.trade_date >= date '2024-01-15'""",
)
def reused_runs(v):
    """Later requests with the successful run of the same key that answers them."""
    key = F.concat_ws(":", F.lit("run"), F.col("user_id").cast("string"), "event_type")
    runs = v.events().select("event_id", "trade_date", key.alias("idempotency_key"), F.when(F.col("k") % 4 == 0, "failed").otherwise("success").alias("status"), F.col("ts").alias("started_at"))
    path = f"{scratch_root(v.spark)}/runs-{uuid.uuid4().hex}"
    logged = runs.where(F.col("trade_date") < F.lit("2024-01-15").cast("date")).withColumnRenamed("event_id", "run_id").drop("trade_date")
    demands.log_runs(logged, path)
    demands.log_runs(logged.withColumn("status", F.lit("success")), path)
    later = runs.where(F.col("trade_date") >= F.lit("2024-01-15").cast("date")).select("event_id", "idempotency_key")
    return demands.reusable_runs(later, tables.read(v.spark, path)).select("event_id", "reused_run_id")


@query(
    "A37",
    "v_events",
    """select trade_date::varchar as batch, count(*) as items, count(*) filter (where k % 10 = 0) as failures,
      case when count(*) filter (where k % 10 = 0) = 0 then 'success' when count(*) filter (where k % 10 = 0) < count(*) then 'partial_success' else 'failed' end as status
    from (select *, trade_date || ':' || user_id as b from v_events) group by 1""",
)
def batch_statuses(v):
    """Status of every day's batch; a ticker that fails does not fail the batch."""
    items = v.events().select(F.col("trade_date").cast("string").alias("batch"), (F.col("k") % 10 == 0).alias("failed"))
    return demands.batches(items, "batch")


@query(
    "S17",
    "v_events",
    "select provider, count(*) as rows, cast(sum(event_id) as bigint) as ids from v_events where user_id % 2 = 0 group by 1",
)
def exported_results(v):
    """Results written as JSON and read back."""
    path = f"{scratch_root(v.spark)}/export-{uuid.uuid4().hex}"
    tables.export_json(tables.nested_to_json(v.events().where("user_id % 2 = 0").select("event_id", F.struct("provider", "k").alias("result"))), path)
    back = v.spark.read.schema("event_id long, result string").json(path)
    return back.groupBy(F.get_json_object("result", "$.provider").alias("provider")).agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids"))


# --- reports ---------------------------------------------------------------------------------

_ISSUE = "event_type = 'error'"
_COUNTS = {
    "events": "'all'", "runs": "provider || '|' || event_type", "issues": f"case when {_ISSUE} then source_type end", "gaps": "case when event_type = 'view' then 'all' end",
    "features": "case when event_type = 'purchase' then 'all' end", "run_costs": "provider || '|' || event_type || '|' || review_status",
    "tickets": "case when event_type in ('click', 'error') then event_type end", "messages": "source_type || '|' || direction", "demand_tasks": "case when user_id < 30 then user_id || '|' || review_status end",
}
_LISTS = {
    "top_events": ("true", "confidence", 10), "top_features": ("event_type = 'purchase'", "value", 10), "issue_details": (_ISSUE, "case source_type when 'media' then 1 else 0 end", 20),
    "gap_details": ("event_type = 'view'", "0", 10), "failed_tasks": ("event_type = 'error' and k % 2 = 0", "0", 10), "faults": ("event_type = 'click' and k % 3 = 0", "0", 10),
    "dead_messages": ("direction = 'negative' and k % 5 = 0", "0", 10), "open_gaps": ("event_type = 'view' and review_status = 'pending'", "0", 10),
}


@query(
    "A7 K1 K2",
    "v_events",
    "with d as (select *, cast(event_id as varchar) as item from v_events where ts >= timestamp '2024-01-09 16:00:00' and ts < timestamp '2024-01-10 16:00:00'), c as ("
    + " union all ".join(f"select '{s}' as section, {e} as item from d" for s, e in _COUNTS.items())
    + "), l as ("
    + " union all ".join(f"select '{s}' as section, cast({rank} as double) as rank, ts, item, {n} as n from d where {cond}" for s, (cond, rank, n) in _LISTS.items())
    + """) select section, cast(null as int) as position, item, count(*) as rows from c where item is not null group by 1, 3
    union all select section, cast(position as int), item, null from (select *, row_number() over (partition by section order by coalesce(rank, 0) desc, ts desc, item desc) as position from l) where position <= n""",
)
def daily_report_sections(v):
    """Seventeen sections of one local day's report from two passes over the events."""
    rows = v.events().withColumn("created_at", F.col("ts"))
    lists = {s: (F.expr(cond), F.expr(rank), F.col("event_id").cast("string"), n) for s, (cond, rank, n) in _LISTS.items()}
    return readers.report_sections(rows, "2024-01-09 16:00:00", "2024-01-10 16:00:00", {s: F.expr(e) for s, e in _COUNTS.items()}, lists)


@query(
    "A26",
    "v_events",
    f"""select user_id || ':' || trade_date as run_id, count(*) as events, bool_and(k % 2 = 0) as events_missing_source_url,
      bool_or(confidence >= {fixed.HIGH_CONFIDENCE}::double and k % 7 = 0) as high_confidence_missing_published_at, bool_and(source_type in ('media', 'social')) as low_authority_sources_only
    from v_events group by 1""",
)
def all_research_runs(v):
    """Issues of every run, one per user and day."""
    events = v.events().select(
        F.concat_ws(":", F.col("user_id").cast("string"), F.col("trade_date").cast("string")).alias("run_id"),
        F.when(F.col("k") % 2 != 0, "http://x").alias("source_url"), "confidence", F.when(F.col("k") % 7 != 0, F.col("ts")).alias("published_at"), "source_type", "tracking_variable",
    )
    return research.run_quality(events)
