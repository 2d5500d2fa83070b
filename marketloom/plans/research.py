"""Queries on coverage, recall, research cards, demands, targets and operational reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import keys, tickers, times, units
from marketloom.functions.numbers import lookup
from marketloom.operators import demands, intervals, readers, research
from marketloom.operators.hotkeys import first_by_key, latest_by_key
from marketloom.plans.registry import query, r
from marketloom.plans.views import cycle, cycle_sql

_RATIO = r("count(*) filter (where covered) / cast(count(*) as double)", 4)
_CELLS = f"""count(*) as expected_cells, count(*) filter (where covered) as covered_cells,
 count(*) filter (where covered and has_authoritative_source) as authoritative_cells, {_RATIO} as coverage_ratio"""


def _matrix(v, confirmed=True):
    events = v.research_events()
    return research.coverage_matrix(v.targets(), events, events.select("event_id", "tracking_variable", "review_status"), confirmed)


@query("J13 J14 A3", "v_matrix", "select * from v_matrix")
def coverage_matrix(v):
    return _matrix(v)


@query("A4", "v_matrix", f"select {_CELLS} from v_matrix")
def coverage_totals(v):
    return research.coverage_totals(_matrix(v))


@query(
    "A5 J28",
    "v_matrix",
    f"""with m as (select x.*, coalesce(industry_id, 'unknown') as ind, coalesce(pool_layer, 'unknown') as layer from v_matrix x join v_targets using (target_id))
    select 'industry_id' as dimension, ind as group_key, {_CELLS} from m group by ind
    union all select 'pool_layer', layer, {_CELLS} from m group by layer""",
)
def coverage_by_group(v):
    return research.coverage_by_group(_matrix(v), v.targets(), ["industry_id", "pool_layer"])


@query(
    "A5",
    "v_matrix",
    f"""with m as (select x.*, unnest(themes) as group_key from v_matrix x join v_targets using (target_id))
    select group_key, {_CELLS} from m group by group_key""",
)
def coverage_by_theme(v):
    return research.coverage_by_theme(_matrix(v), v.targets())


@query(
    "A6",
    "v_events v_targets",
    """select target_id, cast(10 as bigint) as expected_variables from v_targets
    where target_id not in (select user_id from v_events where review_status = 'accepted' and trade_date = date '2024-01-10')""",
)
def zero_covered_targets(v):
    """Targets none of whose variables were covered on one trading day."""
    day = v.research_events().where("event_date = date'2024-01-10'")
    links = day.select("event_id", "tracking_variable", "review_status")
    return research.zero_covered_targets(research.coverage_matrix(v.targets(), day, links))


@query(
    "U2",
    "v_matrix",
    """select distinct e.user_id as target_id, e.tracking_variable from v_events e
    where (e.user_id, e.tracking_variable) not in (select (target_id, tracking_variable) from v_matrix where covered)""",
)
def candidate_only_cells(v):
    return research.candidate_only_cells(_matrix(v), _matrix(v, confirmed=False))


@query(
    "J17 U3",
    "v_events",
    """select distinct user_id as target_id from v_events where user_id not in
    (select user_id from v_events where event_type = 'purchase' and trade_date = date '2024-01-10')""",
)
def missing_snapshots(v):
    e = v.events().withColumnRenamed("user_id", "target_id")
    seen = e.where("event_type = 'purchase' and trade_date = date'2024-01-10'").select("target_id").distinct()
    return research.missing_snapshots(e, seen, "target_id")


@query(
    "F39",
    "v_events",
    """with l as (select user_id, tracking_variable, trade_date, max(confidence) as mapping_confidence from v_events
      where tracking_variable in ('v1', 'v2', 'v3', 'v5', 'v8') group by all)
    select user_id as target_id, tracking_variable, cast(trade_date as varchar) as day, mapping_confidence, 'model' as mapping_method,
      case when mapping_confidence >= 0.65::double then 'accepted' else 'pending' end as review_status from l""",
)
def accepted_links(v):
    """Model labels of a (target, day), unknown variables dropped, one per variable."""
    labels = v.events().select(
        F.concat_ws("|", F.col("user_id").cast("string"), F.col("trade_date").cast("string")).alias("event_id"),
        F.col("user_id").alias("target_id"),
        F.col("trade_date").cast("string").alias("day"),
        "tracking_variable",
        F.col("confidence").alias("mapping_confidence"),
    )
    allowed = F.array(*[F.lit(x) for x in ("v1", "v2", "v3", "v5", "v8")])
    return research.accept_links(labels, allowed).drop("event_id")


_RULES = {"orders": ["eaux", "backlog"], "inventory": ["thand", "onen"], "capex": ["CAPEX", "the"], "buyback": ["leon"]}


def _rule_sql() -> str:
    parts = []
    for name, words in _RULES.items():
        hits = "list_filter([" + ", ".join(f"'{w.lower()}'" for w in words) + "], lambda w: contains(lower(text), w))"
        parts.append(
            f"select doc_id, '{name}' as tracking_variable, 'unclear' as direction, least(0.6::double, {r(f'0.3::double + 0.1::double * len({hits})', 1)}) as confidence,"
            f" array_to_string({hits}, ',') as evidence from documents where len({hits}) > 0"
        )
    return " union all ".join(parts)


@query("P26", "", _rule_sql())
def keyword_candidates(v):
    docs = v.table("documents").select("doc_id", "text")
    return research.keyword_candidates(docs, F.col("text"), _RULES).drop("text")


def _golden_sql() -> str:
    return """
    with g as (select 'g' || cast(item_id as varchar) as expected_event_id, (item_id * 7) % 150 as target_id,
         date '2024-01-01' + cast(item_id % 20 as int) as date_from, date '2024-01-05' + cast(item_id % 20 as int) as date_to,
         ['signup', 'error', 'click', 'View', 'purchase'][cast(item_id % 5 as int) + 1] as kw, item_id % 3 = 0 as no_kw,
         item_id % 4 = 0 as no_type, 'v' || cast(item_id % 10 as varchar) as var, item_id % 2 = 0 as no_var from benchmark),
    m as (select expected_event_id, event_id, row_number() over (partition by expected_event_id order by confidence desc, event_id) as rn
          from g join v_events e on e.user_id = g.target_id and e.trade_date between date_from and date_to
          where (no_kw or contains(translate(e.event_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), translate(kw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))) and (no_type or e.source_type in ('official', 'exchange')) and (no_var or e.tracking_variable = var))
    """


def _golden(v):
    b, key = v.table("benchmark"), F.col("item_id")
    none = F.array().cast("array<string>")
    word = cycle(key, ["signup", "error", "click", "View", "purchase"])
    return b.select(
        F.concat(F.lit("g"), key.cast("string")).alias("expected_event_id"),
        (key * 7 % 150).alias("target_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (key % 20).cast("int")).alias("date_from"),
        F.date_add(F.lit("2024-01-05").cast("date"), (key % 20).cast("int")).alias("date_to"),
        F.when(key % 3 != 0, F.array(word)).otherwise(none).alias("keywords"),
        F.when(key % 4 != 0, F.array(F.lit("official"), F.lit("exchange"))).otherwise(none).alias("source_types"),
        F.when(key % 2 != 0, F.array(F.concat(F.lit("v"), (key % 10).cast("string")))).otherwise(none).alias("expected_variables"),
    )


def _golden_matches(v):
    events = v.research_events().withColumn("summary", F.col("event_type"))
    return research.golden_matches(_golden(v), events, events.select("event_id", "tracking_variable"))


@query(
    "J15 J16",
    "v_events",
    _golden_sql() + "select g.expected_event_id, m.event_id as matched_event_id, m.event_id is not null as matched from g left join m on g.expected_event_id = m.expected_event_id and rn = 1",
)
def golden_matches(v):
    return _golden_matches(v).select("expected_event_id", "matched_event_id", "matched")


@query(
    "A30",
    "v_events",
    _golden_sql()
    + f"""select count(*) as expected_count, count(event_id) as matched_count, {r("count(event_id) / cast(count(*) as double)", 4)} as recall
    from g left join m on g.expected_event_id = m.expected_event_id and rn = 1""",
)
def golden_recall(v):
    return research.golden_recall(_golden_matches(v))


_CARD_SQL = f"""
with e as (select * from v_events where trade_date >= date '2024-01-10'),
cov as (select user_id, string_agg(distinct tracking_variable, ',' order by tracking_variable) as covered, count(distinct tracking_variable) as n
        from e where review_status = 'accepted' group by 1),
ev as (select user_id, count(*) filter (where direction = 'positive') as pos, count(*) filter (where direction = 'negative') as neg,
       max_by(event_id, (confidence, ts, event_id)) as top from e group by 1),
gp as (select user_id, count(*) as gaps, count(*) filter (where event_type = 'error') as high from v_events where confidence < 0.1::double and event_type in ('error', 'view') group by 1),
hk as (select user_id, max_by(k % 5 <> 0, event_id) as ok from (select * from v_events where event_type = 'purchase') group by 1),
c as (select t.target_id, coalesce(covered, '') as covered_variables, 10 - coalesce(n, 0) as missing_variables, {r("coalesce(n, 0) / 10.0::double", 4)} as coverage_ratio,
      coalesce(pos, 0) as positive_events, coalesce(neg, 0) as negative_events, coalesce(gaps, 0) as open_gaps, top as top_event_id,
      case when not coalesce(ok, true) then 'hk_not_connect_eligible_verify_before_inclusion'
           when coalesce(n, 0) / 10.0::double < 0.2::double then 'keep_watch_or_reduce_budget_until_coverage_improves'
           when coalesce(neg, 0) >= 3 then 'review_for_downgrade_or_risk_watch' when coalesce(high, 0) >= 3 then 'needs_followup_before_upgrade'
           else 'keep_current_layer' end as pool_layer_suggestion
      from v_targets t left join cov on cov.user_id = t.target_id left join ev on ev.user_id = t.target_id
      left join gp on gp.user_id = t.target_id left join hk on hk.user_id = t.target_id)
"""


def _cards(v):
    e = v.research_events()
    gaps = v.events().where((F.col("confidence") < 0.1) & F.col("event_type").isin("error", "view")).select(
        F.col("user_id").alias("target_id"), F.lit("open").alias("status"), F.when(F.col("event_type") == "error", "high").otherwise("medium").alias("priority")
    )
    hk = v.events().where("event_type = 'purchase'").select(
        F.col("user_id").alias("target_id"), F.col("event_id").alias("as_of"), (F.col("k") % 5 != 0).alias("hk_connect_eligible")
    )
    return research.research_cards(v.targets(), e, e.select("event_id", "tracking_variable", "review_status"), gaps, hk, "2024-01-10")


@query("A31 K3", "v_events v_targets", _CARD_SQL + "select * from c")
def research_cards(v):
    return _cards(v).select(
        "target_id",
        F.array_join("covered_variables", ",").alias("covered_variables"),
        F.size("missing_variables").cast("long").alias("missing_variables"),
        "coverage_ratio", "positive_events", "negative_events", "open_gaps", "top_event_id", "pool_layer_suggestion",
    )


@query(
    "A32",
    "v_events v_targets",
    _CARD_SQL
    + """select count(*) as cards_total, count(*) filter (where target_id % 3 <> 0) as fresh_cards, count(*) filter (where target_id % 3 = 0) as stale_cards,
    count(*) filter (where coverage_ratio < 0.3::double) as low_coverage_cards from c""",
)
def card_summary(v):
    dated = _cards(v).withColumn("as_of", F.when(F.col("target_id") % 3 == 0, "2024-01-01").otherwise("2024-01-30"))
    return research.card_summary(dated, F.lit("2024-01-30"))


@query(
    "A28",
    "v_matrix",
    f"""with t as (select target_id, count(*) filter (where covered) / 10.0::double as cov, count(*) filter (where covered and has_authoritative_source) / 10.0::double as auth
       from v_matrix group by 1)
    select target_id, {r('''(cov * 0.35::double + auth * 0.20::double + case when target_id % 3 = 0 then 0.0::double else 0.5::double * 0.15::double end + 0.10::double)
       / (0.35::double + 0.20::double + case when target_id % 3 = 0 then 0.0::double else 0.15::double end + 0.10::double)''', 4)} as health from t""",
)
def research_health(v):
    """Health per target; the parts without data do not count."""
    per = _matrix(v).groupBy("target_id").agg(
        (F.count_if("covered") / F.count("*")).alias("cov"),
        (F.count_if(F.col("covered") & F.col("has_authoritative_source")) / F.count("*")).alias("auth"),
    )
    none = F.lit(None).cast("double")
    parts = {
        "coverage": F.col("cov"), "authority": F.col("auth"), "hk": F.when(F.col("target_id") % 3 != 0, 0.5),
        "market": none, "cards": none, "quality": F.lit(1.0),
    }
    return per.select("target_id", research.weighted_health(parts).alias("health"))


@query(
    "A26",
    "v_events v_targets",
    """with r as (select user_id, count(*) as events, bool_and(k % 2 = 0) as nourl, bool_or(confidence >= 0.75::double and k % 7 = 0) as undated,
        bool_and(source_type in ('media', 'social')) as weak, count(distinct tracking_variable) as n from v_events where trade_date = date '2024-01-10' group by 1),
    j as (select t.target_id as run_id, coalesce(events, 0) as events, coalesce(nourl, false) as events_missing_source_url, coalesce(undated, false) as high_confidence_missing_published_at,
        coalesce(weak, false) as low_authority_sources_only, events is null and t.target_id % 2 = 0 as high_priority_zero_events,
        events is not null and n = 0 as zero_tracking_variable_coverage, events is not null and n > 0 and (10 - n) / 10.0::double >= 0.7::double as low_tracking_variable_coverage
        from v_targets t left join r on r.user_id = t.target_id)
    select *, case when events_missing_source_url or high_confidence_missing_published_at or low_authority_sources_only or high_priority_zero_events or zero_tracking_variable_coverage
      then 'accept_degraded' else 'accept' end as decision,
      case when events_missing_source_url or high_confidence_missing_published_at or low_authority_sources_only or high_priority_zero_events or zero_tracking_variable_coverage
      then 'P2' else 'P3' end as severity from j""",
)
def research_run_quality(v):
    events = v.events().where("trade_date = date'2024-01-10'").select(
        F.col("user_id").alias("run_id"),
        F.when(F.col("k") % 2 != 0, "http://x").alias("source_url"),
        "confidence",
        F.when(F.col("k") % 7 != 0, F.col("ts")).alias("published_at"),
        "source_type",
        "tracking_variable",
    )
    targets = v.targets().select(
        F.col("target_id").alias("run_id"), "tracking_variables", F.when(F.col("target_id") % 2 == 0, "high").otherwise("normal").alias("priority")
    )
    return research.run_quality(events, targets)


# --- demands and targets -------------------------------------------------------------------


@query(
    "P31",
    "v_demands",
    """with e as (select demand_id, concat_ws('|', case when status = 'bogus' then 'invalid_status' end, case when active_from > active_to then 'invalid_date_range' end,
       case when demand_id % 8 = 0 and demand_id % 16 = 0 then 'test_mode_cannot_notify_owner' end) as errors from v_demands)
    select errors, count(*) as n, min(demand_id) as first_id from e group by errors""",
)
def demand_rejections(v):
    rows = v.demands().select(
        F.lit("demand.v1").alias("schema_version"), "demand_id", F.lit("daily_collection").alias("demand_type"), F.lit("request").alias("source_type"),
        "status", "active_from", "active_to", (F.col("demand_id") % 8 == 0).alias("test_mode"), (F.col("demand_id") % 16 == 0).alias("notify_owner"),
    )
    checked = rows.withColumn("errors", F.array_join(demands.demand_errors(), "|"))
    return checked.groupBy("errors").agg(F.count("*").alias("n"), F.min("demand_id").alias("first_id"))


@query(
    "S14",
    "v_demands",
    """with n as (select owner_id, demand_id, status, row_number() over (partition by owner_id order by demand_id) as version,
         lag(status) over (partition by owner_id order by demand_id) as prev from v_demands)
    select owner_id, demand_id, version, status from n""",
)
def demand_versions(v):
    rows = v.demands().select("owner_id", "demand_id", "status")
    return demands.versions(rows, "owner_id", "demand_id", F.floor(F.col("demand_id") / 4096))


@query(
    "S14 S13",
    "v_demands",
    """select owner_id, max(demand_id) as demand_id, count(*) as version, max_by(status, demand_id) as status from v_demands group by 1""",
)
def latest_demands(v):
    rows = v.demands().select("owner_id", "demand_id", "status")
    numbered = demands.versions(rows, "owner_id", "demand_id", F.floor(F.col("demand_id") / 4096))
    return demands.latest_versions(numbered, "owner_id")


@query(
    "S14",
    "v_demands",
    """with a as (select status, ['suspend', 'resume', 'cancel'][cast(demand_id % 3 as int) + 1] as action from v_demands)
    select status, action, case when action = 'suspend' and status = 'active' then 'suspended' when action = 'resume' and status = 'suspended' then 'active'
      when action = 'cancel' and status in ('draft', 'active', 'suspended') then 'cancelled' end as new_status, count(*) as n from a group by all""",
)
def lifecycle_actions(v):
    action = cycle(F.col("demand_id"), ["suspend", "resume", "cancel"])
    rows = v.demands().select("status", action.alias("action"))
    return rows.groupBy("status", "action", demands.lifecycle(F.col("status"), F.col("action")).alias("new_status")).agg(F.count("*").alias("n"))


@query(
    "P18",
    "v_demands",
    """select demand_id, cast(active_from as varchar) as active_from from v_demands where status = 'active'
    and (active_from is null or active_from <= date '1997-06-15') and (active_to is null or active_to >= date '1997-06-15')""",
)
def demands_active_on(v):
    day = F.lit("1997-06-15").cast("date")
    found = v.demands().where((F.col("status") == "active") & times.active_on(day, F.col("active_from"), F.col("active_to")))
    return found.select("demand_id", F.col("active_from").cast("string").alias("active_from"))


_MEMBERSHIPS = """i as (
      select l_orderkey * 10 + l_linenumber as constituent_id, 'IDX' || (l_suppkey % 100) as index_code, cast(l_shipdate as date) as effective_date,
        case when l_orderkey % 50 <> 0 then cast(l_shipdate as date) + cast(l_quantity as int) end as end_date from lineitem),
    d as (select demand_id, 'IDX' || (owner_id % 100) as index_code, active_from, active_to from v_demands)"""


def _constituents(v):
    """Line items as index constituents with validity intervals, some of them open."""
    shipped = F.to_date("l_shipdate")
    return v.table("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("constituent_id"),
        F.concat(F.lit("IDX"), (F.col("l_suppkey") % 100).cast("string")).alias("index_code"),
        shipped.alias("effective_date"),
        F.when(F.col("l_orderkey") % 50 != 0, F.date_add(shipped, F.col("l_quantity").cast("int"))).alias("end_date"),
    )


def _indexed_demands(v):
    return v.demands().select("demand_id", F.concat(F.lit("IDX"), (F.col("owner_id") % 100).cast("string")).alias("index_code"), "active_from", "active_to")


@query(
    "J32",
    "v_demands",
    f"""with {_MEMBERSHIPS}
    select demand_id, constituent_id, cast(greatest(active_from, effective_date) as varchar) as overlap_from, cast(least(active_to, end_date) as varchar) as overlap_to
    from d join i using (index_code)
    where coalesce(end_date, date '9999-12-31') >= active_from and effective_date <= coalesce(active_to, date '9999-12-31')
      and active_from <= coalesce(active_to, date '9999-12-31') and effective_date <= coalesce(end_date, date '9999-12-31')""",
)
def constituents_during_demands(v):
    """Index constituents that are valid on some day of a demand's interval."""
    met = intervals.overlap_join(_indexed_demands(v), _constituents(v), ["index_code"], ("active_from", "active_to"), ("effective_date", "end_date"), text=True)
    return met.select("demand_id", "constituent_id", "overlap_from", "overlap_to")


@query(
    "J32 P18",
    "v_demands",
    f"""with {_MEMBERSHIPS}
    select demand_id, count(constituent_id) as constituents from d left join i on d.index_code = i.index_code
      and active_from between effective_date and coalesce(end_date, date '9999-12-31') group by 1""",
)
def constituents_at_start(v):
    """How many constituents are valid on the day on which each demand begins."""
    counted = intervals.counted_on(_indexed_demands(v), _constituents(v), ["index_code"], "active_from", ("effective_date", "end_date"), "constituents")
    return counted.groupBy("demand_id").agg(F.sum("constituents").alias("constituents"))


_DERIVED = """with own as (select owner_id, demand_id, unnest([owner_id, demand_id % 100]) as target_id, case when demand_id % 3 = 0 then demand_id + 1 end as src from v_demands)
    select distinct demand_id, target_id from own union
    select a.demand_id, b.target_id from own a join own b on a.src = b.demand_id"""


@query("J20 U5", "v_demands", _DERIVED)
def derived_targets(v):
    key = F.col("demand_id")
    rows = v.demands().select(
        "demand_id",
        F.array(F.col("owner_id"), key % 100).alias("targets"),
        F.when(key % 3 == 0, F.array(key + 1)).otherwise(F.array().cast("array<bigint>")).alias("derived_from"),
    )
    return demands.derived_targets(rows)


@query(
    "J21 P16",
    "v_members",
    """with d as (select n_nationkey as demand_id, n_nationkey % 3 as kind, ['current_holding', 'trading_candidate', 'watchlist', 'base_pool'][cast(n_nationkey % 4 as int) + 1] as layer from nation)
    select demand_id, 'T' || cast(demand_id as varchar) as ticker, 'explicit' as origin from d where kind = 0
    union all select demand_id, 'I' || cast(demand_id as varchar), 'include_list' from d where kind = 1
    union all select demand_id, ticker, 'pool' from d join v_members m on m.pool_layer = d.layer where kind = 2 and m.status = 'active' and sellability = 'sellable' and not is_st""",
)
def resolved_targets(v):
    key = F.col("n_nationkey")
    none = F.array().cast("array<string>")
    layer = cycle(key, ["current_holding", "trading_candidate", "watchlist", "base_pool"])
    rows = v.table("nation").select(
        key.alias("demand_id"),
        F.when(key % 3 == 0, F.array(F.concat(F.lit("T"), key.cast("string")))).otherwise(none).alias("targets"),
        F.when(key % 3 == 1, F.array(F.concat(F.lit("I"), key.cast("string")))).otherwise(none).alias("include_tickers"),
        F.array(layer).alias("pool_layers"),
        F.lit("sellable").alias("sellability"),
        F.lit(True).alias("exclude_st"),
        F.lit(False).alias("exclude_suspended"),
    )
    return demands.resolve_targets(rows, v.members())


_LAYERS = ["current_holding", "trading_candidate", "watchlist", "base_pool"]
_SCOPED = f"""d as (select demand_id, demand_id % 3 as kind, list_distinct([{cycle_sql("demand_id", _LAYERS)}, {cycle_sql("(demand_id // 4)", _LAYERS)}]) as layers,
      case when demand_id % 5 < 3 then 'sellable' end as wanted, demand_id % 2 = 0 as no_st, demand_id % 7 = 0 as no_suspended from v_demands)"""


def _scoped_demands(v):
    key = F.col("demand_id")
    none = F.array().cast("array<string>")
    return v.demands().select(
        "demand_id",
        F.when(key % 3 == 0, F.array(F.lit("T1"), F.concat(F.lit("T"), key.cast("string")))).otherwise(none).alias("targets"),
        F.when(key % 3 == 1, F.array(F.concat(F.lit("I"), key.cast("string")))).otherwise(none).alias("include_tickers"),
        F.array(cycle(key, _LAYERS), cycle(F.floor(key / 4), _LAYERS)).alias("pool_layers"),
        F.when(key % 5 < 3, "sellable").alias("sellability"),
        (key % 2 == 0).alias("exclude_st"),
        (key % 7 == 0).alias("exclude_suspended"),
    )


@query(
    "J21 P16",
    "v_demands v_members",
    f"""with {_SCOPED} select demand_id, case kind when 0 then 'explicit' when 1 then 'include_list' else 'pool' end as origin,
      case kind when 0 then 2 when 1 then 1 else (select count(*) from v_members m where list_contains(d.layers, m.pool_layer) and status = 'active'
        and (wanted is null or wanted = sellability) and not (no_st and is_st) and not (no_suspended and is_suspended)) end as targets from d""",
)
def target_counts(v):
    """How many targets every demand resolves to, from bitmaps of the members of each filter."""
    return demands.target_counts(demands.target_classes(_scoped_demands(v)), v.members())


@query(
    "J21 P16",
    "v_demands v_members",
    f"""with {_SCOPED}, f as (select distinct layers, wanted, no_st, no_suspended from (select * replace (list_sort(layers) as layers) from d) where kind = 2)
    select array_to_string(layers, '|') as pool_layers, wanted as sellability, no_st as exclude_st, no_suspended as exclude_suspended, ticker from f join v_members m on list_contains(f.layers, m.pool_layer)
      and status = 'active' and (wanted is null or wanted = sellability) and not (no_st and is_st) and not (no_suspended and is_suspended)""",
)
def filter_class_members(v):
    """Members of every filter that some demand has."""
    classed = demands.target_classes(_scoped_demands(v))
    filters = classed.where("class_id is not null").select("class_id", F.array_join("pool_layers", "|").alias("pool_layers"), "sellability", "exclude_st", "exclude_suspended").distinct()
    return demands.class_members(classed, v.members()).join(filters, "class_id").drop("class_id")


@query(
    "P16 P29",
    "v_members",
    """select member_id, pool_layer, case when pool_layer = 'current_holding' and sellability = 'sellable' then 10 when pool_layer = 'current_holding' then 30
      when pool_layer = 'trading_candidate' then 10 when pool_layer = 'watchlist' then 60 else 10 end as snapshot_minutes,
      case when pool_layer = 'current_holding' and sellability = 'sellable' then 60 else 120 end as black_swan_minutes,
      sellability = 'sellable' or pool_layer in ('current_holding', 'trading_candidate') as eligible
    from v_members where status = 'active' and not is_st and not is_suspended""",
)
def pool_cadence(v):
    layer, sell = F.col("pool_layer"), F.col("sellability")
    return demands.filter_pool(v.members(), exclude_st=True, exclude_suspended=True).select(
        "member_id",
        "pool_layer",
        demands.snapshot_minutes(layer, sell).alias("snapshot_minutes"),
        demands.black_swan_minutes(layer, sell).alias("black_swan_minutes"),
        demands.snapshot_eligible(layer, sell).alias("eligible"),
    )


_WORK_SQL = """
with t as (select 'd1' as demand_id, cast(member_id as varchar) as target_id, ticker, pool_layer, sellability, member_id,
      ['intraday_monitoring', 'daily_collection', 'candidate_full_snapshot', 'market_context_daily', 'black_swan_scan'][cast(member_id % 5 as int) + 1] as kind,
      ['intraday', 'post_market', 'non_trading_day'][cast(member_id % 3 as int) + 1] as phase, timestamp '2024-03-05 10:47:00' as as_of from v_members),
w as (select t.*, 'intraday_snapshot_10m' as task_type, case when pool_layer = 'current_holding' and sellability = 'sellable' then 10 when pool_layer = 'current_holding' then 30
        when pool_layer = 'watchlist' then 60 else 10 end as m from t where kind = 'intraday_monitoring' and phase = 'intraday' and (sellability = 'sellable' or pool_layer in ('current_holding', 'trading_candidate'))
      union all select t.*, 'black_swan_scan', case when pool_layer = 'current_holding' and sellability = 'sellable' then 60 else 120 end from t where kind = 'intraday_monitoring' and phase <> 'non_trading_day'
      union all select t.*, 'black_swan_scan', null from t where kind = 'black_swan_scan' and member_id % 7 <> 0
      union all select t.*, 'candidate_full_stock_snapshot', null from t where kind = 'candidate_full_snapshot'
      union all select t.*, 'deep_collect', null from t where kind = 'candidate_full_snapshot' or (kind = 'daily_collection' and member_id % 7 <> 0)
      union all select t.*, 'market_context_snapshot', null from t where kind = 'market_context_daily'
      union all select t.*, 'post_close_stock_refresh', null from t where kind = 'daily_collection' and phase = 'post_market'),
k as (select *, case when m is not null then strftime(date_trunc('day', as_of) + to_minutes((hour(as_of) * 60 + minute(as_of)) // m * m), '%Y-%m-%dT%H:%M:%S') || '+08:00' end as bucket_start from w),
g as (select *, 'collection_task:' || demand_id || ':' || task_type || ':' || target_id || ':' || coalesce(bucket_start, '2024-03-05') as task_key from k)
"""


def _work_targets(v):
    key = F.col("member_id")
    kinds = ["intraday_monitoring", "daily_collection", "candidate_full_snapshot", "market_context_daily", "black_swan_scan"]
    return v.members().select(
        F.lit("d1").alias("demand_id"),
        cycle(key, kinds).alias("demand_type"),
        key.cast("string").alias("target_id"),
        "ticker", "pool_layer", "sellability",
        cycle(key, ["intraday", "post_market", "non_trading_day"]).alias("market_phase"),
        F.lit("2024-03-05 10:47:00").cast("timestamp").alias("as_of"),
        (key % 7 != 0).alias("collect_text"),
        F.lit(True).alias("collect_stock"),
        F.lit(True).alias("collect_hk_connect"),
    )


@query("J33 F7 F35", "v_members", _WORK_SQL + "select target_id, task_type, bucket_start, task_key from g")
def expected_work(v):
    return demands.expected_work(_work_targets(v)).select("target_id", "task_type", "bucket_start", "task_key")


@query("J33", "v_members", _WORK_SQL + "select task_type, count(*) as missing from g where not (task_type = 'deep_collect' and pool_layer = 'watchlist') group by 1")
def missing_work(v):
    expected = demands.expected_work(_work_targets(v))
    done = expected.where("task_type = 'deep_collect' and pool_layer = 'watchlist'")
    return demands.missing_work(expected, done).groupBy("task_type").agg(F.count("*").alias("missing"))


@query(
    "J34",
    "v_members",
    """select case when member_id % 7 = 0 then 'ticker_' || ticker else 'company_' || cast(member_id as varchar) end as target_id from v_members
    where member_id % 5 <> 0 and member_id % 7 <> 0 and member_id not in (select s_suppkey from supplier)""",
)
def unregistered_targets(v):
    key = F.col("member_id")
    named = F.when(key % 7 == 0, F.concat(F.lit("ticker_"), F.col("ticker"))).otherwise(F.concat(F.lit("company_"), key.cast("string")))
    targets = v.members().select(named.alias("target_id"), (key % 5 != 0).alias("collect_text"))
    profiles = v.table("supplier").select(F.concat(F.lit("company_"), F.col("s_suppkey").cast("string")).alias("target_id"))
    return demands.unregistered(targets, profiles).select("target_id")


@query(
    "J36 S13",
    "v_members",
    """select coalesce(n.member_id, o.member_id) as member_id, case when n.member_id is not null then 'new' else o.pool_layer end as pool_layer,
      case when o.member_id is null then 'added' when n.member_id is not null then 'updated' else 'kept' end as change
    from (select * from v_members where pool_layer <> 'base_pool') o full join (select * from v_members where sellability = 'sellable') n on n.member_id = o.member_id""",
)
def merged_targets(v):
    m = v.members()
    existing = m.where("pool_layer <> 'base_pool'").select("member_id", "pool_layer")
    incoming = m.where("sellability = 'sellable'").select("member_id", F.lit("new").alias("pool_layer"))
    return demands.merge_targets(existing, incoming, ["member_id"])


@query("J36", "v_members", "select member_id, pool_layer from v_members where member_id not in (select s_suppkey from supplier)")
def removed_targets(v):
    gone = v.table("supplier").select(F.col("s_suppkey").alias("member_id"))
    return demands.remove_targets(v.members().select("member_id", "pool_layer"), gone, "member_id")


@query(
    "U5",
    "v_members",
    "select coalesce(case when member_id % 2 = 0 then pool_layer end, ticker) as target_key, max(member_id) as member_id from v_members group by 1",
)
def deduped_targets(v):
    m = v.members().select("member_id", F.when(F.col("member_id") % 2 == 0, F.col("pool_layer")).alias("target_id"), "ticker", "company_name")
    return demands.dedupe_targets(m, "member_id").select("target_key", "member_id")


_BUS = """
with tickets as (select 't' || cast(demand_id as varchar) as ticket_id, status as ds, case when demand_id % 6 = 0 then 'done' when demand_id % 6 in (1, 2) then 'open' else 'in_progress' end as status,
     owner_id, demand_id, active_from, cadence, priority from v_demands),
messages as (select 'm' || cast(demand_id as varchar) as message_id, 't' || cast(demand_id as varchar) as ticket_id, case when demand_id % 5 = 0 then 'dead' else 'open' end as status,
     demand_id, cadence, active_from, active_to, cast(substr(priority, 1, 1) as int) as priority from v_demands where v_demands.priority <> '5-LOW')
"""


def _bus(v):
    d = v.demands()
    key = F.col("demand_id")
    name = F.concat(F.lit("t"), key.cast("string"))
    state = F.when(key % 6 == 0, "done").when((key % 6).isin(1, 2), "open").otherwise("in_progress")
    payload = F.to_json(F.struct(F.col("owner_id").cast("string").alias("demand_id")))
    tickets = d.select(name.alias("ticket_id"), state.alias("status"), "cadence", payload.alias("payload"), "demand_id", "active_from")
    carried = F.to_json(F.struct(name.alias("ticket_id")))
    messages = d.where("priority <> '5-LOW'").select(
        F.concat(F.lit("m"), key.cast("string")).alias("message_id"),
        carried.alias("payload"),
        F.when(key % 5 == 0, "dead").otherwise("open").alias("status"),
        "cadence",
        F.col("active_from").alias("created_at"),
        F.col("active_from").alias("available_at"),
        F.col("active_to").alias("expires_at"),
        F.substring("priority", 1, 1).cast("int").alias("priority"),
    )
    return tickets, messages


@query("J30", "v_demands", _BUS + "select message_id, ticket_id from messages join tickets using (ticket_id) where messages.status = 'open' and tickets.status = 'done'")
def completed_but_open(v):
    tickets, messages = _bus(v)
    return demands.completed_but_open(messages, tickets).select("message_id", "ticket_id")


@query("J30", "v_demands", _BUS + "select ticket_id from tickets where status in ('open', 'in_progress') and ticket_id not in (select ticket_id from messages)")
def orphan_tickets(v):
    tickets, messages = _bus(v)
    return demands.orphan_tickets(tickets, messages).select("ticket_id")


@query(
    "J37",
    "v_demands",
    _BUS + "select message_id, ticket_id from messages join tickets using (ticket_id) where messages.status = 'open' and tickets.status in ('open', 'in_progress') and owner_id in (select c_custkey from customer where c_mktsegment = 'BUILDING')",
)
def cancelled_messages(v):
    tickets, messages = _bus(v)
    cancelled = v.table("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").cast("string").alias("demand_id"))
    return demands.cancel_cascade(tickets, messages, cancelled)[1]


@query(
    "K8",
    "v_demands",
    _BUS
    + """select cadence, priority, message_id from (select *, row_number() over (partition by cadence order by priority desc, active_from, message_id) as rn from messages
    where status = 'open' and active_from <= date '1999-01-01' and (active_to is null or active_to > date '1999-01-01')) where rn = 1""",
)
def backlog_heads(v):
    _, messages = _bus(v)
    return demands.backlog_head(messages, "cadence", F.lit("1999-01-01").cast("date"))


@query("J31", "v_demands", "select demand_id, cast(active_from as varchar) as created from v_demands where owner_id = 77")
def ticket_chain(v):
    found = v.demands().where(F.col("owner_id") == 77).select("demand_id", F.col("active_from").cast("string").alias("created"))
    return found.orderBy("created", "demand_id")


@query("A11 A39", "v_demands", "select cadence, status, count(*) as n from v_demands group by 1, 2")
def queue_depth(v):
    return v.demands().groupBy("cadence", "status").agg(F.count("*").alias("n"))


@query(
    "A8",
    "v_demands",
    """with t as (select owner_id, count(*) as p, count(*) filter (where status = 'active') as d, count(*) filter (where status = 'bogus') as f,
       count(*) filter (where status in ('draft', 'suspended')) as o from v_demands group by 1)
    select c_custkey as demand_id, coalesce(p, 0) as tasks_planned, coalesce(d, 0) as tasks_done, coalesce(f, 0) as tasks_failed, coalesce(o, 0) as tasks_open
    from customer left join t on owner_id = c_custkey""",
)
def demand_task_coverage(v):
    states = {"active": "done", "bogus": "failed", "draft": "open", "suspended": "in_progress"}
    tasks = v.demands().select(F.col("owner_id").alias("demand_id"), lookup(F.col("status"), states, F.lit("other")).alias("status"))
    return readers.demand_coverage(v.table("customer").select(F.col("c_custkey").alias("demand_id")), tasks)


# --- reports and readers -------------------------------------------------------------------


@query(
    "A9",
    "",
    """select event_type as tool_name, event_id % 3 as op, count(*) as calls, cast(sum(cast(regexp_extract(props, '"k": *([0-9]+)', 1) as bigint)) as bigint) as queries_executed,
     cast(0 as bigint) as model_calls from events group by 1, 2""",
)
def cost_usage(v):
    runs = v.table("events").select(F.col("event_type").alias("tool_name"), (F.col("event_id") % 3).alias("op"), F.col("props").alias("quality"))
    return readers.cost_usage(runs, {"queries_executed": "$.k", "model_calls": "$.model_calls"}, ["tool_name", "op"])


@query(
    "A10",
    "v_events",
    """select 'event_type' as dimension, event_type as group_key, count(*) as rows from v_events group by 2
    union all select 'source_type', source_type, count(*) from v_events group by 2 union all select 'provider', provider, count(*) from v_events group by 2
    union all select 'review_status', review_status, count(*) from v_events group by 2""",
)
def dashboard_counts(v):
    names = ["event_type", "source_type", "provider", "review_status"]
    return readers.counts_by(v.events(), {n: F.col(n) for n in names})


@query(
    "A10",
    "v_events",
    """select tracking_variable, count(*) as links from v_events where review_status = 'accepted' group by 1 order by links desc, tracking_variable limit 10""",
)
def top_variables(v):
    counted = v.events().where("review_status = 'accepted'").groupBy("tracking_variable").agg(F.count("*").alias("links"))
    return counted.orderBy(F.desc("links"), "tracking_variable").limit(10)


@query(
    "A7 F8",
    "v_events",
    """with d as (select * from v_events where ts >= timestamp '2024-01-09 16:00:00' and ts < timestamp '2024-01-10 16:00:00')
    select 'events_by_type' as section, event_type as group_key, count(*) as rows from d group by 2
    union all select 'events_by_source', source_type, count(*) from d group by 2
    union all select 'runs_by_tool_status', provider || '|' || case when k % 2 = 0 then 'success' else 'failed' end, count(*) from d group by 2
    union all select 'features_by_window', '10m', count(*) from d where k % 2 = 0 having count(*) > 0
    union all select 'links_by_status', review_status, count(*) from d group by 2
    union all select 'issues_by_severity', 'P' || cast(k % 4 as varchar), count(*) from d where event_type = 'error' group by 2
    union all select 'gaps_by_priority', case when k % 3 = 0 then 'high' else 'unknown' end, count(*) from d where event_type = 'error' group by 2
    union all select 'messages_by_topic_status', event_type || '|' || case when k % 10 = 0 then 'dead' else 'open' end, count(*) from d group by 2""",
)
def daily_report(v):
    """Counts of the local day 2024-01-10 by section."""
    e = v.events().withColumnRenamed("ts", "created_at")
    k = F.col("k")
    errors = e.where("event_type = 'error'")
    sections = {
        "events_by_type": (e, F.col("event_type")),
        "events_by_source": (e, F.col("source_type")),
        "runs_by_tool_status": (e, F.concat_ws("|", "provider", F.when(k % 2 == 0, "success").otherwise("failed"))),
        "features_by_window": (e.where("k % 2 = 0"), F.lit("10m")),
        "links_by_status": (e, F.col("review_status")),
        "issues_by_severity": (errors, F.concat(F.lit("P"), (k % 4).cast("string"))),
        "gaps_by_priority": (errors, F.when(k % 3 == 0, "high")),
        "messages_by_topic_status": (e, F.concat_ws("|", "event_type", F.when(k % 10 == 0, "dead").otherwise("open"))),
    }
    return readers.daily_report(sections, "2024-01-09 16:00:00", "2024-01-10 16:00:00")


@query("K1", "v_events", "select event_id, user_id as target_id, event_type, confidence from v_events order by confidence desc, ts desc, event_id desc limit 10")
def top_events(v):
    return readers.top_events(v.research_events()).select("event_id", "target_id", "event_type", "confidence")


@query(
    "P12 P13",
    "v_events",
    """select event_id, user_id as target_id, event_type, confidence, cast(trade_date as varchar) as event_date from v_events
    where event_type in ('click', 'purchase') and confidence >= 0.9::double and trade_date >= date '2024-01-15'""",
)
def recent_events(v):
    found = readers.recent_events(v.research_events(), event_types=["click", "purchase"], min_confidence=0.9, since="2024-01-15")
    return found.select("event_id", "target_id", "event_type", "confidence", F.col("event_date").cast("string").alias("event_date"))


@query(
    "K3 P15",
    "v_demands",
    """select demand_id, priority, case priority when '1-URGENT' then 0 when '2-HIGH' then 1 when '3-MEDIUM' then 2 else 3 end as rank from v_demands
    where status = 'active' order by rank, active_from desc, demand_id desc limit 50""",
)
def open_issues(v):
    found = v.demands().where("status = 'active'")
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
    return readers.open_by_priority(found, "priority", levels, "active_from", "demand_id", 50).select("demand_id", "priority", "rank")


@query("P14", "", "select doc_id, lang from documents where contains(text, 'thand') or contains(text, 'eaux')")
def matching_facts(v):
    return readers.matching_text(v.table("documents"), "text", "thand  eaux").select("doc_id", "lang")


@query(
    "P13 P14",
    "",
    """select doc_id as fact_id, lang as fact_type, (doc_id % 10) / 10.0::double as confidence from documents
    where source = 'src1' and lang in ('en', 'de') and date '2024-01-01' + cast(doc_id % 30 as int) >= date '2024-01-11'
      and (contains(text, 'thand') or contains(text, 'eaux'))""",
)
def facts_of_target(v):
    facts = v.table("documents").select(
        F.col("doc_id").alias("fact_id"),
        F.col("source").alias("target_id"),
        F.col("lang").alias("fact_type"),
        F.col("text").alias("fact_statement"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).alias("created_at"),
        ((F.col("doc_id") % 10) / 10).alias("confidence"),
    )
    found = readers.target_facts(facts, "src1", "thand eaux", ["en", "de"], "2024-01-11")
    return found.select("fact_id", "fact_type", "confidence")


@query(
    "P13",
    "v_events",
    """select event_id as metric_id, event_type as metric_name, value as metric_value from v_events
    where user_id = 7 and event_type in ('click', 'purchase') and ts >= timestamp '2024-01-05 00:00:00'""",
)
def metrics_of_target(v):
    metrics = v.events().select(
        F.col("event_id").alias("metric_id"), F.col("user_id").alias("target_id"), F.col("event_type").alias("metric_name"), F.col("value").alias("metric_value"),
        F.col("ts").alias("created_at"),
    )
    return readers.target_metrics(metrics, 7, ["click", "purchase"], "2024-01-05").select("metric_id", "metric_name", "metric_value")


@query(
    "P13",
    "v_events",
    """select event_id as risk_id, direction as severity, confidence from v_events
    where user_id = 7 and direction in ('negative') and ts >= timestamp '2024-01-05 00:00:00'""",
)
def risks_of_target(v):
    risks = v.research_events().withColumn("severity", F.col("direction"))
    found = readers.target_risks(risks, 7, "2024-01-05", ["negative"])
    return found.select(F.col("event_id").alias("risk_id"), "severity", "confidence")


@query(
    "P13",
    "v_demands",
    """select demand_id as catalyst_id, cast(active_to as varchar) as expected_date from v_demands
    where owner_id = 19 and active_to between date '1996-01-01' and date '1999-12-31'""",
)
def catalysts_of_target(v):
    catalysts = v.demands().withColumnsRenamed({"demand_id": "catalyst_id", "owner_id": "target_id", "active_to": "expected_date"})
    found = readers.target_catalysts(catalysts, 19, "1996-01-01", "1999-12-31")
    return found.select("catalyst_id", F.col("expected_date").cast("string").alias("expected_date"))


@query("P13", "v_demands", "select demand_id as question_id, priority, status from v_demands where owner_id = 19 and status = 'active'")
def questions_of_target(v):
    found = readers.target_work(_work_rows(v), 19, status="active")
    return found.select(F.col("demand_id").alias("question_id"), "priority", "status")


@query("P13", "v_demands", "select demand_id as gap_id, priority, status from v_demands where owner_id = 19 and priority = '1-URGENT'")
def gaps_of_target(v):
    found = readers.target_work(_work_rows(v), 19, priority="1-URGENT")
    return found.select(F.col("demand_id").alias("gap_id"), "priority", "status")


def _work_rows(v):
    return v.demands().withColumnsRenamed({"owner_id": "target_id", "active_from": "created_at"})


@query("P32", "", "select doc_id, lang as kind from documents where contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'the') and lang = 'en' order by doc_id desc limit 20")
def matching_notes(v):
    rows = v.table("documents").withColumnRenamed("lang", "kind")
    return readers.notes(rows, "text", "The", "en", "doc_id", 20).select("doc_id", "kind")


@query(
    "A33",
    "v_events",
    """with h as (select user_id as worker, max(ts) as m from v_events group by 1), a as (select worker, greatest(0, cast(epoch(timestamp '2024-01-30 23:00:00') as bigint) - cast(floor(epoch(m)) as bigint)) as age_seconds from h)
    select worker, age_seconds, case when age_seconds <= 120 then 'active' when age_seconds <= 900 then 'recent' else 'stale' end as liveness from a""",
)
def worker_liveness(v):
    beats = v.events().select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("ts"))
    now = F.lit("2024-01-30 23:00:00").cast("timestamp")
    return readers.liveness_report(beats, "worker", "ts", now, demands.liveness).select("worker", "age_seconds", "liveness")


@query(
    "W14",
    "v_events",
    """with s as (select user_id, event_id, event_type in ('error', 'view') as failed, sum(case when event_type in ('error', 'view') then 0 else 1 end)
        over (partition by user_id order by event_id) as island from v_events),
    n as (select user_id, row_number() over (partition by user_id, island order by event_id) as streak from s where failed)
    select user_id as tool, count(*) filter (where streak = 5) as openings, max(streak) as longest_streak from n group by 1""",
)
def breaker_openings(v):
    outcomes = v.events().select(F.col("user_id").alias("tool"), "event_id", F.col("event_type").isin("error", "view").alias("failed"))
    streaks = demands.failure_streaks(outcomes, "tool", "event_id", F.floor(F.col("event_id") / 4096))
    return demands.breaker_openings(streaks, "tool")


@query(
    "P25",
    "v_events",
    """with c as (select event_id, k % 10 = 0 as usable, ['accept', 'quarantine', 'reject'][cast(k % 3 as int) + 1] as decision,
       ['TOKEN_MISSING', 'RATE_LIMITED', 'OTHER', 'PROVIDER_TIMEOUT'][cast(event_id % 4 as int) + 1] as code, event_id % 8 = 2 as retryable from v_events)
    select case when usable or decision = 'quarantine' or code = 'TOKEN_MISSING' then 'ack' when code in ('RATE_LIMITED', 'PROVIDER_TIMEOUT') or retryable then 'retry' else 'ack' end as action,
      count(*) as n from c group by 1""",
)
def message_actions(v):
    e = v.events()
    code = F.array(cycle(F.col("event_id"), ["TOKEN_MISSING", "RATE_LIMITED", "OTHER", "PROVIDER_TIMEOUT"]))
    decision = cycle(F.col("k"), ["accept", "quarantine", "reject"])
    action = demands.message_action(F.col("k") % 10 == 0, decision, code, F.col("event_id") % 8 == 2)
    return e.groupBy(action.alias("action")).agg(F.count("*").alias("n"))


@query(
    "P28",
    "v_events",
    """with u as (select k % 4 = 0 as five, k % 3 = 0 as fifteen, k % 2 = 0 as status from v_events)
    select case when five then 'aggregate_5m_to_10m' when fifteen then 'fallback_15m_feature' when status then 'trading_status_only' else 'skip_and_emit_capability_gap' end as mode,
      case when five then '5m' when fifteen then '15m' end as frequency, count(*) as n from u group by all""",
)
def capability_modes(v):
    k = F.col("k")
    usable = F.filter(F.array(F.when(k % 3 == 0, "15m"), F.when(k % 4 == 0, "5m")), lambda f: f.isNotNull())
    mode = demands.recommended_mode(usable, k % 2 == 0)
    return v.events().groupBy(mode.alias("mode"), demands.preferred_frequency(usable).alias("frequency")).agg(F.count("*").alias("n"))


@query(
    "W16",
    "v_events",
    "select user_id, max(event_id) as event_id, max_by(event_type, event_id) as event_type, max_by(value, event_id) as value from v_events group by 1",
)
def latest_per_entity(v):
    return latest_by_key(v.events().select("user_id", "event_id", "event_type", "value"), ["user_id"], ["event_id"])


@query(
    "F40",
    "v_events",
    """with i as (select event_id, 'event:' || cast(user_id as varchar) || ':' || event_type || ':' || cast(trade_date as varchar) || ':' || substr(sha256('"' || event_type || '"'), 1, 12) as idempotency_key,
       coalesce(case when k % 2 = 0 then 'u' || cast(k as varchar) end, 'flat') as source_url from v_events)
    select idempotency_key, min(event_id) as event_id, max_by(source_url, -event_id) as source_url from i group by 1""",
)
def structured_events(v):
    """Events derived once per key, with nested or flat source fields."""
    e = v.events().withColumn("source", F.struct(F.when(F.col("k") % 2 == 0, F.concat(F.lit("u"), F.col("k").cast("string"))).alias("url")))
    key = keys.joined_key(
        F.lit("event"), F.col("user_id"), F.col("event_type"), F.col("trade_date"), keys.text_hash(F.col("event_type"), 12)
    )
    rows = e.select(key.alias("idempotency_key"), "event_id", F.coalesce("source.url", F.lit("flat")).alias("source_url"))
    return first_by_key(rows, ["idempotency_key"], ["event_id"])


@query(
    "F46",
    "",
    """select c_custkey, case when c_custkey % 3 = 0 then 'company_hk_' || lpad(cast(700 + c_custkey % 9000 as varchar), 5, '0') when c_custkey % 3 = 1 then 'company_' || cast(600000 + c_custkey as varchar)
      else 'company_' || substr(sha256('"' || c_name || '"'), 1, 8) end as target_id,
      case when c_custkey % 3 = 0 then lpad(cast(700 + c_custkey % 9000 as varchar), 5, '0') || '.HK' when c_custkey % 3 = 1 then cast(600000 + c_custkey as varchar) || '.SH' end as ticker from customer""",
)
def target_ids(v):
    key = F.col("c_custkey")
    hk = F.concat(F.lpad((700 + key % 9000).cast("string"), 4, "0"), F.lit(".hk"))
    ticker = F.when(key % 3 == 0, hk).when(key % 3 == 1, F.concat((600000 + key).cast("string"), F.lit(".sh")))
    none = F.lit(None).cast("string")
    return v.table("customer").select(
        "c_custkey", tickers.target_id(none, ticker, F.col("c_name")).alias("target_id"), tickers.registry_ticker(ticker).alias("ticker")
    )


@query(
    "F36",
    "",
    f"select conv_id, {r('sum(length(text)) * 2.0::double / 1000000 + sum(turn) * 8.0::double / 1000000', 6)} as cost from conversations group by 1",
)
def model_costs(v):
    spent = v.table("conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("i"), F.sum("turn").alias("o"))
    return spent.select("conv_id", units.token_cost(F.col("i"), F.col("o"), F.lit(2.0), F.lit(8.0)).alias("cost"))

