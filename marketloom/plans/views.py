"""Deterministic projections of the input tables that the registered queries run on.

Every view exists twice, as a DataFrame and as SQL text, so that a query and its check
start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions import market, times, urls
from marketloom.operators import bars as bar_ops
from marketloom.operators.hotkeys import dealt, latest_by_key
from marketloom.session import pin

BUCKET_MINUTES = 240
# Parts of one task; the records or queries made of a part are a hundred times its size.
PART_ROWS = 1 << 14
TURNS_PER_BUNDLE = 16
DELTAS = [0.0, 0.00005, 0.002, 0.05, 0.3, None]
# Terms that stand in for a target's entities and keywords in the invented prose of the documents.
ENTITY_TERMS = ["thand", "onen", "Ndonre", "eaux"]
KEYWORD_TERMS = ["then", "leon", "heer"]
STRONG_TERMS = ["the", "ing", "ment", "tion", "oine"]


def ticker(user: Column) -> Column:
    base = F.get(F.array(*[F.lit(b) for b in (600000, 300000, 688000, 430000)]), (user % 4).cast("int"))
    suffix = F.get(F.array(*[F.lit(s) for s in (".SH", ".SZ", ".SH", ".BJ")]), (user % 4).cast("int"))
    return F.concat((base + user).cast("string"), suffix)


def cycle(number: Column, values: list) -> Column:
    """Value picked by a number modulo the list length."""
    return F.get(F.array(*[F.lit(v) for v in values]), (number % len(values)).cast("int"))


class Views:
    """The input tables of one folder and the views derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = pin(spark)
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def parts(self) -> DataFrame:
        """Parts in tasks that are cut by rows, for views that make many rows of each."""
        return dealt(self.table("part"), "p_partkey", PART_ROWS)

    def events(self) -> DataFrame:
        """Collected events: ticker, provider, variable, confidence and source per event."""
        kinds = {"signup": "official", "error": "media", "click": "exchange", "view": "social", "purchase": "company"}
        source = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
        e = self.table("events")
        k = F.get_json_object("props", "$.k").cast("int")
        confidence = F.least(F.col("value") / 100, F.lit(1.0))
        return e.select(
            "event_id",
            "ts",
            "user_id",
            "event_type",
            "value",
            k.alias("k"),
            F.to_date("ts").alias("trade_date"),
            ticker(F.col("user_id")).alias("ticker"),
            cycle(F.col("event_id"), ["tushare", "akshare", "baostock"]).alias("provider"),
            confidence.alias("confidence"),
            F.element_at(source, F.col("event_type")).alias("source_type"),
            F.concat(F.lit("v"), (k % 10).cast("string")).alias("tracking_variable"),
            F.when(confidence >= fixed.LINK_ACCEPT_CONFIDENCE, "accepted").otherwise("pending").alias("review_status"),
            cycle(F.col("event_id"), ["positive", "negative", "neutral"]).alias("direction"),
        )

    def bars(self) -> DataFrame:
        """Raw daily bars per ticker and provider."""
        e = self.events().withColumn("effective_provider", F.col("provider"))
        grouped = e.groupBy("ticker", "effective_provider", "trade_date").agg(
            F.min_by("value", "event_id").alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", "event_id").alias("close"),
            F.count("*").cast("double").alias("volume"),
            F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("amount"),
            ((10 - (F.min("event_id") % 4).cast("double")) / 10).alias("data_quality"),
        )
        status = F.when(F.dayofmonth("trade_date") % 10 == 0, "quarantined").otherwise("validated")
        return grouped.select(
            "*", F.lit("1d").alias("frequency"), F.lit("none").alias("adjust"), status.alias("validation_status")
        )

    def ticks(self) -> DataFrame:
        """Events as price rows inside intraday buckets."""
        bucket = times.minute_bucket(F.col("ts").cast("timestamp"), BUCKET_MINUTES)
        value = F.col("value")
        return self.events().select(
            "ticker",
            "trade_date",
            F.date_format(bucket, "HH:mm").alias("bucket_clock"),
            "event_id",
            *[value.alias(n) for n in ("open", "high", "low", "close", "amount")],
            F.lit(1.0).alias("volume"),
        )

    def buckets(self) -> DataFrame:
        return bar_ops.rollup(self.ticks(), ["ticker", "trade_date", "bucket_clock"], "event_id")

    def daily(self) -> DataFrame:
        """One close per ticker and day over all providers."""
        return bar_ops.rollup(self.ticks(), ["ticker", "trade_date"], "event_id")

    def factors(self) -> DataFrame:
        """Adjustment factors: cumulative ones of one provider, direct ones of another."""
        e = self.events().where(F.col("event_type") == "signup")
        even, v = F.col("event_id") % 2 == 0, F.col("value")
        rows = e.select(
            "ticker",
            F.when(even, "tushare").otherwise("baostock").alias("effective_provider"),
            "trade_date",
            "event_id",
            F.when(even, 1 + v / 1000).alias("adj_factor"),
            F.when(~even, 1 - v / 1000).alias("fore_adjust_factor"),
            F.when(~even, 1 + v / 500).alias("back_adjust_factor"),
            F.when(~even, "baostock_pct_change_adjustment_factor").alias("factor_method"),
        )
        return latest_by_key(rows, ["ticker", "effective_provider", "trade_date"], ["event_id"]).drop("event_id")

    def quotes(self) -> DataFrame:
        """Records of three providers on every part, with deviations that reach every rule branch."""
        p = self.parts()
        key = F.col("p_partkey")
        deltas = F.array(*[F.lit(d).cast("double") for d in DELTAS])
        sources = F.array(
            *[
                F.struct(F.lit(n).alias("provider"), F.lit(gap).alias("gap"), d.alias("delta"))
                for n, gap, d in (
                    ("tushare", 11, F.lit(0.0)),
                    ("akshare", 13, F.get(deltas, (key % 6).cast("int"))),
                    ("baostock", 7, F.get(deltas, (F.floor(key / 6) % 6).cast("int"))),
                )
            ]
        )
        rows = p.withColumn("_s", F.explode(sources)).select("*", "_s.*").drop("_s").where(F.col("p_partkey") % F.col("gap") != 0)
        scaled = 1 + F.col("delta")
        return rows.select(
            F.lit("bar").alias("record_type"),
            F.concat(F.lit("P"), key.cast("string")).alias("comparison_key"),
            "provider",
            F.concat_ws(":", "provider", key.cast("string")).alias("record_id"),
            F.when((F.col("provider") == "akshare") & (key % 5 == 0), fixed.ESTIMATED_AMOUNT_API).otherwise("daily").alias("source_api"),
            (F.col("p_retailprice") * scaled).alias("close"),
            (F.col("p_retailprice") * scaled).alias("open"),
            (F.col("p_size") * 100 * scaled).alias("volume"),
            (F.col("p_retailprice") * F.col("p_size") * scaled).alias("amount"),
            F.when((F.col("provider") == "baostock") & (key % 10 == 0), F.concat(F.upper("p_name"), F.lit(" Ltd.")))
            .when((F.col("provider") == "akshare") & (key % 9 == 0), "other name")
            .otherwise(F.col("p_name"))
            .alias("name"),
            ((F.col("provider") == "baostock") & (key % 17 == 0)).alias("is_suspended"),
            F.when((F.col("provider") != "tushare") | (key % 3 != 0), F.col("p_retailprice")).alias("vwap"),
            F.when(key % 19 != 0, F.concat(F.lit("raw://"), key.cast("string"))).alias("raw_payload_ref"),
            (key % 23 != 0).alias("has_provenance"),
        )

    def links(self) -> DataFrame:
        """One source link per page, with run, canonical URL, domain and body hash."""
        p = self.table("pages")
        return p.select(
            F.col("page_id").alias("link_id"),
            F.concat(F.lit("run"), (F.col("page_id") % 4).cast("string")).alias("run_id"),
            F.concat(F.lit("t"), (F.col("page_id") % 3).cast("string")).alias("target_id"),
            "url",
            urls.canonical(F.col("url")).alias("canonical_url"),
            urls.domain(F.col("url")).alias("domain"),
        )

    def hits(self) -> DataFrame:
        """Documents as search hits: a title, a snippet and a rank within their source."""
        d = self.table("documents")
        return d.select(
            "doc_id",
            "lang",
            F.col("source").alias("run_id"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.col("text").alias("snippet"),
            cycle(
                F.col("doc_id"),
                ["news.sse.com.cn", "www.gov.cn", "example.com", "blog.example.org", "caam.org.cn", ""],
            ).alias("domain"),
            (F.col("doc_id") % 12).cast("int").alias("rank"),
            F.when(F.col("doc_id") % 7 == 0, "source_pack:policy").otherwise("orders_tender").alias("query_family"),
            F.sha2("text", 256).alias("content_hash"),
        )

    def contributions(self) -> DataFrame:
        """Events as model outputs on a link."""
        e = self.events()
        one = F.lit(1.0)
        return e.select(
            F.col("user_id").alias("link_id"),
            "event_id",
            F.col("event_type").alias("model_config_id"),
            cycle(F.col("k"), ["qwen_dashscope", "siliconflow", "solo_a", "solo_b", "other"]).alias("provider"),
            cycle(F.col("k"), ["save_structured", "link_only", "skip"]).alias("decision"),
            F.col("value").alias("overall_score"),
            "confidence",
            cycle(F.col("event_id"), [1.0, 0.8, 1.2]).alias("configured_weight"),
            one.alias("task_weight"),
            one.alias("schema_score"),
            cycle(F.col("event_id"), [1.0, 0.95]).alias("evidence_score"),
            one.alias("feedback_score"),
        )

    def relations(self) -> DataFrame:
        """Supplier and customer edges with a type from the return flag."""
        li, o = self.table("lineitem"), self.table("orders")
        kinds = F.create_map(F.lit("A"), F.lit("supplier_of"), F.lit("N"), F.lit("customer_of"), F.lit("R"), F.lit("partner_of"))
        rows = li.join(o, li.l_orderkey == o.o_orderkey)
        line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
        return rows.select(
            line.alias("relation_id"),
            F.col("l_orderkey").alias("link_id"),
            F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")).alias("subject_name"),
            F.when(F.col("l_suppkey") % 3 == 0, F.col("l_suppkey").cast("string")).alias("subject_ticker"),
            F.when(F.col("o_custkey") % 10 == 0, "多家客户")
            .otherwise(F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")))
            .alias("object_name"),
            F.element_at(kinds, F.col("l_returnflag")).alias("relation_type"),
            F.lit("").alias("product"),
            F.col("l_discount").alias("confidence"),
        )

    def bundles(self) -> DataFrame:
        """Conversations as extraction bundles, one per sixteen turns.

        A long conversation becomes many links, so no bundle gathers more than its sixteen turns.
        """
        chunk = F.floor(F.col("turn") / TURNS_PER_BUNDLE)
        c = self.table("conversations").withColumn("link_id", F.concat_ws("-", F.col("conv_id").cast("string"), chunk.cast("string")))
        turn = F.struct(
            F.col("turn").alias("seq"),
            F.col("text").alias("statement"),
            F.concat(F.lit("p"), (F.col("turn") % 5).cast("string")).alias("passage_id"),
            F.least(F.lit(1.0), F.length("text") / 500).alias("confidence"),
        )

        def of(role: str, name: str) -> Column:
            return F.array_sort(F.collect_list(F.when(F.col("role") == role, turn))).alias(name)

        grouped = c.groupBy("conv_id", "link_id").agg(of("assistant", "facts"), of("user", "events"), of("system", "risks"))
        return grouped.select(
            "link_id",
            F.concat(F.lit("run"), (F.col("conv_id") % 4).cast("string")).alias("run_id"),
            cycle(F.col("conv_id"), ["save_structured", "link_only", "skip"]).alias("decision"),
            "facts",
            "events",
            "risks",
        )

    def targets(self) -> DataFrame:
        """Research targets: one per user seen, with ten variables, an industry, a layer and themes."""
        users = self.events().select("user_id").distinct()
        variables = F.array(*[F.lit(f"v{i}") for i in range(10)])
        layers = ["current_holding", "trading_candidate", "watchlist", "base_pool", None]
        return users.select(
            F.col("user_id").alias("target_id"),
            ticker(F.col("user_id")).alias("ticker"),
            variables.alias("tracking_variables"),
            F.when(F.col("user_id") % 6 != 0, F.concat(F.lit("ind"), (F.col("user_id") % 6).cast("string"))).alias("industry_id"),
            cycle(F.col("user_id"), layers).alias("pool_layer"),
            F.when(F.col("user_id") % 4 == 0, F.array().cast("array<string>"))
            .otherwise(F.array(F.concat(F.lit("th"), (F.col("user_id") % 4).cast("string")), F.lit("th_all")))
            .alias("theme_ids"),
        )

    def research_events(self) -> DataFrame:
        """Events in the shape the coverage operators read."""
        return self.events().select(
            "event_id",
            F.col("user_id").alias("target_id"),
            "event_type",
            F.col("trade_date").alias("event_date"),
            F.col("ts").alias("created_at"),
            "confidence",
            "source_type",
            "direction",
            "tracking_variable",
            "review_status",
        )

    def calendar(self) -> DataFrame:
        """Distinct order dates as a calendar, weekdays open."""
        days = self.table("orders").select(F.to_date("o_orderdate").alias("calendar_date")).distinct()
        return days.withColumn("is_open", F.weekday("calendar_date") < 5)

    def members(self) -> DataFrame:
        """Customers as pool members."""
        c, key = self.table("customer"), F.col("c_custkey")
        return c.select(
            key.alias("member_id"),
            cycle(key, ["current_holding", "trading_candidate", "watchlist", "base_pool"]).alias("pool_layer"),
            ticker(key).alias("ticker"),
            F.col("c_name").alias("company_name"),
            F.when(key % 3 == 0, "sellable").otherwise("t1_locked").alias("sellability"),
            (key % 20 == 0).alias("is_st"),
            (key % 25 == 0).alias("is_suspended"),
            F.when(key % 30 == 0, "removed").otherwise("active").alias("status"),
        )

    def demands(self) -> DataFrame:
        """Orders as demands and tasks."""
        o, key = self.table("orders"), F.col("o_orderkey")
        return o.select(
            key.alias("demand_id"),
            F.col("o_custkey").alias("owner_id"),
            cycle(key, ["active", "suspended", "completed", "draft", "bogus"]).alias("status"),
            F.col("o_orderpriority").alias("priority"),
            F.to_date("o_orderdate").alias("active_from"),
            F.when(key % 4 != 0, F.date_add(F.to_date("o_orderdate"), 30 - (key % 40).cast("int"))).alias("active_to"),
            cycle(key, ["daily", "weekly", "monthly", "quarterly"]).alias("cadence"),
            F.col("o_totalprice").alias("amount"),
        )

    def status(self) -> DataFrame:
        """Special-treatment and suspension flags per ticker."""
        return (
            self.events()
            .select("ticker", (F.col("user_id") % 10 == 0).alias("is_st"), (F.col("user_id") % 15 == 0).alias("is_suspended"))
            .distinct()
        )

    def limit_pct(self) -> Column:
        return market.limit_pct(F.col("ticker"), F.col("is_st"))


TICKER_SQL = (
    "cast([600000, 300000, 688000, 430000][cast({u} % 4 as int) + 1] + {u} as varchar)"
    " || ['.SH', '.SZ', '.SH', '.BJ'][cast({u} % 4 as int) + 1]"
)


def cycle_sql(number: str, values: list) -> str:
    items = ", ".join("null" if v is None else f"'{v}'" if isinstance(v, str) else repr(v) for v in values)
    return f"[{items}][cast({number} % {len(values)} as int) + 1]"


def _rollup_sql(keys: str, source: str) -> str:
    return f"""
        select {keys}, min_by(value, event_id) as open, max(value) as high, min(value) as low,
               max_by(value, event_id) as close, cast(count(*) as double) as volume,
               cast(sum(cast(value as decimal(18,2))) as double) as amount
        from {source} group by {keys}"""


_BUCKET = f"(hour(ts) * 60 + minute(ts)) - ((hour(ts) * 60 + minute(ts)) % {BUCKET_MINUTES})"

SQL: dict[str, str] = {
    "v_events": f"""
        select event_id, ts, user_id, event_type, value, k, cast(ts as date) as trade_date, ticker, provider,
               confidence, source_type, 'v' || cast(k % 10 as varchar) as tracking_variable,
               case when confidence >= 0.65::double then 'accepted' else 'pending' end as review_status, direction
        from (select *, cast(regexp_extract(props, '"k": *([0-9]+)', 1) as int) as k,
                     {TICKER_SQL.format(u="user_id")} as ticker,
                     {cycle_sql("event_id", ["tushare", "akshare", "baostock"])} as provider,
                     least(value / 100, 1.0::double) as confidence,
                     {cycle_sql("event_id", ["positive", "negative", "neutral"])} as direction,
                     case event_type when 'signup' then 'official' when 'error' then 'media' when 'click' then 'exchange'
                          when 'view' then 'social' else 'company' end as source_type
              from events)""",
    "v_bars": """
        select ticker, provider as effective_provider, trade_date, min_by(value, event_id) as open, max(value) as high,
               min(value) as low, max_by(value, event_id) as close, cast(count(*) as double) as volume,
               cast(sum(cast(value as decimal(18,2))) as double) as amount,
               (10 - cast(min(event_id) % 4 as double)) / 10 as data_quality, '1d' as frequency, 'none' as adjust,
               case when day(trade_date) % 10 = 0 then 'quarantined' else 'validated' end as validation_status
        from v_events group by ticker, provider, trade_date""",
    "v_ticks": f"""
        select ticker, trade_date, event_id, value,
               lpad(cast(({_BUCKET}) // 60 as varchar), 2, '0') || ':' || lpad(cast(({_BUCKET}) % 60 as varchar), 2, '0')
               as bucket_clock
        from v_events""",
    "v_buckets": f"""
        select *, case when open <> 0 then close / open - 1 else 0.0::double end as return_window,
               amount / volume as vwap
        from ({_rollup_sql("ticker, trade_date, bucket_clock", "v_ticks")})""",
    "v_daily": _rollup_sql("ticker, trade_date", "v_ticks"),
    "v_fact": """
        select * exclude (event_id, rn) from (
          select ticker, case when event_id % 2 = 0 then 'tushare' else 'baostock' end as effective_provider, trade_date,
                 event_id, case when event_id % 2 = 0 then 1 + value / 1000 end as adj_factor,
                 case when event_id % 2 = 1 then 1 - value / 1000 end as fore_adjust_factor,
                 case when event_id % 2 = 1 then 1 + value / 500 end as back_adjust_factor,
                 case when event_id % 2 = 1 then 'baostock_pct_change_adjustment_factor' end as factor_method,
                 row_number() over (partition by ticker, event_id % 2, trade_date order by event_id desc) as rn
          from v_events where event_type = 'signup') where rn = 1""",
    "v_quotes": f"""
        select 'bar' as record_type, 'P' || p_partkey as comparison_key, provider, provider || ':' || p_partkey as record_id,
               case when provider = 'akshare' and p_partkey % 5 = 0 then 'stock_zh_a_hist_tx' else 'daily' end as source_api,
               p_retailprice * (1 + delta) as close, p_retailprice * (1 + delta) as open,
               (p_size * 100) * (1 + delta) as volume, p_retailprice * p_size * (1 + delta) as amount,
               case when provider = 'baostock' and p_partkey % 10 = 0 then upper(p_name) || ' Ltd.'
                    when provider = 'akshare' and p_partkey % 9 = 0 then 'other name' else p_name end as name,
               provider = 'baostock' and p_partkey % 17 = 0 as is_suspended,
               case when provider <> 'tushare' or p_partkey % 3 <> 0 then p_retailprice end as vwap,
               case when p_partkey % 19 <> 0 then 'raw://' || p_partkey end as raw_payload_ref,
               p_partkey % 23 <> 0 as has_provenance
        from (select part.*, s.provider, s.gap,
                     case s.provider when 'tushare' then 0.0::double
                          when 'akshare' then (cast({DELTAS!r} as double[]))[cast(p_partkey % 6 as int) + 1]
                          else (cast({DELTAS!r} as double[]))[cast((p_partkey // 6) % 6 as int) + 1] end as delta
              from part cross join (values ('tushare', 11), ('akshare', 13), ('baostock', 7)) s(provider, gap))
        where p_partkey % gap <> 0""".replace("None", "null"),
    "v_hits": f"""
        select doc_id, lang, source as run_id, split_part(text, chr(10), 1) as title, text as snippet,
               {cycle_sql("doc_id", ["news.sse.com.cn", "www.gov.cn", "example.com", "blog.example.org", "caam.org.cn", ""])} as domain,
               cast(doc_id % 12 as int) as rank,
               case when doc_id % 7 = 0 then 'source_pack:policy' else 'orders_tender' end as query_family,
               sha256(text) as content_hash
        from documents""",
    "v_contrib": f"""
        select user_id as link_id, event_id, event_type as model_config_id,
               {cycle_sql("k", ["qwen_dashscope", "siliconflow", "solo_a", "solo_b", "other"])} as provider,
               {cycle_sql("k", ["save_structured", "link_only", "skip"])} as decision,
               value as overall_score, confidence,
               cast({cycle_sql("event_id", [1.0, 0.8, 1.2])} as double) as configured_weight,
               cast({cycle_sql("event_id", [1.0, 0.95])} as double) as evidence_score
        from v_events""",
    "v_weighted": """
        select c.*, configured_weight * 1.0::double * 1.0::double * evidence_score * greatest(confidence, 0.05::double)
                    * 1.0::double * case when n = 1 then 1.0::double else 0.6::double end as effective_weight
        from (select *, count(*) over (partition by link_id, family) as n
              from (select *, case provider when 'qwen_dashscope' then 'qwen' when 'siliconflow' then 'qwen' else provider end
                           as family from v_contrib)) c""",
    "v_rel": """
        select l_orderkey * 10 + l_linenumber as relation_id, l_orderkey as link_id, 'Supplier ' || l_suppkey as subject_name,
               case when l_suppkey % 3 = 0 then cast(l_suppkey as varchar) end as subject_ticker,
               case when o_custkey % 10 = 0 then '多家客户' else 'Customer ' || o_custkey end as object_name,
               case l_returnflag when 'A' then 'supplier_of' when 'N' then 'customer_of' when 'R' then 'partner_of' end
               as relation_type, '' as product, l_discount as confidence
        from lineitem join orders on l_orderkey = o_orderkey""",
    "v_turns": f"""
        select link_id, 'run' || cast(conv_id % 4 as varchar) as run_id,
               {cycle_sql("conv_id", ["save_structured", "link_only", "skip"])} as decision, turn as seq,
               text as statement, 'p' || cast(turn % 5 as varchar) as passage_id,
               least(1.0::double, length(text) / 500.0::double) as confidence,
               case role when 'assistant' then 'facts' when 'user' then 'events' else 'risks' end as kind,
               row_number() over (partition by link_id, role order by turn, text) - 1 as position
        from (select *, cast(conv_id as varchar) || '-' || cast(turn // {TURNS_PER_BUNDLE} as varchar) as link_id from conversations)""",
    "v_targets": f"""
        select user_id as target_id, {TICKER_SQL.format(u="user_id")} as ticker,
               case when user_id % 6 <> 0 then 'ind' || cast(user_id % 6 as varchar) end as industry_id,
               {cycle_sql("user_id", ["current_holding", "trading_candidate", "watchlist", "base_pool", None])} as pool_layer,
               case when user_id % 4 = 0 then ['unknown'] else ['th' || cast(user_id % 4 as varchar), 'th_all'] end as themes
        from (select distinct user_id from events)""",
    "v_cells": """
        select target_id, 'v' || cast(i as varchar) as tracking_variable from v_targets, range(10) g(i)""",
    "v_matrix": """
        select c.target_id, c.tracking_variable, o.n is not null as covered, coalesce(o.n, 0) as event_count,
               o.max_confidence, coalesce(o.auth, false) as has_authoritative_source
        from v_cells c left join (
          select user_id, tracking_variable, count(*) as n, max(confidence) as max_confidence,
                 bool_or(source_type in ('official', 'exchange', 'regulator', 'company')) as auth
          from v_events where review_status = 'accepted' group by 1, 2) o
        on o.user_id = c.target_id and o.tracking_variable = c.tracking_variable""",
    "v_cal": """
        select cast(o_orderdate as date) as calendar_date, isodow(cast(o_orderdate as date)) < 6 as is_open
        from orders group by 1, 2""",
    "v_members": f"""
        select c_custkey as member_id, {TICKER_SQL.format(u="c_custkey")} as ticker, c_name as company_name,
               {cycle_sql("c_custkey", ["current_holding", "trading_candidate", "watchlist", "base_pool"])} as pool_layer,
               case when c_custkey % 3 = 0 then 'sellable' else 't1_locked' end as sellability,
               c_custkey % 20 = 0 as is_st, c_custkey % 25 = 0 as is_suspended,
               case when c_custkey % 30 = 0 then 'removed' else 'active' end as status
        from customer""",
    "v_demands": f"""
        select o_orderkey as demand_id, o_custkey as owner_id,
               {cycle_sql("o_orderkey", ["active", "suspended", "completed", "draft", "bogus"])} as status,
               o_orderpriority as priority, cast(o_orderdate as date) as active_from,
               case when o_orderkey % 4 <> 0 then cast(o_orderdate as date) + (30 - cast(o_orderkey % 40 as int)) end as active_to,
               {cycle_sql("o_orderkey", ["daily", "weekly", "monthly", "quarterly"])} as cadence, o_totalprice as amount
        from orders""",
    "v_status": """
        select distinct ticker, user_id % 10 = 0 as is_st, user_id % 15 = 0 as is_suspended from v_events""",
}
_NEEDS = {
    "v_bars": "v_events",
    "v_ticks": "v_events",
    "v_buckets": "v_ticks",
    "v_daily": "v_ticks",
    "v_fact": "v_events",
    "v_contrib": "v_events",
    "v_weighted": "v_contrib",
    "v_cells": "v_targets",
    "v_matrix": "v_cells v_events",
    "v_status": "v_events",
}


def with_views(names: str, body: str) -> str:
    """SQL text preceded by the definitions of the named views and what they need."""
    needed: list[str] = []

    def add(name: str) -> None:
        for parent in _NEEDS.get(name, "").split():
            add(parent)
        if name not in needed:
            needed.append(name)

    for name in names.split():
        add(name)
    if not needed:
        return body.strip()
    text = body.strip()
    definitions = ",\n".join(f"{n} as ({SQL[n].strip()})" for n in needed)
    if text[:5].lower() == "with ":
        return f"with {definitions},\n{text[5:]}"
    return f"with {definitions}\n{text}"
