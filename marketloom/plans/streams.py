"""Streaming queries, run over the events file until everything available is processed."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketloom.functions.numbers import round_half_up
from marketloom.operators import bars, normalize
from marketloom.plans import views
from marketloom.plans.providers import _raw_bars
from marketloom.plans.registry import query, r
from marketloom.session import scratch_root
from marketloom.sources import raw_store, tables
from marketloom.streaming import jobs


def _stream(v):
    """The events file as a stream of ticks in event time."""
    schema = v.table("events").schema
    # a pattern of one name, which may be a file or a folder of part files
    e = jobs.read_files(v.spark, f"{v.folder}/events.parque[t]", "*", schema)
    value = F.col("value")
    return e.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.to_date("ts").alias("trade_date"), "user_id", "event_type",
        views.ticker(F.col("user_id")).alias("ticker"), value.alias("price"), value.cast("decimal(18,2)").alias("amount"),
        views.cycle(F.col("event_id"), ["tushare", "akshare", "baostock"]).alias("provider"),
    )


def _stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


_MARK = "(select max(ts) - interval 10 minute from events)"


@query("T1", "v_events", "select distinct ticker, provider, strftime(to_timestamp(epoch_us(ts) // 1000000 - (epoch_us(ts) // 1000000) % 3) at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as quote_time_bucket from v_events")
def stream_deduped_quotes(v):
    deduped = jobs.dedupe_quotes(_stream(v), "ts", ["ticker", "provider"])
    return jobs.collect_once(deduped, "quotes").select("ticker", "provider", _stamp("quote_time_bucket"))


@query(
    "T2",
    "v_events",
    f"""select ticker, strftime(b, '%Y-%m-%d %H:%M:%S') as bar_start, open, high, low, close, amount, ticks, case when ticks < 2 then 'incomplete' else 'ok' end as calculation_status
    from (select ticker, time_bucket(interval 60 minute, ts) as b, min_by(value, event_id) as open, max(value) as high, min(value) as low, max_by(value, event_id) as close,
      cast(sum(cast(value as decimal(18,2))) as double) as amount, count(*) as ticks from v_events group by 1, 2) where b + interval 60 minute <= {_MARK}""",
)
def stream_tumbling_bars(v):
    flagged = jobs.incomplete_buckets(jobs.tumbling_bars(_stream(v), "ts", "60 minutes", "event_id"), 2)
    rows = jobs.collect_once(flagged, "bars")
    return rows.select(
        "ticker", _stamp("bar_start"), "open", "high", "low", "close", F.col("amount").cast("double").alias("amount"), "ticks", "calculation_status"
    )


@query(
    "T3",
    "v_events",
    f"""select ticker, strftime(w, '%Y-%m-%d %H:%M:%S') as window_start, cast(sum(cast(value as decimal(18,2))) as double) as amount, count(*) as ticks
    from (select *, unnest([time_bucket(interval 2 hour, ts), time_bucket(interval 2 hour, ts) - interval 2 hour]) as w from v_events)
    where w + interval 4 hour <= {_MARK} group by 1, 2""",
)
def stream_sliding_amounts(v):
    rows = jobs.collect_once(jobs.sliding_amounts(_stream(v), "ts", "4 hours", "2 hours"), "sliding")
    return rows.select("ticker", _stamp("window_start"), F.col("amount").cast("double").alias("amount"), "ticks")


@query(
    "T4",
    "v_daily v_status",
    f"""with c as (select ticker, trade_date, lag(close) over (partition by ticker order by trade_date) as pc from v_daily),
    j as (select e.event_id, e.value as price, c.pc, case when is_st then 0.05::double when regexp_matches(split_part(e.ticker, '.', 1), '^(688|300|301)') then 0.2::double
       when regexp_matches(split_part(e.ticker, '.', 1), '^[48]') and length(split_part(e.ticker, '.', 1)) = 6 then 0.3::double else 0.1::double end as p
       from v_events e join c using (ticker, trade_date) join v_status using (ticker) where pc <> 0),
    a as (select event_id, concat_ws('|', case when abs(price / pc - 1) >= 0.02::double then 'return' end, case when price >= {r("pc * (1 + p)", 2)} - 1e-6::double then 'limit_up' end,
       case when price <= {r("pc * (1 - p)", 2)} + 1e-6::double then 'limit_down' end) as reasons from j)
    select * from a where reasons <> ''""",
)
def stream_price_alerts(v):
    closes = bars.previous_close(v.daily()).where("prev_close is not null").select("ticker", "trade_date", "prev_close").join(v.status(), "ticker")
    alerts = jobs.price_alerts(_stream(v), closes.drop("is_suspended"))
    return jobs.collect_once(alerts.select("event_id", F.array_join("reasons", "|").alias("reasons")), "alerts")


@query("T5", "v_events", "select 'k' || cast(user_id as varchar) || ':' || cast(trade_date as varchar) as idempotency_key, min(event_id) as event_id from v_events group by 1")
def stream_idempotent_sink(v):
    """The same stream delivered twice into one table; the second delivery adds nothing."""
    work = f"{scratch_root(v.spark)}/sink-{uuid.uuid4().hex}"
    key = F.concat(F.lit("k"), F.col("user_id").cast("string"), F.lit(":"), F.col("trade_date").cast("string"))
    rows = _stream(v).select("event_id", key.alias("idempotency_key"))
    for delivery in ("first", "second"):
        jobs.run_batches(rows, jobs.insert_sink(f"{work}/out", "idempotency_key"), f"{work}/checkpoint-{delivery}")
    return tables.read(v.spark, f"{work}/out").select("idempotency_key", "event_id")


@query(
    "T6 S1 S2",
    "v_events",
    f"""select event_id as raw_row_index, ticker as normalized_ticker, cast(trade_date as varchar) as trade_date, value as close, {r("confidence", 6)} as low from v_events
    where regexp_matches(ticker, '^(600|601|603|605|688|689|900|000|001|002|003|200|300|301|43|82|83|87|88|89)')""",
)
def stream_landed_records(v):
    """Raw rows landed as JSON lines, picked up by a file stream and written as canonical records."""
    work = f"{scratch_root(v.spark)}/landing-{uuid.uuid4().hex}"
    raw = _raw_bars(v)
    landed = raw.select(
        "raw_payload_id", "provider", F.lit("historical_bars").alias("request_type"), F.lit("2024-01-30").alias("date"), "source_api",
        F.lit("req").alias("request_id"), F.lit(None).cast("string").alias("provider_symbol"),
        F.to_json(F.struct("raw", F.col("raw_row_index").alias("n"))).alias("raw_data"), F.col("raw_row_index").alias("fetch_order"),
    )
    raw_store.append(landed, f"{work}/raw", "fetch_order")
    lines = jobs.read_files(v.spark, f"{work}/raw", "*.json.gz", raw_store.SCHEMA, "json", recursiveFileLookup="false")
    body = F.from_json("raw_data", "raw map<string,string>, n bigint")
    rows = raw_store.records(lines).withColumn("_b", body).select(
        "provider", F.lit("landed").alias("source_api"), F.col("_b.raw").alias("raw"), "raw_payload_id",
        F.concat(F.lit("raw://"), "raw_payload_id").alias("raw_payload_ref"), F.col("_b.n").alias("raw_row_index"),
    )
    records = normalize.standardise(rows, "bar").where("normalized_ticker is not null")
    shown = records.select(
        "raw_row_index", "normalized_ticker", F.col("trade_date").cast("string").alias("trade_date"), "close", round_half_up(F.col("low"), 6).alias("low")
    )
    return jobs.collect_once(shown, "records")


@query(
    "T8",
    "v_events",
    f"""with s as (select user_id, ts, case when ts > lag(ts) over w + interval 2 hour or lag(ts) over w is null then 1 else 0 end as fresh from v_events window w as (partition by user_id order by ts)),
    g as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from s)
    select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as session_start, strftime(max(ts) + interval 2 hour, '%Y-%m-%d %H:%M:%S') as session_end, count(*) as events
    from g group by user_id, n having max(ts) + interval 2 hour <= {_MARK}""",
)
def stream_sessions(v):
    rows = jobs.collect_once(jobs.sessions(_stream(v), "user_id", "ts", "2 hours"), "sessions")
    return rows.select("user_id", _stamp("session_start"), _stamp("session_end"), "events")


_BEATS = """s as (select user_id, ts, case when ts > lag(ts) over w + interval {gap} second or lag(ts) over w is null then 1 else 0 end as fresh from v_events window w as (partition by user_id order by ts)),
    g as (select user_id, ts, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as n from s),
    x as (select user_id, min(ts) as a, max(ts) + interval {gap} second as z from g group by user_id, n)"""


@query(
    "T8",
    "v_events",
    f"""with {_BEATS.format(gap=120)}, {_BEATS.format(gap=900).replace("s as (", "s9 as (").replace("g as (", "g9 as (").replace("from s)", "from s9)").replace("x as (", "x9 as (").replace("from g group", "from g9 group")}
    select user_id, state, strftime(since, '%Y-%m-%d %H:%M:%S') as since from (
      select user_id, 'busy' as state, a as since from x where z <= {_MARK} union all select user_id, 'idle', z from x where z <= {_MARK}
      union all select user_id, 'stale', z from x9 where z <= {_MARK})""",
)
def stream_liveness(v):
    """When each user became busy, idle and stale."""
    rows = jobs.collect_once(jobs.liveness(_stream(v), "user_id", "ts"), "liveness")
    return rows.select("user_id", "state", _stamp("since"))


_PARTS = 5
# Rows of one delivered file, which one task writes.
FILE_ROWS = 1 << 20


def _delivered(v, folder):
    """Events delivered in parts one after the other: mostly in order of time, every ninth event three parts later.

    Returns the schema and the number of files of a part. Every part has as many, some empty if it is small, so that
    a batch of that many files is one part.
    """
    e = v.events()
    span = e.agg(F.unix_seconds(F.min(F.col("ts").cast("timestamp"))).alias("a"), F.unix_seconds(F.max(F.col("ts").cast("timestamp"))).alias("z")).first()
    place = F.floor((F.unix_seconds(F.col("ts").cast("timestamp")) - span["a"]) * _PARTS / (span["z"] - span["a"] + 1)).cast("int")
    part = F.when(F.col("event_id") % 9 == 0, F.least(place + 3, F.lit(_PARTS - 1))).otherwise(place)
    rows = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "ticker", F.col("value").alias("price"), F.col("value").cast("decimal(18,2)").alias("amount"), part.alias("part"))
    rows = rows.persist()
    most = rows.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    files = max(-(-most // FILE_ROWS), 1)
    slot = F.pmod(F.xxhash64("event_id"), F.lit(files)).cast("int")
    used = {(r["part"], r["slot"]) for r in rows.groupBy("part", slot.alias("slot")).count().collect()}
    nothing = rows.drop("part").limit(0).coalesce(1)
    for number in range(_PARTS):
        rows.where(F.col("part") == number).drop("part").repartitionById(files, slot).write.mode("append").parquet(folder)
        # of the empty tasks of a write only the first leaves a file
        for empty in range(1, files):
            if (number, empty) not in used:
                nothing.write.mode("append").parquet(folder)
    rows.unpersist()
    return rows.drop("part").schema, files


@query(
    "T7",
    "v_events",
    f"""with e as (select *, cast(floor((epoch(ts)::bigint - min(epoch(ts)::bigint) over ()) * {_PARTS} / (max(epoch(ts)::bigint) over () - min(epoch(ts)::bigint) over () + 1)) as int) as place from v_events),
    p as (select *, case when event_id % 9 = 0 then least(place + 3, {_PARTS - 1}) else place end as part, time_bucket(interval 60 minute, ts) + interval 60 minute as bucket_end from e),
    m as (select part, max(max(ts)) over (order by part rows between unbounded preceding and 2 preceding) - interval 10 minute as mark from p group by part),
    l as (select p.*, coalesce(bucket_end <= mark, false) as late from p join m using (part))
    select strftime(bucket_end, '%Y-%m-%d %H:%M:%S') as bucket_end, count(*) filter (where not late and bucket_end <= {_MARK}) as ticks,
      count(*) filter (where late) as late, count(*) filter (where not late and bucket_end > {_MARK}) as open from l group by 1""",
)
def stream_late_rows(v):
    """Rows of every hour: in a bar, dropped as late, or in a window still open. They add up to all rows."""
    work = f"{scratch_root(v.spark)}/late-{uuid.uuid4().hex}"
    schema, files = _delivered(v, f"{work}/in")
    stream = jobs.read_files(v.spark, f"{work}/in", "*.parquet", schema, maxFilesPerTrigger=str(files))
    bars_ = jobs.tumbling_bars(stream, "ts", "60 minutes", "event_id")
    jobs.run_available(bars_, f"{work}/bars", f"{work}/bars-checkpoint")
    jobs.run_batches(stream, jobs.late_sink(v.spark, f"{work}/side", "ts", "60 minutes"), f"{work}/side-checkpoint")
    kept = v.spark.read.schema(bars_.schema).parquet(f"{work}/bars").groupBy(F.col("bar_end").alias("bucket_end")).agg(F.sum("ticks").alias("ticks"))
    late = v.spark.read.parquet(f"{work}/side/late").groupBy("bucket_end").agg(F.count("*").alias("late"))
    all_ = v.spark.read.schema(schema).parquet(f"{work}/in").groupBy(F.window("ts", "60 minutes")["end"].alias("bucket_end")).agg(F.count("*").alias("n"))
    joined = all_.join(kept, "bucket_end", "left").join(late, "bucket_end", "left").fillna(0, ["ticks", "late"])
    return joined.select(_stamp("bucket_end"), "ticks", "late", (F.col("n") - F.col("ticks") - F.col("late")).alias("open"))


@query(
    "T9 W14",
    "v_events",
    """with s as (select user_id, event_id, event_type in ('error', 'view') as failed, sum(case when event_type in ('error', 'view') then 0 else 1 end) over (partition by user_id order by event_id) as island from v_events),
    n as (select user_id, row_number() over (partition by user_id, island order by event_id) as streak from s where failed)
    select user_id as tool, count(*) filter (where streak = 5) as openings, max(streak) as longest_streak from n group by 1""",
)
def stream_breaker_alerts(v):
    work = f"{scratch_root(v.spark)}/breaker-{uuid.uuid4().hex}"
    outcomes = _stream(v).select(F.col("user_id").alias("tool"), "event_id", F.col("event_type").isin("error", "view").alias("failed"))
    sink = jobs.streak_sink(v.spark, work, "tool", "event_id", F.floor(F.col("event_id") / 4096))
    jobs.run_batches(outcomes, sink, f"{work}-checkpoint")
    return jobs.breaker_alerts(v.spark.read.parquet(f"{work}/failures"), "tool")


@query("T10 S12", "v_events", "select user_id, max(event_id) as event_id, max_by(value, event_id) as price from v_events group by 1")
def stream_latest_snapshots(v):
    work = f"{scratch_root(v.spark)}/latest-{uuid.uuid4().hex}"
    newest = _stream(v).groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("price", "event_id").alias("price"))
    jobs.run_batches(newest, jobs.latest_sink(f"{work}/out", "user_id", "event_id", 8), f"{work}/checkpoint", "update")
    return tables.read(v.spark, f"{work}/out").select("user_id", "event_id", "price")


@query("T11", "v_events", "select distinct cast(user_id as varchar) || ':' || event_type || ':' || cast(trade_date as varchar) as idempotency_key from v_events")
def stream_deduped_events(v):
    key = F.concat_ws(":", F.col("user_id").cast("string"), "event_type", F.col("trade_date").cast("string"))
    rows = jobs.dedupe_events(_stream(v).withColumn("idempotency_key", key), "ts", "idempotency_key", "2 days")
    return jobs.collect_once(rows, "events").select("idempotency_key")
