"""Tables, raw landing and streams: repeated writes, splits into batches, late data."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from marketloom.operators import demands
from marketloom.plans import streams, views
from marketloom.sources import dims, raw_store, series, tables
from marketloom.streaming import jobs


def test_upsert_keeps_latest_and_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "bars")
    schema = "k string, close double, ingested_at int, day string"
    tables.upsert(spark.createDataFrame([("a", 100.0, 20, "d1"), ("b", 1.0, 1, "d2")], schema), path, ["day"], ["day", "k"])
    kept = (tmp_path / "bars" / "day=d2").stat().st_mtime_ns, sorted(p.name for p in (tmp_path / "bars" / "day=d2").glob("*.parquet"))
    tables.upsert(spark.createDataFrame([("a", 101.0, 21, "d1"), ("c", 5.0, 1, "d1")], schema), path, ["day"], ["day", "k"])
    rows = {r.k: r.close for r in tables.read(spark, path).collect()}
    assert rows == {"a": 101.0, "b": 1.0, "c": 5.0}
    assert kept[1] == sorted(p.name for p in (tmp_path / "bars" / "day=d2").glob("*.parquet"))


def test_upsert_reads_only_touched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, v int, ingested_at int, day date, src string"
    days = [dt.date(2026, 1, d) for d in (1, 2, 3)]
    old = [("a", 1, 1, days[0], "x"), ("b", 1, 1, days[1], "y"), ("c", 1, 1, days[2], None), ("d", 1, 1, days[2], None)]
    tables.upsert(spark.createDataFrame(old, schema), path, ["day", "src"], ["day", "src", "k"])
    new = spark.createDataFrame([("a", 2, 2, days[0], "x"), ("c", 2, 2, days[2], None)], schema)
    kept = tables.touched(tables.read(spark, path), new, ["day", "src"])
    assert sorted(r.k for r in kept.collect()) == ["a", "c", "d"]
    assert "2026-01-01,2026-01-03" in kept._jdf.queryExecution().executedPlan().toString().replace(", ", ",")
    tables.upsert(new, path, ["day", "src"], ["day", "src", "k"])
    rows = {(r.k, r.v) for r in tables.read(spark, path).collect()}
    assert rows == {("a", 2), ("b", 1), ("c", 2), ("d", 1)}


def test_upsert_of_no_rows_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("a", 1, 1, "d1")], "k string, v int, ingested_at int, day string")
    for part in (rows, rows.limit(0)):
        tables.upsert(part, path, ["day"], ["day", "k"])
    assert tables.read(spark, path).count() == 1


def test_first_write_wins_within_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, v int, day string"
    for value, day in ((1, "d1"), (2, "d1"), (3, "d2")):
        tables.insert_absent(spark.createDataFrame([("a", value, day)], schema), path, ["day", "k"], ["v"], ["day"])
    assert {(r.v, r.day) for r in tables.read(spark, path).collect()} == {(1, "d1"), (3, "d2")}


def test_first_write_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    for value in (1, 2):
        tables.insert_absent(spark.createDataFrame([("a", value)], "k string, v int"), path, ["k"], ["v"])
    assert [(r.k, r.v) for r in tables.read(spark, path).collect()] == [("a", 1)]


def test_raw_payloads_are_immutable_and_verifiable(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = spark.range(3000).select(
        F.lit("p1").alias("raw_payload_id"), F.lit("tushare").alias("provider"), F.lit("bars").alias("request_type"), F.lit("2026-01-01").alias("date"),
        F.lit("daily").alias("source_api"), F.lit("r").alias("request_id"), F.col("id").cast("string").alias("provider_symbol"),
        F.to_json(F.struct("id")).alias("raw_data"), F.col("id").alias("fetch_order"),
    )
    for _ in range(2):
        raw_store.append(rows, path, "fetch_order")
    lines = raw_store.scan(spark, path)
    assert raw_store.records(lines).count() == 3000 and raw_store.metadata(lines).count() == 1
    assert raw_store.row_at(lines, "p1", 2999).first().raw_data == '{"id":2999}'
    assert [r.raw_payload_id for r in raw_store.catalogue(lines, "tushare", "bars").collect()] == ["p1"]
    assert raw_store.catalogue(lines, "akshare").count() == 0
    assert raw_store.verify(lines).first().intact
    changed = lines.withColumn("raw_data", F.when(F.col("raw_row_index") == 7, "{}").otherwise(F.col("raw_data")))
    assert not raw_store.verify(changed).first().intact


def test_series_inference(spark):
    df = spark.createDataFrame([("2026年01月02日", "1,200.5"), ("20260103", "--")], "`日期` string, `收盘` string")
    assert [(r.day, r.value) for r in series.infer_series(df).collect()] == [(dt.date(2026, 1, 2), 1200.5), (dt.date(2026, 1, 3), None)]
    with pytest.raises(ValueError):
        series.infer_series(df.select("日期"))


def test_dimensions(spark):
    assert dims.tolerances(spark).where("category = 'price'").first().absolute == 0.01
    assert dims.variable_rules(spark).where("tracking_variable = 'buyback'").count() == 2
    assert dims.domains(spark).where("position = 0").first().domain == "cninfo.com.cn"


TICK = "event_id long, ts timestamp, ticker string, price double, amount decimal(18,2), failed boolean"


@pytest.fixture
def ticks(spark, tmp_path):
    """Three files of ticks, in event-time order; the last holds one very late row."""
    start = dt.datetime(2026, 1, 1, 9, 30, tzinfo=dt.UTC)
    rows = [(i, start + dt.timedelta(minutes=i), "hot" if i % 3 else "b", float(i), Decimal(1), i % 7 != 0) for i in range(180)]
    late = (999, start, "late", 1.0, Decimal(1), False)
    for n, part in enumerate((rows[:60], rows[60:120], [*rows[120:], late])):
        spark.createDataFrame(part, TICK).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{n}"))
        (next((tmp_path / "in" / f"part{n}").glob("*.parquet"))).rename(tmp_path / "in" / f"{n}.parquet")
    return rows, str(tmp_path / "in")


def stream(spark, folder):
    return jobs.read_files(spark, folder, "*.parquet", TICK, maxFilesPerTrigger=1)


def test_bars_equal_batch_and_late_rows_are_counted(spark, ticks, tmp_path):
    rows, folder = ticks
    bars = jobs.tumbling_bars(stream(spark, folder), "ts", "30 minutes", "event_id", "5 minutes")
    run = jobs.run_available(bars, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.ticker, r.bar_start.hour * 60 + r.bar_start.minute): (r.open, r.close, r.ticks) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {}
    for i, ts, ticker, price, *_ in rows:
        window = (ts.hour * 60 + ts.minute) // 30 * 30
        first, _, n = want.get((ticker, window), (price, price, 0))
        want[(ticker, window)] = (first, price, n + 1)
    closed = {k: v for k, v in want.items() if k[1] + 30 <= 9 * 60 + 30 + 179 - 5}
    assert got == closed
    assert jobs.dropped_rows(run) == 1


def test_streaks_continue_across_batches(spark, ticks, tmp_path):
    rows, folder = ticks
    outcomes = stream(spark, folder).where("ticker <> 'late'").select(F.col("ticker").alias("tool"), "event_id", "failed")
    sink = jobs.streak_sink(spark, str(tmp_path / "s"), "tool", "event_id", F.floor(F.col("event_id") / 16))
    jobs.run_batches(outcomes, sink, str(tmp_path / "cp"))
    streamed = {r.tool: (r.openings, r.longest_streak) for r in jobs.breaker_alerts(spark.read.parquet(str(tmp_path / "s" / "failures")), "tool").collect()}
    batch = spark.createDataFrame(rows, TICK).select(F.col("ticker").alias("tool"), "event_id", "failed")
    streaks = demands.failure_streaks(batch, "tool", "event_id", F.floor(F.col("event_id") / 1000))
    assert streamed == {r.tool: (r.openings, r.longest_streak) for r in demands.breaker_openings(streaks, "tool").collect()}


def test_sink_is_idempotent_on_replay(spark, ticks, tmp_path):
    _, folder = ticks
    keyed = stream(spark, folder).select(F.col("event_id").cast("string").alias("k"), "price")
    for attempt in range(2):
        jobs.run_batches(keyed, jobs.insert_sink(str(tmp_path / "t"), "k"), str(tmp_path / f"cp{attempt}"))
    assert tables.read(spark, str(tmp_path / "t")).count() == 181


def test_latest_snapshot_over_batches(spark, ticks, tmp_path):
    rows, folder = ticks
    newest = stream(spark, folder).groupBy("ticker").agg(F.max("event_id").alias("event_id"), F.max_by("price", "event_id").alias("price"))
    jobs.run_batches(newest, jobs.latest_sink(str(tmp_path / "t"), "ticker", "event_id", 4), str(tmp_path / "cp"), "update")
    got = {r.ticker: r.price for r in tables.read(spark, str(tmp_path / "t")).collect()}
    assert got == {"hot": 179.0, "b": 177.0, "late": 1.0}


def test_quotes_dedupe_per_bucket(spark, tmp_path):
    start = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
    rows = [(start + dt.timedelta(seconds=s), "a") for s in (0, 1, 2, 3, 5, 6)]
    spark.createDataFrame(rows, "ts timestamp, ticker string").coalesce(1).write.parquet(str(tmp_path / "q"))
    quotes = jobs.read_files(spark, str(tmp_path / "q"), "*.parquet", "ts timestamp, ticker string")
    out = jobs.collect_once(jobs.dedupe_quotes(quotes, "ts", ["ticker"]), "q")
    assert out.select("quote_time_bucket").distinct().count() == out.count() == 3


def test_sessions_close_after_a_gap(spark, tmp_path):
    start = dt.datetime(2026, 1, 1, tzinfo=dt.UTC)
    rows = [(start + dt.timedelta(minutes=m), "a") for m in (0, 5, 40, 400)]
    spark.createDataFrame(rows, "ts timestamp, k string").coalesce(1).write.parquet(str(tmp_path / "s"))
    events = jobs.read_files(spark, str(tmp_path / "s"), "*.parquet", "ts timestamp, k string")
    out = jobs.collect_once(jobs.sessions(events, "k", "ts", "15 minutes"), "sessions")
    assert sorted(r.events for r in out.collect()) == [1, 2]


def test_streams_read_a_table_of_many_files_as_one_of_one_file(spark, tmp_path):
    from marketloom.plans import REGISTRY, Views

    source = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{source}/events.parquet")
    events.orderBy(F.rand(3)).repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    for name in ("stream_deduped_quotes", "stream_idempotent_sink"):
        one, many = (REGISTRY[name].build(Views(spark, f)) for f in (source, str(tmp_path)))
        assert one.count() and many.count() == one.count()


def test_parts_of_a_delivery_have_equally_many_files_and_the_same_late_rows(spark, tmp_path, monkeypatch):
    """Small parts, one of them without rows in some files, arrive as whole batches, whatever the number of files."""
    events = spark.sql("""select id as event_id, timestamp '2024-01-01' + make_interval(0, 0, 0, 0, cast(if(id < 90, id, id * 3) as int)) as ts,
        id % 7 as user_id, 'view' as event_type, cast(id as double) as value, '{"k": 1}' as props from range(400)""")
    events.write.parquet(f"{tmp_path}/events.parquet")
    v = views.Views(spark, str(tmp_path))

    def late():
        return sorted(map(tuple, streams.stream_late_rows(v).collect()))

    wanted = late()
    monkeypatch.setattr(streams, "FILE_ROWS", 37)
    _, files = streams._delivered(v, f"{tmp_path}/in")
    assert files > 1 and len(list((tmp_path / "in").glob("*.parquet"))) == files * streams._PARTS
    assert max(spark.read.parquet(str(p)).count() for p in (tmp_path / "in").glob("*.parquet")) < 2 * 37
    assert late() == wanted and sum(r[2] for r in wanted) > 0
