"""Structured Streaming forms of the collection and feature operators.

Every transformation takes and returns a streaming DataFrame, so it runs the same on files
or a message bus. Event time is a timestamp column; sources with timezone-free times cast first.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marketloom import fixed
from marketloom.functions import market, times
from marketloom.operators import demands
from marketloom.operators.hotkeys import latest_by_key, running_total
from marketloom.session import scratch_root
from marketloom.sources import tables


def read_files(spark: SparkSession, folder: str, pattern: str, schema: StructType | str, kind: str = "parquet", **options) -> DataFrame:
    """File stream over the files of a folder that match a pattern."""
    reader = spark.readStream.schema(schema).format(kind).option("pathGlobFilter", pattern)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load(folder)


def run_available(stream: DataFrame, path: str, checkpoint: str, partitions: Sequence[str] = ()) -> StreamingQuery:
    """Process everything available into Parquet files, exactly once per checkpoint, then stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partitions:
        writer = writer.partitionBy(*partitions)
    running = writer.trigger(availableNow=True).start(path)
    running.awaitTermination()
    return running


def run_batches(stream: DataFrame, each, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Hand every micro-batch to a function until everything available is processed."""
    running = (
        stream.writeStream.foreachBatch(each)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return running


def collect_once(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is available now and read its output table."""
    work = f"{scratch_root(stream.sparkSession)}/{name}-{uuid.uuid4().hex}"
    run_available(stream, f"{work}/out", f"{work}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{work}/out")


def dropped_rows(running: StreamingQuery) -> int:
    """Rows that came later than the watermark, over all stateful operators and batches."""
    return sum(op["numRowsDroppedByWatermark"] for p in running.recentProgress for op in p["stateOperators"])


# --- transformations -----------------------------------------------------------------------


def dedupe_quotes(quotes: DataFrame, time: str, keys: Sequence[str], delay: str = "10 minutes") -> DataFrame:
    """One quote per key and three-second bucket."""
    bucketed = quotes.withColumn("quote_time_bucket", times.second_bucket(F.col(time)))
    return bucketed.withWatermark(time, delay).dropDuplicatesWithinWatermark([*keys, "quote_time_bucket"])


def dedupe_events(events: DataFrame, time: str, key: str, delay: str = "1 day") -> DataFrame:
    """One event per idempotency key while the watermark remembers it."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def tumbling_bars(ticks: DataFrame, time: str, width: str, sequence: str, delay: str = "10 minutes") -> DataFrame:
    """Bars per ticker and window, emitted once the watermark passes the window's end."""
    window = F.window(time, width)
    bars = (
        ticks.withWatermark(time, delay)
        .groupBy("ticker", window.alias("_w"))
        .agg(
            F.min_by("price", sequence).alias("open"),
            F.max("price").alias("high"),
            F.min("price").alias("low"),
            F.max_by("price", sequence).alias("close"),
            F.sum("amount").alias("amount"),
            F.count("*").alias("ticks"),
        )
    )
    return bars.select("ticker", F.col("_w.start").alias("bar_start"), F.col("_w.end").alias("bar_end"),
                       "open", "high", "low", "close", "amount", "ticks")


def sliding_amounts(ticks: DataFrame, time: str, width: str, slide: str, delay: str = "10 minutes") -> DataFrame:
    """Total and mean amount per ticker over sliding windows."""
    grouped = ticks.withWatermark(time, delay).groupBy("ticker", F.window(time, width, slide).alias("_w"))
    return grouped.agg(F.sum("amount").alias("amount"), F.count("*").alias("ticks")).select(
        "ticker", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "amount", "ticks"
    )


def price_alerts(ticks: DataFrame, closes: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """Ticks that move far from the previous close or touch the price limit.

    ``closes`` is a static table with one row per ticker and day: prev_close and is_st.
    """
    bounds = limits or fixed.FEATURE_THRESHOLDS
    joined = ticks.join(closes, ["ticker", "trade_date"]).where("prev_close <> 0")
    pct = market.limit_pct(F.col("ticker"), F.col("is_st"))
    up = market.limit_price(F.col("prev_close"), pct, True)
    down = market.limit_price(F.col("prev_close"), pct, False)
    rows = joined.withColumn("day_return", F.try_divide("price", "prev_close") - 1)
    reasons = F.filter(
        F.array(
            F.when(F.abs("day_return") >= bounds["return_abs"], "return"),
            F.when(F.col("price") >= up - 1e-6, "limit_up"),
            F.when(F.col("price") <= down + 1e-6, "limit_down"),
        ),
        lambda x: x.isNotNull(),
    )
    return rows.withColumn("reasons", reasons).where(F.size("reasons") > 0)


def sessions(events: DataFrame, key: str, time: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Activity sessions per key, closed by a gap without events."""
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    grouped = events.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("_s"))
    return grouped.agg(F.count("*").alias("events")).select(
        key, F.col("_s.start").alias("session_start"), F.col("_s.end").alias("session_end"), "events"
    )


def liveness(beats: DataFrame, key: str, time: str, busy: str = "120 seconds", stale: str = "900 seconds", delay: str = "10 minutes") -> DataFrame:
    """Changes of every key's state: busy from a first event on, idle and then stale when none follows for so long.

    A state's change is a session's begin or end, so the result does not depend on the order in which events
    arrive within the watermark, and is emitted once the watermark has passed the session.
    """
    active = sessions(beats, key, time, busy, delay)
    turns = F.explode(F.array(
        F.struct(F.lit("busy").alias("state"), F.col("session_start").alias("since")),
        F.struct(F.lit("idle").alias("state"), F.col("session_end").alias("since")),
    ))
    known = active.select(key, turns.alias("_t")).select(key, "_t.*")
    lost = sessions(beats, key, time, stale, delay).select(key, F.lit("stale").alias("state"), F.col("session_end").alias("since"))
    return known.unionByName(lost)


def late_sink(spark: SparkSession, path: str, time: str, width: str, delay: str = "10 minutes"):
    """Batch function that keeps the rows whose window had been closed before their batch.

    The watermark of a batch is the latest event time of the batches before it less the delay. A window is closed
    by the batch whose watermark passes it, which may still add to it; rows of later batches are late. A windowed
    aggregation over the same stream drops exactly these without a trace. Outputs are written per batch id, so a
    replay overwrites its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = tables.read(spark, f"{path}/seen")
        mark = F.lit(None).cast("timestamp")
        if seen is not None:
            latest = seen.where(F.col("batch") < batch_id - 1).agg(F.max("latest")).first()[0]
            mark = F.lit(latest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = batch.withColumn("bucket_end", F.window(time, width)["end"]).where(F.col("bucket_end") <= mark)
        late.write.mode("overwrite").parquet(f"{path}/late/batch={batch_id}")
        totals = batch.agg(F.max(time).alias("latest"), F.count("*").alias("rows"))
        totals.write.mode("overwrite").parquet(f"{path}/seen/batch={batch_id}")

    return write


def incomplete_buckets(bars: DataFrame, expected: int) -> DataFrame:
    """Flag bars that hold fewer ticks than expected."""
    status = F.when(F.col("ticks") < expected, "incomplete").otherwise("ok")
    return bars.withColumn("calculation_status", status)


# --- sinks ---------------------------------------------------------------------------------


def insert_sink(path: str, key: str):
    """Batch function that appends rows whose key is not stored yet; a replayed batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        tables.insert_absent_bucketed(batch, path, [key], [c for c in batch.columns if c != key][:1])

    return write


def latest_sink(path: str, key: str, order: str, buckets: int = 64):
    """Batch function that keeps the latest row per key in a bucketed table.

    Only buckets that receive keys are rewritten; a replayed batch rewrites the same rows.
    """

    def write(batch: DataFrame, _: int) -> None:
        bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        tables.upsert(bucketed, path, ["bucket"], ["bucket", key], order)

    return write


def streak_sink(spark: SparkSession, path: str, key: str, order: str, block: Column):
    """Batch function that follows consecutive failures of every tool across batches.

    ``path`` gets one folder of failures with their streak length and one small table of the
    streak each tool ended the batch with. Both are written per batch id, so a replay overwrites
    its own output.
    """

    def previous(batch_id: int) -> DataFrame | None:
        return tables.read(spark, f"{path}/state/batch={batch_id - 1}") if batch_id > 0 else None

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # read twice below; lost blocks are read again from the source
        state = previous(batch_id)
        succeeded = F.when(F.col("failed"), 0).otherwise(1)
        islands = running_total(batch.select(key, order, "failed"), [key], [order], succeeded, block, "_island")
        failing = running_total(islands.where("failed"), [key, "_island"], [order], F.lit(1), block, "streak")
        if state is not None:
            carried = failing.join(state.withColumnRenamed("streak", "_carry"), key, "left")
            carry = F.when(F.col("_island") == 0, F.coalesce("_carry", F.lit(0))).otherwise(0)
            failing = carried.withColumn("streak", F.col("streak") + carry).drop("_carry")
        failing.select(key, order, "streak").write.mode("overwrite").parquet(f"{path}/failures/batch={batch_id}")
        # A tool's streak after the batch: that of its last event, zero after a success.
        stored = spark.read.parquet(f"{path}/failures/batch={batch_id}")
        last = latest_by_key(batch.select(key, order, "failed"), [key], [order])
        ended = last.join(stored, [key, order], "left").select(key, F.coalesce("streak", F.lit(0)).cast("long").alias("streak"))
        if state is not None:
            ended = ended.unionByName(state.join(ended.select(key), key, "left_anti").select(key, "streak"))
        ended.write.mode("overwrite").parquet(f"{path}/state/batch={batch_id}")
        batch.unpersist()

    return write


def breaker_alerts(failures: DataFrame, key: str, threshold: int = fixed.BREAKER_THRESHOLD) -> DataFrame:
    """Openings and longest streak per tool from the failures a streak sink wrote."""
    return demands.breaker_openings(failures, key, threshold)
