"""Demands, targets, expected work and the tables around them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions import times
from marketloom.functions.keys import joined_key
from marketloom.operators.hotkeys import explode_computed, latest_by_key, running_total
from marketloom.sources import tables


def demand_errors() -> Column:
    """Array of the reasons why a demand row cannot be registered."""
    required = ["schema_version", "demand_id", "demand_type", "source_type", "status"]
    checks = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", F.lit(f"missing_{c}")) for c in required]
    checks += [
        F.when(F.col("schema_version") != "demand.v1", "unsupported_schema_version"),
        F.when(~F.col("status").isin(fixed.DEMAND_STATUSES), "invalid_status"),
        F.when(F.col("active_from") > F.col("active_to"), "invalid_date_range"),
        F.when(F.col("test_mode") & F.col("notify_owner"), "test_mode_cannot_notify_owner"),
    ]
    return F.filter(F.array(*checks), lambda e: e.isNotNull())


def versions(events: DataFrame, key: str, order: str, block: Column) -> DataFrame:
    """Version number of every change of a demand, in order."""
    return running_total(events, [key], [order], F.lit(1), block, "version")


def latest_versions(versioned: DataFrame, key: str) -> DataFrame:
    return latest_by_key(versioned, [key], ["version"])


def lifecycle(current: Column, action: Column) -> Column:
    """Status after an operator action, null when the action is not allowed from the current status."""
    result = F.lit(None).cast("string")
    for name, allowed in fixed.LIFECYCLE.items():
        result = F.when((action == name) & current.isin(*allowed), fixed.LIFECYCLE_RESULT[name]).otherwise(result)
    return result


def derived_targets(demands: DataFrame) -> DataFrame:
    """Targets of every demand: its own and, one hop away, those of its source demands.

    ``demands`` has demand_id, targets (array of target ids) and derived_from (array of demand ids).
    """
    own = demands.select("demand_id", F.explode("targets").alias("target_id"))
    hops = demands.select(F.col("demand_id").alias("_to"), F.explode("derived_from").alias("demand_id"))
    inherited = hops.join(own, "demand_id").select(F.col("_to").alias("demand_id"), "target_id")
    return own.unionByName(inherited).distinct()


def resolve_targets(demands: DataFrame, members: DataFrame) -> DataFrame:
    """Targets per demand by precedence: explicit, else included tickers, else members of its pool layers.

    ``demands`` has demand_id, targets, include_tickers, pool_layers (arrays), sellability, exclude_st
    and exclude_suspended; ``members`` has pool_layer, ticker, sellability, is_st, is_suspended, status.
    """
    explicit = F.size("targets") > 0
    listed = F.size("include_tickers") > 0
    named = demands.where(explicit | listed).select(
        "demand_id",
        F.explode(F.when(explicit, F.col("targets")).otherwise(F.col("include_tickers"))).alias("ticker"),
        F.when(explicit, "explicit").otherwise("include_list").alias("origin"),
    )
    pools = demands.where(~explicit & ~listed).select(
        "demand_id",
        F.explode("pool_layers").alias("pool_layer"),
        F.col("sellability").alias("_wanted"),
        "exclude_st",
        "exclude_suspended",
    )
    pooled = (
        pools.join(members.where(F.col("status") == "active"), "pool_layer")
        .where(
            (F.col("_wanted").isNull() | (F.col("_wanted") == F.col("sellability")))
            & ~(F.col("exclude_st") & F.col("is_st"))
            & ~(F.col("exclude_suspended") & F.col("is_suspended"))
        )
        .select("demand_id", "ticker", F.lit("pool").alias("origin"))
    )
    return named.unionByName(pooled)


_POOL_FILTER = ["pool_layers", "sellability", "exclude_st", "exclude_suspended"]
_MEMBER_KIND = ["pool_layer", "sellability", "is_st", "is_suspended"]


def target_classes(demands: DataFrame) -> DataFrame:
    """Demands with the class of their pool filter: demands with equal filters share one; it is null for named targets.

    ``demands`` is as in ``resolve_targets``. Layers count as a set.
    """
    pool = (F.size("targets") <= 0) & (F.size("include_tickers") <= 0)
    layers = F.array_sort(F.array_distinct(F.coalesce("pool_layers", F.array().cast("array<string>"))))
    rows = demands.withColumn("pool_layers", layers).withColumns({c: F.coalesce(c, F.lit(False)) for c in ("exclude_st", "exclude_suspended")})
    named = F.sha2(F.to_json(F.struct(*_POOL_FILTER), {"ignoreNullFields": "false"}), 256)
    return rows.withColumn("class_id", F.when(pool, named))


def _kinds_of_classes(classed: DataFrame, members: DataFrame) -> DataFrame:
    """Which kinds of members (layer, sellability and flags) each class takes: few rows, whatever the number of demands and members."""
    classes = classed.where("class_id is not null").select("class_id", *_POOL_FILTER).distinct()
    wanted = classes.select("class_id", F.explode("pool_layers").alias("pool_layer"), F.col("sellability").alias("_wanted"), "exclude_st", "exclude_suspended")
    kinds = members.where(F.col("status") == "active").select(*_MEMBER_KIND).distinct()
    fits = (F.col("_wanted").isNull() | (F.col("_wanted") == F.col("sellability"))) & ~(F.col("exclude_st") & F.col("is_st"))
    return wanted.join(kinds, "pool_layer").where(fits & ~(F.col("exclude_suspended") & F.col("is_suspended"))).select("class_id", *_MEMBER_KIND)


def class_members(classed: DataFrame, members: DataFrame) -> DataFrame:
    """Members of every class: class_id and ticker. Demands do not multiply them."""
    kinds = _kinds_of_classes(classed, members)
    return members.where(F.col("status") == "active").join(kinds, _same_kind(members, kinds)).select("class_id", "ticker")


def _same_kind(members: DataFrame, kinds: DataFrame) -> Column:
    same = F.lit(True)
    for name in _MEMBER_KIND:
        same = same & members[name].eqNullSafe(kinds[name])
    return same


def class_sizes(classed: DataFrame, members: DataFrame) -> DataFrame:
    """How many members every class has, from bitmaps of member numbers per kind that are combined per class.

    A kind's members are one bitmap of 32768 numbers each, so the members are read once and meet no demand.
    """
    bucket, bit = F.bitmap_bucket_number("member_id"), F.bitmap_bit_position("member_id")
    active = members.where(F.col("status") == "active")
    bitmaps = active.groupBy(*_MEMBER_KIND, bucket.alias("_bucket")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    kinds = _kinds_of_classes(classed, members)
    whole = bitmaps.join(kinds, _same_kind(bitmaps, kinds)).groupBy("class_id", "_bucket").agg(F.bitmap_or_agg("_bits").alias("_bits"))
    return whole.groupBy("class_id").agg(F.sum(F.bitmap_count("_bits")).alias("members"))


def target_counts(classed: DataFrame, members: DataFrame) -> DataFrame:
    """Number and origin of every demand's targets."""
    explicit, listed = F.size("targets") > 0, F.size("include_tickers") > 0
    sizes = classed.join(class_sizes(classed, members), "class_id", "left")
    origin = F.when(explicit, "explicit").when(listed, "include_list").otherwise("pool")
    count = F.when(explicit, F.size("targets")).when(listed, F.size("include_tickers")).otherwise(F.coalesce("members", F.lit(0)))
    return sizes.select("demand_id", origin.alias("origin"), count.cast("long").alias("targets"))


def filter_pool(members: DataFrame, sellability: str | None = None, exclude_st: bool = False, exclude_suspended: bool = False):
    """Active pool members that pass the optional filters."""
    kept = members.where(F.col("status") == "active")
    if sellability:
        kept = kept.where(F.col("sellability") == sellability)
    if exclude_st:
        kept = kept.where(~F.col("is_st"))
    if exclude_suspended:
        kept = kept.where(~F.col("is_suspended"))
    return kept


def snapshot_minutes(layer: Column, sellability: Column) -> Column:
    minutes = fixed.SNAPSHOT_MINUTES
    return (
        F.when((layer == "current_holding") & (sellability == "sellable"), minutes["held_sellable"])
        .when(layer == "current_holding", minutes["held_locked"])
        .when(layer == "trading_candidate", minutes["candidate"])
        .when(layer == "watchlist", minutes["watchlist"])
        .otherwise(minutes["default"])
    )


def snapshot_eligible(layer: Column, sellability: Column) -> Column:
    return F.coalesce(sellability == "sellable", F.lit(False)) | layer.isin("current_holding", "trading_candidate")


def black_swan_minutes(layer: Column, sellability: Column) -> Column:
    held = (layer == "current_holding") & (sellability == "sellable")
    return F.when(held, fixed.BLACK_SWAN_MINUTES["held_sellable"]).otherwise(fixed.BLACK_SWAN_MINUTES["other"])


def phase_allowed(phase: Column, task: str) -> Column:
    """Whether a market phase allows intraday snapshots or black-swan scans by default."""
    lenient = task == "black_swan"
    return F.when(phase == "intraday", True).when(phase == "non_trading_day", False).otherwise(F.lit(lenient))


def expected_work(targets: DataFrame) -> DataFrame:
    """Task rows that every (demand, target) should have at a moment, with bucket start and stable key.

    ``targets`` has demand_id, demand_type, target_id, ticker, pool_layer, sellability, market_phase, the
    local moment ``as_of`` and the flags collect_text, collect_stock and collect_hk_connect. Bucketed tasks
    are keyed by their bucket, daily ones by the date, so repeated planning yields the same keys.
    """
    layer, sell, phase, kind = F.col("pool_layer"), F.col("sellability"), F.col("market_phase"), F.col("demand_type")
    none = F.lit(None).cast("int")
    intraday, candidate, context = (kind == k for k in ("intraday_monitoring", "candidate_full_snapshot", "market_context_daily"))
    scan = kind == "black_swan_scan"
    research = ~(intraday | candidate | context | scan)
    after_close = (kind == "daily_collection") & phase.isin("post_market", "off_hours")
    hk = F.coalesce(F.upper("ticker").endswith(".HK"), F.lit(False))
    snapshot_due = phase_allowed(phase, "snapshot") & snapshot_eligible(layer, sell)

    def rule(name: str, minutes: Column, due: Column) -> Column:
        return F.struct(F.lit(fixed.TASKS[name]).alias("task_type"), minutes.cast("int").alias("minutes"), due.alias("due"))

    rules = F.array(
        rule("snapshot", snapshot_minutes(layer, sell), intraday & snapshot_due),
        rule("black_swan", black_swan_minutes(layer, sell), intraday & phase_allowed(phase, "black_swan")),
        rule("black_swan", none, scan & F.col("collect_text")),
        rule("candidate", none, candidate),
        rule("deep", none, candidate | (research & F.col("collect_text"))),
        rule("context", none, context),
        rule("stock", none, after_close & F.col("ticker").isNotNull() & F.col("collect_stock")),
        rule("hk", none, after_close & hk & F.col("collect_hk_connect")),
    )
    rows = explode_computed(targets, F.filter(rules, lambda r: r["due"]), "_r")
    bucket = F.date_format(times.minute_bucket(F.col("as_of"), F.col("_r.minutes")), "yyyy-MM-dd'T'HH:mm:ss")
    start = F.when(F.col("_r.minutes").isNotNull(), F.concat(bucket, F.lit(fixed.MARKET_UTC_OFFSET)))
    target = F.coalesce("target_id", "ticker", F.lit("targetless"))
    slot = F.coalesce("bucket_start", F.date_format("as_of", "yyyy-MM-dd"))
    return (
        rows.withColumn("task_type", F.col("_r.task_type"))
        .withColumn("bucket_start", start)
        .withColumn("task_key", joined_key(F.lit("collection_task"), F.col("demand_id"), F.col("task_type"), target, slot))
        .drop("_r")
        .dropDuplicates(["task_key"])
    )


def missing_work(expected: DataFrame, tasks: DataFrame) -> DataFrame:
    return expected.join(tasks.select("task_key"), "task_key", "left_anti")


def merge_targets(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace targets by key and append new ones; the incoming row wins."""
    rest = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*rest).alias("_old"))
    new = incoming.select(*keys, F.struct(*rest).alias("_new"))
    both = old.join(new, list(keys), "full_outer").withColumn("_row", F.coalesce("_new", "_old"))
    change = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNotNull(), "updated").otherwise("kept").alias("change")
    )
    return both.select(*keys, "_row.*", change)


def remove_targets(existing: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    return existing.join(removed.select(key), key, "left_anti").select(*existing.columns)


def dedupe_targets(targets: DataFrame, order: str) -> DataFrame:
    """Last row per target id, ticker or company name, whichever identifies it first."""
    identity = F.coalesce("target_id", "ticker", "company_name")
    return latest_by_key(targets.withColumn("target_key", identity).where("target_key is not null"), ["target_key"], [order])


def unregistered(targets: DataFrame, profiles: DataFrame) -> DataFrame:
    """Targets that need a profile, have none, and are not plain ticker targets."""
    wanted = targets.where(F.col("collect_text") & (F.coalesce("target_id", F.lit("")) != "") & ~F.col("target_id").startswith("ticker_"))
    return wanted.join(profiles.select("target_id"), "target_id", "left_anti")


def cancel_cascade(tickets: DataFrame, messages: DataFrame, cancelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open tickets of cancelled demands, and open messages that carry one of those tickets."""
    open_tickets = tickets.where(F.col("status").isin("open", "in_progress")).withColumn(
        "demand_id", F.get_json_object("payload", "$.demand_id")
    )
    hit = open_tickets.join(cancelled.select("demand_id"), "demand_id", "left_semi").select("ticket_id")
    carried = messages.where(F.col("status") == "open").withColumn("ticket_id", F.get_json_object("payload", "$.ticket_id"))
    return hit, carried.join(hit, "ticket_id", "left_semi").select("message_id", "ticket_id")


def completed_but_open(messages: DataFrame, tickets: DataFrame) -> DataFrame:
    """Messages still open although their ticket is done."""
    carried = messages.where(F.col("status").isin("open", "in_progress")).withColumn(
        "ticket_id", F.get_json_object("payload", "$.ticket_id")
    )
    return carried.join(tickets.where(F.col("status") == "done").select("ticket_id"), "ticket_id", "left_semi")


def orphan_tickets(tickets: DataFrame, messages: DataFrame) -> DataFrame:
    """Open tickets no message refers to."""
    carried = messages.select(F.get_json_object("payload", "$.ticket_id").alias("ticket_id"))
    return tickets.where(F.col("status").isin("open", "in_progress")).join(carried, "ticket_id", "left_anti")


def backlog_head(messages: DataFrame, group: str, now: Column) -> DataFrame:
    """Next message of every group: highest priority, then oldest, not expired."""
    ready = messages.where(
        (F.col("status") == "open") & (F.col("available_at") <= now) & (F.col("expires_at").isNull() | (F.col("expires_at") > now))
    )
    ready = ready.withColumn("_neg", -F.col("priority"))
    head = F.min(F.struct("_neg", "created_at", "message_id"))
    return ready.groupBy(group).agg(head.alias("_h")).select(group, (-F.col("_h._neg")).alias("priority"), F.col("_h.message_id"))


def message_action(usable: Column, decision: Column, codes: Column, retryable: Column) -> Column:
    """ack or retry for a tool result, by its quality decision and error codes."""
    fatal = F.arrays_overlap(codes, F.array(*[F.lit(c) for c in fixed.FATAL_ERRORS]))
    transient = F.arrays_overlap(codes, F.array(*[F.lit(c) for c in fixed.RETRYABLE_ERRORS]))
    return (
        F.when(usable | decision.isin("quarantine", "accept_with_review") | F.coalesce(fatal, F.lit(False)), "ack")
        .when(F.coalesce(transient, F.lit(False)) | retryable, "retry")
        .otherwise("ack")
    )


def failure_streaks(outcomes: DataFrame, key: str, order: str, block: Column) -> DataFrame:
    """Length of the run of consecutive failures each outcome belongs to, zero for a success.

    Streaks are cut by the running number of successes, so each is its own group.
    """
    succeeded = F.when(F.col("failed"), 0).otherwise(1)
    islands = running_total(outcomes, [key], [order], succeeded, block, "_island")
    failing = islands.where("failed").withColumn("_n", F.lit(1))
    return running_total(failing, [key, "_island"], [order], F.col("_n"), block, "streak").drop("_n")


def breaker_openings(streaks: DataFrame, key: str, threshold: int = fixed.BREAKER_THRESHOLD) -> DataFrame:
    """How often a tool reached the failure threshold, and its longest streak."""
    return streaks.groupBy(key).agg(
        F.count_if(F.col("streak") == threshold).alias("openings"), F.max("streak").alias("longest_streak")
    )


def recommended_mode(usable: Column, status_available: Column) -> Column:
    """Intraday collection mode from the usable bar frequencies."""
    return (
        F.when(F.array_contains(usable, "5m"), "aggregate_5m_to_10m")
        .when(F.array_contains(usable, "15m"), "fallback_15m_feature")
        .when(status_available, "trading_status_only")
        .otherwise("skip_and_emit_capability_gap")
    )


def preferred_frequency(usable: Column, fallback: Sequence[str] = ("5m", "15m", "none"), default: str | None = "15m") -> Column:
    """First usable frequency of the fallback order; ``none`` ends it without one, else the default applies."""
    choices = [F.lit(f) for f in fallback if f != "none"]
    first = F.try_element_at(F.filter(F.array(*choices), lambda f: F.coalesce(F.array_contains(usable, f), F.lit(False))), F.lit(1))
    return first if "none" in fallback else F.coalesce(first, F.lit(default))


def liveness(age_seconds: Column) -> Column:
    return (
        F.when(age_seconds.isNull(), "no_heartbeat")
        .when(age_seconds <= fixed.HEARTBEAT_BUSY_SECONDS, "active")
        .when(age_seconds <= fixed.HEARTBEAT_STALE_SECONDS, "recent")
        .otherwise("stale")
    )


def log_runs(runs: DataFrame, path: str) -> None:
    """Add runs to the run log; a run whose idempotency key is in it changes nothing."""
    tables.insert_absent_bucketed(runs, path, ["idempotency_key"], ["started_at", "run_id"])


def reusable_runs(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Requests with the earlier successful run of their key that answers them, null where they have to run.

    Keys are unique in the log, so the join adds no rows.
    """
    done = log.where(F.col("status") == "success").select("idempotency_key", F.col("run_id").alias("reused_run_id"))
    return requests.join(done, "idempotency_key", "left")


def batches(items: DataFrame, batch: str) -> DataFrame:
    """Status of every batch from its items, each of which failed or not on its own."""
    counts = items.groupBy(batch).agg(F.count("*").alias("items"), F.count_if("failed").alias("failures"))
    return counts.withColumn("status", batch_status(F.col("failures"), F.col("items")))


def batch_status(failed: Column, total: Column) -> Column:
    return F.when(failed == 0, "success").when(failed < total, "partial_success").otherwise("failed")
