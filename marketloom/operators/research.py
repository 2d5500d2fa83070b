"""Coverage, recall, research cards and health of the collected research data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions.numbers import any_contains, ratio_or_null, round_half_up
from marketloom.functions.text import ascii_lower
from marketloom.operators.hotkeys import explode_computed, latest_by_key


def accept_links(labels: DataFrame, allowed: Column) -> DataFrame:
    """Model labels restricted to allowed variables, one per (event, variable), with review status.

    ``labels`` has event_id, target_id, tracking_variable, mapping_confidence; ``allowed`` is an
    array column of the target's declared variables (empty or null allows all).
    """
    known = (F.coalesce(F.size(allowed), F.lit(0)) <= 0) | F.array_contains(allowed, F.col("tracking_variable"))
    kept = labels.where(known & (F.coalesce(F.col("tracking_variable"), F.lit("")) != ""))
    once = latest_by_key(kept, ["event_id", "tracking_variable"], ["mapping_confidence"])
    accepted = F.col("mapping_confidence") >= fixed.LINK_ACCEPT_CONFIDENCE
    return once.withColumn("mapping_method", F.lit("model")).withColumn(
        "review_status", F.when(accepted, "accepted").otherwise("pending")
    )


def direction_of(text: Column) -> Column:
    negative, positive = any_contains(text, fixed.NEGATIVE_WORDS), any_contains(text, fixed.POSITIVE_WORDS)
    return (
        F.when(negative & positive, "mixed").when(negative, "negative").when(positive, "positive").otherwise("unclear")
    )


def keyword_candidates(
    events: DataFrame, text: Column, rules: dict[str, Sequence[str]], allowed: Column | None = None
) -> DataFrame:
    """Pending candidate links from keyword rules; confidence grows with the matches up to 0.6.

    ``allowed`` is an array column of the target's declared variables; without any, no rule fires.
    """
    lowered = F.lower(text)

    def candidate(variable: str, words: Sequence[str]) -> Column:
        lowered_words = [w.lower() for w in words]
        hits = F.filter(F.array(*[F.lit(w) for w in lowered_words]), lambda w: F.contains(F.col("_text"), w))
        return F.struct(F.lit(variable).alias("tracking_variable"), hits.alias("hits"))

    found = F.filter(F.array(*[candidate(v, w) for v, w in rules.items()]), lambda c: F.size(c["hits"]) > 0)
    if allowed is not None:
        found = F.filter(found, lambda c: F.array_contains(allowed, c["tracking_variable"]))
    texts = events.withColumn("_text", lowered).withColumn("direction", direction_of(F.col("_text")))
    return (
        explode_computed(texts, found, "_c")
        .select(
            *events.columns,
            F.col("_c.tracking_variable"),
            "direction",
            F.least(F.lit(0.6), round_half_up(0.3 + 0.1 * F.size("_c.hits"), 1)).alias("confidence"),
            F.array_join("_c.hits", ",").alias("evidence"),
        )
    )


def expected_cells(targets: DataFrame) -> DataFrame:
    """One row per target and declared tracking variable."""
    return targets.select("target_id", F.explode("tracking_variables").alias("tracking_variable"))


def coverage_matrix(targets: DataFrame, events: DataFrame, links: DataFrame, confirmed: bool = True) -> DataFrame:
    """Expected target x variable cells with what was observed in each.

    Events and links meet on the unique event id; the observations are reduced to one row per
    cell before they meet the expected grid.
    """
    chosen = links.where(F.col("review_status") == "accepted") if confirmed else links
    observed = (
        events.select("event_id", "target_id", "confidence", "source_type")
        .join(chosen.select("event_id", "tracking_variable"), "event_id")
        .groupBy("target_id", "tracking_variable")
        .agg(
            F.count("*").alias("event_count"),
            F.max("confidence").alias("max_confidence"),
            F.bool_or(F.col("source_type").isin(fixed.AUTHORITATIVE_SOURCES)).alias("authoritative"),
        )
    )
    return (
        expected_cells(targets)
        .join(observed, ["target_id", "tracking_variable"], "left")
        .select(
            "target_id",
            "tracking_variable",
            F.col("event_count").isNotNull().alias("covered"),
            F.coalesce("event_count", F.lit(0)).alias("event_count"),
            "max_confidence",
            F.coalesce("authoritative", F.lit(False)).alias("has_authoritative_source"),
        )
    )


def _cell_counts() -> list[Column]:
    return [
        F.count("*").alias("expected_cells"),
        F.count_if("covered").alias("covered_cells"),
        F.count_if(F.col("covered") & F.col("has_authoritative_source")).alias("authoritative_cells"),
        ratio_or_null(F.count_if("covered"), F.count("*")).alias("coverage_ratio"),
    ]


def coverage_totals(matrix: DataFrame) -> DataFrame:
    return matrix.agg(*_cell_counts())


def coverage_by_group(matrix: DataFrame, targets: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Coverage by several scalar target fields in one pass of grouping sets, absent values as unknown."""
    meta = targets.select("target_id", *[F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias(f) for f in fields])
    rows = matrix.join(meta, "target_id", "left").fillna("unknown", subset=list(fields))
    dimension = F.concat(*[F.when(F.grouping(f) == 0, F.lit(f)).otherwise("") for f in fields])
    return (
        rows.groupingSets([[f] for f in fields], *fields)
        .agg(dimension.alias("dimension"), *_cell_counts())
        .withColumn("group_key", F.coalesce(*fields))
        .drop(*fields)
    )


def coverage_by_theme(matrix: DataFrame, targets: DataFrame) -> DataFrame:
    """Coverage by theme; a target without themes counts under unknown."""
    themes = F.when(F.coalesce(F.size("theme_ids"), F.lit(0)) > 0, F.col("theme_ids")).otherwise(F.array(F.lit("unknown")))
    meta = targets.select("target_id", themes.alias("theme_ids"))
    rows = matrix.join(meta, "target_id", "left").withColumn("group_key", F.explode("theme_ids"))
    return rows.groupBy("group_key").agg(*_cell_counts())


def zero_covered_targets(matrix: DataFrame) -> DataFrame:
    counts = matrix.groupBy("target_id").agg(F.count("*").alias("expected_variables"), F.count_if("covered").alias("_c"))
    return counts.where("_c = 0").drop("_c")


def candidate_only_cells(confirmed: DataFrame, inclusive: DataFrame) -> DataFrame:
    """Cells that only pending candidates cover."""
    cell = ["target_id", "tracking_variable"]
    return inclusive.where("covered").select(*cell).join(confirmed.where("covered").select(*cell), cell, "left_anti")


def missing_snapshots(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(observed.select(key), key, "left_anti")


def golden_matches(golden: DataFrame, events: DataFrame, links: DataFrame) -> DataFrame:
    """Each expected event with its best matching collected event, if any.

    An item matches on target, date range, any keyword, any listed source type and any linked
    variable; empty lists do not restrict. An event without a date counts on the day it was created. Keywords are
    plain text without wildcards. Items are spread over the days of their range, so they meet
    events on (target, day), and one best event per item is kept with map-side aggregation.
    """
    if "created_at" in events.columns:
        events = events.withColumn("event_date", F.coalesce("event_date", F.to_date("created_at")))
    days = F.explode(F.sequence("date_from", "date_to", F.expr("INTERVAL 1 DAY"))).alias("event_date")
    g = golden.select("expected_event_id", "target_id", days, "keywords", "source_types", "expected_variables")
    plain = events.select("event_id", "target_id", "event_date", "summary", "source_type", "confidence").join(
        g, ["target_id", "event_date"]
    )
    no_words, no_types = F.size("keywords") == 0, F.size("source_types") == 0
    candidates = plain.where(
        (no_words | F.exists("keywords", lambda w: F.contains(ascii_lower(F.col("summary")), ascii_lower(w))))
        & (no_types | F.array_contains("source_types", F.col("source_type")))
    )
    linked = candidates.join(links.select("event_id", "tracking_variable"), "event_id", "left")
    any_variable = F.size("expected_variables") == 0
    best = (
        linked.where(any_variable | F.array_contains("expected_variables", F.col("tracking_variable")))
        .groupBy("expected_event_id")
        .agg(F.max(F.struct("confidence", (-F.col("event_id")).alias("_n"), "event_id")).alias("_b"))
        .select("expected_event_id", F.col("_b.event_id").alias("matched_event_id"))
    )
    return golden.join(best, "expected_event_id", "left").withColumn("matched", F.col("matched_event_id").isNotNull())


def golden_missed(matches: DataFrame) -> DataFrame:
    """Expected events that nothing collected matches."""
    return matches.where(~F.col("matched")).select("expected_event_id", "target_id")


def golden_runs(matches: DataFrame, run: Sequence[str]) -> DataFrame:
    """One row per evaluation run: counts, recall and what was missed, with an id made of the run and its outcome.

    The missed ids of a run are as many as its golden list has entries.
    """
    counts = matches.groupBy(*run).agg(
        F.count("*").alias("expected_count"),
        F.count_if("matched").alias("matched_count"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("matched"), F.col("expected_event_id")))), ",").alias("missed"),
    )
    counts = counts.withColumn("recall", ratio_or_null(F.col("matched_count"), F.col("expected_count")))
    return counts.withColumn("run_id", F.concat(F.lit("golden_run_"), F.sha2(F.to_json(F.struct(*counts.columns)), 256)))


def golden_recall(matches: DataFrame) -> DataFrame:
    return matches.agg(
        F.count("*").alias("expected_count"),
        F.count_if("matched").alias("matched_count"),
        ratio_or_null(F.count_if("matched"), F.count("*")).alias("recall"),
    )


def layer_suggestion(hk_eligible: Column, expected: Column, covered: Column, negatives: Column, high_gaps: Column) -> Column:
    """Maintenance hint of a research card, first matching rule."""
    return (
        F.when(~hk_eligible, "hk_not_connect_eligible_verify_before_inclusion")
        .when((expected > 0) & (covered / expected < 0.2), "keep_watch_or_reduce_budget_until_coverage_improves")
        .when(negatives >= 3, "review_for_downgrade_or_risk_watch")
        .when(high_gaps >= 3, "needs_followup_before_upgrade")
        .otherwise("keep_current_layer")
    )


def research_cards(targets: DataFrame, events: DataFrame, links: DataFrame, gaps: DataFrame, hk: DataFrame, since: str) -> DataFrame:
    """One card per target: covered and missing variables, evidence counts and the layer hint.

    Every input is reduced to one row per target before the joins.
    """
    recent = events.where(F.col("event_date") >= F.lit(since).cast("date"))
    accepted = links.where(F.col("review_status") == "accepted").select("event_id", "tracking_variable")
    covered = (
        recent.select("event_id", "target_id")
        .join(accepted, "event_id")
        .groupBy("target_id")
        .agg(F.array_sort(F.collect_set("tracking_variable")).alias("covered_variables"))
    )
    evidence = recent.groupBy("target_id").agg(
        F.count_if(F.col("direction").startswith("positive")).alias("positive_events"),
        F.count_if(F.col("direction").startswith("negative")).alias("negative_events"),
        F.max(F.struct(F.coalesce("confidence", F.lit(0.0)), "created_at", "event_id"))["event_id"].alias("top_event_id"),
    )
    open_gaps = gaps.where(F.col("status") == "open").groupBy("target_id").agg(
        F.count("*").alias("open_gaps"), F.count_if(F.col("priority") == "high").alias("high_gaps")
    )
    latest_hk = latest_by_key(hk.select("target_id", "as_of", "hk_connect_eligible"), ["target_id"], ["as_of"])
    cards = targets.select("target_id", "tracking_variables")
    for part in (covered, evidence, open_gaps, latest_hk.drop("as_of")):
        cards = cards.join(part, "target_id", "left")
    none = F.array().cast("array<string>")
    cards = cards.withColumn("covered_variables", F.coalesce("covered_variables", none)).fillna(
        0, subset=["positive_events", "negative_events", "open_gaps", "high_gaps"]
    )
    expected, done = F.size("tracking_variables"), F.size("covered_variables")
    return (
        cards.withColumn("missing_variables", F.array_except("tracking_variables", "covered_variables"))
        .withColumn("coverage_ratio", ratio_or_null(done, expected))
        .withColumn(
            "pool_layer_suggestion",
            layer_suggestion(
                F.coalesce("hk_connect_eligible", F.lit(True)), expected, done,
                F.least(F.col("negative_events"), F.lit(8)), F.col("high_gaps"),
            ),
        )
    )


def card_summary(cards: DataFrame, as_of: Column) -> DataFrame:
    """Fresh, stale and low-coverage card counts."""
    stale = F.col("as_of") < as_of
    return cards.agg(
        F.count("*").alias("cards_total"),
        F.count_if(~stale).alias("fresh_cards"),
        F.count_if(stale).alias("stale_cards"),
        F.count_if(F.col("coverage_ratio") < fixed.LOW_COVERAGE_CARD).alias("low_coverage_cards"),
    )


def weighted_health(parts: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted mean of the parts that are not null, null when none is."""
    table = weights or fixed.HEALTH_WEIGHTS
    total = sum((F.when(v.isNotNull(), F.lit(table[n])).otherwise(0.0) for n, v in parts.items()), F.lit(0.0))
    score = sum((F.coalesce(v, F.lit(0.0)) * table[n] for n, v in parts.items()), F.lit(0.0))
    return F.when(total > 0, round_half_up(score / total, 4))


def hk_completeness(snapshots: DataFrame, fields: Sequence[str] = fixed.HK_FIELDS) -> DataFrame:
    """Filled share of the required snapshot fields, and the names of the missing ones."""
    missing = F.filter(F.array(*[F.when(F.col(f).isNull(), F.lit(f)) for f in fields]), lambda m: m.isNotNull())
    return snapshots.withColumn("missing_fields", missing).withColumn(
        "completeness", round_half_up((len(fields) - F.size("missing_fields")) / F.lit(float(len(fields))), 4)
    )


def hk_snapshots(components: DataFrame | None, holdings: DataFrame, as_of: str) -> DataFrame:
    """Connect snapshot per ticker: component quote with the latest holding row not after ``as_of``.

    Without a component list a holding row alone implies eligibility and carries the price.
    """
    usable = holdings.where(F.col("holding_date") <= F.lit(as_of).cast("date"))
    latest = latest_by_key(usable, ["ticker"], ["holding_date"])
    carried = [c for c in latest.columns if c not in ("ticker", "holding_date", "close_price")]
    if components is None:
        return latest.select(
            "ticker", F.lit(True).alias("hk_connect_eligible"), F.col("close_price").alias("last_price_hkd"),
            F.lit(None).cast("double").alias("turnover_hkd"), *carried,
        )
    listed = components.select("ticker", "last_price", "turnover", F.lit(True).alias("_listed"))
    return listed.join(latest, "ticker", "full_outer").select(
        "ticker",
        F.coalesce("_listed", F.lit(False)).alias("hk_connect_eligible"),
        F.when(F.col("_listed"), F.col("last_price")).otherwise(F.col("close_price")).alias("last_price_hkd"),
        F.col("turnover").alias("turnover_hkd"),
        *carried,
    )


def run_quality(events: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """Research issues of a collection run: missing URLs, undated confident events, weak sources, coverage."""
    source_type = F.coalesce("source_type", F.lit(""))
    per_run = events.groupBy("run_id").agg(
        F.count("*").alias("events"),
        F.bool_and(F.coalesce("source_url", F.lit("")) == "").alias("events_missing_source_url"),
        F.bool_or((F.coalesce("confidence", F.lit(0.0)) >= fixed.HIGH_CONFIDENCE) & F.col("published_at").isNull()).alias(
            "high_confidence_missing_published_at"
        ),
        F.bool_and(source_type.isin(fixed.WEAK_SOURCES)).alias("low_authority_sources_only"),
        F.collect_set("tracking_variable").alias("_covered"),
    )
    if targets is None:
        return per_run.drop("_covered")
    rows = per_run.join(targets.select("run_id", "tracking_variables", "priority"), "run_id", "right")
    expected = F.size("tracking_variables")
    missing = F.size(F.array_except("tracking_variables", F.coalesce("_covered", F.array().cast("array<string>"))))
    some = F.coalesce("events", F.lit(0)) > 0
    rows = (
        rows.withColumn("events", F.coalesce("events", F.lit(0)))
        .withColumn("high_priority_zero_events", ~some & F.col("priority").isin("high", "urgent"))
        .withColumn("zero_tracking_variable_coverage", some & (expected > 0) & (missing == expected))
        .withColumn(
            "low_tracking_variable_coverage",
            some & (expected > 0) & (missing < expected) & (missing / expected >= fixed.LOW_VARIABLE_MISSING_RATIO),
        )
        .drop("_covered", "tracking_variables", "priority")
        .fillna(False)
    )
    medium = [
        "events_missing_source_url", "high_confidence_missing_published_at", "low_authority_sources_only",
        "high_priority_zero_events", "zero_tracking_variable_coverage",
    ]
    degraded = F.array_contains(F.array(*medium), True)
    return rows.withColumn("decision", F.when(degraded, "accept_degraded").otherwise("accept")).withColumn(
        "severity", F.when(degraded, "P2").otherwise("P3")
    )
