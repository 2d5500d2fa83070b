"""Cross-provider comparison, merging and quality scoring of canonical records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions.numbers import clamp01, lookup, relative_diff
from marketloom.functions.text import compare_form
from marketloom.operators.hotkeys import dealt, explode_computed, first_by_key

_CATEGORY = {name: kind for kind, names in fixed.FIELDS_BY_CATEGORY.items() for name in names}


def category(field: str) -> str:
    return _CATEGORY.get(field, "generic")


def severity(field: str, ours: Column, theirs: Column, forms: tuple[Column, Column] | None = None, tolerances: dict | None = None) -> Column:
    """Conflict severity of one field of two providers; null when they agree or either is absent.

    ``forms`` are the precomputed comparison forms of a free-text field.
    """
    kind = category(field)
    critical = field in fixed.CRITICAL_FIELDS
    if kind == "status":
        level = "critical" if field in fixed.ALWAYS_CRITICAL_STATUS else "high" if critical else "medium"
        return F.when(ours != theirs, level)
    if kind == "generic":
        a, b = forms or (compare_form(ours.cast("string")), compare_form(theirs.cast("string")))
        return F.when(a != b, "medium" if critical else "low")
    a, b = ours.try_cast("double"), theirs.try_cast("double")
    limits = {**fixed.TOLERANCES[kind], **(tolerances or {}).get(kind, {})}
    gap = relative_diff(a, b)
    within = F.lit(False)
    if "absolute" in limits:
        within = within | (F.abs(a - b) <= limits["absolute"])
    if "relative" in limits:
        within = within | (gap <= limits["relative"])
    level = F.lit("high" if critical else "medium")
    if field in ("close", "adj_factor"):
        level = F.when(gap > fixed.CLOSE_OR_FACTOR_CRITICAL_RELATIVE, "critical").otherwise(level)
    if kind == "amount":
        level = F.when(gap > fixed.AMOUNT_CRITICAL_RELATIVE, "critical").otherwise(level)
    unreadable = a.isNull() != b.isNull()
    return F.when(unreadable, "medium").when(~within, level)


def _filled(value: Column) -> Column:
    text = value.cast("string")
    return value.isNotNull() & (text != "") & (text != "NaN")


def meet(
    records: DataFrame, canonical: str, fields: Sequence[str], whitelist: Sequence[str] = (), tolerances: dict | None = None,
    rows_per_task: int | None = None,
) -> DataFrame:
    """One row per comparison key on which all providers of a record meet.

    Rows are first reduced to one per key and provider, so the array gathered per key is as long as
    there are providers. The base is the canonical provider's row, or the first provider by name
    where that is missing. Empty whitelisted base fields are filled from the first supplement that has
    them. ``checks`` holds one entry per supplement and field both sides filled.

    With ``rows_per_task`` the records are counted and dealt to tasks of about that many, in which all of a key is
    gathered; else it is gathered in the session's number of shuffle partitions, whose sorts grow with the table.
    """
    free_text = [f for f in fields if category(f) == "generic"]
    prepared = records.withColumns({f"_form_{f}": compare_form(F.col(f).cast("string")) for f in free_text})
    if rows_per_task:  # after the forms, as Spark forgets how rows are dealt when they pass through Python
        prepared = dealt(prepared, "comparison_key", rows_per_task)
    once = first_by_key(prepared, ["comparison_key", "provider"], ["record_id"])
    cell = F.struct(*[F.col(c) for c in once.columns])
    by_provider = F.array_sort("_rows", lambda x, y: F.when(x["provider"] < y["provider"], -1).otherwise(1))
    rows = (
        once.groupBy("comparison_key")
        .agg(F.collect_list(cell).alias("_rows"))
        .withColumn("_rows", by_provider)
        .withColumn("_own", F.filter("_rows", lambda x: x["provider"] == canonical))
        .withColumn("_base", F.coalesce(F.try_element_at("_own", F.lit(1)), F.element_at("_rows", 1)))
        .withColumn("_others", F.filter("_rows", lambda x: x["provider"] != F.col("_base.provider")))
        .withColumn("has_canonical", F.size("_own") > 0)
    )
    fillable = [f for f in whitelist if f in records.columns]

    def donor(f: str) -> Column:
        return F.try_element_at(F.filter("_others", lambda x: _filled(x[f])), F.lit(1))

    wanted = {f: F.when(F.col("has_canonical") & ~F.coalesce(_filled(F.col(f"_base.{f}")), F.lit(False)), donor(f)) for f in fillable}
    rows = rows.withColumns({f"_donor_{f}": c for f, c in wanted.items()})
    # A filled free text brings its comparison form along.
    filler = {**{f: f for f in fillable}, **{f"_form_{f}": f for f in fillable if f in free_text}}
    flags = F.filter(
        F.array(*[F.when(F.col(f"_donor_{f}").isNotNull(), F.struct(F.lit(f).alias("field"), F.col(f"_donor_{f}.provider"))) for f in fillable]),
        lambda e: e.isNotNull(),
    ) if fillable else F.array().cast("array<struct<field:string,provider:string>>")
    rows = rows.select(
        *[
            F.coalesce(F.col(f"_donor_{filler[c]}.{c}"), F.col(f"_base.{c}")).alias(c) if c in filler else F.col(f"_base.{c}")
            for c in once.columns
        ],
        "has_canonical",
        "_others",
        flags.alias("supplement_flags"),
    )

    def entries(other: Column) -> Column:
        estimated = F.contains(F.concat_ws("|", F.col("source_api"), other["source_api"]), F.lit(fixed.ESTIMATED_AMOUNT_API))

        def entry(f: str) -> Column:
            usable = _filled(F.col(f)) & _filled(other[f])
            if f in ("amount", "vwap"):
                usable = usable & ~estimated
            forms = (F.col(f"_form_{f}"), other[f"_form_{f}"]) if f in free_text else None
            found = F.struct(
                other["provider"].alias("other_provider"),
                other["record_id"].alias("other_record_id"),
                F.lit(f).alias("field_name"),
                F.col(f).cast("string").alias("canonical_value"),
                other[f].cast("string").alias("other_value"),
                severity(f, F.col(f), other[f], forms, tolerances).alias("severity"),
            )
            return F.when(usable, found)

        return F.filter(F.array(*[entry(f) for f in fields]), lambda e: e.isNotNull())

    return (
        rows.withColumn("checks", F.flatten(F.transform("_others", entries)))
        .withColumn("supplements", F.transform("_others", lambda x: x["provider"]))
        .drop("_others", *[f"_form_{f}" for f in free_text])
    )


def conflicts(met: DataFrame) -> DataFrame:
    """One row per conflicting field and other provider."""
    clashes = F.filter("checks", lambda c: c["severity"].isNotNull())
    base = met.withColumnRenamed("provider", "canonical_provider").withColumnRenamed("record_id", "canonical_record_id")
    return explode_computed(base, clashes, "_c").select(
        "comparison_key", "canonical_provider", "canonical_record_id", "has_canonical", "_c.*"
    )


def comparison_results(met: DataFrame) -> DataFrame:
    """One row per (key, other provider) with a canonical row: checked, matched and conflicted field counts."""
    pairs = met.where("has_canonical").withColumn("other_provider", F.explode("supplements"))
    mine = F.filter("checks", lambda c: c["other_provider"] == F.col("other_provider"))
    rows = pairs.select("comparison_key", F.col("provider").alias("canonical_provider"), "other_provider", mine.alias("_m"))
    bad = F.size(F.filter("_m", lambda c: c["severity"].isNotNull()))
    return rows.select(
        "comparison_key",
        "canonical_provider",
        "other_provider",
        F.size("_m").alias("checked_fields"),
        (F.size("_m") - bad).alias("matched_fields"),
        bad.alias("conflicted_fields"),
        F.when(bad == 0, "matched").otherwise("conflicted").alias("status"),
    )


def severity_rank(level: Column) -> Column:
    return lookup(level, fixed.SEVERITY_RANK)


def merge(met: DataFrame, quarantine: bool = True) -> DataFrame:
    """Merge method, validation status and suspicion of every key on which providers met.

    The canonical value is never replaced. It is suspect when two or more supplements all carry one
    other value on a field in conflict.
    """
    count = F.size("supplements")
    ranks = F.transform("checks", lambda c: severity_rank(c["severity"]))
    clashing = F.array_distinct(
        F.transform(F.filter("checks", lambda c: c["severity"].isNotNull()), lambda c: c["field_name"])
    )

    def outvoted(name: Column) -> Column:
        votes = F.filter("checks", lambda c: c["field_name"] == name)
        values = F.array_distinct(F.transform(votes, lambda c: c["other_value"]))
        return (F.size(votes) == count) & (F.size(values) == 1) & (values[0] != votes[0]["canonical_value"])

    rows = met.withColumn("worst", F.array_max(ranks)).withColumn("_clashing", clashing)
    bad, own, worst = F.col("worst").isNotNull(), F.col("has_canonical"), F.col("worst")
    method = (
        F.when(~own & (count == 0), "fallback_single_source")
        .when(~own & ~bad, "fallback_multi_source_agreed")
        .when(~own, "manual_review_required")
        .when(count == 0, "canonical_only")
        .when(~bad & (F.size("supplement_flags") > 0), "fill_missing_from_supplement")
        .when(~bad, "canonical_validated")
        .when((worst >= 3) & F.lit(quarantine), "quarantined_due_to_conflict")
        .when(worst >= 3, "manual_review_required")
        .otherwise("canonical_with_warning")
    )
    named = F.col("merge_method")
    status = (
        F.when(named.isin("fallback_single_source", "canonical_only", "fill_missing_from_supplement"), "validated_with_warning")
        .when(named.isin("fallback_multi_source_agreed", "canonical_validated"), "validated")
        .when(named == "quarantined_due_to_conflict", "quarantined")
        .when(named == "manual_review_required", "manual_review_required")
        .when(worst == 2, "conflicted_medium")
        .otherwise("conflicted_low")
    )
    suspect = own & (count >= 2) & F.exists("_clashing", outvoted)
    return (
        rows.withColumn("merge_method", method)
        .withColumn("validation_status", status)
        .withColumn("canonical_value_suspect", suspect)
        .drop("_clashing")
    )


def append_provider_specific(records: DataFrame) -> DataFrame:
    """Record types whose methodology differs by provider keep every provider's rows."""
    return (
        records.withColumn("source_role", F.lit("provider_specific"))
        .withColumn("merge_method", F.lit("provider_specific_append"))
        .withColumn("validation_status", F.lit("validated_with_warning"))
    )


def quality_score(
    provider: Column,
    filled: Column,
    required: int,
    worst: Column,
    conflict_adjustment: Column,
    method: Column,
    has_provenance: Column,
    has_raw_ref: Column,
    reliability: dict[str, float] | None = None,
) -> Column:
    """Weighted data quality in [0, 1], adjusted for merge method, conflicts and lineage."""
    weight = fixed.QUALITY_WEIGHTS
    by_rank = {rank: fixed.CONSISTENCY_BY_SEVERITY[name] for name, rank in fixed.SEVERITY_RANK.items()}
    consistency = lookup(worst, by_rank, F.lit(1.0))
    traced = F.when(has_provenance, 1.0).otherwise(0.0)
    provenance = F.when(has_raw_ref, traced).otherwise(F.least(traced, F.lit(fixed.UNTRACED_PROVENANCE_CAP)))
    trust = lookup(provider, reliability or fixed.PROVIDER_RELIABILITY, F.lit(fixed.UNKNOWN_RELIABILITY))
    base = (
        weight["completeness"] * (filled / max(1, required))
        + weight["consistency"] * consistency
        + F.lit(weight["timeliness"])
        + weight["reliability"] * trust
        + weight["anomaly"] * F.when(consistency >= 0.7, 1.0).otherwise(0.5)
        + weight["provenance"] * provenance
    )
    return clamp01(
        clamp01(base)
        + lookup(method, fixed.MERGE_ADJUSTMENT, F.lit(0.0))
        + F.coalesce(conflict_adjustment, F.lit(0.0))
        + F.when(has_raw_ref, 0.0).otherwise(fixed.MISSING_RAW_REF_ADJUSTMENT)
        + F.when(has_provenance, 0.0).otherwise(fixed.MISSING_PROVENANCE_ADJUSTMENT)
    )


def rescore(merged: DataFrame, record_type: str) -> DataFrame:
    """Data quality of merged rows from their own conflicts, after merging."""
    penalties = F.transform("checks", lambda c: lookup(c["severity"], fixed.CONFLICT_ADJUSTMENT, F.lit(0.0)).cast("decimal(10,2)"))
    penalty = F.aggregate(penalties, F.lit(0).cast("decimal(12,2)"), lambda acc, p: (acc + p).cast("decimal(12,2)")).cast("double")
    required = [f for f in fixed.REQUIRED_FIELDS[record_type] if f in merged.columns]
    filled = sum((F.col(f).isNotNull().cast("int") for f in required), F.lit(0))
    score = quality_score(
        F.col("provider"), filled, len(required), F.col("worst"), penalty, F.col("merge_method"),
        F.coalesce(F.col("has_provenance"), F.lit(False)), F.col("raw_payload_ref").isNotNull(),
    )
    return merged.withColumn("data_quality", score)


def quality_report(scored: DataFrame) -> DataFrame:
    """One row for a run: mean quality, provenance share, consistency and anomaly."""
    traced = F.col("has_provenance") & F.col("raw_payload_ref").isNotNull()
    any_clash = F.coalesce(F.bool_or(F.col("worst").isNotNull()), F.lit(False))
    return scored.agg(
        F.count("*").alias("records"),
        (F.sum(F.col("data_quality").cast("decimal(20,10)")) / F.count("*")).cast("double").alias("data_quality_score"),
        F.avg(traced.cast("int")).alias("provenance_score"),
        F.when(any_clash, 0.0).otherwise(1.0).alias("consistency_score"),
        F.when(any_clash, 0.5).otherwise(1.0).alias("anomaly_score"),
    )


def response_status(fetches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """success / partial_success / failed per request from its fetch results."""
    blocking = F.col("error_code").isNotNull() & (F.col("error_code") != "EMPTY_RESULT")
    return (
        fetches.groupBy(*keys)
        .agg(
            F.sum("rows_fetched").alias("rows_fetched"),
            F.coalesce(F.bool_or(blocking), F.lit(False)).alias("_errors"),
            F.coalesce(F.bool_or(F.col("error_code").isNotNull()), F.lit(False)).alias("_any_error"),
            F.bool_or(F.col("status").isin("failed", "unavailable")).alias("_failed"),
        )
        .withColumn(
            "response_status",
            F.when((F.col("rows_fetched") == 0) & F.col("_any_error"), "failed")
            .when((F.col("rows_fetched") == 0) | F.col("_errors") | F.col("_failed"), "partial_success")
            .otherwise("success"),
        )
        .drop("_errors", "_any_error", "_failed")
    )


def quality_gate(has_critical: Column, has_high: Column, blocked: Column, below: Column, status: Column) -> Column:
    """Decision and severity of a stock data run, worst condition first."""

    def verdict(decision: str, level: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(level).alias("severity"))

    return (
        F.when(has_critical | blocked, verdict("quarantine", "P0"))
        .when(has_high, verdict("accept_with_review", "P1"))
        .when(below, verdict("accept_degraded", "P2"))
        .when(status == "partial_success", verdict("accept_degraded", "P2"))
        .when(status == "success", verdict("accept", "P3"))
        .otherwise(verdict("reject", "P1"))
    )
