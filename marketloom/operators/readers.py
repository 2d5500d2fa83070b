"""Analyst readers and operational reports over collected tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions.numbers import any_contains
from marketloom.functions.text import ascii_lower


def recent_events(
    events: DataFrame,
    targets: Sequence | None = None,
    event_types: Sequence[str] | None = None,
    min_confidence: float | None = None,
    since: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Events by target, type, confidence and date, newest first."""
    found = events
    if targets is not None:
        found = found.where(F.col("target_id").isin(list(targets)))
    if event_types:
        found = found.where(F.col("event_type").isin(list(event_types)))
    if min_confidence is not None:
        found = found.where(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    if since:
        found = found.where(F.coalesce("event_date", F.to_date("created_at")) >= F.lit(since).cast("date"))
    if limit is None:
        return found
    return found.orderBy(F.desc("event_date"), F.desc("created_at"), F.desc("event_id")).limit(limit)


def matching_text(rows: DataFrame, text: str, query: str) -> DataFrame:
    """Rows whose text holds any whitespace-separated term; no term matches nothing."""
    return rows.where(any_contains(F.col(text), query.split()))


def of_target(rows: DataFrame, target, since: str | None = None, **wanted: Sequence | None) -> DataFrame:
    """Rows of one target created at or after a time whose named columns have wanted values; no wanted values, no filter."""
    found = rows.where(F.col("target_id") == target)
    if since:
        found = found.where(F.col("created_at") >= F.lit(since).cast(rows.schema["created_at"].dataType))
    for name, values in wanted.items():
        if values:
            found = found.where(F.col(name).isin(list(values)))
    return found


def target_facts(
    facts: DataFrame, target, query: str | None = None, fact_types: Sequence[str] | None = None, since: str | None = None
) -> DataFrame:
    """Facts of a target by type, time and search terms, most confident first; a query whose terms match nothing gives no rows."""
    found = of_target(facts, target, since, fact_type=fact_types)
    if query:
        found = matching_text(found, "fact_statement", query)
    return found.orderBy(F.desc("confidence"))


def target_metrics(metrics: DataFrame, target, names: Sequence[str] | None = None, since: str | None = None) -> DataFrame:
    """Metric observations of a target, newest first."""
    return of_target(metrics, target, since, metric_name=names).orderBy(F.desc("created_at"))


def target_risks(risks: DataFrame, target, since: str | None = None, severity: Sequence[str] | None = None) -> DataFrame:
    """Risk flags of a target, most confident first."""
    return of_target(risks, target, since, severity=severity).orderBy(F.desc("confidence"))


def target_catalysts(catalysts: DataFrame, target, date_from: str | None = None, date_until: str | None = None) -> DataFrame:
    """Catalysts of a target expected within an inclusive date range, earliest first."""
    found = of_target(catalysts, target)
    if date_from:
        found = found.where(F.col("expected_date") >= F.lit(date_from).cast("date"))
    if date_until:
        found = found.where(F.col("expected_date") <= F.lit(date_until).cast("date"))
    return found.orderBy("expected_date")


def target_work(rows: DataFrame, target, priority: str | None = None, status: str | None = None) -> DataFrame:
    """Analyst questions or coverage gaps of a target, newest first."""
    found = of_target(rows, target, priority=[priority] if priority else None, status=[status] if status else None)
    return found.orderBy(F.desc("created_at"))


def notes(rows: DataFrame, text: str, query: str, kind: str | None, newest: str, limit: int) -> DataFrame:
    """Notes that contain the query, of one type, newest first."""
    found = rows.where(F.contains(ascii_lower(F.col(text)), ascii_lower(F.lit(query))))
    if kind:
        found = found.where(F.col("kind") == kind)
    return found.orderBy(F.desc(newest)).limit(limit)


def top_events(events: DataFrame, limit: int = 10) -> DataFrame:
    return events.orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), F.desc("created_at"), F.desc("event_id")).limit(limit)


def top_features(features: DataFrame, limit: int = 10) -> DataFrame:
    order = [F.desc(F.coalesce("abnormality_score", F.lit(0.0))), F.col("ticker"), F.col("bucket_start")]
    return features.orderBy(*order).limit(limit)


def priority_order(level: Column, levels: Sequence[str]) -> Column:
    """Rank of a level in a list; levels outside it come last."""
    rank = F.lit(len(levels))
    for position, name in reversed(list(enumerate(levels))):
        rank = F.when(level == name, position).otherwise(rank)
    return rank


def open_by_priority(rows: DataFrame, level: str, levels: Sequence[str], newest: str, tie: str, limit: int) -> DataFrame:
    """Open rows by priority rank, then newest."""
    ranked = rows.withColumn("rank", priority_order(F.col(level), levels))
    return ranked.orderBy("rank", F.desc(newest), F.desc(tie)).limit(limit)


def look_up(rows: DataFrame, **wanted) -> DataFrame:
    """Rows whose columns have the wanted values: one value, a list of values, or an inclusive (first, last) range.

    Every condition is a plain comparison, so the filters reach the scan.
    """
    found = rows
    for name, value in wanted.items():
        if isinstance(value, tuple):
            first, last = (F.lit(v).cast(rows.schema[name].dataType) for v in value)
            found = found.where(F.col(name).between(first, last))
        elif isinstance(value, list):
            found = found.where(F.col(name).isin(value))
        else:
            found = found.where(F.col(name) == F.lit(value).cast(rows.schema[name].dataType))
    return found


def newest(rows: DataFrame, order: Sequence[str], limit: int, **wanted) -> DataFrame:
    """Newest rows with the wanted values; a column without one does not restrict."""
    found = look_up(rows, **{name: value for name, value in wanted.items() if value is not None})
    return found.orderBy(*[F.desc(c) for c in order]).limit(limit)


def links_of_run(links: DataFrame, run, decision: str | None, limit: int) -> DataFrame:
    """Best scored links of a run, of one decision or of all."""
    return newest(links, ["triage_score", "link_id"], limit, run_id=run, triage_decision=decision)


def report_sections(rows: DataFrame, start: str, end: str, counts: dict[str, Column], lists: dict[str, tuple[Column, Column, Column, int]]) -> DataFrame:
    """Sections of a report over the rows created in [start, end): numbers by group, and best rows.

    ``counts`` has the group of a section's rows, null for rows that do not belong to it. ``lists`` has for each section
    which rows belong, their rank (descending), the text to show and how many; ties go to the newest row, then to the
    greatest text. A row is read once for all counts and once for all lists. Returns section, position (null for
    numbers), item and rows.
    """
    kind = rows.schema["created_at"].dataType
    of_day = rows.where((F.col("created_at") >= F.lit(start).cast(kind)) & (F.col("created_at") < F.lit(end).cast(kind)))
    groups = F.array(*[F.struct(F.lit(name).alias("section"), key.cast("string").alias("item")) for name, key in counts.items()])
    counted = of_day.select(F.explode(groups).alias("_g")).select("_g.*").where("item is not null").groupBy("section", "item").agg(F.count("*").alias("rows"))
    parts = [
        F.struct(F.lit(name).alias("section"), F.when(belongs, F.coalesce(rank.cast("double"), F.lit(0.0))).alias("rank"), text.alias("item"), F.lit(limit).alias("limit"))
        for name, (belongs, rank, text, limit) in lists.items()
    ]
    listed = of_day.select("created_at", F.explode(F.array(*parts)).alias("_l")).select("created_at", "_l.*").where("rank is not null")
    best = Window.partitionBy("section").orderBy(F.desc("rank"), F.desc("created_at"), F.desc("item"))
    most = max((limit for *_, limit in lists.values()), default=0)
    top = listed.withColumn("position", F.row_number().over(best)).where(F.col("position") <= most).where(F.col("position") <= F.col("limit"))
    numbers = counted.select("section", F.lit(None).cast("int").alias("position"), "item", "rows")
    return numbers.unionByName(top.select("section", "position", "item", F.lit(None).cast("long").alias("rows")))


def counts_by(rows: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Row counts for several independent dimensions in one grouping-sets pass."""
    named = rows.select(*[F.coalesce(c.cast("string"), F.lit("unknown")).alias(n) for n, c in dimensions.items()])
    names = list(dimensions)
    label = F.concat(*[F.when(F.grouping(n) == 0, F.lit(n)).otherwise("") for n in names])
    counted = named.groupingSets([[n] for n in names], *names).agg(label.alias("dimension"), F.count("*").alias("rows"))
    return counted.select("dimension", F.coalesce(*names).alias("group_key"), "rows")


def daily_report(sections: dict[str, tuple[DataFrame, Column]], day_from: str, day_until: str) -> DataFrame:
    """Row counts of one local day per section and group, as long rows.

    Each section names a table with a ``created_at`` time and the column to group by. The day is a UTC
    half-open range, so the filter reaches every scan.
    """
    out = None
    for name, (rows, key) in sections.items():
        kind = rows.schema["created_at"].dataType
        start, end = F.lit(day_from).cast(kind), F.lit(day_until).cast(kind)
        of_day = rows.where((F.col("created_at") >= start) & (F.col("created_at") < end))
        counted = of_day.groupBy(F.coalesce(key.cast("string"), F.lit("unknown")).alias("group_key")).agg(F.count("*").alias("rows"))
        part = counted.select(F.lit(name).alias("section"), "group_key", "rows")
        out = part if out is None else out.unionByName(part)
    return out


def demand_coverage(demands: DataFrame, tasks: DataFrame) -> DataFrame:
    """Planned, done, failed and open tasks of every demand; demands without tasks count zero."""
    counts = tasks.groupBy("demand_id").agg(
        F.count("*").alias("tasks_planned"),
        F.count_if(F.col("status") == "done").alias("tasks_done"),
        F.count_if(F.col("status") == "failed").alias("tasks_failed"),
        F.count_if(F.col("status").isin("open", "in_progress")).alias("tasks_open"),
    )
    names = ["tasks_planned", "tasks_done", "tasks_failed", "tasks_open"]
    return demands.join(counts, "demand_id", "left").fillna(0, subset=names)


def cost_usage(runs: DataFrame, fields: dict[str, str], groups: Sequence[str]) -> DataFrame:
    """Call counts and summed JSON integers by tool, operation or status; bad integers count zero."""
    sums = [
        F.coalesce(F.sum(F.get_json_object("quality", path).try_cast("bigint")), F.lit(0)).alias(name)
        for name, path in fields.items()
    ]
    return runs.groupBy(*groups).agg(F.count("*").alias("calls"), *sums)


def table_summary(bars: DataFrame, group: Sequence[str]) -> DataFrame:
    """Rows, distinct trading days and date range."""
    return bars.groupBy(*group).agg(
        F.count("*").alias("rows"),
        F.count_distinct("trade_date").alias("trading_days"),
        F.min("trade_date").alias("first_day"),
        F.max("trade_date").alias("last_day"),
    )


def liveness_report(beats: DataFrame, key: str, moment: str, now: Column, classify) -> DataFrame:
    """Newest heartbeat age and liveness class per worker."""
    age = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp("last_seen"))
    newest = beats.groupBy(key).agg(F.max(moment).alias("last_seen")).withColumn("age_seconds", age)
    return newest.withColumn("liveness", classify(F.col("age_seconds")))
