"""Structured extractions: splitting, validation, weighting and merging of model outputs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions.numbers import any_contains, lookup, round_half_up
from marketloom.functions.text import norm
from marketloom.operators.hotkeys import first_by_key, weighted_median


def cap_items(items: Column, limit: int | None = None) -> Column:
    """The first items up to a limit, all without one; ``F.size`` of both tells what a limit leaves out."""
    return items if limit is None else F.slice(items, 1, limit)


def explode_objects(bundles: DataFrame, kind: str, keep: Sequence[str] = ("link_id",)) -> DataFrame:
    """One row per object of a bundle array, with its position and a content-derived id."""
    exploded = bundles.select(*keep, F.posexplode_outer(F.col(kind)).alias("position", "_o")).where("_o is not null")
    rows = exploded.select(*keep, "position", "_o.*")
    identity = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    return rows.withColumn("object_id", F.concat(F.lit(f"{kind}_"), identity))


def identity_key(entity_name: Column, ticker: Column) -> Column:
    """Entity identity: ticker wins over the spelling of the name."""
    by_name = F.concat(F.lit("name:"), norm(entity_name))
    return F.when(F.coalesce(ticker, F.lit("")) != "", F.concat(F.lit("ticker:"), norm(ticker))).otherwise(by_name)


def is_vague(entity_name: Column, ticker: Column) -> Column:
    """Collective names without a ticker identify no counterparty."""
    name = F.trim(F.coalesce(entity_name, F.lit("")))
    return (F.coalesce(ticker, F.lit("")) == "") & ((name == "") | any_contains(name, fixed.VAGUE_MARKERS))


def relation_type(text: Column) -> Column:
    """Relation type with supply and purchase phrasings normalised."""
    given = F.trim(F.coalesce(text, F.lit("")))
    supplies = F.contains(given, F.lit("向")) & F.contains(given, F.lit("供货"))
    buys = F.contains(given, F.lit("采购")) | F.contains(given, F.lit("从"))
    return F.when(supplies, "supplier_of").when(buys, "customer_of").otherwise(given)


def relation_type_error(kind: Column) -> Column:
    return F.when(~kind.isin(fixed.RELATION_TYPES), F.lit("relation_type_not_in_enum"))


def check_evidence(claims: DataFrame, passages: DataFrame) -> DataFrame:
    """Clear citations of unknown passages and discount claims their passage does not support.

    ``claims`` has link_id, passage_id, claimed (text, null when nothing is claimed) and confidence.
    A link without passages is left alone.
    """
    known = passages.select("link_id", "passage_id", F.col("text").alias("_text"), F.lit(True).alias("_known"))
    linked = passages.select("link_id").distinct().withColumn("_has", F.lit(True))
    rows = claims.join(known, ["link_id", "passage_id"], "left").join(linked, "link_id", "left")
    cited = F.coalesce(F.col("passage_id"), F.lit("")) != ""
    unknown = F.col("_has").isNotNull() & cited & F.col("_known").isNull()
    claim, stated = F.col("claimed"), F.coalesce("claimed", F.lit(""))
    # A decimal number counts as found without its trailing zeros too.
    short = F.when(claim.rlike(r"^-?\d+\.\d+$"), F.regexp_replace(claim, r"\.?0+$", "")).otherwise(claim)
    found = F.contains(F.col("_text"), claim) | F.contains(F.col("_text"), short)
    unsupported = F.col("_known").isNotNull() & ~stated.isin("", "0", "0.0") & ~found
    confidence = F.col("confidence")
    lowered = (
        F.when(unknown & (confidence > fixed.UNKNOWN_PASSAGE_FLOOR), round_half_up(confidence * fixed.UNKNOWN_PASSAGE_FACTOR, 3))
        .when(unsupported & (confidence > fixed.UNSUPPORTED_FLOOR), round_half_up(confidence * fixed.UNSUPPORTED_FACTOR, 3))
        .otherwise(confidence)
    )
    warning = F.when(unknown, "passage_id_cleared").when(unsupported, "value_not_in_passage")
    return (
        rows.withColumn("evidence_warning", warning)
        .withColumn("confidence", lowered)
        .withColumn("passage_id", F.when(~unknown, F.col("passage_id")))
        .drop("_text", "_known", "_has")
    )


def effective_weights(contributions: DataFrame) -> DataFrame:
    """Weight of every model contribution, discounted when its provider family repeats on the link."""
    family = lookup(F.col("provider"), fixed.PROVIDER_FAMILY, F.col("provider"))
    rows = contributions.withColumn("family", family)
    counts = rows.groupBy("link_id", "family").agg(F.count("*").alias("_n"))
    independence = F.when(F.col("_n") == 1, 1.0).otherwise(fixed.CORRELATED_DISCOUNT)
    weight = (
        F.col("configured_weight")
        * F.col("task_weight")
        * F.col("schema_score")
        * F.col("evidence_score")
        * F.greatest(F.col("confidence"), F.lit(fixed.MIN_CONFIDENCE))
        * F.col("feedback_score")
        * independence
    )
    return rows.join(counts, ["link_id", "family"]).withColumn("effective_weight", weight).drop("_n")


def vote(weighted: DataFrame) -> DataFrame:
    """Weighted decision vote per link, with decision spread facts for the disagreement level."""
    weight = F.col("effective_weight").cast("decimal(28,12)")
    value = lookup(F.col("decision"), fixed.DECISION_VALUES, F.lit(0.0)).cast("decimal(4,2)")
    totals = weighted.groupBy("link_id").agg(
        (F.sum(weight * value).cast("double") / F.nullif(F.sum(weight).cast("double"), F.lit(0.0))).alias("_score"),
        F.count("*").alias("contributions"),
        F.count_distinct("decision").alias("decisions"),
        (F.max("confidence") - F.min("confidence")).alias("confidence_spread"),
    )
    score = F.coalesce("_score", F.lit(0.0))
    return totals.withColumn("decision_score", round_half_up(score, 6)).withColumn(
        "decision",
        F.when(score >= fixed.SAVE_SCORE, "save_structured").when(score >= fixed.LINK_SCORE, "link_only").otherwise("skip"),
    ).drop("_score")


def _medians(weighted: DataFrame, keys: Sequence[str], blocks: dict[str, Column]) -> DataFrame:
    """Lower weighted medians of several columns at once, as one column each.

    The columns become rows under a metric key, so the contributions are read once for all of them.
    """
    points = F.array(
        *[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value"), b.cast("long").alias("_cell")) for n, b in blocks.items()]
    )
    long = weighted.select(*keys, "effective_weight", F.explode(points).alias("_p")).select(*keys, "effective_weight", "_p.*")
    found = weighted_median(long, [*keys, "metric"], "value", "effective_weight", F.col("_cell"))
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in blocks])


def merge_scores(weighted: DataFrame) -> DataFrame:
    """Lower weighted medians of overall score and confidence per link."""
    blocks = {"overall_score": F.floor("overall_score"), "confidence": F.floor(F.col("confidence") * 20)}
    return (
        _medians(weighted, ["link_id"], blocks)
        .withColumn("overall_score", round_half_up(F.col("overall_score"), 1))
        .withColumn("confidence", round_half_up(F.col("confidence"), 3))
    )


def decision_gate(decision: Column, overall: Column) -> Column:
    """A structured save needs the minimum overall score, else it is demoted to a link."""
    demoted = (decision == "save_structured") & (overall < fixed.SAVE_OVERALL)
    return F.when(demoted, "link_only").otherwise(decision)


def kept_items(decision: Column, items: Column, limit: int | None = None) -> Column:
    """Structured items of a bundle, up to a limit if there is one; a link-only result carries none."""
    return F.when(decision == "link_only", F.slice(items, 1, 0)).otherwise(cap_items(items, limit))


def keep_most_confident(objects: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Most confident object per key; the earliest wins ties."""
    negated = objects.withColumn("_neg", -F.col("confidence"))
    return first_by_key(negated, keys, ["_neg", *order]).drop("_neg")


def keep_first(objects: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Earliest object per key."""
    return first_by_key(objects, keys, order)


def cluster_events(events: DataFrame) -> DataFrame:
    """Events of a link clustered by type and counterparty.

    ``events`` has link_id, event_type, counterparty, event_id, amount, direction, confidence and
    effective_weight. The base is the heaviest member, amount and confidence are weighted medians,
    differing directions become mixed, and differing amounts or directions are counted as conflicts.
    """
    keys = ["link_id", "event_type", "counterparty_key"]
    rows = events.withColumn("counterparty_key", norm(F.col("counterparty")))
    clusters = rows.groupBy(*keys).agg(
        F.max(F.struct("effective_weight", (-F.col("event_id")).alias("_n"), "event_id"))["event_id"].alias("base_event_id"),
        F.count("*").alias("members"),
        (F.min("amount") != F.max("amount")).alias("amount_conflict"),
        (F.min("direction") != F.max("direction")).alias("direction_conflict"),
        F.min("direction").alias("_direction"),
    )
    medians = _medians(rows, keys, {"amount": F.floor("amount"), "confidence": F.floor(F.col("confidence") * 20)})
    joined = clusters.join(medians, keys, "left")
    amount_conflict = F.coalesce("amount_conflict", F.lit(False))
    direction_conflict = F.coalesce("direction_conflict", F.lit(False))
    return (
        joined.withColumn("direction", F.when(direction_conflict, "mixed").otherwise(F.col("_direction")))
        .withColumn("conflicts", amount_conflict.cast("int") + direction_conflict.cast("int"))
        .withColumn("corroboration", F.when(amount_conflict, "conflicting").otherwise("single_source"))
        .drop("_direction", "amount_conflict", "direction_conflict")
    )


def relation_conflicts(relations: DataFrame) -> DataFrame:
    """Pairs for which both a relation and its inverse are asserted on the same ordered entities."""
    inverse = F.create_map(*[F.lit(x) for pair in fixed.INVERSE_RELATIONS.items() for x in pair])
    kinds = F.col("relation_types")
    opposed = F.filter(kinds, lambda k: F.array_contains(kinds, F.try_element_at(inverse, k)))
    return (
        relations.groupBy("subject_key", "object_key", "product")
        .agg(F.array_sort(F.collect_set("relation_type")).alias("relation_types"))  # at most one entry per known type
        .withColumn("opposed", opposed)
        .where(F.size("opposed") > 0)
        .withColumn("resolution", F.lit("require_arbitration"))
    )


def flag_conflicting_relations(relations: DataFrame, found: DataFrame) -> DataFrame:
    """Mark relations that take part in a direction conflict."""
    bad = found.select("subject_key", "object_key", "product", F.explode("opposed").alias("relation_type"))
    keys = ["subject_key", "relation_type", "object_key", "product"]
    return relations.join(bad.withColumn("_bad", F.lit("needs_arbitration")), keys, "left").withColumnRenamed(
        "_bad", "resolution_status"
    )


def corroborated_relations(relations: DataFrame) -> DataFrame:
    """Best row per relation and the number of distinct source links that assert it."""
    keys = ["subject_key", "relation_type", "object_key"]
    return relations.groupBy(*keys).agg(
        F.max(F.struct("confidence", (-F.col("relation_id")).alias("_n"), "relation_id"))["relation_id"].alias("relation_id"),
        F.max("confidence").alias("confidence"),
        F.count_distinct("link_id").alias("source_links"),
    )


def disagreement(decisions: Column, conflict_count: Column, spread: Column) -> Column:
    disputed = (conflict_count > 0) | (decisions > 1)
    strong = (conflict_count >= 2) | (spread > 0.4)
    return F.when(disputed & strong, "high").when(disputed, "medium").otherwise("low")


def feedback_multiplier(feedback: DataFrame, key: str) -> DataFrame:
    """Multiplier in [0.5, 1.2] per model, query family or source type from feedback rows."""
    good = F.coalesce(F.col("correct"), F.lit(False)) | F.coalesce(F.col("useful"), F.lit(False))
    return (
        feedback.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count("*").alias("rows"), F.count_if(good).alias("good"))
        .withColumn("multiplier", round_half_up(0.5 + 0.7 * (F.col("good") / F.col("rows")), 3))
    )


def run_tally(bundles: DataFrame, kinds: Sequence[str], run: str) -> DataFrame:
    """Object counts per run, and the gap flag for events without quantified facts."""
    totals = bundles.groupBy(run).agg(
        F.count("*").alias("briefs"), *[F.sum(F.size(k)).alias(k) for k in kinds]
    )
    missing = (F.col("events") > 0) & (F.col("facts") == 0)
    return totals.withColumn("gap_type", F.when(missing, "missing_amount"))


def rows_per_run(links: DataFrame, analyses: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Row counts per run: links, analyses and every kind of child row."""
    placed = links.select("link_id", "run_id")
    parts = [placed.select("run_id", F.lit("source_links").alias("kind"))]
    parts.append(analyses.select("link_id").join(placed, "link_id").select("run_id", F.lit("merged_analysis").alias("kind")))
    for kind, rows in children.items():
        parts.append(rows.select("link_id").join(placed, "link_id").select("run_id", F.lit(kind).alias("kind")))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united.groupBy("run_id", "kind").agg(F.count("*").alias("rows"))


def explain_links(links: DataFrame, sections: dict[str, DataFrame], text: str = "text") -> DataFrame:
    """Everything known about each link as long rows (section, position, text).

    Long rows replace nested lists, so a link with very many facts stays splittable.
    """
    out = links.select("link_id", F.lit("source").alias("section"), F.lit(0).alias("position"), F.col(text))
    for name, rows in sections.items():
        found = rows.join(links.select("link_id"), "link_id", "left_semi")
        out = out.unionByName(found.select("link_id", F.lit(name).alias("section"), "position", F.col(text)))
    return out


def response_facts(responses: DataFrame, body: str) -> DataFrame:
    """Rows fetched, inline rows and high conflicts read from nested response JSON."""
    schema = (
        "status string, persistence struct<saved:boolean>, provider_results array<struct<rows_fetched:bigint>>,"
        " quality_report struct<data_quality_score:double, conflicts:array<struct<severity:string>>>,"
        " data struct<bars:array<string>>"
    )
    parsed = F.from_json(F.col(body), schema)
    rows = responses.withColumn("_r", parsed)
    found = F.coalesce(F.col("_r.quality_report.conflicts"), F.array().cast("array<struct<severity:string>>"))
    critical = F.exists(found, lambda c: c["severity"] == "critical")
    fetched = F.aggregate(
        F.coalesce(F.col("_r.provider_results"), F.array().cast("array<struct<rows_fetched:bigint>>")),
        F.lit(0).cast("long"),
        lambda acc, r: acc + F.coalesce(r["rows_fetched"], F.lit(0)),
    )
    return (
        rows.withColumn("rows_fetched", fetched)
        .withColumn("inline_bars", F.greatest(F.coalesce(F.size("_r.data.bars"), F.lit(0)), F.lit(0)))
        .withColumn("high_conflict", F.exists(found, lambda c: c["severity"].isin("high", "critical")))
        .withColumn("data_quality", F.col("_r.quality_report.data_quality_score"))
        .withColumn(
            "usable",
            F.col("_r.status").isin("success", "partial_success")
            & F.coalesce("_r.persistence.saved", F.lit(True))
            & ~F.coalesce(critical, F.lit(False)),
        )
        .drop("_r")
    )
