"""Comparison of the providers of all record types in one pass.

A record is its type, provider, id, source API and a map of field names to text values. Which fields of a type are
compared, how far they may differ and how bad a difference is are rows of a rule table, so all types go through the
same joins and expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions.numbers import relative_diff
from marketloom.functions.text import compare_form, nfkc
from marketloom.sources import dims

_IDENTITY = {
    "security_master": ["normalized_ticker"],
    "trade_calendar": ["exchange", "calendar_date"],
    "trading_status": ["normalized_ticker", "trade_date"],
    "bar": ["normalized_ticker", "frequency", ("timestamp", "trade_date"), "adjust"],
    "realtime_quote": ["normalized_ticker", "quote_time_bucket"],
    "adj_factor": ["normalized_ticker", "trade_date"],
    "financial_statement": ["normalized_ticker", "report_period", "statement_type", "report_type"],
    "financial_indicator": ["normalized_ticker", "report_period"],
    "valuation_metric": ["normalized_ticker", "trade_date"],
    "industry_membership": ["normalized_ticker", "industry_system", "effective_date"],
    "concept_membership": ["normalized_ticker", ("concept_code", "concept_name"), "provider"],
    "money_flow": ["normalized_ticker", "trade_date", "frequency", "source_methodology"],
    "index": ["index_code"],
    "index_bar": ["index_code", "frequency", "timestamp"],
    "index_constituent": ["index_code", "normalized_ticker", "effective_date"],
    "corporate_action": ["normalized_ticker", "action_type", "announcement_date", "ex_date"],
}


def comparison_key(record_type: Column, data: Column) -> Column:
    """Business identity under which providers of a record meet; of an unknown type, all its ids and codes."""

    def part(names) -> Column:
        if isinstance(names, str):
            return F.coalesce(data[names], F.lit("None"))
        return F.coalesce(*[F.nullif(data[n], F.lit("")) for n in names], F.lit("None"))

    names = F.array_sort(F.filter(F.map_keys(data), lambda k: F.endswith(k, F.lit("_id")) | F.endswith(k, F.lit("code"))))
    key = F.concat_ws("|", F.transform(names, lambda k: F.coalesce(data[k], F.lit("None"))))
    for kind, identity in _IDENTITY.items():
        key = F.when(record_type == kind, F.concat_ws("|", *[part(n) for n in identity])).otherwise(key)
    return key


def present(value: Column) -> Column:
    return F.coalesce((value != "") & (F.lower(value) != "nan"), F.lit(False))


def _number(value: Column) -> Column:
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < F.lit(float("inf"))), number)


def cells(records: DataFrame, canonical: str) -> DataFrame:
    """One row per supplement record and compared field of its type, against the canonical provider's record.

    ``records`` has record_type, provider, record_id, source_api and ``data``. The canonical record of a key is that
    of the smallest id; all records of other providers are held against it, however many there are. A cell is
    checked when both sides have a value; estimated amounts are never checked. ``severity`` is null where they agree.
    """
    compared = F.create_map(*[F.lit(x) for kind, names in fixed.COMPARED_FIELDS.items() for x in (kind, list(names))])
    # of a record only the values of its type's compared fields go on, in the order of the rules
    values = F.transform(F.element_at(compared, F.col("record_type")), lambda name: F.element_at("data", name))
    keyed = records.withColumns({"comparison_key": comparison_key(F.col("record_type"), F.col("data")), "_values": values})
    side = F.struct("record_id", "source_api", F.col("_values").alias("data"))
    own = keyed.where(F.col("provider") == canonical).groupBy("record_type", "comparison_key").agg(F.min_by(side, "record_id").alias("_own"))
    others = keyed.where(F.col("provider") != canonical).select(
        "record_type", "comparison_key", F.col("provider").alias("other_provider"), F.col("record_id").alias("other_record_id"),
        F.col("source_api").alias("_api"), F.col("_values").alias("_data"),
    )
    # the canonical records grow with the input; their estimated size is that of the file they are made of, so they are not broadcast by it
    met = others.join(own.hint("merge"), ["record_type", "comparison_key"]).join(dims.comparison_rules(records.sparkSession), "record_type")
    ours, theirs = F.col("canonical_value"), F.col("other_value")
    estimated = F.contains(F.concat_ws("|", "_api", "_own.source_api"), F.lit(fixed.ESTIMATED_AMOUNT_API))
    rows = met.select(
        "record_type", "comparison_key", F.col("_own.record_id").alias("canonical_record_id"), "other_provider", "other_record_id",
        "field_name", F.element_at("_own.data", F.col("place")).alias("canonical_value"),
        F.element_at("_data", F.col("place")).alias("other_value"), "kind", "absolute", "relative", "level", "critical_gap",
        (F.col("field_name").isin("amount", "vwap") & estimated).alias("_estimated"),
    )
    rows = rows.withColumn("checked", present(ours) & present(theirs) & ~F.col("_estimated"))
    # only free texts that differ as they are need their comparison forms
    text = F.col("checked") & (F.col("kind") == "generic") & (ours != theirs)
    forms = {f"_{c}": nfkc(F.when(text, F.col(c))) for c in ("canonical_value", "other_value")}
    rows = rows.withColumns({"_text": text, **forms})
    differ = compare_form(F.col("_canonical_value"), already_nfkc=True) != compare_form(F.col("_other_value"), already_nfkc=True)
    rows = rows.withColumns({"_a": _number(ours), "_b": _number(theirs)}).withColumn("_gap", relative_diff(F.col("_a"), F.col("_b")))
    never = F.lit(False)
    within = F.coalesce(F.abs(F.col("_a") - F.col("_b")) <= F.col("absolute"), never) | F.coalesce(F.col("_gap") <= F.col("relative"), never)
    numeric = (
        F.when(F.col("_a").isNull() & F.col("_b").isNull(), None)
        .when(F.col("_a").isNull() | F.col("_b").isNull(), "medium")
        .when(within, None)
        .when(F.col("_gap") > F.col("critical_gap"), "critical")
        .otherwise(F.col("level"))
    )
    severity = (
        F.when(~F.col("checked"), None)
        .when(F.col("kind") == "status", F.when(ours != theirs, F.col("level")))
        .when(F.col("kind") == "generic", F.when(F.col("_text") & differ, F.col("level")))
        .otherwise(numeric)
    )
    return rows.select(
        "record_type", "comparison_key", F.lit(canonical).alias("canonical_provider"), "canonical_record_id", "other_provider",
        "other_record_id", "field_name", "canonical_value", "other_value", "checked", severity.alias("severity"),
    )


def results(compared: DataFrame) -> DataFrame:
    """One row per supplement record: checked, matched and conflicted fields and the status."""
    bad = F.count("severity")
    keys = ["record_type", "comparison_key", "canonical_provider", "canonical_record_id", "other_provider", "other_record_id"]
    return compared.groupBy(*keys).agg(
        F.count_if("checked").alias("checked_fields"),
        (F.count_if("checked") - bad).alias("matched_fields"),
        bad.alias("conflicted_fields"),
        F.when(bad == 0, "matched").otherwise("conflicted").alias("status"),
    )


def summary(compared: DataFrame) -> DataFrame:
    """Checked cells and conflicts of every record type and field, by severity."""
    levels = {f"{level}_conflicts": F.count_if(F.col("severity") == level) for level in fixed.SEVERITY_RANK}
    return compared.groupBy("record_type", "field_name").agg(F.count_if("checked").alias("checked"), *[c.alias(n) for n, c in levels.items()])
