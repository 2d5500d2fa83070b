"""Small dimension tables from fixed configuration, safe to broadcast because their size is known."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import fixed


def domains(spark: SparkSession) -> DataFrame:
    """Listed domains with their source type and list position."""
    rows = [(d, t, i) for i, (d, t) in enumerate(fixed.SOURCE_TYPE_BY_DOMAIN.items())]
    return F.broadcast(spark.createDataFrame(rows, "domain string, source_type string, position int"))


def tolerances(spark: SparkSession) -> DataFrame:
    """Comparison tolerance per field category."""
    rows = [(c, t.get("absolute"), t.get("relative")) for c, t in fixed.TOLERANCES.items()]
    return F.broadcast(spark.createDataFrame(rows, "category string, absolute double, relative double"))


def comparison_rules(spark: SparkSession) -> DataFrame:
    """Compared fields of every record type: kind, tolerances, the level of a difference, the gap from which it is critical and the place among them."""
    kinds = {name: kind for kind, names in fixed.FIELDS_BY_CATEGORY.items() for name in names}
    rows = []
    for record_type, names in fixed.COMPARED_FIELDS.items():
        for place, name in enumerate(names, 1):
            kind, critical = kinds.get(name, "generic"), name in fixed.CRITICAL_FIELDS
            limits = fixed.TOLERANCES.get(kind, {})
            if kind == "status":
                level = "critical" if name in fixed.ALWAYS_CRITICAL_STATUS else "high" if critical else "medium"
            elif kind == "generic":
                level = "medium" if critical else "low"
            else:
                level = "high" if critical else "medium"
            gap = fixed.CLOSE_OR_FACTOR_CRITICAL_RELATIVE if name in ("close", "adj_factor") else fixed.AMOUNT_CRITICAL_RELATIVE if kind == "amount" else None
            rows.append((record_type, name, kind, limits.get("absolute"), limits.get("relative"), level, gap, place))
    schema = "record_type string, field_name string, kind string, absolute double, relative double, level string, critical_gap double, place int"
    return F.broadcast(spark.createDataFrame(rows, schema))


def variable_rules(spark: SparkSession) -> DataFrame:
    """Keyword per tracking variable."""
    rows = [(v, w) for v, words in fixed.VARIABLE_RULES.items() for w in words]
    return F.broadcast(spark.createDataFrame(rows, "tracking_variable string, keyword string"))


def golden_items(spark: SparkSession, items: list[dict]) -> DataFrame:
    """Expected events of a golden list."""
    schema = (
        "expected_event_id string, target_id string, date_from date, date_to date, keywords array<string>,"
        " source_types array<string>, expected_variables array<string>"
    )
    return spark.createDataFrame(items, schema)
