"""Record directory: lineage, quarantine flag and provenance of every record by its id, over all record types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.sources import tables

BUCKETS = 64
#: Record types whose status can quarantine a record, and those that carry provenance per field.
QUARANTINABLE = ["bar", "trading_status"]
TRACED = ["bar", "security_master", "valuation_metric", "financial_indicator"]


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("record_id"), F.lit(BUCKETS)).cast("int"))


def add(records: DataFrame, path: str) -> None:
    """Add records to the directory; a record that is in it stays as it is.

    ``records`` has record_id, record_type, raw_payload_id, raw_payload_ref, raw_row_index, validation_status and
    field_provenance (a map). Rows without an id cannot be looked up and are left out.
    """
    rows = records.where("record_id is not null").select(
        "record_id", "record_type", "raw_payload_id", "raw_payload_ref", "raw_row_index",
        (F.col("record_type").isin(QUARANTINABLE) & F.coalesce(F.col("validation_status") == "quarantined", F.lit(False))).alias("is_quarantined"),
        F.when(F.col("record_type").isin(TRACED), F.to_json("field_provenance")).alias("field_provenance"),
    )
    tables.insert_absent_bucketed(rows, path, ["record_id"], ["record_type", "raw_payload_id"], BUCKETS)


def look_up(spark: SparkSession, path: str, record_ids: Sequence[str]) -> DataFrame:
    """Directory rows of some records; only the buckets of their ids are read."""
    asked = _bucketed(spark.createDataFrame([(r,) for r in record_ids], "record_id string")).distinct()
    found = tables.touched(tables.read(spark, path), asked, ["bucket"])
    return found.join(F.broadcast(asked.select("record_id")), "record_id", "left_semi").drop("bucket")
