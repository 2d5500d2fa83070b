"""Raw landing zone: gzip JSON lines by provider, request type and date.

A payload is the set of rows that share ``raw_payload_id``: one ``metadata`` row and one
``raw_record`` row per fetched record. Payloads are appended once and never changed.

Beside the lines lies an index in hash buckets of the payload id: one row per payload and file, with its range of row
numbers and the payload's hash. Appends and lookups read the buckets of their ids, and of the lines only the named files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from marketloom.operators.hotkeys import running_total
from marketloom.sources import tables

SCHEMA = (
    "raw_payload_id string, line_type string, raw_row_index bigint, provider_symbol string, raw_data string,"
    " source_api string, request_id string, raw_hash string, provider string, request_type string, date string, batch string"
)
PARTITIONS = ["provider", "request_type", "date"]
LINES_PER_HASH = 1024
#: Buckets of the payload index. Its folder is hidden from readers of the lines.
INDEX_BUCKETS = 64
INDEX = "_index"


def scan(spark: SparkSession, path: str) -> DataFrame | None:
    """All lines of the landing zone, or nothing when it is empty."""
    try:
        return spark.read.schema(SCHEMA).option("basePath", path).json(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise


def metadata(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line_type") == "metadata").select(
        "raw_payload_id", "source_api", "request_id", "raw_hash", *PARTITIONS
    )


def records(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line_type") == "raw_record")


def catalogue(lines: DataFrame, provider: str | None = None, request_type: str | None = None) -> DataFrame:
    """Payload ids, filtered on partition columns so that other directories are not read."""
    found = metadata(lines)
    if provider:
        found = found.where(F.col("provider") == provider)
    if request_type:
        found = found.where(F.col("request_type") == request_type)
    return found.select("raw_payload_id", *PARTITIONS)


def row_at(lines: DataFrame, payload_id: Column | str, index: int) -> DataFrame:
    return records(lines).where((F.col("raw_payload_id") == payload_id) & (F.col("raw_row_index") == index))


def payload_hashes(rows: DataFrame, payload: str, index: str, line: Column) -> DataFrame:
    """One hash per payload over its ordered lines, as a tree of bounded groups.

    Every group hashes at most ``LINES_PER_HASH`` ordered children, so a payload of any size is
    hashed by many tasks; four levels hold a trillion lines.
    """
    level = rows.select(F.col(payload), F.col(index).cast("long").alias("_i"), F.sha2(line, 256).alias("_h"))
    for _ in range(4):
        chunk = F.floor(F.col("_i") / LINES_PER_HASH)
        grouped = level.groupBy(payload, chunk.alias("_c")).agg(F.array_sort(F.collect_list(F.struct("_i", "_h"))).alias("_l"))
        joined = F.array_join(F.transform("_l", lambda x: x["_h"]), "")
        level = grouped.select(payload, F.col("_c").alias("_i"), F.sha2(joined, 256).alias("_h"))
    return level.select(payload, F.concat(F.lit("sha256:"), "_h").alias("raw_hash"))


def number_rows(fetched: DataFrame, payload: str, order: str) -> DataFrame:
    """Row index within each payload from zero, blockwise so that a huge payload is not one task."""
    counted = running_total(fetched, [payload], [order], F.lit(1), F.floor(F.col(order) / 65536), "raw_row_index")
    return counted.withColumn("raw_row_index", F.col("raw_row_index") - 1)


def _bucketed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("raw_payload_id"), F.lit(INDEX_BUCKETS)).cast("int"))


def index(spark: SparkSession, path: str) -> DataFrame | None:
    """The payload index: a row per payload and file."""
    return tables.read(spark, f"{path}/{INDEX}")


def indexed_catalogue(spark: SparkSession, path: str, provider: str | None = None, request_type: str | None = None) -> DataFrame:
    """Payloads with their hash and number of rows, from the index alone."""
    found = index(spark, path)
    for name, value in (("provider", provider), ("request_type", request_type)):
        if value:
            found = found.where(F.col(name) == value)
    return found.groupBy("raw_payload_id", *PARTITIONS).agg(F.max("raw_hash").alias("raw_hash"), F.sum("rows").alias("rows"))


def rows_at(spark: SparkSession, path: str, wanted: list[tuple[str, int]]) -> DataFrame:
    """Records of (payload id, row index) pairs; a pair that is not stored has no row.

    The index names the files that hold the rows, and only these are read. The pairs are a list of the caller's, so
    the files are at most as many.
    """
    asked = _bucketed(spark.createDataFrame(wanted, "raw_payload_id string, raw_row_index long"))
    known = tables.touched(index(spark, path), asked, ["bucket"]).drop("bucket")
    held = asked.join(known, "raw_payload_id").where(F.col("raw_row_index").between(F.col("first_row"), F.col("last_row")))
    files = sorted(r["file"] for r in held.select("file").distinct().collect())
    if not files:
        return records(spark.createDataFrame([], SCHEMA))
    lines = spark.read.schema(SCHEMA).option("basePath", path).json(files)
    return records(lines).join(F.broadcast(asked.drop("bucket").distinct()), ["raw_payload_id", "raw_row_index"], "left_semi")


def append(fetched: DataFrame, path: str, order: str) -> None:
    """Append payloads that are not yet stored.

    ``fetched`` has raw_payload_id, the partition columns, source_api, request_id, provider_symbol,
    raw_data (JSON text) and a numeric fetch order. The lines are written under a batch named by the new payload
    ids, then the index. An append that was cut off before the index is written again in the same place.
    """
    spark = fetched.sparkSession
    known = index(spark, path)
    fresh = fetched
    if known is not None:
        ids = tables.stage(_bucketed(fetched.select("raw_payload_id").distinct()), "payloads")
        stored = tables.touched(known, ids, ["bucket"]).select("raw_payload_id").distinct()
        fresh = fetched.join(ids.join(stored, "raw_payload_id", "left_anti").select("raw_payload_id"), "raw_payload_id", "left_semi")
    lines = tables.stage(number_rows(fresh, "raw_payload_id", order), "landing")
    name = lines.select("raw_payload_id").distinct().agg(F.sum(F.xxhash64("raw_payload_id").cast("decimal(38,0)")), F.count("*")).first()
    if not name[1]:
        return
    batch = f"{name[0]}_{name[1]}"
    hashes = payload_hashes(lines, "raw_payload_id", "raw_row_index", F.col("raw_data"))
    heads = (
        lines.groupBy("raw_payload_id", *PARTITIONS)
        .agg(F.min("source_api").alias("source_api"), F.min("request_id").alias("request_id"))
        .join(hashes, "raw_payload_id")
        .withColumn("line_type", F.lit("metadata"))
    )
    body = lines.select(
        "raw_payload_id", "raw_row_index", "provider_symbol", "raw_data", *PARTITIONS, F.lit("raw_record").alias("line_type")
    )
    out = body.unionByName(heads, allowMissingColumns=True).withColumn("batch", F.lit(batch)).write.mode("overwrite")
    out.option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS, "batch").json(path, compression="gzip")
    written = scan(spark, path).where(F.col("batch") == batch).withColumn("file", F.col("_metadata.file_path"))
    rows = written.groupBy("raw_payload_id", *PARTITIONS, "file").agg(
        F.min("raw_row_index").alias("first_row"),
        F.max("raw_row_index").alias("last_row"),
        F.count_if(F.col("line_type") == "raw_record").alias("rows"),
        F.max("raw_hash").alias("raw_hash"),
    )
    entries = _bucketed(rows).withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    entries.partitionBy("bucket", "batch").parquet(f"{path}/{INDEX}")


def verify(lines: DataFrame) -> DataFrame:
    """Stored against recomputed hash of every payload."""
    actual = payload_hashes(records(lines), "raw_payload_id", "raw_row_index", F.col("raw_data"))
    return (
        metadata(lines)
        .select("raw_payload_id", F.col("raw_hash").alias("stored_hash"))
        .join(actual, "raw_payload_id", "left")
        .withColumn("intact", F.coalesce(F.col("stored_hash") == F.col("raw_hash"), F.lit(False)))
    )
