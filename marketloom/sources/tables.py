"""Partitioned Parquet tables: upserts, first-write inserts, readers and reconciliation."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from marketloom.operators.hotkeys import first_by_key, latest_by_key
from marketloom.session import scratch_root

#: Hidden folder of a bucketed table's filters, and bits of one bitmap of a filter.
FILTERS = "_filters"
FILTER_PIECE_BITS = 32768


def read(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or nothing when it was never written."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" in str(missing) or "UNABLE_TO_INFER_SCHEMA" in str(missing):
            return None
        raise


def stage(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared scratch folder once, and read from there afterwards."""
    path = f"{scratch_root(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def touched(existing: DataFrame, incoming: DataFrame, partitions: Sequence[str]) -> DataFrame:
    """Rows of the table in the partitions that incoming rows belong to; null is a partition, too.

    The incoming partition values become literals, so the scan lists and reads no other partition. They
    are at most as many as the table has partitions, or gets new ones.
    """
    values = incoming.select(*[F.col(p).cast(existing.schema[p].dataType).alias(f"_{p}") for p in partitions]).distinct()
    found = values.collect()
    kept = existing
    for p in partitions:
        named = {row[f"_{p}"] for row in found}
        same = F.col(p).isin(sorted(named - {None}))
        kept = kept.where(same | F.col(p).isNull() if None in named else same)
    if len(partitions) == 1:
        return kept
    # of several columns the literals also admit combinations that do not occur
    return kept.join(values, [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in partitions], "left_semi")


def upsert(rows: DataFrame, path: str, partitions: Sequence[str], key: Sequence[str], order: str = "ingested_at") -> None:
    """Merge rows into a table, keeping the latest row per business key.

    Only partitions that receive rows are read and rewritten. The incoming rows are staged first, so
    they are computed once, and the merged partitions too, because a partition cannot be overwritten
    while it is read. The partition columns must be part of the key.
    """
    spark = rows.sparkSession
    existing = read(spark, path)
    merged = rows
    if existing is not None:
        merged = stage(rows, "incoming")
        kept = touched(existing, merged, partitions) if partitions else existing
        # Partition values come back with inferred types.
        merged = merged.unionByName(kept.select(*[F.col(f.name).cast(f.dataType) for f in rows.schema.fields]))
    writer = stage(latest_by_key(merged, key, [order]), "merged").write.mode("overwrite")
    writer = writer.option("partitionOverwriteMode", "dynamic")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def insert_absent(rows: DataFrame, path: str, key: Sequence[str], order: Sequence[str], partitions: Sequence[str] = ()) -> None:
    """Append rows whose key the table lacks; the first row of a key wins.

    With partition columns that belong to the key, only partitions that receive rows are searched.
    """
    spark = rows.sparkSession
    existing = read(spark, path)
    fresh = first_by_key(rows, key, order)
    if existing is not None:
        if partitions and set(partitions) <= set(key):
            fresh = stage(fresh, "fresh")
            existing = touched(existing, fresh, partitions)
        fresh = fresh.join(existing.select(*key), list(key), "left_anti").select(*rows.columns)
    writer = fresh.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def _filter_places(key: Sequence[str], pieces: int) -> list:
    """Places of a key's bits in its bucket's filter, counted from 1 as the built-in bitmaps count."""
    return [F.pmod(F.xxhash64(*key, F.lit(salt)), F.lit(pieces * FILTER_PIECE_BITS)) + 1 for salt in (1, 2)]


def may_be_stored(rows: DataFrame, path: str, key: Sequence[str], pieces: int) -> DataFrame:
    """Rows (with ``bucket``) whose key the filters of their buckets do not rule out."""
    spark = rows.sparkSession
    known = read(spark, f"{path}/{FILTERS}")
    if known is None:
        return rows.limit(0)
    filters = touched(known, rows, ["bucket"]).groupBy("bucket", "piece").agg(F.bitmap_or_agg("bits").alias("_bits"))
    out = rows
    for place in _filter_places(key, pieces):
        at = F.bitmap_bit_position("_place")
        byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        held = out.withColumn("_place", place).withColumn("piece", F.bitmap_bucket_number("_place")).join(filters, ["bucket", "piece"])
        out = held.where(F.getbit(byte, (at % 8).cast("int")) == 1).drop("_place", "piece", "_bits")
    return out


def insert_absent_bucketed(
    rows: DataFrame, path: str, key: Sequence[str], order: Sequence[str], buckets: int = 64, pieces: int = 8
) -> None:
    """Append rows whose key the table lacks; the first row of a key wins, also within the rows.

    The table lies in hash buckets of the key, each with a Bloom filter of ``pieces`` bitmaps. Keys that the filters
    rule out are new without a look at the table; of the others only the buckets are read. Fuller filters rule
    out fewer keys but never a stored one. Filters are written before the rows, so an insert that is cut off
    leaves bits without rows at worst and can be run again. A key with a null is equal to no other, as in any join.
    """
    spark = rows.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    fresh = stage(first_by_key(rows, key, order).withColumn("bucket", bucket), "fresh")
    existing = read(spark, path)
    if existing is not None:
        likely = stage(may_be_stored(fresh, path, key, pieces).select(*key, "bucket"), "likely")
        stored = touched(existing, likely, ["bucket"]).select(*key)
        fresh = stage(fresh.join(likely.join(stored, list(key), "left_semi").select(*key), list(key), "left_anti").select(*fresh.columns), "new")
    bits = None
    for place in _filter_places(key, pieces):
        part = fresh.select("bucket", place.alias("_place"))
        bits = part if bits is None else bits.unionByName(part)
    bits = bits.groupBy("bucket", F.bitmap_bucket_number("_place").alias("piece"))
    filters = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("_place")).alias("bits"))
    # a task per bucket, as buckets are even, so that an insert adds one file to each
    filters.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(f"{path}/{FILTERS}")
    fresh.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(path)


def write_routed(records: DataFrame, path: str, columns: Sequence[str] = ("record_type",)) -> None:
    """One directory per record type, and per frequency where the rows carry one."""
    records.write.mode("append").partitionBy(*columns).parquet(path)


def read_date_range(
    table: DataFrame, date_column: str, start: str, end: str, tickers: Sequence[str] | None = None, ticker_column: str = "normalized_ticker"
) -> DataFrame:
    """Rows of an inclusive date range; both filters reach the scan."""
    found = table.where(F.col(date_column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return read_tickers(found, tickers, ticker_column) if tickers else found


def read_tickers(table: DataFrame, tickers: Sequence[str], ticker_column: str = "normalized_ticker") -> DataFrame:
    return table.where(F.col(ticker_column).isin(list(tickers)))


def row_count_gaps(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Row counts of two stores per partition, with a flag for agreement."""
    a = left.groupBy(*by).agg(F.count("*").alias("left_rows"))
    b = right.groupBy(*by).agg(F.count("*").alias("right_rows"))
    return (
        a.join(b, list(by), "full_outer")
        .fillna(0, subset=["left_rows", "right_rows"])
        .withColumn("matches", F.col("left_rows") == F.col("right_rows"))
    )


def nested_to_json(df: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for sinks that hold flat cells only."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns])


def append_once(rows: DataFrame, path: str, key: str) -> None:
    """Append audit rows that are not there yet; their key is derived from content."""
    insert_absent(rows, path, [key], [c for c in rows.columns if c != key][:1])


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
