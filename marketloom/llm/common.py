"""What the operators of this folder share: input columns, written intermediates, packed counters."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import session

CHUNK = 1 << 16


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings that results or memory rely on: small Arrow batches, as texts can be long."""
    session.pin(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(session.scratch_root(spark))
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Select columns by exact name as alias=(name, type).

    Columns are addressed by place, so further columns may have any name, also one that differs
    from a wanted one in case only or has dots.
    """
    places = {name: i for i, name in reversed(list(enumerate(df.columns)))}
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.select(*[F.col(f"_{places[name]}").cast(kind).alias(alias) for alias, (name, kind) in columns.items()])


def where_column(df: DataFrame, name: str, condition) -> DataFrame:
    """Rows, with all their columns, where a condition on one column, found by exact name, holds."""
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return flat.where(condition(F.col(f"_{df.columns.index(name)}"))).toDF(*df.columns)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared scratch folder and read it back: later steps start from the files."""
    spark = df.sparkSession
    path = f"{session.scratch_root(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def scanned_once(df: DataFrame) -> DataFrame:
    """The same rows with their scan planned now, once, for all later uses.

    How files are split depends on settings and on the cores at the time of planning, so row numbers and block
    starts of two plans may differ. Here every use computes the same partitions. Strings go through the JVM's
    own; keep bytes that may not be UTF-8 as binary.
    """
    rows = df.sparkSession._jsparkSession.createDataFrame(df._jdf.toJavaRDD(), df._jdf.schema())
    return DataFrame(rows, df.sparkSession)


def cut(df: DataFrame) -> DataFrame:
    """Compute a small table now and keep it in the checkpoint folder, which all executors share."""
    return df.checkpoint(eager=True)


def longs(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as the signed longs that Spark has."""
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def unsigned(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def packed_counts(kinds: list[np.ndarray]) -> Iterator[tuple[int, list[bytes]]]:
    """Counter arrays of equal length as (chunk number, compressed 65,536-cell pieces); empty chunks are left out."""
    for start in range(0, len(kinds[0]), CHUNK):
        pieces = [k[start : start + CHUNK] for k in kinds]
        if any(p.any() for p in pieces):
            yield start // CHUNK, [pa.compress(p.astype("<u4").tobytes(), "zstd", asbytes=True) for p in pieces]


def unpacked(blob: bytes, cells: int, kind: str = "<u4") -> np.ndarray:
    size = cells * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(blob, size, "zstd", asbytes=True), kind)


def summed_counts(rows: DataFrame, cells: int, names: list[str]) -> list[np.ndarray]:
    """Sum packed counters of all tasks by chunk, on the executors, and fetch the sums.

    ``rows`` has chunk int and one binary column per name. The result has ``cells`` cells whatever
    the size of the data, so its size on the driver is fixed by that parameter.
    """

    def add(tables: pa.Table) -> pa.Table:
        chunk = tables["chunk"][0].as_py()
        width = min(CHUNK, cells - chunk * CHUNK)
        out = {"chunk": pa.array([chunk], pa.int32())}
        for name in names:
            total = np.zeros(width, np.int64)
            for blob in tables[name]:
                total += unpacked(blob.as_py(), width)
            out[name] = pa.array([pa.compress(total.tobytes(), "zstd", asbytes=True)], pa.binary())
        return pa.table(out)

    kinds = ", ".join(f"{n} binary" for n in names)
    sums = [np.zeros(cells, np.int64) for _ in names]
    for row in rows.groupBy("chunk").applyInArrow(add, f"chunk int, {kinds}").collect():
        start = row["chunk"] * CHUNK
        width = min(CHUNK, cells - start)
        for array, name in zip(sums, names, strict=True):
            array[start : start + width] = unpacked(bytes(row[name]), width, "<i8")
    return sums
