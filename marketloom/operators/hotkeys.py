"""Grouping, carrying and joining that stay parallel when one key holds much of the data.

A window partition is one task, so none of these opens a window over a bare business
key of unbounded size. They aggregate map-side first, or cut every key into blocks and
carry one small summary row per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Pairs that one task of a join makes, rows that it reads, and rows of a key that are not cut further.
TASK_PAIRS, TASK_ROWS, CUT_ROWS = 1 << 24, 1 << 18, 1 << 11


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` per key; the other columns break ties."""
    return _extreme_by_key(df, keys, order, F.max)


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """The same rows, dealt by their key to tasks of about ``rows`` rows each.

    For rows that many others are made of in the task that reads them: files split by bytes, and a small file is one task.
    """
    return df.repartition(max(-(-df.count() // rows), 1), key)


def dealt_by_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of an inner join, dealt to tasks by their pairs, and the columns on which they are to be joined.

    For joins whose result is far larger than their inputs: the planner sizes tasks by the bytes they read, which say nothing
    about the pairs they make. Keys of more than ``CUT_ROWS`` squared pairs or ``TASK_ROWS`` rows are cut: the rows of each side by
    their hash into chunks of about ``CUT_ROWS``, and every chunk goes to all chunks of the other side, so a copied row makes about
    a thousand pairs or more. Only the numbers of chunks of such keys are collected and broadcast. Equal rows share a chunk.
    """
    counts = [df.groupBy(*keys).agg(F.count("*").alias(n)) for df, n in ((left, "_left"), (right, "_right"))]
    pairs, rows = F.col("_left") * F.col("_right"), F.col("_left") + F.col("_right")
    chunks = [F.greatest(F.ceil(F.col(n) / CUT_ROWS), F.lit(1)).alias(n) for n in ("_left", "_right")]
    cut = F.collect_list(F.when((pairs > CUT_ROWS**2) | (rows > TASK_ROWS), F.struct(*keys, *chunks)))
    met = counts[0].join(counts[1], keys, "full").fillna(0, ["_left", "_right"])
    found = met.agg((F.sum(pairs) / TASK_PAIRS + F.sum(rows) / TASK_ROWS).alias("tasks"), cut.alias("cut"))
    work, on = found.first(), list(keys)
    if work["cut"]:
        table = F.broadcast(left.sparkSession.createDataFrame(work["cut"], found.schema["cut"].dataType.elementType))
        on += ["_left", "_right"]
        dealt_out = []
        for df, own, other in ((left, "_left", "_right"), (right, "_right", "_left")):
            known = df.join(table, keys, "left").fillna(1, ["_left", "_right"])
            hashed = [c for c in df.columns if df.schema[c].dataType.typeName() not in ("map", "variant")]  # these have no hash
            chunk, each_other = F.pmod(F.xxhash64(*hashed), own), F.sequence(F.lit(1).cast("bigint"), F.col(other))
            dealt_out.append(known.withColumn(own, chunk + 1).withColumn(other, F.explode(each_other)))
        left, right = dealt_out
    tasks = int(work["tasks"] or 0) + 1
    return left.repartition(tasks, *on), right.repartition(tasks, *on), on


def first_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Row with the smallest ``order`` per key; the other columns break ties."""
    return _extreme_by_key(df, keys, order, F.min)


def _extreme_by_key(df, keys, order, pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    # One struct aggregate reduces each key on the map side, so a hot key shuffles one row per task.
    if any(df.schema[c].dataType.typeName() == "map" for c in rest):  # maps have no order and cannot break ties
        by = F.max_by if pick is F.max else F.min_by
        row = by(F.struct(*order, *rest), F.struct(*order))
    else:
        row = pick(F.struct(*order, *rest))
    chosen = df.groupBy(*keys).agg(row.alias("_row"))
    return chosen.select(*[F.col(c) if c in keys else F.col(f"_row.{c}") for c in df.columns])


def explode_computed(df: DataFrame, array: Column, name: str) -> DataFrame:
    """One row per element of a computed array of non-null elements.

    A plain explode makes the optimizer push a filter on the array's size below the projections that
    compute it, which evaluates an expensive array several times. Exploding outer and dropping the
    empty rows afterwards evaluates it once.
    """
    return df.withColumn(name, F.explode_outer(array)).where(F.col(name).isNotNull())


def mark_first(df: DataFrame, keys: Sequence[str], order: str, name: str = "is_first") -> DataFrame:
    """Flag the row with the smallest unique ``order`` of every key.

    The winners join back on ``order`` itself, which is unique, so no join key is hot.
    """
    winners = df.groupBy(*keys).agg(F.min(order).alias(order)).select(order, F.lit(True).alias(name))
    return df.join(winners, order, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def salted_join(big: DataFrame, compact: DataFrame, keys: Sequence[str], how: str = "left", salts: int = 16) -> DataFrame:
    """Join a large side with a frame of few rows per key, spreading every key over ``salts`` tasks.

    The salt is a hash of the whole row, so a recomputed task places its rows as before.
    """
    plain = [f.name for f in big.schema.fields if f.dataType.typeName() not in ("map", "variant")]
    spread = big.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    copies = compact.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, block: Column, name: str
) -> DataFrame:
    """Running sum of ``value`` in ``order`` per key, including the row itself.

    ``block`` must not decrease along ``order``. Each block is summed on its own and
    shifted by the total of the blocks before it.
    """
    rows = df.withColumn("_block", block).withColumn("_value", value)
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_inside", F.sum("_value").over(inside))
    return (
        summed.join(offsets, [*keys, "_block"])
        .withColumn(name, F.col("_inside") + F.col("_offset"))
        .drop("_block", "_value", "_inside", "_offset")
    )


def asof_intervals(
    right: DataFrame, keys: Sequence[str], time: str, fields: Sequence[str], span: tuple[str, str], unit: str = "month"
) -> DataFrame:
    """Validity intervals of a slowly changing side, cut at calendar blocks.

    ``right`` has one row per key and time. Every row rules from its time until the next row of its
    key; what lies before the first row forms an interval of its own. Each result row has the block,
    ``_from`` and ``_until``, the ruling row ``_ruling`` and the one after it ``_following``. Only blocks
    of the span are produced, so a key has as many rows as it has changes and blocks.
    """
    row = F.struct(F.col(time), *fields)
    ordered = Window.partitionBy(*keys).orderBy(time)
    start, end = (F.lit(d).cast("timestamp") for d in span)
    rows = right.select(
        *keys,
        F.col(time).cast("timestamp").alias("_from"),
        F.lead(F.col(time).cast("timestamp")).over(ordered).alias("_until"),
        row.alias("_ruling"),
        F.lead(row).over(ordered).alias("_following"),
        F.row_number().over(ordered).alias("_n"),
    )
    kind = rows.schema["_ruling"].dataType
    before = F.struct(
        F.lit(None).cast("timestamp").alias("_from"),
        F.col("_from").alias("_until"),
        F.lit(None).cast(kind).alias("_ruling"),
        F.col("_ruling").alias("_following"),
    )
    own = F.struct("_from", "_until", "_ruling", "_following")
    pieces = rows.select(*keys, F.explode(F.when(F.col("_n") == 1, F.array(before, own)).otherwise(F.array(own))).alias("_i"))
    pieces = pieces.select(*keys, "_i.*").where(
        (F.col("_from").isNull() | (F.col("_from") <= end)) & (F.col("_until").isNull() | (F.col("_until") > start))
    )
    first = F.date_trunc(unit, F.greatest(start, F.col("_from")))
    last = F.date_trunc(unit, F.least(end, F.col("_until")))
    blocks = F.sequence(first, last, F.expr(f"INTERVAL 1 {unit.upper()}"))
    return pieces.withColumn("_block", F.explode(blocks))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    fields: Sequence[str],
    span: tuple[str, str],
    unit: str = "month",
) -> DataFrame:
    """Attach the nearest right row at or before (``prev``) and at or after (``next``) each left row of the span.

    The large left side meets the intervals on (keys, block) in a plain equi-join: it is neither sorted
    nor gathered per key, a small right side is broadcast once its size is known at run time, and a hot
    key is spread over its blocks.
    """
    at = F.col(time).cast("timestamp")
    intervals = asof_intervals(right, keys, time, fields, span, unit).withColumnsRenamed({k: f"_r_{k}" for k in keys})
    probes = left.withColumn("_at", at).withColumn("_b", F.date_trunc(unit, at))
    same = (F.col("_b") == F.col("_block")) & F.coalesce(F.col("_at") >= F.col("_from"), F.lit(True))
    same = same & F.coalesce(F.col("_at") < F.col("_until"), F.lit(True))
    for key in keys:
        same = same & (F.col(key) == F.col(f"_r_{key}"))
    exact = F.col("_at") == F.col("_from")
    return probes.join(intervals, same, "left").select(
        *left.columns,
        F.col("_ruling").alias("prev"),
        F.when(exact, F.col("_ruling")).otherwise(F.col("_following")).alias("next"),
    )


def weighted_median(df: DataFrame, keys: Sequence[str], value: str, weight: str, block: Column) -> DataFrame:
    """Lower weighted median per key: first value whose cumulative weight reaches half the total.

    Values are pre-aggregated per key and block; only the block that holds the median is sorted.
    ``block`` must not decrease with the value.
    """
    usable = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).select(
        *keys, F.col(value).alias("_v"), F.col(weight).cast("decimal(28,12)").alias("_w"), block.alias("_block")
    )
    points = usable.groupBy(*keys, "_block", "_v").agg(F.sum("_w").alias("_w"))
    sums = points.groupBy(*keys, "_block").agg(F.sum("_w").alias("_sum"))
    per_key = Window.partitionBy(*keys)
    reached = per_key.orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sums.withColumn("_cum", F.sum("_sum").over(reached)).withColumn("_half", F.sum("_sum").over(per_key) / 2)
    middle = (
        ranked.where(F.col("_cum") >= F.col("_half"))
        .groupBy(*keys)
        .agg(F.min(F.struct("_block", "_cum", "_sum", "_half")).alias("_m"))
        .select(*keys, "_m.*")
    )
    inside = Window.partitionBy(*keys, "_block").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return (
        points.join(middle, [*keys, "_block"])
        .withColumn("_acc", F.sum("_w").over(inside) + F.col("_cum") - F.col("_sum"))
        .where(F.col("_acc") >= F.col("_half"))
        .groupBy(*keys)
        .agg(F.min("_v").alias(value))
    )
