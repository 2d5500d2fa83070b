"""Exact top-k inner products over blocks of vectors, pruned block at a time.

Vectors are integers per dimension ("terms"). They are sorted so that neighbours share their largest
terms, and cut into blocks that keep their rows as a forward index and the largest and smallest value
of each term. For a query the sum over terms of the better of both products bounds every score in a
block. Blocks are scored from the highest bound down, until the bound cannot beat the k-th score.

Shards of blocks meet tiles of queries in one task each; only k rows per query and shard leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketloom.llm.common import pick, stored

BLOCK_ROWS = 256
SHARD_ROWS = 16384
TILE_QUERIES = 2048
LARGEST = 1 << 62


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """vec_id and the terms floor(scale * x), without vectors that are null or hold null or non-finite components.

    Rows with a null id leave, too; an empty vector scores 0. A term beyond LARGEST is held at that limit.
    """
    wanted = pick(vectors, vec_id=(id_col, "long"), vector=(vector_col, "array<double>")).where("vec_id is not null and vector is not null")
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def term(x):
        return F.floor(F.least(F.greatest(F.lit(float(scale)) * x, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("long")

    return wanted.where(sound).select("vec_id", F.transform("vector", term).alias("terms"))


def search(vectors: DataFrame, k: int, every: int, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k best scored vectors of every query.

    Queries are the rows whose id is divisible by ``every``; candidates are all other rows than the query's
    own. Returns query_id long, rank int (from 1), vec_id long, score long: all candidates if fewer than k,
    ties to the smaller vec_id. A repeated row is a candidate of its copies, and each copy that is a query
    has rows of its own. Vectors of different lengths are filled up with zeros. Null or non-finite
    components, null vectors and null ids take no part; an empty table gives no rows; further columns are
    ignored. Terms beyond 2**62 are held there, and scores beyond a long are cut off at its limits before they are ranked.
    """
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id())
    largest = F.array_max(F.transform("terms", lambda x: F.abs(x)))
    leading = F.array_position(F.transform("terms", lambda x: F.abs(x)), largest)
    rows = stored(rows.withColumn("lead", F.coalesce(leading * F.signum(F.element_at("terms", F.greatest(leading, F.lit(1)).cast("int"))), F.lit(0.0)).cast("long")), "terms")
    total = rows.count()
    shards = max(1, -(-total // SHARD_ROWS))
    tiles = max(1, -(-(total // every + 1) // TILE_QUERIES))
    placed = rows.repartitionByRange(shards, "lead", "row").withColumn("shard", F.spark_partition_id())
    blocks = placed.select("shard", F.lit(None).cast("int").alias("tile"), "row", "vec_id", "lead", "terms")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.pmod(F.hash("row"), F.lit(tiles)).alias("tile"), "row", "vec_id", "terms")
    tile_list = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    shard_list = F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    left = blocks.drop("tile").withColumn("tile", tile_list)
    right = queries.withColumn("shard", shard_list)
    found = left.groupBy("shard", "tile").cogroup(right.groupBy("shard", "tile")).applyInArrow(_score(k), "query_row long, query_id long, vec_id long, row long, score long")
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(flat.offsets.to_numpy())
    values = flat.flatten().to_numpy()
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = values
    return out


def _width(column) -> int:
    return max((len(x) for x in column), default=0)


def _score(k: int):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        width = max(_width(left["terms"]), _width(right["terms"]))
        docs, queries = _matrix(left["terms"], width), _matrix(right["terms"], width)
        ids, rows, lead = (left[c].to_numpy() for c in ("vec_id", "row", "lead"))
        nearby = np.lexsort((rows, lead))
        docs, ids, rows = docs[nearby], ids[nearby], rows[nearby]
        query_rows, query_ids = right["row"].to_numpy(), right["vec_id"].to_numpy()
        at, number, value = top_blocks(docs, ids, rows, queries, query_rows, k)
        return pa.table({"query_row": query_rows[at], "query_id": query_ids[at], "vec_id": ids[number], "row": rows[number], "score": value.astype(np.int64)})

    return score


def top_blocks(docs, ids, rows, queries, query_rows, k):
    """(query number, document number, score) of each query's k best of one shard, in no set order."""
    count, asked = len(ids), len(query_rows)
    if not count or not asked:
        none = np.zeros(0, np.int64)
        return none, none, none
    number_of = np.lexsort((rows, ids))  # ties: the smaller id, then the earlier row
    tie = np.empty(count, np.int64)
    tie[number_of] = np.arange(count)
    largest = int(np.abs(docs).max(initial=0)) * int(np.abs(queries).max(initial=0)) * max(docs.shape[1], 1)
    exact = np.float64 if largest < 2**50 and largest * count < 2**61 else object
    docs, queries = docs.astype(exact), queries.astype(exact)
    whole = np.int64 if exact is np.float64 else object
    limit = np.iinfo(np.int64)

    def held(score):
        # numbers that a long cannot hold are cut off before they are compared, so that all tasks order alike
        return score.astype(whole) if whole is np.int64 else np.clip(score, int(limit.min), int(limit.max))

    starts = np.arange(0, count, BLOCK_ROWS)
    ends = np.minimum(starts + BLOCK_ROWS, count)
    high = np.stack([docs[s:e].max(0) for s, e in zip(starts, ends, strict=True)])
    low = np.stack([docs[s:e].min(0) for s, e in zip(starts, ends, strict=True)])
    zero = queries * 0
    bound = held(np.maximum(queries, zero) @ high.T + np.minimum(queries, zero) @ low.T)
    first_tie = np.array([tie[s:e].min() for s, e in zip(starts, ends, strict=True)])
    # one number orders by score, then by smaller tie; scores of different rows never meet
    best_key = bound * count + (count - 1 - first_tie)
    order = np.argsort(-bound, axis=1, kind="stable")
    own = {int(r): i for i, r in enumerate(rows)}
    own = np.array([own.get(int(r), -1) for r in query_rows])
    nothing = -(max(largest, 1 << 63) + 1) * count - 1 if whole is object else -(largest + 1) * count - 1
    top = np.full((asked, k), nothing, whole)
    for step in range(len(starts)):
        turn = order[:, step]
        active = best_key[np.arange(asked), turn] > top.min(1)
        if not active.any():
            # bounds only fall from here, so a query whose bound cannot beat its k-th score is done
            later = bound[np.arange(asked), turn] * count + count - 1 > top.min(1)
            if not later.any():
                break
            continue
        for block in np.unique(turn[active]):
            at = np.flatnonzero(active & (turn == block))
            s, e = starts[block], ends[block]
            keys = held(queries[at] @ docs[s:e].T) * count + (count - 1 - tie[s:e])
            inside = (own[at] >= s) & (own[at] < e)
            keys[np.flatnonzero(inside), own[at][inside] - s] = nothing
            both = np.concatenate([top[at], keys], axis=1)
            both.sort(axis=1) if whole is object else both.partition(both.shape[1] - k, axis=1)
            top[at] = both[:, -k:]
    at, place = np.nonzero(top != nothing)
    key = top[at, place]
    value = key // count
    return at, number_of[(count - 1 - (key - value * count)).astype(np.int64)], value
