"""Vector code compression: product codes whose codebooks are fitted with pivot distances, all in whole numbers.

Every component becomes floor(scale * x). Vectors are cut into equal consecutive parts, and each part position
has a codebook that starts from the vectors of the smallest ids. A round assigns every part to its nearest entry
and moves the entries to the floored mean of their parts.

Nearest entries are found by LAESA. A few pivots per part position, spread over the first codebook, stay fixed, so
the distances of all parts to them are computed once and stored with the vectors. A round computes the distances
from its entries to the pivots; the difference of both distances bounds the distance of part and entry from below.
Entries are tried from the lowest bound up, and only those whose bound does not exceed the best exact distance are
evaluated. Stored distances are rounded, so bounds are lowered by more than the rounding; evaluations are exact.

Tasks add up their parts per entry and component before anything is shuffled. Only codebooks, whose size is
fixed by parameters and the vectors' width, reach the driver.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import pick, stored
from marketloom.llm.topk import _matrix

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024.0
PIVOTS = 8
#: Entries of the lowest bounds that are evaluated before all others are held against the best of them.
FIRST_TRIED = 12
#: Terms beyond stay at this limit.
LARGEST = 1 << 62
_LONG = (1 << 63) - 1
_LIMB = 31
_SLACK = 2.0**-21


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: float) -> DataFrame:
    """vec_id, label and the terms floor(scale * x) of vectors that are not null and hold finite components only."""
    kind = vectors.schema.fields[vectors.columns.index(label_col)].dataType.simpleString()
    wanted = pick(vectors, vec_id=(id_col, "long"), label=(label_col, kind), vector=(vector_col, "array<double>"))
    sound = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))

    def term(x: Column) -> Column:
        value = F.least(F.greatest(F.lit(float(scale)) * x, F.lit(float(-LARGEST))), F.lit(float(LARGEST)))
        return F.floor(value).cast("long")

    return wanted.where("vector is not null").where(sound).select("vec_id", "label", F.transform("vector", term).alias("terms"))


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances of rows of whole numbers, exact: beyond 64 bits as Python numbers."""
    largest = max(int(np.abs(a).max(initial=0)), int(np.abs(b).max(initial=0)))
    if 4 * largest * largest * max(a.shape[-1], 1) * ENTRIES >= 1 << 62:
        a, b = a.astype(object), b.astype(object)
    apart = a - b
    return (apart * apart).sum(-1)


def pivots(entries: np.ndarray, count: int) -> np.ndarray:
    """Numbers of ``count`` entries, each as far as possible from those before it (the first entry, then ties, by number)."""
    chosen = [0]
    nearest = squares(entries, entries[:1])
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(np.argmax(nearest)))
        nearest = np.minimum(nearest, squares(entries, entries[chosen[-1:]]))
    return np.array(chosen)


def distances(a: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of all rows to all points, rounded to 32-bit floats."""
    found = [np.sqrt(squares(a, p[None]).astype(np.float64)) for p in points]
    return np.stack(found, axis=1).astype(np.float32)


def nearest(parts: np.ndarray, far: np.ndarray, entries: np.ndarray, entry_far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of every part's nearest entry, ties to the lower number.

    ``far`` and ``entry_far`` are the distances of parts and entries to the pivots.
    """
    total = len(entries)
    bound = np.zeros((len(parts), total))
    for own, other in zip(far.T.astype(np.float64), entry_far.T.astype(np.float64), strict=True):
        own = own[:, None]
        np.maximum(bound, np.abs(own - other) - (own + other) * _SLACK, out=bound)
    bound *= bound * (1 - _SLACK)
    rows = np.arange(len(parts))
    tried = min(FIRST_TRIED, total)
    order = np.argpartition(bound, tried - 1, axis=1)[:, :tried] if tried < total else np.tile(np.arange(total), (len(parts), 1))
    # one number orders by distance, then by the entry's number
    best = squares(parts, entries[order[:, 0]]) * total + order[:, 0]
    for turn in range(1, tried):
        left = np.flatnonzero(bound[rows, order[:, turn]] <= (best // total).astype(np.float64))
        number = order[left, turn]
        best[left] = np.minimum(best[left], squares(parts[left], entries[number]) * total + number)
    bound[rows[:, None], order] = np.inf
    row, number = np.nonzero(bound <= (best // total).astype(np.float64)[:, None])
    for start in range(0, len(row), 1 << 16):
        some, of = row[start : start + (1 << 16)], number[start : start + (1 << 16)]
        key = squares(parts[some], entries[of]) * total + of
        first = np.flatnonzero(np.diff(some, prepend=-1))
        best[some[first]] = np.minimum(best[some[first]], np.minimum.reduceat(key, first))
    return (best % total).astype(np.int64), best // total


@dataclass
class Codebooks:
    """Entries of all part positions (part, entry, place) and their pivots' distances."""

    entries: np.ndarray
    points: np.ndarray

    def __post_init__(self):
        self.far = np.stack([distances(e, p) for e, p in zip(self.entries, self.points, strict=True)])

    def assign(self, terms: np.ndarray, far: np.ndarray):
        """Number and squared distance of the nearest entry, for part after part."""
        for part, (entries, entry_far) in enumerate(zip(self.entries, self.far, strict=True)):
            wide, many = entries.shape[1], entry_far.shape[1]
            yield nearest(terms[:, part * wide : (part + 1) * wide], far[:, part * many : (part + 1) * many], entries, entry_far)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _far(batch: pa.RecordBatch) -> np.ndarray:
    return batch["far"].flatten().to_numpy().reshape(batch.num_rows, -1)


def _moved(rows: DataFrame, books: Codebooks) -> np.ndarray:
    """The entries after one round."""
    shared = rows.sparkSession.sparkContext.broadcast(books)
    parts, total, wide = books.entries.shape

    def add(batches):
        sums, counts = np.zeros((parts, total, wide), object), np.zeros((parts, total), np.int64)
        for batch in batches:
            terms, far = _matrix(batch["terms"], parts * wide), _far(batch)
            for part, (number, _) in enumerate(shared.value.assign(terms, far)):
                own = terms[:, part * wide : (part + 1) * wide]
                order = np.argsort(number, kind="stable")
                first = np.flatnonzero(np.diff(number[order], prepend=-1))
                some = own[order] if np.abs(own).max(initial=0) < 1 << 40 else own[order].astype(object)
                sums[part, number[order][first]] += np.add.reduceat(some, first, axis=0)
                counts[part] += np.bincount(number, minlength=total)
        part, entry = np.nonzero(counts)
        flat = sums[part, entry].ravel()
        mask = (1 << _LIMB) - 1
        limbs = [flat & mask, flat >> _LIMB & mask, flat >> 2 * _LIMB]
        columns = {"part": np.repeat(part, wide), "entry": np.repeat(entry, wide), "place": np.tile(np.arange(wide), len(part)), "n": np.repeat(counts[part, entry], wide)}
        columns |= {f"s{i}": limb.astype(np.int64) for i, limb in enumerate(limbs)}
        yield pa.record_batch({k: pa.array(v, pa.int64()) for k, v in columns.items()})

    # totals of three limbs of 31 bits, so that no sum can leave a long
    found = rows.mapInArrow(add, "part long, entry long, place long, n long, s0 long, s1 long, s2 long").groupBy("part", "entry", "place")
    sums = found.agg(*[F.sum(c).alias(c) for c in ("n", "s0", "s1", "s2")]).collect()
    entries = books.entries.copy()
    for part, entry, place, n, *limbs in sums:
        entries[part, entry, place] = sum(limb << i * _LIMB for i, limb in enumerate(limbs)) // n
    return entries


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: float = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """Code and error of every vector after ``rounds`` rounds.

    Returns vec_id long, code string (two hex digits per part), error long (squared distances to the final
    entries), label_error long (the errors of equal labels added up, null labels together) and
    codebooks_sha256 string. Vectors that are null or hold null or non-finite components are left out. Vectors
    of different lengths are filled up with zeros, as is a length that the parts do not divide. Rows of one id start
    codebooks in the order of their terms; null ids come last. With fewer vectors than entries codebooks are smaller.
    Terms beyond 2**62 are held at that limit and errors at the limit of a long; everything else is exact. Repeated
    rows count and are returned each, an empty table gives no rows, further columns are ignored.
    """
    if entries > ENTRIES:
        raise ValueError(f"a part's code has two hex digits, for {ENTRIES} entries at most")
    spark = vectors.sparkSession
    rows = integers(vectors, id_col, vector_col, label_col, scale)
    longest = rows.agg(F.max(F.size("terms"))).first()[0] or 0
    wide = max(-(-longest // parts), 1)
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "terms").limit(entries).select("terms").collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    start = np.zeros((len(first), parts * wide), np.int64)
    for row, (terms,) in zip(start, first, strict=True):
        row[: len(terms)] = terms
    start = start.reshape(len(first), parts, wide).transpose(1, 0, 2)
    points = np.stack([e[pivots(e, PIVOTS)] for e in start])

    def measure(batches):
        for batch in batches:
            terms = _matrix(batch["terms"], parts * wide)
            far = np.concatenate([distances(terms[:, i * wide : (i + 1) * wide], p) for i, p in enumerate(points)], axis=1)
            cut = pa.array(np.arange(0, far.size + 1, far.shape[1]), pa.int32())
            yield pa.record_batch({"vec_id": batch["vec_id"], "label": batch["label"], "terms": batch["terms"], "far": pa.ListArray.from_arrays(cut, pa.array(far.ravel()))})

    label = rows.schema["label"].dataType.simpleString()
    measured = stored(rows.mapInArrow(measure, f"vec_id long, label {label}, terms array<long>, far array<float>"), "measured")
    books = Codebooks(start, points)
    for _ in range(rounds):
        books = Codebooks(_moved(measured, books), points)
    shared = spark.sparkContext.broadcast(books)

    def code(batches):
        for batch in batches:
            found = list(shared.value.assign(_matrix(batch["terms"], parts * wide), _far(batch)))
            digits = np.stack([number for number, _ in found], axis=1).astype(np.uint8)
            error = [min(int(e), _LONG) for e in sum(distance for _, distance in found)]
            yield pa.record_batch({"vec_id": batch["vec_id"], "label": batch["label"], "code": pa.array([d.tobytes().hex() for d in digits]), "error": pa.array(error, pa.int64())})

    coded = stored(measured.mapInArrow(code, f"vec_id long, label {label}, code string, error long"), "codes")
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    by_label = coded.groupBy(F.col("label").alias("of")).agg(total.alias("label_error"))
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
