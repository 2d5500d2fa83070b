"""Near-duplicate search over 64-bit signatures: pairs within a Hamming distance, without comparing all with all."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.functions.text import hamming

#: Blocks of bits that two signatures must have in common before they are compared.
SHARED_BLOCKS = 3


def masks(distance: int, shared: int = SHARED_BLOCKS) -> list[int]:
    """Bit masks of every choice of ``shared`` out of ``distance + shared`` blocks of a signature.

    So many blocks cannot all hold one of ``distance`` differing bits: ``shared`` are left equal.
    """
    blocks = distance + shared
    edges = [64 * i // blocks for i in range(blocks + 1)]
    bits = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    found = [sum(chosen) for chosen in combinations(bits, shared)]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def signature_classes(signed: DataFrame, id_col: str, signature: str) -> DataFrame:
    """One row per signature: the smallest id that carries it, and how many rows do.

    Exact copies meet here and are one row from then on.
    """
    usable = signed.where(F.col(signature).isNotNull())
    return usable.groupBy(signature).agg(F.min(id_col).alias("class_id"), F.count("*").alias("members"))


def membership(signed: DataFrame, classes: DataFrame, signature: str) -> DataFrame:
    """Every row of ``signed`` with its class."""
    return signed.join(classes, signature)


def close_pairs(classes: DataFrame, signature: str, distance: int) -> DataFrame:
    """Pairs (class_a < class_b) of classes whose signatures differ in 1 to ``distance`` bits.

    Classes meet on each choice of equal blocks. Two that agree on several choices are one pair: that of the first
    choice they agree on. A choice that very many share is split at run time like any skewed join key.
    """
    chosen = masks(distance)
    keyed = classes.select(
        "class_id",
        F.col(signature).alias("_s"),
        F.posexplode(F.array(*[F.col(signature).bitwiseAND(F.lit(m)) for m in chosen])).alias("_choice", "_key"),
    )
    left, right = keyed.alias("l"), keyed.alias("r")
    gap = hamming(F.col("l._s"), F.col("r._s"))

    def first_choice() -> Column:
        apart = F.col("l._s").bitwiseXOR(F.col("r._s"))
        return F.array_position(F.array(*[apart.bitwiseAND(F.lit(m)) == 0 for m in chosen]), F.lit(True)) - 1

    same = (F.col("l._choice") == F.col("r._choice")) & (F.col("l._key") == F.col("r._key"))
    met = left.join(right, same & (F.col("l.class_id") < F.col("r.class_id")) & (gap <= distance))
    return met.where(first_choice() == F.col("l._choice")).select(
        F.col("l.class_id").alias("class_a"), F.col("r.class_id").alias("class_b"), gap.alias("distance")
    )
