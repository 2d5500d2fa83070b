"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are short, documents long, so similarity of whole sets says nothing; the share of an item's
shingles that a document contains does. Items are partitioned by their number of shingles q. An item's
signature is its q - ceil(c q) + 1 smallest shingle hashes: a document that contains the share c of the
item must contain one of them, so the search has no false negatives. Documents look their shingles up
in the signatures of the partitions they are large enough for, and candidates are verified on the
item's whole shingle set.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import words as W
from marketloom.llm.common import pick, stored, where_column

CONTAINMENT = Fraction(4, 5)
WIDTH = 5
#: Shingles of the items that are searched for at once; more items are searched in further passes.
BLOCK_SHINGLES = 2_000_000
_TABLE_BITS = 20


@dataclass
class Signatures:
    """Search index of one block of items."""

    ids: list
    sets: list[np.ndarray]
    need: np.ndarray
    width: int

    def __post_init__(self):
        self.partitions = []
        sizes = np.array([len(s) for s in self.sets], np.int64)
        for level in np.unique(np.log2(np.maximum(sizes, 1)).astype(int)) if len(sizes) else []:
            items = np.flatnonzero(np.log2(np.maximum(sizes, 1)).astype(int) == level)
            hashes = np.concatenate([self.sets[i][: sizes[i] - self.need[i] + 1] for i in items])
            owner = np.concatenate([np.full(sizes[i] - self.need[i] + 1, i) for i in items])
            order = np.argsort(hashes, kind="stable")
            table = np.zeros(1 << _TABLE_BITS, bool)
            table[(hashes >> W.U64(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.partitions.append((int(self.need[items].min()), table, hashes[order], owner[order]))

    def matches(self, texts: pa.Array):
        """Yield (row, item number, shared shingles) of every text that contains enough of an item."""
        for first, buffer, offsets in W.slabs(texts):
            buffer = W.lower(buffer)
            starts, ends, firsts = W.spans(buffer, offsets, W.NOT_ALNUM)
            hashes, begins = W.shingle_hashes(W.word_hashes(buffer, starts, ends), firsts, self.width)
            place = (hashes >> W.U64(64 - _TABLE_BITS)).astype(np.int64)
            candidates: set[tuple[int, int]] = set()
            for least, table, signature, owner in self.partitions:
                hit = np.flatnonzero(table[place])
                low, high = np.searchsorted(signature, hashes[hit], "left"), np.searchsorted(signature, hashes[hit], "right")
                found = high > low
                rows = np.searchsorted(begins, hit[found], "right") - 1
                for row, a, b in zip(rows.tolist(), low[found].tolist(), high[found].tolist(), strict=True):
                    if begins[row + 1] - begins[row] >= least:
                        candidates.update((row, int(i)) for i in owner[a:b])
            own, whole = -1, None
            for row, item in sorted(candidates):
                if row != own:
                    own, whole = row, np.unique(hashes[begins[row] : begins[row + 1]])
                wanted = self.sets[item]
                at = np.minimum(np.searchsorted(whole, wanted), len(whole) - 1)
                shared = int((whole[at] == wanted).sum())
                if shared >= self.need[item]:
                    yield first + row, item, shared


def index(items: DataFrame, containment: Fraction = CONTAINMENT, width: int = WIDTH, id_col: str = "item_id", text_col: str = "text") -> list[Signatures]:
    """Signatures of all items, in blocks of bounded size. Items without words are never found."""

    def shingle(batches):
        for batch in batches:
            sets = [s for _, s in W.shingle_sets(batch["text"], width, W.NOT_ALNUM)]
            yield pa.record_batch({"item_id": batch["item_id"], "n": pa.array([len(s) for s in sets], pa.int64()), "members": pa.array([s.tobytes() for s in sets], pa.binary())})

    wanted = pick(items, item_id=(id_col, "long"), text=(text_col, "string"))
    sets = stored(wanted.mapInArrow(shingle, "item_id long, n long, members binary").where("n > 0"), "items")
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = -(-total // BLOCK_SHINGLES)
    share = Fraction(containment)
    out = []
    for block in range(blocks):
        rows = sets.where(F.pmod(F.xxhash64("members"), F.lit(blocks)) == block).collect()
        members = [np.frombuffer(r["members"], np.uint64) for r in rows]
        need = np.array([-(-share.numerator * len(s) // share.denominator) for s in members], np.int64)
        out.append(Signatures([r["item_id"] for r in rows], members, need, width))
    return out


def contaminated(docs: DataFrame, items: DataFrame, containment: Fraction = CONTAINMENT, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item of which the document contains at least the share.

    Returns doc_id, item_id, n_shared and n_item long, containment double. Words are runs of ASCII letters,
    digits and non-ASCII characters, lower-cased in A-Z; an item of fewer than ``width`` words is one
    shingle and matches only a text that is that sequence. Null and empty texts match nothing; null ids are
    returned as null; repeated documents or items give a row each; further columns are ignored.
    """
    spark = docs.sparkSession
    wanted = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    kind = "doc_id long, item_id long, n_shared long, n_item long, containment double"
    parts = [wanted.mapInArrow(_pairs(spark.sparkContext.broadcast(block)), kind) for block in index(items, containment, width)]
    out = spark.createDataFrame([], kind)
    for part in parts:
        out = out.unionByName(part)
    return out


def clean(docs: DataFrame, items: DataFrame, containment: Fraction = CONTAINMENT, width: int = WIDTH, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that contain no item to the share."""
    out = docs
    for block in index(items, containment, width):
        flag = F.arrow_udf(_touched(docs.sparkSession.sparkContext.broadcast(block)), "boolean")
        out = where_column(out, text_col, lambda text, flag=flag: ~flag(text.cast("string")))
    return out


def _touched(held):
    def touched(texts: pa.Array) -> pa.Array:
        flags = np.zeros(len(texts), bool)
        for row, _, _ in held.value.matches(texts):
            flags[row] = True
        return pa.array(flags)

    return touched


def _pairs(held):
    def match(batches):
        for batch in batches:
            found = list(held.value.matches(batch["text"]))
            if found:
                rows, numbers, shared = (list(x) for x in zip(*found, strict=True))
                sizes = [len(held.value.sets[i]) for i in numbers]
                yield pa.record_batch(
                    {
                        "doc_id": batch["doc_id"].take(pa.array(rows)),
                        "item_id": pa.array([held.value.ids[i] for i in numbers], pa.int64()),
                        "n_shared": pa.array(shared, pa.int64()),
                        "n_item": pa.array(sizes, pa.int64()),
                        "containment": pa.array([s / n for s, n in zip(shared, sizes, strict=True)], pa.float64()),
                    }
                )

    return match
