"""Near-duplicate texts by 64-bit fingerprints, linked at a small Hamming distance through Golay codes.

A fingerprint holds, bit by bit, the majority over the hashes of a text's shingles. It is cut into segments of
23, 23 and 18 bits (filled up with zeros to 23). The binary Golay code is perfect: each 23-bit word lies within
three bits of exactly one codeword. Words also get the codewords four bits away as keys: one codeword if the
nearest is at most two bits away, six otherwise. Two words that differ in at most two bits share a key, as the
codeword nearest to a word between them is within four bits of both; in at most one bit, one's nearest codeword
is a key of the other.

Four wrong bits fall on the segments in one of these ways, each met by a joint key of 30 to 36 bits:

* one segment has none: its own bits, with a key of one of the other two, which has two wrong bits at most;
* all have some, so one has two at most and the others one each: a key of every segment, of which at least one
  is the nearest codeword. One text's keys have its nearest codeword in a segment of one wrong bit, the other's
  in the other such segment.

Equal fingerprints are one row from the start. Joint keys are counted, keys of a single fingerprint drop out,
and the rest meet by key. A key with more than STRIP_ROWS fingerprints is ordered by the distance from its smallest one
and cut into strips; only strips whose distances differ by at most the limit can hold a link and meet, in tasks of
their own. Tasks emit links as stars of what they connect, never all pairs of a group.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketloom.llm import words
from marketloom.llm.common import longs, pick, stored, unsigned
from marketloom.llm.graph import components, local_components

MAX_BITS = 4
SEED = 42
WIDTH = 4
#: Fingerprints of one key that a task compares; more are cut into strips.
STRIP_ROWS = 2048
#: Distinct fingerprints whose keys one task makes.
TASK_PRINTS = 1 << 15
#: Shingles that are hashed, and key rows that are written or compared, at once.
_SHINGLES = 1 << 15
_ROWS = 1 << 16
_HELD_LINKS = 1 << 20
#: Generator polynomial of the binary Golay code, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _joined(buffer: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a slab with one space after each, where they start and end there, and every text's first word."""
    starts, ends, firsts = words.spans(buffer, offsets, words.SPACES)
    sizes = ends - starts
    out = np.full(int(sizes.sum()) + len(sizes), 0x20, np.uint8)
    number = np.repeat(np.arange(len(sizes)), sizes)
    steps = np.arange(len(number))
    out[steps + number] = buffer[steps + (starts - (np.cumsum(sizes) - sizes))[number]]
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    return out.tobytes(), begins, begins + sizes, firsts


@lru_cache(1)
def _spread_bits() -> np.ndarray:
    """For every byte a number whose bytes are its bits, the lowest first."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def fingerprints(texts: pa.Array, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """The fingerprint of every text of a column: bits set in over half of the XXH64 hashes of its shingles, repeats included.

    Shingles are runs of ``width`` words joined by a space; a text with fewer words is one shingle, one without words has zero.
    """
    out = []
    for _, buffer, offsets in words.slabs(texts):
        data, begins, ends, firsts = _joined(words.lower(buffer), offsets)
        counts = np.diff(firsts)
        sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
        owner = np.repeat(np.arange(len(counts)), sizes)
        first = np.arange(len(owner)) - (np.cumsum(sizes) - sizes)[owner] + firsts[:-1][owner]
        last = first + np.minimum(width, counts[owner]) - 1
        begins, ends = begins[first], ends[last]
        set_in = np.zeros((len(counts), 64), np.int64)
        for at in range(0, len(owner), _SHINGLES):
            part = slice(at, at + _SHINGLES)
            cuts = map(slice, begins[part].tolist(), ends[part].tolist())
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(data.__getitem__, cuts), repeat(seed)), "<u8")
            own = owner[part]
            # eight byte-wide counters a number hold the bits of at most 255 hashes
            edges = np.union1d(np.flatnonzero(np.diff(own, prepend=-1)), np.arange(0, len(own), 255))
            counters = np.add.reduceat(_spread_bits()[hashes.view(np.uint8).reshape(-1, 8)], edges, axis=0)
            np.add.at(set_in, own[edges], counters.view(np.uint8).reshape(-1, 64))
        majority = 2 * set_in > sizes[:, None]
        out.append(np.packbits(majority, axis=1, bitorder="little").view("<u8")[:, 0])
    return np.concatenate(out) if out else np.zeros(0, "<u8")


def syndromes(word: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator; equal for words that differ by a codeword."""
    rest = word.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


@lru_cache(1)
def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """For every syndrome the error patterns of at most four bits, the lightest first, and how many there are."""
    found: list[list[int]] = [[] for _ in range(1 << 11)]
    for weight in range(5):
        errors = np.array([sum(1 << b for b in bits) for bits in combinations(range(23), weight)], np.int64)
        for syndrome, error in zip(syndromes(errors).tolist(), errors.tolist(), strict=True):
            found[syndrome].append(error)
    sizes = np.array([len(f) for f in found])
    table = np.zeros((1 << 11, sizes.max()), np.int64)
    for row, errors in zip(table, found, strict=True):
        row[: len(errors)] = errors
    return table, sizes


def indices(word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the codewords within four bits of each 23-bit word, the nearest first, and how many are valid."""
    table, sizes = _patterns()
    syndrome = syndromes(word)
    return (word[:, None] ^ table[syndrome]) >> 11, sizes[syndrome]


def segments(fp: np.ndarray) -> list[np.ndarray]:
    """Segments of 23, 23 and 18 bits as words."""
    low = (1 << 23) - 1
    return [(fp & words.U64(low)).astype(np.int64), (fp >> words.U64(23) & words.U64(low)).astype(np.int64), (fp >> words.U64(46)).astype(np.int64)]


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Joint keys of fingerprints, and the number of the fingerprint each belongs to.

    Any two fingerprints that differ in at most four bits share a key.
    """
    parts = segments(fp)
    near, counts = zip(*[indices(p) for p in parts], strict=True)
    found, owner = [], []

    def emit(kind: int, key: np.ndarray, valid: np.ndarray) -> None:
        found.append((key | kind << 36)[valid])
        owner.append(np.nonzero(valid)[0])

    most = near[0].shape[1]
    for i in range(most):
        for j in range(most):
            for k in range(most):
                if 0 in (i, j, k):
                    valid = (i < counts[0]) & (j < counts[1]) & (k < counts[2])
                    emit(0, near[0][:, i] << 24 | near[1][:, j] << 12 | near[2][:, k], valid)
    for kind, (whole, other) in enumerate([(0, 1), (1, 0), (2, 0), (2, 1), (1, 2), (0, 2)], 1):
        for i in range(most):
            emit(kind, parts[whole] << 12 | near[other][:, i], i < counts[other])
    return np.concatenate(found), np.concatenate(owner)


def _key_rows(batches):
    for batch in batches:
        fp = unsigned(batch["fp"])
        for start in range(0, len(fp), 512):
            part = fp[start : start + 512]
            key, owner = keys(part)
            yield pa.record_batch({"key": pa.array(key), "fp": longs(part[owner])})


def _links(limit: int):
    """Compare the fingerprints of each (key, low, high) cell, whose rows follow each other, and emit stars.

    With low = high all rows meet; otherwise rows of strip ``low`` meet those of strip ``high``.
    """

    def star(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
        a, b = np.concatenate(a), np.concatenate(b)
        nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = local_components(places[: len(a)], places[len(a) :], len(nodes))
        own = label != np.arange(len(nodes))
        return pa.record_batch({"a": longs(nodes[own]), "b": longs(nodes[label[own]])})

    def compared(cells: np.ndarray, fp: np.ndarray, strip: np.ndarray, low: np.ndarray, high: np.ndarray):
        a, b, held = [], [], 0
        left, step = np.arange(len(cells)), 0
        while len(left):
            step += 1
            left = left[: np.searchsorted(left, len(cells) - step)]
            left = left[cells[left + step] == cells[left]]
            close = np.bitwise_count(fp[left] ^ fp[left + step]) <= limit
            close &= (low[left] == high[left]) | (strip[left] != strip[left + step])
            a.append(fp[left[close]])
            b.append(fp[left[close] + step])
            held += len(a[-1])
            if held >= _HELD_LINKS:
                yield star(a, b)
                a, b, held = [], [], 0
        if held:
            yield star(a, b)

    def link(batches):
        held: list[pa.RecordBatch] = []
        rows = 0

        def taken(last: bool):
            nonlocal held, rows
            table = pa.Table.from_batches(held).combine_chunks()
            cell = np.stack([table[c].to_numpy() for c in ("key", "low", "high")])
            number = np.concatenate([[0], np.cumsum((cell[:, 1:] != cell[:, :-1]).any(0))])
            whole = table.num_rows if last else int(np.searchsorted(number, number[-1]))
            yield from compared(number[:whole], unsigned(table["fp"])[:whole], table["strip"].to_numpy()[:whole], cell[1][:whole], cell[2][:whole])
            held, rows = (table.slice(whole).to_batches(), table.num_rows - whole)

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= _ROWS:
                yield from taken(False)
        if rows:
            yield from taken(True)

    return link


def links(classes: DataFrame, limit: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) of fingerprints that connect all of the distinct ``fp`` longs that differ in ``limit`` bits at most.

    The edges are stars: what is connected by links is connected by edges and nothing else is.
    """
    if limit > MAX_BITS:
        raise ValueError(f"keys meet fingerprints of at most {MAX_BITS} differing bits")
    # a row here is about a hundred there, so tasks are cut by rows and not by bytes
    spread = classes.select("fp").repartition(max(-(-classes.count() // TASK_PRINTS), 1), "fp")
    rows = spread.mapInArrow(_key_rows, "key long, fp long")
    counted = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("least")).where("n > 1")
    busy = rows.join(stored(counted, "keys").hint("shuffle_hash"), "key")
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("least")))
    # strips by distance from the key's smallest fingerprint, and within a distance by hash
    crowd = F.greatest(F.ceil(F.col("n") / STRIP_ROWS), F.lit(1))
    wide = F.when(F.col("n") > STRIP_ROWS, far * crowd + F.pmod(F.xxhash64("fp"), crowd)).otherwise(0)
    placed = busy.select("key", "fp", "n", crowd.alias("crowd"), wide.cast("long").alias("strip"))
    reach = F.when(F.col("n") > STRIP_ROWS, F.col("crowd") * (limit + 1)).otherwise(0)
    # a strip meets itself and the strips of the same or the next ``limit`` distances; distances go from 0 to 64
    top = (F.floor(F.col("strip") / F.col("crowd")) + limit + 1) * F.col("crowd") - 1
    bottom = F.greatest((F.floor(F.col("strip") / F.col("crowd")) - limit) * F.col("crowd"), F.lit(0))
    others = F.when(reach == 0, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(bottom.cast("long"), top.cast("long")))
    cells = placed.withColumn("other", F.explode(others)).select(
        "key", F.least("strip", "other").alias("low"), F.greatest("strip", "other").alias("high"), "strip", "fp"
    )
    dealt = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return dealt.mapInArrow(_links(limit), "a long, b long")


def near_duplicates(docs: DataFrame, limit: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every document.

    Returns doc_id long, fingerprint string (16 lower-case hex digits) and component_id long: the smallest
    id reachable by links, null ids left out (null if there is no other). Two documents link when their
    fingerprints differ in at most ``limit`` bits. Null texts are empty ones, whose fingerprint is zero and
    links like any other. Repeated rows are returned each, null ids as null; an empty table gives no rows
    and further columns are ignored.
    """

    def prints(batches):
        for batch in batches:
            yield pa.record_batch({"doc_id": batch["doc_id"], "fp": longs(fingerprints(batch["text"]))})

    wanted = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    rows = stored(wanted.mapInArrow(prints, "doc_id long, fp long"), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(links(classes, limit))
    linked = classes.join(roots.withColumnRenamed("node", "fp"), "fp")
    smallest = linked.groupBy("root").agg(F.min("least").alias("component"))
    # joins between plain tables: adaptive execution can then split a fingerprint or a component that many rows have
    moved = roots.join(stored(smallest, "components"), "root").select(F.col("node").alias("fp"), "component")
    labels = classes.join(moved, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"))
    labels = stored(labels, "labels")
    return rows.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
