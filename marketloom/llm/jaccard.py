"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The product of the incidence matrix with its transpose holds the overlap of every two documents.
Only the part that can reach the threshold is formed:

1. Documents with equal shingle sets are one row of the matrix. A counting sketch of fixed size,
   summed over all tasks, orders n-grams from rare to frequent. It never counts too low.
2. Of n sorted shingles, two sets that reach the threshold share one of the first
   n - ceil(t n) + 1 of either, so only those columns are searched. A rare column holds at most as
   many rows as the sketch's bound; its pairs are tested by size and by a parity sketch whose
   differing bits never exceed the symmetric difference. A frequent column is not searched pair by
   pair: it only joins its rows into one block.
3. Rows that hang together form a block. Large blocks are cut into strips, and every two strips are
   multiplied by column blocks in one task. Pairs whose overlap so far plus what remains stays below
   the bound that their sizes set are dropped on the way. Exact overlaps remain.
4. Links are reduced to components by aggregation.

No pair of documents is emitted as a row, and no step is approximate apart from the equality of
64-bit hashes.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm import words as W
from marketloom.llm.common import cut, longs, packed_counts, pick, stored, summed_counts, unsigned
from marketloom.llm.graph import components, local_components

CELL_BITS = 22
_CELL_SHIFT = W.U64(64 - CELL_BITS)
_PARITY_BITS = (64, 1 << 14)
STRIP_ROWS, STRIP_SHINGLES = 2048, 2_000_000
_COLUMN_BLOCK = 4096
#: Rows and columns of the product that are formed at once.
_TILE_ROWS = 512
_BLOOM_BITS = 27


def set_hash(mixed: np.ndarray) -> int:
    """Hash of a set from the mixed hashes of its members, in any order."""
    total = np.array([len(mixed)], np.uint64) * W.U64(0x9E3779B97F4A7C15) + np.add.reduce(mixed, dtype=np.uint64)
    return int(W.mix(total).view(np.int64)[0])


def parity(mixed: np.ndarray) -> bytes:
    """Per bit, whether an odd number of members falls on it. Halves fold together by exclusive or."""
    bits = 1 << max(len(mixed) - 1, 1).bit_length()
    bits = min(max(bits, _PARITY_BITS[0]), _PARITY_BITS[1])
    odd = np.bincount((mixed & W.U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _prefix(n: int, t: Fraction) -> int:
    return n - -(-t.numerator * n // t.denominator) + 1


def similar(docs: DataFrame, threshold: Fraction, width: int, id_col: str = "doc_id", text_col: str = "text", ends_word=W.SPACES, row_col: str | None = None) -> DataFrame:
    """One row per document with its similarity class.

    Returns row_id long (``row_col``, distinct in every row; without it a number of the row), doc_id long, n_shingles
    long, component_id long, n_links long (documents linked directly), stays boolean (true for one row
    of every class: the smallest doc_id, and of equal ones the first row).

    Words are lower-cased in A-Z; a text with fewer than ``width`` words is one shingle. Null and empty
    texts, and texts of separators only, have no shingle, link with nothing and are classes of their own.
    Null doc_ids take part; a class has a null component_id only when all its ids are null. Repeated rows
    are documents of equal sets. ``docs`` must give the same rows, in any order, when read again, as
    tables do. Without ``row_col`` the number is that of one scan: another scan may be split otherwise and
    number the rows anew, so it cannot be joined to ``docs``. Further columns are ignored.
    """
    t = Fraction(threshold)
    spark = docs.sparkSession
    wanted = {"doc_id": (id_col, "long"), "text": (text_col, "string")} | ({"row_id": (row_col, "long")} if row_col else {})
    row_id = F.col("row_id") if row_col else F.monotonically_increasing_id().alias("row_id")
    rows = pick(docs, **wanted).select(row_id, "doc_id", "text")
    scanned = stored(rows.mapInArrow(_scanner(width, ends_word), "row_id long, doc_id long, n long, fp long, parity binary, chunk int, counts binary"), "shingled")
    cells = summed_counts(scanned.where("chunk is not null").select("chunk", "counts"), 1 << CELL_BITS, ["counts"])[0]
    load = cells.sum() / len(cells)
    bound = int(8 + load + 6 * load**0.5)
    order = spark.sparkContext.broadcast(np.minimum(cells, 65535).astype(np.uint16))
    known = scanned.where("chunk is null")
    classes = known.where("n > 0").groupBy("fp", "n", "parity").agg(F.count("*").alias("copies"))

    prefixes = rows.select("text").mapInArrow(_prefixer(width, ends_word, t, order, bound), "spot long, token long, fp long, frequent boolean")
    members = stored(prefixes.repartition("spot").sortWithinPartitions("token", "fp").mapInArrow(_shared, "token long, fp long, frequent boolean"), "columns")
    sized = members.where("not frequent").select("token", "fp").join(classes.select("fp", "n", "parity"), "fp")
    near = sized.repartition("token").sortWithinPartitions("token").mapInArrow(_near(t), "a long, b long")
    frequent = members.where("frequent").select(F.col("fp").alias("a"), F.col("token").alias("b"))
    blocks = components(near.unionByName(frequent))

    inside = classes.select("fp", "n", "copies").join(blocks.select(F.col("node").alias("fp"), F.col("root").alias("block")), "fp")
    inside = cut(inside)
    widths = inside.groupBy("block").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles")).where("rows > 1")
    strips = F.greatest(F.ceil(F.col("rows") / STRIP_ROWS), F.ceil(F.col("shingles") / STRIP_SHINGLES)).cast("int")
    inside = inside.join(widths.select("block", strips.alias("strips")), "block")
    bloom = spark.sparkContext.broadcast(_bloom(inside.select("fp")))
    sets = rows.select("text").mapInArrow(_setter(width, ends_word, bloom), "fp long, members binary")
    placed = sets.join(inside, "fp").withColumn("strip", F.pmod(F.hash("fp"), "strips"))
    other = F.explode(F.sequence(F.lit(0), F.col("strips") - 1))
    placed = placed.withColumn("other", other).withColumn("low", F.least("strip", "other")).withColumn("high", F.greatest("strip", "other"))
    product = placed.groupBy("block", "low", "high").applyInArrow(_product(t), "fp long, root long, links long")
    product = cut(product.groupBy("fp", "root").agg(F.sum("links").alias("links")))

    roots = components(product.select(F.col("fp").alias("a"), F.col("root").alias("b")))
    degrees = product.groupBy("fp").agg(F.sum("links").alias("links"))
    by_class = known.where("n > 0").groupBy("fp").agg(F.count("*").alias("copies"), F.min(_order()).alias("head"))
    by_class = by_class.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").join(degrees, "fp", "left")
    by_class = by_class.withColumn("root", F.coalesce("root", "fp")).withColumn("links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
    heads = by_class.groupBy("root").agg(F.min("head").alias("head"))
    by_class = by_class.select("fp", "root", "links").join(heads, "root").select("fp", "links", "head")
    out = known.select("row_id", "doc_id", "n", "fp").join(by_class, "fp", "left")
    return out.select(
        "row_id",
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"),
        (F.col("head").isNull() | (F.col("head.row_id") == F.col("row_id"))).alias("stays"),
    )


def _order() -> Column:
    """Smallest doc_id first, nulls last, then the first row."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")


def one_per_class(docs: DataFrame, threshold: Fraction, width: int, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, all columns as they are.

    The rows are numbered once and written with their numbers, so those that are found and those that are
    dropped are the same however later scans are split.
    """
    places = [f"_{i}" for i in range(len(docs.columns))]  # names that differ in case only cannot be written
    numbered = stored(docs.toDF(*places).withColumn("row", F.monotonically_increasing_id()), "numbered")
    id_col, text_col = (places[docs.columns.index(name)] for name in (id_col, text_col))
    found = similar(numbered, threshold, width, id_col=id_col, text_col=text_col, row_col="row", **names)
    gone = found.where("not stays").select(F.col("row_id").alias("row"))
    return numbered.join(gone, "row", "left_anti").select(*places).toDF(*docs.columns)


def _scanner(width, ends_word):
    def scan(batches):
        cells = np.zeros(1 << CELL_BITS, np.uint32)
        for batch in batches:
            sizes, prints, parities = [], [], []
            for _, s in W.shingle_sets(batch["text"], width, ends_word):
                np.add.at(cells, (s >> _CELL_SHIFT).astype(np.int64), 1)
                mixed = W.mix(s)
                sizes.append(len(s))
                prints.append(set_hash(mixed))
                parities.append(parity(mixed) if len(s) else None)
            none = pa.nulls(batch.num_rows)
            yield pa.record_batch({"row_id": batch["row_id"], "doc_id": batch["doc_id"], "n": pa.array(sizes, pa.int64()), "fp": pa.array(prints, pa.int64()), "parity": pa.array(parities, pa.binary()), "chunk": none.cast(pa.int32()), "counts": none.cast(pa.binary())})
        for chunk, (blob,) in packed_counts([cells]):
            none = pa.nulls(1, pa.int64())
            yield pa.record_batch({"row_id": none, "doc_id": none, "n": none, "fp": none, "parity": pa.nulls(1, pa.binary()), "chunk": pa.array([chunk], pa.int32()), "counts": pa.array([blob], pa.binary())})

    return scan


def _prefixer(width, ends_word, t, order, bound):
    def scan(batches):
        counts, seen = order.value, set()
        for batch in batches:
            tokens, prints, frequent = [], [], []
            for _, s in W.shingle_sets(batch["text"], width, ends_word):
                if not len(s):
                    continue
                mixed = W.mix(s)
                fp = set_hash(mixed)
                if fp in seen:  # copies are one row of the matrix
                    continue
                seen.add(fp)
                count = counts[(s >> _CELL_SHIFT).astype(np.int64)]
                rank = (count.astype(np.uint64) << W.U64(48)) | (mixed >> W.U64(16))
                length = _prefix(len(s), t)
                chosen = np.argpartition(rank, length - 1)[:length] if length < len(s) else slice(None)
                tokens.append(s[chosen])
                prints.append(np.full(length, fp, np.int64))
                frequent.append(count[chosen] > bound)
            if tokens:
                token, fp, often = np.concatenate(tokens).view(np.int64), np.concatenate(prints), np.concatenate(frequent)
                yield pa.record_batch({"spot": pa.array(np.where(often, fp, token)), "token": pa.array(token), "fp": pa.array(fp), "frequent": pa.array(often)})

    return scan


def _runs(batches, names):
    """Arrays of whole runs of equal tokens from batches sorted by token."""
    held = None
    for batch in batches:
        columns = {n: batch[n] for n in names}
        if held is not None:
            columns = {n: pa.concat_arrays([held[n], columns[n]]) for n in names}
        token = columns["token"].to_numpy()
        last = int(np.searchsorted(token, token[-1])) if len(token) else 0
        if last:
            yield {n: c[:last] for n, c in columns.items()}
        held = {n: c[last:] for n, c in columns.items()}
    if held is not None and len(held["token"]):
        yield held


def _shared(batches):
    """Keep the tokens that two or more sets have; a frequent token is kept as it is."""
    for part in _runs(batches, ["token", "fp", "frequent"]):
        token, fp, often = part["token"].to_numpy(), part["fp"].to_numpy(), part["frequent"].to_numpy(zero_copy_only=False)
        first = np.ones(len(token), bool)
        first[1:] = (token[1:] != token[:-1]) | (fp[1:] != fp[:-1])
        token, fp, often = token[first], fp[first], often[first]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        run = np.cumsum(new) - 1
        keep = often | (np.bincount(run)[run] > 1)
        yield pa.record_batch({"token": pa.array(token[keep]), "fp": pa.array(fp[keep]), "frequent": pa.array(often[keep])})


def _near(t: Fraction):
    """Edges between the sets of one token that size and parity allow to be similar."""
    num, den = t.numerator, t.denominator

    def pairs(batches):
        for part in _runs(batches, ["token", "fp", "n", "parity"]):
            token, fp, n = (part[c].to_numpy() for c in ("token", "fp", "n"))
            sketch = [np.frombuffer(x.as_py(), "<u8") for x in part["parity"]]
            level = np.array([len(x) for x in sketch])
            tables = {}
            for size in np.unique(level):
                for at, rows in ((size, np.flatnonzero(level == size)), (size // 2, np.flatnonzero(level == size))):
                    if at:
                        place, values = tables.setdefault(int(at), (np.full(len(token), -1), []))
                        place[rows] = np.arange(len(rows)) + sum(map(len, values))
                        values.append(np.stack([sketch[i] if at == size else sketch[i][:at] ^ sketch[i][at:] for i in rows]))
            tables = {k: (place, np.concatenate(values)) for k, (place, values) in tables.items()}
            found_a, found_b = [], []
            step = 1
            while step < len(token):
                a = np.flatnonzero(token[step:] == token[:-step])
                if not len(a):
                    break
                b = a + step
                small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                fits = small * den >= num * large
                a, b = a[fits], b[fits]
                allowed = n[a] + n[b] - 2 * -(-num * (n[a] + n[b]) // (num + den))
                both = np.minimum(level[a], level[b])
                for size in np.unique(both):
                    rows = np.flatnonzero(both == size)
                    place, values = tables[int(size)]
                    for cut_rows in np.array_split(rows, len(rows) * int(size) // 2_000_000 + 1):
                        differ = np.bitwise_count(values[place[a[cut_rows]]] ^ values[place[b[cut_rows]]]).sum(1, dtype=np.int64)
                        good = cut_rows[differ <= allowed[cut_rows]]
                        found_a.append(fp[a[good]])
                        found_b.append(fp[b[good]])
                step += 1
            if found_a:
                a, b = np.concatenate(found_a), np.concatenate(found_b)
                nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
                label = local_components(places[: len(a)], places[len(a) :], len(nodes))
                own = label != np.arange(len(nodes))
                yield pa.record_batch({"a": pa.array(nodes[own]), "b": pa.array(nodes[label[own]])})

    return pairs


def _bloom_places(fp: np.ndarray) -> list[np.ndarray]:
    h = W.mix(fp.view(np.uint64) ^ W.U64(0x51ED270B))
    mask = W.U64((1 << _BLOOM_BITS) - 1)
    return [((h >> W.U64(s)) & mask).astype(np.int64) for s in (0, 32)]


def _bloom(prints: DataFrame) -> np.ndarray:
    """Bit field of fixed size that has every fingerprint; it only spares sending sets that no block needs."""

    def words(batches):
        for batch in batches:
            places = np.concatenate(_bloom_places(batch["fp"].to_numpy()))
            yield pa.record_batch({"word": pa.array(places >> 6), "bits": longs(W.U64(1) << (places & 63).astype(np.uint64))})

    field = np.zeros(1 << (_BLOOM_BITS - 6), np.uint64)
    found = prints.mapInArrow(words, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    field[found["word"].to_numpy()] = unsigned(found["bits"])
    return field


def _setter(width, ends_word, bloom):
    def scan(batches):
        field, seen = bloom.value, set()
        for batch in batches:
            prints, members = [], []
            for _, s in W.shingle_sets(batch["text"], width, ends_word):
                fp = set_hash(W.mix(s)) if len(s) else None
                if fp is None or fp in seen:
                    continue
                one, two = (int(p[0]) for p in _bloom_places(np.array([fp])))
                if int(field[one >> 6]) >> (one & 63) & 1 and int(field[two >> 6]) >> (two & 63) & 1:
                    seen.add(fp)
                    prints.append(fp)
                    members.append(s.tobytes())
            if prints:
                yield pa.record_batch({"fp": pa.array(prints, pa.int64()), "members": pa.array(members, pa.binary())})

    return scan


def overlaps(sets: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``rows`` and ``columns`` of the pairs of sets that reach the threshold, by a product over column blocks.

    The product is made tile by tile, so memory beside the sets is that of one tile. Tiles hold sets of similar
    sizes, so many need no product.
    """
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    column = column.astype(np.int32)
    count = np.bincount(column)
    by_count = np.argsort(count, kind="stable")
    place = np.empty(len(count), np.int32)
    place[by_count] = np.cumsum(count[by_count] > 1) - 1  # shared columns, rare ones first
    shared = count[column] > 1
    owner, column = owner[shared], place[column[shared]]
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]

    def tiles(members):
        by_size = np.argsort(sizes[members], kind="stable")
        for start in range(0, len(members), _TILE_ROWS):
            own = by_size[start : start + _TILE_ROWS]
            local = np.full(len(sets), -1, np.int32)
            local[members[own]] = np.arange(len(own))
            inside = local[owner] >= 0
            yield own, sizes[members[own]], local[owner[inside]], column[inside]

    lefts, rights = list(tiles(rows)), list(tiles(columns))
    found_r, found_c = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for left in lefts:
        for right in rights:
            r, c = _tile_overlaps(left[1:], right[1:], t)
            found_r.append(left[0][r])
            found_c.append(right[0][c])
    found_r, found_c = np.concatenate(found_r), np.concatenate(found_c)
    order = np.lexsort((found_c, found_r))
    return found_r[order], found_c[order]


def _tile_overlaps(left, right, t: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs that reach the threshold; either side has sizes and, ordered by column, the owners and columns of its shingles."""
    num, den = t.numerator, t.denominator
    small, large = np.minimum.outer(left[0], right[0]), np.maximum.outer(left[0], right[0])
    alive = small * den >= num * large
    need = -(-num * (small + large) // (num + den))
    remain = [np.bincount(owner, minlength=len(sizes)) for sizes, owner, _ in (left, right)]
    found = np.zeros(alive.shape, np.float32)
    end = max((int(column[-1]) + 1 for _, _, column in (left, right) if len(column)), default=0)
    for start in range(0, end, _COLUMN_BLOCK):
        alive &= found + np.minimum.outer(*remain) >= need
        picked = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
        if not len(picked[0]):
            break
        blocks = []
        for side, (sizes, owner, column) in enumerate((left, right)):
            low, high = np.searchsorted(column, [start, start + _COLUMN_BLOCK])
            block = np.zeros((len(sizes), _COLUMN_BLOCK), np.float32)
            block[owner[low:high], column[low:high] - start] = 1
            remain[side] = remain[side] - np.bincount(owner[low:high], minlength=len(sizes))
            blocks.append(block if len(picked[side]) == len(sizes) else block[picked[side]])
        found[np.ix_(*picked)] += blocks[0] @ blocks[1].T
    alive &= found >= need
    return np.nonzero(alive)


def _product(t: Fraction):
    def multiply(table: pa.Table) -> pa.Table:
        low, high = table["low"][0].as_py(), table["high"][0].as_py()
        _, first = np.unique(table["fp"].to_numpy(), return_index=True)
        table = table.take(first)
        fp, copies, strip = (table[c].to_numpy() for c in ("fp", "copies", "strip"))
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table["members"]]
        rows = np.flatnonzero(strip == low)
        columns = np.flatnonzero(strip == high)
        a = b = np.zeros(0, np.int64)
        if len(rows) and len(columns):
            a, b = overlaps(sets, rows, columns, t)
            a, b = rows[a], columns[b]
            a, b = a[a != b], b[a != b]
        label = local_components(a, b, len(fp))
        links = np.bincount(a, copies[b], len(fp))
        if low != high:
            links += np.bincount(b, copies[a], len(fp))
        own = links > 0
        return pa.table({"fp": pa.array(fp[own]), "root": pa.array(fp[label[own]]), "links": pa.array(links[own].astype(np.int64))})

    return multiply
