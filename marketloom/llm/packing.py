"""Best-fit packing of documents into sequences, planned on counts per length.

Documents are tokenised once into pieces of at most the sequence length. The histogram of piece
lengths has as many rows as a sequence has tokens, whatever the number of documents, so best-fit
decreasing runs on it alone: it places counts, not documents. The plan says which ranks of a length
go to which sequences. Every piece has a rank among the pieces of its length (its task's offset plus
its place in the task) and takes the slot that the plan holds for this rank.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marketloom.llm import words
from marketloom.llm.common import pick, stored

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SEQUENCE_TOKENS = 4096
END_ID = 1
#: Word pieces a worker keeps the ids of.
CACHED_PIECES = 600_000
#: Characters that are cut into pieces at once; a longer run without spaces is still taken whole.
SLAB_CHARS = 1_000_000
_PLAIN_BELOW = 0x250
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)
_BEYOND = re.compile(f"[{chr(_PLAIN_BELOW)}-\U0010ffff]")
_SPACE_AFTER = re.compile("[\t\n\x0b\x0c\r \x85\xa0]")


@lru_cache(1)
def _kinds() -> np.ndarray:
    """Space, letter, number or other for every character of basic and extended Latin, as the vocabulary's pattern has them."""
    kinds = np.full(_PLAIN_BELOW, _OTHER, np.uint8)
    for c in range(_PLAIN_BELOW):
        kinds[c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)
    kinds[[ord(c) for c in "\t\n\x0b\x0c\r \x85\xa0"]] = _SPACE
    return kinds


@lru_cache(1)
def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it prints, else the next from U+0100 on."""
    printing = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printing]
    return {b: chr(b) for b in printing} | {b: chr(0x100 + i) for i, b in enumerate(others)}


def plain_spans(chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word piece of lower-case Latin text, given as character codes.

    Pieces are runs of letters, single numbers and runs of other characters. An apostrophe that begins such a run
    takes the s, t, m, d, re, ve or ll after it with it.
    """
    kinds = _kinds()[chars]
    turn = np.diff(kinds, prepend=_SPACE) != 0
    begins = (kinds != _SPACE) & (turn | (kinds == _NUMBER))
    marks = np.flatnonzero(turn & (chars == ord("'")))
    after = [np.append(chars, [0, 0])[marks + i] for i in (1, 2)]
    short = np.isin(after[0], [ord(c) for c in "stmd"])
    long = ((after[0] == ord("r")) | (after[0] == ord("v"))) & (after[1] == ord("e"))
    long |= (after[0] == ord("l")) & (after[1] == ord("l"))
    for some, size in ((marks[short], 2), (marks[long], 3)):
        begins[some + 1] = False
        rest = some + size
        rest = rest[rest < len(chars)]
        begins[rest] = kinds[rest] != _SPACE
    edges = np.append(np.flatnonzero(begins | (turn & (kinds == _SPACE))), len(chars))
    own = np.flatnonzero(begins[edges[:-1]])
    return edges[own], edges[own + 1]


def _slabs(texts: list[str]):
    """Cut texts into parts of about SLAB_CHARS characters at spaces, and gather parts: lists of (text number, part)."""
    held, size = [], 0
    for number, text in enumerate(texts):
        start = 0
        while True:
            end = len(text)
            if end - start > SLAB_CHARS:
                found = _SPACE_AFTER.search(text, start + SLAB_CHARS)
                end = found.start() if found else end
            held.append((number, text[start:end]))
            size += end - start
            start = end
            if size >= SLAB_CHARS:
                yield held
                held, size = [], 0
            if start >= len(text):
                break
    if held:
        yield held


class PieceEncoder:
    """Token ids of whole texts, through a cache of word pieces.

    The vocabulary's model encodes every piece between its pattern's cuts on its own, so a text's ids are
    its pieces' ids in a row. Latin texts are cut here and each distinct piece, told by a 64-bit hash, is encoded
    once. Texts with other letters, also after lower-casing, whose normal form may differ, or with special tokens
    are cut at spaces only.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self):
        self.number: dict[int | str, int] = {}
        self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, "<u4")

    def _learn(self, encoded: list[list[int]]) -> None:
        self.sizes = np.concatenate([self.sizes, [len(ids) for ids in encoded]]).astype(np.int64)
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(encoded), "<u4")])

    def _plain(self, low: str) -> tuple[np.ndarray, np.ndarray]:
        """Piece numbers of a lower-case Latin text, and where they begin."""
        data = np.frombuffer(low.encode("utf-16-le"), np.uint8)
        starts, ends = plain_spans(data.view("<u2"))
        codes, hashes = pd.factorize(words.word_hashes(data, 2 * starts, 2 * ends))
        number, known = self.number, len(self.number)
        numbers = np.array([number.setdefault(h, len(number)) for h in hashes.tolist()], np.int64)
        fresh = np.flatnonzero(numbers >= known)
        if len(fresh):
            # codes are given in the order of first places
            first = np.flatnonzero(np.diff(np.maximum.accumulate(codes), prepend=-1))
            parts = [low[a:b] for a, b in zip(starts[first[fresh]].tolist(), ends[first[fresh]].tolist(), strict=True)]
            # a piece in its normal form goes to the model as one character per byte
            self._learn([[t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(_byte_characters()))] for p in parts])
        return numbers[codes], starts

    def _spaced(self, text: str) -> np.ndarray:
        """Piece numbers of a text that is cut at spaces only."""
        parts = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        known = len(self.number)
        numbers = np.array([self.number.setdefault(p, len(self.number)) for p in parts], np.int64)
        fresh = list(islice(self.number, known, None))
        for start in range(0, len(fresh), 10_000):
            self._learn([e.ids for e in self.tokenizer.encode_batch_fast(fresh[start : start + 10_000], add_special_tokens=False)])
        return numbers

    def _ids(self, pieces: np.ndarray) -> np.ndarray:
        lengths = self.sizes[pieces]
        ends = np.cumsum(lengths)
        begins = np.cumsum(self.sizes) - self.sizes
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[pieces] - (ends - lengths), lengths)]

    def lowered(self, text: str) -> str | None:
        """The text in lower case, if all its characters are of basic or extended Latin before and after."""
        if _BEYOND.search(text) or any(s in text for s in self.special):
            return None
        low = text.lower()
        return low if len(low) == len(text) and not _BEYOND.search(low) else None

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        found: list[list[np.ndarray]] = [[] for _ in texts]
        lows = [self.lowered(t) for t in texts]
        for parts in _slabs([low or "" for low in lows]):
            if len(self.number) > CACHED_PIECES:
                self._clear()
            pieces, starts = self._plain("\n".join(part for _, part in parts))
            ids = self._ids(pieces)
            edges = np.cumsum([0, *(len(part) + 1 for _, part in parts)])
            ends = np.append(0, np.cumsum(self.sizes[pieces]))[np.searchsorted(starts, edges)]
            for (number, _), start, end in zip(parts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                found[number].append(ids[start:end])
        for number, low in enumerate(lows):
            if low is None:
                if len(self.number) > CACHED_PIECES:
                    self._clear()
                found[number] = [self._ids(self._spaced(texts[number]))]
        return [parts[0] if len(parts) == 1 else np.concatenate(parts) for parts in found]


@lru_cache(2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, limit: int = SEQUENCE_TOKENS, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document: doc_id, piece int, start, length, ids_crc32 long, and the task and the place within the task's pieces of that length.

    Only documents longer than ``limit`` tokens, the end id included, are cut.
    """

    def cut(batches):
        task, used = TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in batches:
            texts = [t or "" for t in batch["text"].to_pylist()]
            found = [np.append(ids, end_id).astype("<u4") for ids in encoder(vocabulary).encode(texts)]
            sizes = np.array([len(ids) for ids in found])
            counts = -(-sizes // limit)
            row = np.repeat(np.arange(len(found)), counts)
            piece = np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
            start = piece * limit
            length = np.minimum(sizes[row] - start, limit)
            crc = [zlib.crc32(found[r][s : s + limit]) for r, s in zip(row.tolist(), start.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            place = np.empty(len(row), np.int64)
            place[order] = np.arange(len(row)) - np.searchsorted(length[order], length[order]) + used[length[order]]
            used += np.bincount(length, minlength=limit + 1)
            columns = {"piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}
            columns |= {"task": pa.array(np.full(len(row), task), pa.int32()), "place": pa.array(place)}
            yield pa.record_batch({"doc_id": batch["doc_id"].take(pa.array(row))} | columns)

    wanted = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    return wanted.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long")


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing on counts: rows of (length, first rank, count, first sequence, offset).

    Ranks first..first+count of the length go to as many sequences in a row, at one offset. Sequences with
    equal room are kept as ranges, so the work depends on the number of lengths and not on the counts.
    """
    moves: list[tuple[int, int, int, int, int]] = []
    open_by_room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    sequences = 0

    def open_range(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while count:
            fit = bisect_left(rooms, length)
            if fit < len(rooms):
                room = rooms[fit]
                first, free = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(fit)
                placed = min(count, free)
                moves.append((length, rank, placed, first, capacity - room))
                open_range(room, first + placed, free - placed)
                open_range(room - length, first, placed)
                rank, count = rank + placed, count - placed
                continue
            per = capacity // length
            full = count // per
            for turn in range(per if full else 0):
                moves.append((length, rank, full, sequences, turn * length))
                rank += full
            open_range(capacity - per * length, sequences, full)
            sequences += full
            rest = count - full * per
            for turn in range(rest):
                moves.append((length, rank, 1, sequences, turn * length))
                rank += 1
            if rest:
                open_range(capacity - rest * length, sequences, 1)
                sequences += 1
            count = 0
    return np.array(sorted(moves), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, capacity: int = SEQUENCE_TOKENS, **options) -> DataFrame:
    """Place every piece of every document in a sequence of at most ``capacity`` tokens.

    Returns doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long.
    Pieces of a sequence lie without gaps from offset 0. A null or empty text is the end id alone. Null ids
    are returned as null and repeated rows are packed each. An empty table gives no rows; further columns
    are ignored.
    """
    spark = docs.sparkSession
    cut_up = stored(pieces(docs, limit=capacity, **options), "pieces")
    per_task = cut_up.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).select("task", "length", "base")
    histogram = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(plan(histogram, capacity))

    def take(batches):
        moves = slots.value
        begins = moves[:, 0] * (1 << 48) + moves[:, 1]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["rank"].to_numpy()
            move = moves[np.searchsorted(begins, length * (1 << 48) + rank, "right") - 1]
            columns = {n: batch[n] for n in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield pa.record_batch(columns | {"sequence_id": pa.array(move[:, 3] + rank - move[:, 1]), "offset": pa.array(move[:, 4])})

    ranked = cut_up.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("place"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(take, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
