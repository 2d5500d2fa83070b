"""Words, word hashes and shingles of whole batches of UTF-8 texts, as numpy arrays.

A batch of texts is one byte buffer with offsets, as Arrow holds it. Words are cut at
separator bytes and hashed to 64 bits without a Python loop over words. Two different
words or shingles share a hash with a chance of about 2**-64 per compared pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], U64)
#: Text bytes that are hashed at once; a single longer text is still taken whole.
SLAB_BYTES = 1_000_000
_LONG_WORD = 64


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Lookup table of the bytes (inclusive ranges) that end a word."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Words are runs without ASCII white space.
SPACES = separators((0x20, 0x20), (0x09, 0x0D))
#: Words are runs of ASCII letters, digits and non-ASCII characters.
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h = h ^ (h >> U64(29))
    h = h * U64(0x9FB21C651E98DF25)
    return h ^ (h >> U64(32))


def slabs(texts: pa.Array):
    """Cut a text column into (first row, buffer, offsets) pieces; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + SLAB_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def lower(buffer: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    return _LOWER[buffer]


def spans(buffer: np.ndarray, offsets: np.ndarray, ends_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the first word of every text (one more at the end)."""
    inside = ~ends_word[buffer]
    before = np.empty_like(inside)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = offsets[(offsets < len(buffer))]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, eight bytes at a step; the rare long words go one by one."""
    sizes = ends - starts
    h = sizes.astype(U64) * _MULTIPLIERS[0]
    if not len(starts):
        return h
    padded = np.concatenate([buffer, np.zeros(8, np.uint8)])
    windows = np.ndarray((len(buffer) + 1,), "<u8", padded, strides=(1,))
    rows = np.flatnonzero(sizes <= _LONG_WORD)
    step = 0
    while len(rows):
        part = windows[starts[rows] + step]
        short = sizes[rows] - step
        bits = np.where(short < 8, short, 8).astype(U64) * U64(8)
        part = np.where(bits < U64(64), part & ((U64(1) << (bits & U64(63))) - U64(1)), part)
        h[rows] = mix(h[rows] ^ (part * _MULTIPLIERS[1] + U64(step + 1)))
        rows = rows[short > 8]
        step += 8
    for i in np.flatnonzero(sizes > _LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(buffer[starts[i] : ends[i]].tobytes())
    return h


def hash_word(word: str) -> int:
    """The hash that ``word_hashes`` gives to one word in lower case."""
    buffer = np.frombuffer(word.encode(), np.uint8)
    return int(word_hashes(buffer, np.array([0]), np.array([len(buffer)]))[0])


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words, and where each text's run hashes begin.

    A text with fewer words, but at least one, has its whole sequence as the only shingle.
    """
    counts = np.diff(firsts)
    total = len(words)
    rolled = np.zeros(max(total - width + 1, 0), U64)
    for k in range(width):
        rolled += words[k : k + len(rolled)] * _MULTIPLIERS[k % 5] + U64(k * 7919)
    rolled = mix(rolled)
    sizes = np.where(counts >= width, counts - width + 1, (counts > 0).astype(np.int64))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(counts)), sizes)
    places = np.arange(begins[-1]) - begins[owner] + firsts[:-1][owner]
    out = np.zeros(begins[-1], U64)
    whole = counts[owner] >= width
    out[whole] = rolled[places[whole]]
    for at in np.flatnonzero(~whole):
        text = owner[at]
        run = words[firsts[text] : firsts[text + 1]]
        h = U64(len(run) * 0x51ED27)
        for w in run:
            h = mix(np.array([h ^ w], U64) * _MULTIPLIERS[2])[0]
        out[at] = h
    return out, begins


def shingle_sets(texts: pa.Array, width: int, ends_word: np.ndarray = SPACES):
    """Yield (row, sorted distinct shingle hashes) for every text of a column."""
    for first, buffer, offsets in slabs(texts):
        buffer = lower(buffer)
        starts, ends, firsts = spans(buffer, offsets, ends_word)
        hashes, begins = shingle_hashes(word_hashes(buffer, starts, ends), firsts, width)
        for i in range(len(offsets) - 1):
            yield first + i, np.unique(hashes[begins[i] : begins[i + 1]])
