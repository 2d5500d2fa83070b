"""Text normalisation, hashes, similarity signatures and page extraction."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom import fixed
from marketloom.functions.numbers import lookup

PAGE_TYPE = (
    T.StructType()
    .add("title", T.StringType())
    .add("publish_time", T.StringType())
    .add("body", T.StringType())
    .add("tables", T.ArrayType(T.StringType()))
    .add("images", T.ArrayType(T.StringType()))
)


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, other letters as they are: how the matched keyword searches compare."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def squeeze(text: Column) -> Column:
    """Runs of whitespace to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def norm(text: Column) -> Column:
    """Lower-cased trimmed text, null as empty."""
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def compare_form(text: Column, already_nfkc: bool = False) -> Column:
    """Form in which names and statuses of two providers are compared."""
    folded = text if already_nfkc else nfkc(text)
    form = F.regexp_replace(F.lower(F.coalesce(folded, F.lit(""))), r"(?U)\s+", "")
    for suffix in fixed.COMPANY_SUFFIXES:
        form = F.regexp_replace(form, re.escape(suffix) + "$", "")
    return lookup(form, fixed.STATUS_SYNONYMS, form)


def _merged(base, override):
    if not (isinstance(base, dict) and isinstance(override, dict)):
        return override
    return base | {name: _merged(base[name], value) if name in base else value for name, value in override.items()}


@F.pandas_udf(T.StringType())
def merge_trees(base: pd.Series, override: pd.Series) -> pd.Series:
    """Override JSON laid over base JSON: maps are merged at every depth, anything else is replaced; null is no JSON."""
    pairs = zip(base, override, strict=True)
    return pd.Series([b if o is None else o if b is None else json.dumps(_merged(json.loads(b), json.loads(o)), ensure_ascii=False, separators=(",", ":")) for b, o in pairs], dtype=object)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


#: Characters whose signatures are computed at once; a single longer text is still taken whole.
SLAB_CHARS = 1 << 20
#: White space of the Unicode property.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


class _GramBits:
    """Sign bits (+1 or -1) of the low md5 half of character 3-grams, remembered within one task.

    A 3-gram is keyed by its three code points packed into one integer.
    """

    def __init__(self, limit: int = 200_000) -> None:
        self.limit = limit
        self.rows: dict[int, int] = {}
        self.bits = np.empty((0, 64), dtype=np.int8)

    def of(self, grams: np.ndarray) -> np.ndarray:
        if len(self.rows) > self.limit:
            self.__init__(self.limit)
        unseen = [g for g in grams.tolist() if g not in self.rows]
        if unseen:
            mask = (1 << 21) - 1
            texts = (chr(g >> 42) + chr(g >> 21 & mask) + chr(g & mask) for g in unseen)
            halves = b"".join(_low_md5(t) for t in texts)
            fresh = np.unpackbits(np.frombuffer(halves, dtype=np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * 2 - 1
            self.rows.update(zip(unseen, range(len(self.rows), len(self.rows) + len(unseen)), strict=True))
            self.bits = np.concatenate([self.bits, fresh])
        return self.bits[[self.rows[g] for g in grams.tolist()]]


def _low_md5(text: str) -> bytes:
    return hashlib.md5(text.encode(), usedforsecurity=False).digest()[8:]


def _squeezed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, runs of white space as one blank and none at the ends, and where each text begins."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    edges = np.cumsum([0, *map(len, texts)])
    table = np.zeros(max(int(points.max(initial=0)), 0x3000) + 1, bool)
    table[_WHITE] = True
    white = table[points]
    after_white = np.empty_like(white)
    after_white[1:] = white[:-1]
    after_white[edges[:-1][edges[:-1] < len(points)]] = True
    kept = ~(white & after_white)
    lengths = np.diff(np.append(0, np.cumsum(kept))[edges])
    points = np.where(white, np.uint32(0x20), points)[kept]
    ends = np.cumsum(lengths)
    # a blank that is left at the end of a text goes
    last = ends[lengths > 0] - 1
    last = last[points[last] == 0x20]
    lengths[lengths > 0] -= points[ends[lengths > 0] - 1] == 0x20
    return np.delete(points, last), np.append(0, np.cumsum(lengths))


def signatures(texts: list[str], known: _GramBits) -> np.ndarray:
    """64 sign bits of the summed md5 bits of all character 3-grams of every text, in squeezed form."""
    points, edges = _squeezed(texts)
    lengths = np.diff(edges)
    out = np.zeros(len(texts), np.int64)
    for i in np.flatnonzero((lengths > 0) & (lengths < 3)):
        short = points[edges[i] : edges[i + 1]].astype("<u4").tobytes().decode("utf-32-le")
        out[i] = int.from_bytes(_low_md5(short), "big", signed=True)
    if lengths.max(initial=0) < 3:
        return out
    # characters as numbers of the alphabet that occurs, so that a gram of a text is one small number
    number = np.zeros(int(points.max()) + 1, np.int64)
    number[points] = 1
    alphabet = np.flatnonzero(number)
    number[alphabet] = np.arange(len(alphabet))
    letters, size = number[points], len(alphabet)
    grams = (letters[:-2] * size + letters[1:-1]) * size + letters[2:]
    text = np.repeat(np.arange(len(texts)), lengths)
    whole = text[:-2] == text[2:]
    cells = np.sort(text[:-2][whole] * size**3 + grams[whole])
    first = np.flatnonzero(np.diff(cells, prepend=-1))
    # sums of a text stay whole numbers in 32-bit floats up to 2**24 grams
    exact = np.float32 if lengths.max() < 1 << 24 else np.float64
    counts = np.diff(np.append(first, len(cells))).astype(exact)
    owner, gram = np.divmod(cells[first], size**3)
    distinct, place = np.unique(gram, return_inverse=True)
    packed = alphabet[distinct // size**2] << 42 | alphabet[distinct // size % size] << 21 | alphabet[distinct % size]
    bits = known.of(packed).astype(exact)
    balance = np.zeros((len(texts), 64), exact)
    starts = np.searchsorted(owner, np.arange(len(texts) + 1))
    for i in np.flatnonzero(np.diff(starts)):
        own = slice(starts[i], starts[i + 1])
        balance[i] = counts[own] @ bits[place[own]]
    signed = np.packbits(balance > 0, axis=1).view(">i8")[:, 0].astype(np.int64)
    return np.where(lengths >= 3, signed, out)


@F.pandas_udf(T.LongType())
def _signatures(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known = _GramBits()
    for column in batches:
        texts = column.fillna("").tolist()
        found, start = [], 0
        while start < len(texts):
            end, size = start + 1, len(texts[start])
            while end < len(texts) and size + len(texts[end]) <= SLAB_CHARS:
                size += len(texts[end])
                end += 1
            found.append(signatures(texts[start:end], known))
            start = end
        yield pd.Series(np.concatenate(found) if found else np.zeros(0, np.int64))


def simhash64(text: Column) -> Column:
    """64-bit similarity signature of the whitespace-normalised text, as a signed long."""
    return _signatures(text)


def signature_hex(signature: Column) -> Column:
    return F.lpad(F.lower(F.hex(signature)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two signatures; 64 when either is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


# Start tags that end an open paragraph.
CLOSES_PARAGRAPH = set("p ul ol dl div table section article blockquote form pre hr main h1 h2 h3 h4 h5 h6".split())


class _PageParser(HTMLParser):
    """Collects title, date hints, text blocks, table rows and image candidates of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.hidden = 0
        self.table_depth = 0
        self.title, self.heading, self.in_title = [], None, False
        self.meta: dict[str, str] = {}
        self.text: list[str] = []
        self.open_blocks: list[tuple[str, int, list[str]]] = []
        self.blocks: list[str] = []  # in order of their start tags
        self.tables: list[list[list[list[str]]]] = []
        self.in_cell = False
        self.images: list[str] = []

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if tag in fixed.PAGE_DROPPED_TAGS:
            self.hidden += 1
        if self.hidden:
            return
        if tag in CLOSES_PARAGRAPH:
            self._close("p")
        if tag == "title":
            self.in_title = True
        elif tag == "meta":
            for name in ("property", "name"):
                if given.get(name) and given.get("content"):
                    self.meta.setdefault(given[name], given["content"])
        elif tag == "img":
            self._image(given)
        elif tag == "table":
            self.table_depth += 1
            self.tables.append([])
        elif tag == "tr" and self.table_depth:
            self.tables[-1].append([])
            self.in_cell = False
        elif tag in ("td", "th") and self.table_depth:
            if not self.tables[-1]:
                self.tables[-1].append([])
            self.tables[-1][-1].append([])
            self.in_cell = True
        elif tag in fixed.PAGE_BLOCK_TAGS and not self.table_depth:
            if tag == "li":  # an unclosed item ends where the next begins
                self._close(tag)
            self.open_blocks.append((tag, len(self.blocks), []))
            self.blocks.append("")

    def handle_endtag(self, tag):
        if tag in fixed.PAGE_DROPPED_TAGS:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag == "title":
            self.in_title = False
        elif tag == "table":
            self.table_depth = max(0, self.table_depth - 1)
        elif tag in ("td", "th"):
            self.in_cell = False
        elif tag in fixed.PAGE_BLOCK_TAGS:
            self._close(tag)

    def handle_data(self, data):
        if self.hidden:
            return
        if self.in_title:
            self.title.append(data)
            return
        self.text.append(data)
        if self.table_depth:
            if self.in_cell:
                self.tables[-1][-1][-1].append(data)
            return
        for _, _, parts in self.open_blocks:
            parts.append(data)

    def _close(self, tag):
        names = [name for name, _, _ in self.open_blocks]
        if tag not in names:
            return
        position = len(names) - 1 - names[::-1].index(tag)
        for name, index, parts in self.open_blocks[position:]:
            self.blocks[index] = " ".join("".join(parts).split())
            if name == "h1" and self.heading is None:
                self.heading = self.blocks[index]
        del self.open_blocks[position:]

    def _image(self, given):
        source = given.get("src") or given.get("data-src") or ""
        if not source or source.startswith("data:") or re.search(fixed.IMAGE_SKIP_PATTERN, source, re.IGNORECASE):
            return
        sizes = [int(re.sub(r"\D", "", given.get(side, "")) or 0) for side in ("width", "height")]
        if any(0 < size < fixed.IMAGE_MIN_PIXELS for size in sizes) or source in self.images:
            return
        if len(self.images) < fixed.IMAGE_MAX_CANDIDATES:
            self.images.append(source)


def _page(html: str) -> dict:
    parser = _PageParser()
    parser.feed(html or "")
    parser.close()
    for tag in [name for name, _, _ in parser.open_blocks]:
        parser._close(tag)
    whole = "".join(parser.text)
    published = next((parser.meta[name] for name in fixed.PAGE_DATE_META if name in parser.meta), None)
    if published is None:
        hint = re.search(fixed.PASSAGE_DATE_PATTERN, whole[:2000])
        published = hint.group(0) if hint else None
    blocks = [text for text in parser.blocks if len(text) >= fixed.PAGE_MIN_BLOCK_CHARS]
    tables = []
    for rows in parser.tables[: fixed.MAX_TABLES]:
        cells = [[" ".join("".join(cell).split()) for cell in row] for row in rows[: fixed.MAX_TABLE_ROWS]]
        lines = [" | ".join(c for c in row if c) for row in cells if any(row)]
        if lines:
            tables.append("\n".join(lines))
    title = " ".join("".join(parser.title).split())
    return {
        "title": title or (parser.heading or ""),
        "publish_time": published,
        "body": "\n".join(blocks or [" ".join(whole.split())]),
        "tables": tables,
        "images": parser.images,
    }


@F.pandas_udf(PAGE_TYPE)
def extract_page(html: pd.Series) -> pd.DataFrame:
    """Title, publish time, text body, table texts and image candidates of HTML pages."""
    return pd.DataFrame([_page(h) for h in html], columns=["title", "publish_time", "body", "tables", "images"])


def is_anti_bot(title: Column, body: Column) -> Column:
    """Short page that carries a verification marker."""
    text = F.concat_ws(" ", title, body)
    pattern = "|".join(re.escape(marker) for marker in fixed.ANTI_BOT_MARKERS)
    return (F.length(body) <= fixed.ANTI_BOT_MAX_CHARS) & text.rlike(pattern)


def recovered_json(text: Column) -> Column:
    """JSON object text inside model output, with code fences and prose around it removed; null if none parses."""
    trimmed = F.trim(text)
    unfenced = F.when(
        trimmed.startswith("```"),
        F.trim(F.regexp_replace(F.regexp_replace(trimmed, "^```(json)?", ""), "`+$", "")),
    ).otherwise(trimmed)
    inner = F.regexp_extract(unfenced, r"(?s)\{.*\}", 0)
    return F.coalesce(
        F.when(F.try_parse_json(unfenced).isNotNull(), unfenced),
        F.when(F.try_parse_json(inner).isNotNull(), inner),
    )
