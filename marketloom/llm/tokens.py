"""Token counts per section: encode whole documents once and attribute tokens by their character spans.

A document is its fields one after the other, each ended by a line break; sections are the short
fields and the lines of the long ones. They cover every character, so a token that crosses a
boundary needs a rule: it goes to the section that holds most of its characters, the earlier one on
a tie. Every token counts exactly once, and section counts add up to the document's count.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from marketloom.llm.common import pick

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@lru_cache(4)
def encoder(path: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """Byte-level encoding of a rank file, and how many bytes each token stands for."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes


def encode(text: str, path: str = RANKS) -> np.ndarray:
    """Token ids of a whole text; strings of special tokens are ordinary text."""
    return np.array(encoder(path)[0].encode_ordinary(text), np.int64)


def char_spans(data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First character and end of each token, from the byte lengths of the tokens of a UTF-8 text.

    A token that holds part of a character's bytes covers that character.
    """
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    ends = np.cumsum(sizes)
    return char[ends - sizes], char[ends - 1] + 1


def attribute(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray) -> np.ndarray:
    """Section number of every token; ``sections`` are the characters where sections begin, ascending."""
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    for i in np.flatnonzero(first != last):
        edges = np.concatenate([[starts[i]], sections[first[i] + 1 : last[i] + 1], [ends[i]]])
        first[i] += int(np.argmax(np.diff(edges)))
    return first


def section_counts(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("source", "lang"), lines_of: str = "text", ranks: str = RANKS) -> DataFrame:
    """One row per document and section.

    Returns doc_id long, field string, section int (from 0 within the document), char_start and char_end
    long (in the document's characters), n_tokens long, doc_tokens long. The short ``fields`` are one
    section each, every line of ``lines_of`` with its line break is another.

    A null or empty field has no section; a document without characters gives one row with field and spans
    null, section 0 and no tokens. Null ids are returned as null, repeated rows are counted each, further
    columns are ignored.
    """
    names = [*fields, lines_of]
    wanted = pick(docs, doc_id=(id_col, "long"), **{f"f{i}": (name, "string") for i, name in enumerate(names)})

    def count(batches):
        _, sizes = encoder(ranks)
        for batch in batches:
            out = {k: [] for k in ("doc_id", "field", "section", "char_start", "char_end", "n_tokens", "doc_tokens")}
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                parts, field_of = [], []
                for name, value in zip(names, row[1:], strict=True):
                    if value:
                        lines = [line + "\n" for line in value.split("\n")] if name == lines_of else [value + "\n"]
                        parts += lines
                        field_of += [name] * len(lines)
                if not parts:
                    for key, value in zip(out, (row[0], None, 0, None, None, 0, 0), strict=True):
                        out[key].append(value)
                    continue
                text = "".join(parts)
                lengths = np.array([len(p) for p in parts])
                begins = np.cumsum(lengths) - lengths
                ids = encode(text, ranks)
                starts, ends = char_spans(np.frombuffer(text.encode(), np.uint8), sizes[ids])
                counts = np.bincount(attribute(starts, ends, begins), minlength=len(parts))
                out["doc_id"] += [row[0]] * len(parts)
                out["field"] += field_of
                out["section"] += range(len(parts))
                out["char_start"] += begins.tolist()
                out["char_end"] += (begins + lengths).tolist()
                out["n_tokens"] += counts.tolist()
                out["doc_tokens"] += [len(ids)] * len(parts)
            yield pa.record_batch(out, schema=_SCHEMA)

    return wanted.mapInArrow(count, "doc_id long, field string, section int, char_start long, char_end long, n_tokens long, doc_tokens long")


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("field", pa.string()), ("section", pa.int32()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("n_tokens", pa.int64()), ("doc_tokens", pa.int64())])
