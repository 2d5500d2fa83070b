"""License scans by a positional index of rare words.

Templates are short notices of common licences. The index holds, for every template word, the templates
and positions where it stands. How rare a word is comes from the document frequencies of template words
over all documents. Of every template's mandatory phrase the rarest words are looked up, in any file and
however many notices it holds; a posting at template position p for a word at place i votes for an alignment
that begins at i - p. A phrase that stands in the text has all its rare words there, so its alignment gets
all their votes. Such alignments are compared word by word, and a label is given when the template's
mandatory phrase stands in the text as the alignment says and enough of the notice is there.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from marketloom.llm import words as W
from marketloom.llm.common import pick, summed_counts

#: Phrases that the scan must count, with their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Label, notice, mandatory phrase.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("lgpl-3.0", "this work is licensed under the gnu lesser general public license version 3", "gnu lesser general public license"),
    ("agpl-3.0", "this work is licensed under the gnu affero general public license version 3", "gnu affero general public license"),
    ("cc-by-4.0", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0-1.0", "creative commons cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("mit-notice", "released under the mit license", "the mit license"),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)
#: How many words of each mandatory phrase are looked up, and so how many votes an alignment needs.
RAREST = 2
COVERAGE = 0.6
BASE_SCORE = 0.5

_WORDS = [t[1].split() for t in TEMPLATES]
_PHRASES = [t[2].split() for t in TEMPLATES]
VOCABULARY = sorted({w for words in _WORDS for w in words})
_HASHES = np.array([W.hash_word(w) for w in VOCABULARY], np.uint64)
_BY_HASH = np.argsort(_HASHES)
_SORTED = _HASHES[_BY_HASH]
_NUMBER = {w: i for i, w in enumerate(VOCABULARY)}
_OFFSETS = [next(p for p in range(len(n)) if n[p : p + len(f)] == f) for n, f in zip(_WORDS, _PHRASES, strict=True)]
_BASE_HASHES = [np.array([W.hash_word(w) for w in phrase.split()], np.uint64) for phrase in BASE]
_PHRASE_HASHES = [np.array([W.hash_word(w) for w in phrase], np.uint64) for phrase in _PHRASES]


def vocabulary_numbers(hashes: np.ndarray) -> np.ndarray:
    """Number of each word in the vocabulary of all templates, -1 if it is not there."""
    at = np.minimum(np.searchsorted(_SORTED, hashes), len(_SORTED) - 1)
    return np.where(_SORTED[at] == hashes, _BY_HASH[at], -1)


def phrase_places(hashes: np.ndarray, text_of: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Word numbers where a phrase's words stand consecutively within one text."""
    last = len(hashes) - len(phrase) + 1
    at = np.flatnonzero(hashes[: max(last, 0)] == phrase[0])
    for k in range(1, len(phrase)):
        at = at[hashes[at + k] == phrase[k]]
    return at[text_of[at] == text_of[at + len(phrase) - 1]]


def frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """How many documents have each word of the vocabulary, and how many documents there are."""

    def count(batches):
        seen = np.zeros(len(VOCABULARY) + 1, np.uint32)
        for batch in batches:
            for _, buffer, offsets in W.slabs(batch["text"]):
                low = W.lower(buffer)
                starts, ends, firsts = W.spans(low, offsets, W.NOT_ALNUM)
                number = vocabulary_numbers(W.word_hashes(low, starts, ends))
                text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
                known = np.flatnonzero(number >= 0)
                both = np.unique(text_of[known] * len(VOCABULARY) + number[known])
                np.add.at(seen, both % len(VOCABULARY), 1)
                seen[-1] += len(offsets) - 1
        blob = pa.compress(seen.astype("<u4").tobytes(), "zstd", asbytes=True)
        yield pa.record_batch({"chunk": pa.array([0], pa.int32()), "counts": pa.array([blob])})

    rows = pick(docs, text=(text_col, "string")).mapInArrow(count, "chunk int, counts binary")
    counts = summed_counts(rows, len(VOCABULARY) + 1, ["counts"])[0]
    return counts[:-1], int(counts[-1])


def rare_postings(idf: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """Templates and positions of the RAREST rarest words of every mandatory phrase, by vocabulary number."""
    postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for template, (phrase, offset) in enumerate(zip(_PHRASES, _OFFSETS, strict=True)):
        numbers = [_NUMBER[w] for w in phrase]
        for k in sorted(range(len(phrase)), key=lambda k: (-idf[numbers[k]], k))[:RAREST]:
            postings[numbers[k]].append((template, offset + k))
    return dict(postings)


def aligned_labels(numbers: np.ndarray, postings: dict[int, list[tuple[int, int]]]) -> dict[str, float]:
    """Labels of one text with the share of the notice that stands there.

    ``numbers`` are the vocabulary numbers of the text's words, -1 for others; ``postings`` are those of
    ``rare_postings``.
    """
    votes: Counter = Counter()
    for place in np.flatnonzero(np.isin(numbers, list(postings))).tolist():
        for template, position in postings[int(numbers[place])]:
            votes[template, place - position] += 1
    found: dict[str, float] = {}
    for (template, begin), agreed in votes.items():
        label, notice, phrase = TEMPLATES[template][0], _WORDS[template], _PHRASES[template]
        if agreed < min(RAREST, len(phrase)):
            continue
        held = [0 <= begin + p < len(numbers) and numbers[begin + p] == _NUMBER[w] for p, w in enumerate(notice)]
        offset = _OFFSETS[template]
        if all(held[offset : offset + len(phrase)]) and sum(held) >= COVERAGE * len(notice):
            found[label] = max(found.get(label, 0.0), sum(held) / len(notice))
    return found


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence labels of every document.

    Returns doc_id long, n_words long, n_base long (all places of base phrases), first_word and last_word
    long (smallest and largest start of one, words from 0; null if none), base_labels and labels string
    (distinct, sorted, joined by commas; empty if none), score double: the largest share of a notice that
    stands in the text, at least BASE_SCORE with a base phrase, 0 without a label.

    Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased in A-Z. Null texts are
    empty. Null ids are returned as null, repeated rows are scanned each, further columns are ignored.
    """
    counts, total = frequencies(docs, text_col)
    postings = rare_postings(np.log((total + 1) / (counts + 1)))

    def look(batches):
        for batch in batches:
            rows = []
            for _, buffer, offsets in W.slabs(batch["text"]):
                low = W.lower(buffer)
                starts, ends, firsts = W.spans(low, offsets, W.NOT_ALNUM)
                hashes = W.word_hashes(low, starts, ends)
                text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))
                places: dict[int, list[int]] = defaultdict(list)
                base: dict[int, set[str]] = defaultdict(set)
                for phrase, label in zip(_BASE_HASHES, BASE.values(), strict=True):
                    for at in phrase_places(hashes, text_of, phrase).tolist():
                        places[int(text_of[at])].append(at - int(firsts[text_of[at]]))
                        base[int(text_of[at])].add(label)
                # a label needs its mandatory phrase, so only texts that have one are aligned
                likely = {int(text_of[at]) for phrase in _PHRASE_HASHES for at in phrase_places(hashes, text_of, phrase)}
                for text in range(len(offsets) - 1):
                    own = base.get(text, set())
                    shares: dict[str, float] = {}
                    if text in likely:
                        shares = aligned_labels(vocabulary_numbers(hashes[firsts[text] : firsts[text + 1]]), postings)
                    spots = places.get(text, [])
                    best = max([BASE_SCORE if own else 0.0, *shares.values()])
                    rows.append((int(firsts[text + 1] - firsts[text]), len(spots), min(spots, default=None), max(spots, default=None), ",".join(sorted(own)), ",".join(sorted(own | set(shares))), best))
            names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.record_batch({"doc_id": batch["doc_id"]} | {n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    wanted = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    return wanted.mapInArrow(look, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
