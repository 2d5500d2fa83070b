"""Quality: ordinal regression with cumulative links on hashed text.

Grades are ordered, 0 the worst. One weight per hashed text feature gives a document's position on a
line; ordered thresholds cut the line into grades: P(grade <= k) = sigmoid(threshold k - position). All
grades share the weights, so what tells two grades apart also helps to tell the others. The expected
grade and the probability of a grade or better select documents.

Features are frequencies: of words, of the shapes of blank-separated tokens, of repeats of a token or of
a pair, and of the share of different words and lines. Fitting uses at most ``SAMPLE`` rated documents,
the first in hash order; scoring covers whole texts of all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm import words as W
from marketloom.llm.common import pick

SAMPLE = 6_000
DIM_BITS = 16
DIM = 1 << DIM_BITS
STEPS, RATE, MOMENTUM, PENALTY = 400, 2.0, 0.97, 1e-3
#: Least distance of neighbouring thresholds.
GAP = 0.5
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
_LINES = W.separators((0x0A, 0x0A))
_SHARES = 16


def _slot(hashes: np.ndarray, family: int) -> np.ndarray:
    return (W.mix(hashes ^ W.U64(family * 0x9E3779B97F4A7C15 & (2**64 - 1))) >> W.U64(64 - DIM_BITS)).astype(np.int64)


def _share(firsts: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Share of different values among each text's values, as a bucket from 0 to _SHARES."""
    count = np.diff(firsts)
    out = np.zeros(len(count), np.int64)
    for i in np.flatnonzero(count):
        out[i] = _SHARES * len(np.unique(hashes[firsts[i] : firsts[i + 1]])) // count[i]
    return out


def hashed(texts: pa.Array):
    """Yield (rows, slots, values) per slab of texts: the features of text rows[i] are slots[i] with weight values[i]."""
    for first, raw, offsets in W.slabs(texts):
        low = W.lower(raw)
        starts, ends, firsts = W.spans(low, offsets, W.NOT_ALNUM)
        words = W.word_hashes(low, starts, ends)
        s, e, token_firsts = W.spans(raw, offsets, W.SPACES)
        tokens = W.word_hashes(raw, s, e)
        # shapes: letters, capitals and digits by kind, runs of a kind once
        shape = _SHAPE[raw]
        keep = np.ones(len(raw), bool)
        keep[1:] = shape[1:] != shape[:-1]
        if len(s):
            keep[s] = True
        kept = np.concatenate([[0], np.cumsum(keep)])
        shapes = W.word_hashes(shape[keep], kept[s], kept[e])
        count = len(offsets) - 1
        number = np.arange(count)
        word_of, token_of = np.repeat(number, np.diff(firsts)), np.repeat(number, np.diff(token_firsts))
        again = np.zeros(len(tokens), np.uint64)
        again[1:] = (tokens[1:] == tokens[:-1]) & (token_of[1:] == token_of[:-1])
        line_starts, line_ends, line_firsts = W.spans(raw, offsets, _LINES)
        lines = W.word_hashes(raw, line_starts, line_ends)
        rows = [word_of, token_of, token_of, number, number, number]
        per_word, per_token = 1 / np.maximum(np.diff(firsts), 1), 1 / np.maximum(np.diff(token_firsts), 1)
        slots = [
            _slot(words, 1),
            _slot(shapes, 2),
            _slot(again, 3),
            _slot(_share(token_firsts, tokens).astype(np.uint64), 4),
            _slot(_share(line_firsts, lines).astype(np.uint64), 5),
            _slot(np.log2(np.diff(token_firsts) + 1.0).astype(np.uint64), 6),
        ]
        values = [per_word[word_of], per_token[token_of], per_token[token_of], np.full(count, 0.5), np.full(count, 0.5), np.full(count, 0.1)]
        yield first + np.concatenate(rows), np.concatenate(slots), np.concatenate(values)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def positions(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for rows, slots, values in hashed(texts):
            out += np.bincount(rows, self.weights[slots] * values, len(texts))
        return out

    def tails(self, texts: pa.Array) -> np.ndarray:
        """Probability of grade k or better, for k from 1, a row per text."""
        return _sigmoid(self.positions(texts)[:, None] - self.thresholds)

    def tail_column(self, text: Column, grade: int) -> Column:
        """Probability that a text has the grade or a better one."""
        return F.arrow_udf(lambda texts: pa.array(np.ascontiguousarray(self.tails(texts)[:, grade - 1])), "double")(text)


def fit_ordinal(rows, slots, values, grades: np.ndarray) -> Model:
    """Maximum likelihood of the cumulative-link model by accelerated gradient descent.

    Plain steps, as scaling them per feature would favour rare words, which name single documents.
    """
    n, k = len(grades), int(grades.max()) + 1
    share = np.cumsum(np.bincount(grades, minlength=k))[:-1] / n
    share = np.clip(share, 1e-3, 1 - 1e-3)
    first = np.log(share / (1 - share))
    theta = np.concatenate([first[:1], np.log(np.maximum(np.diff(first), 1e-2))])  # thresholds stay ordered: later ones add exponentials
    w = np.zeros(DIM)
    speed = [np.zeros_like(w), np.zeros_like(theta)]
    for _ in range(STEPS):
        steps = np.concatenate([[theta[0]], GAP + np.exp(theta[1:])])
        cuts = np.cumsum(steps)
        position = np.bincount(rows, w[slots] * values, n)
        upper = np.where(grades < k - 1, cuts[np.minimum(grades, k - 2)] - position, np.inf)
        lower = np.where(grades > 0, cuts[np.maximum(grades - 1, 0)] - position, -np.inf)
        up, down = _sigmoid(upper), _sigmoid(lower)
        up, down = np.where(grades < k - 1, up, 1.0), np.where(grades > 0, down, 0.0)
        p = np.maximum(up - down, 1e-9)
        slope_up, slope_down = up * (1 - up) / p, down * (1 - down) / p
        pull = (slope_up - slope_down) / n  # of the loss by position
        grad_w = np.bincount(slots, pull[rows] * values, DIM) + PENALTY * w / n
        by_cut = np.zeros(k - 1)
        np.add.at(by_cut, np.minimum(grades, k - 2), np.where(grades < k - 1, -slope_up / n, 0))
        np.add.at(by_cut, np.maximum(grades - 1, 0), np.where(grades > 0, slope_down / n, 0))
        grad_theta = np.cumsum(by_cut[::-1])[::-1] * np.concatenate([[1.0], steps[1:] - GAP])
        for value, grad, fast in zip((w, theta), (grad_w, grad_theta), speed, strict=True):
            before = fast.copy()
            fast *= MOMENTUM
            fast -= RATE * grad
            value += fast + MOMENTUM * (fast - before)
    return Model(w, np.cumsum(np.concatenate([[theta[0]], GAP + np.exp(theta[1:])])))


def fit(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model | None:
    """Fit on a bounded sample of rated documents; None without ratings of two grades.

    Grades are integers from 0. Null grades and ids are left out, several ratings of a document count as the
    lowest.
    """
    known = pick(ratings, doc_id=(id_col, "long"), grade=(grade_col, "int")).where("doc_id is not null and grade >= 0")
    chosen = known.groupBy("doc_id").agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    rated = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "grade")

    def rows(batches):
        for batch in batches:
            sparse = [(np.zeros(0, np.int64), np.zeros(0))] * batch.num_rows
            for text, slot, value in hashed(batch["text"]):
                order = np.argsort(text, kind="stable")
                text, slot, value = text[order], slot[order], value[order]
                for i in np.unique(text):
                    low, high = np.searchsorted(text, [i, i + 1])
                    some, at = np.unique(slot[low:high], return_inverse=True)
                    sparse[i] = (some, np.bincount(at, value[low:high]))
            yield pa.record_batch({"doc_id": batch["doc_id"], "grade": batch["grade"], "slots": pa.array([s.astype("<i4").tobytes() for s, _ in sparse], pa.binary()), "values": pa.array([v.astype("<f4").tobytes() for _, v in sparse], pa.binary())})

    table = rated.mapInArrow(rows, "doc_id long, grade int, slots binary, values binary").orderBy("doc_id").toArrow()
    grades = table["grade"].to_numpy().astype(np.int64)
    if len(set(grades)) < 2:
        return None
    slots = [np.frombuffer(s.as_py(), "<i4") for s in table["slots"]]
    values = np.concatenate([np.frombuffer(v.as_py(), "<f4") for v in table["values"]])
    return fit_ordinal(np.repeat(np.arange(len(slots)), [len(s) for s in slots]), np.concatenate(slots), values, grades)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, expected_grade double and tail_probability array (of grade 1 or better, 2 or better, ...) of every document.

    Null and empty texts are scored as texts without words. Without a model both are null. Null ids are
    returned as null, repeated rows are scored each, further columns are ignored.
    """
    wanted = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    if model is None:
        return wanted.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("array<double>").alias("tail_probability"))

    def tails(texts: pa.Array) -> pa.Array:
        return pa.array(list(model.tails(texts)), pa.list_(pa.float64()))

    scored = wanted.select("doc_id", F.arrow_udf(tails, "array<double>")("text").alias("tail_probability"))
    total = F.aggregate("tail_probability", F.lit(0.0), lambda done, p: done + p)
    return scored.select("doc_id", total.alias("expected_grade"), "tail_probability")
