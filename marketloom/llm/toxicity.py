"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

A lexicon of words and word beginnings is learned from labelled documents, as toxic words are inflected
in some languages. Every document becomes a row of dense features: lexicon densities, nearness of
second-person words to lexicon words, capitals, punctuation, and obfuscation (digits or symbols that
hide letters).

Labelled documents fall into folds by content, so that near copies stay together. Features of a fold
come from the lexicon of the other folds, and margins for calibration from trees of the other folds, so
neither sees its own documents. Fitting uses at most ``SAMPLE`` labelled documents, the first in hash
order; scoring covers whole texts of all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm import words as W
from marketloom.llm.common import longs, pick, stored, unsigned

SAMPLE = 20_000
LEXICON = 4096
MIN_SUPPORT, MIN_LOG_ODDS, FOLDS = 5, 2.0, 3
TREES, DEPTH, RATE, BINS = 60, 3, 0.2, 32
#: Second-person words of the languages that the tables hold, and the letters that digits and symbols stand for.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "vous", "votre", "vos", "ti", "tú", "usted", "ustedes", "vosotros")
HIDDEN_LETTERS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"}
NEAR_WORDS = 5
STEMS = (4, 5, 6)
FEATURES = (
    "strong_density", "weak_density", "strong_hits", "weak_hits", "distinct_weight", "second_person_near", "second_person_density",
    "capital_letters", "capital_words", "punctuation", "exclamations", "inner_symbols", "hidden_density", "hidden_hits", "log_words",
)

_HIDDEN = np.arange(256, dtype=np.uint8)
for _symbol, _letter in HIDDEN_LETTERS.items():
    _HIDDEN[ord(_symbol)] = ord(_letter)
_JOINERS = np.zeros(256, bool)
_JOINERS[[ord(c) for c in ".-_*'"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_YOU = np.sort(np.array([W.hash_word(w) for w in SECOND_PERSON], np.uint64))


@dataclass
class Lexicon:
    """Sorted term hashes with weights: log odds of a toxic document having the term."""

    terms: np.ndarray
    weights: np.ndarray

    def weigh(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.terms) or not len(terms):
            return np.zeros(len(terms))
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.weights[at], 0.0)


def _terms(buffer, starts, ends) -> list[np.ndarray]:
    """Hashes of every word and of its beginnings; 0 where a word is no longer than the beginning."""
    out = [W.word_hashes(buffer, starts, ends)]
    for size in STEMS:
        begin = W.word_hashes(buffer, starts, np.minimum(ends, starts + size))
        out.append(np.where(ends - starts > size, W.mix(begin ^ W.U64(size)), W.U64(0)))
    return out


def _per_text(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return sums[firsts[1:]] - sums[firsts[:-1]]


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES per text; a text without words has zeros."""
    parts = [np.zeros((0, len(FEATURES)))]
    for _, raw, offsets in W.slabs(texts):
        low = W.lower(raw)
        starts, ends, firsts = W.spans(low, offsets, W.NOT_ALNUM)
        count = np.maximum(np.diff(firsts), 1)
        terms = _terms(low, starts, ends)
        weight = np.max([lexicon.weigh(t) for t in terms], axis=0) if len(starts) else np.zeros(0)
        strong, weak = weight >= 2 * MIN_LOG_ODDS, (weight > 0) & (weight < 2 * MIN_LOG_ODDS)
        text_of = np.repeat(np.arange(len(count)), np.diff(firsts))
        hit = np.flatnonzero(weight > 0)
        distinct = np.zeros(len(count))
        if len(hit):
            _, one = np.unique(np.stack([text_of[hit].astype(np.uint64), terms[2][hit]]), axis=1, return_index=True)
            np.add.at(distinct, text_of[hit][one], weight[hit][one])
        you = np.flatnonzero(_YOU[np.minimum(np.searchsorted(_YOU, terms[0]), len(_YOU) - 1)] == terms[0])
        near = np.zeros(len(count))
        if len(you) and len(hit):
            after = np.minimum(np.searchsorted(you, hit), len(you) - 1)
            before = np.maximum(after - 1, 0)
            close = np.zeros(len(hit), bool)
            for other in (you[after], you[before]):
                close |= (np.abs(other - hit) <= NEAR_WORDS) & (text_of[other] == text_of[hit])
            np.add.at(near, text_of[hit], close)
        spoken = np.bincount(text_of[you], minlength=len(count))
        letter = _LETTER[raw]
        capital = (raw >= 65) & (raw <= 90)
        letters = np.maximum(_per_text(letter, offsets), 1)
        length = np.maximum(np.diff(offsets), 1)
        sums = np.concatenate([[0], np.cumsum(capital)])
        shouted = (sums[ends] - sums[starts] == ends - starts) & (ends - starts > 1)
        symbol = ~letter & ~W.SPACES[raw]
        inner = np.zeros(len(raw), bool)
        inner[1:-1] = symbol[1:-1] & letter[:-2] & letter[2:] & (raw[1:-1] != 39) & (raw[1:-1] != 45)
        # the same words with hidden letters shown and joiners inside words taken out
        shown = _HIDDEN[low]
        keep = np.ones(len(raw), bool)
        keep[1:-1] = ~(_JOINERS[raw[1:-1]] & _LETTER[shown[:-2]] & _LETTER[shown[2:]])
        kept = np.concatenate([[0], np.cumsum(keep)])
        shown, places = shown[keep], kept[offsets]
        s, e, f = W.spans(shown, places, W.NOT_ALNUM)
        seen = np.max([lexicon.weigh(t) for t in _terms(shown, s, e)], axis=0) if len(s) else np.zeros(0)
        hidden = np.maximum(_per_text(seen >= 2 * MIN_LOG_ODDS, f) - _per_text(strong, firsts), 0)
        strong_hits, weak_hits = _per_text(strong, firsts), _per_text(weak, firsts)
        parts.append(
            np.stack(
                [
                    strong_hits / count, weak_hits / count, np.log1p(strong_hits), np.log1p(weak_hits), distinct, near / np.maximum(strong_hits + weak_hits, 1), spoken / count,
                    _per_text(capital, offsets) / letters, _per_text(shouted, firsts) / count, _per_text(symbol, offsets) / length, _per_text(raw == 33, offsets) / length,
                    _per_text(inner, offsets) / count, hidden / count, np.log1p(hidden), np.log1p(np.diff(firsts)),
                ],
                axis=1,
            )
        )
    return np.concatenate(parts)


@dataclass
class Trees:
    """Boosted regression trees of one depth: a feature and threshold per inner node, a value per leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (2**DEPTH - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray) -> Trees:
    """Logistic boosting on binned features, level by level."""
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    edges = [np.unique(np.quantile(np.unique(c), np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)
    margin, inner = np.full(len(y), base), 2**DEPTH - 1
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold, split = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        node = np.zeros(len(y), np.int64)
        for level in range(DEPTH):
            width = 2**level
            place = node - (width - 1)
            best = np.full(width, 1e-6)
            for j in range(x.shape[1]):
                cell = place * BINS + binned[:, j]
                gs = np.bincount(cell, g, width * BINS).reshape(width, BINS)
                hs = np.bincount(cell, h, width * BINS).reshape(width, BINS)
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                gain[:, len(edges[j]) :] = -1
                gain[(hl < 1) | (ht - hl < 1)] = -1
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                for k in np.flatnonzero(top > best):
                    best[k] = top[k]
                    feature[width - 1 + k], split[width - 1 + k], threshold[width - 1 + k] = j, at[k], edges[j][at[k]]
            node = 2 * node + 1 + (binned[np.arange(len(y)), feature[node]] > split[node])
        place = node - inner
        leaf = RATE * np.bincount(place, g, inner + 1) / (np.bincount(place, h, inner + 1) + 1)
        margin = margin + leaf[place]
        trees.append((feature, threshold, leaf))
    return Trees(*(np.stack(part) for part in zip(*trees, strict=True)), base)


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of labels on margins, by pooling adjacent violators; each pool is shrunk by half a count on either side."""
    order = np.argsort(margin, kind="stable")
    pools: list[list[float]] = []
    for m, label in zip(margin[order], y[order], strict=True):
        pools.append([label, 1.0, m, m])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            total, size, _, last = pools.pop()
            pools[-1][0] += total
            pools[-1][1] += size
            pools[-1][3] = last
    values = np.array([(s + 0.5) / (n + 1) for s, n, _, _ in pools])
    knots = np.array([[low, high] for _, _, low, high in pools]).ravel()
    return knots, np.maximum.accumulate(np.repeat(values, 2))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees | None
    knots: np.ndarray
    values: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.values[0])
        out = np.zeros(len(texts))
        for start in range(0, len(texts), 4096):
            margin = self.trees.margin(features(texts[start : start + 4096], self.lexicon))
            # a small share of the plain margin keeps the order within a pool
            out[start : start + 4096] = 0.98 * np.interp(margin, self.knots, self.values) + 0.02 / (1 + np.exp(-margin))
        return out

    def column(self, text: Column) -> Column:
        """Score of a text column, 0 to 1; a null text is an empty one."""
        return F.arrow_udf(lambda texts: pa.array(self.scores(texts)), "double")(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Text and label of at most ``limit`` labelled documents, the first in hash order of their ids.

    Several labels of a document count as the largest; null labels and ids are left out. ``keep`` is a
    condition on doc_id.
    """
    known = pick(labels, doc_id=(id_col, "long"), label=(label, "int")).where("doc_id is not null and label is not null").where(keep)
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("label").alias("label"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", keep: Column | None = None, sample: int = SAMPLE) -> Model:
    """Learn lexicon, trees and calibration from a bounded sample of labelled documents.

    Only texts and labels are used. The sample is written once, as it is read three times. Without labels of both kinds every score is the share of positives, 0 for none.
    """
    rows = labelled_sample(docs, labels, label, F.lit(True) if keep is None else keep, sample)
    tagged = rows.select("text", (F.col("label") > 0).cast("int").alias("label")).withColumn("group", F.arrow_udf(_content_group, "long")("text"))
    tagged = stored(tagged.withColumn("fold", F.pmod("group", F.lit(FOLDS)).cast("int")), "toxicity-sample")
    sizes = np.zeros((2, FOLDS))
    for r in tagged.groupBy("label", "fold").agg(F.countDistinct("group").alias("n")).collect():
        sizes[r["label"], r["fold"]] = r["n"]
    distinct = tagged.groupBy("group", "label", "fold").agg(F.min("text").alias("text"))
    counted = distinct.mapInArrow(_count_terms, "term long, fold int, pos long, neg long").groupBy("term")
    summed = counted.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), *[F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}{f}") for f in range(FOLDS) for c in ("pos", "neg")])
    odds = F.log((F.col("pos") + 0.5) / float(sizes[1].sum() + 1)) - F.log((F.col("neg") + 0.5) / float(sizes[0].sum() + 1))
    likely = summed.withColumn("odds", odds).where((F.col("pos") >= MIN_SUPPORT) & (F.col("odds") >= MIN_LOG_ODDS))
    likely = likely.orderBy(F.col("odds").desc(), F.col("pos").desc(), "term").limit(LEXICON).toArrow()
    lexicons = [_lexicon(likely, sizes, f) for f in range(FOLDS)]
    table = tagged.mapInArrow(_feature_rows(lexicons), "label int, fold int, x binary").toArrow()
    y, fold = table["label"].to_numpy().astype(float), table["fold"].to_numpy()
    x = np.array([np.frombuffer(v.as_py(), np.float32) for v in table["x"]], np.float64).reshape(len(y), len(FEATURES))
    order = np.lexsort((*x.T, y, fold))
    x, y, fold = x[order], y[order], fold[order]
    if min(len(set(y[fold != f])) for f in range(FOLDS)) < 2:
        return Model(_lexicon(likely, sizes, None), None, np.zeros(0), np.array([y.mean() if len(y) else 0.0]))
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        margin[fold == f] = fit_trees(x[fold != f], y[fold != f]).margin(x[fold == f])
    return Model(_lexicon(likely, sizes, None), fit_trees(x, y), *isotonic(margin, y))


def _lexicon(table: pa.Table, sizes: np.ndarray, without: int | None) -> Lexicon:
    """The lexicon of the counted terms, with the documents of one fold left out."""
    pos, neg = table["pos"].to_numpy().astype(float), table["neg"].to_numpy().astype(float)
    kept = sizes.sum(1)
    if without is not None:
        pos, neg = pos - table[f"pos{without}"].to_numpy(), neg - table[f"neg{without}"].to_numpy()
        kept = kept - sizes[:, without]
    odds = np.log((pos + 0.5) / (kept[1] + 1)) - np.log((neg + 0.5) / (kept[0] + 1))
    good = (pos >= (MIN_SUPPORT if without is None else 3)) & (odds >= MIN_LOG_ODDS)
    terms, odds = unsigned(table["term"])[good], odds[good]
    order = np.argsort(terms)
    return Lexicon(terms[order], odds[order])


def _content_group(texts: pa.Array) -> pa.Array:
    """A number that near copies mostly share: the smallest word hash of a text."""
    out = np.zeros(len(texts), np.uint64)
    for first, buffer, offsets in W.slabs(texts):
        low = W.lower(buffer)
        starts, ends, firsts = W.spans(low, offsets, W.NOT_ALNUM)
        hashes = W.mix(W.word_hashes(low, starts, ends) ^ W.U64(0x1234567))
        for i in range(len(offsets) - 1):
            out[first + i] = hashes[firsts[i] : firsts[i + 1]].min(initial=np.uint64(2**64 - 1))
    return longs(out)


def _count_terms(batches):
    for batch in batches:
        kind = 2 * batch["fold"].to_numpy() + batch["label"].to_numpy()
        found = []
        for first, buffer, offsets in W.slabs(batch["text"]):
            low = W.lower(buffer)
            starts, ends, firsts = W.spans(low, offsets, W.NOT_ALNUM)
            terms = _terms(low, starts, ends)
            for i in range(len(offsets) - 1):
                own = np.unique(np.concatenate([t[firsts[i] : firsts[i + 1]] for t in terms]))
                found.append((own[own != 0], kind[first + i]))
        for value in np.unique(kind):
            term, n = np.unique(np.concatenate([t for t, k in found if k == value]), return_counts=True)
            none = np.zeros(len(term), np.int64)
            fold = pa.array(np.full(len(term), value // 2, np.int32))
            yield pa.record_batch({"term": longs(term), "fold": fold, "pos": pa.array(n if value % 2 else none), "neg": pa.array(none if value % 2 else n)})


def _feature_rows(lexicons: list[Lexicon]):
    def rows(batches):
        for batch in batches:
            fold = batch["fold"].to_numpy()
            x = np.zeros((batch.num_rows, len(FEATURES)), np.float32)
            for f in np.unique(fold):
                own = np.flatnonzero(fold == f)
                x[own] = features(batch["text"].take(pa.array(own)), lexicons[f])
            yield pa.record_batch({"label": batch["label"], "fold": batch["fold"], "x": pa.array([r.tobytes() for r in x], pa.binary())})

    return rows


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no model may learn from: the checksum of the id's text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id long, held_out boolean, score double and predicted int of every document.

    Null and empty texts are scored as texts without words. Null ids are returned as null and are not held
    out; repeated rows are scored each; further columns are ignored.
    """
    wanted = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    scored = wanted.select("doc_id", model.column(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
