"""Language-model scores: cross-entropy difference between a target and a background model.

Both models are bigram models over one vocabulary, the token ids of a public byte-level encoding, so no
text has unknown tokens. Target counts come from the rows marked as target, background counts from all
documents. Background counts are scaled to the target's number of tokens, so that both are smoothed
alike. A document's score is the mean over its tokens of the target's loss less the background's; the
lower, the more it resembles the target.

Texts are encoded once. Their ids, 16 bits a token, are written with the row's number and are what all later steps
read. Target rows are told by their id: a field of FIELD_BITS hashed target ids leaves out most other rows
at once, the rest is joined. So no text is shuffled, and of the ids only those of likely targets.

Pairs of a token and the one before are counted exactly: tasks sort and count runs of tokens, and the
counts are added by pair into a table with a row for every distinct pair, however many the corpus has.
The table also holds what either model loses on the pair. The most frequent pairs, at most HEAD_PAIRS,
are sent to every task; the pairs of a document that are not among them are joined to the table. Every
pair so joined is rarer than those sent, so no key of the join is hot.

Losses are summed as whole numbers of 2**-32, so that sums do not depend on the order of the rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketloom.llm.common import pick, stored
from marketloom.llm.tokens import RANKS, encoder

#: How many pairs every task holds at most, and after how many tokens a task passes its counts on.
HEAD_PAIRS = 1 << 20
RUN_TOKENS = 1 << 21
#: Bits of the field of hashed target ids that every task holds; rows that it cannot tell apart are joined.
FIELD_BITS = 1 << 25
SMOOTHING = 50.0
_UNIT = float(1 << 32)
_BATCH = 1 << 16
_BUCKET_BYTES = 4096


def id_type(vocabulary: int) -> str:
    """The narrowest type that holds the ids of a vocabulary."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def pairs(ids: np.ndarray, vocabulary: int) -> np.ndarray:
    """One number for each token and the token before it (the vocabulary's size at the start)."""
    before = np.concatenate([[vocabulary], ids[:-1]]) if len(ids) else ids
    return before * vocabulary + ids


def _target_field(marked: DataFrame) -> Broadcast:
    """Bits of the hashed target ids."""
    place = F.pmod(F.xxhash64("doc_id"), F.lit(FIELD_BITS))
    # buckets of the built-in bitmaps count from 1, and zero is the last place of bucket 0
    parts = marked.select((place + 1).alias("place")).groupBy(F.bitmap_bucket_number("place").alias("bucket"))
    parts = parts.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    field = np.zeros(FIELD_BITS // 8, np.uint8)
    for bucket, bits in parts.collect():
        field[(bucket - 1) * _BUCKET_BYTES :][: len(bits)] = np.frombuffer(bytes(bits), np.uint8)
    return marked.sparkSession.sparkContext.broadcast(field)


def encoded(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> tuple[DataFrame, DataFrame]:
    """The stored table of all rows as row, doc_id, likely and ids binary, and the distinct target ids."""
    kind = id_type(len(encoder(ranks)[1]))
    marked = pick(targets, doc_id=(id_col, "long")).where("doc_id is not null").distinct()
    field = _target_field(marked)

    def encode_rows(batches):
        tokenizer = encoder(ranks)[0]
        for batch in batches:
            place = batch["place"].to_numpy()
            ids = [tokenizer.encode_to_numpy(t or "", disallowed_special=()).astype(kind).tobytes() for t in batch["text"].to_pylist()]
            likely = (field.value[place >> 3] >> (place & 7) & 1).astype(bool)
            yield pa.record_batch({"row": batch["row"], "doc_id": batch["doc_id"], "likely": pa.array(likely), "ids": pa.array(ids, pa.binary())})

    # the row number joins sums back to their document, so it is written with the one scan that gives it
    wanted = pick(docs, doc_id=(id_col, "long"), text=(text_col, "string"))
    rows = wanted.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(FIELD_BITS)).alias("place"))
    return stored(rows.mapInArrow(encode_rows, "row long, doc_id long, likely boolean, ids binary"), "encoded"), marked


def pair_counts(rows: DataFrame, marked: DataFrame, vocabulary: int) -> DataFrame:
    """Every distinct pair of encoded rows as pair, n, n_target longs: how often it stands in all and in target documents."""

    def counted(runs, target):
        both, n = np.unique(np.concatenate(runs), return_counts=True)
        for start in range(0, len(both), _BATCH):
            part, count = both[start : start + _BATCH], n[start : start + _BATCH]
            yield pa.record_batch({"pair": pa.array(part), "n": pa.array(count * (not target)), "n_target": pa.array(count * target)})

    def count(target):
        def run(batches):
            runs, held = [], 0
            for batch in batches:
                for ids in batch["ids"].to_pylist():
                    runs.append(pairs(np.frombuffer(ids, id_type(vocabulary)).astype(np.int64), vocabulary))
                    held += len(runs[-1])
                    if held >= RUN_TOKENS:
                        yield from counted(runs, target)
                        runs, held = [], 0
            if held:
                yield from counted(runs, target)

        return run

    kinds = "pair long, n long, n_target long"
    of_targets = rows.where("likely").join(marked.hint("shuffle_hash"), "doc_id", "left_semi").select("ids")
    found = rows.select("ids").mapInArrow(count(0), kinds).unionByName(of_targets.mapInArrow(count(1), kinds))
    return found.groupBy("pair").agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target"))


def _by_token(counts: DataFrame, token: Column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Target and background counts by one token of the pairs; as long as the vocabulary."""
    found = counts.groupBy(token.alias("token")).agg(F.sum("n").alias("n"), F.sum("n_target").alias("n_target")).toArrow()
    sums = []
    for name in ("n_target", "n"):
        total = np.zeros(size)
        total[found["token"].to_numpy()] = found[name].to_numpy()
        sums.append(total)
    return sums[0], sums[1]


def fit(rows: DataFrame, marked: DataFrame, vocabulary: int) -> DataFrame:
    """Both models as a stored table of all pairs of encoded rows.

    Returns pair, n, n_target, target_loss and background_loss longs; losses are negative log probabilities
    of the token after the one before, smoothed with the token's frequency, in units of 2**-32.
    """
    counts = stored(pair_counts(rows, marked, vocabulary), "pairs")
    token = _by_token(counts, F.expr(f"pair % {vocabulary}"), vocabulary)
    context = _by_token(counts, F.expr(f"pair div {vocabulary}"), vocabulary + 1)
    share = token[0].sum() / max(token[1].sum(), 1)
    sums = rows.sparkSession.sparkContext.broadcast([(t * scale, c * scale) for t, c, scale in zip(token, context, (1.0, share), strict=True)])

    def price(batches):
        for batch in batches:
            pair = batch["pair"].to_numpy()
            before, own = np.divmod(pair, vocabulary)
            out = {name: batch[name] for name in ("pair", "n", "n_target")}
            for name, joint, (total, contexts) in zip(("target_loss", "background_loss"), (batch["n_target"].to_numpy(), batch["n"].to_numpy() * share), sums.value, strict=True):
                alone = (total[own] + 0.5) / (total.sum() + 0.5 * vocabulary)
                loss = -np.log((joint + SMOOTHING * alone) / (contexts[before] + SMOOTHING))
                out[name] = pa.array(np.rint(loss * _UNIT).astype(np.int64))
            yield pa.record_batch(out)

    return stored(counts.mapInArrow(price, "pair long, n long, n_target long, target_loss long, background_loss long"), "losses")


def _head(model: DataFrame) -> tuple[Broadcast, DataFrame]:
    """The most frequent pairs with their losses, sent to all tasks, and the table of all others.

    Pairs are taken by the number of binary digits of their counts, as long as at most HEAD_PAIRS are.
    """
    digits = F.length(F.bin("n"))
    sizes = {r["digits"]: r["pairs"] for r in model.groupBy(digits.alias("digits")).agg(F.count("*").alias("pairs")).collect()}
    least, taken = 65, 0
    while least > 1 and taken + sizes.get(least - 1, 0) <= HEAD_PAIRS:
        least -= 1
        taken += sizes.get(least, 0)
    found = model.where(digits >= least).select("pair", "target_loss", "background_loss").toArrow().sort_by("pair")
    head = [found[name].to_numpy() for name in ("pair", "target_loss", "background_loss")]
    return model.sparkSession.sparkContext.broadcast(head), model.where(digits < least)


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: str = RANKS) -> DataFrame:
    """Score every document against the target documents among them.

    Returns doc_id long, n_tokens long, target_loss, background_loss and difference double (means per token).
    Null and empty texts have no tokens, null losses and difference 0. Without targets or target tokens both
    models are uniform and every difference is 0. Null ids are returned as null and are no targets, repeated
    rows count and are scored each, further columns are ignored.
    """
    vocabulary = len(encoder(ranks)[1])
    rows, marked = encoded(docs, targets, id_col, text_col, ranks)
    head, others = _head(fit(rows, marked, vocabulary))

    def rate(batches):
        known, *losses = head.value
        for batch in batches:
            sums, rest, times, ends = [], [], [], [0]
            for data in batch["ids"].to_pylist():
                ids = np.frombuffer(data, id_type(vocabulary)).astype(np.int64)
                pair, n = np.unique(pairs(ids, vocabulary), return_counts=True)
                at = np.searchsorted(known, pair)
                here = at < len(known)
                here[here] = known[at[here]] == pair[here]
                at = at[here]
                sums.append((len(ids), *(int(loss[at] @ n[here]) for loss in losses)))
                rest.append(pair[~here])
                times.append(n[~here])
                ends.append(ends[-1] + len(rest[-1]))
            out = {"row": batch["row"], "doc_id": batch["doc_id"]}
            for i, name in enumerate(("n_tokens", "target_sum", "background_sum")):
                out[name] = pa.array([x[i] for x in sums], pa.int64())
            for name, parts in (("pairs", rest), ("times", times)):
                values = np.concatenate(parts) if parts else np.zeros(0, np.int64)
                out[name] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64()))
            yield pa.record_batch(out)

    rated = stored(rows.select("row", "doc_id", "ids").mapInArrow(rate, "row long, doc_id long, n_tokens long, target_sum long, background_sum long, pairs array<long>, times array<long>"), "rated")
    rest = rated.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    priced = rest.join(others.select("pair", "target_loss", "background_loss"), "pair")
    more = priced.groupBy("row").agg(*[F.sum(F.col("times") * F.col(f"{k}_loss")).alias(f"{k}_more") for k in ("target", "background")])
    both = rated.select("row", "doc_id", "n_tokens", "target_sum", "background_sum").join(more, "row", "left")

    def mean(kind: str) -> Column:
        total = F.col(f"{kind}_sum") + F.coalesce(f"{kind}_more", F.lit(0))
        return F.when(F.col("n_tokens") > 0, total / F.lit(_UNIT) / F.col("n_tokens"))

    means = both.select("doc_id", "n_tokens", mean("target").alias("target_loss"), mean("background").alias("background_loss"))
    return means.withColumn("difference", F.coalesce(F.col("target_loss") - F.col("background_loss"), F.lit(0.0)))
