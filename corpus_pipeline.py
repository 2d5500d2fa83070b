"""Training-text pipeline over ``documents``: drop toxic and poor texts, keep one of each group of near
copies, drop texts that hold benchmark items, and pack the rest into sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
documents. A stage judges each row that it gets, null texts as empty ones.
"""

from __future__ import annotations

import uuid
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from marketloom import session
from marketloom.llm import decontaminate, jaccard, packing, quality, toxicity
from marketloom.llm.common import prepare, table, where_column
from marketloom.llm.queries import grades

REJECT_TOXIC = 0.5
KEEP_QUALITY = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half. The model learns from the whole documents table."""
    prepare(spark)
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=~toxicity.held_out())
    return where_column(docs, "text", lambda text: model.column(text.cast("string")) < REJECT_TOXIC)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are at least as likely as not above the lowest grade; all, if there are no ratings to learn from."""
    prepare(spark)
    model = quality.fit(table(spark, sf_dir, "documents"), grades(table(spark, sf_dir, "labels")))
    if model is None:
        return docs
    return where_column(docs, "text", lambda text: model.tail_column(text.cast("string"), 1) >= KEEP_QUALITY)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more over five-word shingles."""
    prepare(spark)
    return jaccard.one_per_class(docs, Fraction(4, 5), 5)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of every benchmark item."""
    prepare(spark)
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of the documents in sequences of 4096 tokens."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: Classifiers and tokenisers are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; what each keeps is written to the shared scratch folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{session.scratch_root(spark)}/llm/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return STAGES[-1][1](spark, docs, sf_dir)
