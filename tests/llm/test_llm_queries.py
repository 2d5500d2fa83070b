"""Registered queries of the training-text operators, and the pipeline, on the smallest tables."""


import duckdb
import pytest

import corpus_pipeline
from marketloom.llm import queries
from tools import check

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(queries.SQL))
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    good, note = check.compare(spark, con, name, FOLDER, 15)
    assert good, note


def test_pages_come_back_from_the_archives(spark):
    import base64
    import hashlib

    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    first = {}
    for page_id in sorted(pages):
        first.setdefault(pages[page_id], page_id)
    for r in queries.op7_warc(spark, FOLDER).collect():
        data = pages.pop(r["page_id"])
        response = first[data] == r["page_id"]
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert r["record_type"] == ("response" if response else "revisit") and r["refers_to"] == (None if response else first[data])
    assert not pages


def test_pipeline_stages_keep_columns_and_drop_copies(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, count = docs.columns, docs.count()
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if number == len(corpus_pipeline.STAGES) - 1:
            break
        assert out.columns == columns
        out.write.parquet(str(tmp_path / str(number)))
        docs = spark.read.parquet(str(tmp_path / str(number)))
        assert docs.count() <= count
        count = docs.count()
    left = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(left) == count and {r["doc_id"] for r in out.select("doc_id").collect()} == left




def test_pipeline_stages_take_odd_rows_and_empty_tables(spark):
    from marketloom.llm import common

    from .test_operators import ODD, odd_rows

    common.prepare(spark)
    spark.conf.set("spark.sql.caseSensitive", "true")
    odd = spark.createDataFrame(odd_rows(), ODD).coalesce(2)
    spark.conf.unset("spark.sql.caseSensitive")
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        found, none = stage(spark, odd, FOLDER), stage(spark, empty, FOLDER)
        rows = found.collect()
        assert none.count() == 0, name
        if name != corpus_pipeline.STAGES[-1][0]:
            assert found.columns == odd.columns and none.columns == empty.columns, name
            assert len(rows) <= len(odd_rows()), name
        else:
            assert {r["doc_id"] for r in rows} == {r[0] for r in odd_rows()}
