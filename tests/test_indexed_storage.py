"""Payload index, bucketed inserts, record directory, target classes, stream liveness and late rows, nested settings."""

import datetime
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import demands
from marketloom.sources import directory, raw_store, tables
from marketloom.streaming import jobs

FETCHED = "raw_payload_id string, provider string, request_type string, date string, source_api string, request_id string, provider_symbol string, raw_data string, fetch_order long"


def payload(spark, name, rows, provider="tushare"):
    return spark.createDataFrame([(name, provider, "bars", "2024-01-01", "daily", "r", str(i), json.dumps({"id": i}), i) for i in range(rows)], FETCHED).repartition(3)


def test_lookups_read_the_named_files_only(spark, tmp_path):
    path = str(tmp_path / "raw")
    raw_store.append(payload(spark, "p1", 40), path, "fetch_order")
    raw_store.append(payload(spark, "p2", 30, "akshare").unionByName(payload(spark, "p1", 50)), path, "fetch_order")
    found = raw_store.rows_at(spark, path, [("p1", 0), ("p1", 39), ("p1", 40), ("p2", 7), ("p2", 7), ("gone", 0)])
    assert sorted((r.raw_payload_id, r.raw_row_index, r.raw_data) for r in found.collect()) == [("p1", 0, '{"id": 0}'), ("p1", 39, '{"id": 39}'), ("p2", 7, '{"id": 7}')]
    every = {f for f in raw_store.scan(spark, path).inputFiles()}
    assert 0 < len(found.inputFiles()) < len(every)
    assert raw_store.rows_at(spark, path, [("gone", 0)]).count() == 0
    listed = {r.raw_payload_id: (r.provider, r.rows) for r in raw_store.indexed_catalogue(spark, path).collect()}
    assert listed == {"p1": ("tushare", 40), "p2": ("akshare", 30)}
    assert [r.raw_payload_id for r in raw_store.indexed_catalogue(spark, path, "akshare", "bars").collect()] == ["p2"]
    lines = raw_store.scan(spark, path)
    assert all(r.intact for r in raw_store.verify(lines).collect())
    hashes = {r.raw_payload_id: r.raw_hash for r in raw_store.metadata(lines).collect()}
    assert {r.raw_payload_id: r.raw_hash for r in raw_store.indexed_catalogue(spark, path).collect()} == hashes


def test_an_append_that_lost_its_index_is_written_in_the_same_place(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "raw")
    raw_store.append(payload(spark, "p0", 5), path, "fetch_order")
    with monkeypatch.context() as cut:
        cut.setattr(raw_store, "_bucketed", lambda rows, real=raw_store._bucketed: real(rows) if "file" not in rows.columns else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            raw_store.append(payload(spark, "p1", 20), path, "fetch_order")
    raw_store.append(payload(spark, "p1", 20), path, "fetch_order")
    raw_store.append(payload(spark, "p1", 20), path, "fetch_order")
    assert raw_store.records(raw_store.scan(spark, path)).count() == 25


def test_the_first_row_of_a_key_stays_in_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, n long, v int"
    rng = random.Random(1)
    stored = {}
    for batch in range(4):
        rows = [(rng.choice(["a", "b", None]) and f"k{rng.randrange(60)}", rng.randrange(3), 1000 * batch + i) for i in range(80)]
        tables.insert_absent_bucketed(spark.createDataFrame(rows, schema), path, ["k", "n"], ["v"], buckets=8, pieces=1)
        for k, n, v in sorted(rows, key=lambda r: r[2]):
            stored.setdefault((k, n), v)
        tables.insert_absent_bucketed(spark.createDataFrame(rows, schema), path, ["k", "n"], ["v"], buckets=8, pieces=1)
    found = [(r.k, r.n, r.v) for r in tables.read(spark, path).collect() if r.k is not None]
    assert sorted(found) == sorted((k, n, v) for (k, n), v in stored.items() if k is not None)


def test_filters_rule_out_new_keys_and_no_stored_one(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.insert_absent_bucketed(spark.range(2000).select(F.col("id").alias("k"), F.lit(1).alias("v")), path, ["k"], ["v"], 16, 4)
    bucket = F.pmod(F.xxhash64("k"), F.lit(16)).cast("int")
    asked = spark.range(1000, 9000).select(F.col("id").alias("k")).withColumn("bucket", bucket)
    likely = {r.k for r in tables.may_be_stored(asked, path, ["k"], 4).collect()}
    assert set(range(1000, 2000)) <= likely and len(likely) < 1100
    few = spark.createDataFrame([(5,)], "k long").withColumn("bucket", bucket)
    plan = tables.touched(tables.read(spark, path), few, ["bucket"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan


def test_records_of_all_types_are_found_by_id(spark, tmp_path):
    path = str(tmp_path / "d")
    schema = "record_id string, record_type string, raw_payload_id string, raw_payload_ref string, raw_row_index long, validation_status string, field_provenance map<string,string>"
    rows = [("b1", "bar", "p", "raw://p", 3, "quarantined", {"close": "tushare"}), ("i1", "index", "p", "raw://p", None, "quarantined", {"x": "y"}),
            ("s1", "security_master", None, None, 0, "validated", None), (None, "bar", "p", "r", 1, "validated", None)]
    directory.add(spark.createDataFrame(rows, schema), path)
    directory.add(spark.createDataFrame([("b1", "bar", "other", "raw://other", 9, "validated", None), ("t1", "trading_status", "p", "r", 1, None, None)], schema), path)
    found = {r.record_id: (r.raw_payload_ref, r.raw_row_index, r.is_quarantined, r.field_provenance) for r in directory.look_up(spark, path, ["b1", "i1", "s1", "t1", "none", "b1"]).collect()}
    assert found == {"b1": ("raw://p", 3, True, '{"close":"tushare"}'), "i1": ("raw://p", None, False, None), "s1": (None, 0, False, None), "t1": ("r", 1, False, None)}


def test_filter_classes_give_the_targets_of_each_demand(spark):
    rng = random.Random(2)
    layers = ["a", "b", "c", None]
    members = [(i, rng.choice(layers), f"T{i}", rng.choice(["sellable", "locked", None]), rng.random() < 0.3, rng.random() < 0.3, rng.choice(["active", "removed"])) for i in range(1, 200)]
    wanted = [(i, ["X", "Y"] if i % 7 == 0 else [], ["Z"] if i % 5 == 0 else [], rng.sample(["a", "b", "c", "none"], rng.randrange(4)) * rng.choice([1, 2]),
               rng.choice(["sellable", None]), rng.choice([True, False, None]), rng.choice([True, False])) for i in range(60)]
    m = spark.createDataFrame(members, "member_id long, pool_layer string, ticker string, sellability string, is_st boolean, is_suspended boolean, status string")
    d = spark.createDataFrame(wanted, "demand_id int, targets array<string>, include_tickers array<string>, pool_layers array<string>, sellability string, exclude_st boolean, exclude_suspended boolean")
    classed = demands.target_classes(d)
    expected, tickers = {}, {}
    for i, explicit, listed, pool, sell, no_st, no_susp in wanted:
        if explicit or listed:
            expected[i] = ("explicit", 2) if explicit else ("include_list", 1)
            continue
        tickers[i] = sorted(t for _, layer, t, s, st, susp, status in members if layer in pool and status == "active" and sell in (None, s) and not (no_st and st) and not (no_susp and susp))
        expected[i] = ("pool", len(tickers[i]))
    assert {r.demand_id: (r.origin, r.targets) for r in demands.target_counts(classed, m).collect()} == expected
    named = {r.demand_id: r.class_id for r in classed.collect()}
    held = {}
    for r in demands.class_members(classed, m).collect():
        held.setdefault(r.class_id, []).append(r.ticker)
    assert {i: sorted(held.get(c, [])) for i, c in named.items() if c} == tickers
    assert len(set(named.values())) < len([c for c in named.values() if c])


def test_liveness_does_not_depend_on_the_order_of_files(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    seconds = {"u": [0, 100, 220, 500, 2000, 4000], "w": [50, 5000]}
    rows = [(k, start + datetime.timedelta(seconds=s)) for k, all_ in seconds.items() for s in all_]
    wanted = set()
    for k, all_ in seconds.items():
        for gap, states in ((120, ("busy", "idle")), (900, (None, "stale"))):
            first = all_[0]
            for a, b in itertools.pairwise([*all_, 10**9]):
                if b - a > gap:
                    if a + gap <= 5000 - 600:
                        wanted |= {(k, states[0], first), (k, states[1], a + gap)} - {(k, None, first)}
                    first = b
    outcomes = []
    for turn, order in enumerate((rows, rows[::-1])):
        folder = tmp_path / str(turn)
        for row in order:
            spark.createDataFrame([row], "k string, t timestamp").coalesce(1).write.mode("append").parquet(str(folder))
        stream = jobs.read_files(spark, str(folder), "*.parquet", "k string, t timestamp")
        found = jobs.collect_once(jobs.liveness(stream, "k", "t"), "liveness").collect()
        outcomes.append({(r.k, r.state, int((r.since - start).total_seconds())) for r in found})
    assert outcomes[0] == outcomes[1] == wanted


def test_late_rows_are_kept_aside(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    for minutes in ([10, 50], [200], [20, 190], [30, 150, 210]):
        spark.createDataFrame([(start + datetime.timedelta(minutes=m),) for m in minutes], "t timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = jobs.read_files(spark, str(tmp_path / "in"), "*.parquet", "t timestamp", maxFilesPerTrigger="1")
    jobs.run_batches(stream, jobs.late_sink(spark, str(tmp_path / "side"), "t", "60 minutes"), str(tmp_path / "checkpoint"))
    late = sorted(int((r.t - start).total_seconds() // 60) for r in spark.read.parquet(str(tmp_path / "side/late")).collect())
    assert late == [30, 150]  # the third file still meets the watermark of the first
    assert spark.read.parquet(str(tmp_path / "side/seen")).agg(F.sum("rows")).first()[0] == 8


def test_trees_merge_at_every_depth(spark):
    cases = [
        ({"a": {"b": {"c": 1, "d": 2}}, "x": 1}, {"a": {"b": {"c": 9, "e": []}}}, {"a": {"b": {"c": 9, "d": 2, "e": []}}, "x": 1}),
        ({"a": {"b": 1}}, {"a": 5}, {"a": 5}), ({"a": 5}, {"a": {"b": 1}}, {"a": {"b": 1}}), ({}, {"é": None}, {"é": None}), ({"l": [1, 2]}, {"l": [3]}, {"l": [3]}),
    ]
    rows = [(i, json.dumps(b), json.dumps(o)) for i, (b, o, _) in enumerate(cases)] + [(10, None, '{"a":1}'), (11, '{"a":1}', None), (12, None, None)]
    found = {r.i: r.m for r in spark.createDataFrame(rows, "i int, b string, o string").select("i", text.merge_trees(F.col("b"), F.col("o")).alias("m")).collect()}
    assert [json.loads(found[i]) for i in range(len(cases))] == [w for _, _, w in cases]
    assert (found[10], found[11], found[12]) == ('{"a":1}', '{"a":1}', None)


def test_streams_read_a_table_that_is_a_file_or_a_folder(spark, tmp_path):
    from marketloom.plans import REGISTRY, Views

    small = "/root/testdata/sf0.001"
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    events.withColumn("user_id", F.col("user_id") + 10**6).write.parquet(str(tmp_path / "events.parquet.old"))
    read = REGISTRY["stream_latest_snapshots"].build
    wanted = {r.user_id: r.event_id for r in read(Views(spark, small)).collect()}
    assert {r.user_id: r.event_id for r in read(Views(spark, str(tmp_path))).collect()} == wanted
