"""Skew-safe primitives against brute force on data where one key dominates."""

import random

import pytest
from pyspark.sql import functions as F

from marketloom.operators import demands, documents, hotkeys
from marketloom.operators.hotkeys import asof_join, latest_by_key, mark_first, running_total, salted_join, weighted_median
from marketloom.plans import comparison, views
from marketloom.plans import providers as provider_plans

KEYS = ["hot"] * 6 + ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    return [(rng.choice(KEYS), i, rng.randint(0, 50), float(rng.randint(1, 9))) for i in range(600)]


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, n long, v int, w double").repartition(7)


def test_latest_by_key(frame, rows):
    got = {r.k: r.n for r in latest_by_key(frame, ["k"], ["v", "n"]).collect()}
    want = {}
    for k, n, v, _ in rows:
        want[k] = max(want.get(k, (-1, -1)), (v, n))
    assert got == {k: n for k, (_, n) in want.items()}


def test_latest_by_key_keeps_map_columns(spark):
    df = spark.sql("select 'a' as k, 1 as n, map('x', 1) as m union all select 'a', 2, map('y', 2)")
    assert latest_by_key(df, ["k"], ["n"]).collect()[0].m == {"y": 2}


def test_mark_first(frame, rows):
    first = {}
    for k, n, *_ in rows:
        first.setdefault(k, n)
    assert {r.n for r in mark_first(frame, ["k"], "n").where("is_first").collect()} == set(first.values())


@pytest.mark.parametrize("block", [1, 16, 10_000])
def test_running_total(frame, rows, block):
    got = {r.n: r.t for r in running_total(frame, ["k"], ["n"], F.col("v"), F.floor(F.col("n") / block), "t").collect()}
    sums, want = {}, {}
    for k, n, v, _ in rows:
        want[n] = sums[k] = sums.get(k, 0) + v
    assert got == want


@pytest.mark.parametrize("unit", ["day", "month"])
def test_asof_join(spark, frame, rows, unit):
    rng = random.Random(3)
    origin = F.lit("2026-01-01").cast("date")
    right = {(k, t): rng.random() for k in ("hot", "a", "zz") for t in rng.sample(range(-40, 640), 25)}
    events = spark.createDataFrame([(k, t, x) for (k, t), x in right.items()], "k string, t int, x double")
    events = events.withColumn("d", F.date_add(origin, F.col("t")))
    probes = frame.withColumn("d", F.date_add(origin, F.col("n").cast("int")))
    joined = asof_join(probes, events, ["k"], "d", ["t", "x"], ("2026-01-01", "2027-12-31"), unit).collect()
    assert len(joined) == len(rows)
    for r in joined:
        before = max((t for k, t in right if k == r.k and t <= r.n), default=None)
        after = min((t for k, t in right if k == r.k and t >= r.n), default=None)
        assert (r.prev.t if r.prev else None) == before and (r.next.t if r.next else None) == after
        assert before is None or r.prev.x == right[(r.k, before)]


@pytest.mark.parametrize("block", [1, 10, 100])
def test_weighted_median(frame, rows, block):
    got = {r.k: r.v for r in weighted_median(frame, ["k"], "v", "w", F.floor(F.col("v") / block)).collect()}
    for key in set(KEYS):
        pairs = sorted((v, w) for k, _, v, w in rows if k == key)
        total, acc = sum(w for _, w in pairs), 0.0
        for v, w in pairs:
            acc += w
            if acc >= total / 2:
                break
        assert got[key] == v


def test_salted_join_keeps_every_row_once(spark, frame, rows):
    side = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, s int")
    left = salted_join(frame, side, ["k"])
    assert left.count() == len(rows) and left.where("s is null").count() == sum(k in "bc" for k, *_ in rows)
    assert salted_join(frame, side, ["k"], "inner").count() == sum(k in ("hot", "a") for k, *_ in rows)


def test_failure_streaks(frame, rows):
    outcomes = frame.select("k", "n", (F.col("v") > 15).alias("failed"))
    got = {r.n: r.streak for r in demands.failure_streaks(outcomes, "k", "n", F.floor(F.col("n") / 32)).collect()}
    running, want = {}, {}
    for k, n, v, _ in rows:
        running[k] = running.get(k, 0) + 1 if v > 15 else 0
        if v > 15:
            want[n] = running[k]
    assert got == want


def test_budget_prefix(frame, rows):
    kept = documents.within_budget(frame, "k", ["n"], F.floor(F.col("n") / 16), 10).select("n").collect()
    seen, want = {}, set()
    for k, n, *_ in rows:
        seen[k] = seen.get(k, 0) + 1
        if seen[k] <= 10:
            want.add(n)
    assert {r.n for r in kept} == want


def test_reuse_prefers_latest_other_run(spark):
    links = spark.createDataFrame([(1, "r1", "h"), (2, "r2", "h"), (3, "r2", "h"), (4, "r3", "g"), (5, "r1", "")], "link_id long, run_id string, h string")
    links = links.withColumn("target_id", F.lit("t"))
    analyses = spark.createDataFrame([(1, "t", 10), (2, "t", 20), (3, "t", 30), (5, "t", 9)], "link_id long, target_id string, analysed_at long")
    got = {r.link_id: r.reused_link_id for r in documents.reusable_analysis(links, analyses, "h").collect()}
    assert got == {1: 3, 2: 1, 3: 1, 4: None, 5: None}


def test_results_do_not_depend_on_partitioning(frame):
    def run(df):
        return sorted(map(tuple, running_total(df, ["k"], ["n"], F.col("v"), F.floor(F.col("n") / 64), "t").select("n", "t").collect()))

    assert run(frame) == run(frame.repartition(3)) == run(frame.orderBy(F.desc("n")).coalesce(1))


def test_dealt_rows_are_cut_by_number_and_kept(spark):
    rows = spark.range(0, 1000, 1, 1).withColumn("v", F.col("id") * 2)
    dealt = hotkeys.dealt(rows, "id", 100)
    assert dealt.rdd.getNumPartitions() == 10 and hotkeys.dealt(rows.limit(0), "id", 100).count() == 0
    assert sorted(map(tuple, dealt.collect())) == [(i, 2 * i) for i in range(1000)]


def test_views_that_multiply_parts_make_them_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(views, "PART_ROWS", 50)
    v = views.Views(spark, "/root/testdata/sf0.001")
    wanted = -(-v.table("part").count() // 50)
    assert wanted > 1
    for made in (v.quotes(), comparison.records(v)):
        assert made.rdd.getNumPartitions() == wanted


def test_keys_on_which_providers_meet_are_gathered_in_as_many_tasks_as_their_rows_need(spark, monkeypatch):
    monkeypatch.setattr(views, "PART_ROWS", 50)
    v = views.Views(spark, "/root/testdata/sf0.001")
    wanted = -(-v.quotes().count() // 150)
    assert wanted > 1
    plans = [provider_plans.provider_comparisons, provider_plans.provider_conflicts, provider_plans.merged_records, provider_plans.quality_scores]
    for build in plans:
        found = sorted(map(str, build(v).collect()))
        spark.conf.set("spark.sql.shuffle.partitions", 1)
        try:
            alone = build(v)
            assert alone.rdd.getNumPartitions() == wanted, build.__name__
            assert sorted(map(str, alone.collect())) == found
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 8)
