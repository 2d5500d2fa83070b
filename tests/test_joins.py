"""Near-duplicate pairs, interval overlaps and the comparison of all record types, against plain loops."""

import collections
import datetime
import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from marketloom.functions import text
from marketloom.operators import cells, hotkeys, intervals, neighbours


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("distance", [1, 3, 5])
def test_pairs_within_a_distance_match_all_pairs(spark, distance):
    rng = random.Random(distance)
    centres = [rng.getrandbits(64) for _ in range(6)] + [0, (1 << 64) - 1]
    prints = []
    for i in range(300):
        x = rng.choice(centres)
        for b in rng.sample(range(64), rng.randrange(8)):
            x ^= 1 << b
        prints.append((i, signed(x)))
    prints += [(1000 + i, s) for i, s in prints[:40]] + [(2000, None)]
    frame = spark.createDataFrame(prints, "doc_id long, signature long")
    classes = neighbours.signature_classes(frame, "doc_id", "signature")
    members = collections.defaultdict(list)
    for i, s in prints:
        if s is not None:
            members[s].append(i)
    assert {tuple(r) for r in classes.collect()} == {(s, min(m), len(m)) for s, m in members.items()}
    wanted = set()
    for (a, m), (b, n) in itertools.combinations(members.items(), 2):
        gap = ((a ^ b) & ((1 << 64) - 1)).bit_count()
        if gap <= distance:
            wanted.add((*sorted((min(m), min(n))), gap))
    found = [tuple(r) for r in neighbours.close_pairs(classes, "signature", distance).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    joined = neighbours.membership(frame, classes, "signature").collect()
    assert {(r["doc_id"], r["class_id"]) for r in joined} == {(i, min(m)) for m in members.values() for i in m}


def test_any_few_bits_leave_a_choice_of_blocks_equal():
    for distance in (0, 2, 3):
        chosen = neighbours.masks(distance)
        rng = random.Random(distance)
        for _ in range(300):
            error = signed(sum(1 << b for b in rng.sample(range(64), distance)))
            assert any(error & m == 0 for m in chosen)
        assert all((m & ((1 << 64) - 1)).bit_count() >= 3 * (64 // (distance + 3)) for m in chosen)


def plain_signature(value):
    squeezed = re.sub(r"\s+", " ", value or "").strip()
    if not squeezed:
        return 0
    votes = [0] * 64
    for i in range(max(len(squeezed) - 2, 1)):
        h = int(hashlib.md5(squeezed[i : i + 3].encode()).hexdigest(), 16)
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return signed(sum(1 << b for b in range(64) if votes[b] > 0))


def test_signatures_of_odd_texts_match_plain_ones(spark, monkeypatch):
    monkeypatch.setattr(text, "SLAB_CHARS", 40)
    texts = [None, "", " \n", "a", " a ", "ab", "a b", "  abc", "abc  ", "x　 y z", "中文字符测试", "é" * 50, "\U0001f600 tail of text", "one\ttwo\r\nthree " * 20]
    known = text._GramBits(limit=5)
    assert text.signatures([t or "" for t in texts], known).tolist() == [plain_signature(t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", text.simhash64(F.col("t")).alias("s")).collect()
    assert {r["i"]: r["s"] for r in rows} == {i: plain_signature(t) for i, t in enumerate(texts)}
    assert spark.createDataFrame([], "t string").select(text.simhash64(F.col("t"))).collect() == []


@pytest.mark.parametrize("unit", ["month", "year"])
def test_overlaps_match_all_pairs(spark, unit):
    rng = random.Random(4)
    day = datetime.date(2023, 1, 1)

    def spans(count):
        rows = []
        for i in range(count):
            start = day + datetime.timedelta(rng.randrange(900))
            end = start + datetime.timedelta(rng.randrange(-3, 200))
            rows.append((i, rng.choice("abc") if i % 11 else None, start if i % 7 else None, end if i % 5 else None))
        return rows

    left, right = spans(70), spans(90)
    a = spark.createDataFrame(left, "l int, k string, l_from date, l_to date")
    b = spark.createDataFrame(right, "r int, k string, r_from date, r_to date")
    found = intervals.overlap_join(a, b, ["k"], ("l_from", "l_to"), ("r_from", "r_to"), unit)
    low, high = datetime.date.min, datetime.date.max
    wanted = set()
    for i, k, f, t in left:
        for j, m, g, u in right:
            ends = (f or low, t or high, g or low, u or high)
            if k is not None and k == m and ends[0] <= ends[1] and ends[2] <= ends[3] and max(ends[0], ends[2]) <= min(ends[1], ends[3]):
                wanted.add((i, j, max((x for x in (f, g) if x), default=None), min((x for x in (t, u) if x), default=None)))
    rows = [(r["l"], r["r"], r["overlap_from"], r["overlap_to"]) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == wanted
    assert intervals.overlap_join(a.limit(0), b, ["k"], ("l_from", "l_to"), ("r_from", "r_to")).count() == 0


def test_cut_intervals_are_never_broadcast(spark):
    """A small table whose open intervals span many blocks is large once cut, which the planner can't see."""
    a = spark.sql("select id as l, id % 2 as k, date '1990-01-01' as l_from, cast(null as date) as l_to from range(50)")
    b = spark.sql("select id as r, id % 2 as k, date_add(date '1990-01-01', cast(id * 30 as int)) as r_from, cast(null as date) as r_to from range(200)")
    found = intervals.overlap_join(a, b, ["k"], ("l_from", "l_to"), ("r_from", "r_to"))
    assert found.count() == 25 * 100 * 2
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_one_key_and_day_are_spread_over_tasks(spark):
    """One group holds every pair, few bytes and many rows: its tasks must follow the pairs, whatever the bytes."""
    one = "cast(id div 1000000 as int)"  # no constant, which the planner would know
    a = spark.sql(f"select id as l, {one} as k, date_add(date '2024-01-05', {one}) as l_from, date_add(date '2024-01-09', {one}) as l_to from range(6000)")
    b = spark.sql(f"select id as r, {one} as k, date_add(date '2024-01-03', cast(id % 5 as int)) as r_from, cast(null as date) as r_to from range(9000)")
    found = intervals.overlap_join(a, b, ["k"], ("l_from", "l_to"), ("r_from", "r_to"))
    tasks = found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.sum(F.col("l") * F.col("r")).alias("sum")).collect()
    assert sum(t["n"] for t in tasks) == 6000 * 9000 and sum(t["sum"] for t in tasks) == sum(range(6000)) * sum(range(9000))
    assert max(t["n"] for t in tasks) <= 6000 * 9000 // 3


@pytest.mark.parametrize("cut_rows", [1, 3])
def test_cut_keys_meet_like_plain_ones(spark, monkeypatch, cut_rows):
    monkeypatch.setattr(hotkeys, "CUT_ROWS", cut_rows)
    monkeypatch.setattr(hotkeys, "TASK_PAIRS", 20)
    a = spark.createDataFrame([(i, "hot" if i < 20 else f"k{i % 4}" if i % 5 else None, {i: i}) for i in range(40)], "l int, k string, m map<int,int>")
    b = spark.createDataFrame([(i, "hot" if i < 15 else f"k{i % 5}" if i % 6 else None) for i in range(60)], "r int, k string")
    x, y, on = hotkeys.dealt_by_pairs(a, b, ["k"])
    assert len(on) == 3 and x.count() > 40  # some keys are cut and their rows copied
    rows = [(r["l"], r["r"]) for r in x.join(y, on).collect()]
    wanted = [(r["l"], r["r"]) for r in a.join(b, "k").collect()]
    assert sorted(rows) == sorted(wanted) and len(wanted) > 300
    none, _, on = hotkeys.dealt_by_pairs(a.limit(0), b, ["k"])
    assert on == ["k"] and none.count() == 0


def test_overlap_days_as_text_are_those_of_the_dates(spark):
    """Days are spelled once per interval; nulls and the end of the calendar included."""
    a = spark.sql("""select * from values (1, 'a', date '2023-01-05', date '2023-03-01'), (2, 'a', null, null), (3, 'a', date '2023-02-01', null),
      (4, 'a', null, date '2023-02-10'), (5, 'a', date '2023-02-20', date '9999-12-31'), (6, 'a', date '0999-02-20', date '0999-03-20') as t(l, k, l_from, l_to)""")
    b = spark.sql("""select * from values (1, 'a', date '2023-01-05', date '2023-01-05'), (2, 'a', null, date '2023-02-01'), (3, 'a', date '2023-03-01', null),
      (4, 'a', null, null), (5, 'a', date '2023-05-31', date '9999-12-31') as t(r, k, r_from, r_to)""")
    spans = ["k"], ("l_from", "l_to"), ("r_from", "r_to"), "year"
    dates, texts = intervals.overlap_join(a, b, *spans), intervals.overlap_join(a, b, *spans, text=True)
    columns = ["l", "r", *[F.col(c).cast("string").alias(c) for c in ("overlap_from", "overlap_to")]]
    plain = a.join(b, "k").where("coalesce(greatest(l_from, r_from) <= least(l_to, r_to), true)")
    plain = plain.select("l", "r", F.greatest("l_from", "r_from").cast("string"), F.least("l_to", "r_to").cast("string"))
    assert collections.Counter(dates.select(columns).collect()) == collections.Counter(texts.select(columns).collect()) == collections.Counter(plain.collect())
    assert dict(texts.dtypes)["overlap_from"] == "string" and dict(dates.dtypes)["overlap_to"] == "date"
    assert dates.columns == texts.columns


def test_counts_of_valid_intervals_match_all_pairs(spark):
    rng = random.Random(6)
    day = datetime.date(2023, 1, 1)
    points = [(i, rng.choice("abcd") if i % 9 else None, day + datetime.timedelta(rng.randrange(300)) if i % 8 else None) for i in range(120)]
    spans = []
    for i in range(150):
        start = day + datetime.timedelta(rng.randrange(280))
        end = start + datetime.timedelta(rng.randrange(-3, 60))
        spans.append((rng.choice("abc") if i % 11 else None, start if i % 7 else None, end if i % 5 else None))
    p = spark.createDataFrame(points, "p int, k string, at date")
    s = spark.createDataFrame(spans, "k string, f date, t date")
    found = {r["p"]: r["n"] for r in intervals.counted_on(p, s, ["k"], "at", ("f", "t"), "n").collect()}
    wanted = {
        i: sum(k is not None and k == m and at is not None and f is not None and f <= at <= (t or datetime.date.max) for m, f, t in spans) for i, k, at in points
    }
    assert found == wanted and any(wanted.values())


RECORDS = "record_type string, provider string, record_id string, source_api string, data map<string,string>"


def compared(spark, *rows):
    return {(r["other_record_id"], r["field_name"]): r for r in cells.cells(spark.createDataFrame(list(rows), RECORDS), "tushare").collect()}


def test_absent_values_are_neither_matches_nor_conflicts(spark):
    ticker = {"normalized_ticker": "600519.SH"}
    own = ("security_master", "tushare", "a", "", {**ticker, "name": "贵州茅台", "company_full_name": "贵州茅台酒股份有限公司", "industry": "白酒", "total_share": None})
    other = ("security_master", "akshare", "b", "", {**ticker, "name": " 贵州 茅台", "company_full_name": "", "total_share": "1"})
    found = compared(spark, own, other)
    assert [f for (_, f), r in found.items() if r["checked"]] == ["name"] and not any(r["severity"] for r in found.values())
    frame = cells.cells(spark.createDataFrame([own, other, ("security_master", "baostock", "c", "", ticker)], RECORDS), "tushare")
    by_record = {r["other_record_id"]: r for r in cells.results(frame).collect()}
    assert [by_record["b"][c] for c in ("checked_fields", "matched_fields", "conflicted_fields", "status")] == [1, 1, 0, "matched"]
    assert [by_record["c"][c] for c in ("checked_fields", "status")] == [0, "matched"]


def test_estimated_amounts_are_not_compared(spark):
    same = {"normalized_ticker": "1", "frequency": "1d", "timestamp": "", "trade_date": "2025-01-02", "adjust": "none", "close": "11.43"}
    found = compared(
        spark,
        ("bar", "tushare", "a", "daily", {**same, "amount": "2102923078.11", "vwap": "11.55"}),
        ("bar", "akshare", "b", "stock_zh_a_hist_tx", {**same, "timestamp": None, "amount": "2081000000.0", "vwap": "11.44"}),
    )
    assert {f for (_, f), r in found.items() if r["checked"]} == {"close"} and found["b", "close"]["severity"] is None


def test_levels_of_differences(spark):
    def bar(provider, **values):
        return ("bar", provider, provider, "", {"normalized_ticker": "1", "frequency": "1d", "timestamp": "t", "adjust": "none", **values})

    found = compared(spark, bar("tushare", close="10.0", open="10", volume="100", amount="10", turnover_rate="1", vwap="x"),
                     bar("akshare", close="10.0005", open="10.5", volume="n/a", amount="200", turnover_rate="1.2", vwap="Y"),
                     bar("baostock", close="10.5", open="NaN", volume="101", amount="10.5", turnover_rate="bad", vwap="Ｘ Ltd."),
                     bar("fourth", close="13"))
    levels = {k: r["severity"] for k, r in found.items() if r["checked"]}
    assert levels == {
        ("akshare", "close"): None, ("akshare", "open"): "medium", ("akshare", "volume"): "medium", ("akshare", "amount"): "high",
        ("akshare", "turnover_rate"): "medium", ("akshare", "vwap"): "low", ("baostock", "close"): "high", ("baostock", "volume"): "high",
        ("baostock", "amount"): "high", ("baostock", "turnover_rate"): "medium", ("baostock", "vwap"): None, ("fourth", "close"): "critical",
    }
    status = {"normalized_ticker": "600519.SH", "trade_date": "2026-05-29"}
    flags = compared(spark, ("trading_status", "tushare", "a", "", {**status, "is_suspended": "false", "list_status": "L"}),
                     ("trading_status", "akshare", "b", "", {**status, "is_suspended": "true", "list_status": "D"}))
    assert [flags["b", f]["severity"] for f in ("is_suspended", "list_status")] == ["critical", "high"]


def test_keys_of_all_record_types(spark):
    data = {n: n for n in "normalized_ticker exchange calendar_date trade_date frequency adjust concept_name provider index_code".split()}
    rows = spark.createDataFrame([("trade_calendar", data), ("bar", data), ("concept_membership", {**data, "concept_code": ""}), ("other", {**data, "x_id": None})], "record_type string, data map<string,string>")
    found = {r["record_type"]: r["k"] for r in rows.select("record_type", cells.comparison_key(F.col("record_type"), F.col("data")).alias("k")).collect()}
    assert found == {
        "trade_calendar": "exchange|calendar_date", "bar": "normalized_ticker|frequency|trade_date|adjust",
        "concept_membership": "normalized_ticker|concept_name|provider", "other": "index_code|None",
    }


def test_canonical_records_are_joined_without_a_broadcast(spark, tmp_path):
    """Their estimated size is that of the file they are made of, a hundredth of what they are."""
    ticker = {"normalized_ticker": "600519.SH"}
    rows = [("security_master", "tushare", "a", "", {**ticker, "name": "x"}), ("security_master", "akshare", "b", "", {**ticker, "name": "y"})]
    spark.createDataFrame(rows, RECORDS).write.parquet(f"{tmp_path}/records")
    found = cells.cells(spark.read.parquet(f"{tmp_path}/records"), "tushare")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and plan.count("SortMergeJoin") == 1  # the rules are sent to all tasks
    assert {(r["field_name"], r["canonical_value"], r["other_value"]) for r in found.where("severity is not null").collect()} == {("name", "x", "y")}
