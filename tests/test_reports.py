"""Keyed lookups, report sections, run logs and undated golden events on small tables."""

import datetime

from pyspark.sql import functions as F

from marketloom import fixed
from marketloom.functions import urls
from marketloom.operators import demands, documents, readers, research
from marketloom.sources import tables


def test_lookups_take_values_lists_and_ranges(spark):
    rows = spark.createDataFrame([("a", "2024-01-01", 1), ("a", "2024-01-05", 2), ("b", "2024-01-05", 3), (None, None, 4)], "k string, d string, n int").withColumn("d", F.to_date("d"))
    assert [r.n for r in readers.look_up(rows, k="a", d="2024-01-05").collect()] == [2]
    assert sorted(r.n for r in readers.look_up(rows, k=["a", "b"], d=("2024-01-05", "2024-01-09")).collect()) == [2, 3]
    assert [r.n for r in readers.newest(rows, ["d", "n"], 2, k=None).collect()] == [3, 2]
    assert "EqualTo(k,a)" in readers.look_up(rows, k="a")._jdf.queryExecution().toString() or readers.look_up(rows, k="a").count() == 2


def test_links_of_a_run_have_any_decision(spark):
    links = spark.createDataFrame([(1, "r", 5.0, "read"), (2, "r", 9.0, "skip"), (3, "s", 99.0, "read"), (4, "r", 5.0, "read")], "link_id long, run_id string, triage_score double, triage_decision string")
    assert [r.link_id for r in readers.links_of_run(links, "r", None, 10).collect()] == [2, 4, 1]
    assert [r.link_id for r in readers.links_of_run(links, "r", "read", 1).collect()] == [4]


def test_sections_count_groups_and_list_best_rows(spark):
    day = datetime.datetime(2024, 1, 1)
    rows = [(day + datetime.timedelta(hours=h), kind, score, name) for h, kind, score, name in
            [(0, "x", 1.0, "a"), (1, "x", 1.0, "b"), (2, "y", None, "c"), (3, None, 5.0, "d"), (23, "y", 0.5, "e"), (24, "x", 9.0, "late"), (-1, "x", 9.0, "early")]]
    frame = spark.createDataFrame(rows, "created_at timestamp, kind string, score double, name string")
    found = readers.report_sections(
        frame, "2024-01-01", "2024-01-02", {"all": F.lit("all"), "kinds": F.col("kind")},
        {"top": (F.lit(True), F.col("score"), F.col("name"), 3), "y": (F.col("kind") == "y", F.lit(0), F.col("name"), 9)},
    ).collect()
    assert {(r["section"], r["item"], r["rows"]) for r in found if r["position"] is None} == {("all", "all", 5), ("kinds", "x", 2), ("kinds", "y", 2)}
    assert sorted((r["section"], r["position"], r["item"]) for r in found if r["position"]) == [("top", 1, "d"), ("top", 2, "b"), ("top", 3, "a"), ("y", 1, "e"), ("y", 2, "c")]
    assert readers.report_sections(frame.limit(0), "2024-01-01", "2024-01-02", {"a": F.lit("x")}, {"t": (F.lit(True), F.lit(0), F.col("name"), 1)}).count() == 0


def test_failing_items_do_not_fail_a_batch(spark):
    rows = [("a", False), ("a", False), ("b", True), ("b", False), ("c", True)]
    found = demands.batches(spark.createDataFrame(rows, "batch string, failed boolean"), "batch").collect()
    assert {r.batch: (r["items"], r.failures, r.status) for r in found} == {"a": (2, 0, "success"), "b": (2, 1, "partial_success"), "c": (1, 1, "failed")}


def test_requests_reuse_the_logged_run_of_their_key(spark, tmp_path):
    schema = "run_id string, idempotency_key string, status string, started_at int"
    demands.log_runs(spark.createDataFrame([("r1", "k1", "success", 1), ("r2", "k2", "failed", 1), ("r0", "k1", "failed", 2)], schema), str(tmp_path))
    demands.log_runs(spark.createDataFrame([("r3", "k2", "success", 3), ("r4", "k3", "success", 3)], schema), str(tmp_path))
    requests = spark.createDataFrame([(i, f"k{i}") for i in (1, 1, 2, 3, 4)], "n int, idempotency_key string")
    found = demands.reusable_runs(requests, tables.read(spark, str(tmp_path))).collect()
    assert sorted((r.n, r.reused_run_id) for r in found if r.reused_run_id) == [(1, "r1"), (1, "r1"), (3, "r4")] and len(found) == 5


def test_undated_events_count_on_the_day_they_were_created(spark):
    golden = spark.createDataFrame([("g1", 1, "2024-01-01", "2024-01-03", ["50%"]), ("g2", 1, "2024-02-01", "2024-02-01", [])], "expected_event_id string, target_id int, a string, b string, keywords array<string>")
    none = F.array().cast("array<string>")
    golden = golden.select("expected_event_id", "target_id", F.to_date("a").alias("date_from"), F.to_date("b").alias("date_to"), "keywords", none.alias("source_types"), none.alias("expected_variables"))
    events = spark.createDataFrame([(1, 1, None, "2024-01-02 05:00:00", "up 50% now", 0.1), (2, 1, "2024-03-01", "2024-01-02 05:00:00", "up 50%", 0.9), (3, 1, None, "2024-01-02 05:00:00", "up 500", 0.9)],
                                   "event_id long, target_id int, d string, c string, summary string, confidence double")
    events = events.select("event_id", "target_id", F.to_date("d").alias("event_date"), F.col("c").cast("timestamp").alias("created_at"), "summary", F.lit("x").alias("source_type"), "confidence")
    links = events.select("event_id", F.lit("v").alias("tracking_variable"))
    matches = research.golden_matches(golden, events, links)
    assert {r.expected_event_id: r.matched_event_id for r in matches.collect()} == {"g1": 1, "g2": None}
    assert [tuple(r) for r in research.golden_missed(matches).collect()] == [("g2", 1)]
    run = research.golden_runs(matches.withColumn("f", F.lit("list")), ["f"])
    first, again = run.first(), run.first()
    assert (first.expected_count, first.matched_count, first.recall, first.missed) == (2, 1, 0.5, "g2") and first.run_id == again.run_id


def test_first_listed_domain_names_the_type(spark):
    hosts = [("www.sse.com.cn",), ("sse.com.cn",), ("asse.com.cn",), ("x.miit.gov.cn",), ("",), (None,), ("b.a",), ("a",)]
    frame = spark.createDataFrame(hosts, "h string")
    assert [r.t for r in frame.select(urls.source_type(F.col("h")).alias("t")).collect()] == ["exchange", "exchange", "media", "regulator", "unknown", "unknown", "media", "media"]
    assert [r.t for r in frame.select(urls.source_type(F.col("h"), {"a": "one", "b.a": "two"}).alias("t")).collect()][-2:] == ["one", "one"]


def page(spark, body, title=None, tables=None):
    return spark.createDataFrame([(body, title, tables)], "body string, title string, tables array<string>")


def chosen(frame, **options):
    row = documents.select_passages(frame, F.array(F.lit("宁德"), F.lit("")), ["毛利率"], **options).first()
    return [(p.passage_id, p.text) for p in row.passages], row.passages_left_out


def test_title_paragraphs_and_tables_share_places_and_budget(spark):
    body = "\n".join(["first", "plain", "宁德 one", "毛利率", " ", "2024-01-02"])
    tables = ["毛利率 | 22.5%", "nothing", "120 GWh", None]
    whole, left = chosen(page(spark, body, "T", tables))
    assert [i for i, _ in whole] == ["title", "p0", "p2", "p3", "p4", "t1", "t3"] and left == 0
    few, left = chosen(page(spark, body, "T", tables), limit=4)
    assert [i for i, _ in few] == ["title", "p0", "p2", "p3"] and left == 3
    short, left = chosen(page(spark, body, "T", tables), budget=13)
    assert short == [("title", "T"), ("p0", "first"), ("p2", "宁德 one"), ("p3", "毛利")] and left == 3
    spare, left = chosen(page(spark, "first", None, tables), limit=3, budget=10)
    assert spare == [("p0", "first"), ("t1", "毛利率 |")] and left == 1
    assert chosen(page(spark, "", "", None)) == ([], 0) and chosen(page(spark, None, None, [])) == ([], 0)


def test_chunks_are_cut_only_when_asked(spark):
    rows = spark.createDataFrame([(["a" * 5, "b" * 5, "c" * 5],)], "p array<string>")
    assert [c.chunk for c in rows.select(documents.chunk_passages(F.col("p"), 6)).first()[0]] == [1, 2, 3]
    assert [c.chunk for c in rows.select(documents.chunk_passages(F.col("p"), 6, 2)).first()[0]] == [1, 2]


def test_templates_take_all_values_without_limits(spark):
    targets = spark.createDataFrame([(1, {"a": [f"x{i}" for i in range(5)], "b": ["y1", "y2"]})], "target_id int, values map<string,array<string>>")
    templates = [("f", 1.0, "{a} and {b}"), ("g", 1.0, "{c} gone"), ("h", 1.0, "fixed")]
    assert documents.expand_templates(targets, templates, None, None).count() == 11
    assert documents.expand_templates(targets, templates).count() == 7
    assert documents.expand_templates(targets, templates, 3, 4).count() == 5


def test_quick_date_test_finds_what_the_pattern_finds(spark):
    texts = ["2024-1", "2024年3", "12024/1x", "202-1", "2024-", "2023Q4", "3023Q4", "2023Q5", "近3天", "近天", "12天", "上半年", "下半年", "半年", "5天上半年", "", "１２３４-5"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(fixed.PASSAGE_DATE_PATTERN).alias("a"), F.col("t").rlike(fixed.PASSAGE_DATE_TEST).alias("b"))
    assert all(r.a == r.b for r in frame.collect())
