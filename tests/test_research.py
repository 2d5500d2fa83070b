"""Coverage, extraction and demand rules against hand-checked values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.operators import demands, documents, extraction, readers, research


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture
def seeded(spark):
    targets = frame(spark, [("t1", ["orders", "capex"], "i1", ["a", "b"]), ("t2", ["orders"], None, [])],
                    "target_id string, tracking_variables array<string>, industry_id string, theme_ids array<string>")
    events = frame(spark, [(1, "t1", 0.9, "exchange"), (2, "t1", 0.4, "media"), (3, "t2", 0.5, "media")],
                   "event_id long, target_id string, confidence double, source_type string")
    links = frame(spark, [(1, "orders", "accepted"), (2, "orders", "accepted"), (2, "capex", "pending"), (3, "orders", "pending")],
                  "event_id long, tracking_variable string, review_status string")
    return targets, events, links


def test_coverage(seeded):
    targets, events, links = seeded
    confirmed = research.coverage_matrix(targets, events, links)
    inclusive = research.coverage_matrix(targets, events, links, confirmed=False)
    total = research.coverage_totals(confirmed).first()
    assert (total.expected_cells, total.covered_cells, total.authoritative_cells, total.coverage_ratio) == (3, 1, 1, 0.3333)
    cells = {(r.target_id, r.tracking_variable) for r in research.candidate_only_cells(confirmed, inclusive).collect()}
    assert cells == {("t1", "capex"), ("t2", "orders")}
    assert [r.target_id for r in research.zero_covered_targets(confirmed).collect()] == ["t2"]
    groups = {r.group_key: r.coverage_ratio for r in research.coverage_by_group(confirmed, targets, ["industry_id"]).collect()}
    assert groups == {"i1": 0.5, "unknown": 0.0}
    assert {r.group_key for r in research.coverage_by_theme(confirmed, targets).collect()} == {"a", "b", "unknown"}


def test_golden_matching(spark):
    d = dt.date
    golden = frame(
        spark,
        [("g1", "t1", d(2026, 7, 1), d(2026, 7, 6), ["回购"], ["exchange"], ["buyback"]), ("g2", "t1", d(2026, 7, 1), d(2026, 7, 2), [], [], []), ("g3", "t2", d(2026, 7, 1), d(2026, 7, 2), ["x"], [], [])],
        "expected_event_id string, target_id string, date_from date, date_to date, keywords array<string>, source_types array<string>, expected_variables array<string>",
    )
    events = frame(
        spark,
        [(1, "t1", d(2026, 7, 3), "公司回购股份", "exchange", 0.6), (2, "t1", d(2026, 7, 4), "公司回购股份", "exchange", 0.9), (3, "t1", d(2026, 7, 2), "其他", "media", 0.2), (4, "t1", d(2026, 7, 9), "回购", "exchange", 1.0)],
        "event_id long, target_id string, event_date date, summary string, source_type string, confidence double",
    )
    links = frame(spark, [(1, "buyback"), (3, "orders")], "event_id long, tracking_variable string")
    matches = research.golden_matches(golden, events, links)
    assert {r.expected_event_id: r.matched_event_id for r in matches.collect()} == {"g1": 1, "g2": 3, "g3": None}
    assert research.golden_recall(matches).first().recall == 0.6667


def test_keyword_candidates(spark):
    rows = frame(spark, [("中标 订单 合同 增长", ), ("no match",), ("合同 取消 但 增长",)], "s string")
    got = research.keyword_candidates(rows, F.col("s"), {"orders": ["订单", "合同", "中标", "定点"]}).collect()
    assert [(r.confidence, r.direction, r.evidence) for r in got] == [(0.6, "positive", "订单,合同,中标"), (0.4, "mixed", "合同")]
    assert research.keyword_candidates(rows, F.col("s"), {"orders": ["订单"]}, F.array(F.lit("capex"))).count() == 0


def test_health_skips_missing_parts(one):
    none = F.lit(None).cast("double")
    parts = {"coverage": F.lit(0.5), "authority": F.lit(0.5), "hk": none, "market": none, "cards": none, "quality": F.lit(1.0)}
    assert one(research.weighted_health(parts)) == round((0.5 * 0.55 + 0.1) / 0.65, 4)


@pytest.mark.parametrize(
    ("eligible", "expected", "covered", "negatives", "high", "hint"),
    [
        (False, 5, 5, 0, 0, "hk_not_connect_eligible_verify_before_inclusion"),
        (True, 10, 1, 5, 5, "keep_watch_or_reduce_budget_until_coverage_improves"),
        (True, 10, 5, 3, 5, "review_for_downgrade_or_risk_watch"),
        (True, 10, 5, 2, 3, "needs_followup_before_upgrade"),
        (True, 10, 5, 2, 2, "keep_current_layer"),
    ],
)
def test_layer_suggestion(one, eligible, expected, covered, negatives, high, hint):
    assert one(research.layer_suggestion(*[F.lit(x) for x in (eligible, expected, covered, negatives, high)])) == hint


def test_hk_snapshot_without_component_list(spark):
    holdings = frame(spark, [("00700.HK", dt.date(2026, 7, 1), 300.0, 5.0), ("00700.HK", dt.date(2026, 7, 3), 310.0, 6.0), ("00700.HK", dt.date(2026, 7, 9), 1.0, 1.0)],
                     "ticker string, holding_date date, close_price double, southbound_holding_shares double")
    row = research.hk_snapshots(None, holdings, "2026-07-05").first()
    assert (row.hk_connect_eligible, row.last_price_hkd, row.turnover_hkd, row.southbound_holding_shares) == (True, 310.0, None, 6.0)
    done = research.hk_completeness(research.hk_snapshots(None, holdings, "2026-07-05"), ["last_price_hkd", "turnover_hkd"]).first()
    assert (done.completeness, done.missing_fields) == (0.5, ["turnover_hkd"])


def test_triage(spark):
    hit = "title string, snippet string, domain string, rank int, query_family string, is_duplicate boolean"
    rows = frame(
        spark,
        [("宁德时代 中标 5亿元 订单", "", "www.cninfo.com.cn", 1, "orders", False), ("无关", "新闻", "example.com", 9, "x", False), ("宁德时代", "x", "a.com", 1, "source_pack:policy", True)],
        hit,
    )
    got = documents.triage(rows, F.array(F.lit("宁德时代"))).collect()
    # 35 entity + 20 amount + 24 strong + 12 order and tender + 20 exchange + 9 rank
    assert [(r.read_priority, r.triage_decision, r.need_model) for r in got] == [
        (120.0, "read", True), (1.0, "skip_for_now", False), (52.0, "link_record_only", False),
    ]


def test_templates(spark):
    targets = spark.sql("select 't' as target_id, map('company', array('A'), 'product', array('p1','p2','p3','p4'), 'customer', array('c1','c2','c3'), 'tender', cast(array() as array<string>)) as values")
    templates = [("f", 50.0, "{company} {product} {customer}"), ("g", 50.0, "{company} {tender}"), ("h", 50.0, "plain"), ("i", 50.0, "{unknown}")]
    got = [r.query_text for r in documents.expand_templates(targets, templates).collect()]
    assert got == ["A p1 c1", "A p1 c2", "A p1 c3", "A p2 c1", "A p2 c2", "A p2 c3", "plain"]


def test_passage_budget_truncates_the_last_passage(spark):
    body = "\n".join(["开头段落" * 10, "中标金额 5亿元 " + "x" * 50, "无", "风险" + "y" * 100])
    rows = documents.select_passages(frame(spark, [(body,)], "body string"), F.array(F.lit("宁德")), ["中标", "风险"], limit=8, budget=120)
    kept = rows.first().passages
    assert [(p.passage_id, p.score) for p in kept] == [("p0", 5.0), ("p1", 10.0), ("p3", 4.0)]
    assert sum(len(p.text) for p in kept) == 120


def test_chunks(spark):
    row = frame(spark, [(["a" * 5, "b" * 6, "c" * 20, "d", "e" * 9, "f" * 9],)], "p array<string>").select(documents.chunk_passages(F.col("p"), 10, 3).alias("c")).first()
    assert [c.chunk for c in row.c] == [1, 2, 3]


def test_evidence(spark):
    passages = frame(spark, [("l", "p1", "金额 300 万元")], "link_id string, passage_id string, text string")
    claims = frame(spark, [("l", "p1", "300", 0.8), ("l", "p1", "500", 0.8), ("l", "p9", "300", 0.8), ("l", "p9", "300", 0.2), ("l", "p1", "300.0", 0.9), ("m", "p9", "1", 0.8)],
                   "link_id string, passage_id string, claimed string, confidence double")
    got = sorted((r.link_id, r.claimed, r.passage_id or "", r.confidence) for r in extraction.check_evidence(claims, passages).collect())
    assert got == [("l", "300", "", 0.2), ("l", "300", "", 0.56), ("l", "300", "p1", 0.8), ("l", "300.0", "p1", 0.9), ("l", "500", "p1", 0.48), ("m", "1", "p9", 0.8)]


def test_inverse_relations_conflict(spark):
    rows = frame(spark, [("a", "b", "", "supplier_of"), ("a", "b", "", "customer_of"), ("a", "b", "x", "customer_of"), ("a", "c", "", "partner_of")],
                 "subject_key string, object_key string, product string, relation_type string")
    found = extraction.relation_conflicts(rows)
    assert [(r.subject_key, r.object_key, r.product) for r in found.collect()] == [("a", "b", "")]
    flags = {(r.relation_type, r.product): r.resolution_status for r in extraction.flag_conflicting_relations(rows, found).collect()}
    assert flags[("supplier_of", "")] == "needs_arbitration" and flags[("customer_of", "x")] is None


def test_entities(one):
    n = F.lit(None).cast("string")
    assert one(
        extraction.identity_key(F.lit(" 宁德时代 "), F.lit("300750")), extraction.identity_key(F.lit(" ABC "), n),
        extraction.is_vague(F.lit("多家供应商"), n), extraction.is_vague(F.lit("多家供应商"), F.lit("1")), extraction.is_vague(F.lit(""), n),
    ) == ("ticker:300750", "name:abc", True, False, True)


def test_family_discount_and_gate(spark, one):
    rows = frame(spark, [("l", "qwen_dashscope", 0.8), ("l", "siliconflow", 0.8), ("l", "solo", 0.01)], "link_id string, provider string, confidence double")
    for name in ("configured_weight", "task_weight", "schema_score", "evidence_score", "feedback_score"):
        rows = rows.withColumn(name, F.lit(1.0))
    weights = {r.provider: round(r.effective_weight, 6) for r in extraction.effective_weights(rows).collect()}
    assert weights == {"qwen_dashscope": 0.48, "siliconflow": 0.48, "solo": 0.05}
    assert one(extraction.decision_gate(F.lit("save_structured"), F.lit(69.0)), extraction.decision_gate(F.lit("save_structured"), F.lit(70.0))) == ("link_only", "save_structured")


def test_demand_rules(spark, one):
    assert one(*[demands.lifecycle(F.lit(s), F.lit(a)) for s, a in (("active", "suspend"), ("draft", "suspend"), ("draft", "cancel"), ("suspended", "resume"))]) == (
        "suspended", None, "cancelled", "active",
    )
    assert one(*[demands.liveness(F.lit(a)) for a in (None, 120, 121, 901)]) == ("no_heartbeat", "active", "recent", "stale")
    assert one(*[demands.batch_status(F.lit(f), F.lit(3)) for f in (0, 1, 3)]) == ("success", "partial_success", "failed")


def test_frequency_fallback(one):
    usable = F.array(F.lit("15m"))
    none = F.lit(None).cast("array<string>")
    assert one(
        demands.preferred_frequency(usable), demands.preferred_frequency(none), demands.preferred_frequency(none, ("5m",)),
        demands.recommended_mode(usable, F.lit(False)),
    ) == ("15m", None, "15m", "fallback_15m_feature")


def test_expected_work_after_close(spark):
    row = ("d", "daily_collection", "company_hk_00700", "00700.HK", "watchlist", None, "post_market", dt.datetime(2026, 6, 1, 15, 30, tzinfo=dt.UTC), True, False, True)
    schema = ("demand_id string, demand_type string, target_id string, ticker string, pool_layer string, sellability string, market_phase string,"
              " as_of timestamp, collect_text boolean, collect_stock boolean, collect_hk_connect boolean")  # fmt: skip
    got = {r.task_type: r.task_key for r in demands.expected_work(frame(spark, [row], schema)).collect()}
    assert set(got) == {"deep_collect", "hk_connect_daily_snapshot"}
    assert got["deep_collect"] == "collection_task:d:deep_collect:company_hk_00700:2026-06-01"


def test_priority_and_search(spark):
    rows = frame(spark, [("P2", 1), ("P0", 2), ("zz", 9), ("P0", 5)], "severity string, at int").withColumn("id", F.col("at"))
    got = readers.open_by_priority(rows, "severity", ["P0", "P1", "P2"], "at", "id", 3).collect()
    assert [(r.severity, r.at) for r in got] == [("P0", 5), ("P0", 2), ("P2", 1)]
    facts = frame(spark, [("中标 100万",), ("别的",)], "t string")
    assert readers.matching_text(facts, "t", "中标 订单").count() == 1 and readers.matching_text(facts, "t", "  ").count() == 0
