"""Bars, features and provider rules against hand-checked values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marketloom.operators import bars, features, normalize, providers

BAR = "ticker string, effective_provider string, trade_date date, open double, close double, data_quality double, validation_status string, frequency string, adjust string"
FACTOR = "ticker string, effective_provider string, trade_date date, adj_factor double, fore_adjust_factor double, back_adjust_factor double, factor_method string"


def day(n):
    return dt.date(2026, 5, n)


def bar(provider, n, close, quality=0.9, status="validated", adjust="none"):
    return ("600519.SH", provider, day(n), close, close, quality, status, "1d", adjust)


def adjusted(spark, bar_rows, factor_rows, adjust="qfq"):
    out = bars.adjust_prices(spark.createDataFrame(bar_rows, BAR), spark.createDataFrame(factor_rows, FACTOR), adjust, ("2026-05-01", "2026-05-31"))
    return sorted(out.collect(), key=lambda r: (r.effective_provider, r.trade_date))


def test_direct_forward_factor(spark):
    row = adjusted(spark, [bar("baostock", 29, 10.0)], [("600519.SH", "baostock", day(1), None, 0.75, None, "baostock_x")])[0]
    assert (row.close, row.raw_close, row.applied_adjust_factor, row.adjust) == (7.5, 10.0, 0.75, "qfq")


def test_cumulative_factor_is_normalised_to_the_last_in_range(spark):
    factors = [("600519.SH", "tushare", day(1), 2.0, None, None, None), ("600519.SH", "tushare", day(20), 4.0, None, None, None)]
    rows = adjusted(spark, [bar("tushare", 10, 10.0), bar("tushare", 25, 10.0)], factors)
    assert [r.close for r in rows] == [5.0, 10.0]
    assert [r.close for r in adjusted(spark, [bar("tushare", 10, 10.0)], factors, "hfq")] == [20.0]


def test_forward_match_only_when_the_whole_group_lacks_a_factor(spark):
    factors = [("600519.SH", "tushare", day(20), 4.0, None, None, None)]
    alone = adjusted(spark, [bar("tushare", 5, 10.0)], factors, "hfq")
    mixed = adjusted(spark, [bar("tushare", 5, 10.0), bar("tushare", 21, 10.0)], factors, "hfq")
    assert [r.applied_adjust_factor for r in alone] == [4.0]
    assert [r.applied_adjust_factor for r in mixed] == [1.0, 4.0]


def test_foreign_factors_serve_a_provider_without_its_own(spark):
    factors = [("600519.SH", "tushare", day(1), 3.0, None, None, None), ("600519.SH", "baostock", day(1), 5.0, None, None, None)]
    rows = adjusted(spark, [bar("akshare", 5, 1.0), bar("baostock", 5, 1.0)], factors, "hfq")
    assert {r.effective_provider: r.applied_adjust_factor for r in rows} == {"akshare": 3.0, "baostock": 5.0}


def test_ticker_without_factors_stays_raw(spark):
    row = adjusted(spark, [bar("tushare", 5, 10.0)], [("000001.SZ", "tushare", day(1), 3.0, None, None, None)])[0]
    assert row.close == 10.0 and row.adjustment_source == "no_adj_factor_available_raw_prices_returned"


def test_stored_adjusted_rows_win(spark):
    table = spark.createDataFrame([bar("tushare", 5, 10.0), bar("tushare", 5, 9.0, adjust="qfq")], BAR)
    factors = spark.createDataFrame([("600519.SH", "tushare", day(1), 3.0, None, None, None)], FACTOR)
    rows = bars.adjusted_bars(table, factors, "2026-05-01", "2026-05-31", "qfq").collect()
    assert [(r.close, r.adjustment_source) for r in rows] == [(9.0, None)]


def test_quarantined_rows_are_not_trading_ready(spark):
    table = spark.createDataFrame([bar("tushare", 5, 1.0, 0.95), bar("tushare", 6, 1.0, 0.99, "quarantined"), bar("tushare", 7, 1.0, 0.7)], BAR)
    assert bars.trading_ready(table).count() == 1


BUCKET = "ticker string, trade_date date, bucket_clock string, open double, high double, low double, close double, volume double, amount double, return_window double"


def feature(spark, close, prev=100.0, history=(1000.0, 2000.0, 3000.0), amount=6500.0):
    days = [(("300750.SZ", day(10 + i), "10:00", 100.0, 100.0, 100.0, 100.0, 1.0, a, 0.0)) for i, a in enumerate(history)]
    buckets = spark.createDataFrame([*days, ("300750.SZ", day(20), "10:00", 100.0, 101.0, 79.0, close, 1.0, amount, close / 100 - 1)], BUCKET)
    daily = spark.createDataFrame([("300750.SZ", day(19), prev), ("300750.SZ", day(20), close)], "ticker string, trade_date date, close double")
    status = spark.createDataFrame([("300750.SZ", False, False)], "ticker string, is_st boolean, is_suspended boolean")
    return features.build(buckets, daily, status).where(F.col("trade_date") == F.lit(day(20))).first()


def test_bucket_enrichment(spark):
    row = feature(spark, 101.0)
    assert (row.amount_ratio, row.limit_up, row.limit_down, row.emit, row.risk_review) == (3.25, 120.0, 80.0, True, False)
    assert "amount_ratio>=3.0" in row.reasons


def test_limit_down_triggers_risk_review(spark):
    row = feature(spark, 80.0)
    assert row.hit_down and row.risk_review and row.abnormality_score == 1.0


def test_ratio_needs_three_days(spark):
    assert feature(spark, 101.0, history=(1000.0, 2000.0)).amount_ratio is None
    assert feature(spark, 101.0, history=(1000.0, 2000.0, 0.0)).amount_ratio is None


RECORD = "comparison_key string, provider string, record_id string, source_api string, close double, is_suspended boolean, name string, amount double, vwap double"


def record(provider, close=10.0, halted=False, name="贵州茅台", amount=100.0, api="daily", vwap=None, key="k"):
    return (key, provider, f"{provider}-{key}", api, close, halted, name, amount, vwap)


def merged(spark, *rows, **options):
    met = providers.meet(spark.createDataFrame(list(rows), RECORD), "tushare", ["close", "is_suspended", "name", "amount", "vwap"], ["vwap"])
    return providers.merge(met, **options).first()


@pytest.mark.parametrize(
    ("rows", "method", "status", "suspect"),
    [
        ([record("tushare"), record("akshare", 10.0005)], "canonical_validated", "validated", False),
        ([record("tushare")], "canonical_only", "validated_with_warning", False),
        ([record("tushare"), record("akshare", 12.0)], "quarantined_due_to_conflict", "quarantined", False),
        ([record("tushare"), record("akshare", 11.0), record("baostock", 11.0)], "quarantined_due_to_conflict", "quarantined", True),
        ([record("tushare"), record("akshare", name="其他公司")], "canonical_with_warning", "conflicted_low", False),
        ([record("akshare")], "fallback_single_source", "validated_with_warning", False),
        ([record("akshare"), record("baostock")], "fallback_multi_source_agreed", "validated", False),
        ([record("akshare"), record("baostock", 11.0)], "manual_review_required", "manual_review_required", False),
        ([record("tushare"), record("akshare", vwap=3.0)], "fill_missing_from_supplement", "validated_with_warning", False),
        ([record("tushare"), record("akshare", name="贵州茅台股份有限公司")], "canonical_validated", "validated", False),
        ([record("tushare"), record("akshare", amount=999.0, api="stock_zh_a_hist_tx")], "canonical_validated", "validated", False),
        ([record("tushare", None), record("akshare")], "canonical_validated", "validated", False),
    ],
)
def test_merge_policy(spark, rows, method, status, suspect):
    row = merged(spark, *rows)
    assert (row.merge_method, row.validation_status, row.canonical_value_suspect) == (method, status, suspect)


def test_canonical_value_is_never_replaced(spark):
    assert merged(spark, record("tushare", 10.0), record("akshare", 11.0), record("baostock", 11.0)).close == 10.0


def test_filled_field_names_its_provider(spark):
    row = merged(spark, record("tushare"), record("baostock", vwap=4.0), record("akshare", vwap=4.0))
    assert row.vwap == 4.0 and [(f.field, f.provider) for f in row.supplement_flags] == [("vwap", "akshare")]


def test_status_conflict_is_critical(spark):
    met = providers.meet(spark.createDataFrame([record("tushare"), record("akshare", halted=True)], RECORD), "tushare", ["is_suspended"])
    assert [r.severity for r in providers.conflicts(met).collect()] == ["critical"]


def test_repeated_rows_of_a_provider_meet_once(spark):
    rows = [record("tushare")] + [record("akshare", 10.0 + i) for i in range(30)]
    met = providers.meet(spark.createDataFrame(rows, RECORD), "tushare", ["close"])
    assert met.first().supplements == ["akshare"]


def test_quality_adjustments(one):
    score = providers.quality_score(
        F.lit("tushare"), F.lit(6), 6, F.lit(4), F.lit(-0.5), F.lit("canonical_with_warning"), F.lit(False), F.lit(True)
    )
    # .25 + .03 + .15 + .09 + .05 + 0 = .57, minus .5 and .2, not below zero
    assert one(score) == 0.0
    clean = providers.quality_score(
        F.lit("tushare"), F.lit(6), 6, F.lit(None).cast("int"), F.lit(None).cast("double"), F.lit("canonical_validated"), F.lit(True), F.lit(True)
    )
    assert one(clean) == 1.0


def test_lineage_is_complete(spark):
    raw = spark.sql("select 'tushare' as provider, 'daily' as source_api, map('ts_code', '600519.SH', 'trade_date', '20260529', 'close', '10', 'vol', '100') as raw,"
                    " 'p' as raw_payload_id, 'raw://p' as raw_payload_ref, 0L as raw_row_index")  # fmt: skip
    business = ["close", "volume", "pre_close"]
    row = normalize.with_lineage(normalize.standardise(raw, "bar"), business, "bar")
    out = row.withColumn("missing", normalize.unproven_fields(business, F.col("field_provenance"))).first()
    assert out.volume == 10000.0 and set(out.field_provenance) == {"close", "volume"} and out.missing == []


@pytest.mark.parametrize("kind", sorted(normalize.RECORD_FIELDS))
def test_every_record_type_has_a_plan(spark, kind):
    raw = spark.sql("select 'tushare' as provider, 'x' as source_api, map('ts_code', '600519.SH') as raw, 'p' as raw_payload_id, 'r' as raw_payload_ref, 0L as raw_row_index")
    assert normalize.standardise(raw, kind).count() == 1


def test_record_types_respell_no_ticker_in_a_filter_and_show_types_without_records(spark, tmp_path):
    from marketloom.plans import Views, providers as plans

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.where("false").write.parquet(str(tmp_path / "events.parquet"))
    empty = plans.canonical_record_types(Views(spark, str(tmp_path)))
    # One cleaned raw row per type; a filter pushed below it would clean it again for every alias.
    assert empty._jdf.queryExecution().optimizedPlan().toString().count("map_filter(") == len(plans._SHOWN)
    assert sorted(map(tuple, empty.collect())) == sorted((kind, 0, None, 0) for kind in plans._SHOWN)
