"""Scalar functions against hand-checked values."""

import datetime as dt
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marketloom.functions import keys, market, numbers, text, tickers, times, units, urls


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("600519", "600519.SH"),
        ("sh600519", "600519.SH"),
        ("sh.600519", "600519.SH"),
        ("000001.XSHE", "000001.SZ"),
        ("000001_sz", "000001.SZ"),
        ("430047-BSE", "430047.BJ"),
        ("hk00700", "00700.HK"),
        ("00700.HKEX", "00700.HK"),
        ("600519.SZ", None),
        ("999999", None),
        ("700.HK", None),
        ("600519.XX", None),
        ("", None),
        (None, None),
    ],
)
def test_ticker_normalisation(spark, raw, expected):
    row = spark.createDataFrame([(raw,)], "t string").select(tickers.normalize(F.col("t")).alias("n")).first()
    assert row.n == expected


def test_provider_symbols(one):
    t = F.lit("600519.SH")
    assert one(*[tickers.provider_symbol(t, d) for d in ("tushare", "baostock", "akshare", "joinquant")]) == (
        "600519.SH", "sh.600519", "sh600519", "600519.XSHG",
    )
    hk = F.lit("00700.HK")
    assert one(*[tickers.provider_symbol(hk, d) for d in ("baostock", "akshare", "joinquant")]) == (None, "hk00700", None)


def test_target_ids(one):
    none = F.lit(None).cast("string")
    name_hash = hashlib.sha256('"天目湖"'.encode()).hexdigest()[:8]
    assert one(
        tickers.target_id(none, F.lit("700.HK").cast("string"), F.lit("x")),
        tickers.target_id(none, F.lit("0700.HK"), F.lit("x")),
        tickers.target_id(none, F.lit("600519.SH"), F.lit("x")),
        tickers.target_id(none, none, F.lit("天目湖")),
        tickers.target_id(none, none, F.lit("天目湖"), "industry"),
        tickers.target_id(F.lit("given"), none, F.lit("x")),
    ) == ("company_700", "company_hk_00700", "company_600519", f"company_{name_hash}", f"industry_{name_hash}", "given")


def test_dates_and_instants(one):
    day = dt.date(2026, 5, 29)
    assert one(*[times.trade_date(F.lit(x)) for x in ("20260529", "2026-05-29", "2026-05-29T10:00:00", "2026/05/29")]) == (day, day, day, None)
    assert one(times.flexible_date(F.lit("2026年5月29日")), times.flexible_date(F.lit("2026/05/29")), times.flexible_date(F.lit("2026年05月29日"))) == (
        None, day, day,
    )
    shown = [F.date_format(times.instant(F.lit(x)), "yyyy-MM-dd HH:mm") for x in ("20260529", "2026-05-29 09:30:00", "2026-05-29T01:30:00Z")]
    assert one(*shown) == ("2026-05-28 16:00", "2026-05-29 01:30", "2026-05-29 01:30")


def test_windows_and_quarters(one):
    assert one(*[times.window_days(F.lit(x)) for x in ("30d", "12w", "6m", "1y", "x")]) == (30, 84, 180, 365, None)
    assert one(*[times.window_minutes(F.lit(x)) for x in ("10m", "4h", "1d", "15", "x")]) == (10, 240, 1440, 15, None)
    assert one(times.quarters_between(F.lit("2025-11-02").cast("date"), F.lit("2026-05-01").cast("date"))) == ["2025Q4", "2026Q1", "2026Q2"]
    assert one(times.last_quarters(F.lit("2026-05-01").cast("date"), 3)) == ["2025Q4", "2026Q1", "2026Q2"]


def test_market_phases(one):
    def phase(clock):
        return times.market_phase(F.lit(f"2026-06-01 {clock}").cast("timestamp"), F.lit(True))

    assert one(*[phase(c) for c in ("08:00:00", "09:26:00", "10:00:00", "12:00:00", "14:59:59", "15:00:00", "21:00:00")]) == (
        "pre_market", "off_hours", "intraday", "lunch_break", "intraday", "post_market", "off_hours",
    )
    days = [F.lit(d).cast("date") for d in ("2026-06-06", "2026-06-05", "2026-06-07")]
    assert one(*[times.is_trading_day(d, ["2026-06-05"], ["2026-06-07"]) for d in days]) == (False, False, True)


def test_units(one):
    n = F.lit(None).cast("string")
    assert one(
        units.volume_shares(F.lit("1,200"), F.lit("手"), F.lit("x")),
        units.volume_shares(F.lit("12"), n, F.lit("tushare")),
        units.volume_shares(F.lit("12"), n, F.lit("baostock")),
        units.volume_shares(F.lit("12"), F.lit("barrel"), F.lit("x")),
        units.amount_base(F.lit("12"), n, F.lit("tushare")),
        units.amount_base(F.lit("12"), F.lit("万元"), F.lit("x")),
    ) == (120000.0, 1200.0, 12.0, None, 12000.0, 120000.0)
    assert one(*[units.currency(F.lit(c)) for c in ("rmb", "港币", "usd", "")]) == ("CNY", "HKD", "USD", "CNY")
    assert one(units.ah_premium_pct(F.lit(10.0), F.lit(9.0), F.lit(1.08))) == 20.0


def test_chinese_numbers(one):
    texts = ["1.5亿", "3,000万", "12.5%", "--", "约20家", "2千", "abc"]
    assert one(*[numbers.chinese_number(F.lit(t)) for t in texts]) == (1.5e8, 3e7, 12.5, None, 20.0, 2000.0, None)


def test_limits_and_score(one):
    f = F.lit(False)
    pcts = [market.limit_pct(F.lit(t), f) for t in ("300001.SZ", "688001.SH", "430047.BJ", "600519.SH")]
    assert one(*pcts, market.limit_pct(F.lit("600519.SH"), F.lit(True))) == (0.2, 0.2, 0.3, 0.1, 0.05)
    assert one(market.limit_price(F.lit(100.0), F.lit(0.2), True), market.limit_price(F.lit(100.0), F.lit(0.2), False)) == (120.0, 80.0)
    none = F.lit(None).cast("double")
    assert one(market.abnormality(F.lit(0.01), F.lit(5.0), none, none, none, f)) == 0.425
    assert one(market.abnormality(F.lit(0.0), F.lit(0.0), F.lit(3.25), none, none, f)) == 0.8125
    assert one(market.abnormality(F.lit(0.0), F.lit(0.0), none, none, F.lit(0.0), F.lit(True))) == 1.0


def test_urls(one):
    assert one(
        urls.canonical(F.lit(" HTTPS://WWW.Example.com/a/b/?b=2&utm_source=x&a=1&c=#frag ")),
        urls.canonical(F.lit("http://example.com")),
        urls.canonical(F.lit("http://example.com/p?q=a%20b&Ref=1")),
        urls.domain(F.lit("https://www.news.sse.com.cn/x")),
    ) == ("https://www.example.com/a/b?a=1&b=2", "http://example.com/", "http://example.com/p?q=a+b", "news.sse.com.cn")
    hosts = ["news.sse.com.cn", "stats.gov.cn", "example.com", "notgov.cn", ""]
    # The broader gov.cn entry comes before stats.gov.cn; both say regulator.
    assert one(*[urls.source_type(F.lit(h)) for h in hosts]) == ("exchange", "regulator", "media", "media", "unknown")


def test_compare_form(one):
    assert one(*[text.compare_form(F.lit(t)) for t in ("贵州茅台 股份有限公司", "ＡＢＣ Ltd.", "暂停上市", None)]) == ("贵州茅台", "abc", "停牌", "")


def brute_simhash(value: str) -> str:
    value = " ".join(value.split())
    if not value:
        return "0" * 16
    votes = [0] * 64
    for i in range(max(len(value) - 2, 1)):
        h = int(hashlib.md5(value[i : i + 3].encode()).hexdigest(), 16)
        for b in range(64):
            votes[b] += 1 if h >> b & 1 else -1
    return f"{sum(1 << b for b in range(64) if votes[b] > 0):016x}"


def test_simhash_and_hamming(spark):
    texts = ["", "ab", "hello  world", "公司公告：中标 3 亿元", "x" * 5000, "the quick brown fox " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("s", text.simhash64(F.col("t")))
    rows = df.select("t", text.signature_hex(F.col("s")).alias("h"), text.hamming(F.col("s"), F.lit(0).cast("long")).alias("d")).collect()
    for row in rows:
        assert row.h == brute_simhash(row.t)
        assert row.d == bin(int(row.h, 16)).count("1")


PAGE = """<html><head><title> A  title </title><meta property="article:published_time" content="2026-01-02">
<style>p{}</style><script>var x = "<p>hidden paragraph text</p>";</script></head><body><nav><p>navigation block text</p></nav>
<h1>Heading of the page</h1><p>First paragraph with <b>bold</b> text.<p>Second, unclosed paragraph.
<ul><li>short</li><li>A list item long enough</li></ul>
<table><tr><th>Metric</th><th>Value</th></tr><tr><td>Revenue</td><td>3亿元</td></tr></table>
<img src="/img/logo.png"><img src="/img/a.jpg" width="50"><img src="/img/b.jpg" width="640px"><img data-src="/img/c.jpg"><img src="/img/c.jpg">
<footer><p>footer block of text</p></footer></body></html>"""


def test_page_extraction(spark):
    row = spark.createDataFrame([(PAGE,), ("plain 2025-03-04 text",)], "h string").select(text.extract_page(F.col("h")).alias("p")).collect()
    page = row[0].p
    assert page.title == "A title" and page.publish_time == "2026-01-02"
    assert page.body.split("\n") == [
        "Heading of the page", "First paragraph with bold text.", "Second, unclosed paragraph.", "A list item long enough",
    ]
    assert page.tables == ["Metric | Value\nRevenue | 3亿元"]
    assert page.images == ["/img/b.jpg", "/img/c.jpg"]
    assert row[1].p.body == "plain 2025-03-04 text" and row[1].p.publish_time == "2025-03-04"


def test_anti_bot_and_json(one):
    assert one(text.is_anti_bot(F.lit("x"), F.lit("please solve the captcha")), text.is_anti_bot(F.lit("x"), F.lit("captcha " * 100))) == (True, False)
    found = one(*[text.recovered_json(F.lit(t)) for t in ('```json\n{"a": 1}\n```', 'Sure: {"a": {"b": 2}} ok', "nothing", '{"a": ')])
    assert [json.loads(x) if x else None for x in found] == [{"a": 1}, {"a": {"b": 2}}, None, None]


def test_request_key(one):
    none = F.lit(None).cast("string")
    empty = F.lit(None).cast("array<string>")
    key = keys.request_key(
        F.lit("m"), F.lit("trade_calendar"), F.lit("p"), empty, none, F.array(F.lit("SZSE"), F.lit("SSE")),
        F.lit("2026-01-01").cast("date"), none, none, F.lit("qfq"), empty, F.array(F.lit("b"), F.lit("a")),
    )
    assert one(key) == "m:trade_calendar:p:SSE,SZSE:20260101:none:none:qfq:none:a,b:v0.1"


def test_canonical_tickers_are_told_without_respelling_them(spark):
    from pyspark.sql import functions as F

    raws = ["600000.SH", "600000.SH\n", "600000.SH\r\n", " 600000.sh ", "SH600000", "600000_XSHG", "600000-SSE", "600000", "430001.BJ", "00700.HK", "00700.HKEX",
            "600000.SZ", "600000.SHX", "x600000.SH", "600000.SH\n600000.SH", "", None]
    wanted = ["600000.SH", "600000.SH", "600000.SH", "600000.SH", "600000.SH", "600000.SH", "600000.SH", "600000.SH", "430001.BJ", "00700.HK", "00700.HK",
              None, None, None, None, None, None]
    rows = spark.createDataFrame(list(enumerate(raws)), "i int, t string").select("i", tickers.normalize(F.col("t")).alias("n"))
    assert [r.n for r in rows.orderBy("i").collect()] == wanted
