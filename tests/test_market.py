import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantfeed.functions import text as tx
from quantfeed.functions import timestamps as ts
from quantfeed.operators import catalog, feeds, reports, research, snapshots, themes
from quantfeed.operators.rolling import Rolling, ema
from quantfeed.sources import bars, payloads, tables
from quantfeed.streaming import digest

REF = dt.datetime(2026, 7, 27, 12, 0)
TIMES = {
    "2026-7-27 09:30:01": (dt.datetime(2026, 7, 27, 9, 30, 1), "exact"),
    "2026-07-27 09:30:01:817": (dt.datetime(2026, 7, 27, 9, 30, 1), "exact"),
    "发布时间：2026/07/27 09:30": (dt.datetime(2026, 7, 27, 9, 30), "exact"),
    "2026年07月27日": (dt.datetime(2026, 7, 27), "date"),
    "20260727": (dt.datetime(2026, 7, 27), "date"),
    "1785146400": (dt.datetime(2026, 7, 27, 10, 0), "exact"),
    "1785146400000": (dt.datetime(2026, 7, 27, 10, 0), "exact"),
    "46分钟前": (dt.datetime(2026, 7, 27, 11, 14), "derived"),
    "刚刚": (REF, "derived"),
    "07-27 11:30": (dt.datetime(2026, 7, 27, 11, 30), "exact"),
    "12-30 09:30": (dt.datetime(2025, 12, 30, 9, 30), "exact"),
    "13:30": (dt.datetime(2026, 7, 26, 13, 30), "exact"),
    "soon": (None, "missing"),
    "": (None, "missing"),
    None: (None, "missing"),
}


def test_times(spark):
    df = spark.createDataFrame([(t,) for t in TIMES], "t string")
    out = df.select("t", ts.parse(F.col("t"), F.lit(REF).cast("timestamp")).alias("p")).select("t", F.date_format("p.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "p.quality").collect()
    assert {r.t: (r.ts, r.quality) for r in out} == {k: (v[0] and f"{v[0]:%Y-%m-%d %H:%M:%S}", v[1]) for k, v in TIMES.items()}


def test_rolling_needs_whole_windows(spark):
    rows = [(1, i, x) for i, x in enumerate([1.0, 2.0, None, 4.0, 4.0, 4.0, 7.0])]
    df = spark.createDataFrame(rows, "code int, day int, x double")
    r, x = Rolling(), F.col("x")
    out = df.select("day", r.mean(x, 3).alias("mean"), r.rank(x, 3).alias("rank"), r.idx_max(x, 3).alias("top"), r.corr(x, F.col("day"), 3).alias("corr")).orderBy("day").collect()
    assert [o.mean for o in out] == [None] * 5 + [4.0, 5.0]
    assert out[5].rank == 1.0 and out[5].top == 1.0 and out[5].corr is None
    assert out[6].top == 3.0 and out[6].corr == pytest.approx(0.8660254)
    with pytest.raises(ValueError):
        r.ref(x, -1)
    e = {o.day: o.e for o in ema(df, "x", 3, "e").collect()}
    assert e[2] is None and e[3] == pytest.approx(2.75)


def test_severity_and_phrases(spark):
    df = spark.createDataFrame([("关于立案调查及停牌的公告",), ("年度报告",), ("建议立即买入，稳赚不赔",)], "t string")
    out = df.select(tx.classify(F.col("t")).alias("c"), tx.scan(F.col("t")).alias("s"), tx.rewrite(F.col("t")).alias("r"), tx.rewrite(tx.rewrite(F.col("t"))).alias("rr")).collect()
    assert [(o.c.category, o.c.severity) for o in out] == [("立案调查", 100), ("", 0), ("", 0)]
    assert [(h.category, h.matched) for h in out[2].s] == [("投资建议", "建议立即买入"), ("收益承诺", "稳赚不赔")]
    assert all(o.r == o.rr for o in out)


def test_klines_and_rss(spark):
    lines = ["2026-07-24,10,11,12,9,100,-,1,2.5,0.2,", "bad,10,11,12,9,100,5", "2026-07-24,10,11", "2026-07-25,x,11,12,9,100,5"]
    out = bars.parse_kline(spark.createDataFrame([(x,) for x in lines], "line string")).collect()
    assert [(o.open, o.close, o.amount, o.change, o.turnover, o.vwap) for o in out] == [(10.0, 11.0, 0.0, 2.5, 0.0, 11.0)]
    xml = "<rss><item><title><![CDATA[A & b]]></title><link>u</link><pubDate>d</pubDate></item><item><title>c</title></item></rss>"
    out = payloads.parse_rss(spark.createDataFrame([(xml,)], "xml string")).collect()
    assert [(o.ord, o.title, o.url, o.raw_time) for o in out] == [(0, "A & b", "u", "d"), (1, "c", "", "")]


def test_theme_words(spark):
    df = spark.createDataFrame([("新能源汽车 分析，AI",), ("",), (None,)], "t string")
    out = df.select(themes.theme_words(F.col("t")).alias("w"), themes.hinted_indices(F.col("t")).alias("i")).collect()
    assert out[0].w == ["新能源汽车", "新能源汽", "能源汽车", "新能源", "能源汽", "源汽车", "新能", "能源", "源汽", "汽车", "AI"]
    assert [o.w for o in out[1:]] == [[], []] and out[1].i == ["0.399006", "1.000001"]


def test_bond_alerts(spark):
    today, at = dt.date(2026, 7, 27), dt.datetime(2026, 7, 27, 10)
    rows = [(1, at, today, 9.0), (2, at, None, -8.0), (3, None, None, 7.0), (4, at, None, 6.0), (5, at, None, 1.0), (6, at, None, None), (7, None, None, None)]
    df = spark.createDataFrame([(0, *r, 100.0, 100.0 + r[0], "00") for r in rows], "s int, bond_id int, quoted_at timestamp, redeem_day date, change double, price double, dblow double, status string")
    out = snapshots.bond_alerts(df, "s", F.lit(today), movers=2, cheapest=3).orderBy("bond_id").collect()
    assert [(r.bond_id, r.kind) for r in out] == [(1, "redeem"), (2, "mover"), (4, "low"), (5, "low")]
    assert snapshots.bond_alerts(df.limit(0), "s", F.lit(today)).count() == 0


def test_report_lines_and_texts(spark):
    text = "# a\nx\n```\n# 目录\ncode\n```\ny\n## 目录\ngone\n### still gone\n# b\n> note\nlast"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    out = reports.report_lines(df, section_titles=("目录",), line_starts=("> ",)).orderBy("doc_id", "pos").collect()
    assert [r.line for r in out if r.doc_id == 1] == ["# a", "x", "y", "# b", "last"]
    df = spark.createDataFrame([("【a】 b", "异动快报：c", "x+y++z+w")], "a string, b string, c string")
    r = df.select(tx.open_bracket(F.col("a")).alias("a"), tx.without_alert_prefix(F.col("b")).alias("b"), tx.reason_tags(F.col("c")).alias("c"), tx.joined(" · ", F.col("a"), F.lit(None), F.lit(" ")).alias("d")).first()
    assert tuple(r) == ("a｜b", "c", ["x", "y", "z"], "【a】 b")


def test_factor_metadata(spark):
    df = spark.createDataFrame([("KUP2",), ("ROC20",), ("VSUMD5",), ("VWAP0",), ("X",)], "f string")
    out = df.select(catalog.factor_group(F.col("f")).alias("g"), catalog.described(F.col("f"), {"KUP": "上影线", "ROC": "N 日前"}).alias("d")).collect()
    assert [o.g for o in out] == ["K线形态", "趋势动量", "量能结构", "价格基准", "其他"]
    assert [o.d for o in out] == ["上影线", "20 日前", "", "", ""]
    assert catalog.core_factors(["A", "KMID"]) == ["KMID"] and catalog.core_factors(["A", "B"]) == ["A", "B"]


def test_ledger_and_days(spark, tmp_path):
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.json").write_text('{"key":"a","first_seen":"2026-07-26T10:00:00"}\n{"key":"b","first_seen":"soon"}\n{broken\n{"key":"c","first_seen":"2026-07-01T10:00:00"}\n')
    kept = tables.read_ledger(spark, str(tmp_path / "l"), F.lit(REF).cast("timestamp"))
    assert [r.key for r in kept.collect()] == ["a"]
    days = str(tmp_path / "days")
    tables.write_days(spark.createDataFrame([(1, "x"), (2, "y")], "v int, day string"), days)
    tables.write_days(spark.createDataFrame([(3, "y")], "v int, day string"), days)
    assert sorted(r.v for r in spark.read.parquet(days).collect()) == [1, 3]


def test_delivery_is_repeated_until_it_works(spark, tmp_path):
    spark.createDataFrame([("k1",), ("k2",)], "key string").write.parquet(str(tmp_path / "in"))
    said = []

    def publish(batch, batch_id):
        said.append(sorted(r.key for r in batch.collect()))
        if len(said) == 1:
            raise ValueError("no network")

    items = lambda: spark.readStream.schema("key string").parquet(str(tmp_path / "in"))
    run = lambda: digest.deliver(items(), publish, str(tmp_path / "ledger"), str(tmp_path / "check")).awaitTermination()
    with pytest.raises(Exception, match="no network"):
        run()
    run()
    assert said == [["k1", "k2"], ["k1", "k2"]]
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "ledger")).collect()) == ["k1", "k2"]


def test_price_factors(spark):
    rows = [(1, i, 100.0 + (i % 5), 10.0 + i, 1e8) for i in range(30)]
    out = research.price_factors(spark.createDataFrame(rows, "code int, day int, close double, volume double, amount double"), turnover="volume").orderBy("day").collect()
    rets = [rows[i][2] / rows[i - 1][2] - 1 for i in range(10, 30)]
    assert out[19].amihud is None and out[29].amihud == pytest.approx(sum(map(abs, rets)) / 20)
    assert out[29].downside_vol == pytest.approx((sum(r * r for r in rets if r < 0) / 20) ** 0.5) and out[29].momentum_12m_1m is None


def test_screening_states(spark):
    ref = dt.datetime(2026, 7, 27, 12, 0)
    rows = [
        (1, "关于收到问询函的公告", dt.datetime(2026, 7, 27, 9, 0), "600001", "甲股", "A1"),
        (2, "甲股立案调查", dt.datetime(2026, 7, 26, 9, 0), "600001", "甲股", "A1"),
        (3, "分红公告", dt.datetime(2026, 7, 26, 9, 0), "600001", "甲股", "A2"),
        (4, "警示函", dt.datetime(2026, 6, 1), "600002", "乙股", "A3"),
        (5, "警示函", None, "600002", "乙股", "A4"),
        (6, "警示函", dt.datetime(2026, 7, 28), "600002", "乙股", "A5"),
        (7, "停牌", dt.datetime(2026, 7, 20), None, None, "A6"),
        (8, "核查", dt.datetime(2026, 7, 20), None, None, None),
        (9, " ", dt.datetime(2026, 7, 20), "600003", "丙股", "A7"),
        (10, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "ord int, title string, published_at timestamp, code string, stock string, art_code string")
    out = reports.screened(df, F.lit(ref).cast("timestamp"))
    got = {r.ord: (r.state, r.title) for r in out.collect()}
    assert got[1] == ("kept", "甲股 关于收到问询函的公告") and got[2][0] == "repeat" and got[7] == ("kept", "停牌") and got[8][0] == "kept"
    assert [got[i][0] for i in (3, 4, 5, 6, 9, 10)] == ["other", "stale", "no_time", "no_time", "blank", "blank"]
    counts = reports.screening_counters(out).first()
    assert (counts.scanned, counts.dropped_no_time, counts.dropped_stale, counts.events) == (10, 2, 1, 3)
    codes = spark.createDataFrame([("600001",)], "code string")
    assert [r.ord for r in reports.screened(df, F.lit(ref).cast("timestamp"), words=("停",), codes=codes).filter("state = 'kept'").orderBy("ord").collect()] == [1, 7]
    focus = reports.linked(out.filter("state = 'kept'"), codes, ("停牌", "核"))
    assert {r.ord: r.focus for r in focus.collect()} == {1: True, 7: True, 8: False}
    assert [r.ord for r in reports.background(focus, focus.filter("focus")).collect()] == [8]


def test_review_counts_on_what_earlier_rules_left(spark):
    rules = (("a+", "one", "b"), ("b", "two", "c"), ("ac", "three", "d"))
    df = spark.createDataFrame([(1, "aa b ac"), (2, "zz"), (3, None)], "i int, text string")
    out = {r.i: ([(h.category, h.matched) for h in r.hits], r.rewritten) for r in reports.reviewed(df, rules=rules).collect()}
    assert out == {1: ([("one", "aa"), ("one", "a"), ("two", "b"), ("two", "b"), ("two", "b")], "c c cc"), 2: ([], "zz"), 3: ([], None)}


def test_counters_count_all_that_was_fetched(spark):
    ref = dt.datetime(2026, 7, 27, 12, 0)
    rows = [("s", i, f"k{i}", f"t{i}", dt.datetime(2026, 7, 27, 11, 0) if i != 1 else None, "exact") for i in range(6)]
    items = spark.createDataFrame(rows, "source string, ord int, key string, title string, published_at timestamp, time_quality string")
    out = feeds.judged(items, items.limit(0), F.lit(ref).cast("timestamp"), 180, limit=3)
    assert {r.ord: r.reason for r in out.collect()} == {0: None, 1: "no_time", 2: None, 3: None, 4: "unread", 5: "unread"}
    assert [(r.fetched, r.kept, r.dropped_no_time) for r in feeds.counters(out).collect()] == [(6, 3, 1)]


def test_newest_factors_equal_the_panels_last_day(spark):
    rows = [(c, i, 10.0 + (i * 7 % 11), 10.0 + (i * 5 % 13), 25.0 + i % 5, 5.0 + i % 4, 100.0 + i * 3 % 17, 11.0) for c in (1, 2) for i in range(80 if c == 1 else 69)]
    bars_ = spark.createDataFrame(rows, "code int, day int, open double, close double, high double, low double, volume double, vwap double")
    names = [*catalog.CANDLE, *catalog.PRICE, *(f"{f}{d}" for d in (5, 60) for f in catalog.FAMILIES)]
    whole = catalog.factors(bars_, names, windows=(5, 60)).filter("code = 1 and day = 79").first()
    newest = catalog.latest_factors(bars_, names, windows=(5, 60)).collect()
    assert len(newest) == 1  # the other code has fewer bars than factors need
    for n in names:
        assert newest[0][n] == pytest.approx(whole[n], rel=1e-9, abs=1e-12), n


def test_as_of_equals_plain_search(spark):
    start = dt.datetime(2026, 1, 1)
    hours = lambda n: start + dt.timedelta(hours=n)
    facts = [(i % 3 if i % 11 else None, hours(i * 37 % 1500) if i % 13 else None, i, float(i)) for i in range(200)] + [(0, hours(0), 900, 9.0), (0, hours(0), 901, None)]
    asked = [(j, j % 4 if j % 17 else None, hours(j * 29 % 1700 - 20) if j % 19 else None) for j in range(300)] + [(1000, 0, hours(0)), (1000, 0, hours(0))]
    right = spark.createDataFrame(facts, "key int, known timestamp, ord int, value double")
    left = spark.createDataFrame(asked, "j int, key int, at timestamp")
    expected = []
    for j, key, at in asked:
        past = [(known, o, v) for k, known, o, v in facts if None not in (key, at, known) and k == key and known <= at]
        expected.append((j, max(past)[2] if past else None))
    order = lambda rows: sorted(rows, key=str)
    for block in ("day", "week", "year"):
        out = research.as_of(left, right, "key", "at", "known", ("value",), ("ord",), block=block)
        assert out.columns == ["j", "key", "at", "value"]
        assert order((r.j, r.value) for r in out.collect()) == order(expected), block
    assert research.as_of(left, right.limit(0), "key", "at", "known", ("value",), ("ord",)).filter("value is not null").isEmpty()
