"""Registered queries on feeds, payloads, announcements and streams, made of the given tables' columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantfeed.functions import text as tx
from quantfeed.functions import timestamps as ts
from quantfeed.operators import boards as bd
from quantfeed.operators import catalog, feeds, reports, research, scoring, snapshots
from quantfeed.operators import rolling as rl
from quantfeed.plans import queries as base
from quantfeed.plans.queries import _ITEMS, _PROFILE, _panel_sql, bars, profiles, query, rounded, table
from quantfeed.sources import bars as br
from quantfeed.sources import payloads, tables
from quantfeed.sources.tables import work_folder
from quantfeed.streaming import digest


def _quoted(*values: str) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ---------------------------------------------------------------- announcements

_RULE_WORDS = tuple(w for w, _, _ in tx.SEVERITY_RULES)
_HEADS = ("关于公司", "年度报告", "重大合同中标", *(f"收到{w}的公告" for w in _RULE_WORDS))
_TAILS = ("", "及回购进展", *(f"暨{w}" for w in _RULE_WORDS[::5]))
#: Announcements made of orders: title, times in several shapes, code and stock of some, an article number.
_NOTICES = f"""notices AS (SELECT o_orderkey AS ord,
  CASE WHEN o_orderkey % 41 = 0 THEN '  ' ELSE ([{_quoted(*_HEADS)}])[o_orderkey % {len(_HEADS)} + 1] || ([{_quoted(*_TAILS)}])[o_custkey % {len(_TAILS)} + 1] END AS title,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) END AS published_at,
  CASE WHEN o_orderkey % 7 <> 0 THEN CAST(600000 + o_custkey % 500 AS VARCHAR) END AS code,
  CASE WHEN o_orderkey % 7 <> 0 THEN CASE WHEN o_custkey % 3 = 0 THEN '年度' ELSE '股' || o_custkey % 500 END END AS stock,
  CASE WHEN o_orderkey % 11 <> 0 THEN 'AN' || o_orderkey // 3 END AS art_code FROM orders)"""
_REF = "TIMESTAMP '2001-07-15 12:00:00'"
_SEVERITY = "CASE " + " ".join(f"WHEN contains(title, '{w}') THEN {s}" for w, s, _ in sorted(tx.SEVERITY_RULES, key=lambda r: -r[1])) + " ELSE 0 END"
_CATEGORY = "CASE " + " ".join(f"WHEN contains(title, '{w}') THEN '{c}'" for w, _, c in sorted(tx.SEVERITY_RULES, key=lambda r: -r[1])) + " ELSE '' END"
_PAGE = "CASE WHEN code IS NOT NULL AND art_code IS NOT NULL THEN 'notices/detail/' || code || '/' || art_code || '.html' ELSE 'notices/' END"


def _screen_sql(linked: str = "true") -> str:
    return f"""{_NOTICES}, c AS (SELECT * REPLACE (trim(title) AS title), {_SEVERITY} AS severity, {_CATEGORY} AS category, {_PAGE} AS url FROM notices),
st AS (SELECT *, CASE WHEN title = '' THEN 'blank' WHEN severity = 0 THEN 'other' WHEN published_at IS NULL OR published_at > {_REF} + INTERVAL 10 MINUTE THEN 'no_time'
  WHEN published_at < {_REF} - INTERVAL 30 DAY THEN 'stale' WHEN NOT ({linked}) THEN 'unlinked' ELSE 'kept' END AS state0 FROM c),
sr AS (SELECT *, CASE WHEN state0 = 'kept' AND url <> 'notices/' AND row_number() OVER (PARTITION BY state0, url ORDER BY ord) > 1 THEN 'repeat' ELSE state0 END AS state FROM st),
screened AS (SELECT * REPLACE (CASE WHEN state = 'kept' AND stock IS NOT NULL AND NOT contains(title, stock) THEN stock || ' ' || title ELSE title END AS title) FROM sr)"""


def notices(spark, sf_dir) -> DataFrame:
    o, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), (i % len(words) + 1).cast("int"))
    return o.select(
        k.alias("ord"),
        F.when(k % 41 == 0, "  ").otherwise(F.concat(pick(_HEADS, k), pick(_TAILS, c))).alias("title"),
        F.when(k % 17 != 0, F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(k % 24).cast("int"))).alias("published_at"),
        F.when(k % 7 != 0, (F.lit(600000) + c % 500).cast("string")).alias("code"),
        F.when(k % 7 != 0, F.when(c % 3 == 0, "年度").otherwise(F.concat(F.lit("股"), (c % 500).cast("string")))).alias("stock"),
        F.when(k % 11 != 0, F.concat(F.lit("AN"), F.floor(k / 3).cast("string"))).alias("art_code"),
    )


def _ref() -> Column:
    return F.lit("2001-07-15 12:00:00").cast("timestamp")


def screened(spark, sf_dir) -> DataFrame:
    return reports.screened(notices(spark, sf_dir), _ref())


@query(f"WITH {_screen_sql()} SELECT ord, state, CASE WHEN state = 'kept' THEN title END AS title, severity, category, url FROM screened")
def announcement_screening(spark, sf_dir):
    return screened(spark, sf_dir).select("ord", "state", F.when(F.col("state") == "kept", F.col("title")).alias("title"), "severity", "category", "url")


@query(f"WITH {_screen_sql()} SELECT count(*) AS scanned, count(*) FILTER (WHERE state = 'no_time') AS dropped_no_time, count(*) FILTER (WHERE state = 'stale') AS dropped_stale, count(*) FILTER (WHERE state = 'kept') AS events FROM screened")
def screening_counters(spark, sf_dir):
    return reports.screening_counters(screened(spark, sf_dir))


@query(f"""WITH {_screen_sql("contains(title, '问询') OR contains(title, '年度') OR coalesce(contains(stock, '年度'), false) OR coalesce(code IN (SELECT CAST(600000 + s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 4 = 0), false)")} SELECT state, count(*) AS announcements, CAST(sum(ord) AS BIGINT) AS ords FROM screened GROUP BY state""")
def screening_of_codes_and_words(spark, sf_dir):
    codes = table(spark, sf_dir, "supplier").filter("s_suppkey % 4 = 0").select((F.lit(600000) + F.col("s_suppkey")).cast("string").alias("code"))
    x = reports.screened(notices(spark, sf_dir), _ref(), words=("问询", "年度"), codes=codes)
    return x.groupBy("state").agg(F.count("*").alias("announcements"), F.sum("ord").alias("ords"))


_FOCUS = f"""{_screen_sql()}, f AS (SELECT *, coalesce(code IN (SELECT CAST(600000 + s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 9 = 0), false) AS held,
  contains(title, '退市') OR contains(title, '年度') OR coalesce(contains(stock, '年度'), false) AS named FROM screened WHERE state = 'kept')"""


def focused(spark, sf_dir) -> DataFrame:
    held = table(spark, sf_dir, "supplier").filter("s_suppkey % 9 = 0").select((F.lit(600000) + F.col("s_suppkey")).cast("string").alias("code"))
    return reports.linked(screened(spark, sf_dir).filter("state = 'kept'"), held, ("退市", "市", "年度"))


@query(f"WITH {_FOCUS} SELECT ord, held, named, held OR named AS focus FROM f")
def focus_events(spark, sf_dir):
    return focused(spark, sf_dir).select("ord", "held", "named", "focus")


@query(f"WITH {_FOCUS} SELECT ord, title, category FROM f WHERE NOT held AND NOT named")
def background_events(spark, sf_dir):
    x = focused(spark, sf_dir)
    return reports.background(x, x.filter("focus")).select("ord", "title", "category")


@query(f"WITH {_FOCUS}, g AS (SELECT *, held OR named AS focus FROM f), p AS (SELECT focus, ord, severity, row_number() OVER (PARTITION BY focus ORDER BY severity DESC, published_at DESC, ord) AS place FROM g) SELECT * FROM p WHERE place <= 6")
def top_events(spark, sf_dir):
    return reports.top_events(focused(spark, sf_dir), "focus", 6).select("focus", "ord", "severity", "place")


@query(
    f"""WITH {_screen_sql()}, n AS (SELECT category, count(*) AS events, max(severity) AS severity, max(published_at) AS newest FROM screened WHERE state = 'kept' GROUP BY category)
SELECT category, events, CASE WHEN severity >= 85 THEN 'high' WHEN severity >= 65 THEN 'medium' ELSE 'lowish' END AS risk,
  strftime(newest, '%Y-%m-%d %H:%M') || '（' || CASE WHEN epoch_us({_REF}) - epoch_us(newest) < 86400000000 THEN CAST(CAST(trunc((epoch_us({_REF}) - epoch_us(newest)) / 3600000000) AS BIGINT) AS VARCHAR) || ' 小时前' ELSE CAST(CAST(trunc((epoch_us({_REF}) - epoch_us(newest)) / 86400000000) AS BIGINT) AS VARCHAR) || ' 天前' END || '）' AS newest FROM n"""
)
def category_risk_and_freshness(spark, sf_dir):
    x = screened(spark, sf_dir).filter("state = 'kept'").groupBy("category").agg(F.count("*").alias("events"), F.max("severity").alias("severity"), F.max("published_at").alias("newest"))
    return x.select("category", "events", reports.risk_level(F.col("severity")).alias("risk"), ts.newest_note(F.col("newest"), _ref()).alias("newest"))


_SAID = ("建议立即买入", "目标价: 12.5元", "稳赚不赔", "明天必涨", "推荐关注该股", "可以放心买入", "无风险套利", "翻倍可期", "闭眼买", "内幕消息显示", "主力建仓完毕", "跟随游资", "洗盘计划", "8元以下可买", "平静的一天", "必涨停在望")
_SPEECH = f"s AS (SELECT conv_id, turn, ([{_quoted(*_SAID)}])[(conv_id + turn) % {len(_SAID)} + 1] || '，' || ([{_quoted(*_SAID)}])[(conv_id * 3 + turn) % {len(_SAID)} + 1] AS t0 FROM conversations)"


def _fixed_rules_sql() -> str:
    steps = []
    for i, (pattern, _, replacement) in enumerate(tx.PHRASE_RULES):
        source = "s" if i == 0 else f"f{i}"
        steps.append(f"f{i + 1} AS (SELECT * EXCLUDE (t{i}), regexp_replace(t{i}, '{pattern}', '{replacement}', 'g') AS t{i + 1}, CAST(len(regexp_extract_all(t{i}, '{pattern}')) AS BIGINT) AS m{i} FROM {source})")
    n = len(tx.PHRASE_RULES)
    return f"WITH {_SPEECH}, {', '.join(steps)} SELECT conv_id, turn, t{n} AS rewritten, CAST({' + '.join(f'm{i}' for i in range(n))} AS INT) AS hits FROM f{n}"


def speech(spark, sf_dir) -> DataFrame:
    c, said = table(spark, sf_dir, "conversations"), F.array(*map(F.lit, _SAID))
    pick = lambda i: F.element_at(said, (i % len(_SAID) + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat(pick(F.col("conv_id") + F.col("turn")), F.lit("，"), pick(F.col("conv_id") * 3 + F.col("turn"))).alias("text"))


@query(_fixed_rules_sql())
def fixed_phrase_rules(spark, sf_dir):
    return reports.reviewed(speech(spark, sf_dir)).select("conv_id", "turn", "rewritten", F.size("hits").alias("hits"))


# ---------------------------------------------------------------- payloads

_DAY = "strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')"
_LINE = f"""CASE o_orderkey % 9 WHEN 0 THEN {_DAY} || ',10,11' WHEN 1 THEN 'no date,10,11,12,9,100,5,1,2,3,4' WHEN 2 THEN {_DAY} || ',10,-,12,9,100,5,1,2,3,4' WHEN 3 THEN {_DAY} || ',10,11,12,9,100,-,,,,'
 ELSE {_DAY} || ',' || o_custkey || ',' || (o_custkey + 1) || ',' || (o_custkey + 2) || ',' || o_custkey || ',' || (o_orderkey % 50) || ',' || (o_custkey * 5) || ',1,2,' || (o_orderkey % 3) || ',' || (o_orderkey % 4) END"""


@query(
    f"""WITH l AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderkey % 9 > 2)
SELECT k, day, CASE WHEN k % 9 = 3 THEN 10.0 ELSE c END::DOUBLE AS open, CASE WHEN k % 9 = 3 THEN 11.0 ELSE c + 1 END::DOUBLE AS close, CASE WHEN k % 9 = 3 THEN 100 ELSE k % 50 END::DOUBLE AS volume,
  CASE WHEN k % 9 = 3 THEN 0 ELSE c * 5 END::DOUBLE AS amount, CASE WHEN k % 9 = 3 THEN 0 ELSE 2 END::DOUBLE AS change, CASE WHEN k % 9 = 3 THEN 0 ELSE k % 4 END::DOUBLE AS turnover,
  CAST(floor(CASE WHEN k % 9 = 3 THEN 11.0 WHEN c > 0 AND k % 50 > 0 THEN c * 5 / (k % 50 * 100.0) ELSE c + 1 END::DOUBLE * 1000) AS BIGINT) AS vwap FROM l"""
)
def kline_bars(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    whole = F.concat_ws(",", day, c, c + 1, c + 2, c, k % 50, c * 5, F.lit("1"), F.lit("2"), k % 3, k % 4)
    line = (
        F.when(k % 9 == 0, F.concat(day, F.lit(",10,11"))).when(k % 9 == 1, "no date,10,11,12,9,100,5,1,2,3,4").when(k % 9 == 2, F.concat(day, F.lit(",10,-,12,9,100,5,1,2,3,4")))
        .when(k % 9 == 3, F.concat(day, F.lit(",10,11,12,9,100,-,,,,"))).otherwise(whole)
    )
    x = br.parse_kline(table(spark, sf_dir, "orders").select(k.alias("k"), line.alias("line")))
    return rounded(x.select("k", "day", "open", "close", "volume", "amount", "change", "turnover", F.floor(F.col("vwap") * 1000).alias("vwap")))


@query(
    """WITH r AS (SELECT user_id AS code, epoch_us(ts) // 1000000 AS s, value AS c, event_id AS i FROM events),
b AS (SELECT code, i, CAST(make_timestamp((s + 28800) * 1000000) AS DATE) AS day, CASE WHEN i % 6 IN (0, 5) THEN 1.0 ELSE 0.5 END * c AS close, CASE WHEN i % 4 = 0 THEN c ELSE c + 1 END * CASE WHEN i % 6 IN (0, 5) THEN 1.0 ELSE 0.5 END AS high, CASE WHEN i % 3 = 0 THEN 0 ELSE i / 100.0 END AS volume FROM r WHERE i % 5 <> 0)
SELECT code, i, day, round(close, 6) AS close, round(high, 6) AS high, round(CAST(volume AS DOUBLE), 6) AS volume, round(coalesce((close / nullif(lag(close) OVER (PARTITION BY code ORDER BY i), 0) - 1) * 100, 0), 6) AS change FROM b"""
)
def chart_bars(spark, sf_dir):
    i, v = F.col("event_id"), F.col("value")
    one = lambda x: F.array(x)
    e = table(spark, sf_dir, "events").withColumn("t", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    close = F.when(i % 5 != 0, v)
    adjusted = F.when(i % 6 == 0, F.lit(None).cast("double")).when(i % 6 == 5, F.lit(0.0)).otherwise(v / 2)
    payload = F.to_json(F.struct(one(F.col("t")).alias("timestamp"), one(v).alias("open"), one(F.when(i % 4 != 0, v + 1)).alias("high"), one(v - 1).alias("low"), one(close).alias("close"), one(F.when(i % 3 != 0, i.cast("double"))).alias("volume"), one(adjusted).alias("adjclose")))
    x = br.explode_chart(e.select(F.col("user_id").alias("code"), i.alias("i"), payload.alias("payload")))
    return rounded(br.with_change(x, "code", "i").select("code", "i", "day", "close", "high", "volume", "change"))


@query(
    f"""WITH {_NOTICES} SELECT ord, art_code, title, code, stock, strftime(published_at, '%Y-%m-%d %H:%M:%S') || ':817' AS raw_time, ['公告', category_] AS columns FROM (SELECT *, 'c' || ord % 3 AS category_ FROM notices WHERE ord % 10 <> 0)"""
)
def announcement_payloads(spark, sf_dir):
    x = notices(spark, sf_dir)
    known = F.struct("art_code", "title", F.concat(F.date_format("published_at", "yyyy-MM-dd HH:mm:ss"), F.lit(":817")).alias("display_time"), F.array(F.struct(F.col("code").alias("stock_code"), F.col("stock").alias("short_name"))).alias("codes"), F.array(F.struct(F.lit("公告").alias("column_name")), F.struct(F.concat(F.lit("c"), (F.col("ord") % 3).cast("string")).alias("column_name"))).alias("columns"))
    payload = F.when(F.col("ord") % 20 == 0, "{broken").when(F.col("ord") % 10 == 0, F.lit(None).cast("string")).otherwise(F.to_json(known))
    return payloads.parse_announcements(x.select("ord", payload.alias("payload")))


@query(f"WITH {_NOTICES} SELECT ord, epoch_us(published_at) AS micros, 'exact' AS quality FROM notices WHERE published_at IS NOT NULL AND ord % 10 <> 0")
def announcement_times(spark, sf_dir):
    x = announcement_payloads(spark, sf_dir).filter("raw_time is not null")
    p = ts.parse(F.col("raw_time"), _ref())
    return x.withColumn("p", p).select("ord", F.unix_micros("p.ts").alias("micros"), F.col("p.quality").alias("quality"))


@query("SELECT c_custkey AS k, c_name AS name, CAST(c_nationkey AS INT) AS n FROM customer")
def wrapped_json(spark, sf_dir):
    body = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("n")))
    x = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("var ajaxResult="), body, F.lit(";")).alias("t"))
    return x.withColumn("j", payloads.unwrap_json(F.col("t"), "struct<name:string,n:int>")).select("k", "j.name", "j.n")


@query(
    """WITH i AS (SELECT c_nationkey AS feed, c_name AS title, 'http://x/' || c_custkey AS url, c_mktsegment AS raw_time, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS ord FROM customer) SELECT feed, CAST(ord AS INT) AS ord, title, url, raw_time FROM i WHERE ord < 30"""
)
def rss_items(spark, sf_dir):
    item = F.concat(F.lit("<item>\n<title><![CDATA["), "c_name", F.lit("]]></title><link>http://x/"), F.col("c_custkey").cast("string"), F.lit("</link><pubDate> "), "c_mktsegment", F.lit(" </pubDate></item>"))
    feed = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("feed")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", item.alias("x")))), lambda s: s["x"]), "\n").alias("xml"))
    return payloads.parse_rss(feed).select("feed", "ord", "title", "url", "raw_time")


@query(
    f"""SELECT o_orderkey AS k, CAST(0 AS INT) AS block, CAST(0 AS INT) AS ord, {_DAY} AS raw_time, 'Report number ' || o_orderkey AS title, CASE o_orderkey % 3 WHEN 0 THEN 'http://y/data/' WHEN 1 THEN 'http://www/data/' ELSE 'http://www/sub/data/' END || o_orderkey AS url FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderdate >= TIMESTAMP '2000-01-01'"""
)
def dated_table_links(spark, sf_dir):
    k = F.col("o_orderkey")
    key = k.cast("string")
    href = F.concat(F.when(k % 3 == 0, "http://y/data/").when(k % 3 == 1, "/data/").otherwise("sub/data/"), key)
    said = F.when(k % 4 != 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("分享者：x"))).otherwise("no date")
    html = F.concat(F.lit("<TABLE class=o><tr><td><table><tr><td><a href='"), href, F.lit("'>Report number <b>"), key, F.lit("</b></a> <a href=/data/1>short</a> <a href=/other/1>A long other link</a></td><td>"), said, F.lit("</td></tr></table></td></tr></TABLE>"))
    return payloads.parse_dated_links(table(spark, sf_dir, "orders").select(k.alias("k"), html.alias("html")), base="http://www/")


@query("SELECT 'customer' AS feed, c_custkey AS id, c_name AS title, NULL AS price FROM customer UNION ALL SELECT 'orders', o_orderkey, NULL, round(o_totalprice, 6) FROM orders")
def union_of_feeds(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("feed"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    o = table(spark, sf_dir, "orders").select(F.lit("orders").alias("feed"), F.col("o_orderkey").alias("id"), F.round("o_totalprice", 6).alias("price"))
    return payloads.union_feeds(c, o)


@query("SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS rows_, CAST(sum(CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN o_orderkey * 2 ELSE o_orderkey END) AS BIGINT) AS keys FROM orders GROUP BY 1")
def replaced_days(spark, sf_dir):
    """Days are written, those before 1996 written again with other values; the rest must stay."""
    path = f"{work_folder(spark)}/days"
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").alias("k"))
    tables.write_days(o, path)
    tables.write_days(o.filter("day < '1996-01-01'").withColumn("k", F.col("k") * 2), path)
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("rows_"), F.sum("k").alias("keys"))


@query("SELECT 'k' || event_id AS key, epoch_us(date_trunc('second', ts)) AS first_seen FROM events WHERE event_id % 10 > 1 AND date_trunc('second', ts) >= TIMESTAMP '2024-01-28 00:00:00' - INTERVAL 72 HOUR")
def ledger_read_back(spark, sf_dir):
    """A ledger with damaged lines and bad times, read as the next round would."""
    path, i = f"{work_folder(spark)}/ledger", F.col("event_id")
    key = F.concat(F.lit("k"), i.cast("string"))
    stamp = F.when(i % 10 == 0, "not a time").otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
    line = F.when(i % 10 == 1, F.concat(F.lit('{"key": "'), key)).otherwise(F.to_json(F.struct(key.alias("key"), stamp.alias("first_seen"))))
    table(spark, sf_dir, "events").select(line.alias("value")).write.text(path)
    return tables.read_ledger(spark, path, F.lit("2024-01-28 00:00:00").cast("timestamp")).select("key", F.unix_micros("first_seen").alias("first_seen"))


@query("WITH g AS (SELECT user_id, min(ts) AS t FROM events GROUP BY user_id) SELECT 'u' || user_id AS key, epoch_us(date_trunc('second', t)) AS first_seen FROM g")
def ledger_written_whole(spark, sf_dir):
    path = f"{work_folder(spark)}/whole"
    x = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("first_seen"))
    x = x.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), "first_seen")
    tables.write_whole(x.limit(0), f"{path}-table")
    tables.write_whole(x, f"{path}-table")
    tables.write_ledger(tables.read_whole(spark, f"{path}-table"), path)
    back = tables.read_ledger(spark, path, F.lit("1970-01-05 00:00:00").cast("timestamp"))
    return back.select("key", F.unix_micros("first_seen").alias("first_seen"))


# ---------------------------------------------------------------- times and texts

_SHAPES = """CASE event_id % 8 WHEN 0 THEN strftime(ts, '%m-%d %H:%M') WHEN 1 THEN strftime(ts, '%H:%M:%S') WHEN 2 THEN (event_id % 90) || '分钟前' WHEN 3 THEN (event_id % 50) || ' 小时前' WHEN 4 THEN '刚刚'
  WHEN 5 THEN '发布时间：' || strftime(ts, '%Y-%m-%d %H:%M:%S') || ':817' WHEN 6 THEN CAST(epoch_us(ts) // 1000 AS VARCHAR) ELSE (event_id % 6) || '天前' END"""
_NOW = "TIMESTAMP '2024-01-20 12:00:00'"


@query(
    f"""WITH e AS (SELECT event_id AS i, ts, {_NOW} AS ref FROM events),
p AS (SELECT i, ref, CASE i % 8
  WHEN 0 THEN CASE WHEN date_trunc('minute', ts) <= ref + INTERVAL 10 MINUTE THEN date_trunc('minute', ts) ELSE date_trunc('minute', ts) - INTERVAL 1 YEAR END
  WHEN 1 THEN CASE WHEN CAST(ref AS DATE) + CAST(date_trunc('second', ts) AS TIME) > ref + INTERVAL 10 MINUTE THEN CAST(ref AS DATE) + CAST(date_trunc('second', ts) AS TIME) - INTERVAL 1 DAY ELSE CAST(ref AS DATE) + CAST(date_trunc('second', ts) AS TIME) END
  WHEN 2 THEN ref - INTERVAL 1 MINUTE * (i % 90) WHEN 3 THEN ref - INTERVAL 1 HOUR * (i % 50) WHEN 4 THEN ref WHEN 5 THEN date_trunc('second', ts) WHEN 6 THEN make_timestamp(epoch_us(ts) // 1000 * 1000) ELSE ref - INTERVAL 1 DAY * (i % 6) END AS t FROM e)
SELECT i, CASE WHEN i % 8 IN (2, 3, 4, 7) THEN 'derived' ELSE 'exact' END AS quality, epoch_us(t) AS micros, round((epoch_us(ref) - epoch_us(t)) / 60000000.0::DOUBLE, 6) AS age,
  CASE WHEN (epoch_us(ref) - epoch_us(t)) BETWEEN -60000000 AND 59999999 THEN '刚刚' WHEN (epoch_us(ref) - epoch_us(t)) BETWEEN 0 AND 3599999999 THEN CAST((epoch_us(ref) - epoch_us(t)) // 60000000 AS VARCHAR) || '分钟前'
    WHEN CAST(t AS DATE) = CAST(ref AS DATE) THEN '今天 ' || strftime(t, '%H:%M') WHEN CAST(t AS DATE) = CAST(ref AS DATE) - 1 THEN '昨天 ' || strftime(t, '%H:%M') ELSE strftime(t, '%m-%d %H:%M') END AS shown FROM p"""
)
def relative_times_and_ages(spark, sf_dir):
    i, t = F.col("event_id"), F.col("ts").cast("timestamp")
    ref = F.lit("2024-01-20 12:00:00").cast("timestamp")
    said = lambda n, unit: F.concat((i % n).cast("string"), F.lit(unit))
    raw = (
        F.when(i % 8 == 0, F.date_format(t, "MM-dd HH:mm")).when(i % 8 == 1, F.date_format(t, "HH:mm:ss")).when(i % 8 == 2, said(90, "分钟前")).when(i % 8 == 3, said(50, " 小时前")).when(i % 8 == 4, "刚刚")
        .when(i % 8 == 5, F.concat(F.lit("发布时间："), F.date_format(t, "yyyy-MM-dd HH:mm:ss"), F.lit(":817"))).when(i % 8 == 6, F.unix_millis(t).cast("string")).otherwise(said(6, "天前"))
    )
    x = table(spark, sf_dir, "events").select(i.alias("i"), ts.parse(raw, ref).alias("p"))
    return rounded(x.select("i", "p.quality", F.unix_micros("p.ts").alias("micros"), ts.age_minutes(F.col("p.ts"), ref).alias("age"), ts.readable_age(F.col("p.ts"), ref).alias("shown")))


@query(
    """WITH p AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate ELSE o_orderdate + INTERVAL 1 HOUR * (o_orderkey % 24) END AS t FROM orders),
q AS (SELECT *, CASE WHEN t = date_trunc('day', t) THEN 'date' ELSE 'exact' END AS quality FROM p)
SELECT k, quality, epoch_us(CASE WHEN quality = 'date' THEN t + INTERVAL 8 HOUR ELSE t END) AS micros, isodow(t) <= 5 AND hour(t) * 60 + minute(t) BETWEEN 555 AND 930 AS trading, hour(t) >= 9 AND hour(t) < 12 AS morning FROM q"""
)
def publish_dates(spark, sf_dir):
    k, t = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    raw = F.concat(F.date_format(F.when(k % 3 == 0, t).otherwise(t + F.make_interval(hours=(k % 24).cast("int"))), "yyyy-MM-dd HH:mm:ss"), F.lit(".000"))
    x = table(spark, sf_dir, "orders").select(k.alias("k"), ts.publish_date(raw, _ref()).alias("p"))
    aligned = F.when(F.col("p.quality") == "date", ts.align_to_hour(F.col("p.ts"), 8)).otherwise(F.col("p.ts"))
    return x.select("k", "p.quality", F.unix_micros(aligned).alias("micros"), ts.in_trading_hours(F.col("p.ts"), 555, 930).alias("trading"), ts.in_quiet_hours(F.col("p.ts"), "09:00", "12:00").alias("morning"))


_FLASH = ("【快讯】新能源板块拉升", "异动快报：<em>某股</em>涨停", "异动快报：某股涨停", "某股涨停", "北向资金跌超预期", "平淡的一天", "概念股封板 跳水", "CPI与PPI公布", "回购 增持 减持 中标")
_FLASH_SQL = f"([{_quoted(*_FLASH)}])[event_id % {len(_FLASH)} + 1]"


def _flash(i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, _FLASH)), (i % len(_FLASH) + 1).cast("int"))


@query(
    f"""WITH t AS (SELECT event_id AS i, {_FLASH_SQL} AS title FROM events)
SELECT i, regexp_replace(title, '^【(.*?)】\\s*', '\\1｜') AS bracket, regexp_replace(regexp_replace(title, '</?em>', '', 'g'), '^异动快报[:：]\\s*', '') AS plain,
  {' OR '.join(f"contains(title, '{w}')" for w in tx.SIGNAL_WORDS)} AS signal,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {' OR '.join(f'contains(title, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{t}' END" for t, ws in tx.FLASH_TAGS)}], lambda x: x IS NOT NULL)[1:3], '|') AS tags,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {' OR '.join(f'contains(title, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{t}' END" for t, ws in tx.ALERT_TAGS)}], lambda x: x IS NOT NULL), '|') AS alerts,
  array_to_string(list_filter([{_quoted(*tx.HOT_WORDS)}], lambda w: contains(title, w))[1:3], '|') AS hot, array_to_string(list_filter([{_quoted(*tx.INDICATOR_WORDS)}], lambda w: contains(title, w))[1:2], '|') AS indicators FROM t"""
)
def flash_titles(spark, sf_dir):
    t = F.col("title")
    x = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), _flash(F.col("event_id")).alias("title"))
    return x.select("i", tx.open_bracket(t).alias("bracket"), tx.without_alert_prefix(tx.without_emphasis(t)).alias("plain"), tx.is_signal(t).alias("signal"), F.array_join(tx.grouped_tags(t), "|").alias("tags"), F.array_join(tx.grouped_tags(t, tx.ALERT_TAGS), "|").alias("alerts"), F.array_join(tx.keyword_tags(t, tx.HOT_WORDS, 3), "|").alias("hot"), F.array_join(tx.keyword_tags(t, tx.INDICATOR_WORDS, 2), "|").alias("indicators"))


@query(f"""WITH t AS (SELECT event_type AS source, event_id AS ord, trim(regexp_replace({_FLASH_SQL}, '^异动快报[:：]\\s*', '')) || user_id % 40 AS title FROM events) SELECT source, title, min(ord) AS ord FROM t GROUP BY ALL""")
def titles_once(spark, sf_dir):
    i = F.col("event_id")
    x = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), i.alias("ord"), F.concat(_flash(i), (F.col("user_id") % 40).cast("string")).alias("title"))
    return feeds.distinct_titles(x).select("source", "title", "ord")


@query(f"""WITH t AS (SELECT event_type AS source, event_id AS ord, ts AS published_at, {' OR '.join(f"contains({_FLASH_SQL}, '{w}')" for w in tx.SIGNAL_WORDS)} AS signal FROM events) SELECT source, ord, row_number() OVER (PARTITION BY source ORDER BY signal DESC, published_at DESC, ord) AS place FROM t""")
def signals_first(spark, sf_dir):
    i = F.col("event_id")
    x = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"), i.alias("ord"), F.col("ts").cast("timestamp").alias("published_at"), tx.is_signal(_flash(i)).alias("signal"))
    return feeds.signals_first(x).select("source", "ord", F.col("place").cast("long").alias("place"))


_MADE = """(CASE doc_id % 4 WHEN 0 THEN '# 标题 ' || doc_id || chr(10) WHEN 1 THEN chr(10) || '  ## 副题' || chr(10) ELSE '' END || '正文' || doc_id || chr(10) || '## 目录' || chr(10) || 'x' || chr(10) || '## 原始报告 1：来源' || chr(10) || '```py' || chr(10) || '# code' || chr(10) || '```' || chr(10) || '> **文件名**：a' || chr(10) || '方法论层的话' || chr(10) || '尾')"""


def made_reports(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    head = F.when(d % 4 == 0, F.concat(F.lit("# 标题 "), d.cast("string"), F.lit("\n"))).when(d % 4 == 1, "\n  ## 副题\n").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(head, F.lit("正文"), d.cast("string"), F.lit("\n## 目录\nx\n## 原始报告 1：来源\n```py\n# code\n```\n> **文件名**：a\n方法论层的话\n尾")).alias("text"))


@query(f"""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '标题 ' || doc_id WHEN 1 THEN '副题' ELSE '目录' END AS title, md5(CASE WHEN doc_id % 4 = 0 THEN substr({_MADE}, instr({_MADE}, chr(10)) + 1) ELSE {_MADE} END) AS body FROM documents""")
def report_titles(spark, sf_dir):
    x = made_reports(spark, sf_dir)
    return x.select("doc_id", tx.document_title(F.col("text"), F.lit("none")).alias("title"), F.md5(reports.without_first_heading(F.col("text"))).alias("body"))


@query(
    """WITH l AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN ['# 标题 ' || doc_id, '正文' || doc_id, '## 来源', '尾'] WHEN 1 THEN ['', '  ## 副题', '正文' || doc_id, '## 来源', '尾'] ELSE ['正文' || doc_id, '## 来源', '尾'] END AS ls FROM documents)
SELECT doc_id, array_to_string(ls, '|') AS lines FROM l"""
)
def pushed_reports(spark, sf_dir):
    x = reports.pushed_lines(made_reports(spark, sf_dir))
    return x.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls")).select("doc_id", F.array_join("ls.line", "|").alias("lines"))


@query(
    """WITH g AS (SELECT o_custkey AS k, list(o_orderpriority ORDER BY o_orderkey) AS ts, count(*) AS n FROM orders GROUP BY o_custkey)
SELECT k, CASE WHEN k % 5 = 0 THEN '给定' || k WHEN n = 1 THEN ts[1] || '（合并版）' ELSE ts[1] || ' + ' || ts[2] || ' 等 ' || n || ' 份报告合并分析' END AS topic,
  CASE WHEN k % 5 = 0 THEN '给定' || k ELSE array_to_string(list_transform(list_sort(list_transform(list_distinct(ts), lambda t: {'p': list_position(ts, t), 't': t})), lambda x: x.t), ' + ') END AS joined FROM g"""
)
def merge_topics(spark, sf_dir):
    listed = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda s: s["o_orderpriority"])
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(listed.alias("ts"))
    given = F.when(F.col("k") % 5 == 0, F.concat(F.lit(" 给定"), F.col("k").cast("string"), F.lit(" "))).otherwise("  ")
    return g.select("k", reports.merge_topic(F.col("ts"), given).alias("topic"), reports.joined_topics(F.col("ts"), given).alias("joined"))


@query(
    """SELECT o_orderkey AS k, '股' || o_custkey || '(' || o_custkey || ') 封板' || CASE WHEN o_orderkey % 2 = 0 THEN ' · ' || o_orderkey % 5 || '连板' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN ' · a+b' ELSE '' END AS limit_up,
  array_to_string(list_filter([CASE WHEN o_orderkey % 4 <> 0 THEN printf('涨幅 %.2f%%', o_orderkey % 21 / 2.0) END, CASE WHEN o_orderkey % 5 <> 0 THEN printf('换手 %.2f%%', o_custkey % 8 / 4.0) END, CASE WHEN o_custkey % 10 <> 0 THEN printf('封单 %.2f亿', o_custkey % 10 / 4.0) END, CASE WHEN o_orderkey % 6 <> 0 THEN '开板 ' || o_orderkey % 6 || ' 次' END], lambda x: x IS NOT NULL), '，') AS details,
  CASE WHEN o_orderkey % 2 = 0 THEN '机构·' ELSE '' END || o_orderpriority AS research, CASE WHEN o_custkey % 3 = 0 THEN '' ELSE '股' || o_custkey || CASE WHEN o_custkey % 3 = 1 THEN '(' || o_custkey || ')' ELSE '' END || ' ' END || '机构·' || o_orderpriority AS forecast,
  array_to_string(list_filter([CASE WHEN o_orderkey % 2 = 0 THEN '评级 买' END, CASE WHEN o_orderkey % 3 = 0 THEN '今年EPS预测 1.2' END, CASE WHEN o_orderkey % 5 = 0 THEN '对应PE 9' END], lambda x: x IS NOT NULL), '，') AS bits, 'a|b|c' AS reasons FROM orders"""
)
def composed_titles(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    stock = F.concat(F.lit("股"), c.cast("string"))
    return table(spark, sf_dir, "orders").select(
        k.alias("k"),
        snapshots.limit_up_line(stock, c.cast("string"), F.when(k % 2 == 0, F.concat((k % 5).cast("string"), F.lit("连板"))), F.when(k % 3 == 0, "a+b").otherwise(" ")).alias("limit_up"),
        snapshots.limit_up_details(F.when(k % 4 != 0, k % 21 / 2.0), F.when(k % 5 != 0, c % 8 / 4.0), c % 10 / 4.0 * 1e8, (k % 6).cast("int")).alias("details"),
        snapshots.research_line(F.when(k % 2 == 0, "机构"), F.col("o_orderpriority")).alias("research"),
        snapshots.forecast_line(F.when(c % 3 != 0, stock), F.when(c % 3 == 1, c.cast("string")), F.lit("机构"), F.col("o_orderpriority")).alias("forecast"),
        snapshots.forecast_details(F.when(k % 2 == 0, "买"), F.when(k % 3 == 0, "1.2").otherwise(""), F.when(k % 5 == 0, "9")).alias("bits"),
        F.array_join(tx.reason_tags(F.lit("a++b+c+d")), "|").alias("reasons"),
    )


# ---------------------------------------------------------------- market


@query(
    f"""WITH {_PROFILE}, e AS (SELECT code, day, composite, unnest([{', '.join(f"{{'s': {d}, 'p': {i}, 'd': '{d}'}}" for i, d in enumerate(scoring.DIMENSIONS))}]) AS e FROM profile),
b AS (SELECT code, arg_max(e.d, (e.s, -e.p)) FILTER (WHERE e.s IS NOT NULL) AS best, arg_min(e.d, (e.s, e.p)) FILTER (WHERE e.s IS NOT NULL) AS worst, CAST(count(e.s) AS INT) AS covered FROM e GROUP BY code),
r AS (SELECT code, list_filter([{', '.join(f'CASE WHEN ROC{d} > 0 THEN 1 / ROC{d} - 1 END' for d in (5, 10, 20, 60))}], lambda x: x IS NOT NULL) AS rs, CASE WHEN ROC5 > 0 THEN 1 / ROC5 - 1 END AS a, CASE WHEN ROC60 > 0 THEN 1 / ROC60 - 1 END AS z FROM latest)
SELECT p.code, best, worst, covered, CASE WHEN composite IS NULL THEN 'none' WHEN composite >= 70 THEN 'high' WHEN composite >= 55 THEN 'raised' WHEN composite > 45 THEN 'middle' WHEN composite > 30 THEN 'lowered' ELSE 'low' END AS stance,
  CASE WHEN len(rs) = 0 THEN 'none' WHEN list_min(rs) > 0 THEN 'all_up' WHEN list_max(rs) <= 0 THEN 'all_down' WHEN a > 0 AND z < 0 THEN 'repair' WHEN a < 0 AND z > 0 THEN 'fading' ELSE 'mixed' END AS shape FROM profile p JOIN b USING (code) JOIN r USING (code)"""
)
def dimension_extremes(spark, sf_dir):
    return scoring.extremes(profiles(spark, sf_dir)).select("code", "best", "worst", "covered", "stance", "shape")


_USER_BARS = "bars AS (SELECT user_id AS code, event_id AS day, value AS open, value AS close, value + 1 AS high, value / 2 AS low, event_id % 100 + 1.0::DOUBLE AS volume, value AS vwap FROM events)"


@query(f"WITH {_panel_sql(('MA20', 'STD60', 'IMAX30', 'RANK10', 'CORR20'), _USER_BARS)} SELECT code, day, {', '.join(f'round({k}, 6) AS {k}' for k in ('MA20', 'STD60', 'IMAX30', 'RANK10', 'CORR20'))} FROM latest")
def gated_factors(spark, sf_dir):
    """Users' events as bars; users with fewer than 70 have no factors."""
    v, i = F.col("value"), F.col("event_id")
    x = table(spark, sf_dir, "events").select(F.col("user_id").alias("code"), i.alias("day"), v.alias("open"), v.alias("close"), (v + 1).alias("high"), (v / 2).alias("low"), (i % 100 + 1.0).alias("volume"), v.alias("vwap"))
    return rounded(catalog.latest_factors(x, ("MA20", "STD60", "IMAX30", "RANK10", "CORR20")))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 70")
def series_with_history(spark, sf_dir):
    return rl.with_history(table(spark, sf_dir, "events").select("user_id"), by="user_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"WITH {base.BARS} SELECT code, day, round(CASE WHEN abs((open / 50000.0) ** (close / 40000.0)) < 'inf'::DOUBLE THEN (open / 50000.0) ** (close / 40000.0) END, 6) AS power, round(-close, 6) AS minus, CASE WHEN open = close THEN 1.0 ELSE 0.0 END::DOUBLE AS same, CASE WHEN open <> close THEN 1.0 ELSE 0.0 END::DOUBLE AS other, CASE WHEN open <= close THEN 1.0 ELSE 0.0 END::DOUBLE AS upto FROM bars")
def factor_power_and_compare(spark, sf_dir):
    o, c = F.col("open"), F.col("close")
    return rounded(bars(spark, sf_dir).select("code", "day", rl.power(o / 50000.0, c / 40000.0).alias("power"), (-c).alias("minus"), rl.compare(o, "==", c).alias("same"), rl.compare(o, "!=", c).alias("other"), rl.compare(o, "<=", c).alias("upto")))


_NAMES = ("*ST云", "退市某", "S T海", "正常股", "st小", "好公司")
_RISKY = "regexp_matches(upper(replace(name, ' ', '')), 'ST|退|\\*')"


@query(f"WITH m AS (SELECT c_custkey AS code, ([{_quoted(*_NAMES)}])[c_custkey % {len(_NAMES)} + 1] AS name, c_acctbal AS amount FROM customer), k AS (SELECT *, row_number() OVER (ORDER BY amount DESC, code) AS n FROM m WHERE NOT {_RISKY}) SELECT code, name, round(amount, 6) AS amount, 'market' AS universe FROM k WHERE n <= 50")
def market_leaders(spark, sf_dir):
    c = F.col("c_custkey")
    m = table(spark, sf_dir, "customer").select(c.alias("code"), F.element_at(F.array(*map(F.lit, _NAMES)), (c % len(_NAMES) + 1).cast("int")).alias("name"), F.col("c_acctbal").alias("amount"))
    return rounded(bd.top_of_market(m, 50))


@query("SELECT c_nationkey AS code, arg_min(c_name, c_custkey) AS name FROM customer GROUP BY c_nationkey")
def market_universe(spark, sf_dir):
    return bd.universe(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("code"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ord")))


@query(
    """WITH c AS (SELECT c_custkey AS k, lpad(CAST(c_custkey * 617 % 1000000 AS VARCHAR), 6, '0') AS code, c_acctbal AS b FROM customer),
s AS (SELECT *, CASE WHEN code[1] IN ('6', '9') THEN code || '.SS' WHEN code[1] IN ('0', '2', '3') THEN code || '.SZ' WHEN code[1] IN ('4', '8') THEN code || '.BJ' END AS symbol, CASE WHEN code[1] IN ('6', '9') THEN '1.' ELSE '0.' END || code AS ident FROM c)
SELECT k, symbol, ident, CASE WHEN code[1] IN ('6', '9') THEN code || '.SS' ELSE code || '.SZ' END AS of_id, code AS of_symbol, code AS of_ident, round(CASE WHEN k % 4 = 0 THEN 0 ELSE b * 2 END, 6) AS amount FROM s"""
)
def code_mappings(spark, sf_dir):
    k = F.col("c_custkey")
    code = F.lpad((k * 617 % 1_000_000).cast("string"), 6, "0")
    x = table(spark, sf_dir, "customer").select(k.alias("k"), code.alias("code"), F.when(k % 4 != 0, F.col("c_acctbal")).alias("price"))
    x = x.withColumns({"symbol": bd.exchange_symbol(F.col("code")), "ident": bd.market_id(F.col("code"))})
    return rounded(x.select("k", "symbol", "ident", bd.symbol_of_id(F.col("ident")).alias("of_id"), bd.plain_code(F.coalesce("symbol", "code")).alias("of_symbol"), bd.plain_code(F.col("ident")).alias("of_ident"), bd.estimated_amount(F.col("price"), F.lit(2.0)).alias("amount")))


@query(f"WITH {base.BARS}, x AS (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY day) AS p FROM bars) SELECT code, day, round(close, 6) AS close FROM x WHERE p IS NULL OR (close < round(p * 1.1, 2) AND close > round(p * 0.9, 2))")
def tradable_bars(spark, sf_dir):
    return rounded(research.tradable(bars(spark, sf_dir)).select("code", "day", "close"))


@query(f"WITH {base._MONTH}, r AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY factor) + (count(*) OVER (PARTITION BY day, factor) - 1) / 2.0::DOUBLE AS rf, rank() OVER (PARTITION BY day ORDER BY forward) + (count(*) OVER (PARTITION BY day, forward) - 1) / 2.0::DOUBLE AS rw FROM panel WHERE factor IS NOT NULL AND forward IS NOT NULL), d AS (SELECT day, CASE WHEN count(*) > 1 THEN corr(rf, rw) END AS ic FROM r GROUP BY day) SELECT round(avg(ic), 6) AS mean, round(stddev_samp(ic), 6) AS std, round(avg(ic) / stddev_samp(ic), 6) AS ir, round(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END), 6) AS positive FROM d")
def information_ratio(spark, sf_dir):
    return rounded(research.information_summary(research.information(base.research_panel(spark, sf_dir), "factor", "forward")))


@query(f"WITH {base._MONTH}, r AS (SELECT *, ntile(5) OVER (PARTITION BY day ORDER BY factor, code) AS b FROM panel WHERE factor IS NOT NULL AND forward IS NOT NULL), g AS (SELECT b, avg(forward) AS m FROM r GROUP BY b), s AS (SELECT *, m > lag(m) OVER (ORDER BY b) AS up FROM g) SELECT round(arg_max(m, b), 6) AS top, round(arg_min(m, b), 6) AS bottom, round(arg_max(m, b) - arg_min(m, b), 6) AS spread, CAST(count(*) FILTER (WHERE up) AS INT) AS rising, count(*) FILTER (WHERE up) = count(*) - 1 AS monotone FROM s")
def quantile_spread(spark, sf_dir):
    return rounded(research.quantile_spread(research.quantile_returns(base.research_panel(spark, sf_dir), "factor", "forward")))


@query(
    """WITH e AS (SELECT o_custkey AS code, CAST(o_orderdate AS DATE) AS day, o_orderkey AS k, o_totalprice AS eps FROM orders)
SELECT code, day, k, CAST(floor(eps / nullif(k % 50, 0) * 1000) AS BIGINT) AS pe_inverse, round(k / nullif(k % 50, 0)::DOUBLE, 6) AS pb_inverse,
  (SELECT round((e.eps - p.eps) / p.eps, 6) FROM e p WHERE p.code = e.code AND p.day <= e.day - 30 ORDER BY p.day DESC, p.k DESC LIMIT 1) AS revision FROM e"""
)
def ratios_and_revisions(spark, sf_dir):
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("code"), F.col("o_orderdate").cast("date").alias("day"), k.alias("k"), F.col("o_totalprice").alias("eps"), (k % 50).cast("double").alias("price"))
    r = research.value_ratios("price", "eps", "k")
    x = research.revision(e, "eps", order=("k",))
    return rounded(x.select("code", "day", "k", F.floor(r["pe_inverse"] * 1000).alias("pe_inverse"), r["pb_inverse"].alias("pb_inverse"), "revision"))


# ---------------------------------------------------------------- feeds and streams


@query(f"WITH {_ITEMS} SELECT source, count(*) AS n, bool_or(source IN ('view', 'error')) AS date_only FROM items WHERE source <> 'click' AND source IN ('view', 'error', 'click') GROUP BY source")
def active_sources(spark, sf_dir):
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("source")).distinct()
    config = names.select("source", (F.col("source") == "click").alias("disabled"), F.when(F.col("source").isin("view", "error"), True).alias("date_only"))
    on = feeds.active(base.items(spark, sf_dir), config, chosen=("view", "error", "click"))
    return on.groupBy("source").agg(F.count("*").alias("n"), F.bool_or("date_only").alias("date_only"))


@query(f"WITH {base._JUDGED_ALL}, k AS (SELECT *, CASE source WHEN 'view' THEN 0 ELSE 1 END AS rank FROM lim WHERE kept), t AS (SELECT *, row_number() OVER (ORDER BY published_at DESC, rank, ord) AS n, count(*) OVER () AS total FROM k) SELECT total, source, ord, title, epoch_us(published_at) AS micros FROM t WHERE n = 1")
def digest_head(spark, sf_dir):
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("source")).distinct().withColumn("rank", F.when(F.col("source") == "view", 0).otherwise(1))
    head = feeds.digest_head(base.judged_all(spark, sf_dir).filter("kept"), names)
    return head.select("total", "source", "ord", "title", F.unix_micros("published_at").alias("micros"))


def event_stream(spark, sf_dir) -> DataFrame:
    """The events as a stream of items (source, key, published_at, read_at), each read three hours after its time but for some."""
    path = f"{sf_dir}/events.parquet"
    # A pattern stands for a single file as well as for a folder of them.
    raw = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    t, i = F.col("ts").cast("timestamp"), F.col("event_id")
    read = t + F.make_interval(hours=(i % 7 - 1).cast("int"))
    return raw.select(F.col("event_type").alias("source"), F.concat("event_type", F.lit(":"), (F.col("user_id") % 50).cast("string")).alias("key"), t.alias("published_at"), read.alias("read_at"), i.alias("ord"))


#: The events' time is cut into so many rounds; what the ledger remembers is 1.2 rounds long, as 72 hours are to rounds of 60.
_ROUNDS = 6
_ROUND_SQL = f"""span AS (SELECT epoch_us(min(ts)) AS lo, (epoch_us(max(ts)) - epoch_us(min(ts))) // {_ROUNDS} + 1 AS step FROM events),
it AS (SELECT event_id AS ord, event_type || ':' || user_id % 500 AS key, epoch_us(ts) AS us, lo, step, least((epoch_us(ts) - lo) // step + CASE WHEN event_id % 7 = 0 THEN 2 ELSE 0 END, {_ROUNDS - 1}) AS round FROM events, span)"""


def event_rounds(spark, sf_dir) -> tuple[list[DataFrame], int]:
    """The events as items (source, key, published_at, read_at, ord) by the round in which they are read, and microseconds a round.

    Every seventh item is read two rounds after its time.
    """
    events = table(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    lo, hi = events.agg(F.min(us), F.max(us)).first()
    step = (hi - lo) // _ROUNDS + 1
    at = F.least(F.floor((us - lo) / step) + F.when(F.col("event_id") % 7 == 0, 2).otherwise(0), F.lit(_ROUNDS - 1))
    key = F.concat("event_type", F.lit(":"), (F.col("user_id") % 500).cast("string"))
    read = F.timestamp_micros(lo + (at + 1) * step)
    x = events.select(F.col("event_type").alias("source"), key.alias("key"), F.col("ts").cast("timestamp").alias("published_at"), read.alias("read_at"), F.col("event_id").alias("ord"), at.alias("round"))
    return [x.filter(F.col("round") == k).drop("round") for k in range(_ROUNDS)], step


def _rows_of_rounds(spark, sf_dir, made) -> DataFrame:
    """What a stream over the rounds, one run each, writes down in all its batches."""
    rounds, step = event_rounds(spark, sf_dir)
    folder = work_folder(spark)

    def start(stream):
        return made(stream, step).writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()

    digest.in_rounds(rounds, folder, start)
    return spark.read.parquet(f"{folder}/rows")


@query(
    f"""WITH RECURSIVE {_ROUND_SQL}, p AS (SELECT DISTINCT key, round FROM it),
sent AS (SELECT key, min(round) AS round FROM p GROUP BY key UNION ALL SELECT s.key, n.round FROM sent s, LATERAL (SELECT min(p.round) AS round FROM p WHERE p.key = s.key AND p.round > s.round + 1) n WHERE n.round IS NOT NULL)
SELECT it.ord, it.key, it.round FROM it JOIN sent s ON s.key = it.key AND s.round = it.round"""
)
def stream_unsent(spark, sf_dir):
    """What each round sends: keys come back once their time in the ledger is over, one round having passed them by."""
    x = _rows_of_rounds(spark, sf_dir, lambda items, step: digest.unsent(items, 1.2 * step / 3.6e9))
    rounds, step = event_rounds(spark, sf_dir)
    lo = table(spark, sf_dir, "events").agg(F.min(F.unix_micros(F.col("ts").cast("timestamp")))).scalar()
    return x.select("ord", "key", (F.floor((F.unix_micros("read_at") - lo) / step) - 1).alias("round"))


@query(
    f"""WITH {_ROUND_SQL}, e AS (SELECT event_type AS source, it.* FROM it JOIN events ON event_id = ord), wm AS (SELECT round, max(max(us)) OVER (ORDER BY round) - max(step) // 2 AS after FROM e GROUP BY round),
s AS (SELECT source, e.round, us - us % 1800000000 - 1800000000 * k AS start FROM e, (SELECT unnest(range(0, 6)) AS k)),
kept AS (SELECT s.source, s.start FROM s LEFT JOIN wm ON wm.round = s.round - 1 WHERE wm.after IS NULL OR s.start + 10800000000 > wm.after // 1000 * 1000)
SELECT source, start AS window_start, count(*) AS items FROM kept WHERE start + 10800000000 <= (SELECT max(after) FROM wm) GROUP BY ALL"""
)
def stream_closed_windows(spark, sf_dir):
    """Sliding counts in append mode: a window is written once, when the watermark has passed it; items read two rounds late find it closed."""
    x = _rows_of_rounds(spark, sf_dir, lambda items, step: digest.sliding(items, late=f"{step // 2} microseconds"))
    return x.select("source", F.unix_micros("window_start").alias("window_start"), "items")


@query(
    """WITH t AS (SELECT 'orders' AS source, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier)
SELECT source, source <> 'customer' AS ok, CASE WHEN source <> 'customer' THEN n ELSE (SELECT count(*) FROM customer WHERE c_custkey % 3 < 2) END AS items FROM t UNION ALL SELECT 'missing', false, 0"""
)
def streams_that_fail_alone(spark, sf_dir):
    """Feeds as concurrent streams of three batches; one dies in its third, one can't start."""
    folder = work_folder(spark)

    def feed(name: str, key: str, fails: bool = False):
        def made() -> DataFrame:
            x = table(spark, sf_dir, name).select(F.col(key).cast("long").alias("id"))
            for k in range(3):  # one file, so one batch, for each third
                x.filter(F.col("id") % 3 == k).coalesce(1).write.mode("append").parquet(f"{folder}/in-{name}")
            stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-{name}")
            return stream.withColumn("id", F.when(F.col("id") % 3 == 2, F.raise_error(F.lit("broken feed")).cast("long")).otherwise(F.col("id"))) if fails else stream

        return made

    feeds_ = {"orders": feed("orders", "o_orderkey"), "customer": feed("customer", "c_custkey", True), "supplier": feed("supplier", "s_suppkey"), "missing": feed("nothing", "x")}
    status = digest.land_streams(feeds_, f"{folder}/landed")
    landed = None
    for name in ("orders", "customer", "supplier"):
        own = spark.read.parquet(f"{folder}/landed/source={name}").agg(F.count("*").alias("items")).select(F.lit(name).alias("source"), "items")
        landed = own if landed is None else landed.union(own)
    return status.join(landed, "source", "left").select("source", "ok", F.coalesce("items", F.lit(0).cast("long")).alias("items"))


def _run(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """What the stream gives until its input ends, written batch by batch; a batch that comes again replaces itself."""
    path = f"{folder}/rows"

    def keep(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch_id={batch_id}")

    stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(path)


@query("SELECT event_id AS ord FROM events WHERE event_id % 7 - 1 <= 3 AND event_id % 7 - 1 >= 0")
def stream_valid_items(spark, sf_dir):
    return _run(digest.valid(event_stream(spark, sf_dir), 180), work_folder(spark)).select("ord")


@query("SELECT DISTINCT event_type || ':' || user_id % 50 AS key FROM events")
def stream_once(spark, sf_dir):
    return _run(digest.once(event_stream(spark, sf_dir)).select("key"), work_folder(spark)).select("key")


@query("WITH w AS (SELECT event_type AS source, epoch_us(ts) AS us FROM events), s AS (SELECT source, us - us % 1800000000 - 1800000000 * k AS start FROM w, (SELECT unnest(range(0, 6)) AS k)) SELECT source, start AS window_start, count(*) AS items FROM s GROUP BY ALL")
def stream_sliding_counts(spark, sf_dir):
    x = _run(digest.sliding(event_stream(spark, sf_dir)), work_folder(spark), "complete")
    return x.select("source", F.unix_micros("window_start").alias("window_start"), "items")


@query("SELECT event_type || ':' || user_id % 50 AS key, count(*) AS sent FROM events GROUP BY 1")
def stream_delivered(spark, sf_dir):
    """Delivery over two runs: the second finds all keys in the ledger and sends nothing again."""
    folder = work_folder(spark)

    def publish(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("append").parquet(f"{folder}/out")

    for run in (1, 2):
        digest.deliver(event_stream(spark, sf_dir), publish, f"{folder}/ledger", f"{folder}/log-{run}").awaitTermination()
    return spark.read.parquet(f"{folder}/out").groupBy("key").agg(F.count("*").alias("sent"))


@query("SELECT CAST(count(*) AS BIGINT) AS items, epoch_us(max(ts)) AS newest, CAST(0 AS BIGINT) AS in_quiet_hours FROM events")
def stream_heartbeat_and_quiet_hours(spark, sf_dir):
    """A round's figures, and what is published when the round falls into the quiet hours: nothing."""
    folder = work_folder(spark)
    night = lambda: F.lit("2024-01-01 23:30:00").cast("timestamp")
    silent = digest.outside_quiet_hours(lambda rows, batch_id: rows.write.mode("append").parquet(f"{folder}/quiet"), "23:00", "07:00", night)

    def round_(rows: DataFrame, batch_id: int) -> None:
        digest.heartbeat(rows, batch_id).write.mode("append").parquet(f"{folder}/beats")
        silent(rows, batch_id)

    event_stream(spark, sf_dir).writeStream.foreachBatch(round_).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    beats = spark.read.parquet(f"{folder}/beats").agg(F.sum("items").alias("items"), F.unix_micros(F.max("newest")).alias("newest"))
    return beats.withColumn("in_quiet_hours", spark.read.parquet(f"{folder}/quiet").agg(F.count("*")).scalar())


@query("SELECT 'customer' AS source, true AS ok, count(*) AS items FROM customer UNION ALL SELECT 'events', true, count(*) FROM events UNION ALL SELECT 'missing', false, 0")
def feeds_with_a_broken_one(spark, sf_dir):
    path = f"{work_folder(spark)}/landed"
    names = {"customer": "c_custkey", "missing": "x", "events": "event_id"}
    made = {k: (lambda k=k, c=c: table(spark, sf_dir, k).select(F.col(c).alias("id"))) for k, c in names.items()}
    status = digest.land_feeds(spark, made, path)
    landed = spark.read.parquet(path).groupBy("source").agg(F.count("*").alias("items"))
    return status.join(landed, "source", "left").select("source", "ok", F.coalesce("items", F.lit(0).cast("long")).alias("items"))
