"""Titles, keys, severity rules and phrase rules as column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word in the title, severity, category.
SEVERITY_RULES = (
    ("立案调查", 100, "立案调查"),
    ("立案", 95, "立案调查"),
    ("行政处罚", 90, "行政处罚"),
    ("处罚决定", 88, "行政处罚"),
    ("市场禁入", 92, "行政处罚"),
    ("被证监会", 85, "监管措施"),
    ("监管措施", 80, "监管措施"),
    ("警示函", 78, "监管措施"),
    ("责令改正", 76, "监管措施"),
    ("通报批评", 74, "纪律处分"),
    ("公开谴责", 74, "纪律处分"),
    ("纪律处分", 72, "纪律处分"),
    ("问询函", 70, "问询关注"),
    ("关注函", 68, "问询关注"),
    ("监管函", 68, "问询关注"),
    ("年报问询", 66, "问询关注"),
    ("股票交易异常波动", 60, "异常波动"),
    ("异常波动", 58, "异常波动"),
    ("严重异常波动", 65, "异常波动"),
    ("风险提示", 55, "风险提示"),
    ("退市风险", 85, "退市风险"),
    ("其他风险警示", 80, "退市风险"),
    ("暂停上市", 88, "退市风险"),
    ("终止上市", 90, "退市风险"),
    ("停牌", 50, "停复牌"),
    ("核查", 52, "问询关注"),
    ("自律监管", 70, "纪律处分"),
)
#: Pattern, category, replacement.
PHRASE_RULES = (
    (r"建议(立即|马上|尽快)?(买入|卖出|加仓|减仓|清仓|抄底|逃顶)", "投资建议", "从研究角度观察到"),
    (r"(强烈|重点)?推荐(买入|持有|关注该股|该股)", "投资建议", "研究上值得跟踪"),
    (r"(可以|可)(大胆|放心)?(买入|重仓|满仓|梭哈|上车)", "投资建议", "相关变化可作为研究观察点"),
    (r"(目标价|止损价|买入价|建仓价)\s*[:：]?\s*[\d.]+\s*元?", "价格指令", "（不提供目标价位）"),
    (r"(现价|回调至)?[\d.]+元?(以下|附近)可(买|入|建仓)", "价格指令", "（不提供买卖价位）"),
    (r"(明天|下周|下月|后市)(必|一定|肯定)(涨|跌|拉升|大涨)", "收益承诺", "后续走势存在不确定性"),
    (r"(必|一定|肯定|铁定|100%|百分百)(涨|跌|赚|盈利|翻倍)", "收益承诺", "存在向上/向下的可能性"),
    (r"(稳赚|包赚|稳赢)(不赔)?", "收益承诺", "（不涉及收益预测）"),
    (r"(保本|保收益|无风险|零风险)(套利)?", "收益承诺", "（不涉及收益承诺）"),
    (r"(涨停|翻倍|暴涨|暴富|十倍股|牛股)(在望|可期|无疑|确定)", "收益承诺", "价格走势存在不确定性"),
    (r"(闭眼|无脑)(买|入|抄)", "投资建议", "需自行独立判断"),
    (r"(内幕消息|小道消息|内部消息|独家消息|未公开信息)(显示|表明)?", "内幕信息", "公开信息显示"),
    (r"(主力|游资|机构)(已经)?(建仓|锁仓|控盘)完毕", "操纵暗示", "资金面数据出现变化"),
    (r"(跟(着|随)?(主力|游资|庄家))", "操纵暗示", "结合资金面数据观察"),
    (r"(拉升|出货|洗盘)(计划|时间表)", "操纵暗示", "价量变化"),
)


def normalised_title(title: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)\s+", " ")))


def dedupe_key(url: Column, source: Column, title: Column) -> Column:
    """16 hex digits: of the url, or of source and title where there is none."""
    url = F.trim(F.coalesce(url, F.lit("")))
    base = F.when(url != "", url).otherwise(F.concat(source, F.lit("::"), normalised_title(title)))
    return F.substring(F.sha1(F.encode(base, "UTF-8")), 1, 16)


def classify(title: Column, rules: Sequence[tuple[str, int, str]] = SEVERITY_RULES) -> Column:
    """struct<category, severity> of the severest word in the title, the first of equals; ("", 0) if none."""
    out = F.struct(F.lit("").alias("category"), F.lit(0).alias("severity"))
    for _, (word, severity, category) in sorted(enumerate(rules), key=lambda x: (x[1][1], -x[0])):
        out = F.when(title.contains(word), F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"))).otherwise(out)
    return out


def keyword_tags(title: Column, words: Sequence[str], most: int) -> Column:
    """The first ``most`` words of the list that the title contains."""
    return F.slice(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(title, w)), 1, most)


def scan(text: Column, rules: Sequence[tuple[str, str, str]] = PHRASE_RULES) -> Column:
    """array<struct<category, matched>> of all matches, rule by rule."""

    def matches(pattern: str, category: str) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda m: F.struct(F.lit(category).alias("category"), m.alias("matched")))

    return F.flatten(F.array(*[matches(p, c) for p, c, _ in rules]))


def rewrite(text: Column, rules: Sequence[tuple[str, str, str]] = PHRASE_RULES) -> Column:
    """The text with each rule's matches replaced, rule after rule on what the earlier ones left."""
    for pattern, _, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


#: Words of market signals, of each tag with its words, of an alert's tags, of hot announcements, of statistics.
SIGNAL_WORDS = ("拉升", "涨停", "跳水", "异动", "走强", "领涨", "大涨", "翻红", "封板", "涨超", "跌超", "创新高", "新高", "冲高")
FLASH_TAGS = (("题材", ("概念", "板块")), ("涨停", ("涨停", "封板")), ("回撤", ("跳水", "跌停", "跌超")), ("资金", ("北向", "外资")))
ALERT_TAGS = (("涨停", ("涨停",)), ("跌停", ("跌停",)), ("龙虎榜", ("龙虎榜",)))
HOT_WORDS = ("业绩预增", "业绩预告", "业绩快报", "回购", "增持", "减持", "中标", "重大合同", "重组", "收购", "停牌", "复牌", "问询函", "关注函", "立案", "分红", "解禁", "定增", "可转债")
INDICATOR_WORDS = ("采购经理指数", "PMI", "居民消费价格", "CPI", "工业生产者出厂价格", "PPI", "国内生产总值", "GDP", "工业增加值", "固定资产投资", "社会消费品零售", "房地产", "工业企业利润", "就业", "能源生产")


def is_signal(title: Column, words: Sequence[str] = SIGNAL_WORDS) -> Column:
    return F.coalesce(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(title, w)), F.lit(False))


def grouped_tags(title: Column, tags: Sequence[tuple[str, tuple[str, ...]]] = FLASH_TAGS, most: int = 3) -> Column:
    """The first ``most`` tags of which the title holds a word."""
    named = [F.when(is_signal(title, words), F.lit(tag)) for tag, words in tags]
    return F.slice(F.array_compact(F.array(*named)), 1, most)


def named_title(title: Column, stock: Column) -> Column:
    """The title, after the stock's name if it doesn't hold it."""
    name = F.coalesce(stock, F.lit(""))
    return F.when((name != "") & F.contains(title, name), title).otherwise(F.trim(F.concat_ws(" ", name, title)))


def document_title(content: Column, fallback: Column) -> Column:
    """The first level-1 or level-2 heading, else the fallback."""
    found = F.trim(F.regexp_extract(content, r"(?m)^\s*##?[ \t]+(\S.*)$", 1))
    return F.coalesce(F.nullif(found, F.lit("")), fallback)


def open_bracket(title: Column) -> Column:
    """A leading 【x】 as x｜."""
    return F.regexp_replace(title, r"^【(.*?)】\s*", "$1｜")


def without_alert_prefix(title: Column) -> Column:
    return F.regexp_replace(title, r"^异动快报[:：]\s*", "")


def without_emphasis(title: Column) -> Column:
    return F.regexp_replace(title, r"</?em>", "")


def reason_tags(reason: Column, most: int = 3) -> Column:
    """The first reasons of a list joined by +."""
    return F.slice(F.filter(F.split(reason, r"\+"), lambda r: r != ""), 1, most)


def joined(separator: str, *parts: Column) -> Column:
    """The parts that are there and not blank, joined."""
    return F.concat_ws(separator, *[F.nullif(F.trim(p), F.lit("")) for p in parts])
