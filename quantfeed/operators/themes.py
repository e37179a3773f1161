"""Topics of a request: words to look boards up by, policy words in them, benchmarks they point at."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words too common to find a board by.
STOP_WORDS = (
    "分析", "研判", "行情", "板块", "概念", "题材", "个股", "股票", "市场", "走势", "复盘", "研究", "报告", "投资", "机会", "风险", "今日", "近期",
    "最新", "怎么样", "如何", "点评", "监管", "监督", "管理", "因子", "量化", "的", "了", "与", "和", "及",
)
# Words of regulation.
POLICY_WORDS = (
    "证监会", "交易所", "沪深交易所", "北交所", "国务院", "人民银行", "金融监管总局", "新规", "征求意见", "管理办法", "实施细则", "指引", "自律规则", "退市新规",
    "程序化交易", "量化交易", "融券", "转融通", "减持新规", "分红", "回购增持", "信息披露", "内幕交易", "操纵市场", "财务造假", "严监管",
)
# Words that name a broad index, and the two indices shown where none is named.
INDEX_HINTS = (
    ("1.000001", ("上证", "沪指", "大盘", "A股", "两市", "市场")),
    ("0.399001", ("深证", "深成指")),
    ("0.399006", ("创业板",)),
    ("1.000300", ("沪深300", "300")),
)
DEFAULT_INDICES = ("0.399006", "1.000001")

#: Lengths of the pieces cut from a long chunk.
PIECES = (4, 3, 2)


def _pieces(chunk: Column, size: int) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.length(chunk) - size + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.substr(chunk, i, F.lit(size)))


def theme_words(topic: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Distinct words of a topic, longest first, in their order among equals; null gives none.

    Chunks between commas, stops and white space; Chinese chunks of over 4 characters also give their
    pieces of 4, 3 and 2. Stop words go.
    """
    chunks = F.split(F.regexp_replace(F.coalesce(topic, F.lit("")), r"(?U)[，。、,.\s]+", " "), " ")
    chunks = F.filter(chunks, lambda c: (c != "") & ~c.isin(*stop_words))

    def words(chunk: Column) -> Column:
        cut = F.filter(F.concat(*[_pieces(chunk, n) for n in PIECES]), lambda p: ~p.isin(*stop_words))
        return F.when((F.length(chunk) > 4) & chunk.rlike("[一-鿿]"), F.concat(F.array(chunk), cut)).otherwise(F.array(chunk))

    every = F.array_distinct(F.flatten(F.transform(chunks, words)))
    placed = F.array_sort(F.transform(every, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w"))))
    return F.transform(placed, lambda e: e["w"])


def policy_hits(topic: Column, words: tuple[str, ...] = POLICY_WORDS) -> Column:
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.coalesce(topic, F.lit("")), w))


def hinted_indices(topic: Column) -> Column:
    """Ids of the indices that a topic names, sorted; the default pair if it names none."""
    text = F.coalesce(topic, F.lit(""))
    named = [F.when(F.greatest(*[F.contains(text, F.lit(w)) for w in (*words, words[0])]), F.lit(index)) for index, words in INDEX_HINTS]
    found = F.array_sort(F.array_compact(F.array(*named)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, DEFAULT_INDICES)))
