"""Screened events, reviewed texts and merged reports."""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quantfeed.functions.text import PHRASE_RULES, SEVERITY_RULES, classify, document_title, named_title
from quantfeed.functions.timestamps import is_future


def detail_url(code: Column, art_code: Column, base: str) -> Column:
    """Page of an announcement below ``base``; ``base`` itself where the code or the number is missing."""
    known = (F.coalesce(code, F.lit("")) != "") & (F.coalesce(art_code, F.lit("")) != "")
    return F.when(known, F.concat(F.lit(f"{base}detail/"), code, F.lit("/"), art_code, F.lit(".html"))).otherwise(base)


def holds_word(words: Column, *texts: Column, least: int = 1) -> Column:
    """Whether one of the words (an array) with ``least`` characters is in one of the texts."""
    found = lambda w: reduce(lambda a, b: a | b, [F.coalesce(F.contains(t, w), F.lit(False)) for t in texts])
    return F.coalesce(F.exists(words, lambda w: (F.length(w) >= least) & found(w)), F.lit(False))


def screened(announcements: DataFrame, ref: Column, days: int = 30, rules=SEVERITY_RULES, base: str = "notices/", words: tuple[str, ...] = (), codes: DataFrame | None = None) -> DataFrame:
    """Announcements (ord, title, published_at, code, stock, art_code) with url, category, severity and state.

    state: the first that holds of blank (no title), other (names no regulatory event), no_time (also
    for stamps ahead of ref), stale, unlinked (codes or words are given, and its code is not among them
    and no word in its title or stock name), repeat (an earlier row that got as far has the page), kept.
    Kept titles begin with the stock's name unless they hold it.
    """
    x = announcements.withColumn("title", F.trim(F.coalesce("title", F.lit("")))).withColumn("_event", classify(F.col("title"), rules))
    old = F.unix_micros("published_at") < F.unix_micros(ref) - days * 86_400_000_000
    linked_to = F.lit(True)
    if words or codes is not None:
        linked_to = holds_word(F.array(*map(F.lit, words)).cast("array<string>"), F.col("title"), F.col("stock"))
        if codes is not None:
            x = x.join(codes.select("code").distinct().withColumn("_own", F.lit(True)), "code", "left")
            linked_to = linked_to | F.coalesce("_own", F.lit(False))
    state = (
        F.when(F.col("title") == "", "blank")
        .when(F.col("_event.severity") == 0, "other")
        .when(F.col("published_at").isNull() | is_future(F.col("published_at"), ref), "no_time")
        .when(old, "stale")
        .when(~linked_to, "unlinked")
        .otherwise("kept")
    )
    x = x.withColumns({"state": state, "url": detail_url(F.col("code"), F.col("art_code"), base), "category": F.col("_event.category"), "severity": F.col("_event.severity")})
    # The first row of each page comes from an aggregation, so a page that comes often meets in no task.
    first = x.filter((F.col("state") == "kept") & (F.col("url") != base)).groupBy("url").agg(F.min("ord").alias("_first"))
    x = x.join(first, "url", "left")
    repeat = (F.col("state") == "kept") & (F.col("ord") > F.col("_first"))
    x = x.withColumn("state", F.when(repeat, "repeat").otherwise(F.col("state")))
    return x.withColumn("title", F.when(F.col("state") == "kept", named_title(F.col("title"), F.col("stock"))).otherwise(F.col("title"))).drop("_event", "_first", "_own")


def screening_counters(screened_rows: DataFrame) -> DataFrame:
    """One row: scanned, dropped_no_time, dropped_stale and events."""
    named = {"dropped_no_time": "no_time", "dropped_stale": "stale", "events": "kept"}
    return screened_rows.agg(F.count("*").alias("scanned"), *[F.count_if(F.col("state") == v).alias(k) for k, v in named.items()])


def risk_level(severity: Column) -> Column:
    return F.when(severity.isNull(), "low").when(severity >= 85, "high").when(severity >= 65, "medium").otherwise("lowish")


def linked(events: DataFrame, holdings: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """Adds held (its code is among the holdings), named (its title or stock holds a word of two characters or more) and focus."""
    own = holdings.select("code").distinct().withColumn("_own", F.lit(True))
    named = holds_word(F.array(*map(F.lit, words)).cast("array<string>"), F.col("title"), F.col("stock"), least=2)
    x = events.join(own, "code", "left").withColumn("held", F.coalesce("_own", F.lit(False))).drop("_own").withColumn("named", named)
    return x.withColumn("focus", F.col("held") | F.col("named"))


def background(events: DataFrame, focus: DataFrame, key: str = "ord") -> DataFrame:
    """The events that aren't among the focus."""
    return events.join(focus.select(key), key, "left_anti")


def top_events(events: DataFrame, within: str, n: int) -> DataFrame:
    """The severest events of each group, newest first among equals."""
    w = Window.partitionBy(within).orderBy(F.desc("severity"), F.desc("published_at"), "ord")
    return events.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def _categorised(matches: Column, category: str) -> Column:
    return F.transform(matches, lambda m: F.struct(F.lit(category).alias("category"), m.alias("matched")))


def reviewed(texts: DataFrame, text: str = "text", rules=PHRASE_RULES) -> DataFrame:
    """Adds hits (array of category and match) and rewritten: rule after rule on what earlier ones left.

    A rule's hits are those in the text that the rules before it wrote. Null texts have no hits. Only
    texts with some rule's match are worked on: without one, no rule changes anything.
    """
    any_rule = "|".join(f"(?:{p})" for p, _, _ in rules)
    x = texts.withColumn("_hit", F.coalesce(F.col(text).rlike(any_rule), F.lit(False))).withColumn("_t", F.col(text))
    found = []
    for i, (pattern, category, replacement) in enumerate(rules):
        matches = _categorised(F.regexp_extract_all("_t", F.lit(pattern), F.lit(0)), category)
        x = x.withColumns({f"_m{i}": F.when(F.col("_hit"), matches), "_t": F.when(F.col("_hit"), F.regexp_replace("_t", pattern, replacement)).otherwise(F.col("_t"))})
        found.append(F.coalesce(f"_m{i}", F.array().cast("array<struct<category:string,matched:string>>")))
    return x.withColumns({"hits": F.flatten(F.array(*found)), "rewritten": F.col("_t")}).drop("_hit", "_t", *[f"_m{i}" for i in range(len(rules))])


def _sha(content: str) -> Column:
    return F.sha2(F.coalesce(content, F.lit("")), 256)


def distinct_documents(docs: DataFrame, order: str = "doc_id", content: str = "text") -> DataFrame:
    """(order, sha, size, duplicate_of): the first document of each content has no duplicate_of.

    Only hashes are shuffled. Whole hashes decide, sha shows 12 digits. First ids come from an
    aggregation, so many copies don't meet in a task.
    """
    x = docs.select(order, _sha(content).alias("_sha"), F.coalesce(F.length(content), F.lit(0)).alias("size"))
    first = x.groupBy("_sha").agg(F.min(order).alias("_first"))
    return x.join(first, "_sha").select(order, F.substring("_sha", 1, 12).alias("sha"), "size", F.when(F.col(order) != F.col("_first"), F.col("_first")).alias("duplicate_of"))


def without_first_heading(content: Column) -> Column:
    return F.regexp_replace(content, r"^\s*# [^\n]*\n?", "")


def merged(docs: DataFrame, group: str, order: str = "doc_id", content: str = "text") -> DataFrame:
    """The merged report of each group as rows (group, order, size, section), one per distinct document.

    A group's text is its sections by ``order``, parted by blank lines; it is never put into one row.
    """
    x = docs.withColumn("_sha", _sha(content))
    first = x.groupBy("_sha").agg(F.min(order).alias(order))
    section = F.concat(F.lit("## "), document_title(F.col(content), F.col(order).cast("string")), F.lit("\n\n"), without_first_heading(F.coalesce(content, F.lit(""))))
    kept = x.join(first, ["_sha", order], "left_semi")
    return kept.select(group, order, F.coalesce(F.length(content), F.lit(0)).alias("size"), section.alias("section"))


def merged_totals(sections: DataFrame, group: str, order: str = "doc_id") -> DataFrame:
    """(group, sources, total_chars, digest) of merged reports; digest is the MD5 of a group's text.

    MD5 reads a text from its start to its end, so a group's sections run through one task. They
    are sorted on disk and hashed as they come; the task holds a batch of them at a time.
    """

    def run(batches):
        at, md5, n, chars = None, None, 0, 0
        for batch in batches:
            for g, size, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if md5 is None or g != at:
                    if md5 is not None:
                        yield row(at, n, chars, md5)
                    at, md5, n, chars = g, hashlib.md5(), 0, 0
                if n:
                    md5.update(b"\n\n")
                md5.update(text.encode("utf-8", "surrogatepass"))
                n, chars = n + 1, chars + size
        if md5 is not None:
            yield row(at, n, chars, md5)

    def row(g, n, chars, md5):
        return pa.RecordBatch.from_arrays([pa.array([g], kind), pa.array([n], pa.int64()), pa.array([chars], pa.int64()), pa.array([md5.hexdigest()])], [group, "sources", "total_chars", "digest"])

    kind = to_arrow_type(sections.schema[group].dataType)
    out = T.StructType([sections.schema[group]]).add("sources", "long").add("total_chars", "long").add("digest", "string")
    x = sections.repartition(group).sortWithinPartitions(group, order, "section").select(group, "size", "section")
    return x.mapInArrow(run, out)


def merge_topic(titles: Column, given: Column) -> Column:
    """The given topic, else one made of the first two titles; null or no titles: the given one."""
    n = F.size(titles)
    made = F.when(n == 1, F.concat(titles[0], F.lit("（合并版）"))).otherwise(F.concat(F.array_join(F.slice(titles, 1, 2), " + "), F.lit(" 等 "), n.cast("string"), F.lit(" 份报告合并分析")))
    return F.coalesce(F.nullif(F.trim(given), F.lit("")), F.when(n > 0, made), given)


def joined_topics(topics: Column, given: Column) -> Column:
    """The given topic, else the distinct topics in their order; empty if there is none."""
    clean = F.filter(F.transform(F.coalesce(topics, F.array().cast("array<string>")), lambda t: F.trim(F.coalesce(t, F.lit("")))), lambda t: t != "")
    return F.when(F.size(clean) == 0, "").otherwise(F.coalesce(F.nullif(F.trim(given), F.lit("")), F.array_join(F.array_distinct(clean), " + ")))


#: Sections and lines of a report that aren't pushed, and the heading of a merged source.
PUSH_SECTIONS = ("目录", "合并说明与来源追溯")
PUSH_SECTION_WORDS = ("免费开源金融数据库", "因子库构建与数学公式", "数据清洗与特征工程", "Prompt 架构", "投研检查清单")
PUSH_LINE_WORDS = ("免费开源金融数据库", "多因子库设计", "数据预处理与 A 股特征工程", "防空泛 AI 研报 Prompt", "方法论层", "接入规范与代码实现")
PUSH_LINE_STARTS = ("> **合并时间**", "> **文件名**")
SOURCE_HEADING = r"^#{1,2}\s+原始报告\s*\d+\s*[：:]\s*(.+?)\s*#*\s*$"


def pushed_lines(docs: DataFrame, order: str = "doc_id", content: str = "text") -> DataFrame:
    """Lines (order, pos, line) of reports as they are pushed: headings of merged sources show the source's title."""
    x = report_lines(docs, PUSH_SECTIONS, PUSH_SECTION_WORDS, PUSH_LINE_WORDS, PUSH_LINE_STARTS, order, content)
    title = F.regexp_extract(F.trim("line"), SOURCE_HEADING, 1)
    return x.withColumn("line", F.when(title != "", F.concat(F.lit("## "), title)).otherwise(F.col("line")))


def report_lines(docs: DataFrame, section_titles: tuple[str, ...] = (), section_words: tuple[str, ...] = (), line_words: tuple[str, ...] = (), line_starts: tuple[str, ...] = (), order: str = "doc_id", content: str = "text") -> DataFrame:
    """Lines (order, pos, line) of reports without fenced blocks, unwanted sections and unwanted lines.

    A section reaches from a heading of level 1 or 2 to the next. It goes if its title is listed or
    holds a listed word. Headings inside fences don't count. One pass over each report's lines.
    """
    x = docs.select(order, F.posexplode(F.split(F.coalesce(content, F.lit("")), r"\r\n|\n|\r")).alias("pos", "line"))
    w = Window.partitionBy(order).orderBy("pos")
    fence = F.col("line").rlike(r"^\s*(```|~~~)\s*([\w.+-]*)\s*$")
    x = x.withColumn("_fence", fence).withColumn("_fences", F.sum(fence.cast("int")).over(w))
    outside = ~F.col("_fence") & (F.col("_fences") % 2 == 0)
    title = F.regexp_extract(F.trim("line"), r"^#{1,2}\s+(.+?)\s*#*\s*$", 1)
    heads = outside & (title != "")
    unwanted = title.isin(*section_titles) if section_titles else F.lit(False)
    for word in section_words:
        unwanted = unwanted | title.contains(word)
    x = x.withColumn("_skip", F.coalesce(F.last(F.when(heads, unwanted), ignorenulls=True).over(w), F.lit(False)))
    keep = outside & ~F.col("_skip")
    for start in line_starts:
        keep = keep & ~F.ltrim("line").startswith(start)
    for word in line_words:
        keep = keep & ~F.col("line").contains(word)
    return x.filter(keep).select(order, "pos", "line")
