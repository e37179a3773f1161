"""Feed payloads: wrapped JSON, RSS, HTML lists, announcements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What can't be read as JSON goes to ``_bad``.
ANNOUNCEMENT = "struct<_bad:string,art_code:string,title:string,display_time:string,codes:array<struct<stock_code:string,short_name:string>>,columns:array<struct<column_name:string>>>"


def unwrap_json(text: Column, schema: str) -> Column:
    """The JSON between the first brace and the last, as in ``var x={...};``."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def parse_announcements(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Rows (art_code, title, raw_time, code, stock, columns) of announcements; null and unreadable ones go."""
    a = F.from_json(payload, ANNOUNCEMENT, {"columnNameOfCorruptRecord": "_bad"})
    x = df.withColumn("_a", a).filter("_a is not null and _a._bad is null")
    first = F.try_element_at(F.col("_a.codes"), F.lit(1))
    return x.select(*[c for c in df.columns if c != payload], F.col("_a.art_code").alias("art_code"), F.col("_a.title").alias("title"), F.col("_a.display_time").alias("raw_time"), first["stock_code"].alias("code"), first["short_name"].alias("stock"), F.transform("_a.columns", lambda c: c["column_name"]).alias("columns"))


def parse_rss(df: DataFrame, xml: str = "xml", most: int = 30) -> DataFrame:
    """Items of a feed in order: title without CDATA marks, link, pubDate."""
    items = F.slice(F.regexp_extract_all(xml, F.lit(r"(?is)<item\b[^>]*>(.*?)</item>"), F.lit(1)), 1, most)
    x = df.select(*[c for c in df.columns if c != xml], F.posexplode(items).alias("ord", "_item"))
    tag = lambda t: F.trim(F.regexp_replace(F.regexp_extract("_item", rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1), r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", "$1"))
    return x.withColumns({"title": tag("title"), "url": tag("link"), "raw_time": tag("pubDate")}).drop("_item")


def parse_links(df: DataFrame, html: str = "html", base: str = "") -> DataFrame:
    """All ``<li>`` blocks with a link: text, absolute url and the leading stamp if there is one.

    A link without http goes below ``base``, parted by one slash.
    """
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<li\b[^>]*>(.*?)</li>"), F.lit(1))
    x = df.select(*[c for c in df.columns if c != html], F.posexplode(blocks).alias("ord", "_li"))
    href = F.regexp_extract("_li", r"(?is)<a\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    title = F.trim(F.regexp_replace(F.regexp_extract("_li", r"(?is)<a\b[^>]*>(.*?)</a>", 1), r"(?s)<[^>]*>", ""))
    stamp = F.regexp_extract("_li", r"^\s*(?:<[^>]*>\s*)*(\d{4}-\d{1,2}-\d{1,2}(?: \d{1,2}:\d{2}(?::\d{2})?)?)", 1)
    return x.filter(href != "").withColumns({"title": title, "url": absolute(href, base), "raw_time": stamp}).drop("_li")


def absolute(href: Column, base: str) -> Column:
    return F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(href, F.lit("/"))))


def parse_dated_links(df: DataFrame, html: str = "html", base: str = "", part: str = "/data/", least: int = 8) -> DataFrame:
    """Links in tables that hold a date: title, absolute url and the table's first date as raw_time.

    Takes links whose href holds ``part`` and whose text has ``least`` characters; tables without a date
    give none. Tables are those that hold no other table.
    """
    keep = [c for c in df.columns if c != html]
    tables = F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^>]*>((?:(?!</?table\b).)*)</table>"), F.lit(1))
    x = df.select(*keep, F.posexplode(tables).alias("block", "_table"))
    said = F.regexp_replace("_table", r"(?s)<[^>]*>", " ")
    x = x.withColumn("raw_time", F.regexp_extract(said, r"20\d{2}-\d{2}-\d{2}", 0)).filter("raw_time <> ''")
    x = x.select(*keep, "block", "raw_time", F.posexplode(F.regexp_extract_all("_table", F.lit(r"(?is)<a\b[^>]*>.*?</a>"), F.lit(0))).alias("ord", "_a"))
    href = F.regexp_extract("_a", r"(?is)^<a\b[^>]*\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    title = F.trim(F.regexp_replace("_a", r"(?s)<[^>]*>", ""))
    return x.filter(F.contains(href, F.lit(part)) & (F.length(title) >= least)).withColumns({"title": title, "url": absolute(href, base)}).drop("_a")


def union_feeds(*feeds: DataFrame) -> DataFrame:
    """All feeds in one table; columns that a feed lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), feeds)
