"""Snapshots of a market's lists: bond alerts, hot lists, heat of boards, intraday series.

A snapshot is named by a column such as its slot; only its top rows are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfeed.functions.columns import number
from quantfeed.functions.text import joined


def bond_alerts(bonds: DataFrame, snapshot: str, today: Column, move: float = 5.0, movers: int = 6, cheapest: int = 5) -> DataFrame:
    """Rows of ``bonds`` with kind and place: redeem (redeemed today), mover, low (cheapest double-low).

    Reads bond_id, quoted_at, redeem_day, change, price, dblow, status. A bond alerts once, in the first
    kind that takes it. Movers take the largest changes; a bond without a time holds its place there,
    but gives no row. Bonds in the low list trade normally (status 00) and have a price.
    """
    dated = F.col("quoted_at").isNotNull()
    x = bonds.withColumn("_redeem", F.coalesce(F.col("redeem_day") == today, F.lit(False)) & dated)
    moving = F.coalesce(F.abs("change") >= move, F.lit(False)) & ~F.col("_redeem")
    w = Window.partitionBy(snapshot)
    x = x.withColumn("_move", F.row_number().over(w.orderBy(F.desc(moving), F.desc(F.abs("change")), "bond_id"))).withColumn("_moving", moving)
    x = x.withColumn("_mover", F.col("_moving") & (F.col("_move") <= movers) & dated)
    valued = F.coalesce((F.col("price") > 0) & F.col("dblow").isNotNull() & (F.col("status") == "00"), F.lit(False)) & ~F.col("_redeem") & ~F.col("_mover")
    x = x.withColumn("_valued", valued).withColumn("_cheap", F.row_number().over(w.orderBy(F.desc("_valued"), "dblow", "bond_id")))
    low = F.col("_valued") & (F.col("_cheap") <= cheapest) & dated
    kind = F.when(F.col("_redeem"), "redeem").when(F.col("_mover"), "mover").when(low, "low")
    place = F.when(F.col("_mover"), F.col("_move")).when(low, F.col("_cheap"))
    return x.withColumns({"kind": kind, "place": place}).filter("kind is not null").drop("_redeem", "_move", "_moving", "_mover", "_valued", "_cheap")


def bond_line(name: Column, code: Column, change: Column, kind: Column) -> Column:
    """Title of an alert; only movers show their change."""
    moved = F.when((kind == "mover") & change.isNotNull(), F.format_string("%+.2f%%", change))
    return F.concat(F.concat_ws(" ", F.concat(name, F.lit("("), code.cast("string"), F.lit(")")), moved), F.lit(" · "), kind)


def limit_up_line(name: Column, code: Column, streak: Column, reason: Column) -> Column:
    """Title of a stock at its limit: name and code, then the streak and the reason where known."""
    return joined(" · ", F.concat(name, F.lit("("), code, F.lit(") 封板")), streak, reason)


def limit_up_details(change: Column, turnover: Column, amount: Column, openings: Column) -> Column:
    parts = [
        F.when(change.isNotNull(), F.format_string("涨幅 %.2f%%", change)),
        F.when(turnover.isNotNull(), F.format_string("换手 %.2f%%", turnover)),
        F.when(amount != 0, F.format_string("封单 %.2f亿", amount / 1e8)),
        F.when(openings != 0, F.format_string("开板 %d 次", openings)),
    ]
    return F.concat_ws("，", *parts)


def research_line(org: Column, title: Column) -> Column:
    """Title of a research report: after its house where known."""
    return joined("·", org, title)


def forecast_line(stock: Column, code: Column, org: Column, title: Column) -> Column:
    """Title of a forecast: stock with its code, house and title."""
    name = F.coalesce(F.trim(stock), F.lit(""))
    head = F.when((name != "") & (F.coalesce(F.trim(code), F.lit("")) != ""), F.concat(name, F.lit("("), F.trim(code), F.lit(")"))).otherwise(name)
    return F.trim(F.concat(head, F.lit(" "), F.coalesce(F.trim(org), F.lit("")), F.lit("·"), F.coalesce(F.trim(title), F.lit(""))))


def forecast_details(rating: Column, earnings: Column, ratio: Column) -> Column:
    said = lambda label, x: F.when(F.coalesce(F.trim(x), F.lit("")) != "", F.concat(F.lit(label), F.trim(x)))
    return F.concat_ws("，", said("评级 ", rating), said("今年EPS预测 ", earnings), said("对应PE ", ratio))


def _top(rows: DataFrame, snapshot: str, n: int, *order) -> DataFrame:
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(snapshot).orderBy(*order))).filter(F.col("_place") <= n)


def hot_list(rows: DataFrame, snapshot: str, n: int = 8, most_tags: int = 5) -> DataFrame:
    """One row per snapshot: leader, lines of the first n by ``position``, their first distinct tags.

    Reads position, name, code, change, tags (array).
    """
    shown = F.concat(F.col("name"), F.lit("("), F.col("code").cast("string"), F.lit(")"))
    line = F.concat_ws(" ", shown, F.when(F.col("change").isNotNull(), F.format_string("%+.2f%%", "change")))
    top = _top(rows, snapshot, n, "position").groupBy(snapshot)
    entry = F.struct(F.col("_place").alias("p"), line.alias("line"), F.col("name").alias("name"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    out = top.agg(F.array_sort(F.collect_list(entry)).alias("e"))
    tags = F.slice(F.array_distinct(F.flatten("e.tags")), 1, most_tags)
    return out.select(snapshot, F.col("e")[0]["name"].alias("leader"), F.array_join("e.line", "\n").alias("lines"), F.array_join(tags, "|").alias("tags"))


def board_heat(rows: DataFrame, snapshot: str, n: int = 6) -> DataFrame:
    """One row per snapshot: lines of the n boards that rose most, with inflow and leader where known.

    Reads board, change, inflow, leader. Equal changes are ordered by the board's name.
    """
    flow = F.when(F.col("inflow").isNotNull(), F.concat(F.format_string("（主力%+.2f亿", F.col("inflow") / 1e8), F.coalesce(F.concat(F.lit("，领涨"), F.nullif("leader", F.lit(""))), F.lit("")), F.lit("）")))
    line = F.concat(F.concat_ws(" ", "board", F.when(F.col("change").isNotNull(), F.format_string("%+.2f%%", "change"))), F.coalesce(flow, F.lit("")))
    out = _top(rows, snapshot, n, F.desc_nulls_last("change"), "board").groupBy(snapshot).agg(F.array_sort(F.collect_list(F.struct(F.col("_place").alias("p"), line.alias("line")))).alias("e"))
    return out.select(snapshot, F.array_join("e.line", "\n").alias("lines"))


def last_minute(series: DataFrame, name: str, at: str = "minute", value: str = "value") -> DataFrame:
    """(name, minute, net): the newest value of each series that isn't "-" or empty; 0 and non-numbers give no row."""
    given = series.filter(F.col(value).isNotNull() & ~F.trim(value).isin("-", ""))
    newest = given.groupBy(name).agg(F.max(at).alias(at), F.max_by(value, at).alias("_v"))
    return newest.select(name, at, number(F.col("_v")).alias("net")).filter("net is not null and net <> 0")
