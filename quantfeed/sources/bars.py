"""Daily bars from k-line strings, chart payloads and trades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfeed.functions.columns import number


def vwap(amount: Column, volume: Column, close: Column, lot: float = 100.0) -> Column:
    return F.when((amount > 0) & (volume > 0), amount / (volume * lot)).otherwise(close)


def parse_kline(df: DataFrame, line: str = "line") -> DataFrame:
    """Bars from ``day,open,close,high,low,volume,amount,amplitude,change%,change,turnover%``.

    Short lines and those with a bad date or price go; amount, change and turnover count 0 if absent.
    """
    f = F.split(line, ",")
    at = lambda i: F.try_element_at(f, F.lit(i + 1))
    loose = lambda i: F.when(F.coalesce(F.trim(at(i)), F.lit("")).isin("", "-"), 0.0).otherwise(number(at(i)))
    x = df.filter(F.size(f) >= 6).withColumns(
        {"day": F.try_to_date(at(0), "yyyy-MM-dd"), **{c: number(at(i + 1)) for i, c in enumerate(("open", "close", "high", "low", "volume"))}, "amount": loose(6), "change": loose(8), "turnover": loose(10)}
    )
    bad = [F.col(c).isNull() for c in ("day", "open", "close", "high", "low", "volume", "amount", "change", "turnover")]
    x = x.filter(~F.exists(F.array(*bad), lambda b: b)).drop(line)
    return x.withColumn("vwap", vwap(F.col("amount"), F.col("volume"), F.col("close")))


#: Charts' days are those of a clock eight hours ahead of UTC.
CHART_ZONE_SECONDS = 8 * 3600
CHART = "struct<timestamp:array<bigint>,open:array<double>,high:array<double>,low:array<double>,close:array<double>,volume:array<double>,adjclose:array<double>>"


def explode_chart(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Bars from JSON with parallel arrays, prices adjusted by adjclose / close, volume in lots.

    Rows without a close or time go; the session's time zone is UTC.
    """
    j = F.from_json(payload, CHART)
    x = df.withColumn("_j", j)
    x = x.select(*[c for c in df.columns if c != payload], F.inline(F.arrays_zip(*[F.col(f"_j.{c}").alias(c) for c in ("timestamp", "open", "high", "low", "close", "volume", "adjclose")])))
    x = x.filter("timestamp is not null and close is not null")
    ratio = F.coalesce(F.try_divide(F.nullif("adjclose", F.lit(0.0)), F.col("close")), F.lit(1.0))
    prices = {c: F.coalesce(c, F.col("close")) * ratio for c in ("open", "high", "low")}
    return x.withColumns({**prices, "close": F.col("close") * ratio, "day": F.to_date(F.timestamp_seconds(F.col("timestamp") + CHART_ZONE_SECONDS)), "volume": F.coalesce(F.col("volume") / 100, F.lit(0.0))}).drop("timestamp", "adjclose")


def with_change(bars: DataFrame, by: str = "code", order: str = "day") -> DataFrame:
    """Adds change, the day's in percent of the close before; 0 for the first row and after a close of 0."""
    before = F.lag("close").over(Window.partitionBy(by).orderBy(order))
    return bars.withColumn("change", F.coalesce((F.try_divide(F.col("close"), before) - 1) * 100, F.lit(0.0)))


def from_trades(trades: DataFrame, added: tuple[str, ...] = (), dealt: str | None = None) -> DataFrame:
    """Bars (code, day, open, close, high, low, volume, amount, vwap) from lineitem rows as trades.

    Trades follow each other by order and line; of several with the same order and line the cheapest comes first.
    The last digits of a sum of doubles depend on their order: with columns ``added`` a bar's trades are added up in the order
    of these, so that sums don't change with the layout of tasks. ``dealt``: the trades are dealt by this key alone
    ("code"), so that what goes by it afterwards needs no shuffle of its own; for tables with few trades a bar, as none are
    put together before they travel.
    """
    x = trades.select(F.col("l_suppkey").alias("code"), F.to_date("l_shipdate").alias("day"), "l_quantity", "l_extendedprice", "l_orderkey", "l_linenumber", *added)
    if added or dealt:
        x = x.repartition(*([dealt] if dealt else ["code", "day"])).sortWithinPartitions("code", "day", *added)
    at = F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
    bars = x.withColumn("at", at).groupBy("code", "day").agg(
        F.min_by("l_extendedprice", "at").alias("open"),
        F.max_by("l_extendedprice", "at").alias("close"),
        F.max("l_extendedprice").alias("high"),
        F.min("l_extendedprice").alias("low"),
        F.sum("l_quantity").alias("volume"),
        F.sum("l_extendedprice").alias("amount"),
    )
    return bars.withColumn("vwap", vwap(F.col("amount"), F.col("volume"), F.col("close"), lot=1.0))
