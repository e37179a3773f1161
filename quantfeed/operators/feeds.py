"""Feed items: validity with counted reasons, limits, ordering, caps and the ledger of sent keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfeed.functions.text import normalised_title, without_alert_prefix
from quantfeed.functions.timestamps import is_fresh, is_future
from quantfeed.sources.tables import written_down

#: Hours that a sent key is remembered, and the most keys kept.
LEDGER_HOURS, LEDGER_KEYS = 72, 20_000
#: Items are put in order by slots of so many seconds.
SLOT_SECONDS = 600


def drop_reason(ref: Column, window_minutes: int, seen: Column, date_allowed: Column) -> Column:
    """Why an item goes, the first reason that holds; null if it stays.

    Reads title, published_at and time_quality. A date without a time counts as no time where the
    source doesn't allow it; a blank title goes uncounted.
    """
    ts, quality = F.col("published_at"), F.col("time_quality")
    return (
        F.when(normalised_title(F.col("title")) == "", "blank")
        .when(ts.isNull() | (quality == "missing"), "no_time")
        .when(is_future(ts, ref), "future")
        .when((quality == "date") & ~date_allowed, "no_time")
        .when(~is_fresh(ts, ref, window_minutes), "stale")
        .when(seen, "seen")
    )


def active(items: DataFrame, sources: DataFrame, chosen: tuple[str, ...] = ()) -> DataFrame:
    """Items of sources that aren't disabled, and that are chosen if any are; adds the source's date_only.

    ``sources``: a row (source, disabled, date_only) for each; items of others aren't taken.
    """
    on = sources.filter(~F.coalesce("disabled", F.lit(False)))
    if chosen:
        on = on.filter(F.col("source").isin(*chosen))
    return items.join(on.select("source", F.coalesce("date_only", F.lit(False)).alias("date_only")), "source")


def judged(items: DataFrame, ledger: DataFrame, ref: Column, window_minutes: int, limit: int = 0, date_allowed: Column | None = None) -> DataFrame:
    """Items (source, ord, key, ...) with reason and kept, in collection order up to each source's limit.

    Rows after a source's ``limit``-th valid one aren't looked at: they are neither kept nor dropped for
    a reason, only fetched (reason ``unread``). The running count of valid rows is taken per block of
    the order, so a source's rows may be spread out.
    """
    sent = ledger.select("key").distinct().withColumn("_seen", F.lit(True))
    allowed = F.lit(False) if date_allowed is None else date_allowed
    x = items.join(sent, "key", "left").withColumn("reason", drop_reason(ref, window_minutes, F.coalesce("_seen", F.lit(False)), allowed)).drop("_seen")
    x = x.withColumn("kept", F.col("reason").isNull())
    if not limit:
        return x
    x = written_down(x)
    block = F.floor(F.col("ord") / 4096)
    x = x.withColumn("_block", block)
    counts = x.groupBy("source", "_block").agg(F.count_if("kept").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = Window.partitionBy("source", "_block").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    x = x.join(counts.withColumn("_before", before).drop("_c"), ["source", "_block"])
    nth = F.col("_before") + F.count_if("kept").over(inside)
    x = x.withColumn("_nth", nth).withColumn("_read", (F.col("_nth") < limit) | ((F.col("_nth") == limit) & F.col("kept")))
    x = x.withColumns({"reason": F.when(F.col("_read"), F.col("reason")).otherwise("unread"), "kept": F.col("kept") & F.col("_read")})
    return x.drop("_block", "_before", "_nth", "_read")


def counters(judged_items: DataFrame) -> DataFrame:
    """Per source: fetched (all that came in), kept and each counted reason."""
    named = {"dropped_no_time": "no_time", "dropped_future": "future", "dropped_stale": "stale", "dropped_seen": "seen"}
    return judged_items.groupBy("source").agg(F.count("*").alias("fetched"), F.count_if("kept").alias("kept"), *[F.count_if(F.col("reason") == r).alias(k) for k, r in named.items()])


def newest_first(kept: DataFrame) -> DataFrame:
    """Adds each item's place in its source, newest first, then collection order; items without a time come last.

    Counts per slot of SLOT_SECONDS give each slot its first place, so only a slot's items are sorted.
    """
    at = F.coalesce(F.floor(F.unix_micros("published_at") / (SLOT_SECONDS * 1_000_000)), F.lit(-(2**62)))
    x = kept.withColumn("_slot", at)
    counts = x.groupBy("source", "_slot").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("source").orderBy(F.desc("_slot"))) - F.col("_n")).drop("_n")
    inside = Window.partitionBy("source", "_slot").orderBy(F.desc("published_at"), "ord")
    x = x.withColumn("_inside", F.row_number().over(inside)).join(before, ["source", "_slot"])
    return x.withColumn("place", F.col("_before") + F.col("_inside")).drop("_slot", "_inside", "_before")


def capped(placed: DataFrame, sources: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` items with sources in rank order; 0: all.

    Counts per source give every source its first number, so no window runs over all items.
    """
    if not cap:
        return placed
    placed = placed.filter(F.col("place") <= cap)
    counts = placed.groupBy("source").agg(F.count("*").alias("_n")).join(sources.select("source", "rank"), "source")
    first = counts.withColumn("_first", F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy("rank", "source")) - F.col("_n"))
    return placed.join(first.select("source", "_first"), "source").filter(F.col("_first") + F.col("place") <= cap).drop("_first")


def signals_first(items: DataFrame) -> DataFrame:
    """Adds each item's place in its source: signals first, then newest, then collection order.

    Reads signal (boolean). Signals and others are placed apart, so a source's items meet in slots only.
    """
    x = newest_first(items.withColumn("_source", F.col("source")).withColumn("source", F.concat_ws("\x00", "source", F.when(F.col("signal"), "0").otherwise("1"))))
    x = x.withColumn("source", F.col("_source")).drop("_source")
    ahead = items.groupBy("source").agg(F.count_if("signal").alias("_ahead"))
    return x.join(ahead, "source").withColumn("place", F.col("place") + F.when(F.col("signal"), 0).otherwise(F.col("_ahead"))).drop("_ahead")


def digest_head(kept: DataFrame, sources: DataFrame) -> DataFrame:
    """One row (total, source, ord, title, published_at): how many items, and the newest of them.

    Of equal stamps the source with the lower rank comes first, then the item collected first.
    """
    x = kept.join(sources.select("source", "rank"), "source")
    order = F.struct("published_at", (-F.col("rank")).alias("r"), (-F.col("ord")).alias("o"))
    top = x.agg(F.count("*").alias("total"), F.max_by(F.struct("source", "ord", "title", "published_at"), order).alias("_top"))
    return top.select("total", "_top.*")


def distinct_titles(items: DataFrame) -> DataFrame:
    """One item of each title and source, the first in collection order; a repeated-alert prefix doesn't count.

    First places come from an aggregation, so a title that comes a million times meets in no task.
    """
    x = items.withColumn("title", without_alert_prefix(F.trim(F.coalesce("title", F.lit(""))))).filter("title <> ''")
    first = x.groupBy("source", "title").agg(F.min("ord").alias("ord"))
    return x.join(first, ["source", "title", "ord"], "left_semi")


def updated_ledger(ledger: DataFrame, sent: DataFrame, ref: Column, hours: int = LEDGER_HOURS, most: int = LEDGER_KEYS) -> DataFrame:
    """Keys with the time they were first seen: recent ones only, at most the newest ``most``."""
    rows = ledger.select("key", "first_seen").unionByName(sent.select("key", ref.alias("first_seen")))
    first = rows.filter("key is not null and first_seen is not null").groupBy("key").agg(F.min("first_seen").alias("first_seen"))
    fresh = first.filter(F.unix_micros("first_seen") >= F.unix_micros(ref) - hours * 3_600_000_000)
    return fresh.orderBy(F.desc("first_seen"), "key").limit(most)


def slot(ts: Column, minutes: int) -> Column:
    """Start of the slot of so many minutes that holds the stamp."""
    return F.timestamp_micros(F.unix_micros(ts) - F.pmod(F.unix_micros(ts), F.lit(minutes * 60_000_000)))
