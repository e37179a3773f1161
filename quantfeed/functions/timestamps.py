"""Timestamps in mixed notations, graded by how far they can be trusted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Minutes that a stamp may lie ahead of the reference time.
FUTURE_MINUTES = 10
# Shapes of a text with a time of day, and of one with a date only.
EXACT_SHAPES = (
    r"\d{4}-\d{1,2}-\d{1,2}[ T]\d{1,2}:\d{1,2}:\d{1,2}",
    r"\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}",
    r"\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{1,2}(:\d{1,2})?",
    r"\d{4}年\d{1,2}月\d{1,2}日 \d{1,2}:\d{1,2}",
    r"\d{14}",
)
DATE_SHAPES = (r"\d{4}-\d{1,2}-\d{1,2}", r"\d{4}/\d{1,2}/\d{1,2}", r"\d{4}年\d{1,2}月\d{1,2}日", r"\d{8}")
YEARLESS_SHAPE = r"^\d{1,2}[-/月]\d{1,2}日?[ T]+\d{1,2}:\d{2}(:\d{2})?$"
TIME_SHAPE = r"^\d{1,2}:\d{2}(:\d{2})?$"
#: Seconds of the units in "N units ago".
UNIT_SECONDS = {"秒": 1, "分": 60, "分钟": 60, "小时": 3600, "天": 86400, "周": 604800}
JUST_NOW = ("刚刚", "刚才", "just now")
PREFIX = r"^(发布时间|时间|更新时间|发表于|于)[:：]?\s*"


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used; keeps the generated code small."""
    return F.transform(F.array(value), use)[0]


def _absolute(text: Column, numbers: Column, ref: Column) -> Column:
    """struct<ts, quality> of a text that names a date, a day and time, or a time."""
    n = [F.coalesce(F.try_element_at(numbers, F.lit(i)), F.lit(0)) for i in range(1, 7)]
    exact, dated = text.rlike(f"^({'|'.join(EXACT_SHAPES)})$"), text.rlike(f"^({'|'.join(DATE_SHAPES)})$")
    latest = F.timestamp_micros(F.unix_micros(ref) + FUTURE_MINUTES * 60_000_000)
    whole = F.when(n[5] < 60, F.try_make_timestamp(*n))
    yearless = _bound(F.try_make_timestamp(F.year(ref), *n[:5]), lambda this: F.when(this <= latest, this).otherwise(F.try_make_timestamp(F.year(ref) - 1, *n[:5])))
    today = F.try_make_timestamp(F.year(ref), F.month(ref), F.day(ref), *n[:3])
    timed = _bound(today, lambda at: F.when(at > latest, at - F.expr("INTERVAL 1 DAY")).otherwise(at))
    ts = F.when(exact | dated, whole).when(text.rlike(YEARLESS_SHAPE), yearless).when(text.rlike(TIME_SHAPE), timed)
    return F.struct(ts.alias("ts"), F.when(dated, "date").otherwise("exact").alias("quality"))


def parse(raw: Column, ref: Column) -> Column:
    """struct<ts, quality, raw> of a text. ``ref`` is the time it was read; never the wall clock.

    quality is exact, date (no time of day), derived (relative to ref) or missing.
    """
    raw = F.coalesce(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), F.lit(""))
    seconds = F.create_map(*[F.lit(x) for kv in UNIT_SECONDS.items() for x in kv])

    def graded(raw: Column) -> Column:
        epoch = F.when(raw.rlike(r"^(\d{10}|\d{13})$"), raw.try_cast("double"))
        from_epoch = F.timestamp_micros((F.when(epoch > 1e11, epoch / 1000).otherwise(epoch) * 1_000_000).cast("long"))
        ago = r"(?U)^(\d+)\s*(秒|分钟|分|小时|天|周)前$"
        passed = F.regexp_extract(raw, ago, 1).try_cast("long") * F.try_element_at(seconds, F.regexp_extract(raw, ago, 2))
        relative = F.when(raw.isin(*JUST_NOW), ref).when(raw.rlike(ago), F.timestamp_micros(F.unix_micros(ref) - passed * 1_000_000))
        text = F.trim(F.regexp_replace(F.regexp_replace(raw, PREFIX, ""), r"(?U)\s+", " "))
        text = F.regexp_replace(text, r"^(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}):\d{1,3}$", "$1")
        # All shapes give their numbers in one way; the shape says what they mean.
        spread = lambda t: F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})(?:(\d{2})(\d{2})(\d{2}))?$", "$1-$2-$3-$4-$5-$6")
        numbers = lambda t: F.transform(F.split(F.regexp_replace(spread(t), "[^0-9]+", "-"), "-"), lambda x: x.try_cast("int"))
        absolute = _bound(text, lambda t: _bound(numbers(t), lambda n: _absolute(t, n, ref)))
        stamp = lambda ts, quality: F.when(ts.isNotNull(), F.struct(ts.alias("ts"), F.lit(quality).alias("quality")))
        return F.coalesce(_bound(from_epoch, lambda x: stamp(x, "exact")), _bound(relative, lambda x: stamp(x, "derived")), absolute)

    found = _bound(raw, lambda r: F.struct(graded(r).alias("p"), r.alias("raw")))
    return _bound(found, lambda f: F.struct(f["p"]["ts"].alias("ts"), F.when(f["p"]["ts"].isNull(), "missing").otherwise(f["p"]["quality"]).alias("quality"), f["raw"].alias("raw")))


def is_future(ts: Column, ref: Column) -> Column:
    return F.unix_micros(ts) > F.unix_micros(ref) + FUTURE_MINUTES * 60_000_000


def is_fresh(ts: Column, ref: Column, window_minutes: int) -> Column:
    """ref - window <= ts <= ref + tolerance, both ends included."""
    return (F.unix_micros(ts) >= F.unix_micros(ref) - window_minutes * 60_000_000) & ~is_future(ts, ref)


def age_minutes(ts: Column, ref: Column) -> Column:
    """Whole and broken minutes from ts to ref; negative ahead of it."""
    return (F.unix_micros(ref) - F.unix_micros(ts)) / 60_000_000


def readable_age(ts: Column, ref: Column) -> Column:
    """How long ago a stamp is, in words; a stamp more than a minute ahead is shown by its clock or date."""
    minutes = (F.unix_micros(ref) - F.unix_micros(ts)) / 60_000_000
    days = F.datediff(ref, ts)
    return (
        F.when((minutes >= -1) & (minutes < 1), "刚刚")
        .when((minutes >= 0) & (minutes < 60), F.concat(F.floor(minutes).cast("string"), F.lit("分钟前")))
        .when(days == 0, F.concat(F.lit("今天 "), F.date_format(ts, "HH:mm")))
        .when(days == 1, F.concat(F.lit("昨天 "), F.date_format(ts, "HH:mm")))
        .otherwise(F.date_format(ts, "MM-dd HH:mm"))
    )


def publish_date(raw: Column, ref: Column) -> Column:
    """struct<ts, quality, raw> of a feed that writes dates as ``2026-07-27 00:00:00.000``."""
    p = parse(F.substring_index(raw, ".", 1), ref)
    return F.struct(p["ts"].alias("ts"), midnight_as_date(p["ts"], p["quality"]).alias("quality"), p["raw"].alias("raw"))


def newest_note(newest: Column, ref: Column) -> Column:
    """When the newest event came out and how long ago, in hours within a day, else in days; null for none."""
    hours = (F.unix_micros(ref) - F.unix_micros(newest)) / 3_600_000_000
    ago = F.when(hours < 24, F.concat(hours.cast("int").cast("string"), F.lit(" 小时前"))).otherwise(F.concat((hours / 24).cast("int").cast("string"), F.lit(" 天前")))
    return F.concat(F.date_format(newest, "yyyy-MM-dd HH:mm"), F.lit("（"), ago, F.lit("）"))


def align_to_hour(ts: Column, hour: int) -> Column:
    """A date-only stamp at the given hour of its day."""
    return F.date_trunc("day", ts) + F.make_interval(hours=F.lit(hour))


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def in_trading_hours(ts: Column, start: int = 9 * 60 + 30, end: int = 15 * 60 + 10) -> Column:
    """Monday to Friday, both minutes included."""
    return (F.weekday(ts) < 5) & minute_of_day(ts).between(start, end)


def in_quiet_hours(ts: Column, start: str, end: str) -> Column:
    """Inside [start, end) of the day, over midnight if start is later; equal or invalid ends: never."""

    def minutes(clock: str) -> int | None:
        h, _, m = clock.strip().partition(":")
        ok = h.isdigit() and m.isdigit() and int(h) < 24 and int(m) < 60
        return int(h) * 60 + int(m) if ok else None

    a, b = minutes(start), minutes(end)
    if a is None or b is None or a == b:
        return F.lit(False)
    now = minute_of_day(ts)
    return (now >= a) & (now < b) if a < b else (now >= a) | (now < b)


def midnight_as_date(ts: Column, quality: Column) -> Column:
    """Quality of a stamp in a feed that writes dates as midnight: exact midnights count as dates."""
    midnight = (F.hour(ts) == 0) & (F.minute(ts) == 0) & (F.second(ts) == 0)
    return F.when((quality == "exact") & midnight, "date").otherwise(quality)


def bar_freshness(day: Column, ref: Column) -> Column:
    """How old the newest bar is: unknown, today, previous, or the number of days, with its date."""
    days = F.datediff(ref, day)
    label = F.when(days <= 0, "今日").when(days == 1, "上一交易日").otherwise(F.concat(days.cast("string"), F.lit(" 天前")))
    return F.when(day.isNull(), "行情日期未知").otherwise(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("（"), label, F.lit("）")))
