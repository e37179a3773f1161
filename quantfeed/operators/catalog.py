"""The 158 factors: nine of the candle, four of the price, 29 families over five windows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfeed.functions.columns import divide
from quantfeed.operators.frames import Frames, computed
from quantfeed.operators.rolling import Latest, Rolling, greater, less, log
from quantfeed.operators.series import blocks

WINDOWS = (5, 10, 20, 30, 60)
EPS = 1e-12
FAMILIES = tuple("ROC MA STD BETA RSQR RESI MAX MIN QTLU QTLD RANK RSV IMAX IMIN IMXD CORR CORD CNTP CNTN CNTD SUMP SUMN SUMD VMA VSTD WVMA VSUMP VSUMN VSUMD".split())
CANDLE = tuple("KMID KLEN KMID2 KUP KUP2 KLOW KLOW2 KSFT KSFT2".split())
PRICE = tuple("OPEN0 HIGH0 LOW0 VWAP0".split())
#: Rows that a factor may look back: the longest window and the row before it.
LOOKBACK = max(WINDOWS) + 2
#: Columns that the windows of rolled() read.
NEEDED = ("close", "high", "low", "volume", "_i", "_lv", "_ret", "_lr", "_up", "_down", "_gain", "_loss", "_move", "_vgain", "_vloss", "_vmove", "_wv")
#: Fixed value: with fewer bars there are no factors and no scores.
MIN_BARS = 70


def prepared(bars: DataFrame, by: str | list[str] = "code", order: str = "day") -> DataFrame:
    """The columns that windows run over: they need the row before, and windows can't nest."""
    r = Rolling(by, order)
    c, v = F.col("close"), F.col("volume")
    c1, v1 = r.ref(c, 1), r.ref(v, 1)
    x = bars.withColumns({"_i": F.row_number().over(r.rows).cast("double"), "_c1": c1, "_v1": v1})
    dc, dv = F.col("close") - F.col("_c1"), F.col("volume") - F.col("_v1")
    ret = divide(F.col("close"), F.col("_c1"))
    zero = F.lit(0.0)
    return x.withColumns(
        {
            "_lv": log(v + 1),
            "_ret": ret,
            "_lr": log(divide(F.col("volume"), F.col("_v1")) + 1),
            "_up": (dc > 0).cast("double"),
            "_down": (dc < 0).cast("double"),
            "_gain": greater(dc, zero),
            "_loss": greater(-dc, zero),
            "_move": F.abs(dc),
            "_vgain": greater(dv, zero),
            "_vloss": greater(-dv, zero),
            "_vmove": F.abs(dv),
            "_wv": F.abs(ret - 1) * F.col("volume"),
        }
    )


def candle() -> dict[str, Column]:
    o, c, h, low = (F.col(x) for x in ("open", "close", "high", "low"))
    span = h - low + EPS
    top, bottom = greater(o, c), less(o, c)
    shapes = {
        "KMID": (c - o, o),
        "KLEN": (h - low, o),
        "KMID2": (c - o, span),
        "KUP": (h - top, o),
        "KUP2": (h - top, span),
        "KLOW": (bottom - low, o),
        "KLOW2": (bottom - low, span),
        "KSFT": (c * 2 - h - low, o),
        "KSFT2": (c * 2 - h - low, span),
    }
    out = {k: divide(*v) for k, v in shapes.items()}
    return out | {f"{x.upper()}0": divide(F.col(x), c) for x in ("open", "high", "low", "vwap")}


def rolled(d: int, r: Rolling | Latest | Frames) -> dict[str, Callable[[], Column | np.ndarray]]:
    """The 29 families for one window over prepared columns, as sliding columns, aggregates of the newest rows or arrays; each is built when called."""
    c, h, low, v, i = (r.col(x) for x in ("close", "high", "low", "volume", "_i"))
    now = lambda x: r.now(x)
    mean, total, std = (lambda x: r.mean(r.col(x), d)), (lambda x: r.sum(r.col(x), d)), (lambda x: r.std(r.col(x), d))
    move, vmove = (lambda: total("_move") + EPS), (lambda: total("_vmove") + EPS)
    volume = lambda: now(v) + EPS
    out = {
        "ROC": lambda: r.divide(r.ref(c, d), now(c)),
        "MA": lambda: r.divide(r.mean(c, d), now(c)),
        "STD": lambda: r.divide(r.std(c, d), now(c)),
        "BETA": lambda: r.divide(r.slope(c, d, i), now(c)),
        "RSQR": lambda: r.rsquare(c, d, i),
        "RESI": lambda: r.divide(r.resi(c, d, i), now(c)),
        "MAX": lambda: r.divide(r.max(h, d), now(c)),
        "MIN": lambda: r.divide(r.min(low, d), now(c)),
        "QTLU": lambda: r.divide(r.quantile(c, d, 0.8), now(c)),
        "QTLD": lambda: r.divide(r.quantile(c, d, 0.2), now(c)),
        "RANK": lambda: r.rank(c, d),
        "RSV": lambda: r.divide(now(c) - r.min(low, d), r.max(h, d) - r.min(low, d) + EPS),
        "IMAX": lambda: r.idx_max(h, d) / d,
        "IMIN": lambda: r.idx_min(low, d) / d,
        "IMXD": lambda: (r.idx_max(h, d) - r.idx_min(low, d)) / d,
        "CORR": lambda: r.corr(c, r.col("_lv"), d),
        "CORD": lambda: r.corr(r.col("_ret"), r.col("_lr"), d),
        "CNTP": lambda: mean("_up"),
        "CNTN": lambda: mean("_down"),
        "CNTD": lambda: mean("_up") - mean("_down"),
        "SUMP": lambda: r.divide(total("_gain"), move()),
        "SUMN": lambda: r.divide(total("_loss"), move()),
        "SUMD": lambda: r.divide(total("_gain") - total("_loss"), move()),
        "VMA": lambda: r.divide(mean("volume"), volume()),
        "VSTD": lambda: r.divide(std("volume"), volume()),
        "WVMA": lambda: r.divide(std("_wv"), mean("_wv") + EPS),
        "VSUMP": lambda: r.divide(total("_vgain"), vmove()),
        "VSUMN": lambda: r.divide(total("_vloss"), vmove()),
        "VSUMD": lambda: r.divide(total("_vgain") - total("_vloss"), vmove()),
    }
    return {f"{k}{d}": x for k, x in out.items()}


def factors(bars: DataFrame, names: Sequence[str] | None = None, windows: Sequence[int] = WINDOWS, by: str = "code", order: str = "day") -> DataFrame:
    """Bars (code, day, open, close, high, low, volume, vwap) with the named factors, all by default.

    One shuffle by code serves every window: a pass for the row before, then one for the frames.
    """
    candles, made = candle(), {}
    for d in windows:
        made |= rolled(d, Rolling(by, order))
    wanted = [*candles, *made] if names is None else list(names)
    return prepared(bars, by, order).select(by, order, *[(candles[n] if n in candles else made[n]()).alias(n) for n in wanted])


def panel(bars: DataFrame, names: Sequence[str] | None = None, windows: Sequence[int] = WINDOWS, by: str = "code", order: str = "day", long: bool | None = False, also: dict[str, Column] | None = None, into: tuple[Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], Sequence[str]] | None = None) -> DataFrame:
    """What factors() gives, for every row, with the windows worked out on arrays.

    One shuffle by code; the columns that look one row back are window functions on the same sort. Each task
    works on some ten thousand rows of many codes at a time. ``long``: whether a code may have more rows than a block
    (series.blocks), which are then dealt to several tasks; None looks. ``also``: further columns of a code's rows in
    order, as window functions over them; only for short series, as a block knows nothing of the next. ``into``: what is made of
    the rolling factors in the same tasks, and its names; these columns then leave the tasks in place of the factors.
    """
    if also and long is not False:
        raise ValueError("further columns need whole series")
    candles, also = candle(), also or {}
    wanted = [*candles, *(f"{k}{d}" for d in windows for k in FAMILIES)] if names is None else list(names)
    rolling = [n for n in wanted if n not in candles]
    keys = [by, "_block"]
    x = prepared(blocks(bars, by, [order], max(windows) + 2, long), keys, order).withColumns(also).sortWithinPartitions(*keys, order)
    shown = {n: candles[n].alias(n) for n in wanted if n in candles} | {k: F.col(k) for k in also}
    x = x.select(*keys, order, "_own", *shown.values(), *(F.col(c).cast("double").alias(c) for c in NEEDED))

    def made(f: Frames) -> dict[str, np.ndarray]:
        every: dict[str, Callable] = {}
        for d in windows:
            every |= rolled(d, f)
        found = {n: every[n]() for n in rolling}
        return into[0](found) if into else found

    names = list(into[1]) if into else rolling
    out = computed(x, keys, [by, order, *shown], made, names, "_own")
    return out.select(by, order, *([n for n in wanted if n in candles] + names if into else wanted), *also)


def latest_factors(bars: DataFrame, names: Sequence[str] | None = None, windows: Sequence[int] = WINDOWS, least: int = MIN_BARS, by: str = "code", order: str = "day") -> DataFrame:
    """The factors of each code's newest day, by one aggregation over the rows that they look back to.

    Codes with fewer than ``least`` bars have no factors and give no row.
    """
    candles, made = candle(), {}
    for d in windows:
        made |= rolled(d, Latest())
    wanted = [*candles, *made] if names is None else list(names)
    kept = max(LOOKBACK, least)
    recent = bars.withColumn("_age", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter(F.col("_age") <= kept)
    whole = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = prepared(recent.withColumn("_newest", F.last("close").over(whole)), by, order)
    at = Latest()
    shown = [at.now(F.col(c)).alias(c) for c in ("open", "close", "high", "low", "vwap")]
    out = x.groupBy(by).agg(F.max(order).alias(order), F.count("*").alias("_rows"), *shown, *[made[n]().alias(f"_f_{n}") for n in wanted if n not in candles])
    return out.filter(F.col("_rows") >= least).select(by, order, *[(candles[n] if n in candles else F.col(f"_f_{n}")).alias(n) for n in wanted])


# Groups of factors by name, the factors that reports show first, what each family says.
GROUPS = (
    (r"^K(MID|LEN|UP|LOW|SFT)", "K线形态"),
    (r"^(ROC|MA|BETA|RSQR|RESI)\d", "趋势动量"),
    (r"^(STD|MAX|MIN|QTLU|QTLD|RANK|RSV|IMAX|IMIN|IMXD)\d", "波动与位置"),
    (r"^(CNTP|CNTN|CNTD|SUMP|SUMN|SUMD)\d", "涨跌强弱"),
    (r"^(VMA|VSTD|WVMA|VSUMP|VSUMN|VSUMD|VOLUME)\d", "量能结构"),
    (r"^(CORR|CORD)\d", "量价配合"),
    (r"^(OPEN|HIGH|LOW|CLOSE|VWAP)\d", "价格基准"),
)
OTHER_GROUP = "其他"
CORE = (
    "KMID", "KLEN", "KUP", "KLOW", "KSFT", "ROC5", "ROC10", "ROC20", "ROC60", "MA5", "MA10", "MA20", "MA60", "STD5", "STD20", "STD60", "BETA20",
    "BETA60", "RSQR20", "RSQR60", "RESI20", "MAX20", "MIN20", "QTLU20", "QTLD20", "RANK20", "RANK60", "RSV20", "IMAX20", "IMIN20", "IMXD20", "CORR10",
    "CORR20", "CORR60", "CORD20", "CNTP20", "CNTN20", "CNTD20", "SUMP20", "SUMN20", "SUMD20", "SUMD60", "VMA5", "VMA20", "VSTD20", "WVMA20",
    "VSUMP20", "VSUMD20",
)


def factor_group(name: Column) -> Column:
    """Group of a factor by its name, the first whose pattern fits."""
    return F.coalesce(*[F.when(name.rlike(pattern), group) for pattern, group in GROUPS], F.lit(OTHER_GROUP))


def core_factors(available: Sequence[str], core: Sequence[str] = CORE, fallback: int = 60) -> list[str]:
    """The core factors among those available; the first ``fallback`` of all if there is none."""
    return [c for c in core if c in set(available)] or list(available[:fallback])


def described(name: Column, texts: dict[str, str]) -> Column:
    """A factor's text from its family's in ``texts``, with the window in place of N; empty if unknown."""
    window = F.regexp_extract(name, r"(\d+)$", 1)
    family = F.when(name.rlike(r"^K.*2$"), F.regexp_replace(name, "2$", "")).otherwise(F.regexp_replace(name, r"\d+$", ""))
    pairs = F.create_map(*[F.lit(x) for kv in texts.items() for x in kv])
    text = F.coalesce(F.try_element_at(pairs, family), F.lit(""))
    return F.when(window != "", F.replace(text, F.lit("N 日"), F.concat(window, F.lit(" 日")))).otherwise(text)


def coverage(panel: DataFrame, names: Sequence[str], keys: Sequence[str] = ("code", "day")) -> DataFrame:
    """Rows (factor, factor_group, attempted, computed, percent): over how many rows each factor has a value."""
    tidy = panel.select(*keys, *[F.col(n).cast("double") for n in names]).unpivot(list(keys), list(names), "factor", "value")
    out = tidy.groupBy("factor").agg(F.count("*").alias("attempted"), F.count("value").alias("computed"))
    return out.select("factor", factor_group(F.col("factor")).alias("factor_group"), "attempted", "computed", (F.col("computed") * 100 / F.col("attempted")).alias("percent"))
