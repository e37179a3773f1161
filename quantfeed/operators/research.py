"""Cross-sections of a day: cleaning of factors, their information content, point-in-time joins."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quantfeed.functions.columns import divide
from quantfeed.operators.frames import Frames, added
from quantfeed.sources.tables import written_down


def winsorised(panel: DataFrame, factor: str, by: str = "day", k: float = 3.0) -> DataFrame:
    """Factor held within median +- k * 1.4826 * median absolute deviation of its day."""
    median = panel.groupBy(by).agg(F.percentile(factor, F.lit(0.5)).alias("_m"))
    x = panel.join(median, by)
    spread = x.groupBy(by).agg((F.percentile(F.abs(F.col(factor) - F.col("_m")), F.lit(0.5)) * 1.4826 * k).alias("_s"))
    held = F.greatest(F.least(F.col(factor), F.col("_m") + F.col("_s")), F.col("_m") - F.col("_s"))
    return x.join(spread, by).withColumn(factor, F.when(F.col(factor).isNotNull(), held)).drop("_m", "_s")


def z_scored(panel: DataFrame, factor: str, by: str = "day") -> DataFrame:
    stats = panel.groupBy(by).agg(F.avg(factor).alias("_m"), F.stddev_samp(factor).alias("_s"))
    return panel.join(stats, by).withColumn(factor, F.try_divide(F.col(factor) - F.col("_m"), F.col("_s"))).drop("_m", "_s")


def neutralised(panel: DataFrame, factor: str, size: str, industry: str, by: str = "day") -> DataFrame:
    """Residual of the factor on size and industry: both are centred within the industry, then one slope a day.

    On a day whose sizes don't differ within any industry (but for rounding) the slope is 0.
    """
    rows = panel.filter(F.col(factor).isNotNull() & F.col(size).isNotNull())
    means = rows.groupBy(by, industry).agg(F.avg(factor).alias("_f"), F.avg(size).alias("_z"))
    x = rows.join(means, [by, industry]).withColumns({"_y": F.col(factor) - F.col("_f"), "_x": F.col(size) - F.col("_z")})
    slope = x.groupBy(by).agg(F.when(F.sum(F.col("_x") * F.col("_x")) > 1e-9, F.sum(F.col("_x") * F.col("_y")) / F.sum(F.col("_x") * F.col("_x"))).otherwise(0.0).alias("_b"))
    return x.join(slope, by).withColumn("residual", F.col("_y") - F.col("_b") * F.col("_x")).drop("_f", "_z", "_y", "_x", "_b")


def information(panel: DataFrame, factor: str, forward: str, by: str = "day") -> DataFrame:
    """Per day: correlation of factor and forward return, the same of their ranks, and the number of rows."""
    rows = panel.filter(F.col(factor).isNotNull() & F.col(forward).isNotNull())
    for c in (factor, forward):
        tied = Window.partitionBy(by, c)
        rows = rows.withColumn(f"_r_{c}", F.rank().over(Window.partitionBy(by).orderBy(c)) + (F.count("*").over(tied) - 1) / 2)
    corr = lambda a, b: F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return rows.groupBy(by).agg(F.count("*").alias("n"), corr(factor, forward).alias("ic"), corr(f"_r_{factor}", f"_r_{forward}").alias("rank_ic"))


def information_summary(days: DataFrame, ic: str = "rank_ic") -> DataFrame:
    return days.agg(F.avg(ic).alias("mean"), F.stddev_samp(ic).alias("std"), F.try_divide(F.avg(ic), F.stddev_samp(ic)).alias("ir"), F.avg((F.col(ic) > 0).cast("double")).alias("positive"))


def quantile_returns(panel: DataFrame, factor: str, forward: str, groups: int = 5, by: str = "day", tie: str = "code") -> DataFrame:
    """Mean forward return of each group of the factor, over all days."""
    rows = panel.filter(F.col(factor).isNotNull() & F.col(forward).isNotNull())
    g = F.ntile(groups).over(Window.partitionBy(by).orderBy(factor, tie))
    return rows.withColumn("bucket", g).groupBy("bucket").agg(F.count("*").alias("n"), F.avg(forward).alias("mean_return"))


def quantile_spread(groups: DataFrame) -> DataFrame:
    """One row (top, bottom, spread, rising, monotone) of what quantile_returns gives.

    rising: how many of the steps from a group to the next higher one raise the mean; monotone: all of them.
    """
    listed = groups.agg(F.array_sort(F.collect_list(F.struct("bucket", "mean_return"))).alias("g")).select(F.col("g.mean_return").alias("m"))
    steps = F.transform(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(0))), lambda x, i: x > F.element_at("m", i + 1))
    rising = F.size(F.filter(steps, lambda s: s))
    x = listed.filter(F.size("m") > 0)
    return x.select(F.element_at("m", -1).alias("top"), F.element_at("m", 1).alias("bottom"), (F.element_at("m", -1) - F.element_at("m", 1)).alias("spread"), rising.alias("rising"), (rising == F.size("m") - 1).alias("monotone"))


def ranked_factors(panel: DataFrame, names: Sequence[str], forward: str, groups: int = 5, by: str = "day", tie: str = "code", digits: int = 9) -> DataFrame:
    """Long form of many factors at once, with ranks inside each (factor, day): rows (factor, day, code, value, forward, r_value, r_forward, bucket).

    Rows without a value or a forward return go; ranks of equal values are averaged, values are compared to so many digits.
    Rows are shuffled by day while they are wide and become long inside the tasks, so that a row travels once for all factors.
    """
    wide = panel.select(tie, by, F.col(forward).alias("forward"), *[F.round(n, digits).alias(n) for n in names]).filter("forward is not null").repartition(by)
    values = F.filter(F.array(*[F.struct(F.lit(n).alias("factor"), F.col(n).alias("value")) for n in names]), lambda x: x["value"].isNotNull())
    rows = wide.select(tie, by, "forward", F.explode(values).alias("x")).select(tie, by, "forward", "x.factor", "x.value")
    within = Window.partitionBy(by, "factor")
    for c in ("forward", "value"):
        w = within.orderBy(c)
        rows = rows.withColumn(f"r_{c}", F.rank().over(w) + (F.count("*").over(w.rangeBetween(0, 0)) - 1) / 2)
    return rows.withColumn("bucket", F.ntile(groups).over(within.orderBy("value", tie)))


def factor_days(ranked: DataFrame, groups: int = 5, by: str = "day") -> DataFrame:
    """Rows (factor, day, ic, sums, counts): rank correlation, and forward returns by group; one pass over the ranks, on the shuffle that made them.

    A day whose values or forward returns are all equal has no correlation.
    """
    corr = F.try_divide(F.covar_pop("r_value", "r_forward"), F.stddev_pop("r_value") * F.stddev_pop("r_forward"))
    held = [F.when(F.col("bucket") == k + 1, F.col("forward")) for k in range(groups)]
    return ranked.groupBy(by, "factor").agg(corr.alias("ic"), F.array(*map(F.sum, held)).alias("sums"), F.array(*map(F.count, held)).alias("counts"))


def _rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """What F.round says of a column: further from a tie than the product is off, its integer is the right one."""
    unit = 10.0**digits
    with np.errstate(all="ignore"):
        y = x * unit
        k = np.rint(y)
        odd = ~(np.abs(y - k) + np.abs(y) * 1e-15 < 0.5)
    out = np.where(odd, x, k / unit + 0.0)
    for i in np.flatnonzero(odd & (np.abs(x) < 2.0**53)):  # larger ones are whole
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _ranks(ordered: np.ndarray) -> np.ndarray:
    """Places from 1 of values in order, equal ones sharing their mean."""
    new = np.ones(len(ordered), bool)
    new[1:] = (ordered[1:] != ordered[:-1]) & ~(np.isnan(ordered[1:]) & np.isnan(ordered[:-1]))
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(ordered)))
    return np.repeat(first + (size + 1) / 2, size)


def ranked_days(panel: DataFrame, names: Sequence[str], forward: str, groups: int = 5, by: str = "day", tie: str = "code", digits: int = 9) -> DataFrame:
    """What factor_days says of ranked_factors, with a day's ranks worked out on arrays.

    Rows travel once, by day and while they are wide; a task holds the codes of one day at a time and sorts each factor once.
    Values are rounded there too: as columns, so many roundings make a method too large for the JVM to compile.
    """
    wide = panel.select(F.col(tie).alias("_tie"), F.col(by), F.col(forward).cast("double").alias("_forward"), *[F.col(n).cast("double").alias(f"_v{k}") for k, n in enumerate(names)]).filter("_forward is not null")
    schema = T.StructType([panel.schema[by], T.StructField("factor", T.StringType()), T.StructField("ic", T.DoubleType()), T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    made_of = to_arrow_schema(schema)

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t["_tie"], null_placement="at_start"))
        w = t["_forward"].to_numpy()
        by_forward = np.argsort(w, kind="stable")
        out: list[tuple] = []
        for k, name in enumerate(names):
            c = t[f"_v{k}"]
            given = c.is_valid().to_numpy()
            n = int(given.sum())
            if not n:
                continue
            rows = np.flatnonzero(given)
            v = _rounded(c.to_numpy()[rows], digits)
            at = np.argsort(v, kind="stable")  # of equal values the smaller tie first, as rows lie so
            order = rows[at]
            ranks = np.empty(len(w))
            there = by_forward[given[by_forward]]
            ranks[there] = _ranks(w[there])
            x, y = _ranks(v[at]) - (n + 1) / 2, ranks[order] - (n + 1) / 2
            spread = np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())
            parts = np.array_split(w[order], groups)  # the first n % groups hold one more, as in ntile
            out.append((name, float((x * y).sum() / spread) if spread else None, [float(p.sum()) if len(p) else None for p in parts], [len(p) for p in parts]))
        columns = list(zip(*out, strict=True)) or [()] * 4
        days = t[by].slice(0, 1).combine_chunks().take(pa.array([0] * len(out), pa.int64()))
        return pa.table([days, *(pa.array(c, f.type) for c, f in zip(columns, list(made_of)[1:], strict=True))], schema=made_of)

    return wide.groupBy(by).applyInArrow(run, schema)


def factor_summary(days: DataFrame, groups: int = 5) -> DataFrame:
    """Rows (factor, days, mean, std, positive, top, bottom, ir, spread): what information, information_summary and quantile_returns say, for each factor.

    A correlation counts as positive from 1e-9 on, so that a zero is none whatever its last digits. top and bottom
    are mean forward returns of the highest and the lowest group that has rows.
    """
    means = [F.try_divide(F.sum(F.col("sums")[k]), F.sum(F.col("counts")[k])) for k in range(groups)]
    ic = [F.count("ic").alias("days"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((F.col("ic") > 1e-9).cast("double")).alias("positive")]
    out = days.groupBy("factor").agg(*ic, F.coalesce(*means[::-1]).alias("top"), F.coalesce(*means).alias("bottom"))
    return out.withColumns({"ir": F.try_divide("mean", "std"), "spread": F.col("top") - F.col("bottom")})


def tradable(bars: DataFrame, limit: float = 10.0, by: str = "code", order: str = "day") -> DataFrame:
    """Rows whose close is neither at the day's upper nor lower limit: ``limit`` percent from the close before, to the cent.

    A code's first row has no limit and stays.
    """
    before = F.lag("close").over(Window.partitionBy(by).orderBy(order))
    step = limit / 100
    at_limit = (F.col("close") >= F.round(before * (1 + step), 2)) | (F.col("close") <= F.round(before * (1 - step), 2))
    return bars.withColumn("_at_limit", F.coalesce(at_limit, F.lit(False))).filter(~F.col("_at_limit")).drop("_at_limit")


def value_ratios(price: str = "price", earnings: str = "earnings", book: str = "book") -> dict[str, Column]:
    """Earnings yield and book to price; null for a missing or zero price."""
    return {"pe_inverse": divide(F.col(earnings), F.col(price)), "pb_inverse": divide(F.col(book), F.col(price))}


def revision(estimates: DataFrame, value: str, key: str = "code", at: str = "day", days: int = 30, order: tuple[str, ...] = ()) -> DataFrame:
    """Adds revision: the estimate against the one known ``days`` before, as a share of that."""
    past = estimates.select(F.col(key), F.col(at).alias("_known"), F.col(value).alias("_past"), *[F.col(o).alias(f"_past_{o}") for o in order])
    asking = estimates.withColumn("_at_past", F.col(at) - F.expr(f"INTERVAL {days} DAY"))
    x = as_of(asking, past, key, "_at_past", "_known", ("_past",), tuple(f"_past_{o}" for o in order))
    return x.withColumn("revision", divide(F.col(value) - F.col("_past"), F.col("_past"))).drop("_at_past", "_past")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, known: str, values: tuple[str, ...], order: tuple[str, ...] = (), block: str = "week") -> DataFrame:
    """Adds the newest values of ``right`` that were known at each row of ``left``.

    Both sides are laid on one time line per key and the last value is carried on, so nothing is
    joined by range. What becomes known at the same time counts; of several, the last in ``order``.
    Time lines are cut into blocks (a unit of date_trunc) and each block takes over what was known at
    the end of those before it, so a key's rows meet in one task for one block only. Facts without a
    key or a time are known to nobody; rows without a key or a time get nulls.
    """
    facts = right.filter(F.col(key).isNotNull() & F.col(known).isNotNull())
    facts = facts.select(F.col(key), F.col(known).alias("_at"), F.lit(0).alias("_side"), F.struct(*values).alias("_fact"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)])
    rows = left.withColumns({"_at": F.col(at), "_side": F.lit(1), "_row": F.struct(*left.columns)}).select(key, "_at", "_side", "_row")
    both = facts.unionByName(rows, allowMissingColumns=True).withColumn("_block", F.date_trunc(block, "_at"))
    line = ["_at", "_side", *[f"_o{i}" for i in range(len(order))]]
    ends = both.filter(F.col(key).isNotNull() & F.col("_block").isNotNull()).groupBy(key, "_block").agg(F.max_by("_fact", F.when(F.col("_side") == 0, F.struct(*line))).alias("_end"))
    before = F.last("_end", ignorenulls=True).over(Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    carried = ends.select(key, "_block", before.alias("_before"))
    inside = Window.partitionBy(key, "_block").orderBy(*line).rowsBetween(Window.unboundedPreceding, 0)
    out = both.join(carried, [key, "_block"], "left").withColumn("_known", F.coalesce(F.last("_fact", ignorenulls=True).over(inside), "_before")).filter("_side = 1")
    return out.select("_row.*", *[F.col(f"_known.{v}").alias(v) for v in values])


def price_factors(bars: DataFrame, turnover: str = "turnover", n: int = 20, by: str = "code", order: str = "day") -> DataFrame:
    """Bars with ret, ret_20, momentum_12m_1m, corr_20, amihud, turnover_std and downside_vol.

    amihud is the mean of |return| per 100 million of amount; downside_vol is the root of the mean over
    n rows of squared losses. Windows that aren't full give null.
    """
    given = dict.fromkeys(("close", "amount", "volume", turnover))
    x = bars.withColumns({f"_{c}": F.col(c).cast("double") for c in given})

    def made(f: Frames) -> dict[str, np.ndarray]:
        c, amount, volume, turned = (f.col(f"_{k}") for k in ("close", "amount", "volume", turnover))
        ret = f.divide(c, f.ref(c, 1)) - 1
        loss = np.where(ret < 0, ret * ret, np.where(np.isnan(ret), np.nan, 0.0))
        return {
            "ret": ret,
            "ret_20": f.divide(c, f.ref(c, n)) - 1,
            "momentum_12m_1m": f.divide(f.ref(c, 21), f.ref(c, 252)) - 1,
            "corr_20": f.corr(c, volume, n),
            "amihud": f.mean(f.divide(np.abs(ret), amount / 1e8), n),
            "turnover_std": f.std(turned, n),
            "downside_vol": np.sqrt(f.mean(loss, n)),
        }

    names = ("ret", "ret_20", "momentum_12m_1m", "corr_20", "amihud", "turnover_std", "downside_vol")
    return added(x, made, names, max(252, n + 1), by, order).drop(*(f"_{c}" for c in given))


def idiosyncratic(returns: DataFrame, n: int = 20, by: str = "code", order: str = "day") -> DataFrame:
    """Adds idio_vol: spread of what the day's mean return over all codes leaves of ``ret`` unexplained.

    Days are few (a row each), so the market's returns join by broadcast or sort, as their size says. The returns are
    written down, as the market's and the codes' own both read them.
    """
    returns = written_down(returns)
    market = returns.groupBy(order).agg(F.avg("ret").alias("_market"))
    x = returns.join(market, order).withColumn("_ret", F.col("ret").cast("double"))

    def made(f: Frames) -> dict[str, np.ndarray]:
        ret = f.col("_ret")
        rho = f.corr(ret, f.col("_market"), n)
        return {"idio_vol": np.sqrt(np.maximum(f.var(ret, n) * (1 - rho * rho), 0.0))}

    return added(x, made, ("idio_vol",), n, by, order).drop("_ret", "_market")
