"""Rolling factor operators: a value exists only where all n rows of its window exist and aren't null.

Each takes columns that are in the table already (a window function can't nest in another) and a
window of ``by`` rows ordered by ``order``; all operators over the same columns share one sort.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quantfeed.functions.columns import divide, finite
from quantfeed.operators.series import blocks
from quantfeed.sources.tables import written_down


class Rolling:
    def __init__(self, by: str | list[str] = "code", order: str = "day"):
        self.rows: WindowSpec = Window.partitionBy(by).orderBy(order)

    col, divide = staticmethod(F.col), staticmethod(divide)

    def frame(self, n: int) -> WindowSpec:
        if n < 1:
            raise ValueError("a window has at least one row")
        return self.rows.rowsBetween(1 - n, 0)

    def now(self, x: Column) -> Column:
        """The value in the row that a factor is for."""
        return x

    def full(self, n: int, *xs: Column) -> Column:
        given = F.lit(True)
        for x in xs:
            given = given & (F.count(x).over(self.frame(n)) == n)
        return given

    def _gated(self, value: Column, n: int, *xs: Column) -> Column:
        return F.when(self.full(n, *xs), finite(value))

    def ref(self, x: Column, n: int) -> Column:
        if n < 0:
            raise ValueError("looking ahead is not allowed")
        return x if n == 0 else F.lag(x, n).over(self.rows)

    def delta(self, x: Column, n: int) -> Column:
        return x - self.ref(x, n)

    def change(self, x: Column, n: int) -> Column:
        """Return over n rows in percent."""
        return (divide(x, self.ref(x, n)) - 1) * 100

    def mean(self, x: Column, n: int) -> Column:
        return self._gated(F.avg(x).over(self.frame(n)), n, x)

    def sum(self, x: Column, n: int) -> Column:
        return self._gated(F.sum(x).over(self.frame(n)), n, x)

    def std(self, x: Column, n: int) -> Column:
        return self._gated(F.stddev_samp(x).over(self.frame(n)), n, x)

    def var(self, x: Column, n: int) -> Column:
        return self._gated(F.var_samp(x).over(self.frame(n)), n, x)

    def max(self, x: Column, n: int) -> Column:
        return self._gated(F.max(x).over(self.frame(n)), n, x)

    def min(self, x: Column, n: int) -> Column:
        return self._gated(F.min(x).over(self.frame(n)), n, x)

    def quantile(self, x: Column, n: int, q: float) -> Column:
        return self._gated(F.percentile(x, F.lit(q)).over(self.frame(n)), n, x)

    def median(self, x: Column, n: int) -> Column:
        return self.quantile(x, n, 0.5)

    def _values(self, x: Column, n: int) -> Column:
        return F.collect_list(x).over(self.frame(n))

    def mad(self, x: Column, n: int) -> Column:
        """Mean absolute deviation from the window's mean."""
        mean = F.avg(x).over(self.frame(n))
        total = F.aggregate(F.transform(self._values(x, n), lambda v: F.abs(v - mean)), F.lit(0.0), lambda s, v: s + v)
        return self._gated(total / n, n, x)

    def rank(self, x: Column, n: int) -> Column:
        """Share of the window's values that are at most the current one."""
        return self._gated(F.size(F.filter(self._values(x, n), lambda v: v <= x)) / F.lit(float(n)), n, x)

    def idx_max(self, x: Column, n: int) -> Column:
        """Position of the first largest value, 1 for the oldest row."""
        return self._gated(F.array_position(self._values(x, n), F.max(x).over(self.frame(n))).cast("double"), n, x)

    def idx_min(self, x: Column, n: int) -> Column:
        return self._gated(F.array_position(self._values(x, n), F.min(x).over(self.frame(n))).cast("double"), n, x)

    def _varies(self, x: Column, n: int) -> Column:
        return F.max(x).over(self.frame(n)) > F.min(x).over(self.frame(n))

    def corr(self, x: Column, y: Column, n: int) -> Column:
        """Pearson correlation; null if a side is constant."""
        w = self.frame(n)
        r = F.try_divide(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w))
        return F.when(self._varies(x, n) & self._varies(y, n), self._gated(r, n, x, y))

    def cov(self, x: Column, y: Column, n: int) -> Column:
        return self._gated(F.covar_samp(x, y).over(self.frame(n)), n, x, y)

    def slope(self, x: Column, n: int, i: Column) -> Column:
        """Least-squares slope over 0..n-1; ``i`` is the row number."""
        if n == 1:
            return F.when(x.isNotNull(), F.lit(0.0))
        return self._gated(F.regr_slope(x, i).over(self.frame(n)), n, x)

    def rsquare(self, x: Column, n: int, i: Column) -> Column:
        return F.when(self._varies(x, n), self._gated(F.regr_r2(x, i).over(self.frame(n)), n, x))

    def resi(self, x: Column, n: int, i: Column) -> Column:
        """What the window's last value is off its fitted line."""
        return x - (self.mean(x, n) + self.slope(x, n, i) * ((n - 1) / 2))

    def wma(self, x: Column, n: int, i: Column) -> Column:
        """Mean with weights 1..n, the newest weighing most."""
        w = self.frame(n)
        total = F.sum(x * i).over(w) - (i - n) * F.sum(x).over(w)
        return self._gated(total / (n * (n + 1) / 2), n, x)


class Latest:
    """The operators of Rolling for each series' newest row alone, as aggregates over a group of rows.

    On the newest row a window is what is at most n rows old, so every factor is a conditional aggregate
    and no frame slides. Rows carry their age (1 for the newest) and, for rank, the newest value.
    """

    def __init__(self, age: str = "_age", newest: str = "_newest"):
        self.age, self.newest = F.col(age), F.col(newest)

    col, divide = staticmethod(F.col), staticmethod(divide)

    def within(self, x: Column, n: int) -> Column:
        if n < 1:
            raise ValueError("a window has at least one row")
        return F.when(self.age <= n, x)

    def now(self, x: Column) -> Column:
        return self.ref(x, 0)

    def ref(self, x: Column, n: int) -> Column:
        if n < 0:
            raise ValueError("looking ahead is not allowed")
        return F.max(F.when(self.age == n + 1, x))

    def _gated(self, value: Column, n: int, *xs: Column) -> Column:
        given = F.lit(True)
        for x in xs:
            given = given & (F.count(self.within(x, n)) == n)
        return F.when(given, finite(value))

    def mean(self, x: Column, n: int) -> Column:
        return self._gated(F.avg(self.within(x, n)), n, x)

    def sum(self, x: Column, n: int) -> Column:
        return self._gated(F.sum(self.within(x, n)), n, x)

    def std(self, x: Column, n: int) -> Column:
        return self._gated(F.stddev_samp(self.within(x, n)), n, x)

    def max(self, x: Column, n: int) -> Column:
        return self._gated(F.max(self.within(x, n)), n, x)

    def min(self, x: Column, n: int) -> Column:
        return self._gated(F.min(self.within(x, n)), n, x)

    def quantile(self, x: Column, n: int, q: float) -> Column:
        return self._gated(F.percentile(self.within(x, n), F.lit(q)), n, x)

    def rank(self, x: Column, n: int) -> Column:
        return self._gated(F.count(self.within(F.when(x <= self.newest, 1), n)) / F.lit(float(n)), n, x)

    def idx_max(self, x: Column, n: int) -> Column:
        oldest = F.max_by(self.age, self.within(F.struct(x, self.age), n))
        return self._gated((n + 1 - oldest).cast("double"), n, x)

    def idx_min(self, x: Column, n: int) -> Column:
        oldest = F.min_by(self.age, self.within(F.struct(x, -self.age), n))
        return self._gated((n + 1 - oldest).cast("double"), n, x)

    def _varies(self, x: Column, n: int) -> Column:
        return F.max(self.within(x, n)) > F.min(self.within(x, n))

    def corr(self, x: Column, y: Column, n: int) -> Column:
        a, b = self.within(x, n), self.within(y, n)
        r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
        return F.when(self._varies(x, n) & self._varies(y, n), self._gated(r, n, x, y))

    def slope(self, x: Column, n: int, i: Column) -> Column:
        if n == 1:
            return F.when(self.now(x).isNotNull(), F.lit(0.0))
        return self._gated(F.regr_slope(self.within(x, n), self.within(i, n)), n, x)

    def rsquare(self, x: Column, n: int, i: Column) -> Column:
        return F.when(self._varies(x, n), self._gated(F.regr_r2(self.within(x, n), self.within(i, n)), n, x))

    def resi(self, x: Column, n: int, i: Column) -> Column:
        return self.now(x) - (self.mean(x, n) + self.slope(x, n, i) * ((n - 1) / 2))


def with_row_number(df: DataFrame, name: str = "i", by: str = "code", order: str = "day") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(order)).cast("double"))


def greater(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(a, b))


def less(a: Column, b: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull(), F.least(a, b))


def log(x: Column) -> Column:
    """Natural logarithm; null for zero and below."""
    return F.when(x > 0, F.ln(x))


def power(a: Column, b: Column) -> Column:
    """a to the power of b; null where that is no finite number."""
    return finite(F.pow(a, b))


def compare(a: Column, op: str, b: Column) -> Column:
    """1.0 or 0.0 for one of > < >= <= == !=; null where a side is missing."""
    made = {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b, "==": a == b, "!=": a != b}
    return truth(made[op])


def when_true(c: Column, a: Column, b: Column) -> Column:
    """a where c isn't zero, b where it is, null where it is missing."""
    return F.when(c.isNull(), None).when(c != 0, a).otherwise(b)


def truth(c: Column) -> Column:
    """A comparison as 1.0, 0.0 or null."""
    return c.cast("double")


def ema(df: DataFrame, column: str, n: int, out: str, by: str = "code", order: str | list[str] = "day", long: bool | None = False) -> DataFrame:
    """Adds the exponential mean with 2 / (n + 1), seeded by the first value.

    Null rows stay null and keep the state. What a block of rows makes of the mean y before it is a * y + b, so
    blocks are worked out side by side, a row for each is carried along the series, and the blocks start from what
    they are given. ``long``: whether a series may have more rows than a block (series.blocks); None looks. Short
    series are a block each and nothing is carried.
    """
    orders = [order] if isinstance(order, str) else list(order)
    x = blocks(df, by, orders, 0, long).drop("_own")
    keys, alpha, names = [by, "_block"], 2 / (n + 1), list(df.columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def means(values: pd.Series, before: float | None) -> pd.Series:
        y = values.astype(float)
        seeded = y if before is None or pd.isna(before) else pd.concat([pd.Series([before]), y])
        return seeded.ewm(alpha=alpha, adjust=False, ignore_na=True).mean().iloc[-len(y) :].where(y.notna().to_numpy())

    def alone(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(orders)
        return pdf[names].assign(**{out: means(pdf[column], None).to_numpy()})

    if long is False:
        return x.groupBy(*keys).applyInPandas(alone, f"{schema}, `{out}` double")
    x = written_down(x)

    def effect(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(orders)[column].astype(float).dropna()
        last = y.ewm(alpha=alpha, adjust=False).mean().iloc[-1] if len(y) else None
        return pd.DataFrame({"by": pdf[by].iloc[:1].to_numpy(), "block": pdf["_block"].iloc[:1].to_numpy(), "n": [len(y)], "first": [y.iloc[0] if len(y) else None], "last": [last]})

    kind = df.schema[by].dataType.simpleString()
    effects = x.select(*keys, *orders, column).groupBy(*keys).applyInPandas(effect, f"by {kind}, block long, n long, first double, last double")

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        """``last`` counts the block's first value whole, as if it began the series; a mean before it takes its place by the decay."""
        pdf, state, before = pdf.sort_values("block"), None, []
        for m, first, last in zip(pdf["n"], pdf["first"], pdf["last"], strict=True):
            before.append(state)
            if m:
                state = last if state is None else last + (1 - alpha) ** m * (state - first)
        return pdf[["by", "block"]].assign(before=pd.Series(before, index=pdf.index, dtype=float))

    given = written_down(effects.groupBy("by").applyInPandas(carry, f"by {kind}, block long, before double"))
    joined = x.join(given, x[by].eqNullSafe(given["by"]) & (x["_block"] == given["block"])).drop("by", "block")

    def begun(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(orders)
        return pdf[names].assign(**{out: means(pdf[column], pdf["before"].iloc[0]).to_numpy()})

    return joined.groupBy(*keys).applyInPandas(begun, f"{schema}, `{out}` double")


def last_rows(df: DataFrame, n: int, by: str = "code", order: str = "day") -> DataFrame:
    """The newest n rows of each series."""
    newest = Window.partitionBy(by).orderBy(F.desc(order))
    return df.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") <= n).drop("_age")


def with_history(df: DataFrame, least: int = 70, by: str = "code") -> DataFrame:
    """Series of at least so many rows."""
    return df.withColumn("_n", F.count("*").over(Window.partitionBy(by))).filter(F.col("_n") >= least).drop("_n")
