"""Sliding operators over many series at once, as array work of one pass each.

Windows of n rows are read off two running accumulations, one ahead from every n-th row and one back from it, so a
sum or an extreme costs the same for every n and no sum runs longer than two windows. Moments are taken around
the row where the two meet, which is in the window itself: nothing large is subtracted from
something large. A NaN reaches exactly the windows that hold it, which is the rule that a window needs all its
rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantfeed.operators.series import blocks

#: Rows worked on together, and values of windows laid out side by side at once.
ROWS, CELLS = 32_768, 4_000_000


class Frames:
    """The operators of Rolling on arrays of rows in order, one series after another; null is NaN.

    ``place`` is each row's place in its series.
    """

    def __init__(self, cols: Mapping[str, np.ndarray], place: np.ndarray):
        self.cols, self.place = cols, place
        self.kept: dict[tuple, object] = {}

    def col(self, name: str) -> np.ndarray:
        return self.cols[name]

    @staticmethod
    def divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            q = a / b
        return np.where(np.isfinite(q), q, np.nan)

    @staticmethod
    def now(x: np.ndarray) -> np.ndarray:
        return x

    def _once(self, key: tuple, make: Callable[[], object]):
        if key not in self.kept:
            self.kept[key] = make()
        return self.kept[key]

    def _placed(self, values: np.ndarray, n: int) -> np.ndarray:
        """Values of windows that end at row n - 1 and later, null where a series has fewer rows."""
        out = np.full(len(self.place), np.nan)
        if len(values):
            out[n - 1 :] = values
        return np.where((self.place >= n - 1) & np.isfinite(out), out, np.nan)

    def _laid(self, x: np.ndarray, n: int) -> np.ndarray:
        y = np.full(-(-len(x) // n) * n, np.nan)
        y[: len(x)] = x
        return y.reshape(-1, n)

    def _meet(self, ahead: np.ndarray, back: np.ndarray, n: int, join: np.ufunc) -> np.ndarray:
        begin = np.arange(max(0, len(self.place) - n + 1))
        a, b = ahead.ravel()[begin + n - 1], back.ravel()[begin]
        return np.where(begin % n == 0, a, join(a, b))

    def _sum(self, n: int, *xs: np.ndarray) -> np.ndarray:
        """Window sums of the product of columns, each around its value where the window's two parts meet."""

        def make():
            ahead = back = 1.0
            for x in xs:
                y = self._laid(x, n)
                ahead = ahead * (y - y[:, :1])
                back = back * (y - np.append(y[1:, :1], [[np.nan]], axis=0))
            return self._meet(np.cumsum(ahead, axis=1), np.cumsum(back[:, ::-1], axis=1)[:, ::-1], n, np.add)

        return self._once(("sum", n, *map(id, xs)), make)

    def _center(self, x: np.ndarray, n: int) -> np.ndarray:
        begin = np.arange(max(0, len(x) - n + 1))
        return self._once(("center", n, id(x)), lambda: self._laid(x, n)[:, 0][-(-begin // n)])

    def _most(self, x: np.ndarray, n: int, join: np.ufunc) -> np.ndarray:
        def make():
            y = self._laid(x, n)
            return self._meet(join.accumulate(y, axis=1), join.accumulate(y[:, ::-1], axis=1)[:, ::-1], n, join)

        return self._once((join.__name__, n, id(x)), make)

    def _spread(self, n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Window sums of (x - mean x) (y - mean y)."""
        return self._sum(n, x, y) - self._sum(n, x) * self._sum(n, y) / n

    def _windows(self, x: np.ndarray, n: int, made: Callable[[np.ndarray, slice], np.ndarray]) -> np.ndarray:
        """What ``made`` says of windows laid out as rows, some at a time."""
        if len(x) < n:
            return np.empty(0)
        view, step = np.lib.stride_tricks.sliding_window_view(x, n), max(1, CELLS // n)
        return np.concatenate([made(view[k : k + step], slice(k + n - 1, min(k + step, len(view)) + n - 1)) for k in range(0, len(view), step)])

    def _given(self, x: np.ndarray, n: int, values: np.ndarray) -> np.ndarray:
        return self._placed(np.where(np.isnan(self._sum(n, x)), np.nan, values), n)

    def ref(self, x: np.ndarray, n: int) -> np.ndarray:
        if n < 0:
            raise ValueError("looking ahead is not allowed")
        out = np.full(len(x), np.nan)
        out[n:] = x[: max(0, len(x) - n)]
        return np.where(self.place >= n, out, np.nan)

    def delta(self, x: np.ndarray, n: int) -> np.ndarray:
        return x - self.ref(x, n)

    def change(self, x: np.ndarray, n: int) -> np.ndarray:
        return (self.divide(x, self.ref(x, n)) - 1) * 100

    def mean(self, x: np.ndarray, n: int) -> np.ndarray:
        return self._once(("mean", n, id(x)), lambda: self._placed(self._center(x, n) + self._sum(n, x) / n, n))

    def sum(self, x: np.ndarray, n: int) -> np.ndarray:
        return self._once(("total", n, id(x)), lambda: self._placed(self._center(x, n) * n + self._sum(n, x), n))

    def var(self, x: np.ndarray, n: int) -> np.ndarray:
        """By Welford's updates, oldest row first, as the built-in aggregates do it: equal to the last digits."""
        if n == 1:
            return np.full(len(x), np.nan)

        def squares(w: np.ndarray, _: slice) -> np.ndarray:
            mean, total = np.zeros(len(w)), np.zeros(len(w))
            for k in range(n):
                off = w[:, k] - mean
                part = off / (k + 1)
                mean = mean + part
                total = total + off * (off - part)
            return total

        return self._once(("var", n, id(x)), lambda: self._placed(self._windows(x, n, squares) / (n - 1), n))

    def std(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.sqrt(self.var(x, n))

    def max(self, x: np.ndarray, n: int) -> np.ndarray:
        return self._placed(self._most(x, n, np.maximum), n)

    def min(self, x: np.ndarray, n: int) -> np.ndarray:
        return self._placed(self._most(x, n, np.minimum), n)

    def quantile(self, x: np.ndarray, n: int, q: float) -> np.ndarray:
        ordered = self._once(("sorted", n, id(x)), lambda: self._windows(x, n, lambda w, _: np.sort(w, axis=1)).reshape(-1, n))
        at = (n - 1) * q
        low = int(at)
        high = min(low + 1, n - 1)
        return self._given(x, n, ordered[:, low] * (high - at) + ordered[:, high] * (at - low) if high > at > low else ordered[:, low])

    def median(self, x: np.ndarray, n: int) -> np.ndarray:
        return self.quantile(x, n, 0.5)

    def mad(self, x: np.ndarray, n: int) -> np.ndarray:
        return self._given(x, n, self._windows(x, n, lambda w, _: np.abs(w - w.mean(axis=1, keepdims=True)).mean(axis=1)))

    def rank(self, x: np.ndarray, n: int) -> np.ndarray:
        return self._given(x, n, self._windows(x, n, lambda w, at: (w <= x[at, None]).sum(axis=1)) / n)

    def idx_max(self, x: np.ndarray, n: int) -> np.ndarray:
        return self._once(("top", n, id(x)), lambda: self._given(x, n, self._windows(x, n, lambda w, _: w.argmax(axis=1) + 1.0)))

    def idx_min(self, x: np.ndarray, n: int) -> np.ndarray:
        return self._once(("low", n, id(x)), lambda: self._given(x, n, self._windows(x, n, lambda w, _: w.argmin(axis=1) + 1.0)))

    def _varies(self, x: np.ndarray, n: int) -> np.ndarray:
        return self._most(x, n, np.maximum) > self._most(x, n, np.minimum)

    def corr(self, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(all="ignore"):
            r = self._spread(n, x, y) / (np.sqrt(self._spread(n, x, x)) * np.sqrt(self._spread(n, y, y)))
        return self._placed(np.where(self._varies(x, n) & self._varies(y, n), r, np.nan), n)

    def cov(self, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
        return self._placed(self._spread(n, x, y) / (n - 1), n) if n > 1 else np.full(len(x), np.nan)

    def slope(self, x: np.ndarray, n: int, i: np.ndarray) -> np.ndarray:
        if n == 1:
            return np.where(np.isnan(x), np.nan, 0.0)
        return self._once(("slope", n, id(x)), lambda: self._placed(self._spread(n, x, i) / (n * (n * n - 1) / 12), n))

    def rsquare(self, x: np.ndarray, n: int, i: np.ndarray) -> np.ndarray:
        if n == 1:
            return np.full(len(x), np.nan)
        with np.errstate(all="ignore"):
            r = self._spread(n, x, i) ** 2 / (self._spread(n, x, x) * (n * (n * n - 1) / 12))
        return self._placed(np.where(self._varies(x, n), r, np.nan), n)

    def resi(self, x: np.ndarray, n: int, i: np.ndarray) -> np.ndarray:
        return x - (self.mean(x, n) + self.slope(x, n, i) * ((n - 1) / 2))

    def wma(self, x: np.ndarray, n: int, i: np.ndarray) -> np.ndarray:
        """Weights 1..n; i - (last i - n) around the meeting row is (i - center) + (center - last i + n)."""
        last = i[n - 1 :] if len(i) >= n else np.empty(0)
        shift = self._center(i, n) - last + n
        total = self._sum(n, x, i) + shift * self._sum(n, x) + self._center(x, n) * (n * (n + 1) / 2)
        return self._placed(total / (n * (n + 1) / 2), n)


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and the place of each row in its group. Rows come in the order of their keys."""
    held: list[pa.RecordBatch] = []

    def places(t: pa.Table) -> np.ndarray:
        new = np.zeros(len(t), bool)
        new[:1] = True
        for k in range(keys):
            codes = t.column(k).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        first = np.flatnonzero(new)
        return np.arange(len(t)) - np.repeat(first, np.diff(np.append(first, len(t))))

    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) >= ROWS:
            t = pa.Table.from_batches(held)
            place = places(t)
            last = len(t) - 1 - int(place[-1])  # the last group may go on
            held = t.slice(last).to_batches()
            if last:
                yield t.slice(0, last), place[:last]
    if held and sum(map(len, held)):
        t = pa.Table.from_batches(held)
        yield t, places(t)


def computed(prepared: DataFrame, keys: Sequence[str], shown: Sequence[str], made: Callable[[Frames], Mapping[str, np.ndarray]], names: Sequence[str], own: str | None = None) -> DataFrame:
    """The columns ``shown`` and one double for each of ``names``, as ``made`` works them out.

    ``prepared`` lies in order within its partitions, all rows of a key together; numeric columns go to ``made``
    as doubles. Rows where ``own`` is false are only looked back at.
    """
    numeric = [f.name for f in prepared.schema if isinstance(f.dataType, T.DoubleType)]
    width = len(keys)
    x = prepared.select(*keys, *shown, *([own] if own else []), *[F.col(c).alias(f"_x{k}") for k, c in enumerate(numeric)])
    begin = width + len(shown) + bool(own)

    def run(batches):
        for t, place in _groups(batches, width):
            cols = {c: t.column(begin + k).to_numpy().astype(np.float64) for k, c in enumerate(numeric)}
            found = made(Frames(cols, place))
            arrays = [t.column(width + k) for k in range(len(shown))]
            for name in names:
                v = np.asarray(found[name], np.float64)
                arrays.append(pa.chunked_array([pa.array(v, mask=~np.isfinite(v))]))
            out = pa.table(arrays, names=[*shown, *names])
            if own and not pc.all(t.column(begin - 1)).as_py():
                out = out.filter(t.column(begin - 1))
            yield from out.to_batches()

    schema = T.StructType([*(prepared.schema[c] for c in shown), *(T.StructField(n, T.DoubleType()) for n in names)])
    return x.mapInArrow(run, schema)


def sliding(df: DataFrame, made: Callable[[Frames], Mapping[str, np.ndarray]], names: Sequence[str], lookback: int, by: str = "code", order: str | Sequence[str] = "day", long: bool | None = None) -> DataFrame:
    """Rows (by, order..., names...): operators on the double columns of ``df``, null-gated like Rolling's.

    ``made`` gets Frames and gives an array for each name; no row may need more than ``lookback`` rows before it.
    A series of any length is cut into blocks that overlap by so much (see series.blocks for ``long``). Null keys are a
    series, rows of equal order follow each other in any order; an empty table gives no rows. A column
    "_i" with the row number within the block is added.
    """
    orders = [order] if isinstance(order, str) else list(order)
    x = blocks(df, by, orders, lookback, long)
    keys = [by, "_block"]
    x = x.repartition(*keys).sortWithinPartitions(*keys, *orders)
    return computed(x, keys, [by, *orders], lambda f: made(_numbered(f)), names, "_own")


def added(df: DataFrame, made: Callable[[Frames], Mapping[str, np.ndarray]], names: Sequence[str], lookback: int, by: str = "code", order: str = "day", long: bool | None = False) -> DataFrame:
    """The columns of ``df`` and those that ``made`` works out on its double columns; see sliding()."""
    keys = [by, "_block"]
    x = blocks(df, by, [order], lookback, long).repartition(*keys).sortWithinPartitions(*keys, order)
    return computed(x, keys, df.columns, made, names, "_own")


def _numbered(f: Frames) -> Frames:
    f.cols = {**f.cols, "_i": f.place.astype(np.float64)}
    return f
