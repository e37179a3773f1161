"""Six 0-100 dimension scores of an instrument and day, their composite and levels."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantfeed.functions.columns import clip, mean_of, scale

DIMENSIONS = ("momentum", "trend", "volatility", "volume", "price_volume", "strength")
#: The factors that the scores read.
NEEDS = tuple("ROC5 ROC10 ROC20 ROC60 MA5 MA10 MA20 MA60 BETA20 RSQR20 STD20 RANK20 RSV20 VMA5 VMA20 VSUMD20 CORR10 CORR20 CORR60 CORD20 SUMD20 SUMP20 CNTD20".split())


def _inverse(name: str) -> Column:
    """1 / x, for positive x."""
    x = F.col(name)
    return F.when(x > 0, 1.0 / x)


def tenth(x: Column) -> Column:
    """Rounded to one decimal; what is a tie but for the last binary digit goes up."""
    return F.round(x + 1e-9, 1)


class Columns:
    """What scores are made of, as columns."""

    col, scale, clip, mean_of, inverse, tenth = (staticmethod(f) for f in (F.col, scale, clip, mean_of, _inverse, tenth))


class Arrays:
    """The same on arrays of a factor each, null is NaN."""

    def __init__(self, cols: Mapping[str, np.ndarray]):
        self.cols = cols

    def col(self, name: str) -> np.ndarray:
        return self.cols[name]

    def inverse(self, name: str) -> np.ndarray:
        x = self.cols[name]
        with np.errstate(all="ignore"):
            return np.where(x > 0, 1.0 / x, np.nan)

    @staticmethod
    def clip(x: np.ndarray) -> np.ndarray:
        return np.clip(x, 0.0, 100.0)

    def scale(self, v: np.ndarray, center: float, span: float, invert: bool = False) -> np.ndarray:
        return self.clip(50.0 + (-50.0 if invert else 50.0) * (v - center) / span)

    @staticmethod
    def mean_of(*parts: np.ndarray) -> np.ndarray:
        total, n = 0.0, 0
        for x in parts:
            there = ~np.isnan(x)
            total, n = total + np.where(there, x, 0.0), n + there
        with np.errstate(all="ignore"):
            return np.where(n > 0, total / n, np.nan)

    @staticmethod
    def tenth(x: np.ndarray) -> np.ndarray:
        """Ten times a score is off by under 1e-12, so only what is closer to a tie is left to decimal numbers."""
        v = x + 1e-9
        k = np.rint(v * 10)
        out = k / 10
        for at in np.flatnonzero(np.abs(np.abs(v * 10 - k) - 0.5) < 1e-11):
            out[at] = float(Decimal(repr(float(v[at]))).quantize(Decimal("0.1"), ROUND_HALF_UP))
        return out


def scores(r: Columns | Arrays | None = None) -> dict[str, Column | np.ndarray]:
    """Each dimension's score, rounded to one decimal; null if none of its readings is there."""
    r = r or Columns()
    raw = {
        "momentum": [r.scale(r.inverse(f"ROC{d}") - 1, 0.0, s) for d, s in ((5, 0.06), (10, 0.09), (20, 0.14), (60, 0.25))],
        "trend": [*(r.scale(r.inverse(f"MA{d}") - 1, 0.0, s) for d, s in ((5, 0.04), (10, 0.06), (20, 0.09), (60, 0.16))), r.scale(r.col("BETA20"), 0.0, 0.004)],
        "volatility": [r.scale(r.col("STD20"), 0.03, 0.03, invert=True), r.clip(r.col("RANK20") * 100), r.clip(r.col("RSV20") * 100)],
        "volume": [*(r.scale(r.inverse(f"VMA{d}"), 1.0, 1.0) for d in (5, 20)), r.scale(r.col("VSUMD20"), 0.0, 0.5)],
        "price_volume": [*(r.scale(r.col(f"CORR{d}"), 0.0, 0.6) for d in (10, 20, 60)), r.scale(r.col("CORD20"), 0.0, 0.6)],
        "strength": [r.scale(r.col("SUMD20"), 0.0, 0.6), r.clip(r.col("SUMP20") * 100), r.scale(r.col("CNTD20"), 0.0, 0.4)],
    }
    return {k: r.tenth(r.mean_of(*v)) for k, v in raw.items()}


def composites(factors: Mapping[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The six scores and their composite as profile() has them, from arrays of the factors that it needs."""
    r = Arrays(factors)
    found = scores(r)
    return found | {"composite": r.tenth(r.mean_of(*found.values()))}


def level(score: Column) -> Column:
    """Class of a score: high, raised, middle, lowered, low; none if it is missing."""
    return F.when(score.isNull(), "none").when(score >= 70, "high").when(score >= 55, "raised").when(score > 45, "middle").when(score > 30, "lowered").otherwise("low")


def momentum_shape() -> Column:
    """How the returns over 5, 10, 20 and 60 days agree."""
    r = F.filter(F.array(*[_inverse(f"ROC{d}") - 1 for d in (5, 10, 20, 60)]), lambda x: x.isNotNull())
    short, long = _inverse("ROC5") - 1, _inverse("ROC60") - 1
    return (
        F.when(F.size(r) == 0, "none")
        .when(F.forall(r, lambda x: x > 0), "all_up")
        .when(F.forall(r, lambda x: x <= 0), "all_down")
        .when((short > 0) & (long < 0), "repair")
        .when((short < 0) & (long > 0), "fading")
        .otherwise("mixed")
    )


def profile(panel: DataFrame, keys: tuple[str, ...] = ("code", "day")) -> DataFrame:
    """Keys, the six scores, composite (mean of those there), covered (how many), stance and shape."""
    x = panel.select(*keys, *[v.alias(k) for k, v in scores().items()], momentum_shape().alias("shape"))
    covered = sum((F.col(d).isNotNull().cast("int") for d in DIMENSIONS), F.lit(0))
    return x.withColumn("composite", tenth(mean_of(*map(F.col, DIMENSIONS)))).withColumn("covered", covered).withColumn("stance", level(F.col("composite")))


def levels(profiles: DataFrame) -> DataFrame:
    """Adds the level of each dimension beside its score, as <dimension>_level."""
    return profiles.withColumns({f"{d}_level": level(F.col(d)) for d in DIMENSIONS})


def extremes(profiles: DataFrame) -> DataFrame:
    """Adds the best and the worst dimension, the first of equals."""
    entries = F.filter(F.array(*[F.struct(F.col(d).alias("s"), F.lit(-i).alias("p"), F.lit(d).alias("d")) for i, d in enumerate(DIMENSIONS)]), lambda e: e["s"].isNotNull())
    low = F.transform(entries, lambda e: F.struct(e["s"].alias("s"), (-e["p"]).alias("p"), e["d"].alias("d")))
    return profiles.withColumn("best", F.array_max(entries)["d"]).withColumn("worst", F.array_min(low)["d"])


def ranked(profiles: DataFrame, within: tuple[str, ...] = ("day",), by: str = "composite", tie: str = "code") -> DataFrame:
    """Place by falling composite among those that have one."""
    w = Window.partitionBy(*within).orderBy(F.desc(by), tie)
    return profiles.filter(F.col(by).isNotNull()).withColumn("place", F.row_number().over(w))


def ranked_overall(profiles: DataFrame, by: str = "composite", tie: str = "code") -> DataFrame:
    """Place by falling composite over all rows that have one.

    A composite has one decimal, so at most 1,001 values: counts of values give each its first place, and
    only rows of one value are put in order together.
    """
    x = profiles.filter(F.col(by).isNotNull())
    counts = x.groupBy(by).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(F.lit(1)).orderBy(F.desc(by))) - F.col("_n")).drop("_n")
    inside = F.row_number().over(Window.partitionBy(by).orderBy(tie))
    return x.withColumn("_inside", inside).join(before, by).withColumn("place", (F.col("_before") + F.col("_inside")).cast("int")).drop("_before", "_inside")


def compared(profiles: DataFrame, benchmark: DataFrame, group: tuple[str, ...] = ("board", "day"), spread: float = 30.0) -> DataFrame:
    """Mean composite of each group, the benchmark's mean of the day, gap, spread and whether the group diverges."""
    mine = profiles.groupBy(*group).agg(F.count("composite").alias("scored"), F.avg("composite").alias("mean"), (F.max("composite") - F.min("composite")).alias("spread"))
    theirs = benchmark.groupBy("day").agg(F.avg("composite").alias("benchmark"))
    return mine.join(theirs, "day", "left").withColumn("gap", F.col("mean") - F.col("benchmark")).withColumn("divergent", F.col("spread") >= spread)


def _cut(x: Column, *steps: tuple[float, str], last: str) -> Column:
    """The name of the first step that x reaches; null for null."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for least, name in steps:
        out = out.when(x >= least, name)
    return out.otherwise(last)


def classes() -> dict[str, Column]:
    """What the readings of each dimension say, as codes; null where a reading is missing."""
    bias = F.filter(F.array(*[_inverse(f"MA{d}") - 1 for d in (5, 10, 20, 60)]), lambda b: b.isNotNull())
    corr = mean_of(*[F.col(f"CORR{d}") for d in (10, 20, 60)])
    rsqr, std, rsv, sump, ratio = F.col("RSQR20"), F.col("STD20"), F.col("RSV20"), F.col("SUMP20"), _inverse("VMA20")
    position = F.when(F.size(bias) == 0, F.lit(None).cast("string")).when(F.forall(bias, lambda b: b > 0), "above").when(F.forall(bias, lambda b: b <= 0), "below").otherwise("between")
    return {
        "trend_position": position,
        "trend_quality": F.when(rsqr <= 0.3, "noisy").otherwise(_cut(rsqr, (0.7, "clean"), last="middle")),
        "volatility_level": F.when(std <= 0.02, "calm").otherwise(_cut(std, (0.05, "wild"), last="middle")),
        "range_position": F.when(rsv <= 0.2, "lower").otherwise(_cut(rsv, (0.8, "upper"), last="middle")),
        "volume_level": F.when(ratio <= 0.7, "shrinking").otherwise(_cut(ratio, (1.5, "surging"), (1.1, "rising"), last="flat")),
        "volume_sum": F.when(F.col("VSUMD20") > 0, "rising").when(F.col("VSUMD20").isNotNull(), "falling"),
        "price_volume_class": F.when(corr <= -0.4, "opposed").when(corr <= -0.15, "weakly_opposed").otherwise(_cut(corr, (0.4, "aligned"), (0.15, "weakly_aligned"), last="unrelated")),
        "strength_class": F.when(sump <= 0.4, "weak").otherwise(_cut(sump, (0.6, "strong"), last="balanced")),
    }


#: Readings in the order of the dimensions; ratios to a past price or volume count only if positive.
READINGS = NEEDS


def evidence(most: int = 8) -> Column:
    """The first readings that are there, as NAME=value."""
    shown = [F.when(F.col(n) > 0 if n.startswith(("ROC", "MA", "VMA")) else F.col(n).isNotNull(), F.format_string(f"{n}=%.4f", F.col(n))) for n in READINGS]
    return F.slice(F.array_compact(F.array(*shown)), 1, most)
