"""Forecast metrics as aggregate columns.

Each takes the prediction and truth columns and returns one aggregate, so any
set of them runs in a single hash aggregation over free grouping keys.

Where ``ieee`` is an argument, a zero denominator gives by default what the
metric's text says; with ``ieee`` the term is infinite, or NaN over zero.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgrid.functions.safe import ieee_over, over_or
from stepgrid.series import spread_join


def finite_pairs(df: DataFrame, pred: str = "prediction", truth: str = "ground_truth") -> DataFrame:
    """Keep rows where both sides are real numbers."""
    keep = F.lit(True)
    for name in (pred, truth):
        c = F.col(name).cast("double")
        keep = keep & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return df.filter(keep)


GRID, GRID_TOP = 2.0**12, 2.0**36  # steps per unit of what is summed without rounding, and the largest term that is split


def steady_sum(x: Column) -> Column:
    """The sum of doubles, whatever the order of the rows.

    A plain sum ends in other last bits with other partitions. Here the
    multiples of 2**-12 are summed apart from what is left of each term: their
    sum is exact up to 2**41, and what the rest loses is far below the last bit
    of the whole. Terms of 2**36 and more, infinite ones and NaN are summed plainly.
    """
    x = x.cast("double")
    small = F.abs(x) < GRID_TOP
    whole = F.when(small, F.rint(x * GRID) / GRID).otherwise(x)
    return F.sum(whole) + F.coalesce(F.sum(F.when(small, x - whole)), F.lit(0.0))


def steady_avg(x: Column) -> Column:
    return F.try_divide(steady_sum(x), F.count(x))


def mse(p: Column, t: Column) -> Column:
    return steady_avg((p - t) * (p - t))


def rmse(p: Column, t: Column) -> Column:
    return F.sqrt(mse(p, t))


def mae(p: Column, t: Column) -> Column:
    return steady_avg(F.abs(p - t))


def mape_eps(p: Column, t: Column, eps: float = 1e-8) -> Column:
    return F.avg(F.abs(100 * (p - t) / (t + eps)))


def mspe_eps(p: Column, t: Column, eps: float = 1e-8) -> Column:
    ratio = (p - t) / (t + eps)
    return F.avg(ratio * ratio)


def smape_eps(p: Column, t: Column, eps: float = 1e-8) -> Column:
    return F.avg(200 * F.abs(p - t) / (F.abs(p) + F.abs(t) + eps))


def nd(p: Column, t: Column, ieee: bool = False) -> Column:
    over = ieee_over if ieee else F.try_divide
    return over(steady_sum(F.abs(p - t)), steady_sum(F.abs(t)))


def rse(p: Column, t: Column) -> Column:
    """Root relative squared error; the spread comes from one-pass variance."""
    return F.sqrt(F.try_divide(F.sum((t - p) * (t - p)), F.var_pop(t) * F.count(t)))


def corr(p: Column, t: Column) -> Column:
    return F.corr(p, t)


def mape_percent(p: Column, t: Column, ieee: bool = False) -> Column:
    """Plain MAPE in percent; a zero truth yields no term."""
    over = ieee_over if ieee else F.try_divide
    return F.avg(F.abs(over(p - t, t))) * 100


def smape_half(p: Column, t: Column, eps: float = 1e-7, ieee: bool = False) -> Column:
    """|p-t| over the mean of |p| and |t|; none above ``eps`` counts as no error."""
    half = (F.abs(t) + F.abs(p)) / 2
    if ieee:
        return F.avg(ieee_over(F.abs(p - t), half))
    return F.avg(F.when(half > eps, F.abs(p - t) / half).otherwise(0.0))


def over_or_one(a: Column, b: Column, ieee: bool = False) -> Column:
    """a / b, a zero denominator counted as one."""
    return ieee_over(a, b) if ieee else a / F.when(b == 0, 1.0).otherwise(b)


def smape_m4(p: Column, t: Column, ieee: bool = False) -> Column:
    """200|p-t| / (|p|+|t|), a zero denominator counted as one."""
    return F.avg(over_or_one(200 * F.abs(p - t), F.abs(p) + F.abs(t), ieee))


def mape_m4(p: Column, t: Column, ieee: bool = False) -> Column:
    """100|p-t| / |t|, a zero truth counted as one."""
    return F.avg(over_or_one(100 * F.abs(p - t), F.abs(t), ieee))


def mape_masked(p: Column, t: Column, ieee: bool = False) -> Column:
    """Loss form: |(p-t)/t| with zero truth weighing nothing."""
    if ieee:
        return F.avg(F.abs((p - t) * ieee_over(F.lit(1.0), t)))
    return F.avg(F.abs((p - t) * over_or(F.lit(1.0), t, 0.0)))


def wape(p: Column, t: Column, ieee: bool = False) -> Column:
    return nd(p, t, ieee)


def nrmse(p: Column, t: Column, ieee: bool = False) -> Column:
    over = ieee_over if ieee else F.try_divide
    return over(rmse(p, t), steady_avg(F.abs(t)))


def bias_abs_score(p: Column, t: Column, ieee: bool = False) -> Column:
    """(sum|e| + |sum e|) / sum t: accuracy and bias in one number."""
    over = ieee_over if ieee else F.try_divide
    return over(F.sum(F.abs(p - t)) + F.abs(F.sum(p - t)), F.sum(t))


def corr_products(df: DataFrame, by: list[str], pred: str, truth: str) -> DataFrame:
    """``corr_ref``: sum of deviation products over the root of the summed
    squared products. Needs the group means first, so two aggregations."""
    means = df.groupBy(*by).agg(F.avg(pred).alias("_mp"), F.avg(truth).alias("_mt"))
    both = (F.col(pred) - F.col("_mp")) * (F.col(truth) - F.col("_mt"))
    return spread_join(df, means, by).groupBy(*by).agg(
        F.try_divide(F.sum(both), F.sqrt(F.sum(both * both))).alias("corr_ref")
    )


def pinball(q: float, p: Column, t: Column, form: str = "standard") -> Column:
    """Row loss at level q. ``form='reversed'`` takes prediction minus truth,
    which is the loss at 1 - q."""
    d = (t - p) if form == "standard" else (p - t)
    return F.greatest(q * d, (q - 1) * d)


def covered(lo: Column, hi: Column, t: Column) -> Column:
    return ((lo <= t) & (t <= hi)).cast("int")


def msis(lo: Column, hi: Column, t: Column, scale: Column, alpha: float = 0.05, ieee: bool = False) -> Column:
    """Mean scaled interval score; a row with a zero scale yields no term."""
    over = ieee_over if ieee else F.try_divide
    miss = F.when(t < lo, 2 / alpha * (lo - t)).when(t > hi, 2 / alpha * (t - hi)).otherwise(0.0)
    return steady_avg(over(hi - lo + miss, scale))


def _rise(x: Column, start: float, end: float) -> Column:
    """S-curve from 20 % at ``start`` to 80 % at ``end``; one minus it falls."""
    steepness = 2 * math.log(4) / (end - start)
    return 1 / (1 + F.exp((0.5 * (start + end) - x) * steepness))


# Weights and ranges (mg/dL) of the glucose error penalty.
PENALTY = {
    "low_weight": 1.5,
    "high_weight": 1.0,
    "low_edge": 85.0,
    "low_span": 90.0,
    "high_edge": 155.0,
    "high_span": 300.0,
    "over_span": 30.0,
    "under_span": 60.0,
}


def glucose_penalty(p: Column, t: Column) -> Column:
    """>= 1: over-prediction of lows and under-prediction of highs cost more."""
    c = PENALTY
    truth_low = 1 - _rise(t, c["low_edge"] - c["low_span"], c["low_edge"])
    truth_high = _rise(t, c["high_edge"], c["high_edge"] + c["high_span"])
    low = truth_low * _rise(p - t, 0.0, c["over_span"])
    high = truth_high * (1 - _rise(p - t, -c["under_span"], 0.0))
    return 1 + c["low_weight"] * low + c["high_weight"] * high


def gmse(p: Column, t: Column) -> Column:
    return F.avg(glucose_penalty(p, t) * (p - t) * (p - t))


def gaussian_nll(mean: Column, std: Column, t: Column, eps: float = 1e-7) -> Column:
    z = F.try_divide(t - mean, std)
    density = F.try_divide(F.exp(-0.5 * z * z), std * math.sqrt(2 * math.pi))
    return F.avg(-F.log(eps + density))


def accuracy(p: Column, t: Column) -> Column:
    return F.avg((p == t).cast("int"))
