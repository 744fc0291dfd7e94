"""Random counts as column expressions that take the same space for any n.

A binomial count is drawn by inversion where its mean is small (one uniform,
walked through the distribution) and by transformed rejection (Hoermann 1993)
beyond, where a few pairs of uniforms settle it. All uniforms are seeded
hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepgrid.functions.hashing import hash_unit

INVERSION_MEAN = 30.0  # up to this mean, inversion
STEPS = 160  # a count of mean 30 is beyond with a chance below 2**-60, the grain of a uniform
ATTEMPTS = 48  # each is accepted with a chance above 0.6

# log(k!) less its leading Stirling terms, for k from 0 to 9
TAILS = [math.lgamma(k + 1) - (0.5 * math.log(2 * math.pi) + (k + 0.5) * math.log(k + 1) - (k + 1)) for k in range(10)]


def _tail(k: Column) -> Column:
    x = k + 1
    series = (1 / 12 - (1 / 360 - 1 / 1260 / (x * x)) / (x * x)) / x
    return F.when(k < 10, F.get(F.array(*[F.lit(t) for t in TAILS]), F.greatest(k, F.lit(0)).cast("int"))).otherwise(series)


def _inverted(n: Column, p: Column, u: Column) -> Column:
    """The count whose cumulative chance first exceeds ``u``, for p up to one half."""
    start = F.struct(F.pow(1 - p, n).alias("chance"), F.pow(1 - p, n).alias("upto"), F.lit(0).cast("bigint").alias("k"))

    def step(acc: Column, i: Column) -> Column:
        chance = acc["chance"] * (n - i) / (i + 1) * p / (1 - p)
        on = (acc["upto"] <= u) & (i < n)
        moved = F.struct(chance.alias("chance"), (acc["upto"] + chance).alias("upto"), (i + 1).cast("bigint").alias("k"))
        return F.when(on, moved).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS - 1)), start, step, lambda acc: acc["k"])


def _rejected(n: Column, p: Column, seeds: tuple[Column, ...]) -> Column:
    """Transformed rejection, for p up to one half and a mean of ten or more."""
    spread = F.sqrt(n * p * (1 - p))
    b = 1.15 + 2.53 * spread
    a = -0.0873 + 0.0248 * b + 0.01 * p
    odds, mode = p / (1 - p), F.floor((n + 1) * p)
    alpha = (2.83 + 5.1 / b) * spread
    centre = n * p + 0.5

    def attempt(i: Column) -> Column:
        u = hash_unit(*seeds, F.lit("u"), i) - 0.5
        v = hash_unit(*seeds, F.lit("v"), i)
        us = F.greatest(0.5 - F.abs(u), F.lit(1e-18))
        k = F.floor((2 * a / us + b) * u + centre)
        level = F.log(F.greatest(v, F.lit(1e-300)) * alpha / (a / (us * us) + b))
        bound = (
            (mode + 0.5) * F.log((mode + 1) / (odds * (n - mode + 1)))
            + (n + 1) * F.log((n - mode + 1) / (n - k + 1))
            + (k + 0.5) * F.log(odds * (n - k + 1) / (k + 1))
            + _tail(mode) + _tail(n - mode) - _tail(k) - _tail(n - k)
        )
        inside = (k >= 0) & (k <= n)
        plain = (us >= 0.07) & (v <= 0.92 - 4.2 / b)
        return F.when(inside & plain, k).when(inside & (level <= bound), k).cast("bigint")

    none = F.lit(None).cast("bigint")
    drawn = F.aggregate(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1)), none, lambda acc, i: F.when(acc.isNotNull(), acc).otherwise(attempt(i)))
    return F.coalesce(drawn, mode.cast("bigint"))


def binomial(n: Column, p: Column, *seeds: Column) -> Column:
    """A seeded binomial(n, p) count; 0 for n of 0 or less, null for a null n or p."""
    trials = F.greatest(n.cast("bigint"), F.lit(0).cast("bigint"))
    chance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p.cast("double")))
    small = F.least(chance, 1 - chance)
    mean = trials * small
    drawn = F.when(mean <= INVERSION_MEAN, _inverted(trials, small, hash_unit(*seeds, F.lit("count")))).otherwise(_rejected(trials, small, seeds))
    out = F.when(chance <= 0.5, drawn).otherwise(trials - drawn)
    return F.when(n.isNotNull() & p.isNotNull(), out)


def beta(a: int, b: int, *seeds: Column) -> Column:
    """A seeded Beta(a, b) number for whole a and b: the a-th smallest of a + b - 1 uniforms."""
    draws = F.array(*[hash_unit(*seeds, F.lit("beta"), F.lit(i)) for i in range(a + b - 1)])
    return F.element_at(F.array_sort(draws), a)
