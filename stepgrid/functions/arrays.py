"""Columns over bounded arrays: windows, patches and series shards.

Arrays here are windows or shards (see ``sources.series.build_series``), so
their size has a limit that does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepgrid.functions.hashing import hash_below, hash_unit


def real(x: Column) -> Column:
    """True for a value that is neither null nor NaN."""
    return x.isNotNull() & ~F.isnan(x.cast("double"))


def impute_constant(arr: Column, value: float = 0.0) -> Column:
    return F.transform(arr, lambda x: F.when(real(x), x).otherwise(F.lit(value)))


def observed_mask(arr: Column) -> Column:
    return F.transform(arr, real)


def time_index(arr: Column) -> Column:
    return F.transform(arr, lambda _, i: i)


def variate_index(variates: Column) -> Column:
    """For an array of arrays: the variate number beside every value."""
    return F.transform(variates, lambda v, i: F.transform(v, lambda _: i))


def sample_index(arr: Column, sample: int = 1) -> Column:
    return F.transform(arr, lambda _: F.lit(sample))


def patchify(arr: Column, size: int, max_size: int, pad: float = 0.0) -> Column:
    """Whole patches of ``size``, each right-padded to ``max_size``."""
    count = F.floor(F.size(arr) / size).cast("int")
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    fill = F.array_repeat(F.lit(pad), max_size - size)
    return F.transform(starts, lambda i: F.concat(F.slice(arr, i * size + 1, F.lit(size)), fill))


def overlapping_patches(arr: Column, size: int, stride: int) -> Column:
    """Left-pad with nulls to a multiple of ``size``, then slide by stride."""
    lack = F.pmod(-F.size(arr), F.lit(size))
    full = F.concat(F.array_repeat(F.lit(None).cast("double"), lack), arr)
    starts = F.sequence(F.lit(1), F.size(arr) + lack - size + 1, F.lit(stride))
    return F.transform(starts, lambda i: F.slice(full, i, F.lit(size)))


def patch_crop(arr: Column, patch: int, min_patches: int, max_patches: int, *seeds: Column) -> Column:
    """A random run of whole patches: a random offset below one patch, a
    random patch count within the bounds, a random first patch."""
    n = F.size(arr)
    offset = hash_below(n % patch + 1, *seeds, F.lit("offset"))
    total = F.floor((n - offset) / patch).cast("int")
    most = F.least(F.lit(max_patches), total)
    count = min_patches + hash_below(most - min_patches + 1, *seeds, F.lit("count"))
    first = hash_below(total - count + 1, *seeds, F.lit("first"))
    return F.when(most >= min_patches, F.slice(arr, offset + first * patch + 1, count * patch))


def pad_to(arr: Column, minimum: int, *seeds: Column) -> Column:
    """Pad with nulls to ``minimum``, split at random between both ends."""
    lack = F.greatest(F.lit(minimum) - F.size(arr), F.lit(0))
    front = hash_below(lack + 1, *seeds)
    null = F.lit(None).cast("double")
    return F.concat(F.array_repeat(null, front), arr, F.array_repeat(null, lack - front))


def left_pad(arr: Column, length: int, pad: Column | None = None) -> Column:
    fill = F.lit(None).cast("double") if pad is None else pad
    return F.concat(F.array_repeat(fill, F.greatest(F.lit(length) - F.size(arr), F.lit(0))), arr)


def right_pad(arr: Column, length: int, pad: Column) -> Column:
    return F.concat(arr, F.array_repeat(pad, F.greatest(F.lit(length) - F.size(arr), F.lit(0))))


def prediction_mask(arr: Column, masked: Column) -> Column:
    """True over the last ``masked`` positions."""
    n = F.size(arr)
    return F.transform(arr, lambda _, i: i >= n - masked)


def extend_mask(mask: Column, other: Column) -> Column:
    """All-false mask for a field that is never predicted."""
    return F.concat(mask, F.transform(other, lambda _: F.lit(False)))


def drop_tail(arr: Column, masked: Column) -> Column:
    return F.slice(arr, F.lit(1), F.size(arr) - masked)


def transpose(rows: Column, width: int) -> Column:
    return F.array(*[F.transform(rows, _getter(i)) for i in range(width)])


def _getter(i: int):
    def pick(row: Column) -> Column:
        return F.get(row, F.lit(i))

    return pick


def moving_average(arr: Column, k: int) -> Column:
    """Trailing mean over k values, zeros before the start."""
    total = lambda window: F.aggregate(window, F.lit(0.0), lambda acc, x: acc + x)
    return F.transform(
        arr,
        lambda _, i: total(F.slice(arr, F.greatest(i - k + 2, F.lit(1)), F.least(i + 1, F.lit(k)))) / k,
    )


def window_stats(arr: Column) -> dict[str, Column]:
    """Minimum, maximum, lower median and trend of a window."""
    n = F.size(arr)
    return {
        "min_value": F.array_min(arr),
        "max_value": F.array_max(arr),
        "median_value": F.element_at(F.array_sort(arr), F.floor((n + 1) / 2).cast("int")),
        "trend": F.when(F.element_at(arr, -1) - F.element_at(arr, 1) > 0, "upward").otherwise("downward"),
    }


def circular_autocorrelation(arr: Column) -> Column:
    """Sum of x[i] * x[(i + lag) mod n] for every lag."""
    n = F.size(arr)

    def at_lag(lag: Column) -> Column:
        turned = F.concat(F.slice(arr, lag + 1, n - lag), F.slice(arr, F.lit(1), lag))
        return F.aggregate(F.zip_with(arr, turned, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)

    return F.transform(F.sequence(F.lit(0), n - 1), at_lag)


def top_lags(arr: Column, k: int) -> Column:
    """The k lags of greatest autocorrelation, ties to the smaller lag.

    Quadratic in the window length; windows beyond a few thousand values go
    through ``operators.spectral.top_lags_fft``.
    """
    scored = F.transform(
        circular_autocorrelation(arr), lambda c, lag: F.struct((-c).alias("c"), lag.alias("lag"))
    )
    return F.transform(F.slice(F.array_sort(scored), F.lit(1), F.lit(k)), lambda s: s["lag"])


def quantile_at(level: float, levels: list[float], values: list[Column]) -> Column:
    """Value at one level by linear interpolation between known levels, flat
    beyond the outer ones. Levels are plan-time constants."""
    known = sorted(zip(levels, values), key=lambda p: p[0])
    if level <= known[0][0]:
        return known[0][1]
    if level >= known[-1][0]:
        return known[-1][1]
    for (l0, v0), (l1, v1) in zip(known, known[1:]):
        if l0 <= level < l1:
            return v0 + (level - l0) / (l1 - l0) * (v1 - v0)
    raise ValueError(f"level {level} outside [0, 1]")


def weighted_quantile(samples: Column, weights: Column, level: float) -> Column:
    """Quantile of weighted samples: the inverse of the cumulative weight,
    interpolated, flat below the first and above the last sample."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    ordered = F.array_sort(
        F.zip_with(samples, weights, lambda v, w: F.struct(v.alias("v"), (w / total).alias("w")))
    )
    start = F.struct(
        F.lit(0.0).alias("cum"),
        F.lit(None).cast("double").alias("prev"),
        F.lit(None).cast("double").alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        cum = acc["cum"] + x["w"]
        inside = F.when(acc["prev"].isNull(), x["v"]).otherwise(
            acc["prev"] + (level - acc["cum"]) / x["w"] * (x["v"] - acc["prev"])
        )
        hit = acc["out"].isNull() & (cum > level)
        return F.struct(cum.alias("cum"), x["v"].alias("prev"), F.when(hit, inside).otherwise(acc["out"]).alias("out"))

    return F.aggregate(ordered, start, step, lambda acc: F.coalesce(acc["out"], acc["prev"]))


def instance_norm(arr: Column, eps: float = 1e-5, arcsinh: bool = False, center: str = "mean", root_eps: bool = False) -> dict[str, Column]:
    """Normalised window with its ``loc`` and ``scale``.

    Missing values are left out of the statistics. ``center='last'`` subtracts
    the last value; ``root_eps`` adds eps under the root instead of replacing
    a zero deviation.
    """
    seen = F.filter(arr, real)
    n = F.size(seen)
    total = F.aggregate(seen, F.lit(0.0), lambda s, x: s + x)
    mean = F.coalesce(F.try_divide(total, n), F.lit(0.0))
    squares = F.aggregate(seen, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    var = F.try_divide(squares, n)
    if root_eps:
        scale = F.coalesce(F.sqrt(var + eps), F.lit(1.0))
    else:
        std = F.coalesce(F.sqrt(var), F.lit(1.0))
        scale = F.when(std == 0, eps).otherwise(std)
    loc = mean if center == "mean" else F.element_at(arr, -1)
    return {"loc": loc, "scale": scale}


def apply_norm(arr: Column, loc: Column, scale: Column, arcsinh: bool = False) -> Column:
    def scaled(x: Column) -> Column:
        z = (x - loc) / scale
        return F.asinh(z) if arcsinh else z

    return F.transform(arr, scaled)


def invert_norm(arr: Column, loc: Column, scale: Column, arcsinh: bool = False) -> Column:
    return F.transform(arr, lambda z: (F.sinh(z) if arcsinh else z) * scale + loc)


def quantize(arr: Column, low: float, high: float, tokens: int, special: int, pad_id: int = 0) -> dict[str, Column]:
    """Mean-abs scale and token ids over ``tokens - special - 1`` centres.

    A value goes to the nearest centre, one exactly half-way up; ids are
    clamped after the special offset; missing values get ``pad_id``.
    """
    centres = tokens - special - 1
    width = (high - low) / (centres - 1)
    seen = F.filter(arr, real)
    mean_abs = F.try_divide(F.aggregate(seen, F.lit(0.0), lambda s, x: s + F.abs(x)), F.size(seen))
    scale = F.when(mean_abs > 0, mean_abs).otherwise(1.0)

    def token(x: Column) -> Column:
        bucket = F.floor((x / scale - low) / width + 0.5).cast("bigint") + 1
        inner = F.greatest(F.lit(1), F.least(F.lit(centres), bucket))
        return F.when(real(x), F.least(F.lit(tokens - 1), inner + special)).otherwise(pad_id).cast("int")

    return {"scale": scale, "tokens": F.transform(arr, token)}


def dequantize(tokens: Column, scale: Column, low: float, high: float, n_tokens: int, special: int) -> Column:
    centres = n_tokens - special - 1
    width = (high - low) / (centres - 1)
    return F.transform(
        tokens,
        lambda t: (low + width * F.greatest(F.lit(0), F.least(F.lit(centres - 1), t - special - 1))) * scale,
    )


def covariate_map(names: list[str], columns: list[str]) -> Column:
    """Named covariate arrays as one map column."""
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*[F.col(c) for c in columns]))


def random_drop(arr: Column, p: float, *seeds: Column) -> Column:
    """Each value becomes null with probability p, by seeded hash."""
    return F.transform(arr, lambda x, i: F.when(hash_unit(*seeds, i) >= p, x))


def fixed_scale(arr: Column, factor: float) -> Column:
    return F.transform(arr, lambda x: x * factor)
