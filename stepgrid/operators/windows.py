"""Context and horizon windows.

A window is found at its *last* reading, so every test looks back and one
ascending scan serves runs, segments and slices. Values are gathered once per
bounded chunk and sliced at the accepted ends only.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepgrid.functions.hashing import hash_below
from stepgrid.operators.gaps import local_runs, run_rows, segment_rows, split_rows
from stepgrid.series import (
    CHUNK,
    HOME,
    T,
    SeriesSpec,
    after,
    before,
    carry,
    chunked,
    floor_div,
    in_chunk,
    in_row_chunk,
    row_chunks,
    running,
    with_position,
)
from stepgrid.session import settle


def context_steps(hours: float, step: timedelta) -> int:
    """Hours to steps, at least one; ties go to the even step."""
    return max(1, round(timedelta(hours=hours) / step))


def horizon_steps(minutes: float, step: timedelta) -> int:
    return max(1, round(timedelta(minutes=minutes) / step))


def patch_multiple(context: int, patch: int) -> int:
    """Context rounded down to whole patches; 0 means: skip this context."""
    return context // patch * patch


def _accepts(x, length, stride: int, contiguous: bool):
    """Does a valid window of ``length`` end at this reading?

    ``x`` gives the columns _home, pos, seg_pos and _clean. Runs count the
    stride from the series start, segments from their own.
    """
    first = x("pos" if contiguous else "seg_pos") - (length - 1)
    return (
        x("_home") & (x("seg_pos") >= length - 1) & (x("_clean") >= length) & (F.pmod(first, F.lit(stride)) == 0)
    )


def window_ends(
    df: DataFrame,
    spec: SeriesSpec,
    length: int,
    stride: int = 1,
    limit: timedelta | None = None,
) -> DataFrame:
    """Chunked rows with ``_ok`` true where a valid window of ``length`` ends.

    ``limit=None``: the window must be an unbroken run. Otherwise it must lie
    in one gap-split segment.
    """
    rows = run_rows(df, spec, length) if limit is None else segment_rows(df, spec, limit, length)
    return rows.withColumn("_ok", _accepts(F.col, length, stride, limit is None))


def window_index(df: DataFrame, spec: SeriesSpec, length: int, stride: int = 1, limit: timedelta | None = None) -> DataFrame:
    """Where valid windows lie, without their values: keys, ``window_start``,
    ``start_us`` and ``end_us``, as a written table.

    Samplers draw from it and fetch the drawn windows alone (see
    :func:`gather_windows`). Windows over runs take one scan: the readings that
    end one are written with the number of readings of each chunk, and places
    are summed up from those numbers.
    """
    keys = list(spec.keys)
    if limit is not None:
        rows = window_ends(df, spec, length, stride, limit)
        rows = rows.withColumn("start_us", F.lag(T, length - 1).over(in_row_chunk(spec))).filter("_ok")
        found = rows.select(*keys, (F.col("pos") - (length - 1)).alias("window_start"), "start_us", F.col(T).alias("end_us"))
        return settle(found, "window-index")
    rows = local_runs(df, spec, length).withColumn("_here", F.max("_k").over(Window.partitionBy(*keys, CHUNK)) + 1)
    ends = F.col(HOME) & (F.col("seg_pos") >= length - 1) & (F.col("_clean") >= length)
    rows = rows.withColumn("_ok", ends).where(F.col("_ok") | (F.col(HOME) & (F.col("_k") == 0)))
    marks = settle(rows.select(*keys, CHUNK, T, "_k", "_here", "_ok"), "window-index")
    offsets = marks.where("_k = 0").select(*keys, CHUNK, F.coalesce(F.sum("_here").over(before(spec)), F.lit(0)).alias("c_off"))
    start = (F.col("c_off") + F.col("_k") - (length - 1)).alias("window_start")
    found = marks.where("_ok").join(offsets, [*keys, CHUNK]).select(*keys, start, (F.col(T) - (length - 1) * spec.step_us).alias("start_us"), F.col(T).alias("end_us"))
    return found.where(F.pmod("window_start", F.lit(stride)) == 0)


def gather_windows(df: DataFrame, spec: SeriesSpec, picked: DataFrame, context: int, horizon: int) -> DataFrame:
    """``context`` and ``target`` of the windows of an index, and no others.

    One scan: readings of chunks that hold no such window drop out by a semi
    join before any array is made; a window that lies in several chunks is put
    together from its parts.
    """
    keys, length = list(spec.keys), context + horizon
    width = spec.chunk_us()
    chunks = F.sequence(floor_div(F.col("start_us"), width), floor_div(F.col("end_us"), width))
    pairs = picked.select(*keys, "window_start", "start_us", "end_us").distinct().withColumn(CHUNK, F.explode(chunks))
    rows = chunked(df, spec).join(pairs.select(*keys, CHUNK).distinct(), [*keys, CHUNK], "left_semi")
    one = F.struct(F.col(T).alias("t"), F.col(spec.value).alias("v"))
    packed = rows.groupBy(*keys, CHUNK).agg(F.array_sort(F.collect_list(one)).alias("_r"))
    first = F.greatest(F.array_position(F.col("_r.t"), F.col("start_us")), F.lit(1)).cast("int")
    part = F.filter(F.slice("_r", first, F.lit(length)), lambda r: (r["t"] >= F.col("start_us")) & (r["t"] <= F.col("end_us")))
    parts = packed.join(pairs, [*keys, CHUNK]).select(*keys, "window_start", "start_us", part.alias("_p"))
    whole = parts.groupBy(*keys, "window_start", "start_us").agg(F.array_sort(F.flatten(F.collect_list("_p"))).alias("_w"))
    return whole.select(
        *keys,
        "window_start",
        F.timestamp_micros("start_us").alias("start_ts"),
        F.slice(F.col("_w.v"), 1, context).alias("context"),
        F.slice(F.col("_w.v"), context + 1, horizon).alias("target"),
    )


def windows_grid(
    df: DataFrame,
    spec: SeriesSpec,
    grid: list[tuple[int, int]],
    stride: int = 1,
    limit: timedelta | None = None,
    covariates: list[str] | None = None,
) -> DataFrame:
    """Windows of every (context, horizon) of a grid from one scan.

    Adds ``context_steps`` and ``horizon_steps``. The halo is that of the
    longest window; shorter ones find their readings in the same chunk.
    Stride 0 means the context.
    """
    longest = max(c + h for c, h in grid)
    rows = run_rows(df, spec, longest) if limit is None else segment_rows(df, spec, limit, longest)
    return _cut(rows, spec, grid, lambda x, c, h: _accepts(x, c + h, stride or c, limit is None), covariates)


def _cut(rows: DataFrame, spec: SeriesSpec, grid: list[tuple[int, int]], accepts, covariates: list[str] | None = None) -> DataFrame:
    """Arrays for accepted ends; the readings of a bounded chunk are gathered
    once and sliced for every configuration.

    A chunk's readings are one array of time and values; the readings that end
    a window, with the configurations they end, are another, so a chunk without
    any is dropped and a sparse stride carries little.
    """
    values = [spec.value, *(covariates or [])]
    segment = F.col("segment_id") if "segment_id" in rows.columns else F.lit(None).cast("bigint")
    size = lambda c, h: F.struct(F.lit(c).alias("c"), F.lit(h).alias("h"))
    rows = rows.withColumn("_fits", F.array_compact(F.array(*[F.when(accepts(F.col, c, h), size(c, h)) for c, h in grid])))
    one = F.struct(F.col(T).alias("t"), *[F.col(v).alias(f"v{i}") for i, v in enumerate(values)])
    end = F.struct(F.col("_i").alias("i"), "pos", segment.alias("seg"), F.col("_fits").alias("fits"))
    packed = rows.groupBy(*spec.keys, CHUNK).agg(F.array_sort(F.collect_list(one)).alias("_rows"), F.collect_list(F.when(F.size("_fits") > 0, end)).alias("_ends"))
    packed = packed.where(F.size("_ends") > 0)
    arrays = [F.col(f"_rows.v{i}").alias(f"_v{i}") for i in range(len(values))]
    found = packed.select(*spec.keys, F.col("_rows.t").alias("_ts"), *arrays, "_ends")
    found = found.select("*", F.explode("_ends").alias("e")).select("*", F.explode("e.fits").alias("f"))
    context, horizon = F.col("f.c"), F.col("f.h")
    first = F.col("e.i") - (context + horizon - 1)
    out = found.select(
        *spec.keys,
        (F.col("e.pos") - (context + horizon - 1)).alias("window_start"),
        F.col("e.seg").alias("segment_id"),
        F.timestamp_micros(F.get("_ts", first - 1)).alias("start_ts"),
        context.alias("context_steps"),
        horizon.alias("horizon_steps"),
        F.slice("_v0", first, context).alias("context"),
        F.slice("_v0", first + context, horizon).alias("target"),
        *[F.slice(f"_v{k}", first, context).alias(f"context_{name}") for k, name in enumerate(values[1:], 1)],
    )
    return out.select(*[c for c in out.columns if c != "start_ts"], "start_ts")


def windows_contiguous(df: DataFrame, spec: SeriesSpec, context: int, horizon: int, stride: int = 1) -> DataFrame:
    """Windows over unbroken runs; stride (0 = context) from the series start."""
    out = windows_grid(df, spec, [(context, horizon)], stride)
    return out.drop("segment_id", "context_steps", "horizon_steps")


def windows_segmented(
    df: DataFrame,
    spec: SeriesSpec,
    context: int,
    horizon: int,
    stride: int = 1,
    limit: timedelta = timedelta(hours=1),
    covariates: list[str] | None = None,
) -> DataFrame:
    """Windows inside gap-split segments; stride restarts in each segment.

    ``covariates`` are cut for the context only (past-only features).
    """
    out = windows_grid(df, spec, [(context, horizon)], stride, limit, covariates)
    return out.drop("context_steps", "horizon_steps")


def supervised_pairs(df: DataFrame, spec: SeriesSpec, past: int, future: int, stride: int, limit: timedelta) -> DataFrame:
    """Past array and the single value ``future`` steps ahead."""
    cutw = windows_segmented(df, spec, past, future, stride, limit)
    return cutw.withColumn("y", F.element_at("target", -1)).drop("target")


def count_windows(
    df: DataFrame,
    spec: SeriesSpec,
    length: int,
    strides: list[int],
    by: list[str],
    limit: timedelta | None = None,
) -> DataFrame:
    """Windows per group and stride without building any array."""
    if limit is None:
        rows = window_ends(df, spec, length).filter("_ok")
        first = F.col("pos") - (length - 1)
        counts = rows.groupBy(*by).agg(
            *[F.count(F.when(F.pmod(first, F.lit(s)) == 0, 1)).alias(str(s)) for s in strides]
        )
    else:
        sizes = (
            split_rows(df, spec, limit)
            .filter(HOME)
            .groupBy(*spec.keys, "segment_id")
            .agg((F.count("*") - length + 1).alias("usable"))
            .filter("usable > 0")
        )
        counts = sizes.groupBy(*by).agg(*[F.sum(F.ceil(F.col("usable") / s)).alias(str(s)) for s in strides])
    return counts.unpivot(by, [str(s) for s in strides], "stride", "windows").withColumn(
        "stride", F.col("stride").cast("int")
    )


def latest_window(df: DataFrame, spec: SeriesSpec, context: int, horizon: int = 0) -> DataFrame:
    """The last unbroken window of each series (``horizon`` > 0: with truth)."""
    rows = window_ends(df, spec, context + horizon)
    last_here = F.max(F.when(F.col("_ok"), F.col(T))).over(Window.partitionBy(*spec.keys, CHUNK))
    rows = carry(
        rows.withColumn("_last", last_here),
        spec,
        {"ends": F.count(F.when(F.col("_ok"), 1))},
        [{"c_later": F.coalesce(F.sum("ends").over(after(spec)), F.lit(0))}],
    )
    rows = rows.withColumn("_ok", F.col("_ok") & (F.col(T) == F.col("_last")) & (F.col("c_later") == 0))
    out = _cut(rows, spec, [(context, horizon)], lambda x, c, h: x("_ok"))
    return out.drop("segment_id", "context_steps", "horizon_steps")


def persistence_pairs(df: DataFrame, spec: SeriesSpec, horizon: int | list[int], missing: bool = False) -> DataFrame:
    """The value at t as the forecast of t + horizon, over unbroken runs.

    One shuffle for any number of horizons: a run of that many steps never
    reaches past the halo. A list of horizons adds ``horizon_steps``. Pairs with
    a null value are left out unless ``missing``.
    """
    horizons = [horizon] if isinstance(horizon, int) else horizon
    rows = chunked(df, spec, behind_us=max(horizons) * spec.step_us)
    w = in_chunk(spec)
    gap = F.col(T) - F.lag(T).over(w)
    rows = (
        rows.withColumn("_new", gap.isNull() | (gap != spec.step_us))
        .withColumn("_since", F.last(F.when(F.col("_new"), F.col(T)), ignorenulls=True).over(running(w)))
        .withColumns({f"_p{h}": F.lag(spec.value, h).over(w) for h in horizons})
        .filter(F.col(HOME) & (F.lit(missing) | F.col(spec.value).isNotNull()))
    )

    def pair(h: int) -> Column:
        whole = (F.col(T) - F.col("_since") >= h * spec.step_us) & (F.lit(missing) | F.col(f"_p{h}").isNotNull())
        return F.when(whole, F.struct(F.lit(h).alias("horizon_steps"), F.col(f"_p{h}").alias("prediction")))

    keep = [F.col(spec.ts), "prediction", F.col(spec.value).alias("ground_truth")]
    if isinstance(horizon, int):
        found = rows.withColumn("_f", pair(horizon)).filter("_f is not null")
        return found.withColumn("prediction", F.col("_f.prediction")).select(*spec.keys, *keep)
    found = rows.withColumn("_f", F.explode(F.array_compact(F.array(*[pair(h) for h in horizons]))))
    found = found.withColumn("prediction", F.col("_f.prediction")).withColumn("horizon_steps", F.col("_f.horizon_steps"))
    return found.select(*spec.keys, "horizon_steps", *keep)


def lag_rows(df: DataFrame, spec: SeriesSpec, lags: dict[str, int], value: str | None = None) -> DataFrame:
    """Columns holding the value some readings back; ``df`` carries ``pos``."""
    value = value or spec.value
    rows = row_chunks(df, spec, max(lags.values()))
    w = in_row_chunk(spec)
    return (
        rows.withColumns({name: F.lag(value, k).over(w) for name, k in lags.items()})
        .filter(HOME)
        .drop(CHUNK, HOME)
    )


def last_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Last n rows per key; Spark prunes to n per key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def first_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(order))
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


# Windows at places counted in readings. Series of any length are cut into row
# chunks with a halo of one window, so a window is a slice of one bounded array.


def chunk_width(spec: SeriesSpec, length: int) -> int:
    """Places that a row chunk of windows of ``length`` spans."""
    return max(spec.chunk_steps, 4 * max(length - 1, 1))


def chunk_arrays(df: DataFrame, spec: SeriesSpec, length: int) -> DataFrame:
    """Bounded arrays that hold every run of ``length`` readings of a series.

    One row per chunk: keys, ``n`` (readings of the series), ``base`` (place of
    the first value), ``values``, and ``lo`` to ``hi``, the places at which
    windows of this chunk end.
    """
    rows = row_chunks(with_position(df, spec, total="_total"), spec, max(length - 1, 1))
    packed = rows.groupBy(*spec.keys, CHUNK).agg(
        F.max("_total").alias("n"),
        F.array_sort(F.collect_list(F.struct("pos", spec.value))).alias("_r"),
        F.min(F.when(F.col(HOME), F.col("pos"))).alias("lo"),
        F.max(F.when(F.col(HOME), F.col("pos"))).alias("hi"),
    )
    arrays = F.element_at("_r", 1)["pos"].alias("base"), F.col(f"_r.{spec.value}").alias("values")
    return packed.where("lo IS NOT NULL").select(*spec.keys, "n", *arrays, "lo", "hi")


def between(start: Column, length: Column) -> Column:
    """Values from a place on, of a chunk whose array holds them."""
    return F.slice("values", (start - F.col("base") + 1).cast("int"), length.cast("int"))


def _ends_here(end: Column) -> Column:
    return (end >= F.col("lo")) & (end <= F.col("hi"))


def _strided(chunks: DataFrame, length: int, stride: int) -> DataFrame:
    """``at``: starts of all windows of ``length`` that end in the chunk, at multiples of ``stride``."""
    first = F.ceil(F.greatest(F.col("lo") - length + 1, F.lit(0)) / stride) * stride
    last = F.col("hi") - length + 1
    return chunks.where(first <= last).withColumn("at", F.explode(F.sequence(first, last, F.lit(stride).cast("bigint"))))


def rolling_slices(df: DataFrame, spec: SeriesSpec, offset: int, distance: int, windows: int, context: int, horizon: int) -> DataFrame:
    """Evaluation windows at ``offset + w * distance``; negative offset counts
    from the end. Contexts are cut to what exists before the forecast start."""
    out = chunk_arrays(df, spec, context + horizon)
    start = F.col("n") + offset if offset < 0 else F.lit(offset)
    out = out.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    out = out.withColumn("forecast_start", start + F.col("window") * distance)
    out = out.filter((F.col("forecast_start") >= 1) & _ends_here(F.col("forecast_start") + horizon - 1))
    have = F.least(F.col("forecast_start"), F.lit(context))
    return out.select(
        *spec.keys,
        "window",
        "forecast_start",
        between(F.col("forecast_start") - have, have).alias("context"),
        between(F.col("forecast_start"), F.lit(horizon)).alias("label"),
    )


def rolling_origin(df: DataFrame, spec: SeriesSpec, prediction_length: int, folds: int) -> DataFrame:
    """Backtest: fold k holds out prediction_length values, the last fold the
    final ones; everything earlier is history. One row per reading and fold
    (``fold, cut_at, part``), as a history has no bound."""
    rows = with_position(df, spec, total="_total").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    rows = rows.withColumn("cut_at", F.col("_total") - (folds - F.col("fold")) * prediction_length)
    rows = rows.filter((F.col("cut_at") >= 1) & (F.col("pos") < F.col("cut_at") + prediction_length))
    return rows.withColumn("part", F.when(F.col("pos") < F.col("cut_at"), "history").otherwise("label")).drop("_total")


def encoder_decoder(df: DataFrame, spec: SeriesSpec, seq_len: int, label_len: int, pred_len: int, stride: int = 1) -> DataFrame:
    """Encoder input and decoder target that overlap by ``label_len``."""
    length = seq_len + pred_len
    out = _strided(chunk_arrays(df, spec, length), length, stride)
    return out.select(
        *spec.keys,
        F.col("at").alias("s_begin"),
        between(F.col("at"), F.lit(seq_len)).alias("seq_x"),
        between(F.col("at") + seq_len - label_len, F.lit(label_len + pred_len)).alias("seq_y"),
    )


def stepped_windows(df: DataFrame, spec: SeriesSpec, size: int, step: int) -> DataFrame:
    """Fixed windows with a step; ``step=size`` gives non-overlapping ones."""
    out = _strided(chunk_arrays(df, spec, size), size, step)
    return out.select(*spec.keys, "at", between(F.col("at"), F.lit(size)).alias("window"))


def _padded(values: Column, width: int, left: bool) -> tuple[Column, Column]:
    """Values filled up with zeros to ``width``, and the 0/1 mask."""
    lack = F.lit(width) - F.size(values)
    zeros, ones = F.array_repeat(F.lit(0.0), lack), F.array_repeat(F.lit(1.0), F.size(values))
    return (F.concat(zeros, values), F.concat(zeros, ones)) if left else (F.concat(values, zeros), F.concat(ones, zeros))


def padded_tail(df: DataFrame, spec: SeriesSpec, n: int) -> DataFrame:
    """Last n values left-padded with zeros, and the 0/1 mask."""
    out = chunk_arrays(df, spec, n).filter(_ends_here(F.col("n") - 1))
    have = F.least(F.col("n"), F.lit(n))
    values, mask = _padded(between(F.col("n") - have, have), n, left=True)
    return out.select(*spec.keys, values.alias("insample"), mask.alias("insample_mask"))


def cut_point_window(df: DataFrame, spec: SeriesSpec, key: Column, seed: int, limit: int, insample: int, outsample: int) -> DataFrame:
    """A seeded cut in the last ``limit`` positions, padded left and right;
    ``key`` names the series in the draw. A single reading has no cut."""
    out = chunk_arrays(df, spec, insample + outsample).filter("n > 1")
    low = F.greatest(F.lit(1), F.col("n") - limit)
    out = out.withColumn("cut", low + hash_below(F.col("n") - low, key, F.lit(seed)))
    ahead = F.least(F.col("n") - F.col("cut"), F.lit(outsample))
    out = out.withColumn("ahead", ahead).filter(_ends_here(F.col("cut") + F.col("ahead") - 1))
    have = F.least(F.col("cut"), F.lit(insample))
    before, before_mask = _padded(between(F.col("cut") - have, have), insample, left=True)
    after, after_mask = _padded(between(F.col("cut"), F.col("ahead")), outsample, left=False)
    named = {"insample": before, "insample_mask": before_mask, "outsample": after, "outsample_mask": after_mask}
    return out.select(*spec.keys, "cut", *[c.alias(k) for k, c in named.items()])


def shared_axis_windows(
    df: DataFrame, spec: SeriesSpec, covariate: str, offset: int, history: int, horizon: int, shift: int, windows: int
) -> DataFrame:
    """Rolling windows over a shared axis with the covariate cut alongside.

    The covariate is known for the first readings of a series and null after
    them; windows beyond its end are left out, and one it ends in repeats its
    last value."""
    pair = F.struct(F.col(spec.value).alias("v"), F.col(covariate).alias("c")).alias(spec.value)
    length = history + horizon
    out = chunk_arrays(df.select(*spec.keys, spec.ts, pair), spec, length)
    out = out.withColumn("window", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    out = out.withColumn("at", (F.lit(offset) + F.col("window") * shift).cast("bigint"))
    end = F.least(F.col("at") + length, F.col("n")) - 1
    out = out.filter((F.col("at") + history <= F.col("n")) & _ends_here(end))
    out = out.withColumn("_w", between(F.col("at"), F.least(F.lit(length), F.col("n") - F.col("at"))))
    features = F.filter("_w.c", lambda c: c.isNotNull())
    out = out.withColumn("_f", features).filter(F.size("_f") > 0)
    fill = F.array_repeat(F.element_at("_f", -1), F.lit(length) - F.size("_f"))
    return out.select(
        *spec.keys,
        "window",
        "at",
        F.slice("_w.v", 1, history).alias("past"),
        F.slice("_w.v", history + 1, horizon).alias("future"),
        F.concat("_f", fill).alias("features"),
    )


def future_timestamps(df: DataFrame, keys: list[str], ts: str, step: timedelta, horizon: int) -> DataFrame:
    """``horizon`` timestamps after the last one of each key."""
    last = df.groupBy(*keys).agg(F.max(ts).alias("_last"))
    step_us = int(step / timedelta(microseconds=1))
    ahead = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    return (
        last.withColumn("horizon_step", ahead)
        .withColumn(ts, F.timestamp_micros(F.unix_micros(F.col("_last").cast("timestamp")) + F.col("horizon_step") * step_us))
        .drop("_last")
    )


def calendar_shift(months: int, ts: str) -> Column:
    """A timestamp some months on, keeping month ends at month ends."""
    moved = F.add_months(F.col(ts), months)
    at_end = F.dayofmonth(F.last_day(ts)) == F.dayofmonth(ts)
    return F.when(at_end, F.last_day(moved)).otherwise(moved)


def _step_columns(now: Column, then: Column) -> dict[str, Column]:
    """Least and greatest step of pairs of neighbours, in time and months, and whether all keep their day of the month."""
    step = F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))
    months = (F.year(now) - F.year(then)) * 12 + F.month(now) - F.month(then)
    same_day = (F.dayofmonth(now) == F.dayofmonth(then)) | ((F.last_day(now) == F.to_date(now)) & (F.last_day(then) == F.to_date(then)))
    edge = F.when(then.isNotNull(), same_day.cast("int"))
    return {"lo": step, "hi": step, "mlo": months, "mhi": months, "edge": edge}


def step_summary(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Per series ``n``, least and greatest step (``lo, hi``), months (``mlo, mhi``) and ``edge``.

    One scan and one shuffle of the timestamps: a chunk becomes one row of
    mergeable numbers with its first and last time, and steps across chunk
    borders are taken between those rows.
    """
    keys = list(spec.keys)
    merge = {"lo": F.min, "hi": F.max, "mlo": F.min, "mhi": F.max, "edge": F.min}
    rows = chunked(df.select(*keys, spec.ts), spec)
    rows = rows.withColumn("_then", F.lag(spec.ts).over(in_chunk(spec)))
    inner = _step_columns(F.col(spec.ts), F.col("_then"))
    each = rows.groupBy(*keys, CHUNK).agg(
        F.count("*").alias("n"),
        F.min(spec.ts).alias("_first"),
        F.max(spec.ts).alias("_last"),
        *[merge[name](column).alias(name) for name, column in inner.items()],
    )
    each = each.withColumn("_then", F.lag("_last").over(Window.partitionBy(*keys).orderBy(CHUNK)))
    border = _step_columns(F.col("_first"), F.col("_then"))
    pick = {name: F.greatest if f is F.max else F.least for name, f in merge.items()}
    each = each.withColumns({name: pick[name](F.col(name), border[name]) for name in merge})
    return each.groupBy(*keys).agg(F.sum("n").alias("n"), *[f(name).alias(name) for name, f in merge.items()])


def infer_freq(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """One frequency per series: a fixed step, a month/quarter/year step, or
    ``freq`` null when the steps are mixed."""
    found = step_summary(df, spec).withColumn("edge", F.coalesce("edge", F.lit(0)))
    name = (
        F.when(F.col("lo") == F.col("hi"), F.concat((F.col("lo") / 1_000_000).cast("bigint").cast("string"), F.lit("s")))
        .when((F.col("edge") == 1) & (F.col("mlo") == F.col("mhi")) & (F.col("mlo") > 0), F.concat(F.col("mlo").cast("string"), F.lit("mo")))
    )
    return found.select(*spec.keys, "n", name.alias("freq"))


def patched_context(windows: DataFrame, patch: int, context: str = "context") -> DataFrame:
    """Contexts cut to their newest whole patches; those below one patch are left out."""
    size = F.size(context) - F.size(context) % patch
    return windows.filter(size > 0).withColumn(context, F.slice(context, F.size(context) - size + 1, size))
