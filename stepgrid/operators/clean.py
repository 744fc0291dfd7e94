"""Parsing, cleaning, regular grids, splits and validation of series."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stepgrid.series import (
    CHUNK,
    SeriesSpec,
    chunked,
    floor_div,
    in_chunk,
    micros,
    row_salt,
    spread_join,
    with_position,
)
from stepgrid.series import T as T_US
from stepgrid.session import settle

# Largest epoch magnitude -> unit. The second set reads the top
# class as microseconds and puts its limits lower.
EPOCH_S_MS_NS = ((1e15, 1_000_000_000), (1e12, 1_000))
EPOCH_S_MS_US = ((1e14, 1_000_000), (1e11, 1_000))


def epoch_units(df: DataFrame, raw: str, by: list[str], thresholds=EPOCH_S_MS_NS) -> DataFrame:
    """Ticks per second of each source, from the largest magnitude in it."""
    top = F.max(F.abs(F.col(raw).try_cast("double")))
    ticks = F.lit(1)
    for limit, per_second in reversed(thresholds):
        ticks = F.when(top >= limit, per_second).otherwise(ticks)
    return df.groupBy(*by).agg(ticks.cast("bigint").alias("ticks_per_second"))


def parse_timestamps(df: DataFrame, raw: str, by: list[str], out: str = "ts", thresholds=EPOCH_S_MS_NS, salt: Column | None = None) -> DataFrame:
    """Timestamps from datetimes, ISO text or epoch numbers.

    The epoch unit is inferred per source (``by``), as one source may mix with
    others of a different unit in the same table. A source may hold most rows,
    so units are joined back spread, over ``salt`` where it is given.
    """
    kind = df.schema[raw].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return df.withColumn(out, F.col(raw).cast("timestamp"))
    if not isinstance(kind, T.StringType):
        units = epoch_units(df, raw, by, thresholds)
        return spread_join(df, units, by, salt).withColumn(out, from_ticks(F.col(raw), F.col("ticks_per_second"))).drop("ticks_per_second")
    number = F.col(raw).try_cast("double")
    units = epoch_units(df, raw, by, thresholds)
    text = F.coalesce(F.try_to_timestamp(F.col(raw)), F.try_to_timestamp(F.col(raw), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    value = F.when(number.isNull(), text).otherwise(from_ticks(number, F.col("ticks_per_second")))
    return spread_join(df, units, by, salt).withColumn(out, value).drop("ticks_per_second")


def from_ticks(raw: Column, per_second: Column) -> Column:
    whole = raw.try_cast("bigint")
    micro = (
        F.when(per_second == 1_000_000_000, F.floor(whole / 1000))
        .when(per_second == 1_000_000, whole)
        .when(per_second == 1_000, whole * 1000)
        .otherwise(F.round(raw.try_cast("double") * 1_000_000))
    )
    return F.timestamp_micros(micro.cast("bigint"))


def parse_date_formats(col: Column, formats: list[str]) -> Column:
    """First format that fits, else null."""
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in formats])


def clean_readings(df: DataFrame, spec: SeriesSpec, order: list[str] | None = None) -> DataFrame:
    """Numeric values only, one row per (series, timestamp).

    Of duplicates the first by ``order`` (source file, position) stays; an
    aggregate, so duplicates are dropped before the shuffle as well as after.
    """
    value = F.col(spec.value).try_cast("double")
    kept = df.withColumn(spec.value, F.when(~F.isnan(value), value)).dropna(subset=[spec.ts, spec.value])
    rank = F.struct(*[F.col(c) for c in (order or [spec.value])])
    others = [c for c in kept.columns if c not in (*spec.keys, spec.ts)]
    picked = kept.groupBy(*spec.keys, spec.ts).agg(F.min_by(F.struct(*others), rank).alias("_row"))
    return picked.select(*spec.keys, spec.ts, "_row.*").drop(*[c for c in order or [] if c != spec.value])


def bucket_readings(df: DataFrame, spec: SeriesSpec, how: str = "mean") -> DataFrame:
    """One reading per step: mean, sum, max, min or first of the raw values."""
    slot = floor_div(micros(spec.ts), spec.step_us) * spec.step_us
    agg = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}.get(how)
    value = agg(spec.value) if agg else F.min_by(spec.value, micros(spec.ts))
    return (
        df.groupBy(*spec.keys, slot.alias("_slot"))
        .agg(value.alias(spec.value))
        .withColumn(spec.ts, F.timestamp_micros("_slot"))
        .drop("_slot")
    )


def keep_series(df: DataFrame, keys: list[str], minimum: int = 0, value: str | None = None, most: float = 1.0, bad: str = "missing") -> DataFrame:
    """Series with at least ``minimum`` rows and at most the share ``most`` of
    missing (or zero) values.

    Counts are taken per (series, salt) and summed per series, so the rows are
    read once to judge and once to keep.
    """
    flag = F.lit(False) if value is None else F.col(value).isNull() if bad == "missing" else F.col(value) == 0
    salt = row_salt(df, keys)
    parts = df.groupBy(*keys, salt.alias("_salt")).agg(F.count("*").alias("_n"), F.count_if(flag).alias("_bad"))
    whole = parts.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum("_bad").alias("_bad"))
    kept = whole.filter((F.col("_n") >= minimum) & (F.col("_bad") / F.col("_n") <= most)).select(*keys)
    pairs = parts.select(*keys, "_salt").join(kept, keys)
    return df.withColumn("_salt", salt).join(pairs, [*keys, "_salt"]).drop("_salt")


def grid_runs(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The readings chunked, each with the grid slots that it stands for: from ``_first`` to ``_last``.

    These are the slots from itself up to the next reading, for the first of a
    chunk also those before it. The runs of a series fill its grid, which
    starts at ``c_lo``, without overlap; a reading without slots is left out.
    The start of the series and of the next chunk come from one small row per
    chunk, so only the readings are shuffled, once.
    """
    step, width = spec.step_us, spec.chunk_us()
    ends = df.groupBy(*spec.keys, floor_div(micros(spec.ts), width).alias(CHUNK)).agg(F.min(micros(spec.ts)).alias("_lo"))
    walk = Window.partitionBy(*spec.keys).orderBy(CHUNK)
    ends = ends.withColumn("c_lo", F.first("_lo").over(walk)).withColumn("c_next", F.lead(CHUNK).over(walk) * width).drop("_lo")
    w = in_chunk(spec)
    rows = (
        chunked(df, spec)
        .withColumn("_prev", F.lag(T_US).over(w))
        .withColumn("_next", F.lead(T_US).over(w))
        .join(ends, [*spec.keys, CHUNK])
    )
    lo, t = F.col("c_lo"), F.col(T_US)
    begin = F.when(F.col("_prev").isNull(), F.greatest(lo, F.col(CHUNK) * width)).otherwise(t)
    end = F.coalesce("_next", "c_next", t + 1)
    first = lo + floor_div(begin - lo + (step - 1), step) * step
    last = lo + floor_div(end - 1 - lo, step) * step
    return rows.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last").drop("_prev", "_next", "c_next")


def regularize(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Reindex each series to its full grid; absent slots are null and
    readings off the grid are dropped.

    No join of slots with readings: the run of each reading is expanded where
    it is, long gaps block by block, never as one array.
    """
    step, width = spec.step_us, spec.chunk_us()
    rows = grid_runs(df, spec)
    t = F.col(T_US)
    rows = rows.withColumn("_block", F.explode(F.sequence("_first", "_last", F.lit(width))))
    top = F.least(F.col("_last"), F.col("_block") + (width - step))
    rows = rows.withColumn("_slot", F.explode(F.sequence("_block", top, F.lit(step))))
    others = [c for c in df.columns if c not in (*spec.keys, spec.ts)]
    return rows.select(
        *spec.keys, *[F.when(F.col("_slot") == t, F.col(c)).alias(c) for c in others], F.timestamp_micros("_slot").alias(spec.ts)
    )


def resample_mean(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Mean per step, on the full grid."""
    return regularize(bucket_readings(df, spec, "mean"), spec)


def block_sum(df: DataFrame, spec: SeriesSpec, size: int) -> DataFrame:
    """Sum of every ``size`` consecutive readings."""
    rows = with_position(df, spec).withColumn("block", floor_div(F.col("pos"), size))
    return rows.groupBy(*spec.keys, "block").agg(F.sum(spec.value).alias(spec.value), F.min(spec.ts).alias(spec.ts))


def keep_preferred(df: DataFrame, by: list[str], column: str, preferred: int) -> DataFrame:
    """Per group only rows with the preferred value, if there are any.

    An aggregate and a salted join rather than a window, so that a large group
    is never gathered.
    """
    has = df.groupBy(*by).agg(F.max((F.col(column) == preferred).cast("int")).alias("_has"))
    return spread_join(df, has, by).filter((F.col("_has") == 0) | (F.col(column) == preferred)).drop("_has")


def split_position(df: DataFrame, spec: SeriesSpec, first: float, second: float, rounding: str = "ceil") -> DataFrame:
    """Chronological ``part``: train, validation, test by position.

    ``first`` and ``second`` are the shares of train and validation; counts
    are rounded up ('ceil') or down ('floor').
    """
    rows = with_position(df, spec, total="_n")
    fix = F.ceil if rounding == "ceil" else F.floor
    a = fix(F.col("_n") * first)
    b = a + fix(F.col("_n") * second)
    part = F.when(F.col("pos") < a, "train").when(F.col("pos") < b, "validation").otherwise("test")
    return rows.withColumn("part", part).drop("_n")


def split_fixed(df: DataFrame, spec: SeriesSpec, train: int, validation: int, test: int, seq_len: int, percent: int = 100) -> DataFrame:
    """Fixed borders; validation and test reach back ``seq_len`` rows, so a
    row may be in two parts. ``percent`` cuts the training part."""
    shortened = (train - seq_len) * percent // 100 + seq_len
    borders = {
        "train": (0, shortened),
        "validation": (train - seq_len, train + validation),
        "test": (train + validation - seq_len, train + validation + test),
    }
    rows = with_position(df, spec)
    parts = [F.when(F.col("pos").between(lo, hi - 1), name) for name, (lo, hi) in borders.items()]
    return rows.withColumn("part", F.explode(F.array_compact(F.array(*parts))))


def thin_long_series(df: DataFrame, spec: SeriesSpec, limit: int, factor: int) -> DataFrame:
    """Every ``factor``-th row of series longer than ``limit``."""
    rows = with_position(df, spec, total="_n")
    return rows.filter((F.col("_n") <= limit) | (F.pmod(F.col("pos"), F.lit(factor)) == 0)).drop("_n")


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Add columns that are not there yet."""
    return df.withColumns({c: F.lit(v) for c, v in defaults.items() if c not in df.columns})


def cast_covariates(df: DataFrame, targets: list[str], skip: list[str]) -> DataFrame:
    """Numbers and booleans to float, text kept; a text target is an error."""
    for name in targets:
        if isinstance(df.schema[name].dataType, T.StringType):
            raise ValueError(f"target {name} is not numeric")
    number = (T.NumericType, T.BooleanType)
    casts = {f.name: F.col(f.name).cast("float") for f in df.schema if f.name not in skip and isinstance(f.dataType, number)}
    return df.withColumns(casts)


def validate_forecast_frame(
    df: DataFrame,
    spec: SeriesSpec,
    targets: list[str],
    future: DataFrame | None = None,
    horizon: int | None = None,
    minimum: int = 3,
) -> DataFrame:
    """Violations as rows ``(keys, problem)``; an empty result is valid.

    The readings are scanned once, into one small row per id that is written;
    all problems of an id come from that row and its count in ``future``.
    """
    from stepgrid.operators.windows import infer_freq

    for name in (*spec.keys, spec.ts, *targets):
        if name not in df.columns:
            raise ValueError(f"missing column {name}")
    if future is not None and set(targets) & set(future.columns):
        raise ValueError("future holds a target column")
    keys = list(spec.keys)
    ids = settle(infer_freq(df, spec), "frequencies")
    long, named = F.col("n") >= minimum, F.col("freq").isNotNull()
    common = ids.filter(long & named).agg(F.min("freq").alias("f")).scalar()
    problems = [
        F.when(F.col("n") < minimum, "too few points"),
        F.when(long & ~named, "irregular"),
        F.when(long & (F.col("freq") != common), "different frequency"),
    ]
    if future is not None:
        there = future.groupBy(*keys).agg(F.count("*").alias("_len"))
        ids = ids.join(there, keys, "full_outer")
        both = F.when(F.col("n").isNull(), "id only in future").when(F.col("_len").isNull(), "id without future")
        problems.append(both.when(F.col("_len") != F.lit(horizon), "wrong future length"))
    return ids.select(*keys, F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def transform_by_dataset(df: DataFrame, dataset: Column, kind: Column, branches: dict[str, dict[str, Column]]) -> DataFrame:
    """Each dataset's own transform, in one scan.

    ``branches`` gives the columns to set under a dataset's name, the name of
    its kind, or ``default``; the first of the three that is there holds, and
    without any a row stays as it is. All are expressions of one projection,
    evaluated for the rows of their dataset only.
    """
    names = [n for n in branches if n != "default"]
    out = {}
    for column in dict.fromkeys(c for columns in branches.values() for c in columns):
        own = F.col(column) if column in df.columns else F.lit(None)
        value = None
        for which in (dataset, kind):
            for name in names:
                chosen = branches[name].get(column, own)
                value = F.when(which == name, chosen) if value is None else value.when(which == name, chosen)
        last = branches.get("default", {}).get(column, own)
        out[column] = last if value is None else value.otherwise(last)
    return df.withColumns(out)


def same_columns(a: DataFrame, b: DataFrame) -> bool:
    return set(a.columns) == set(b.columns)


def id_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Ids in only one of two tables; an empty result means equal sets."""
    left = a.select(*keys).distinct().withColumn("side", F.lit("left"))
    right = b.select(*keys).distinct().withColumn("side", F.lit("right"))
    return left.join(right, keys, "left_anti").unionByName(right.join(left, keys, "left_anti"))
