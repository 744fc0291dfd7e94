"""Series rows: arrays per item, cut into shards of bounded length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgrid.operators.clean import grid_runs
from stepgrid.series import SALTS, SeriesSpec, T, floor_div, spread_join, with_position
from stepgrid.session import settle

SHARD_ROWS = 65_536


def build_series(
    df: DataFrame,
    spec: SeriesSpec,
    freq: str,
    targets: list[str],
    covariates: list[str] | None = None,
    shard_rows: int = SHARD_ROWS,
    multivariate: bool = False,
) -> DataFrame:
    """One row per item: item_id, start, freq, target[, past_feat_dynamic_real].

    An item longer than ``shard_rows`` becomes several rows in order of
    ``shard``, each with its own start, so no array outgrows a task; all
    values are kept. ``multivariate`` gives the target as array of arrays.
    """
    covariates = covariates or []
    rows = with_position(df, spec).withColumn("shard", floor_div(F.col("pos"), shard_rows))
    one = F.struct(
        F.col(spec.ts).alias("t"), *[F.col(c).cast("float").alias(c) for c in [*targets, *covariates]]
    )
    packed = rows.groupBy(*spec.keys, "shard").agg(F.array_sort(F.collect_list(one)).alias("_r"))
    item = F.concat_ws("__", *[F.col(k).cast("string") for k in spec.keys])
    target = F.array(*[F.col(f"_r.{t}") for t in targets]) if multivariate else F.col(f"_r.{targets[0]}")
    out = packed.select(
        item.alias("item_id"),
        "shard",
        F.element_at("_r", 1)["t"].alias("start"),
        F.lit(freq).alias("freq"),
        target.alias("target"),
        *([F.array(*[F.col(f"_r.{c}") for c in covariates]).alias("past_feat_dynamic_real")] if covariates else []),
    )
    return out


def cut_rows(df: DataFrame, spec: SeriesSpec, offset: int | None = None, date_offset: str | None = None) -> DataFrame:
    """Rows before a row offset or up to a date, for train parts."""
    if date_offset is not None:
        return df.filter(F.col(spec.ts) <= F.lit(date_offset).cast("timestamp"))
    if offset is None:
        return df
    if offset >= 0:
        return with_position(df, spec).filter(F.col("pos") < offset).drop("pos")
    rows = with_position(df, spec, total="_n")
    return rows.filter(F.col("pos") < F.col("_n") + offset).drop("pos", "_n")


def wide_to_long(df: DataFrame, ts: str, columns: list[str] | None = None, item: str = "item_id") -> DataFrame:
    """One column per series to one row per reading."""
    columns = columns or [c for c in df.columns if c != ts]
    return df.unpivot([ts], columns, item, "value")


def corpus_series(
    df: DataFrame, spec: SeriesSpec, freq: str, minimum: int, most_missing: float, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """Regular grid, then drop short or sparse series, then series rows.

    The grid is packed as runs, one per reading, and expanded to values only in
    the rows of kept series. The packed rows are settled, as judging and
    keeping each read them; they hold about as much as the readings.
    """
    keys, step = list(spec.keys), spec.step_us
    nth = lambda us: floor_div(F.col(us) - F.col("c_lo"), step)
    runs = grid_runs(df, spec).withColumn("_lo", nth("_first")).withColumn("_hi", nth("_last"))
    own = F.when(F.pmod(F.col(T) - F.col("c_lo"), F.lit(step)) == 0, nth(T))  # the slot of the reading itself, if it is on the grid
    runs = runs.withColumn("_own", own).withColumn("shard", F.explode(F.sequence(floor_div(F.col("_lo"), shard_rows), floor_div(F.col("_hi"), shard_rows))))
    runs = runs.withColumn("_lo", F.greatest("_lo", F.col("shard") * shard_rows)).withColumn("_hi", F.least("_hi", (F.col("shard") + 1) * shard_rows - 1))
    here = F.col("_own").between(F.col("_lo"), F.col("_hi"))
    run = F.struct(
        (F.col("_lo") - F.col("shard") * shard_rows).cast("int").alias("at"),
        F.when(here, F.col("_own") - F.col("_lo")).otherwise(0).cast("int").alias("before"),
        F.when(here, F.col(spec.value).cast("float")).alias("v"),
        F.when(here, F.col("_hi") - F.col("_own")).otherwise(F.col("_hi") - F.col("_lo")).cast("int").alias("behind"),
    )
    bad = F.col("_hi") - F.col("_lo") + 1 - (here & F.col(spec.value).isNotNull()).cast("int")
    packed = runs.groupBy(*keys, "shard").agg(
        F.min("c_lo").alias("_start"), F.sum(F.col("_hi") - F.col("_lo") + 1).alias("_n"), F.sum(F.coalesce(bad, F.col("_hi") - F.col("_lo") + 1)).alias("_bad"), F.array_sort(F.collect_list(run)).alias("_r")
    )
    packed = settle(packed, "packed")
    whole = packed.groupBy(*keys).agg(F.sum("_n").alias("_n"), F.sum("_bad").alias("_bad"))
    kept = whole.filter((F.col("_n") >= minimum) & (F.col("_bad") / F.col("_n") <= most_missing)).select(*keys)
    kept = spread_join(packed, kept, keys, F.pmod("shard", F.lit(SALTS)))
    none = F.lit(None).cast("float")
    values = F.transform("_r", lambda r: F.concat(F.array_repeat(none, r["before"]), F.array(r["v"]), F.array_repeat(none, r["behind"])))
    start = F.timestamp_micros(F.col("_start") + F.col("shard") * (shard_rows * step))
    item = F.concat_ws("__", *[F.col(k).cast("string") for k in keys])
    return kept.select(item.alias("item_id"), "shard", start.alias("start"), F.lit(freq).alias("freq"), F.flatten(values).alias("target"))


def with_dynamic_features(df: DataFrame, features: DataFrame, on: list[str]) -> DataFrame:
    """Feature file joined to entity rows by time; entities stay whole."""
    return df.join(features, on, "left")


def align_measures(tables: list[DataFrame], on: list[str]) -> DataFrame:
    """Measure tables with the same keys side by side."""
    out = tables[0]
    for more in tables[1:]:
        out = out.join(more, on)
    return out


def measure_series(tables: dict[str, DataFrame], spec: SeriesSpec, freq: str, how: str = "inner", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Measures that lie in tables of their own as one multivariate series per key.

    Each table has the keys, the time and ``spec.value``. All meet in one
    shuffle by key and time (a table that has several values for a time gives
    its greatest); 'inner' keeps the times that every measure has, 'outer' all,
    with nulls. The target holds one array per measure, in the order of
    ``tables`` and aligned by time.
    """
    rows = None
    for name, df in tables.items():
        part = df.select(*spec.keys, spec.ts, F.lit(name).alias("_measure"), F.col(spec.value).cast("double").alias("_v"))
        rows = part if rows is None else rows.unionByName(part)
    mine = lambda name: F.col("_measure") == name
    wide = rows.groupBy(*spec.keys, spec.ts).agg(
        *[F.max(F.when(mine(name), F.col("_v"))).alias(name) for name in tables],
        F.count_distinct("_measure").alias("_tables") if how == "inner" else F.lit(len(tables)).alias("_tables"),
    )
    whole = wide.filter(F.col("_tables") == len(tables)).drop("_tables")
    return build_series(whole, spec, freq, list(tables), shard_rows=shard_rows, multivariate=True)


def cell_series(df: DataFrame, spec: SeriesSpec, freq: str, variables: list[str], var: str, value: str) -> DataFrame:
    """Gridded long table (cell, ts, variable, value): one multivariate
    series per cell."""
    wide = df.groupBy(*spec.keys, spec.ts).agg(
        *[F.max(F.when(F.col(var) == v, F.col(value))).alias(v) for v in variables]
    )
    return build_series(wide, spec, freq, variables, multivariate=True)


def flatten_variates(df: DataFrame, target: str) -> DataFrame:
    """Multivariate rows to one row per variate."""
    others = [c for c in df.columns if c != target]
    return df.select(*others, F.posexplode(target).alias("variate", target))


def read_partitioned(spark, path: str, ts: str, item: str = "item_id") -> DataFrame:
    """Hive-partitioned wide Parquet to long readings; partition columns are
    kept as keys and pruned on filter."""
    raw = spark.read.parquet(path)
    numeric = [f.name for f in raw.schema if f.dataType.typeName() in ("double", "float")]
    keep = [c for c in raw.columns if c not in numeric]
    return raw.unpivot(keep, numeric, item, "value")


def quantile_columns(levels: list[float], kind: str = "level") -> list[Column]:
    """Rename prediction-interval columns (lo-80, hi-80, ...) to quantiles."""
    out = []
    for q in levels:
        if abs(q - 0.5) < 1e-12:
            out.append(F.col("median").alias("q50"))
            continue
        level = round(abs(1 - 2 * q) * 100)
        side = "lo" if q < 0.5 else "hi"
        out.append(F.col(f"`{side}-{level}`").alias(f"q{round(q * 100)}"))
    return out


def level_columns(levels: list[float], median: str = "median") -> list[Column]:
    """Rename quantile columns (q10, q50, ...) back to lo/hi levels."""
    out = []
    for q in levels:
        level = round(abs(1 - 2 * q) * 100)
        name = median if level == 0 else f"{'lo' if q < 0.5 else 'hi'}-{level}"
        out.append(F.col(f"q{round(q * 100)}").alias(name))
    return out
