"""Imputation of long series with state carried across chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgrid.series import (
    CHUNK,
    HOME,
    T,
    SeriesSpec,
    after,
    before,
    carry,
    chunked,
    in_chunk,
    running,
    with_position,
)


def _seen(name: str):
    c = F.col(name).cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c), c)


def impute_constant(df: DataFrame, spec: SeriesSpec, value: float = 0.0) -> DataFrame:
    return df.withColumn("imputed", F.coalesce(_seen(spec.value), F.lit(value)))


def _filled(df: DataFrame, spec: SeriesSpec, default: float) -> DataFrame:
    """Chunked rows with the forward fill in ``imputed``."""
    w = running(in_chunk(spec))
    rows = chunked(df, spec).withColumn("_v", _seen(spec.value))
    rows = rows.withColumn("imputed", F.last("_v", ignorenulls=True).over(w))
    rows = carry(
        rows,
        spec,
        {"last_v": F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(T)))},
        [{"c_last": F.last("last_v", ignorenulls=True).over(before(spec))}],
    )
    return rows.withColumn("imputed", F.coalesce("imputed", "c_last", F.lit(default))).drop("c_last")


def impute_last(df: DataFrame, spec: SeriesSpec, default: float = 0.0) -> DataFrame:
    """Last seen value; ``default`` before the first one."""
    return _filled(df, spec, default).drop(T, CHUNK, HOME, "_v")


def impute_causal_mean(df: DataFrame, spec: SeriesSpec, default: float = 0.0) -> DataFrame:
    """Missing values become the mean of everything before them in the
    forward-filled series; the first row keeps its fill."""
    rows = _filled(df, spec, default).withColumnRenamed("imputed", "_fill")
    w = in_chunk(spec)
    rows = rows.withColumn("_sum", F.sum("_fill").over(running(w)) - F.col("_fill"))
    rows = rows.withColumn("_cnt", F.row_number().over(w) - 1)
    rows = carry(
        rows,
        spec,
        {"s": F.sum("_fill"), "n": F.count("*")},
        [
            {
                "c_sum": F.coalesce(F.sum("s").over(before(spec)), F.lit(0.0)),
                "c_cnt": F.coalesce(F.sum("n").over(before(spec)), F.lit(0)),
            }
        ],
    )
    n = F.col("_cnt") + F.col("c_cnt")
    mean = (F.col("_sum") + F.col("c_sum")) / n
    out = F.when(F.col("_v").isNull() & (n > 0), mean).otherwise(F.col("_fill"))
    return rows.withColumn("imputed", out).drop(T, CHUNK, HOME, "_v", "_fill", "_sum", "_cnt", "c_sum", "c_cnt")


def impute_linear(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Drop leading missing rows, interpolate by position, hold the end."""
    rows = with_position(df, spec, keep_chunks=True).withColumn("_v", _seen(spec.value))
    point = F.when(F.col("_v").isNotNull(), F.struct(F.col("pos").alias("p"), F.col("_v").alias("v")))
    rows = rows.withColumn("_pt", point)
    rows = rows.withColumn("_prev", F.last("_pt", ignorenulls=True).over(running(in_chunk(spec))))
    rows = rows.withColumn("_next", F.last("_pt", ignorenulls=True).over(running(in_chunk(spec, descending=True))))
    seen_t = F.when(F.col("_pt").isNotNull(), F.col(T))
    rows = carry(
        rows,
        spec,
        {"first_pt": F.min_by("_pt", seen_t), "last_pt": F.max_by("_pt", seen_t)},
        [
            {
                "c_prev": F.last("last_pt", ignorenulls=True).over(before(spec)),
                "c_next": F.last("first_pt", ignorenulls=True).over(after(spec)),
            }
        ],
    )
    prev, nxt = F.coalesce("_prev", "c_prev"), F.coalesce("_next", "c_next")
    slope = (nxt["v"] - prev["v"]) / (nxt["p"] - prev["p"])
    value = (
        F.when(F.col("_v").isNotNull(), F.col("_v"))
        .when(nxt.isNull(), prev["v"])
        .otherwise(prev["v"] + (F.col("pos") - prev["p"]) * slope)
    )
    return (
        rows.filter(prev.isNotNull())
        .withColumn("imputed", value)
        .drop(T, CHUNK, HOME, "_v", "_pt", "_prev", "_next", "c_prev", "c_next")
    )


def zero_pad_series(df: DataFrame, spec: SeriesSpec, minimum: int) -> DataFrame:
    """Series shorter than ``minimum`` get earlier rows of value 0."""
    ends = df.groupBy(*spec.keys).agg(F.count("*").alias("_n"), F.min(spec.ts).alias("_lo"))
    short = ends.filter(F.col("_n") < minimum)
    k = F.explode(F.sequence(F.lit(1), minimum - F.col("_n"))).alias("_k")
    lo = F.unix_micros(F.col("_lo").cast("timestamp"))
    extra = short.select(*spec.keys, lo.alias("_us"), k).select(
        *spec.keys,
        F.timestamp_micros(F.col("_us") - F.col("_k") * spec.step_us).alias(spec.ts),
        F.lit(0.0).alias(spec.value),
    )
    return df.unionByName(extra, allowMissingColumns=True)
