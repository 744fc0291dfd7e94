"""Scaling of long series: global, per train part, per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepgrid.operators.ranks import number_in_order
from stepgrid.series import spread_join


def scale_standard(df: DataFrame, value: str, floor: float = 1e-12) -> DataFrame:
    """One mean and population deviation for the whole table."""
    stats = df.agg(F.avg(value).alias("m"), F.sqrt(F.greatest(F.var_pop(value), F.lit(floor))).alias("s"))
    mean, std = stats.select("m").scalar(), stats.select("s").scalar()
    return df.withColumn("scaled", (F.col(value) - mean) / std)


def scale_on_part(df: DataFrame, keys: list[str], value: str, in_train: Column, tol: float = 0.0) -> DataFrame:
    """Standard scaling per series, fitted on the train rows only; a
    deviation of at most ``tol`` counts as 1."""
    v = F.when(in_train, F.col(value))
    std = F.stddev_pop(v)
    stats = df.groupBy(*keys).agg(F.avg(v).alias("loc"), F.when(std <= tol, 1.0).otherwise(std).alias("scale"))
    return spread_join(df, stats, keys).withColumn("scaled", (F.col(value) - F.col("loc")) / F.col("scale"))


def normalize_per_series(df: DataFrame, keys: list[str], value: str, tol: float = 1e-9) -> DataFrame:
    """Adds loc, scale and ``scaled``; keep loc and scale to invert."""
    return scale_on_part(df, keys, value, F.lit(True), tol)


def renormalize(df: DataFrame, scaled: str, out: str) -> DataFrame:
    return df.withColumn(out, F.col(scaled) * F.col("scale") + F.col("loc"))


def normalizer(df: DataFrame, value: str, kind: str, keys: list[str] | None = None, eps: float | None = None) -> DataFrame:
    """'standardization', 'minmax', and their per-sample forms over keys.

    The eps under the fraction is the machine epsilon of doubles by default.
    """
    eps = 2.220446049250313e-16 if eps is None else eps
    per_sample = kind.startswith("per_sample_")
    std = kind.endswith("std") or kind == "standardization"
    centre = F.avg(value) if std else F.min(value)
    spread = F.stddev_samp(value) if std else F.max(value) - F.min(value)
    if per_sample:
        stats = df.groupBy(*keys).agg(centre.alias("_c"), spread.alias("_s"))
        out = spread_join(df, stats, keys)
        return out.withColumn("scaled", (F.col(value) - F.col("_c")) / (F.col("_s") + eps)).drop("_c", "_s")
    stats = df.agg(centre.alias("c"), spread.alias("s"))
    return df.withColumn(
        "scaled", (F.col(value) - stats.select("c").scalar()) / (stats.select("s").scalar() + eps)
    )


def masked_scaler(
    df: DataFrame, keys: list[str], value: str, observed: Column, kind: str = "std", correction: int = 1, minimum: float = 1e-5
) -> DataFrame:
    """loc and scale per (sample, variate) from observed values only.

    'std': root of variance (with correction) + minimum; 'absmean'; 'none'.
    """
    v = F.when(observed, F.col(value))
    n = F.count(v)
    if kind == "std":
        var = F.when(n - correction != 0, F.var_pop(v) * n / (n - correction)).otherwise(0.0)
        loc, scale = F.coalesce(F.avg(v), F.lit(0.0)), F.sqrt(F.coalesce(var, F.lit(0.0)) + minimum)
    elif kind == "absmean":
        loc, scale = F.lit(0.0), F.coalesce(F.avg(F.abs(v)), F.lit(0.0))
    else:
        loc, scale = F.lit(0.0), F.lit(1.0)
    return df.groupBy(*keys).agg(F.count("*").alias("length"), loc.alias("loc"), scale.alias("scale"))


def one_hot(df: DataFrame, column: str, categories: list[str], drop_first: bool = True) -> DataFrame:
    """0/1 columns for known categories; unknown ones are all zero."""
    kept = categories[1:] if drop_first else categories
    return df.withColumns(
        {f"{column}_{c}": F.coalesce((F.col(column) == F.lit(c)).cast("double"), F.lit(0.0)) for c in kept}
    )


def category_index(df: DataFrame, column: str, out: str) -> DataFrame:
    """0-based index of each category in sorted order; a null has none.

    The index is taken from the distinct categories (aggregated first, numbered
    range by range) and joined back; the fact table itself is never sorted.
    """
    names = df.select(column).distinct().filter(F.col(column).isNotNull())
    return spread_join(df, number_in_order(names, [F.col(column)], out), [column], how="left")


def target_encode(df: DataFrame, keys: list[str], column: str, target: str, smooth: float = 1.0) -> DataFrame:
    """Mean target per (series, category), shrunk to the series mean."""
    cats = df.groupBy(*keys, column).agg(F.sum(target).alias("_s"), F.count(target).alias("_n"))
    means = cats.groupBy(*keys).agg((F.sum("_s") / F.sum("_n")).alias("_m"))
    coded = cats.join(means, keys).withColumn(
        "encoded", (F.col("_s") + smooth * F.col("_m")) / (F.col("_n") + smooth)
    )
    return spread_join(df, coded.select(*keys, column, "encoded"), [*keys, column])


def ordinal_encode(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Number of each category of a series in the order of its text, as
    ``encoded``; categories combine before they are numbered."""
    cats = df.select(*keys, column).distinct().filter(F.col(column).isNotNull())
    place = Window.partitionBy(*keys).orderBy(F.col(column).cast("string"))
    coded = cats.withColumn("encoded", (F.row_number().over(place) - 1).cast("double"))
    return spread_join(df, coded, [*keys, column], how="left")
