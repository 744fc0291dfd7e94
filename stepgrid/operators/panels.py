"""Metric panels that need in-sample errors, groups or denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgrid.functions import metrics
from stepgrid.functions.safe import ieee_over
from stepgrid.operators.windows import lag_rows
from stepgrid.series import SeriesSpec, spread_join, with_position


def seasonal_error(insample: DataFrame, spec: SeriesSpec, season: int) -> DataFrame:
    """Mean absolute seasonal difference of each series."""
    rows = lag_rows(with_position(insample, spec), spec, {"_prev": season})
    return rows.groupBy(*spec.keys).agg(F.avg(F.abs(F.col(spec.value) - F.col("_prev"))).alias("seasonal_error"))


def mase(predictions: DataFrame, errors: DataFrame, keys: list[str], eps: float = 0.0, ieee: bool = False) -> DataFrame:
    """Mean absolute error over the in-sample seasonal error, per series.

    Where that error is zero the result is null; with ``ieee`` it is infinite,
    or NaN over zero.
    """
    over = ieee_over if ieee else F.try_divide
    scored = predictions.groupBy(*keys).agg(F.avg(F.abs(F.col("prediction") - F.col("ground_truth"))).alias("mae"))
    return scored.join(errors, keys).withColumn("mase", over(F.col("mae"), F.col("seasonal_error") + eps))


def standard_panel(
    predictions: DataFrame,
    errors: DataFrame,
    keys: list[str],
    axis: list[str],
    quantiles: dict[float, str],
    interval: tuple[str, str] | None = None,
    ieee: bool = False,
) -> DataFrame:
    """MSE of the mean and of the median forecast, MAE, MASE, MAPE, SMAPE,
    MSIS, RMSE, NRMSE, ND and mean weighted quantile loss.

    ``axis`` are the grouping columns: none for one row, the item columns for
    a row per item, the step for a row per time. Missing labels are masked and
    terms with a zero denominator left out; with ``ieee`` no label is
    masked, and such terms are infinite, or NaN over zero. Sums do not depend
    on the order of the rows.
    """
    over = ieee_over if ieee else F.try_divide
    rows = spread_join(predictions if ieee else predictions.filter(metrics_label()), errors, keys)
    p, t, med = F.col("prediction"), F.col("ground_truth"), F.col(quantiles.get(0.5, "prediction"))
    err = F.col("seasonal_error")
    aggs = [
        metrics.mse(p, t).alias("mse_mean"),
        metrics.mse(med, t).alias("mse_median"),
        metrics.mae(med, t).alias("mae"),
        metrics.steady_avg(over(F.abs(med - t), err)).alias("mase"),
        metrics.steady_avg(over(F.abs(med - t), F.abs(t))).alias("mape"),
        metrics.steady_avg(over(2 * F.abs(med - t), F.abs(med) + F.abs(t))).alias("smape"),
        metrics.rmse(p, t).alias("rmse"),
        metrics.nrmse(p, t, ieee).alias("nrmse"),
        metrics.nd(med, t, ieee).alias("nd"),
    ]
    if interval:
        aggs.append(metrics.msis(F.col(interval[0]), F.col(interval[1]), t, err, ieee=ieee).alias("msis"))
    losses = [
        over(2 * metrics.steady_sum(metrics.pinball(q, F.col(c), t)), metrics.steady_sum(F.abs(t))) for q, c in sorted(quantiles.items())
    ]
    aggs.append((sum(losses[1:], losses[0]) / len(losses)).alias("mean_weighted_quantile_loss"))
    return rows.groupBy(*axis).agg(*aggs) if axis else rows.agg(*aggs)


def metrics_label() -> Column:
    t = F.col("ground_truth").cast("double")
    return t.isNotNull() & ~F.isnan(t)


def scaled_crps(predictions: DataFrame, ids: list[str], by: list[str], quantiles: dict[float, str], horizon: int) -> DataFrame:
    """Per level: sum over ids of mean loss x horizon, over the sum of truth;
    then the mean over levels."""
    t = F.col("ground_truth")
    each = predictions.groupBy(*by, *ids).agg(
        F.sum(t).alias("_y"),
        *[(F.avg(metrics.pinball(q, F.col(c), t)) * horizon).alias(c) for q, c in quantiles.items()],
    )
    levels = [F.try_divide(F.sum(c), F.sum("_y")) for c in quantiles.values()]
    total = sum(levels[1:], levels[0]) / len(levels)
    return each.groupBy(*by).agg(total.alias("scaled_crps")) if by else each.agg(total.alias("scaled_crps"))


def interval_quality(predictions: DataFrame, by: list[str], pairs: list[tuple[str, str, str]], pi_mode: str = "step", window: list[str] | None = None) -> DataFrame:
    """Coverage and width of prediction intervals (name, low, high).

    'step' averages over steps; 'window' counts a window as covered when at
    least half of its steps are, and averages widths per window first.
    """
    t = F.col("ground_truth")
    rows = metrics.finite_pairs(predictions)
    if pi_mode == "window":
        per = []
        for name, lo, hi in pairs:
            inside = F.avg(metrics.covered(F.col(lo), F.col(hi), t))
            per += [(inside >= 0.5).cast("int").alias(f"_c_{name}"), F.avg(F.col(hi) - F.col(lo)).alias(f"_w_{name}")]
        rows = rows.groupBy(*dict.fromkeys([*by, *(window or [])])).agg(*per)
        aggs = [F.avg(f"_{k}_{n}").alias(f"{n}_{label}") for n, _, _ in pairs for k, label in (("c", "coverage"), ("w", "width"))]
        return rows.groupBy(*by).agg(*aggs)
    aggs = []
    for name, lo, hi in pairs:
        aggs += [
            F.avg(metrics.covered(F.col(lo), F.col(hi), t)).alias(f"{name}_coverage"),
            F.avg(F.col(hi) - F.col(lo)).alias(f"{name}_width"),
        ]
    return rows.groupBy(*by).agg(*aggs)


def normalized_loss(
    df: DataFrame, keys: list[str], error: str, normalize: str, correction: int = 1, eps: float = 1e-5
) -> DataFrame:
    """Loss per row over a denominator per (sample, variate).

    error: 'nmae', 'nmse', 'nmlse'; 'nrmse' takes the root per group.
    normalize: none, absolute_target, absolute_target_squared, target,
    target_squared, standard_deviation, variance.
    """
    t, p = F.col("ground_truth"), F.col("prediction")
    n = F.count(t)
    var = F.when(n - correction != 0, F.var_pop(t) * n / (n - correction)).otherwise(0.0)
    mean_abs, mean = F.avg(F.abs(t)), F.avg(t)
    denominator = {
        "none": F.lit(1.0),
        "absolute_target": mean_abs,
        "absolute_target_squared": mean_abs * mean_abs,
        "target": mean,
        "target_squared": mean * mean,
        "standard_deviation": F.sqrt(var + eps),
        "variance": var,
    }[normalize]
    row = {
        "nmae": F.abs(p - t),
        "nmse": (p - t) * (p - t),
        "nrmse": (p - t) * (p - t),
        "nmlse": F.log1p((p - t) * (p - t)),
    }[error]
    # the denominator is constant in a group, so it divides the group's sum
    total = F.sum(row)
    safe = F.when(denominator == 0, 1.0).otherwise(denominator)
    agg = F.try_divide(F.sqrt(total / safe + eps), F.sqrt(n)) if error == "nrmse" else F.try_divide(total / safe, n)
    return df.groupBy(*keys).agg(agg.alias(error))


# Display groups of the yearly-to-hourly competition summary.
MAIN_GROUPS = ("Yearly", "Quarterly", "Monthly")
OTHER_GROUPS = ("Weekly", "Daily", "Hourly")


def competition_summary(predictions: DataFrame, errors: DataFrame, keys: list[str], group: str, ieee: bool = False) -> DataFrame:
    """sMAPE, MAPE, MASE and OWA against a naive forecast, per group, with
    Others and Average weighted by series count.

    ``predictions`` has prediction, naive and ground_truth per step. A zero
    denominator counts as one in sMAPE and MAPE, and a series with no seasonal
    error has no MASE; with ``ieee`` such a term is infinite, or NaN over zero.
    """
    over = ieee_over if ieee else F.try_divide
    p, nv, t = F.col("prediction"), F.col("naive"), F.col("ground_truth")
    per_series = (
        predictions.groupBy(group, *keys)
        .agg(
            F.avg(F.abs(p - t)).alias("_mae"),
            F.avg(F.abs(nv - t)).alias("_nmae"),
            *[F.sum(_terms(k, a, t, ieee)).alias(n) for n, k, a in (("_s", "smape", p), ("_ns", "smape", nv), ("_m", "mape", p))],
            F.count("*").alias("_points"),
        )
        .join(errors, keys)
    )
    base = per_series.groupBy(group).agg(
        F.count("*").alias("n_series"),
        (F.sum("_s") / F.sum("_points")).alias("smape"),
        (F.sum("_ns") / F.sum("_points")).alias("naive_smape"),
        (F.sum("_m") / F.sum("_points")).alias("mape"),
        F.avg(over(F.col("_mae"), F.col("seasonal_error"))).alias("mase"),
        F.avg(over(F.col("_nmae"), F.col("seasonal_error"))).alias("naive_mase"),
    )
    place = F.when(F.col(group).isin(*OTHER_GROUPS), "Others").otherwise(F.col(group))
    rows = base.withColumn("_g", F.explode(F.array(place, F.lit("Average")))).drop(group).withColumnRenamed("_g", group)
    n = F.sum("n_series")
    names = ("smape", "naive_smape", "mape", "mase", "naive_mase")
    out = rows.groupBy(group).agg(n.alias("n_series"), *[(F.sum(F.col(v) * F.col("n_series")) / n).alias(v) for v in names])
    owa = (over(F.col("mase"), F.col("naive_mase")) + over(F.col("smape"), F.col("naive_smape"))) / 2
    return out.withColumn("owa", owa)


def _terms(kind: str, p: Column, t: Column, ieee: bool) -> Column:
    if kind == "smape":
        return metrics.over_or_one(200 * F.abs(p - t), F.abs(p) + F.abs(t), ieee)
    return metrics.over_or_one(100 * F.abs(p - t), F.abs(t), ieee)


def per_horizon_columns(predictions: DataFrame, subject: list[str], horizons: list[int], scale: float = 1.0) -> DataFrame:
    """Overall and per-horizon RMSE and MAE per subject, in original units."""
    e = (F.col("prediction") - F.col("ground_truth")) * scale
    aggs = [F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae")]
    for h in horizons:
        at = F.when(F.col("horizon_step") == h, e)
        aggs += [F.sqrt(F.avg(at * at)).alias(f"rmse_{h}"), F.avg(F.abs(at)).alias(f"mae_{h}")]
    return predictions.groupBy(*subject).agg(*aggs)
