"""Whole evaluation flows made of the operators."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgrid.functions import metrics
from stepgrid.operators.forecast import last_observed, long_predictions
from stepgrid.operators.rollup import overall_rows, weighted_dataset_summary, zone_summary
from stepgrid.operators.stats import benjamini_hochberg, collapse_duplicates, pair_methods, paired_wilcoxon
from stepgrid.operators.windows import context_steps, horizon_steps, persistence_pairs, windows_grid
from stepgrid.series import SeriesSpec
from stepgrid.sources.results import skip_completed


def config_grid(spark: SparkSession, contexts: list[float], horizons: list[float], step: timedelta) -> DataFrame:
    """The context x horizon grid as a table of plan-time literals."""
    rows = [(c, h, context_steps(c, step), horizon_steps(h, step)) for c in contexts for h in horizons]
    return spark.createDataFrame(
        rows, "context_hours double, horizon_minutes double, context_steps int, horizon_steps int"
    )


def persistence_summary(readings: DataFrame, spec: SeriesSpec, horizon: int) -> DataFrame:
    """Per-subject and per-dataset error of the persistence forecast."""
    pairs = persistence_pairs(readings, spec, horizon)
    p, t = F.col("prediction"), F.col("ground_truth")
    each = pairs.groupBy(*spec.keys).agg(
        F.count("*").alias("n_windows"), metrics.rmse(p, t).alias("rmse"), metrics.mae(p, t).alias("mae")
    )
    return weighted_dataset_summary(each, spec.keys[0], spec.keys[1])


def work_units(readings: DataFrame, spec: SeriesSpec, grid: list[tuple[int, int]], done: DataFrame | None = None) -> DataFrame:
    """One row per (series, context, horizon) not yet in the results."""
    pairs = F.array(*[F.struct(F.lit(c).alias("context_steps"), F.lit(h).alias("horizon_steps")) for c, h in grid])
    units = readings.select(*spec.keys).distinct().withColumn("_g", F.explode(pairs)).select(*spec.keys, "_g.*")
    if done is None:
        return units
    return skip_completed(units, done, [*spec.keys, "context_steps", "horizon_steps"])


def rolling_evaluation(
    readings: DataFrame, spec: SeriesSpec, grid: list[tuple[int, int]], stride: int, forecast=last_observed
) -> DataFrame:
    """Errors per (series, context, horizon) of a windowed forecaster.

    ``forecast(windows, horizon)`` adds the ``forecast`` array, the horizon
    being a column; by default the last observed value. The whole grid comes
    from one scan and one shuffle of the readings.
    """
    windows = forecast(windows_grid(readings, spec, grid, stride), F.col("horizon_steps"))
    config = ["context_steps", "horizon_steps"]
    rows = long_predictions(windows, [*spec.keys, *config, "window_start"])
    p, t = F.col("prediction"), F.col("ground_truth")
    final = F.col("horizon_step") == F.col("horizon_steps") - 1
    return (
        metrics.finite_pairs(rows)
        .groupBy(*spec.keys, *config)
        .agg(
            metrics.rmse(p, t).alias("rmse_all"),
            metrics.mae(p, t).alias("mae_all"),
            F.sqrt(F.avg(F.when(final, (p - t) * (p - t)))).alias("rmse_final"),
            F.avg(F.when(final, F.abs(p - t))).alias("mae_final"),
            F.count_if(final).alias("n_windows"),
        )
    )


def clinical_report(pairs: DataFrame, method: str, dataset: str, participant: str, excluded: list[str]) -> DataFrame:
    """Zone and risk figures per dataset with the overall rows."""
    each = zone_summary(pairs, [method, dataset, participant])
    return overall_rows(each, method, dataset, excluded, ["ceg_a", "seg_a", "seg_risk"])


def cohort_tests(scores: DataFrame, protocol: str, participant: list[str], method: str, value: str) -> DataFrame:
    """Pairwise signed-rank tests with corrected p within each protocol."""
    unique = collapse_duplicates(scores, [protocol, *participant, method], value)
    tests = paired_wilcoxon(pair_methods(unique, [protocol], participant, method, value), [protocol])
    return benjamini_hochberg(tests, [protocol])
