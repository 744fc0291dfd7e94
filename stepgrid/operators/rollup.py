"""Roll-ups of scores by participant, dataset, cohort and method."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgrid.functions import clinical, metrics
from stepgrid.functions.text import mean_std_text
from stepgrid.operators.ranks import number_in_order
from stepgrid.series import spread_join

ALL_PATIENTS = "ALL_PATIENTS"


def score(predictions: DataFrame, by: list[str], mode: str = "all", pred: str = "prediction", truth: str = "ground_truth") -> DataFrame:
    """RMSE, MAE, points and windows per group; mode 'final' scores only the
    last horizon step of each window."""
    rows = metrics.finite_pairs(predictions, pred, truth)
    if mode == "final":
        rows = rows.filter(F.col("horizon_step") == F.col("horizon_steps") - 1)
    p, t = F.col(pred), F.col(truth)
    return rows.groupBy(*by).agg(
        metrics.rmse(p, t).alias("rmse"), metrics.mae(p, t).alias("mae"), F.count("*").alias("n_points")
    )


def weighted_dataset_summary(metrics_rows: DataFrame, dataset: str, patient: str, extra: list[str] | None = None) -> DataFrame:
    """Per-patient rows plus one ALL_PATIENTS row per dataset, weighted by
    windows, from one grouping-sets aggregation.

    ``metrics_rows`` has n_windows, rmse and mae per (dataset, patient).
    """
    extra = extra or []
    keys = [dataset, *extra, patient]
    n = F.sum("n_windows")
    both = metrics_rows.groupingSets(
        [[F.col(k) for k in keys], [F.col(k) for k in (dataset, *extra)]], *[F.col(k) for k in keys]
    ).agg(
        F.grouping(patient).alias("_all"),
        n.alias("n_windows"),
        F.sqrt(F.try_divide(F.sum(F.col("n_windows") * F.col("rmse") * F.col("rmse")), n)).alias("rmse"),
        F.try_divide(F.sum(F.col("n_windows") * F.col("mae")), n).alias("mae"),
    )
    name = F.when(F.col("_all") == 1, ALL_PATIENTS).otherwise(F.col(patient))
    return both.withColumn(patient, name).drop("_all")


def across_patients(rows: DataFrame, by: list[str], value: str, deviation: str = "population") -> DataFrame:
    """Mean, deviation and count of patients; missing scores are left out."""
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value))
    std = F.stddev_pop(v) if deviation == "population" else F.stddev_samp(v)
    return rows.groupBy(*by).agg(F.avg(v).alias(f"{value}_mean"), std.alias(f"{value}_std"), F.count(v).alias("n_patients"))


def zone_summary(pairs: DataFrame, by: list[str], pred: str = "prediction", truth: str = "ground_truth") -> DataFrame:
    """Clarke zone A share, surveillance zone A share and mean risk."""
    p, t = F.col(pred).cast("double"), F.col(truth).cast("double")
    rows = metrics.finite_pairs(pairs, pred, truth)
    rows = rows.withColumn("_zone", clinical.clarke_zone(t, p)).withColumn("_risk", clinical.seg_rule_risk(t, p))
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        clinical.zone_percent(F.col("_zone"), "A").alias("ceg_a"),
        F.avg(F.when(F.col("_risk") == 0, 100.0).otherwise(0.0)).alias("seg_a"),
        F.avg("_risk").alias("seg_risk"),
    )


def zone_shares(pairs: DataFrame, by: list[str], zone: Column, letters: list[str]) -> DataFrame:
    rows = pairs.withColumn("_zone", zone)
    return rows.groupBy(*by).agg(*[clinical.zone_percent(F.col("_zone"), z).alias(z) for z in letters])


def overall_rows(
    per_participant: DataFrame, method: str, dataset: str, excluded: list[str], values: list[str], extra: list[str] | None = None
) -> DataFrame:
    """Mean and sample deviation per dataset, with Overall (Open) and
    Overall (Total) rows in which each participant counts once.

    Every row is sent to its dataset and the overall groups it belongs to, so
    one aggregation, combined before the shuffle, makes all three kinds.
    """
    extra = extra or []
    open_row = F.when(~F.col(dataset).isin(excluded), F.lit("Overall (Open)"))
    places = F.array_compact(F.array(F.col(dataset), open_row, F.lit("Overall (Total)")))
    rows = per_participant.withColumn("_group", F.explode(places)).drop(dataset).withColumnRenamed("_group", dataset)
    aggs = [F.count("*").alias("n_participants")]
    for v in values:
        aggs += [F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std")]
    return rows.groupBy(method, dataset, *extra).agg(*aggs)


def participant_zone_means(pairs: DataFrame, by: list[str], participant: str, zone: Column, letters: list[str]) -> DataFrame:
    """Mean over participants of each participant's zone shares."""
    each = zone_shares(pairs, [*by, participant], zone, letters)
    return each.groupBy(*by).agg(*[F.avg(z).alias(z) for z in letters])


def strata_rmse(
    pairs: DataFrame, by: list[str], pred: str = "prediction", truth: str = "ground_truth", strata: list[tuple[str, Column]] | None = None
) -> DataFrame:
    """RMSE per stratum, one column each, null where empty.

    ``strata`` is a list of labels and conditions, by default the glycemic
    ones; strata may overlap, and a row counts in each whose condition holds.
    """
    rows = metrics.finite_pairs(pairs, pred, truth)
    e = F.col(truth) - F.col(pred)
    strata = clinical.glycemic_strata(F.col(truth)) if strata is None else strata
    return rows.groupBy(*by).agg(*[F.sqrt(F.avg(F.when(condition, e * e))).alias(label) for label, condition in strata])


def strata_rows(df: DataFrame, strata: list[tuple[str, Column]], out: str = "stratum") -> DataFrame:
    """One row for each stratum that a row is in; rows in none are left out."""
    labels = F.array(*[F.when(condition, F.lit(label)) for label, condition in strata])
    return df.withColumn(out, F.explode(F.array_compact(labels)))


def strata_table(per_participant: DataFrame, protocol: str, order: list[str], labels: list[str] | None = None) -> DataFrame:
    """Strata x protocol cells 'mean (std)', blanks where absent."""
    names = list(clinical.STRATA) if labels is None else labels
    long = per_participant.unpivot([protocol], names, "stratum", "rmse").filter("rmse is not null")
    cells = long.groupBy("stratum", protocol).agg(mean_std_text(F.col("rmse")).alias("cell"))
    wide = cells.groupBy("stratum").pivot(protocol, order).agg(F.first("cell"))
    return wide.fillna("")


def pivot_table(df: DataFrame, rows: str, columns: str, names: list[str], value: str) -> DataFrame:
    """Mean of value in a rows x columns table with known column names."""
    return df.groupBy(rows).pivot(columns, names).agg(F.avg(value))


def melt(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    return df.unpivot(keys, columns, name, value)


def stitch_protocols(per_method: DataFrame, protocol: str, method: str, row: str, cell: str, order: list[str]) -> DataFrame:
    """Per-protocol tables: rows x methods in display order, blanks filled."""
    wide = per_method.groupBy(protocol, row).pivot(method, order).agg(F.first(cell))
    return wide.fillna("")


def scope_summary(df: DataFrame, dataset: str, open_datasets: list[str], value: str) -> DataFrame:
    """n, mean and sample deviation over the open and over all datasets."""
    scope = F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col(dataset).isin(open_datasets), F.lit("open")))))
    return df.withColumn("scope", scope).groupBy("scope").agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )


def mean_columns(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])


def relative_score(model: DataFrame, baseline: DataFrame, on: str, values: list[str]) -> DataFrame:
    """Geometric mean over datasets of model / baseline, per metric."""
    named = baseline.select(on, *[F.col(v).alias(f"_b_{v}") for v in values])
    joined = model.join(named, on)
    return joined.agg(*[F.exp(F.avg(F.log(F.try_divide(F.col(v), F.col(f"_b_{v}"))))).alias(v) for v in values])


def dataset_weights(lengths: DataFrame, name: str, group: Column, cap: float = 0.001) -> DataFrame:
    """Sampling weight of each dataset.

    Share of total length capped and renormalised per group, divided by the
    group's share of the series count, then split over its shards.
    """
    shards = lengths.withColumn("_g", group).groupBy("_g", name).agg(
        F.sum("length").alias("_len"), F.count("*").alias("_series")
    )
    groups = shards.groupBy("_g").agg(F.sum("_len").alias("_len"), F.sum("_series").alias("_series"), F.count("*").alias("_shards"))
    totals = groups.agg(F.sum("_len").alias("len"), F.sum("_series").alias("series"))
    groups = groups.withColumn("_omega", F.least(F.lit(cap), F.col("_len") / totals.select("len").scalar()))
    clipped = groups.agg(F.sum("_omega").alias("o")).scalar()
    weight = F.col("_omega") / clipped * totals.select("series").scalar() / F.col("_series") / F.col("_shards")
    return shards.select("_g", name).join(groups.withColumn("weight", weight).select("_g", "weight"), "_g").drop("_g")


def merge_throughput(records: DataFrame, method: str, order: str, fields: list[str], inference: list[str]) -> DataFrame:
    """First non-null value per field in source order; zero-shot inference
    numbers are kept apart under their own names."""
    zero = F.col("protocol") == "zeroshot"

    def first(value: Column) -> Column:
        return F.min_by(value, F.when(value.isNotNull(), F.col(order)))

    aggs = []
    for f in fields:
        value = F.when(~zero, F.col(f)) if f in inference else F.col(f)
        aggs.append(first(value).alias(f))
    # a later zero-shot record replaces an earlier one
    aggs += [
        F.max_by(F.when(zero, F.col(f)), F.when(zero & F.col(f).isNotNull(), F.col(order))).alias(f"zeroshot_{f}")
        for f in inference
    ]
    return records.groupBy(method).agg(*aggs)


def cost_estimate(throughput: DataFrame, workload: DataFrame, config: DataFrame) -> DataFrame:
    """Training and inference seconds = throughput x workload.

    ``config``: method, protocol, convention, epochs, batch, stride, steps
    (fixed step budget, else null), window_cap. ``workload``: convention,
    split, stride, windows. Inference runs over the test split at stride 1.
    """
    train = workload.filter("split = 'train'").select("convention", "stride", F.col("windows").alias("train_windows"))
    test = workload.filter("split = 'test' and stride = 1").select("convention", F.col("windows").alias("infer_windows"))
    rows = config.join(throughput, "method").join(train, ["convention", "stride"], "left").join(test, "convention", "left")
    per_epoch = F.least(F.col("train_windows"), F.col("window_cap"))
    budget = F.col("steps").isNotNull() & F.col("sec_per_step").isNotNull()
    train_seconds = F.when(budget, F.col("sec_per_step") * F.col("steps")).otherwise(
        per_epoch / 1000.0 * F.col("sec_per_1k_train_windows") * F.col("epochs")
    )
    steps = F.when(budget, F.col("steps")).otherwise(F.floor(per_epoch / F.col("batch")) * F.col("epochs"))
    ms = F.when(F.col("protocol") == "zeroshot", F.col("zeroshot_ms_per_window")).otherwise(F.col("ms_per_window"))
    return rows.select(
        "method",
        "protocol",
        "train_windows",
        per_epoch.alias("windows_per_epoch"),
        steps.cast("bigint").alias("train_steps"),
        train_seconds.alias("train_seconds"),
        "infer_windows",
        (F.col("infer_windows") * ms / 1000.0).alias("infer_seconds"),
    )


def _display_place(column: str, order: list[str]) -> Column:
    place = F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))
    return F.when(place == 0, len(order) + 1).otherwise(place)


def display_order(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Known names in the given order, unknown ones after them by name."""
    return df.orderBy(_display_place(column, order), column)


def with_display_place(df: DataFrame, column: str, order: list[str], out: str = "place") -> DataFrame:
    """The 1-based place of each row in display order; names must be distinct."""
    numbered = number_in_order(df, [_display_place(column, order), F.col(column)], out)
    return numbered.withColumn(out, F.col(out) + 1)


def attach_dimension(df: DataFrame, dim: DataFrame, on: list[str], how: str = "left", dim_rows: int | None = None, limit: int = 1_000_000) -> DataFrame:
    """Join a dimension with one row per key.

    Broadcast only when its row count is known (given by the caller from its
    source) and under the limit; otherwise a join spread over hot keys.
    """
    if dim_rows is not None and dim_rows <= limit:
        return df.join(F.broadcast(dim), on, how)
    return spread_join(df, dim, on, how=how)


def unmapped_keys(df: DataFrame, dim: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of ``df`` that the dimension lacks."""
    return df.select(*on).distinct().join(dim.select(*on).distinct(), on, "left_anti")


def common_keys(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    return a.select(*on).intersect(b.select(*on))
