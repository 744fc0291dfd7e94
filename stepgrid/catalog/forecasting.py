"""Baselines, covariate regression and the forecaster slot."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from stepgrid.catalog.base import DAY, KEYS, PAIRS, POS, READINGS, SPEC, query, r6, raw_events, readings, rounded, slot, table
from stepgrid.catalog.scoring import STEPS, steps
from stepgrid.operators import forecast
from stepgrid.operators.windows import future_timestamps, persistence_pairs, windows_contiguous


def wins(spark, sf):
    return windows_contiguous(readings(spark, sf), SPEC, 4, 2)


WINS = f"""{POS}, w AS (SELECT dataset, subject_id, pos AS window_start, slot, lead(slot, 5) OVER o AS last, value AS x0, lead(value) OVER o AS x1, lead(value, 2) OVER o AS x2, lead(value, 3) OVER o AS x3,
    lead(value, 4) OVER o AS t0, lead(value, 5) OVER o AS t1 FROM pos WINDOW o AS (PARTITION BY dataset, subject_id ORDER BY slot)),
wins AS (SELECT * FROM w WHERE last = slot + 5)"""


@query("last_observed_baseline", f"WITH {STEPS} SELECT dataset, subject_id, window_start, CAST(horizon_step AS INTEGER) AS horizon_step, prediction, ground_truth FROM steps")
def _(spark, sf):
    return steps(spark, sf).drop("horizon_steps")


@query(
    "seasonal_naive",
    f"""WITH {POS} SELECT dataset, subject_id, slot, lag(value, 3) OVER (PARTITION BY dataset, subject_id ORDER BY slot) AS prediction, value AS ground_truth FROM pos QUALIFY pos >= 3""",
)
def _(spark, sf):
    out = forecast.seasonal_naive(readings(spark, sf), SPEC, 3)
    return out.select(*KEYS, slot().alias("slot"), "prediction", "ground_truth")


@query(
    "seasonal_naive_windows",
    f"WITH {WINS} SELECT dataset, subject_id, window_start, CAST(0 AS INTEGER) AS horizon_step, x1 AS prediction, t0 AS ground_truth FROM wins UNION ALL SELECT dataset, subject_id, window_start, CAST(1 AS INTEGER), x2, t1 FROM wins",
)
def _(spark, sf):
    return forecast.long_predictions(forecast.seasonal_naive_windows(wins(spark, sf), 3, 2), [*KEYS, "window_start"])


def drift_model():
    """A stand-in forecaster: the mean of the context, then plus its drift.

    Fails on purpose where a batch holds a negative number, to exercise the
    error column in tests.
    """

    def run(contexts: list[np.ndarray]) -> dict[str, np.ndarray]:
        x = np.vstack(contexts)
        if (x < 0).any():
            raise ValueError("negative reading")
        mean = x.mean(axis=1)
        point = np.column_stack([mean, mean + x[:, -1] - x[:, 0]])
        return {"point": point, "q10": point - 1.0, "q90": point + 1.0}

    return run


@query(
    "forecast_apply",
    f"""WITH {WINS} SELECT dataset, subject_id, window_start, round((x0 + x1 + x2 + x3) / 4, 6) AS p0, round((x0 + x1 + x2 + x3) / 4 + x3 - x0, 6) AS p1,
      round((x0 + x1 + x2 + x3) / 4 - 1, 6) AS lo, round((x0 + x1 + x2 + x3) / 4 + 1, 6) AS hi, CAST(NULL AS VARCHAR) AS error FROM wins""",
)
def _(spark, sf):
    out = forecast.forecast_apply(wins(spark, sf), [*KEYS, "window_start"], drift_model, ["point", "q10", "q90"])
    at = F.element_at
    return rounded(
        out.select(*KEYS, "window_start", at("point", 1).alias("p0"), at("point", 2).alias("p1"), at("q10", 1).alias("lo"), at("q90", 1).alias("hi"), "error")
    )


@query(
    "forecast_frame",
    f"""WITH {WINS} SELECT dataset, subject_id, window_start, slot + 4 AS slot, 'target' AS target_name, x3 AS predictions, round(x3 * 0.5, 6) AS q10 FROM wins
    UNION ALL SELECT dataset, subject_id, window_start, slot + 5, 'target', x3, round(x3 * 0.5, 6) FROM wins""",
)
def _(spark, sf):
    rows = forecast.last_observed(wins(spark, sf), 2)
    rows = rows.withColumn("low", F.transform("forecast", lambda v: v * 0.5))
    first = F.timestamp_seconds(F.unix_seconds("start_ts") + 4 * 86400)
    out = forecast.forecast_frame(rows.withColumn("t0", first), [*KEYS, "window_start"], "t0", SPEC.step_us, {"forecast": "predictions", "low": "q10"}, "target")
    return rounded(out.withColumn("slot", slot("timestamp")).drop("timestamp"))


@query(
    "point_choice",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice WHEN o_orderkey % 3 = 1 THEN o_totalprice / 2 ELSE -1 END AS prediction FROM orders",
)
def _(spark, sf):
    k, v = F.col("o_orderkey") % 3, F.col("o_totalprice")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.when(k == 0, v).alias("q50"), F.when(k == 1, v / 2).alias("sample_mean"), F.lit(-1.0).alias("mean")
    )
    return rows.select("o_orderkey", forecast.point_choice("q50", "sample_mean", "mean").alias("prediction"))


@query(
    "sample_median",
    f"""WITH e AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS slot, value FROM events) SELECT CAST(user_id AS VARCHAR) AS subject_id, slot, round(median(value), 6) AS prediction FROM e GROUP BY 1, 2""",
)
def _(spark, sf):
    samples = raw_events(spark, sf).select("subject_id", slot().alias("slot"), F.col("value").alias("sample"))
    return rounded(forecast.sample_median(samples, ["subject_id", "slot"]))


@query(
    "xreg_ridge",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS y, l_quantity AS x FROM lineitem), s AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM t)
    SELECT l_orderkey, l_linenumber, round(a + b * x, 4) AS xreg, round(y - (a + b * x), 4) AS residual FROM t, s""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    fit = forecast.xreg_ridge(rows, "l_extendedprice", ["l_quantity"], {})
    out = forecast.residual_target(rows, "l_extendedprice", fit)
    return out.select("l_orderkey", "l_linenumber", F.round("xreg", 4).alias("xreg"), F.round("residual", 4).alias("residual"))


@query(
    "xreg_categories",
    """SELECT l_orderkey, l_linenumber, round(avg(l_quantity) OVER (PARTITION BY l_returnflag), 4) AS fitted FROM lineitem""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    fit = forecast.xreg_category_ridge(rows, "l_quantity", [], ["l_returnflag"])
    return fit.predict(rows, "fitted").select("l_orderkey", "l_linenumber", F.round("fitted", 4).alias("fitted"))


@query(
    "xreg_category_ridge",
    """WITH c AS (SELECT l_shipmode_, count(*) AS n, sum(l_quantity) AS s FROM (SELECT l_quantity, l_suppkey % 7 AS l_shipmode_ FROM lineitem) GROUP BY 1),
    a AS (SELECT (sum(s) - sum(n * s / (n + 3.0))) / (sum(n) + 3.0 - sum(n * n / (n + 3.0))) AS a FROM c)
    SELECT l_orderkey, l_linenumber, round(a + (s - n * a) / (n + 3.0), 4) AS fitted FROM lineitem JOIN c ON l_suppkey % 7 = l_shipmode_, a""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_suppkey") % 7).alias("code"))
    fit = forecast.xreg_category_ridge(rows, "l_quantity", [], ["code"], ridge=3.0)
    return fit.predict(rows, "fitted").select("l_orderkey", "l_linenumber", F.round("fitted", 4).alias("fitted"))


@query(
    "xreg_on_residuals",
    f"""WITH {PAIRS}, s AS (SELECT regr_slope(ground_truth - prediction, slot) AS b, regr_intercept(ground_truth - prediction, slot) AS a FROM pairs WHERE dataset <> 'g0')
    SELECT dataset, subject_id, slot, round(prediction + a + b * slot, 4) AS prediction FROM pairs, s WHERE dataset = 'g0'""",
)
def _(spark, sf):
    pairs = persistence_pairs(readings(spark, sf), SPEC, 1).withColumn("slot", slot()).withColumnRenamed("prediction", "forecast")
    history, future = pairs.filter("dataset <> 'g0'"), pairs.filter("dataset = 'g0'")
    out = forecast.xreg_on_residuals(history, future, "ground_truth", "forecast", ["slot"], {})
    return out.select(*KEYS, "slot", F.round("prediction", 4).alias("prediction"))


@query(
    "add_regression_back",
    """WITH s AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem)
    SELECT l_orderkey, l_linenumber, round(1 + a + b * l_quantity, 4) AS point, round(-1 + a + b * l_quantity, 4) AS q10 FROM lineitem, s""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    fit = forecast.xreg_ridge(rows, "l_extendedprice", ["l_quantity"], {})
    out = forecast.add_back(rows.withColumns({"point": F.lit(1.0), "q10": F.lit(-1.0)}), fit, "point", ["q10"])
    return out.select("l_orderkey", "l_linenumber", F.round("point", 4).alias("point"), F.round("q10", 4).alias("q10"))


@query(
    "align_models",
    f"""WITH {POS} SELECT b.dataset, b.subject_id, b.slot, max(a.value) FILTER (b.slot - a.slot = 1 AND b.pos - a.pos = 1) AS back1, max(a.value) FILTER (b.slot - a.slot = 2 AND b.pos - a.pos = 2) AS back2
    FROM pos a JOIN pos b ON a.dataset = b.dataset AND a.subject_id = b.subject_id AND (b.slot - a.slot = 1 OR (b.slot - a.slot = 2 AND b.pos - a.pos = 2)) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    made = {f"back{h}": persistence_pairs(readings(spark, sf), SPEC, h).withColumn("slot", slot()) for h in (1, 2)}
    return forecast.align_models(made, [*KEYS, "slot"])


@query(
    "join_truth_audit",
    f"""WITH {POS} SELECT count(*) FILTER (prev IS NULL OR slot - prev <> 1) AS prediction FROM pos""",
)
def _(spark, sf):
    pred = persistence_pairs(readings(spark, sf), SPEC, 1).select(*KEYS, "ts", "prediction")
    return forecast.unmatched(forecast.join_truth(readings(spark, sf), pred, [*KEYS, "ts"]), ["prediction"])


@query(
    "future_mismatch",
    f"""WITH {READINGS}, m AS (SELECT dataset, subject_id, max(slot) AS s FROM readings GROUP BY 1, 2), e AS (SELECT dataset, subject_id, s + k AS slot FROM m, (SELECT unnest([1, 2]) AS k)),
    f AS (SELECT dataset, subject_id, s + k AS slot FROM m, (SELECT unnest([1, 2, 3]) AS k) WHERE (k < 3 OR CAST(subject_id AS BIGINT) % 4 = 0) AND NOT (k = 2 AND CAST(subject_id AS BIGINT) % 7 = 0))
    SELECT dataset, subject_id, slot, CASE WHEN e.s IS NULL THEN 'unexpected' ELSE 'missing' END AS problem FROM (SELECT *, 1 AS s FROM e) e FULL JOIN (SELECT *, 1 AS s FROM f) f USING (dataset, subject_id, slot) WHERE e.s IS NULL OR f.s IS NULL""",
)
def _(spark, sf):
    rows = readings(spark, sf)
    expected = future_timestamps(rows, KEYS, "ts", DAY, 2)
    sid = F.col("subject_id").cast("bigint")
    given = future_timestamps(rows, KEYS, "ts", DAY, 3).filter((F.col("horizon_step") < 3) | (sid % 4 == 0))
    given = given.filter(~((F.col("horizon_step") == 2) & (sid % 7 == 0)))
    out = forecast.future_mismatch(expected, given, [*KEYS, "ts"])
    return out.select(*KEYS, slot().alias("slot"), "problem")
