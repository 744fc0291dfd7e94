"""Inputs of forecasters and evaluations: covariates, levels, limits, choices."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from stepgrid.catalog.base import KEYS, POS, READINGS, SPEC, query, readings, rounded, slot, table
from stepgrid.functions import text
from stepgrid.operators import clean, forecast, sampling, scale, windows
from stepgrid.sources import series

DAY = timedelta(days=1)


@query(
    "future_covariates",
    f"""WITH {READINGS}, last AS (SELECT dataset, subject_id, max(slot) AS s FROM readings GROUP BY 1, 2),
    e AS (SELECT dataset, subject_id, s + k AS slot FROM last, (SELECT unnest([1, 2, 3]) AS k)),
    f AS (SELECT dataset, subject_id, slot + 2 AS slot, value FROM readings WHERE slot % 3 > 0),
    m AS (SELECT dataset, subject_id, e.slot AS es, f.slot AS fs, value FROM e FULL JOIN f USING (dataset, subject_id, slot))
    SELECT dataset, subject_id, round(coalesce(sum(CASE WHEN es IS NOT NULL THEN value END), 0), 6) AS total,
      count(*) FILTER (fs IS NULL) AS n_missing, count(*) FILTER (es IS NULL) AS n_extra FROM m GROUP BY 1, 2""",
)
def _(spark, sf):
    rows = readings(spark, sf)
    expected = windows.future_timestamps(rows, KEYS, "ts", DAY, 3)
    later = F.timestamp_seconds(F.unix_seconds("ts") + 2 * 86400).alias("ts")
    future = rows.filter(slot("ts") % 3 > 0).select(*KEYS, later, F.col("value").alias("load"))
    out = forecast.future_covariates(expected, future, KEYS, "ts", ["load"])
    total = F.aggregate("load", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    return rounded(out.select(*KEYS, total.alias("total"), "n_missing", "n_extra"))


@query(
    "level_columns",
    """SELECT o_orderkey, round(o_totalprice * 0.8, 4) AS "lo-80", o_totalprice AS median, round(o_totalprice * 1.2, 4) AS "hi-80" FROM orders""",
)
def _(spark, sf):
    v = F.col("o_totalprice")
    rows = table(spark, sf, "orders").select("o_orderkey", F.round(v * 0.8, 4).alias("q10"), v.alias("q50"), F.round(v * 1.2, 4).alias("q90"))
    return rows.select("o_orderkey", *series.level_columns([0.1, 0.5, 0.9]))


@query(
    "ordinal_encode",
    """SELECT event_id, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS DOUBLE) AS encoded FROM events""",
)
def _(spark, sf):
    return scale.ordinal_encode(table(spark, sf, "events"), ["user_id"], "event_type").select("event_id", "encoded")


@query(
    "limit_ids",
    """SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (
      SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT (SELECT CAST(floor(count(DISTINCT o_custkey) * 0.25) AS BIGINT) FROM orders))""",
)
def _(spark, sf):
    return sampling.limit_ids(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 0.25)


@query(
    "patched_context",
    f"""WITH {POS}, l AS (SELECT *, lag(slot, 5) OVER w AS first, lag(value) OVER w AS x4, lag(value, 2) OVER w AS x3, lag(value, 3) OVER w AS x2, lag(value, 4) OVER w AS x1
      FROM pos WINDOW w AS (PARTITION BY dataset, subject_id ORDER BY slot))
    SELECT dataset, subject_id, pos - 5 AS window_start, CAST(4 AS INTEGER) AS n_values, round(x1 + x2 + x3 + x4, 6) AS total FROM l WHERE first = slot - 5""",
)
def _(spark, sf):
    cut = windows.windows_contiguous(readings(spark, sf), SPEC, 5, 1, 1)
    out = windows.patched_context(cut, 2)
    total = F.aggregate("context", F.lit(0.0), lambda a, v: a + v)
    return rounded(out.select(*KEYS, "window_start", F.size("context").alias("n_values"), total.alias("total")))


@query(
    "dataset_choice",
    """SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN 'log' WHEN p_size > 25 THEN 'scale' ELSE 'mean' END AS choice FROM part""",
)
def _(spark, sf):
    kind = F.when(F.col("p_size") > 25, "large").otherwise("small")
    choices = {"Brand#11": "log", "large": "scale", "default": "mean"}
    return table(spark, sf, "part").select("p_partkey", text.dataset_choice(F.col("p_brand"), kind, choices).alias("choice"))


@query(
    "transform_by_dataset",
    f"""WITH {READINGS} SELECT dataset, subject_id, slot, round(CASE WHEN dataset = 'g0' THEN ln(1 + value) WHEN CAST(subject_id AS BIGINT) % 2 = 0 THEN value / 100 ELSE value - 50 END, 6) AS value,
      CASE WHEN dataset = 'g0' THEN 'log' WHEN CAST(subject_id AS BIGINT) % 2 = 0 THEN NULL ELSE 'shift' END AS unit FROM readings""",
)
def _(spark, sf):
    v = F.col("value")
    kind = F.when(F.col("subject_id").cast("bigint") % 2 == 0, "even").otherwise("odd")
    branches = {
        "g0": {"value": F.log1p(v), "unit": F.lit("log")},
        "even": {"value": v / 100},
        "default": {"value": v - 50, "unit": F.lit("shift")},
    }
    out = clean.transform_by_dataset(readings(spark, sf), F.col("dataset"), kind, branches)
    return rounded(out.select(*KEYS, slot().alias("slot"), "value", "unit"))


@query(
    "measure_series",
    """WITH m AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS slot, max(value) AS hi, min(value) AS lo, CAST(count(*) AS DOUBLE) AS n,
        max(CASE WHEN event_type = 'click' THEN value END) AS click FROM events GROUP BY 1, 2)
    SELECT CAST(user_id AS VARCHAR) AS item_id, CAST(4 AS INTEGER) AS measures, count(*) AS n, min(slot) AS first, round(sum(hi::FLOAT::DOUBLE), 4) AS hi,
      round(sum(lo::FLOAT::DOUBLE), 4) AS lo, round(sum(n::FLOAT::DOUBLE), 4) AS taps, round(last(click::FLOAT::DOUBLE ORDER BY slot), 4) AS last_click FROM m WHERE click IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    events = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), F.timestamp_seconds(slot() * 86400).alias("ts"), "event_type", "value")
    spec = SPEC.with_(keys=("user_id",))
    one = lambda agg: events.groupBy("user_id", "ts").agg(agg.alias("value"))
    clicks = events.filter("event_type = 'click'").select("user_id", "ts", "value")
    tables = {"hi": one(F.max("value")), "lo": one(F.min("value")), "taps": one(F.count("*").cast("double")), "click": clicks}
    out = series.measure_series(tables, spec, "D")
    at = lambda i: F.col("target")[i].cast("array<double>")
    total = lambda i: F.aggregate(at(i), F.lit(0.0), lambda a, v: a + v)
    first = slot("start").alias("first")
    return rounded(
        out.select(
            "item_id", F.size("target").alias("measures"), F.size(at(0)).cast("bigint").alias("n"), first,
            total(0).alias("hi"), total(1).alias("lo"), total(2).alias("taps"), F.element_at(at(3), -1).alias("last_click"),
        ),
        4,
    )


@query(
    "at_horizon",
    "SELECT event_id FROM events WHERE event_id % 4 * 15 = 30",
)
def _(spark, sf):
    k = F.col("event_id") % 4
    wanted = text.at_horizon(F.when(F.col("event_id") % 2 == 0, k * 15), k * 3, 30, 5)
    return table(spark, sf, "events").filter(wanted).select("event_id")


@query(
    "series_cut_by_date",
    f"""WITH {READINGS} SELECT dataset, subject_id, slot, value FROM readings WHERE slot <= (SELECT CAST(floor(epoch(min(ts)) / 86400) AS BIGINT) + 15 FROM events)""",
)
def _(spark, sf):
    rows = readings(spark, sf)
    first = table(spark, sf, "events").agg(F.date_trunc("day", F.min(F.col("ts").cast("timestamp")))).first()[0]
    return series.cut_rows(rows, SPEC, date_offset=str(first + timedelta(days=15))).select(*KEYS, slot().alias("slot"), "value")
