"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from datetime import timedelta  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from stepgrid.catalog import QUERIES  # noqa: E402
from stepgrid.operators import impute, windows  # noqa: E402
from stepgrid.plans import evaluation  # noqa: E402
from stepgrid.series import SeriesSpec  # noqa: E402
from stepgrid.session import local_session, settle  # noqa: E402

HEADLINE = [
    "persistence_summary",
    "count_windows",
    "count_windows_segmented",
    "windows_contiguous",
    "windows_segmented",
    "contiguous_runs",
    "latest_window",
    "rolling_evaluation",
    "clinical_report",
    "seg_rule_risk",
    "seg_lookup_risk",
    "strata_table",
    "cohort_tests",
    "regularize",
    "impute_causal_mean",
    "impute_linear",
    "build_series",
    "panel_by_item",
    "forecast_apply",
    "sample_windows",
    "pack_sequences",
]


STEP = timedelta(minutes=5)


def dense_readings(spark, sf_dir):
    """Five-minute readings made from the orders: every order is 16 readings of
    one of 50 subjects, so a subject has far more than one chunk of them, with
    a gap wherever the order's price ends in a certain way."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    at = F.floor(F.col("o_orderkey") / 50) * 16 + F.col("k")
    rows = orders.where("o_totalprice * 100 % 40 >= 1").select("o_orderkey", "o_totalprice", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"))
    return rows.select(
        F.concat(F.lit("g"), (F.col("o_orderkey") % 3).cast("string")).alias("dataset"),
        (F.col("o_orderkey") % 50).cast("string").alias("subject_id"),
        F.timestamp_seconds(at * 300).alias("ts"),
        (40 + F.pmod(F.col("o_totalprice") + 3 * F.col("k"), F.lit(300))).alias("value"),
    )


def dense_work(rows):
    """Work on the dense readings; the dataset follows from the subject, so it is no key."""
    spec = SeriesSpec(keys=("subject_id",), step=STEP)
    named = SeriesSpec(keys=("dataset", "subject_id"), step=STEP)
    pooled = rows.withColumn("dataset", F.lit("all"))
    return {
        "dense_count_windows": lambda: windows.count_windows(rows, spec, 150, [1, 12, 240], ["subject_id"]),
        "dense_windows_stride_1": lambda: windows.windows_contiguous(rows, spec, 144, 6, 1),
        "dense_windows_stride_12": lambda: windows.windows_contiguous(rows, spec, 144, 6, 12),
        "dense_windows_stride_240": lambda: windows.windows_contiguous(rows, spec, 144, 6, 240),
        "dense_persistence": lambda: evaluation.persistence_summary(pooled, named, 6),
        "dense_rolling_grid": lambda: evaluation.rolling_evaluation(rows, spec, [(144, 6), (144, 18), (288, 6), (288, 18)], 12),
        "dense_impute_linear": lambda: impute.impute_linear(rows, spec),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    times: dict[str, float] = {}
    # one untimed pass over a small query starts the Python workers and the JVM paths
    QUERIES["forecast_apply"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    for name, work in dense_work(settle(dense_readings(spark, sf_dir), "dense")).items():
        start = time.perf_counter()
        work().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir)}
        )
    )


if __name__ == "__main__":
    main()
