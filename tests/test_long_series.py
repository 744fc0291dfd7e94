"""Transforms, samples and statistics of whole series, across chunk borders and at extreme sizes."""

import math
from collections import Counter
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepgrid.functions.draws import beta, binomial
from stepgrid.operators import anomaly, clean, forecast, ranks, rollup, sampling, scale, whole, windows
from stepgrid.operators.gaps import segment_rows
from stepgrid.series import CHUNK, SeriesSpec
from stepgrid.sources.series import measure_series

MINUTE = timedelta(minutes=1)


def spec_of(chunk):
    return SeriesSpec(keys=("item",), step=MINUTE, chunk_steps=chunk)


def long_table(spark, lengths, value=lambda item, i: float((i * 37 + len(item)) % 101), step=60):
    rows = [(item, i * step, value(item, i)) for item, n in lengths.items() for i in range(n)]
    df = spark.createDataFrame(rows, "item string, s long, value double").repartition(5)
    return df.select("item", F.timestamp_seconds("s").alias("ts"), "value")


def minutes(column="ts"):
    return (F.unix_seconds(column) / 60).cast("long").alias("i")


# whole series -----------------------------------------------------------------

LENGTHS = {"a": 100, "bb": 7, "ccc": 31, "d": 1}


@pytest.mark.parametrize("make", [
    lambda df, spec: whole.crop_to_patches(df, spec, 4, 2, 9, F.col("item")).select("item", minutes(), "pos", "patch", "value"),
    lambda df, spec: whole.pad_short(df, spec, 33, F.col("item")).select("item", minutes(), "pos", "padded", "value"),
    lambda df, spec: whole.mask_tail(df, spec, F.floor(F.col("_total") / 3)).select("item", minutes(), "masked"),
    lambda df, spec: whole.mask_tail(df, spec, whole.random_ratio(0.1, 0.6, F.col("item"))).select("item", minutes(), "masked"),
    lambda df, spec: whole.index_rows(df.withColumn("w", -F.col("value")), spec, ["value", "w"], 3).select("item", minutes(), "time_index", "variate_index", "sample_id", "value"),
    lambda df, spec: whole.moving_average_rows(df, spec, 6).select("item", minutes(), F.round("smooth", 9), F.round("residual", 9)),
])
def test_chunks_do_not_show(spark, make):
    df = long_table(spark, LENGTHS)
    key = lambda r: [(v is None, str(v)) for v in r]
    small, large = (sorted(map(tuple, make(df, spec_of(c)).collect()), key=key) for c in (4, 1000))
    assert small == large and small


def test_crop_is_a_run_of_whole_patches(spark):
    df = long_table(spark, LENGTHS)
    got = {}
    for r in whole.crop_to_patches(df, spec_of(8), 4, 2, 9, F.col("item")).select("item", minutes(), "pos", "patch").collect():
        got.setdefault(r["item"], []).append((r["pos"], r["i"], r["patch"]))
    assert set(got) == {"a", "ccc"}
    for item, rows in got.items():
        rows.sort()
        assert [p for p, _, _ in rows] == list(range(len(rows))) and len(rows) % 4 == 0 and 8 <= len(rows) <= 36
        start = rows[0][1]
        assert [i for _, i, _ in rows] == list(range(start, start + len(rows))) and start + len(rows) <= LENGTHS[item]
        assert [p // 4 for p, _, _ in rows] == [k for _, _, k in rows]


def test_pads_and_masks(spark):
    df = long_table(spark, LENGTHS).withColumn("extra", F.lit("x"))
    padded = whole.pad_short(df, spec_of(8), 33, F.col("item")).collect()
    for item, n in LENGTHS.items():
        rows = sorted((r["pos"], r["padded"], r["extra"]) for r in padded if r["item"] == item)
        assert [p for p, *_ in rows] == list(range(max(n, 33)))
        real = [p for p, pad, _ in rows if not pad]
        assert real == list(range(real[0], real[0] + n)) and all((extra is None) == pad for _, pad, extra in rows)
    share = whole.random_ratio(0.1, 0.6, F.col("item"))
    for r in whole.mask_tail(df, spec_of(8), share).groupBy("item").agg(F.count_if("masked").alias("m"), F.max(F.when(~F.col("masked"), minutes())).alias("last")).collect():
        n = LENGTHS[r["item"]]
        assert max(1, round(0.1 * n) - 1) <= r["m"] <= max(1, round(0.6 * n) + 1)
        assert r["last"] is None or r["last"] == n - r["m"] - 1
    assert whole.pad_short(df.limit(0), spec_of(8), 5, F.col("item")).count() == 0


@pytest.mark.parametrize("k", [1, 5, 40])
def test_sliding_sums_equal_a_frame(spark, k):
    odd = {17: None, 30: math.nan, 55: math.inf, 56: -math.inf}
    df = long_table(spark, {"a": 100, "b": 3}, lambda item, i: odd.get(i, (i % 13) / 3) if item == "a" else 1.0)
    got = {(r["item"], r["i"]): (r["frame_sum"], r["frame_count"]) for r in whole.sliding_sums(df, spec_of(8), k).select("item", minutes(), "frame_sum", "frame_count").collect()}
    for item, n in (("a", 100), ("b", 3)):
        values = [odd.get(i, (i % 13) / 3) if item == "a" else 1.0 for i in range(n)]
        for i in range(n):
            frame = [v for v in values[max(0, i - k + 1) : i + 1] if v is not None]
            total, count = got[item, i]
            assert count == len(frame)
            if all(map(math.isfinite, frame)):
                assert math.isclose(total, sum(frame), abs_tol=1e-9)
            else:
                assert math.isnan(total)


def test_segment_windows_hold_bounded_rows(spark):
    """Five-minute readings with gaps under a day: a halo in time would hold every reading."""
    rng = np.random.default_rng(1)
    at = np.cumsum(np.where(rng.random(3000) < 0.01, 5 * rng.integers(2, 280, 3000), 5))
    rows = [("x", int(t) * 60, float(i)) for i, t in enumerate(at)]
    df = spark.createDataFrame(rows, "item string, s long, value double").select("item", F.timestamp_seconds("s").alias("ts"), "value")
    spec = SeriesSpec(keys=("item",), step=timedelta(minutes=5), chunk_steps=64)
    limit, context, horizon = timedelta(days=1), 288, 6
    sizes = segment_rows(df, spec, limit, 294).groupBy(CHUNK).count().collect()
    assert max(r["count"] for r in sizes) <= 5 * 293 + 1
    got = windows.windows_segmented(df, spec, context, horizon, 7, limit).collect()
    breaks = [0, *[i for i in range(1, len(at)) if at[i] - at[i - 1] > 1440], len(at)]
    want = {s for a, b in zip(breaks, breaks[1:]) for s in range(a, b - 293, 7)}
    assert {r["window_start"] for r in got} == want and len(got) == len(want) > 100
    for r in got[::50]:
        assert r["context"] == [float(r["window_start"] + i) for i in range(context)]
        assert r["target"] == [float(r["window_start"] + context + i) for i in range(horizon)]


# samples ----------------------------------------------------------------------


def gappy(spark):
    keep = lambda item, i: not (i % 23 == 5 or (item == "b" and i in (40, 41)))
    rows = [(item, i * 60, float(i)) for item, n in (("a", 200), ("b", 90), ("c", 3)) for i in range(n) if keep(item, i)]
    return spark.createDataFrame(rows, "item string, s long, value double").select("item", F.timestamp_seconds("s").alias("ts"), "value")


@pytest.mark.parametrize("limit", [None, 3 * MINUTE])
@pytest.mark.parametrize("chunk", [16, 1000])
def test_gathered_windows_are_the_windows(spark, limit, chunk):
    df, spec = gappy(spark), spec_of(chunk)
    every = windows.windows_grid(df, spec, [(5, 2)], 3, limit)
    want = {(r["item"], r["window_start"]): (r["start_ts"], r["context"], r["target"]) for r in every.collect()}
    index = windows.window_index(df, spec, 7, 3, limit)
    assert {(r["item"], r["window_start"]) for r in index.collect()} == set(want)
    got = windows.gather_windows(df, spec, index, 5, 2).collect()
    assert {(r["item"], r["window_start"]): (r["start_ts"], r["context"], r["target"]) for r in got} == want and len(got) == len(want)
    sample = sampling.sample_window_values(df, spec, 5, 2, 10, 4, 3, limit).collect()
    old = {(r["item"], r["window_start"]) for r in sampling.sample_windows(every.select("item", "window_start"), ["item", "window_start"], 10, 4).collect()}
    assert {(r["item"], r["window_start"]) for r in sample} == old and all(want[r["item"], r["window_start"]][1] == r["context"] for r in sample)


def test_balanced_values_repeat_windows(spark):
    df, spec = gappy(spark), spec_of(16)
    got = sampling.subject_balanced_values(spark, df, spec, 5, 2, 400, 9).collect()
    want = {(r["item"], r["window_start"]): r["target"] for r in windows.windows_contiguous(df, spec, 5, 2).collect()}
    assert sorted(r["draw"] for r in got) == list(range(400)) and all(want[r["item"], r["window_start"]] == r["target"] for r in got)
    share = Counter(r["item"] for r in got)
    assert set(share) == {"a", "b"} and 140 < share["a"] < 260


def test_proportional_draws_of_one_long_series(spark):
    rows = [(f"s{i}", 1) for i in range(300)] + [("long", 600), ("none", 0), (None, 300)]
    df = spark.createDataFrame(rows, "k string, len long")
    got = Counter(r["k"] for r in sampling.sample_series(spark, df, "k", "len", 4000, 3).collect())
    assert sum(got.values()) == 4000 and "none" not in got
    assert 1850 < got["long"] < 2150 and 870 < got[None] < 1130
    assert sampling.sample_series(spark, df.limit(0), "k", "len", 10, 3).collect() == []
    even = Counter(r["k"] for r in sampling.sample_series(spark, df, "k", "len", 4000, 3, "uniform").collect())
    assert max(even.values()) < 45 and len(even) > 290


@pytest.mark.parametrize("n,p", [(10, 0.3), (50, 0.9), (400, 0.5), (100_000, 0.002), (10_000_000, 0.37)])
def test_binomial_draws(spark, n, p):
    df = spark.range(6000).select(binomial(F.lit(n), F.lit(p), F.col("id"), F.lit(1)).alias("x"))
    x = np.array([r["x"] for r in df.collect()])
    mean, sd = n * p, math.sqrt(n * p * (1 - p))
    assert x.min() >= 0 and x.max() <= n
    assert abs(x.mean() - mean) < 4.5 * sd / math.sqrt(len(x)) and abs(x.std() / sd - 1) < 0.05
    # the distribution function at a few points, against a normal or the exact one
    for z in (-1.5, -0.5, 0.0, 0.5, 1.5):
        k = math.floor(mean + z * sd)
        log = lambda j: math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log(1 - p)
        exact = sum(math.exp(log(j)) for j in range(max(0, int(mean - 12 * sd)), min(n, k) + 1))
        assert abs((x <= k).mean() - exact) < 4.5 * math.sqrt(0.25 / len(x))


def test_count_draws_at_the_edges(spark):
    cases = [(0, 0.5), (-3, 0.5), (5, 0.0), (5, 1.0), (10**9, 0.0), (10**9, 1.0), (None, 0.5), (5, None), (1, 0.5)]
    df = spark.createDataFrame(cases, "n long, p double")
    got = [r["x"] for r in df.select(binomial(F.col("n"), F.col("p"), F.lit(1)).alias("x")).collect()]
    assert got[:8] == [0, 0, 0, 5, 0, 10**9, None, None] and got[8] in (0, 1)
    b = np.array([r[0] for r in spark.range(4000).select(beta(2, 3, F.col("id"))).collect()])
    assert abs(b.mean() - 0.4) < 0.02 and abs(b.std() - 0.2) < 0.02
    counts = np.array([r[0] for r in spark.range(3000).select(sampling.random_count("beta_binomial", F.lit(41), F.col("id"), a=2, b=3)).collect()])
    assert counts.min() >= 1 and counts.max() <= 41 and abs(counts.mean() - 17) < 0.9


# statistics -------------------------------------------------------------------


@pytest.mark.parametrize("values", [
    [3.0], [1.0, 2.0], [5.0] * 7 + [5.0000000001], [-math.inf, 1.0, 2.0, math.inf], [math.inf] * 3 + [1.0], [0.0, -0.0, 0.0, 1e-320, -1e-320, 1e308, -1e308],
    [100 + i * 1e-13 for i in range(50)],
])
def test_quantiles_of_odd_columns(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "v double")
    ordered = sorted(values)
    for q in (0.0, 0.3, 0.9):
        at = q * (len(values) - 1)
        low, high = ordered[int(at)], ordered[min(int(at) + 1, len(values) - 1)]
        share = at - int(at)
        want = low if low == high or share == 0 else low + (high - low) * share
        got = ranks.quantile_table(df, "v", q).collect()[0][0]
        assert got == want or (math.isnan(got) and math.isnan(want)) or math.isclose(got, want, rel_tol=1e-15)


def test_threshold_stays_a_plan(spark):
    values = [float(i) for i in range(1000)]
    train, test = (spark.createDataFrame([(v,) for v in part], "e double") for part in (values[:300], values[300:]))
    cut = anomaly.anomaly_threshold(train, test, "e", 10.0)
    assert math.isclose(cut.first()["threshold"], np.quantile(values, 0.9))
    assert anomaly.detect(test, "e", cut).agg(F.sum("pred")).first()[0] == 100
    assert ranks.quantile_table(train.limit(0), "e", 0.5).first()[0] is None


def test_numbers_follow_an_order(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3000).alias("x"), F.concat(F.lit("n"), F.col("id")).alias("name")).repartition(7)
    got = ranks.number_in_order(df, [-F.col("x")], "at").collect()
    assert all(r["at"] == 2999 - r["x"] for r in got) and len(got) == 3000
    cats = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "k string")
    assert sorted(map(tuple, scale.category_index(cats, "k", "code").collect()), key=str) == [("a", 0), ("a", 0), ("b", 1), ("c", 2), (None, None)]
    shown = rollup.with_display_place(spark.createDataFrame([("z",), ("q",), ("m",), ("a",)], "k string"), "k", ["q", "z", "missing"]).collect()
    assert {r["k"]: r["place"] for r in shown} == {"q": 1, "z": 2, "a": 3, "m": 4}


def test_frames_are_validated_in_one_scan(spark):
    rows = [("ok", i * 60) for i in range(40)] + [("short", 0)] + [("mixed", i * i * 60) for i in range(9)] + [("slow", i * 120) for i in range(9)]
    df = spark.createDataFrame(rows, "item string, s long").select("item", F.timestamp_seconds("s").alias("ts"), F.lit(1.0).alias("value"))
    future = spark.createDataFrame([("ok", 1), ("ok", 2), ("mixed", 1), ("new", 1), ("short", 1), ("short", 2)], "item string, step int")
    for chunk in (4, 1000):
        got = sorted(map(tuple, clean.validate_forecast_frame(df, spec_of(chunk), ["value"], future, 2).collect()))
        assert got == [
            ("mixed", "irregular"), ("mixed", "wrong future length"), ("new", "id only in future"), ("ok", "different frequency"), ("short", "too few points"), ("slow", "id without future"),
        ]
    assert clean.validate_forecast_frame(df.limit(0), spec_of(4), ["value"]).collect() == []


@pytest.mark.parametrize("driver_terms", [512, 3])
@pytest.mark.parametrize("ridge", [0.0, 2.5])
def test_ridge_over_category_tables(spark, ridge, driver_terms):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=200), "b": rng.normal(size=200) * 5, "k": rng.choice(list("uvw"), 200), "g": rng.choice([1, 2], 200)})
    pdf["y"] = 2 * pdf.a - pdf.b + (pdf.k == "v") * 3 + (pdf.g == 2) + rng.normal(size=200)
    df = spark.createDataFrame(pdf)
    fit = forecast.xreg_category_ridge(df, "y", ["a", "b"], ["k", "g"], ridge, driver_terms=driver_terms)
    x = [np.ones(200)] + [(pdf[c] - pdf[c].mean()) / pdf[c].std(ddof=0) for c in ("a", "b")]
    x += [(pdf.g == c).astype(float) for c in ((1, 2) if ridge else (2,))] + [(pdf.k == c).astype(float) for c in ("uvw" if ridge else "vw")]
    x = np.column_stack(x)
    pdf["want"] = x @ (np.linalg.pinv(x.T @ x + ridge * np.eye(x.shape[1])) @ x.T @ pdf.y)
    got = fit.predict(df).toPandas().sort_values(["a", "b"]).xreg.to_numpy()
    assert np.allclose(got, pdf.sort_values(["a", "b"]).want.to_numpy(), atol=1e-6)


def test_regression_with_unknown_and_null_categories(spark):
    train = spark.createDataFrame([("u", 1.0), ("v", 3.0), (None, 9.0), ("v", None)], "k string, y double")
    fit = forecast.xreg_category_ridge(train, "y", [], ["k"])
    got = {r["k"]: r["xreg"] for r in fit.predict(spark.createDataFrame([("u",), ("v",), ("w",), (None,)], "k string")).collect()}
    assert math.isclose(got["v"], 3.0) and got["u"] == got["w"] == got[None] == pytest.approx(5.0)


# per dataset, strata, measures ---------------------------------------------------


def test_each_dataset_has_its_transform(spark):
    df = spark.createDataFrame([("d1", "x", 4.0), ("d2", "x", 4.0), ("d3", "y", 4.0), (None, None, 4.0)], "d string, kind string, v double")
    branches = {"d1": {"v": F.sqrt("v")}, "x": {"v": F.col("v") * 10, "note": F.lit("tens")}, "default": {"note": F.lit("as is")}}
    got = {r["d"]: (r["v"], r["note"]) for r in clean.transform_by_dataset(df, F.col("d"), F.col("kind"), branches).collect()}
    assert got == {"d1": (2.0, None), "d2": (40.0, "tens"), "d3": (4.0, "as is"), None: (4.0, "as is")}
    same = clean.transform_by_dataset(df, F.col("d"), F.col("kind"), {"d9": {"v": F.lit(0.0)}})
    assert [r["v"] for r in same.collect()] == [4.0] * 4


def test_strata_may_overlap(spark):
    df = spark.createDataFrame([(60.0, 70.0), (100.0, 90.0), (300.0, 330.0)], "ground_truth double, prediction double").withColumn("who", F.lit("p"))
    strata = [("all", F.col("ground_truth") > 0), ("low", F.col("ground_truth") < 80), ("none", F.col("ground_truth") < 0)]
    assert Counter(r["stratum"] for r in rollup.strata_rows(df, strata).collect()) == {"all": 3, "low": 1}
    row = rollup.strata_rmse(df, ["who"], strata=strata).first()
    assert row["low"] == 10 and row["none"] is None and math.isclose(row["all"], math.sqrt((100 + 100 + 900) / 3))


@pytest.mark.parametrize("how,n", [("inner", 30), ("outer", 50)])
def test_four_measures_make_one_row(spark, how, n):
    spec = spec_of(8)
    tables = {m: long_table(spark, {"a": 50 - 10 * k, "b": 5}, lambda item, i, k=k: float(100 * k + i)).filter(F.minute("ts") >= 0) for k, m in enumerate(["p", "q", "r"])}
    tables["s"] = long_table(spark, {"a": 50, "b": 5}, lambda item, i: float(-i))
    out = {r["item_id"]: r for r in measure_series(tables, spec, "T", how).collect()}
    assert len(out) == 2 and len(out["a"]["target"]) == 4 and [len(x) for x in out["a"]["target"]] == [n] * 4
    assert out["a"]["target"][3] == [float(-i) for i in range(n)]
    assert out["a"]["target"][2] == [200.0 + i if i < 30 else None for i in range(n)]
    assert out["b"]["target"][1] == [100.0 + i for i in range(5)]
