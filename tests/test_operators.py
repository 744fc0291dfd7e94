"""Hand-worked cases of single operators."""

import itertools
import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepgrid.functions import arrays, calendar, clinical, metrics, text
from stepgrid.operators import clean, distances, forecast, packing, panels, ranks, rollup, sampling, scale, stats
from stepgrid.series import SeriesSpec
from stepgrid.sources import readings as src
from stepgrid.sources import results
from stepgrid.sources import series as src_series


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# clinical ------------------------------------------------------------------


def test_clarke_boundaries(spark):
    cases = [
        (70, 180, "E"), (180, 70, "E"), (69, 69, "A"), (100, 120, "A"), (100, 121, "B"), (60, 75, "D"), (70, 84, "A"),
        (70, 85, "D"), (240, 180, "D"), (239, 180, "B"), (100, 210, "C"), (100, 209, "B"), (178, 60, "C"), (160, 60, "B"),
        (0, 0, "A"), (0, 100, "D"), (300, 300, "A"),
    ]
    df = spark.createDataFrame([(float(r), float(m), z) for r, m, z in cases], "r double, m double, z string")
    bad = df.withColumn("got", clinical.clarke_zone(F.col("r"), F.col("m"))).filter("got <> z").collect()
    assert not bad


def test_seg_rule_risk(spark):
    cases = [
        (100, 114, 0.0), (100, 116, 0.5), (99, 115, 0.5), (99, 83, 0.5), (60, 29, 1.0), (60, 0, 1.0), (69, 8, 2.0), (150, 191, 1.0), (150, 190, 0.5),
        (150, 270, 2.0), (150, 271, 3.0), (300, 240, 0.5), (300, 239, 1.0), (300, 119, 3.0), (300, 510, 2.0), (300, 511, 3.0),
        (-5, 0.9, 0.0), (700, 599, 0.0), (100.9, 114.9, 0.0), (60, 111, 2.0), (60, 141, 3.0),
    ]
    df = spark.createDataFrame([(float(r), float(m), z) for r, m, z in cases], "r double, m double, z double")
    bad = df.withColumn("got", clinical.seg_rule_risk(F.col("r"), F.col("m"))).filter("got <> z").collect()
    assert not bad


def test_seg_lookup_rounds_half_even_and_clips(spark):
    df = spark.createDataFrame([(-1.0,), (0.5,), (1.5,), (599.5,), (700.0,)], "x double")
    assert [r[0] for r in df.select(clinical.grid_index(F.col("x"))).collect()] == [0, 0, 2, 599, 599]


def test_seg_zone_edges(spark):
    df = spark.createDataFrame([(0.0,), (0.49,), (0.5,), (1.5,), (2.5,), (3.5,), (4.0,), (4.1,)], "x double")
    names = [r[0] for r in df.select(clinical.seg_zone(F.col("x"))).collect()]
    assert names == ["None", "None", "Slight", "Moderate", "Great", "Extreme", "Extreme", None]


def test_strata_edges(spark):
    df = spark.createDataFrame([(69.99,), (70.0,), (180.0,), (180.01,)], "x double")
    got = [r[0] for r in df.select(clinical.stratum(F.col("x"))).collect()]
    assert got == ["Hypo (<70)", "In-range [70,180]", "In-range [70,180]", "Hyper (>180)"]


def test_bilinear_of_a_plane_is_the_plane(spark):
    cells = [(i, j, float(2 * i + 3 * j)) for i in range(4) for j in range(4)]
    table = spark.createDataFrame(cells, "ref_i int, meas_i int, risk double")
    points = spark.createDataFrame([(0.0, 0.0), (150.0, 420.0), (600.0, 600.0), (700.0, -5.0)], "r double, m double")
    out = clinical.with_seg_bilinear(points, table, "r", "m", 4).collect()
    for row in out:
        r, m = min(max(row.r, 0), 600) / 200, min(max(row.m, 0), 600) / 200
        assert math.isclose(row.risk, 2 * r + 3 * m, abs_tol=1e-9)


def test_seg_table_reader(spark, tmp_path):
    (tmp_path / "seg.txt").write_text("0 -1.5 2\n1 0 3\n-4 1 0\n")
    table = src.read_seg_table(spark, str(tmp_path))
    assert table.filter("ref_i = 2 and meas_i = 0").first().risk == 4.0
    report = one(src.seg_table_report(table))
    assert report.square and report.complete and report.zero_diagonal and report.rows == 3


def test_penalty_is_one_in_range_and_more_at_lows(spark):
    df = spark.createDataFrame([(120.0, 120.0), (50.0, 100.0), (250.0, 150.0)], "t double, p double")
    mid, low, high = (r[0] for r in df.select(metrics.glucose_penalty(F.col("p"), F.col("t"))).collect())
    assert mid < 1.2 and low > mid and high > mid


# statistics ----------------------------------------------------------------


def wilcoxon_by_enumeration(d):
    d = [x for x in d if x]
    order = sorted(range(len(d)), key=lambda i: abs(d[i]))
    rank = {i: k + 1 for k, i in enumerate(order)}
    w = sum(rank[i] for i in range(len(d)) if d[i] > 0)
    low = min(w, len(d) * (len(d) + 1) // 2 - w)
    hits = sum(
        sum(k + 1 for k, s in enumerate(signs) if s) <= low for signs in itertools.product((0, 1), repeat=len(d))
    )
    return min(1.0, 2 * hits / 2 ** len(d))


def test_wilcoxon(spark):
    rng = np.random.default_rng(3)
    distinct = (rng.permutation(12) + 1) * rng.choice([-1, 1], 12) + 0.25
    sets = {
        "single": [1.0],
        "two": [1.0, -2.0],
        "zero": [0.0] * 6,
        "exact": distinct.tolist(),
        "ties": [1.0, 1.0, -1.0, 2.0, 2.0, -3.0, 4.0, 0.0],
    }
    rows = [(n, i, m, v) for n, d in sets.items() for i, x in enumerate(d) for m, v in (("a", x + 10.0), ("b", 10.0))]
    scores = spark.createDataFrame(rows, "protocol string, who int, method string, rmse double")
    pairs = stats.pair_methods(scores, ["protocol"], ["who"], "method", "rmse")
    got = {r.protocol: r for r in stats.paired_wilcoxon(pairs, ["protocol"]).collect()}
    assert got["single"].p_value is None and got["single"].mean_diff is None
    assert got["two"].p_value == 1.0
    assert got["zero"].p_value == 1.0
    assert math.isclose(got["exact"].p_value, wilcoxon_by_enumeration(sets["exact"]))
    # ranks 2,2,2,4.5,4.5,6,7: W+ = 2+2+4.5+4.5+7, ties 3 and 2
    assert got["ties"].w_plus == 20.0 and got["ties"].n_used == 7
    se = math.sqrt((7 * 8 * 15 - (24 + 6) / 2) / 24)
    assert math.isclose(got["ties"].p_value, math.erfc(abs(20 - 14) / se / math.sqrt(2)))


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, None, 0.04, 0.9, 0.001]
    df = spark.createDataFrame([("x", i, v) for i, v in enumerate(p)], "protocol string, i int, p_value double")
    got = {r.i: r.p_adj_bh for r in stats.benjamini_hochberg(df, ["protocol"]).collect()}
    valid = sorted((v, i) for i, v in enumerate(p) if v is not None)
    run, want = 1.0, {3: None}
    for rank in range(len(valid), 0, -1):
        v, i = valid[rank - 1]
        run = min(run, v * len(valid) / rank)
        want[i] = run
    assert got[3] is None
    assert all(math.isclose(got[i], want[i]) for i in want if want[i] is not None)


def test_exact_quantile(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(size=3000), rng.normal(size=50) * 1e6, np.zeros(400)])
    df = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(4)
    for q in (0.0, 0.25, 0.5, 0.99, 1.0):
        assert math.isclose(ranks.exact_quantile(df, "v", q), np.quantile(values, q), rel_tol=1e-12, abs_tol=1e-12)


def test_average_ranks_against_pandas(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-20, 20, 500) / 4.0
    df = spark.createDataFrame(pd.DataFrame({"g": rng.integers(0, 2, 500), "v": v}))
    got = {(r.g, r.v): r.avg_rank for r in ranks.average_ranks(df, ["g"], "v").collect()}
    pdf = df.toPandas()
    pdf["r"] = pdf.groupby("g").v.rank()
    assert got == {(r.g, r.v): r.r for r in pdf.itertuples()}


def test_smallest_and_dense_index(spark):
    df = spark.range(5000).repartition(6)
    h = sampling.seeded_hash(F.col("id"), F.lit(4))
    kept = {r.id for r in ranks.smallest(df, h, 700, ["id"], bits=4).collect()}
    want = [r.id for r in df.orderBy(h, "id").limit(700).collect()]
    assert kept == set(want)
    assert ranks.smallest(df, h, 9000, ["id"]).count() == 5000
    numbers = [r.n for r in ranks.dense_index(df, ["id"], "n").collect()]
    assert sorted(numbers) == list(range(5000))


# sources -------------------------------------------------------------------


def test_subject_csvs(spark, tmp_path):
    for name, body in {
        "d1/001.csv": "Timestamp,BGvalue\n1700000000,100\n1700000300,110\n1700000300,111\n,5\n1700000600,bad\n",
        "d1/Subject 7+a.csv": "time,value\n1700000000,70\n",
        "d1/002.csv": "glucose,time\n90,1700000000000\n95,1700000300000\n",
        "d2/003.csv": "date,reading\n2023-11-14 22:13:20,80\n2023-11-14T22:18:20,81\n",
        "d2/004.csv": "nothing,here\n1,2\n",
    }.items():
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text(body)
    out = src.read_subject_csvs(spark, str(tmp_path)).orderBy("dataset", "subject_id", "ts").collect()
    got = [(r.dataset, r.subject_id, int(r.ts.timestamp()) - 1700000000, r.value) for r in out]
    assert got == [
        ("d1", "001", 0, 100.0), ("d1", "001", 300, 110.0), ("d1", "002", 0, 90.0), ("d1", "002", 300, 95.0),
        ("d1", "Subject 7+a", 0, 70.0),
        ("d2", "003", 0, 80.0), ("d2", "003", 300, 81.0),
    ]


def test_resolve_columns():
    assert src.resolve_columns(["Date", "mg"]) == ("Date", "mg")
    assert src.resolve_columns(["glucose", "TIME"]) == ("TIME", "glucose")
    with pytest.raises(ValueError):
        src.resolve_columns(["a", "b"])


def test_nested_subjects(spark):
    df = spark.createDataFrame([("d", "001", [300, 0, 300, None], [2.0, 1.0, 9.0, 5.0])], "dataset string, subject_id string, timestamp array<long>, BGvalue array<double>")
    out = src.read_nested_subjects(df).orderBy("ts").collect()
    assert [(r.subject_id, r.value) for r in out] == [("001", 1.0), ("001", 2.0)]


@pytest.mark.parametrize("raw", ["1700000000", "1700000000000", "1700000000000000000", "2023-11-14 22:13:20"])
def test_one_instant_in_four_notations(spark, raw):
    df = spark.createDataFrame([("s", raw)], "source string, raw string")
    assert int(one(clean.parse_timestamps(df, "raw", ["source"])).ts.timestamp()) == 1700000000


def test_event_xml(spark, tmp_path):
    (tmp_path / "559.xml").write_text(
        '<patient id="559"><glucose_level><event ts="07-12-2021 01:17:35" value="101"/><event ts="07-12-2021 01:22:00" value="98"/></glucose_level></patient>'
    )
    out = src.read_event_xml(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.subject_id, r.ts.second, r.value) for r in out] == [("559", 0, 101.0), ("559", 0, 98.0)]


def test_tsf(spark, tmp_path):
    (tmp_path / "a.tsf").write_text(
        "# note\n@relation x\n@attribute series_name string\n@attribute start date\n@frequency daily\n@horizon 3\n@data\nT1:2020-01-01 00-00-00:1,?,3.5\n"
    )
    df, facts = src.read_tsf(spark, str(tmp_path))
    row = one(df)
    assert row.series_name == "T1" and row.series_value == [1.0, None, 3.5] and row.start.year == 2020
    assert facts["frequency"] == "daily" and facts["horizon"] == "3"


def test_participants_collision(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"d1": ["a", "b"],\n "d2": ["c"]}')
    out = src.read_participants(spark, str(tmp_path))
    assert {(r.dataset, r.patient) for r in out.collect()} == {("d1", "a"), ("d1", "b"), ("d2", "c")}
    (tmp_path / "p.json").write_text('{"d1": ["a"], "d2": ["a"]}')
    with pytest.raises(Exception, match="several datasets"):
        src.read_participants(spark, str(tmp_path)).collect()


def test_series_shards_keep_every_value(spark):
    df = spark.range(100).select(F.lit("x").alias("item"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.col("id").cast("double").alias("value"))
    spec = SeriesSpec(keys=("item",), step=timedelta(minutes=1), chunk_steps=16)
    out = src_series.build_series(df, spec, "T", ["value"], shard_rows=30).orderBy("shard").collect()
    assert [len(r.target) for r in out] == [30, 30, 30, 10]
    assert sum((r.target for r in out), []) == [float(i) for i in range(100)]
    assert [int(r.start.timestamp()) for r in out] == [0, 1800, 3600, 5400]


def test_upsert(spark, tmp_path):
    base, keys = str(tmp_path / "r"), ["participant_id", "context_hours"]
    first = spark.createDataFrame([("1", 4, 1, 0.5), ("1", 4, 2, 0.6), ("2", 4, 1, 0.7)], "participant_id string, context_hours int, run int, rmse double")
    results.upsert_results(spark, base, 0, first, keys, "run")
    second = spark.createDataFrame([("1", 4, 3, 0.1, "new"), ("3", 4, 3, 0.2, "x")], "participant_id string, context_hours int, run int, rmse double, note string")
    out = results.upsert_results(spark, base, 1, second, keys, "run", ["participant_id", "rmse"])
    assert out.columns[:2] == ["participant_id", "rmse"]
    assert {(r.participant_id, r.rmse, r.note) for r in out.collect()} == {("1", 0.1, "new"), ("2", 0.7, None), ("3", 0.2, "x")}
    done = results.completed_keys(out, keys, first)
    todo = spark.createDataFrame([("1", 4), ("4", 4)], "participant_id string, context_hours int")
    assert [r.participant_id for r in results.skip_completed(todo, done, keys).collect()] == ["4"]
    assert results.completed_keys(first.drop("run", "context_hours"), keys, first).count() == 0


# forecasting, packing, arrays ------------------------------------------------


def test_forecast_apply_reports_failed_batches(spark):
    from stepgrid.catalog.forecasting import drift_model

    rows = [(i, [float(i), float(i + 1)]) for i in range(6)] + [(9, [-1.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, context array<double>").repartition(7, "id")
    out = {r.id: r for r in forecast.forecast_apply(df, ["id"], drift_model, ["point"]).collect()}
    assert len(out) == 7 and out[9].point is None and "negative" in out[9].error
    good = [r for r in out.values() if r.error is None]
    assert all(r.point == [r.id + 0.5, r.id + 1.5] for r in good) and good


def test_ridge_matches_numpy(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"a": rng.normal(size=300), "b": rng.normal(size=300) * 5, "k": rng.choice(["u", "v", "w"], 300)})
    pdf["y"] = 2 * pdf.a - pdf.b + (pdf.k == "v") * 3 + rng.normal(size=300)
    df = spark.createDataFrame(pdf)
    for ridge in (0.0, 4.0):
        fit = forecast.xreg_ridge(df, "y", ["a", "b"], {"k": ["u", "v", "w"]}, ridge)
        x = [np.ones(300)] + [(pdf[c] - pdf[c].mean()) / pdf[c].std(ddof=0) for c in ("a", "b")]
        x += [(pdf.k == c).astype(float) for c in (("u", "v", "w") if ridge else ("v", "w"))]
        x = np.column_stack(x)
        want = x @ (np.linalg.pinv(x.T @ x + ridge * np.eye(x.shape[1])) @ x.T @ pdf.y)
        got = [r[0] for r in df.select(fit.predict()).collect()]
        assert np.allclose(got, want)


def test_packing_is_first_fit_decreasing(spark):
    sizes = [5, 3, 3, 2, 2, 1, 7]
    df = spark.createDataFrame([(i, [float(i)] * n) for i, n in enumerate(sizes)], "id long, s array<double>")
    plan = packing.pack_plan(df, "id", "s", 8, 100).collect()
    bins = {}
    for r in plan:
        bins.setdefault(r.bin, []).append(r.length)
    assert [sorted(bins[b], reverse=True) for b in sorted(bins)] == [[7, 1], [5, 3], [3, 2, 2]]
    rows = packing.pack_sequences(df, "id", "s", 8, 100).collect()
    assert sum(s > 0 for r in rows for s in r.sample_id) == sum(sizes)
    with pytest.raises(Exception, match="longer than the bin"):
        packing.pack_plan(df, "id", "s", 6, 100).collect()


def test_quantization_boundaries(spark):
    # five centres -2..2, one special token: boundaries at -1.5, -0.5, 0.5, 1.5
    df = spark.createDataFrame([([-0.5, 0.5, 0.49, 2.0, None, -9.0],)], "x array<double>")
    q = arrays.quantize(F.col("x"), -2.0, 2.0, 7, 1)
    row = df.select(q["scale"].alias("s"), q["tokens"].alias("t")).first()
    scale_ = row.s
    want = []
    for v in [-0.5, 0.5, 0.49, 2.0, None, -9.0]:
        want.append(0 if v is None else min(6, int(np.searchsorted([-1e20, -1.5, -0.5, 0.5, 1.5, 1e20], v / scale_, side="right")) + 1))
    assert row.t == want


@pytest.mark.parametrize(
    "query,levels,values,expected",
    [(0.5, [0.1, 0.9], [0.0, 8.0], 4.0), (0.05, [0.1, 0.9], [0.0, 8.0], 0.0), (0.95, [0.1, 0.9], [0.0, 8.0], 8.0), (0.3, [0.9, 0.1, 0.5], [8.0, 0.0, 2.0], 1.0)],
)
def test_quantile_interpolation(spark, query, levels, values, expected):
    df = spark.createDataFrame([tuple(values)], [f"c{i}" for i in range(len(values))])
    got = df.select(arrays.quantile_at(query, levels, [F.col(c) for c in df.columns])).first()[0]
    assert math.isclose(got, expected)


def test_instance_norm_of_constant_and_empty(spark):
    df = spark.createDataFrame([([5.0, 5.0],), ([None, None],), ([1.0, 3.0],)], "x array<double>")
    stats_ = arrays.instance_norm(F.col("x"))
    got = [(r.a, r.b) for r in df.select(stats_["loc"].alias("a"), stats_["scale"].alias("b")).collect()]
    assert got == [(5.0, 1e-5), (0.0, 1.0), (2.0, 1.0)]


def test_window_median_is_the_lower_one(spark):
    df = spark.createDataFrame([([4.0, 1.0, 3.0, 2.0],)], "x array<double>")
    stats_ = arrays.window_stats(F.col("x"))
    row = df.select(stats_["median_value"].alias("m"), stats_["trend"].alias("t")).first()
    assert row.m == 2.0 and row.t == "downward"


def test_coral_and_mmd_of_equal_sets(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    rows = [(i, x[i % 60].tolist(), i < 60) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, v array<double>, s boolean").repartition(3)
    assert abs(one(distances.coral(df, "v", F.col("s"), 4)).coral) < 1e-12
    assert abs(one(distances.linear_mmd(df, "v", F.col("s"))).linear_mmd) < 1e-20
    far = df.withColumn("v", F.when(F.col("s"), F.transform("v", lambda e: e + 5)).otherwise(F.col("v")))
    near = distances.rbf_mmd(df, "id", "v", F.col("s"), 120).first().mmd
    assert distances.rbf_mmd(far, "id", "v", F.col("s"), 120).first().mmd > near + 0.5


# calendar and text -----------------------------------------------------------


def test_easter():
    assert [calendar.easter(y) for y in (1999, 2000, 2024, 2025)] == [date(1999, 4, 4), date(2000, 4, 23), date(2024, 3, 31), date(2025, 4, 20)]


def test_holiday_rules():
    h = calendar.HOLIDAYS
    assert h["thanksgiving"](2024) == date(2024, 11, 28) and h["cyber_monday"](2024) == date(2024, 12, 2)
    assert h["memorial_day"](2024) == date(2024, 5, 27) and h["labor_day"](2024) == date(2024, 9, 2)
    assert h["superbowl"](2021) == date(2021, 2, 7) and h["mothers_day"](2022) == date(2022, 5, 8)


def test_sunday_week_and_week_dates(spark):
    days = [date(2026, 1, 1), date(2026, 1, 4), date(2023, 1, 1), date(2026, 12, 31), date(2024, 2, 29)]
    df = spark.createDataFrame([(d,) for d in days], "d date")
    assert [r[0] for r in df.select(calendar.sunday_week(F.col("d"))).collect()] == [int(d.strftime("%U")) for d in days]
    from datetime import datetime

    weeks = ["202401", "202300", "202052", "201553"]
    df = spark.createDataFrame([(w,) for w in weeks], "w string")
    got = [r[0] for r in df.select(calendar.week_end_date(F.col("w"))).collect()]
    assert got == [datetime.strptime(w + "0", "%Y%W%w").date() for w in weeks]


def test_text_cells(spark):
    df = spark.createDataFrame([(0.00042, 59.96, "9.50 (1.25)"), (0.02, 3601.0, "bad"), (None, None, None)], "p double, s double, c string")
    cols = text.parse_mean_std(F.col("c"))
    out = df.select(
        text.p_value_text(F.col("p")).alias("p"), text.significance_stars(F.col("p")).alias("q"), text.duration_text(F.col("s")).alias("s"), cols["mean"].alias("m"), cols["std"].alias("d")
    ).collect()
    assert [tuple(r) for r in out] == [("4.2e-04", "***", "60.0s", 9.5, 1.25), ("0.020", "*", "1.00h", None, None), ("NA", "NA", "-", None, None)]


def test_strict_routing_fails(spark):
    df = spark.createDataFrame([("zzz",)], "s string")
    with pytest.raises(Exception, match="unknown subject"):
        df.select(text.route_subject(F.col("s"), [("^a", "x")], strict=True)).collect()


# roll-ups ----------------------------------------------------------------------


def test_overall_rows_count_each_participant_once(spark):
    rows = [("m", "open", float(v)) for v in (1, 3)] + [("m", "closed", 8.0)]
    df = spark.createDataFrame(rows, "method string, dataset string, v double")
    got = {r.dataset: (r.n_participants, r.v_mean) for r in rollup.overall_rows(df, "method", "dataset", ["closed"], ["v"]).collect()}
    assert got == {"open": (2, 2.0), "closed": (1, 8.0), "Overall (Open)": (2, 2.0), "Overall (Total)": (3, 4.0)}


def test_interval_modes_differ(spark):
    rows = [(1, 0, 5.0, 4.0, 6.0), (1, 1, 9.0, 4.0, 6.0), (2, 0, 9.0, 4.0, 6.0), (2, 1, 9.0, 4.0, 6.0)]
    df = spark.createDataFrame(rows, "w int, horizon_step int, ground_truth double, lo double, hi double").withColumns({"prediction": F.lit(1.0), "g": F.lit(1)})
    assert one(panels.interval_quality(df, ["g"], [("pi", "lo", "hi")])).pi_coverage == 0.25
    assert one(panels.interval_quality(df, ["g"], [("pi", "lo", "hi")], "window", ["w"])).pi_coverage == 0.5


def test_scalers_on_short_groups(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", None)], "k string, v double")
    got = {r.k: (r.loc, r.scale) for r in scale.masked_scaler(df, ["k"], "v", F.col("v").isNotNull()).collect()}
    assert got["a"][0] == 2.0 and math.isclose(got["a"][1], math.sqrt(1e-5)) and got["b"][0] == 1.0


def test_validation_of_frames(spark):
    spec = SeriesSpec(keys=("item_id",), ts="timestamp", value="target", step=timedelta(days=1))
    rows = [("A", d) for d in (1, 2, 3, 4)] + [("B", d) for d in (1, 2, 4)] + [("C", 1), ("C", 2)] + [("D", d) for d in (1, 3, 5)]
    df = spark.createDataFrame(rows, "item_id string, d int").select("item_id", F.make_date(F.lit(2024), F.lit(1), "d").cast("timestamp").alias("timestamp"), F.lit(1.0).alias("target"))
    got = {(r.item_id, r.problem) for r in clean.validate_forecast_frame(df, spec, ["target"]).collect()}
    assert ("B", "irregular") in got and ("C", "too few points") in got
    assert len([p for p in got if p[1] == "different frequency"]) == 1


# streaming ---------------------------------------------------------------------


def test_latest_stream_over_triggers(spark, tmp_path):
    from stepgrid.operators.windows import latest_window
    from stepgrid.streaming.latest import latest_stream

    spec = SeriesSpec(step=timedelta(minutes=5))
    minutes = [0, 5, 10, 15, 25, 30, 35, 40, 55, 60, 20]  # 20 arrives late and closes a gap
    schema = "dataset string, subject_id string, ts timestamp, value double"
    all_rows = spark.createDataFrame([("d", "a", m, float(m)) for m in minutes], "dataset string, subject_id string, m int, value double")
    all_rows = all_rows.select("dataset", "subject_id", F.timestamp_seconds(1_700_000_000 + F.col("m") * 60).alias("ts"), "value")
    source = str(tmp_path / "in")

    def run():
        job = (
            latest_stream(spark.readStream.schema(schema).parquet(source), spec, 4, "1 day")
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
            .outputMode("append").trigger(availableNow=True).start()
        )
        job.awaitTermination()

    for part in (minutes[:4], minutes[4:10], minutes[10:]):
        all_rows.filter(F.col("value").isin([float(m) for m in part])).coalesce(1).write.mode("append").parquet(source)
        run()
    out = spark.read.parquet(str(tmp_path / "out"))
    newest = out.orderBy(F.col("last_us").desc()).first()
    want = one(latest_window(all_rows, spec, 4))
    assert newest.context == want.context == [25.0, 30.0, 35.0, 40.0]
    assert sorted(r.context[0] for r in out.collect()) == [0.0, 25.0]


def test_csv_headers_with_quotes_and_length(spark, tmp_path):
    from stepgrid.sources import readings as src

    folder = tmp_path / "data" / "set"
    folder.mkdir(parents=True)
    wide = ",".join(f"column {k} {'x' * 40}" for k in range(3000))  # over 64 KiB
    (folder / "a.csv").write_text('timestamp,"BG, value"\n2024-01-01 00:00:00,101\n2024-01-01 00:05:00,102\n')
    (folder / "b.csv").write_text(f"time,glucose,{wide}\n2024-01-01 00:00:00,103{',' * 3000}\n")
    (folder / "c.csv").write_text("﻿Time , Value \n2024-01-01 00:00:00,104\n", encoding="utf-8")
    (folder / "d.csv").write_text("one,two\n1,2\n")
    got = src.read_subject_csvs(spark, str(tmp_path / "data")).collect()
    assert sorted((r.subject_id, r.value) for r in got) == [("a", 101.0), ("a", 102.0), ("b", 103.0), ("c", 104.0)]
    left_out = src.unresolved_csvs(spark, str(tmp_path / "data")).collect()
    assert [r.path.rsplit("/", 1)[1] for r in left_out] == ["d.csv"]
    assert "no time or value column" in left_out[0].problem


def test_upsert_keeps_rows_without_order(spark):
    from stepgrid.sources.results import merge_results

    stored = spark.createDataFrame([("1", 0.5), ("2", 0.7)], "participant_id string, rmse double")
    new = spark.createDataFrame([("1", 0.4, 9)], "participant_id string, rmse double, run int")
    rows = merge_results(stored, new, ["participant_id"], "run").collect()
    assert sorted((r.participant_id, r.rmse, r.run) for r in rows) == [("1", 0.4, 9), ("2", 0.7, None)]


def test_upsert_keeps_rows_that_predate_the_key(spark):
    from stepgrid.sources.results import merge_results

    stored = spark.createDataFrame([("1", 0.5), ("1", 0.6)], "participant_id string, rmse double")
    new = spark.createDataFrame([("1", 2, 0.4, 1), ("1", 2, 0.3, 2)], "participant_id string, stride int, rmse double, run int")
    rows = merge_results(stored, new, ["participant_id", "stride"], "run").collect()
    assert sorted(r.rmse for r in rows) == [0.3, 0.5, 0.6]


def test_only_the_bad_window_fails(spark):
    from stepgrid.operators.forecast import forecast_apply

    def make_model():
        def model(contexts):
            import numpy as np

            if any((c < 0).any() for c in contexts):
                raise ValueError("negative reading")
            return {"point": np.array([[c[-1], c[-1]] for c in contexts])}

        return model

    windows = spark.range(300).select("id", F.array(F.col("id").cast("double"), F.when(F.col("id") == 77, -1.0).otherwise(1.0)).alias("context"))
    out = forecast_apply(windows, ["id"], make_model, ["point"]).collect()
    assert [r.id for r in out if r.error] == [77]
    assert sum(r.point == [1.0, 1.0] for r in out) == 299


def test_holidays_of_any_year(spark):
    from stepgrid.functions.calendar import HOLIDAYS, holiday_distance

    days = spark.sql("SELECT explode(array(DATE'1931-05-01', DATE'2010-03-03', NULL)) AS day")
    rows = holiday_distance(days, "day").collect()
    assert {r.day.year for r in rows} == {1931, 2010}
    assert {r.holiday for r in rows if r.day.year == 2010} == set(HOLIDAYS)


def test_freq_class(spark):
    from stepgrid.functions.calendar import freq_class

    want = {"H": 0, "5min": 0, "D": 0, "W": 1, "MS": 1, "M": 1, "ME": 1, "Q": 2, "A": 2, "W-SUN": 1, "Q-DEC": 2, "QS": 0, "x!": None}
    rows = spark.createDataFrame([(k,) for k in want], "f string").select("f", freq_class(F.col("f")).alias("c")).collect()
    assert {r.f: r.c for r in rows} == want


def test_latest_stream_with_a_late_reading(spark, tmp_path):
    from stepgrid.operators.windows import latest_window
    from stepgrid.streaming.latest import latest_stream

    spec = SeriesSpec(step=timedelta(minutes=5))
    minutes = [0, 5, 10, 20, 30, 40, 15]
    schema = "dataset string, subject_id string, ts timestamp, value double"
    rows = spark.createDataFrame([("d", "a", m, float(m)) for m in minutes], "dataset string, subject_id string, m int, value double")
    rows = rows.select("dataset", "subject_id", F.timestamp_seconds(1_700_000_000 + F.col("m") * 60).alias("ts"), "value")
    source = str(tmp_path / "in")
    for part in (minutes[:6], minutes[6:]):
        rows.filter(F.col("value").isin([float(m) for m in part])).coalesce(1).write.mode("append").parquet(source)
        job = (
            latest_stream(spark.readStream.schema(schema).parquet(source), spec, 5, "30 minutes")
            .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp"))
            .outputMode("append").trigger(availableNow=True).start()
        )
        job.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [r.context for r in out] == [one(latest_window(rows, spec, 5)).context] == [[0.0, 5.0, 10.0, 15.0, 20.0]]


def test_padding_refuses_longer_sequences(spark):
    from stepgrid.operators.packing import pad_sequences

    df = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0, 3.0, 4.0, 5.0],)], "v array<double>")
    assert pad_sequences(df.limit(1), "v", 4).first()["values"] == [1.0, 2.0, 0.0, 0.0]
    with pytest.raises(Exception, match="sequence longer than 4"):
        pad_sequences(df, "v", 4).collect()


@pytest.mark.parametrize("chunk", [4, 4096])
def test_mixture_sample_cuts_whole_series(spark, chunk):
    from stepgrid.operators.sampling import mixture_sample

    spec = SeriesSpec(step=timedelta(minutes=5), chunk_steps=chunk)
    rows = spark.range(90).select(
        F.lit("d").alias("dataset"), (F.col("id") % 2).cast("string").alias("subject_id"), F.timestamp_seconds(F.col("id") * 300).alias("ts"), F.col("id").cast("double").alias("value")
    )
    out = mixture_sample(spark, rows, spec, "dataset", "subject_id", {"d": 1.0}, 300, 3, 3, 8, 2).collect()
    assert len(out) == 300 and max(r.cut for r in out) > 35
    for r in out:
        series = [float(v) for v in range(int(r.subject_id), 90, 2)]
        assert r.past == series[max(r.cut - 8, 0) : r.cut] and r.future == series[r.cut : r.cut + 2]
