"""Runs, segments, windows and scans against plain loops, over chunk borders."""

import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stepgrid.operators import anomaly, clean, gaps, impute, windows
from stepgrid.series import SeriesSpec, chunked, with_position

STEP = 300
LIMITS = [None, timedelta(minutes=6), timedelta(hours=1)]


def random_rows(seed=1, subjects=4, n=120):
    rng = random.Random(seed)
    rows = []
    for s in range(subjects):
        t = rng.randint(-50, 50) * STEP  # some epochs are negative
        for _ in range(n):
            rows.append(("d", str(s), t, rng.random() if rng.random() > 0.2 else None))
            t += rng.choice([STEP] * 12 + [240, 360, 600, 5000, 2700])
    return pd.DataFrame(rows, columns=["dataset", "subject_id", "sec", "value"])


@pytest.fixture(scope="module")
def rows():
    return random_rows()


@pytest.fixture(scope="module")
def frame(spark, rows):
    df = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), "dataset string, subject_id string, sec long, value double")
    df = df.withColumn("ts", F.timestamp_seconds("sec")).coalesce(2).cache()
    df.count()
    return df


def spec(chunk):
    return SeriesSpec(step=timedelta(seconds=STEP), chunk_steps=chunk)


def segments(t, limit):
    cut = [0]
    for a, b in zip(t, t[1:]):
        gap = b - a
        cut.append(cut[-1] + int(gap != STEP if limit is None else gap > limit.total_seconds()))
    return cut


def sorted_pd(df):
    return df.toPandas().sort_values(["subject_id", "sec"]).reset_index(drop=True)


@pytest.mark.parametrize("chunk", [4, 4096])
def test_runs(frame, rows, chunk):
    got = sorted_pd(gaps.contiguous_runs(frame, spec(chunk)))
    want = []
    for _, g in rows.groupby("subject_id"):
        t = g.sec.tolist()
        run = [0] * len(t)
        for i in range(len(t) - 2, -1, -1):
            run[i] = run[i + 1] + 1 if t[i + 1] - t[i] == STEP else 0
        want += run
    assert got.run.tolist() == want


def test_endpoints_do_not_prove_a_run(spark):
    steps = np.cumsum([0, 5, 5, 4, 6, 5, 10, 5]) * 60
    df = spark.createDataFrame([("d", "a", int(s), 1.0) for s in steps], "dataset string, subject_id string, sec long, value double")
    df = df.withColumn("ts", F.timestamp_seconds("sec"))
    got = sorted_pd(gaps.contiguous_runs(df, spec(4096)))
    assert got.run.tolist() == [2, 1, 0, 0, 1, 0, 1, 0]
    # 4 + 6 minutes end on the grid but are no run
    assert windows.persistence_pairs(df, spec(4096), 2).count() == 1


@pytest.mark.parametrize("chunk", [4, 4096])
@pytest.mark.parametrize("limit", LIMITS)
def test_segments(frame, rows, chunk, limit):
    got = sorted_pd(gaps.segment_by_gap(frame, spec(chunk), limit))
    for s, g in rows.groupby("subject_id"):
        mine = got[got.subject_id == s]
        want = segments(g.sec.tolist(), limit)
        assert mine.segment_id.tolist() == want
        assert mine.pos.tolist() == list(range(len(g)))
        assert mine.seg_pos.tolist() == [i - want.index(k) for i, k in enumerate(want)]


@pytest.mark.parametrize("seconds,parts", [(359, 1), (360, 1), (361, 2)])
def test_segment_limit_is_inclusive(spark, seconds, parts):
    df = spark.createDataFrame([("d", "a", 0, 1.0), ("d", "a", seconds, 1.0)], "dataset string, subject_id string, sec long, value double")
    out = gaps.segment_by_gap(df.withColumn("ts", F.timestamp_seconds("sec")), spec(16), timedelta(minutes=6))
    assert out.select("segment_id").distinct().count() == parts


@pytest.mark.parametrize("chunk", [4, 64])
@pytest.mark.parametrize("stride", [1, 3])
@pytest.mark.parametrize("limit", LIMITS)
def test_windows(frame, rows, chunk, stride, limit):
    s = spec(chunk)
    made = windows.windows_contiguous(frame, s, 4, 2, stride) if limit is None else windows.windows_segmented(frame, s, 4, 2, stride, limit)
    got = sorted((r.subject_id, r.window_start, tuple(r.context), tuple(r.target)) for r in made.collect())
    want = []
    for name, g in rows.groupby("subject_id"):
        seg, v = segments(g.sec.tolist(), limit), g.value.tolist()
        for i in range(len(v) - 5):
            offset = i if limit is None else i - seg.index(seg[i])
            part = v[i : i + 6]
            if seg[i] == seg[i + 5] and offset % stride == 0 and not any(x is None or x != x for x in part):
                want.append((name, i, tuple(part[:4]), tuple(part[4:])))
    assert got == sorted(want)


@pytest.mark.parametrize("limit", LIMITS)
def test_counts_equal_windows(frame, limit):
    whole = frame.withColumn("value", F.lit(1.0))
    counts = windows.count_windows(whole, spec(8), 6, [1, 2, 5], ["dataset"], limit).collect()
    for row in counts:
        if limit is None:
            made = windows.windows_contiguous(whole, spec(8), 4, 2, row.stride)
        else:
            made = windows.windows_segmented(whole, spec(8), 4, 2, row.stride, limit)
        assert made.count() == row.windows


@pytest.mark.parametrize("chunk", [4, 4096])
def test_latest(frame, rows, chunk):
    whole = frame.withColumn("value", F.lit(1.0))
    got = {r.subject_id: r.window_start for r in windows.latest_window(whole, spec(chunk), 4, 2).collect()}
    for name, g in rows.groupby("subject_id"):
        seg = segments(g.sec.tolist(), None)
        starts = [i for i in range(len(seg) - 5) if seg[i] == seg[i + 5]]
        assert got.get(name) == (starts[-1] if starts else None)


def test_steps_from_hours():
    five = timedelta(minutes=5)
    assert windows.context_steps(12, five) == 144
    assert windows.horizon_steps(30, five) == 6
    assert windows.horizon_steps(1, five) == 1
    assert windows.patch_multiple(144, 96) == 96 and windows.patch_multiple(48, 96) == 0


@pytest.mark.parametrize("chunk", [4, 4096])
def test_imputation(frame, rows, chunk):
    s = spec(chunk)
    last = sorted_pd(impute.impute_last(frame, s, -1.0)).imputed.tolist()
    mean = sorted_pd(impute.impute_causal_mean(frame, s, -1.0)).imputed.tolist()
    linear = sorted_pd(impute.impute_linear(frame, s))
    want_last, want_mean, want_linear = [], [], []
    for _, g in rows.groupby("subject_id"):
        v = g.value.astype(float).to_numpy()
        fill = pd.Series(v).ffill().fillna(-1.0).to_numpy()
        want_last += fill.tolist()
        want_mean += [fill[i] if i == 0 or v[i] == v[i] else fill[:i].mean() for i in range(len(v))]
        seen = np.flatnonzero(~np.isnan(v))
        want_linear += np.interp(np.arange(len(v)), seen, v[seen])[seen[0] :].tolist()
    assert last == want_last
    assert np.allclose(mean, want_mean)
    assert np.allclose(linear.imputed.tolist(), want_linear)


@pytest.mark.parametrize("chunk", [4, 4096])
def test_regular_grid(frame, rows, chunk):
    got = clean.regularize(frame.drop("sec"), spec(chunk)).groupBy("subject_id").agg(F.count("*").alias("n"), F.count("value").alias("k"))
    want = {}
    for name, g in rows.groupby("subject_id"):
        lo, hi = g.sec.min(), g.sec.max()
        on_grid = g[(g.sec - lo) % STEP == 0]
        want[name] = ((hi - lo) // STEP + 1, int(on_grid.value.notna().sum()))
    assert {r.subject_id: (r.n, r.k) for r in got.collect()} == want


@pytest.mark.parametrize("chunk", [4, 4096])
def test_lags(frame, rows, chunk):
    out = windows.lag_rows(with_position(frame, spec(chunk)), spec(chunk), {"a": 1, "b": 7})
    got = sorted_pd(out)
    for name, g in rows.groupby("subject_id"):
        mine = got[got.subject_id == name]
        assert mine.a.equals(pd.Series(g.value.astype(float)).shift(1).set_axis(mine.index).rename("a"))
        assert mine.b.equals(pd.Series(g.value.astype(float)).shift(7).set_axis(mine.index).rename("b"))


@pytest.mark.parametrize("chunk", [4, 4096])
def test_point_adjust(frame, rows, chunk):
    df = frame.withColumn("label", (F.pmod(F.xxhash64("sec"), F.lit(3)) > 0).cast("int"))
    df = df.withColumn("pred", (F.pmod(F.xxhash64("sec", F.lit(1)), F.lit(5)) == 0).cast("int"))
    got = sorted_pd(anomaly.point_adjust(df, spec(chunk), "label", "pred"))
    for _, g in got.groupby("subject_id"):
        label, pred, out = g.label.tolist(), g.pred.tolist(), g.adjusted.tolist()
        want, i = list(pred), 0
        while i < len(label):
            j = i
            while j < len(label) and label[j] == 1:
                j += 1
            if j > i and any(pred[i:j]):
                want[i:j] = [1] * (j - i)
                if i == 0:
                    want[0] = pred[0]
            i = max(j, i + 1)
        assert out == want


def test_long_subject_is_spread(spark):
    """One subject with nearly all rows still makes many bounded groups."""
    df = spark.range(20_000).select(
        F.lit("d").alias("dataset"), F.lit("hot").alias("subject_id"), F.timestamp_seconds(F.col("id") * STEP).alias("ts"), F.lit(1.0).alias("value")
    )
    sizes = chunked(df, spec(512), behind_us=10 * STEP * 1_000_000).groupBy("subject_id", "_chunk").count()
    biggest = sizes.agg(F.max("count")).first()[0]
    assert biggest <= 512 + 10 and sizes.count() >= 39
    assert windows.count_windows(df, spec(512), 150, [1], ["dataset"]).first().windows == 20_000 - 149


@pytest.mark.parametrize("chunk", [4, 4096])
def test_windows_by_place_do_not_depend_on_chunks(spark, chunk):
    from datetime import timedelta

    from stepgrid.operators import windows as w

    n = 20
    spec = SeriesSpec(keys=("k",), step=timedelta(minutes=5), chunk_steps=chunk)
    df = spark.range(n).select(F.lit("s").alias("k"), F.timestamp_seconds(F.col("id") * 300 + F.col("id") % 3).alias("ts"), F.col("id").cast("double").alias("value"))
    values = [float(v) for v in range(n)]
    got = {r.s_begin: (r.seq_x, r.seq_y) for r in w.encoder_decoder(df, spec, 4, 2, 2).collect()}
    assert got == {b: (values[b : b + 4], values[b + 2 : b + 6]) for b in range(15)}
    got = {r["at"]: r.window for r in w.stepped_windows(df, spec, 5, 5).collect()}
    assert got == {b: values[b : b + 5] for b in (0, 5, 10, 15)}
    tails = w.padded_tail(df, spec, 24).collect()
    assert [(r.insample, r.insample_mask) for r in tails] == [([0.0] * 4 + values, [0.0] * 4 + [1.0] * 20)]
    rows = w.rolling_origin(df, spec, 2, 2).collect()
    parts = {(r.fold, r.cut_at, r.part, r.value) for r in rows}
    assert {(f, c) for f, c, *_ in parts} == {(0, 16), (1, 18)}
    assert sorted(v for f, _, part, v in parts if f == 1 and part == "label") == [18.0, 19.0]
    assert sum(part == "history" for f, _, part, _ in parts if f == 0) == 16
    got = {r.window: (r.forecast_start, r.context, r.label) for r in w.rolling_slices(df, spec, -8, 2, 4, 6, 2).collect()}
    assert got == {k: (12 + 2 * k, values[6 + 2 * k : 12 + 2 * k], values[12 + 2 * k : 14 + 2 * k]) for k in range(4)}
    early = {r.window: r.context for r in w.rolling_slices(df, spec, 2, 3, 2, 6, 2).collect()}
    assert early == {0: values[:2], 1: values[:5]}
    (cut,) = w.cut_point_window(df, spec, F.col("k"), 7, 10, 8, 4).collect()
    assert 10 <= cut.cut < 20
    assert cut.insample == values[cut.cut - 8 : cut.cut] and cut.outsample == (values[cut.cut : cut.cut + 4] + [0.0] * 4)[:4]
    shared = df.withColumn("feat", F.when(F.col("value") < 14, F.col("value") * 2))
    got = {r["at"]: (r.past, r.future, r.features) for r in w.shared_axis_windows(shared, spec, "feat", 1, 4, 2, 3, 6).collect()}
    feats = lambda a: ([2.0 * v for v in range(a, min(a + 6, 14))] + [26.0] * 6)[:6]
    assert got == {a: (values[a : a + 4], values[a + 4 : a + 6], feats(a)) for a in (1, 4, 7, 10, 13)}
