"""Results that the third round's review found wrong."""

import io
import math
import os
from datetime import timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from stepgrid.functions import clinical, metrics
from stepgrid.series import SeriesSpec
from stepgrid.sources import readings, results, series

SF = os.environ.get("STEPGRID_TEST_SF", "/root/testdata/sf0.001")
ZEROS = """CASE WHEN user_id % 5 = 1 AND epoch(ts) // 86400 % 5 < 2 THEN 0.0 WHEN user_id % 5 = 2 THEN 0.0 WHEN user_id % 5 = 3 THEN 5.0 ELSE value END"""


def test_band_edges_of_the_surveillance_rules_are_exact(spark):
    rows = [(r, m, 0.0 if 85 * r <= 100 * m <= 115 * r else 1.0) for r in range(100, 600) for m in {r * 85 // 100, -(-r * 85 // 100), r * 115 // 100, r * 115 // 100 + 1} if m < 600]
    df = spark.createDataFrame([(float(r), float(m), z) for r, m, z in rows], "r double, m double, z double")
    bad = df.withColumn("got", clinical.seg_rule_risk(F.col("r"), F.col("m"))).filter("(got = 0) <> (z = 0)").collect()
    assert not bad


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Events whose days are zero now and then, always zero, or always the same."""
    folder = str(tmp_path_factory.mktemp("zeros"))
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"COPY (SELECT * REPLACE ({ZEROS} AS value) FROM '{SF}/events.parquet') TO '{folder}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    return folder, con


def same(x, y):
    if isinstance(x, float) and isinstance(y, float):
        return x == y or (math.isnan(x) and math.isnan(y)) or math.isclose(x, y, rel_tol=1e-9)
    return x == y and (x is None) == (y is None)


@pytest.mark.parametrize("name", ["competition_summary", "panel_by_item", "panel_by_time", "panel_overall", "percentage_metrics", "mase", "bias_abs_score"])
def test_zero_denominators_score_as_in_sql(spark, zeros, name):
    folder, con = zeros
    frame = entry.queries()[name](spark, folder)
    cursor = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in frame.columns]
    keys = [i for i, (_, kind) in enumerate(frame.dtypes) if kind in ("string", "bigint")]
    order = lambda rows: sorted(rows, key=lambda r: [r[i] for i in keys])
    got, want = order([tuple(r) for r in frame.collect()]), order([tuple(r[i] for i in at) for r in cursor.fetchall()])
    assert len(got) == len(want)
    assert not [(g, w) for g, w in zip(got, want, strict=True) if not all(map(same, g, w))]
    assert any(isinstance(v, float) and not math.isfinite(v) for r in want for v in r) or name == "bias_abs_score"


@pytest.mark.parametrize("name", ["panel_by_item", "panel_by_time", "panel_overall"])
@pytest.mark.parametrize("odd", ["NULL", "'nan'::DOUBLE"])
def test_panels_score_missing_days_as_in_sql(spark, tmp_path, name, odd):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    value = f"CASE WHEN user_id % 4 = 0 AND floor(epoch(ts) / 86400)::BIGINT % 3 = 0 OR user_id % 11 = 5 THEN {odd} ELSE value END"
    con.execute(f"COPY (SELECT * REPLACE ({value} AS value) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    frame = entry.queries()[name](spark, str(tmp_path))
    cursor = con.execute(entry.oracle_sql()[name])
    at = [[d[0] for d in cursor.description].index(c) for c in frame.columns]
    key = lambda r: [v for v in r if isinstance(v, (str, int))]
    got, want = sorted(map(tuple, frame.collect()), key=key), sorted((tuple(r[i] for i in at) for r in cursor.fetchall()), key=key)
    assert len(got) == len(want)
    assert not [(g, w) for g, w in zip(got, want, strict=True) if not all(map(same, g, w))]


def test_scores_do_not_depend_on_the_order_of_rows(spark):
    rows = [((i * 7919 % 56021) / 100, (i * 104729 % 49999) / 100, 0.01 + i % 13) for i in range(6000)]
    p, t, s = F.col("p"), F.col("t"), F.col("s")
    aggs = [metrics.mse(p, t), metrics.rmse(p, t), metrics.mae(p, t), metrics.nd(p, t), metrics.nrmse(p, t), metrics.msis(p * 0.4, p * 2.5, t, s)]
    orders = [rows, rows[::-1], sorted(rows), sorted(rows, key=lambda r: abs(r[0] - r[1]))]
    got = {tuple(spark.createDataFrame(x, "p double, t double, s double").coalesce(1).agg(*aggs).first()) for x in orders}
    got.add(tuple(spark.createDataFrame(rows, "p double, t double, s double").repartition(7).agg(*aggs).first()))
    assert len(got) == 1
    mse, _, mae, nd, _, _ = got.pop()
    assert mse == math.fsum((a - b) * (a - b) for a, b, _ in rows) / 6000
    assert mae == math.fsum(abs(a - b) for a, b, _ in rows) / 6000
    assert nd == math.fsum(abs(a - b) for a, b, _ in rows) / math.fsum(b for _, b, _ in rows)


@pytest.mark.parametrize("odd", [[1.0, math.inf], [math.inf, -math.inf], [1.0, math.nan], [1e300, 1e-300], [-0.25, 2.0**36, 1e-9], [None, 3.0], [None], []])
def test_steady_sums_take_odd_values_as_plain_ones_do(spark, odd):
    row = spark.createDataFrame([(x,) for x in odd], "x double").coalesce(1).agg(metrics.steady_sum(F.col("x")), metrics.steady_avg(F.col("x")), F.sum("x"), F.avg("x")).first()
    assert all(map(same, row[:2], row[2:])), row


def test_corpus_series_writes_runs_and_not_the_grid(spark, monkeypatch):
    spec = SeriesSpec(keys=("item",), step=timedelta(seconds=1), chunk_steps=16)
    rows = [("a", 0, 1.0), ("a", 5, None), ("a", 95, 2.0), ("b", 7, 3.0), ("b", 8, 4.0), ("c", 0, 5.0)]
    df = spark.createDataFrame(rows, "item string, s long, value double").select("item", F.timestamp_seconds("s").alias("ts"), "value")
    written = []
    monkeypatch.setattr(series, "settle", lambda table, name: written.append(table.count()) or table)
    out = series.corpus_series(df, spec, "s", 2, 0.98, shard_rows=40).orderBy("item_id", "shard").collect()
    assert written == [3 + 1 + 1]  # shards of a, b and c
    targets = [(r.item_id, r.shard, r.start.timestamp(), list(r.target)) for r in out]
    a = [1.0] + [None] * 94 + [2.0]
    assert targets == [("a", 0, 0.0, a[:40]), ("a", 1, 40.0, a[40:80]), ("a", 2, 80.0, a[80:]), ("b", 0, 7.0, [3.0, 4.0])]


def test_blocks_of_a_csv_hold_every_line_once():
    text = "a,b\r\n1,2\n\n3,äö\r5,6\nlast".encode()
    want = [line for line in text.decode().replace("\r", "\n").split("\n") if line]
    for width in range(1, len(text) + 2):
        got = []
        for start in range(0, len(text), width):
            got += [line for line in readings.block_lines(io.BytesIO(text), start, min(start + width, len(text))) if line]
        assert got == want, width


def test_subject_csvs_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(readings, "BLOCK_BYTES", 64)  # files are read in several blocks
    monkeypatch.setattr(type(spark.read), "text", None)  # the driver lists no files
    rows = [(f"s{k % 40}/{k % 2}", 1_700_000_000 + 60 * k, k / 4) for k in range(800)]
    df = spark.createDataFrame(rows, "subject_id string, s long, value double").select(F.lit("d").alias("dataset"), "subject_id", F.timestamp_seconds("s").alias("ts"), "value")
    spec = SeriesSpec(step=timedelta(minutes=1), chunk_steps=100)
    results.write_subject_csvs(df, spec, str(tmp_path / "out"))
    folder = next((tmp_path / "out" / "dataset=d").iterdir())
    (folder / ".part-left-by-a-failed-task").write_text("timestamp,BGvalue\n1,1\n")
    back = readings.read_subject_csvs(spark, str(tmp_path / "out"), r"dataset=([^/]+)/subject_id=([^/]+)/[^/]*\.csv$")
    got = sorted((r.subject_id, int(r.ts.timestamp()), r.value) for r in back.collect())
    assert got == sorted((name.replace("/", "%2F"), s, v) for name, s, v in rows)
    with pytest.raises(FileExistsError):
        results.write_subject_csvs(df, spec, str(tmp_path / "out"))
