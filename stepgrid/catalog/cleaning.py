"""Readers, cleaning, grids, splits, imputation, scaling and writers."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from stepgrid.catalog.base import DAY, KEYS, POS, READINGS, SHARD, SHARDED, SPEC, query, r6, raw_events, readings, rounded, shard_name, slot, table
from stepgrid.functions import text
from stepgrid.operators import clean, impute, scale
from stepgrid.series import SeriesSpec, with_position
from stepgrid.session import fresh_path, settle
from stepgrid.sources import readings as src
from stepgrid.sources import results, series

SHIP = SeriesSpec(keys=("item",), step=DAY)


def daily(spark, sf):
    """Daily shipped quantity per supplier: long regular-ish series."""
    line = table(spark, sf, "lineitem")
    return line.groupBy(
        F.col("l_suppkey").cast("string").alias("item"), F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("ts")
    ).agg(F.sum("l_quantity").alias("value"))


DAILY = """daily AS (
  SELECT CAST(l_suppkey AS VARCHAR) AS item, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS slot, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2)"""

# every slot between first and last reading; absent ones null
GRID = f"""{DAILY}, ends AS (SELECT item, min(slot) AS lo, max(slot) AS hi FROM daily GROUP BY item),
slots AS (SELECT item, unnest(range(lo, hi + 1)) AS slot FROM ends),
grid AS (SELECT s.item, s.slot, d.value FROM slots s LEFT JOIN daily d ON s.item = d.item AND s.slot = d.slot)"""

# the same over event readings: small series with gaps
EGRID = f"""{READINGS}, ends AS (SELECT dataset, subject_id, min(slot) AS lo, max(slot) AS hi FROM readings GROUP BY 1, 2),
slots AS (SELECT dataset, subject_id, unnest(range(lo, hi + 1)) AS slot FROM ends),
grid AS (SELECT s.dataset, s.subject_id, s.slot, r.value,
    row_number() OVER (PARTITION BY s.dataset, s.subject_id ORDER BY s.slot) - 1 AS pos
  FROM slots s LEFT JOIN readings r ON s.dataset = r.dataset AND s.subject_id = r.subject_id AND s.slot = r.slot)"""


def grid(spark, sf):
    return clean.regularize(readings(spark, sf), SPEC)


def nested(spark, sf):
    return (
        raw_events(spark, sf)
        .groupBy(*KEYS, F.floor(F.col("event_id") / 10_000).alias("part"))  # bounded rows
        .agg(F.array_sort(F.collect_list(F.struct(F.unix_micros("ts").alias("t"), F.col("value").alias("v")))).alias("r"))
        .select(*KEYS, F.transform("r.t", lambda t: (t / 1_000_000).cast("bigint")).alias("timestamp"), F.col("r.v").alias("BGvalue"))
    )


@query(
    "read_nested_subjects",
    """WITH e AS (SELECT 'g' || CAST(user_id % 3 AS VARCHAR) AS dataset, CAST(user_id AS VARCHAR) AS subject_id,
      CAST(floor(epoch(ts)) AS BIGINT) AS sec, value FROM events WHERE user_id % 3 <> 2)
    SELECT dataset, subject_id, sec, min(value) AS value FROM e GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    out = src.read_nested_subjects(nested(spark, sf), datasets=["g0", "g1"])
    return out.select(*KEYS, F.unix_seconds("ts").alias("sec"), "value")


@query(
    "distinct_datasets",
    "SELECT DISTINCT 'g' || CAST(user_id % 3 AS VARCHAR) AS dataset FROM events ORDER BY 1",
)
def _(spark, sf):
    return raw_events(spark, sf).select("dataset").distinct().orderBy("dataset")


@query("subject_csv_round_trip", f"WITH {READINGS} SELECT dataset, subject_id, slot, value FROM readings")
def _(spark, sf):
    path = fresh_path(spark, "subject-csv")
    results.write_subject_csvs(readings(spark, sf), SPEC, path)
    back = src.read_subject_csvs(spark, path, r"dataset=([^/]+)/subject_id=([^/]+)/[^/]*\.csv$")
    return back.select(*KEYS, slot().alias("slot"), "value")


@query(
    "dataset_paths",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS dataset
    FROM documents WHERE doc_id % 5 <> 0""",
)
def _(spark, sf):
    docs = table(spark, sf, "documents")
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".csv"))
    path = (
        F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("/data/mixed/"), name))
        .when(F.col("doc_id") % 3 == 0, F.concat_ws("/", F.lit("/data/controlled_dataset"), "source", name))
        .otherwise(F.concat_ws("/", F.lit("/data"), "lang", name))
    )
    rows = src.skip_mixed(docs.withColumn("path", path), "path", only_if_others=True)
    return rows.select("doc_id", src.dataset_from_path(F.col("path")).alias("dataset"))


@query(
    "vendor_csv_columns",
    """SELECT subject, count(*) AS n, round(sum(v), 6) AS total FROM (
      SELECT CAST(user_id % 10 AS VARCHAR) AS subject, floor(epoch(ts)) AS s, min(value) AS v FROM events GROUP BY 1, 2)
    GROUP BY 1""",
)
def _(spark, sf):
    path = fresh_path(spark, "vendor-csv")
    table(spark, sf, "events").select(
        (F.col("user_id") % 10).alias("subject"),
        F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("LBDTC"),
        F.col("value").alias("LBORRES"),
    ).write.partitionBy("subject").option("header", True).csv(path)
    back = src.read_subject_csvs(spark, path, r"/([^/]+)/subject=([^/]+)/[^/]*\.csv$", ("LBDTC", "LBORRES"))
    return rounded(back.groupBy(F.col("subject_id").alias("subject")).agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query(
    "read_event_xml",
    """SELECT CAST(epoch(date_trunc('minute', ts)) AS BIGINT) AS sec, count(*) AS n, round(sum(value), 6) AS total
    FROM events GROUP BY 1""",
)
def _(spark, sf):
    path = fresh_path(spark, "event-xml")
    at = F.date_format(F.col("ts").cast("timestamp"), "dd-MM-yyyy HH:mm:ss")
    events = table(spark, sf, "events").select(
        "user_id", F.floor(F.col("event_id") / 10_000).alias("part"), F.struct(at.alias("_ts"), F.col("value").alias("_value")).alias("e")
    )
    doc = events.groupBy("user_id", "part").agg(F.struct(F.collect_list("e").alias("event")).alias("glucose_level"))
    doc.select("glucose_level").write.format("xml").option("rootTag", "patients").option("rowTag", "patient").save(path)
    back = src.read_event_xml(spark, path)
    return rounded(back.groupBy(F.unix_seconds("ts").alias("sec")).agg(F.count("*").alias("n"), F.sum("value").alias("total")))


@query(
    "read_tsf",
    f"""WITH {EGRID} SELECT dataset || '__' || subject_id || '__' || CAST(slot // 4096 AS VARCHAR) AS series_name, min(slot) AS first_slot, count(*) AS n,
      count(value) AS observed, round(sum(value), 6) AS total FROM grid GROUP BY 1""",
)
def _(spark, sf):
    path = fresh_path(spark, "tsf")
    block = F.floor(slot() / 4096).cast("string").alias("block")
    rows = grid(spark, sf).groupBy(*KEYS, block).agg(
        F.array_sort(F.collect_list(F.struct("ts", "value"))).alias("r")
    )
    values = F.array_join(F.transform("r.value", lambda v: F.coalesce(v.cast("string"), F.lit("?"))), ",")
    start = F.date_format(F.element_at("r", 1)["ts"], "yyyy-MM-dd HH-mm-ss")
    body = rows.select(F.concat_ws(":", F.concat_ws("__", *KEYS, "block"), start, values).alias("value"))
    head = "@relation readings\n@attribute series_name string\n@attribute start_timestamp date\n@frequency daily\n@horizon 2\n@missing true\n@equallength false\n@data"
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(path)
    body.write.mode("append").text(path)
    back, _facts = src.read_tsf(spark, path)
    return rounded(
        back.select(
            "series_name",
            slot("start_timestamp").alias("first_slot"),
            F.size("series_value").cast("bigint").alias("n"),
            F.size(F.filter("series_value", lambda v: v.isNotNull())).cast("bigint").alias("observed"),
            F.aggregate("series_value", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))).alias("total"),
        )
    )


@query(
    "build_series",
    f"""WITH {SHARDED} SELECT dataset || '__' || subject_id AS item_id, 'D' AS freq, min(slot) AS start_slot, count(*) AS n,
      round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 6) AS total, round(CAST(CAST(arg_max(value, slot) AS FLOAT) AS DOUBLE), 6) AS last_value
    FROM sharded GROUP BY dataset, subject_id""",
)
def _(spark, sf):
    return _series_facts(series.build_series(readings(spark, sf), SPEC, "D", ["value"], shard_rows=SHARD))


def _series_facts(df):
    x = F.col("target").cast("array<double>")
    return rounded(
        df.select(
            shard_name(F.col("item_id"), F.col("shard")).alias("item_id"),
            "freq",
            slot("start").alias("start_slot"),
            F.size("target").cast("bigint").alias("n"),
            F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))).alias("total"),
            F.element_at(x, -1).alias("last_value"),
        )
    )


@query(
    "series_cut_by_offset",
    f"""WITH {POS}, n AS (SELECT *, count(*) OVER (PARTITION BY dataset, subject_id) AS n FROM pos)
    SELECT dataset, subject_id, slot, value FROM n WHERE pos < n - 3""",
)
def _(spark, sf):
    return series.cut_rows(readings(spark, sf), SPEC, offset=-3).select(*KEYS, slot().alias("slot"), "value")


@query(
    "wide_to_long",
    """SELECT o_orderdate, item_id, value FROM (
      SELECT CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS o_orderdate, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS F,
        sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS O, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS P
      FROM orders GROUP BY 1) UNPIVOT INCLUDE NULLS (value FOR item_id IN (F, O, P))""".replace("item_id, value FROM", "item_id, round(value, 2) AS value FROM"),
)
def _(spark, sf):
    wide = table(spark, sf, "orders").groupBy(slot("o_orderdate").alias("o_orderdate")).agg(
        *[F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))).alias(s) for s in ("F", "O", "P")]
    )
    out = series.wide_to_long(wide, "o_orderdate")
    return out.withColumn("value", F.round("value", 2))


@query(
    "corpus_series",
    f"""WITH {GRID} SELECT item AS item_id, 'D' AS freq, min(slot) AS start_slot, count(*) AS n, round(sum(value), 6) AS total,
      arg_max(value, slot) AS last_value FROM grid GROUP BY item HAVING count(*) >= 30 AND avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) <= 0.95""",
)
def _(spark, sf):
    return _series_facts(series.corpus_series(daily(spark, sf), SHIP, "D", 30, 0.95))


@query(
    "series_with_covariates",
    f"""WITH r AS (SELECT 'g' || CAST(user_id % 3 AS VARCHAR) AS dataset, CAST(user_id AS VARCHAR) AS subject_id,
        CAST(floor(epoch(ts) / 86400) AS BIGINT) AS slot, max(value) AS value, min(value) AS low, count(*) AS taps FROM events GROUP BY 1, 2, 3)
    SELECT dataset || '__' || subject_id AS item_id, count(*) AS n, round(sum(CAST(CAST(low AS FLOAT) AS DOUBLE)), 6) AS sum_low,
      CAST(sum(taps) AS DOUBLE) AS sum_taps FROM r GROUP BY dataset, subject_id""",
)
def _(spark, sf):
    day = F.timestamp_seconds(slot() * 86400)
    rows = raw_events(spark, sf).groupBy(*KEYS, day.alias("ts")).agg(
        F.max("value").alias("value"), F.min("value").alias("low"), F.count("*").alias("taps")
    )
    out = series.build_series(rows, SPEC, "D", ["value"], ["low", "taps"])

    def total(i):
        x = F.element_at("past_feat_dynamic_real", i).cast("array<double>")
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)

    return rounded(
        out.select("item_id", F.size("target").cast("bigint").alias("n"), total(1).alias("sum_low"), total(2).alias("sum_taps"))
    )


@query(
    "dynamic_features_by_time",
    f"""WITH {READINGS}, f AS (SELECT CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) + 8700 AS slot, count(*) AS orders FROM orders GROUP BY 1)
    SELECT r.dataset, r.subject_id, r.slot, r.value, f.orders FROM readings r LEFT JOIN f USING (slot)""",
)
def _(spark, sf):
    feats = table(spark, sf, "orders").groupBy((slot("o_orderdate") + 8700).alias("slot")).agg(F.count("*").alias("orders"))
    rows = readings(spark, sf).withColumn("slot", slot()).drop("ts")
    return series.with_dynamic_features(rows, feats, ["slot"]).select(*KEYS, "slot", "value", "orders")


@query(
    "align_measures",
    """WITH o AS (SELECT o_custkey AS cell, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS slot, max(o_totalprice) AS price FROM orders GROUP BY 1, 2),
    n AS (SELECT o_custkey AS cell, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) AS slot, count(*) AS orders FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2)
    SELECT cell, slot, price, orders FROM o JOIN n USING (cell, slot)""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumn("slot", slot("o_orderdate")).withColumnRenamed("o_custkey", "cell")
    price = orders.groupBy("cell", "slot").agg(F.max("o_totalprice").alias("price"))
    count = orders.filter("o_orderstatus <> 'P'").groupBy("cell", "slot").agg(F.count("*").alias("orders"))
    return series.align_measures([price, count], ["cell", "slot"])


@query(
    "cell_series",
    f"""WITH c AS (SELECT user_id, floor(epoch(ts) / 86400) AS slot,
        max(CASE WHEN event_type = 'click' THEN value END) AS a, max(CASE WHEN event_type = 'view' THEN value END) AS b FROM events GROUP BY 1, 2)
    SELECT CAST(user_id AS VARCHAR) AS item_id, CAST(count(*) AS BIGINT) AS n, round(coalesce(sum(CAST(CAST(a AS FLOAT) AS DOUBLE)), 0), 6) AS sum_click,
      round(coalesce(sum(CAST(CAST(b AS FLOAT) AS DOUBLE)), 0), 6) AS sum_view FROM c GROUP BY 1""",
)
def _(spark, sf):
    rows = raw_events(spark, sf).withColumn("ts", F.timestamp_seconds(slot() * 86400))
    spec = SPEC.with_(keys=("subject_id",))
    out = series.cell_series(rows, spec, "D", ["click", "view"], "event_type", "value")

    def total(i):
        x = F.element_at("target", i).cast("array<double>")
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))

    return rounded(
        out.select("item_id", F.size(F.element_at("target", 1)).cast("bigint").alias("n"), total(1).alias("sum_click"), total(2).alias("sum_view"))
    )


@query(
    "flatten_variates",
    """WITH c AS (SELECT user_id, floor(epoch(ts) / 86400) AS slot,
        max(CASE WHEN event_type = 'click' THEN value END) AS a, max(CASE WHEN event_type = 'view' THEN value END) AS b FROM events GROUP BY 1, 2)
    SELECT CAST(user_id AS VARCHAR) AS item_id, CAST(0 AS INTEGER) AS variate, count(a) AS observed FROM c GROUP BY 1
    UNION ALL SELECT CAST(user_id AS VARCHAR), CAST(1 AS INTEGER), count(b) FROM c GROUP BY 1""",
)
def _(spark, sf):
    rows = raw_events(spark, sf).withColumn("ts", F.timestamp_seconds(slot() * 86400))
    out = series.cell_series(rows, SPEC.with_(keys=("subject_id",)), "D", ["click", "view"], "event_type", "value")
    flat = series.flatten_variates(out, "target")
    return flat.select("item_id", F.col("variate"), F.size(F.filter("target", lambda v: v.isNotNull())).cast("bigint").alias("observed"))


@query(
    "read_partitioned_parquet",
    """SELECT region, item_id, count(*) AS n, round(sum(value), 2) AS total FROM (
      SELECT CAST(c_nationkey % 5 AS INTEGER) AS region, 'c_acctbal' AS item_id, c_acctbal AS value FROM customer
      UNION ALL SELECT CAST(c_nationkey % 5 AS INTEGER), 'twice', c_acctbal * 2 FROM customer) GROUP BY 1, 2""",
)
def _(spark, sf):
    path = fresh_path(spark, "hive-parquet")
    cust = table(spark, sf, "customer").select(
        (F.col("c_nationkey") % 5).alias("region"), F.col("c_custkey").alias("ts"), "c_acctbal", (F.col("c_acctbal") * 2).alias("twice")
    )
    cust.write.partitionBy("region").parquet(path)
    long = series.read_partitioned(spark, path, "ts")
    return long.groupBy("region", "item_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("build_mixed", f"WITH {READINGS} SELECT 'mixed' AS dataset, dataset || '__' || subject_id AS subject_id, slot, value FROM readings")
def _(spark, sf):
    return results.build_mixed(readings(spark, sf)).select(*KEYS, slot().alias("slot"), "value")


@query(
    "parse_timestamps",
    "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS sec FROM events",
)
def _(spark, sf):
    us = F.unix_micros("ts")
    kind = F.col("event_id") % 4
    raw = (
        F.when(kind == 0, (us / 1_000_000).cast("bigint").cast("string"))
        .when(kind == 1, F.floor(us / 1000).cast("bigint").cast("string"))
        .when(kind == 2, (us * 1000).cast("string"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    )
    rows = raw_events(spark, sf).select("event_id", kind.alias("source"), raw.alias("raw"))
    out = clean.parse_timestamps(rows, "raw", ["source"])
    return out.select("event_id", F.unix_seconds("ts").alias("sec"))


@query(
    "parse_timestamps_micros",
    "SELECT event_id, CAST(epoch_us(ts) AS BIGINT) AS us FROM events",
)
def _(spark, sf):
    rows = raw_events(spark, sf).select("event_id", F.lit(1).alias("source"), F.unix_micros("ts").alias("raw"))
    out = clean.parse_timestamps(rows, "raw", ["source"], thresholds=clean.EPOCH_S_MS_US)
    return out.select("event_id", F.unix_micros("ts").alias("us"))


@query(
    "parse_date_formats",
    "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS sec FROM events",
)
def _(spark, sf):
    kind = F.col("event_id") % 3
    raw = F.when(kind == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(kind == 1, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).otherwise("bad")
    parsed = clean.parse_date_formats(F.col("raw"), ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss"])
    return raw_events(spark, sf).withColumn("raw", raw).select("event_id", F.unix_seconds(parsed).alias("sec"))


@query(
    "clean_readings",
    """SELECT dataset, subject_id, sec, value FROM (
      SELECT 'g' || CAST(user_id % 3 AS VARCHAR) AS dataset, CAST(user_id AS VARCHAR) AS subject_id, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS sec,
        arg_min(value, event_id) AS value FROM events WHERE event_id % 7 <> 0 GROUP BY 1, 2, 3)""",
)
def _(spark, sf):
    hour = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 3600) * 3600)
    value = F.when(F.col("event_id") % 7 == 0, "bad").otherwise(F.col("value").cast("string"))
    rows = raw_events(spark, sf).withColumn("ts", hour).withColumn("value", value).select(*KEYS, "ts", "value", "event_id")
    out = clean.clean_readings(rows, SPEC, ["event_id"])
    return out.select(*KEYS, F.floor(F.unix_seconds("ts") / 3600).cast("bigint").alias("sec"), "value")


@query(
    "keep_long_series",
    f"WITH {READINGS} SELECT dataset, subject_id, slot, value FROM readings QUALIFY count(*) OVER (PARTITION BY dataset, subject_id) >= 27",
)
def _(spark, sf):
    return clean.keep_series(readings(spark, sf), KEYS, 27).select(*KEYS, slot().alias("slot"), "value")


@query(
    "drop_sparse_series",
    f"""WITH {EGRID} SELECT dataset, subject_id, slot, value FROM grid
    QUALIFY avg(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY dataset, subject_id) <= 0.1""",
)
def _(spark, sf):
    return clean.keep_series(grid(spark, sf), KEYS, value="value", most=0.1).select(*KEYS, slot().alias("slot"), "value")


@query(
    "drop_zero_series",
    """WITH z AS (SELECT l_suppkey, CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) AS slot, max(l_discount) AS value FROM lineitem GROUP BY 1, 2)
    SELECT l_suppkey, count(*) AS n FROM z GROUP BY 1 HAVING avg(CASE WHEN value = 0 THEN 1 ELSE 0 END) <= 0.08""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey", slot("l_shipdate").alias("slot")).agg(F.max("l_discount").alias("value"))
    return clean.keep_series(rows, ["l_suppkey"], value="value", most=0.08, bad="zero").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("regularize", f"WITH {GRID} SELECT item, slot, value FROM grid")
def _(spark, sf):
    return clean.regularize(daily(spark, sf), SHIP).select("item", slot().alias("slot"), "value")


@query(
    "resample_mean",
    """WITH h AS (SELECT event_type AS item, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, avg(value) AS value FROM events GROUP BY 1, 2),
    e AS (SELECT item, min(hour) AS lo, max(hour) AS hi FROM h GROUP BY 1), s AS (SELECT item, unnest(range(lo, hi + 1)) AS hour FROM e)
    SELECT s.item, s.hour, round(h.value, 6) AS value FROM s LEFT JOIN h ON s.item = h.item AND s.hour = h.hour""",
)
def _(spark, sf):
    rows = raw_events(spark, sf).withColumnRenamed("event_type", "item")
    spec = SeriesSpec(keys=("item",), step=timedelta(hours=1))
    out = clean.resample_mean(rows, spec)
    return out.select("item", F.floor(F.unix_seconds("ts") / 3600).cast("bigint").alias("hour"), r6("value").alias("value"))


@query(
    "block_sum",
    f"""WITH {POS} SELECT dataset, subject_id, CAST(floor(pos / 6) AS BIGINT) AS block, round(sum(value), 6) AS value
    FROM pos GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(clean.block_sum(readings(spark, sf), SPEC, 6).drop("ts"))


@query(
    "keep_preferred_context",
    """SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p FROM orders)
    QUALIFY p = 1 OR NOT bool_or(p = 1) OVER (PARTITION BY o_custkey)""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").withColumn("p", F.substring("o_orderpriority", 1, 1).cast("int"))
    return clean.keep_preferred(rows, ["o_custkey"], "p", 1).select("o_custkey", "o_orderkey", "o_orderpriority")


@query(
    "finite_pairs",
    f"""WITH {POS} SELECT dataset, count(*) AS n, round(sum(nullif(value, 0)), 6) AS total FROM pos
    WHERE prev IS NOT NULL AND pos % 5 <> 0 GROUP BY 1""",
)
def _(spark, sf):
    from stepgrid.functions.metrics import finite_pairs

    rows = with_position(readings(spark, sf), SPEC)
    rows = rows.withColumn("prediction", F.when(F.col("pos") % 5 == 0, float("nan")).otherwise(F.col("value")))
    kept = finite_pairs(rows.withColumn("ground_truth", F.when(F.col("pos") > 0, F.col("value"))))
    return rounded(kept.groupBy("dataset").agg(F.count("*").alias("n"), F.sum("prediction").alias("total")))


@query(
    "default_fields",
    """SELECT event_id, value, CAST(0 AS INTEGER) AS insulin, CAST(0 AS INTEGER) AS carbs FROM events""",
)
def _(spark, sf):
    rows = raw_events(spark, sf).select("event_id", "value")
    return clean.with_defaults(rows, {"insulin": 0, "carbs": 0, "value": -1.0})


@query(
    "cast_covariates",
    """SELECT l_orderkey, l_linenumber, round(CAST(CAST(l_quantity AS FLOAT) AS DOUBLE), 4) AS l_quantity,
      round(CAST(CAST(l_extendedprice AS FLOAT) AS DOUBLE), 4) AS l_extendedprice, l_returnflag,
      round(CAST(CAST(l_quantity > 25 AS INTEGER) AS DOUBLE), 4) AS big FROM lineitem""",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", (F.col("l_quantity") > 25).alias("big")
    )
    out = clean.cast_covariates(rows, ["l_quantity"], ["l_orderkey", "l_linenumber"])
    return out.withColumns({c: F.round(F.col(c).cast("double"), 4) for c in ("l_quantity", "l_extendedprice", "big")})


@query(
    "validate_forecast_frame",
    f"""WITH {POS}, q AS (SELECT dataset, subject_id, count(*) AS n, min(slot - prev) AS lo, max(slot - prev) AS hi FROM pos GROUP BY 1, 2),
    fut AS (SELECT DISTINCT dataset, subject_id, CAST(subject_id AS BIGINT) % 4 AS k FROM readings)
    SELECT dataset, subject_id, CASE WHEN n < 3 THEN 'too few points' ELSE 'irregular' END AS problem FROM q WHERE n < 3 OR lo <> hi
    UNION ALL SELECT dataset, subject_id, CASE WHEN k = 0 THEN 'id without future' ELSE 'wrong future length' END FROM fut WHERE k IN (0, 1)""",
)
def _(spark, sf):
    rows = readings(spark, sf)
    # futures of length 0..2 by subject, where two rows are due
    k = F.col("subject_id").cast("bigint") % 4
    length = F.when(k == 0, 0).when(k == 1, 1).otherwise(2)
    ids = rows.select(*KEYS).distinct().withColumn("_l", length).filter("_l > 0")
    future = ids.select(*KEYS, F.explode(F.sequence(F.lit(1), F.col("_l"))).alias("step"))
    return clean.validate_forecast_frame(rows, SPEC, ["value"], future, 2)


@query(
    "split_by_fraction",
    f"""WITH {POS}, n AS (SELECT *, count(*) OVER (PARTITION BY dataset, subject_id) AS n FROM pos)
    SELECT dataset, subject_id, slot, CASE WHEN pos < ceil(n * 0.7) THEN 'train' WHEN pos < ceil(n * 0.7) + ceil(n * 0.1) THEN 'validation' ELSE 'test' END AS part FROM n""",
)
def _(spark, sf):
    return clean.split_position(readings(spark, sf), SPEC, 0.7, 0.1).select(*KEYS, slot().alias("slot"), "part")


@query(
    "split_fixed_borders",
    f"""WITH {POS} SELECT dataset, subject_id, slot, 'train' AS part FROM pos WHERE pos < 10
    UNION ALL SELECT dataset, subject_id, slot, 'validation' FROM pos WHERE pos >= 12 AND pos < 22
    UNION ALL SELECT dataset, subject_id, slot, 'test' FROM pos WHERE pos >= 18 AND pos < 28""",
)
def _(spark, sf):
    return clean.split_fixed(readings(spark, sf), SPEC, 16, 6, 6, 4, 50).select(*KEYS, slot().alias("slot"), "part")


@query(
    "thin_long_series",
    f"""WITH {POS}, n AS (SELECT *, count(*) OVER (PARTITION BY dataset, subject_id) AS n FROM pos)
    SELECT dataset, subject_id, slot, value FROM n WHERE n <= 26 OR pos % 2 = 0""",
)
def _(spark, sf):
    return clean.thin_long_series(readings(spark, sf), SPEC, 26, 2).select(*KEYS, slot().alias("slot"), "value")


@query(
    "id_differences",
    f"""WITH a AS (SELECT DISTINCT user_id FROM events WHERE value > 150), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
    SELECT CAST(user_id AS VARCHAR) AS subject_id, 'left' AS side FROM a WHERE user_id NOT IN (SELECT user_id FROM b)
    UNION ALL SELECT CAST(user_id AS VARCHAR), 'right' FROM b WHERE user_id NOT IN (SELECT user_id FROM a)""",
)
def _(spark, sf):
    rows = raw_events(spark, sf)
    return clean.id_differences(rows.filter("value > 150"), rows.filter("event_type = 'error'"), ["subject_id"])


@query("impute_constant", f"WITH {EGRID} SELECT dataset, subject_id, slot, coalesce(value, -1) AS imputed FROM grid")
def _(spark, sf):
    return impute.impute_constant(grid(spark, sf), SPEC, -1.0).select(*KEYS, slot().alias("slot"), "imputed")


# readings over a threshold count as missing, so series may start with a gap
HOLES = f"""{EGRID}, holes AS (SELECT dataset, subject_id, slot, pos, CASE WHEN value < 100 THEN value END AS value FROM grid),
filled AS (SELECT *, coalesce(last_value(value IGNORE NULLS) OVER (PARTITION BY dataset, subject_id ORDER BY slot
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS fill FROM holes)"""


def holes(spark, sf):
    return settle(grid(spark, sf), "grid").withColumn("value", F.when(F.col("value") < 100, F.col("value")))


@query("impute_last", f"WITH {HOLES} SELECT dataset, subject_id, slot, fill AS imputed FROM filled")
def _(spark, sf):
    return impute.impute_last(holes(spark, sf), SPEC).select(*KEYS, slot().alias("slot"), "imputed")


@query(
    "impute_causal_mean",
    f"""WITH {HOLES} SELECT dataset, subject_id, slot, round(CASE WHEN value IS NULL AND pos > 0 THEN avg(fill) OVER (
      PARTITION BY dataset, subject_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE fill END, 6) AS imputed FROM filled""",
)
def _(spark, sf):
    return impute.impute_causal_mean(holes(spark, sf), SPEC).select(*KEYS, slot().alias("slot"), r6("imputed").alias("imputed"))


@query(
    "impute_linear",
    f"""WITH {HOLES}, p AS (SELECT *,
      last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp, last_value(value IGNORE NULLS) OVER b AS pv,
      first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS np, first_value(value IGNORE NULLS) OVER a AS nv FROM holes
      WINDOW b AS (PARTITION BY dataset, subject_id ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        a AS (PARTITION BY dataset, subject_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT dataset, subject_id, slot, round(CASE WHEN value IS NOT NULL THEN value WHEN nv IS NULL THEN pv
      ELSE pv + (pos - pp) * (nv - pv) / (np - pp) END, 6) AS imputed FROM p WHERE pv IS NOT NULL""",
)
def _(spark, sf):
    return impute.impute_linear(holes(spark, sf), SPEC).select(*KEYS, slot().alias("slot"), r6("imputed").alias("imputed"))


@query(
    "zero_pad_series",
    f"""WITH {READINGS}, n AS (SELECT dataset, subject_id, count(*) AS n, min(slot) AS lo FROM readings GROUP BY 1, 2)
    SELECT dataset, subject_id, slot, value FROM readings
    UNION ALL SELECT dataset, subject_id, lo - k AS slot, 0.0 FROM (SELECT *, unnest(range(1, 28 - n + 1)) AS k FROM n WHERE n < 28)""",
)
def _(spark, sf):
    return impute.zero_pad_series(readings(spark, sf), SPEC, 28).select(*KEYS, slot().alias("slot"), "value")


@query(
    "scale_standard",
    f"""WITH {READINGS} SELECT dataset, subject_id, slot, round((value - (SELECT avg(value) FROM readings)) /
      (SELECT sqrt(greatest(var_pop(value), 1e-12)) FROM readings), 6) AS scaled FROM readings""",
)
def _(spark, sf):
    return scale.scale_standard(readings(spark, sf), "value").select(*KEYS, slot().alias("slot"), r6("scaled").alias("scaled"))


@query(
    "scale_on_train_part",
    f"""WITH {POS} SELECT dataset, subject_id, slot, round((value - avg(value) FILTER (pos < 15) OVER w) / stddev_pop(value) FILTER (pos < 15) OVER w, 6) AS scaled
    FROM pos WINDOW w AS (PARTITION BY dataset, subject_id)""",
)
def _(spark, sf):
    rows = with_position(readings(spark, sf), SPEC)
    out = scale.scale_on_part(rows, KEYS, "value", F.col("pos") < 15)
    return out.select(*KEYS, slot().alias("slot"), r6("scaled").alias("scaled"))


@query(
    "normalize_per_series",
    f"""WITH {READINGS} SELECT dataset, subject_id, slot, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS scaled, value AS restored
    FROM readings WINDOW w AS (PARTITION BY dataset, subject_id)""",
)
def _(spark, sf):
    out = scale.renormalize(scale.normalize_per_series(readings(spark, sf), KEYS, "value"), "scaled", "restored")
    return out.select(*KEYS, slot().alias("slot"), r6("scaled").alias("scaled"), r6("restored").alias("restored"))


NORMALIZERS = {
    "normalizer_standard": ("standardization", "(value - avg(value) OVER ()) / (stddev_samp(value) OVER () + 2.220446049250313e-16)"),
    "normalizer_minmax": ("minmax", "(value - min(value) OVER ()) / (max(value) OVER () - min(value) OVER () + 2.220446049250313e-16)"),
    "normalizer_sample_std": ("per_sample_std", "(value - avg(value) OVER w) / (stddev_samp(value) OVER w + 2.220446049250313e-16)"),
    "normalizer_sample_minmax": ("per_sample_minmax", "(value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 2.220446049250313e-16)"),
}
for _name, (_kind, _expr) in NORMALIZERS.items():

    @query(_name, f"WITH {READINGS} SELECT dataset, subject_id, slot, round({_expr}, 6) AS scaled FROM readings WINDOW w AS (PARTITION BY dataset, subject_id)")
    def _(spark, sf, kind=_kind):
        out = scale.normalizer(readings(spark, sf), "value", kind, KEYS)
        return out.select(*KEYS, slot().alias("slot"), r6("scaled").alias("scaled"))


for _kind, _loc, _scale in (
    ("std", "avg(v)", "sqrt(var_samp(v) + 1e-5)"),
    ("absmean", "0", "avg(abs(v))"),
    ("none", "0", "1"),
):

    @query(
        f"masked_scaler_{_kind}",
        f"""WITH {READINGS}, m AS (SELECT dataset, subject_id, CASE WHEN value < 100 THEN value END AS v FROM readings)
        SELECT dataset, subject_id, count(*) AS length, round(CAST({_loc} AS DOUBLE), 6) AS loc, round(CAST({_scale} AS DOUBLE), 6) AS scale FROM m GROUP BY 1, 2""",
    )
    def _(spark, sf, kind=_kind):
        return rounded(scale.masked_scaler(readings(spark, sf), KEYS, "value", F.col("value") < 100, kind))


@query(
    "one_hot",
    """SELECT event_id, CAST(event_type = 'click' AS INTEGER)::DOUBLE AS event_type_click, CAST(event_type = 'view' AS INTEGER)::DOUBLE AS event_type_view FROM events""",
)
def _(spark, sf):
    out = scale.one_hot(raw_events(spark, sf).select("event_id", "event_type"), "event_type", ["add", "click", "view"])
    return out.drop("event_type")


@query("category_index", "SELECT event_id, event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM events")
def _(spark, sf):
    out = scale.category_index(raw_events(spark, sf).select("event_id", "event_type"), "event_type", "code")
    return out.withColumn("code", F.col("code").cast("bigint"))


@query(
    "target_encode",
    """WITH c AS (SELECT user_id, event_type, sum(value) AS s, count(*) AS n FROM events GROUP BY 1, 2),
    m AS (SELECT user_id, sum(s) / sum(n) AS m FROM c GROUP BY 1)
    SELECT CAST(user_id AS VARCHAR) AS subject_id, event_type, round((s + m) / (n + 1), 6) AS encoded FROM c JOIN m USING (user_id)""",
)
def _(spark, sf):
    out = scale.target_encode(raw_events(spark, sf), ["subject_id"], "event_type", "value")
    return rounded(out.select("subject_id", "event_type", "encoded").distinct())


@query(
    "union_sources",
    """SELECT 'customer' AS source, c_custkey AS id, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT 'supplier', s_suppkey, s_acctbal, NULL FROM supplier""",
)
def _(spark, sf):
    a = table(spark, sf, "customer").select(
        F.lit("customer").alias("source"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    b = table(spark, sf, "supplier").select(F.lit("supplier").alias("source"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query(
    "distinct_keep_last",
    "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return results.newest_by_key(rows, ["o_custkey"], "o_orderkey")


@query(
    "upsert_results",
    """WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS participant_id, CAST(o_orderkey % 4 AS INTEGER) AS context_hours, o_orderkey AS run, o_totalprice AS rmse,
      CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS note FROM orders)
    SELECT participant_id, context_hours, max(run) AS run, arg_max(rmse, run) AS rmse, CASE WHEN max(run) % 2 = 0 THEN arg_max(note, run) END AS note FROM r GROUP BY 1, 2""",
)
def _(spark, sf):
    base = fresh_path(spark, "results")
    rows = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("participant_id"),
        (F.col("o_orderkey") % 4).cast("int").alias("context_hours"),
        F.col("o_orderkey").alias("run"),
        F.col("o_totalprice").alias("rmse"),
        F.col("o_orderpriority").alias("note"),
    )
    keys = ["participant_id", "context_hours"]
    first = rows.filter("run % 2 = 1").drop("note")
    results.upsert_results(spark, base, 0, first, keys, "run")
    return results.upsert_results(spark, base, 1, rows.filter("run % 2 = 0"), keys, "run", ["participant_id", "context_hours", "rmse"])


@query(
    "completed_keys",
    """SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS participant_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS context_hours
    FROM orders WHERE o_orderstatus <> 'P'""",
)
def _(spark, sf):
    stored = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("participant_id"), F.substring("o_orderpriority", 1, 1).alias("context_hours")
    )
    return results.completed_keys(stored, ["participant_id", "context_hours"], stored)


@query(
    "skip_completed",
    """SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def _(spark, sf):
    done = table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return results.skip_completed(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), done, ["c_custkey"])


@query(
    "read_result_files",
    """SELECT CASE WHEN o_orderstatus = 'F' THEN 'fullshot' ELSE 'zeroshot' END AS protocol, lower(o_orderstatus) AS method, count(*) AS n,
      round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2""",
)
def _(spark, sf):
    base = fresh_path(spark, "families")
    orders = table(spark, sf, "orders")
    for status, protocol in (("F", "fullshot"), ("O", "zeroshot"), ("P", "zeroshot")):
        part = orders.filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_totalprice")
        part.write.option("header", True).csv(f"{base}/{protocol}/{status.lower()}")
    back = results.read_result_files(spark, [base], r"/(fullshot|zeroshot)/([^/]+)/[^/]*$")
    return back.groupBy("protocol", "method").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"))


@query(
    "read_participants",
    "SELECT n_name AS dataset, CAST(c_custkey AS VARCHAR) AS patient FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def _(spark, sf):
    path = fresh_path(spark, "participants")
    pairs = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    part = F.floor(F.col("c_custkey") / 10_000).alias("part")
    lists = pairs.groupBy("n_name", part).agg(F.collect_list(F.col("c_custkey").cast("string")).alias("ids"))
    lists.select(F.to_json(F.create_map("n_name", "ids")).alias("value")).write.text(path)
    return src.read_participants(spark, path, multiline=False)


@query(
    "join_phase_tables",
    """WITH a AS (SELECT l_suppkey AS s, l_partkey AS p, l_returnflag AS f, sum(l_quantity) AS phase_0 FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-06-01' GROUP BY 1, 2, 3),
    b AS (SELECT l_suppkey AS s, l_partkey AS p, l_returnflag AS f, sum(l_quantity) AS phase_1 FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-06-01' GROUP BY 1, 2, 3)
    SELECT s, p, f, phase_0, phase_1 FROM a JOIN b USING (s, p, f)""",
)
def _(spark, sf):
    line = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.col("l_returnflag").alias("f"), "l_quantity", F.col("l_shipdate").cast("timestamp").alias("at")
    )
    early = F.col("at") < F.lit("1998-06-01").cast("timestamp")
    first = line.filter(early).groupBy("s", "p", "f").agg(F.sum("l_quantity").alias("phase_0"))
    second = line.filter(~early).groupBy("s", "p", "f").agg(F.sum("l_quantity").alias("phase_1"))
    return series.align_measures([first, second], ["s", "p", "f"])
