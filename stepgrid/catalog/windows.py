"""Runs, segments, windows and the persistence flow."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from stepgrid.catalog.base import DAY, KEYS, PAIRS, POS, READINGS, SERIES, SPEC, query, r6, raw_events, readings, rounded, slot, table
from stepgrid.operators import gaps, windows
from stepgrid.plans import evaluation
from stepgrid.series import SeriesSpec, with_position

LIMIT = timedelta(days=2)
CTX, HOR, LEN = 4, 2, 6


def _series(spark, sf):
    """Readings in single precision, as series are stored."""
    return readings(spark, sf).withColumn("value", F.col("value").cast("float").cast("double"))


def _item():
    return F.concat_ws("__", *KEYS).alias("item_id")


@query(
    "persistence_summary",
    f"""WITH {READINGS}, runs AS (
      SELECT *, slot - row_number() OVER (PARTITION BY dataset, subject_id ORDER BY slot) AS run FROM readings),
    pairs AS (
      SELECT a.dataset, a.subject_id, a.value AS p, b.value AS t FROM runs a JOIN runs b
        ON a.dataset = b.dataset AND a.subject_id = b.subject_id AND a.run = b.run AND b.slot = a.slot + 2),
    each AS (
      SELECT dataset, subject_id, count(*) AS n_windows, sqrt(avg((p - t) * (p - t))) AS rmse, avg(abs(p - t)) AS mae
      FROM pairs GROUP BY 1, 2)
    SELECT dataset, subject_id, n_windows, round(rmse, 6) AS rmse, round(mae, 6) AS mae FROM each
    UNION ALL
    SELECT dataset, 'ALL_PATIENTS', CAST(sum(n_windows) AS BIGINT),
           round(sqrt(sum(n_windows * rmse * rmse) / sum(n_windows)), 6), round(sum(n_windows * mae) / sum(n_windows), 6)
    FROM each GROUP BY dataset""",
)
def _(spark, sf):
    return rounded(evaluation.persistence_summary(readings(spark, sf), SPEC, 2))


@query(
    "persistence_pairs",
    f"""WITH {POS} SELECT a.dataset, a.subject_id, b.slot, a.value AS prediction, b.value AS ground_truth
    FROM pos a JOIN pos b ON a.dataset = b.dataset AND a.subject_id = b.subject_id
      AND b.slot = a.slot + 3 AND b.pos = a.pos + 3""",
)
def _(spark, sf):
    out = windows.persistence_pairs(readings(spark, sf), SPEC, 3)
    return out.select(*KEYS, slot().alias("slot"), "prediction", "ground_truth")


@query(
    "contiguous_runs",
    f"""WITH {POS} SELECT dataset, subject_id, slot,
      min(CASE WHEN nxt IS NULL OR nxt - slot <> 1 THEN pos END) OVER (
        PARTITION BY dataset, subject_id ORDER BY slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - pos AS run
    FROM pos""",
)
def _(spark, sf):
    return gaps.contiguous_runs(readings(spark, sf), SPEC).select(*KEYS, slot().alias("slot"), "run")


SEG = f"""{POS}, seg0 AS (
  SELECT *, CAST(sum(CASE WHEN slot - prev > 2 THEN 1 ELSE 0 END) OVER (
    PARTITION BY dataset, subject_id ORDER BY slot) AS BIGINT) AS segment_id FROM pos),
seg AS (SELECT *, row_number() OVER (PARTITION BY dataset, subject_id, segment_id ORDER BY slot) - 1 AS seg_pos,
  count(*) OVER (PARTITION BY dataset, subject_id, segment_id) AS seg_n FROM seg0)"""


@query("segment_by_gap", f"WITH {SEG} SELECT dataset, subject_id, slot, segment_id, seg_pos FROM seg")
def _(spark, sf):
    out = gaps.segment_by_gap(readings(spark, sf), SPEC, LIMIT)
    return out.select(*KEYS, slot().alias("slot"), "segment_id", "seg_pos")


@query(
    "segment_exact_step",
    f"""WITH {POS} SELECT dataset, subject_id, slot, CAST(sum(CASE WHEN slot - prev <> 1 THEN 1 ELSE 0 END) OVER (
      PARTITION BY dataset, subject_id ORDER BY slot) AS BIGINT) AS segment_id FROM pos""",
)
def _(spark, sf):
    out = gaps.segment_by_gap(readings(spark, sf), SPEC, None)
    return out.select(*KEYS, slot().alias("slot"), "segment_id")


def _wide(df, extra=()):
    return df.select(
        *KEYS,
        "window_start",
        *extra,
        slot("start_ts").alias("start_slot"),
        *[F.element_at("context", i + 1).alias(f"x{i}") for i in range(CTX)],
        *[F.element_at("target", i + 1).alias(f"y{i}") for i in range(HOR)],
    )


LEADS = ", ".join([f"lead(value, {i}) OVER w AS {'x' if i < CTX else 'y'}{i if i < CTX else i - CTX}" for i in range(LEN)])
COLS = "x0, x1, x2, x3, y0, y1"


@query(
    "windows_contiguous",
    f"""WITH {POS}, l AS (SELECT dataset, subject_id, slot, pos, {LEADS}, lead(slot, 5) OVER w AS last
      FROM pos WINDOW w AS (PARTITION BY dataset, subject_id ORDER BY slot))
    SELECT dataset, subject_id, pos AS window_start, slot AS start_slot, {COLS} FROM l
    WHERE last = slot + 5 AND pos % 2 = 0""",
)
def _(spark, sf):
    return _wide(windows.windows_contiguous(readings(spark, sf), SPEC, CTX, HOR, 2))


SEGWIN = f"""{SEG}, l AS (SELECT dataset, subject_id, slot, pos, segment_id, seg_pos, seg_n, {LEADS}
  FROM seg WINDOW w AS (PARTITION BY dataset, subject_id, segment_id ORDER BY slot))"""


@query(
    "windows_segmented",
    f"""WITH {SEGWIN} SELECT dataset, subject_id, pos AS window_start, segment_id, slot AS start_slot, {COLS}
    FROM l WHERE seg_pos + 6 <= seg_n AND seg_pos % 3 = 0""",
)
def _(spark, sf):
    return _wide(windows.windows_segmented(readings(spark, sf), SPEC, CTX, HOR, 3, LIMIT), ["segment_id"])


@query(
    "supervised_pairs",
    f"""WITH {SEGWIN} SELECT dataset, subject_id, pos AS window_start, x0, x3, y1 AS y
    FROM l WHERE seg_pos + 6 <= seg_n""",
)
def _(spark, sf):
    out = windows.supervised_pairs(readings(spark, sf), SPEC, CTX, HOR, 1, LIMIT)
    return out.select(*KEYS, "window_start", F.element_at("context", 1).alias("x0"), F.element_at("context", 4).alias("x3"), "y")


@query(
    "supervised_all_future",
    f"""WITH {SEGWIN} SELECT dataset, subject_id, segment_id, count(*) AS n, round(sum(x0 + x1 + x2 + x3), 6) AS sum_x,
      round(sum(y0), 6) AS sum_y0, round(sum(y1), 6) AS sum_y1
    FROM l WHERE seg_pos + 6 <= seg_n GROUP BY ALL""",
)
def _(spark, sf):
    out = windows.windows_segmented(readings(spark, sf), SPEC, CTX, HOR, 1, LIMIT)
    x = F.aggregate("context", F.lit(0.0), lambda a, v: a + v)
    return rounded(
        out.groupBy(*KEYS, "segment_id").agg(
            F.count("*").alias("n"),
            F.sum(x).alias("sum_x"),
            F.sum(F.element_at("target", 1)).alias("sum_y0"),
            F.sum(F.element_at("target", 2)).alias("sum_y1"),
        )
    )


@query(
    "covariate_windows",
    f"""WITH rd AS (
      SELECT 'g' || CAST(user_id % 3 AS VARCHAR) AS dataset, CAST(user_id AS VARCHAR) AS subject_id,
        CAST(floor(epoch(ts) / 86400) AS BIGINT) AS slot, max(value) AS value, CAST(count(*) AS DOUBLE) AS taps,
        min(value) AS low FROM events GROUP BY 1, 2, 3),
    p AS (SELECT *, row_number() OVER w - 1 AS pos, lag(slot) OVER w AS prev FROM rd
      WINDOW w AS (PARTITION BY dataset, subject_id ORDER BY slot)),
    s AS (SELECT *, sum(CASE WHEN slot - prev > 2 THEN 1 ELSE 0 END) OVER (
      PARTITION BY dataset, subject_id ORDER BY slot) AS sg FROM p),
    l AS (SELECT dataset, subject_id, pos AS window_start, row_number() OVER w - 1 AS sp,
        count(*) OVER (PARTITION BY dataset, subject_id, sg) AS sn,
        value + lead(value) OVER w + lead(value, 2) OVER w + lead(value, 3) OVER w AS sum_value,
        taps + lead(taps) OVER w + lead(taps, 2) OVER w + lead(taps, 3) OVER w AS sum_taps,
        low + lead(low) OVER w + lead(low, 2) OVER w + lead(low, 3) OVER w AS sum_low
      FROM s WINDOW w AS (PARTITION BY dataset, subject_id, sg ORDER BY slot))
    SELECT dataset, subject_id, window_start, round(sum_value, 6) AS sum_value, sum_taps, round(sum_low, 6) AS sum_low
    FROM l WHERE sp + 6 <= sn""",
)
def _(spark, sf):
    day = F.timestamp_seconds(slot() * 86400)
    daily = (
        raw_events(spark, sf)
        .groupBy(*KEYS, day.alias("ts"))
        .agg(F.max("value").alias("value"), F.count("*").cast("double").alias("taps"), F.min("value").alias("low"))
    )
    out = windows.windows_segmented(daily, SPEC, CTX, HOR, 1, LIMIT, ["taps", "low"])

    def total(name):
        return F.aggregate(name, F.lit(0.0), lambda a, v: a + v)

    return rounded(
        out.select(
            *KEYS,
            "window_start",
            total("context").alias("sum_value"),
            total("context_taps").alias("sum_taps"),
            total("context_low").alias("sum_low"),
        )
    )


@query(
    "count_windows",
    f"""WITH {POS}, l AS (SELECT dataset, pos, slot, lead(slot, 5) OVER (PARTITION BY dataset, subject_id ORDER BY slot) AS last FROM pos),
    ok AS (SELECT * FROM l WHERE last = slot + 5), s AS (SELECT unnest([1, 2, 12]) AS stride)
    SELECT d.dataset, s.stride, CAST((SELECT count(*) FROM ok WHERE ok.dataset = d.dataset AND ok.pos % s.stride = 0) AS BIGINT) AS windows
    FROM (SELECT DISTINCT dataset FROM ok) d, s""",
)
def _(spark, sf):
    return windows.count_windows(readings(spark, sf), SPEC, LEN, [1, 2, 12], ["dataset"])


@query(
    "count_windows_segmented",
    f"""WITH {SEG}, n AS (SELECT dataset, subject_id, segment_id, count(*) - 5 AS usable FROM seg GROUP BY ALL HAVING count(*) >= 6),
    s AS (SELECT unnest([1, 2, 12]) AS stride)
    SELECT dataset, stride, CAST(sum(ceil(usable / stride)) AS BIGINT) AS windows FROM n, s GROUP BY ALL""",
)
def _(spark, sf):
    return windows.count_windows(readings(spark, sf), SPEC, LEN, [1, 2, 12], ["dataset"], LIMIT)


@query(
    "usable_subjects",
    f"""WITH {POS}, l AS (SELECT dataset, subject_id, pos, slot, lead(slot, 5) OVER (PARTITION BY dataset, subject_id ORDER BY slot) AS last FROM pos)
    SELECT dataset, count(DISTINCT subject_id) AS found, count(DISTINCT CASE WHEN last = slot + 5 THEN subject_id END) AS usable,
      CAST(count(*) FILTER (last = slot + 5) AS BIGINT) AS stride_1,
      CAST(count(*) FILTER (last = slot + 5 AND pos % 2 = 0) AS BIGINT) AS stride_2 FROM l GROUP BY dataset""",
)
def _(spark, sf):
    rows = windows.window_ends(readings(spark, sf), SPEC, LEN).filter("_home")
    first = F.col("pos") - (LEN - 1)
    each = rows.groupBy(*KEYS).agg(
        F.count_if("_ok").alias("s1"), F.count_if(F.col("_ok") & (F.pmod(first, F.lit(2)) == 0)).alias("s2")
    )
    return each.groupBy("dataset").agg(
        F.count("*").alias("found"), F.count_if(F.col("s1") > 0).alias("usable"), F.sum("s1").alias("stride_1"), F.sum("s2").alias("stride_2")
    )


for _name, _hor in (("latest_window", 0), ("latest_window_with_truth", HOR)):

    @query(
        _name,
        f"""WITH {POS}, l AS (SELECT *, {LEADS}, lead(slot, {CTX + _hor - 1}) OVER w AS last
          FROM pos WINDOW w AS (PARTITION BY dataset, subject_id ORDER BY slot)),
        ok AS (SELECT *, row_number() OVER (PARTITION BY dataset, subject_id ORDER BY pos DESC) AS r FROM l WHERE last = slot + {CTX + _hor - 1})
        SELECT dataset, subject_id, pos AS window_start, x0, x1, x2, x3 FROM ok WHERE r = 1""",
    )
    def _(spark, sf, hor=_hor):
        out = windows.latest_window(readings(spark, sf), SPEC, CTX, hor)
        return out.select(*KEYS, "window_start", *[F.element_at("context", i + 1).alias(f"x{i}") for i in range(CTX)])


@query(
    "rolling_slices",
    f"""WITH {SERIES}, w AS (SELECT item_id, target, n, w.w AS "window", n - 8 + w.w * 2 AS fs
      FROM ser, (SELECT unnest(range(4)) AS w) w WHERE n - 8 + w.w * 2 >= 1 AND n - 8 + w.w * 2 + 2 <= n)
    SELECT item_id, CAST("window" AS INTEGER) AS "window", CAST(fs AS INTEGER) AS forecast_start,
      round(list_sum(target[greatest(fs - 5, 1):fs]), 6) AS sum_context, round(list_sum(target[fs + 1:fs + 2]), 6) AS sum_label FROM w""",
)
def _(spark, sf):
    out = windows.rolling_slices(_series(spark, sf), SPEC, -8, 2, 4, 6, 2)
    return rounded(out.select(_item(), "window", F.col("forecast_start").cast("int").alias("forecast_start"), _sum("context").alias("sum_context"), _sum("label").alias("sum_label")))


def _sum(name):
    return F.aggregate(name, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


@query(
    "rolling_origin",
    f"""WITH {SERIES}, f AS (SELECT item_id, target, f.f AS fold, n - (3 - f.f) * 2 AS c FROM ser, (SELECT unnest(range(3)) AS f) f)
    SELECT item_id, CAST(fold AS INTEGER) AS fold, CAST(c AS INTEGER) AS cut_at, round(list_sum(target[1:c]), 6) AS sum_history,
      round(list_sum(target[c + 1:c + 2]), 6) AS sum_label FROM f WHERE c >= 1""",
)
def _(spark, sf):
    out = windows.rolling_origin(_series(spark, sf), SPEC, 2, 3)
    of = lambda part: F.sum(F.when(F.col("part") == part, F.col("value")))
    out = out.groupBy(*KEYS, "fold", "cut_at").agg(of("history").alias("sum_history"), of("label").alias("sum_label"))
    return rounded(out.select(_item(), "fold", F.col("cut_at").cast("int").alias("cut_at"), "sum_history", "sum_label"))


@query(
    "encoder_decoder_windows",
    f"""WITH {SERIES}, s AS (SELECT item_id, target, unnest(range(0, n - 6 + 1)) AS b FROM ser WHERE n >= 6)
    SELECT item_id, CAST(b AS INTEGER) AS s_begin, round(list_sum(target[b + 1:b + 4]), 6) AS sum_x,
      round(list_sum(target[b + 3:b + 6]), 6) AS sum_y FROM s""",
)
def _(spark, sf):
    out = windows.encoder_decoder(_series(spark, sf), SPEC, 4, 2, 2)
    return rounded(out.select(_item(), F.col("s_begin").cast("int").alias("s_begin"), _sum("seq_x").alias("sum_x"), _sum("seq_y").alias("sum_y")))


@query(
    "stepped_windows",
    f"""WITH {SERIES}, s AS (SELECT item_id, target, unnest(range(0, n - 5 + 1, 5)) AS b FROM ser WHERE n >= 5)
    SELECT item_id, CAST(b AS INTEGER) AS "at", round(list_sum(target[b + 1:b + 5]), 6) AS sum_window FROM s""",
)
def _(spark, sf):
    out = windows.stepped_windows(_series(spark, sf), SPEC, 5, 5)
    return rounded(out.select(_item(), F.col("at").cast("int").alias("at"), _sum("window").alias("sum_window")))


@query(
    "padded_tail",
    f"""WITH {SERIES} SELECT item_id, round(CASE WHEN n >= 20 THEN target[n - 19] ELSE 0 END, 6) AS first_value, round(target[n], 6) AS last_value,
      CAST(least(n, 20) AS DOUBLE) AS observed, round(list_sum(target[greatest(n - 19, 1):n]), 6) AS total FROM ser""",
)
def _(spark, sf):
    out = windows.padded_tail(_series(spark, sf), SPEC, 20)
    return rounded(
        out.select(
            _item(),
            F.element_at("insample", 1).alias("first_value"),
            F.element_at("insample", 20).alias("last_value"),
            _sum("insample_mask").alias("observed"),
            _sum("insample").alias("total"),
        )
    )


HASH = "CAST('0x' || substr(md5(concat_ws('|', {})), 1, 15) AS BIGINT)"


@query(
    "cut_point_window",
    f"""WITH {SERIES}, c AS (SELECT *, greatest(1, n - 10) AS low FROM ser),
    d AS (SELECT *, low + {HASH.format("item_id, 7")} % (n - low) AS cut FROM c WHERE n > low)
    SELECT item_id, CAST(cut AS INTEGER) AS cut, round(list_sum(target[greatest(cut - 7, 1):cut]), 6) AS sum_in,
      round(list_sum(target[cut + 1:least(cut + 4, n)]), 6) AS sum_out, CAST(least(cut, 8) AS DOUBLE) AS n_in,
      CAST(least(n - cut, 4) AS DOUBLE) AS n_out FROM d""",
)
def _(spark, sf):
    out = windows.cut_point_window(_series(spark, sf), SPEC, _item(), 7, 10, 8, 4)
    return rounded(
        out.select(
            _item(),
            F.col("cut").cast("int").alias("cut"),
            _sum("insample").alias("sum_in"),
            _sum("outsample").alias("sum_out"),
            _sum("insample_mask").alias("n_in"),
            _sum("outsample_mask").alias("n_out"),
        )
    )


@query(
    "last_n_context",
    f"""WITH {POS}, r AS (SELECT *, row_number() OVER (PARTITION BY dataset, subject_id ORDER BY slot DESC) AS r FROM readings)
    SELECT dataset, subject_id, slot, value FROM r WHERE r <= 4""",
)
def _(spark, sf):
    return windows.last_n(readings(spark, sf), KEYS, "ts", 4).select(*KEYS, slot().alias("slot"), "value")


@query(
    "first_horizon",
    f"""WITH {POS} SELECT dataset, subject_id, slot, value FROM pos WHERE pos < 2""",
)
def _(spark, sf):
    return windows.first_n(readings(spark, sf), KEYS, "ts", 2).select(*KEYS, slot().alias("slot"), "value")


@query(
    "future_timestamps",
    f"""WITH {READINGS}, m AS (SELECT dataset, subject_id, max(slot) AS s FROM readings GROUP BY 1, 2)
    SELECT dataset, subject_id, CAST(k AS INTEGER) AS horizon_step, s + k AS slot FROM m, (SELECT unnest([1, 2, 3]) AS k)""",
)
def _(spark, sf):
    out = windows.future_timestamps(readings(spark, sf), KEYS, "ts", DAY, 3)
    return out.select(*KEYS, "horizon_step", slot().alias("slot"))


@query(
    "infer_freq",
    f"""WITH {POS} SELECT dataset, subject_id, count(*) AS n,
      CASE WHEN min(slot - prev) = max(slot - prev) THEN CAST(min(slot - prev) * 86400 AS VARCHAR) || 's' END AS freq
    FROM pos GROUP BY 1, 2""",
)
def _(spark, sf):
    return windows.infer_freq(readings(spark, sf), SPEC)


@query(
    "infer_freq_monthly",
    """WITH m AS (SELECT CAST(l_suppkey AS VARCHAR) AS item, date_trunc('month', l_shipdate) AS ts FROM lineitem GROUP BY 1, 2),
    d AS (SELECT *, date_diff('month', lag(ts) OVER (PARTITION BY item ORDER BY ts), ts) AS g FROM m)
    SELECT item, count(*) AS n, CASE WHEN min(g) = max(g) THEN CAST(min(g) AS VARCHAR) || 'mo' END AS freq FROM d GROUP BY item""",
)
def _(spark, sf):
    monthly = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("item"), F.date_trunc("month", F.col("l_shipdate").cast("timestamp")).alias("ts")
    )
    spec = SeriesSpec(keys=("item",), step=timedelta(days=1))
    return windows.infer_freq(monthly.distinct(), spec)


@query(
    "shared_axis_windows",
    f"""WITH {SERIES}, cov AS (SELECT item_id, target, n, [x * 2 for x in target[1:greatest(n - 3, 1)]] AS feat FROM ser),
    w AS (SELECT *, w.w AS "window", 1 + w.w * 3 AS a FROM cov, (SELECT unnest(range(5)) AS w) w WHERE 1 + w.w * 3 + 4 <= n),
    g AS (SELECT *, least(6, len(feat) - a) AS have FROM w WHERE len(feat) > a)
    SELECT item_id, CAST("window" AS INTEGER) AS "window", CAST(a AS INTEGER) AS "at", round(list_sum(target[a + 1:a + 4]), 6) AS sum_past,
      round(coalesce(list_sum(target[a + 5:least(a + 6, n)]), 0), 6) AS sum_future,
      round(list_sum(feat[a + 1:a + have]) + (6 - have) * feat[len(feat)], 6) AS sum_features FROM g""",
)
def _(spark, sf):
    rows = with_position(_series(spark, sf), SPEC, total="_n")
    # a covariate that is known for all readings but the last three
    rows = rows.withColumn("feat", F.when(F.col("pos") < F.greatest(F.col("_n") - 3, F.lit(1)), F.col("value") * 2)).drop("pos", "_n")
    out = windows.shared_axis_windows(rows, SPEC, "feat", 1, 4, 2, 3, 5)
    return rounded(
        out.select(_item(), "window", F.col("at").cast("int").alias("at"), _sum("past").alias("sum_past"), _sum("future").alias("sum_future"), _sum("features").alias("sum_features"))
    )
