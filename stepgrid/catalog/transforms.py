"""Transforms of windows of readings, and of whole series in long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepgrid.catalog.base import KEYS, POS, READINGS, SPEC, WINDOWED, query, r6, reading_windows, readings, rounded, slot, table
from stepgrid.functions import arrays
from stepgrid.operators import packing, sampling, spectral, whole
from stepgrid.operators.windows import lag_rows
from stepgrid.series import with_position

HASH = "CAST('0x' || substr(md5(concat_ws('|', {})), 1, 15) AS BIGINT)"

# one array per window, values over 100 missing
ARR = f"""{WINDOWED}, arr AS (
  SELECT item_id, list(value ORDER BY i) AS full_target, count(*) AS n, list(CASE WHEN value < 100 THEN value END ORDER BY i) AS target
  FROM cells GROUP BY item_id)"""

# the same as rows
LONG = f"""{WINDOWED}, long AS (
  SELECT item_id, i, count(*) OVER (PARTITION BY item_id) AS n, value AS full_value, CASE WHEN value < 100 THEN value END AS value FROM cells)"""

# whole series, whatever their length
WHOLE = f"""{READINGS}, whole AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, subject_id ORDER BY slot) - 1 AS pos, count(*) OVER (PARTITION BY dataset, subject_id) AS n FROM readings)"""


def items(spark, sf):
    """One row per window with the whole and the gappy array."""
    return reading_windows(spark, sf).select(
        "item_id",
        F.col("values").alias("full_target"),
        F.transform("values", lambda v: F.when(v < 100, v)).alias("target"),
    )


def total(col):
    col = F.col(col) if isinstance(col, str) else col
    return F.aggregate(col, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))


def exploded(df, col, name):
    return df.select("item_id", F.posexplode(col).alias("i", name)).withColumn("i", F.col("i").cast("bigint"))


@query("array_impute_constant", f"WITH {LONG} SELECT item_id, i, coalesce(value, -5) AS v FROM long")
def _(spark, sf):
    return exploded(items(spark, sf), arrays.impute_constant(F.col("target"), -5.0), "v")


@query("observed_mask", f"WITH {LONG} SELECT item_id, i, value IS NOT NULL AS seen FROM long")
def _(spark, sf):
    return exploded(items(spark, sf), arrays.observed_mask(F.col("target")), "seen")


@query(
    "index_arrays",
    f"""WITH {WHOLE} SELECT dataset, subject_id, slot, pos AS time_index, CAST(k AS INTEGER) AS variate_index, CAST(7 AS INTEGER) AS sample_id,
      CASE k WHEN 0 THEN value ELSE round(value / 2, 6) END AS value FROM whole, (SELECT unnest([0, 1]) AS k)""",
)
def _(spark, sf):
    rows = readings(spark, sf).withColumn("half", F.round(F.col("value") / 2, 6))
    out = whole.index_rows(rows, SPEC, ["value", "half"], sample=7)
    return out.select(*KEYS, slot().alias("slot"), "time_index", "variate_index", "sample_id", "value")


@query(
    "window_index_arrays",
    f"""WITH {LONG} SELECT item_id, i, CAST(i AS INTEGER) AS time_index, CAST(1 AS INTEGER) AS sample_id, CAST(0 AS INTEGER) AS variate_0, CAST(1 AS INTEGER) AS variate_1 FROM long""",
)
def _(spark, sf):
    both = arrays.variate_index(F.array(F.col("full_target"), F.col("target")))
    made = F.arrays_zip(
        arrays.time_index(F.col("target")).alias("time_index"), arrays.sample_index(F.col("target")).alias("sample_id"), both[0].alias("variate_0"), both[1].alias("variate_1")
    )
    out = exploded(items(spark, sf), made, "z")
    return out.select("item_id", "i", *[F.col(f"z.{c}").cast("int").alias(c) for c in ("time_index", "sample_id", "variate_0", "variate_1")])


@query(
    "patchify",
    f"""WITH {LONG} SELECT item_id, CAST(i // 4 AS BIGINT) AS patch, round(sum(full_value), 6) AS total, CAST(6 AS INTEGER) AS width
    FROM long WHERE i // 4 < n // 4 GROUP BY 1, 2""",
)
def _(spark, sf):
    out = items(spark, sf).select("item_id", F.posexplode(arrays.patchify(F.col("full_target"), 4, 6)).alias("patch", "p"))
    return rounded(out.select("item_id", F.col("patch").cast("bigint").alias("patch"), total("p").alias("total"), F.size("p").alias("width")))


@query(
    "overlapping_patches",
    f"""WITH {ARR}, p AS (SELECT item_id, list_concat(list_transform(range(CAST((-n) % 4 + 4 AS BIGINT) % 4), lambda x: NULL::DOUBLE), full_target) AS a,
        n + ((-n) % 4 + 4) % 4 AS m FROM arr),
    s AS (SELECT item_id, a, unnest(range(0, m - 4 + 1, 2)) AS b FROM p)
    SELECT item_id, CAST(b // 2 AS BIGINT) AS patch, round(coalesce(list_sum(a[b + 1:b + 4]), 0), 6) AS total FROM s""",
)
def _(spark, sf):
    out = items(spark, sf).select("item_id", F.posexplode(arrays.overlapping_patches(F.col("full_target"), 4, 2)).alias("patch", "p"))
    return rounded(out.select("item_id", F.col("patch").cast("bigint").alias("patch"), total("p").alias("total")))


@query(
    "patch_size_choice",
    f"""WITH z AS (SELECT o_custkey AS k, count(*) * 20 AS len FROM orders GROUP BY 1),
    f AS (SELECT k, len, (['S', 'T', 'H', 'D', 'M', 'Y'])[k % 6 + 1] AS freq FROM z),
    r AS (SELECT *, CASE freq WHEN 'S' THEN [64, 128] WHEN 'T' THEN [32, 64, 128] WHEN 'H' THEN [32, 64] WHEN 'D' THEN [16, 32] WHEN 'M' THEN [8, 16, 32] ELSE [8] END AS sizes FROM f),
    c AS (SELECT *, [s for s in sizes if s <= len // 2] AS fit FROM r)
    SELECT k, freq, CASE WHEN len(fit) > 0 THEN fit[{HASH.format("k, 3")} % len(fit) + 1] END AS patch FROM c""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg((F.count("*") * 20).alias("len"))
    names = F.array(*[F.lit(x) for x in ("S", "T", "H", "D", "M", "Y")])
    rows = rows.withColumn("freq", F.get(names, (F.col("k") % 6).cast("int")))
    choice = sampling.patch_size("freq", "len", [8, 16, 32, 64, 128], 2, F.col("k"), F.lit(3))
    return rows.select("k", "freq", choice.alias("patch"))


@query(
    "patch_crop",
    f"""WITH {WHOLE}, a AS (SELECT *, {HASH.format("dataset, subject_id, 'offset'")} % (n % 4 + 1) AS off FROM whole),
    b AS (SELECT *, (n - off) // 4 AS tot FROM a), c AS (SELECT *, least(5, tot) AS most FROM b WHERE least(5, tot) >= 2),
    d AS (SELECT *, 2 + {HASH.format("dataset, subject_id, 'count'")} % (most - 1) AS cnt FROM c),
    e AS (SELECT *, off + 4 * ({HASH.format("dataset, subject_id, 'first'")} % (tot - cnt + 1)) AS low FROM d)
    SELECT dataset, subject_id, slot, pos - low AS pos, (pos - low) // 4 AS patch FROM e WHERE pos >= low AND pos < low + cnt * 4""",
)
def _(spark, sf):
    out = whole.crop_to_patches(readings(spark, sf), SPEC, 4, 2, 5, F.col("dataset"), F.col("subject_id"))
    return out.select(*KEYS, slot().alias("slot"), "pos", "patch")


@query(
    "window_patch_crop",
    f"""WITH {ARR}, a AS (SELECT item_id, full_target AS t, n, {HASH.format("item_id, 'offset'")} % (n % 4 + 1) AS off FROM arr),
    b AS (SELECT *, (n - off) // 4 AS tot FROM a), c AS (SELECT *, least(5, tot) AS most FROM b WHERE least(5, tot) >= 2),
    d AS (SELECT *, 2 + {HASH.format("item_id, 'count'")} % (most - 1) AS cnt FROM c),
    e AS (SELECT *, {HASH.format("item_id, 'first'")} % (tot - cnt + 1) AS f FROM d)
    SELECT item_id, CAST(cnt * 4 AS INTEGER) AS n_values, round(list_sum(t[off + f * 4 + 1:off + f * 4 + cnt * 4]), 6) AS total FROM e""",
)
def _(spark, sf):
    crop = arrays.patch_crop(F.col("full_target"), 4, 2, 5, F.col("item_id"))
    out = items(spark, sf).withColumn("c", crop).filter(F.col("c").isNotNull())
    return rounded(out.select("item_id", F.size("c").alias("n_values"), total("c").alias("total")))


@query(
    "pad_to_minimum",
    f"""WITH {WHOLE}, s AS (SELECT dataset, subject_id, max(n) AS n, {HASH.format("dataset, subject_id, 1")} % (greatest(29 - max(n), 0) + 1) AS front FROM whole GROUP BY 1, 2),
    p AS (SELECT *, unnest(range(29)) AS pos FROM s)
    SELECT w.dataset, w.subject_id, pos + front AS pos, value, false AS padded FROM whole w JOIN s USING (dataset, subject_id)
    UNION ALL SELECT dataset, subject_id, pos, NULL, true FROM p WHERE n < 29 AND (pos < front OR pos >= front + n)""",
)
def _(spark, sf):
    out = whole.pad_short(readings(spark, sf), SPEC, 29, F.col("dataset"), F.col("subject_id"), F.lit(1))
    return out.select(*KEYS, "pos", "value", "padded")


@query(
    "window_pad_to_minimum",
    f"""WITH {ARR}, a AS (SELECT *, greatest(15 - n, 0) AS lack FROM arr)
    SELECT item_id, CAST(greatest(n, 15) AS INTEGER) AS n_values, CAST({HASH.format("item_id, 1")} % (lack + 1) AS INTEGER) AS front, round(list_sum(full_target), 6) AS total FROM a""",
)
def _(spark, sf):
    out = items(spark, sf).withColumn("p", arrays.pad_to(F.col("full_target"), 15, F.col("item_id"), F.lit(1)))
    lead = F.array_position(arrays.observed_mask(F.col("p")), F.lit(True)).cast("int") - 1
    return rounded(out.select("item_id", F.size("p").alias("n_values"), lead.alias("front"), total("p").alias("total")))


@query(
    "pad_left_right",
    f"""WITH {ARR} SELECT item_id, CASE WHEN n >= 12 THEN full_target[1] END AS first_left, full_target[n] AS last_left,
      CASE WHEN n >= 12 THEN full_target[n] ELSE 0 END AS last_right FROM arr""",
)
def _(spark, sf):
    t = F.col("full_target")
    return items(spark, sf).select(
        "item_id",
        F.element_at(arrays.left_pad(t, 12), 1).alias("first_left"),
        F.element_at(arrays.left_pad(t, 12), -1).alias("last_left"),
        F.element_at(arrays.right_pad(t, 12, F.lit(0.0)), -1).alias("last_right"),
    )


@query(
    "prediction_mask",
    f"""WITH {WHOLE} SELECT dataset, subject_id, slot, pos >= n - n // 4 AS masked FROM whole""",
)
def _(spark, sf):
    out = whole.mask_tail(readings(spark, sf), SPEC, F.floor(F.col(whole.TOTAL) / 4))
    return out.select(*KEYS, slot().alias("slot"), "masked")


@query(
    "random_prediction_mask",
    f"""WITH {WHOLE}, m AS (SELECT *, greatest(1, CAST(round((0.15 + 0.35 * ({HASH.format("dataset, subject_id, 8")} / 1152921504606846976.0)) * n) AS BIGINT)) AS m FROM whole)
    SELECT dataset, subject_id, count(*) FILTER (pos >= n - m) AS masked, round(sum(value) FILTER (pos < n - m), 6) AS kept FROM m GROUP BY 1, 2""",
)
def _(spark, sf):
    share = whole.random_ratio(0.15, 0.5, F.col("dataset"), F.col("subject_id"), F.lit(8))
    out = whole.mask_tail(readings(spark, sf), SPEC, share)
    return rounded(out.groupBy(*KEYS).agg(F.count_if("masked").alias("masked"), F.sum(F.when(~F.col("masked"), F.col("value"))).alias("kept")))


@query(
    "window_prediction_mask",
    f"""WITH {LONG} SELECT item_id, CAST(sum(CASE WHEN i >= n - n // 4 THEN 1 ELSE 0 END) AS INTEGER) AS masked,
      round(coalesce(sum(CASE WHEN i < n - n // 4 THEN full_value END), 0), 6) AS kept, CAST(2 * max(n) AS INTEGER) AS extended FROM long GROUP BY 1""",
)
def _(spark, sf):
    take = F.floor(F.size("full_target") / 4).cast("int")
    mask = arrays.prediction_mask(F.col("full_target"), take)
    return rounded(
        items(spark, sf).select(
            "item_id",
            F.size(F.filter(mask, lambda m: m)).alias("masked"),
            total(arrays.drop_tail(F.col("full_target"), take)).alias("kept"),
            F.size(arrays.extend_mask(mask, F.col("full_target"))).alias("extended"),
        )
    )


@query(
    "sample_variates",
    f"""WITH v AS (SELECT DISTINCT user_id, event_type FROM events)
    SELECT CAST(user_id AS VARCHAR) AS user_id, event_type FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY {HASH.format("user_id, event_type, 5")}, event_type) <= 2""",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), "event_type").distinct()
    return sampling.sample_variates(rows, ["user_id"], "event_type", 2, 5)


@query(
    "transpose_fields",
    f"""WITH {LONG} SELECT item_id, i, full_value AS a, value AS b FROM long""",
)
def _(spark, sf):
    pairs = F.zip_with("full_target", "target", lambda a, b: F.array(a, b))
    cols = arrays.transpose(pairs, 2)
    out = items(spark, sf).select("item_id", F.posexplode(F.arrays_zip(F.get(cols, 0).alias("a"), F.get(cols, 1).alias("b"))).alias("i", "z"))
    return out.select("item_id", F.col("i").cast("bigint").alias("i"), "z.a", "z.b")


# first-fit-decreasing of each batch, one sequence per step
PACKED = f"""{ARR.replace("readings AS", "RECURSIVE readings AS", 1)}, h AS (SELECT item_id, n, full_target, {HASH.format("item_id, 0")} AS h FROM arr),
o AS (SELECT *, (row_number() OVER (ORDER BY h % 4096, h, item_id) - 1) // 32 AS batch FROM h),
queue AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY n DESC, item_id) AS k FROM o),
fit AS (
  SELECT DISTINCT batch, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS free, CAST(0 AS BIGINT) AS spot FROM queue
  UNION ALL
  SELECT batch, k, CASE WHEN spot > len(free) THEN list_append(free, 64 - n) ELSE list_transform(free, lambda x, j: CASE WHEN j = spot THEN x - n ELSE x END) END, spot
  FROM (SELECT q.batch, q.k, q.n, f.free, coalesce(nullif(list_position(list_transform(f.free, lambda x: x >= q.n), true), 0), len(f.free) + 1) AS spot
    FROM fit f JOIN queue q ON q.batch = f.batch AND q.k = f.k + 1)),
placed AS (SELECT q.batch, spot - 1 AS bin, row_number() OVER (PARTITION BY q.batch, spot ORDER BY q.k) AS sample_id, item_id AS id, n AS length, full_target
  FROM fit f JOIN queue q ON q.batch = f.batch AND q.k = f.k),
packed AS (SELECT *, sum(length) OVER (PARTITION BY batch, bin ORDER BY sample_id) - length AS start FROM placed)"""


@query(
    "pack_sequences",
    f"""WITH {PACKED} SELECT CAST(batch AS BIGINT) AS batch, CAST(bin AS BIGINT) AS bin, max(sample_id) AS sequences, CAST(sum(length) AS BIGINT) AS cells,
      CAST(sum(sample_id * (length * start + length * (length - 1) // 2)) AS BIGINT) AS layout, round(sum(list_sum(full_target)), 4) AS total FROM packed GROUP BY 1, 2""",
)
def _(spark, sf):
    out = packing.pack_sequences(items(spark, sf), "item_id", "full_target", 64, 32)
    used = F.filter("sample_id", lambda s: s > 0)
    # where in a bin each sequence lies: places weighted by its number
    layout = F.aggregate(F.transform("sample_id", lambda s, i: s * i), F.lit(0).cast("bigint"), lambda a, v: a + v)
    full = F.when((F.size("values") == 64) & (F.size("sample_id") == 64), F.size(used))
    return out.select(
        "batch", "bin", F.array_max("sample_id").alias("sequences"), full.cast("bigint").alias("cells"), layout.alias("layout"), F.round(total("values"), 4).alias("total")
    )


@query(
    "pack_batches",
    f"""WITH {PACKED} SELECT CAST(batch AS BIGINT) AS batch, CAST(bin AS BIGINT) AS bin, sample_id, id, length FROM packed""",
)
def _(spark, sf):
    return packing.pack_plan(items(spark, sf), "item_id", "full_target", 64, 32)


@query(
    "pad_sequences",
    f"WITH {ARR} SELECT item_id, CAST(n AS INTEGER) AS observed, round(list_sum(full_target), 6) AS total, CAST(24 AS INTEGER) AS width FROM arr",
)
def _(spark, sf):
    out = packing.pad_sequences(items(spark, sf), "full_target", 24)
    ones = F.size(F.filter("sample_id", lambda s: s == 1))
    return rounded(out.select("item_id", ones.alias("observed"), total("values").alias("total"), F.size("values").alias("width")))


@query("fixed_scale", f"WITH {LONG} SELECT item_id, i, round(full_value / 100, 6) AS v FROM long")
def _(spark, sf):
    return rounded(exploded(items(spark, sf), arrays.fixed_scale(F.col("full_target"), 0.01), "v"))


@query(
    "quantize_series",
    f"""WITH {LONG}, s AS (SELECT item_id, coalesce(avg(abs(value)), 1) AS s FROM long GROUP BY 1),
    q AS (SELECT item_id, i, s, value, CAST(floor((value / s + 15) / (30.0 / 4092) + 0.5) AS BIGINT) + 1 AS b FROM long JOIN s USING (item_id))
    SELECT item_id, i, CAST(CASE WHEN value IS NULL THEN 0 ELSE least(4095, greatest(1, least(4093, b)) + 2) END AS INTEGER) AS token,
      round((-15 + (30.0 / 4092) * greatest(0, least(4092, CASE WHEN value IS NULL THEN 0 ELSE least(4095, greatest(1, least(4093, b)) + 2) END - 3))) * s, 6) AS restored FROM q""",
)
def _(spark, sf):
    q = arrays.quantize(F.col("target"), -15.0, 15.0, 4096, 2)
    rows = items(spark, sf).withColumn("scale", q["scale"]).withColumn("tokens", q["tokens"])
    back = arrays.dequantize(F.col("tokens"), F.col("scale"), -15.0, 15.0, 4096, 2)
    out = rows.select("item_id", F.posexplode(F.arrays_zip(F.col("tokens").alias("t"), back.alias("b"))).alias("i", "z"))
    return rounded(out.select("item_id", F.col("i").cast("bigint").alias("i"), F.col("z.t").alias("token"), F.col("z.b").alias("restored")))


@query(
    "moving_average",
    f"""WITH {WHOLE}, m AS (SELECT *, sum(value) OVER (PARTITION BY dataset, subject_id ORDER BY slot ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / 3 AS smooth FROM whole)
    SELECT dataset, subject_id, slot, round(smooth, 6) AS smooth, round(value - smooth, 6) AS residual FROM m""",
)
def _(spark, sf):
    out = whole.moving_average_rows(readings(spark, sf), SPEC, 3)
    return rounded(out.select(*KEYS, slot().alias("slot"), "smooth", "residual"))


@query(
    "sliding_sums",
    f"""WITH {READINGS}, g AS (SELECT dataset, subject_id, slot, CASE WHEN value < 100 THEN value END AS v FROM readings)
    SELECT dataset, subject_id, slot, round(coalesce(sum(v) OVER w, 0), 6) AS frame_sum, count(v) OVER w AS frame_count FROM g
    WINDOW w AS (PARTITION BY dataset, subject_id ORDER BY slot ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
)
def _(spark, sf):
    rows = readings(spark, sf).withColumn("value", F.when(F.col("value") < 100, F.col("value")))
    return rounded(whole.sliding_sums(rows, SPEC, 5).select(*KEYS, slot().alias("slot"), "frame_sum", "frame_count"))


@query(
    "window_moving_average",
    f"""WITH {LONG}, m AS (SELECT *, sum(full_value) OVER (PARTITION BY item_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) / 3 AS smooth FROM long)
    SELECT item_id, i, round(smooth, 6) AS smooth, round(full_value - smooth, 6) AS residual FROM m""",
)
def _(spark, sf):
    smooth = arrays.moving_average(F.col("full_target"), 3)
    z = F.arrays_zip(smooth.alias("s"), F.col("full_target").alias("v"))
    out = items(spark, sf).select("item_id", F.posexplode(z).alias("i", "z"))
    return rounded(
        out.select("item_id", F.col("i").cast("bigint").alias("i"), F.col("z.s").alias("smooth"), (F.col("z.v") - F.col("z.s")).alias("residual"))
    )


@query(
    "lagged_values",
    f"""WITH {POS} SELECT dataset, subject_id, slot, lag(value, 2) OVER w AS lag_2, lag(value, 7) OVER w AS lag_7
    FROM pos WINDOW w AS (PARTITION BY dataset, subject_id ORDER BY slot)""",
)
def _(spark, sf):
    rows = lag_rows(with_position(readings(spark, sf), SPEC), SPEC, {"lag_2": 2, "lag_7": 7})
    return rows.select(*KEYS, slot().alias("slot"), "lag_2", "lag_7")


@query(
    "window_stats",
    f"""WITH {ARR} SELECT item_id, list_min(full_target) AS min_value, list_max(full_target) AS max_value,
      list_sort(full_target)[(n + 1) // 2] AS median_value, CASE WHEN full_target[n] - full_target[1] > 0 THEN 'upward' ELSE 'downward' END AS trend FROM arr""",
)
def _(spark, sf):
    stats = arrays.window_stats(F.col("full_target"))
    return items(spark, sf).select("item_id", *[c.alias(n) for n, c in stats.items()])


LAGS = f"""{LONG}, ac AS (SELECT a.item_id, g.lag, sum(a.full_value * b.full_value) AS c
  FROM long a JOIN (SELECT unnest(range(31)) AS lag) g ON g.lag < a.n JOIN long b ON a.item_id = b.item_id AND b.i = (a.i + g.lag) % a.n GROUP BY 1, 2),
lags AS (SELECT item_id, lag, row_number() OVER (PARTITION BY item_id ORDER BY round(c, 4) DESC, lag) - 1 AS rank FROM ac)"""


@query("top_lags", f"WITH {LAGS} SELECT item_id, rank, CAST(lag AS INTEGER) AS lag FROM lags WHERE rank < 5")
def _(spark, sf):
    scored = F.transform(arrays.circular_autocorrelation(F.col("full_target")), lambda c: F.round(c, 4))
    ranked = F.slice(F.array_sort(F.transform(scored, lambda c, i: F.struct((-c).alias("c"), i.alias("lag")))), 1, 5)
    out = items(spark, sf).select("item_id", F.posexplode(ranked).alias("rank", "r"))
    return out.select("item_id", F.col("rank").cast("bigint").alias("rank"), "r.lag")


@query("top_lags_fft", f"WITH {LAGS} SELECT item_id, rank, CAST(lag AS INTEGER) AS lag FROM lags WHERE rank < 5")
def _(spark, sf):
    out = spectral.top_lags_fft(items(spark, sf), "full_target", 5)
    return out.select("item_id", F.posexplode("lags").alias("rank", "lag")).withColumn("rank", F.col("rank").cast("bigint"))


@query(
    "interpolate_quantiles",
    f"""SELECT o_orderkey, o_totalprice * 0.5 AS q05,
      o_totalprice * 0.5 + {(0.25 - 0.1) / (0.5 - 0.1)!r}::DOUBLE * (o_totalprice - o_totalprice * 0.5) AS q25, o_totalprice AS q50,
      o_totalprice + {(0.6 - 0.5) / (0.9 - 0.5)!r}::DOUBLE * (o_totalprice * 2 - o_totalprice) AS q60, o_totalprice * 2 AS q95 FROM orders""",
)
def _(spark, sf):
    v = F.col("o_totalprice")
    levels, values = [0.1, 0.5, 0.9], [v * 0.5, v, v * 2]

    def at(q):
        return arrays.quantile_at(q, levels, values)

    return table(spark, sf, "orders").select(
        "o_orderkey", at(0.05).alias("q05"), at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.6).alias("q60"), at(0.95).alias("q95")
    )


@query(
    "weighted_quantile",
    f"""WITH {LONG}, w AS (SELECT item_id, full_value AS v, (i % 3 + 1.0) AS w FROM long), t AS (SELECT item_id, sum(w) AS tw FROM w GROUP BY 1),
    c AS (SELECT w.item_id, v, w / tw AS w, sum(w / tw) OVER (PARTITION BY w.item_id ORDER BY v, w / tw ROWS UNBOUNDED PRECEDING) AS cum,
      lag(v) OVER (PARTITION BY w.item_id ORDER BY v, w / tw) AS pv FROM w JOIN t USING (item_id))
    SELECT item_id, round(arg_min(CASE WHEN pv IS NULL THEN v ELSE pv + (0.5001 - (cum - w)) / w * (v - pv) END, cum), 8) AS q FROM c WHERE cum > 0.5001 GROUP BY 1""",
)
def _(spark, sf):
    weights = F.transform("full_target", lambda _, i: (i % 3 + 1).cast("double"))
    return rounded(items(spark, sf).select("item_id", arrays.weighted_quantile(F.col("full_target"), weights, 0.5001).alias("q")), 8)


@query(
    "quantile_columns",
    "SELECT o_orderkey, round(o_totalprice * 0.8, 4) AS q10, o_totalprice AS q50, round(o_totalprice * 1.2, 4) AS q90 FROM orders",
)
def _(spark, sf):
    from stepgrid.sources.series import quantile_columns

    v = F.col("o_totalprice")
    rows = table(spark, sf, "orders").select(
        "o_orderkey", F.round(v * 0.8, 4).alias("lo-80"), F.round(v * 1.2, 4).alias("hi-80"), v.alias("median")
    )
    return rows.select("o_orderkey", *quantile_columns([0.1, 0.5, 0.9]))


@query(
    "random_drop",
    f"""WITH {LONG} SELECT item_id, i, CASE WHEN {HASH.format("item_id, 9, i")} / 1152921504606846976.0 >= 0.3 THEN full_value END AS v FROM long""",
)
def _(spark, sf):
    return exploded(items(spark, sf), arrays.random_drop(F.col("full_target"), 0.3, F.col("item_id"), F.lit(9)), "v")


@query(
    "masked_score",
    f"""WITH {POS}, m AS (SELECT value, value * 0.9 AS p, {HASH.format("subject_id, slot, 4")} / 1152921504606846976.0 < 0.25 AS k FROM pos)
    SELECT round(avg((p - value) * (p - value)), 6) AS mse, round(avg(abs(p - value)), 6) AS mae, count(*) AS n FROM m WHERE k""",
)
def _(spark, sf):
    rows = readings(spark, sf).withColumn("slot", slot()).withColumn("prediction", F.col("value") * 0.9)
    mask = sampling.random_mask(0.25, F.col("subject_id"), F.col("slot"), F.lit(4))
    return rounded(sampling.masked_score(rows, mask, "prediction", "value"))


NORM = f"{LONG}, st AS (SELECT item_id, avg(value) AS loc, stddev_pop(value) AS sd, last(full_value ORDER BY i) AS lastv, sqrt(var_pop(value) + 1e-5) AS rsd FROM long GROUP BY 1)"


@query(
    "instance_norm",
    f"""WITH {NORM} SELECT item_id, i, round((value - loc) / CASE WHEN sd = 0 THEN 1e-5 ELSE sd END, 6) AS z,
      round(asinh((value - loc) / CASE WHEN sd = 0 THEN 1e-5 ELSE sd END), 6) AS za, round(value, 4) AS restored FROM long JOIN st USING (item_id)""",
)
def _(spark, sf):
    stats = arrays.instance_norm(F.col("target"))
    rows = items(spark, sf).withColumns(stats)
    loc, sc = F.col("loc"), F.col("scale")
    rows = rows.withColumn("z", arrays.apply_norm(F.col("target"), loc, sc)).withColumn("za", arrays.apply_norm(F.col("target"), loc, sc, True))
    rows = rows.withColumn("back", arrays.invert_norm(F.col("za"), loc, sc, True))
    out = rows.select("item_id", F.posexplode(F.arrays_zip("z", "za", "back")).alias("i", "r"))
    return out.select(
        "item_id", F.col("i").cast("bigint").alias("i"), r6("r.z").alias("z"), r6("r.za").alias("za"), F.round("r.back", 4).alias("restored")
    )


@query(
    "instance_norm_last",
    f"WITH {NORM} SELECT item_id, i, round((full_value - lastv) / rsd2, 6) AS z FROM long JOIN (SELECT item_id, lastv, sqrt(var_pop(full_value) + 1e-5) AS rsd2 FROM long JOIN st USING (item_id) GROUP BY 1, 2) USING (item_id)",
)
def _(spark, sf):
    stats = arrays.instance_norm(F.col("full_target"), center="last", root_eps=True)
    rows = items(spark, sf).withColumns(stats)
    return rounded(exploded(rows, arrays.apply_norm(F.col("full_target"), F.col("loc"), F.col("scale")), "z"))


@query(
    "covariate_maps",
    f"WITH {ARR} SELECT item_id, n AS n_past, round(list_sum(full_target), 6) AS sum_past, round(coalesce(list_sum(target), 0), 6) AS sum_gappy FROM arr",
)
def _(spark, sf):
    rows = items(spark, sf).withColumn("past", arrays.covariate_map(["load", "gappy"], ["full_target", "target"]))
    load, gappy = F.col("past")["load"], F.col("past")["gappy"]
    return rounded(rows.select("item_id", F.size(load).cast("bigint").alias("n_past"), total(load).alias("sum_past"), total(gappy).alias("sum_gappy")))
