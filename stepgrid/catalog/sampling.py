"""Seeded sampling and the latest-context stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from stepgrid.catalog.base import KEYS, POS, READINGS, SPEC, query, readings, rounded, slot, table
from stepgrid.operators import sampling, windows
from stepgrid.session import fresh_path
from stepgrid.streaming.latest import latest_stream

HASH = "CAST('0x' || substr(md5(concat_ws('|', {})), 1, 15) AS BIGINT)"
OK = f"""{POS}, l AS (SELECT *, lead(slot, 5) OVER w AS last, value + lead(value) OVER w + lead(value, 2) OVER w + lead(value, 3) OVER w AS sx, lead(value, 4) OVER w + lead(value, 5) OVER w AS sy
  FROM pos WINDOW w AS (PARTITION BY dataset, subject_id ORDER BY slot)),
win AS (SELECT dataset, subject_id, pos AS window_start, slot AS start_slot, round(sx, 6) AS sum_context, round(sy, 6) AS sum_target FROM l WHERE last = slot + 5)"""


def sums(windows):
    """Start and sums of both parts of gathered windows."""
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v)
    return rounded(windows.withColumns({"start_slot": slot("start_ts"), "sum_context": total("context"), "sum_target": total("target")}).drop("start_ts", "context", "target"))


@query(
    "sample_windows",
    f"WITH {OK} SELECT * FROM win ORDER BY {HASH.format('dataset, subject_id, window_start, 11')}, dataset, subject_id, window_start LIMIT 500",
)
def _(spark, sf):
    return sums(sampling.sample_window_values(readings(spark, sf), SPEC, 4, 2, 500, 11))


@query(
    "first_ids",
    "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT DISTINCT o_custkey FROM orders ORDER BY 1 LIMIT 100)",
)
def _(spark, sf):
    return sampling.first_ids(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 100)


@query(
    "subject_balanced_sample",
    f"""WITH {OK}, num AS (SELECT *, row_number() OVER (PARTITION BY dataset, subject_id ORDER BY window_start) - 1 AS w, count(*) OVER (PARTITION BY dataset, subject_id) AS n FROM win),
    sub AS (SELECT dataset, subject_id, max(n) AS n, {HASH.format('dataset, subject_id, 0')} AS h FROM num GROUP BY 1, 2), idx AS (SELECT *, row_number() OVER (ORDER BY h % 4096, h, dataset, subject_id) - 1 AS s FROM sub),
    d AS (SELECT draw, {HASH.format('draw, 21')} % (SELECT count(*) FROM sub) AS s, {HASH.format('draw, 22')} AS r FROM (SELECT unnest(range(3000)) AS draw))
    SELECT draw, idx.dataset, idx.subject_id, window_start, start_slot, sum_context, sum_target FROM d JOIN idx USING (s) JOIN num ON num.dataset = idx.dataset AND num.subject_id = idx.subject_id AND num.w = r % idx.n""",
)
def _(spark, sf):
    return sums(sampling.subject_balanced_values(spark, readings(spark, sf), SPEC, 4, 2, 3000, 21))


LENS = f"""{READINGS}, items AS (SELECT dataset || '__' || subject_id AS item_id, count(*) AS n FROM readings GROUP BY dataset, subject_id),
h AS (SELECT item_id, n AS len, {HASH.format('item_id, 5')} AS h FROM items),
line AS (SELECT *, sum(len) OVER (ORDER BY h % 4096, h, item_id ROWS UNBOUNDED PRECEDING) - len AS a, row_number() OVER (ORDER BY h % 4096, h, item_id) - 1 AS k FROM h),
d AS (SELECT draw, {HASH.format('draw, 5')} / 1152921504606846976.0 AS u FROM (SELECT unnest(range(2000)) AS draw))"""


def lengths(spark, sf):
    """Readings per series; no array is built to measure it."""
    counts = readings(spark, sf).groupBy(*KEYS).agg(F.count("*").alias("length"))
    return counts.select(F.concat_ws("__", *KEYS).alias("item_id"), "length")


@query(
    "length_proportional_sample",
    f"WITH {LENS} SELECT draw, item_id FROM d JOIN line ON floor(u * (SELECT sum(len) FROM h)) >= a AND floor(u * (SELECT sum(len) FROM h)) < a + len",
)
def _(spark, sf):
    return sampling.sample_series(spark, lengths(spark, sf), "item_id", "length", 2000, 5)


@query("uniform_series_sample", f"WITH {LENS} SELECT draw, item_id FROM d JOIN line ON floor(u * (SELECT count(*) FROM h)) = k")
def _(spark, sf):
    return sampling.sample_series(spark, lengths(spark, sf), "item_id", "length", 2000, 5, "uniform")


@query(
    "epoch_sizes",
    f"""WITH {READINGS}, s AS (SELECT dataset, count(DISTINCT subject_id) AS n FROM readings GROUP BY 1)
    SELECT dataset, n AS n_series, CAST(ceil(n * CASE dataset WHEN 'g0' THEN 2.5 WHEN 'g1' THEN 0.3 ELSE 1.0 END) AS BIGINT) AS draws FROM s""",
)
def _(spark, sf):
    return sampling.epoch_sizes(readings(spark, sf).select(*KEYS).distinct(), "dataset", {"g0": 2.5, "g1": 0.3})


# a binomial count is the number of cumulative chances that a uniform reaches
BINOMIAL = """s AS (SELECT *, least(p, 1 - p) AS q FROM drawn),
j AS (SELECT k, n, p, q, u, unnest(range(n - 1)) AS j FROM s WHERE n > 1),
chance AS (SELECT *, exp(lgamma(n) - lgamma(j + 1) - lgamma(n - j) + j * ln(q) + (n - 1 - j) * ln(1 - q)) AS c FROM j),
upto AS (SELECT *, sum(c) OVER (PARTITION BY k ORDER BY j) AS f FROM chance),
hit AS (SELECT k, count(*) FILTER (f <= u) AS x FROM upto GROUP BY 1),
count_of AS (SELECT s.k, s.n, CASE WHEN n = 1 THEN 0 WHEN p <= 0.5 THEN x ELSE n - 1 - x END AS x FROM s LEFT JOIN hit USING (k))"""


@query(
    "random_counts",
    f"""WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
    drawn AS (SELECT *, 0.5 AS p, {HASH.format("k, 2, 'count'")} / 1152921504606846976.0 AS u FROM c), {BINOMIAL}
    SELECT k, n, CAST(1 + {HASH.format('k, 1')} % n AS INTEGER) AS uniform, 1 + x AS binomial FROM count_of""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return rows.select(
        "k",
        "n",
        sampling.random_count("uniform", F.col("n"), F.col("k"), F.lit(1)).alias("uniform"),
        sampling.random_count("binomial", F.col("n"), F.col("k"), F.lit(2)).alias("binomial"),
    )


BETA = ", ".join(HASH.format(f"k, 3, 'beta', {i}") + " / 1152921504606846976.0" for i in range(4))


@query(
    "beta_binomial_counts",
    f"""WITH c AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1),
    drawn AS (SELECT *, list_sort([{BETA}])[2] AS p, {HASH.format("k, 3, 'count'")} / 1152921504606846976.0 AS u FROM c), {BINOMIAL}
    SELECT k, n, 1 + x AS picked FROM count_of""",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    pick = sampling.random_count("beta_binomial", F.col("n"), F.col("k"), F.lit(3), a=2, b=3)
    return rows.select("k", "n", pick.alias("picked"))


@query(
    "stack_other_series",
    f"""WITH {READINGS}, s AS (SELECT dataset, subject_id, {HASH.format('subject_id, 13')} AS h FROM readings GROUP BY 1, 2),
    i AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY h % 4096, h, subject_id) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS n FROM s),
    t AS (SELECT *, 1 + {HASH.format('subject_id, 13')} % least(n, 4) AS take, {HASH.format('subject_id, 14')} % greatest(n - 1, 1) AS turn FROM i),
    p AS (SELECT *, unnest(range(take)) AS slot FROM t), q AS (SELECT *, CASE WHEN slot = 0 THEN i ELSE (i + (turn + slot - 1) % greatest(n - 1, 1) + 1) % n END AS j FROM p)
    SELECT q.dataset, q.subject_id, string_agg(o.subject_id, ',' ORDER BY slot) AS members FROM q JOIN i o ON q.dataset = o.dataset AND q.j = o.i GROUP BY 1, 2""",
)
def _(spark, sf):
    tails = windows.padded_tail(readings(spark, sf), SPEC, 20)  # what is stacked is a window of each series
    out = sampling.stack_others(tails, ["dataset"], "subject_id", "insample", 4, 13)
    return out.select(*KEYS, F.array_join("members", ",").alias("members"))


@query(
    "mixture_sample",
    f"""WITH {READINGS}, s AS (SELECT dataset, subject_id, list(value ORDER BY slot) AS v, count(*) AS len, {HASH.format('subject_id, 31')} AS h FROM readings GROUP BY 1, 2 HAVING count(*) >= 5),
    i AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY h % 4096, h, subject_id) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS n FROM s),
    d AS (SELECT draw, {HASH.format('draw, 31')} / 1152921504606846976.0 AS u, {HASH.format('draw, 32')} AS r, {HASH.format('draw, 33')} AS c FROM (SELECT unnest(range(1500)) AS draw)),
    e AS (SELECT *, CASE WHEN u < 0.5 THEN 'g0' WHEN u < 0.5 + 0.3 THEN 'g1' ELSE 'g2' END AS dataset FROM d),
    f AS (SELECT draw, e.dataset, subject_id, 3 + c % (len - 2 - 3 + 1) AS cut, v, len FROM e JOIN i ON e.dataset = i.dataset AND i.i = r % i.n)
    SELECT draw, dataset, subject_id, CAST(cut AS INTEGER) AS cut, round(list_sum(v[greatest(cut - 7, 1):cut]), 6) AS sum_past, round(list_sum(v[cut + 1:cut + 2]), 6) AS sum_future FROM f""",
)
def _(spark, sf):
    shares = {"g0": 0.5, "g1": 0.3, "g2": 0.2}
    out = sampling.mixture_sample(spark, readings(spark, sf), SPEC, "dataset", "subject_id", shares, 1500, 31, 3, 8, 2)

    def total(c):
        return F.aggregate(c, F.lit(0.0), lambda a, v: a + v)

    return rounded(out.select("draw", *KEYS, "cut", total("past").alias("sum_past"), total("future").alias("sum_future")))


@query(
    "shuffle_rows",
    f"SELECT c_custkey, c_name FROM customer ORDER BY {HASH.format('c_custkey, 2')}, c_custkey",
)
def _(spark, sf):
    return sampling.shuffle_rows(table(spark, sf, "customer").select("c_custkey", "c_name"), ["c_custkey"], 2)


@query(
    "latest_stream",
    f"""WITH {POS}, l AS (SELECT *, lag(slot, 3) OVER w AS s3, lag(value) OVER w AS x2, lag(value, 2) OVER w AS x1, lag(value, 3) OVER w AS x0
      FROM pos WINDOW w AS (PARTITION BY dataset, subject_id ORDER BY slot)),
    r AS (SELECT *, row_number() OVER (PARTITION BY dataset, subject_id ORDER BY slot DESC) AS r FROM l WHERE s3 = slot - 3)
    SELECT dataset, subject_id, slot AS last_slot, x0, x1, x2, value AS x3 FROM r WHERE r = 1""",
)
def _(spark, sf):
    """The stream over finished readings ends at the batch answer."""
    source, sink = fresh_path(spark, "stream-in"), fresh_path(spark, "stream-out")
    readings(spark, sf).write.parquet(source)
    stream = spark.readStream.schema("subject_id string, value double, ts timestamp, dataset string").parquet(source)
    job = (
        latest_stream(stream, SPEC, 4, "3650 days")
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", fresh_path(spark, "stream-state"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    out = spark.read.parquet(sink)
    newest = out.groupBy(*KEYS).agg(F.max_by("context", "last_us").alias("c"), F.max("last_us").alias("us"))
    day = F.floor(F.col("us") / 86_400_000_000).cast("bigint")
    return newest.select(*KEYS, day.alias("last_slot"), *[F.element_at("c", i + 1).alias(f"x{i}") for i in range(4)])
