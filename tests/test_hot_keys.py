"""Joins and picks with one key holding a third of the rows or more."""

from collections import Counter

from pyspark.sql import functions as F

from stepgrid.operators import clean, ranks, rollup
from stepgrid.series import SALTS, row_salt, spread_join


def hot(spark, n=6000):
    """A third of all rows under key 0, the rest over 200 keys, a few null."""
    key = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 997 == 1, None).otherwise(1 + F.col("id") % 200)
    return spark.range(n).select(key.cast("int").alias("k"), F.col("id").alias("v"))


def test_spread_join_equals_join(spark):
    df = hot(spark)
    stats = df.filter("k < 150").groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        want = Counter(map(tuple, df.join(stats, ["k"], how).select("k", "v", "n").collect()))
        got = Counter(map(tuple, spread_join(df, stats, ["k"], how=how).select("k", "v", "n").collect()))
        assert got == want


def test_hot_key_is_split(spark):
    df = hot(spark)
    parts = df.withColumn("s", row_salt(df, ["k"])).filter("k = 0").groupBy("s").count().collect()
    assert len(parts) == SALTS
    assert max(r["count"] for r in parts) < 2000 / SALTS * 3


def test_keep_series_by_length_and_share(spark):
    df = hot(spark).filter("k is not null").withColumn("x", F.when(F.col("v") % 4 > 0, F.col("v")))
    kept = clean.keep_series(df, ["k"], 100, "x", 0.5)
    counts = {r.k: (r.n, r.bad) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("bad")).collect()}
    want = {k for k, (n, bad) in counts.items() if n >= 100 and bad / n <= 0.5}
    assert {r.k for r in kept.select("k").distinct().collect()} == want and 0 in want
    assert kept.count() == sum(counts[k][0] for k in want)


def test_dimension_join_keeps_unmatched_and_null(spark):
    df = hot(spark)
    dim = spark.createDataFrame([(0, "a"), (5, "b")], "k int, name string")
    spread = rollup.attach_dimension(df, dim, ["k"])
    small = rollup.attach_dimension(df, dim, ["k"], dim_rows=2)
    assert Counter(map(tuple, spread.collect())) == Counter(map(tuple, small.collect()))
    assert spread.count() == 6000
    assert rollup.unmapped_keys(df.filter("k in (0, 5, 7)"), dim, ["k"]).first().k == 7


def test_index_in_order_of_a_hot_group(spark):
    df = hot(spark).filter("k is not null")
    rows = ranks.index_in_order(df, ["k"], "v", 256, "i").filter("k = 0").orderBy("v").collect()
    assert [r.i for r in rows] == list(range(2000))


def test_ranks_of_a_hot_group(spark):
    df = hot(spark).filter("k is not null").withColumn("x", F.col("v") % 50 - 25)
    got = {r.x: (r.ties, r.avg_rank) for r in ranks.average_ranks(df, ["k"], "x").filter("k = 0").collect()}
    values = sorted(v % 50 - 25 for v in range(0, 6000, 3))
    for x in set(values):
        first, n = values.index(x), values.count(x)
        assert got[x] == (n, first + (n + 1) / 2)
