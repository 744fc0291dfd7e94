"""Paired significance tests and multiple-testing correction."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepgrid.operators.ranks import average_ranks

EXACT_LIMIT = 50


def collapse_duplicates(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One row per (method, participant): the mean of duplicates."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def pair_methods(scores: DataFrame, by: list[str], participant: list[str], method: str, value: str) -> DataFrame:
    """Every pair of methods per participant, first name before second.

    Scores are unique per (method, participant), so a participant gathers one
    entry per method and its pairs come from one shuffle, without a self-join.
    """
    keys = [*by, *participant]
    entry = F.struct(F.col(method).alias("m"), F.col(value).alias("v"))
    held = scores.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    first = held.select(*keys, "_s", F.posexplode("_s").alias("_i", "_a"))
    later = F.explode(F.slice("_s", F.col("_i") + 2, F.size("_s"))).alias("_b")
    pairs = first.select(*keys, "_a", later)
    return pairs.select(
        *keys,
        F.col("_a.m").alias("method_a"),
        F.col("_b.m").alias("method_b"),
        F.col("_a.v").alias("value_a"),
        F.col("_b.v").alias("value_b"),
    )


def wilcoxon_counts(spark: SparkSession, limit: int = EXACT_LIMIT) -> DataFrame:
    """Share of sign patterns with W+ <= w for n = 1..limit: (n, w, cdf).

    About 22,000 rows for 50, from the subset-sum recurrence.
    """
    rows, ways = [], [1]
    for n in range(1, limit + 1):
        ways = [
            (ways[w] if w < len(ways) else 0) + (ways[w - n] if 0 <= w - n < len(ways) else 0)
            for w in range(n * (n + 1) // 2 + 1)
        ]
        total, run = 2**n, 0
        for w, c in enumerate(ways):
            run += c
            rows.append((n, w, run / total))
    return spark.createDataFrame(pd.DataFrame(rows, columns=["n", "w", "cdf"]), "n bigint, w bigint, cdf double")


def two_sided_p(z: Column) -> Column:
    """Two-sided normal tail. Spark has no erfc; this sees one row per test."""

    @F.pandas_udf("double")
    def tail(values: pd.Series) -> pd.Series:
        return values.map(lambda v: math.erfc(abs(v) / math.sqrt(2.0)), na_action="ignore")

    return tail(z)


def paired_wilcoxon(pairs: DataFrame, by: list[str], tol: float = 1e-8) -> DataFrame:
    """Two-sided signed-rank test per method pair.

    Zero differences are dropped from the ranks. Fewer than two pairs give a
    null p, all differences near zero give 1. Exact for up to 50 untied
    non-zero differences, else the normal approximation with tie correction.
    """
    keys = [*by, "method_a", "method_b"]
    diffs = pairs.withColumn("d", F.col("value_a") - F.col("value_b")).withColumn("_abs", F.abs("d"))
    # one row per distinct size carries all the sums, ranked or not
    ranked = average_ranks(
        diffs,
        keys,
        "_abs",
        F.count_if(F.col("d") != 0),
        [F.count("*").alias("_n"), F.sum("d").alias("_sum"), F.count_if(F.col("d") > 0).alias("_pos")],
    )
    t = F.col("ties")
    out = ranked.groupBy(*keys).agg(
        F.sum("_n").alias("n_pairs"),
        (F.sum("_sum") / F.sum("_n")).alias("mean_diff"),
        F.max("_abs").alias("_top"),
        F.sum(F.col("_n") - t).alias("_zeros"),
        F.sum(t).alias("n_used"),
        F.sum(F.when(t > 0, F.col("avg_rank") * F.col("_pos"))).alias("w_plus"),
        F.sum(t * t * t - t).alias("_tie"),
    )
    n = F.col("n_used").cast("double")
    se = F.sqrt((n * (n + 1) * (2 * n + 1) - F.col("_tie") / 2) / 24)
    out = out.withColumn("z", F.try_divide(F.col("w_plus") - n * (n + 1) / 4, se))
    table = wilcoxon_counts(pairs.sparkSession)
    low = F.least(F.col("w_plus"), n * (n + 1) / 2 - F.col("w_plus"))
    exact = (F.col("n_used") <= EXACT_LIMIT) & (F.col("_tie") == 0) & (F.col("_zeros") == 0)
    out = out.withColumn("n", F.when(exact, F.col("n_used"))).withColumn("w", F.when(exact, low).cast("bigint"))
    out = out.join(F.broadcast(table), ["n", "w"], "left")
    p = (
        F.when(F.col("n_pairs") < 2, F.lit(None).cast("double"))
        .when(F.col("_top") <= tol, 1.0)
        .when(F.col("cdf").isNotNull(), F.least(F.lit(1.0), 2 * F.col("cdf")))
        .otherwise(two_sided_p(F.col("z")))
    )
    mean_diff = F.when(F.col("n_pairs") >= 2, F.col("mean_diff"))
    return out.withColumn("p_value", p).withColumn("mean_diff", mean_diff).drop("_top", "_zeros", "_tie", "n", "w", "cdf")


def benjamini_hochberg(tests: DataFrame, by: list[str], p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Adjusted p within a group; a null p stays null.

    A group holds the tests of one protocol, one per pair of methods, so its
    windows are small and the tests are computed once.
    """
    up = Window.partitionBy(*by).orderBy(F.col(p).asc_nulls_last())
    down = Window.partitionBy(*by).orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = tests.withColumn("_rank", F.row_number().over(up)).withColumn("_m", F.count(p).over(Window.partitionBy(*by)))
    best = F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down)
    adjusted = F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), best))
    out = ranked.withColumn("p_adj_bh", adjusted).drop("_rank", "_m")
    return out.withColumn("significant", F.coalesce(F.col("p_adj_bh") < alpha, F.lit(False)))


def method_matrix(tests: DataFrame, by: list[str], methods: list[str], value: str, diagonal: float) -> DataFrame:
    """Symmetric method x method table of one test column."""
    both = tests.select(*by, "method_a", "method_b", value).unionByName(
        tests.select(*by, F.col("method_b").alias("method_a"), F.col("method_a").alias("method_b"), value)
    )
    cells = [
        F.when(F.col("method_a") == m, F.lit(diagonal)).otherwise(F.max(F.when(F.col("method_b") == m, F.col(value)))).alias(m)
        for m in methods
    ]
    return both.groupBy(*by, "method_a").agg(*cells).withColumnRenamed("method_a", "method")
