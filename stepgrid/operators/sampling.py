"""Seeded sampling. Draws are rows of ``spark.range`` that meet what they pick
in an equi-join, so a draw never scans a group."""

from __future__ import annotations

import math
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepgrid.functions.draws import beta, binomial
from stepgrid.functions.hashing import hash_below, hash_unit, seeded_hash
from stepgrid.operators.ranks import BUCKETS, dense_index, index_in_order, prefix_by_hash, smallest
from stepgrid.operators.windows import between, chunk_arrays, chunk_width, gather_windows, window_index
from stepgrid.series import SeriesSpec, spread_join
from stepgrid.session import settle


def sample_windows(windows: DataFrame, keys: list[str], n: int, seed: int) -> DataFrame:
    """At most n windows, uniform, the same for the same seed."""
    order = seeded_hash(*[F.col(k) for k in keys], F.lit(seed))
    return smallest(windows, order, n, keys)


def first_ids(df: DataFrame, key: str, n: int) -> DataFrame:
    """All rows of the first n ids in sort order. Only distinct ids are
    ordered, and each task keeps n of them."""
    ids = df.select(key).distinct().orderBy(key).limit(n)
    return df.join(ids, key, "left_semi")


def subject_balanced_sample(spark: SparkSession, windows: DataFrame, spec: SeriesSpec, n: int, seed: int) -> DataFrame:
    """Uniform subject, then uniform window of it, n times with replacement."""
    keys = list(spec.keys)
    numbered = index_in_order(windows, keys, "window_start", spec.chunk_steps, "_w")
    subjects = dense_index(windows.groupBy(*keys).agg(F.count("*").alias("_n")), keys, "_s")
    total = subjects.agg(F.count("*").alias("k")).scalar()
    draws = spark.range(n).withColumnRenamed("id", "draw")
    draws = draws.withColumn("_s", F.pmod(seeded_hash(F.col("draw"), F.lit(seed)), total))
    picked = draws.join(subjects, "_s").withColumn("_w", F.pmod(seeded_hash(F.col("draw"), F.lit(seed + 1)), F.col("_n")))
    return picked.drop("_s", "_n").join(numbered, [*keys, "_w"]).drop("_w")


def sample_window_values(
    df: DataFrame, spec: SeriesSpec, context: int, horizon: int, n: int, seed: int, stride: int = 1, limit: timedelta | None = None
) -> DataFrame:
    """At most n windows with their values, uniform over all windows of a table.

    Windows are drawn from their index; only readings of drawn windows are
    gathered.
    """
    index = window_index(df, spec, context + horizon, stride, limit)
    picked = settle(sample_windows(index, [*spec.keys, "window_start"], n, seed), "drawn")
    return gather_windows(df, spec, picked, context, horizon)


def subject_balanced_values(
    spark: SparkSession, df: DataFrame, spec: SeriesSpec, context: int, horizon: int, n: int, seed: int, stride: int = 1, limit: timedelta | None = None
) -> DataFrame:
    """n draws of a uniform subject and a uniform window of it, with the values.

    A window drawn several times is gathered once.
    """
    index = settle(window_index(df, spec, context + horizon, stride, limit), "window-index")
    draws = settle(subject_balanced_sample(spark, index, spec, n, seed), "drawn")
    values = gather_windows(df, spec, draws, context, horizon)
    return draws.drop("start_us", "end_us").join(values, [*spec.keys, "window_start"])


def sample_series(spark: SparkSession, series: DataFrame, key: str, length: str, n: int, seed: int, how: str = "proportional") -> DataFrame:
    """n draws of series, 'uniform' or 'proportional' to their length; none from an empty table.

    A draw is a position on the line of all lengths laid end to end in hash
    order. The borders of the hash partitions (at most ``BUCKETS``) route a
    draw to its partition; partitions longer than the mean are cut into parts
    of that length, so that neither many series nor a long one fills a task.
    In a part series and draws are merged in order: a draw takes the last
    series that begins before it.
    """
    amount = F.lit(1).cast("bigint") if how == "uniform" else F.col(length).cast("bigint")
    lines = series.select(key, amount.alias("_len")).filter("_len > 0")
    lines = prefix_by_hash(lines, [key], F.col("_len"), "_from", seed)
    bucket = F.pmod(seeded_hash(F.col(key), F.lit(seed)), F.lit(BUCKETS))
    lines = settle(lines.withColumn("_b", bucket), "lines")
    borders = lines.groupBy("_b").agg(F.min("_from").alias("_o"), F.sum("_len").alias("_t"))
    total = borders.agg(F.sum("_t")).scalar()
    starts = borders.agg(F.array_sort(F.collect_list(F.struct("_o", "_b")))).scalar()
    part = F.greatest(F.lit(1), F.ceil(total / BUCKETS))

    cut = lambda at: F.floor((at - F.col("_o")) / part)
    listed = lines.join(F.broadcast(borders.select("_b", "_o")), "_b")
    listed = listed.withColumn("_part", F.explode(F.sequence(cut(F.col("_from")), cut(F.col("_from") + F.col("_len") - 1))))
    series_rows = listed.select("_b", "_part", F.col("_from").alias("_at"), F.lit(None).cast("bigint").alias("draw"), key)

    draws = spark.range(n).select(F.col("id").alias("draw"), F.floor(hash_unit(F.col("id"), F.lit(seed)) * total).alias("_at"), starts.alias("_starts"))
    # binary search: the last border at or before the position
    halves = F.array(*[F.lit(1 << k) for k in range(BUCKETS.bit_length() - 1, -1, -1)])
    found = F.aggregate(halves, F.lit(0), lambda at, half: F.when(F.get("_starts", at + half - 1)["_o"] <= F.col("_at"), at + half).otherwise(at))
    draws = draws.where("_at IS NOT NULL").withColumn("_s", F.get("_starts", found - 1))
    draws = draws.select("draw", "_at", F.col("_s._b").alias("_b"), F.col("_s._o").alias("_o"))
    draw_rows = draws.select("_b", cut(F.col("_at")).alias("_part"), "_at", "draw", F.lit(None).cast(lines.schema[key].dataType).alias(key))

    order = Window.partitionBy("_b", "_part").orderBy("_at", F.col("draw").isNotNull())
    begins = F.when(F.col("draw").isNull(), F.struct(F.col(key).alias("key")))
    merged = series_rows.union(draw_rows).withColumn("_hit", F.last(begins, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return merged.where("draw IS NOT NULL").select("draw", F.col("_hit.key").alias(key))


def epoch_size(n_series: int, weight: float) -> int:
    """Draws per epoch of a dataset with a multiplier."""
    return math.ceil(n_series * weight)


def epoch_sizes(series: DataFrame, dataset: str, weights: dict[str, float], default: float = 1.0) -> DataFrame:
    """Series and draws per epoch of each dataset, by its multiplier."""
    weight = F.lit(default)
    for name, w in weights.items():
        weight = F.when(F.col(dataset) == name, w).otherwise(weight)
    counts = series.groupBy(dataset).agg(F.count("*").alias("n_series"))
    return counts.withColumn("draws", F.ceil(F.col("n_series") * weight))


def random_count(kind: str, n: Column, *seeds: Column, p: float = 0.5, a: int = 1, b: int = 1) -> Column:
    """1..n: 'uniform', 'binomial' (one plus binomial(n - 1, p)) or
    'beta_binomial' with p from a Beta(a, b) of whole a and b. No draw takes
    more space for a larger n (see ``functions.draws``)."""
    if kind == "uniform":
        return 1 + hash_below(n, *seeds)
    chance = beta(a, b, *seeds) if kind == "beta_binomial" else F.lit(p)
    return 1 + binomial(n.cast("bigint") - 1, chance, *seeds)


def stack_others(series: DataFrame, group: list[str], key: str, values: str, max_series: int, seed: int) -> DataFrame:
    """Each series with a random number of others of its set, as arrays.

    The arrays are written once; numbers, sizes and picks come from the keys
    alone, and the picked arrays are met at the end by an equi-join. At most
    ``max_series`` arrays come together in one row.
    """
    stored = settle(series.select(*group, key, values), "stacked")
    numbered = settle(dense_index(stored.select(*group, key), [key], "_i", seed, within=group), "numbers")
    sizes = numbered.groupBy(*group).agg(F.count("*").alias("_n"))
    own = spread_join(numbered, sizes, group)
    take = random_count("uniform", F.least(F.col("_n").cast("int"), F.lit(max_series)), F.col(key), F.lit(seed))
    # slot 0 is the series itself, further slots step on by distinct strides
    picks = own.select(*group, key, "_n", F.col("_i").alias("_me"), F.explode(F.sequence(F.lit(0), take - 1)).alias("_slot"))
    turn = F.pmod(seeded_hash(F.col(key), F.lit(seed + 1)), F.greatest(F.col("_n") - 1, F.lit(1)))
    step = F.pmod(turn + F.col("_slot") - 1, F.greatest(F.col("_n") - 1, F.lit(1))) + 1
    picks = picks.withColumn("_i", F.when(F.col("_slot") == 0, F.col("_me")).otherwise(F.pmod(F.col("_me") + step, F.col("_n"))))
    met = picks.join(numbered.select(*group, "_i", F.col(key).alias("_k")), [*group, "_i"])
    met = met.join(stored.select(*group, F.col(key).alias("_k"), F.col(values).alias("_v")), [*group, "_k"])
    rows = met.groupBy(*group, key).agg(F.array_sort(F.collect_list(F.struct("_slot", "_k", "_v"))).alias("_r"))
    return rows.select(*group, key, F.col("_r._k").alias("members"), F.col("_r._v").alias("stacked"))


def mixture_sample(
    spark: SparkSession, df: DataFrame, spec: SeriesSpec, dataset: str, key: str, probabilities: dict[str, float], n: int, seed: int, min_past: int, context: int, horizon: int
) -> DataFrame:
    """Draw a dataset by probability, a series of it, then a cut with at
    least ``min_past`` values before it and a full horizon after it.

    Series are drawn by their lengths; a draw then meets the one chunk of its
    series that holds the window around the cut.
    """
    lengths = df.groupBy(dataset, key).agg(F.count("*").alias("_len")).filter(F.col("_len") >= min_past + horizon)
    numbered = dense_index(lengths, [key], "_i", seed, within=[dataset])
    sizes = numbered.groupBy(dataset).agg(F.count("*").alias("_n"))
    total, run, choice = sum(probabilities.values()), 0.0, None
    u = hash_unit(F.col("draw"), F.lit(seed))
    for name, p in probabilities.items():
        run += p / total
        choice = F.when(u < run, name) if choice is None else choice.when(u < run, name)
    draws = spark.range(n).withColumnRenamed("id", "draw").withColumn(dataset, choice.otherwise(list(probabilities)[-1]))
    picked = spread_join(draws, sizes, [dataset]).withColumn("_i", F.pmod(seeded_hash(F.col("draw"), F.lit(seed + 1)), F.col("_n")))
    rows = picked.join(numbered, [dataset, "_i"])
    room = F.col("_len") - horizon - min_past + 1
    rows = rows.withColumn("cut", min_past + hash_below(room, F.col("draw"), F.lit(seed + 2)))
    chunks, width = chunk_arrays(df, spec, context + horizon), chunk_width(spec, context + horizon)
    rows = rows.withColumn("_c", F.floor((F.col("cut") + horizon - 1) / width))
    rows = rows.join(chunks.withColumn("_c", F.floor(F.col("lo") / width)), [dataset, key, "_c"])
    have = F.least(F.col("cut"), F.lit(context))
    return rows.select(
        "draw",
        dataset,
        key,
        "cut",
        between(F.col("cut") - have, have).alias("past"),
        between(F.col("cut"), F.lit(horizon)).alias("future"),
    )



def shuffle_rows(df: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """A seeded random order: a range-partitioned sort by hash."""
    return df.orderBy(seeded_hash(*[F.col(k) for k in keys], F.lit(seed)), *keys)


def sample_variates(df: DataFrame, keys: list[str], variate: str, most: int, seed: int) -> DataFrame:
    """At most ``most`` variates per series; pruned before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(seeded_hash(*[F.col(k) for k in keys], F.col(variate), F.lit(seed)), variate)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= most).drop("_r")


# Allowed patch sizes (from, up to) by frequency letter.
PATCH_RANGES = {
    "S": (64, 128),
    "T": (32, 128),
    "H": (32, 64),
    "D": (16, 32),
    "B": (16, 32),
    "W": (16, 32),
    "M": (8, 32),
    "Q": (1, 8),
    "Y": (1, 8),
    "A": (1, 8),
}


def patch_size(freq: str, length: str, sizes: list[int], min_patches: int, *seeds: Column) -> Column:
    """A seeded choice among sizes allowed for the frequency and length."""
    out = None
    for letter, (low, high) in PATCH_RANGES.items():
        allowed = [F.lit(s) for s in sizes if low <= s <= high]
        options = F.array(*allowed) if allowed else F.array().cast("array<int>")
        out = F.when(F.col(freq) == letter, options) if out is None else out.when(F.col(freq) == letter, options)
    fit = F.filter(out, lambda s: s <= F.floor(F.col(length) / min_patches))
    return F.when(F.size(fit) > 0, F.get(fit, F.pmod(seeded_hash(*seeds), F.size(fit)).cast("int")))


def random_mask(p: float, *seeds: Column) -> Column:
    """True with probability p, by seeded hash of the row key."""
    return hash_unit(*seeds) < p


def masked_score(df: DataFrame, masked: Column, pred: str, truth: str) -> DataFrame:
    """MSE and MAE over the masked cells only."""
    e = F.when(masked, F.col(pred) - F.col(truth))
    return df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.count(e).alias("n"))


def limit_ids(df: DataFrame, key: str, limit: float) -> DataFrame:
    """Rows of the first ids: ``limit`` is a number above one, or else a share of all ids."""
    n = int(limit) if limit > 1 else int(limit * df.agg(F.count_distinct(key)).first()[0])
    return first_ids(df, key, n)
