"""Numbering, prefix sums, ranks and exact quantiles without one big task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepgrid.functions.hashing import BITS, seeded_hash
from stepgrid.session import settle

BUCKETS = 4096


def prefix_by_hash(df: DataFrame, keys: list[str], amount: Column, out: str, seed: int = 0, within: list[str] | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Exclusive prefix sum of ``amount`` in a seeded hash order of ``keys``.

    Rows fall into hash buckets; bucket totals (a fixed number of rows) are
    summed first, so no window sees more than one bucket. ``within`` restarts
    the sum per group.
    """
    within = within or []
    rows = df.withColumn("_a", amount).withColumn("_h", seeded_hash(*[F.col(k) for k in keys], F.lit(seed)))
    rows = rows.withColumn("_b", F.pmod("_h", F.lit(buckets)))
    w = Window.partitionBy(*within, "_b").orderBy("_h", *keys).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*within, "_b").agg(F.sum("_a").alias("_t"))
    before = Window.partitionBy(*within).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    rows = rows.withColumn(out, F.sum("_a").over(w) - F.col("_a"))
    return rows.join(offsets, [*within, "_b"]).withColumn(out, F.col(out) + F.col("_o")).drop("_a", "_h", "_b", "_o")


def dense_index(df: DataFrame, keys: list[str], out: str, seed: int = 0, within: list[str] | None = None) -> DataFrame:
    """Number distinct keys 0..n-1 in a seeded random order."""
    numbered = prefix_by_hash(df, keys, F.lit(1), out, seed, within)
    return numbered.withColumn(out, F.col(out).cast("bigint"))


def index_in_order(df: DataFrame, groups: list[str], order: str, width: int, out: str) -> DataFrame:
    """Number rows 0..n-1 per group by an integer column of unique values.

    Value ranges of ``width`` hold at most ``width`` rows each.
    """
    rows = df.withColumn("_b", ((F.col(order) - F.pmod(order, F.lit(width))) / width).cast("bigint"))
    counts = rows.groupBy(*groups, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    local = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy(order)) - 1
    return rows.withColumn(out, local).join(offsets, [*groups, "_b"]).withColumn(out, F.col(out) + F.col("_o")).drop("_b", "_o")


def value_bucket(v: Column, per_octave: int = 64) -> Column:
    """Order-keeping integer bucket of a number, about 1 % wide."""
    size = F.floor(F.log2(F.abs(v)) * per_octave) + 1100 * per_octave
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("bigint")


def average_ranks(
    df: DataFrame, groups: list[str], value: str, ties: Column | None = None, extra: list[Column] | None = None
) -> DataFrame:
    """Distinct values per group with count and average rank.

    Ties are counted before the shuffle; ranks come from counts per value
    bucket, so a large group is ranked by many tasks. ``ties`` may leave rows
    out of the ranking; ``extra`` aggregates ride along.
    """
    count = F.count("*") if ties is None else ties
    counts = df.groupBy(*groups, value).agg(count.alias("ties"), *(extra or [])).withColumn("_b", value_bucket(F.col(value)))
    per_bucket = counts.groupBy(*groups, "_b").agg(F.sum("ties").alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.withColumn("_o", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    upto = Window.partitionBy(*groups, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("_c", F.sum("ties").over(upto)).join(offsets, [*groups, "_b"])
    rank = F.col("_o") + F.col("_c") - F.col("ties") + (F.col("ties") + 1) / 2
    return rows.withColumn("avg_rank", rank).drop("_b", "_c", "_o")


PARTS = 1024  # slots that a range of values is counted in, per pass


def quantile_table(df: DataFrame, value: str, level: float) -> DataFrame:
    """Exact linear-interpolation quantile of a whole column, as a table of one row ``quantile``.

    Selection by counting: values fall into slots of about 1 % of their size,
    the slots of the two wanted ranks are cut into ``PARTS`` equal ones, and so
    on until each holds a single value (six passes at most, as doubles are
    evenly spaced in such a slot). A pass is one aggregate with map-side
    counts; the two rows (rank, range) it leaves are written and steer the
    next. No value comes to the driver. Infinite values are counted apart; null
    and NaN are left out; without values the quantile is null. Settle an
    expensive input first.
    """
    infinite = float("inf")
    rows = df.select(F.col(value).cast("double").alias("v")).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    # adding 0.0 makes the two zeros one
    finite = rows.filter(F.abs("v") < infinite).select((F.col("v") + 0.0).alias("v"))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if(F.col("v") == -infinite).alias("below"), F.count_if(F.col("v") == infinite).alias("above"))
    at = F.lit(level) * (F.col("n") - 1)
    ranks = F.explode(F.array(F.struct(F.lit(0).alias("id"), F.floor(at).alias("k")), F.struct(F.lit(1).alias("id"), F.least(F.floor(at) + 1, F.col("n") - 1).alias("k"))))
    wanted = sizes.where("n > 0").withColumn("r", ranks).select("r.id", "r.k", "n", "below", "above", (at - F.floor(at)).alias("share"))
    wanted = settle(wanted, "quantile")
    state = wanted.where("k >= below AND k < n - above").select("id", (F.col("k") - F.col("below")).alias("k"))

    slots = finite.groupBy(value_bucket(F.col("v")).alias("slot")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    slots = settle(slots, "quantile")  # as many rows as there are magnitudes, at most 2100 octaves of 64
    listed = slots.agg(F.array_sort(F.collect_list(F.struct("slot", "n", "lo", "hi")))).scalar()
    state = settle(_chosen(state.withColumn("slots", listed)), "quantile")
    while not state.where("lo < hi").isEmpty():
        ranges = state.agg(F.collect_list(F.struct("id", "lo", "hi"))).scalar()
        hit = F.explode(F.filter("ranges", lambda s: (F.col("v") >= s["lo"]) & (F.col("v") <= s["hi"])))
        width = F.col("s.hi") / PARTS - F.col("s.lo") / PARTS
        slot = F.when(width > 0, F.least(F.lit(PARTS - 1), F.floor((F.col("v") - F.col("s.lo")) / width))).otherwise(F.lit(0))
        # in a range too narrow to cut, its two ends are apart
        slot = F.when(width > 0, slot).otherwise((F.col("v") > F.col("s.lo")).cast("bigint"))
        counts = finite.withColumn("ranges", ranges).select("v", hit.alias("s")).groupBy(F.col("s.id").alias("id"), slot.alias("slot"))
        counts = counts.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        counts = counts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", "n", "lo", "hi"))).alias("slots"))  # PARTS at most
        state = settle(_chosen(state.select("id", "k").join(counts, "id")), "quantile")
    found = wanted.join(state.select("id", F.col("lo").alias("v")), "id", "left")
    found = found.withColumn("v", F.when(F.col("k") < F.col("below"), -infinite).when(F.col("k") >= F.col("n") - F.col("above"), infinite).otherwise(F.col("v")))
    low, high, share = F.max(F.when(F.col("id") == 0, F.col("v"))), F.max(F.when(F.col("id") == 1, F.col("v"))), F.max("share")
    return found.agg(F.when((low == high) | (share == 0), low).otherwise(low + (high - low) * share).alias("quantile"))


def _chosen(state: DataFrame) -> DataFrame:
    """For each rank the slot that holds it, and the rank inside: ``id, k, lo, hi``."""
    start = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("bigint").alias("k"))

    def step(acc: Column, s: Column) -> Column:
        here = acc["k"].isNull() & (F.col("k") < acc["before"] + s["n"])
        taken = F.struct(acc["before"].alias("before"), s["lo"].alias("lo"), s["hi"].alias("hi"), (F.col("k") - acc["before"]).alias("k"))
        passed = F.struct((acc["before"] + s["n"]).alias("before"), acc["lo"].alias("lo"), acc["hi"].alias("hi"), acc["k"].alias("k"))
        return F.when(here, taken).otherwise(passed)

    return state.withColumn("c", F.aggregate("slots", start, step)).select("id", F.col("c.k").alias("k"), F.col("c.lo").alias("lo"), F.col("c.hi").alias("hi"))


def exact_quantile(df: DataFrame, value: str, level: float) -> float:
    """The number of :func:`quantile_table`, for a caller that needs it at once."""
    found = quantile_table(df, value, level).first()["quantile"]
    if found is None:
        raise ValueError("no values")
    return found


def number_in_order(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Number rows 0..n-1 by the given columns, rising, which must tell all rows apart.

    Rows are dealt to ranges and written, so that borders stay as they are;
    each range is numbered on its own and moved by the rows of the ranges
    before it, of which there are as many as shuffle partitions.
    """
    names = [f"_o{i}" for i in range(len(order))]
    dealt = df.withColumns(dict(zip(names, order))).repartitionByRange(*[F.col(n) for n in names])
    dealt = settle(dealt.withColumn("_p", F.spark_partition_id()), "ordered")
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    every = sizes.agg(F.collect_list(F.struct("_p", "_n"))).scalar()
    before = F.aggregate(F.filter("_every", lambda s: s["_p"] < F.col("_p")), F.lit(0).cast("bigint"), lambda acc, s: acc + s["_n"])
    starts = sizes.withColumn("_every", every).select("_p", before.alias("_before"))
    rows = dealt.withColumn(out, F.row_number().over(Window.partitionBy("_p").orderBy(*names)) - 1)
    rows = rows.join(F.broadcast(starts), "_p")
    return rows.withColumn(out, F.col(out) + F.col("_before")).drop("_p", "_before", *names)


def smallest(df: DataFrame, order: Column, n: int, ties: list[str], bits: int = 16) -> DataFrame:
    """Exactly the n rows of smallest seeded-hash ``order``, never sorted whole.

    Rows are counted by the top bits; the buckets below the cut are kept as
    they are and only the bucket on the cut is ranked.
    """
    rows = df.withColumn("_h", order).withColumn("_b", F.shiftright("_h", BITS - bits))
    counts = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    # 2^bits rows at most
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter(F.col("_before") < n)
    plan = plan.withColumn("_take", F.least(F.col("_n"), n - F.col("_before")))
    kept = rows.join(F.broadcast(plan.drop("_before")), "_b")
    whole = kept.filter("_take = _n")
    cut = kept.filter("_take < _n").withColumn(
        "_r", F.row_number().over(Window.partitionBy("_b").orderBy("_h", *ties))
    )
    cut = cut.filter("_r <= _take").drop("_r")
    return whole.unionByName(cut).drop("_h", "_b", "_n", "_take")
