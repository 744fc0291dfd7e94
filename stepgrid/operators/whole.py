"""Transforms of whole series, in long form.

A series of any length is cropped, padded, masked, indexed and smoothed without
ever being one array. What a transform needs to know of a series (its length
and its seeded draws) is worked out on a small table of one row per chunk and
joined to the readings' chunks; a crop or a pad is then an interval of places.
Sliding frames count back a number of readings: they are differences of running
sums within chunks of rows that carry a halo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepgrid.functions.hashing import seeded_hash
from stepgrid.series import CHUNK, HOME, T, SeriesSpec, before, chunked, floor_div, in_chunk, in_row_chunk, micros, row_chunks, running, with_position

TOTAL = "_total"  # readings of the series, for the columns that callers give


def chunk_table(df: DataFrame, spec: SeriesSpec, draws: dict[str, Column] | None = None) -> DataFrame:
    """One row per chunk: keys, ``_chunk``, ``_first`` (place of its first reading), ``_here``, ``_total``, and the draws."""
    counts = df.groupBy(*spec.keys, floor_div(micros(spec.ts), spec.chunk_us()).alias(CHUNK)).agg(F.count("*").alias("_here"))
    whole = F.sum("_here").over(Window.partitionBy(*spec.keys))
    out = counts.withColumns({"_first": F.coalesce(F.sum("_here").over(before(spec)), F.lit(0)), TOTAL: whole})
    for name, draw in (draws or {}).items():
        out = out.withColumn(name, draw)
    return out


def placed(df: DataFrame, spec: SeriesSpec, chunks: DataFrame) -> DataFrame:
    """Readings of the given chunks with their place ``pos`` and what the chunk table says."""
    rows = chunked(df, spec).withColumn("_k", F.row_number().over(in_chunk(spec)) - 1)
    rows = rows.join(chunks, [*spec.keys, CHUNK]).withColumn("pos", F.col("_first") + F.col("_k"))
    return rows.drop(T, CHUNK, HOME, "_k", "_first", "_here")


def _below(bound: Column, *seeds: Column) -> Column:
    """Seeded whole number in [0, bound), for bounds of any size."""
    return F.pmod(seeded_hash(*seeds), bound)


def index_rows(df: DataFrame, spec: SeriesSpec, variates: list[str], sample: int = 1) -> DataFrame:
    """One row per reading and variate: ``time_index``, ``variate_index``, ``sample_id`` and ``value``."""
    rows = with_position(df.select(*spec.keys, spec.ts, *[F.col(v).alias(f"_v{i}") for i, v in enumerate(variates)]), spec)
    each = F.array(*[F.struct(F.lit(i).alias("variate_index"), F.col(f"_v{i}").cast("double").alias("value")) for i in range(len(variates))])
    rows = rows.withColumn("_e", F.explode(each))
    return rows.select(*spec.keys, spec.ts, F.col("pos").alias("time_index"), "_e.variate_index", F.lit(sample).alias("sample_id"), "_e.value")


def crop_to_patches(df: DataFrame, spec: SeriesSpec, patch: int, min_patches: int, max_patches: int, *seeds: Column) -> DataFrame:
    """A random run of whole patches of each series, ``pos`` and ``patch`` counted from its start.

    Drawn once per series: an offset below one patch, a number of patches
    within the bounds, the first patch. Series with fewer than ``min_patches``
    are left out. ``seeds`` are columns of the keys. Chunks outside the run are
    dropped before the readings meet it.
    """
    n, low = F.col(TOTAL), F.lit(min_patches)
    draws = {
        "_offset": _below(n % patch + 1, *seeds, F.lit("offset")),
        "_whole": floor_div(n - F.col("_offset"), patch),
        "_most": F.least(F.lit(max_patches), F.col("_whole")),
        "_count": low + _below(F.greatest(F.col("_most") - low + 1, F.lit(1)), *seeds, F.lit("count")),
        "_low": F.col("_offset") + patch * _below(F.greatest(F.col("_whole") - F.col("_count") + 1, F.lit(1)), *seeds, F.lit("first")),
        "_high": F.col("_low") + F.col("_count") * patch,
    }
    chunks = chunk_table(df, spec, draws).where(F.col("_most") >= low)
    chunks = chunks.where("_low < _first + _here AND _high > _first").select(*spec.keys, CHUNK, "_first", "_here", "_low", "_high")
    rows = placed(df, spec, chunks).where("pos >= _low AND pos < _high")
    rows = rows.withColumn("pos", F.col("pos") - F.col("_low"))
    return rows.withColumn("patch", floor_div(F.col("pos"), patch)).drop("_low", "_high")


def pad_short(df: DataFrame, spec: SeriesSpec, minimum: int, *seeds: Column) -> DataFrame:
    """Series of at least ``minimum`` places: missing ones split at random between both ends.

    ``pos`` counts from the first place; a padded place has no timestamp and no
    values (``padded`` true).
    """
    lack = F.greatest(F.lit(minimum) - F.col(TOTAL), F.lit(0))
    chunks = chunk_table(df, spec, {"_lack": lack, "_front": _below(F.col("_lack") + 1, *seeds)})
    rows = placed(df, spec, chunks).withColumn("pos", F.col("pos") + F.col("_front")).drop("_lack", "_front", TOTAL)
    short = chunks.where("_first = 0 AND _lack > 0")
    places = F.filter(F.sequence(F.lit(0).cast("bigint"), F.lit(minimum - 1).cast("bigint")), lambda i: (i < F.col("_front")) | (i >= F.col("_front") + F.col(TOTAL)))
    empty = short.select(*spec.keys, F.explode(places).alias("pos"))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema if f.name not in spec.keys]
    columns = [*df.columns, "pos"]
    pads = empty.select(*spec.keys, *rest, "pos").select(*columns, F.lit(True).alias("padded"))
    return rows.select(*columns, F.lit(False).alias("padded")).union(pads)


def mask_tail(df: DataFrame, spec: SeriesSpec, masked: Column) -> DataFrame:
    """Add ``masked``: true over the last ``masked`` readings of each series.

    ``masked`` is a column of ``_total`` (readings of the series) and the keys,
    worked out once per chunk. Rows that are not masked are what other fields
    are cut to; a field that is never predicted has a mask of false.
    """
    chunks = chunk_table(df, spec, {"_from": F.col(TOTAL) - masked}).select(*spec.keys, CHUNK, "_first", "_here", "_from")
    return placed(df, spec, chunks).withColumn("masked", F.col("pos") >= F.col("_from")).drop("_from")


def random_ratio(low: float, high: float, *seeds: Column) -> Column:
    """For :func:`mask_tail`: a seeded share of the series, at least one reading."""
    share = low + (high - low) * (seeded_hash(*seeds) / float(1 << 60))
    return F.greatest(F.lit(1), F.round(share * F.col(TOTAL)).cast("bigint"))


def sliding_sums(df: DataFrame, spec: SeriesSpec, k: int, value: str | None = None) -> DataFrame:
    """Add ``frame_sum`` and ``frame_count`` over each reading and the ``k - 1`` before it.

    Differences of running sums, so the cost of a row does not grow with ``k``.
    Missing values count as absent; an infinite or NaN value makes the sums of
    the frames that hold it NaN, and no others. ``df`` needs no ``pos``; the
    result has it.
    """
    value = value or spec.value
    v = F.col(value).cast("double")
    odd = F.isnan(v) | (F.abs(v) == float("inf"))
    marks = {"_x": F.when(v.isNull() | odd, 0.0).otherwise(v), "_n": v.isNotNull().cast("int"), "_odd": F.coalesce(odd.cast("int"), F.lit(0))}
    rows = row_chunks(with_position(df, spec), spec, k - 1).withColumns(marks)
    w = in_row_chunk(spec)
    rows = rows.withColumns({f"{m}_upto": F.sum(m).over(running(w)) for m in marks})
    rows = rows.withColumns({m: F.col(f"{m}_upto") - F.coalesce(F.lag(f"{m}_upto", k).over(w), F.lit(0)) for m in marks})
    rows = rows.filter(HOME).withColumn("frame_sum", F.when(F.col("_odd") > 0, float("nan")).otherwise(F.col("_x")))
    return rows.withColumn("frame_count", F.col("_n").cast("bigint")).drop(CHUNK, HOME, *marks, *[f"{m}_upto" for m in marks])


def moving_average_rows(df: DataFrame, spec: SeriesSpec, k: int) -> DataFrame:
    """Trailing mean over k readings with zeros before the start, and the ``residual``."""
    rows = sliding_sums(df, spec, k)
    smooth = F.col("frame_sum") / k
    return rows.withColumn("smooth", smooth).withColumn("residual", F.col(spec.value) - F.col("smooth")).drop("frame_sum", "frame_count")
