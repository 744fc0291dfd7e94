"""Gap-free runs and gap-split segments."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgrid.series import (
    CHUNK,
    HOME,
    T,
    SeriesSpec,
    after,
    before,
    carry,
    chunked,
    floor_div,
    in_chunk,
    in_row_chunk,
    micros,
    row_chunks,
    running,
)


def contiguous_runs(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """Add ``run``: how many exact steps follow each reading without a break."""
    rows = chunked(df, spec, ahead_us=spec.step_us)
    backwards = in_chunk(spec, descending=True)
    following = F.lag(T).over(backwards)
    rows = (
        rows.withColumn("_brk", following.isNull() | (following - F.col(T) != spec.step_us))
        .filter(HOME)
        .withColumn("_end", F.last(F.when(F.col("_brk"), F.col(T)), ignorenulls=True).over(running(backwards)))
    )
    rows = carry(
        rows,
        spec,
        {"first_break": F.min(F.when(F.col("_brk"), F.col(T)))},
        [{"c_end": F.min("first_break").over(after(spec))}],
    )
    run = (F.coalesce("_end", "c_end") - F.col(T)) / spec.step_us
    return rows.withColumn("run", run.cast("bigint")).drop(T, CHUNK, HOME, "_brk", "_end", "c_end")


def local_runs(df: DataFrame, spec: SeriesSpec, length: int) -> DataFrame:
    """Rows chunked for windows of ``length`` steps, with ``_i`` (1-based place
    in the chunk, halo counted), ``_k`` (place among its home rows) and
    ``seg_pos`` = exact steps since the last break (counted inside the chunk,
    which holds at least ``length`` of them when they exist)."""
    rows = chunked(df, spec, behind_us=spec.step_us * max(1, length - 1))
    w = in_chunk(spec)
    gap = F.col(T) - F.lag(T).over(w)
    return (
        rows.withColumn("_i", F.row_number().over(w))
        .withColumn("_k", F.count(F.when(F.col(HOME), 1)).over(running(w)) - 1)
        .withColumn("_new", gap.isNull() | (gap != spec.step_us))
        .withColumn("_from", F.last(F.when(F.col("_new"), F.col("_i")), ignorenulls=True).over(running(w)))
        .withColumn("_clean", since_missing(spec, w))
        .withColumn("seg_pos", F.col("_i") - F.col("_from"))
        .drop("_new", "_from")
    )


def run_rows(df: DataFrame, spec: SeriesSpec, length: int) -> DataFrame:
    """:func:`local_runs` with ``pos``.

    The readings are shuffled once; positions come from per-chunk counts that
    are summed before their own, small, shuffle.
    """
    width = spec.chunk_us(spec.step_us * max(1, length - 1))
    counts = df.groupBy(*spec.keys, floor_div(micros(spec.ts), width).alias(CHUNK)).agg(F.count("*").alias("n"))
    offsets = counts.withColumn("c_off", F.coalesce(F.sum("n").over(before(spec)), F.lit(0))).drop("n")
    rows = local_runs(df, spec, length).join(offsets, [*spec.keys, CHUNK], "left")
    return rows.withColumn("pos", F.col("c_off") + F.col("_k")).drop("_k", "c_off")


def since_missing(spec: SeriesSpec, w):
    """Rows since the last missing value, counted inside the chunk."""
    bad = F.col(spec.value).isNull() | F.isnan(F.col(spec.value).cast("double"))
    return F.col("_i") - F.coalesce(F.last(F.when(bad, F.col("_i")), ignorenulls=True).over(running(w)), F.lit(0))


def split_rows(df: DataFrame, spec: SeriesSpec, limit: timedelta | None = None) -> DataFrame:
    """Positions and segments, still chunked; home rows know their predecessor.

    ``limit=None`` splits wherever the gap is not exactly one step (a run);
    otherwise a segment ends where the gap exceeds ``limit``. Adds ``pos``,
    ``segment_id`` and ``seg_pos`` (valid on home rows) and ``_clean``.
    """
    reach = spec.step_us if limit is None else int(limit / timedelta(microseconds=1))
    rows = chunked(df, spec, behind_us=reach)
    w = in_chunk(spec)
    gap = F.col(T) - F.lag(T).over(w)
    split = gap.isNull() | ((gap != spec.step_us) if limit is None else (gap > reach))
    home = F.col(HOME)
    rows = (
        rows.withColumn("_i", F.row_number().over(w))
        .withColumn("_new", home & split)
        .withColumn("_k", F.count(F.when(home, 1)).over(running(w)) - 1)
        .withColumn("_segs", F.count(F.when(F.col("_new"), 1)).over(running(w)))
        .withColumn("_from", F.last(F.when(F.col("_new"), F.col("_k")), ignorenulls=True).over(running(w)))
        .withColumn("_clean", since_missing(spec, w))
    )
    rows = carry(
        rows,
        spec,
        {
            "n": F.count(F.when(home, 1)),
            "segs": F.count(F.when(F.col("_new"), 1)),
            "last_start": F.max(F.when(F.col("_new"), F.col("_k"))),
        },
        [
            {
                "c_off": F.coalesce(F.sum("n").over(before(spec)), F.lit(0)),
                "c_seg": F.coalesce(F.sum("segs").over(before(spec)), F.lit(0)),
            },
            {"start_pos": F.col("c_off") + F.col("last_start")},
            {"c_start": F.last("start_pos", ignorenulls=True).over(before(spec))},
        ],
    )
    pos = F.col("c_off") + F.col("_k")
    return (
        rows.withColumn("pos", pos)
        .withColumn("segment_id", F.col("c_seg") + F.col("_segs") - 1)
        .withColumn("seg_pos", pos - F.coalesce(F.col("c_off") + F.col("_from"), F.col("c_start")))
        .drop("_i", "_new", "_k", "_segs", "_from", "c_off", "c_seg", "c_start")
    )


def segment_rows(df: DataFrame, spec: SeriesSpec, limit: timedelta, length: int) -> DataFrame:
    """Segments in chunks counted in rows, with the ``length - 1`` readings a window looks back to.

    A window of a segment may span any time, so a halo in time has no bound in
    readings; segment numbers are carried over time chunks first, then the rows
    are chunked by place. Costs a second shuffle and holds arrays to a chunk.
    """
    rows = split_rows(df, spec, limit).filter(HOME).drop(CHUNK, HOME, "_clean")
    rows = row_chunks(rows, spec, length - 1)
    w = in_row_chunk(spec)
    return rows.withColumn("_i", F.row_number().over(w)).withColumn("_clean", since_missing(spec, w))


def segment_by_gap(df: DataFrame, spec: SeriesSpec, limit: timedelta | None) -> DataFrame:
    """Add ``pos``, ``segment_id`` (0, 1, ... per series) and ``seg_pos``."""
    rows = split_rows(df, spec, limit)
    return rows.filter(HOME).drop(T, CHUNK, HOME, "_clean")
