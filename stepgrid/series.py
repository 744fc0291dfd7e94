"""The series contract and the bounded-group scans every operator builds on.

A plain ``Window.partitionBy(subject)`` puts a whole series into one task, so
one subject with a third of all rows would stall a cluster. The scans here cut
each series into time chunks of a bounded number of steps instead:

* look-back that is bounded in time (lags, run tests, window slices) copies the
  rows near a chunk border into the next chunk (a *halo*), so one shuffle on
  ``(keys, chunk)`` is enough;
* look-back that is unbounded (positions, segment ids, forward fill) adds one
  small row per chunk, runs the scan over those rows, and joins the carried
  state back on ``(keys, chunk)``, a key that is spread evenly by construction.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

T = "_t"
CHUNK = "_chunk"
HOME = "_home"


@dataclass(frozen=True)
class SeriesSpec:
    """Names and step of a long series table (one row per reading).

    ``chunk_steps`` sets the width of the time chunks all scans work in. A
    chunk holds about that many rows when readings come once per step; make it
    smaller for readings denser than the step.
    """

    keys: tuple[str, ...] = ("dataset", "subject_id")
    ts: str = "ts"
    value: str = "value"
    step: timedelta = timedelta(minutes=5)
    chunk_steps: int = 4096

    @property
    def step_us(self) -> int:
        return int(self.step / timedelta(microseconds=1))

    def with_(self, **changes) -> "SeriesSpec":
        return replace(self, **changes)

    def chunk_us(self, halo_us: int = 0) -> int:
        """Chunk width; at least four halos wide so copies stay a minority."""
        return max(self.chunk_steps * self.step_us, 4 * halo_us)


def micros(ts: str | Column) -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(col.cast("timestamp"))


def floor_div(col: Column, width: int) -> Column:
    """Integer floor division that is right for negative epochs too."""
    rest = F.pmod(col, F.lit(width))
    return ((col - rest) / F.lit(width)).cast("bigint")


def chunked(df: DataFrame, spec: SeriesSpec, behind_us: int = 0, ahead_us: int = 0) -> DataFrame:
    """Add ``_t``, ``_chunk`` and ``_home``; border rows also go to the
    neighbour chunk (``_home`` false) when they lie within the halo."""
    width = spec.chunk_us(max(behind_us, ahead_us))
    df = df.withColumn(T, micros(spec.ts))
    home = floor_div(F.col(T), width)
    if not behind_us and not ahead_us:
        return df.withColumn(CHUNK, home).withColumn(HOME, F.lit(True))
    offset = F.pmod(F.col(T), F.lit(width))
    places = [F.struct(home.alias("c"), F.lit(True).alias("h"))]
    if behind_us:
        places.append(
            F.when(width - offset <= behind_us, F.struct((home + 1).alias("c"), F.lit(False).alias("h")))
        )
    if ahead_us:
        places.append(F.when(offset < ahead_us, F.struct((home - 1).alias("c"), F.lit(False).alias("h"))))
    where = F.explode(F.array_compact(F.array(*places)))
    return (
        df.withColumn("_at", where)
        .withColumn(CHUNK, F.col("_at.c"))
        .withColumn(HOME, F.col("_at.h"))
        .drop("_at")
    )


def in_chunk(spec: SeriesSpec, descending: bool = False):
    order = F.col(T).desc() if descending else F.col(T)
    return Window.partitionBy(*spec.keys, CHUNK).orderBy(order)


def running(window):
    return window.rowsBetween(Window.unboundedPreceding, 0)


def carry(rows: DataFrame, spec: SeriesSpec, summary: dict[str, Column], scans: list[dict[str, Column]]) -> DataFrame:
    """Join per-chunk carried state onto ``rows``.

    ``summary`` aggregates the rows of a chunk to one small row. ``scans`` are
    applied one after another to those small rows (each a dict of windowed
    columns over :func:`before` / :func:`after`); columns named with a leading
    ``c_`` are what comes back.
    """
    small = rows.groupBy(*spec.keys, CHUNK).agg(*[c.alias(n) for n, c in summary.items()])
    for scan in scans:
        small = small.withColumns(scan)
    kept = [c for c in small.columns if c.startswith("c_")]
    return rows.join(small.select(*spec.keys, CHUNK, *kept), [*spec.keys, CHUNK])


def before(spec: SeriesSpec):
    """All earlier chunks of the same series."""
    return Window.partitionBy(*spec.keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def after(spec: SeriesSpec):
    """All later chunks, walked from the end so that the frame only grows."""
    return (
        Window.partitionBy(*spec.keys).orderBy(F.col(CHUNK).desc()).rowsBetween(Window.unboundedPreceding, -1)
    )


def with_position(df: DataFrame, spec: SeriesSpec, total: str | None = None, keep_chunks: bool = False) -> DataFrame:
    """0-based position of each reading in its series, as column ``pos``.

    ``total`` names a column for the length of the series. ``keep_chunks``
    leaves the rows chunked, so that a scan over the same chunks which follows
    needs no further shuffle.
    """
    w = in_chunk(spec)
    rows = chunked(df, spec).withColumn("_k", F.row_number().over(w) - 1)
    counts = df.groupBy(*spec.keys, floor_div(micros(spec.ts), spec.chunk_us()).alias(CHUNK)).agg(
        F.count("*").alias("n")
    )
    offsets = counts.withColumn("c_off", F.coalesce(F.sum("n").over(before(spec)), F.lit(0)))
    if total:
        offsets = offsets.withColumn(total, F.sum("n").over(Window.partitionBy(*spec.keys)))
    rows = rows.join(offsets.drop("n"), [*spec.keys, CHUNK])
    rows = rows.withColumn("pos", F.col("c_off") + F.col("_k")).drop("_k", "c_off")
    return rows if keep_chunks else rows.drop(T, CHUNK, HOME)


def row_chunks(df: DataFrame, spec: SeriesSpec, behind: int) -> DataFrame:
    """Chunks counted in rows, with ``behind`` rows of halo.

    For look-back by a number of *readings*, which no time span bounds on an
    irregular series. Costs one more shuffle than :func:`chunked`. ``df`` must
    carry ``pos``; order within a chunk is by ``pos``.
    """
    width = max(spec.chunk_steps, 4 * behind)
    home = floor_div(F.col("pos"), width)
    places = [
        F.struct(home.alias("c"), F.lit(True).alias("h")),
        F.when(
            width - F.pmod(F.col("pos"), F.lit(width)) <= behind,
            F.struct((home + 1).alias("c"), F.lit(False).alias("h")),
        ),
    ]
    return (
        df.withColumn("_at", F.explode(F.array_compact(F.array(*places))))
        .withColumn(CHUNK, F.col("_at.c"))
        .withColumn(HOME, F.col("_at.h"))
        .drop("_at")
    )


def in_row_chunk(spec: SeriesSpec):
    return Window.partitionBy(*spec.keys, CHUNK).orderBy("pos")


SALTS = 64


def row_salt(df: DataFrame, keys: list[str]) -> Column:
    """A salt from the other columns of a row."""
    rest = [F.col(f"`{c}`") for c in df.columns if c not in keys]
    return F.pmod(F.xxhash64(*rest), F.lit(SALTS)) if rest else F.lit(0)


def spread_join(df: DataFrame, stats: DataFrame, keys: list[str], salt: Column | None = None, how: str = "inner") -> DataFrame:
    """Inner or left join of rows with one row per key, safe for hot keys.

    The join key is (keys, salt). The small side is repeated only for the
    salts a key really has: the distinct (keys, salt) pairs, which combine
    before their shuffle. A key of few rows has few pairs, a hot one is split.
    """
    rows = df.withColumn("_salt", row_salt(df, keys) if salt is None else salt)
    pairs = rows.select(*keys, "_salt").distinct().join(stats, keys)
    return rows.join(pairs, [*keys, "_salt"], how).drop("_salt")
