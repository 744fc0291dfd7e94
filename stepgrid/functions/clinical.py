"""Clinical error grids and glycemic strata as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clarke_zone(ref: Column, meas: Column) -> Column:
    """Clarke zone A-E. The branches overlap, so their order matters; the
    20 % band is tested without division, which also covers reference 0."""
    swapped = ((ref <= 70) & (meas >= 180)) | ((ref >= 180) & (meas <= 70))
    both_low = (ref < 70) & (meas < 70)
    mid = meas.between(70, 180)
    return (
        F.when(swapped, "E")
        .when(both_low | (F.abs(meas - ref) <= 0.20 * ref), "A")
        .when(mid & ((ref <= 70) | (ref >= 240)), "D")
        .when((ref >= 70) & (meas >= ref + 110), "C")
        .when((ref >= 130) & (meas <= 70) & (meas <= 1.4 * (ref - 130)), "C")
        .otherwise("B")
    )


def zone_percent(zone: Column, letter: str) -> Column:
    return F.avg(F.when(zone == letter, 100.0).otherwise(0.0))


# Risk by size of the error outside the accepted band. The three
# limits part the risks 0.5, 1, 2 and 3; below 70 and up to 180 mg/dL they are
# absolute errors, above 180 percent of the reference.
RISKS = (0.5, 1.0, 2.0, 3.0)
LIMITS_LOW_UNDER = (30, 60, 90)
LIMITS_LOW_OVER = (30, 50, 80)
LIMITS_MID = (40, 80, 120)
LIMITS_HIGH_UNDER = (20, 40, 60)
LIMITS_HIGH_OVER = (20, 40, 70)
GRID = 600


def _graded(size: Column, limits: tuple[int, int, int]) -> Column:
    out = F.lit(RISKS[3])
    for limit, risk in reversed(list(zip(limits, RISKS))):
        out = F.when(size <= limit, risk).otherwise(out)
    return out


def _cell(x: Column) -> Column:
    """Truncate toward zero and clip to the grid."""
    return F.greatest(F.lit(0), F.least(F.lit(GRID - 1), x.cast("int")))


def seg_rule_risk(ref: Column, meas: Column) -> Column:
    """Surveillance risk from the banded rules, on truncated values."""
    r, m = _cell(ref), _cell(meas)
    size = F.abs(m - r)
    percent = size / F.greatest(r, F.lit(1)) * 100.0
    under = m < r
    # in whole numbers, as 100 * 1.15 in floating point is less than 115
    accepted = F.when(r < 100, size <= 15).otherwise((m * 100 >= r * 85) & (m * 100 <= r * 115))
    low = F.when(under, _graded(size, LIMITS_LOW_UNDER)).otherwise(_graded(size, LIMITS_LOW_OVER))
    high = F.when(under, _graded(percent, LIMITS_HIGH_UNDER)).otherwise(_graded(percent, LIMITS_HIGH_OVER))
    return (
        F.when(accepted, 0.0).when(r < 70, low).when(r <= 180, _graded(size, LIMITS_MID)).otherwise(high)
    )


def grid_index(x: Column, size: int = GRID) -> Column:
    """Nearest grid line (ties to even), clipped."""
    return F.greatest(F.lit(0), F.least(F.lit(size - 1), F.rint(x).cast("int")))


# Upper edges of the five risk zones of the lookup grid.
ZONE_EDGES = (("None", 0.5), ("Slight", 1.5), ("Moderate", 2.5), ("Great", 3.5))


def seg_zone(risk: Column) -> Column:
    """Zone name; an edge belongs to the upper zone, above 4 to none."""
    out = F.when(risk <= 4.0 + 1e-6, "Extreme")
    for name, edge in reversed(ZONE_EDGES):
        out = F.when(risk < edge, name).otherwise(out)
    return out


# Glycemic strata in display order.
STRATA = ("Hyper (>180)", "In-range [70,180]", "Hypo (<70)")


def glycemic_strata(truth: Column) -> list[tuple[str, Column]]:
    """Labels and conditions of the strata, in display order."""
    return list(zip(STRATA, (truth > 180, truth.between(70, 180), truth < 70)))


def stratum(truth: Column) -> Column:
    return F.coalesce(*[F.when(condition, label) for label, condition in glycemic_strata(truth)])


def with_seg_risk(
    df: DataFrame, table: DataFrame, ref: str, meas: str, size: int = GRID, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """Risk from a lookup table ``(ref_i, meas_i, risk)``.

    The table has size x size rows by contract, so its size is known before
    it is read; it is broadcast only while that stays under the bound.
    """
    small = F.broadcast(table) if size * size <= broadcast_rows else table
    keyed = df.withColumn("ref_i", grid_index(F.col(ref), size)).withColumn("meas_i", grid_index(F.col(meas), size))
    return keyed.join(small, ["ref_i", "meas_i"], "left").drop("ref_i", "meas_i")


def with_seg_bilinear(
    df: DataFrame, table: DataFrame, ref: str, meas: str, size: int, top: float = 600.0, broadcast_rows: int = 1_000_000
) -> DataFrame:
    """Risk by bilinear interpolation over ``size`` grid lines on [0, top].

    The table side is first widened to one row per cell with its four corners,
    so the readings meet one equi-join.
    """
    step = top / (size - 1)
    corner = F.col("risk")
    cells = table.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        (F.col("ref_i") - a).alias("i"), (F.col("meas_i") - b).alias("j"), F.lit(2 * a + b).alias("k"), corner.alias("v")
                    )
                    for a in (0, 1)
                    for b in (0, 1)
                ]
            )
        ).alias("c")
    ).select("c.*")
    cells = cells.groupBy("i", "j").agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(f"v{k}") for k in range(4)])
    if size * size <= broadcast_rows:
        cells = F.broadcast(cells)

    def place(name: str) -> tuple[Column, Column]:
        at = F.greatest(F.lit(0.0), F.least(F.lit(top), F.col(name).cast("double"))) / step
        cell = F.least(F.lit(size - 2), F.floor(at).cast("int"))
        return cell, at - cell

    i, u = place(ref)
    j, v = place(meas)
    risk = (
        (1 - F.col("_u")) * (1 - F.col("_v")) * F.col("v0")
        + (1 - F.col("_u")) * F.col("_v") * F.col("v1")
        + F.col("_u") * (1 - F.col("_v")) * F.col("v2")
        + F.col("_u") * F.col("_v") * F.col("v3")
    )
    return (
        df.withColumn("i", i).withColumn("j", j).withColumn("_u", u).withColumn("_v", v)
        .join(cells, ["i", "j"], "left")
        .withColumn("risk", risk)
        .drop("i", "j", "_u", "_v", "v0", "v1", "v2", "v3")
    )
