"""Anomaly detection scores with point adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgrid.operators.ranks import quantile_table
from stepgrid.series import CHUNK, HOME, T, SeriesSpec, before, carry, chunked, in_chunk, running, spread_join


def anomaly_threshold(train: DataFrame, test: DataFrame, energy: str, ratio: float) -> DataFrame:
    """The (100 - ratio) percentile of train and test energies together, as a
    table of one row ``threshold``."""
    both = train.select(energy).unionByName(test.select(energy))
    return quantile_table(both, energy, (100 - ratio) / 100).withColumnRenamed("quantile", "threshold")


def detect(df: DataFrame, energy: str, threshold: DataFrame, out: str = "pred") -> DataFrame:
    """0/1 detection of energies above the threshold table's number."""
    return df.withColumn(out, (F.col(energy) > threshold.select("threshold").scalar()).cast("int"))


def point_adjust(df: DataFrame, spec: SeriesSpec, label: str, pred: str) -> DataFrame:
    """A detection anywhere in a true run marks the whole run.

    Runs are numbered by the normal rows before them, carried over chunks, so
    one series may be of any length; the first reading of all is only marked
    by its own detection.
    """
    w = in_chunk(spec)
    normal = F.when(F.col(label) == 0, 1).otherwise(0)
    rows = chunked(df, spec).withColumn("_zeros", F.sum(normal).over(running(w))).withColumn("_k", F.row_number().over(w))
    rows = carry(
        rows,
        spec,
        {"z": F.sum(normal), "n": F.count("*")},
        [
            {
                "c_z": F.coalesce(F.sum("z").over(before(spec)), F.lit(0)),
                "c_n": F.coalesce(F.sum("n").over(before(spec)), F.lit(0)),
            }
        ],
    )
    rows = rows.withColumn("_run", F.col("_zeros") + F.col("c_z")).withColumn("_first", F.col("_k") + F.col("c_n") == 1)
    hits = rows.groupBy(*spec.keys, "_run", label).agg(F.max(pred).alias("_hit"))
    # a run may be very long: its rows meet the run's result chunk by chunk
    joined = spread_join(rows, hits, [*spec.keys, "_run", label], F.col(CHUNK))
    adjusted = F.when((F.col(label) == 1) & ~F.col("_first"), F.col("_hit")).otherwise(F.col(pred))
    return joined.withColumn("adjusted", adjusted).drop(
        T, CHUNK, HOME, "_zeros", "_k", "c_z", "c_n", "_run", "_first", "_hit"
    )


def detection_scores(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Accuracy, precision, recall and F1 of a 0/1 detection."""
    hit = F.count_if((F.col(label) == 1) & (F.col(pred) == 1))
    called, true = F.count_if(F.col(pred) == 1), F.count_if(F.col(label) == 1)
    zero = F.lit(0.0)
    precision = F.coalesce(F.try_divide(hit, called), zero)
    recall = F.coalesce(F.try_divide(hit, true), zero)
    return df.agg(
        F.avg((F.col(label) == F.col(pred)).cast("int")).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(F.try_divide(2 * precision * recall, precision + recall), zero).alias("f1"),
    )
