"""Distances between two sets of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgrid.operators.ranks import dense_index


def _outer_sums(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[object, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for side, part in batch.groupby("side"):
                x = np.vstack([np.asarray(v, dtype=float) for v in part["vector"]])
                n, s, c = totals.get(side, (0, np.zeros(dim), np.zeros((dim, dim))))
                totals[side] = (n + len(x), s + x.sum(0), c + x.T @ x)
        for side, (n, s, c) in totals.items():
            yield pd.DataFrame({"side": [side], "n": [n], "sums": [s.tolist()], "products": [c.ravel().tolist()]})

    return run


def coral(df: DataFrame, vector: str, is_source: Column, dim: int) -> DataFrame:
    """Squared Frobenius distance of the two covariances over 4 d^2.

    Each task folds its rows into one d x d sum; only these partial sums are
    shuffled.
    """
    sides = df.select(F.when(is_source, "s").otherwise("t").alias("side"), F.col(vector).alias("vector"))
    partial = sides.mapInPandas(_outer_sums(dim), "side string, n bigint, sums array<double>, products array<double>")
    counts = partial.groupBy("side").agg(F.sum("n").alias("n"))
    sums = partial.select("side", F.posexplode("sums").alias("i", "v")).groupBy("side", "i").agg(F.sum("v").alias("s"))
    cells = partial.select("side", F.posexplode("products").alias("k", "v")).groupBy("side", "k").agg(F.sum("v").alias("p"))
    cells = cells.withColumn("i", F.floor(F.col("k") / dim).cast("int")).withColumn("j", (F.col("k") % dim).cast("int"))
    cov = (
        cells.join(sums.withColumnRenamed("s", "si"), ["side", "i"])
        .join(sums.select("side", F.col("i").alias("j"), F.col("s").alias("sj")), ["side", "j"])
        .join(counts, "side")
        .withColumn("c", (F.col("p") - F.col("si") * F.col("sj") / F.col("n")) / (F.col("n") - 1))
    )
    gap = cov.groupBy("k").agg(F.sum(F.when(F.col("side") == "s", F.col("c")).otherwise(-F.col("c"))).alias("gap"))
    return gap.agg((F.sum(F.col("gap") * F.col("gap")) / (4 * dim * dim)).alias("coral"))


def linear_mmd(df: DataFrame, vector: str, is_source: Column) -> DataFrame:
    """Squared distance of the two mean vectors."""
    cells = df.select(is_source.alias("s"), F.posexplode(vector).alias("i", "v"))
    means = cells.groupBy("i").agg(F.avg(F.when(F.col("s"), F.col("v"))).alias("a"), F.avg(F.when(~F.col("s"), F.col("v"))).alias("b"))
    return means.agg(F.sum((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("linear_mmd"))


def _rbf(mul: float, count: int):
    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        x = np.vstack([np.asarray(v, dtype=float) for v in part["vector"]])
        src = part["side"].to_numpy() == "s"
        value = None
        if 0 < src.sum() < len(src):
            square = (x * x).sum(1)
            dist = np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0.0)
            width = dist.sum() / (len(x) ** 2 - len(x)) / mul ** (count // 2)
            kernel = sum(np.exp(-dist / (width * mul**i)) for i in range(count))
            value = kernel[src][:, src].mean() + kernel[~src][:, ~src].mean() - 2 * kernel[src][:, ~src].mean()
        return pd.DataFrame({"batch": [key[0]], "n": [len(x)], "mmd": [value]})

    return run


def rbf_mmd(df: DataFrame, key: str, vector: str, is_source: Column, batch_size: int = 64, mul: float = 2.0, count: int = 5) -> DataFrame:
    """Multi-kernel MMD per batch of ``batch_size`` vectors.

    A kernel needs all pairs of a batch, so batches have a fixed size: rows
    are numbered in hash order and cut, and each batch is one small group.
    """
    sides = df.select(F.col(key), F.when(is_source, "s").otherwise("t").alias("side"), F.col(vector).alias("vector"))
    sides = dense_index(sides, [key], "_n")
    batch = F.floor(F.col("_n") / batch_size).cast("bigint").alias("batch")
    rows = sides.select(batch, "side", "vector")
    return rows.groupBy("batch").applyInPandas(_rbf(mul, count), "batch bigint, n bigint, mmd double")
