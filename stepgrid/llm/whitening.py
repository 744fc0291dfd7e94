"""Whitening of embeddings with exact scatter from bit-sliced vectors.

Entries become integers. In blocks of rows each dimension is shifted to its
least value in the block, and its bit planes are packed across the rows into
64-bit words. The product sum of two dimensions is the number of common bits of
each pair of planes, weighted by the planes' powers of two: exact, whatever the
order in which tasks and blocks are added up. Sums are centred as integers;
floating point begins with the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgrid.llm.textbytes import own_worker
from stepgrid.session import fresh_path

SCALE, SHIFT = 1024.0, 100_000
LARGEST = float(1 << 61)  # entries beyond this, scaled, have no 64-bit integer
BLOCK = 4096  # rows whose planes are packed at once
PLANE_BYTES = 64 << 20  # of planes compared at once

LIMB, LIMBS = 40, 4  # exact sums travel as four longs, with room for 2**23 tasks
CROSS = "i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass(frozen=True)
class Whitening:
    """What rows are projected with: exact sums, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray  # one column each
    values: np.ndarray
    explained: np.ndarray
    identity_error: float


def usable(vector: Column) -> Column:
    """Rows whose vector has finite entries only, none of them null."""
    entry = lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) * SCALE >= LARGEST)
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, entry), F.lit(True))


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """Entries as integers, a row per vector."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(SCALE * flat).astype(np.int64).reshape(-1, width) + SHIFT


def bit_planes(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Planes of non-negative integers: words of row bits for each dimension and plane, and the number of planes."""
    rows, width = x.shape
    planes = max(int(x.max(initial=0)).bit_length(), 1)
    padded = np.zeros((-(-rows // 64) * 64, width), np.uint64)
    padded[:rows] = x
    out = np.empty((width, planes, len(padded) // 64), np.uint64)
    for p in range(planes):
        bits = ((padded >> np.uint64(p)) & np.uint64(1)).astype(np.uint8)
        out[:, p] = np.ascontiguousarray(np.packbits(bits.T, axis=1)).view(np.uint64)
    return out, planes


def cross_products(x: np.ndarray) -> np.ndarray:
    """Exact ``sum over rows of x[i] x[j]`` of non-negative integers, as Python integers."""
    width = x.shape[1]
    packed, planes = bit_planes(x)
    lines = packed.reshape(width * planes, -1)
    powers = np.arange(planes)
    weights = np.array([1 << int(k) for k in range(2 * planes - 1)], object)
    at_once = max(1, PLANE_BYTES // max(lines.nbytes, 1))
    out = np.zeros((width, width), object)
    for i in range(width):
        common = np.zeros((2 * planes - 1, width - i), np.int64)
        rest = lines[i * planes :]
        for first in range(0, planes, at_once):
            mine = packed[i, first : first + at_once]
            found = np.bitwise_count(mine[:, None, :] & rest[None]).sum(axis=2, dtype=np.int64)
            found = found.reshape(len(mine), width - i, planes)
            for p in range(len(mine)):
                common[first + p + powers] += found[p].T
        out[i, i:] = weights @ common.astype(object)
        out[i:, i] = out[i, i:]
    return out


def block_sums(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and product sums of any integers, each dimension shifted to its least value."""
    least = x.min(axis=0)
    moved = (x - least).astype(np.uint64)
    low = least.astype(object)
    part = np.array([int(v) for v in (moved & np.uint64(0xFFFFFFFF)).sum(axis=0)], object)
    part = part + np.array([int(v) << 32 for v in (moved >> np.uint64(32)).sum(axis=0)], object)
    sums = part + len(x) * low
    cross = cross_products(moved) + np.outer(part, low) + np.outer(low, part) + len(x) * np.outer(low, low)
    return sums, cross


def scatter(vectors: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """Number of rows, sums and product sums over all rows.

    Each task sends one row for each pair of dimensions, the driver receives as
    many: (width + 1)(width + 2) / 2 exact numbers, however many the vectors.
    Index ``width`` stands for the constant 1, so it holds sums and count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("whitening")
        total, sums, cross = 0, np.zeros(width, object), np.zeros((width, width), object)
        for batch in batches:
            x = integers(batch.column("v"), width)
            for first in range(0, len(x), BLOCK):
                s, c = block_sums(x[first : first + BLOCK])
                sums, cross = sums + s, cross + c
            total += len(x)
        if not total:
            return
        i, j = np.triu_indices(width)
        rows = [*zip(i.tolist(), j.tolist(), cross[i, j].tolist(), strict=True)]
        rows += [(k, width, v) for k, v in enumerate(sums.tolist())] + [(width, width, total)]
        a, b, value = zip(*rows, strict=True)
        low = (1 << LIMB) - 1
        limbs = [[v >> LIMB * k & (low if k < LIMBS - 1 else -1) for v in value] for k in range(LIMBS)]
        columns = [pa.array(a, pa.int32()), pa.array(b, pa.int32()), *[pa.array(limb, pa.int64()) for limb in limbs]]
        yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in CROSS.split(", ")])

    sums = vectors.mapInArrow(run, CROSS).groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)])
    whole = np.zeros((width + 1, width + 1), object)
    for row in sums.collect():
        whole[row["i"], row["j"]] = whole[row["j"], row["i"]] = sum(row[f"l{k}"] << LIMB * k for k in range(LIMBS))
    return whole[width, width], whole[width, :width].tolist(), whole[:width, :width].tolist()


def fitted(n: int, sums: list[int], cross: list[list[int]], most: int) -> Whitening:
    """Components of the covariance: exact integers over n squared, then eigenvectors."""
    width = len(sums)
    square = n * n
    v = np.array([[(n * cross[i][j] - sums[i] * sums[j]) / square for j in range(width)] for i in range(width)], float)
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")[:most]
    trace = sum(n * cross[i][i] - sums[i] ** 2 for i in range(width)) / square
    components, values = vectors[:, order], values[order]
    # the largest entry is positive, so that a sign does not depend on the library
    components = components * np.sign(components[np.abs(components).argmax(axis=0), np.arange(components.shape[1])])
    real = values > width * np.finfo(float).eps * trace if trace else np.zeros(len(values), bool)
    values = np.where(real, values, 0.0)
    scaled = np.where(real, components / np.sqrt(np.where(real, values, 1.0)), 0.0)
    error = np.abs(scaled.T @ v @ scaled - np.eye(len(values))).max(initial=0.0)
    return Whitening(n, sums, components, values, values / trace if trace else np.zeros(len(values)), float(error))


def fit(vectors: DataFrame, most: int = 8) -> Whitening | None:
    """Fit on all rows of ``v``; None without rows or dimensions."""
    widths = vectors.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(1).collect()
    if not widths or not widths[0]["w"]:
        return None
    width = int(widths[0]["w"])
    return fitted(*scatter(vectors.where(F.size("v") == width), width), most)


def projected(batch: pa.RecordBatch, model: Whitening) -> pa.RecordBatch:
    """Rows of ``OUT`` for a batch of ``vec_id, v``."""
    width, count = model.components.shape
    x = integers(batch.column("v"), width)
    n, sums = model.n, np.array(model.sums, object)
    # 64 bits where all steps fit in them, else Python integers
    fits = n * int(np.abs(x).max(initial=0)) + max(abs(s) for s in model.sums) < 1 << 62
    centred = x * n - sums.astype(np.int64) if fits else x.astype(object) * n - sums
    if fits and int(np.abs(centred).max(initial=0)) ** 2 * width < 1 << 63:
        deviation = (centred * centred).sum(axis=1)
    else:
        whole = centred.astype(object)
        deviation = [v if v < 1 << 63 else None for v in (whole * whole).sum(axis=1)] if len(x) else []
    real = model.values > 0
    scaled = np.where(real, model.components / np.sqrt(np.where(real, model.values, 1.0)), 0.0)
    whitened = (centred.astype(float) / n) @ scaled
    rows = len(x)
    ids = batch.column("vec_id")
    columns = [
        pc.take(ids, pa.array(np.repeat(np.arange(rows), count))),
        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), rows)),
        pa.array(np.full(rows * count, n, np.int64)),
        pc.take(pa.array(deviation, pa.int64()), pa.array(np.repeat(np.arange(rows), count))),
        pa.array(whitened.ravel()),
        pa.array(np.tile(model.explained, rows)),
        pa.array(np.full(rows * count, model.identity_error)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in OUT.split(", ")])


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", most: int = 8) -> DataFrame:
    """Whitened coordinates of each vector on the first ``most`` components.

    Columns ``vec_id, component, n, deviation, whitened, explained,
    identity_error``; entries enter as ``floor(1024 c) + 100000``. Rows whose
    vector is null, or holds a null, non-finite or too large entry (its integer
    would not fit 64 bits) are dropped, and so are vectors of another length
    than most have (of equally many, the longest). Repeated rows count each;
    ids may be null or repeated. Fewer dimensions give fewer components. A
    component without variance has whitened 0, explained 0 and shows in the
    identity error. ``deviation`` is null where it passes 64 bits. Without
    usable vectors, or if they have no entries, the result is empty. Other
    columns are not read.
    """
    spark: SparkSession = rows.sparkSession
    vector = F.col(vector_column)
    clean = rows.where(usable(vector)).select(F.col(id_column).cast("long").alias("vec_id"), F.transform(vector, lambda x: x.cast("double")).alias("v"))
    model = fit(clean, most)
    if model is None:
        return spark.createDataFrame([], OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("whitening")
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                yield projected(batch.slice(first, BLOCK), model)

    return clean.where(F.size("v") == model.components.shape[0]).mapInArrow(run, OUT)


def store(model: Whitening, spark: SparkSession) -> str:
    """Write mean, components and eigenvalues as Parquet, a row per component; returns the folder."""
    path = fresh_path(spark, "whitening")
    mean = [s / model.n for s in model.sums]
    rows = [
        (k + 1, float(model.values[k]), float(model.explained[k]), mean, model.components[:, k].tolist()) for k in range(len(model.values))
    ]
    spark.createDataFrame(rows, "component int, value double, explained double, mean array<double>, direction array<double>").coalesce(1).write.parquet(path)
    return path
