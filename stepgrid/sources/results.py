"""Writers and the incrementally kept results table."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgrid.functions.text import boolish
from stepgrid.series import CHUNK, T, SeriesSpec, chunked
from stepgrid.sources.readings import located

UNSAFE = "\"#%'*/:=?\\\x7f{[]^"  # in folder names

# The key of one result row and its types.
RESULT_KEY = ("participant_id", "context_hours", "horizon_minutes", "stride_steps", "metric_mode")
KEY_TYPES = {
    "participant_id": "string",
    "context_hours": "int",
    "horizon_minutes": "int",
    "stride_steps": "int",
    "metric_mode": "string",
}


def folder_name(column: str, value: str | None) -> str:
    """``column=value`` with the characters escaped that no folder name may hold, as Spark writes it."""
    if value is None or value == "":
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    return f"{column}=" + "".join(f"%{ord(c):02X}" if c < " " or c in UNSAFE else c for c in value)


def write_subject_csvs(df: DataFrame, spec: SeriesSpec, path: str, by: list[str] | None = None) -> None:
    """Readings as CSV folders per dataset and subject, time as epoch seconds.

    Rows are spread by chunk as well as subject, so a long subject is written
    by many tasks. A task writes its files one after another, each under a
    hidden name until it is whole; a repeated task replaces its own files.
    """
    by = by or list(spec.keys)
    system, base = located(path.rstrip("/"))
    if system.get_file_info(base).type.name != "NotFound":
        raise FileExistsError(path)
    system.create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = located(path.rstrip("/"))
        name, now, stream, count = f"part-{TaskContext.get().partitionId():05d}", None, None, 0

        def finish():
            stream.close()
            files.move(f"{base}/{now}/.{name}-{mark}", f"{base}/{now}/{name}.csv")

        mark = uuid.uuid4().hex
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in by], strict=True)
            lines = zip(keys, batch.column("_line").to_pylist(), strict=True)
            for key, own in groupby(lines, key=lambda x: x[0]):
                folder = "/".join(map(folder_name, by, key))
                if folder != now:
                    if stream:
                        finish()
                    files.create_dir(f"{base}/{folder}", recursive=True)
                    stream = files.open_output_stream(f"{base}/{folder}/.{name}-{mark}")
                    stream.write(b"timestamp,BGvalue\n")
                    now, count = folder, count + 1
                stream.write("".join([f"{line}\n" for _, line in own]).encode())
        if stream:
            finish()
        yield pa.RecordBatch.from_pydict({"files": [count]})

    rows = chunked(df, spec)
    seconds = F.floor(F.col(T) / 1_000_000).cast("bigint").cast("string")
    line = F.concat_ws(",", F.coalesce(seconds, F.lit("")), F.coalesce(F.col(spec.value).cast("string"), F.lit("")))
    parts = rows.repartition(*[F.col(k) for k in spec.keys], F.col(CHUNK)).sortWithinPartitions(*by, T)
    out = parts.select(*[F.col(c).cast("string").alias(c) for c in by], line.alias("_line"))
    out.mapInArrow(write, "files long").agg(F.sum("files")).collect()


def build_mixed(df: DataFrame) -> DataFrame:
    """All datasets pooled; ids become ``dataset__subject``."""
    pooled = df.withColumn("subject_id", F.concat_ws("__", "dataset", "subject_id"))
    return pooled.withColumn("dataset", F.lit("mixed"))


def newest_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the one with the greatest order; no order is least.

    ``max_by`` over the other columns combines before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(F.col(order).isNotNull(), F.col(order))
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_row"))
    return picked.select(*keys, "_row.*")


def merge_results(
    current: DataFrame | None,
    new_rows: DataFrame,
    keys: list[str],
    order: str,
    desired: list[str] | None = None,
) -> DataFrame:
    """Union of columns, latest row per key, preferred columns first.

    Stored rows without the order column are older than any new row. Stored
    rows that lack a key column can't be told apart by it and are all kept.
    """
    missing = [k for k in keys if k not in new_rows.columns]
    if missing:
        raise ValueError(f"new rows lack key columns {missing}")
    if current is None:
        merged = newest_by_key(new_rows, keys, order)
    elif any(k not in current.columns for k in keys):
        merged = current.unionByName(newest_by_key(new_rows, keys, order), allowMissingColumns=True)
    else:
        merged = newest_by_key(current.unionByName(new_rows, allowMissingColumns=True), keys, order)
    first = [c for c in (desired or []) if c in merged.columns]
    return merged.select(*first, *[c for c in merged.columns if c not in first])


def upsert_results(
    spark: SparkSession,
    base: str,
    version: int,
    new_rows: DataFrame,
    keys: list[str],
    order: str,
    desired: list[str] | None = None,
    sort_by: list[str] | None = None,
) -> DataFrame:
    """Merge into the next version folder and read it back.

    A version is a whole table in its own folder: readers of the old one are
    not disturbed, and a failed write leaves it in place. ``sort_by`` orders
    the rows of its files, by those of the columns it has.
    """
    current = spark.read.parquet(f"{base}/version={version}") if version > 0 else None
    merged = merge_results(current, new_rows, keys, order, desired)
    ordered = [c for c in (sort_by or []) if c in merged.columns]
    merged = merged.orderBy(*ordered) if ordered else merged
    merged.write.mode("errorifexists").parquet(f"{base}/version={version + 1}")
    return spark.read.parquet(f"{base}/version={version + 1}")


def completed_keys(results: DataFrame | None, keys: list[str], template: DataFrame) -> DataFrame:
    """Typed distinct keys already stored; missing key columns mean none."""
    if results is None or any(k not in results.columns for k in keys):
        return template.select(*keys).limit(0)

    def typed(k: str):
        return boolish(F.col(k)).alias(k) if k == "latest_requires_truth" else F.col(k).cast(KEY_TYPES.get(k, "string")).alias(k)

    return results.select(*[typed(k) for k in keys]).dropna().distinct()


def skip_completed(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work units whose key is not stored yet."""
    return work.join(done, keys, "left_anti")


def read_result_files(spark: SparkSession, paths: list[str], pattern: str, names: tuple[str, str] = ("protocol", "method")) -> DataFrame:
    """CSV result families; protocol and method from the path."""
    raw = spark.read.option("header", True).option("recursiveFileLookup", True).csv(paths)
    path = F.col("_metadata.file_path")
    return raw.select("*", *[F.regexp_extract(path, pattern, i + 1).alias(n) for i, n in enumerate(names)])
