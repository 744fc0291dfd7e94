"""Packing of sequences into rows of a fixed length."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgrid.operators.ranks import dense_index


def _fit(max_length: int):
    def run(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "id"], ascending=[False, True])
        free: list[int] = []
        places = []
        for length in part["length"]:
            at = next((i for i, room in enumerate(free) if room >= length), None)
            if at is None:
                free.append(max_length)
                at = len(free) - 1
            free[at] -= length
            places.append(at)
        out = part.assign(batch=key[0], bin=places)
        out["sample_id"] = out.groupby("bin").cumcount() + 1
        return out[["batch", "bin", "sample_id", "id", "length"]]

    return run


def pack_plan(df: DataFrame, key: str, sequence: str, max_length: int, batch_size: int) -> DataFrame:
    """First-fit-decreasing bins within batches of ``batch_size`` rows.

    The order of filling makes this sequential, so it runs per batch; batches
    have a fixed size and only ids and lengths are sent to Python.
    """
    sizes = df.select(F.col(key).alias("id"), F.size(sequence).cast("bigint").alias("length"))
    too_long = F.raise_error(F.concat(F.lit("sequence longer than the bin: "), F.col("id").cast("string")))
    sizes = sizes.withColumn("length", F.when(F.col("length") <= max_length, F.col("length")).otherwise(too_long))
    rows = dense_index(sizes, ["id"], "_n").withColumn("batch", F.floor(F.col("_n") / batch_size).cast("bigint"))
    id_type = df.schema[key].dataType.simpleString()
    schema = f"batch bigint, bin bigint, sample_id bigint, id {id_type}, length bigint"
    return rows.drop("_n").groupBy("batch").applyInPandas(_fit(max_length), schema)


def pack_sequences(df: DataFrame, key: str, sequence: str, max_length: int, batch_size: int) -> DataFrame:
    """Packed rows: joined values, sample ids (0 = padding)."""
    plan = pack_plan(df, key, sequence, max_length, batch_size)
    rows = plan.join(df.select(F.col(key).alias("id"), F.col(sequence).alias("_s")), "id")
    packed = rows.groupBy("batch", "bin").agg(
        F.array_sort(F.collect_list(F.struct("sample_id", "_s"))).alias("_p")
    )
    values = F.flatten(F.col("_p._s"))
    ids = F.flatten(F.transform("_p", lambda x: F.array_repeat(x["sample_id"], F.size(x["_s"]))))
    room = F.lit(max_length) - F.size(values)
    return packed.select(
        "batch",
        "bin",
        F.concat(values, F.array_repeat(F.lit(0.0), room)).alias("values"),
        F.concat(ids, F.array_repeat(F.lit(0).cast("bigint"), room)).alias("sample_id"),
    )


def pad_sequences(df: DataFrame, sequence: str, max_length: int) -> DataFrame:
    """Right-padded values with sample id 1 for data and 0 for padding; a
    longer sequence fails the job."""
    n = F.size(sequence)
    too_long = F.raise_error(F.concat(F.lit(f"sequence longer than {max_length}: "), n.cast("string")))
    room = F.when(n <= max_length, max_length - n).otherwise(too_long.cast("int"))
    return df.withColumn("values", F.concat(F.col(sequence), F.array_repeat(F.lit(0.0), room))).withColumn(
        "sample_id", F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), room))
    )
