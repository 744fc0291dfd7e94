"""Registry of queries and their SQL twins, and the tables they share."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepgrid.operators.clean import bucket_readings
from stepgrid.operators.windows import windows_grid
from stepgrid.series import SeriesSpec
from stepgrid.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DAY = timedelta(days=1)
SPEC = SeriesSpec(step=DAY)
KEYS = ["dataset", "subject_id"]
SHARD = 4096  # values per row of stored series
GRID, STRIDE = [(4, 2), (9, 3), (18, 2)], 4  # windows of the queries of window transforms


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is its twin over the same tables."""

    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return fn

    return add


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stored table; its schema is read from the file footers once."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as readings: user is the subject, user modulo 3 the dataset."""
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("g"), (F.col("user_id") % 3).cast("string")).alias("dataset"),
        F.col("user_id").cast("string").alias("subject_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "value",
        "event_id",
        "event_type",
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reading per subject and day: the day's peak."""
    return bucket_readings(raw_events(spark, sf_dir), SPEC, "max")


def slot(ts: str | Column = "ts") -> Column:
    col = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(col.cast("timestamp")) / 86400).cast("bigint")


def r6(col: Column | str) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, 6)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to some places: sums differ in their last bits between engines."""
    return df.select(
        *[
            F.round(F.col(f"`{f.name}`"), places).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


READINGS = """readings AS (
  SELECT 'g' || CAST(user_id % 3 AS VARCHAR) AS dataset, CAST(user_id AS VARCHAR) AS subject_id,
         CAST(floor(epoch(ts) / 86400) AS BIGINT) AS slot, max(value) AS value
  FROM events GROUP BY 1, 2, 3)"""

POS = f"""{READINGS}, pos AS (
  SELECT *, row_number() OVER w - 1 AS pos, lag(slot) OVER w AS prev, lead(slot) OVER w AS nxt
  FROM readings WINDOW w AS (PARTITION BY dataset, subject_id ORDER BY slot))"""

# last-value and next-day pairs: the one-step persistence forecast
PAIRS = f"""{READINGS}, pairs AS (
  SELECT b.dataset, b.subject_id, b.slot, a.value AS prediction, b.value AS ground_truth
  FROM readings a JOIN readings b
    ON a.dataset = b.dataset AND a.subject_id = b.subject_id AND b.slot = a.slot + 1)"""

# a series longer than a shard continues under its name with "#1", "#2", ...
SHARDED = f"""{READINGS}, numbered AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, subject_id ORDER BY slot) - 1 AS nth FROM readings),
sharded AS (
  SELECT dataset, slot, value, nth % 4096 AS i,
    subject_id || CASE WHEN nth >= 4096 THEN '#' || CAST(nth // 4096 AS VARCHAR) ELSE '' END AS subject_id FROM numbered)"""

SERIES = f"""{READINGS}, ser AS (
  SELECT dataset || '__' || subject_id AS item_id, count(*) AS n, min(slot) AS s0,
         list(CAST(CAST(value AS FLOAT) AS DOUBLE) ORDER BY slot) AS target
  FROM readings GROUP BY dataset, subject_id)"""


def shard_name(name: Column, shard: Column) -> Column:
    return F.concat(name, F.when(shard > 0, F.concat(F.lit("#"), shard.cast("string"))).otherwise(""))


# windows of several lengths over unbroken runs, every fourth start, as rows
WINDOWED = f"""{POS}, sizes AS (SELECT unnest([{", ".join(str(c + h) for c, h in GRID)}]) AS size),
win AS (
  SELECT a.dataset, a.subject_id, a.pos AS window_start, size FROM pos a, sizes, pos b
  WHERE a.dataset = b.dataset AND a.subject_id = b.subject_id AND b.pos = a.pos + size - 1 AND b.slot = a.slot + size - 1 AND a.pos % {STRIDE} = 0),
cells AS (
  SELECT concat_ws('__', r.dataset, r.subject_id, window_start, size) AS item_id, r.pos - window_start AS i, r.value
  FROM win w JOIN pos r ON r.dataset = w.dataset AND r.subject_id = w.subject_id AND r.pos >= window_start AND r.pos < window_start + size)"""


def reading_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True windows of several lengths: item_id and values."""
    found = windows_grid(readings(spark, sf_dir), SPEC, GRID, STRIDE)
    size = F.col("context_steps") + F.col("horizon_steps")
    name = F.concat_ws("__", *KEYS, F.col("window_start").cast("string"), size.cast("string"))
    return found.select(name.alias("item_id"), F.concat("context", "target").alias("values"))
