"""Readers that turn subject data of many shapes into one long table."""

from __future__ import annotations

import csv
import os
import re
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgrid.operators.clean import clean_readings, from_ticks, parse_timestamps
from stepgrid.series import SeriesSpec
from stepgrid.session import settle

# Accepted column names, in order of preference.
TIME_NAMES = ("timestamp", "time", "datetime", "date_time", "date")
VALUE_NAMES = (
    "bgvalue",
    "glucose",
    "glucose_value",
    "glucose_value_mg_dl",
    "sensor_glucose",
    "value",
    "glucose_value_mmol_l",
)
BLOCK_BYTES = 4 << 20  # of a file read by a task at once
LINE_END = re.compile(rb"[\r\n]")
FILE_STEM = r"([^/]+)/([^/]+)\.csv$"


def find_column(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """First candidate present, ignoring case and outer blanks."""
    known = {c.strip().lower(): c for c in columns}
    return next((known[c] for c in candidates if c in known), None)


def resolve_columns(columns: list[str]) -> tuple[str, str]:
    """Time and value column; the value falls back to the second column."""
    time = find_column(columns, TIME_NAMES)
    value = find_column(columns, VALUE_NAMES) or (columns[1] if len(columns) > 1 else None)
    if time is None or value is None:
        raise ValueError(f"no time or value column among {columns}")
    return time, value


def read_nested_subjects(
    df: DataFrame, value_key: str = "BGvalue", ticks_per_second: int = 1, datasets: list[str] | None = None
) -> DataFrame:
    """Nested subject rows to clean readings.

    The dataset filter is on a scan column, so it prunes partitions or row
    groups before any array is read.
    """
    if datasets is not None:
        df = df.filter(F.col("dataset").isin(datasets))
    pair = F.explode(F.arrays_zip(F.col("timestamp").alias("t"), F.col(value_key).alias("v"))).alias("r")
    rows = df.select(F.col("dataset").cast("string"), F.col("subject_id").cast("string"), pair)
    rows = rows.select(
        "dataset",
        "subject_id",
        from_ticks(F.col("r.t"), F.lit(ticks_per_second)).alias("ts"),
        F.col("r.v").cast("double").alias("value"),
    )
    return clean_readings(rows, SeriesSpec())


def located(path: str):
    """The Arrow file system of a path, and the path in it; without a scheme it is a local one."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def opened(path: str):
    """A file of any store Arrow knows, as a stream."""
    files, name = located(path)
    return files.open_input_stream(name)


def read_until(path: str, done: Callable[[bytes], bool], block: int = 65536, files=None) -> str:
    """The beginning of a file, block by block until ``done`` says it is enough; ``files`` is its store, if known."""
    with files.open_input_stream(path) if files else opened(path) as stream:
        data = b""
        while not done(data):
            more = stream.read(block)
            if not more:
                break
            data += more
    return data.decode("utf-8-sig", "replace")


def header_line(path: str, files=None) -> str:
    """First line of a file, whatever its length; line ends inside quotes belong to it."""
    text = read_until(path, lambda data: any(part.count(b'"') % 2 == 0 for part in _prefixes(data)), files=files)
    quoted = False
    for at, c in enumerate(text):
        quoted ^= c == '"'
        if c in "\r\n" and not quoted:
            return text[:at]
    return text


def _prefixes(data: bytes) -> Iterator[bytes]:
    at = data.find(b"\n")
    while at >= 0:
        yield data[:at]
        at = data.find(b"\n", at + 1)


def source_path() -> Column:
    """Path of the file a row came from, without URL escapes."""
    return source_path_of("_metadata.file_path")


def source_path_of(column: str) -> Column:
    return F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B")))


def spread(df: DataFrame, tasks: int = 0) -> DataFrame:
    """Rows dealt to some tasks per core; each stands for work on a file."""
    return df.repartition(max(tasks, 4 * df.sparkSession.sparkContext.defaultParallelism))


def list_files(spark: SparkSession, root: str, ending: str) -> DataFrame:
    """``path, size`` of the files under a folder, paths from ``root`` on; hidden names are left out.

    Every level of folders is listed by tasks, as a tree of subjects has too
    many for the driver. ``root`` may be a file as well.
    """
    level, found = spark.createDataFrame([("",)], "path string"), []

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, base = located(root.rstrip("/"))
        for batch in batches:
            out = []
            for path in batch["path"]:
                own = files.get_file_info(base) if path == "" else None
                if own is not None and own.type == fs.FileType.File:
                    out.append(("", own.size))
                    continue
                for at in files.get_file_info(fs.FileSelector(base + path)):
                    name = at.base_name
                    if name.startswith(".") or (name.startswith("_") and "=" not in name):
                        continue
                    if at.type == fs.FileType.Directory:
                        out.append((f"{path}/{name}", None))
                    elif name.endswith(ending):
                        out.append((f"{path}/{name}", at.size))
            yield pd.DataFrame(out, columns=["path", "size"]).astype({"path": "str", "size": "Int64"})

    while not found or not level.isEmpty():
        listed = settle((spread(level) if found else level).mapInPandas(entries, "path string, size long"), "listing")
        found.append(listed.where("size IS NOT NULL"))
        level = listed.where("size IS NULL").select("path")
    return reduce(DataFrame.union, found)


LAYOUT = "path string, size long, header string, time_at int, value_at int, problem string"


def csv_layouts(spark: SparkSession, root: str, columns: tuple[str, str] | None = None) -> DataFrame:
    """One row per CSV file: its header and the places of time and value, or the problem with it.

    ``path`` counts from ``root`` on. Only the first line of each file is read,
    on the executors.
    """

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = located(root.rstrip("/"))
        for batch in batches:
            out = []
            for path, size in zip(batch["path"], batch["size"], strict=True):
                header = header_line(base + path, files)
                names = [c.strip() for c in next(csv.reader([header]), [])]
                row = {"path": path, "size": size, "header": header, "time_at": None, "value_at": None, "problem": None}
                try:
                    time, value = columns if columns else resolve_columns(names)
                    row |= {"time_at": names.index(time), "value_at": names.index(value)}
                except ValueError as problem:
                    row["problem"] = str(problem)
                out.append(row)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LAYOUT.split(", ")]).astype({"time_at": "Int32", "value_at": "Int32"})

    return spread(list_files(spark, root, ".csv")).mapInPandas(resolve, LAYOUT)


def unresolved_csvs(spark: SparkSession, root: str, columns: tuple[str, str] | None = None) -> DataFrame:
    """``path, problem`` of the files :func:`read_subject_csvs` leaves out."""
    path = F.concat(F.lit(root.rstrip("/")), "path").alias("path")
    return csv_layouts(spark, root, columns).where("problem IS NOT NULL").select(path, "problem")


def block_lines(stream, start: int, end: int) -> list[str]:
    """Lines that start in a range of bytes of a file, the last one whole; empty ones may be among them."""
    stream.seek(max(start - 1, 0))
    data = stream.read(end - max(start - 1, 0))
    if start:
        first = LINE_END.search(data)
        data = data[first.end() :] if first else b""
    while data and data[-1:] not in b"\r\n":
        more = stream.read(65536)
        stop = LINE_END.search(more)
        data += more[: stop.end()] if stop else more
        if not more:
            break
    return [line.decode("utf-8", "replace") for line in LINE_END.split(data)]


def csv_lines(layouts: DataFrame, root: str) -> DataFrame:
    """``path, block, time_at, value_at, line`` of every line but empty ones and the header.

    A task reads whole small files one after another and blocks of large ones.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = located(root.rstrip("/"))
        names = ["path", "block", "time_at", "value_at"]

        def table(held):
            each = [len(lines) for _, lines in held]
            columns = {c: pd.Series([row[k] for row, _ in held]).repeat(each).to_numpy() for k, c in enumerate(names)}
            return pd.DataFrame(columns | {"line": [line for _, lines in held for line in lines]})

        for batch in batches:
            held, size = [], 0
            for row in batch.itertuples(index=False):
                end = min(row.size, (row.block + 1) * BLOCK_BYTES)
                with files.open_input_file(base + row.path) as stream:
                    lines = (line.removeprefix("\ufeff") for line in block_lines(stream, row.block * BLOCK_BYTES, end))
                    lines = [line for line in lines if line not in ("", row.header)]
                held.append(((row.path, row.block, row.time_at, row.value_at), lines))
                size += sum(map(len, lines))
                if size >= BLOCK_BYTES:
                    yield table(held)
                    held, size = [], 0
            if held:
                yield table(held)

    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("size") - 1, F.lit(0)) / BLOCK_BYTES))).alias("block")
    cut = layouts.select("path", "size", "header", "time_at", "value_at", blocks)
    return spread(cut).mapInPandas(read, "path string, block long, time_at int, value_at int, line string")


def read_subject_csvs(
    spark: SparkSession, root: str, path_pattern: str = FILE_STEM, columns: tuple[str, str] | None = None
) -> DataFrame:
    """A tree of subject CSVs with free headers to clean readings.

    Dataset and subject come from the path by ``path_pattern``. The files are
    listed and read by tasks, however many there are; each line meets the
    layout of its file. Files whose columns cannot be resolved are left out and
    listed by :func:`unresolved_csvs`. ``columns`` names time and value for
    vendor layouts.
    """
    layouts = settle(csv_layouts(spark, root, columns).where("problem IS NULL"), "layouts")
    files, last = layouts.agg(F.count("*"), F.max(F.greatest("time_at", "value_at"))).first()
    if not files:
        raise ValueError(f"no usable CSV under {root}")
    # cells behind the last one that any file needs are not parsed
    rows = csv_lines(layouts, root)
    rows = rows.withColumn("cells", F.from_csv("line", F.lit(", ".join(f"c{k} string" for k in range(last + 1))), {"columnPruning": "false"}))
    rows = rows.withColumn("cells", F.array(*[F.col(f"cells.c{k}") for k in range(last + 1)]))
    path = F.concat(F.lit(root.rstrip("/")), "path")
    rows = rows.select(
        F.regexp_extract(path, path_pattern, 1).alias("dataset"),
        F.regexp_extract(path, path_pattern, 2).alias("subject_id"),
        F.col("path").alias("source"),
        "block",
        F.get("cells", F.col("time_at")).alias("raw_ts"),
        F.get("cells", F.col("value_at")).alias("value"),
    )
    # the units need a pass of their own; the files are opened once
    parsed = parse_timestamps(settle(rows, "csv-lines"), "raw_ts", ["source"], salt=F.col("block"))
    return clean_readings(parsed.drop("raw_ts", "block"), SeriesSpec(), ["source", "value"])


def dataset_from_path(path: Column, container: str = "controlled_dataset") -> Column:
    """Dataset folder of a subject file, looking through a container folder."""
    inner = F.regexp_extract(path, rf"/{container}/([^/]+)/", 1)
    return F.when(inner != "", inner).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def skip_mixed(df: DataFrame, path: str, only_if_others: bool = False) -> DataFrame:
    """Leave out pooled ``mixed`` copies; as a fallback keep them where a
    table holds nothing else."""
    is_mixed = F.col(path).contains("/mixed/")
    if not only_if_others:
        return df.filter(~is_mixed)
    others = df.filter(~is_mixed).agg(F.count("*").alias("n")).select("n").scalar()
    return df.filter(~is_mixed | (others == 0))


def read_event_xml(spark: SparkSession, root: str, variate: str = "glucose_level", attr: str = "value") -> DataFrame:
    """Event attributes under one element; seconds are set to zero."""
    schema = f"{variate} struct<event: array<struct<_ts: string, _{attr}: string>>>"
    raw = spark.read.format("xml").option("rowTag", "patient").schema(schema).load(root)
    rows = raw.select(
        F.regexp_extract(source_path(), r"([^/]+?)(\.[^./]*)?$", 1).alias("subject_id"), F.explode(f"{variate}.event").alias("e")
    )
    ts = F.date_trunc("minute", F.try_to_timestamp(F.col("e._ts"), F.lit("dd-MM-yyyy HH:mm:ss")))
    return rows.select("subject_id", ts.alias("ts"), F.col(f"e._{attr}").try_cast("double").alias("value"))


def _tsf_heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        heads = []
        for path in batch["path"]:
            text = read_until(path, lambda data: b"@data" in data and b"\n" in data[data.index(b"@data") :])
            lines = [line.strip() for line in text.splitlines()]
            heads.append("\n".join(line for line in lines[: lines.index("@data") + 1 if "@data" in lines else 0] if line.startswith("@")))
        yield pd.DataFrame({"head": heads})


def read_tsf(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Series rows and the header facts of a ``.tsf`` file or folder of
    files with the same header. Only the heads of the files are read for it."""
    files = spark.read.format("binaryFile").load(path).select(source_path().alias("path"))
    heads = files.mapInPandas(_tsf_heads, "head string").where("head <> ''")  # a part of a file may have none
    heads = [r.head for r in heads.distinct().limit(2).collect()]
    if len(heads) > 1:
        raise ValueError("files with different headers")
    head = "".join(heads).split("\n")
    ordered = [h.split(" ")[1] for h in head if h.startswith("@attribute")]
    names = {h.split(" ")[1]: h.split(" ")[2] for h in head if h.startswith("@attribute")}
    facts = {h.split(" ")[0][1:]: h.split(" ")[1] for h in head if h.count(" ") == 1}
    if not names or "@data" not in head:
        raise ValueError("missing attribute or data section")
    lines = spark.read.text(path, lineSep="\n").select(F.trim("value").alias("line")).filter("line <> ''")
    parts = F.split("line", ":")
    rows = lines.filter(~F.col("line").startswith("@") & ~F.col("line").startswith("#"))
    rows = rows.withColumn("_p", parts)
    bad = F.raise_error(F.concat(F.lit("wrong number of attributes: "), F.substring("line", 1, 80)))
    rows = rows.withColumn("_p", F.when(F.size("_p") == len(ordered) + 1, F.col("_p")).otherwise(bad))

    def typed(i: int, name: str) -> Column:
        raw = F.get("_p", F.lit(i))
        kind = names[name]
        if kind == "numeric":
            return raw.cast("bigint").alias(name)
        if kind == "date":
            return F.try_to_timestamp(raw, F.lit("yyyy-MM-dd HH-mm-ss")).alias(name)
        return raw.alias(name)

    values = F.transform(
        F.split(F.get("_p", F.lit(len(ordered))), ","), lambda v: F.nullif(F.trim(v), F.lit("?")).cast("double")
    )
    values = F.when(F.exists(values, lambda v: v.isNotNull()), values).otherwise(F.raise_error(F.lit("all values missing")))
    return rows.select(*[typed(i, n) for i, n in enumerate(ordered)], values.alias("series_value")), facts


def read_participants(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """``{dataset: [patient, ...]}`` as (dataset, patient) rows, unique by
    patient; a patient in two datasets fails the job.

    One document per file, or with ``multiline=False`` one per line, which
    splits a large file over tasks.
    """
    raw = spark.read.text(path, wholetext=multiline)
    pairs = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("dataset", "patients"))
    return unique_patients(pairs.select("dataset", F.explode("patients").alias("patient")))


def unique_patients(pairs: DataFrame) -> DataFrame:
    clash = F.raise_error(F.concat(F.lit("patient in several datasets: "), F.col("patient")))
    found = pairs.groupBy("patient").agg(F.min("dataset").alias("a"), F.max("dataset").alias("b"))
    return found.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(clash).alias("dataset"), "patient")


def read_seg_table(spark: SparkSession, path: str) -> DataFrame:
    """A square text grid of risks as (ref_i, meas_i, risk), absolute values.

    Row numbers follow the file order, so the file is read as one text value;
    a grid has a fixed size of about 600 x 600.
    """
    raw = spark.read.text(path, wholetext=True)
    line = F.posexplode(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != "")).alias("ref_i", "line")
    rows = raw.select(line)
    cell = F.posexplode(F.split(F.trim("line"), r"[\s,]+")).alias("meas_i", "cell")
    return rows.select("ref_i", cell).select("ref_i", "meas_i", F.abs(F.col("cell").cast("double")).alias("risk"))


def seg_table_report(table: DataFrame) -> DataFrame:
    """One row of checks: square, complete, zero diagonal, range."""
    diagonal = F.max(F.when(F.col("ref_i") == F.col("meas_i"), F.abs("risk")))
    return table.agg(
        (F.max("ref_i") + 1).alias("rows"),
        (F.max("meas_i") + 1).alias("columns"),
        (F.count("*") == (F.max("ref_i") + 1) * (F.max("meas_i") + 1)).alias("complete"),
        (F.max("ref_i") == F.max("meas_i")).alias("square"),
        (diagonal <= 1e-3).alias("zero_diagonal"),
        F.min("risk").alias("low"),
        F.max("risk").alias("high"),
    )
