"""Exact duplicates by a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, kept in a folder
all executors reach. A batch of documents is reduced to one row per digest
first (map-side, so a group of copies of any size is one row per task), and
those rows meet the index in a sort-merge anti-join that moves only the batch;
what is new is appended. Texts are shuffled only by :func:`keep_distinct`,
which has to return them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stepgrid.session import fresh_path

SALTS = 64  # parts of a group of copies; those it has rows in are the bits of a long


def digest(text: str | Column = "text") -> Column:
    """SHA-256 of a text in UTF-8 as 32 bytes; null counts as empty."""
    col = F.col(text) if isinstance(text, str) else text
    return F.unhex(F.sha2(F.coalesce(col, F.lit("")), 256))


class DigestIndex:
    """Digests seen so far, with the id that stays for each: ``digest, keep_id``."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        """Open the index at ``path`` (made if missing; a new folder if none is given).

        ``buckets`` is fixed when the index is made and must be given again
        when it is opened; size it for the final number of digests (a few
        million per bucket). It starts at the number of shuffle partitions.
        """
        self.spark = spark
        self.path = path or fresh_path(spark, "digest-index")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def new_groups(self, groups: DataFrame) -> DataFrame:
        """Rows of ``groups`` (one per digest) whose digest the index lacks."""
        return groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame) -> None:
        """Add ``digest, keep_id`` rows; the caller has removed known digests."""
        rows = groups.select("digest", "keep_id").repartition(self.buckets, "digest")
        rows.write.format("parquet").mode("append").bucketBy(self.buckets, "digest").sortBy("digest").option("path", self.path).saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def drop_name(self) -> None:
        """Forget the session's name of the table; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def text_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per distinct text: ``digest, keep_id`` (largest id), ``group_size``, and ``salts``, the parts it has rows in."""
    rows = _rows(docs, id_column, text_column)
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, digest`` and the part of its group of copies that a row falls into, by its id."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), digest(text_column).alias("digest"))
    return rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))


def deduplicate(docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Mark the rows of ``docs`` and append the new texts to ``index``.

    Returns one row per input row: ``doc_id, keep_id, group_size, kept,
    text_sha256``. Of texts new to the index the row with the largest id stays;
    a text the index knows is dropped in favour of the indexed id. Null and
    empty texts are one group. Rows with a null id are copies like others and
    stay only when all of their group have none. Rows that repeat both id and
    text are each marked like the row they repeat; :func:`keep_distinct` keeps
    one of them. Only id and text are read from ``docs``.

    The returned plan reads the index as it is after the append.
    """
    groups = text_groups(docs, id_column, text_column)
    index.append(index.new_groups(groups))
    rows = _rows(docs, id_column, text_column)
    sized = groups.select("digest", "group_size", "salts").join(index.table().hint("merge"), "digest")
    # a group is repeated for the parts it has rows in, so no task reads more of its copies than one part
    parts = F.expr(f"filter(sequence(0, {SALTS - 1}), part -> (salts & shiftleft(1L, part)) != 0)")
    sized = sized.withColumn("salt", F.explode(parts)).drop("salts")
    marked = rows.join(sized.hint("merge"), ["digest", "salt"])
    return marked.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_distinct(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The rows of ``docs`` that stay, whole, with texts new to ``index`` appended to it.

    Rows that repeat id and text are reduced to one on the map side, before
    the join, so that no group meets in one task with its texts.
    """
    groups = text_groups(docs)
    fresh = index.new_groups(groups)
    columns = docs.columns
    tag = uuid.uuid4().hex[:8]
    mark, key, lacks = f"_digest_{tag}", f"_id_{tag}", f"_lacks_{tag}"
    # an id and whether it is missing: equal keys of both steps, so one exchange serves both
    at = lambda c: {key: F.coalesce(c, F.lit(0).cast("long")), lacks: c.isNull()}
    stay = fresh.withColumns(at(F.col("keep_id"))).select(F.col("digest").alias(mark), key, lacks)
    rows = docs.withColumns({mark: digest("text"), **at(F.col("doc_id").cast("long"))}).dropDuplicates([mark, key, lacks])
    out = rows.join(stay.hint("merge"), [mark, key, lacks], "left_semi")
    out = out.select(*[F.col(f"`{c}`") for c in columns])
    path = fresh_path(docs.sparkSession, "distinct")
    out.write.parquet(path)
    index.append(fresh)
    return docs.sparkSession.read.schema(out.schema).parquet(path)
