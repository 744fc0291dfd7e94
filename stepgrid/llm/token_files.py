"""Token ids in files of patched frame-of-reference blocks.

Documents are range-partitioned and sorted by id; every task encodes its range
and writes files of bounded size into a folder all executors reach, under names
that no other attempt of the task uses. The table of written files is stored
last, with the attempts that counted, so a lost executor leaves at most files
no table names.

A file holds, all little-endian:

* ``SGPFOR01``
* the blocks of up to 512 ids after each other. A block's ids less their
  minimum are packed at the width that covers nine tenths of them; what is
  wider is an exception, with its position and its high part in lists
* the block index: minimum, width, number of exceptions and, for each block,
  where its packed words and exceptions start
* the documents: id, null flag, number of ids
* a footer with the counts and places of these parts
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stepgrid.llm.pieces import encoded_batches
from stepgrid.llm.textbytes import own_worker, slices
from stepgrid.session import fresh_path

MAGIC = b"SGPFOR01"
BLOCK = 512
PERCENTILE = 0.9
FILE_IDS = 8 << 20  # ids after which a task begins its next file
READERS = 10_000  # tasks that read files back; each reads one file after another
FOOTER = "<8sqqqqqqq"
FOOTER_SIZE = struct.calcsize(FOOTER)
BITS = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)  # the length of each 16-bit number


def bit_lengths(values: np.ndarray) -> np.ndarray:
    if values.size and values.max() >= len(BITS):
        return np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    return BITS[values]


def pack_words(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64-bit words with ``width`` bits for each value of a row; 64 values fill ``width`` words."""
    rows, n = values.shape
    out = np.zeros((rows, n * width // 64), np.uint64)
    values = values.astype(np.uint64)
    groups = values.reshape(rows, n // 64, 64)
    packed = out.reshape(rows, n // 64, width)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        packed[:, :, word] |= groups[:, :, i] << np.uint64(shift)
        if shift + width > 64:
            packed[:, :, word + 1] |= groups[:, :, i] >> np.uint64(64 - shift)
    return out


def unpack_words(words: np.ndarray, width: int, n: int) -> np.ndarray:
    rows = words.shape[0]
    groups = words.reshape(rows, n // 64, width)
    out = np.zeros((rows, n // 64, 64), np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        part = groups[:, :, word] >> np.uint64(shift)
        if shift + width > 64:
            part |= groups[:, :, word + 1] << np.uint64(64 - shift)
        out[:, :, i] = part & mask
    return out.reshape(rows, n)


def encode_file(ids: np.ndarray, doc_ids: np.ndarray, doc_null: np.ndarray, lengths: np.ndarray) -> bytes:
    """The bytes of one file; ``lengths`` are the numbers of ids of the documents, in order."""
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint32)
    grid[: len(ids)] = ids
    if len(ids) < len(grid):
        grid[len(ids) :] = ids[-1]
    grid = grid.reshape(blocks, BLOCK)
    low = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = grid - low[:, None]
    bits = bit_lengths(rest)
    width = np.sort(bits, axis=1, kind="stable")[:, int(np.ceil(PERCENTILE * BLOCK)) - 1] if blocks else np.zeros(0, np.uint8)
    wide = bits > width[:, None]
    n_wide = wide.sum(axis=1, dtype=np.uint16)
    size = width.astype(np.int64) * (BLOCK // 8) + n_wide.astype(np.int64) * 6
    start = np.cumsum(size) - size
    body = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width):
        of = np.flatnonzero(width == w)
        if w:
            kept = rest[of] & np.uint32((1 << int(w)) - 1)
            packed = pack_words(kept, int(w)).view(np.uint8)
            body[(start[of][:, None] + np.arange(packed.shape[1])).ravel()] = packed.ravel()
    block, position = np.nonzero(wide)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_wide, dtype=np.int64) - n_wide, n_wide)
    lists = start[block] + width[block].astype(np.int64) * (BLOCK // 8)
    places = position.astype("<u2").view(np.uint8).reshape(-1, 2)
    body[(lists + 2 * nth)[:, None] + np.arange(2)] = places
    high = (rest[block, position] >> width[block].astype(np.uint32)).astype("<u4").view(np.uint8).reshape(-1, 4)
    body[(lists + 2 * n_wide[block].astype(np.int64) + 4 * nth)[:, None] + np.arange(4)] = high
    at_index = len(MAGIC) + len(body)
    index = low.astype("<u4").tobytes() + width.astype("u1").tobytes() + n_wide.astype("<u2").tobytes() + start.astype("<i8").tobytes()
    docs = doc_ids.astype("<i8").tobytes() + doc_null.astype("u1").tobytes() + lengths.astype("<i8").tobytes()
    at_docs = at_index + len(index)
    footer = struct.pack(FOOTER, MAGIC, len(ids), BLOCK, blocks, len(MAGIC), at_index, at_docs, len(doc_ids))
    return b"".join([MAGIC, body.tobytes(), index, docs, footer])


def decode_blocks(raw: memoryview, first: int, last: int) -> np.ndarray:
    """Ids of blocks ``first`` to ``last`` of a file, found through its block index."""
    _, _, block_size, blocks, at_body, at_index, _, _ = struct.unpack(FOOTER, raw[-FOOTER_SIZE:])
    of = slice(first, last)
    low = np.frombuffer(raw, "<u4", blocks, at_index)[of]
    width = np.frombuffer(raw, "u1", blocks, at_index + 4 * blocks)[of]
    n_wide = np.frombuffer(raw, "<u2", blocks, at_index + 5 * blocks)[of].astype(np.int64)
    start = np.frombuffer(raw, "<i8", blocks, at_index + 7 * blocks)[of] + at_body
    data = np.frombuffer(raw, np.uint8)
    out = np.zeros((len(low), block_size), np.uint32)
    for w in np.unique(width):
        mine = np.flatnonzero(width == w)
        if w:
            taken = data[start[mine][:, None] + np.arange(int(w) * block_size // 8)]
            out[mine] = unpack_words(taken.view("<u8").reshape(len(mine), -1), int(w), block_size)
    block = np.repeat(np.arange(len(low)), n_wide)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_wide) - n_wide, n_wide)
    lists = start[block] + width[block].astype(np.int64) * (block_size // 8)
    position = data[(lists + 2 * nth)[:, None] + np.arange(2)].copy().view("<u2").ravel()
    high = data[(lists + 2 * n_wide[block] + 4 * nth)[:, None] + np.arange(4)].copy().view("<u4").ravel()
    out[block, position] |= high << width[block].astype(np.uint32)
    return out + low[:, None]


def decode_file(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids, document ids, null flags and lengths of a whole file."""
    view = memoryview(raw)
    magic, n, _, blocks, _, _, at_docs, docs = struct.unpack(FOOTER, view[-FOOTER_SIZE:])
    if magic != MAGIC or bytes(view[: len(MAGIC)]) != MAGIC:
        raise ValueError("not a token file")
    ids = np.concatenate([decode_blocks(view, b, min(b + 2048, blocks)).ravel() for b in range(0, blocks, 2048)] or [np.zeros(0, np.uint32)])[:n]
    doc_ids = np.frombuffer(raw, "<i8", docs, at_docs)
    null = np.frombuffer(raw, "u1", docs, at_docs + 8 * docs).astype(bool)
    return ids, doc_ids, null, np.frombuffer(raw, "<i8", docs, at_docs + 9 * docs)


def opened(uri: str):
    """File system and path of a shared folder, by any scheme Arrow knows."""
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Encode, write, and return the stored table of files: ``part, seq, path, n_docs, n_ids``.

    Files are in ascending order of document id by ``part``, then ``seq``.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("tokens")
        system, base = opened(folder)
        part, seq, held, total = TaskContext.get().partitionId(), 0, [], 0

        def flush():
            ids, doc_ids, null, lengths = (np.concatenate(x) for x in zip(*held, strict=True))
            path = f"{base}/{part:08d}-{seq:06d}-{uuid.uuid4().hex}.pfor"
            with system.open_output_stream(path) as out:
                out.write(encode_file(ids, doc_ids, null, lengths))
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path.rsplit("/", 1)[1]], "n_docs": [len(doc_ids)], "n_ids": [len(ids)]})

        for batch, ids, at in encoded_batches(slices(batches), tokenizer):
            # the end id goes behind the ids of each document
            ends = at[1:] + np.arange(batch.num_rows)
            with_end = np.full(len(ids) + batch.num_rows, end_id, np.uint32)
            inner = np.ones(len(with_end), bool)
            inner[ends] = False
            with_end[inner] = ids
            doc_ids = batch.column("doc_id")
            held.append((with_end, doc_ids.fill_null(0).to_numpy(), doc_ids.is_null().to_numpy(zero_copy_only=False), np.diff(at) + 1))
            total += len(with_end)
            if total >= FILE_IDS:
                yield flush()
                seq, held, total = seq + 1, [], 0
        if held:
            yield flush()

    system, base = opened(folder)
    system.create_dir(base, recursive=True)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    files = ordered.mapInArrow(write, "part long, seq long, path string, n_docs long, n_ids long")
    files.write.parquet(f"{folder}/files.parquet")
    return docs.sparkSession.read.schema(files.schema).parquet(f"{folder}/files.parquet")


def with_starts(files: DataFrame) -> DataFrame:
    """``start``: ids of all files before; sums by part first, so no window holds all files of a part and all parts."""
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).alias("_before"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    here = files.withColumn("start", F.coalesce(F.sum("n_ids").over(inner), F.lit(0)))
    return here.join(parts, "part").withColumn("start", F.col("start") + F.col("_before")).drop("_before")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Read the files back: ``doc_id, start, n_tokens, ids_crc32``, one row per document."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("files")
        system, base = opened(folder)
        for batch in batches:
            for name, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with system.open_input_file(f"{base}/{name}") as file:
                    ids, doc_ids, null, lengths = decode_file(file.read())
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                columns = [pa.array(doc_ids, mask=null), pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = with_starts(spark.read.parquet(f"{folder}/files.parquet")).select("path", "start")
    # a row stands for a whole file, which its size does not tell adaptive execution
    spread = files.repartition(max(1, min(files.count(), READERS)), "path")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_file_round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and return what the files hold per document.

    Null and empty texts hold the end id alone. Rows that share an id follow
    each other in no promised order; rows with a null id come first. An empty
    table writes no file. Only id and text are read from ``docs``.
    """
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, end_id, folder)
    return read_token_files(docs.sparkSession, folder)
