"""Benchmark decontamination by greedy string tiling.

Every run of ``SEED`` words of a test item is a seed. Documents are hashed run
by run (a running Karp-Rabin hash over whole texts), and their seeds join the
items' on the hash. What a text and an item share meets in one group: seeds on
one diagonal are a match, and the longest match that touches no marked word is
marked, again and again, until none of ``SEED`` words is left. The share of an
item's words that tiles cover does not depend on the order of its passages.

A bitmap of fixed size holds the items' hashes and goes to all tasks, so only
seeds that items probably have are shuffled, never texts. Equal texts are one
row after the map side. A row of the join holds all places of a seed in the
text and in the item, so repeated words make long rows, not many.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgrid.llm.phrases import as_bitmap, holds
from stepgrid.llm.textbytes import HASHED_BYTES, flat, own_worker, run_hashes, slices, word_hashes, words
from stepgrid.session import settle

SEED = 5  # words of the shortest tile
COVERAGE = 0.5  # share of an item's words in tiles from which a document counts as contaminated
SEED_BITS = 27  # of the bitmap of seeds, whatever their number; a wrong bit costs a row, never a result
SALTS = 16  # parts of a seed that many texts hold
BROADCAST_TEXTS = 250_000  # rows of 40 bytes up to which the judged texts are sent to all tasks


# fixed values: code points of scripts without spaces between words, and of
# spaces and punctuation beyond ASCII
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF)]
SIGNS = [(0x0080, 0x00A9), (0x00AB, 0x00B4), (0x00B6, 0x00B9), (0x00BB, 0x00BF), (0x00D7, 0x00D7), (0x00F7, 0x00F7), (0x2000, 0x206F), (0x3000, 0x3003), (0x3008, 0x3020), (0x3030, 0x3030), (0x30FB, 0x30FB), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65)]
ASCII_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def _among(points: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    found = np.zeros(len(points), bool)
    for low, high in ranges:
        found |= (points >= low) & (points <= high)
    return found


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, case and punctuation aside, and each word's text.

    A character of a script that puts no spaces between words is a word.
    """
    data, at = flat(pc.utf8_lower(texts.fill_null("")))
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        starts, ends, doc = words(data, at, ASCII_WORD)
        return word_hashes(data, starts, ends), doc
    size = 1 + (data[lead] >= 0xC0) + (data[lead] >= 0xE0) + (data[lead] >= 0xF0)
    byte = lambda k: (data[np.minimum(lead + k, len(data) - 1)] & 0x3F).astype(np.uint32)
    points = np.where(
        size == 2,
        (data[lead] & 0x1F).astype(np.uint32) << 6 | byte(1),
        np.where(size == 3, (data[lead] & 0x0F).astype(np.uint32) << 12 | byte(1) << 6 | byte(2), (data[lead] & 0x07).astype(np.uint32) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)),
    )
    inside = ASCII_WORD[data]
    sign, alone = _among(points, SIGNS), _among(points, UNSPACED)
    for k in range(4):
        inside[lead[sign & (size > k)] + k] = False
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[at] = edge[lead[alone]] = edge[(lead + size)[alone]] = True
    cuts = np.flatnonzero(edge)
    keep = inside[cuts[:-1]]
    starts, ends = cuts[:-1][keep], cuts[1:][keep]
    return word_hashes(data, starts, ends), np.searchsorted(at, starts, "right") - 1


def seed_batch(texts: pa.Array, keep=None) -> tuple[np.ndarray, np.ndarray, pa.ListArray, np.ndarray]:
    """Text and hash of every distinct seed of a text, its places there, and the texts' lengths in words.

    ``keep`` tells which hashes matter. Texts of fewer words than a seed have none.
    """
    tokens, text = tokens_of(texts)
    length = np.bincount(text, minlength=len(texts)).astype(np.int64)
    start = np.cumsum(length) - length
    hashes, first = run_hashes(tokens, text, SEED)
    if keep is not None:
        found = keep(hashes)
        hashes, first = hashes[found], first[found]
    order = np.lexsort((first, hashes, text[first]))
    hashes, first = hashes[order], first[order]
    owner = text[first]
    heads = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])])) if len(first) else np.zeros(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.append(heads, len(first)), pa.int32()), pa.array((first - start[owner]).astype(np.int32)))
    return owner[heads], hashes[heads], places, length


def seeds_of(batches: Iterator[pa.RecordBatch], keep=None) -> Iterator[tuple]:
    """Slices of batches, small enough for their words to be hashed, with what :func:`seed_batch` finds in them."""
    for batch in slices(batches, size=HASHED_BYTES):
        yield batch, *seed_batch(batch.column("text"), keep)


def item_seeds(items: DataFrame) -> DataFrame:
    """``item, item_id, n_rows, length, hash, places`` of the distinct items ``item, item_id, n_rows, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("sets")
        for batch, owner, hashes, places, length in seeds_of(batches):
            kept = [batch.column(c).take(pa.array(owner)) for c in ("item", "item_id", "n_rows")]
            columns = [*kept, pa.array(length[owner]), pa.array(hashes.view(np.int64)), places]
            yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "n_rows", "length", "hash", "places"])

    return items.mapInArrow(run, "item binary, item_id long, n_rows long, length long, hash long, places array<int>")


def text_seeds(texts: DataFrame, bitmap) -> DataFrame:
    """``key, hash, at`` of every distinct seed of the texts ``key, text`` that the bitmap holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("sets")
        for batch, owner, hashes, places, _ in seeds_of(batches, lambda h: holds(bitmap.value, h, SEED_BITS)):
            columns = [batch.column("key").take(pa.array(owner)), pa.array(hashes.view(np.int64)), places]
            yield pa.RecordBatch.from_arrays(columns, ["key", "hash", "at"])

    return texts.mapInArrow(run, "key binary, hash long, at array<int>")


def matches(seeds: dict[int, np.ndarray]) -> list[tuple[int, int, int]]:
    """Maximal matches ``(-words, place in the item, place in the text)``.

    ``seeds`` maps a place in the item to the sorted places of its seed in the
    text. Only the matches that are still open are held beside those found.
    """
    out = []
    none = np.zeros(0, np.int64)
    last, run, before = none, none, -2

    def close(ended: np.ndarray) -> None:
        n = run[ended]
        out.extend(zip((-(n + SEED - 1)).tolist(), (before - n + 1).tolist(), (last[ended] - n + 1).tolist(), strict=True))

    for place in sorted(seeds):
        where = np.asarray(seeds[place], np.int64)
        if place != before + 1:
            close(np.arange(len(last)))
            last, run = none, none
        at = np.searchsorted(last, where - 1)
        goes = np.append(last, -2)[at] == where - 1
        open_ = np.ones(len(last), bool)
        open_[at[goes]] = False
        close(np.flatnonzero(open_))
        longer = np.ones(len(where), np.int64)
        longer[goes] += run[at[goes]]
        last, run, before = where, longer, place
    close(np.arange(len(last)))
    return out


def tiled(seeds: dict[int, np.ndarray], length: int) -> int:
    """Words of an item of ``length`` words covered by greedy tiles, from the seeds it shares with one text."""
    heap = matches(seeds)
    heapq.heapify(heap)
    in_item, in_doc = bytearray(length), set()
    covered = 0
    while heap and covered < length:
        n, p, w = heapq.heappop(heap)
        n = -n
        free = [not in_item[p + k] and w + k not in in_doc for k in range(n)]
        if all(free):
            in_item[p : p + n] = b"\1" * n
            in_doc.update(range(w, w + n))
            covered += n
            continue
        k = 0  # what other tiles left of this match competes again
        while k < n:
            if not free[k]:
                k += 1
                continue
            end = k
            while end < n and free[end]:
                end += 1
            if end - k >= SEED:
                heapq.heappush(heap, (k - end, p + k, w + k))
            k = end
    return covered


def _share(part: pd.DataFrame) -> pd.DataFrame:
    """Covered share of one item in one text."""
    seeds = {int(p): at for places, at in zip(part["places"], part["at"], strict=True) for p in places}
    length = int(part["length"].iloc[0])
    out = part[["key", "item_id", "n_rows"]].head(1).copy()
    out["item_id"] = out["item_id"].astype("Int64")
    out["share"] = tiled(seeds, length) / length
    return out


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def judged_texts(texts: Column, docs: DataFrame, benchmark: DataFrame, item_column: str, item_text: str, coverage: float) -> DataFrame:
    """``key, coverage, item_id, n_items`` of every distinct text that shares a seed with an item, written to the shared folder."""
    items = benchmark.select(F.col(item_column).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    items = items.groupBy(text_key(F.col("text")).alias("item")).agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_rows"), F.max("text").alias("text"))
    seeds = settle(item_seeds(items), "seeds")
    bitmap = as_bitmap(seeds, F.shiftrightunsigned("hash", 64 - SEED_BITS), SEED_BITS)
    found = text_seeds(docs.select(text_key(texts).alias("key"), F.coalesce(texts.cast("string"), F.lit("")).alias("text")), bitmap)
    found = found.dropDuplicates(["key", "hash"]).withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    salted = seeds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = found.join(salted.hint("merge"), ["hash", "salt"]).select("key", "item", "item_id", "n_rows", "length", "places", "at")
    shares = met.groupBy("key", "item").applyInPandas(_share, "key binary, item_id long, n_rows long, share double")
    best = F.max(F.struct("share", F.col("item_id").isNotNull().alias("named"), (-F.col("item_id")).alias("less"))).alias("best")
    many = F.sum(F.when(F.col("share") >= coverage, F.col("n_rows")).otherwise(0)).alias("n_items")
    judged = shares.groupBy("key").agg(best, many)
    return settle(judged.select("key", F.col("best.share").alias("coverage"), (-F.col("best.less")).alias("item_id"), "n_items"), "judged")


def _sent(judged: DataFrame) -> DataFrame:
    """The judged texts for a join; sent to all tasks only when counted to be few."""
    return F.broadcast(judged) if judged.count() <= BROADCAST_TEXTS else judged.hint("merge")


def contamination(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", coverage: float = COVERAGE
) -> DataFrame:
    """``docs`` with ``contaminated, coverage, item_id, n_items`` after its own columns.

    ``coverage`` is the largest share of a test item's words that tiles cover,
    ``item_id`` the item (smallest id of equals; null if no item shares a
    seed), ``n_items`` the number of items covered to at least ``coverage``;
    ``contaminated`` says that there is one. Null and empty texts and items
    match nothing, and neither do items of fewer than five words: they can't be
    told from chance. Repeated rows are judged each. An empty benchmark leaves
    all documents clean. Columns of ``docs`` with the names of the new ones
    come back under their names with ``_input`` added, as often as it takes.
    """
    new = ["coverage", "item_id", "n_items", "contaminated"]
    docs_columns = docs.columns
    names, taken = [], set(new) | {c.lower() for c in docs_columns}
    for c in docs_columns:
        if c.lower() in new:
            while c.lower() in taken:
                c += "_input"
            taken.add(c.lower())
        names.append(c)
    docs = docs.toDF(*names)
    tag = f"_text_{uuid.uuid4().hex[:8]}"
    text = F.col(f"`{names[docs_columns.index(text_column)]}`")
    judged = judged_texts(text, docs, benchmark, item_column, item_text, coverage).withColumnRenamed("key", tag)
    rows = docs.withColumn(tag, text_key(text)).join(_sent(judged), tag, "left")
    own = [F.col(f"`{c}`") for c in names]
    found = [F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "item_id", F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items")]
    return rows.select(*own, *found).withColumn("contaminated", F.col("n_items") > 0)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their own columns."""
    tag = f"_text_{uuid.uuid4().hex[:8]}"
    judged = judged_texts(F.col("text"), docs, benchmark, "item_id", "text", COVERAGE)
    dirty = judged.where("n_items > 0").select(F.col("key").alias(tag))
    rows = docs.withColumn(tag, text_key(F.col("text")))
    return rows.join(_sent(dirty), tag, "left_anti").drop(tag)
