"""Near-duplicates by fast similarity sketches, bands and exact verification.

A document is the set of its word shingles. Its sketch has one coordinate per
bin. In round ``i`` every shingle is thrown into a bin by the round's hash and
the bin keeps the smallest value; an earlier round always wins. After as many
rounds as bins, bins still empty are filled one by one in as many rounds more,
each by the smallest hash over the whole set, so every coordinate is filled,
and the share of equal coordinates estimates the similarity with the
concentration of that many independent draws.

Equal sets are one class from then on, however many copies it has. Bands of
coordinates are buckets. In every bucket the members are first compared with
one centre only, which joins a group of near copies with as many comparisons
as members. Members of one bucket that are still in different components are
then compared with each other: pair by pair in small buckets, and in large
ones block by block, where a task multiplies the incidence matrices of two
blocks of bounded size and returns one link for every two components that
have one. No candidate pair is left out. All comparisons are made on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgrid.llm.components import components
from stepgrid.llm.textbytes import BASE, HASHED_BYTES, flat, mix, own_worker, run_hashes, slices, word_hashes, words
from stepgrid.session import settle

BANDS, BAND_ROWS = 50, 7  # a pair at 0.8 is missed with probability (1 - 0.8 ** 7) ** 50 = 8e-6
BROADCAST_IDS = 1_000_000  # ids, 8 bytes each, up to which a set of ids is sent to all tasks
SMALL = 16  # members up to which a bucket's pairs are rows
BLOCK = 256  # members of a block of a larger bucket, about
COLUMNS = 4096  # shingles multiplied at once
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
LOW = np.uint64((1 << 40) - 1)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of all texts after each other (52 bits of hash, sorted by text), and the texts' offsets."""
    data, at = flat(texts)
    data = np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)
    is_word = np.ones(256, bool)
    is_word[[0x20, *range(0x09, 0x0E)]] = False
    starts, ends, doc = words(data, at, is_word)
    tokens = word_hashes(data, starts, ends)
    found, first = run_hashes(tokens, doc, size)
    docs = [doc[first]]
    shingles = [found]
    n_words = np.bincount(doc, minlength=len(texts))
    for short in range(1, size):
        mine = (n_words == short)[doc]
        if mine.any():
            found, first = run_hashes(tokens[mine], doc[mine], short)
            shingles.append(found)
            docs.append(doc[mine][first])
    # fewer than 2**12 texts in a slice, so text and hash fit into one number to sort by
    keys = np.sort((np.concatenate(docs).astype(np.uint64) << np.uint64(52)) | (np.concatenate(shingles) >> np.uint64(12)))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    owner = (keys >> np.uint64(52)).astype(np.int64)
    return keys & np.uint64((1 << 52) - 1), np.searchsorted(owner, np.arange(len(texts) + 1))


def _thrown(shingles: np.ndarray, turn: int) -> np.ndarray:
    return mix(shingles + np.uint64((turn + 1) * BASE & 0xFFFFFFFFFFFFFFFF))


def sketches(shingles: np.ndarray, at: np.ndarray, bins: int) -> np.ndarray:
    """One row of ``bins`` coordinates per set; sets must not be empty."""
    n = len(at) - 1
    out = np.full(n * bins, EMPTY)
    owner = np.repeat(np.arange(n), np.diff(at))
    for turn in range(bins):
        h = _thrown(shingles, turn)
        place = ((h >> np.uint64(40)) * np.uint64(bins)) >> np.uint64(24)
        np.minimum.at(out, owner * bins + place.astype(np.int64), (h & LOW) | np.uint64(turn << 40))
        open_ = np.unique(owner)
        open_ = open_[(out.reshape(n, bins)[open_] == EMPTY).any(axis=1)]
        if not len(open_):
            return out.reshape(n, bins)
        wanted = np.zeros(n, bool)
        wanted[open_] = True
        keep = wanted[owner]
        shingles, owner = shingles[keep], owner[keep]
    for place in range(bins):
        turn = bins + place
        value = (_thrown(shingles, turn) & LOW) | np.uint64(turn << 40)
        np.minimum.at(out, owner * bins + place, value)
    return out.reshape(n, bins)


def sketch_table(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, n_shingles, d1, d2, bands``: set size, a digest of the set, and its band hashes (null if empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("sets")
        for batch in slices(batches, size=HASHED_BYTES):
            shingles, at = shingle_sets(batch.column("text"), size)
            n = np.diff(at)
            full = np.flatnonzero(n)
            digests = np.zeros((2, batch.num_rows), np.uint64)
            bands = np.zeros((len(full), BANDS), np.uint64)
            if len(full):
                starts = at[:-1][full]
                digests[0, full] = np.add.reduceat(mix(shingles), starts)
                digests[1, full] = np.add.reduceat(mix(shingles ^ np.uint64(BASE)), starts)
                rows = sketches(shingles, np.append(starts, len(shingles)), BANDS * BAND_ROWS).reshape(len(full), BANDS, BAND_ROWS)
                for k in range(BAND_ROWS):
                    bands = mix(bands * np.uint64(BASE) + rows[:, :, k])
                bands = mix(bands + np.arange(BANDS, dtype=np.uint64))
            ends = np.concatenate([[0], np.cumsum(n > 0) * BANDS])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands.view(np.int64).ravel()))
            columns = [batch.column("doc_id"), pa.array(n.astype(np.int64)), *(pa.array(d.view(np.int64)) for d in digests), lists]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def set_table(docs: DataFrame, size: int) -> DataFrame:
    """``doc_id, shingles``: full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("sets")
        for batch in slices(batches, size=HASHED_BYTES):
            shingles, at = shingle_sets(batch.column("text"), size)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(shingles.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], ["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles array<long>")


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose ``doc_id`` is in the stored table ``ids``; sent to all tasks only when counted to be few."""
    few = ids.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids.hint("merge"), "doc_id", "left_semi")


def sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """Full sets of the documents ``doc_id``, written to the shared folder."""
    return settle(set_table(with_ids(docs, settle(ids.distinct(), "ids")), size), "sets")


def linked_pairs(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets reach the similarity, written to the shared folder."""
    pairs = settle(pairs, "pairs")
    sets = sets_of(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")), docs, size)
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a")
    joined = joined.withColumn("both", F.size(F.array_intersect("sa", "sb")))
    joined = joined.where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both")))
    return settle(joined.select("a", "b").distinct(), "links")


def common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections, by products of incidence matrices over columns of shingles."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    owner, column = owner[shared], np.cumsum(often > 1)[column[shared]] - 1
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int((often > 1).sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [first, first + COLUMNS])
        present = np.zeros((len(sets), COLUMNS), np.float32)
        present[owner[lo:hi], column[lo:hi] - first] = 1
        out += present @ present.T
    return out


def block_links(members: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """A link ``a, b`` for every two components with one in a bucket of ``bucket, members, rep, component``.

    Members fall into blocks by hash. A member goes to every pair of blocks
    that holds its own, so each two members meet in one task, which holds two
    blocks.
    """
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", "bucket"), blocks).cast("int")
    rows = members.select("bucket", "rep", "component", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.select("bucket", "rep", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    sets = sets_of(members.select(F.col("rep").alias("doc_id")), docs, size).withColumnRenamed("doc_id", "rep")

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        n = part["shingles"].map(len).to_numpy()
        both = common([np.asarray(x, np.int64) for x in part["shingles"]])
        a, b = np.nonzero(np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1))
        rep, component = part["rep"].to_numpy(), part["component"].to_numpy()
        found = pd.DataFrame({"a": rep[a], "b": rep[b], "x": np.minimum(component[a], component[b]), "y": np.maximum(component[a], component[b])})
        return found[found["x"] != found["y"]].drop_duplicates(["x", "y"])[["a", "b"]]

    met = rows.join(sets.hint("merge"), "rep").groupBy("bucket", "i", "j").applyInPandas(compare, "a long, b long")
    return settle(met.select(*ordered_pair("a", "b")).distinct(), "links")


def ordered_pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns ``doc_id, n_shingles, component_id, kept``, one row per input row.

    Documents are linked when ``100 * intersection >= percent * union`` of
    their sets of ``size``-word shingles; ``component_id`` is the smallest id
    reachable by links and ``kept`` marks that document. A text with fewer
    words is one shingle; a null, empty or blank text has an empty set and is
    linked with nothing. Repeated rows link by their equal sets. Rows that
    share an id are one document with the links of all its rows. A row without
    an id is its own component (null) and kept. Only id and text are read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    sketched = settle(sketch_table(rows, size), "sketches")
    filled = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["n_shingles", "d1", "d2"]
    classes = settle(filled.groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    reps = filled.withColumn("rep", F.col("doc_id")).join(classes.hint("merge"), ["rep", *key], "left_semi")
    members = reps.select("rep", "n_shingles", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    crowded = settle(members.join(shared.hint("merge"), "bucket"), "buckets")

    # the centre of a bucket is the member that shares buckets with most others
    weight = crowded.groupBy("rep").agg(F.sum("members").alias("weight"))
    weighted = crowded.join(weight.hint("merge"), "rep").select("bucket", "rep", "n_shingles", "weight")
    first = F.max(F.struct("weight", (-F.col("rep")).alias("less"), "n_shingles")).alias("c")
    centre = weighted.groupBy("bucket").agg(first).select("bucket", (-F.col("c.less")).alias("centre"), F.col("c.n_shingles").alias("centre_n"))
    near = lambda x, y: F.least(x, y) * 100 >= F.greatest(x, y) * percent
    star = weighted.join(centre.hint("merge"), "bucket").where(F.col("rep") != F.col("centre")).where(near("n_shingles", "centre_n"))
    star = settle(star.select(*ordered_pair("rep", "centre")).distinct(), "pairs")
    links = linked_pairs(star, rows, size, percent)

    # members of one bucket that are not yet in one component
    known = components(links).withColumnRenamed("node", "rep")
    component = F.coalesce("component", "rep").alias("component")
    labelled = settle(weighted.join(known.hint("merge"), "rep", "left").select("bucket", "rep", "n_shingles", component), "labelled")
    counted = labelled.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members"))
    mixed = counted.where("lo < hi").select("bucket", "members")
    open_ = settle(labelled.join(mixed.hint("merge"), "bucket"), "open")
    few = open_.where(F.col("members") <= SMALL)
    x, y = few.alias("x"), few.alias("y")
    apart = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component"))
    rest = x.join(y.hint("merge"), apart & near("x.n_shingles", "y.n_shingles")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b"))
    rest = rest.distinct().join(star.hint("merge"), ["a", "b"], "left_anti")
    many = open_.where(F.col("members") > SMALL).select("bucket", "members", "rep", "component")
    links = links.union(linked_pairs(rest, rows, size, percent)).union(block_links(many, rows, size, percent))

    final = components(links).withColumnRenamed("node", "rep")
    of_class = settle(classes.join(final.hint("merge"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id")), "classes")
    out = sketched.join(of_class.hint("merge"), key, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, whole. Only the dropped ids meet the documents."""
    marked = near_duplicates(docs, size, percent)
    dropped = settle(marked.where("NOT kept").select(F.col("doc_id").alias("dropped")).distinct(), "dropped")
    few = dropped.count() <= BROADCAST_IDS
    other = F.broadcast(dropped) if few else dropped.hint("merge")
    return docs.join(other, docs["doc_id"].cast("long") == other["dropped"], "left_anti")
