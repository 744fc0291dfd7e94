"""Kneser-Ney n-gram models: counting, estimating, and looking up in shards.

Units (bytes or characters) of an n-gram are packed into one 64-bit number, the
newest in the lowest bits: a mask gives the shorter history, a shift the
context. Tasks count whole texts and send each distinct n-gram once; the model
is estimated by joins of those counts on (group, n-gram), which spread over as
many partitions as there are n-grams.

The estimated model is stored as shards of hashes in sorted order. A scoring
task takes the distinct n-grams of a batch to the shards they belong to, one
shard at a time, keeping a bounded number of bytes of shards in memory. (The
n-grams of documents joined through a shuffle would be several times the size
of the texts.)
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepgrid.llm.textbytes import BASE, flat, mix, own_worker, slices, worker_state
from stepgrid.llm.token_files import opened
from stepgrid.session import fresh_path, settle

MOST_GROUPS = 5_000
SHARD_ROWS = 2_000_000  # 12 bytes each
SHARD_CACHE = 96 << 20  # bytes of shards a worker keeps
SCORE_BYTES = 3 << 20  # text scored at once: each unit takes some 60 bytes meanwhile
FLUSH = 3_000_000  # distinct n-grams a task holds before it sends them


@dataclass(frozen=True)
class Units:
    """How texts become units: ``split`` maps texts to units and document offsets."""

    split: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]
    bits: int
    order: int
    alphabet: int  # unseen units share the mass of one draw from so many

    def grams(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The n-gram that ends at each unit (zeros before a text begins), and document offsets."""
        units, at = self.split(texts)
        units = units.astype(np.uint64)
        place = np.arange(len(units), dtype=np.int32) - np.repeat(at[:-1].astype(np.int32), np.diff(at))
        keys = units.copy()
        for back in range(1, self.order):
            before = np.zeros(len(units), np.uint64)
            before[back:] = units[:-back] if len(units) > back else 0
            before[place < back] = 0
            keys |= before << np.uint64(self.bits * back)
        return keys, at

    def mask(self, n: int) -> int:
        return (1 << (self.bits * n)) - 1


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return flat(texts)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    letter, lower = np.zeros(1 << 16, bool), np.arange(1 << 16, dtype=np.uint32)
    for code in range(1 << 16):
        c = chr(code)
        if c.isalpha():
            letter[code] = True
            small = c.lower()
            if len(small) == 1 and ord(small) < 1 << 16:
                lower[code] = ord(small)
    return letter, lower


def letters_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters, with one space for each run of anything else.

    Letters beyond the first 65,536 code points fold into 2,048 units that no
    other character uses.
    """
    letter, lower = worker_state("letters", _letters)
    data, at = flat(texts)
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    far = codes >= 1 << 16
    near = np.where(far, 0, codes)
    is_letter = letter[near]
    units = np.where(is_letter, lower[near], 0x20).astype(np.uint32)
    if far.any():
        kinds, back = np.unique(codes[far], return_inverse=True)
        alpha = np.array([chr(c).isalpha() for c in kinds.tolist()], bool)[back]
        units[far] = np.where(alpha, 0xD800 | (codes[far] & 0x7FF), 0x20)
    space = units == 0x20
    keep = ~space
    keep[1:] |= ~space[:-1]
    inner = starts[:-1][starts[:-1] < len(units)]
    keep[inner] = True
    return units[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def gram_counts(docs: DataFrame, units: Units) -> DataFrame:
    """``group, gram, n`` over the whole texts of ``docs`` (columns ``group, text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("models")
        held: dict[str, list] = {}

        def merged(parts):
            keys = np.concatenate([k for k, _ in parts])
            kept, back = np.unique(keys, return_inverse=True)
            return kept, np.bincount(back, weights=np.concatenate([n for _, n in parts])).astype(np.int64)

        def sent():
            for group, parts in held.items():
                keys, n = merged(parts)
                for a in range(0, len(keys), 100_000):
                    size = len(keys[a : a + 100_000])
                    columns = [pa.array([group] * size), pa.array(keys[a : a + 100_000].view(np.int64)), pa.array(n[a : a + 100_000])]
                    yield pa.RecordBatch.from_arrays(columns, ["group", "gram", "n"])
            held.clear()

        for batch in slices(batches, size=SCORE_BYTES):
            groups = batch.column("group").dictionary_encode()
            codes = groups.indices.to_numpy()
            for code, group in enumerate(groups.dictionary.to_pylist()):
                mine = np.flatnonzero(codes == code)
                keys, _ = units.grams(batch.column("text").take(pa.array(mine)))
                held.setdefault(group, []).append(np.unique(keys, return_counts=True))
            if sum(len(k) for parts in held.values() for k, _ in parts) > FLUSH:
                for group in held:
                    held[group] = [merged(held[group])]
                if sum(len(k) for parts in held.values() for k, _ in parts) > FLUSH // 2:
                    yield from sent()
        yield from sent()

    counted = docs.select("group", "text").mapInArrow(run, "group string, gram long, n long")
    return counted.groupBy("group", "gram").agg(F.sum("n").alias("n"))


def _discount(n: Column, modified: bool) -> Column:
    if not modified:
        return F.col("d1")
    return F.when(n == 1, F.col("d1")).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def _discounts(counts: DataFrame, modified: bool) -> DataFrame:
    """Discounts of each group from its counts of counts."""
    t = [F.sum((F.col("n") == k).cast("double")).alias(f"t{k}") for k in range(1, 5)]
    of = counts.groupBy("group").agg(*t)
    y = F.coalesce(F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2")), F.lit(0.5))
    if not modified:
        return of.select("group", F.least(F.greatest(y, F.lit(0.05)), F.lit(0.95)).alias("d1"))

    def closed(k: int) -> Column:
        ratio = F.coalesce(F.try_divide(F.col(f"t{k + 1}"), F.col(f"t{k}")), F.lit(0.5))
        return F.least(F.greatest(k - (k + 1) * y * ratio, F.lit(0.05)), F.lit(k - 0.05)).alias(f"d{k}")

    return of.select("group", closed(1), closed(2), closed(3))


def estimate(counts: DataFrame, units: Units, modified: bool) -> DataFrame:
    """``n, part, group, gram, value``: log probabilities (part 0) and log back-off weights of contexts (part 1).

    Interpolated Kneser-Ney with one discount for each order and group, or
    with three by count (``modified``). The highest order uses counts, lower
    ones the number of different units seen before an n-gram.
    """
    tables = {units.order: counts}
    for n in range(units.order - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND(F.lit(units.mask(n)).cast("long"))
        tables[n] = settle(tables[n + 1].groupBy("group", shorter.alias("gram")).agg(F.count("*").alias("n")), "gram-counts")
    lower, out = None, []
    for n in range(1, units.order + 1):
        # one row for each group, of which callers bound the number (see store)
        rows = tables[n].join(F.broadcast(_discounts(tables[n], modified)), "group")
        rows = rows.withColumn("context", F.shiftrightunsigned("gram", units.bits) if n > 1 else F.lit(0).cast("long"))
        rows = rows.withColumn("less", F.least(F.col("n").cast("double"), _discount(F.col("n"), modified)))
        contexts = rows.groupBy("group", "context").agg(F.sum("n").alias("total"), (F.sum("less") / F.sum("n")).alias("weight"))
        rows = rows.join(contexts, ["group", "context"])
        if lower is None:
            below = F.lit(1.0 / units.alphabet)
        else:
            known = lower.select("group", F.col("gram").alias("shorter"), F.col("p").alias("below"))
            rows = rows.withColumn("shorter", F.col("gram").bitwiseAND(F.lit(units.mask(n - 1)).cast("long"))).join(known, ["group", "shorter"])
            below = F.col("below")
        p = (F.col("n") - F.col("less")) / F.col("total") + F.col("weight") * below
        lower = settle(rows.select("group", "gram", p.alias("p")), "gram-probabilities")
        out.append(lower.select(F.lit(n).alias("n"), F.lit(0).alias("part"), "group", "gram", F.log("p").alias("value")))
        weights = settle(contexts.select("group", "context", F.log("weight").alias("value")), "gram-weights")
        out.append(weights.select(F.lit(n).alias("n"), F.lit(1).alias("part"), "group", F.col("context").alias("gram"), "value"))
    table = out[0]
    for more in out[1:]:
        table = table.union(more)
    return table


def entry_hash(n, part, group: int, gram: np.ndarray) -> np.ndarray:
    seed = ((group * 2 + part) * 64 + n + 1) * BASE & 0xFFFFFFFFFFFFFFFF
    return mix(mix(gram.astype(np.uint64) + np.uint64(BASE)) ^ np.uint64(seed))


@dataclass(frozen=True)
class Model:
    """A stored model: where its shards are, and the number of each group."""

    folder: str
    shards: int
    groups: dict[str, int]
    units: Units


def store(table: DataFrame, groups: list[str], units: Units) -> Model:
    """Write an estimated model as shards of sorted hashes, each one file.

    Groups are languages; more than ``MOST_GROUPS`` are refused.
    """
    if len(groups) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    table = settle(table, "model")
    number = {g: k for k, g in enumerate(groups)}
    shards = 1
    rows = table.count()
    while rows > shards * SHARD_ROWS:
        shards *= 2
    shift = np.uint64(64 - (shards.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, part, gram = (batch.column(c).to_numpy() for c in ("n", "part", "gram"))
            group = np.array([number[g] for g in batch.column("group").to_pylist()], np.int64)
            h = np.zeros(len(n), np.uint64)
            for kind in np.unique(np.stack([n, part, group]), axis=1).T.tolist():
                mine = (n == kind[0]) & (part == kind[1]) & (group == kind[2])
                h[mine] = entry_hash(*kind, gram[mine].view(np.uint64))
            shard = (h >> shift).astype(np.int32) if shards > 1 else np.zeros(len(h), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(h.view(np.int64)), batch.column("value").cast(pa.float32())], ["shard", "h", "value"])

    folder = fresh_path(table.sparkSession, "model-shards")
    hashed = table.mapInArrow(run, "shard int, h long, value float")
    hashed.repartition(shards, "shard").sortWithinPartitions("shard", "h").write.partitionBy("shard").parquet(folder)
    return Model(folder, shards, number, units)


def _shard(model: Model, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and values of a shard, from the worker's memory or the shared folder."""
    cache = worker_state("model shards", OrderedDict)
    key = (model.folder, k)
    if key not in cache:
        import pyarrow.dataset as ds

        system, base = opened(model.folder)
        path = f"{base}/shard={k}"
        from pyarrow.fs import FileType

        if system.get_file_info(path).type == FileType.NotFound:
            cache[key] = np.zeros(0, np.int64), np.zeros(0, np.float32)
        else:
            table = ds.dataset(path, filesystem=system, format="parquet").to_table(columns=["h", "value"])
            h, value = table.column("h").to_numpy(), table.column("value").to_numpy()
            order = np.argsort(h, kind="stable")  # already sorted within a file
            cache[key] = h[order], value[order]
        while len(cache) > 1 and sum(h.nbytes + v.nbytes for h, v in cache.values()) > SHARD_CACHE:
            cache.popitem(last=False)
    cache.move_to_end(key)
    return cache[key]


def looked_up(model: Model, h: np.ndarray) -> np.ndarray:
    """Value of each hash; not a number where the model has none."""
    out = np.full(len(h), np.nan)
    shard = (h >> np.uint64(64 - (model.shards.bit_length() - 1))).astype(np.int64) if model.shards > 1 else np.zeros(len(h), np.int64)
    for k in np.unique(shard).tolist():
        mine = np.flatnonzero(shard == k)
        keys, values = _shard(model, k)
        if len(keys):
            wanted = h[mine].view(np.int64)
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            found = keys[at] == wanted
            out[mine[found]] = values[at[found]]
    return out


def log_probabilities(model: Model, grams: np.ndarray, group: str) -> np.ndarray:
    """Natural log probability of the last unit of each n-gram under one group's model."""
    units, number = model.units, model.groups[group]
    out = np.zeros(len(grams))
    open_ = np.arange(len(grams))
    for n in range(units.order, 0, -1):
        gram = grams[open_] & np.uint64(units.mask(n))
        value = looked_up(model, entry_hash(n, 0, number, gram))
        seen = ~np.isnan(value)
        out[open_[seen]] += value[seen]
        open_, gram = open_[~seen], gram[~seen]
        if not len(open_):
            return out
        context = gram >> np.uint64(units.bits) if n > 1 else np.zeros(len(gram), np.uint64)
        out[open_] += np.nan_to_num(looked_up(model, entry_hash(n, 1, number, context)))
    out[open_] -= np.log(units.alphabet)
    return out
