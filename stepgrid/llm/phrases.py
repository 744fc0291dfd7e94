"""Collocations: frequent phrases found by Rabin-Karp fingerprints, scored by their weakest cut.

Every n-gram of a slice of text is hashed at once from prefix polynomials over
its words (modulo 2**64, by numpy). A shuffle adds up occurrences by
fingerprint and keeps one occurrence pointer (document, word) of each. Only
phrases that turn out frequent become text: their pointers are taken back to
the documents they point into.

A phrase can only be frequent if all its parts are, so words are counted first;
then pairs of frequent words by the first half of their fingerprints alone,
which shuffles a few bytes a pair; then pairs and longer runs of what may be
frequent pairs. What is frequent is handed to the next pass as a bitmap of a
fixed number of bits, whatever the size of the corpus: a bit set by another
fingerprint lets a rare phrase into the exact count, which drops it.

A second fingerprint of each occurrence travels along as its least and largest
value. Where they differ, phrases share a fingerprint; those are counted again
by their text.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepgrid.llm.textbytes import BASE, flat, mix, own_worker, slices, worker_state, words
from stepgrid.series import spread_join
from stepgrid.session import settle

SECOND = 0xD6E8FEB86659FD93  # odd base of the second fingerprint
SLICE = 2 << 20  # bytes of text in the arrays of a task at once
HASH_BYTES = 1 << 18  # bytes of words hashed at once
PLACE_BITS = 24  # of a pointer, for the word; the other 39 are for the text
MARK_BITS = 24  # of the bitmap of texts that are pointed into
UNKNOWN = "und"
SALTS = 64

BORDER = np.zeros(256, bool)
BORDER[list(b".,;:!?\n\v\f\r")] = True
IS_WORD = ~BORDER
IS_WORD[list(b" \t")] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

COUNTED = "fp long, n long, pointer long, low long, high long"
PHRASES = "lang string, words int, phrase string, f long"


@dataclass(frozen=True)
class Mining:
    """What is mined: phrases of 2 to ``longest`` words that occur ``least`` times or more.

    ``share`` is the percentage of a phrase's occurrences that must lie in one
    longer candidate for it to be dropped; ``top`` the length of each
    language's list. ``bits``, 32 at most, sizes the bitmaps (2**bits bits); ``keep`` masks
    fingerprints and is there for tests of collisions. None but the first four
    changes a result.
    """

    longest: int = 5
    least: int = 100
    share: int = 100
    top: int = 2000
    bits: int = 27
    keep: int = (1 << 64) - 1


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _both(base: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(HASH_BYTES, base), _powers(HASH_BYTES, pow(base, -1, 1 << 64))


def _polynomials(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Running sums of ``values[i] * base**i``."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def word_prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Fingerprint of each byte range, a bounded number of bytes at a time."""
    out = np.zeros(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        last = max(int(np.searchsorted(ends, starts[first] + HASH_BYTES, "right")), first + 1)
        begin, end = int(starts[first]), int(ends[last - 1])
        size = end - begin
        if size <= HASH_BYTES:
            up, down = worker_state(f"powers {base} {HASH_BYTES}", lambda: _both(base))
        else:  # one long word
            up, down = _powers(size, base), _powers(size, pow(base, -1, 1 << 64))
        sums = _polynomials(data[begin:end].astype(np.uint64) + np.uint64(1), up)
        s, e = starts[first:last] - begin, ends[first:last] - begin
        out[first:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        first = last
    return out


def language_salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


class Grams:
    """The words of some texts, and the fingerprints of their n-grams.

    ``texts`` are in lower case afterwards; ``piece`` numbers the runs of words
    between borders, which no n-gram crosses.
    """

    def __init__(self, texts: pa.Array, langs: list[str | None], keep: int):
        data, at = flat(texts)
        self.data, self.keep = LOWER[data], np.uint64(keep)
        self.starts, self.ends, self.doc = words(self.data, at, IS_WORD)
        borders = np.flatnonzero(BORDER[self.data])
        self.piece = np.searchsorted(borders, self.starts) + self.doc
        self.first = np.searchsorted(self.doc, np.arange(len(langs) + 1))
        self.langs = [UNKNOWN if x is None else x for x in langs]
        salt_of = {x: language_salt(x) for x in set(self.langs)}
        self.salts = np.array([salt_of[x] for x in self.langs], np.uint64)
        self.salt = self.salts[self.doc]
        count = len(self.starts)
        self.sums, self.down = [], []
        for base in (BASE, SECOND):
            self.sums.append(_polynomials(word_prints(self.data, self.starts, self.ends, base), _powers(count, base)))
            self.down.append(_powers(count, pow(base, -1, 1 << 64)))

    def __len__(self) -> int:
        return len(self.starts)

    def within(self, n: int) -> np.ndarray:
        """Whether ``n`` words from each word on lie in one piece."""
        m = max(len(self) - n + 1, 0)
        return self.piece[:m] == self.piece[n - 1 :] if n > 1 else np.ones(m, bool)

    def prints(self, n: int, of: int = 0, at: np.ndarray | None = None) -> np.ndarray:
        """Fingerprints of the n-grams at the words ``at`` (default all), in their language."""
        at = np.arange(max(len(self) - n + 1, 0)) if at is None else at
        sums = self.sums[of]
        h = (sums[at + n] - sums[at]) * self.down[of][at] + self.salt[at] + np.uint64(n)
        return mix(h) & self.keep if of == 0 else mix(h)

    def language_prints(self, of: int = 0) -> np.ndarray:
        """Fingerprint of the empty phrase of each document's language."""
        h = mix(self.salts)
        return h & self.keep if of == 0 else mix(h + np.uint64(SECOND))

    def text(self, at: int, n: int) -> str:
        parts = [self.data[self.starts[i] : self.ends[i]].tobytes() for i in range(at, at + n)]
        return b" ".join(parts).decode("utf-8", "replace")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def holds(bitmap: np.ndarray, prints: np.ndarray, bits: int) -> np.ndarray:
    slot = prints >> np.uint64(64 - bits)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def chained(grams: Grams, n: int, parent: int, bitmap: np.ndarray, bits: int) -> np.ndarray:
    """Where an n-gram lies in one piece and all its parts of ``parent`` words may be frequent."""
    fine = grams.within(parent)
    fine[fine] = holds(bitmap, grams.prints(parent)[fine], bits)
    out = grams.within(n)
    for k in range(n - parent + 1):
        out &= fine[k : k + len(out)]
    return out


def _grouped(prints, counts, pointers, checks) -> pa.RecordBatch:
    """One row for each fingerprint of a slice."""
    order = np.argsort(prints, kind="stable")
    prints = prints[order]
    first = np.flatnonzero(np.concatenate([[True], prints[1:] != prints[:-1]])) if len(prints) else np.zeros(0, np.int64)
    over = lambda f, x: f.reduceat(x[order], first) if len(first) else np.zeros(0, np.int64)
    columns = [_signed(prints[first]), over(np.add, counts), over(np.minimum, pointers), over(np.minimum, checks), over(np.maximum, checks)]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["fp", "n", "pointer", "low", "high"])


def _batches(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[tuple[pa.RecordBatch, Grams]]:
    own_worker("phrases")
    for part in slices(batches, size=SLICE):
        yield part, Grams(part.column("text"), part.column("lang").to_pylist(), keep)


def _keyed(docs: DataFrame) -> DataFrame:
    """Texts with their language and the 39 bits by which pointers name them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.shiftrightunsigned(F.xxhash64(text), 64 - (63 - PLACE_BITS))
    return docs.select(text.alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), name.alias("name"))


def occurrences(keyed: DataFrame, lengths: range, parent: int, bitmap, mining: Mining) -> DataFrame:
    """Counted fingerprints of all n-grams whose parts may be frequent, one row per slice and fingerprint.

    Of ``lengths`` 0 stands for the empty phrase, which occurs at every word.
    """
    keep, bits = mining.keep, mining.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, grams in _batches(batches, keep):
            names = part.column("name").to_numpy().astype(np.int64)
            for n in lengths:
                if n == 0:
                    counts = np.diff(grams.first)
                    has = counts > 0
                    yield _grouped(grams.language_prints()[has], counts[has], names[has] << PLACE_BITS, _signed(grams.language_prints(1))[has])
                    continue
                at = np.flatnonzero(chained(grams, n, parent, bitmap.value, bits) if bitmap else grams.within(n))
                doc = grams.doc[at]
                place = (at - grams.first[doc]) & ((1 << PLACE_BITS) - 1)
                checks = _signed(grams.prints(n, 1, at))
                yield _grouped(grams.prints(n, 0, at), np.ones(len(at), np.int64), names[doc] << PLACE_BITS | place, checks)

    return keyed.mapInArrow(run, COUNTED)


def halves(keyed: DataFrame, n: int, bitmap, mining: Mining) -> DataFrame:
    """Counts of n-grams of what may be frequent words by the upper 32 bits of their fingerprints."""
    keep, bits = mining.keep, mining.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams in _batches(batches, keep):
            at = np.flatnonzero(chained(grams, n, 1, bitmap.value, bits))
            half, counts = np.unique((grams.prints(n, 0, at) >> np.uint64(32)).astype(np.uint32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(half.view(np.int32)), pa.array(counts.astype(np.int64))], names=["half", "n"])

    return keyed.mapInArrow(run, "half int, n long").groupBy("half").agg(F.sum("n").alias("n")).where(F.col("n") >= mining.least)


def frequent(counted: DataFrame, least: int) -> DataFrame:
    sums = counted.groupBy("fp").agg(F.sum("n").alias("n"), F.min("pointer").alias("pointer"), F.min("low").alias("low"), F.max("high").alias("high"))
    return settle(sums.where(F.col("n") >= least), "frequent")


def as_bitmap(slots: DataFrame, slot: Column, bits: int):
    """A broadcast bitmap of ``2**bits`` bits; its size does not depend on the rows."""
    parts = slots.select(slot.alias("slot")).groupBy(F.shiftright("slot", 15).alias("block"))
    parts = parts.agg(F.expr("bitmap_construct_agg(slot & 32767)").alias("set"))
    out = np.zeros(max(1 << bits >> 3, 4096), np.uint8)
    for row in parts.collect():  # at most 2**(bits - 15) rows of 4 KB
        out[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["set"], np.uint8)
    return slots.sparkSession.sparkContext.broadcast(out)


def _print_slot(bits: int) -> Column:
    return F.shiftrightunsigned("fp", 64 - bits)


def pointed(keyed: DataFrame, found: DataFrame, mining: Mining) -> DataFrame:
    """The phrase that each pointer shows, with its language: ``lang, words, phrase, f``.

    A text that only shares its name with the right one shows other
    fingerprints at that word and is passed over.
    """
    name = F.shiftright("pointer", PLACE_BITS)
    shift = 63 - PLACE_BITS - MARK_BITS
    marks = as_bitmap(found, F.shiftright(name, shift), MARK_BITS)
    longest, keep = mining.longest, mining.keep

    def only_marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("name").to_numpy().astype(np.uint64) << np.uint64(64 - 63 + PLACE_BITS)
            yield batch.filter(pa.array(holds(marks.value, names, MARK_BITS)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, grams in _batches(batches, keep):
            lists = part.column("shown")
            shown, bounds = lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            get = lambda c: shown.field(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            doc = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            place, fp, check, total = get("place"), get("fp").view(np.uint64), get("low"), get("n")
            out = []
            own = (_signed(grams.language_prints())[doc] == fp.view(np.int64)) & (_signed(grams.language_prints(1))[doc] == check)
            out += [(grams.langs[doc[i]], 0, "", int(total[i])) for i in np.flatnonzero(own)]
            size = np.diff(grams.first)[doc]
            step = 1 << PLACE_BITS
            for turn in range(int(np.diff(grams.first).max(initial=0)) // step + 1):
                for n in range(1, longest + 1):
                    here = np.flatnonzero(place + turn * step + n <= size)
                    at = grams.first[doc[here]] + place[here] + turn * step
                    same = (grams.prints(n, 0, at) == fp[here]) & (_signed(grams.prints(n, 1, at)) == check[here]) & (grams.piece[at] == grams.piece[at + n - 1])
                    out += [(grams.langs[doc[i]], n, grams.text(int(a), n), int(total[i])) for i, a in zip(here[same], at[same], strict=True)]
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            types = [pa.string(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "words", "phrase", "f"])

    by_text = found.select(name.alias("name"), F.struct((F.col("pointer") % (1 << PLACE_BITS)).alias("place"), "fp", "low", "n").alias("s"))
    by_text = by_text.groupBy("name").agg(F.collect_list("s").alias("shown"))
    texts = keyed.mapInArrow(only_marked, keyed.schema).dropDuplicates()
    out = texts.join(by_text, "name").select("text", "lang", "shown").mapInArrow(read, PHRASES).dropDuplicates(["lang", "phrase"])
    out = settle(out, "phrases")
    marks.unpersist()
    return out


def recounted(keyed: DataFrame, shared: DataFrame, mining: Mining) -> DataFrame:
    """Phrases of fingerprints that several phrases share, counted by their text."""
    bitmap = as_bitmap(shared, _print_slot(mining.bits), mining.bits)
    longest, keep, bits = mining.longest, mining.keep, mining.bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, grams in _batches(batches, keep):
            seen: Counter = Counter()
            prints, counts = grams.language_prints(), np.diff(grams.first)
            for d in np.flatnonzero(holds(bitmap.value, prints, bits) & (counts > 0)):
                seen[int(prints[d].view(np.int64)), grams.langs[d], 0, ""] += int(counts[d])
            for n in range(1, longest + 1):
                at = np.flatnonzero(grams.within(n))
                prints = grams.prints(n, 0, at)
                hit = holds(bitmap.value, prints, bits)
                for a, p in zip(at[hit].tolist(), _signed(prints[hit]).tolist(), strict=True):
                    seen[p, grams.langs[grams.doc[a]], n, grams.text(a, n)] += 1
            rows = [(*key, n) for key, n in seen.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["fp", "lang", "words", "phrase", "f"])

    seen = keyed.mapInArrow(run, "fp long, " + PHRASES).join(shared.select("fp"), "fp", "left_semi")
    out = seen.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(F.col("f") >= mining.least)
    out = settle(out, "recounted")
    bitmap.unpersist()
    return out


def frequent_phrases(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """``lang, words, phrase, f`` of all phrases that occur ``least`` times or more.

    The phrase of 0 words stands for the number of all words of a language.
    """
    keyed = _keyed(docs)
    single = frequent(occurrences(keyed, range(0, 2), 1, None, mining), mining.least)
    words_set = as_bitmap(single, _print_slot(mining.bits), mining.bits)
    unsigned = F.col("half").cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    pairs_set = as_bitmap(halves(keyed, 2, words_set, mining), F.shiftright(unsigned, 32 - mining.bits), mining.bits)
    words_set.unpersist()
    longer = frequent(occurrences(keyed, range(2, mining.longest + 1), 2, pairs_set, mining), mining.least)
    pairs_set.unpersist()
    # a fingerprint can be met at several lengths when few bits are kept
    found = single.union(longer)
    found = found.groupBy("fp").agg(F.sum("n").alias("n"), F.min("pointer").alias("pointer"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = settle(found, "frequent")
    out = pointed(keyed, found.where("low = high"), mining)
    shared = found.where("low != high")
    return out if shared.isEmpty() else out.union(recounted(keyed, shared, mining).select(*out.columns))


def _joined(parts: Column) -> Column:
    return F.array_join(parts, " ")


def collocations(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """Each language's best phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` counts the phrase, ``n`` all words of the language. Of the cuts of a
    phrase into two the one with the lowest ``score = floor(1000 a n / (l r))``
    counts (``l`` and ``r`` occurrences of its sides), of equal ones the first.
    A phrase inside a longer candidate that has ``share`` percent of its
    occurrences is dropped. Order is by score and ``a``, both falling, then by
    the bytes of the phrase. Arithmetic is exact for fewer than 10**17 words.

    Null texts count as empty and add nothing; a null language is ``und``;
    repeated rows count each; a text of any length is read whole. Without words
    the result is empty. Only text and lang are read, so other columns may have
    any names, and doc_id may be null.
    """
    phrases = frequent_phrases(docs, mining)
    counts = phrases.select("lang", F.col("phrase").alias("side"), "f")
    rows = phrases.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ", -1).alias("w"))

    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = rows.select("lang", "phrase", "a", "w", "words", cut)
    cuts = cuts.withColumns({"left": _joined(F.slice("w", 1, F.col("k"))), "right": _joined(F.slice("w", F.col("k") + 1, F.col("words")))})
    cuts = cuts.select("lang", "phrase", "a", "k", "left", "right")
    cuts = cuts.join(counts.select("lang", F.col("side").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("side").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    totals = phrases.where("words = 0").select("lang", F.col("f").alias("n"))
    cuts = spread_join(cuts.select("lang", "phrase", "a", "k", "l", "r"), totals, ["lang"])
    exact = "CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)) DIV (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr(exact).cast("long").alias("score"), "k", "l", "r")).alias("best"))

    size = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")
    inner = rows.where("words >= 3").select("lang", "w", "words", "a", size)
    inner = inner.select("lang", "w", "a", "size", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("first"))
    inner = inner.select("lang", _joined(F.slice("w", F.col("first"), F.col("size"))).alias("phrase"), "a")
    inner = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * mining.share))
    kept = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # the best of a language are among the best of each of its parts
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    kept = kept.withColumn("nth", F.row_number().over(part)).where(F.col("nth") <= mining.top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    kept = kept.withColumn("rank", rank.cast("long")).where(F.col("rank") <= mining.top)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""
    WITH pieces AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents),
    split AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
    grams AS (
      SELECT lang, k AS words, unnest([array_to_string(w[i:i + k - 1], ' ') FOR i IN range(1, len(w) - k + 2)]) AS phrase
      FROM split, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
    f AS (SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
    total AS (SELECT lang, sum(len(w)) AS n FROM split GROUP BY 1),
    candidates AS (SELECT lang, words, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE words >= 2),
    cuts AS (SELECT *, unnest(range(1, words)) AS k FROM candidates),
    scored AS (
      SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
        CAST(1000::HUGEINT * c.a * t.n::HUGEINT // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM cuts c JOIN total t USING (lang)
      JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
      JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    sizes AS (SELECT *, unnest(range(2, words)) AS size FROM candidates WHERE words > 2),
    inner_phrases AS (
      SELECT lang, a, unnest([array_to_string(w[i:i + size - 1], ' ') FOR i IN range(1, words - size + 2)]) AS phrase FROM sizes),
    longer AS (SELECT lang, phrase, max(a) AS longer FROM inner_phrases GROUP BY ALL),
    kept AS (SELECT b.* FROM best b LEFT JOIN longer o USING (lang, phrase) WHERE o.longer IS NULL OR 100 * o.longer < 100 * b.a),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
    SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= 2000"""
