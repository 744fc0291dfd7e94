"""Whole texts of an Arrow batch as one flat byte array, and what is computed on it at once.

The functions run inside ``mapInArrow`` tasks. They never loop over documents:
a batch is one UTF-8 buffer with document offsets, and words, hashes and
pre-tokens are positions in it.
"""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 8 << 20
SLICE_ROWS = 4096
HASHED_BYTES = 2 << 20  # of text whose words are hashed at once, which takes some 40 bytes of memory for each

# odd multipliers of the polynomial and mixing hashes
BASE = 0x9E3779B97F4A7C15 | 1
MIX_A, MIX_B = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def own_worker(owner: str) -> None:
    """Say what this Python worker does from now on; what it kept for another purpose goes.

    Workers are reused from stage to stage, and what an idle one keeps is
    memory its executor lacks.
    """
    home = sys.modules.setdefault("_stepgrid_worker", types.ModuleType("_stepgrid_worker"))
    if getattr(home, "owner", None) != owner:
        home.owner, home.kept = owner, {}
        gc.collect()
    give_back()


def give_back() -> None:
    """Return freed memory to the system, which Arrow's pool and the C library would keep."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def worker_state(name: str, make: Callable):
    """An object made once per Python worker and kept between its tasks."""
    home = sys.modules.setdefault("_stepgrid_worker", types.ModuleType("_stepgrid_worker"))
    kept = home.__dict__.setdefault("kept", {})
    if name not in kept:
        kept[name] = make()
    return kept[name]


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts (null: empty) and the n + 1 offsets of the texts in them."""
    texts = texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut by bytes of text and by rows, so that long texts bound memory; a row is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = flat(batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + size, "right")) - 1
            last = min(max(last, first + 1), first + SLICE_ROWS, batch.num_rows)
            yield batch.slice(first, last - first)
            first = last


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer: every input bit reaches every output bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_A)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_B)
    return h ^ (h >> np.uint64(31))


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64."""
    return _powers(n, BASE), _powers(n, pow(BASE, -1, 1 << 64))


def words(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every maximal run of word bytes.

    ``is_word`` is a table of 256 booleans. Runs end at document borders.
    """
    inside = is_word[data]
    edge = np.empty(len(data) + 1, bool)
    edge[0] = edge[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    edge[at] = True
    cuts = np.flatnonzero(edge)
    starts, ends = cuts[:-1], cuts[1:]
    keep = inside[starts] if len(data) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Karp-Rabin hash of each byte range, from one running sum over the buffer."""
    up, down = powers(len(data) + 1)
    running = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=running[1:])
    return mix((running[ends] - running[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def run_hashes(tokens: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first position of every ``n`` consecutive tokens of one document."""
    if len(tokens) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(tokens) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(BASE) + tokens[k : k + m]
    inside = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(h[inside]), inside


def _letter_ends(data: np.ndarray) -> np.ndarray:
    """Where a byte ends an ASCII or Latin-1 letter (the two signs among the latter left out)."""
    lower = data | 0x20
    found = (lower >= 0x61) & (lower <= 0x7A) & (data < 0x80)
    found[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    return found


PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) != "|"]] = True


def pretoken_pieces(data: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Texts cut where every pre-token ends, as a dictionary array.

    Returns the pieces and the offsets of the documents among them. Cuts are
    made before a space that follows a visible character, and between a letter
    and punctuation. Byte-level and word tokenizers begin a new pre-token at
    both, so a text is encoded by encoding its pieces one by one. No cut is
    made where that is not certain: after characters beyond Latin-1 letters,
    which may be white space, or before a bar, which may belong to a special
    string.
    """
    cut = np.zeros(len(data) + 1, bool)
    if len(data) > 2:
        before, after = data[:-1], data[1:]
        letter = _letter_ends(data)[:-1]
        visible = ((before > 0x20) & (before < 0x7F)) | letter
        cut[1:-1] = ((after == 0x20) & visible) | (letter & PUNCTUATION[after])
    cut[at] = True
    offsets = np.flatnonzero(cut)
    pieces = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))
    return pieces.dictionary_encode(), np.searchsorted(offsets, at)


# kinds of ASCII characters; controls and bytes of other characters have none
SPACE, DIGIT, LETTER, SIGN, QUOTE, BAR = 1, 2, 4, 8, 16, 32
VISIBLE = DIGIT | LETTER | SIGN | QUOTE | BAR
KIND = np.zeros(256, np.uint8)
KIND[[*range(0x09, 0x0E), 0x20]] = SPACE
KIND[0x30:0x3A] = DIGIT
KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
KIND[PUNCTUATION] = SIGN
KIND[[ord("'"), ord("|")]] = QUOTE, BAR


def word_pieces(data: np.ndarray, at: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """``pretoken_pieces`` for tokenizers that drop space and take digits one by one.

    ASCII space is left out, and cuts are also made behind signs before a
    letter, and on both sides of a digit. An apostrophe stays with the letters
    behind it, of which it may make a suffix.
    """
    before, after = KIND[data], KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    after[lead] = before[lead + 1] = LETTER
    left, right = before[:-1], after[1:]
    cut = np.zeros(len(data), bool)
    cut[1:] = (left == SPACE) | ((left == LETTER) & (right & (SIGN | QUOTE) != 0)) | ((left == SIGN) & (right == LETTER))
    cut[1:] |= ((left == DIGIT) & (right & VISIBLE != 0)) | ((right == DIGIT) & (left & VISIBLE != 0))
    cut[at[at < len(data)]] = True
    kept = after != SPACE
    offsets = np.append(np.flatnonzero(cut[kept]), np.count_nonzero(kept))
    pieces = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[kept]))
    return pieces.dictionary_encode(), np.searchsorted(offsets, at - np.searchsorted(np.flatnonzero(~kept), at))


def latin_lower(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lower case for the texts in which letter by letter is certain to be right.

    Texts with characters beyond Latin-1 (combining marks may compose with one
    case only) or with ``<|`` (special strings are matched as they are written)
    are left as they are.
    """
    if not len(data):
        return data
    odd = data > 0xC3
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)
    lower = data.copy()
    lower[(data >= 0x41) & (data <= 0x5A)] += 0x20
    accented = np.zeros(len(data), bool)
    accented[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    lower[accented] += 0x20
    for doc in np.unique(np.searchsorted(at, np.flatnonzero(odd), "right") - 1):
        lower[at[doc] : at[doc + 1]] = data[at[doc] : at[doc + 1]]
    return lower
