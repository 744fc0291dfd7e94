"""Byte-pair encoding of distinct words over their shared prefixes, and decoding.

For a byte-pair vocabulary the last token of the encoding of a word's prefix
follows from shorter prefixes alone: it is the one token that ends the prefix
and may stand after the last token of what is left before it. (Two tokens may
stand together when the merges turn their joined bytes into just those two.)
So every node of a trie of words has one state, its last token, and the
encodings of all words are read off by walking states back to the root.

The distinct words are sorted, which lines them up in the depth-first order of
their trie; a prefix shared by neighbours is one node whose state is computed
once. Nodes of equal depth are computed together as arrays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepgrid.llm.pieces import distinct_pieces, library, placed, remembered
from stepgrid.llm.textbytes import BASE, give_back, own_worker, slices, worker_state

DEEP = 48  # bytes; longer words are walked one by one, with the same states
STEP = np.uint64(BASE)
ENCODED_BYTES = 1 << 20  # of text encoded at once; ids and decoded text of all of it are held
REMEMBERED_BYTES = 16 << 20  # of pieces in a generation of the worker's memory
PAIR_BITS = 20  # of the number of token pairs whose answers a worker remembers
NEVER = 1 << 60  # a rank after all others


def byte_symbols() -> dict[str, int]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merge ranks, and which tokens may stand next to each other."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        symbol = byte_symbols()
        as_bytes = lambda token: bytes(symbol[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        special_ids = set(self.special.values())
        self.bytes_of = {i: as_bytes(t) for t, i in spec["model"]["vocab"].items() if i not in special_ids}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(as_bytes(a), as_bytes(b)): r for r, (a, b) in enumerate(merges)}
        self.decoded = dict(self.bytes_of) | {i: t.encode() for t, i in self.special.items()}
        # remembered answers on pairs of tokens: one place for each hash, the newest pair has it
        self.pairs, self.stand = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        # suffixes of tokens by hash: where no suffix fits, no longer token can
        ends = {}
        for token, i in self.id_of.items():
            for k in range(len(token)):
                ends.setdefault(token[k:], -1)
        self.longest = max(map(len, self.id_of))
        # the merge a token ends with, as rank and both sides; single bytes have none
        self.last_merge: dict[int, tuple[int, int, int]] = {}
        for token, i in self.id_of.items():
            parts, merge = self._merge(token)
            if parts == [token]:
                ends[token] = i
                self.last_merge[i] = (self.rank[merge], self.id_of[merge[0]], self.id_of[merge[1]]) if merge else (-1, -1, -1)
        self.ends = ends
        self.rank_of = {self.id_of[a] << 32 | self.id_of[b]: r for (a, b), r in self.rank.items() if a in self.id_of and b in self.id_of}
        # learned in order: no token is merged further by an earlier merge than the one that made it
        made = {i: m[0] for i, m in self.last_merge.items()}
        self.in_order = all(made.get(k >> 32, -1) < r and made.get(k & 0xFFFFFFFF, -1) < r for k, r in self.rank_of.items())
        hashes = np.array([_hash(s) for s in ends], np.uint64)
        order = np.argsort(hashes)
        self.end_hash, self.end_id = hashes[order], np.fromiter(ends.values(), np.int64, len(ends))[order]

    def _merge(self, word: bytes) -> tuple[list[bytes], tuple[bytes, bytes] | None]:
        """The merges applied in order of rank, on a short byte string, and the last of them."""
        parts, pair = [word[i : i + 1] for i in range(len(word))], None
        while len(parts) > 1:
            best, at = min((self.rank.get((parts[i], parts[i + 1]), NEVER), i) for i in range(len(parts) - 1))
            if best == NEVER:
                break
            pair = (parts[at], parts[at + 1])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts, pair

    def merged(self, word: bytes) -> list[bytes]:
        return self._merge(word)[0]

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their bytes are encoded together.

        Merges within the tokens are undone from the last on: of each two parts
        that lay side by side at the border, none may have been merged before
        one of them became part of something longer.
        """
        if not self.in_order:
            a, b = self.bytes_of[left], self.bytes_of[right]
            return self.merged(a + b) == [a, b]
        left_until = right_until = NEVER
        while True:
            rank = self.rank_of.get(left << 32 | right, NEVER)
            # of equal ranks the leftmost is merged first
            if rank < left_until and rank <= right_until and rank < NEVER:
                return False
            left_made, right_made = self.last_merge[left], self.last_merge[right]
            if left_made[0] > right_made[0]:
                left_until, _, left = left_made
            elif right_made[0] >= 0:
                right_until, right, _ = right_made
            else:
                return True

    def may_follow_all(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        place = (keys.astype(np.uint64) * STEP >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.stand[place]
        unknown = np.flatnonzero(self.pairs[place] != keys)
        if len(unknown):
            new, back = np.unique(keys[unknown], return_inverse=True)
            answers = np.array([self.may_follow(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()], bool)
            out[unknown] = answers[back]
            # one after the other, so that a place holds one pair and its answer
            at, kept = np.unique(place[unknown], return_index=True)
            self.pairs[at], self.stand[at] = keys[unknown][kept], answers[back][kept]
        return out


def _hash(word: bytes) -> int:
    h = 0
    for b in word:
        h = (h * BASE + b + 1) & 0xFFFFFFFFFFFFFFFF
    return h


def walk(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Token ids of one long word: the states along a trie of a single path."""
    last = [-1] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        fits = []
        for k in range(1, min(end, vocabulary.longest) + 1):
            token = vocabulary.ends.get(word[end - k : end])
            if token is None:
                break
            if token >= 0:
                fits.append((k, token))
        for k, token in reversed(fits):
            if end == k or vocabulary.may_follow(last[end - k], token):
                last[end] = token
                break
    ids, end = [], len(word)
    while end:
        ids.append(last[end])
        end -= len(vocabulary.bytes_of[last[end]])
    return ids[::-1]


def trie_encode(words: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """Token ids of sorted distinct words of at most ``DEEP`` bytes, as little-endian 32-bit integers."""
    n = len(words)
    if not n:
        return []
    lengths = np.fromiter(map(len, words), np.int64, n)
    deepest = int(lengths.max())
    letters = np.zeros((n, deepest), np.uint8)
    letters[np.arange(deepest) < lengths[:, None]] = np.frombuffer(b"".join(words), np.uint8)
    # common prefix with the word before; a word opens the nodes deeper than that
    same = np.zeros((n, deepest), bool)
    same[1:] = letters[1:] == letters[:-1]
    common = np.minimum(np.cumprod(same, axis=1, dtype=np.int8).sum(axis=1, dtype=np.int64), np.minimum(lengths, np.concatenate([[0], lengths[:-1]])))
    node_of = [np.zeros(n, np.int32)]  # by depth: the node of each word, or a stale number where the word is shorter
    hashes = [np.zeros(1, np.uint64)]
    last = [np.full(1, -1, np.int64)]
    power = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(deepest, STEP, np.uint64)]))
    for depth in range(1, deepest + 1):
        opens = (common < depth) & (lengths >= depth)
        first = np.flatnonzero(opens)
        node_of.append((np.cumsum(opens) - 1).astype(np.int32))
        hashes.append(hashes[-1][node_of[depth - 1][first]] * STEP + letters[first, depth - 1].astype(np.uint64) + np.uint64(1))
        fits: list[tuple[int, np.ndarray, np.ndarray]] = []
        alive = np.arange(len(first))
        for k in range(1, min(depth, vocabulary.longest) + 1):
            before = hashes[depth - k][node_of[depth - k][first[alive]]]
            suffix = hashes[depth][alive] - before * power[k]
            at = np.minimum(np.searchsorted(vocabulary.end_hash, suffix), len(vocabulary.end_hash) - 1)
            known = vocabulary.end_hash[at] == suffix
            alive, token = alive[known], vocabulary.end_id[at[known]]
            if not len(alive):
                break
            if (token >= 0).any():
                fits.append((k, alive[token >= 0], token[token >= 0]))
        state = np.full(len(first), -1, np.int64)
        for k, nodes, token in reversed(fits):
            unset = state[nodes] < 0
            nodes, token = nodes[unset], token[unset]
            if k < depth and len(nodes):
                left = last[depth - k][node_of[depth - k][first[nodes]]]
                stands = vocabulary.may_follow_all(left, token)
                nodes, token = nodes[stands], token[stands]
            state[nodes] = token
        last.append(state)
    # read the tokens off from the ends of the words
    widths = np.zeros(max(vocabulary.bytes_of) + 1, np.int64)
    widths[list(vocabulary.bytes_of)] = [len(b) for b in vocabulary.bytes_of.values()]
    table = np.full((n, deepest), -1, np.int64)
    for depth in range(1, deepest + 1):
        here = np.flatnonzero(lengths >= depth)
        table[here, depth - 1] = last[depth][node_of[depth][here]]
    rows, left, rounds = np.arange(n), lengths.copy(), []
    while len(rows):
        token = table[rows, left[rows] - 1]
        rounds.append((rows, token))
        left[rows] -= widths[token]
        rows = rows[left[rows] > 0]
    counts = np.zeros(n, np.int64)
    for rows, _ in rounds:
        counts[rows] += 1
    ends = np.cumsum(counts)
    ids = np.empty(int(ends[-1]), "<u4")
    for back, (rows, token) in enumerate(rounds, 1):
        ids[ends[rows] - back] = token
    flat, at = ids.tobytes(), (4 * ends).tolist()
    return [flat[a:b] for a, b in zip([0, *at], at, strict=False)]


def encode_words(words: list[bytes], vocabulary: Vocabulary) -> dict[bytes, bytes]:
    short = sorted({w for w in words if len(w) <= DEEP})
    found = dict(zip(short, trie_encode(short, vocabulary), strict=True))
    found.update({w: np.array(walk(w, vocabulary), "<u4").tobytes() for w in {w for w in words if len(w) > DEEP}})
    return found


def pretokens(pieces: list[str], path: str, vocabulary: Vocabulary) -> list[list[bytes | int]]:
    """The pre-tokens of each piece as bytes, special strings as their ids.

    A piece of letters with at most one space before them is one pre-token;
    others are cut by the tokenizer's own pre-tokenizer, after special strings
    have been taken out.
    """
    array = pa.array(pieces, pa.large_string())
    # a literal apostrophe or any other sign goes the long way
    simple = pc.match_substring_regex(array, r"^ ?[A-Za-zÀ-ÖØ-öø-ÿ]+$").to_numpy(zero_copy_only=False)
    symbol = worker_state("byte symbols", byte_symbols)
    cutter = library(path).pre_tokenizer
    out: list[list[bytes | int]] = []
    for piece, whole in zip(pieces, simple.tolist(), strict=True):
        if whole:
            out.append([piece.encode()])
            continue
        parts: list[bytes | int] = []
        for text in _special_cut(piece, vocabulary.special):
            if text in vocabulary.special:
                parts.append(vocabulary.special[text])
            elif text:
                parts.extend(bytes(symbol[c] for c in token) for token, _ in cutter.pre_tokenize_str(text))
        out.append(parts)
    return out


def _special_cut(text: str, special: dict[str, int]) -> list[str]:
    """The text cut at special strings, leftmost and then longest first."""
    out = []
    while text:
        at = [(text.find(s), -len(s), s) for s in special if s and s in text]
        if not at:
            break
        start, _, found = min(at)
        out += [text[:start], found]
        text = text[start + len(found) :]
    return [*out, text]


def piece_ids(pieces: list[str], path: str) -> list[bytes]:
    """Ids of each piece as little-endian 32-bit integers."""
    vocabulary = worker_state(f"vocabulary {path}", lambda: Vocabulary(path))
    cut = pretokens(pieces, path, vocabulary)
    ids_of: dict[bytes | int, bytes] = {i: i.to_bytes(4, "little") for i in vocabulary.special.values()}
    ids_of.update(encode_words([w for parts in cut for w in parts if isinstance(w, bytes)], vocabulary))
    return [ids_of[parts[0]] if len(parts) == 1 else b"".join([ids_of[p] for p in parts]) for parts in cut]


def written(ids: np.ndarray, path: str) -> tuple[pa.Array, pa.Array]:
    """Each id in decimal, and the bytes it stands for."""

    def tables() -> tuple[pa.Array, pa.Array]:
        decoded = worker_state(f"vocabulary {path}", lambda: Vocabulary(path)).decoded
        every = range(max(decoded) + 1)
        return pa.array(map(str, every), pa.string()), pa.array([decoded.get(i) for i in every], pa.large_binary())

    take = pa.array(ids)
    numbers, tokens = worker_state(f"ids as text {path}", tables)
    return numbers.take(take), tokens.take(take)


def encode_pieces(pieces: list[str], path: str) -> list[tuple[int, str, bytes]]:
    """For each piece: number of ids, the ids in decimal, and what they decode to."""
    out = []
    for coded in piece_ids(pieces, path):
        numbers, tokens = written(np.frombuffer(coded, "<u4"), path)
        out.append((len(numbers), ",".join(numbers.to_pylist()), b"".join(tokens.to_pylist())))
    return out


def encoded_batches(batches: Iterator[pa.RecordBatch], tokenizer: str) -> Iterator[pa.RecordBatch]:
    """``doc_id, n_tokens, ids, decoded`` of the rows ``doc_id, text``, slice by slice."""
    for batch in slices(batches, size=ENCODED_BYTES):
        pieces, codes, docs = distinct_pieces(batch.column("text"))
        found = remembered(f"trie {tokenizer}", lambda new: piece_ids(new, tokenizer), pieces, REMEMBERED_BYTES)
        ids, at = placed(found, codes, docs)
        numbers, tokens = written(ids, tokenizer)
        # whole texts are decoded: the bytes of one character may be spread over tokens
        _, ends, joined = tokens.buffers()
        ends = np.frombuffer(ends, np.int64)[at].tolist()
        joined = memoryview(joined or b"")
        texts = pa.array([str(joined[a:b], "utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.string())
        numbers = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), numbers), ",")
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(at)), numbers, texts], ["doc_id", "n_tokens", "ids", "decoded"])
        del batch, pieces, codes, docs, found, ids, at, numbers, tokens, ends, joined, texts
        give_back()


def encode_and_decode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Columns ``doc_id, n_tokens, ids, decoded``, one row per input row.

    ``ids`` are the decimal ids joined by commas, ``decoded`` the text they
    stand for. ``tokenizer`` is the path of a byte-level ``.json`` vocabulary
    on every worker. Null and empty texts have no ids and decode to an empty
    text. Repeated rows and rows with a null id are encoded like others; other
    columns of ``docs``, whatever their names, are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_worker("tokens")
        yield from encoded_batches(batches, tokenizer)

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids string, decoded string")
