"""Tokenizing by distinct pieces: each piece is encoded once and its ids are placed where it occurs."""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stepgrid.llm.textbytes import flat, latin_lower, pretoken_pieces, word_pieces, worker_state

CACHE, CACHE_BYTES = 250_000, 64 << 20  # pieces in a generation of the worker's memory, and their bytes; results do not depend on them
KEPT = 600_000  # pieces whose ids are kept in arrays, which take less of those bytes
JOINED = 1000  # words encoded as one text
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # pre-tokens of vocabularies of words; the rest is dropped
WORD_END = "</w>"


def library(path: str):
    """The tokenizer of a ``.json`` file, loaded once per worker."""

    def load():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        return tokenizer

    return worker_state(f"tokenizer {path}", load)


def of_words(path: str) -> bool:
    """Whether ``word_pieces`` cuts texts for this tokenizer, and the last token of each pre-token is marked.

    That is read from its file; with any other steps than the known ones, or
    special strings that might be cut or that take space with them, it is not.
    """
    from tokenizers import pre_tokenizers

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)

    def steps(name: str, inner: str) -> list[dict]:
        step = spec.get(name) or {"type": "Sequence", inner: []}
        return step[inner] if step["type"] == "Sequence" else [step]

    split = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    plain = [{"type": "NFC"}, {"type": "Lowercase"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}]
    cutters, model = steps("pre_tokenizer", "pretokenizers"), spec["model"]
    bytewise = len(cutters) == 2 and cutters[1]["type"] == "ByteLevel" and not cutters[1]["add_prefix_space"] and not cutters[1].get("use_regex", True)
    special = pa.array([t["content"] for t in spec["added_tokens"]], pa.large_string())
    literal = not any(t[k] for t in spec["added_tokens"] for k in ("normalized", "lstrip", "rstrip", "single_word"))
    letters = pre_tokenizers.ByteLevel.alphabet()
    return (
        bytewise
        and cutters[0] == split
        and all(step in plain for step in steps("normalizer", "normalizers"))
        and model.get("type") == "BPE"
        and model.get("end_of_word_suffix") == WORD_END
        and all(b + end in model["vocab"] for b in letters for end in ("", WORD_END))
        and not model.get("dropout")
        and not model.get("ignore_merges")
        and literal
        and (not len(special) or word_pieces(*flat(special))[0].to_pylist() == special.to_pylist())
    )


def library_encoder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Ids of each piece as little-endian 32-bit integers, by the tokenizers library."""

    def encode(pieces: list[str]) -> list[bytes]:
        found = library(path).encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    return encode


def array_encoder(path: str, words: bool) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of pieces by the tokenizers library, and where those of each piece start and end.

    With ``words``, pieces of letters alone are encoded many at once, with
    spaces between them; each ends at the token that is marked for it.
    """

    def ends() -> np.ndarray:
        tokens = library(path).get_vocab()
        out = np.zeros(max(tokens.values()) + 1, bool)
        out[[i for token, i in tokens.items() if token.endswith(WORD_END)]] = True
        return out

    def encode(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tokenizer = library(path)
        found, lengths, whole = [np.zeros(0, "<u4")], np.zeros(len(pieces), np.int64), np.zeros(len(pieces), bool)
        if words:
            whole = pc.match_substring_regex(pieces, r"^[A-Za-zÀ-ÖØ-öø-ÿ]+$").to_numpy(zero_copy_only=False)
            joined = pieces.filter(pa.array(whole)).cast(pa.string())
            at = pa.array([*range(0, len(joined), JOINED), len(joined)], pa.int32())
            for text in pc.binary_join(pa.ListArray.from_arrays(at, joined), " ").to_pylist():
                found += [np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast([text], add_special_tokens=False)]
            marked = np.flatnonzero(worker_state(f"ends {path}", ends)[np.concatenate(found)])
            lengths[whole] = np.diff(marked, prepend=-1)
        single = library_encoder(path)(pieces.filter(pa.array(~whole)).to_pylist())
        found.append(np.frombuffer(b"".join(single), "<u4"))
        lengths[~whole] = [len(ids) // 4 for ids in single]
        in_order = np.concatenate([np.flatnonzero(whole), np.flatnonzero(~whole)])
        stop = np.empty(len(pieces), np.int64)
        stop[in_order] = np.cumsum(lengths[in_order])
        return np.concatenate(found), stop - lengths, stop

    return encode


class PieceIds:
    """Ids of pieces, those of earlier batches of this worker included, without an object for each.

    Of more than ``KEPT`` pieces or ``CACHE_BYTES``, half as much stays, what was
    used last first.
    """

    def __init__(self, encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.encode, self.batch = encode, 0
        self.pieces, self.ids = pa.array([], pa.large_string()), np.zeros(0, "<u4")
        self.start, self.stop, self.used = np.zeros((3, 0), np.int64)

    def of(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the start and end among them of each of the distinct ``pieces``."""
        self.batch += 1
        at = pc.index_in(pieces, value_set=self.pieces)
        new = pieces.filter(at.is_null())
        at = at.fill_null(-1).to_numpy().astype(np.int64)
        at[at < 0] = len(self.pieces) + np.arange(len(new))
        ids, start, stop = self.encode(new)
        self.start, self.stop = np.append(self.start, start + len(self.ids)), np.append(self.stop, stop + len(self.ids))
        self.pieces, self.ids = pa.concat_arrays([self.pieces, new]), np.append(self.ids, ids)
        self.used = np.append(self.used, np.zeros(len(new), np.int64))
        self.used[at] = self.batch
        out = self.ids, self.start[at], self.stop[at]
        self.forget()
        return out

    def forget(self) -> None:
        held = pc.binary_length(self.pieces).to_numpy() + 4 * (self.stop - self.start) + 32
        if len(self.pieces) <= KEPT and held.sum() <= CACHE_BYTES:
            return
        newest = np.argsort(-self.used, kind="stable")[: KEPT // 2]
        keep = np.sort(newest[np.cumsum(held[newest]) <= CACHE_BYTES // 2])
        self.pieces, self.used = self.pieces.take(pa.array(keep, pa.int64())), self.used[keep]
        self.ids, self.start, self.stop = taken(self.ids, self.start[keep], self.stop[keep])


def taken(ids: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of given ranges after each other, and where each range now starts and ends."""
    ends = np.cumsum(stop - start)
    total = int(ends[-1]) if len(ends) else 0
    return ids[np.arange(total) + np.repeat(stop - ends, stop - start)], ends - (stop - start), ends


def library_counter(path: str) -> Callable[[list[str]], list[int]]:
    def count(pieces: list[str]) -> list[int]:
        return list(map(len, library(path).encode_batch_fast(pieces, add_special_tokens=False)))

    return count


def remembered(name: str, work: Callable[[list], list], items: list, most: int | None = None) -> list:
    """``work(items)``, keeping answers of earlier batches of this worker.

    Two generations are kept: when the young one is full it becomes the old
    one, and what is used again moves back, so frequent items stay. A
    generation is full by number or by bytes, as a text without spaces is one
    item; it holds at most one batch more than that. ``most`` bounds the bytes
    further.
    """
    memory = worker_state(name, lambda: [{}, {}, 0])
    young, old, held = memory
    out = list(map(young.get, items))
    lacking = [x for x, answer in zip(items, out, strict=True) if answer is None]
    if lacking:
        answers = {x: old[x] for x in lacking if x in old}
        new = [x for x in lacking if x not in answers]
        answers.update(zip(new, work(new) if new else [], strict=True))
        young.update(answers)
        held += sum(map(sys.getsizeof, answers)) + sum(map(sys.getsizeof, answers.values()))
        out = list(map(young.__getitem__, items))
    memory[:] = ({}, young, 0) if len(young) > CACHE or held > min(most or CACHE_BYTES, CACHE_BYTES) else (young, old, held)
    return out


def coded_pieces(texts: pa.Array, lower: bool = False, words: bool = False) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The pieces of a batch, and the documents' offsets among them.

    ``lower`` is for tokenizers that ignore case, ``words`` for those that
    ``word_pieces`` cuts for: fewer pieces differ.
    """
    data, at = flat(texts)
    return (word_pieces if words else pretoken_pieces)(latin_lower(data, at) if lower else data, at)


def distinct_pieces(texts: pa.Array, lower: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces of a batch, the number of each occurrence, and the documents' offsets among those."""
    coded, docs = coded_pieces(texts, lower)
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(), docs


def placed(encoded: list[bytes], codes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all documents after each other, and the n + 1 offsets of the documents among them."""
    ends = np.cumsum(np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4)
    return laid(np.frombuffer(b"".join(encoded), "<u4"), np.concatenate([[0], ends])[:-1], ends, codes, docs)


def laid(ids: np.ndarray, start: np.ndarray, stop: np.ndarray, codes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``placed`` for pieces whose ids are ranges of ``ids``."""
    ids, _, ends = taken(ids, start[codes], stop[codes])
    return ids, np.concatenate([[0], ends])[docs]


def encoded_batches(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with the ids of its texts and the documents' offsets among them."""
    lower = '"Lowercase"' in (library(path).normalizer.__getstate__().decode() if library(path).normalizer else "")
    words = worker_state(f"of words {path}", lambda: of_words(path))
    memory = worker_state(f"ids {path}", lambda: PieceIds(array_encoder(path, words)))
    for batch in batches:
        coded, docs = coded_pieces(batch.column("text"), lower, words)
        ids, at = laid(*memory.of(coded.dictionary), coded.indices.to_numpy(), docs)
        yield batch, ids, at
