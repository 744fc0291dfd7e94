"""Encoding by a vocabulary of words: the same ids as the library's for whole texts, by few calls of it."""

import json
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from stepgrid.llm import pieces, textbytes
from stepgrid.llm.pieces import encoded_batches, library, of_words
from stepgrid.llm.token_files import bit_lengths

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    *"aZßÉ×÷ÿªºµ017²٣½.,;!?<>=|'\"-_/#@’日κЖ",
    *" \x09\x0a\x0b\x0c\x0d\x1c\x1f\x00\x7f\x85\xa0\u1680\u2028\u3000\u200b\ufeff",
    *"\u0301\u0338\u0327\u20e3\u0345\u0130\u0131\u017f\u212a\u1100\u1161\u11a8\uac01",
    "the", "ing", "Straße", "'s", "'LL", "'t", "n't", "2024", "AKIA6P5D", "<|", "|>", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "  ", ".\n",
]


@pytest.fixture(autouse=True)
def fresh_worker():
    textbytes.own_worker("test")
    yield
    textbytes.own_worker("after test")


def batches(texts, rows):
    return iter(pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"]).slice(k, rows) for k in range(0, len(texts), rows))


def encoded(texts, path, rows=500):
    return [ids[a:b].tolist() for _, ids, at in encoded_batches(batches(texts, rows), path) for a, b in zip(at[:-1], at[1:], strict=True)]


def whole(texts, path):
    return [library(path).encode(t, add_special_tokens=False).ids for t in texts]


def mixed_texts(n=3000):
    random = np.random.default_rng(11)
    texts = ["".join(random.choice(PARTS, k)) for k in random.integers(0, 14, n)]
    # every part beside every other
    return texts + ["a" + x + y + "b" for x in PARTS for y in PARTS] + [" ", "", "\n\n", "x" * 700, "1" * 90]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_mixed_texts_encode_like_whole_texts(path):
    texts = mixed_texts()
    assert encoded(texts, path) == whole(texts, path)


@pytest.mark.parametrize("limits", [(40, 64 << 20), (600_000, 3000)])
def test_little_memory_of_pieces_changes_nothing(monkeypatch, limits):
    monkeypatch.setattr(pieces, "KEPT", limits[0])
    monkeypatch.setattr(pieces, "CACHE_BYTES", limits[1])
    texts = mixed_texts(1500)
    assert encoded(texts, WORD, 60) == whole(texts, WORD)
    memory = textbytes.worker_state(f"ids {WORD}", list)
    assert len(memory.pieces) <= limits[0] and memory.ids.nbytes <= limits[1]


def counted(monkeypatch):
    handed = []

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

        def encode_batch_fast(self, texts, **more):
            handed.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **more)

    load = pieces.library
    monkeypatch.setattr(pieces, "library", lambda path: Counting(load(path)))
    return handed


def test_new_words_are_encoded_many_at_once(monkeypatch):
    letters = "bcdfghklmnprstvwz"
    texts = [" ".join(a + "o" + b + "e" + c + d for c in letters for d in letters) for a in letters for b in letters[:4]]
    want = whole(texts, WORD)
    handed = counted(monkeypatch)
    assert encoded(texts, WORD) == want
    assert len(handed) <= 30, len(handed)  # 19,652 different words


def test_numbers_and_lines_make_no_new_pieces(monkeypatch):
    texts = [f"on {y}-{m:02d}-{d:02d}.\nkey AKIA{y * m}X{d * m}Q (see\tit)" for y in range(1990, 2025) for m in range(1, 13) for d in range(1, 29)]
    want = whole(texts, WORD)
    handed = counted(monkeypatch)
    assert encoded(texts, WORD) == want
    assert sum(map(len, handed)) <= 200, len(handed)


@pytest.mark.parametrize(
    "change",
    [
        lambda s: s["model"].update(ignore_merges=True),
        lambda s: s["pre_tokenizer"]["pretokenizers"][0].update(behavior="Isolated"),
        lambda s: s["pre_tokenizer"]["pretokenizers"][0]["pattern"].update(Regex=r"[\p{L}]+|[\p{N}]+|[^\s\p{L}\p{N}]+"),
        lambda s: s["normalizer"]["normalizers"].append({"type": "Prepend", "prepend": "x"}),
        lambda s: s["added_tokens"][0].update(content="b 1"),
        lambda s: s["added_tokens"][0].update(lstrip=True),
    ],
)
def test_other_vocabularies_are_not_cut_into_words(tmp_path, change):
    assert of_words(WORD) and not of_words(BYTE)
    with open(WORD, encoding="utf-8") as file:
        spec = json.load(file)
    change(spec)
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    Tokenizer.from_file(str(path))
    assert not of_words(str(path))


def test_a_vocabulary_of_words_may_lack_special_strings(tmp_path):
    with open(WORD, encoding="utf-8") as file:
        spec = json.load(file)
    spec["added_tokens"] = []
    path = tmp_path / "plain.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    assert of_words(str(path))
    texts = mixed_texts(300)
    assert encoded(texts, str(path)) == whole(texts, str(path))


@pytest.mark.parametrize("most", [1, 2**16 - 1, 2**16, 2**32 - 1])
def test_bit_lengths(most):
    values = np.array([[0, 1, 2, 255, 256, most // 2, most // 2 + 1, most]], np.uint32)
    assert bit_lengths(values).tolist() == [[int(v).bit_length() for v in values[0]]]


def test_ids_of_a_text_do_not_depend_on_its_batch():
    texts = mixed_texts(400)
    sums = {zlib.crc32(repr(encoded(texts, WORD, rows)).encode()) for rows in (1, 7, 4096)}
    assert len(sums) == 1
