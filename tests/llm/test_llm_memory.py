"""Memory that a Python worker takes beside its executor's heap."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from stepgrid.llm import bpe_trie, decontaminate
from stepgrid.llm.bpe_trie import Vocabulary, encoded_batches, piece_ids
from stepgrid.llm.pieces import library
from stepgrid.llm.queries import tokenizer_path


def test_seeds_of_a_large_batch_take_bounded_memory():
    text = " ".join(f"w{k:05d}" for k in range(2000))
    batch = pa.RecordBatch.from_arrays([pa.array([text] * 640)], ["text"])
    tracemalloc.start()
    found = sum(len(hashes) for _, _, hashes, _, _ in decontaminate.seeds_of(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 640 * 1996
    assert peak < 192 << 20, peak >> 20


def test_texts_are_encoded_a_few_megabytes_at_once():
    text = " ".join(f"w{k % 50:05d}" for k in range(4000))
    batch = pa.RecordBatch.from_arrays([pa.array(range(200)), pa.array([text] * 200)], ["doc_id", "text"])
    out = list(encoded_batches(iter([batch]), tokenizer_path("byte_bpe_50k.json")))
    assert [i for part in out for i in part.column(0).to_pylist()] == list(range(200))
    assert all(x == text for part in out for x in part.column(3).to_pylist())
    assert max(part.num_rows for part in out) * len(text) <= 2 << 20


def test_texts_reach_python_a_few_megabytes_at_once(spark):
    from pyspark.sql import functions as F

    from stepgrid.session import configure

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"size": [sum(map(len, batch.column("text").to_pylist()))]})

    rows = configure(spark).range(0, 4000, 1, 1).select(F.repeat(F.lit("0123456789"), 1000).alias("text"))
    found = [r["size"] for r in rows.mapInArrow(sizes, "size long").collect()]
    assert sum(found) == 40_000_000
    assert max(found) <= 8 << 20, found


BYTE = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(BYTE)


def test_tokens_stand_together_as_the_merges_say(vocabulary):
    assert vocabulary.in_order
    random = np.random.default_rng(5)
    whole = [i for i, token in vocabulary.bytes_of.items() if vocabulary.merged(token) == [token]]
    pairs = set(map(tuple, random.choice(whole, (6000, 2)).tolist()))
    # tokens cut in two anywhere, and tokens next to themselves, are where the merges decide
    for i in random.choice(whole, 6000).tolist():
        token = vocabulary.bytes_of[i]
        pairs.add((i, i))
        pairs.update((vocabulary.id_of[token[:k]], vocabulary.id_of[token[k:]]) for k in range(1, len(token)) if token[:k] in vocabulary.id_of and token[k:] in vocabulary.id_of)
    pairs = [(a, b) for a, b in pairs if a in vocabulary.last_merge and b in vocabulary.last_merge]
    spelled = [vocabulary.merged(vocabulary.bytes_of[a] + vocabulary.bytes_of[b]) == [vocabulary.bytes_of[a], vocabulary.bytes_of[b]] for a, b in pairs]
    assert 1000 < sum(spelled) < len(pairs) - 1000
    assert [vocabulary.may_follow(a, b) for a, b in pairs] == spelled
    for _ in range(2):
        assert vocabulary.may_follow_all(*np.array(pairs).T).tolist() == spelled


@pytest.mark.parametrize("bits, in_order", [(3, True), (20, False)])
def test_few_places_for_pairs_or_merges_out_of_order_change_nothing(monkeypatch, bits, in_order):
    monkeypatch.setattr(bpe_trie, "PAIR_BITS", bits)
    small = Vocabulary(BYTE)
    small.in_order = in_order
    monkeypatch.setattr(bpe_trie, "worker_state", lambda name, make: small if name.startswith("vocabulary") else make())
    random = np.random.default_rng(6)
    pieces = sorted({" " + "".join(random.choice(list("etaoinshrdluäß"), random.integers(1, 12))) for _ in range(500)})
    want = [library(BYTE).encode(x, add_special_tokens=False).ids for x in pieces]
    assert [np.frombuffer(x, "<u4").tolist() for x in piece_ids(pieces, BYTE)] == want


def test_merges_are_not_run_for_pairs_of_tokens(monkeypatch, vocabulary):
    def spelled(*_):
        raise AssertionError("merges run on the bytes of a pair")

    monkeypatch.setattr(bpe_trie, "worker_state", lambda name, make: vocabulary if name.startswith("vocabulary") else make())
    monkeypatch.setattr(Vocabulary, "merged", spelled)
    text = "an unremarkable internationalisation of tokenizers " * 3
    part = next(encoded_batches(iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array([text])], ["doc_id", "text"])]), BYTE))
    assert part.column(2).to_pylist() == [",".join(map(str, library(BYTE).encode(text, add_special_tokens=False).ids))]
