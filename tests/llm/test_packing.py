import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from llm_fixtures import texts  # noqa: F401

from termloom.llm import packing
from termloom.llm.queries import VOCABULARY


def slow_best_fit(lengths, capacity):
    """Best-fit decreasing, one item at a time."""
    left = []
    for length in sorted(lengths, reverse=True):
        fitting = [i for i, room in enumerate(left) if room >= length]
        if fitting:
            left[min(fitting, key=lambda i: left[i])] -= length
        else:
            left.append(capacity - length)
    return sorted(left)


@pytest.mark.parametrize("seed", range(30))
def test_counts_pack_as_single_items_do(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
    counts = {length: lengths.count(length) for length in set(lengths)}
    used = {}
    for length, _, items, each, first, offset in packing.best_fit_decreasing(counts, capacity):
        for item in range(items):
            spans = used.setdefault(first + item // each, [])
            spans.append((offset + item % each * length, length))
    for spans in used.values():
        end = 0
        for start, length in sorted(spans):
            assert start == end
            end += length
        assert end <= capacity
    rooms = sorted(capacity - sum(n for _, n in spans) for spans in used.values())
    assert rooms == slow_best_fit(lengths, capacity)


def test_pieces_and_places(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    long = "It's 12 o'clock,  naïve\n\n\tfoo #hash 中文 <|endoftext|> " * 300
    rows = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x"), (4, long), (5, "a b")]
    packed = packing.pack_documents(texts(rows), VOCABULARY, keep_ids=True)
    found = packed.collect()
    by_document = {}
    for row in found:
        ids = np.frombuffer(bytes(row["ids"]), "<u4")
        assert len(ids) == row["length"] and zlib.crc32(row["ids"]) == row["ids_crc32"]
        by_document.setdefault(row["doc_id"], []).append((row["piece"], row["start"], ids.tolist()))
    ids = tokenizer.encode(long, add_special_tokens=False).ids + [2]
    pieces = sorted(by_document[4])
    assert sum((part for _, _, part in pieces), []) == ids
    assert [start for _, start, _ in pieces] == [0, *range(len(ids) % 1024, len(ids), 1024)]
    assert by_document[2] == by_document[3] == [(0, 0, [2])]
    assert len(by_document[1]) == 2 and len(by_document[None]) == 1
    spans = {}
    for row in found:
        spans.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for held in spans.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(held), sorted(held)[1:]))
        assert min(held)[0] == 0 and sum(n for _, n in held) <= 1024
    whole = packing.sequences(packed).collect()
    assert sum(row["n_tokens"] for row in whole) == sum(row["length"] for row in found)
    assert all(len(row["ids"]) == 4 * row["n_tokens"] for row in whole)


def test_a_document_of_blanks_and_one_of_whole_pieces(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = [(1, " " * 5_000_000 + "a"), (2, "a" + " a" * 4094)]
    packed = packing.pack_documents(texts(rows), VOCABULARY, keep_ids=True).collect()
    for doc_id, text in rows:
        mine = sorted((r["piece"], bytes(r["ids"])) for r in packed if r["doc_id"] == doc_id)
        ids = np.frombuffer(b"".join(part for _, part in mine), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids + [2]
    full = [r["sequence_id"] for r in packed if r["length"] == 1024]
    assert len(full) == len(set(full)) and len(full) >= 4
    assert not {r["sequence_id"] for r in packed if r["length"] < 1024} & set(full)


def test_no_documents(texts):
    assert packing.pack_documents(texts([]), VOCABULARY).collect() == []
