import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from llm_fixtures import texts  # noqa: F401
from tokenizers import Tokenizer

from termloom.llm import byte_bpe, token_store, wavelet
from termloom.llm.queries import VOCABULARY, op12_token_store
from termloom.session import scratch_path


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def planes_of(numbers):
    data = bytearray()
    directory = wavelet.write_planes(numbers, data.extend)
    return wavelet.Planes(directory, lambda length, place: bytes(data[place : place + length]))


@pytest.mark.parametrize("size, largest", [(0, 5), (1, 1), (1, 70_000), (64, 1), (999, 50_256), (270_000, 300), (1 << 18, 3)])
def test_planes_answer_as_the_array_does(size, largest):
    rng = np.random.default_rng(size)
    numbers = rng.integers(0, rng.integers(1, largest + 1, size) + 1, size).astype("u4")
    planes = planes_of(numbers)
    assert (planes.decode() == numbers).all()
    places = rng.integers(0, size, 100) if size else np.array([], int)
    assert (planes.access(places) == numbers[places]).all()
    for number in {0, 1, 2, largest, largest + 1, 1 << 40, -1}:
        low, high = sorted(rng.integers(0, size + 1, 2).tolist())
        expected = low + np.flatnonzero(numbers[low:high].astype(np.int64) == number)
        assert planes.count(number, low, high) == len(expected)
        assert (planes.occurrences(number, low, high) == expected).all()


def test_ids_are_those_of_the_library(tokenizer):
    rng = random.Random(4)
    alphabet = ["a", "B", "é", "中", "😀", "1", "٣", " ", "  ", "\n", "\t", "\r\n", "\x85", " ",
                "'s", "'", "-", "\x00", "́", "<|endoftext|>", "<|endof", "|>", "‍", "\x1c"]
    encoder = VOCABULARY.encoder()
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(3000)]
    blanks = "\n \t" * (byte_bpe.LONG_RUN // 2)
    texts += [blanks, f"a{blanks}b", f"a{blanks}\n", f"{blanks} 中{blanks}<|endoftext|>{blanks}é"]
    texts += ["ab" * 300_000, "", " "]
    for text in texts:
        assert encoder.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_shards_hold_every_document_in_order(spark, texts, tokenizer):
    rng = random.Random(1)
    words = ["alpha", "beta ", "中文", "<|endoftext|>", "\n\n", "x1"]
    rows = [(rng.randint(0, 60), " ".join(rng.choices(words, k=rng.randint(0, 60)))) for _ in range(300)]
    rows += [(7, "same")] * 100 + [(None, "none"), (None, None), (9, None), (8, ""), (3, "long " * 30_000)]
    folder = scratch_path(spark, "token_store")
    index = token_store.write_shards(texts(rows), folder, VOCABULARY, shard_tokens=500)
    assert index.count() > 20
    found = token_store.read_documents(index, folder, keep_ids=True).orderBy("start").collect()
    expected = {}
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        expected.setdefault(doc_id, []).append(np.array(ids, "<u4").tobytes())
    held, end = {}, 0
    for row in found:
        assert row["start"] == end and len(row["ids"]) == 4 * row["n_tokens"]
        assert row["ids_crc32"] == zlib.crc32(row["ids"])
        held.setdefault(row["doc_id"], []).append(bytes(row["ids"]))
        end += row["n_tokens"]
    assert {d: sorted(x) for d, x in held.items()} == {d: sorted(x) for d, x in expected.items()}
    order = [row["doc_id"] for row in found]
    assert order == sorted(order, key=lambda doc_id: (doc_id is not None, doc_id or 0))

    stream = np.frombuffer(b"".join(bytes(row["ids"]) for row in found), "<u4")
    for number in (2, 50256, int(stream[5]), 49_999):
        assert (stream == number).sum() == token_store.count_ids(index, folder, number).first()["n"]
        places = token_store.find_id(index, folder, number).orderBy("place").collect()
        assert [row["place"] for row in places] == np.flatnonzero(stream == number).tolist()
        for row in places[:50]:
            owner = [x for x in found if x["start"] <= row["place"] < x["start"] + x["n_tokens"]]
            assert owner[0]["doc_id"] == row["doc_id"]
            assert owner[0]["start"] + row["position"] == row["place"]


def test_single_documents_are_read_by_access(spark, texts):
    folder = scratch_path(spark, "token_store")
    index = token_store.write_shards(texts([(1, "a b c"), (2, "d" * 5000)]), folder, VOCABULARY)
    files, root = token_store.file_system(folder)
    held = {}
    for row in index.collect():
        with files.open_input_file(f"{root}/{row['shard']}") as source:
            shard = token_store.Shard(source)
            for i, doc_id in enumerate(shard.doc_ids):
                held[doc_id] = shard.ids(i).tolist()
    encoder = VOCABULARY.encoder()
    assert held == {1: [*encoder.encode("a b c"), 2], 2: [*encoder.encode("d" * 5000), 2]}


def test_no_documents(spark, texts):
    folder = scratch_path(spark, "token_store")
    index = token_store.write_shards(texts([]), folder, VOCABULARY)
    assert index.collect() == [] and token_store.read_documents(index, folder).collect() == []


def test_query_over_the_table(spark, tokenizer):
    sf_dir = "/root/testdata/sf0.001"
    found = {row["doc_id"]: row for row in op12_token_store(spark, sf_dir).collect()}
    start = 0
    for doc_id, text in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        row = found[doc_id]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
