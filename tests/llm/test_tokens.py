"""BPE, packing and token counts against the tokenizer libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from inkstone.llm import bpe, packing, token_counts

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, id string, ids string, n_tokens int, start int"
ODD = [None, "", " ", "  ", "\n", "a", "the cat  sat\n\n on \t the mat ", "<|endoftext|> x<|endoftext|>", "aaaaaaaa aaaa", "é ñ 你好   x y",
       "it's we'll \x1c b", "🙂🙂 abc'S", "▁a ▁ b▁▁c", "<s> a</s> <unk> <0x0A>", "same text", "same text", "x" * 3000, "word " * 9000]


def odd_rows():
    rnd = random.Random(3)
    parts = ["a", " ", "\n", "\t", "1", "'s", "é", "<|endoftext|>", "你", "\x85", "!", "▁"]
    made = ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 40))) for _ in range(300)]
    return [(i if i != 3 else None, t, "x", "y", 5, 6) for i, t in enumerate(ODD + made)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def test_encoding_and_decoding_equal_the_library(spark, docs):
    own = Tokenizer.from_file(BPE)
    texts = {r[0]: r[1] or "" for r in odd_rows()}
    found = {r["doc_id"]: r for r in bpe.digests(docs, BPE).collect()}
    assert len(found) == len(texts)
    for i, text in texts.items():
        ids = own.encode(text, add_special_tokens=False).ids
        assert found[i]["n_tokens"] == len(ids)
        assert found[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[i]["decoded_sha256"] == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode(docs, BPE)
    back = {r["doc_id"]: r["text"] for r in bpe.decode(encoded, BPE).collect()}
    assert back == texts


def test_broken_bytes_decode_to_replacement_characters(spark):
    own = Tokenizer.from_file(BPE)
    ids = own.encode("你").ids[:1]
    rows = spark.createDataFrame([(1, ids), (2, None), (3, [])], "doc_id int, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(rows, BPE).collect()} == {1: own.decode(ids, skip_special_tokens=False), 2: "", 3: ""}


def test_no_rows(spark, docs):
    none = docs.limit(0)
    for found in (bpe.digests(none, BPE), packing.pack(none, BPE), token_counts.token_counts(none, PIECES)):
        assert found.count() == 0


def test_pieces_are_whole_and_sequences_gapless(spark, docs):
    own = Tokenizer.from_file(BPE)
    rows = packing.pack(docs, BPE, capacity=256, group_docs=100).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text, *_ in odd_rows():
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    for own_rows in by_sequence.values():
        at = 0
        for r in sorted(own_rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256


def test_repeated_rows_are_packed_once_each(spark):
    rows = spark.createDataFrame([(1, "same words here")] * 700, "doc_id int, text string")
    found = packing.pack(rows, BPE, capacity=64, group_docs=50).collect()
    assert len(found) == 700 and len({(r["sequence_id"], r["offset"]) for r in found}) == 700
    assert len({r["sequence_id"] >> 32 for r in found}) > 5


def test_first_fit_decreasing_equals_a_plain_scan():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 7, 200):
        lengths = rnd.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room = []
        for k in np.argsort(-lengths, kind="stable"):
            b = next((b for b, r in enumerate(room) if r >= lengths[k]), len(room))
            if b == len(room):
                room.append(100)
            assert (bins[k], offsets[k]) == (b, 100 - room[b])
            room[b] -= lengths[k]


def test_token_counts_equal_the_library(spark, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = {r["doc_id"]: r for r in token_counts.token_counts(docs, PIECES).collect()}
    for i, text, *_ in odd_rows():
        n = len(model.encode(text or ""))
        assert (found[i]["n_tokens"], found[i]["n_bytes"], found[i]["over_limit"]) == (n, len((text or "").encode()), n > 4096)


def test_frequent_table_is_only_a_cache(spark, docs):
    table = token_counts.frequent_lengths(docs, PIECES, per_task=2, kept=3).value
    assert len(table[1]) == 3
