from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from cadastra.llm import packing, token_files
from cadastra.llm.packing import Block, encode_block
from cadastra.llm.token_files import PieceEncoder, encode_blocks, piece_encoder, read_documents
from cadastra.session import stage
from hypothesis import given, settings, strategies as st
from llm_odd import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    with open(PATH, encoding="utf-8") as file:
        return file.read()


def expected(encoder, texts):
    return [x.ids for x in encoder.library.encode_batch(list(texts), add_special_tokens=False)]


@pytest.mark.parametrize("n, top", [(0, 1), (1, 1), (5, 1 << 63), (1000, 2), (70_000, 50_000), (3000, 1 << 40), (200, (1 << 64) - 1)])
def test_blocks_round_trip(n, top):
    draw = np.random.default_rng(n)
    ids = draw.integers(0, top, n, dtype=np.uint64)
    ids[::3] = 0
    lengths = [n // 2, n - n // 2, 0]
    block = Block(encode_block(ids, lengths))
    assert np.array_equal(block.read(), ids)
    assert [x.tolist() for x in block.documents()] == [ids[: n // 2].tolist(), ids[n // 2 :].tolist(), []]
    for a, b in ((0, n // 3), (n // 3, n), (n // 2, n // 2 + 5)):
        assert np.array_equal(block.read(a, b), ids[a:b])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 5), st.integers(0, (1 << 60) - 2), st.just(int(packing.ESCAPE))), max_size=300))
def test_words_hold_what_they_say(values):
    words, first = packing.pack(np.array(values, np.uint64))
    assert packing.unpack(words)[: len(values)].tolist() == values
    counts = np.array(packing.COUNTS)[(words >> np.uint64(60)).astype(int)]
    assert first.tolist() == (np.cumsum(counts) - counts).tolist()


def test_words_are_as_narrow_as_values_allow():
    for width, count in zip(packing.WIDTHS, packing.COUNTS):
        words, _ = packing.pack(np.full(count, (1 << width) - 2, np.uint64))
        assert len(words) == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t\r\x1c\x85\xa0\u2003\u200baZé9'.!\U0001f642中", "'s", "  ", "<|endoftext|>"]), max_size=40).map("".join), max_size=4))
def test_pieces_give_the_ids_of_whole_texts(tokenizer, texts):
    encoder = piece_encoder(tokenizer)
    for _ in range(2):  # the second time all parts are known
        ids, counts = encoder.encode(texts)
        assert ids.tolist() == [i for x in expected(encoder, texts) for i in x]
        assert counts.tolist() == [len(x) for x in expected(encoder, texts)]


def test_forgetting_changes_nothing(tokenizer, monkeypatch):
    monkeypatch.setattr(token_files, "KEPT_PARTS", 3)
    encoder = PieceEncoder(tokenizer)
    for texts in (["a b c d e f", ""], ["b c", " x"], ["a b c d e f"]):
        assert encoder.encode(texts)[0].tolist() == [i for x in expected(encoder, texts) for i in x]


def checked(rows, tokenizer, got):
    """(doc_id, start, n_tokens, checksum) of plain Python over texts in the order of their ids."""
    encoder = PieceEncoder(tokenizer)
    by_id = {}
    for i, t in rows:
        ids = np.array(expected(encoder, [t or ""])[0] + [0], "<u4")
        by_id.setdefault(-1 if i is None else i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == sorted((i, *x) for i, xs in by_id.items() for x in xs)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id if r.doc_id is not None else -1 for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids)


def test_files_of_odd_rows(documents, tokenizer):
    got = read_documents(stage(encode_blocks(documents(ODD), PATH)), ["ids_crc32"]).collect()
    checked(ODD, tokenizer, got)
    assert read_documents(stage(encode_blocks(documents([]), PATH)), ["ids_crc32"]).count() == 0


@pytest.fixture
def small_parts(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_files_of_many_small_blocks(documents, tokenizer, small_parts):
    draw = random.Random(4)
    words = ["alpha", "beta", "Gamma", "12", "é", "!", "\n", ""]
    rows = [(draw.randrange(10**9) - 10**8, " ".join(draw.choices(words, k=draw.randrange(60)))) for _ in range(400)] + [(77, "same text")] * 30
    blocks = stage(encode_blocks(documents(rows), PATH, block_ids=200))
    assert blocks.count() > 30 and blocks.select("part").distinct().count() > 1
    checked(rows, tokenizer, read_documents(blocks, ["ids_crc32"]).collect())
    encoder = PieceEncoder(tokenizer)
    texts = {i: t for i, t in rows}
    for r in read_documents(blocks).where("doc_id <> 77").collect():
        assert r.ids == [*expected(encoder, [texts[r.doc_id]])[0], 0]
