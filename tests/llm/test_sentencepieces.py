from __future__ import annotations

import struct

import public_tokenizers
import pytest
import sentencepiece
from cadastra.llm.sentencepieces import PieceCodec, Normalizer, _fields, decode, encode, read_char_map

from llm_odd import ODD

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  a  b\t\nc ", "▁ ▁", "é́日本𝒳 a", "a\x00b", "\U0001f642\U0001f642 x", "word " * 500]


@pytest.fixture(scope="module")
def own():
    with open(MODEL, "rb") as file:
        return PieceCodec(file.read())


def double_array(entries: dict[bytes, int]) -> bytes:
    """A small double-array trie, laid out without care for space: one block of 256 units for each node."""
    units = [0] * 256
    prefixes = sorted({k[:i] for k in entries for i in range(len(k) + 1)}, key=len)
    place = {p: 256 * (i + 1) for i, p in enumerate(prefixes)}
    units += [0] * (256 * (len(prefixes) + 1))
    where = {b"": 0}
    for p in prefixes:
        node = where[p]
        relative = node ^ place[p]  # a multiple of 256 or below 2**21 in units of one
        units[node] |= relative << 10
        if p in entries:
            units[node] |= 1 << 8
            units[place[p]] = entries[p] | 1 << 31
        for q in prefixes:
            if len(q) == len(p) + 1 and q.startswith(p):
                where[q] = place[p] ^ q[-1]
                units[where[q]] |= q[-1]
    return struct.pack(f"<{len(units)}I", *units)


def with_char_map(table: dict[str, str]) -> bytes:
    texts, entries = b"", {}
    for key, value in table.items():
        entries[key.encode()] = len(texts)
        texts += value.encode() + b"\0"
    trie = double_array(entries)
    blob = struct.pack("<I", len(trie)) + trie + texts

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(fields):
        return b"".join(varint(f << 3 | (2 if isinstance(v, bytes) else 0)) + (varint(len(v)) + v if isinstance(v, bytes) else varint(v)) for f, v in fields)

    with open(MODEL, "rb") as file:
        model = file.read()
    spec = dict(_fields(next(v for f, v in _fields(model) if f == 3)))
    spec[2] = blob
    return b"".join(message([(f, v if f != 3 else message(spec.items()))]) for f, v in _fields(model))


def test_spans_are_the_librarys(own):
    for text in TEXTS:
        ids = own.encode([text], add_end=False)[0]
        begin, end = own.spans(text.encode(), ids)
        assert list(zip(begin.tolist(), end.tolist())) == [(p.begin, p.end) for p in own.library.encode(text, return_type="proto").pieces]


def test_compiled_character_map():
    table = {"ａ": "a", "ａｂ": "xyz", "é": "e", "ﬁ": "fi", "…": "..."}
    model = with_char_map(table)
    own = PieceCodec(model)
    assert read_char_map(dict(_fields(next(v for f, v in _fields(model) if f == 3)))[2]) == {k.encode(): v.encode() for k, v in table.items()}
    for text in ["ａ ａｂ ａａｂ", "café ﬁn…", "…", "x ａ", "日ａ本"]:
        data, _ = own.normalize(text.encode())
        ids = own.encode([text], add_end=False)[0]
        begin, end = own.spans(text.encode(), ids)
        pieces = sentencepiece.SentencePieceProcessor(model_proto=model).encode(text, return_type="proto").pieces
        assert [(b, e) for b, e in zip(begin.tolist(), end.tolist())] == [(p.begin, p.end) for p in pieces], text
        assert data.tobytes().decode().replace("▁", " ").strip() == text.replace("ａｂ", "xyz").replace("ａ", "a").replace("é", "e").replace("ﬁ", "fi").replace("…", "...")


def test_normalizer_without_a_map_keeps_bytes():
    data, source = Normalizer(b"\x20\x00")("a é".encode())
    assert data.tobytes().decode() == "▁a▁é" and source.tolist() == [0, 0, 0, 0, 1, 1, 1, 2, 2, 4]


def test_tables(documents):
    docs = documents(ODD)
    got = encode(docs, MODEL, outputs=("ids", "span_starts", "span_ends", "decoded", "covered_bytes")).collect()
    assert len(got) == len(ODD)
    for row, (_, text) in zip(sorted(got, key=lambda r: (r.doc_id or 0, r.decoded)), sorted(((i, t or "") for i, t in ODD), key=lambda r: (r[0] or 0, r[1]))):
        assert row.decoded == text and row.covered_bytes == len(text.encode())
        assert row.ids[-1] == 2 and len(row.ids) == len(row.span_starts) == len(row.span_ends)
    assert encode(documents([]), MODEL).count() == 0


def test_decode(documents):
    docs = documents([(1, "a b"), (2, None)])
    back = {r.doc_id: r.decoded for r in decode(encode(docs, MODEL, outputs=("ids",)), MODEL).collect()}
    assert back == {1: "a b", 2: ""}
