"""SentencePiece encoding that keeps track of the original bytes, and decoding.

The text is normalised here, by the longest prefix that the model's compiled
character map holds, and every normalised byte remembers the original byte it
came from. The ids come from the public library; the lengths of their pieces add
up to the normalised text, and the alignment projects each piece back to a span
of original UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, types as T

from cadastra.llm.arrow import map_rows

SPACE = "▁".encode()

#: What ``encode`` can return for each text, and its type.
OUTPUTS = {
    "ids": T.ArrayType(T.IntegerType()),
    "span_starts": T.ArrayType(T.LongType()),
    "span_ends": T.ArrayType(T.LongType()),
    "decoded": T.StringType(),
    "n_tokens": T.LongType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
    "covered_bytes": T.LongType(),
}


def _fields(blob: bytes):
    """Fields (number, value) of one protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = blob[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(blob):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, blob[at : at + size]
            at += size


def read_char_map(blob: bytes) -> dict[bytes, bytes]:
    """All entries of a compiled character map: original bytes to replacement.

    The blob holds the size of a double-array trie, its 32-bit units, and the
    replacements, each ended by a zero byte.
    """
    if len(blob) < 4:
        return {}
    size = int.from_bytes(blob[:4], "little")
    units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
    texts = blob[4 + size :]

    def offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    found: dict[bytes, bytes] = {}
    todo = [(offset(units[0]), b"")]
    while todo:
        base, prefix = todo.pop()
        for label in range(1, 256):
            node = base ^ label
            if node < len(units) and units[node] & 0x800000FF == label:
                key = prefix + bytes([label])
                below = node ^ offset(units[node])
                if units[node] >> 8 & 1:
                    start = units[below] & 0x7FFFFFFF
                    found[key] = texts[start : texts.index(0, start)]
                todo.append((below, key))
    return found


class Normalizer:
    """Longest-prefix normalisation with the source position of every byte."""

    def __init__(self, spec: bytes):
        fields = dict(_fields(spec))
        self.table = read_char_map(fields.get(2, b""))
        self.dummy_prefix = bool(fields.get(3, 1))
        self.squeeze = bool(fields.get(4, 1))
        self.escape = bool(fields.get(5, 1))
        ordered = sorted(self.table, key=len, reverse=True)
        self.found = re.compile(b"|".join(map(re.escape, ordered))) if ordered else None

    def _replace(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Bytes after the character map, and for each the start of its source."""
        data = np.frombuffer(raw, np.uint8)
        source = np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0)) if len(data) else np.empty(0, np.int64)
        if self.found is None:
            return data, source
        bytes_out, source_out, done, at = [], [], 0, 0
        while m := self.found.search(raw, at):
            if raw[m.start()] & 0xC0 == 0x80:  # a match may begin only where a character begins
                at = m.start() + 1
                continue
            new = np.frombuffer(self.table[m[0]], np.uint8)
            bytes_out += [data[done : m.start()], new]
            source_out += [source[done : m.start()], np.full(len(new), m.start())]
            done = at = m.end()
        return np.concatenate([*bytes_out, data[done:]]), np.concatenate([*source_out, source[done:]])

    def __call__(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Normalised bytes, and one source position more than there are bytes."""
        data, source = self._replace(raw)
        end = len(raw)
        if self.squeeze and len(data):
            space = data == 32
            kept = ~(space & np.concatenate(([True], space[:-1])))
            data, source = data[kept], source[kept]
            if len(data) and data[-1] == 32:
                end = int(source[-1])
                data, source = data[:-1], source[:-1]
        if not len(data):
            return np.empty(0, np.uint8), np.array([end])
        mark = np.frombuffer(SPACE if self.escape else b" ", np.uint8)
        if self.escape:
            space = data == 32
            times = np.where(space, 3, 1)
            source = np.repeat(source, times)
            data = np.repeat(data, times)
            data[np.repeat(space, times)] = np.tile(mark, int(space.sum()))
        if self.dummy_prefix:
            data = np.concatenate((mark, data))
            source = np.concatenate((np.full(len(mark), source[0]), source))
        return data, np.append(source, end)


class PieceCodec:
    """Encodes with spans and decodes, with the model given as bytes."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = Normalizer(next((v for f, v in _fields(model) if f == 3), b""))
        ids = range(self.library.get_piece_size())
        self.is_byte = np.array([self.library.is_byte(i) for i in ids])
        self.lengths = np.array([1 if self.library.is_byte(i) else 0 if self.library.is_control(i) else len(self.library.id_to_piece(i).encode()) for i in ids])

    def spans(self, raw: bytes, ids: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """Original byte span of each piece.

        Of the byte pieces that spell one character, the last has its span and
        the others are empty; control pieces are empty too.
        """
        data, source = self.normalize(raw)
        at = np.asarray(ids, np.int64)
        length = self.lengths[at]
        unknown = at == self.library.unk_id()
        if unknown.any():  # without byte pieces, an unknown piece has what the others leave
            pieces = self.library.encode(raw.decode(), out_type=str)
            length[: len(pieces)][unknown[: len(pieces)]] = [len(p.encode()) for p, u in zip(pieces, unknown) if u]
        stop = np.cumsum(length)
        start = stop - length
        if len(stop) and stop[-1] != len(data):
            raise ValueError(f"the pieces spell {stop[-1]} bytes, the normalised text has {len(data)}")
        whole = np.append((data & 0xC0) != 0x80, True)  # positions where a character begins
        byte = self.is_byte[at]
        begin = source[start]
        end = np.where(byte & ~whole[stop], begin, source[stop])
        return begin, end

    def encode(self, texts: Sequence[str], add_end: bool = True) -> list[list[int]]:
        return self.library.encode(list(texts), add_eos=add_end, num_threads=1)

    def decode(self, ids: Sequence[Sequence[int]]) -> list[str]:
        return self.library.decode(list(ids), num_threads=1) if ids else []


@lru_cache(maxsize=2)
def codec(model: bytes) -> PieceCodec:
    return PieceCodec(model)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", outputs: Sequence[str] = ("ids", "span_starts", "span_ends"),
    add_end: bool = True,
) -> DataFrame:
    """``id_col`` and the asked ``outputs`` for each row, one pass over the text.

    A null text counts as empty: it has the end id alone (none without
    ``add_end``), an empty span and an empty decoded text. Rows are kept as they
    are, repeated and null ids included; other columns are not read. Every text
    is encoded whole; a task holds one chunk of rows. The model is read once, on
    the driver, and goes to the executors as a broadcast of its fixed size.
    """
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([docs.schema[id_col], *[T.StructField(n, OUTPUTS[n]) for n in outputs]])
    spans = {"span_starts", "span_ends", "covered_bytes"} & set(outputs)
    read_back = {"decoded", "decoded_sha256"} & set(outputs)

    def make():
        own = codec(model.value)

        def rows(chunk):
            texts = [t or "" for t in chunk[text_col]]
            ids = own.encode(texts, add_end)
            out = {id_col: chunk[id_col], "ids": ids, "n_tokens": [len(x) for x in ids]}
            if "ids_sha256" in outputs:
                out["ids_sha256"] = [_digest(" ".join(map(str, x))) for x in ids]
            if spans:
                pairs = [own.spans(t.encode(), x) for t, x in zip(texts, ids)]
                out["span_starts"] = [b for b, _ in pairs]
                out["span_ends"] = [e for _, e in pairs]
                out["covered_bytes"] = [int((e - b).sum()) for b, e in pairs]
            if read_back:
                out["decoded"] = own.decode(ids)
                out["decoded_sha256"] = [_digest(t) for t in out["decoded"]]
            return out

        return rows

    return map_rows(docs, [id_col, text_col], make, schema)


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col`` and the ``decoded`` text of each list of ids; null ids give an empty text."""
    with open(model_path, "rb") as file:
        model = encoded.sparkSession.sparkContext.broadcast(file.read())
    schema = T.StructType([encoded.schema[id_col], T.StructField("decoded", T.StringType())])

    def make():
        own = codec(model.value)
        return lambda chunk: {id_col: chunk[id_col], "decoded": own.decode([x or [] for x in chunk[ids_col]])}

    return map_rows(encoded, [id_col, ids_col], make, schema)
