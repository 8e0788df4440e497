"""Ids of all documents in one order, in files of Simple-8b blocks, and back.

Files are Parquet tables that Spark writes: a row is a block of ``packing`` with
the ids of its documents, the part of the order it belongs to and the number of
ids before it in that part. So any file system that Spark writes to will do, a
lost task leaves nothing behind, and readers take as many blocks as they like at
a time. A block ends with the document that fills it; documents are never cut.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from cadastra.llm.packing import Block, encode_block

#: Ids from which a block is closed.
BLOCK_IDS = 1 << 18
#: Texts encoded together.
CHUNK_ROWS = 256
#: A worker forgets its encoded parts beyond so many parts or ids.
KEPT_PARTS = 1_200_000
KEPT_IDS = 8_000_000
#: New parts that the library encodes in one call.
LEARNT_PARTS = 10_000

BLOCKS = "part int, block int, first_id long, n_ids long, docs array<long>, data binary"

_CARE = re.compile(r"\s (?!\S)")
_CUT = re.compile(r"(?<=\S) | (?=\S)")

# The letters, digits and white space of ASCII and of the Latin blocks, where the classes of all
# versions of Unicode agree, and the pattern of byte-level merges on them.
_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_SPACES = "\\t-\\r "
_PLAIN = re.compile(f"[{_LETTERS}!-~{_SPACES}]*")
_PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_LETTERS}0-9{_SPACES}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+")


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or the next one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in printable)
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class PieceEncoder:
    """The ids of the library for byte-level merges, each different part of a text encoded once.

    Texts of Latin letters, digits and signs are parted by the library's pattern
    here, and new parts are merged by the library's model. Other texts are first
    cut at spaces: no part goes on over a space that has a character other than
    white space before or after it. Pieces with other characters then go to the
    library whole.
    """

    def __init__(self, tokenizer: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work out
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_str(tokenizer)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.merges = Tokenizer(self.library.model)
        self.merges.pre_tokenizer = pre_tokenizers.Split("\n", "removed")  # no part has a line end: its byte has another letter
        self.letters = _byte_letters()
        self.widths = np.array([len(self.library.id_to_token(i) or "") for i in range(self.library.get_vocab_size())], np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _add(self, parts: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        self.known.update(zip(parts, range(len(self.known), len(self.known) + len(parts))))
        self.ids = np.concatenate((self.ids, ids.astype(np.uint32)))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(counts, dtype=np.int64)))

    def _learn(self, parts: list[str]) -> None:
        plain = [p for p in parts if _PLAIN.fullmatch(p)]
        if plain:
            spelt = [p.encode().decode("latin-1").translate(self.letters) for p in plain]
            ids = np.array(self.merges.encode("\n".join(spelt), add_special_tokens=False).ids, np.int64)
            ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum([len(p) for p in spelt])) + 1
            self._add(plain, ids, np.diff(ends, prepend=0))
        other = [p for p in parts if not _PLAIN.fullmatch(p)]
        if other:
            found = [x.ids for x in self.library.encode_batch(other, add_special_tokens=False)]
            self._add(other, np.array([i for x in found for i in x], np.int64), np.array([len(x) for x in found], np.int64))

    def _parts(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _PARTS.findall(text)
        first, *later = _CUT.split(text) if _CARE.search(text) else text.split(" ")
        pieces = [first, *[" " + p for p in later]]
        return [part for p in pieces for part in (_PARTS.findall(p) if _PLAIN.fullmatch(p) else [p])]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each text), as encode_batch without special tokens gives them."""
        if len(self.known) > KEPT_PARTS or len(self.ids) > KEPT_IDS:
            self.forget()
        parts: list[str] = []
        ends = []
        for text in texts:
            parts += self._parts(text)
            ends.append(len(parts))
        at = np.fromiter(map(self.known.get, parts, repeat(-1)), np.int64, len(parts))
        new = np.flatnonzero(at < 0).tolist()
        if new:
            missing = list({parts[i] for i in new})
            for start in range(0, len(missing), LEARNT_PARTS):
                self._learn(missing[start : start + LEARNT_PARTS])
            at[new] = [self.known[parts[i]] for i in new]
        start, length = self.starts[at], self.starts[at + 1] - self.starts[at]
        stop = np.cumsum(length)
        place = np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(start - (stop - length), length)
        return self.ids[place], np.diff(np.concatenate(([0], stop))[np.array(ends, np.int64)], prepend=0)


@lru_cache(maxsize=1)
def piece_encoder(tokenizer: str) -> PieceEncoder:
    """One for each worker, which tasks after one another use."""
    return PieceEncoder(tokenizer)


def _block(part: int, number: int, first: int, docs: list, ids: list[np.ndarray], lengths: list[int]) -> list:
    data = encode_block(np.concatenate(ids), lengths)
    return [part, number, first, sum(lengths), docs, data]


def encode_blocks(docs: DataFrame, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> DataFrame:
    """The blocks (``BLOCKS``) of all documents in ascending order of their ids.

    Every text is encoded whole, without special tokens, and ``end_id`` follows
    it; a null text counts as empty. Rows with a null id come first, rows of one
    id in the order of a hash of their text; rows that are equal are all kept.
    Other columns are not read. Texts are sorted over all tasks by ranges of the
    id, so a part is a range; a hot id is spread by the hash, and equal rows of
    it by their place in the table (so ``docs`` should be read from files).
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = spark.sparkContext.broadcast(file.read())  # a file of fixed size
    order = ["id", "hash", "place"]
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number, before = piece_encoder(tokenizer.value), TaskContext.get().partitionId(), 0, 0
        names, ids, lengths = [], [], []
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_ids", pa.int64()), ("docs", pa.list_(pa.int64())), ("data", pa.binary())])

        def full() -> pa.RecordBatch:
            nonlocal number, before
            row = _block(part, number, before, names[:], ids, lengths)
            number, before = number + 1, before + row[3]
            for waiting in (names, ids, lengths):
                waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

        size = 0
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK_ROWS):
                chunk = batch.slice(start, CHUNK_ROWS)
                flat, counts = own.encode([t or "" for t in chunk.column(1).to_pylist()])
                stops = np.cumsum(counts)
                whole = np.insert(flat, stops, end_id)
                at = 0
                for name, n in zip(chunk.column(0).to_pylist(), (counts + 1).tolist()):
                    names.append(name)
                    ids.append(whole[at : at + n])
                    lengths.append(n)
                    at, size = at + n, size + n
                    if size >= block_ids:
                        yield full()
                        size = 0
        if names:
            yield full()

    return placed.mapInArrow(run, BLOCKS)


def read_documents(blocks: DataFrame, outputs: Sequence[str] = ("ids",)) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and the asked ``outputs`` of every document of the blocks.

    ``outputs`` are ids (array of long) and ids_crc32 (checksum of the ids as
    little-endian unsigned 32-bit integers). Blocks may come in any order and
    partitioning. The ids before a part are a running sum over one row for each
    part. No blocks give no rows.
    """
    kinds = {"ids": "array<long>", "ids_crc32": "long"}
    arrow = {"ids": pa.list_(pa.int64()), "ids_crc32": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, docs, data in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                ids = Block(data).documents()
                lengths = np.array([len(x) for x in ids], np.int64)
                columns = [pa.array(np.full(len(ids), part, np.int32)), pa.array(docs, pa.int64()), pa.array(first + np.cumsum(lengths) - lengths), pa.array(lengths)]
                made = {
                    "ids": lambda: [x.astype(np.int64) for x in ids],
                    "ids_crc32": lambda: [zlib.crc32(x.astype("<u4").tobytes()) for x in ids],
                }
                columns += [pa.array(made[n](), arrow[n]) for n in outputs]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "start", "n_tokens", *outputs])

    schema = "part int, doc_id long, start long, n_tokens long" + "".join(f", {n} {kinds[n]}" for n in outputs)
    found = blocks.select("part", "first_id", "docs", "data").mapInArrow(run, schema)
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    base = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return found.join(base, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", *outputs)
