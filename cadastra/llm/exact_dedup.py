"""Exact deduplication with an index of cuckoo filters that takes insertions and deletions.

The index is cut into shards by digest. A shard has a cuckoo filter and the
buckets of stored keys (the whole digests of live texts with the row that
stays). A digest that the filter doesn't know is new; a hit is verified against
the keys stored in its two buckets. When an insertion finds no free slot, the
shard doubles its buckets and is filled again from the stored keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cadastra.session import stage

SLOTS = 4
MAX_KICKS = 200
#: Digests a shard is laid out for; a shard holds one row for each, and one task works on it.
SHARD_ROWS = 100_000

STATE = "shard int, digest binary, keep_id long, group_size long, slot long, buckets long"
STATE_COLUMNS = ["shard", "digest", "keep_id", "group_size", "slot", "buckets"]


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots; the keys are kept by slot beside them."""

    def __init__(self, n_keys: int = 0):
        self.size = 4
        while self.size * SLOTS * 0.8 < n_keys:
            self.size *= 2
        self._clear()

    def _clear(self) -> None:
        self.marks = np.zeros((self.size, SLOTS), np.uint16)
        self.keys: dict[int, bytes] = {}  # slot number to stored key

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[:2], "little") or 1
        first = int.from_bytes(key[8:16], "little") & (self.size - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x5BD1E995 & (self.size - 1))

    def may_hold(self, key: bytes) -> bool:
        mark, a, b = self._places(key)
        return mark in self.marks[a].tolist() or mark in self.marks[b].tolist()

    def find(self, key: bytes) -> int | None:
        """Slot of a stored key: the filter first, then the content of the two buckets."""
        mark, a, b = self._places(key)
        for bucket in (a, b):
            for slot, found in enumerate(self.marks[bucket].tolist()):
                if found == mark and self.keys[bucket * SLOTS + slot] == key:
                    return bucket * SLOTS + slot
        return None

    def insert(self, key: bytes) -> None:
        """Insert a key that isn't stored; doubles the buckets when no slot can be freed."""
        mark, bucket, other = self._places(key)
        for choice in (bucket, other):
            if 0 in (row := self.marks[choice].tolist()):
                self._put(choice, row.index(0), mark, key)
                return
        for kick in range(MAX_KICKS):
            slot = kick % SLOTS
            at = bucket * SLOTS + slot
            moved_mark, moved_key = int(self.marks[bucket, slot]), self.keys[at]
            self._put(bucket, slot, mark, key)
            mark, key = moved_mark, moved_key
            bucket = self._other(bucket, mark)
            if 0 in (row := self.marks[bucket].tolist()):
                self._put(bucket, row.index(0), mark, key)
                return
        self._resize(key)

    def _put(self, bucket: int, slot: int, mark: int, key: bytes) -> None:
        self.marks[bucket, slot] = mark
        self.keys[bucket * SLOTS + slot] = key

    def _resize(self, extra: bytes) -> None:
        stored = [*self.keys.values(), extra]
        self.size *= 2
        self._clear()
        for key in stored:
            self.insert(key)

    def delete(self, key: bytes) -> bool:
        """Remove a stored key; other keys with the same fingerprint stay."""
        slot = self.find(key)
        if slot is None:
            return False
        self.marks[slot // SLOTS, slot % SLOTS] = 0
        del self.keys[slot]
        return True

    def load(self, keys: list[bytes], slots: list[int], buckets: int) -> None:
        """Put keys back at the slots they were stored at in a filter of so many buckets."""
        self.size = buckets
        self._clear()
        for key, slot in zip(keys, slots):
            self._put(slot // SLOTS, slot % SLOTS, int.from_bytes(key[:2], "little") or 1, key)


def normalised(text: Column) -> Column:
    """Each run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the normalised text, computed where the text is read."""
    return docs.select(docs[f"`{id_col}`"].alias("id"), F.unhex(F.sha2(normalised(docs[f"`{text_col}`"]), 256)).alias("digest"))


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def _combined(rows: DataFrame, shards: int) -> DataFrame:
    """One row for each digest and task: copies meet in the task before they are dealt out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch.assign(n=1).groupby("digest", sort=False).agg(keep_id=("id", "min"), group_size=("n", "sum")).reset_index()
            yield found.astype({"keep_id": "Int64"})

    return rows.mapInPandas(run, "digest binary, keep_id long, group_size long").select(_shard(F.col("digest"), shards).alias("shard"), "*")


def _opened(stored: pd.DataFrame, expected: int) -> tuple[CuckooFilter, dict[bytes, list]]:
    """The shard's filter as it was stored, or filled again from the stored keys if more are expected than it is laid out for."""
    filter_ = CuckooFilter(max(expected, len(stored)))
    rows = {bytes(d): [k, n] for d, k, n in zip(stored.digest, stored.keep_id, stored.group_size)}
    buckets = int(stored.buckets.iloc[0]) if len(stored) else 0
    if buckets >= filter_.size:
        filter_.load(list(rows), [int(s) for s in stored.slot], buckets)
    else:
        for key in rows:
            filter_.insert(key)
    return filter_, rows


def _closed(shard: int, filter_: CuckooFilter, rows: dict[bytes, list]) -> pd.DataFrame:
    at = {key: slot for slot, key in filter_.keys.items()}
    out = pd.DataFrame(
        {"shard": shard, "digest": list(rows), "keep_id": [r[0] for r in rows.values()], "group_size": [r[1] for r in rows.values()], "slot": [at[k] for k in rows], "buckets": filter_.size}
    )
    return out.astype({"keep_id": "Int64", "shard": "int32"})[STATE_COLUMNS]


def _insert_shard(key: tuple, stored: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
    filter_, rows = _opened(stored, len(stored) + len(new) // 4)
    for digest, keep, n in zip(new.digest, new.keep_id, new.group_size):
        digest = bytes(digest)
        if filter_.may_hold(digest) and filter_.find(digest) is not None:
            row = rows[digest]
            row[0] = keep if pd.isna(row[0]) else row[0] if pd.isna(keep) else min(row[0], keep)
            row[1] += n
        else:
            filter_.insert(digest)
            rows[digest] = [keep, n]
    return _closed(int(key[0]), filter_, rows)


def _delete_shard(key: tuple, stored: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
    filter_, rows = _opened(stored, len(stored))
    for digest in gone.digest:
        digest = bytes(digest)
        if filter_.may_hold(digest) and filter_.delete(digest):
            del rows[digest]
    return _closed(int(key[0]), filter_, rows)


class DedupIndex:
    """Live digests in shards; ``state`` is a table in the shared folder.

    ``insert`` and ``delete`` write a new state and leave the old one, so a task
    that is run again finds what it read before.
    """

    def __init__(self, spark: SparkSession, shards: int, state: DataFrame | None = None):
        self.shards = shards
        self.state = spark.createDataFrame([], STATE) if state is None else state

    @classmethod
    def for_rows(cls, spark: SparkSession, n_rows: int) -> DedupIndex:
        return cls(spark, max(1, -(-n_rows // SHARD_ROWS)))

    def insert(self, rows: DataFrame) -> DedupIndex:
        """Index after the rows (id, digest): the smallest id of a digest stays."""
        new = _combined(rows, self.shards)
        merged = self.state.groupBy("shard").cogroup(new.groupBy("shard")).applyInPandas(_insert_shard, STATE)
        return DedupIndex(self.state.sparkSession, self.shards, stage(merged))

    def delete(self, gone: DataFrame) -> DedupIndex:
        """Index without the digests of ``gone`` (column ``digest``); unknown ones change nothing."""
        keys = gone.select("digest").where(F.col("digest").isNotNull()).distinct().select(_shard(F.col("digest"), self.shards).alias("shard"), "digest")
        left = self.state.groupBy("shard").cogroup(keys.groupBy("shard")).applyInPandas(_delete_shard, STATE)
        return DedupIndex(self.state.sparkSession, self.shards, stage(left))

    def live(self) -> DataFrame:
        """(digest, keep_id, group_size) of each live text."""
        return self.state.select("digest", "keep_id", "group_size")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, keep_id, group_size, kept and text_sha256 of every row.

    Texts are equal when they are the same after each run of ASCII white space
    became one space; null counts as empty. Of equal texts the row with the
    smallest id stays. Repeated rows of one id and text count each in
    ``group_size``, and one of them is kept. A null id comes after all others:
    it stays only where the group has nothing else, and then ``keep_id`` is
    null. An empty table gives an empty result. Other columns are not read.
    """
    found = stage(digests(docs, id_col, text_col))
    index = DedupIndex.for_rows(docs.sparkSession, found.count()).insert(found)
    repeated = found.groupBy("id", "digest").agg(F.count("*").alias("copies"))
    joined = repeated.join(index.live(), "digest").select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "*")
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
