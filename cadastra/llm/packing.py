"""Simple-8b word-aligned coding of ids, in blocks that numpy encodes and decodes whole.

A 64-bit word has a selector in its upper 4 bits, and 60 bits that hold as many
values as the selector says, all of one width. A block replaces its frequent ids
by their rank (the smallest ranks are the commonest ids, so words hold many of
them); a rank has a place in the block's dictionary. All other ids are escapes:
their place in the word holds ones only, and the id itself follows in a list.
Numbers of ids and escapes before every group of words let a reader decode any
part of a block without the words before it.

Layout of a block, little-endian: the header of ``HEADER``, words (8 bytes
each), lengths of the documents (4 bytes), ids and escapes before each group of
words (4 bytes each), the dictionary and the escapes (``id_bytes`` each).
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import numpy as np

# Widths of the selectors of Simple-8b in bits; 60 bits hold 60 // width values.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
COUNTS = tuple(60 // w for w in WIDTHS)
MAGIC = b"S8B1"

HEADER = np.dtype([("magic", "S4"), ("id_bytes", "<u4"), *[(f, "<u4") for f in ("ids", "docs", "words", "groups", "ranked", "escapes")]])
GROUP_WORDS = 256
#: Marks an escape among ranks; above every rank.
ESCAPE = np.uint64(1 << 62)
_SHIFT = np.uint64(60)


def _ones(width: int) -> np.uint64:
    return np.uint64((1 << width) - 1)


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, dictionary, escapes): the ids as ranks, with as large a dictionary as makes the block smallest."""
    top = int(ids.max()) if len(ids) else 0
    if top < 1 << 22:
        counts = np.bincount(ids.astype(np.int64), minlength=1)
        known = np.flatnonzero(counts)
        inverse = None
    else:
        known, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
    seen = counts[known] if inverse is None else counts
    order = np.argsort(-seen, kind="stable")
    total = np.cumsum(seen[order])
    id_bits = 16 if top < 1 << 16 else 32 if top < 1 << 32 else 64
    # Bits of the ids of each width under the dictionary's size, of the dictionary, and of the escapes.
    sizes = [min(len(order), (1 << w) - 1) for w in WIDTHS if w <= 30]
    upto = [int(total[s - 1]) if s else 0 for s in sizes]
    inside, costs = 0, []
    for k, (size, n) in enumerate(zip(sizes, upto)):
        inside += (n - (upto[k - 1] if k else 0)) * (64 / COUNTS[k])
        costs.append(inside + size * id_bits + (len(ids) - n) * (id_bits + 64 / COUNTS[k]))
    size = sizes[int(np.argmin(costs))]
    dictionary = known[order[:size]].astype(np.uint64)
    if inverse is None:
        rank = np.full(len(counts), ESCAPE, np.uint64)
        rank[dictionary.astype(np.int64)] = np.arange(size, dtype=np.uint64)
        values = rank[ids.astype(np.int64)]
    else:
        rank = np.full(len(known), ESCAPE, np.uint64)
        rank[order[:size]] = np.arange(size, dtype=np.uint64)
        values = rank[inverse]
    return values, dictionary, ids[values == ESCAPE]


def _chosen(values: np.ndarray) -> np.ndarray:
    """The selector that a word beginning at each place would have: the narrowest one whose values all fit."""
    n = len(values)
    need = np.zeros(n + 64, np.uint8)  # behind the end anything fits
    plain = np.where(values == ESCAPE, np.uint64(0), values)
    most = plain.max(initial=0)
    for width in WIDTHS:
        if _ones(width) > most:  # a value of ones only would be an escape
            break
        need[:n] += plain >= _ones(width)
    widest = {1: need}
    for count in sorted(set(COUNTS) - {1}):  # a window is the larger of two shorter ones that cover it
        part = max(c for c in widest if c < count)
        while 2 * part < count:
            both = np.zeros_like(need)
            both[: len(need) - part] = np.maximum(widest[part][:-part], widest[part][part:])
            widest[2 * part] = both
            part *= 2
        both = np.zeros_like(need)
        step = count - part
        both[: len(need) - step] = np.maximum(widest[part][:-step], widest[part][step:])
        widest[count] = both
    choice = np.full(n, len(WIDTHS) - 1, np.uint8)
    for k in range(len(WIDTHS) - 2, -1, -1):
        choice[widest[COUNTS[k]][:n] <= k] = k
    return choice


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first): the words of the values (``ESCAPE`` or below 2**60 - 1), and the place of each word's first value."""
    n = len(values)
    choice = _chosen(values)
    steps = np.array(COUNTS, np.uint8)[choice].tobytes()
    first, at = [], 0
    while at < n:
        first.append(at)
        at += steps[at]
    first = np.array(first, np.int64)
    selector = choice[first]
    words = selector.astype(np.uint64) << _SHIFT
    padded = np.concatenate((np.where(values == ESCAPE, _ones(64), values), np.zeros(64, np.uint64)))
    for k in np.unique(selector):
        mine = np.flatnonzero(selector == k)
        at, payload = first[mine], np.zeros(len(mine), np.uint64)
        for j in range(COUNTS[k]):
            payload |= (padded[at + j] & _ones(WIDTHS[k])) << np.uint64(j * WIDTHS[k])
        words[mine] |= payload
    return words, first


def unpack(words: np.ndarray) -> np.ndarray:
    """The values of the words, those that fill the last word up included."""
    selector = (words >> _SHIFT).astype(np.int64)
    counts = np.array(COUNTS)[selector]
    stop = np.cumsum(counts)
    values = np.empty(int(stop[-1]) if len(stop) else 0, np.uint64)
    for k in np.unique(selector):
        mine = np.flatnonzero(selector == k)
        part = (words[mine][:, None] >> (np.arange(COUNTS[k], dtype=np.uint64) * np.uint64(WIDTHS[k]))) & _ones(WIDTHS[k])
        values[(stop - counts)[mine][:, None] + np.arange(COUNTS[k])] = np.where(part == _ones(WIDTHS[k]), ESCAPE, part)
    return values


def encode_block(ids: np.ndarray, lengths: Sequence[int]) -> bytes:
    """One block with the ids (from 0 up to 2**64 - 1) of documents of these lengths, one after another."""
    ids = np.asarray(ids, np.uint64)
    lengths = np.asarray(lengths, np.int64)
    if lengths.sum() != len(ids) or len(ids) >= 1 << 32:
        raise ValueError(f"{len(ids)} ids for lengths of {int(lengths.sum())}")
    values, dictionary, escapes = _ranked(ids)
    words, first = pack(values)
    starts = first[::GROUP_WORDS]
    missed = np.concatenate(([0], np.cumsum(values == ESCAPE)))[starts]
    top = int(ids.max()) if len(ids) else 0
    id_bytes = 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    header = np.array([(MAGIC, id_bytes, len(ids), len(lengths), len(words), len(starts), len(dictionary), len(escapes))], HEADER)
    parts = (header, words.astype("<u8"), lengths.astype("<u4"), starts.astype("<u4"), missed.astype("<u4"), dictionary.astype(f"<u{id_bytes}"), escapes.astype(f"<u{id_bytes}"))
    return b"".join(p.tobytes() for p in parts)


class Block:
    """Reads a block; only the parts asked for are decoded."""

    def __init__(self, data: bytes):
        head = np.frombuffer(data, HEADER, 1)[0]
        if head["magic"] != MAGIC:
            raise ValueError("not a block of ids")
        self.ids = int(head["ids"])
        kind, at = f"<u{head['id_bytes']}", HEADER.itemsize
        parts = []
        for dtype, n in (("<u8", head["words"]), ("<u4", head["docs"]), ("<u4", head["groups"]), ("<u4", head["groups"]), (kind, head["ranked"]), (kind, head["escapes"])):
            parts.append(np.frombuffer(data, dtype, int(n), at))
            at += parts[-1].nbytes
        self.words, lengths, starts, self.missed, self.dictionary, self.escapes = parts
        self.ends = np.cumsum(lengths, dtype=np.int64)
        self.starts = starts.astype(np.int64)

    def read(self, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids from ``start`` to before ``stop``."""
        stop = self.ids if stop is None else min(stop, self.ids)
        if start >= stop:
            return np.empty(0, np.uint64)
        first = int(np.searchsorted(self.starts, start, "right")) - 1
        last = int(np.searchsorted(self.starts, stop, "left"))
        values = unpack(self.words[first * GROUP_WORDS : last * GROUP_WORDS])
        values = values[: stop - int(self.starts[first])]
        escaped = values == ESCAPE
        out = np.empty(len(values), np.uint64)
        out[~escaped] = self.dictionary[values[~escaped].astype(np.int64)]
        missed = int(self.missed[first])
        out[escaped] = self.escapes[missed : missed + int(escaped.sum())]
        return out[start - int(self.starts[first]) :]

    def documents(self) -> list[np.ndarray]:
        """The ids of each document."""
        ids = self.read()
        return [ids[a:b] for a, b in pairwise([0, *self.ends.tolist()])]
