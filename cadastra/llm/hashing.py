"""Hashes of the words of many texts at once, on arrays of bytes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Bytes of text worked on together; one longer text is worked on alone.
BLOCK_BYTES = 1 << 20

# The increment and the two multipliers of the splitmix64 finaliser.
GOLDEN = 0x9E3779B97F4A7C15
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)

_MASK = (1 << 64) - 1
_BASE = MULTIPLIERS[0] * GOLDEN % (1 << 64) | 1

#: The six ASCII characters of white space.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64((seed + 1) * GOLDEN & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MULTIPLIERS[0])
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MULTIPLIERS[1])
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)


@lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, 2**bits of each."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(1 << bits, base, np.uint64)
        powers[0] = 1
        both.append(np.cumprod(powers))
    return both[0], both[1]


def _lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _lower_table()

#: Kinds of bytes: 0 parts words, and a word goes on while the kind stays the same.
WORDS = np.array([b not in SPACES for b in range(256)], np.uint8)
WORDS_AND_MARKS = np.array([0 if b in SPACES else 1 if b >= 128 or chr(b).isalnum() or b == 95 else 2 for b in range(256)], np.uint8)


def blocks(texts: Sequence[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as bytes in runs of about ``BLOCK_BYTES``, each with the index of its first text."""
    first, part, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        if part and size + len(raw) > BLOCK_BYTES:
            yield first, part
            first, part, size = i, [], 0
        part.append(raw)
        size += len(raw)
    if part:
        yield first, part


def word_hashes(raws: Sequence[bytes], kinds: np.ndarray = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased (A-Z) word, in order, and the number of words of each text."""
    data = LOWER[np.frombuffer(b"\n".join([*raws, b""]), np.uint8)]
    kind = np.concatenate(([0], kinds[data])).astype(np.int8)
    change = np.flatnonzero(kind[1:] != kind[:-1])  # a run of one kind ends before, and one begins at, each place
    begins = kind[1:][change] != 0
    start = change[begins]
    stop = np.append(change[1:], len(data))[begins]
    power, inverse = _powers(max(21, int(len(data)).bit_length()))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * power[: len(data)])))
    hashes = mix((total[stop] - total[start]) * inverse[start])
    ends = np.cumsum([len(r) + 1 for r in raws])
    return hashes, np.diff(np.searchsorted(start, ends), prepend=0)


def ngrams(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``n`` words inside one text, and the number of runs of each text."""
    text = np.repeat(np.arange(len(counts)), counts)
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.zeros(len(counts), np.int64)
    size = len(hashes) - n + 1
    mixed = np.full(size, n, np.uint64)
    for i in range(n):
        mixed = mix(mixed * np.uint64(_BASE) + hashes[i : i + size])
    inside = text[:size] == text[n - 1 :]
    return mixed[inside], np.maximum(counts - (n - 1), 0)
