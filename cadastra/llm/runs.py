"""Periodic runs in the words of a text, by maximal pairs.

A run is a longest stretch with a period. Two equal stretches form a maximal pair
if neither the words before them nor those after them are equal; a run of period
q is what the maximal pair at distance q covers, if the equal stretch is at least
q long, so nothing has to be extended. Suffixes are sorted, and the intervals of
common prefixes are walked bottom-up: each has the places of its suffixes, in a
list of all and in one for each word to their left. When two parts of an interval
meet, each place of the smaller one looks in the larger one for places within
reach that have another word to their left. All of these are runs, or repeats of
a run's period.

Only suffixes whose first words occur more than once are sorted to the end, as a
run of ``min_length`` needs an equal stretch of half of that. Places with the
same word to the left are passed over by doubling steps, so the work of a text of
n words grows as n log n times a logarithm, repetitive or not.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, types as T

from cadastra.llm.arrow import map_rows

#: Runs shorter than this many words are not reported.
MIN_LENGTH = 12
#: Words sorted together; a longer text is sorted alone.
BATCH_WORDS = 1 << 19

Run = tuple[int, int, int]


def word_ids(texts: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A number for every word (runs of bytes other than ASCII white space) of the texts, equal for equal words, and the words of each text."""
    known: dict[bytes, int] = {}
    split = [t.split() for t in texts]
    flat = [w for words in split for w in words]
    ids = np.fromiter((known.setdefault(w, len(known)) for w in flat), np.int64, len(flat))
    return ids, np.array([len(w) for w in split], np.int64)


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of the keys from 0, equal for equal keys."""
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _repeats(ids: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """For each text, whether some ``n`` words in a row occur in it twice (or have the same hash as others)."""
    text = np.repeat(np.arange(len(counts)), counts)
    size = len(ids) - n + 1
    if size <= 0:
        return np.zeros(len(counts), bool)
    mixed = text[:size].astype(np.uint64)
    for i in range(n):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + size].astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    inside = text[:size] == text[n - 1 :]
    grams, texts = mixed[inside], text[:size][inside]
    order = np.argsort(grams)
    same = grams[order][1:] == grams[order][:-1]
    out = np.zeros(len(counts), bool)
    out[texts[order][1:][same]] = True
    return out


def sorted_suffixes(ids: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, common, word): suffixes that share ``least`` words or more with another of their text, sorted; words each shares with the one before.

    Prefix doubling: the rank of a place's first 2h words is the pair of the ranks
    of its first h words and of the h after them; only places whose rank others
    have are ranked again. Each text ends with a word of its own, so suffixes of
    different texts share nothing. ``word`` has the words with these ends.
    """
    ends = np.cumsum(counts) + np.arange(len(counts))
    word = np.empty(len(ids) + len(counts), np.int64)
    inside = np.ones(len(word), bool)
    inside[ends] = False
    word[inside] = ids
    word[ends] = np.arange(len(counts)) + (int(ids.max()) + 1 if len(ids) else 0)
    rank = _dense(word)
    levels = [rank]
    tied = np.flatnonzero(np.bincount(rank)[rank] > 1)
    width = 1
    while len(tied):
        # Ranks are the places that a sort by them would begin at, so a group of ties is ranked inside its own range.
        if width == 1:
            begin = np.concatenate(([0], np.cumsum(np.bincount(rank))))
            rank = begin[rank]
            levels[0] = rank
        second = rank[tied + width]
        order = np.lexsort((second, rank[tied]))
        first, second = rank[tied][order], second[order]
        place = np.arange(len(order))
        fresh = np.concatenate(([True], first[1:] != first[:-1]))
        split = fresh | np.concatenate(([True], second[1:] != second[:-1]))
        group_begin = np.maximum.accumulate(np.where(fresh, place, 0))
        part_begin = np.maximum.accumulate(np.where(split, place, 0))
        rank = rank.copy()
        rank[tied[order]] = first + part_begin - group_begin
        levels.append(rank)
        width *= 2
        sizes = np.diff(np.append(np.flatnonzero(split), len(order)))
        tied = tied[order][np.repeat(sizes > 1, sizes)]
    # Words shared with the next suffix in order, longest steps first.
    order = np.argsort(rank, kind="stable")
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        equal = levels[k][a] == levels[k][b]
        step = equal * (1 << k)
        common += step
        a += step
        b += step
    common = np.concatenate(([0], common))
    near = (common >= least) | np.append(common[1:] >= least, False)
    return order[near], common[near], word


class _Interval:
    """Places of the suffixes of an interval, sorted, and those of each word to the left."""

    __slots__ = ("classes", "places")

    def __init__(self, place: int, left: int):
        self.places = [place]
        self.classes = {left: [place]}


def _others(interval: _Interval, left: Sequence[int], low: int, high: int, avoid: int) -> Iterator[int]:
    """Places from ``low`` to ``high`` whose word to the left is not ``avoid``."""
    places, same = interval.places, interval.classes.get(avoid, ())
    at = bisect_left(places, low)
    while at < len(places) and places[at] <= high:
        if left[places[at]] != avoid:
            yield places[at]
            at += 1
            continue
        # The class' list runs in step with that of all places while nothing else comes between.
        own, step = bisect_left(same, places[at]), 1
        while at + step < len(places) and own + step < len(same) and places[at + step] == same[own + step]:
            step *= 2
        known, beyond = step // 2, step  # in step up to the first, no more at the second
        while beyond - known > 1:
            middle = (known + beyond) // 2
            if at + middle < len(places) and own + middle < len(same) and places[at + middle] == same[own + middle]:
                known = middle
            else:
                beyond = middle
        at += known + 1


def maximal_pairs(places: Sequence[int], common: Sequence[int], left: Sequence[int], least: int) -> Iterator[Run]:
    """(start, distance, equal) of all maximal pairs at a distance of at most their length, which is ``least`` or more.

    ``left[place]`` is the word before a place; it is unlike all others where a text begins.
    """
    stack: list[_Interval] = []
    shared: list[int] = []

    def meet() -> Iterator[Run]:
        """The two upper intervals become one; suffixes of the one share exactly so many words with those of the other."""
        small, large, length = stack.pop(), stack.pop(), shared.pop()
        if len(small.places) > len(large.places):
            small, large = large, small
        for place in small.places:
            for other in _others(large, left, place - length, place + length, left[place]):
                yield (place, other - place, length) if place < other else (other, place - other, length)
        for place in small.places:
            insort(large.places, place)
        for word, some in small.classes.items():
            mine = large.classes.setdefault(word, [])
            for place in some:
                insort(mine, place)
        stack.append(large)

    for place, length in zip(places, common):
        while shared and shared[-1] >= max(length, least):
            yield from meet()
        if length < least:
            stack.clear()
        else:
            shared.append(length)
        stack.append(_Interval(place, left[place]))
    while shared:
        yield from meet()


def runs_of(texts: Sequence[bytes], min_length: int = MIN_LENGTH) -> Iterator[list[Run]]:
    """The runs (start, length, period) of each text's words, by start, then period."""
    least = -(-min_length // 2)
    first = 0
    while first < len(texts):
        stop, size = first, 0
        while stop < len(texts) and (stop == first or size + len(texts[stop]) <= 8 * BATCH_WORDS):
            size += len(texts[stop])
            stop += 1
        ids, counts = word_ids(texts[first:stop])
        found: list[list[Run]] = [[] for _ in range(stop - first)]
        some = np.flatnonzero(_repeats(ids, counts, least))
        if len(some):
            own = np.concatenate([ids[e - n : e] for e, n in zip(np.cumsum(counts)[some].tolist(), counts[some].tolist())])
            places, common, word = sorted_suffixes(own, counts[some], least)
            begins = np.cumsum(counts[some] + 1) - counts[some] - 1
            left = np.concatenate(([-1], word[:-1]))
            left[begins] = -1 - np.arange(len(some))
            smallest: dict[tuple[int, int], int] = {}
            for start, distance, equal in maximal_pairs(places.tolist(), common.tolist(), left.tolist(), least):
                if distance + equal >= min_length:
                    key = (start, distance + equal)  # a longer period of the same stretch is a repeat of the smallest one
                    smallest[key] = min(distance, smallest.get(key, distance))
            keys = np.array(list(smallest), np.int64).reshape(-1, 2)
            text = np.searchsorted(begins, keys[:, 0], "right") - 1
            for t, (start, length), period in zip(text.tolist(), keys.tolist(), smallest.values()):
                found[some[t]].append((start - int(begins[t]), length, period))
        for runs in found:
            yield sorted(runs, key=lambda r: (r[0], r[2]))
        first = stop


def collapse(text: bytes, runs: Sequence[Run]) -> bytes:
    """The words of a text without those that a run repeats after its first period, joined by one space."""
    words = text.split()
    if runs:
        dropped = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            dropped[start + period] += 1
            dropped[start + length] -= 1
        words = [w for w, d in zip(words, np.cumsum(dropped).tolist()) if not d]
    return b" ".join(words)


RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")]), False)


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH) -> DataFrame:
    """``id_col``, n_words, the runs and the collapsed text of every row.

    Words are runs of characters other than ASCII white space, numbered from 0.
    ``runs`` has (start, length, period) of all runs of at least ``min_length``
    words, by start, then period; the period is the smallest one and the run at
    least twice as long. ``collapsed`` are the words that no run contains after
    its first period, joined by one space. A null or empty text has no words, no
    runs and an empty collapsed text. Rows are kept as they are, repeated and null
    ids included; other columns are not read. A text is one row's work, whole.
    """
    if min_length < 2:
        raise ValueError("a run has at least two words")
    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])

    def make():
        def rows(chunk):
            texts = [(t or "").encode() for t in chunk[text_col]]
            runs = list(runs_of(texts, min_length))
            named = [[dict(zip(("start", "length", "period"), r)) for r in x] for x in runs]
            return {
                id_col: chunk[id_col], "n_words": [len(t.split()) for t in texts], "runs": named,
                "collapsed": [collapse(t, r).decode() for t, r in zip(texts, runs)],
            }

        return rows

    return map_rows(docs, [id_col, text_col], make, schema)
