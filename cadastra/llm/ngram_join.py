"""Similarity join of documents on word n-grams, and the groups its links make.

A document is the set of its 5-word shingles. For a Jaccard similarity of at
least 80 %, two sets share one of their first 20 % under any order of all
shingles, and under a longer prefix more of them, by a number that follows from
their sizes. Several orders are used: all put shingles known to be frequent
last, and differ in the hash that orders the rest. The first one proposes
candidates, which must share as many as similar sets would under each of the
others too before their texts are compared. A document that shares fewer
shingles of a longer prefix with all others together than two similar ones share
is on no list: a passage that texts have in common doesn't bring them together.

Where many documents share a shingle they aren't paired with each other but with
one leader of similar size. Documents that reach their leader are in its group.
One that is far from its leader (a similarity under 60 %) can't be similar to one
that reached it, for the distances obey the triangle inequality. So only lists
with two documents that are far from the leader, or one that is neither, are
looked at again: with the leader that has most links, then without leaders.
Without leaders, the documents left are dealt out to tiles of a bounded weight.
Two tiles with a list in common meet as one group, where the orders' prefixes
choose what is compared; only links leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from cadastra.llm.components import components
from cadastra.llm.hashing import blocks, mix, ngrams, word_hashes
from cadastra.llm.url_filter import bloom_level
from cadastra.session import collect_garbage, stage

WORDS = 5
PERCENT = 80
#: Under this similarity to a leader, a document is similar to none that reaches the leader.
FAR_PERCENT = 2 * PERCENT - 100
#: Share of a set whose shingles are counted under the first order, to tell which sets may have a similar one.
LONG_PREFIX = 25
#: Share of a set that the other orders' prefixes have.
OTHER_PREFIX = 50
#: Least bits for each shingle of a prefix (or of a whole set) in its bitmap.
BITS_PER_SHINGLE = 4
#: Bits of the filter that keeps texts without candidates from being shuffled.
FILTER_BITS = 1 << 26
#: The orders after the first; each has its own hash.
OTHER_ORDERS = (1, 2)
#: What is held against each other before texts are: an order, and the share of a set that its prefix has.
FILTERS = (*((k, OTHER_PREFIX) for k in OTHER_ORDERS), (0, 100))
#: Shingles a task counts together, and the documents among them from which a shingle is reported as frequent.
COUNTED = 4_000_000
LOCALLY_FREQUENT = 4
#: Frequent shingles that every task is told, the most frequent first. More of them never change a result.
FREQUENT = 400_000
#: Shingles, and eighths of the bytes of texts, of the documents in a tile.
TILE = 1 << 17
#: Documents that have one leader in the list of a frequent shingle; a longer list has several.
LIST_ROWS = 2048


def shingle_sets(texts: list[str | None]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted different shingles) of each text; with fewer words than a shingle, the whole sequence is one."""
    for first, raws in blocks(texts):
        hashes, counts = word_hashes(raws)
        grams, gram_counts = ngrams(hashes, counts, WORDS)
        word_end, gram_end = np.cumsum(counts), np.cumsum(gram_counts)
        for i, (n, m) in enumerate(zip(counts, gram_counts)):
            if m:
                yield first + i, np.unique(grams[gram_end[i] - m : gram_end[i]])
            elif n:
                yield first + i, ngrams(hashes[word_end[i] - n : word_end[i]], np.array([n]), int(n))[0]
            else:
                yield first + i, np.empty(0, np.uint64)


def _node(shingles: np.ndarray) -> int:
    """One number for a set: equal sets are one node of the join."""
    return int(mix(np.array([np.add.reduce(mix(shingles, 3)) + np.uint64(len(shingles))], np.uint64))[0].astype(np.int64))


def _profile(texts: DataFrame) -> DataFrame:
    """Rows of documents (id, n, node), and rows (token, seen) of what was frequent where it was read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        size, nodes = 0, set()

        def frequent() -> pa.RecordBatch:
            token, seen = np.unique(np.concatenate([np.empty(0, np.uint64), *waiting]), return_counts=True)
            keep = seen >= LOCALLY_FREQUENT
            none = pa.nulls(int(keep.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.array(token[keep].astype(np.int64)), pa.array(seen[keep])], names=names)

        names = ["id", "n", "node", "token", "seen"]
        for batch in batches:
            ids = batch.column(0)
            n, node = [], []
            for _, shingles in shingle_sets(batch.column(1).to_pylist()):
                n.append(len(shingles))
                node.append(_node(shingles) if len(shingles) else None)
                if len(shingles) and node[-1] not in nodes:
                    nodes.add(node[-1])
                    waiting.append(shingles)
                    size += len(shingles)
                if size >= COUNTED:
                    yield frequent()
                    waiting, size, nodes = [], 0, set()
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(node, pa.int64()), none, none], names=names)
        yield frequent()

    return texts.mapInArrow(run, "id long, n long, node long, token long, seen long")


class Orders:
    """The global orders, as sort keys of shingles: frequent ones last, by powers of two of their counts."""

    def __init__(self, tokens: np.ndarray, levels: np.ndarray):
        self.tokens, self.levels = tokens, levels

    @classmethod
    def of(cls, profile: DataFrame) -> Orders:
        """The most frequent ``FREQUENT`` of those reported, of which the driver gets no more than that."""
        counts = stage(profile.where(F.col("token").isNotNull()).groupBy("token").agg(F.floor(F.log2(F.sum("seen"))).cast("int").alias("level")))
        least, total = 0, 0
        for row in counts.groupBy("level").count().orderBy(F.desc("level")).collect():
            total += row["count"]
            if total > FREQUENT:
                least = row["level"] + 1
                break
        rows = counts.where(F.col("level") >= least).toPandas().sort_values("token")
        return cls(rows["token"].to_numpy(np.int64).astype(np.uint64), rows["level"].to_numpy(np.int64)).sorted()

    def sorted(self) -> Orders:
        order = np.argsort(self.tokens)
        self.tokens, self.levels = self.tokens[order], self.levels[order]
        return self

    def level(self, shingles: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(shingles), np.int64)
        at = np.minimum(np.searchsorted(self.tokens, shingles), len(self.tokens) - 1)
        return np.where(self.tokens[at] == shingles, self.levels[at], 0)

    def key(self, shingles: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
        return (levels.astype(np.uint64) << np.uint64(58)) | (mix(shingles, 11 + order) >> np.uint64(6))

    def prefix(self, shingles: np.ndarray, levels: np.ndarray, order: int) -> np.ndarray:
        """Positions of the first shingles of a set: as many as may be missing from a similar set, and one; or ``OTHER_PREFIX``."""
        n = len(shingles)
        size = -(-OTHER_PREFIX * n // 100) if order else n - -(-PERCENT * n // 100) + 1
        return np.argpartition(self.key(shingles, levels, order), size - 1)[:size] if size < n else np.arange(n)

    def long_prefix(self, shingles: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the first ``LONG_PREFIX`` of a set under the first order, its prefix at least, and which are of the prefix."""
        n = len(shingles)
        size = n - -(-PERCENT * n // 100) + 1
        longer = max(size, -(-LONG_PREFIX * n // 100))
        at = np.argpartition(self.key(shingles, levels, 0), sorted({size - 1, longer - 1}))[:longer]
        return at, np.arange(longer) < size


def _postings(texts: DataFrame, orders) -> DataFrame:
    """(node, n, list, token, first) for the first order: the list a document is on, the shingle where it has several lists, and whether it is of the prefix.

    A task names the lists of equal sets once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, nodes = orders.value, set()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows: list[list[np.ndarray]] = [[], [], [], [], []]
                for _, shingles in shingle_sets(batch.column(0).slice(start, 256).to_pylist()):
                    if not len(shingles) or (node := _node(shingles)) in nodes:
                        continue
                    nodes.add(node)
                    levels = own.level(shingles)
                    at, first = own.long_prefix(shingles, levels)
                    token = shingles[at]
                    lists = np.maximum(1, (2 ** levels[at]) // LIST_ROWS).astype(np.uint64)
                    many = lists > 1
                    salted = np.where(many, mix(token, 5) + mix(np.uint64(node & (2**64 - 1)) % lists, 6), token)
                    for part, values in zip(rows, (np.full(len(at), node), np.full(len(at), len(shingles)), salted.astype(np.int64), np.where(many, token.astype(np.int64), 0), first)):
                        part.append(values)
                if rows[0]:
                    node, n, list_, token, first = (np.concatenate(part) for part in rows)
                    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n.astype(np.int32)), pa.array(list_), pa.array(token, mask=token == 0), pa.array(first)], names=["node", "n", "list", "token", "first"])
                if len(nodes) > 1_000_000:
                    nodes.clear()

    return texts.mapInArrow(run, "node long, n int, list long, token long, first boolean")


def _band(n: Column) -> Column:
    """Sizes in bands of a factor 1.25: similar ones are at most one band apart."""
    return F.floor(F.log(n) / F.log(F.lit(100 / PERCENT)))


def _lists(texts: DataFrame, orders) -> DataFrame:
    """(node, n, list, token): the lists of documents that may be similar to another one of these texts.

    Similar sets have at least ``PERCENT`` of the larger in common, so their long
    prefixes share what these have more than the rest of a set. A document of
    which fewer are on a list with another of its size has no similar one. Where
    a shingle has several lists, others are taken to hold it.
    """
    near = Window.partitionBy("list").orderBy("band").rangeBetween(-1, 1)
    rows = _postings(texts, orders).withColumn("band", _band(F.col("n")))
    rows = rows.select("node", "n", "list", "token", "first", F.min("node").over(near).alias("low"), F.max("node").over(near).alias("high"))
    shared = stage(rows.where(F.col("token").isNotNull() | (F.col("low") != F.col("high"))).drop("low", "high"))
    least = F.ceil((LONG_PREFIX - 100 + PERCENT) * F.col("n") / 100 - F.lit(1e-6))
    enough = shared.groupBy("node", "n").agg(F.count("*").alias("held")).where(F.col("held") >= least)
    return shared.where("first").drop("first").join(enough.select("node"), "node", "left_semi").select("node", "n", "list", "token")


def _led(postings: DataFrame, leader: Column) -> DataFrame:
    """(node, n, to, to_n, list, token): each document with the leaders of its size and of the next smaller one on its lists.

    Similar ones are in one band of sizes or in neighbouring ones, and have a
    leader in common. A leader is kept with itself where a shingle has several
    lists.
    """
    by_size = Window.partitionBy("list").orderBy("band")
    led = postings.withColumn("band", _band(F.col("n"))).select("node", "n", "list", "token", F.min(leader).over(by_size.rangeBetween(0, 0)).alias("own"), F.min(leader).over(by_size.rangeBetween(-1, -1)).alias("lower"))
    led = led.where((F.col("own.node") != F.col("node")) | F.col("lower").isNotNull() | F.col("token").isNotNull())
    led = led.withColumn("leader", F.explode(F.array_compact(F.array("own", "lower"))))
    led = led.select("node", "n", F.col("leader.node").alias("to"), F.col("leader.n").alias("to_n"), "token")
    return led.where((F.col("node") != F.col("to")) | F.col("token").isNotNull()).distinct()


def _star(led: DataFrame) -> DataFrame:
    """(node, n, to, to_n, across): documents with their leaders, and the leaders of one shingle's lists with the first of them."""
    led = stage(led)  # read twice, and much smaller than the lists
    pair = ["node", "n", "to", "to_n"]
    leaders = led.where(F.col("token").isNotNull()).select(F.col("to").alias("node"), F.col("to_n").alias("n"), F.col("token").alias("list"), F.lit(None).cast("long").alias("token")).distinct()
    across = _led(leaders, F.struct("node", "n")).select(*pair, F.lit(True).alias("across"))
    pairs = led.select(*pair, F.lit(False).alias("across")).where(F.col("node") != F.col("to")).unionByName(across)
    return pairs.groupBy(*pair).agg(F.max("across").alias("across"))


def bitmap(shingles: np.ndarray) -> np.ndarray:
    """Bits of these shingles in a power of two of 64-bit words; folding its halves gives the bitmap of half the words."""
    words = 1 << max(0, (BITS_PER_SHINGLE * len(shingles) - 1) // 64).bit_length()
    out = np.zeros(words, np.uint64)
    mixed = mix(shingles, 17)
    np.bitwise_or.at(out, (mixed >> np.uint64(6)) & np.uint64(words - 1), np.uint64(1) << (mixed & np.uint64(63)))
    return out


def _candidates(texts: DataFrame, orders) -> DataFrame:
    """(node, text, and a bitmap for each of ``FILTERS``) from (node, text) of candidates."""
    names = [f"bits{i}" for i in range(len(FILTERS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = orders.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                wanted = part.column(0).to_pylist()
                keep, found = [], [[] for _ in names]
                for i, shingles in shingle_sets(part.column(1).to_pylist()):
                    if len(shingles) and _node(shingles) == wanted[i]:
                        keep.append(i)
                        levels = own.level(shingles)
                        for values, (order, percent) in zip(found, FILTERS):
                            values.append(bitmap(shingles if percent == 100 else shingles[own.prefix(shingles, levels, order)]).view(np.int64))
                kept = part.take(pa.array(keep, pa.int32()))
                yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1), *[pa.array(v, pa.list_(pa.int64())) for v in found]], names=["node", "text", *names])

    return texts.mapInArrow(run, "node long, text string, " + ", ".join(f"{n} array<long>" for n in names))


def _only_in(a: Column, b: Column) -> Column:
    """Bits of one bitmap that are not in the other, at the words of the smaller: so many shingles at least are in the first alone."""
    words = F.least(F.size(a), F.size(b))

    def folded(x: Column) -> Column:
        return F.when(F.size(x) > words, F.transform(F.slice(x, F.lit(1), words), lambda v, i: v.bitwiseOR(F.get(x, i + words)))).otherwise(x)

    alone = F.zip_with(folded(a), folded(b), lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y))))
    return F.aggregate(alone, F.lit(0), lambda total, x: total + x)


def _shared(percent: int, n: Column, m: Column) -> Column:
    """Least number of shingles that sets of these sizes share at a similarity."""
    return F.ceil(F.lit(float(percent)) * (n + m) / F.lit(100.0 + percent) - F.lit(1e-6))


def _similar_sizes(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT


def _judged(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(node, to, near, link) of the pairs (node, n, to, to_n), each given once.

    Sets that share s shingles share at least s less what their prefixes leave
    out of either of them under each order, and s of their whole sets. A bit in
    one bitmap and not in the other proves that a shingle is missing. Where a pair
    shares less than sets of ``FAR_PERCENT`` would, it isn't near; where less
    than similar ones would, it isn't compared. What is left is compared by the
    whole texts.
    """
    n, m = F.col("n"), F.col("to_n")
    near, close = _shared(FAR_PERCENT, n, m) <= F.least(n, m), _similar_sizes(n, m)
    sized = pairs.select("node", "to", "n", "to_n", near.alias("near"), close.alias("close"))
    bits = [f"bits{i}" for i in range(len(FILTERS))]
    a, b = held.select("node", F.struct(*bits).alias("a")), held.select(F.col("node").alias("to"), F.struct(*bits).alias("b"))
    both = sized.where("near or close").join(a, "node").join(b, "to")
    near, close = F.col("near"), F.col("close")
    for name, (_, percent) in zip(bits, FILTERS):
        size = [F.ceil(F.lit(percent / 100) * x) for x in (n, m)]
        one, other = F.col(f"a.{name}"), F.col(f"b.{name}")
        common = F.least(size[0] - _only_in(one, other), size[1] - _only_in(other, one))
        spare = common - F.least(size[0] - n, size[1] - m)
        near = near & (spare >= _shared(FAR_PERCENT, n, m))
        close = close & (spare >= _shared(PERCENT, n, m))
    filtered = stage(both.select("node", "to", near.alias("near"), close.alias("close")))
    filtered = filtered.unionByName(sized.where("not (near or close)").select("node", "to", "near", "close"))
    wanted = filtered.where("close").select("node", "to")
    whole = wanted.join(held.select("node", F.col("text").alias("a")), "node").join(held.select(F.col("node").alias("to"), F.col("text").alias("b")), "to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, leader = None, np.empty(0, np.uint64)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                tos, bs = part.column(1).to_pylist(), part.column(3)
                keep = []
                for i, mine in shingle_sets(part.column(2).to_pylist()):
                    if tos[i] != last:
                        last, (_, leader) = tos[i], next(shingle_sets([bs[i].as_py()]))
                    shared = len(np.intersect1d(mine, leader, assume_unique=True))
                    if 100 * shared >= PERCENT * (len(mine) + len(leader) - shared):
                        keep.append(i)
                if keep:
                    kept = part.take(pa.array(keep, pa.int32()))
                    yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["node", "to"])

    links = whole.select("node", "to", "a", "b").mapInArrow(run, "node long, to long").distinct().withColumn("link", F.lit(True))
    judged = stage(filtered.join(links, ["node", "to"], "left").select("node", "to", "near", F.coalesce("link", F.lit(False)).alias("link")))
    collect_garbage(pairs.sparkSession)
    return judged


def _open(pairs: DataFrame, judged: DataFrame, roots: DataFrame) -> DataFrame:
    """Nodes that may be similar to one of another component on a list of theirs.

    Of a leader that isn't joined with somebody: those without a link to it, if
    they are several; all, if one that isn't joined is near it. For a shingle
    with several lists, all of them, if anybody isn't joined.
    """
    known = judged.where(~F.col("link")).join(roots.select("node", F.col("root").alias("a")), "node", "left")
    known = known.join(roots.select(F.col("node").alias("to"), F.col("root").alias("b")), "to", "left")
    loose = stage(known.select("node", "to", "near", (F.coalesce("a", "node") != F.coalesce("b", "to")).alias("apart")))
    apart = loose.where("apart").select("node", "to", "near")
    leaders = stage(loose.groupBy("to").agg(F.count("*").alias("n"), F.max("apart").alias("apart"), F.max(F.col("near") & F.col("apart")).alias("near")).where("apart"))
    far = loose.join(leaders.where((F.col("n") > 1) & ~F.col("near")).select("to"), "to", "left_semi").select("node")
    whole = leaders.where("near").select("to")
    across = pairs.where("across").select("node", "to")
    if not across.isEmpty():
        ends = across.select(F.explode(F.array("node", "to")).alias("node")).distinct()
        split = stage(apart.select(F.explode(F.array("node", "to")).alias("node")).distinct().join(ends, "node", "left_semi"))
        tops = stage(across.join(split, "node", "left_semi").select("to").unionByName(split.select(F.col("node").alias("to"))).distinct())
        lists = across.join(tops, "to", "left_semi").select(F.col("node").alias("to")).unionByName(tops)
        whole = whole.unionByName(lists)
    whole = stage(whole.distinct())
    members = pairs.select("node", "to").join(whole, "to", "left_semi").select("node").unionByName(whole.select(F.col("to").alias("node")))
    return far.unionByName(members).distinct()


def _tiles(lists: DataFrame, held: DataFrame) -> DataFrame:
    """(node, tile, band): documents of similar sizes that share their longest list, dealt out by a hash to tiles of about ``TILE``."""
    home = lists.groupBy("node").agg(F.max(F.struct("members", "token")).getField("token").alias("home"), F.first("n").alias("n"))
    weighed = home.join(held.select("node", F.octet_length("text").alias("bytes")), "node")
    weighed = weighed.select("node", "home", _band(F.col("n")).alias("band"), (F.col("n") + F.col("bytes") / 8).alias("weight"))
    many = weighed.groupBy("home", "band").agg(F.ceil(F.sum("weight") / TILE).alias("tiles"))
    return weighed.join(many, ["home", "band"]).select("node", F.xxhash64("home", "band", F.pmod(F.xxhash64("node"), "tiles")).alias("tile"), "band")


class _Postings:
    """Which of some documents hold a shingle."""

    def __init__(self, sets: list[np.ndarray]):
        shingles = np.concatenate([np.empty(0, np.uint64), *sets])
        order = np.argsort(shingles, kind="stable")
        self.shingles = shingles[order]
        self.holder = np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order]
        self.documents = len(sets)

    def counts(self, shingles: np.ndarray) -> np.ndarray:
        """How many of these shingles each document holds."""
        first = np.searchsorted(self.shingles, shingles, "left")
        n = np.searchsorted(self.shingles, shingles, "right") - first
        at = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
        return np.bincount(self.holder[at], minlength=self.documents)


def _tile_links(orders, group: pa.Table) -> pa.Table:
    """Links between the documents of two tiles (or of one), of different roots.

    Pairs must share a prefix shingle under the first order, and as many as
    similar sets would under each of the others; the whole sets of what is left
    are compared.
    """
    own, texts = orders.value, group["text"].to_pylist()
    tile, node, root = (group[c].to_numpy() for c in ("tile", "node", "root"))
    sets = [x for _, x in shingle_sets(texts)]
    sizes = np.array([len(x) for x in sets])
    levels = [own.level(x) for x in sets]
    prefixes = [[x[own.prefix(x, v, k)] for x, v in zip(sets, levels)] for k in (0, *OTHER_ORDERS)]
    alone = tile.min() == tile.max()
    left = np.arange(len(sets)) if alone else np.flatnonzero(tile == tile.min())
    right = left if alone else np.flatnonzero(tile != tile.min())
    tables = [_Postings([p[j] for j in right]) for p in prefixes]
    whole, m = _Postings([sets[j] for j in right]), sizes[right]
    lacking = [np.array([len(p[j]) for j in right]) - m for p in prefixes]
    found: list[tuple[int, int]] = []
    for i in left:
        n = sizes[i]
        going = (root[right] != root[i]) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
        if alone:
            going &= right > i
        shared = -(-PERCENT * (n + m) // (100 + PERCENT))
        for prefix, table, lack in zip(prefixes, tables, lacking):
            if going.any():
                least = np.maximum(1, shared + np.minimum(len(prefix[i]) - n, lack))
                going &= table.counts(prefix[i]) >= least
        if going.any():
            both = whole.counts(sets[i])
            for j in np.flatnonzero(going & (100 * both >= PERCENT * (n + m - both))):
                found.append((int(node[i]), int(node[right[j]])))
    return pa.table({"node": pa.array([a for a, _ in found], pa.int64()), "to": pa.array([b for _, b in found], pa.int64())})


def _links_without_leaders(lists: DataFrame, held: DataFrame, orders) -> DataFrame:
    """(node, to) of the links between documents of different roots that have a list in common; lists are (token, node, n, root).

    Tiles are paired, not documents: a list gives the pairs of its tiles in
    neighbouring bands of sizes, each pair once over all lists. A document goes
    to the groups of those tiles with which it has a list in common itself, and a
    group holds at most two tiles.
    """
    several = lists.groupBy("token").agg(F.count("*").alias("members"), (F.min("root") != F.max("root")).alias("apart")).where("apart")
    lists = stage(lists.join(several.select("token", "members"), "token"))
    tiles = stage(_tiles(lists, held))
    listed = stage(lists.select("token", "node", "root").join(tiles, "node"))
    on = listed.groupBy("token", "tile", "band").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    other = on.select("token", *[F.col(c).alias(f"other_{c}") for c in ("tile", "band", "low", "high")])
    met = on.join(other, "token").where((F.abs(F.col("band") - F.col("other_band")) <= 1) & ((F.col("low") != F.col("other_high")) | (F.col("high") != F.col("other_low"))))
    met = stage(met.select("token", "tile", F.least("tile", "other_tile").alias("x"), F.greatest("tile", "other_tile").alias("y")))
    told = stage(listed.join(met, ["token", "tile"]).select("x", "y", "tile", "node", "root").distinct())
    dealt = told.join(held.select("node", "text"), "node")
    return dealt.groupBy("x", "y").applyInArrow(lambda group: _tile_links(orders, group), "node long, to long").distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_shingles and component_id of every row.

    Words are runs of characters other than ASCII white space, A-Z lower-cased.
    Two documents link when their sets' similarity is at least ``PERCENT`` in a
    hundred; a component is all that links lead to, and its id the smallest id
    in it. A null or empty text has no shingles and links with nothing; its
    component is itself. Rows are kept as they are, repeated ids too (each of
    its texts links on its own). A row with a null id is linked with nothing and
    has a null component. Other columns are not read.

    Equal sets are one node. Every link between different sets either is found
    or joins two nodes that other links have joined; each text is compared
    whole.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"))
    profile = stage(_profile(texts))
    orders = spark.sparkContext.broadcast(Orders.of(profile))
    rows = profile.where(F.col("token").isNull()).select("id", "n", "node")
    nodes = stage(rows.where(F.col("id").isNotNull() & F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("id"), F.max("n").cast("int").alias("n")))

    found = _star(_led(_lists(texts.where(F.col("id").isNotNull()).select("text"), orders), F.struct("node", "n")))
    pairs = stage(found)
    ends = pairs.select("node").unionByName(pairs.select(F.col("to").alias("node"))).distinct()
    wanted = stage(nodes.join(ends, "node", "left_semi").select("id", "node"))
    listed = bloom_level(wanted.select(F.col("id").alias("key")), 0, wanted.count(), FILTER_BITS)
    held = stage(_candidates(texts.where(listed.contains(F.col("id"))).join(wanted, "id").select("node", "text"), orders))
    judged = _judged(pairs, held)
    links = judged.where("link").select("node", "to")
    roots = _roots(links)

    # Lists that aren't joined yet: once more with the leader that has most links, which
    # tells the text that others are copies of, then without leaders.
    for leaders in (True, False):
        left = stage(_open(pairs, judged, roots))
        collect_garbage(spark)
        if left.isEmpty():
            break
        still = _lists(held.join(left, "node", "left_semi").select("text"), orders)
        if leaders:
            degree = links.select("node").unionByName(links.select(F.col("to").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))
            known = still.join(degree, "node", "left").withColumn("degree", -F.coalesce("degree", F.lit(0)))
            pairs = stage(_star(_led(known, F.struct("degree", "node", "n"))))
        else:
            lists = still.select(F.coalesce("token", "list").alias("token"), "node", "n").distinct().join(roots, "node", "left")
            found = stage(_links_without_leaders(lists.withColumn("root", F.coalesce("root", "node")), held, orders))
            roots = _roots(found, roots)
            break
        judged = _judged(pairs, held)
        links = links.unionByName(judged.where("link").select("node", "to"))
        roots = _roots(judged.where("link").select("node", "to"), roots)

    named = nodes.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"))
    labels = named.join(smallest, "root").select("node", "component_id")
    out = rows.join(labels, "node", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"))


def _roots(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Roots under these links and those that made the known roots."""
    if known is not None:
        links = links.unionByName(known.select("node", F.col("root").alias("to")))
    return components(links.select(F.col("node").alias("u"), F.col("to").alias("v")))
