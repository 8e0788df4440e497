"""Nearest neighbours by inner product with robust-pruned directed graphs, one for each shard.

Vectors get one more component, so that the largest inner product becomes the
smallest Euclidean distance. A shard's graph is built by inserting its vectors
in a random order: a greedy search from the entry point proposes neighbours, and
a candidate is kept as a neighbour only if no neighbour kept before is nearer to
it by the relaxed factor ``ALPHA``. Queries walk every shard with a beam, and
the shards' answers meet by score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cadastra.session import stage

DEGREE = 48
ALPHA = 1.2
BUILD_BEAM = 80
#: Vectors inserted or searched for at a time.
BATCH = 256
#: Different vectors a shard is laid out for.
SHARD_VECTORS = 4_000
#: Queries that search a shard in one task.
QUERY_ROWS = 20_000
#: Pairs whose scores are worked out at a time.
PAIRS = 4096


class Graph:
    """Directed graph over the rows of ``points``; every node is reached from ``entry``."""

    def __init__(self, points: np.ndarray, links: np.ndarray | None = None, seed: int = 1):
        self.points = points
        self.norms = np.einsum("ij,ij->i", points, points)
        self.entry = int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))
        if links is not None:
            self.links = links
            return
        n = len(points)
        self.links = np.full((n, DEGREE), -1, np.int32)
        order = np.random.default_rng(seed).permutation(n)
        order = np.concatenate(([self.entry], order[order != self.entry]))
        at, step = 1, 1
        while at < n:  # the first batches are small: what is inserted together can't find each other
            part = order[at : at + step]
            self._insert(part)
            at += len(part)
            step = min(BATCH, max(1, at // 4))

    def _distances(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Squared distance, up to each query's own norm; far away for the missing node -1."""
        dots = np.matmul(self.points[nodes], queries[:, :, None])[:, :, 0]
        return np.where(nodes < 0, np.inf, self.norms[nodes] - 2 * dots)

    def search(self, queries: np.ndarray, beam: int, visited: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best nodes found from the entry point, best first, -1 for none; with ``visited``, of all nodes scored."""
        q = len(queries)
        nodes = np.full((q, beam), -1, np.int32)
        nodes[:, 0] = self.entry
        far = np.full((q, beam), np.inf)
        far[:, :1] = self._distances(queries, nodes[:, :1])
        done = np.zeros((q, beam), bool)
        seen = np.zeros((q, len(self.points)), bool)
        seen[:, self.entry] = True
        log_nodes, log_far = [nodes[:, :1].copy()], [far[:, :1].copy()]
        active = np.arange(q)
        while len(active):
            open_ = ~done[active] & (nodes[active] >= 0)
            going = open_.any(axis=1)
            active = active[going]
            if not len(active):
                break
            pick = open_[going].argmax(axis=1)
            done[active, pick] = True
            near = self.links[nodes[active, pick]]
            fresh = (near >= 0) & ~seen[active[:, None], near]
            near = np.where(fresh, near, -1)
            rows, cols = np.nonzero(fresh)
            seen[active[rows], near[rows, cols]] = True
            d = self._distances(queries[active], near)
            all_nodes = np.concatenate((nodes[active], near), axis=1)
            all_far = np.concatenate((far[active], d), axis=1)
            all_done = np.concatenate((done[active], np.zeros(near.shape, bool)), axis=1)
            best = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            nodes[active] = np.take_along_axis(all_nodes, best, 1)
            far[active] = np.take_along_axis(all_far, best, 1)
            done[active] = np.take_along_axis(all_done, best, 1)
            if visited:
                wide_nodes, wide_far = np.full((q, DEGREE), -1, np.int32), np.full((q, DEGREE), np.inf)
                wide_nodes[active], wide_far[active] = near, d
                log_nodes.append(wide_nodes)
                log_far.append(wide_far)
        nodes = np.where(np.isinf(far), -1, nodes)
        if not visited:
            return nodes, far
        nodes, far = np.concatenate(log_nodes, axis=1), np.concatenate(log_far, axis=1)
        best = np.argsort(far, axis=1, kind="stable")[:, : 2 * beam]
        return np.take_along_axis(nodes, best, 1), np.take_along_axis(far, best, 1)

    def _prune(self, node: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """Robust pruning of each row of candidates: nearest first, and none that a kept one is nearer to by the factor."""
        p = self.points[node]
        own = self._distances(p, candidates) + self.norms[node][:, None]
        order = np.argsort(own, axis=1, kind="stable")
        candidates, own = np.take_along_axis(candidates, order, 1), np.take_along_axis(own, order, 1)
        alive = np.isfinite(own) & (candidates != node[:, None])
        alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
        vectors, norms = self.points[candidates], self.norms[candidates]
        kept = np.full((len(node), DEGREE), -1, np.int32)
        rows = np.arange(len(node))
        for i in range(DEGREE):
            some = alive.any(axis=1)
            if not some.any():
                break
            pick = alive.argmax(axis=1)
            chosen = candidates[rows, pick]
            kept[some, i] = chosen[some]
            between = norms + self.norms[chosen][:, None] - 2 * np.matmul(vectors, self.points[chosen][:, :, None])[:, :, 0]
            alive &= ALPHA**2 * between > own
            alive[rows, pick] = False
        return kept

    def _insert(self, part: np.ndarray) -> None:
        found, _ = self.search(self.points[part], BUILD_BEAM, visited=True)
        self.links[part] = self._prune(part, found)
        source, target = np.repeat(part, DEGREE), self.links[part].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, counts = np.unique(target, return_index=True, return_counts=True)
        free = (self.links[nodes] < 0).sum(axis=1)
        wide = np.full((len(nodes), DEGREE + int(counts.max(initial=0))), -1, np.int32)
        wide[:, :DEGREE] = self.links[nodes]
        place = np.arange(len(target)) - np.repeat(first, counts) + DEGREE
        wide[np.repeat(np.arange(len(nodes)), counts), place] = source
        fits = counts <= free
        if fits.any():
            packed = np.sort(wide[fits], axis=1)[:, ::-1][:, :DEGREE]
            self.links[nodes[fits]] = packed
        if (~fits).any():
            self.links[nodes[~fits]] = self._prune(nodes[~fits], wide[~fits])


def _usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and every component a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _extended(vectors: np.ndarray, largest: float) -> np.ndarray:
    """Vectors with the component that gives all of them the squared norm ``largest``.

    In double precision: near copies differ by less than what single precision
    leaves of the difference of two dot products.
    """
    rest = np.sqrt(np.maximum(largest - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.concatenate((vectors, rest[:, None]), axis=1)


def build_index(nodes: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each shard of the vectors of a length: its members' smallest ids, keys, vectors and links.

    ``nodes`` are different vectors (size, key, first, v); ``sizes`` has (size, shards, largest) of every length.
    """

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        own = np.stack(rows["v"].to_numpy()).astype(np.float64)
        graph = Graph(_extended(own, float(rows["largest"].iloc[0])), seed=int(key[1]) + 1)
        return pd.DataFrame(
            {"size": [key[0]], "shard": [key[1]], "largest": [rows["largest"].iloc[0]], "keys": [rows["key"].tolist()], "firsts": [rows["first"].tolist()],
             "vectors": [own.tobytes()], "links": [graph.links.tobytes()]}
        )

    dealt = nodes.join(sizes, "size").select("size", F.pmod(F.xxhash64("key"), F.col("shards")).cast("int").alias("shard"), "largest", "key", "first", "v")
    return dealt.groupBy("size", "shard").applyInPandas(build, "size int, shard int, largest double, keys array<string>, firsts array<long>, vectors binary, links binary")


def nearest(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, query_step: int = 20, beam: int = 100,
    shard_vectors: int = SHARD_VECTORS,
) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` nearest found of every query.

    Queries are the rows whose id is divisible by ``query_step``, candidates all
    other rows of the table; nearness is the inner product in double precision,
    ties go to the smaller id. Null, empty and zero vectors, those with a null
    or non-finite component and rows with a null id take no part. Vectors of
    different lengths have no inner product: each length is searched by itself.

    Equal vectors are one node of a graph, which stands for the ``k + 1``
    smallest ids among them: more can't be in an answer. Every vector is indexed;
    only the order of insertion is random (by a seeded hash). A shard, of about
    ``shard_vectors`` different vectors, is one task's work. A repeated id with
    one vector counts once.
    """
    vectors = rows.select(rows[f"`{id_col}`"].cast("long").alias("id"), rows[f"`{vector_col}`"].cast("array<double>").alias("v"))
    vectors = vectors.where(F.col("id").isNotNull() & _usable(F.col("v")))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    vectors = vectors.withColumn("size", F.size("v")).withColumn("key", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), " "), 256))

    # Ids of one vector: tasks drop all but the first few before anything is shuffled.
    by_vector = Window.partitionBy("key").orderBy("id")
    members = stage(vectors.select("key", "size", "v", "id").distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1))
    nodes = members.where(F.col("n") == 1).select("size", "key", F.col("id").alias("first"), "v")

    queries = vectors.where(F.col("id") % query_step == 0).select("size", "key", "v").distinct()
    asked = queries.groupBy("size").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.lit(QUERY_ROWS))).cast("int").alias("parts"))
    sizes = nodes.groupBy("size").agg(F.greatest(F.lit(1), F.round(F.count("*") / F.lit(shard_vectors))).cast("int").alias("shards"), F.max(square).alias("largest"))
    sizes = stage(sizes.join(asked, "size"))  # a length that nobody asks for needs no graph
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    graphs = stage(build_index(nodes, sizes)).join(sizes.select("size", "parts"), "size").withColumn("part", each("parts")).drop("parts")
    asked = queries.join(sizes, "size").select("size", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), each("shards").alias("shard"), "key", "v")
    schema = T.StructType([T.StructField("query", T.StringType()), T.StructField("found", T.StringType()), T.StructField("first", T.LongType()), T.StructField("score", T.DoubleType())])

    def search_shard(key: tuple, stored: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query": pd.Series(dtype=str), "found": pd.Series(dtype=str), "first": pd.Series(dtype=np.int64), "score": pd.Series(dtype=float)})]
        if len(stored) and len(wanted):
            names = np.array(stored["keys"][0], object)
            firsts = np.array(stored["firsts"][0], np.int64)
            own = np.frombuffer(stored["vectors"][0], np.float64).reshape(len(names), -1)
            graph = Graph(_extended(own, float(stored["largest"][0])), np.frombuffer(stored["links"][0], np.int32).reshape(len(names), DEGREE))
            for start in range(0, len(wanted), BATCH):
                part = wanted.iloc[start : start + BATCH]
                exact = np.stack(part["v"].to_numpy()).astype(np.float64)
                padded = np.concatenate((exact, np.zeros((len(exact), 1))), axis=1)
                found, _ = graph.search(padded, max(beam, k + 1))
                i, j = np.nonzero(found >= 0)
                hit = found[i, j]
                # One pair after another, so that equal vectors have equal scores wherever they are.
                scores = np.concatenate([(exact[i[a : a + PAIRS]] * own[hit[a : a + PAIRS]]).sum(axis=1) for a in range(0, len(i), PAIRS)])
                order = np.lexsort((firsts[hit], -scores, i))
                place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
                best = order[place <= k]
                out.append(pd.DataFrame({"query": part["key"].to_numpy()[i[best]], "found": names[hit[best]], "first": firsts[hit[best]], "score": scores[best]}))
        return pd.concat(out)

    found = graphs.groupBy("size", "shard", "part").cogroup(asked.groupBy("size", "shard", "part")).applyInPandas(search_shard, schema)
    # Of all shards, the k + 1 best vectors of a query: its own may be among them. Equal scores go by a vector's smallest id.
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first"))).where(F.col("n") <= k + 1)
    near = best.select("query", F.col("found").alias("key"), "score").join(members.select("key", "id"), "key").select("query", "id", "score")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    near = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    asks = vectors.where(F.col("id") % query_step == 0).select(F.col("id").alias("query_id"), F.col("key").alias("query")).distinct()
    answers = asks.join(stage(near), "query").where(F.col("id") != F.col("query_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return answers.select("query_id", rank.alias("rank"), F.col("id").alias("vec_id"), "score").where(F.col("rank") <= k)
