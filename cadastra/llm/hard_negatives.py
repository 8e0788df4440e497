"""Hard negatives by exact integer inner products, several candidates in one multiplication.

Components are integers. Those of the candidates and of the anchors are biased so
that none is negative, and the same component of several candidates is put into
separate fields of one wide integer (Kronecker packing). One multiplication for
each component of an anchor then adds to all fields at once; a field is wide
enough for the largest sum, so nothing carries over, and the scores come out by
shifts, less what the biases added. The integers are held in doubles as long as
all fields fit into 53 bits, where sums of products are exact and matrix products
fast, else in Python's integers of any width.

Anchors meet all rows in blocks: a task has one block of either and nothing else.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cadastra.session import stage

#: Rows of the table, and anchors among them, that one task compares.
BLOCK_ROWS = 4096
BLOCK_ANCHORS = 4096
#: Anchors whose scores with a block are in memory at once.
SCORED_ANCHORS = 256
#: Bits that a double adds and multiplies exactly.
EXACT_BITS = 53
#: Fields of one of Python's integers.
WIDE_FIELDS = 16

LEAST, MOST = -(1 << 63) + 1, (1 << 63) - 1
NONE = np.iinfo(np.int64).min


def pack_fields(rows: np.ndarray, fields: int, width: int) -> np.ndarray:
    """(-(-n // fields), d): of ``fields`` rows of integers under 2**width each, one row of integers; missing rows are 0."""
    n, d = rows.shape
    full = np.zeros((-(-n // fields) * fields, d), rows.dtype)
    full[:n] = rows
    parts = full.reshape(-1, fields, d)
    packed = parts[:, 0].copy()
    for j in range(1, fields):
        packed = packed + parts[:, j] * (1 << (width * j))
    return packed


def exact_scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products (anchors x rows) of vectors of integers, given as doubles, exact; beyond 64 bits the nearest integer that has them."""
    if not anchors.size or not rows.size:
        return np.zeros((len(anchors), len(rows)), np.int64)
    d = anchors.shape[1]
    a_bias, c_bias = int(np.abs(anchors).max()), int(np.abs(rows).max())
    width = max(1, (4 * d * a_bias * c_bias).bit_length())
    if width <= EXACT_BITS:
        fields = EXACT_BITS // width
        total = (anchors + a_bias) @ pack_fields(rows + c_bias, fields, width).T
        total = total.astype(np.int64)
        mask: int = (1 << width) - 1
        scores = np.stack([(total >> (width * j)) & mask for j in range(fields)], axis=2)
        sums = [x.astype(np.int64).sum(axis=1) for x in (anchors, rows)]
    else:
        whole = [np.array([[int(x) for x in row] for row in part], object) for part in (anchors, rows)]
        packed = pack_fields(whole[1] + c_bias, WIDE_FIELDS, width)
        total = (whole[0] + a_bias) @ packed.T
        mask = (1 << width) - 1
        scores = np.stack([(total >> (width * j)) & mask for j in range(WIDE_FIELDS)], axis=2)
        sums = [x.sum(axis=1) for x in whole]
    scores = scores.reshape(len(anchors), -1)[:, : len(rows)]
    scores = scores - c_bias * sums[0][:, None] - a_bias * sums[1][None, :] - d * a_bias * c_bias
    return scores if scores.dtype == np.int64 else np.clip(scores, LEAST, MOST).astype(np.int64)


def best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of the ``k`` largest scores of every row but ``NONE``; of equal ones the first. Changes ``scores``."""
    i, found = np.arange(len(scores)), []
    for _ in range(min(k, scores.shape[1])):
        j = scores.argmax(axis=1)
        kept = scores[i, j] != NONE
        found.append((i[kept], j[kept], scores[i, j][kept]))
        scores[i, j] = NONE
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class _Side:
    """The columns of one block as arrays."""

    def __init__(self, table: pa.Table, size: int):
        self.n = table.num_rows
        self.row, self.id = (table.column(c).to_numpy() for c in ("row", "id"))
        self.label = np.array(table.column("label").to_pylist(), object)
        self.v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(self.n, size)

    def take(self, at: np.ndarray) -> None:
        for name in ("row", "id", "label", "v"):
            setattr(self, name, getattr(self, name)[at])


def _block(table: pa.Table, size: int) -> _Side:
    side = _Side(table, size)
    side.take(np.lexsort((side.row, side.id)))  # of equal scores, the first is the one with the smallest id
    return side


def hard_negatives(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", anchor_step: int = 50, positives: int = 5, negatives: int = 3,
    least_percent: int = 50, most_percent: int = 95, scale: float = 256.0, block_rows: int = BLOCK_ROWS, block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score.

    A component x becomes floor(``scale`` * x); a row's score is its integer inner
    product with the anchor. Anchors are the rows whose id is divisible by
    ``anchor_step``. An anchor's positives are the ``positives`` best other rows
    of its label; for each of them the ``negatives`` best rows of other labels
    are returned whose score is from ``least_percent`` to ``most_percent`` of the
    positive's. Higher scores come first, ties by smaller id, then by place in
    the table. Scores are exact; one beyond a long counts as the largest or
    smallest long.

    Rows with a null id or label, a null vector, or a null or non-finite
    component take no part. Vectors of different lengths have no product; each
    length is a table of its own. A repeated id is another row, as anchor,
    positive and negative. An anchor without positives, and a positive without
    rows in its range, give no rows. Rows are dealt over blocks by a hash of
    their place, so no label, id or vector makes a block larger.
    """
    anchor = F.col("id") % anchor_step == 0
    used = rows.select(rows[f"`{id_col}`"].cast("long").alias("id"), rows[f"`{label_col}`"].cast("string").alias("label"), rows[f"`{vector_col}`"].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    used = used.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)
    used = stage(used.withColumn("row", F.monotonically_increasing_id()))
    sizes = used.agg(F.count("*").alias("rows"), F.count_if(anchor).alias("anchors")).first()
    blocks, parts = max(1, -(-sizes["rows"] // block_rows)), max(1, -(-sizes["anchors"] // block_anchors))

    keys = ["size", "block", "part"]
    dealt = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sized = used.withColumn("size", F.size("v"))
    dealt_rows = sized.withColumn("block", dealt(blocks, 1)).withColumn("part", every(parts))
    anchors = sized.where(anchor).withColumn("part", dealt(parts, 2))
    dealt_anchors = anchors.withColumn("block", every(blocks))

    def nearest(key: tuple, asked: pa.Table, table: pa.Table) -> pa.Table:
        """The best rows of the anchors' own labels."""
        out = []
        if asked.num_rows and table.num_rows:
            mine, other = _Side(asked, key[0].as_py()), _block(table, key[0].as_py())
            for label in set(mine.label):
                wanted, cols = np.flatnonzero(mine.label == label), np.flatnonzero(other.label == label)
                for start in range(0, len(wanted), SCORED_ANCHORS):
                    at = wanted[start : start + SCORED_ANCHORS]
                    scores = exact_scores(np.floor(scale * mine.v[at]), np.floor(scale * other.v[cols]))
                    own = mine.row[at][:, None] == other.row[cols][None, :]
                    scores[own] = NONE
                    i, j = best(scores.copy(), positives)
                    out.append((mine.row[at][i], other.row[cols][j], other.id[cols][j], scores[i, j]))
        found = [np.concatenate([np.empty(0, np.int64), *column]) for column in (zip(*out) if out else [()] * 4)]
        return pa.table(dict(zip(("anchor", "row", "id", "score"), found)))

    near = dealt_anchors.groupBy(*keys).cogroup(dealt_rows.groupBy(*keys)).applyInArrow(nearest, "anchor long, row long, id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id", "row")
    asks = stage(near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score"))).alias("p")))
    asked = stage(anchors.join(asks.withColumnRenamed("anchor", "row"), "row").select("row", "id", "label", "v", "size", "part", F.col("p.n").alias("ns"), F.col("p.id").alias("ids"), F.col("p.score").alias("scores")))

    names = ["anchor", "anchor_id", "n", "positive_id", "positive_score", "row", "negative_id", "negative_score"]

    def between(key: tuple, asked: pa.Table, table: pa.Table) -> pa.Table:
        """The best rows of other labels in the range of each positive."""
        out = []
        if asked.num_rows and table.num_rows:
            mine, other = _Side(asked, key[0].as_py()), _block(table, key[0].as_py())
            ids, given = asked.column("ids").to_pylist(), asked.column("scores").to_pylist()
            quantised = np.floor(scale * other.v)
            for start in range(0, mine.n, SCORED_ANCHORS):
                at = np.arange(start, min(start + SCORED_ANCHORS, mine.n))
                scores = exact_scores(np.floor(scale * mine.v[at]), quantised)
                scores[mine.label[at][:, None] == other.label[None, :]] = NONE
                for n in range(positives):
                    have = [i for i in range(len(at)) if len(given[at[i]]) > n]
                    if not have:
                        break
                    positive = [given[at[i]][n] for i in have]
                    low = np.array([-(-least_percent * s // 100) for s in positive], object).clip(LEAST, MOST).astype(np.int64)
                    high = np.array([most_percent * s // 100 for s in positive], object).clip(LEAST, MOST).astype(np.int64)
                    some = scores[have]
                    some[(some < low[:, None]) | (some > high[:, None])] = NONE
                    i, j = best(some, negatives)
                    anchor_at = at[np.array(have)[i]]
                    who = [ids[x][n] for x in anchor_at]
                    out.append((mine.row[anchor_at], mine.id[anchor_at], np.full(len(i), n), np.array(who, np.int64), np.array(positive, np.int64)[i], other.row[j], other.id[j], scores[np.array(have)[i], j]))
        found = [np.concatenate([np.empty(0, np.int64), *column]).astype(np.int64) for column in (zip(*out) if out else [()] * len(names))]
        return pa.table(dict(zip(names, found)))

    ranges = asked.withColumn("block", every(blocks)).groupBy(*keys).cogroup(dealt_rows.groupBy(*keys)).applyInArrow(between, ", ".join(f"{n} long" for n in names))
    rank = F.row_number().over(Window.partitionBy("anchor", "n").orderBy(F.desc("negative_score"), "negative_id", "row"))
    found = ranges.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
