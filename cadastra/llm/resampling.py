"""Quality by importance resampling: documents are drawn by how much likelier target text makes them than raw text.

Two bags of hashed word n-grams are estimated, one from target rows (labelled
good), one from all documents. A document's log weight is the sum, over its
n-grams, of the log of the ratio of both models. Adding Gumbel noise to the log
weights and taking the k largest draws k documents without replacement in
proportion to their weights.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from cadastra.llm.arrow import map_rows
from cadastra.llm.hashing import WORDS_AND_MARKS, blocks, ngrams, word_hashes
from cadastra.session import stage

BUCKETS = 1 << 14
#: Labelled rows of each class that the target model and the cut are fitted on.
LABELLED_ROWS = 10_000


def features(raws: list[bytes], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words, marks and pairs of both of some texts, and the number of each text's.

    All pairs of a word with itself are one n-gram, so that repetition is learnt
    from every word that is repeated.
    """
    hashes, counts = word_hashes(raws, WORDS_AND_MARKS)
    pairs, pair_counts = ngrams(hashes, counts, 2)
    text = np.repeat(np.arange(len(raws)), counts)
    pairs[(hashes[1:] == hashes[:-1])[text[1:] == text[:-1]]] = 1
    text = np.concatenate((np.repeat(np.arange(len(raws)), counts), np.repeat(np.arange(len(raws)), pair_counts)))
    bucket = (np.concatenate((hashes, pairs)) & np.uint64(buckets - 1)).astype(np.int64)
    order = np.argsort(text, kind="stable")
    return bucket[order], counts + pair_counts


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, rows: int, seed: int = 5) -> DataFrame:
    """(id, label) of at most ``rows`` labelled ids of each class, the first by a seeded hash; an id labelled twice counts once, as the larger."""
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    draw = [one.where(F.col("label") == k).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(rows) for k in (0, 1)]
    return draw[0].unionByName(draw[1])


def _counted(docs: DataFrame, buckets: int) -> DataFrame:
    """(label, bucket, n) over all documents: a task adds up its own, and tasks meet by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, buckets), np.int64)  # all documents, and those labelled good
        for batch in batches:
            texts, good = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, raws in blocks(texts):
                bucket, counts = features(raws, buckets)
                total[0] += np.bincount(bucket, minlength=buckets)
                mine = np.repeat([good[first + i] == 1 for i in range(len(raws))], counts)
                total[1] += np.bincount(bucket[mine], minlength=buckets)
        target, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(target.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[target, at])], names=["target", "bucket", "n"])

    parts = docs.select("text", "label").mapInArrow(run, "target int, bucket int, n long")
    return parts.groupBy("target", "bucket").agg(F.sum("n").alias("n"))


def fit_ratio(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of the target's and the raw model for each bucket, from (text, label).

    The two models are tables of ``buckets`` counts whatever the corpus holds;
    they come to the driver as such. Counts are smoothed by one.
    """
    counts = np.ones((2, buckets))
    for row in _counted(docs, buckets).toLocalIterator():
        counts[row["target"], row["bucket"]] += row["n"]
    model = np.log(counts / counts.sum(axis=1, keepdims=True))
    return model[1] - model[0]


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(id, log_weight, n_features) of every row of (id, text); an empty text weighs 0."""
    table = docs.sparkSession.sparkContext.broadcast(ratio)
    schema = T.StructType([docs.schema["id"], T.StructField("log_weight", T.DoubleType()), T.StructField("n_features", T.LongType())])

    def make():
        own = table.value

        def rows(chunk):
            weight, size = [], []
            for _, raws in blocks(chunk["text"]):
                bucket, counts = features(raws, len(own))
                sums = np.concatenate(([0.0], np.cumsum(own[bucket])))
                ends = np.cumsum(counts)
                weight.append(np.round(sums[ends] - sums[ends - counts], 6))
                size.append(counts)
            return {"id": chunk["id"], "log_weight": np.concatenate(weight), "n_features": np.concatenate(size)}

        return rows

    return map_rows(docs, ["id", "text"], make, schema)


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut on the weight with the fewest labelled rows on the wrong side, in the middle of the gap it lies in."""
    if not len(weights) or good.all():
        return -np.inf
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    wrong = np.concatenate(([0], np.cumsum(g))) + (~g).sum() - np.concatenate(([0], np.cumsum(~g)))
    real = np.concatenate(([True], w[1:] > w[:-1], [True]))  # equal weights fall on one side
    at = int(np.argmin(np.where(real, wrong, len(w) + 1)))
    return -np.inf if at == 0 else np.inf if at == len(w) else float((w[at - 1] + w[at]) / 2)


def _order(value: float) -> int:
    """A number whose order is the order of doubles."""
    bits = struct.unpack("<q", struct.pack("<d", value))[0]
    return bits if bits >= 0 else -1 - (bits & (2**63 - 1))


def top_k(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Rows with the ``k`` largest keys (doubles); rows equal to the last one come along.

    The range of keys that holds the k-th is narrowed by counts of at most 4096
    parts of it, so no task sorts or gathers the rows.
    """
    ends = rows.agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(key).alias("n")).first()
    if k <= 0:
        return rows.where(F.lit(False))
    if k >= ends["n"]:
        return rows
    low, high, left = ends["low"], ends["high"], k
    while low < high:
        width = (high - low) / 4096
        if width == 0 or low + width == low:
            break
        part = F.least(F.lit(4095), F.floor((F.col(key) - F.lit(low)) / F.lit(width)))
        inside = rows.where(F.col(key).between(low, high)).groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min(key).alias("a"), F.max(key).alias("b"))
        for row in inside.orderBy(F.desc("part")).collect():
            if row["n"] >= left:
                break
            left -= row["n"]
        if (row["a"], row["b"]) == (low, high):
            break
        low, high = row["a"], row["b"]
        if row["n"] == left:
            high = low
    return rows.where(F.col(key) >= F.lit(low))


def resample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", k: int | None = None,
    labelled_rows: int = LABELLED_ROWS, seed: int = 11,
) -> DataFrame:
    """``id_col``, log_weight and key (log weight plus Gumbel noise) of the documents drawn.

    ``k`` is the number to draw. Without it, it is the number of documents that
    weigh more than the cut which best parts the labelled rows: as many as look
    like target text. The target model and the cut are fitted on at most
    ``labelled_rows`` labelled rows of each class, chosen by a seeded hash; the
    raw model, the weights and the draw cover all documents.

    A null or empty text has no n-grams and weighs 0. The noise is a hash of the
    seed and the id, so reruns agree, and repeated rows of an id are drawn
    together; rows with the key of the last one drawn come along. A null id has
    noise of its own. Without labelled rows, or without bad ones, all documents
    are drawn. Other columns are not read.
    """
    sample = stage(labelled_sample(labels, id_col, label_col, labelled_rows))
    texts = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    marked = texts.join(F.broadcast(sample), "id", "left")  # at most two times labelled_rows
    ratio = fit_ratio(marked)
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 12).cast("double") + 0.5) / F.lit(2.0**52)
    weighed = stage(log_weights(texts, ratio).withColumn("key", F.col("log_weight") - F.log(-F.log(uniform))))
    if k is None:
        rows = weighed.join(F.broadcast(sample), "id").select("log_weight", "label").toPandas()
        cut = best_cut(rows["log_weight"].to_numpy(float), rows["label"].to_numpy() == 1)
        k = weighed.where(F.col("log_weight") > F.lit(float(cut))).count()
    return top_k(weighed, "key", k).select(F.col("id").alias(id_col), "log_weight", "key")
