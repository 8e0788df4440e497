"""Toxicity by multiple-instance learning: a document is toxic if one of its sentences is.

A sentence's probability is a logistic model over hashed byte windows of its
words; a document's is the noisy-or of its sentences and of one leak that every
document has, 1 - (1 - leak) * prod(1 - p). A sentence that has none of the
windows the model uses, or hardly any sign, counts 0, so that a text doesn't
become toxic by its length. Only documents are labelled. The gradient of the document's likelihood goes to each
sentence in proportion to how much it explains the label, so the model also
locates the offending sentences.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from cadastra.llm.arrow import map_rows
from cadastra.llm.hashing import mix
from cadastra.llm.resampling import labelled_sample
from cadastra.session import stage

BUCKETS = 1 << 20
#: Bytes of the windows that are features, the space before and after a word among them.
WINDOWS = (5, 7)
#: Labelled rows of each class, and the longest text, that the model is fitted on.
LABELLED_ROWS = 3000
LABELLED_CHARS = 20_000
EPOCHS = 8
RATE = 0.3
START_BIAS = -5.0
#: A sentence less likely than this adds nothing to a document's score.
NEGLIGIBLE = 0.02
#: A bucket is used if it occurs in so many documents of label 1, and its share among them is so many standard errors above.
SCREEN_DOCS = 4
SCREEN_SPREADS = 4.0
#: A sentence longer than this many bytes is scored in parts, so that one without ends stays small.
SENTENCE_BYTES = 2000


@lru_cache(maxsize=1)
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Bytes after folding (anything but letters, digits and bytes of other scripts is a space), and which end a sentence."""
    fold = np.full(256, 32, np.uint8)
    keep = [b for b in range(256) if b >= 128 or chr(b).isalnum()]
    fold[keep] = keep
    ends = np.zeros(256, bool)
    ends[[ord(c) for c in ".!?\n"]] = True
    return fold, ends


def sentences(raw: bytes) -> list[tuple[int, int]]:
    """Byte spans that cover the text: up to an end mark followed by white space or the text's end, or a line end.

    A span longer than ``SENTENCE_BYTES`` is cut at spaces.
    """
    if not raw:
        return []
    data = np.frombuffer(raw, np.uint8)
    _, ends = _kinds()
    after = np.append(data[1:], 32)
    stop = np.flatnonzero(ends[data] & ((data == 10) | (after <= 32))) + 1
    stops = np.append(stop[stop < len(data)], len(data)).tolist()
    out, start = [], 0
    for end in stops:
        while end - start > SENTENCE_BYTES:
            cut = raw.rfind(b" ", start + 1, start + SENTENCE_BYTES)
            if cut < 0:
                cut = start + SENTENCE_BYTES
            out.append((start, cut))
            start = cut
        out.append((start, end))
        start = end
    return out


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all sentences of a text, and where each sentence's begin.

    Folding keeps the length, so that sentence spans hold in it; lower-casing
    before it does not: ``original_spans`` leads back.
    """
    raw = text.encode()
    spans = sentences(raw)
    fold, _ = _kinds()
    folded = np.concatenate(([32], fold[np.frombuffer(raw, np.uint8)], np.full(max(WINDOWS), 32))).astype(np.uint64)
    bases = np.uint64(257)
    pieces, owner = [], []
    sentence = np.repeat(np.arange(len(spans)), [b - a for a, b in spans])
    size = len(raw)
    for n in WINDOWS:
        value = np.full(size, n, np.uint64)
        for i in range(n):
            value = value * bases + folded[i : i + size]
        full = (folded[1 : size + 1] != 32) | (folded[:size] != 32)
        pieces.append((mix(value[full]) & np.uint64(BUCKETS - 1)).astype(np.int64))
        owner.append(sentence[full])
    bucket, own = np.concatenate(pieces), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return bucket[order], np.searchsorted(own[order], np.arange(len(spans)))


def _bag(text: str, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The used buckets that each sentence has, once each, the sentence of each of them, and the number of sentences."""
    if not text:
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    bucket, starts = _features(text)
    owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(bucket))))
    keep = used[bucket]
    pair = np.unique(owner[keep] * BUCKETS + bucket[keep])
    return pair % BUCKETS, pair // BUCKETS, len(starts)


def original_spans(text: str, lowered: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character spans of ``text`` for byte spans of ``lowered``, its lower-cased form, in ascending order."""
    heads = np.concatenate(([0], np.cumsum((np.frombuffer(lowered.encode(), np.uint8) & 0xC0) != 0x80)))  # characters begun before a byte
    out = [(int(heads[a]), int(heads[b])) for a, b in spans]
    if len(lowered) != len(text):  # a few letters have two characters in lower case
        ends = np.cumsum([len(c.lower()) for c in text])
        out = [(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "right"))) for a, b in out]
    return out


def sentence_scores(text: str, weights: np.ndarray, bias: float, used: np.ndarray) -> np.ndarray:
    """Probability of each sentence of a lower-cased text; 0 without a window of ``used``, which marks the weights that aren't 0."""
    bucket, owner, size = _bag(text, used)
    p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, weights[bucket], minlength=size) + bias, -30, 30)))
    return np.where((np.bincount(owner, minlength=size) > 0) & (p >= NEGLIGIBLE), p, 0.0)


def noisy_or(scores: np.ndarray, leak: float = 0.0) -> float:
    """Never quite 1, and for a text without sentences the leak."""
    return float(-np.expm1(np.log1p(-leak) + np.log1p(-np.minimum(scores, 1 - 1e-12)).sum()))


def _screen(texts: list[str], labels: np.ndarray) -> np.ndarray:
    """Buckets that occur in clearly more documents of label 1 than of label 0; others would be learnt by heart."""
    seen = np.zeros((2, BUCKETS))
    for text, label in zip(texts, labels):
        if text:
            seen[label, np.unique(_features(text)[0])] += 1
    rows = np.maximum(np.bincount(labels, minlength=2), 1)
    share = seen / rows[:, None]
    both = seen.sum(axis=0) / rows.sum()
    spread = np.sqrt(np.maximum(both * (1 - both), 1e-12) * (1 / rows).sum())
    return (seen[1] >= SCREEN_DOCS) & (share[1] - share[0] > SCREEN_SPREADS * spread)


def fit(texts: list[str], labels: list[int], seed: int = 3) -> tuple[np.ndarray, float, float]:
    """Weights, bias and leak after ``EPOCHS`` passes of AdaGrad over the documents.

    Only sentences with a window in use are instances; the leak is one more
    instance of every document, which has a bias alone.
    """
    label = np.asarray(labels)
    used = _screen(texts, label)
    weights, squares = np.zeros(BUCKETS), np.ones(BUCKETS)
    bias, bias_squares = np.full(2, START_BIAS), np.ones(2)  # of sentences, of the leak
    bags = []
    for text in texts:
        bucket, owner, _ = _bag(text, used)
        bags.append((bucket, np.unique(owner, return_inverse=True)[1]))
    order = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in order.permutation(len(bags)):
            bucket, owner = bags[i]
            size = int(owner[-1]) + 1 if len(owner) else 0
            z = np.append(np.bincount(owner, weights[bucket], minlength=size) + bias[0], bias[1])
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            whole = max(noisy_or(p), 1e-9)
            slope = -p * (1 - whole) / whole if label[i] else p
            each = slope[owner]
            np.add.at(squares, bucket, each**2)
            np.add.at(weights, bucket, -RATE * each / np.sqrt(squares[bucket]))
            both = np.array([slope[:size].sum(), slope[size]])
            bias_squares += both**2
            bias -= RATE * both / np.sqrt(bias_squares)
    return weights, float(bias[0]), float(1 / (1 + np.exp(-bias[1])))


def fit_on(sample: DataFrame) -> tuple[np.ndarray, float, float]:
    """Model of (text, label), fitted in one task: the sample is bounded, and so are the weights that come back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat([pd.DataFrame({"id": [], "label": [], "text": []}), *batches])
        rows = rows.sort_values(["id", "text"])  # the order of the rows is part of the model
        if rows.label.nunique() < 2:
            weights, bias, leak = np.zeros(1), -30.0, 0.0 if not len(rows) or rows.label.max() == 0 else 0.5
        else:
            weights, bias, leak = fit([t.lower() for t in rows.text.fillna("")], rows.label.astype(int).tolist())
        yield pd.DataFrame({"weights": [weights.astype(np.float32).tobytes()], "bias": [bias], "leak": [leak]})

    found = sample.repartition(1).mapInPandas(run, "weights binary, bias double, leak double").first()
    if found is None:
        return np.zeros(BUCKETS), -30.0, 0.0
    weights = np.frombuffer(bytes(found["weights"]), np.float32).astype(np.float64)
    return (weights if len(weights) == BUCKETS else np.zeros(BUCKETS)), found["bias"], found["leak"]


def held_out(id_: Column) -> Column:
    """Whether a row's label must not be learnt from: a quarter of all ids."""
    return F.coalesce(F.crc32(id_.cast("string")) % 4 == 2, F.lit(False))


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3,
    labelled_rows: int = LABELLED_ROWS,
) -> DataFrame:
    """``id_col``, held_out, score, predicted and offending of every row.

    ``offending`` has the sentences (text, start, probability) at or above
    ``threshold``, in order, as the document writes them, with the character
    they start at. The model is fitted on at most ``labelled_rows``
    labelled rows of each class that aren't held out, chosen by a seeded hash,
    those of them whose text has at most ``LABELLED_CHARS`` characters; it reads
    nothing but the text; of a labelled id with several texts it learns from the
    smallest. Every text is scored whole, and a null or empty one has the leak's
    score. Rows are kept as they are, repeated and null ids too; without labels of
    both classes all scores are alike. Other columns are not read.
    """
    usable = labels.where(~held_out(F.col(id_col)))
    sample = labelled_sample(usable, id_col, label_col, labelled_rows)
    texts = docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text"))
    short = texts.where(F.length("text") <= LABELLED_CHARS)
    known = short.join(F.broadcast(sample), "id").groupBy("id", "label").agg(F.min("text").alias("text"))  # at most two times labelled_rows
    model = docs.sparkSession.sparkContext.broadcast(fit_on(stage(known)))
    sentence = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.LongType()), T.StructField("probability", T.DoubleType())])
    schema = T.StructType([docs.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("offending", T.ArrayType(sentence))])
    named = texts.withColumnRenamed("id", id_col)

    def make():
        own_weights, own_bias, leak = model.value
        used = own_weights != 0

        def rows(chunk):
            out = {id_col: chunk[id_col], "score": [], "offending": []}
            for text in chunk["text"]:
                text = text or ""
                lowered = text.lower()
                p = sentence_scores(lowered, own_weights, own_bias, used)
                out["score"].append(round(noisy_or(p, leak), 9))
                hits = np.flatnonzero(p >= threshold)
                spans = sentences(lowered.encode()) if len(hits) else []
                places = original_spans(text, lowered, [spans[i] for i in hits])
                out["offending"].append([{"text": text[a:b], "start": a, "probability": float(p[i])} for i, (a, b) in zip(hits, places)])
            return out

        return rows

    scored = map_rows(named, [id_col, "text"], make, schema)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")
