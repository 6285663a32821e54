"""Quality classifier: naive Bayes support vectors.

A text's features are the hashed byte n-grams it contains, and whether it has word n-grams (2 to 4) of one and the same
word (indicators, not counts). Each n-gram is scaled by the log of
the ratio of its share in the two classes, then a linear model with hinge loss is fitted on the scaled indicators by dual
coordinate descent. The result is one weight per n-gram bucket: a fixed 2^18 floats however large the corpus is.

The model is fitted on a bounded sample of labelled rows, ``TRAIN_ROWS`` of them in the order of a seeded hash of doc_id
(the only bound in this module), in one task, which keeps the n-gram numbers of the sample in one array and nothing else
of it. Every document is scored, whole, in Arrow batches.

Labels of a doc_id that occurs more than once are averaged (0.5 and more counts as 1), and of its texts the least one is
learned from. Defined results: null or empty text has no n-gram and gets the model's bias as its score; a very long text
is read in pieces, whole; a null doc_id is not held out; without labelled rows of both classes every score is the share
of label 1 (0.5 without labels); repeated rows get equal scores; an empty table gives an empty one; columns named like
the results are replaced, other columns pass through, whatever they are called.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm._common import documents, free_names, own_columns, text_or_empty

BITS = 18
NGRAMS = (2, 4)
TRAIN_ROWS = 12_000
SEED = 29
SMOOTHING = 1.0
COST = 1.0
EPOCHS = 12
BLEND = 0.75
PIECE = 1 << 20
FLAGS = 3
_STEP = np.uint32(2654435761)


def _bucket(key: np.ndarray) -> np.ndarray:
    """Bucket numbers from FLAGS on; the first ones say that words are repeated."""
    return np.maximum(key >> np.uint32(32 - BITS), np.uint32(FLAGS))


def features(text: str | None) -> np.ndarray:
    """Sorted bucket numbers of the n-grams of the whole text."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    found = []
    for n in NGRAMS:
        # Pieces overlap by n - 1 bytes, so every n-gram of a very long text is seen and memory stays bounded.
        for at in range(0, max(0, len(data) - n + 1), PIECE):
            part = data[at : at + PIECE + n - 1].astype(np.uint32)
            key = np.full(len(part) - n + 1, n, np.uint32)
            for j in range(n):
                key = (key ^ part[j : len(part) - n + 1 + j]) * _STEP
                key ^= key >> np.uint32(15)
            seen = np.zeros(1 << BITS, bool) if len(key) > 50_000 else None
            if seen is None:
                found.append(np.unique(_bucket(key)))
            else:
                seen[_bucket(key)] = True
                found.append(np.flatnonzero(seen).astype(np.uint32))
    words = (text or "").split()
    alike = list(map(str.__eq__, words, words[1:]))
    runs = (True in alike, (True, True) in zip(alike, alike[1:], strict=False))
    runs += (runs[1] and (True, True, True) in zip(alike, alike[1:], alike[2:], strict=False),)
    found.append(np.array([n for n, seen in enumerate(runs) if seen], np.uint32))
    return np.unique(np.concatenate(found))


class Rows:
    """The n-gram numbers of many texts, one after another in one array that grows."""

    def __init__(self):
        self.numbers, self.spans = np.empty(1 << 16, np.uint32), []

    def append(self, x: np.ndarray) -> None:
        at = self.spans[-1][1] if self.spans else 0
        if at + len(x) > len(self.numbers):
            self.numbers.resize(at + len(x) + at // 4, refcheck=False)
        self.numbers[at : at + len(x)] = x
        self.spans.append((at, at + len(x)))

    def sort_by(self, keys: list[int]) -> list[int]:
        """Put the rows into ascending order of their keys; the order taken."""
        order = sorted(range(len(keys)), key=keys.__getitem__)
        self.spans = [self.spans[i] for i in order]
        return order

    def __len__(self) -> int:
        return len(self.spans)

    def __getitem__(self, i: int) -> np.ndarray:
        return self.numbers[slice(*self.spans[i])]


def log_count_ratios(rows: Rows, labels: np.ndarray) -> np.ndarray:
    """log of the n-gram's share among the indicators of class 1 over its share in class 0."""
    counts = np.full((2, 1 << BITS), SMOOTHING)
    for i, y in enumerate(labels.tolist()):
        counts[y, rows[i]] += 1  # a text has each number once
    share = counts / counts.sum(1, keepdims=True)
    return np.log(share[1] / share[0])


def dual_coordinate_descent(rows: Rows, labels: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model on rows of scaled indicators, each of length one.

    The scaled values of a row are taken anew whenever it is visited, so only its n-gram numbers are kept.
    """
    y = np.where(labels == 1, 1.0, -1.0)
    length = np.array([max(1e-9, float(np.sqrt(scale[rows[i]] @ scale[rows[i]]))) for i in range(len(rows))])
    w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            x = rows[i]
            v = scale[x] / length[i]
            gradient = y[i] * (w[x] @ v + bias) - 1.0
            moved = min(max(alpha[i] - gradient / 2.0, 0.0), COST)  # |x|^2 is 1, and 1 for the bias
            if moved != alpha[i]:
                step = (moved - alpha[i]) * y[i]
                w[x] += step * v
                bias += step
                alpha[i] = moved
    return w, bias


def fit(rows: Rows, labels: np.ndarray) -> bytes:
    """The model: 2^BITS scales, as many weights, then bias and slope of the score, as little-endian float32."""
    scale, w, tail = np.zeros(1 << BITS), np.zeros(1 << BITS), [0.0, 1.0]
    if len(labels) and 0 < labels.mean() < 1:
        scale = log_count_ratios(rows, labels)
        w, bias = dual_coordinate_descent(rows, labels, scale)
        w = BLEND * w + (1 - BLEND) * np.abs(w).mean() * np.sign(w)
        tail = [bias, 3.0]
    elif len(labels):
        tail = [30.0 if labels.mean() == 1 else -30.0, 1.0]
    return np.concatenate([scale, w, tail]).astype("<f4").tobytes()


def margins(texts: pd.Series, model: np.ndarray) -> np.ndarray:
    scale, w = model[: 1 << BITS], model[1 << BITS : 2 << BITS]
    product, square, (bias, slope) = scale * w, scale * scale, model[2 << BITS :]
    out = np.empty(len(texts))
    for i, text in enumerate(texts):
        x = features(text)
        out[i] = slope * (bias + float(product[x].sum()) / max(1e-6, float(np.sqrt(square[x].sum()))))
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> bytes:
    """Fit on at most ``rows`` labelled documents that are not held out, chosen by a seeded hash of doc_id."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sample = (
        known.groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(SEED), F.col("doc_id")), "doc_id")
        .limit(rows)
    )

    def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "label": b.label, "x": [features(t).tobytes() for t in b.text]})

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, labels = Rows(), [], []
        for b in batches:
            ids += b.column("doc_id").to_pylist()
            labels += b.column("label").to_pylist()
            for x in b.column("x"):
                held.append(np.frombuffer(x.as_buffer(), np.uint32))
        if ids:
            # Rows come in any order; the fit goes by doc_id, so that reruns agree.
            order = held.sort_by(ids)
            yield pa.RecordBatch.from_pydict({"model": [fit(held, np.array(labels)[order])]})

    # The sample has a fixed bound (TRAIN_ROWS ids and labels), so it may be broadcast at any size of the corpus.
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    once = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # copies go before the shuffle
    vectors = once.mapInPandas(featured, "doc_id long, label int, x binary")
    found = vectors.repartition(1).mapInArrow(fitted, "model binary").collect()
    return bytes(found[0].model) if found else fit(Rows(), np.empty(0, int))


def scorer(spark: SparkSession, model: bytes) -> Callable[[Column], Column]:
    """Column -> score between 0 and 1. The model has a fixed size (2 MB), so it is broadcast."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights = np.frombuffer(shared.value, "<f4").astype(np.float64)
        for batch in texts:
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(margins(batch, weights), -60, 60))))

    return score


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    score = scorer(docs.sparkSession, train(docs, labels))
    columns, (scored,) = own_columns(docs, "held_out", "score", "predicted"), free_names(docs, "scored")
    done = docs.select(*columns, score(F.col("text").cast("string")).alias(scored))
    return done.select(
        *columns,
        held_out(F.col("doc_id")).alias("held_out"),
        F.col(scored).alias("score"),
        (F.col(scored) >= 0.5).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns as they are."""
    score = scorer(docs.sparkSession, train(docs, labels))
    return docs.filter(score(F.col("text").cast("string")) >= threshold)


def crc_held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    scored = score_quality(documents(spark, sf_dir).select("doc_id", "text"), labels)
    return scored.select("doc_id", "held_out", "score", "predicted")
