"""Quality by a factorisation machine.

A document is a sparse vector: hashed words (share of the text, square-rooted), structure statistics, and size metadata.
score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum (v_if x_i)^2]): all pairwise interactions by rank-``RANK`` factors, in time
linear in the entries.  Trained by Adam on at most ``TRAIN_ROWS`` labelled documents; vectors are made by Spark tasks, and have at
most ``DIM`` word entries each, so that what the driver gathers is bounded whatever the corpus.

Defined results: a null text counts as empty; empty texts are scored from their statistics; without labelled rows the score is 0.5 for
every row; repeated rows get equal scores; null ids are not held out.  Columns besides doc_id, text and the labels' are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.features import training_rows

DIM, RANK, TRAIN_ROWS, EPOCHS, STEPS, THRESHOLD = 1 << 13, 8, 6000, 12, 600, 0.3
_SYMBOLS = b"#$%&*|<>{}=~^\\_@+/"
_CLASSES = np.zeros((256, 6), np.float64)  # upper, lower or beyond ASCII, digit, stop or comma, symbol, white space
_CLASSES[65:91, 0] = _CLASSES[97:123, 1] = _CLASSES[128:, 1] = _CLASSES[48:58, 2] = 1
_CLASSES[list(b".,;:!?'\"()-"), 3] = 1
_CLASSES[list(_SYMBOLS), 4] = 1
_CLASSES[list(b" \t\n\r\x0b\x0c"), 5] = 1
N_STATS = 20


def stats(text: str, words: list[str], counts: Counter) -> list[float]:
    """Structure statistics and size metadata, each about 0 to 1."""
    raw = np.frombuffer(text.encode(), np.uint8)
    of_byte = np.bincount(raw, minlength=256)
    n, w = max(1, len(raw)), max(1, len(words))
    upper, lower, digit, stop, symbol, space = (of_byte @ _CLASSES).tolist()
    shares = of_byte[of_byte > 0] / n
    lines = [x for x in text.split("\n") if x]
    pairs = Counter(zip(words, words[1:]))
    return [
        np.log1p(len(text)) / 12, np.log1p(len(words)) / 10, min(1.0, len(text) / w / 20), len(counts) / w, max(counts.values(), default=0) / w,
        upper / max(1.0, upper + lower), digit / n, stop / n, symbol / n, space / n, of_byte[33] / w, of_byte[124] / w,
        sum(a == b for a, b in zip(words, words[1:])) / w, len(pairs) / w, max(pairs.values(), default=0) / w,
        -float((shares * np.log2(shares)).sum()) / 8, 1 - len(set(lines)) / max(1, len(lines)), min(1.0, len(lines) / w), sum(len(x) <= 2 for x in words) / w,
        float(not words),
    ]


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values: words first, statistics from DIM on."""
    text = text or ""
    words = text.split()
    counts = Counter(words)
    own: Counter = Counter()
    for word, k in counts.items():
        own[crc32(word.lower().encode()) % DIM] += k
    values = np.sqrt(np.fromiter(own.values(), np.float64, len(own)) / max(1, len(words)))
    columns = np.fromiter(own.keys(), np.int64, len(own))
    return np.concatenate([columns, DIM + np.arange(N_STATS)]), np.concatenate([values, stats(text, words, counts)])


@dataclass
class Model:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, columns: np.ndarray, values: np.ndarray) -> float:
        part = self.factors[columns] * values[:, None]
        return float(self.bias + self.linear[columns] @ values + 0.5 * ((part.sum(axis=0) ** 2).sum() - (part**2).sum()))

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(*vector(text)), -30, 30))))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.02) -> Model:
    """rows: columns, values, label."""
    random = np.random.default_rng(7)
    size = DIM + N_STATS
    positive = sum(y for *_, y in rows)
    theta = np.zeros((size, 1 + RANK))
    if 0 < positive < len(rows):
        theta[:, 1:] = random.normal(0, 0.01, (size, RANK))
        epochs = max(epochs, -(-STEPS // -(-len(rows) // batch)))  # few rows take more rounds
    bias = float(np.log((positive + 1) / (len(rows) - positive + 1))) if rows else 0.0
    decay = np.concatenate([np.full((DIM, 1), 1e-4), np.full((N_STATS, 1), 1e-6)])
    m, v, mb, vb, step = np.zeros_like(theta), np.zeros_like(theta), 0.0, 0.0, 0
    for epoch in range(epochs if 0 < positive < len(rows) else 0):
        now = rate * (1 - epoch / epochs)
        order = random.permutation(len(rows))
        for at in range(0, len(rows), batch):
            chosen = [rows[i] for i in order[at : at + batch]]
            sizes = np.array([len(c) for c, *_ in chosen])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            columns, x = np.concatenate([c for c, *_ in chosen]), np.concatenate([u for _, u, _ in chosen])[:, None]
            y = np.array([y for *_, y in chosen])
            own = theta[columns]
            part = own[:, 1:] * x
            sums = np.add.reduceat(part, starts, axis=0)
            z = bias + np.add.reduceat(own[:, 0] * x[:, 0], starts) + 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((part**2).sum(axis=1), starts))
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(chosen)
            each = np.repeat(error, sizes)[:, None]
            slope = np.concatenate([each * x, each * x * (np.repeat(sums, sizes, axis=0) - part)], axis=1)
            touched, where = np.unique(columns, return_inverse=True)
            by_row = np.argsort(where, kind="stable")
            grad = np.add.reduceat(slope[by_row], np.concatenate([[0], np.cumsum(np.bincount(where))[:-1]]), axis=0)
            grad += decay[touched] * theta[touched]
            step += 1
            m[touched] = 0.9 * m[touched] + 0.1 * grad
            v[touched] = 0.99 * v[touched] + 0.01 * grad**2
            theta[touched] -= now * (m[touched] / (1 - 0.9**step)) / (np.sqrt(v[touched] / (1 - 0.99**step)) + 1e-8)
            mb, vb = 0.9 * mb + 0.1 * error.sum(), 0.99 * vb + 0.01 * error.sum() ** 2
            bias -= now * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    return Model(float(bias), theta[:, 0].copy(), theta[:, 1:].copy())


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """From at most ``rows`` labelled documents outside the held-out fifth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [vector(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c, _ in vectors], pa.binary()), pa.array([x.tobytes() for _, x in vectors], pa.binary()), batch.column("label"), batch.column("doc_id")], ["columns", "x", "label", "doc_id"])

    chosen = training_rows(docs, labels, "quality", 5, 0, rows).select("text", "label", "doc_id")
    got = chosen.mapInArrow(run, "columns binary, x binary, label int, doc_id long").toPandas()
    got = got.sort_values(["doc_id", "x"])  # the order of files doesn't matter
    return fit([(np.frombuffer(c, np.int64), np.frombuffer(x, np.float64), y) for c, x, y in zip(got["columns"], got["x"], got["label"], strict=True)])


def scorer(spark: SparkSession, model: Model):
    """Function of a text column that gives its score."""
    held = spark.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.score(t) for t in texts], dtype="float64")

    return scored


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """The whole rows that score ``threshold`` or more."""
    scored = scorer(docs.sparkSession, train(docs, labels, rows))
    return docs.filter(scored(F.col("text")) >= threshold)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    score = scorer(docs.sparkSession, train(docs, labels, rows))(F.col("text"))
    return docs.withColumn("score", score).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
