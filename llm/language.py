"""Language by nearest centroids of TF-IDF character n-grams.

A text's letters, lower-cased, with each run of anything else as one blank, give n-grams of one to three characters, hashed to ``DIM`` columns.
Term frequencies are dampened by square root, weighted by inverse document frequency and scaled to length one.  Each
language has up to ``CENTROIDS`` spherical k-means centroids; a text gets the language of the nearest by cosine.  A text further from it
than ``SLACK`` times the distance that holds ``QUANTILE`` of the centroid's own training texts is marked as rejected (of a language not learned).

Trained on at most ``TRAIN_ROWS`` documents of each language; their vectors are made by Spark tasks.  Defined results: ``und`` with score 0 for null texts,
texts without a letter, and all texts where nothing could be learned; repeated rows get equal results; null ids are not held
out.  Columns besides doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DIM, CENTROIDS, TRAIN_ROWS, ROUNDS, QUANTILE, SLACK, HEAT, SALTS = 1 << 12, 4, 600, 12, 0.99, 1.25, 0.04, 16
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")  # numbers such as one half are word characters, but no letters
_OTHER = re.compile(r"[\W\d_]+")


def grams(text: str) -> np.ndarray:
    """Dampened counts of the hashed n-grams."""
    codes = np.frombuffer((" " + _OTHER.sub(" ", text.lower()).strip() + " ").encode("utf-32-le", "replace"), np.uint32)
    mixed = codes * np.uint32(2654435761)
    two = (mixed[:-1] ^ (mixed[:-1] >> np.uint32(15))) * np.uint32(2246822519) + mixed[1:]
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * np.uint32(3266489917) + mixed[2:]
    hashed = np.concatenate([mixed, two, three])
    hashed ^= hashed >> np.uint32(16)
    hashed *= np.uint32(2246822507)
    counts = np.bincount(hashed >> np.uint32(33 - DIM.bit_length()), minlength=DIM)
    return np.sqrt(counts, dtype=np.float32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # rows of length one
    owner: np.ndarray  # the language of each row
    radius: np.ndarray  # largest distance that is accepted

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        named, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [False] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None and self.languages and _LETTER.search(t)]
        for at in range(0, len(known), 64):
            chosen = known[at : at + 64]
            vectors = np.stack([grams(texts[i]) for i in chosen]) * self.idf
            vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
            cosine = vectors @ self.centroids.T
            best = cosine.argmax(axis=1)
            per_language = np.stack([cosine[:, self.owner == k].max(axis=1) for k in range(len(self.languages))], axis=1)
            odds = np.exp((per_language - per_language.max(axis=1, keepdims=True)) / HEAT)
            share = odds.max(axis=1) / odds.sum(axis=1)
            for row, i in enumerate(chosen):
                named[i], scores[i] = self.languages[self.owner[best[row]]], float(share[row])
                rejected[i] = bool(1 - cosine[row, best[row]] > self.radius[best[row]])
        return named, scores, rejected


def fit(rows: list[tuple[str, np.ndarray]]) -> Model:
    """rows: language, counts from ``grams``."""
    languages = sorted({x for x, _ in rows})
    if not languages:
        return Model([], np.ones(DIM, np.float32), np.zeros((0, DIM), np.float32), np.zeros(0, int), np.zeros(0))
    all_counts = np.stack([v for _, v in rows]).astype(np.float32)
    idf = (np.log((1 + len(rows)) / (1 + (all_counts > 0).sum(axis=0))) + 1).astype(np.float32)
    vectors = all_counts * idf
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    of = np.array([languages.index(x) for x, _ in rows])
    random = np.random.default_rng(11)
    centroids, owner, radius = [], [], []
    for k in range(len(languages)):
        own = vectors[of == k]
        middle = own[random.choice(len(own), min(CENTROIDS, len(own)), replace=False)]
        for _ in range(ROUNDS):
            near = (own @ middle.T).argmax(axis=1)
            sums = np.stack([own[near == c].sum(axis=0) if (near == c).any() else middle[c] for c in range(len(middle))])
            middle = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        far = 1 - (own @ middle.T)
        near = far.argmin(axis=1)
        for c in range(len(middle)):
            inside = far[near == c, c]
            centroids.append(middle[c])
            owner.append(k)
            radius.append(min(1.0, SLACK * float(np.quantile(inside, QUANTILE))) if len(inside) else 1.0)
    return Model(languages, idf, np.stack(centroids).astype(np.float32), np.array(owner), np.array(radius))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """From at most ``rows`` documents a language (of the smallest id hashes; of rows with equal id, the text of smallest hash) outside the held-out third."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [grams(t.as_py()).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(vectors, pa.binary()), batch.column("doc_id")], ["lang", "counts", "doc_id"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
    first = [F.xxhash64(F.lit("training"), "doc_id"), F.col("doc_id")]
    ids = own.select("lang", "doc_id").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    for keys in (["lang", "salt"], ["lang"]):  # a language of very many documents is reduced in several tasks first
        ids = ids.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*first))).filter(F.col("place") <= rows)
    chosen = own.join(F.broadcast(ids.select("lang", "doc_id").distinct()), ["lang", "doc_id"])  # at most ``rows`` ids a language
    chosen = chosen.groupBy("lang", "doc_id").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("row")).select("lang", "doc_id", "row.text")
    chosen = chosen.select("lang", "text", "doc_id").filter(F.col("text").rlike("\\p{L}"))
    got = chosen.mapInArrow(run, "lang string, counts binary, doc_id long").toPandas().sort_values(["doc_id", "counts"])
    return fit([(x, np.frombuffer(v, np.float32)) for x, v in zip(got.lang, got.counts, strict=True)])


def identify(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, scores, rejected = held.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(named, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows_in.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")
