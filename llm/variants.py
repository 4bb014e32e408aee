"""Grouping of spelling variants by generation over a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols, so that words become reduced words over a small alphabet.  For each word the full one-edit neighbourhood of its
reduced word (itself, deletions, replacements, insertions: ``(2 * SYMBOLS + 1)`` a letter at most) is generated and joined with the reduced vocabulary: words that
are one edit apart have reduced words at most one edit apart, so that none is missed.  Pairs that meet are verified on the original strings.

Only hashes of reduced words and of words travel through that join; the strings are attached to the pairs that met, each pair once.  Neighbours' hashes
come from sums before and after each place, so that a very long word costs its length, not its square.

A word's form is its near word of largest count, if that is at least ``FACTOR`` times its own; its root is found by doubling the steps towards
the last form.  Counts grow along forms, so chains end.

Defined results: null texts have no words; a null doc_id counts as empty text where it is hashed; rows of equal doc_id count each; an empty table
gives no rows.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import store

SYMBOLS, MIN_LETTERS, MIN_COUNT, FACTOR, DIVISOR = 8, 6, 5, 5, 199
RUN = "[A-Za-z\\u00C0-\\u00FF]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BASE = 0x9E3779B97F4A7C15


def vocabulary(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, divisor: int | None = DIVISOR) -> DataFrame:
    """word, n: letter runs, A-Z lower-cased.  With ``divisor``, runs whose crc32 with their document's id it divides lose one letter first."""
    text = F.coalesce("text", F.lit(""))
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lowered, F.lit(RUN), F.lit(0))).alias("word"))
    runs = runs.filter(F.length("word") >= min_letters)
    if divisor is not None:
        h = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
        at = (h % F.length("word")).cast("int")
        runs = runs.withColumn("word", F.when(h % divisor == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.length("word")))).otherwise(F.col("word")))
        runs = runs.filter(F.length("word") >= min_letters)
    return runs.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def reduced(words: list[str], symbols: int) -> np.ndarray:
    """Words of one length as rows of symbols 1 to ``symbols``, by a hash of each letter."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)
    return ((points + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03) >> np.uint64(33)) % np.uint64(symbols) + np.uint64(1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _key(sums: np.ndarray, length: int) -> np.ndarray:
    """The length keeps words apart that differ in it only."""
    return _mix(sums + np.uint64(length * 0x94D049BB133111EB % (1 << 64)))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, _BASE, np.uint64))))


def own_keys(own: np.ndarray) -> np.ndarray:
    """Hash of each reduced word, a row of ``own``: the sum of symbols times powers."""
    n = own.shape[1]
    return _key((own * _powers(n)[:n]).sum(axis=1), n)


def neighbourhoods(own: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each reduced word and of all reduced words one edit away, each hash once a row."""
    m, n = own.shape
    power, inverse = _powers(n), np.uint64(pow(_BASE, -1, 1 << 64))
    parts = own * power[:n]
    head = np.zeros((m, n + 1), np.uint64)  # head[:, i]: what stands before place i
    head[:, 1:] = np.cumsum(parts, axis=1)
    whole = head[:, -1:]
    tail = whole - head  # what stands from place i on
    letters = np.arange(1, symbols + 1, dtype=np.uint64)
    around = [_key(whole, n), _key(head[:, :n] + tail[:, 1:] * inverse, n - 1)]
    for letter in letters:
        around.append(_key(whole - parts + letter * power[:n], n))
        around.append(_key(head + tail * np.uint64(_BASE) + letter * power, n + 1))
    every = np.sort(np.concatenate(around, axis=1), axis=1)
    first = np.ones(every.shape, bool)
    first[:, 1:] = every[:, 1:] != every[:, :-1]
    return np.nonzero(first)[0], every[first]


def reduced_keys(words: DataFrame, symbols: int = SYMBOLS, neighbours: bool = False) -> DataFrame:
    """key, id: hash of the reduced word, or of every member of its neighbourhood, and hash of the word."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = batch.column("word").to_pylist(), batch.column("id").to_numpy()
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            for n in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == n)
                step = max(1, 300_000 // ((2 * symbols + 1) * (n + 1)))
                for a in range(0, len(at), step):
                    some = at[a : a + step]
                    own = reduced([texts[i] for i in some.tolist()], symbols)
                    row, key = neighbourhoods(own, symbols) if neighbours else (np.arange(len(some)), own_keys(own))
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[some][row])], ["key", "id"])

    return words.select("word", F.xxhash64("word").alias("id")).mapInArrow(keys, "key long, id long")


def near_words(words: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """word, n, near, near_n: each word with each word exactly one edit away, in both directions."""
    around = reduced_keys(words, symbols, neighbours=True)
    met = around.join(reduced_keys(words, symbols).withColumnRenamed("id", "near_id"), "key").filter("id != near_id").select("id", "near_id").distinct()
    own = words.select(F.xxhash64("word").alias("id"), "word", "n")
    other = words.select(F.xxhash64("word").alias("near_id"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    pairs = met.join(own, "id").join(other, "near_id")
    return pairs.filter(F.levenshtein("word", "near", 1) == 1).select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """forms: word, form.  word, root: the last word that forms lead to.  Each round doubles the steps."""
    now = store(forms.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = store(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variant-roots")
        if now.filter("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group(words: DataFrame, factor: int = FACTOR, symbols: int = SYMBOLS) -> DataFrame:
    """words: word, n.  word, n, n_near, form, form_n, root."""
    words = store(words.select("word", "n"), "variant-words")
    best = near_words(words, symbols).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    best = words.join(best, "word", "left").withColumn("found", F.col("best.less").isNotNull() & (-F.col("best.less") >= factor * F.col("n")))
    best = store(best.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("found"), F.col("best.near")).alias("form"), F.when(F.col("found"), -F.col("best.less")).alias("form_n")), "variant-forms")
    root = roots(best.filter("form is not null"))
    return best.join(root, "word", "left").withColumn("root", F.coalesce("root", "word"))
