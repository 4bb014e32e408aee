"""Phrase collocations by prefix-free parsing.

A text is a sequence of words with a mark between its pieces.  Wherever the hash of ``OVERLAP`` consecutive words is 0 modulo ``TRIGGER`` a chunk ends with those
words and the next chunk begins with them, so that equal passages give equal chunks wherever they stand.  Distinct chunks with their
frequencies are the dictionary; phrases are counted inside it, weighted.  Chunks share ``OVERLAP`` = ``MAX_WORDS`` - 1 words: a phrase belongs to the chunk that holds
its first word before the shared end (the last chunk of a text owns its end too), so each occurrence is counted once.  Where no trigger comes for
``MAX_CHUNK`` words a chunk is cut there, which moves occurrences to another chunk and loses none.

Counting goes by length.  A phrase of k words is counted only where its first and last k - 1 words are frequent; these are told by a bit map of their hashes,
``LOAD`` bits a phrase, that is broadcast: 32 MB at most.  Where there are more than ``HELD`` frequent phrases, the count goes in as many passes over the dictionary
as keep each part's map below that, phrases dealt by the hash of their first k - 1 words.  The map only spares work, and phrases of one hash are told
apart by their words: counts are of exact texts.  A lang is part of every hash, chunk and phrase.

Defined results: null texts are empty; a null lang is ``und``; rows without or with equal doc_id count each; an empty table gives no rows.  Columns besides
text and lang are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import new_path, store
from llm.tokens import slices_of_text

MAX_WORDS, MIN_COUNT, TOP = 5, 100, 2000
TRIGGER, MAX_CHUNK = 48, 1024
LOAD, HELD = 32, 1 << 23
PENDING = 12 << 20  # bytes of chunks that a task counts together
SALTS = 16
MARK = b"."
_UPPER, _BREAKS = bytes(range(65, 91)), b".,;:!?\x0a\x0b\x0c\x0d"
_CHANGE = bytes.maketrans(_UPPER + _BREAKS + b"\t", _UPPER.lower() + MARK * len(_BREAKS) + b" ")
_MARKS, _BLANKS = re.compile(rb"\.[. ]*"), re.compile(rb"  +")
_STEP, _SEED = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)


def normal(text: str | None) -> bytes:
    """Words and marks separated by one blank; a mark stands only between words."""
    data = (text or "").encode().translate(_CHANGE)
    return _BLANKS.sub(b" ", _MARKS.sub(b" . ", data)).strip(b" .")


class Words:
    """Words of an Arrow array of normal texts: ``at`` their numbers in ``known``, ``offsets`` where each text begins."""

    def __init__(self, texts: pa.Array):
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        self.known, self.at = coded.dictionary, coded.indices.to_numpy()
        self.offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy()))).astype(np.int64)
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.offsets))
        self.mark = self.at == pc.index(self.known, pa.scalar(MARK, pa.binary())).as_py()

    def hashes(self) -> np.ndarray:
        from xxhash import xxh3_64_digest as digest

        return np.frombuffer(b"".join(map(digest, self.known.to_pylist())), "<u8")[self.at]

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        parts = [self.known.take(pa.array(self.at[at + i])) for i in range(k)]
        return parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary()))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def phrase_hashes(each: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place; the last k - 1 places hold rubbish."""
    out = each.copy()
    for i in range(1, k):
        out *= _STEP
        out[: len(out) - i] += each[i:]
    return mixed(out)


def lang_hashes(langs: list[str]) -> np.ndarray:
    from xxhash import xxh3_64_digest as digest

    return np.frombuffer(b"".join(digest(x.encode()) for x in langs), "<u8")


def cuts(words: Words, overlap: int, trigger: int, longest: int) -> np.ndarray:
    """Where chunks begin: with each text, at each trigger, and every ``longest`` words without one; never in a text's last ``overlap`` words."""
    first, ends = words.offsets[:-1], words.offsets[1:]
    room = np.arange(len(words.at)) + overlap < ends[words.row]
    starts = np.union1d(first, np.flatnonzero(room & (phrase_hashes(words.hashes(), overlap) % np.uint64(trigger) == 0)))
    stop = np.append(starts[1:], 0)
    last = np.append(words.row[starts[1:]] != words.row[starts[:-1]], True)
    stop[last] = np.maximum(ends[words.row[starts[last]]] - overlap, starts[last])
    more = [np.arange(starts[i] + longest, stop[i], longest) for i in np.flatnonzero(stop - starts > longest)]
    return np.union1d(starts, np.concatenate(more)) if more else starts


def dictionary(docs: DataFrame, max_words: int = MAX_WORDS, trigger: int = TRIGGER, longest: int = MAX_CHUNK) -> DataFrame:
    """lang, chunk (normal text), last, n_words (owned words), freq."""
    overlap = max(max_words - 1, 1)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, langs = batch.column("text").to_pylist(), batch.column("lang")
            for a, b in slices_of_text(texts, 1 << 22):
                own = [normal(x) for x in texts[a:b]]
                some = [i for i, x in enumerate(own) if x]
                if not some:
                    continue
                words = Words(pa.array([own[i] for i in some], pa.binary()))
                starts = cuts(words, overlap, trigger, longest)
                row = words.row[starts]
                last = np.append(row[1:] != row[:-1], True)
                own_end = np.append(starts[1:], len(words.at))
                end = np.where(last, own_end, own_end + overlap)
                place = np.concatenate(([0], np.cumsum(pc.binary_length(words.known).to_numpy()[words.at] + 1)))
                base = place[words.offsets[row]]
                edges = zip(row.tolist(), (place[starts] - base).tolist(), (place[end] - base - 1).tolist(), strict=True)
                chunks = [own[some[i]][x:y] for i, x, y in edges]
                n_words = np.concatenate(([0], np.cumsum(~words.mark)))
                lang = langs.take(pa.array(a + np.array(some)[row]))
                yield pa.RecordBatch.from_arrays([lang, pa.array(chunks, pa.binary()), pa.array(last), pa.array(n_words[own_end] - n_words[starts])], ["lang", "chunk", "last", "n_words"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("und")).alias("lang"))
    return rows.mapInArrow(parse, "lang string, chunk binary, last boolean, n_words long").groupBy("lang", "chunk", "last", "n_words").agg(F.count("*").alias("freq"))


def _owned(words: Words, last: np.ndarray, k: int, overlap: int) -> np.ndarray:
    """Which places begin a phrase of k words of one piece that their chunk owns."""
    first = np.zeros(len(words.at), bool)
    first[words.offsets[:-1]] = True
    piece = np.cumsum(words.mark | first)  # a mark begins the piece after it
    own_end = words.offsets[1:] - np.where(last, 0, overlap)
    ok = (np.arange(len(words.at)) < own_end[words.row]) & ~words.mark
    if k > 1:
        ok[: 1 - k] &= piece[k - 1 :] == piece[: 1 - k]
        ok[max(len(ok) - k + 1, 0) :] = False
    return ok


def counted(chunks: DataFrame, k: int, held: object | None, part: int, parts: int, cells: int, max_words: int) -> DataFrame:
    """lang, phrase, n of the phrases of k words whose first and last k - 1 words are frequent."""
    overlap = max(max_words - 1, 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if held is None else np.frombuffer(held.value, np.uint8)

        def frequent(h: np.ndarray) -> np.ndarray:
            at = h % np.uint64(cells)
            return bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 != 0

        def told(words: Words, at: np.ndarray, n: np.ndarray, langs: pa.Array, code: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([langs.take(pa.array(code)), words.phrases(at, k), pa.array(n.astype(np.int64))], ["lang", "phrase", "n"])

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            words = Words(table["chunk"].chunk(0))
            coded = table["lang"].chunk(0).dictionary_encode()
            langs, code = coded.dictionary, coded.indices.to_numpy()
            freq = table["freq"].chunk(0).to_numpy()
            ok = _owned(words, table["last"].chunk(0).to_numpy(zero_copy_only=False), k, overlap)
            if k == 1:
                size = len(words.known)
                at = np.flatnonzero(ok)
                cell = code[words.row[at]].astype(np.int64) * size + words.at[at]
                n = np.bincount(cell, weights=freq[words.row[at]], minlength=size * len(langs))  # whole numbers below 2 ** 53
                seen = np.flatnonzero(n)
                place = np.zeros(size, np.int64)
                place[words.at] = np.arange(len(words.at))
                yield told(words, place[seen % size], n[seen], langs, seen // size)
                return
            each = (words.hashes() + lang_hashes(langs.to_pylist())[code][words.row]) * _SEED
            shorter = phrase_hashes(each, k - 1)
            known = frequent(shorter)
            if parts == 1:
                ok[:-1] &= known[:-1] & known[1:]
            else:  # the rest of a phrase may belong to another part's map
                ok &= known & (shorter // np.uint64(cells) % np.uint64(parts) == np.uint64(part))
            at = np.flatnonzero(ok)
            if not len(at):
                return
            h = phrase_hashes(each, k)[at]
            order = np.argsort(h)
            h, at = h[order], at[order]
            same = lambda: np.logical_and.reduce([words.at[at[1:] + i] == words.at[at[:-1] + i] for i in range(k)] + [code[words.row[at[1:]]] == code[words.row[at[:-1]]]])
            equal = same()
            if (equal != (h[1:] == h[:-1])).any():  # different phrases of one hash
                order = np.lexsort([code[words.row[at]]] + [words.at[at + i] for i in range(k)])
                at = at[order]
                equal = same()
            new = np.flatnonzero(np.concatenate(([True], ~equal)))
            yield told(words, at[new], np.add.reduceat(freq[words.row[at]], new), langs, code[words.row[at[new]]])

        pending, size = [], 0
        for batch in batches:
            pending.append(batch)
            size += batch.nbytes
            if size > PENDING:
                yield from settle(pa.Table.from_batches(pending))
                pending, size = [], 0
        if size:
            yield from settle(pa.Table.from_batches(pending))

    rows = chunks.select("lang", "chunk", "last", "freq").mapInArrow(count, "lang string, phrase binary, n long")
    return rows.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def bit_map(phrases: DataFrame, k: int, part: int, parts: int, cells: int) -> bytes:
    """Bits of the hashes of one part's phrases; at most about ``HELD`` hashes come to the driver."""

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, coded = Words(batch.column("phrase")), batch.column("lang").dictionary_encode()
            seeds = lang_hashes(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            h = phrase_hashes((words.hashes() + seeds[words.row]) * _SEED, k)[words.offsets[:-1]]
            h = h[h // np.uint64(cells) % np.uint64(parts) == np.uint64(part)]
            yield pa.RecordBatch.from_arrays([pa.array((h % np.uint64(cells)).astype(np.int64))], ["cell"])

    found = phrases.select("lang", "phrase").mapInArrow(cells_of, "cell long").toArrow()["cell"].to_numpy()
    bits = np.zeros(cells // 8, np.uint8)
    np.bitwise_or.at(bits, found >> 3, np.uint8(1) << (found & 7).astype(np.uint8))
    return bits.tobytes()


def frequencies(chunks: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, held: int = HELD) -> DataFrame:
    """lang, phrase (binary, words joined by one space), k, n of all phrases of 1 to ``max_words`` words that occur ``min_count`` times."""
    spark, path = chunks.sparkSession, new_path(chunks.sparkSession, "phrases")
    schema = "lang string, phrase binary, n long"
    for k in range(1, max_words + 1):
        shorter = None if k == 1 else spark.read.schema(schema).parquet(f"{path}/k={k - 1}")
        known = 0 if shorter is None else shorter.count()
        parts = max(1, -(-known // held))
        cells = 1 << max(10, (LOAD * known // parts).bit_length())
        for part in range(parts):
            bits = None if shorter is None else spark.sparkContext.broadcast(bit_map(shorter, k - 1, part, parts, cells))
            found = counted(chunks, k, bits, part, parts, cells, max_words).filter(F.col("n") >= min_count)
            found.select("lang", "phrase", "n").write.mode("append").parquet(f"{path}/k={k}")
            if bits is not None:
                bits.destroy()
    return spark.read.schema(schema + ", k int").parquet(path)


def _cut(phrase: str, k: str) -> tuple:
    """First k words of a phrase, and the rest."""
    words = F.split(F.col(phrase), " ")
    return F.array_join(F.slice(words, F.lit(1), F.col(k)), " "), F.array_join(F.slice(words, F.col(k) + 1, F.size(words)), " ")


def ranked(phrases: DataFrame, totals: DataFrame, max_words: int = MAX_WORDS, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score.  phrases: as of ``frequencies``; totals: lang, n (all words)."""
    known = phrases.select("lang", F.col("phrase").cast("string").alias("phrase"), "k", F.col("n").alias("a"))
    candidates = known.filter("k > 1")
    first, rest = _cut("phrase", "cut")
    each = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumns({"first": first, "rest": rest})
    left, right = (known.select("lang", F.col("phrase").alias(side), F.col("a").alias(name)) for side, name in (("first", "l"), ("rest", "r")))
    big = "decimal(20,0)"
    score = F.expr(f"(cast(1000 as decimal(4,0)) * cast(a as decimal(16,0)) * cast(n as decimal(18,0))) div (cast(l as {big}) * cast(r as decimal(18,0)))")
    each = each.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang").withColumn("score", score)
    scored = each.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    inside = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    covered = candidates.filter("k > 2").select("lang", F.explode(inside).alias("phrase"), F.col("a").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left_over = scored.join(covered, ["lang", "phrase"], "left").filter("longer is null or longer < a").select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = left_over.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, top: int = TOP, trigger: int = TRIGGER, longest: int = MAX_CHUNK) -> DataFrame:
    chunks = store(dictionary(docs, max_words, trigger, longest), "phrase-chunks")
    totals = store(chunks.groupBy("lang").agg(F.sum(F.col("n_words") * F.col("freq")).alias("n")), "phrase-totals")
    return ranked(store(frequencies(chunks, max_words, min_count), "phrase-counts"), totals, max_words, top)
