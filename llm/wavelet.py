"""Token ids of a corpus in wavelet-matrix shards.

Documents are dealt by ranges of doc_id and text hash and encoded there; a task closes a shard once it holds ``shard_tokens`` ids, so a
shard is a run of whole documents in ascending order.  A shard is one row of the store: its documents' ids and lengths,
and for each bit of the ids, from the highest, a plane of bits in the order that the planes above left (zeros first), the number of zeros, and the ones
before every block of 512 bits.  That answers access, rank (how often an id occurs before a place), select (the place of its k-th
occurrence), counts and occurrence lists from the one compressed file, without decoding the rest.

Defined results: a null text counts as empty; every document ends with id 0; rows of equal doc_id stand in the order of their
texts' hashes, rows without doc_id come first; an empty table gives an empty store.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from llm.common import n_partitions
from llm.tokens import default_path, encoder, slices_of_text

SHARD_TOKENS, END_ID, BLOCK = 1 << 20, 0, 512
BATCH_CHARS = 1 << 22  # texts encoded together; more share more words
KEPT_PIECES = 800_000  # a task here has one Python worker, where encoding and digests in one stage have two
SCHEMA = "part int, shard int, doc_ids array<bigint>, lengths array<bigint>, n_tokens long, planes array<binary>, zeros array<bigint>, ranks array<binary>"


class WaveletMatrix:
    """Succinct sequence of unsigned ids; build from ids or open from a stored row."""

    def __init__(self, n: int, planes: list[bytes], zeros: list[int], ranks: list[bytes]):
        self.n, self.planes, self.zeros = n, [np.frombuffer(p, np.uint8) for p in planes], list(zeros)
        self.ranks = [np.frombuffer(r, "<u4") for r in ranks]

    @staticmethod
    def build(ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        now = ids.astype(np.uint16 if n == 0 or ids.max() < 1 << 16 else np.uint32)
        planes, zeros, ranks = [], [], []
        for k in range(max(1, int(now.max(initial=0)).bit_length()) - 1, -1, -1):
            bits = (now & now.dtype.type(1 << k)) != 0
            plane = np.packbits(bits, bitorder="little")
            plane = np.concatenate([plane, np.zeros(-len(plane) % (BLOCK // 8), np.uint8)])
            ones = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.int64)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes())
            planes.append(plane.tobytes())
            low = np.compress(~bits, now)  # several times faster than now[~bits] where bits alternate without order
            zeros.append(len(low))
            now = np.concatenate([low, np.compress(bits, now)])
        return WaveletMatrix(n, planes, zeros, ranks)

    def _bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        plane, block = self.planes[level], at // BLOCK
        words = np.concatenate([plane, np.zeros(BLOCK // 8, np.uint8)]).view(np.uint64).reshape(-1, BLOCK // 64)[block]
        left = np.clip(at[:, None] - block[:, None] * BLOCK - 64 * np.arange(BLOCK // 64), 0, 64).astype(np.uint64)
        mask = np.where(left == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(left, np.uint64(63))) - np.uint64(1))
        return self.ranks[level][block].astype(np.int64) + np.bitwise_count(words & mask).sum(axis=1, dtype=np.int64)

    def ids(self) -> np.ndarray:
        """All ids, in one pass over the planes from the lowest."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for k, level in enumerate(range(len(self.planes) - 1, -1, -1)):
            bits, before = self._bits(level), np.empty_like(out)
            before[np.flatnonzero(~bits)] = out[: self.zeros[level]]  # as in build, places are faster than a mask
            before[np.flatnonzero(bits)] = out[self.zeros[level] :] | out.dtype.type(1 << k)
            out = before
        return out.astype(np.uint32)

    def access(self, places: np.ndarray) -> np.ndarray:
        at, out = np.asarray(places, np.int64), np.zeros(len(places), np.uint32)
        for level, plane in enumerate(self.planes):
            bit = plane[at >> 3] >> (at & 7).astype(np.uint8) & 1 != 0
            ones = self._ones(level, at)
            out = out << np.uint32(1) | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int, start: int = 0, end: int | None = None) -> tuple[int, int]:
        """Where the occurrences of an id within [start, end) stand below the last plane."""
        span = np.array([start, self.n if end is None else end], np.int64)
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            ones = self._ones(level, span)
            span = self.zeros[level] + ones if token >> (len(self.planes) - 1 - level) & 1 else span - ones
        return int(span[0]), int(span[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(token, start, end)
        return b - a

    def rank(self, token: int, place: int) -> int:
        return self.count(token, 0, place)

    def occurrences(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Places of the occurrences number ``first`` up to ``last`` (exclusive), ascending: select for each of them."""
        a, b = self._range(token)
        at = np.arange(a, b, dtype=np.int64)[first:last]
        for level in range(len(self.planes) - 1, -1, -1):
            if token >> (len(self.planes) - 1 - level) & 1:
                at = self._select(level, at - self.zeros[level], True)
            else:
                at = self._select(level, at, False)
        return at

    def select(self, token: int, k: int) -> int:
        return int(self.occurrences(token, k, k + 1)[0])

    def _select(self, level: int, k: np.ndarray, one: bool) -> np.ndarray:
        """Place of the k-th one or zero: its block by binary search, then within the block."""
        before = self.ranks[level].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        block = np.searchsorted(before, k, side="right") - 1
        bits = np.unpackbits(self.planes[level].reshape(-1, BLOCK // 8)[block], axis=1, bitorder="little") == one
        return block * BLOCK + (bits.cumsum(axis=1) > (k - before[block])[:, None]).argmax(axis=1)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, shard_tokens: int = SHARD_TOKENS, end_id: int = END_ID) -> None:
    """Encodes and writes the store, a Parquet table of shards, to ``path``."""
    tokenizer = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, own = TaskContext.get().partitionId(), 0, encoder(tokenizer, KEPT_PIECES)
        end = np.array([end_id], "<u4").tobytes()
        ids, lengths, doc_ids = [], [], []

        def closed() -> pa.RecordBatch:
            matrix = WaveletMatrix.build(np.frombuffer(b"".join(ids), "<u4"))
            row = {"part": part, "shard": shard, "doc_ids": doc_ids, "lengths": lengths, "n_tokens": matrix.n, "planes": [p.tobytes() for p in matrix.planes], "zeros": matrix.zeros, "ranks": [r.tobytes() for r in matrix.ranks]}
            return pa.RecordBatch.from_pylist([row], schema)

        held = 0
        for batch in batches:
            texts, numbers = batch.column("text").to_pylist(), batch.column("doc_id").to_pylist()
            for a, b in slices_of_text(texts, BATCH_CHARS):
                for doc_id, coded in zip(numbers[a:b], own.batch(texts[a:b]), strict=True):
                    ids += [coded, end]
                    lengths.append(len(coded) // 4 + 1)
                    doc_ids.append(doc_id)
                    held += lengths[-1]
                    if held >= shard_tokens:
                        yield closed()
                        ids, lengths, doc_ids, held, shard = [], [], [], 0, shard + 1
        if doc_ids:
            yield closed()

    longs = pa.list_(pa.int64())
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_ids", longs), ("lengths", longs), ("n_tokens", pa.int64()), ("planes", pa.list_(pa.binary())), ("zeros", longs), ("ranks", pa.list_(pa.binary()))])
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # By the text too, so that rows without id, or of one id, spread over several tasks.
    dealt = docs.repartitionByRange(n_partitions(docs.sparkSession), "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    dealt.mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def starts(shards: DataFrame) -> DataFrame:
    """part, shard, base: ids in all shards before.  One row a shard; parts are summed first, so the ordered sums stay small."""
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("of_part"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = shards.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("in_part"))
    return own.join(bases, "part").select("part", "shard", (F.col("of_part") + F.col("in_part")).alias("base"))


def documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read back from the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                part, shard, doc_ids, lengths, n, planes, zeros, ranks = (c[row].as_py() for c in batch.columns)
                raw = WaveletMatrix(n, planes, zeros, ranks).ids().astype("<u4")
                ends = np.cumsum(np.array(lengths, np.int64))
                crcs = [zlib.crc32(raw[e - k : e]) for e, k in zip(ends.tolist(), lengths, strict=True)]
                m = len(doc_ids)
                columns = [pa.array([part] * m, pa.int32()), pa.array([shard] * m, pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"])

    rows = shards.mapInArrow(run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    return rows.join(starts(shards), ["part", "shard"]).select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_counts(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """token, n: how often each occurs in the whole store, by rank alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix(row["n_tokens"], row["planes"], row["zeros"], row["ranks"])
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int64()), pa.array([matrix.count(t) for t in tokens], pa.int64())], ["token", "n"])

    counts = shards.select("n_tokens", "planes", "zeros", "ranks").mapInArrow(run, "token long, n long")
    return counts.groupBy("token").agg(F.sum("n").alias("n"))


def token_places(shards: DataFrame, token: int) -> DataFrame:
    """doc_id, place (within its document) of every occurrence of one id, by select, without decoding other ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                matrix = WaveletMatrix(row["n_tokens"], row["planes"], row["zeros"], row["ranks"])
                ends = np.cumsum(row["lengths"])
                places = matrix.occurrences(token)
                doc = np.searchsorted(ends, places, side="right")
                own = places - (ends - row["lengths"])[doc]
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][d] for d in doc], pa.int64()), pa.array(own, pa.int64())], ["doc_id", "place"])

    return shards.drop("part", "shard").mapInArrow(run, "doc_id long, place long")
