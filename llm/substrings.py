"""Removal of repeated passages with a count-min prefilter.

A window is ``WINDOW`` consecutive words of one document.  Pass one: every task sketches the windows of its documents in ``DEPTH`` rows of
saturating counters (0, 1, 2 or more): the cells of some windows at a time, sorted and cut into blocks; a shuffle by blocks merges them, one block in memory.  A merged count is never too small, so a
window that occurs twice anywhere meets cells of 2 or more in every row.  Pass two groups exactly, by 96 bits of hash, only those windows: a task first
settles repeats among its own documents and sends on just the smallest document of each window, so a window that a third of all
documents hold is sent once a task.  Repeats come back as places in documents.

A row has about a cell for each byte of text, so that few unique windows share a cell, up to ``CELLS``, which bounds the merged bit maps (broadcast compressed, at most
DEPTH * CELLS / 8 bytes).  Beyond about CELLS windows the prefilter lets more and more windows through to the exact pass, which gives the same result at the cost of a
larger shuffle; a sketch for each part of the hash space would hash all texts once more for each part.

Defined results: a null text has no words; texts of fewer than ``WINDOW`` words lose nothing; rows of equal doc_id take
nothing from each other; rows without doc_id count as having the largest id.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, DEPTH, CELLS, BLOCK = 13, 2, 1 << 29, 1 << 20
PENDING = 500_000  # windows that a task holds before it sends on the smallest documents
NO_ID = (1 << 63) - 1
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_128_digest as digest

    return np.frombuffer(b"".join(map(digest, words)), "<u8").reshape(-1, 2)


def window_hashes(words: list[bytes], window: int = WINDOW) -> np.ndarray:
    """Two independent 64-bit hashes of each window."""
    n = len(words) - window + 1
    if n <= 0:
        return np.zeros((0, 2), np.uint64)
    each = word_hashes(words)
    out = each[:n].copy()
    for k in range(1, window):
        out *= _MULTIPLIERS
        out += each[k : k + n]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def cells_of(hashes: np.ndarray, row: int, cells: int) -> np.ndarray:
    mixed = (hashes[:, 0] ^ (hashes[:, 1] * np.uint64(2 * row + 1) + np.uint64(row))) * np.uint64(0x94D049BB133111EB)
    return (mixed >> np.uint64(64 - (cells.bit_length() - 1))).astype(np.int64)


class BitMap:
    def __init__(self, cells: int):
        self.raw = np.zeros(cells // 8, np.uint8)

    def has(self, cells: np.ndarray) -> np.ndarray:
        return self.raw[cells >> 3] >> (cells & 7).astype(np.uint8) & 1 != 0


def packed(places: np.ndarray, again: np.ndarray) -> bytes:
    """Ascending places of one block and whether each was met more than once: steps by byte planes, compressed."""
    import zstandard

    steps = np.diff(places, prepend=0).astype("<u4")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=1).compress(len(places).to_bytes(4, "little") + planes.tobytes() + np.packbits(again).tobytes())


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int.from_bytes(raw[:4], "little")
    planes = np.frombuffer(raw, np.uint8, 4 * n, 4).reshape(4, n)
    steps = np.ascontiguousarray(planes.T).view("<u4").ravel()
    return np.cumsum(steps, dtype=np.int64), np.unpackbits(np.frombuffer(raw, np.uint8, offset=4 + 4 * n), count=n).astype(bool)


def split(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def repeated_cells(docs: DataFrame, window: int, depth: int, cells: int) -> list[tuple[int, int, bytes]]:
    """Row, block and compressed bit map of the cells that count two or more in the merged sketch."""
    import zstandard

    block = min(BLOCK, cells)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells of ``PENDING`` windows at a time, by block; nothing else is kept."""
        pending: list[np.ndarray] = []

        def settle() -> Iterator[pa.RecordBatch]:
            hashes = np.concatenate(pending)
            pending.clear()
            for row in range(depth):
                at, n = np.unique(cells_of(hashes, row, cells), return_counts=True)
                edges = np.searchsorted(at, np.arange(0, cells + 1, block))
                some = np.flatnonzero(edges[1:] > edges[:-1])
                raw = [packed(at[edges[b] : edges[b + 1]] - b * block, n[edges[b] : edges[b + 1]] > 1) for b in some.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(raw), pa.int32()), pa.array(some.astype(np.int32)), pa.array(raw, pa.binary())], ["row", "block", "cells"])

        held = 0
        for batch in batches:
            for text in batch.column("text"):
                hashes = window_hashes(split(text.as_py()), window)
                pending.append(hashes)
                held += len(hashes)
                if held > PENDING:
                    yield from settle()
                    held = 0
        if held:
            yield from settle()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Streams over blocks in order; holds one block."""
        import zstandard

        now, once, twice = None, np.zeros(block, bool), np.zeros(block, bool)
        pack = zstandard.ZstdCompressor(level=1).compress

        def merged() -> pa.RecordBatch:
            raw = pack(np.packbits(twice, bitorder="little").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([raw], pa.binary())], ["row", "block", "twice"])

        for batch in batches:
            for row, b, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (row, b):
                    if now and twice.any():
                        yield merged()
                    now = (row, b)
                    once[:], twice[:] = False, False
                places, again = unpacked(raw)
                twice[places] |= once[places] | again
                once[places] = True
        if now and twice.any():
            yield merged()

    sketches = docs.select("text").mapInArrow(sketch, "row int, block int, cells binary")
    merged = sketches.repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(merge, "row int, block int, twice binary")
    return [(r["row"], r["block"], bytes(r["twice"])) for r in merged.toLocalIterator()]  # at most DEPTH * CELLS / 8 bytes in all


def opened(blocks: list[tuple[int, int, bytes]], depth: int, cells: int) -> list[BitMap]:
    import zstandard

    unpack, size = zstandard.ZstdDecompressor().decompress, min(BLOCK, cells) // 8
    maps = [BitMap(cells) for _ in range(depth)]
    for row, block, raw in blocks:
        maps[row].raw[block * size : (block + 1) * size] = np.frombuffer(unpack(raw), np.uint8)
    return maps


def _estimated_repeated(maps: list[BitMap], hashes: np.ndarray, cells: int) -> np.ndarray:
    ok = np.ones(len(hashes), bool)
    for row, m in enumerate(maps):
        at = np.flatnonzero(ok)
        ok[at] = m.has(cells_of(hashes[at], row, cells))
    return ok


def by_row(d: np.ndarray, t: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Places of each document and text together."""
    if not len(d):
        return d, t, []
    order = np.lexsort((p, t, d))
    d, t, p = d[order], t[order], p[order].astype("<u4")
    cuts = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]), [True])))
    return d[cuts[:-1]], t[cuts[:-1]], [p[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id (the largest for none) and the text's hash, which tells rows of equal id apart."""
    of_text = F.xxhash64("text")
    return docs.select(F.col("doc_id").cast("long").alias("own_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), of_text.alias("of_text"), "text")


def cells_for(docs: DataFrame) -> int:
    """A power of two, at least the bytes of all texts, between ``BLOCK`` and ``CELLS``."""
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return min(CELLS, max(BLOCK, 1 << size.bit_length()))


def repeats(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, cells: int | None = None) -> DataFrame:
    """doc_id, of_text, places (binary, little-endian unsigned 32-bit): windows of the document that also start in one with a smaller id; of windows that
    a document holds several times, one place may stand for all.  Several rows a document."""
    cells = cells or cells_for(docs)
    held = docs.sparkSession.sparkContext.broadcast(repeated_cells(docs, window, depth, cells))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = opened(held.value, depth, cells)
        hashes, ids, texts, places, count = [], [], [], [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            h, d, t, p = (np.concatenate(x) for x in (hashes, ids, texts, places))
            order = np.lexsort((p, t, d, h[:, 1], h[:, 0]))
            h, d, t, p = h[order], d[order], t[order], p[order]
            new = np.concatenate(([True], (h[1:] != h[:-1]).any(axis=1)))
            least = d[np.flatnonzero(new)][np.cumsum(new) - 1]
            row = np.concatenate(([True], (d[1:] != d[:-1]) | (t[1:] != t[:-1])))
            known = (new | row) & (d > least)  # settled here: a smaller document of this task has the window
            yield from told(d[known], t[known], p[known])
            send = (new | row) & (d == least)
            check = (h[send, 1] >> np.uint64(32)) << np.uint64(32) | p[send].astype(np.uint64)
            none = pa.nulls(int(send.sum()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(h[send, 0].view(np.int64)), pa.array(check.view(np.int64)), pa.array(d[send]), pa.array(t[send]), none], ["key", "check", "doc_id", "of_text", "places"])

        def told(d: np.ndarray, t: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(d):
                d, t, raw = by_row(d, t, p)
                none = pa.nulls(len(raw), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(d), pa.array(t), pa.array(raw, pa.binary())], ["key", "check", "doc_id", "of_text", "places"])

        for batch in batches:
            for doc_id, of_text, text in zip(batch.column("doc_id").to_pylist(), batch.column("of_text").to_pylist(), batch.column("text"), strict=True):
                own = window_hashes(split(text.as_py()), window)
                at = np.flatnonzero(_estimated_repeated(maps, own, cells))
                hashes.append(own[at])
                ids.append(np.full(len(at), doc_id, np.int64))
                texts.append(np.full(len(at), of_text, np.int64))
                places.append(at)
                count += len(at)
                if count > PENDING:
                    yield from settle()
                    hashes, ids, texts, places, count = [], [], [], [], 0
        if count:
            yield from settle()

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows in order of key, check and document: places of every document but a window's smallest, and what was settled before."""
        last = None
        for batch in batches:
            settled = pa.RecordBatch.from_arrays([batch.column(i) for i in (2, 3, 4)], ["doc_id", "of_text", "places"]).filter(batch.column(0).is_null())
            if settled.num_rows:
                yield settled
            batch = batch.filter(batch.column(0).is_valid())
            key, check, doc = (batch.column(i).to_numpy().view(np.uint64) for i in range(3))
            window_bits, doc = check >> np.uint64(32), doc.view(np.int64)
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (window_bits[1:] != window_bits[:-1])
            first_doc = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            if last is not None and len(key) and (key[0], window_bits[0]) == last[:2]:
                run = int(np.flatnonzero(new[1:])[0] + 1) if new[1:].any() else len(key)
                first_doc[:run] = last[2]
            if len(key):
                last = (key[-1], window_bits[-1], first_doc[-1])
            later = doc > first_doc
            d, t, raw = by_row(doc[later], batch.column(3).to_numpy()[later], (check[later] & np.uint64(0xFFFFFFFF)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(t), pa.array(raw, pa.binary())], ["doc_id", "of_text", "places"])

    rows = _keyed(docs).select("doc_id", "of_text", "text")
    found = rows.mapInArrow(candidates, "key long, check long, doc_id long, of_text long, places binary")
    deal = F.coalesce("key", F.xxhash64("doc_id", "of_text"))
    dealt = found.repartition(deal).sortWithinPartitions("key", F.shiftrightunsigned("check", 32), "doc_id")
    return dealt.mapInArrow(grouped, "doc_id long, of_text long, places binary")


def remove(docs: DataFrame, window: int = WINDOW, depth: int = DEPTH, cells: int | None = None) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed."""
    docs = docs.select("doc_id", "text")
    places = repeats(docs, window, depth, cells).groupBy("doc_id", "of_text").agg(F.collect_list("places").alias("places"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sizes, gone = [], [], []
            for text, found in zip(batch.column("text"), batch.column("places").to_pylist(), strict=True):
                words = split(text.as_py())
                sizes.append(len(words))
                if not found:
                    texts.append(b" ".join(words).decode())
                    gone.append(0)
                    continue
                own = window_hashes(words, window)
                at = np.frombuffer(b"".join(found), "<u4").astype(np.int64)
                hit = np.isin(own[:, 0], own[at, 0])  # all places of a window that a document holds several times
                edge = np.zeros(len(words) + 1, np.int64)
                edge[: len(hit)] += hit
                edge[window : window + len(hit)] -= hit
                covered = np.cumsum(edge[:-1]) > 0
                texts.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c]).decode())
                gone.append(int(covered.sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_words", "n_removed"])

    joined = _keyed(docs).join(places, ["doc_id", "of_text"], "left").select(F.col("own_id").alias("doc_id"), "text", "places")
    return joined.mapInArrow(cut, "doc_id long, text string, n_words long, n_removed long")


def digests(removed: DataFrame) -> DataFrame:
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
