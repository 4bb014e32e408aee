"""SimHash near-duplicates with pigeonring filtering.

A fingerprint has five segments on a ring.  If two fingerprints differ in at most four bits, some segment starts a
chain in which the first l segments together differ in at most l * 4/5 bits, for every l: none in the first, one in the
first two, two in three, three in four, four in all.  Fingerprints that share the first segment and all but one bit of
the second meet in a bucket (64 buckets a fingerprint, one for each bit left out); there the rest of the chain prunes
before the full distance is taken.  Buckets return a spanning forest of their links, never all pairs, and buckets of more
than ``tile`` fingerprints are cut into tiles, so that neither a task nor the result grows with the square of a group.

Defined results: a null text counts as empty; texts without words have fingerprint zero and are linked like any other;
rows with equal doc_id are rows of their own with the same component; rows without doc_id take part in links and have
the component's smallest id, or null where it has none.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import store
from llm.components import components

SHINGLE, MAX_BITS, TILE = 4, 4, 16_384
_WIDTHS = (13, 13, 13, 13, 12)
_STARTS = (0, 13, 26, 39, 52)
_FULL = (1 << 64) - 1


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint of one text (unsigned)."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    full = n // 255 * 255  # sums of up to 255 bits fit a byte, which numpy adds fastest
    counts = bits[full:].sum(axis=0, dtype=np.int64)
    if full:
        counts += np.add.reduce(bits[:full].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, of_text (a hash that tells rows of equal id apart), fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in batch.column("text")), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("of_text"), pa.array(fps.view("<i8"))], ["doc_id", "of_text", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("of_text"), "text")
    return rows.mapInArrow(run, "doc_id long, of_text long, fp long")


def _rotated(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftrightunsigned(fp, by).bitwiseOR(F.shiftleft(fp, 64 - by))


def _chains(fp: Column) -> list[tuple[Column, int, int]]:
    """For each start on the ring: the first two segments as a number, and their widths."""
    out = []
    for i in range(5):
        first, second = _WIDTHS[i], _WIDTHS[(i + 1) % 5]
        out.append((_rotated(fp, _STARTS[i]).bitwiseAND(F.lit((1 << first + second) - 1)), first, second))
    return out


def _keys(start: int, chain: Column, first: int, second: int) -> list[Column]:
    """Bucket keys of a chain: its bits without one bit of its second segment, and which bit that is."""
    before = sum(_WIDTHS[(i + 1) % 5] for i in range(start))
    return [
        chain.bitwiseAND(F.lit(~(1 << first + j))).bitwiseOR(F.lit((before + j) << 26)) for j in range(second)
    ]


def _close(x: np.ndarray, y: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Whether the chain from ``start`` stays within its budgets, then the full distance."""
    diff = x ^ y
    ok = np.ones(diff.shape, bool)
    for length, budget in ((3, 2), (4, 3)):
        masks = np.array([sum(((1 << _WIDTHS[(i + k) % 5]) - 1) << _STARTS[(i + k) % 5] for k in range(length)) & _FULL for i in range(5)], np.uint64)
        ok &= np.bitwise_count(diff & masks[start]) <= budget
    return ok & (np.bitwise_count(diff) <= MAX_BITS)


_START_OF_BIT = np.repeat(np.arange(5), [_WIDTHS[(i + 1) % 5] for i in range(5)])


def _forest(fps: np.ndarray, start: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Spanning forest of the links within one bucket, by breadth-first search against what is not yet reached."""
    left, rest = [], np.unique(fps)
    frontier = rest[:0]
    while len(rest):
        if not len(frontier):
            frontier, rest = rest[:1], rest[1:]
        found = []
        for x in frontier:
            near = _close(rest, x, start)
            if near.any():
                found.append(rest[near])
                left.append((np.full(near.sum(), x), rest[near]))
                rest = rest[~near]
        frontier = np.concatenate(found) if found else rest[:0]
    return [a for a, _ in left], [b for _, b in left]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links within runs of equal keys of a sorted partition."""

    def pairs(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        sizes = np.diff(cuts)
        start_of = _START_OF_BIT[(keys >> 57).astype(np.int64)]
        left, right = [], []
        small = np.repeat(sizes <= 32, sizes)
        for lag in range(1, min(33, len(keys))):
            at = np.flatnonzero((keys[lag:] == keys[:-lag]) & small[lag:])
            if not len(at):
                break
            at = at[_close(fps[at], fps[at + lag], start_of[at])]
            left.append(fps[at])
            right.append(fps[at + lag])
        for k in np.flatnonzero(sizes > 32):
            a, b = _forest(fps[cuts[k] : cuts[k + 1]], int(start_of[cuts[k]]))
            left += a
            right += b
        none = np.zeros(0, np.uint64)
        a, b = np.concatenate([none, *left]), np.concatenate([none, *right])
        both = np.unique(np.stack([a, b], axis=1), axis=0) if len(a) else np.zeros((0, 2), np.uint64)
        return pa.RecordBatch.from_arrays([pa.array(both[:, i].astype(np.uint64).view(np.int64)) for i in (0, 1)], ["a", "b"])

    held_k, held_f = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    for batch in batches:
        keys = np.concatenate([held_k, batch.column(0).to_numpy().view(np.uint64)])
        fps = np.concatenate([held_f, batch.column(1).to_numpy().view(np.uint64)])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
        held_k, held_f = keys[last:], fps[last:]
        if last:
            yield pairs(keys[:last], fps[:last])
    if len(held_k):
        yield pairs(held_k, held_f)


def links(distinct: DataFrame, tile: int = TILE) -> DataFrame:
    """Pairs (a, b) of different fingerprints that connect whatever 4 bits connect.  distinct: fp, stored.

    ``tile`` is the number of fingerprints that a bucket may have before it is cut.  A bucket's size is at most that of the
    two exact chains it holds, so five counts a fingerprint tell which buckets to cut.
    """
    chains = _chains(F.col("fp"))
    exact = distinct.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), c.alias("chain")) for i, (c, _, _) in enumerate(chains)])).alias("x")).groupBy("x.i", "x.chain").count()
    large = exact.filter(F.col("count") > tile // 2)
    spread = [
        large.filter(F.col("i") == i).select(F.explode(F.array(*_keys(i, F.col("chain"), first, second))).alias("key"), "count")
        for i, (_, first, second) in enumerate(chains)
    ]
    cut = spread[0].unionAll(spread[1]).unionAll(spread[2]).unionAll(spread[3]).unionAll(spread[4])
    cut = store(cut.groupBy("key").agg(F.ceil(2 * F.sum("count") / tile).cast("long").alias("parts")), "simhash-large")
    n_cut = cut.count()

    keys = [k for i, (c, first, second) in enumerate(chains) for k in _keys(i, c, first, second)]
    rows = distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")
    if n_cut:
        rows = rows.join(F.broadcast(cut) if n_cut <= 100_000 else cut, "key", "left")
        own = F.pmod(F.xxhash64("fp"), F.col("parts"))
        tiles = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
            F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda j: F.least(own, j) * F.col("parts") + F.greatest(own, j))
        )
        rows = rows.select("key", "fp", F.explode(tiles).alias("tile"))
    else:
        rows = rows.withColumn("tile", F.lit(0).cast("long"))
    rows = rows.select(F.shiftleft("key", 31).bitwiseOR(F.col("tile")).alias("k"), "fp")
    rows = rows.repartition("k").sortWithinPartitions("k")
    return rows.mapInArrow(_links, "a long, b long").distinct()


def _placed(docs: DataFrame, shingle: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of rows, and of each distinct one the root of its component and the least doc_id."""
    prints = store(fingerprints(docs, shingle), "simhash-prints")
    of_print = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    roots = components(links(of_print.select("fp"), tile))
    return prints, of_print.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach)."""
    prints, rooted = _placed(docs, shingle, tile)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    out = prints.select("doc_id", "fp").join(placed, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, tile: int = TILE) -> DataFrame:
    """One whole row of each component: the one of smallest doc_id (none counts as largest), then text hash; of equal rows any one."""
    prints, rooted = _placed(docs, shingle, tile)
    last = (1 << 63) - 1
    key = F.struct(F.coalesce("doc_id", F.lit(last)).alias("_own"), F.col("of_text").alias("_of_text"))
    of_print = prints.groupBy("fp").agg(F.min(key).alias("row"))
    chosen = of_print.join(rooted.select("fp", "root"), "fp").groupBy("root").agg(F.min("row").alias("row")).select("row.*").distinct()
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(last)).alias("_own"), F.xxhash64("text").alias("_of_text"))
    return keyed.join(chosen, ["_own", "_of_text"], "left_semi").dropDuplicates(["_own", "_of_text"]).select("row.*")
