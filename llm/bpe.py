"""BPE encoding and decoding by tree concatenation.

Texts of up to ``long_chars`` characters are encoded where they are read.  A longer text is cut at word boundaries (see
``tokens``) into leaves of about ``leaf_chars``.  A stretch without such a boundary is pre-tokenised; what the splitting
pattern leaves whole (``unsplit text``) is halved into leaves down to ``leaf_bytes`` bytes, at any byte.  Leaves are rows:
they are shuffled and encoded in parallel.  Then each long text's leaves are joined pairwise as a tree.  At a join inside unsplit
text the last k tokens of the left and first k of the right side are encoded again as one window, and k grows until the
window begins with the left side's token and ends with the right side's; then both sides agree with it and the joined
tokens are the encoding of the joined text, since a BPE sequence is right exactly if each neighbouring pair of its tokens is.

Texts of ``long_chars`` and less are encoded whole, which is exact too; of the invented test documents under 1 % are longer, and none holds
unsplit text beyond 45 characters, so their leaves meet at word boundaries; ``tests/llm`` drives joins inside unsplit text.

Defined results: a null text counts as empty, an empty text has no tokens; every row gives one row; repeated and null ids
are carried along.  Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.tokens import _CUT, byte_names, default_path, encoder, slices_of_text

LONG_CHARS, LEAF_CHARS, LEAF_BYTES = 1 << 14, 1 << 12, 1 << 8
_WINDOW = 4
_SCHEMA = "doc_id long, ids binary"
DIGESTS = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


class Pieces:
    """Byte-level pieces of one tokenizer: encode a piece, bytes of an id, decode ids."""

    def __init__(self, path: str):
        own = encoder(path).tokenizer
        self.tokenizer, self.model = own, own.model
        self.special = {t.content: i for i, t in own.get_added_tokens_decoder().items()}
        self.pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        size = own.get_vocab_size(with_added_tokens=True)
        self.names = [own.id_to_token(i) for i in range(size)]
        codes = {c: b for b, c in byte_names().items()}
        self.raw = [n.encode() if n in self.special else bytes(codes[c] for c in n) for n in (x or "" for x in self.names)]
        self.decimal = [str(i) for i in range(size)]

    def encode(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(piece)]

    def text(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").encode()


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def join(left: list[int], right: list[int], own: Pieces) -> list[int]:
    """Tokens of two neighbouring stretches of one unsplit text, re-encoded around the join until both sides agree."""
    if not left or not right:
        return left + right
    k = _WINDOW
    while True:
        a, b = left[-k:], right[:k]
        window = own.encode("".join(own.names[i] for i in a + b))
        whole_left, whole_right = len(a) == len(left), len(b) == len(right)
        if (whole_left or window[0] == a[0]) and (whole_right or window[-1] == b[-1]):
            return left[: len(left) - len(a)] + window + right[len(b) :]
        k *= 2


def tree(parts: list[tuple[bool, list[int]]], own: Pieces) -> list[int]:
    """Ids of a text from its leaves in order.  A leaf's flag tells that it goes on the unsplit text of the one before it;
    such leaves are joined pairwise, level by level."""
    out: list[int] = []
    level: list[list[int]] = []
    for goes_on, ids in [*parts, (False, [])]:
        if not goes_on:
            while len(level) > 1:
                level = [join(level[i], level[i + 1], own) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
            out += level[0] if level else []
            level = []
        level.append(ids)
    return out


def halves(piece: str, leaf: int) -> list[str]:
    if len(piece) <= leaf:
        return [piece]
    middle = len(piece) // 2
    return halves(piece[:middle], leaf) + halves(piece[middle:], leaf)


def leaves(text: str, own: Pieces, leaf_chars: int, leaf_bytes: int) -> Iterator[tuple[str, bool, str]]:
    """Kind (text or piece), whether it goes on the leaf before, and content."""
    held, size = [], 0

    def flush() -> Iterator[tuple[str, bool, str]]:
        if held:
            yield "text", False, "".join(held)
            held.clear()

    for stretch in _CUT.split(text):
        if len(stretch) <= leaf_chars:
            if size + len(stretch) > leaf_chars:
                yield from flush()
                size = 0
            held.append(stretch)
            size += len(stretch)
            continue
        yield from flush()
        size = 0
        for k, segment in enumerate(own.pattern.split(stretch) if own.pattern else [stretch]):
            if k % 2:
                yield "text", False, segment
            elif segment:
                short: list[str] = []
                for piece, _ in own.tokenizer.pre_tokenizer.pre_tokenize_str(segment):
                    if len(piece) <= leaf_bytes:
                        short.append(piece)
                        if len(short) < 4096:
                            continue
                    if short:
                        yield "pieces", False, "\x00".join(short)
                        short = []
                    if len(piece) > leaf_bytes:
                        for n, half in enumerate(halves(piece, leaf_bytes)):
                            yield "piece", n > 0, half
                if short:
                    yield "pieces", False, "\x00".join(short)
    yield from flush()


def _plain(doc_ids: pa.Array, coded: list[bytes], own: Pieces) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(coded, pa.binary())], ["doc_id", "ids"])


def _digested(doc_ids: pa.Array, coded: list[bytes], own: Pieces) -> pa.RecordBatch:
    sizes, ids_sha, text_sha = [], [], []
    for raw in coded:
        ids = np.frombuffer(raw, "<u4")
        sizes.append(len(ids))
        ids_sha.append(hashlib.sha256(",".join(map(own.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
        text_sha.append(hashlib.sha256(own.text(ids)).hexdigest())
    return pa.RecordBatch.from_arrays([doc_ids, pa.array(sizes, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], DIGESTS)


def _digested_with_ids(doc_ids: pa.Array, coded: list[bytes], own: Pieces) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(raw) // 4 for raw in coded]))).astype(np.int32)
    arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))
    return pa.RecordBatch.from_arrays([*_digested(doc_ids, coded, own).columns, arrays], [*DIGESTS, "ids"])


def encode(docs: DataFrame, path: str | None = None, long_chars: int = LONG_CHARS, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit integers) of every row."""
    return _encoded(docs, _plain, _SCHEMA, path, long_chars, leaf_chars, leaf_bytes)


def round_trip(docs: DataFrame, path: str | None = None, with_ids: bool = False, long_chars: int = LONG_CHARS, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids as an array: encoded and decoded by the same worker."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return _encoded(docs, _digested_with_ids if with_ids else _digested, schema, path, long_chars, leaf_chars, leaf_bytes)


def _encoded(docs: DataFrame, finish: Callable[[pa.Array, list[bytes], Pieces], pa.RecordBatch], schema: str, path: str | None, long_chars: int, leaf_chars: int, leaf_bytes: int) -> DataFrame:
    path = path or default_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = pieces(path), encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in slices_of_text(texts):
                yield finish(batch.column("doc_id").slice(a, b - a), words.batch(texts[a:b]), own)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            for row, doc_id, text in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for n, (kind, inner, content) in enumerate(leaves(text, own, leaf_chars, leaf_bytes)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc_id, "n": n, "kind": kind, "inner": inner, "content": content}], leaf_schema)

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = pieces(path), encoder(path)
        for batch in batches:
            kinds, contents = batch.column("kind").to_pylist(), batch.column("content").to_pylist()
            coded = [b"" if kind == "text" else np.array([i for p in content.split("\x00") for i in own.encode(p)], "<u4").tobytes() for kind, content in zip(kinds, contents, strict=True)]
            whole = [i for i, kind in enumerate(kinds) if kind == "text"]
            for a, b in slices_of_text([contents[i] for i in whole]):
                for i, ids in zip(whole[a:b], words.batch([contents[i] for i in whole[a:b]]), strict=True):
                    coded[i] = ids
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("row", "doc_id", "n", "inner")] + [pa.array(coded, pa.binary())], schema=coded_schema)

    def joined(rows):  # no hints: Spark reads them as objects
        own = pieces(path)
        rows = rows.sort_by("n")
        doc_id, inner, coded = rows["doc_id"].slice(0, 1).combine_chunks(), rows["inner"].to_pylist(), rows["ids"].to_pylist()
        if any(inner):
            ids = np.array(tree([(goes_on, np.frombuffer(raw, "<u4").tolist()) for goes_on, raw in zip(inner, coded, strict=True)], own), "<u4").tobytes()
        else:  # all leaves meet at word boundaries
            ids = b"".join(coded)
        return pa.Table.from_batches([finish(doc_id, [ids], own)])

    leaf_schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("kind", pa.string()), ("inner", pa.bool_()), ("content", pa.string())])
    coded_schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("inner", pa.bool_()), ("ids", pa.binary())])
    is_long = F.length("text") > long_chars
    short = docs.filter(~is_long).mapInArrow(whole, schema)
    cut_rows = docs.filter(is_long).withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, "row long, doc_id long, n long, kind string, inner boolean, content string")
    coded = cut_rows.repartition("row", "n").mapInArrow(encode_leaves, "row long, doc_id long, n long, inner boolean, ids binary")
    return short.unionAll(coded.groupBy("row").applyInArrow(joined, schema))


def digests(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encoded rows."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(path)
        for batch in batches:
            yield _digested(batch.column("doc_id"), batch.column("ids").to_pylist(), own)

    return encoded.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
