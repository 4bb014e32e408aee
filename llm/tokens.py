"""Exact encoding of whole texts by the tokenizers library, a word at a time.

A text may be cut before any space that stands between two characters that are no white space: the splitting pattern
joins a space only to what follows it, and looks no further back.  Encoded pieces between such cuts are kept in a
table of bounded size, so that repeated words cost a look-up.  Special tokens hold no space and are never cut.
"""

from __future__ import annotations

import re
from array import array
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

KEPT_PIECES = 400_000
KEPT_LENGTH = 48
_CUT = re.compile(r"(?<=\S)(?=\x20\S)")
_OTHER_SPACE = [c for c in map(chr, range(0x3001)) if c.isspace() and c != " "]
# Letters that every Unicode version since 3.2 knows as such, and signs but the apostrophe, which begins pieces of its own kind.
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ȳΑ-ΡΣ-ώА-яぁ-ゔァ-ヺ一-龥가-힣", "!-&(-/:-@\\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}0-9{_SIGNS}]+(?:\n[{_LETTERS}0-9{_SIGNS}]+)*")
_PIECE = re.compile(f" ?[{_LETTERS}]+| ?[0-9]+| ?[{_SIGNS}]+|\n")
_LOADED: dict[str, Encoder] = {}


def byte_names() -> dict[int, str]:
    """Byte-level vocabularies spell a byte as itself where it prints, else as the next character from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in printable}
    names.update({b: chr(0x100 + k) for k, b in enumerate(b for b in range(256) if b not in names)})
    return names


def _regular(text: str) -> bool:
    """Whether every space of a text stands between two characters that are no white space."""
    if not text or text[0].isspace() or text[-1].isspace() or "  " in text:
        return False
    others = _OTHER_SPACE[:9] if text.isascii() else _OTHER_SPACE
    return not any(c in text and (f" {c}" in text or f"{c} " in text) for c in others)


class Encoder:
    """Encodes with the tokenizer of one file.  Ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, pieces: int | None = None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = own = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.limit = pieces or KEPT_PIECES
        self.kept: dict[str, bytes] = {}
        self.model, self.names = own.model, byte_names()
        self.special = re.compile("|".join(re.escape(t.content) for t in own.get_added_tokens_decoder().values()) or "(?!)")
        # Only then are the pieces of plain words known without asking the tokenizer.
        self.byte_level = type(own.model) is BPE and own.normalizer is None and type(own.pre_tokenizer) is ByteLevel and own.pre_tokenizer.use_regex and not own.pre_tokenizer.add_prefix_space

    def direct(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it.

        Words of common letters, digits and signs are cut by the byte-level pattern here, all in one pass, and each different piece goes
        straight to the tokenizer's model; all others go through the whole tokenizer."""
        plain = [w for w in words if _PLAIN.fullmatch(w)] if self.byte_level else []
        if self.special.search(" ".join(plain)):
            plain = [w for w in plain if not self.special.search(w)]
        out: dict[str, bytes] = {}
        if plain:
            tokenize, names, of_token = self.model.tokenize, self.names, attrgetter("id")
            pieces = _PIECE.findall(" " + " ".join(plain))
            different = list(set(pieces))
            flat, ends = array("I"), [0]
            for piece in different:
                spelled = piece.replace(" ", "Ġ") if piece.isascii() and piece != "\n" else piece.encode().decode("latin-1").translate(names)
                flat.extend(map(of_token, tokenize(spelled)))
                ends.append(4 * len(flat))
            raw = flat.tobytes()
            ids = {piece: raw[a:b] for piece, a, b in zip(different, ends, ends[1:])}
            coded: list[bytes] = []
            for piece in pieces:
                if piece[0] == " ":  # only the first piece of a word has a space
                    coded.append(ids[piece])
                else:
                    coded[-1] += ids[piece]
            if len(plain) == len(words):
                return coded
            out.update(zip(plain, coded, strict=True))
        if rest := [w for w in words if w not in out]:
            out.update(zip(rest, self.direct([f" {w}" for w in rest]), strict=True))
        return [out[w] for w in words]

    def batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text.

        Arrow splits the texts, finds their different words and puts the ids of words together, so that Python meets a word once a batch."""
        firsts, rests, cut = [], [], []
        for text in texts:
            if _regular(text):
                first, blank, rest = text.partition(" ")
                firsts.append(first)
                rests.append(rest if blank else None)
                cut.append(None)
            else:
                cut.append(_CUT.split(text))
        lists = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        words = lists.values.dictionary_encode()
        different = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # many times faster than to_pylist
        # Kept under the word: its ids with a space before it.
        coded = list(map(self.kept.get, different))
        if missing := [w for w, ids in zip(different, coded, strict=True) if ids is None]:
            if len(self.kept) + len(missing) > self.limit:
                half = np.median(np.fromiter(map(len, self.kept), np.int64, len(self.kept))) if self.kept else 0
                self.kept = {w: ids for w, ids in self.kept.items() if len(w) < half}  # shorter words come more often
            new = self.words(missing)
            self.kept.update((w, ids) for w, ids in zip(missing, new, strict=True) if len(w) <= KEPT_LENGTH)
            found = iter(new)
            coded = [next(found) if ids is None else ids for ids in coded]
        offsets = np.concatenate(([0], np.cumsum(np.fromiter(map(len, coded), np.int64, len(coded)), dtype=np.int64)))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(coded), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(coded))])
        _, offsets, data = coded.take(words.indices).buffers()
        ends = np.frombuffer(offsets, np.int64)[lists.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        whole = list({x for part in (firsts, *filter(None, cut)) for x in part})
        others = dict(zip(whole, self.direct(whole), strict=True)) if whole else {}
        out, at = [], 0
        for parts in cut:
            if parts is None:
                out.append(b"".join((others[firsts[at]], data[ends[at] : ends[at + 1]])))
                at += 1
            else:
                out.append(b"".join(map(others.__getitem__, parts)))
        return out


def encoder(path: str, pieces: int | None = None) -> Encoder:
    """The worker's encoder for a file, kept between tasks; it keeps the ids of so many pieces."""
    if path not in _LOADED:
        _LOADED[path] = Encoder(path)
    _LOADED[path].limit = pieces or KEPT_PIECES
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")




def slices_of_text(texts: list[str], chars: int = 1 << 20):
    """Ranges of texts of about so many characters together, so that a task's memory doesn't follow the batch size."""
    at, held = 0, 0
    for i, text in enumerate(texts):
        if i > at and held + len(text) > chars:
            yield at, i
            at, held = i, 0
        held += len(text)
    if at < len(texts):
        yield at, len(texts)
