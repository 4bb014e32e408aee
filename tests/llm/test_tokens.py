import hashlib
import random
import zlib

import numpy as np
import pytest

from llm import bpe, wavelet
from llm.tokens import default_path, encoder

from .conftest import by_row

ALPHABET = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "日", ".", ",", "'s", "!", "12", "<|endoftext|>", "\xa0", "\x1c"]


def reference(text):
    own = encoder(default_path()).tokenizer
    return own.encode(text or "", add_special_tokens=False).ids


def texts(n, size, seed=3):
    own = random.Random(seed)
    return ["".join(own.choice(ALPHABET) for _ in range(own.randrange(size))) for _ in range(n)]


def test_words_are_encoded_as_the_library_does():
    cases = ["", " ", "a", " a", "a ", "a \n b", "  a  b", *texts(600, 60)]
    got = encoder(default_path()).batch(cases)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [reference(t) for t in cases]


def test_small_table_of_words_gives_the_same_ids(monkeypatch):
    from llm import tokens

    monkeypatch.setattr(tokens, "KEPT_PIECES", 20)
    own = tokens.Encoder(default_path())
    cases = texts(100, 60)
    for at in range(0, 100, 10):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.batch(cases[at : at + 10])] == [reference(t) for t in cases[at : at + 10]]


@pytest.mark.parametrize("leaf_chars, leaf_bytes", [(1, 1), (8, 3), (40, 16)])
def test_tree_of_leaves_is_exact(leaf_chars, leaf_bytes):
    own, words = bpe.pieces(default_path()), encoder(default_path())
    for text in ["a" * 3000, "日本" * 700, "thetheand" * 300, " " * 900, *texts(150, 120)]:
        parts = []
        for kind, inner, content in bpe.leaves(text, own, leaf_chars, leaf_bytes):
            ids = np.frombuffer(words.batch([content])[0], "<u4").tolist() if kind == "text" else [i for p in content.split("\0") for i in own.encode(p)]
            parts.append((inner, ids))
        assert bpe.tree(parts, own) == reference(text)


def test_encode_long_and_short_texts(docs):
    rows = [(i, t) for i, t in enumerate(["", "short text", "a" * 2000, "word " * 500, "x1" * 700 + " tail", None])]
    out = bpe.round_trip(docs(rows), with_ids=True, long_chars=300, leaf_chars=100, leaf_bytes=64).collect()
    assert len(out) == len(rows)
    for r in out:
        text = rows[r.doc_id][1] or ""
        assert r.ids == reference(text) and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_encode_messy_and_empty(messy):
    texts_of = [r.text or "" for r in messy.collect()]
    got = bpe.round_trip(messy).collect()
    assert sorted(map(str, got)) == sorted(map(str, bpe.digests(bpe.encode(messy)).collect()))
    assert sorted(r.decoded_sha256 for r in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for t in texts_of)
    assert bpe.round_trip(messy.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 1, 511, 512, 1537])
def test_wavelet_matrix(n):
    own = np.random.default_rng(n)
    ids = own.integers(0, 9 if n % 2 else 50_257, n).astype("<u4")
    matrix = wavelet.WaveletMatrix.build(ids)
    assert (matrix.ids() == ids).all()
    if n:
        places = own.integers(0, n, 40)
        assert (matrix.access(places) == ids[places]).all()
        for token in {*ids[:5].tolist(), 1, 60_000}:
            at = np.flatnonzero(ids == token)
            assert matrix.occurrences(token).tolist() == at.tolist()
            assert matrix.count(token) == len(at) and matrix.rank(token, n // 2) == (at < n // 2).sum()
            if len(at):
                assert matrix.select(token, len(at) - 1) == at[-1]


def test_store_reads_back_in_order(spark, docs, tmp_path):
    rows = [(i, f"text {i} " * (i % 7)) for i in (5, 1, 9, 3, 30, 22, 14, 2, 41)]
    path = str(tmp_path / "store")
    wavelet.write(docs(rows), path, shard_tokens=20)
    shards = wavelet.read(spark, path)
    start, want = 0, []
    for i, t in sorted(rows):
        ids = np.array([*reference(t), 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert by_row(wavelet.documents(shards), "doc_id", "start", "n_tokens", "ids_crc32") == want
    token = reference(" text")[0]
    n = sum(reference(t).count(token) for _, t in rows)
    assert [tuple(r) for r in wavelet.token_counts(shards, [token]).collect()] == [(token, n)]
    places = sorted((i, k) for i, t in rows for k, x in enumerate(reference(t)) if x == token)
    assert by_row(wavelet.token_places(shards, token), "doc_id", "place") == places


def test_store_of_messy_and_empty(spark, messy, tmp_path):
    for name, df in (("m", messy), ("e", messy.limit(0))):
        wavelet.write(df, str(tmp_path / name))
        got = wavelet.documents(wavelet.read(spark, str(tmp_path / name))).collect()
        assert len(got) == df.count()
        assert sum(r.n_tokens for r in got) == sum(len(reference(r.text)) + 1 for r in df.collect())


def test_pieces_that_new_words_share_are_tokenised_once():
    from llm import tokens

    own, asked = tokens.Encoder(tokens.default_path()), []
    model = own.model
    own.model = type("Counting", (), {"tokenize": staticmethod(lambda piece: asked.append(piece) or model.tokenize(piece))})
    texts = ["one ab### cd### éf###", "two ab### gh###\nij###"]
    assert own.batch(texts) == own.direct(texts)
    assert "###" in asked and len(asked) == len(set(asked))


def test_batches_of_odd_texts_are_exact():
    from llm import tokens

    texts = ["", "a", " a", "a ", "a  b", "a\nb c", "l'été d'x don't", "<|endoftext|> a b<|endoftext|>", "日本語 テスト x\n\ny z", "Ġa Ġ b", "🙂 a🙂b x", "\n", "a\tb c", "a " + "x" * 60 + " b", "é è ê\nü ö"]
    for kept in (3, 400_000):
        own = tokens.Encoder(tokens.default_path(), kept)
        for _ in range(2):
            assert own.batch(texts) == own.direct(texts)
            assert own.batch([]) == [] and own.batch(texts[:1]) == own.direct(texts[:1])
        assert not any(len(w) > tokens.KEPT_LENGTH for w in own.kept)
