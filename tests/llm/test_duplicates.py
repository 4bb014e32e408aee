import hashlib
import random
import re
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from llm import components, imatch, simhash, substrings

from .conftest import by_row


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 4]), 42) for k in range(max(1, len(words) - 3))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def groups(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(nodes), 2):
        if linked(a, b):
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {n: find(n) for n in nodes}


def test_simhash_matches_its_definition():
    own = random.Random(1)
    for text in [None, "", " ", "One", "a b c", "a b c d", "É É A a", *(" ".join(own.choice("abcdé") * own.randrange(1, 3) for _ in range(n)) for n in (5, 40, 600))]:
        assert simhash.simhash(text) == plain_simhash(text)


@pytest.mark.parametrize("tile", [simhash.TILE, 6])
def test_links_connect_all_near_fingerprints(spark, tile):
    own = random.Random(5)
    prints = {own.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:12]:  # chains and dense groups around some
        for _ in range(14):
            for bit in own.sample(range(64), own.randrange(1, 4)):
                p ^= 1 << bit
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = components.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), tile))
    got = {r.node: r.root for r in found.collect()}
    want = groups(signed, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 4)
    assert {p: got.get(p, p) for p in signed} == want


def test_near_duplicates(docs, messy):
    text = " ".join(f"w{k}" for k in range(400))
    rows = [(9, text), (4, text.replace("w7 ", "v7 ")), (2, text.upper()), (11, "quite another text of some words"), (12, ""), (13, None), (None, text)]
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(rows)).collect()}
    ids = {i: plain_simhash(t) for i, t in rows}
    assert {i: p for i, (p, _) in out.items()} == {i: f"{p:016x}" for i, p in ids.items()}
    numbered = [i for i in ids if i is not None]
    assert {i: c for i, (_, c) in out.items() if i is not None} == groups(numbered, lambda a, b: (ids[a] ^ ids[b]).bit_count() <= 4)
    assert out[None][1] == 2 and out[12][1] == out[13][1] == 12
    assert simhash.near_duplicates(messy).count() == messy.count()
    assert simhash.near_duplicates(messy.limit(0)).count() == 0


def test_keep_one_keeps_whole_rows(docs, messy):
    text = " ".join(f"w{k}" for k in range(400))
    rows = docs([(9, text), (4, text), (4, text), (None, text), (5, "alone here in this table"), (None, None)])
    kept = simhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert by_row(kept, "doc_id", "text") == by_row(docs([(4, text), (5, "alone here in this table"), (None, None)]), "doc_id", "text")
    assert simhash.keep_one(messy.limit(0)).count() == 0
    assert simhash.keep_one(messy).count() == len({plain_simhash(r.text) for r in messy.collect()})


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)] + [(200, 200), (300, 301)], "a long, b long")
    got = {r.node: r.root for r in components.components(chain).collect()}
    assert got == {**dict.fromkeys(range(71), 0), 300: 300, 301: 300}


def removed(rows, window):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    key = lambda i: 1 << 70 if i is None else i
    first = {}
    for i, w in words:
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            first[s] = min(first.get(s, key(i)), key(i))
    out = []
    for i, w in words:
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < key(i) for j in range(window)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("cells", [1 << 9, 1 << 22])
def test_repeated_windows_are_removed(docs, cells, monkeypatch):
    monkeypatch.setattr(substrings, "PENDING", 500)
    own = random.Random(2)
    passages = [[f"p{k}_{j}" for j in range(own.randrange(2, 30))] for k in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(own.randrange(5)):
            words += own.choice(passages) if own.random() < 0.6 else [f"u{i}_{own.randrange(9)}" for _ in range(own.randrange(20))]
        rows.append((own.randrange(40) if i % 9 else None, " ".join(words)))
    rows += [(50, "be " * 40), (51, "be " * 9), (49, "be " * 12 + "so"), (52, None), (53, "")]
    got = substrings.digests(substrings.remove(docs(rows).repartition(5), window=5, cells=cells))
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == removed(rows, 5)


def test_substrings_of_messy_and_empty(messy):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    got = substrings.digests(substrings.remove(messy, cells=1 << 20))
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == removed(rows, 13)
    assert substrings.remove(messy.limit(0), cells=1 << 20).count() == 0


def test_imatch_edits_and_likeness(docs):
    own = random.Random(4)
    word = lambda: own.choice("abcdefgh") + own.choice("aeiou") + str(own.randrange(30))
    rows = [(i * 37, " ".join(word() for _ in range(own.randrange(20, 300)))) for i in range(80)] + [(5000, ""), (5001, None), (5002, "É日 x")]
    rows.append((6001, rows[3][1]))
    out = {r.doc_id: r for r in imatch.compare(docs(rows)).collect()}
    lined = sorted(((i, t or "") for i, t in rows), reverse=True)
    for k, (i, text) in enumerate(lined):
        following = lined[(k + 1) % len(lined)][1]
        half = len(text) // 2
        assert out[i].n_chars == len(text)
        assert out[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + following[:half]).encode()).hexdigest()
        assert 0 <= out[i].near_edited <= 1 and 0 <= out[i].near_next <= 1
    assert out[6001].fingerprint == out[rows[3][0]].fingerprint != out[rows[4][0]].fingerprint
    assert sum(r.near_edited for r in out.values()) > 2 * sum(r.near_next for r in out.values())
    assert out[5001].near_next == 1.0  # two empty texts


def test_imatch_of_odd_tables(messy, docs):
    assert imatch.compare(messy).count() == messy.count()
    assert imatch.compare(messy.limit(0)).count() == 0
    (one,) = imatch.compare(docs([(8, "one row is its own next document")])).collect()
    assert one.near_next == 1.0
    same = imatch.compare(docs([(1, "same words here")] * 3)).select("near_edited", "near_next").collect()
    assert len(same) == 3 and all(r.near_next == 1.0 for r in same)
    far = imatch.compare(docs([(i, f"text {i}") for i in (-(2**62), -5, 0, 3, 2**62, 2**63 - 1)]))
    assert far.select(F.count_distinct("edited_sha256")).first()[0] == 5  # text 0 and text 3 both become textex
