import random
import zlib
from itertools import combinations

import numpy as np

from llm import language, quality, toxicity
from llm.common import table

SF = "/root/testdata/sf0.01"


def held_out(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def test_factorisation_identity_matches_all_pairs():
    own = np.random.default_rng(1)
    model = quality.Model(0.3, own.normal(size=30), own.normal(size=(30, 4)))
    columns, x = np.array([2, 5, 11, 29]), own.normal(size=4)
    plain = 0.3 + model.linear[columns] @ x + sum((model.factors[columns[a]] @ model.factors[columns[b]]) * x[a] * x[b] for a, b in combinations(range(4), 2))
    assert np.isclose(model.raw(columns, x), plain)


def test_quality_of_held_out_documents(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == held_out(r.doc_id, 5, 0) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in own) >= 0.95 * len(own)


def test_quality_of_odd_tables(messy, labels):
    empty = labels([])
    rows = quality.classify(messy, empty).collect()
    assert len(rows) == messy.count() and {r.score for r in rows} == {0.5} and {r.predicted for r in rows} == {1}
    kept = quality.keep_good(messy, labels([(3, 1, 0), (5, 0, 1), (2, 0, None), (None, 1, 1), (99, 1, 1)]))
    assert kept.columns == messy.columns
    assert quality.classify(messy.limit(0), empty).count() == 0


def test_language_of_held_out_documents(spark):
    docs = table(spark, SF, "documents")
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = language.identify(docs).collect()
    own = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == held_out(r.doc_id, 3, 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in own) >= 0.98 * len(own)


def test_language_of_odd_tables(messy, docs):
    rows = language.identify(messy).collect()
    assert len(rows) == messy.count() and {r.lang_pred for r in rows} == {"en", "und"}
    assert {r.lang_pred for r in language.identify(docs([(1, None), (2, "12 !?"), (4, ""), (7, "½ ² ③ _")])).collect()} == {"und"}
    assert language.identify(messy.limit(0)).count() == 0


def test_far_texts_are_rejected():
    own = random.Random(2)
    word = lambda letters: "".join(own.choice(letters) for _ in range(5))
    text = lambda letters: " ".join(word(letters) for _ in range(80))
    model = language.fit([(name, language.grams(text(letters))) for name, letters in (("a", "abcde"), ("b", "vwxyz")) for _ in range(30)])
    names, scores, rejected = model.predict([text("abcde"), text("vwxyz"), text("klmnop"), None, "..."])
    assert names[:2] == ["a", "b"] and names[3:] == ["und", "und"] and scores[3:] == [0.0, 0.0]
    assert rejected == [False, False, True, False, False]


def plain_kernel(s, t, n, decay):
    """Sum over pairs of equal subsequences, by enumeration."""
    total = 0.0
    for i in combinations(range(len(s)), n):
        for j in combinations(range(len(t)), n):
            if [s[k] for k in i] == [t[k] for k in j]:
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_subsequence_kernel_matches_enumeration():
    pairs = [("^idiot$", "idiot$"), ("^i1d2iot$", "^idiot"), ("abcabc", "cab"), ("aaaa", "aaa"), ("xyz", "abc")]
    got = toxicity.subsequence_kernel(toxicity.coded([a for a, _ in pairs], 24), toxicity.coded([b for _, b in pairs], 6))
    assert np.allclose(got, [plain_kernel(a, b, toxicity.LENGTH, toxicity.DECAY) for a, b in pairs], rtol=1e-4)


def test_spaced_letters_are_joined():
    assert "idiot" in toxicity.units("you i d i o t, really") and "idiot" in toxicity.units("i-d-i-o-t")
    assert all(len(x) <= toxicity.LONGEST for x in toxicity.forms("x" * 500))


def test_toxicity_tolerates_gaps_and_insertions(docs, labels):
    own = random.Random(3)
    word = lambda: "".join(own.choice(("ta", "ne", "sho", "li", "re", "um")) for _ in range(own.randrange(1, 4)))
    rows, marked = [], []
    for i in range(240):
        words = [word() for _ in range(40)]
        if i % 4 == 0:
            words[5] = words[25] = own.choice(("blockhead", "dumbcluck"))
        rows.append((i, " ".join(words)))
        marked.append((i, 1, int(i % 4 == 0)))
    clean = " ".join(word() for _ in range(40))
    odd = {1001: "blo.ckhead", 1002: "b l o c k h e a d", 1003: "bloxckhead", 1004: "Dumbcluck!!", 1005: "umrene"}
    rows += [(i, f"{clean} {x} {clean} {x}") for i, x in odd.items()] + [(2000, None), (2001, ""), (None, clean)]
    out = {r.doc_id: r for r in toxicity.score(docs(rows), labels(marked)).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out.values())
    assert sum(out[i].predicted == t for i, _, t in marked) >= 0.98 * len(marked)
    assert [out[i].predicted for i in sorted(odd)] == [1, 1, 1, 1, 0]
    assert out[2000].predicted == out[2001].predicted == out[None].predicted == 0


def test_toxicity_of_odd_tables(messy, labels):
    rows = toxicity.score(messy, labels([])).collect()
    assert len(rows) == messy.count() and {r.score for r in rows} == {0.5}
    assert toxicity.score(messy.limit(0), labels([(1, 1, 1)])).count() == 0
