"""Spelling variants, url filter and phrases against plain versions of the same rules."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from llm import phrases, urls, variants

from .conftest import by_row

RUN = re.compile("[A-Za-z\u00c0-\u00ff]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_vocabulary(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in RUN.findall((text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w], None if form[w] is None else n[form[w]], root(w)) for w in n)


COLUMNS = ("word", "n", "n_near", "form", "form_n", "root")


def test_variants_match_brute_force(docs):
    own = random.Random(21)
    base = ["".join(own.choice("abÉé") for _ in range(own.randrange(6, 9))) for _ in range(6)]

    def changed(w):
        i = own.randrange(len(w))
        return own.choice([w[:i] + w[i + 1 :], w[:i] + own.choice("abé") + w[i:], w[:i] + own.choice("abé") + w[i + 1 :]])

    words = base + [changed(w) for w in base for _ in range(4)]
    words += [changed(w) for w in words]
    rows = [(i, " ".join(own.choices(words, weights=[60] * 6 + [6] * 24 + [1] * 30, k=60)).title()) for i in range(60)] + [(None, "abcdef " * 7), (None, None), (7, "")]
    want = plain_groups(plain_vocabulary(rows))
    got = by_row(variants.group(variants.vocabulary(docs(rows))), *COLUMNS)
    assert len(want) > 30 and any(r[3] for r in want) and got == sorted(want, key=lambda r: tuple((x is None, x) for x in r))


def test_chains_of_forms_and_ties(spark):
    n = {"aaaaaa": 10_000, "aaaaab": 1000, "aaaabb": 100, "aaabbb": 20, "aabbbb": 4, "zzzzzz": 9, "zzzzzy": 50, "zzzzzx": 50, "x" * 20_000: 5, "x" * 19_999: 25}
    table = spark.createDataFrame(list(n.items()), "word string, n long")
    assert by_row(variants.group(table), *COLUMNS) == sorted(plain_groups(n), key=lambda r: tuple((x is None, x) for x in r))


def test_neighbourhoods_hold_every_edit_once():
    own, size = random.Random(5), 4
    for n in (1, 2, 6):
        rows = np.array([[own.randrange(1, size + 1) for _ in range(n)] for _ in range(20)], np.uint64)
        at, keys = variants.neighbourhoods(rows, size)
        for k, row in enumerate(rows.tolist()):
            want = {tuple(row)}
            for i in range(n + 1):
                want |= {tuple(row[:i] + [s] + row[i:]) for s in range(1, size + 1)}
                want |= {tuple(row[:i] + [s] + row[i + 1 :]) for s in range(1, size + 1) if i < n} | {tuple(row[:i] + row[i + 1 :])}
            hashes = [int(variants.own_keys(np.array([x], np.uint64).reshape(1, -1))[0]) for x in want]
            assert sorted(keys[at == k].tolist()) == sorted(set(hashes)) and len(set(hashes)) == len(want)


def test_variants_of_odd_tables(messy):
    got = by_row(variants.group(variants.vocabulary(messy)), *COLUMNS)
    assert got == []
    assert variants.group(variants.vocabulary(messy, min_letters=4)).select("word").first()["word"] == "word"
    assert variants.group(variants.vocabulary(messy.limit(0))).count() == 0


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", "r", "v", 1) for i, u in rows], "page_id long, url string, html string, rule string, host string, score int")


RULED = [
    ("http://A.example.net/en/x?q", "a.example.net", "/en/x", "example.net/en/", "allow"),
    ("http://example.net/EN/x", "example.net", "/EN/x", "net/", "block"),
    ("https://x.NET/", "x.net", "/", "net/", "block"),
    ("https://b.example.com/de/1#f", "b.example.com", "/de/1", "example.com/de/", "block"),
    ("https://u.org/fr/?x", "u.org", "/fr/", "org/fr/", "allow"),
]
FREE = [("http://x.net", "x.net", ""), ("http://x.net?a/b", "x.net", ""), ("http://notexample.com/de/1", "notexample.com", "/de/1"), ("u.org/fr/1", "", ""), (None, "", ""), ("", "", ""), ("://", "", ""), ("a://b://c/d", "b:", "//c/d")]


def test_hosts_paths_and_rules(spark):
    rows = [(i, r[0]) for i, r in enumerate(RULED)] + [(100 + i, r[0]) for i, r in enumerate(FREE)]
    out = {r.page_id: r for r in urls.judge(pages(spark, rows)).collect()}
    assert len(out) == len(rows)
    for i, (_, host, path, rule, verdict) in enumerate(RULED):
        assert (out[i].host, out[i].path, out[i].rule, out[i].verdict, out[i].score) == (host, path, rule, verdict, None)
    for i, (_, host, path) in enumerate(FREE):
        assert (out[100 + i].host, out[100 + i].path, out[100 + i].rule) == (host, path, None) and out[100 + i].verdict in ("allow", "block")


def plain_judge(labelled, asked):
    """Scores and threshold by a direct version of both models.  labelled: text -> (verdict, n)."""
    windows = lambda t: [(t[max(0, i - urls.ORDER) : i], t[i]) for i in range(1, len(t))]
    marked = lambda t: urls.START + t + urls.END
    held = {t for t in labelled if zlib.crc32(t.encode()) % urls.HELD_OUT == 0}
    models = {"allow": Counter(), "block": Counter()}
    for t, (verdict, n) in labelled.items():
        for context, c in [] if t in held else windows(marked(t)):
            for k in range(len(context) + 1):
                models[verdict][context[len(context) - k :], c] += n

    def p(model, context, c):
        out = 1 / urls.ALPHABET
        for k in range(len(context) + 1):
            end = context[len(context) - k :]
            after = [n for (x, _), n in model.items() if x == end]
            if after:
                out = (model[end, c] + len(after) * out) / (sum(after) + len(after))
        return out

    def score(t):
        own = [round((math.log(p(models["allow"], *w)) - math.log(p(models["block"], *w))) * 1e6) for w in windows(marked(t))]
        return math.floor(sum(own) / len(own))

    bins = {}
    for t in held:
        pair = bins.setdefault(math.floor(score(t) / urls.GRID), [0, 0])
        pair[labelled[t][0] == "block"] += labelled[t][1]
    a, r = (sum(p[i] for p in bins.values()) for i in (0, 1))
    lost = lambda b: sum(p[0] for x, p in bins.items() if x < b) * r + sum(p[1] for x, p in bins.items() if x >= b) * a
    limit = min(((lost(b), abs(b), b) for b in bins), default=(0, 0, 0))[2] * urls.GRID if a and r else 0
    return {t: (score(t), "allow" if score(t) >= limit else "block") for t in asked}


def test_models_match_a_direct_version(spark):
    own = random.Random(4)
    host = lambda good: "".join(own.choice("abcd" if good else "wxyz") for _ in range(4))
    labelled, rows = {}, []
    for i in range(60):
        good = i % 2 == 0
        h, path = f"{host(good)}.org" if good else f"{host(good)}.net", "/fr/" if good else "/q"
        rows += [f"http://{h}{path}"] * (1 + i % 3)
        labelled[h + path] = ("allow" if good else "block", rows.count(f"http://{h}{path}"))
    asked = [f"{host(i % 2)}.com/{i}" for i in range(20)]
    rows += [f"http://{t}" for t in asked] + [None]
    got = {r.host + r.path: (r.score, r.verdict) for r in urls.judge(pages(spark, list(enumerate(rows)))).collect() if r.rule is None}
    want = plain_judge(labelled, [*asked, ""])
    assert got == want
    good, bad = ([want[t][0] for i, t in enumerate(asked) if i % 2 == k] for k in (1, 0))
    assert min(good) > max(bad)


def test_urls_of_odd_tables(spark):
    assert urls.judge(pages(spark, [])).count() == 0
    one = urls.judge(pages(spark, [(None, None), (None, None), (1, "http://q.com/")])).collect()
    assert [(r.verdict, r.score) for r in one] == [("allow", 0)] * 3  # nothing is labelled
    many = pages(spark, [(3, "http://q.net/")] * 500 + [(3, "http://" + "a" * 5000 + ".com/")] + [(4, "http://q.com/x")] * 500)
    assert urls.judge(many).count() == 1001
    kept = urls.keep_allowed(pages(spark, [(1, "http://a.org/fr/"), (2, "http://a.net/")]))
    assert kept.columns == many.columns and [r.url for r in kept.collect()] == ["http://a.org/fr/"]


def plain_phrases(rows, max_words, min_count, top):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang or "und"] += len(words)
            for k in range(1, max_words + 1):
                counts.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {x: n for x, n in counts.items() if n >= min_count}
    out = []
    for (lang, w), a in found.items():
        if len(w) < 2:
            continue
        if any(other == lang and len(v) > len(w) and n >= a and any(v[i : i + len(w)] == w for i in range(len(v))) for (other, v), n in found.items()):
            continue
        score, _, l, r = min((1000 * a * totals[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, l, r, totals[lang], score))
    ranked = []
    for lang in totals:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))[:top]
        ranked += [(lang, i + 1, *x[1:]) for i, x in enumerate(own)]
    return sorted(ranked)


def text_rows(seed, n, letters="abcde"):
    own = random.Random(seed)
    word = lambda: own.choice(letters) * own.randrange(1, 3)
    passage = " ".join(word() for _ in range(40))
    rows = []
    for _ in range(n):
        parts = [word() + own.choice([" ", " ", "  ", "\t", ", ", ".\n", "!"]) for _ in range(own.randrange(60))]
        parts.insert(own.randrange(len(parts) + 1), passage + " " if own.random() < 0.4 else "")
        rows.append(("".join(parts).title() if own.random() < 0.2 else "".join(parts), own.choice(["en", "de", None])))
    return rows


PHRASE = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@pytest.mark.parametrize(("trigger", "longest"), [(3, 1024), (5, 7), (10**9, 9)])
def test_phrases_match_brute_force(spark, trigger, longest):
    rows = text_rows(trigger, 60) + [("É É é É\x0bé É", "en"), (None, "en"), ("", None), ("a\u00a0b a\u00a0b", "und")]
    df = spark.createDataFrame([(t, x, 1, "c") for t, x in rows], "text string, lang string, n int, phrase string")
    got = sorted(tuple(r[c] for c in PHRASE) for r in phrases.collocations(df, min_count=6, top=25, trigger=trigger, longest=longest).collect())
    want = plain_phrases(rows, 5, 6, 25)
    assert got == want and len(want) > 50


def test_counting_in_parts_gives_the_same(spark):
    rows = text_rows(9, 40)
    chunks = phrases.dictionary(spark.createDataFrame(rows, "text string, lang string"), trigger=4).persist()
    whole = by_row(phrases.frequencies(chunks, min_count=5), "k", "lang", "phrase", "n")
    assert by_row(phrases.frequencies(chunks, min_count=5, held=7), "k", "lang", "phrase", "n") == whole and len(whole) > 100


def test_repeated_passages_share_chunks(spark):
    passage = " ".join(f"w{k * k % 97}" for k in range(600))
    df = spark.createDataFrame([(f"start{i} " * (i + 1) + passage, "en") for i in range(20)], "text string, lang string")
    chunks = phrases.dictionary(df, trigger=8).collect()
    assert sum(c.freq for c in chunks) > 4 * len(chunks)
    assert sum(c.freq * c.n_words for c in chunks) == sum(600 + i + 1 for i in range(20))


def test_phrases_of_odd_tables(messy):
    out = phrases.collocations(messy).collect()
    assert {(r.lang, r.phrase, r.a, r.n >= 30_000) for r in out} == {("en", " ".join(["word"] * k), 30_001 - k, True) for k in range(2, 6)}
    assert phrases.collocations(messy.limit(0)).count() == 0
