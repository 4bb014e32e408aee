import hashlib
import random
import re

from llm import decontaminate, pii, simhash

from .conftest import by_row

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    each = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in each) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_match_the_plain_patterns(docs):
    own = random.Random(6)
    pieces = ["a", "B.c", "@", "@x.org", "%", ".", "-", " ", "  ", "+", "(", ")", "0", "1.2.3.4", "255", "007", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "+1 (555) 010-9999", "é", "日", "🙂", "x@y", "\n"]
    rows = [(i, "".join(own.choice(pieces) for _ in range(own.randrange(1, 25)))) for i in range(400)]
    rows += [(1000, "a" * 20_000), (1001, "1" * 20_000), (1002, "1 " * 20_000), (1003, "+1 " + "(" * 20_000), (1004, "a@b.c%d@e.f " * 900), (1005, None), (1006, "")]
    out = {r.doc_id: r for r in pii.detect(docs(rows), {}).collect()}
    for i, text in rows:
        spans = base_spans(text)
        assert out[i].base_sha256 == hashlib.sha256(joined(spans).encode()).hexdigest(), text
        assert out[i].spans == joined(spans)
        assert (out[i].n_email, out[i].n_ip, out[i].n_card, out[i].n_phone) == tuple(sum(s[0] == k for s in spans) for k in PATTERNS)


def test_weak_supervision_adds_what_labelers_agree_on(docs):
    own = random.Random(7)
    number = lambda: f"({own.randrange(200, 999)}) {own.randrange(200, 999)}-{own.randrange(1000, 9999)}"
    rows = [(i, f"please call {number()} or mail user{i}@mail.example.com today") for i in range(60)]
    rows += [(100 + i, f"invoice {own.randrange(10**8, 10**9)} for 12 items, order {own.randrange(10**8, 10**9)} kg") for i in range(60)]
    rows += [(300, "masked: write to jane.doe (at) mail (dot) org now"), (301, "phone (415) 555-0134 please"), (302, "invoice 123456789 only")]
    out = {r.doc_id: r for r in pii.detect(docs(rows)).collect()}
    assert sum(out[i].n_added for i in range(60)) >= 55
    assert sum(out[100 + i].n_added for i in range(60)) == 0 and out[302].n_added == 0
    assert out[301].spans == "phone:6:20"
    for i, text in rows:
        assert joined(base_spans(text)) == ",".join(s for s in out[i].spans.split(",") if s in joined(base_spans(text)).split(","))


def test_mask_keeps_rows_and_replaces_spans(messy, docs):
    rows = docs([(1, "mail a@b.org, call +1 555 010 9999."), (2, None), (3, ""), (4, "clean"), (5, "9@x.org " * 200), (6, "🙂 1.2.3.4é1.2.3.5")])
    out = pii.mask(rows, {})
    assert out.columns == rows.columns
    assert by_row(out, "doc_id", "text") == [(1, "mail <EMAIL>, call <PHONE>."), (2, None), (3, ""), (4, "clean"), (5, "<EMAIL> " * 200), (6, "🙂 <IP>é<IP>")]
    assert pii.mask(messy).count() == messy.count() and pii.detect(messy).count() == messy.count()
    assert pii.detect(messy.limit(0)).count() == 0 and pii.mask(messy.limit(0)).count() == 0


ITEM = "A train leaves Boston at 9:30 and travels 120 km in 2 hours, how many km does it travel in 5 hours?"
AGAIN = "A train leaves Denver at 7:15 and travels 300 km in 4 hours, how many km does it travel in 9 hours?"
MIXED = "a b c 4 d 4 e f 4 g h"


def benchmark(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "item_id long, text string, doc_id int")


def test_templates_find_exact_and_changed_questions(spark, docs):
    items = benchmark(spark, [(1, ITEM), (2, "short"), (3, None), (4, ""), (5, MIXED), (1, ITEM)])
    filler = " ".join(f"w{k}" for k in range(50))
    rows = docs([(10, f"{filler} {ITEM} {filler}"), (11, f"{filler}. {AGAIN}"), (12, filler), (13, None), (14, ""), (15, " ".join(ITEM.split()[:9])), (16, "short"), (17, MIXED.replace("4", "7")), (18, "a b c 4 d 5 e f 6 g h"), (None, ITEM)])
    found = decontaminate.matches(rows, items)
    assert by_row(found, "doc_id", "item_id") == [(10, 1), (11, 1), (16, 2), (17, 5), (None, 1)]  # 18: one slot value stands for three
    kept = decontaminate.keep_clean(rows, items)
    assert kept.columns == rows.columns and [r[0] for r in by_row(kept, "doc_id")] == [12, 13, 14, 15, 18]


def test_plain_passages_match_brute_force(spark, docs):
    own = random.Random(8)
    word = lambda: own.choice("abcdef") + own.choice("ghij") + own.choice("klm")
    items = [(k, " ".join(word() for _ in range(own.randrange(6, 25)))) for k in range(12)]
    rows = []
    for i in range(80):
        words = items[own.randrange(12)][1].split()
        words = words[own.randrange(3) :][: own.randrange(3, 30)]
        rows.append((i, " ".join([word() for _ in range(own.randrange(9))] + words + [word() for _ in range(own.randrange(9))])))
    grams = lambda t: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)}
    want = sorted((i, k) for i, t in rows for k, x in items if len(grams(x) & grams(t)) >= 0.8 * len(grams(x)))
    assert want and by_row(decontaminate.matches(docs(rows), benchmark(spark, items)), "doc_id", "item_id") == want


def test_copies_are_found_whatever_their_case_blanks_and_place(spark, docs):
    items = benchmark(spark, [(1, ITEM), (2, "two plus two is"), (3, "alone")])
    filler = " some filler words of a plain kind that say nothing at all "
    copies = [ITEM, ITEM.lower(), ITEM.upper(), ITEM.replace(" ", "  "), ITEM.replace(" ", "\n"), AGAIN]
    rows = [(i, filler + x + filler) for i, x in enumerate(copies)] + [(20, f"{filler} Two plus  two is {filler}"), (21, filler), (22, "alone"), (23, "not alone")]
    found = decontaminate.matches(docs(rows), items)
    assert by_row(found, "doc_id", "item_id") == [(i, 1) for i in range(len(copies))] + [(20, 2), (22, 3)]


def test_one_changed_value_does_not_hide_a_copy(spark, docs):
    middle = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(92))
    items = benchmark(spark, [(1, f"the 5 cats {middle} the 5 dogs")])
    rows = docs([(1, f"the 5 cats {middle} the 6 dogs"), (2, f"the 6 cats {middle} the 6 dogs"), (3, f"the 7 cats {middle} the 6 dogs")])
    found = decontaminate.matches(rows, items)
    assert by_row(found, "doc_id", "n_matched", "n_windows") == [(1, 94, 94), (2, 94, 94), (3, 90, 94)]


def plain_templates(text):
    """Words and template words of a text of plain words, numbers and names, by rule."""
    words = text.split()
    typed = ["<num>" if w.isdigit() else "<name>" if w[0].isupper() and k else w.lower() for k, w in enumerate(words)]
    return [w.lower() for w in words], typed


def plain_matches(doc, item, size=5):
    """Distinct windows of the item that the document holds, slots checked by diagonal."""
    (own, own_typed), (words, typed) = plain_templates(doc), plain_templates(item)
    at = {}
    for j in range(len(words) - size + 1):
        at.setdefault(tuple(words[j : j + size]), j)
    held = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}
    done, diagonals = {w for w in at if w in held}, {}
    for w, j in at.items():
        for i in range(len(own) - size + 1):
            if w not in done and own_typed[i : i + size] == typed[j : j + size]:
                hit = diagonals.setdefault(i - j, (set(), set()))
                hit[0].add(w)
                hit[1].update((words[j + k], own[i + k]) for k in range(size) if typed[j + k][0] == "<")
    for windows, pairs in diagonals.values():
        if len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
            done |= windows
    return len(done), len(at)


def test_templates_and_slots_match_brute_force(spark, docs):
    own = random.Random(12)
    word = lambda: own.choice(["sun", "tree", "river", "stone", "bird", "cloud", "road", "house"])
    slot = lambda: own.choice(["17", "4", "250", "Anna", "Paul", "Mira"])
    text = lambda n: " ".join(slot() if k % 4 == 2 else word() for k in range(n))
    items = [(k, text(own.randrange(6, 20))) for k in range(8)]
    rows = []
    for i in range(60):
        words = items[own.randrange(8)][1].split()
        if i % 3:
            swap = {v: slot() for v in words if v.isdigit() or v[0].isupper()}
            words = [swap.get(w, w) if i % 3 == 1 else slot() if w in swap else w for w in words]
        rows.append((i, " ".join([word() for _ in range(1 + i % 4)] + words + [word() for _ in range(i % 5)])))
    want = []
    for i, doc in rows:
        for k, item in items:
            n, total = plain_matches(doc, item)
            if n >= 0.8 * total:
                want.append((i, k, n, total))
    found = decontaminate.matches(docs(rows), benchmark(spark, items))
    assert len(want) > 20 and by_row(found, "doc_id", "item_id", "n_matched", "n_windows") == sorted(want)


def test_rows_keep_columns_named_like_those_used_inside(spark):
    names = "own no_id of_text row _own _of_text _text _base _all _chars key place".split()
    rows = spark.createDataFrame([(1, "mail a@b.org now please do", *names), (2, ITEM, *names), (None, "mail a@b.org now please do", *names)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    items = benchmark(spark, [(1, ITEM)])
    for out, n in ((decontaminate.keep_clean(rows, items), 2), (pii.mask(rows, {}), 3), (simhash.keep_one(rows), 2)):
        got = out.collect()
        assert out.columns == rows.columns and len(got) == n and all([r[c] for c in names] == names for r in got)


def test_decontamination_of_messy_and_empty(spark, messy):
    items = benchmark(spark, [(1, "a b c d e f g h"), (2, "x y z")])
    assert by_row(decontaminate.matches(messy, items), "doc_id", "item_id") == [(3, 1)]
    assert decontaminate.matches(messy, items.limit(0)).count() == decontaminate.matches(messy.limit(0), items).count() == 0
    assert decontaminate.keep_clean(messy, items.limit(0)).count() == messy.count()
