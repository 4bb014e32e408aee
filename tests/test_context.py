import json

import pytest
from pyspark.sql import functions as F

import recordlake as rl

TWO = "---\ntitle: T\n---\n# Doc\n\n## One\nfirst\n```yaml\nid: task-1\nkind: a\n```\n## Two\nsecond\n```yaml\nid: task-2\nkind: a\n```\n"


def sections(df):
    return {(r["_note_file"], r["_pos"]): r["_section"] for r in rl.extract_records(df, sections=True).collect()}


def test_sections(corpus):
    got = sections(corpus(
        ("a.md", TWO),
        ("b.md", "## Section\n### Subsection\nDetail.\n```yaml\nk: 1\n```\n## Next Section\n"),
        ("c.md", "no headings\n```yaml\nk: 1\n```\n\n \t\u00a0\n"),
        ("d.md", "## Alpha\nSome text.\n### In\n## Beta\n```yaml\nk: 1\n```\n### Deeper\nx\n# Top\n"),
    ))
    assert got[("a.md", 0)] == "## One\nfirst\n```yaml\nid: task-1\nkind: a\n```"
    assert got[("a.md", 1)] == "## Two\nsecond\n```yaml\nid: task-2\nkind: a\n```"
    assert got[("b.md", 0)] == "### Subsection\nDetail.\n```yaml\nk: 1\n```"
    assert got[("c.md", 0)] == "no headings\n```yaml\nk: 1\n```"
    assert got[("d.md", 0)] == "## Beta\n```yaml\nk: 1\n```\n### Deeper\nx"


def test_context_both_ways(corpus):
    notes = corpus(("a.md", TWO), ("b.md", "---\nonly: fm\n---\n"), ("c.typ", "```yaml\nk: 5\n```"), ("d.md", "text"))
    direct = {(r["_note_file"], r["_pos"]): r["context"] for r in rl.extract_with_context(notes).collect()}
    joined = {(r["_note_file"], r["_pos"]): r["context"] for r in rl.attach_context(rl.extract_records(notes), notes).collect()}
    assert direct == joined
    assert direct[("a.md", 1)].startswith("---\ntitle: T\n---\n\n## Two\nsecond")
    assert direct[("b.md", -1)] == "---\nonly: fm\n---"


def test_context_falls_back_to_form(corpus, records):
    rows = records({"_note_file": "/n/i.jsonl", "a": 1}, {"_note_file": "/n/gone.md", "b": "x"})
    got = [r["context"] for r in rl.attach_context(rows, corpus(("/n/other.md", "x"))).orderBy("_pos").collect()]
    assert got == ["a  1.0\n\nsource  /n/i.jsonl", "b  x\n\nsource  /n/gone.md"]


@pytest.mark.parametrize(
    "record, position",
    [
        ({"id": "task-1"}, 0), ({"id": "task-2", "kind": "wrong"}, 1), ({"id": "nope"}, None), ({"kind": "a"}, 0), ({}, None),
        ({"title": "T"}, None), ({"kind": "a", "_meta": 1, "gone": None, "title": "other"}, 0), ({"kind": "a", "extra": "x"}, None),
        ({"kind": "a", "absent": ""}, 0),
    ],
)
def test_locate(corpus, records, record, position):
    row = records({"_note_file": "a.md", **record}).drop("_pos")
    assert rl.locate_blocks(row, corpus(("a.md", TWO))).first()["_pos"] == position


def test_locate_ignores_frontmatter_id(corpus, records):
    note = "---\nid: doc\n---\n```yaml\nid: x\nkind: a\n```\n```yaml\nkind: b\n```\n"
    rows = records({"_note_file": "a.md", "id": "x", "kind": "b"}, {"_note_file": "a.md", "id": "x"})
    assert [r["_pos"] for r in rl.locate_blocks(rows, corpus(("a.md", note))).orderBy(F.size("fields")).collect()] == [None, 1]


def test_locate_numbers(corpus):
    notes = corpus(("a.md", "```yaml\nid: 5\nn: 1.5\n```\n```yaml\nn: 2.0\nok: true\n```\n"))
    found = rl.locate_blocks(rl.extract_records(notes).drop("_pos"), notes)
    assert sorted(r["_pos"] for r in found.collect()) == [0, 1]


DIGEST = """---
title: T
---

# Doc
prose

## Data

\t
```yaml
id: 1
```
more prose
```yaml
id: 2
```
## Tasks old
- dropped
## Tasks
- one
### Sub
- two

## End
x
"""


def test_digest(corpus):
    df = corpus(("a.md", DIGEST), ("b.md", "just prose\n"), ("c.md", "# H\ntext\n```yaml\na: 1\n"), ("d.md", "## Tasksy\n- no\n"), ("e.md", "## Tasks\r\n- yes\r\n"))
    got = {r["_note_file"]: r["digest"] for r in rl.compact_digest(df).collect()}
    assert got["a.md"] == (
        "---\ntitle: T\n---\n\n## Data\n```yaml\nid: 1\n```\n\n```yaml\nid: 2\n```\n\n## Tasks\n- one\n### Sub\n- two"
    )
    assert got["b.md"] == "" and got["d.md"] == ""
    assert got["c.md"] == "```yaml\na: 1\n"
    assert got["e.md"] == "## Tasks\r\n- yes"
    other = {r["_note_file"]: r["digest"] for r in rl.compact_digest(df, tasks_heading="End").collect()}
    assert other["a.md"].endswith("\n\n## End\nx")


def test_copies_of_a_note_do_not_multiply_records(corpus):
    notes = corpus(*[("a.md", TWO)] * 5, ("b.md", TWO))
    records = rl.extract_records(notes)
    assert records.count() == 12
    with_context = rl.attach_context(records, notes)
    assert with_context.count() == 12
    assert {r["context"] for r in with_context.collect()} == {r["context"] for r in rl.extract_with_context(notes).collect()}
    found = rl.locate_blocks(records.drop("_pos"), notes).groupBy("_pos").count().collect()
    assert {r["_pos"]: r["count"] for r in found} == {0: 6, 1: 6}


def test_both_ways_to_a_context_agree(corpus):
    """Empty blocks, blocks of comments or bad YAML, notes without blocks, without frontmatter and without either."""
    fence = lambda text: f"```yaml\n{text}```\n"
    parts = ["---\nk: 1\n---\n", "# A\ntext\n", fence(""), "## B\n", fence("id: 1\n"), fence("# only a comment\n"), "# C\n", fence("x: [\n")]
    notes = corpus(*[(f"{n:03}.md", "".join(p for i, p in enumerate(parts) if n >> i & 1)) for n in range(1 << len(parts))])
    records = rl.extract_records(notes)
    direct = {(r["_note_file"], r["_pos"]): r["context"] for r in rl.extract_with_context(notes).collect()}
    joined = {(r["_note_file"], r["_pos"]): r["context"] for r in rl.attach_context(records, notes).collect()}
    assert len(direct) > 150 and joined == direct


def test_blocks_are_found_by_their_rarest_value(corpus):
    """Many blocks with common values; names that only some blocks have; values that are empty text."""
    blocks = [{"a": i % 5, "b": i % 7, **({"c": "x"} if i % 3 else {}), **({"d": ""} if i % 4 == 0 else {})} for i in range(60)]
    text = "".join("```yaml\n" + "".join(f"{k}: {v if v != '' else chr(34) * 2}\n" for k, v in b.items()) + "```\n" for b in blocks)
    notes = corpus(("n.md", "---\nfm: 1\n---\n" + text), ("m.md", text))
    records = rl.extract_records(notes)

    def plain(tested):
        return next(i for i, b in enumerate(blocks) if all(str(b.get(k, "")) == str(v) for k, v in tested.items()))

    found = rl.locate_blocks(records.drop("_pos"), notes)
    for r in found.select("_pos", F.to_json("fields").alias("j")).collect():
        assert r["_pos"] == plain({k: v for k, v in json.loads(r["j"]).items() if k != "fm"})
    other = spark_records(corpus, [("n.md", 'd: ""'), ("n.md", 'z: ""'), ("n.md", "a: 9"), ("n.md", "a: 1\nzz: 1"), ("x.md", "a: 1"), ("n.md", "fm: 1")])
    got = {r["n"]: r["_pos"] for r in rl.locate_blocks(other, notes).select("_pos", F.variant_get(F.col("fields")["_order"], "$", "int").alias("n")).collect()}
    assert got == {0: 0, 1: 0, 2: None, 3: None, 4: None, 5: None}


def spark_records(corpus, rows):
    """Records that claim to be from a note, in order."""
    made = rl.extract_records(corpus(*[(f"{i}.md", f"---\n_order: {i}\n{t}\n---\n") for i, (_, t) in enumerate(rows)]))
    source = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(rows) for x in (f"{i}.md", n)])
    return made.orderBy("_note_file").withColumn("_note_file", source[F.col("_note_file")])


def test_locating_blocks_broadcasts_nothing(corpus):
    """Notes are much larger than the tables they are made of, so Spark's guess of their size must not bring them to the driver."""
    notes = corpus(("a.md", TWO), ("b.md", '---\nk: 1\n---\n```yaml\nn: 1\n```\n```yaml\nn: 2\ne: ""\n```\n'))
    found = rl.locate_blocks(rl.extract_records(notes).drop("_pos"), notes)
    assert sorted(r["_pos"] for r in found.collect() if r["_note_file"] == "b.md") == [0, 1]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
