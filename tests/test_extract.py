import json
import random
import re

import pytest
import yaml
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import recordlake as rl
from recordlake.functions.patterns import FENCE
from recordlake.functions.text import is_note
from recordlake.functions.yaml_fields import flat_to_json, yaml_to_json
from recordlake.session import settings as session_settings
from recordlake.functions.yaml_text import yaml_text_to_json
from recordlake.operators.extract import extract_records
from recordlake.operators.presets import apply_presets, preset_condition
from recordlake.operators.sections import spans_of
from tests.conftest import as_dicts


@pytest.mark.parametrize(
    "path, kind",
    [
        ("log/dive.md", "markdown"), ("/v1.2/README", "markdown"), ("LOG.MARKDOWN", "markdown"), ("hdfs://h/q.Md", "markdown"),
        ("/t/sheet.typst", "typst"), ("/t/SHEET.Typ", "typst"), ("deep/er/rows.JSONL", "jsonl"), ("/t/scan.png", "other"), ("/t/q.md.bak", "other"), ("/t/.md", "markdown"),
    ],
)
def test_source_type(spark, path, kind):
    assert spark.range(1).select(rl.source_type(F.lit(path))).first()[0] == kind


def test_most_notes_need_no_pattern(spark):
    paths = [("/n/a.md",), ("/n/B.MD",), ("/n/.md",), ("/n/amd",), ("/n/c.md.bak",), ("/n/d.typ",), ("x.md\n",), (".md",), (None,)]
    found = spark.createDataFrame(paths, "p string").select("p", is_note(F.col("p")).alias("note"))
    assert [r["note"] for r in found.collect()] == [True, True, True, True, False, True, False, True, None]
    assert "EndsWith(" in found._jdf.queryExecution().executedPlan().toString()


def front(df):
    return {r["_note_file"]: (r["_frontmatter"], r["_body"]) for r in df.collect()}


def test_frontmatter(corpus):
    df = corpus(
        ("a.md", "---\nreef: outer\nvisits: 3\n---\nCoral."),
        ("b.md", "plain text\n\n---\nrule: above\n---\n"),
        ("c.md", "---\nx: 1---2\ny: 3"),  # ends mid-line
        ("d.md", "---\nnever: closed\n"),
        ("e.md", "------tail"),
        ("f.md", "----x"),
        ("g.md", "---\nlist: [1\n---\nCoral"),
    )
    got = front(rl.with_frontmatter(df))
    assert got["a.md"] == ("reef: outer\nvisits: 3", "\nCoral.")
    assert got["b.md"] == ("", "plain text\n\n---\nrule: above\n---\n")
    assert got["c.md"] == ("x: 1", "2\ny: 3")
    assert got["d.md"] == ("", "---\nnever: closed\n")
    assert got["e.md"] == ("", "tail")
    assert got["f.md"] == ("", "----x")
    assert got["g.md"] == ("list: [1", "\nCoral")
    keys = {r["_note_file"]: sorted(r["keys"]) for r in rl.frontmatter_keys(df).collect()}
    assert keys["a.md"] == ["reef", "visits"] and keys["b.md"] == [] and keys["g.md"] == []


def test_header_block(corpus):
    df = corpus(
        ("a.md", "Reef: outer\nVisits: 3\n\n \nCoral."),
        ("b.md", "Reef: inner\nseen from the boat\n\nCoral."),
        ("c.md", "only prose\n"),
        ("d.md", "---\nt: 1\n---\nReef: outer\n"),
        ("e.md", "Dive no.2-b : 7\nTime: 9:30\n"),
    )
    got = front(rl.with_frontmatter(df, header_block=True))
    assert got["a.md"] == ("Reef: outer\nVisits: 3", " \nCoral.")
    assert got["b.md"] == ("Reef: inner", "seen from the boat\n\nCoral.")
    assert got["c.md"] == ("", "only prose\n")
    assert got["d.md"] == ("t: 1", "\nReef: outer\n")
    assert got["e.md"] == ("Dive no.2-b : 7\nTime: 9:30", "")
    assert front(rl.with_frontmatter(df))["b.md"][0] == ""
    found = as_dicts(rl.extract_records(df, header_block=True))
    assert found == [{"Reef": "outer", "Visits": 3}, {"Reef": "inner"}, {"t": 1}, {"Dive no.2-b": 7, "Time": "9:30"}]


NOTE = "---\ntitle: T\nstatus: fm\n---\n# H\n```yaml\nid: 1\nstatus: own\n```\ntext\n```yml  \nid: 2\nnull_field:\n```\n"


def test_records_per_block(corpus):
    df = corpus(("a.md", NOTE), ("b.md", "---\nonly: front\n---\nx"), ("c.md", "nothing"), ("d.pdf", NOTE), ("e.typ", "```yaml\nk: v"))
    assert as_dicts(rl.extract_records(df)) == [
        {"title": "T", "status": "own", "id": 1},
        {"title": "T", "status": "fm", "id": 2, "null_field": None},
        {"only": "front"},
        {"k": "v"},
    ]
    assert as_dicts(rl.extract_records(df, "frontmatter")) == [{"title": "T", "status": "fm"}, {"only": "front"}]
    assert as_dicts(rl.extract_records(df, "blocks_only")) == [{"id": 1, "status": "own"}, {"id": 2, "null_field": None}, {"k": "v"}]
    assert as_dicts(rl.extract_records(df, "unknown")) == as_dicts(rl.extract_records(df))
    positions = [r["_pos"] for r in rl.extract_records(df).orderBy("_note_file", "_pos").collect()]
    assert positions == [0, 1, -1, 0]


def test_blocks_with_carriage_returns_and_odd_fences(corpus):
    df = corpus(
        ("a.md", "```yaml\r\na: 1\r\nb: x\r\n```\r\nrest\r\n"),
        ("b.md", " ```yaml\nindented: no\n```\n```yamlx\nno: 1\n```\n"),
        ("c.md", "```yaml\na: ```\nb: 1\n```  \n```yaml\n```\n"),
        ("d.md", "```yaml\n- list\n```\n"),
    )
    assert as_dicts(rl.extract_records(df)) == [{"a": 1, "b": "x"}]


def test_invalid_block_keeps_frontmatter(corpus):
    df = corpus(("a.md", "---\nk: 1\n---\n```yaml\nx: [\n```\n"), ("b.md", "---\nk: {\n---\n```yaml\nx: 1\n```\n"))
    assert as_dicts(rl.extract_records(df)) == [{"k": 1}, {"x": 1}]


YAML_CASES = {
    "a: yes\nb: 12:30:00\nc: 1_000\nd: 2026-01-01": {"a": "yes", "b": "12:30:00", "c": "1_000", "d": "2026-01-01"},
    "a: 010\nb: +5\nc: 0x1F\nd: .5\ne: 0o17\nf: 1.": {"a": 10, "b": 5, "c": 31, "d": 0.5, "e": 15, "f": 1.0},
    "a: ~\nb:\nc: null\nd: Null\ne: True\nf: FALSE": {"a": None, "b": None, "c": None, "d": None, "e": True, "f": False},
    "a: 1.5E3\nb: -2\nc: '7'\nd: \"8\"\ne: !!str 9": {"a": 1500.0, "b": -2, "c": "7", "d": "8", "e": "9"},
    "a: [1, x, null]\nb: {c: d}\n": {"a": [1, "x", None], "b": {"c": "d"}},
    "a: &x {k: 1}\nb:\n  <<: *x\n  z: 2\n": {"a": {"k": 1}, "b": {"k": 1, "z": 2}},
    "t: |\n  one\n  two\n": {"t": "one\ntwo\n"},
    "a: x # comment\n# whole line\nb: y#z": {"a": "x", "b": "y#z"},
    "1: x\ntrue: y": {"1": "x", "true": "y"},
    "a: .inf\nb: .nan": {"a": ".inf", "b": ".nan"},
    "a: o'brien \"q\" \\n": {"a": "o'brien \"q\" \\n"},
    "a: 1\n---\nb: 2": {"a": 1},
    "": {},
    "# only a comment": {},
}


@pytest.mark.parametrize("text", list(YAML_CASES))
def test_yaml_values(text):
    assert json.loads(yaml_text_to_json(text)) == YAML_CASES[text]


@pytest.mark.parametrize("text", ["- a", "a: b: c", "a: 1\na: 2", "a: [", "? [x]\n: y", "a: &a [*a]", "\ta: 1", "plain"])
def test_yaml_invalid(text):
    assert yaml_text_to_json(text) is None


def both_ways(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")

    def normal(c):
        return F.to_json(F.try_parse_json(c), {"ignoreNullFields": "false"})

    rows = df.select("t", normal(flat_to_json(F.col("t"))).alias("flat"), normal(yaml_to_json(F.col("t"))).alias("full"))
    return rows.collect()


def test_flat_rewriting_agrees_on_cases(spark):
    texts = list(YAML_CASES) + ["a: x  \nb: ''\nc: \"\"\nd: 'a # b: c'", "a b.c-d: 1\nk: http://x.y/z?q=1#f", "k: -x\nn: -5\nm: - y"]
    for row in both_ways(spark, texts):
        assert row["flat"] is None or row["flat"] == row["full"], row["t"]


yaml_lines = st.lists(
    st.one_of(
        st.builds(
            "{}:{}{}".format,
            st.sampled_from(["a", "b_1", "my key", "a.b", "x-y", "1", "true", "", "a:", "é", "<<", "- a"]),
            st.sampled_from([" ", "", "  ", "\t"]),
            st.one_of(
                st.text(alphabet="ab1 .:#-'\"\\[]{},&*!|>%@`?=~_+eEéß\u00a0\u2028", max_size=8),
                st.sampled_from(["true", "False", "null", "~", "1.50", "-0", "007", "1e5", ".5", "0x1", "'a b'", '"c"', "2026-01-01"]),
            ),
        ),
        st.sampled_from(["", "# c", "  x: 1", "text"]),
    ),
    max_size=4,
)


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(yaml_lines, min_size=40, max_size=40))
def test_flat_rewriting_agrees_with_parser(spark, blocks):
    for row in both_ways(spark, ["\n".join(lines) for lines in blocks]):
        assert row["flat"] is None or row["flat"] == row["full"], repr(row["t"])


plain = st.one_of(st.none(), st.booleans(), st.integers(-(10**12), 10**12), st.text(max_size=12), st.lists(st.text(max_size=4), max_size=3))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.dictionaries(st.from_regex(r"[a-z]{1,6}", fullmatch=True), plain, min_size=1, max_size=5), min_size=10, max_size=10))
def test_round_trip(spark, field_sets):
    notes = [(f"/n/{i:02}.md", "```yaml\n" + yaml.safe_dump(f, allow_unicode=False) + "```\n") for i, f in enumerate(field_sets)]
    df = spark.createDataFrame(notes, "_note_file string, content string")
    assert as_dicts(rl.extract_records(df)) == field_sets


def test_long_texts_do_not_overflow(corpus):
    many = "".join(f"# H{i}\n```yaml\nid: {i}\n```\n" for i in range(3000))
    wide = "```yaml\n" + "".join(f"k{i}: {'v' * 50} w\n" for i in range(3000)) + "```\n"
    line = "```yaml\nk: " + "word:x " * 40000 + "\n```\n" + "plain text line\n" * 20000
    df = corpus(("a.md", many), ("b.md", wide), ("c.md", line), ("d.md", "k: v\n" * 5000))
    found = rl.extract_records(df, header_block=False, sections=True).groupBy("_note_file").count().collect()
    assert {r["_note_file"]: r["count"] for r in found} == {"a.md": 3000, "b.md": 1, "c.md": 1}
    assert rl.with_frontmatter(df, header_block=True).filter("_is_header").count() == 1


def section_by_search(lines, block):
    """Section bounds straight from the definition."""
    level = lambda s: len(s) - len(s.lstrip("#")) if s.lstrip("#")[:1] in " \t" and 1 <= len(s) - len(s.lstrip("#")) <= 6 else 0
    start = next((i for i in range(block - 1, -1, -1) if level(lines[i])), None)
    if start is None:
        return "\n".join(lines).rstrip()
    end = next((i for i in range(start + 1, len(lines)) if 0 < level(lines[i]) <= level(lines[start])), len(lines))
    return "\n".join(lines[start:end]).rstrip()


note_lines = st.lists(
    st.sampled_from(["# a", "## b", "### c", "#### d", "####### no", "#no", "text", "", "```yaml", "```", "```yml", "id: 1", "# x", "## y"]),
    max_size=25,
)


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(note_lines, min_size=30, max_size=30))
def test_sections_match_definition(spark, notes):
    expected, rows = {}, []
    for n, lines in enumerate(notes):
        name, i, pos = f"/n/{n:02}.md", 0, 0
        rows.append((name, "---\nf: 1\n---" + "\n".join(["", *lines])))
        body = ["", *lines]
        while i < len(body):
            if body[i] in ("```yaml", "```yml"):
                expected[(name, pos)] = section_by_search(body, i)
                pos += 1
                while i + 1 < len(body) and body[i + 1] != "```":
                    i += 1
                i += 1
            i += 1
    df = spark.createDataFrame(rows, "_note_file string, content string")
    got = rl.extract_records(df, sections=True).filter("_pos >= 0").collect()
    assert {(r["_note_file"], r["_pos"]): r["_section"] for r in got} == expected


def test_spans():
    assert spans_of([]) == []
    assert spans_of([0, -1, -1]) == [{"first": 0, "end": 3, "from_block": 0, "blocks": 2}]
    kinds = [-1, 1, -1, 2, -1, -1, 3, 2, -1, 1]
    assert spans_of(kinds) == [
        {"first": 0, "end": 10, "from_block": 0, "blocks": 1},
        {"first": 1, "end": 9, "from_block": 1, "blocks": 1},
        {"first": 3, "end": 7, "from_block": 2, "blocks": 2},
        {"first": 7, "end": 9, "from_block": 4, "blocks": 1},
    ]


def test_blocks_without_fields_are_listed(corpus):
    deep = "a: " + "[" * 3000 + "]" * 3000
    block = lambda text: f"```yaml\n{text}\n```\n"
    notes = corpus(
        ("a.md", "---\n- a list\n---\n" + block("ok: 1") + block("k: 1\nk: 2") + block("x: [1") + block(deep)),
        ("b.md", block("flat: text") + block("") + block("~") + block("just words") + block("n: {a: [1, {b: 2}]}")),
        ("c.md", "---\n: : :\n  - x: [\n---\n"), ("d.jsonl", block("x: [1")), ("e.md", None), ("f.md", "Head: x: y\n\n" + block("{")),
    )
    got = {(r["_note_file"], r["_pos"]): r["error"] for r in rl.bad_blocks(notes).collect()}
    assert sorted(got) == [("a.md", -1), ("a.md", 1), ("a.md", 2), ("a.md", 3), ("b.md", 3), ("c.md", -1), ("f.md", 0)], got
    assert got["a.md", -1] == got["b.md", 3] == "no mapping" and got["a.md", 1] == "duplicate key" and "deep" in got["a.md", 3]
    assert got["a.md", 2].startswith("invalid YAML: ")
    kept = rl.extract_records(notes).count()
    assert kept == 3  # one of a.md, two of b.md
    assert [(r["_note_file"], r["_pos"]) for r in rl.bad_blocks(notes, header_block=True).filter("_note_file = 'f.md'").collect()] == [("f.md", 0)]


def test_blocks_are_those_of_a_plain_reading_by_lines(spark):
    def blocks_of(text):
        out, lines, i = [], text.split("\n"), 0
        while i < len(lines):
            opens = re.fullmatch(r"```ya?ml[ \t\f\r]*", lines[i])
            i += 1
            if not opens:
                continue
            inside = []
            while i < len(lines) and not re.fullmatch(r"```[ \t\f\r]*", lines[i]):
                inside.append(lines[i])
                i += 1
            if i == len(lines) and len(inside) > 1 and inside[-1] == "":
                inside.pop()  # the line end that closes an unterminated block
            out.append("\n".join(inside))
            i += 1
        return out

    chance = random.Random(5)
    parts = ["```yaml", "```yml \t", "```", "``` ", "```x", "", "", "a: 1", " ```", "b", "````"]
    texts = ["\n".join(chance.choices(parts, k=chance.randint(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4)
    found = df.select("t", F.regexp_extract_all("t", F.lit(FENCE), F.lit(1)).alias("b")).collect()
    assert [r["b"] for r in found] == [blocks_of(r["t"]) for r in found]


def test_long_block_costs_no_stack(spark, corpus):
    text = "```yaml\n" + "a b c\n" * 300_000 + "```\n```yaml\nk: 1\n```"
    row = corpus(("/n/a.md", text)).select(F.regexp_extract_all("content", F.lit(FENCE), F.lit(1)).alias("b")).first()
    assert [len(b) for b in row["b"]] == [6 * 300_000 - 1, 4]


def test_records_are_put_together_in_compiled_code(spark, corpus):
    """A generator whose value calls functions on elements would be interpreted, for each record."""
    records = extract_records(corpus(("/n/a.md", "---\nx: 1\ny: 2\n---\n```yaml\ny: ~\nz: 3\n```\n```yaml\nw: 4\n```")))
    assert as_dicts(records) == [{"x": 1, "y": None, "z": 3}, {"x": 1, "y": 2, "w": 4}]
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Generate explode" in line and "map_zip_with" in line]
    assert [line for line in plan.splitlines() if re.search(r"\*\([0-9]+\) Generate explode\(", line)]


def test_lists_are_taken_apart_only_where_the_text_is_one(spark, records):
    rows = records({"t": "[a"}, {"t": ["[a", "b"]}, {"t": "b"}, {"t": []}, {"u": 1}, {"t": [["b"]]}, {"t": {"b": 1}}, {"t": None})
    kept = lambda e: [r["_pos"] for r in apply_presets(rows, [e]).orderBy("_pos").collect()]
    assert (kept("t=b"), kept("t=[a"), kept("t~b"), kept("t^[a"), kept("t!b")) == ([1, 2], [0, 1], [1, 2, 5, 6], [0, 1], [0, 3, 4, 5, 6, 7])
    assert "startswith" in str(preset_condition("t=b")).lower()


def test_no_values_wait_for_python(corpus):
    """Rows that wait for Python hold texts: fields are parsed above, once for a frontmatter and its block together."""
    plan = rl.extract_records(corpus(("/n/a.md", "x")))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "try_variant_get" in plan
    assert plan.rindex("try_variant_get") < plan.index("ArrowEvalPython")


@pytest.mark.parametrize("repeated", ["true", "false"])
def test_fields_of_frontmatter_and_block_together(spark, corpus, repeated):
    """Shared, repeated, empty and non-flat members, whatever the session lets JSON objects repeat."""
    fence = "```yaml\n{}```\n"
    notes = {
        "/n/a.md": ("a: 1\nb: x", "b: ~\nc: 2\n"), "/n/b.md": ("a: 1\na: 2", "c: 3\n"), "/n/c.md": ("a: 1", "c: 3\nc: 4\n"),
        "/n/d.md": ("a: [1, 2]", "a: 5\nc: {d: 1}\n"), "/n/e.md": ("", "c: 6\n"), "/n/f.md": ("a: 7", ""), "/n/g.md": ("- a", "- b\n"),
        "/n/h.md": ("a: \"open", "c: 8\n"), "/n/i.md": ("a: 'it''s'", "c: a \"b\" \\ é\n"), "/n/j.md": ("a: 1\x01null\"", "c: 9\n"),
    }
    df = corpus(*[(path, f"---\n{front}\n---\n" + fence.format(block)) for path, (front, block) in notes.items()])
    with session_settings(spark, {"spark.sql.variant.allowDuplicateKeys": repeated}):
        rows = rl.extract_records(df).select("_note_file", F.to_json("fields", {"ignoreNullFields": "false"})).collect()
    assert {path: json.loads(fields) for path, fields in rows} == {
        "/n/a.md": {"a": 1, "b": None, "c": 2}, "/n/b.md": {"c": 3}, "/n/c.md": {"a": 1}, "/n/d.md": {"a": 5, "c": {"d": 1}}, "/n/e.md": {"c": 6},
        "/n/f.md": {"a": 7}, "/n/h.md": {"c": 8}, "/n/i.md": {"a": "it's", "c": "a \"b\" \\ é"}, "/n/j.md": {"c": 9},
    }
