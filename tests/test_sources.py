import json
import random

import pytest
from pyspark.sql import functions as F

import recordlake as rl
from recordlake.operators.fulltext import matching_notes
from recordlake.operators.profile import collect_profile
from recordlake.operators.textindex import with_grams
from recordlake.sources.json_array import json_array_elements
from recordlake.sources.notes import absolute_root, within_depth
from recordlake.sources.store import as_json_lines, write_profile
from recordlake.streaming.ingest import merged_records, start_ingest, start_merged_ingest, store_index, stream_records, write_batch
from tests.conftest import as_dicts


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "notes dir"
    for name, text in {
        "a.md": "---\ntitle: river survey\nstatus: active\n---\nBody\n",
        "sub/b +100%.md": "```yaml\nid: 1\nbinder: [x, y]\nstatus: done\n```\n",
        "sub/deep/c.TYP": "```yaml\nid: 2\n```\n",
        "sub/deep/noext": "---\nk: v\n---\n",
        "d.txt": "---\nno: 1\n---\n",
        "collections/ledger.jsonl": '{"id": 1, "binder": ["x", "z"], "kind": "pdf"}\n\n  \nnot json\n[1]\n{"id": 9, "t": "l\\u00e4"}\r\n',
        "collections/other.txt": "{}",
    }.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    return root


def names(df):
    return sorted(r["_note_file"].split("notes dir/")[1] for r in df.select("_note_file").collect())


def test_read_corpus(spark, tree):
    corpus = rl.read_corpus(spark, str(tree))
    assert names(corpus) == ["a.md", "sub/b +100%.md", "sub/deep/c.TYP", "sub/deep/noext"]
    assert all(r["_note_file"].startswith(str(tree)) for r in corpus.collect())
    assert names(rl.read_corpus(spark, str(tree), depth=0)) == ["a.md"]
    assert names(rl.read_corpus(spark, str(tree) + "/", depth=1)) == ["a.md", "sub/b +100%.md"]
    assert names(rl.read_corpus(spark, f"file://{tree}", depth=0)) == ["a.md"]
    probe = rl.apply_presets(rl.extract_records(corpus), ["title=river survey"])
    assert as_dicts(probe) == [{"title": "river survey", "status": "active"}]


def test_root_forms(spark):
    assert absolute_root(spark, "s3a://bucket/notes/") == "s3a://bucket/notes"
    assert absolute_root(spark, "file:///a/b") == "/a/b" == absolute_root(spark, "/a/b/")


def test_jsonl(spark, tree):
    index = rl.read_jsonl(spark, str(tree / "collections" / "ledger.jsonl"))
    assert as_dicts(index) == [{"id": 1, "binder": ["x", "z"], "kind": "pdf"}, {"id": 9, "t": "lä"}]
    assert [(r["_pos"], r["_source_type"], r["_layer"]) for r in index.orderBy("_pos").collect()] == [(0, "jsonl", "index"), (5, "jsonl", "index")]
    with pytest.raises(Exception):
        rl.read_jsonl(spark, str(tree / "collections" / "ledger.jsonl"), strict=True).collect()
    good = tree / "good.jsonl"
    good.write_text('\n{"a": 1}\n\n{"a": 2}\n')
    assert as_dicts(rl.read_jsonl(spark, str(good), strict=True)) == [{"a": 1}, {"a": 2}]


def test_jsonl_positions_over_splits(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    path.write_text("".join(json.dumps({"n": i, "pad": "x" * (i % 50)}) + "\n" for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = rl.read_jsonl(spark, str(path)).select("_pos", F.try_variant_get(F.col("fields")["n"], "$", "int").alias("n"))
        assert rows.rdd.getNumPartitions() > 3
        assert [r["n"] for r in rows.orderBy("_pos").collect()] == list(range(5000))
        assert rows.select("_pos").distinct().count() == 5000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_collections(spark, tree, tmp_path):
    assert rl.read_collections(spark, str(tree)).count() == 2
    assert rl.read_collections(spark, str(tmp_path / "nowhere")) is None
    (tmp_path / "c" / "collections").mkdir(parents=True)
    (tmp_path / "c" / "collections" / "x.txt").write_text("{}")
    assert rl.read_collections(spark, str(tmp_path / "c")) is None


def test_end_to_end(spark, tree):
    records = rl.build_records(rl.read_corpus(spark, str(tree)), rl.read_collections(spark, str(tree)))
    rows = rl.query(records, where="id = 1 ORDER BY binder").rows.collect()
    assert [(r["binder"], r["kind"], r["status"], r["_layer"]) for r in rows] == [
        ("x", "pdf", "done", "annotation"), ("y", None, "done", "annotation"), ("z", "pdf", None, "index"),
    ]


def test_store(spark, tree, tmp_path):
    records = rl.extract_records(rl.read_corpus(spark, str(tree)))
    stored = rl.snapshot(records, str(tmp_path / "store"))
    assert as_dicts(stored) == as_dicts(records)
    assert set(stored.columns) >= {"_key_id", "_key_binder", "_key_status"}
    for expression in ("status=active", "status^do", "binder=x", "binder^y", "status!done", "status~on", "id=2"):
        assert as_dicts(rl.apply_presets(stored, [expression])) == as_dicts(rl.apply_presets(records, [expression])), expression
    plan = rl.apply_presets(stored, ["status=active"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(_key_status,active)" in plan
    pruned = stored.filter("_source_type = 'typst'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_source_type" in pruned


def test_json_and_csv_output(spark, tree, tmp_path):
    records = rl.extract_records(rl.read_corpus(spark, str(tree), depth=0))
    rl.write_json_lines(records, str(tmp_path / "json"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert lines == [{"title": "river survey", "status": "active", "_note_file": str(tree / "a.md")}]
    rl.write_json_lines(spark.sql("SELECT 1 AS a, CAST(NULL AS STRING) AS b"), str(tmp_path / "wide"))
    assert json.loads(spark.read.text(str(tmp_path / "wide")).first()["value"]) == {"a": 1, "b": None}
    rl.write_csv(rl.select_columns(records, ["title"]), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["title"] == "river survey"
    back = as_json_lines(records).select(F.lit("x").alias("_note_file"), F.lit(0).alias("_pos"), F.col("value").alias("line"))
    assert as_dicts(rl.parse_jsonl(back)) == lines


def test_stream_equals_batch(spark, tree, tmp_path):
    stream = stream_records(spark, str(tree), ["id~"], depth=1)
    for _ in range(2):  # nothing new the second time
        start_ingest(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint")).awaitTermination(120)
        batch = rl.apply_presets(rl.extract_records(rl.read_corpus(spark, str(tree), depth=1)), ["id~"])
        assert as_dicts(rl.read_records(spark, str(tmp_path / "store"))) == as_dicts(batch)
    (tree / "new.md").write_text("```yaml\nid: 77\n```\n")
    start_ingest(stream, str(tmp_path / "store"), str(tmp_path / "checkpoint")).awaitTermination(120)
    assert {"id": 77} in as_dicts(rl.read_records(spark, str(tmp_path / "store")))


def merged_text(df):
    return sorted(json.dumps(r, sort_keys=True) for r in as_dicts(df))


def test_merged_stream_equals_the_whole_merge(spark, corpus, records, tmp_path):
    """Three batches, one of them replayed; half of the index comes after them."""
    notes = [(f"/n/{i}.md", f"```yaml\nid: {i % 7}\nbinder: [x, y{i % 3}]\nown: {i}\nkind: ~\n```\n") for i in range(12)] + [("/n/none.md", "```yaml\nown: 99\n```\n")]
    index = [{"id": i, "binder": ["x", "y1"], "kind": f"k{i}", "copy": c} for c in (0, 1) for i in range(9)] + [{"kind": "no key"}]
    schema = "_note_file string, content string"
    for part in range(3):
        spark.createDataFrame(notes[part::3], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "notes"))
    start, store = records(*index[:5], layer="index"), str(tmp_path / "merged")
    store_index(start, str(tmp_path / "index"))
    stream = rl.extract_records(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "notes")))
    start_merged_ingest(stream, str(tmp_path / "index"), store, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert len([p for p in (tmp_path / "merged").iterdir() if p.name.startswith("batch=")]) == 3
    again = spark.read.parquet(store).filter("batch = 1").select("_note_file").distinct()
    batch = spark.createDataFrame(notes, schema).join(again, "_note_file", "left_semi")
    write_batch(rl.extract_records(batch), 1, str(tmp_path / "index"), store)
    whole = rl.build_records(spark.createDataFrame(notes, schema), records(*index, layer="index"))
    assert merged_text(merged_records(spark, store, records(*index, layer="index"))) == merged_text(whole)
    assert any('"kind": "k' in r for r in merged_text(spark.read.parquet(store).filter("_filled")))


def test_typed_store_prunes_the_scan(spark, records, tmp_path):
    rows = records(
        {"status": "a", "n": 1, "day": "2026-01-05", "tags": ["x", "y"], "mix": 1, "o": {"k": 1}, "Case": "up", "case": "low", "a.b": 2.5, "t`k": True, "_m": "x"},
        {"status": "b", "n": 2, "day": "2026-02-05", "tags": ["z"], "mix": "one", "f": 1}, {"status": "a", "n": 3, "f": 1.5, "none": None}, {"tags": []},
    )
    stored = rl.snapshot(rows, str(tmp_path / "s"))
    assert as_dicts(stored) == as_dicts(rows)
    assert rl.column_types(stored) == rl.column_types(rows)
    plain, wide = rl.widen(rows), rl.widen(stored)
    assert plain.dtypes == wide.dtypes
    text = lambda df: sorted(str(r[:-1]) for r in df.select(*[F.col(f"`{c.replace('`', '``')}`").cast("string") if c != "o" else F.to_json(c) for c in df.columns], F.lit(0)).collect())
    assert text(plain) == text(wide)
    for clause in ("n > 1 AND day >= '2026-02-01'", "array_contains(tags, 'x')", "mix = 'one' OR \"a.b\" > 2"):
        found = rl.sql_where(wide, clause).select("status", "n")
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "fields" not in plan.split("ReadSchema:")[1].splitlines()[0], clause
        assert sorted(map(str, found.collect())) == sorted(map(str, rl.sql_where(plain, clause).select("status", "n").collect())), clause
    assert "EqualTo(_typed_status,a)" in rl.sql_where(wide, "status = 'a'")._jdf.queryExecution().executedPlan().toString()
    for expression in ("status=a", "status!a", "day^2026-01", "n=2", "n!2", "tags=x", "mix~on", "mix=1", "none=x", "none!x", "absent=x", "absent!x", "t`k=true", "Case=up", "case=low", "o~k"):
        assert as_dicts(rl.apply_presets(stored, [expression])) == as_dicts(rl.apply_presets(rows, [expression])), expression
    narrow = rl.widen(rl.apply_presets(stored, ["status=a"])).select("n")
    assert "fields" not in narrow._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1].splitlines()[0]


def test_stored_columns_do_not_answer_for_changed_fields(spark, records, tmp_path):
    rows = records({"k": "x", "tags": ["a", "b"]}, {"k": 1})
    stored = rl.snapshot(rows, str(tmp_path / "s"))
    for change in (lambda r: rl.explode_field(r, "tags"), lambda r: rl.normalize_arrays(r, ["k"]), lambda r: rl.union_layers(r, records({"k": 2.5}, {"new": 1}))):
        assert rl.column_types(change(stored)) == rl.column_types(change(rows))
        for expression in ("tags=a", "k=x", "k=2.5", "new=1"):
            assert as_dicts(rl.apply_presets(change(stored), [expression])) == as_dicts(rl.apply_presets(change(rows), [expression]))


def test_few_typed_fields_change_no_result(spark, records, tmp_path):
    rows = records(*[{"a": i, "b": str(i), **({"c": i / 2} if i % 2 else {})} for i in range(6)])
    stored = rl.snapshot(rows, str(tmp_path / "s"), typed_fields=1)
    assert [c for c in stored.columns if c.startswith("_typed_")] == ["_typed_a"]
    assert sorted(map(str, rl.widen(stored).collect())) == sorted(map(str, rl.widen(rows).collect()))


def test_profiles_of_appended_parts_are_merged(spark, records, tmp_path):
    path = str(tmp_path / "s")
    rl.snapshot(records({"k": 1, "day": "2026-01-01"}), path)
    more = records({"k": 2.5, "day": "soon", "new": True})
    rl.write_records(more, path, mode="append", types={"k": "bigint"})
    write_profile(spark, collect_profile(more), path)
    stored = rl.read_records(spark, path)
    assert rl.column_types(stored) == {"day": "string", "k": "double", "new": "boolean"}
    assert sorted(map(str, rl.widen(stored).select("k", "day", "new").collect())) == ["Row(k=1.0, day='2026-01-01', new=None)", "Row(k=2.5, day='soon', new=True)"]


def test_refresh_equals_a_full_extraction(spark, corpus, tmp_path):
    store = str(tmp_path / "r")
    note = lambda i, v: (f"/n/{i}.md", f"---\nid: {i}\n---\n```yaml\nv: {v}\n```\n")
    first = [note(i, 0) for i in range(10)] + [("/n/x.jsonl", "{}"), ("/n/bare.md", "no fields"), ("/n/null.md", None)]
    second = [note(0, 0), note(1, 5), *[note(i, 0) for i in range(3, 9)], ("/n/moved.md", note(9, 0)[1]), ("/n/bare.md", "---\nid: 77\n---\n"), ("/n/null.md", "")]
    third = [*second, note(2, 0)]
    for texts, counts in ((first, (12, 0, 0)), (first, (0, 0, 0)), (second, (1, 2, 2)), (third, (1, 0, 0)), ([], (0, 0, 12)), (first, (12, 0, 0))):
        now = corpus(*texts) if texts else corpus(("", "")).limit(0)
        done = rl.refresh(spark, now, store)
        assert (done["new"], done["edited"], done["deleted"]) == counts
        assert merged_text(rl.current_records(spark, store)) == merged_text(rl.extract_records(now))
    versions = spark.read.parquet(store + "/records").groupBy("version").agg(F.count_distinct("_note_file").alias("n")).collect()
    assert {r["version"]: r["n"] for r in versions} == {1: 10, 2: 3, 3: 1, 5: 10}  # only what changed was extracted; no change is no version


def test_a_refresh_that_died_is_repeated(spark, corpus, tmp_path):
    store = str(tmp_path / "r")
    rl.refresh(spark, corpus(("/n/a.md", "---\nk: 1\n---\n")), store)
    half = rl.extract_records(corpus(("/n/a.md", "---\nk: 9\n---\n"), ("/n/b.md", "---\nk: 9\n---\n")))
    half.write.parquet(f"{store}/records/version=2")  # records, but no manifest
    assert as_dicts(rl.current_records(spark, store)) == [{"k": 1}]
    assert rl.refresh(spark, corpus(("/n/a.md", "---\nk: 2\n---\n")), store)["edited"] == 1
    assert as_dicts(rl.current_records(spark, store)) == [{"k": 2}]


def test_indexed_full_text_equals_the_plain_search(spark, corpus, tmp_path):
    own = random.Random(3)
    word = lambda: "".join(own.choice("abÀéİß日🙂 ") for _ in range(own.randrange(1, 9)))
    notes = [(f"/n/{i}.md", " ".join(word() for _ in range(own.randrange(12)))) for i in range(120)]
    notes += [("/n/short.md", "a"), ("/n/two.typ", "Éa"), ("/n/empty.md", ""), ("/n/null.md", None), ("/n/x.jsonl", "ab a a"), ("/n/long.md", "x" * 50_000 + "needle")]
    texts, path = corpus(*notes), str(tmp_path / "index")
    rl.write_text_index(texts, path)
    terms = ["a", "é", "É", "ab", "日🙂", " aé ", "abé", "ba a", "needle", "xneedle", "zzz", "z", "İ", notes[5][1][2:22], notes[9][1][1:5]]
    for term in filter(str.strip, terms):
        want = sorted(r[0] for r in matching_notes(texts, term).select("_note_file").collect())
        for listed in (10_000, 2):
            assert sorted(r[0] for r in rl.matching_notes_indexed(spark, path, term, listed).select("_note_file").collect()) == want, term
    plan = rl.matching_notes_indexed(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(note" in plan or "PushedFilters: [IsNotNull(note), EqualTo(note" in plan or "EqualTo(note" in plan
    rows = rl.extract_records(corpus(("/n/long.md", "---\nk: 1\n---\n"), ("/n/two.typ", "---\nk: 2\n---\n")))
    assert as_dicts(rl.filter_fulltext_indexed(rows, path, "NEEDLE")) == [{"k": 1}] and rl.filter_fulltext_indexed(rows, path, " ").count() == 2


def test_grams_of_the_index_need_no_call_for_each_place(spark):
    own = random.Random(4)
    texts = ["", "é", "É日", "a🙂b", "\n\r\n\u2028x", "aaaa", *("".join(own.choice("aÀé\n日🙂 İ") for _ in range(own.randrange(40))) for _ in range(40))]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "note long, content string")
    got = with_grams(rows)
    folded = {r["note"]: r["t"] for r in rows.select("note", F.lower("content").alias("t")).collect()}
    want = sorted((i, g) for i, t in folded.items() for g in ({t[k : k + 3] for k in range(len(t) - 2)} or {t} if t else ()))
    assert sorted(map(tuple, got.collect())) == want
    assert "lambdafunction" not in got._jdf.queryExecution().executedPlan().toString()


def test_depth_in_any_file_system(spark):
    at = lambda path, root, depth: spark.createDataFrame([(path,)], "p string").filter(within_depth(F.col("p"), root, depth)).count()
    assert at("hdfs://nn:8020/notes/a.md", "/notes", 0) == at("hdfs://nn:8020/notes/a.md", "hdfs://nn:8020/notes/", 0) == at("/notes/a.md", "/notes", 0) == 1
    assert at("s3a://b/notes/x/a.md", "s3a://b/notes", 0) == 0 and at("s3a://b/notes/x/a.md", "s3a://b/notes", 1) == 1
    with pytest.raises(Exception, match="not below"):
        at("/other/a.md", "/notes", 3)
    with pytest.raises(ValueError):
        at("/notes/a.md", "/no*s", 0)


def test_equal_keys_of_a_line(spark):
    lines = spark.createDataFrame([("f", 0, '{"a":1,"a":2}'), ("f", 1, "[1]")], "_note_file string, _pos long, line string")
    assert as_dicts(rl.parse_jsonl(lines)) == as_dicts(rl.parse_jsonl(lines.limit(1), strict=True)) == [{"a": 2}]
    both = rl.parse_jsonl(lines).select("_pos").unionAll(rl.bad_lines(lines).select("_pos"))
    assert sorted(r[0] for r in both.collect()) == [0, 1]
    try:
        spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")  # what the session says holds
        assert rl.bad_lines(lines).count() == 2
    finally:
        spark.conf.unset("spark.sql.variant.allowDuplicateKeys")


def index_texts():
    """Arrays with braces, quotes and escapes in strings, nested tags, blanks, and nothing at all."""
    odd = ['plain', 'a } b', '{"x": [1, "]"]}', 'quote " and } after', 'back\\slash', 'ends with \\', '"}"', "é🙂}{", "[[", "", "}}}}"]
    entries = [{"file": f"/n/{i}.md", "project": odd[i % 11], "title": odd[i * 7 % 11], "tasks": [{"line": k, "status": "x", "tags": {"t": odd[(i + k) % 11], "o": {"p": [i]}}, "task": odd[(i * k) % 11] * k} for k in range(i % 4)]} for i in range(120)]
    return {"one.json": json.dumps(entries), "pretty.json": "\n " + json.dumps(entries[:40], indent=2, ensure_ascii=False) + "\n", "tight.json": json.dumps(entries[5:30], separators=(",", ":")), "none.json": "[ ]", "last.json": json.dumps(entries[:1])}


@pytest.mark.parametrize("size", [150, 4000, 1 << 20])
def test_task_index_split_equals_one_task_reader(spark, tmp_path, size):
    for name, text in index_texts().items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    as_text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct("*"))).collect())
    whole = as_text(rl.read_task_index(spark, str(tmp_path)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        assert as_text(rl.read_task_index(spark, str(tmp_path), split=True)) == whole and len(whole) == 186
        tasks = rl.read_task_index(spark, str(tmp_path), split=True).select(F.explode("tasks").alias("t"))
        assert tasks.filter("t.status = 'x'").count() == rl.read_task_index(spark, str(tmp_path)).select(F.explode("tasks")).count()
        one = json_array_elements(spark, str(tmp_path / "one.json"))
        assert sorted(r["_pos"] for r in one.collect()) == list(range(120))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_broken_task_index_fails(spark, tmp_path):
    (tmp_path / "bad.json").write_text('[{"file": "a", "tasks": 5}]')
    with pytest.raises(Exception, match="(?i)malformed"):
        rl.read_task_index(spark, str(tmp_path / "bad.json"), split=True).collect()


def test_files_of_one_row_each_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """One task would write, and one thread rename, as many files as there are rows."""
    import threading

    from workload import files

    used, pool = set(), files.ThreadPoolExecutor

    class Watched(pool):
        def map(self, function, items):
            return super().map(lambda i: (used.add(threading.get_ident()), function(i)), items)

    monkeypatch.setattr(files, "ThreadPoolExecutor", Watched)
    texts = spark.createDataFrame([(f"row {i}",) for i in range(40)], "value string").coalesce(1)
    files.write_text_files(texts, str(tmp_path / "out"), ".md", one_each=True)
    written = sorted(p for p in (tmp_path / "out").iterdir() if p.name.endswith(".md"))
    assert sorted(p.read_text().strip() for p in written) == sorted(f"row {i}" for i in range(40))
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.endswith(".txt")]
    assert len({p.name.split("-")[1] for p in written}) > 1 and threading.get_ident() not in used


def test_writing_a_store_sorts_nothing(spark, corpus, tmp_path):
    """Records of all source types mixed in one task go to one file each, without a sort of the task's records."""
    names = ["a.md", "b.typ", "c", "d.typst"] * 5
    notes = corpus(*[(f"/n/{i}/{name}", f"```yaml\nid: {i}\n```") for i, name in enumerate(names)]).coalesce(1)
    extra = rl.parse_jsonl(spark.createDataFrame([("/n/x.jsonl", i, f'{{"id": {100 + i}}}') for i in range(3)], "_note_file string, _pos long, line string"))
    both = rl.extract_records(notes).unionByName(extra).coalesce(1)
    tracker = spark._jsparkSession.sharedState().statusStore()
    before = tracker.executionsCount()
    rl.write_records(both, str(tmp_path / "store"))
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    runs = tracker.executionsList(int(before), 10)
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    assert plans and not any("Sort" in p for p in plans)
    assert sorted(len(list((tmp_path / "store" / d).glob("*.parquet"))) for d in ("_source_type=markdown", "_source_type=typst", "_source_type=jsonl")) == [1, 1, 1]
    assert sorted(r["id"] for r in rl.widen(rl.read_records(spark, str(tmp_path / "store")), {"id": "bigint"}).collect()) == [*range(20), 100, 101, 102]
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"
