import json

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import recordlake as rl
from tests.conftest import as_dicts


def by_text(dicts):
    return sorted(json.dumps(d, sort_keys=True) for d in dicts)


def test_explode(records):
    rows = records({"id": 1, "binder": ["a", "b"]}, {"id": 2, "binder": "c"}, {"id": 3}, {"id": 4, "binder": []}, {"id": 5, "binder": {"k": [1]}})
    got = as_dicts(rl.explode_field(rows, "binder"))
    assert by_text(got) == by_text([
        {"id": 1, "binder": "a"}, {"id": 1, "binder": "b"}, {"id": 2, "binder": "c"}, {"id": 3}, {"id": 4, "binder": None},
        {"id": 5, "binder": {"k": [1]}},
    ])


def test_normalize_arrays(records):
    rows = records({"tags": "a", "n": 1}, {"tags": ["b", "c"]}, {"tags": None}, {"n": 2, "tags": {"k": 1}})
    assert as_dicts(rl.normalize_arrays(rows, ["tags", "nope"])) == [
        {"tags": ["a"], "n": 1}, {"tags": ["b", "c"]}, {"tags": None}, {"n": 2, "tags": [{"k": 1}]},
    ]
    assert as_dicts(rl.normalize_arrays(rows, [])) == as_dicts(rows)


def test_merge(records):
    index = records(
        {"id": 1, "binder": "a", "kind": "pdf", "amount": 10}, {"id": 1, "binder": "a", "kind": "second", "amount": 11},
        {"id": 2, "binder": "a", "kind": "doc"}, {"id": 3, "kind": "no binder"}, {"id": 3, "kind": "no binder"}, {"id": "4", "binder": "z", "kind": "four"},
        layer="index",
    )
    notes = records(
        {"_note_file": "/n/a.md", "id": 1, "binder": "a", "amount": 99, "status": "x"},
        {"_note_file": "/n/b.md", "id": 1, "binder": "a", "amount": None},
        {"_note_file": "/n/c.md", "status": "keyless"}, {"_note_file": "/n/c.md", "status": "keyless"},
        {"_note_file": "/n/d.md", "id": 4, "binder": "z"}, {"_note_file": "/n/e.md", "id": 9, "binder": "q"},
    )
    for hot in (1_000_000, 1, 2):
        merged = rl.merge_layers(notes, index, hot_key_rows=hot)
        got = {}
        for r in merged.select("_note_file", "_layer", F.to_json("fields", {"ignoreNullFields": "false"}).alias("j")).collect():
            got.setdefault((r["_note_file"], r["_layer"]), []).append(json.loads(r["j"]))
        assert got[("/n/a.md", "annotation")] == [{"id": 1, "binder": "a", "amount": 99, "status": "x", "kind": "pdf"}]
        assert got[("/n/b.md", "annotation")] == [{"id": 1, "binder": "a", "amount": 10, "kind": "pdf"}]
        assert got[("/n/c.md", "annotation")] == [{"status": "keyless"}, {"status": "keyless"}]
        assert got[("/n/d.md", "annotation")] == [{"id": 4, "binder": "z", "kind": "four"}]
        assert got[("/n/e.md", "annotation")] == [{"id": 9, "binder": "q"}]
        assert by_text(got[("/n/x.jsonl", "index")]) == by_text(
            [{"id": 2, "binder": "a", "kind": "doc"}, {"id": 3, "kind": "no binder"}, {"id": 3, "kind": "no binder"}]
        )
        assert merged.count() == 9


keyed = st.lists(st.tuples(st.sampled_from([1, 2, 3, None]), st.sampled_from(["a", "b", None]), st.integers(0, 5)), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(keyed, keyed, st.sampled_from([1, 2, 10**6]))
def test_merge_laws(spark, notes, index, hot):
    def table(rows, field, layer):
        lines = [(f"/{layer}", i, json.dumps({k: v for k, v in (("id", a), ("binder", b), (field, c)) if v is not None})) for i, (a, b, c) in enumerate(rows)]
        df = rl.parse_jsonl(spark.createDataFrame(lines, "_note_file string, _pos long, line string"))
        return df.withColumn("_layer", F.lit(layer))

    merged = rl.merge_layers(table(notes, "own", "annotation"), table(index, "kind", "index"), hot_key_rows=hot)
    got = by_text(json.loads(r[0]) for r in merged.select(F.to_json("fields")).collect())

    first = {}
    for a, b, c in index:
        if a is not None and b is not None:
            first.setdefault((a, b), c)
    want = []
    for a, b, c in notes:
        found = first.get((a, b))
        want.append({k: v for k, v in (("id", a), ("binder", b), ("own", c), ("kind", found)) if v is not None})
    annotated = {(a, b) for a, b, _ in notes}
    want += [{"id": a, "binder": b, "kind": c} for (a, b), c in first.items() if (a, b) not in annotated]
    want += [{k: v for k, v in (("id", a), ("binder", b), ("kind", c)) if v is not None} for a, b, c in index if a is None or b is None]
    assert got == by_text(want)


def test_hot_key_is_spread(spark, records):
    """Annotations of a hot key meet their one index record in several groups."""
    from recordlake.operators.skew import hot_keys, spread_many, spread_one

    many = spark.range(2000).select(F.when(F.col("id") < 1500, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    counts = many.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    hot = hot_keys(counts, ["k"], 100)  # 4 shuffle partitions: 16 shares of 125 rows
    assert [tuple(r) for r in hot.collect()] == [("hot", 12)] and hot_keys(counts, ["k"], 1501).count() == 0
    left = spread_many(many, hot, ["k"], ["id"])
    assert left.filter("k = 'hot'").select("_salt").distinct().count() == 12
    right = spread_one(counts, hot, ["k"])
    assert right.count() == counts.count() + 11
    assert left.join(right, ["k", "_salt"]).count() == 2000


def test_union(records):
    both = rl.union_layers(records({"a": 1}), records({"b": 2}, layer="index"))
    assert sorted(map(str, as_dicts(both))) == ["{'a': 1}", "{'b': 2}"]
    assert {r["_layer"] for r in both.collect()} == {"annotation", "index"}


def test_build_records(corpus, records):
    notes = corpus(("/n/a.md", "```yaml\nid: 1\nbinder: [x, y]\nstatus: ok\n```\n"))
    index = records({"id": 1, "binder": ["x", "z"], "kind": "k"}, layer="index")
    got = by_text(as_dicts(rl.build_records(notes, index)))
    assert got == by_text([
        {"id": 1, "binder": "x", "status": "ok", "kind": "k"}, {"id": 1, "binder": "y", "status": "ok"}, {"id": 1, "binder": "z", "kind": "k"},
    ])
    assert rl.build_records(notes).count() == 1


def test_merged_records_carry_corpus_columns_and_lists(corpus, records):
    notes = corpus(("/n/a.md", "```yaml\nid: 1\nbinder: [x, y]\ntag: t\n```\nneedle"), ("/n/b.md", "```yaml\nown: 2\n```\n"))
    index = records({"id": 1, "binder": "x", "kind": "k", "note": "n"}, {"id": 2, "binder": "x"}, {"kind": "alone"}, layer="index")
    got = rl.build_records(rl.mark_fulltext(notes, "needle"), index, keep=["_fulltext"], array_fields=["tag", "note"])
    rows = [(json.dumps(f, sort_keys=True), flag) for f, flag in zip(as_dicts(got), [r["_fulltext"] for r in sorted(got.collect(), key=lambda r: (r["_note_file"], r["_pos"]))], strict=True)]
    assert sorted(rows, key=str) == sorted([
        ('{"binder": "x", "id": 1, "kind": "k", "note": ["n"], "tag": ["t"]}', True), ('{"binder": "y", "id": 1, "tag": ["t"]}', True),
        ('{"own": 2}', False), ('{"binder": "x", "id": 2}', None), ('{"kind": "alone"}', None),
    ], key=str)
    shown = rl.query(got, fulltext="needle", where="id = 1")
    assert shown.rows.count() == 2 and shown.shown_count == 2
