"""Large values, odd names and lines that hold no object: nothing is lost or answered wrongly."""

import datetime
import json

import pytest

import recordlake as rl
from recordlake.functions.yaml_text import yaml_text_to_json


def test_limit_counts_rows_of_the_files_asked_for(spark, records):
    rows = records(*[{"_note_file": f"/n/{'ab'[i % 2]}{i}.md", "k": i} for i in range(10)])
    out = rl.query(rows, where="k >= 0 ORDER BY k LIMIT 2", filename="/b").rows
    assert [r.k for r in out.collect()] == [1, 3]


def test_long_integers_compare_exactly(spark):
    near = [(1234567890123456788,), (1234567890123456789,)]
    table = spark.createDataFrame(near, "m long")
    assert table.filter(rl.where_field(table, "m", "=", "1234567890123456789")).count() == 1
    assert table.filter(rl.where_field(table, "m", "<", "99999999999999999999999")).count() == 2


def test_dates_and_names_of_conditions(spark):
    table = spark.createDataFrame([(datetime.date(2026, 2, 3), 1)], "Day date, `a``b` int")
    assert table.filter(rl.where_field(table, "day", ">=", "2026-02")).count() == 1
    assert table.filter(rl.where_field(table, "a`b", "=", "1")).count() == 1
    for field, value in (("day", "soon"), ("day", "2026-02-30"), ("other", "1")):
        with pytest.raises(ValueError):
            rl.where_field(table, field, ">", value)


def test_folders_give_their_jsonl_files_and_bad_lines_are_listed(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"v": 1}\nno object\n\n[2]\n{"v": 3}\n')
    (tmp_path / "x.json").write_text('{"v": 9}\n')
    lines = rl.read_lines(spark, str(tmp_path))
    assert rl.parse_jsonl(lines).count() == 2
    assert sorted(r.line for r in rl.bad_lines(lines).collect()) == ["[2]", "no object"]
    assert rl.read_jsonl(spark, str(tmp_path / "x.json")).count() == 1


def test_long_blocks_are_whole_and_alias_bombs_refused():
    numbers = list(range(1_000_001))
    assert json.loads(yaml_text_to_json(f"all: {numbers}"))["all"] == numbers
    bomb = "a: &a [x, x, x, x, x, x, x, x, x, x]\n" + "".join(f"{b}: &{b} [{', '.join([f'*{a}'] * 10)}]\n" for a, b in zip("abcdefgh", "bcdefghi"))
    assert yaml_text_to_json(bomb) is None
