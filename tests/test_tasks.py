import json

import pytest
from pyspark.sql import functions as F

import recordlake as rl
from recordlake.operators.tasks import is_closed, is_done, tag_text

INDEX = [
    {"file": "/n/alpha.md", "project": "alpha", "title": "A", "tasks": [
        {"line": 3, "status": None, "tags": {}, "task": "Write report"},
        {"line": 4, "status": "x", "tags": {}, "task": "done one"},
        {"line": 5, "status": None, "tags": {"done": False}, "task": "tag done"},
    ]},
    {"file": "/n/beta.v1.md", "project": "Beta Two", "title": "B", "tasks": [
        {"line": 12, "status": ">", "tags": {}, "task": "moved"},
        {"line": 13, "status": "-", "tags": None, "task": "dropped"},
        {"line": 14, "status": None, "tags": {"cancelled": True}, "task": "cancelled"},
        {"line": 0, "status": "?", "tags": {"waiting": "client", "today": True, "n": 3, "z": None, "f": False}, "task": "Ask CLIENT"},
    ]},
    {"file": "/n/empty.md", "project": "none", "title": "C", "tasks": []},
    {"file": "/n/none.md", "project": "none", "title": "C", "tasks": None},
]


@pytest.fixture
def index_path(tmp_path):
    path = tmp_path / "index.json"
    path.write_text(json.dumps(INDEX, indent=1))
    return str(path)


def texts(df):
    return sorted(r["text"] for r in df.collect())


def test_tasks(spark, index_path):
    flat = rl.flatten_tasks(rl.read_task_index(spark, index_path))
    assert flat.count() == 7
    states = {r["text"]: (r["done"], r["closed"]) for r in flat.select("text", is_done().alias("done"), is_closed().alias("closed")).collect()}
    assert states == {
        "Write report": (False, False), "done one": (True, True), "tag done": (True, True), "moved": (False, True),
        "dropped": (False, True), "cancelled": (False, True), "Ask CLIENT": (False, False),
    }
    assert texts(rl.filter_tasks(flat)) == ["Ask CLIENT", "Write report"]
    assert texts(rl.filter_tasks(flat, done=True)) == ["done one", "tag done"]
    assert texts(rl.filter_tasks(flat, tag="today")) == ["Ask CLIENT"]
    assert texts(rl.filter_tasks(flat, tag="toda")) == []
    assert texts(rl.filter_tasks(flat, project="BETA")) == ["Ask CLIENT"]
    assert texts(rl.filter_tasks(flat, search="client")) == ["Ask CLIENT"]
    assert texts(rl.filter_tasks(flat, search="report", project="beta")) == []
    rows = [tuple(r) for r in rl.format_tasks(rl.filter_tasks(flat)).orderBy("Task").collect()]
    assert rows == [
        ("Write report", "alpha", "", "alpha"),
        ("[?] Ask CLIENT", "Beta Two", "@f(false)  @n(3)  @today  @waiting(client)  @z()", "beta.v1"),
    ]
    where = [r[0] for r in rl.filter_tasks(flat).orderBy("line").select(rl.task_location()).collect()]
    assert where == ["/n/beta.v1.md", "/n/alpha.md:3"]


def test_task_index_as_lines(spark, tmp_path):
    (tmp_path / "index.jsonl").write_text("\n".join(json.dumps(r) for r in INDEX))
    assert rl.flatten_tasks(rl.read_task_index(spark, str(tmp_path), lines=True)).count() == 7


def test_broken_index_fails(spark, tmp_path):
    (tmp_path / "index.json").write_text('[{"file": "a", ')
    with pytest.raises(Exception):
        rl.read_task_index(spark, str(tmp_path)).count()


def test_tag_text(spark):
    df = spark.sql("SELECT map('waiting', parse_json('\"client\"'), 'today', parse_json('true'), 't', parse_json('\"true\"')) AS tags, map() AS none")
    assert df.select(tag_text(F.col("tags"))).first()[0] == "@t(true)  @today  @waiting(client)"
