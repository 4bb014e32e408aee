import json

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

import recordlake as rl


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    def make(*notes):
        return spark.createDataFrame(list(notes), "_note_file string, content string")

    return make


@pytest.fixture
def records(spark):
    """Records from dicts; ``_note_file`` in the dict is the source, the order the position."""

    def make(*rows, layer="annotation"):
        lines = []
        for i, row in enumerate(rows):
            row = dict(row)
            lines.append((row.pop("_note_file", "/n/x.jsonl"), i, json.dumps(row)))
        df = rl.parse_jsonl(spark.createDataFrame(lines, "_note_file string, _pos long, line string"))
        return df.withColumn("_layer", F.lit(layer))

    return make


def as_dicts(records):
    """Fields of records as Python dicts, in the order of source and position."""
    rows = records.select("_note_file", "_pos", F.to_json("fields", {"ignoreNullFields": "false"}).alias("j")).collect()
    return [json.loads(r["j"]) for r in sorted(rows, key=lambda r: (r["_note_file"], r["_pos"] or 0))]
