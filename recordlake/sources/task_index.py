"""The task index: notes with their task lists."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.sources.json_array import json_array_elements

TASK_INDEX_SCHEMA = (
    "file STRING, project STRING, title STRING, "
    "tasks ARRAY<STRUCT<line: INT, status: STRING, tags: MAP<STRING, VARIANT>, task: STRING>>"
)


def read_task_index(spark: SparkSession, path: str | list[str], lines: bool = False, split: bool = False) -> DataFrame:
    """Index records from files that each hold one JSON array, or JSON lines.

    A file with an array is read by one task, unless ``split`` lets many tasks read its parts, for two shuffles of the
    text.  An element that is no valid record fails the job.
    """
    if split and not lines:
        record = F.from_json("element", TASK_INDEX_SCHEMA, {"mode": "FAILFAST"})
        return json_array_elements(spark, path).select(record.alias("record")).select("record.*")
    reader = spark.read.schema(TASK_INDEX_SCHEMA).option("mode", "FAILFAST")
    return reader.option("multiLine", not lines).json(path)
