"""JSON lines as records of the index layer."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.functions.barrier import computed_once
from recordlake.functions.yaml_fields import json_fields
from recordlake.session import last_key_wins
from recordlake.sources.notes import plain_path


def read_jsonl(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """Records of JSON-lines files, one per line.

    ``_pos`` grows with the line within a file (it is the line number in files of one
    split).  Of a folder, the ``*.jsonl`` files are read; a path with an extension or a glob is taken as it is.  Lines that hold
    no JSON object are left out (``bad_lines`` lists them); with ``strict`` the first malformed line fails the job.  Blank lines never count.
    """
    return parse_jsonl(read_lines(spark, path), strict)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines of JSON-lines files: ``(_note_file, _pos, line)``."""
    reader = spark.read.format("text").option("lineSep", "\n")
    paths = [path] if isinstance(path, str) else path
    if not any(set(p.rstrip("/").rpartition("/")[2]) & set(".*?[{") for p in paths):
        reader = reader.option("pathGlobFilter", "*.jsonl")
    files = reader.load(path)
    row_in_task = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return files.select(
        plain_path(F.col("_metadata.file_path")).alias("_note_file"),
        (F.col("_metadata.file_block_start") + row_in_task).alias("_pos"),
        F.col("value").alias("line"),
    )


def bad_lines(lines: DataFrame) -> DataFrame:
    """The lines, not blank, that ``parse_jsonl`` leaves out."""
    lines = lines.filter(F.length(F.trim(F.col("line"), F.lit(" \t\r"))) > 0)
    last_key_wins(lines.sparkSession)
    return lines.filter(json_fields(F.col("line")).isNull()).select("_note_file", "_pos", "line")


def parse_jsonl(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Records from a table ``(_note_file, _pos, line)`` of JSON texts.  Of equal keys in an object the last counts."""
    lines = lines.filter(F.length(F.trim(F.col("line"), F.lit(" \t\r"))) > 0)
    fields = _strict_fields(F.col("line")) if strict else json_fields(F.col("line"))
    last_key_wins(lines.sparkSession)
    return computed_once(lines, "fields", fields).filter(F.col("fields").isNotNull()).select(
        "_note_file",
        F.lit("jsonl").alias("_source_type"),
        F.lit("index").alias("_layer"),
        F.col("_pos").cast("long").alias("_pos"),
        "fields",
    )


def read_collections(spark: SparkSession, notes_dir: str) -> DataFrame | None:
    """Records of ``<notes_dir>/collections/*.jsonl``; None when there are none."""
    try:
        return read_jsonl(spark, notes_dir.rstrip("/") + "/collections/*.jsonl")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _strict_fields(line: Column) -> Column:
    return F.variant_get(F.parse_json(line), "$", "map<string,variant>")
