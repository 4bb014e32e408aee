"""Records written once and queried many times, and results as plain files."""

from collections.abc import Mapping, Sequence

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from recordlake.functions.kinds import type_name
from recordlake.functions.values import text_form
from recordlake.operators.extract import RECORD_COLUMNS
from recordlake.operators.profile import collect_profile
from recordlake.session import settings
from recordlake.sources.columns import KEY_PREFIX, TYPED_FIELDS, TYPED_PREFIX, typed_columns, with_flags

HOT_KEYS = ("id", "binder", "status")
PROFILE = "_profile"
SOURCE_TYPES = 4  # fixed value: markdown, typst, jsonl, other


def key_columns(records: DataFrame, keys: Sequence[str] = HOT_KEYS) -> DataFrame:
    """Add a text column per key, so that presets on it reach the Parquet scan."""
    return records.withColumns({KEY_PREFIX + k: text_form(F.col("fields")[k]) for k in keys})


def write_records(
    records: DataFrame,
    path: str,
    keys: Sequence[str] = HOT_KEYS,
    cluster_by: Sequence[str] = (),
    mode: str = "overwrite",
    types: Mapping[str, str] | None = None,
) -> None:
    """Store records as Parquet, one directory per source type.

    ``types`` names fields that become typed columns beside the map.
    ``cluster_by`` sorts every file by key columns, which lets their statistics prune
    row groups.  It sorts within tasks only; no shuffle.
    """
    stored = key_columns(records.select(*RECORD_COLUMNS), keys).withColumns(typed_columns(types or {}))
    if cluster_by:
        stored = stored.sortWithinPartitions("_source_type", *[KEY_PREFIX + k for k in cluster_by])
    # A writer for each source type at a time; with one writer a task would first sort, and spill, all its records by their type.
    with settings(records.sparkSession, {"spark.sql.maxConcurrentOutputFileWriters": str(SOURCE_TYPES)}):
        stored.write.mode(mode).partitionBy("_source_type").parquet(path)


def write_profile(spark: SparkSession, profile: Sequence[Row], path: str) -> None:
    """Store what fields a part of the records has, beside them; profiles of further parts are added."""
    rows = [(r["key"], r["present"], r["non_null"], r["flags"]) for r in profile]
    table = spark.createDataFrame(rows, "key string, present long, non_null long, flags int")
    table.coalesce(1).write.mode("append").parquet(f"{path}/{PROFILE}")


def stored_profile(spark: SparkSession, path: str) -> DataFrame | None:
    """``key, present, non_null, flags`` of a whole store, from the profiles of its parts; None without any."""
    try:
        parts = spark.read.parquet(f"{path}/{PROFILE}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return parts.groupBy("key").agg(F.sum("present").alias("present"), F.sum("non_null").alias("non_null"), F.bit_or("flags").alias("flags"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Stored records, with their key columns and, where the store has a profile, their typed columns.

    Types are those of the whole store, so a clause means the same whatever presets are active.
    """
    stored = spark.read.parquet(path)
    added = [c for c in stored.columns if c.startswith((KEY_PREFIX, TYPED_PREFIX))]
    records = stored.select(*RECORD_COLUMNS, *[F.col("`" + c.replace("`", "``") + "`") for c in added])
    profile = stored_profile(spark, path)
    return records if profile is None else with_flags(records, {r["key"]: r["flags"] for r in collect_profile(profile)})


def snapshot(records: DataFrame, path: str, keys: Sequence[str] = HOT_KEYS, typed_fields: int = TYPED_FIELDS) -> DataFrame:
    """Write records and return the stored table: extract once, query many times.

    Fields are profiled on the way; the ``typed_fields`` best filled ones become typed columns.
    """
    held = records.select(*RECORD_COLUMNS).persist(StorageLevel.DISK_ONLY)  # profiled, then written; extracted once
    try:
        rows = sorted(collect_profile(held), key=lambda r: (-r["non_null"], r["key"]))
        chosen = [r for r in rows if r["non_null"] and not r["key"].startswith("_")][:typed_fields]
        write_records(held, path, keys, types={r["key"]: type_name(r["flags"]) for r in chosen})
        write_profile(records.sparkSession, rows, path)
    finally:
        held.unpersist()
    return read_records(records.sparkSession, path)


def as_json_lines(records: DataFrame) -> DataFrame:
    """One column ``value``: every record as JSON object text, its source as ``_note_file``."""
    source = F.map_from_arrays(
        F.array(F.lit("_note_file")), F.array(F.to_variant_object(F.array("_note_file")))
    )
    with_source = F.map_concat(
        F.map_filter("fields", lambda k, _: k != "_note_file"),
        F.transform_values(source, lambda _, v: F.variant_get(v, "$[0]", "variant")),
    )
    return records.select(F.to_json(with_source, {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Records, or any table, as JSON lines; nulls are kept."""
    if "fields" in df.columns:
        as_json_lines(df).write.mode(mode).text(path)
    else:
        df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A table of cell texts as CSV with a header."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)
