"""New notes as a stream of stored records.

A file source reports a file once: edits and deletions stay unseen until the next batch
scan.  Extraction keeps no state.
"""

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from recordlake.functions.barrier import computed_once
from recordlake.operators.extract import RECORD_COLUMNS, extract_records, overlay
from recordlake.operators.layers import MERGE_KEYS, explode_field, first_per_key, has_all, merge_names, union_layers, with_merge_keys
from recordlake.operators.presets import apply_presets
from recordlake.plans.query import BINDER_FIELD
from recordlake.sources.notes import stream_corpus
from recordlake.sources.store import HOT_KEYS, key_columns


INDEX_PARTS = 64


def key_part(names: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*names), F.lit(INDEX_PARTS)).cast("int")


def complete_keys(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    return with_merge_keys(records, keys).filter(has_all(merge_names(keys)))


def stream_records(
    spark: SparkSession, path: str, expressions: Sequence[str] = (), mode: str = "all", depth: int | None = None
) -> DataFrame:
    """Streaming records of the notes under ``path``, filtered by preset expressions."""
    return apply_presets(extract_records(stream_corpus(spark, path, depth), mode), expressions)


def start_ingest(records: DataFrame, store: str, checkpoint: str, keys: Sequence[str] = HOT_KEYS) -> StreamingQuery:
    """Append all records that are there now to a store, then stop."""
    writer = key_columns(records, keys).writeStream.format("parquet").partitionBy("_source_type")
    return writer.option("path", store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_index(index: DataFrame, path: str, keys: Sequence[str] = MERGE_KEYS) -> None:
    """Write the first index record of every key, exploded and de-duplicated once, for all batches to come.

    Files are partitioned by a hash of the key, so that a batch reads only the parts its keys fall into.
    """
    names = merge_names(keys)
    unique = first_per_key(complete_keys(explode_field(index, BINDER_FIELD), keys), names)
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = F.pmod(F.xxhash64(F.lit("spread"), *names), F.lit(-(-tasks // INDEX_PARTS)))  # a part is not one task's
    unique.withColumn("_part", key_part(names)).repartition("_part", spread).write.mode("overwrite").partitionBy("_part").parquet(path)


def keyed_batch(batch: DataFrame, keys: Sequence[str] = MERGE_KEYS) -> DataFrame:
    return with_merge_keys(explode_field(batch, BINDER_FIELD), keys).withColumn("_part", key_part(merge_names(keys)))


def merge_batch(rows: DataFrame, parts: Sequence[int], index_path: str, keys: Sequence[str] = MERGE_KEYS) -> DataFrame:
    """Annotations of a keyed batch, back-filled from these parts of a stored index: record columns, their keys, and whether an index record was found."""
    names = merge_names(keys)
    index = rows.sparkSession.read.parquet(index_path).filter(F.col("_part").isin(list(parts)))
    index = index.select(*names, F.col("fields").alias("_index_fields"))
    joined = rows.join(index, names, "left")
    merged = computed_once(joined, "fields", overlay(F.col("fields"), F.col("_index_fields"), fill_nulls=True))
    return merged.select(*RECORD_COLUMNS, *names, F.col("_index_fields").isNotNull().alias("_filled"))


def start_merged_ingest(records: DataFrame, index_path: str, store: str, checkpoint: str, keys: Sequence[str] = MERGE_KEYS) -> StreamingQuery:
    """Store every batch of annotations, back-filled from an index that ``store_index`` wrote.

    A batch is a directory: repeated, it overwrites its own rows.  ``merged_records`` adds what the index brings later.
    """

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, batch_id, index_path, store, keys)

    return records.writeStream.foreachBatch(store_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_batch(batch: DataFrame, batch_id: int, index_path: str, store: str, keys: Sequence[str] = MERGE_KEYS) -> None:
    rows = keyed_batch(batch, keys).persist(StorageLevel.DISK_ONLY)  # its parts are looked up, then it is merged; extracted once
    try:
        parts = [r["_part"] for r in rows.select("_part").distinct().collect()]  # at most INDEX_PARTS numbers
        merge_batch(rows, parts, index_path, keys).write.mode("overwrite").parquet(f"{store}/batch={batch_id}")
    finally:
        rows.unpersist()


def merged_records(spark: SparkSession, store: str, index: DataFrame, keys: Sequence[str] = MERGE_KEYS) -> DataFrame:
    """What ``merge_layers`` gives for all batches and the whole index: rows that found no index record in their batch are
    filled from the index as it is now, and its records without an annotation are added."""
    names = merge_names(keys)
    rows = spark.read.parquet(store).select(*RECORD_COLUMNS, *names, "_filled")
    index = with_merge_keys(explode_field(index, BINDER_FIELD), keys)
    complete = has_all(names)
    unique = first_per_key(index.filter(complete), names)
    # rows that were filled, or can never be, need no second look
    open_rows, done = rows.filter(~F.col("_filled") & complete), rows.filter(F.col("_filled") | ~complete)
    late = open_rows.join(unique.select(*names, F.col("fields").alias("_index_fields")), names, "left")
    late = computed_once(late, "fields", overlay(F.col("fields"), F.col("_index_fields"), fill_nulls=True))
    alone = unique.join(rows.filter(complete).select(*names).distinct(), names, "left_anti")
    return union_layers(done, late, alone, index.filter(~complete))
