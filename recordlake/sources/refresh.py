"""A store that follows its notes: only what changed is extracted again.

The manifest lists, for every version, the notes that were new, edited or deleted then, with a hash of their text.  A refresh compares the
corpus with the latest entry of each note by a full outer join of paths and hashes, extracts the changed notes, and writes their records
under the new version; deleted notes leave a tombstone in the manifest.  A renamed note is a deleted and a new one.
Current records are those whose version is the latest of their note.

The manifest of a version is written last.  A refresh that dies before leaves files that the next one overwrites, and nothing that is read.
"""

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.functions.text import is_note
from recordlake.operators.extract import ALL, RECORD_COLUMNS, extract_records
from recordlake.sources.store import HOT_KEYS, key_columns

NEW, EDITED, DELETED = "new", "edited", "deleted"
_MANIFEST = "_note_file string, hash struct<a: bigint, b: bigint>, state string, version int"


def manifest(spark: SparkSession, store: str) -> DataFrame:
    """Every entry of every version: ``_note_file, hash, state, version``; no rows before the first refresh."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{store}/manifest")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def current_notes(spark: SparkSession, store: str) -> DataFrame:
    """Latest entry of each note that is not deleted."""
    latest = manifest(spark, store).groupBy("_note_file").agg(F.max_by(F.struct("hash", "state", "version"), "version").alias("last"))
    return latest.select("_note_file", "last.*").filter(F.col("state") != DELETED)


def changed_notes(spark: SparkSession, corpus: DataFrame, store: str) -> DataFrame:
    """``_note_file, hash, state`` of the notes that differ from the store.  Only paths and hashes are shuffled.

    Copies of a path count as one note with all their texts.
    """
    text = F.coalesce("content", F.lit(""))
    hashes = corpus.filter(is_note(F.col("_note_file"))).select("_note_file", F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))
    # sums of hashes, so that two equal texts of a path differ from none
    now = hashes.groupBy("_note_file").agg(F.struct(_wrapped_sum("a").alias("a"), _wrapped_sum("b").alias("b")).alias("hash"))
    before = current_notes(spark, store).select("_note_file", F.col("hash").alias("known"))
    both = now.join(before, "_note_file", "full")
    state = F.when(F.col("known").isNull(), NEW).when(F.col("hash").isNull(), DELETED).when(F.col("hash") != F.col("known"), EDITED)
    return both.select("_note_file", "hash", state.alias("state")).filter("state is not null")


def _wrapped_sum(name: str):
    """Sum modulo 2 ** 61; exact as a decimal, so it never overflows."""
    return (F.sum(F.col(name).cast("decimal(20,0)")) % F.lit(1 << 61).cast("decimal(20,0)")).cast("bigint")


def refresh(
    spark: SparkSession, corpus: DataFrame, store: str, mode: str = ALL, header_block: bool = False, keys: Sequence[str] = HOT_KEYS
) -> dict[str, int]:
    """Bring a store up to date with a corpus; returns how many notes were new, edited and deleted."""
    version = (manifest(spark, store).agg(F.max("version")).first()[0] or 0) + 1
    pending = f"{store}/pending/version={version}"
    changed_notes(spark, corpus, store).write.mode("overwrite").parquet(pending)
    changes = spark.read.schema("_note_file string, hash struct<a: bigint, b: bigint>, state string").parquet(pending)
    touched = corpus.join(changes.filter(F.col("state") != DELETED).select("_note_file"), "_note_file", "left_semi")
    records = extract_records(touched, mode, header_block)
    key_columns(records, keys).write.mode("overwrite").parquet(f"{store}/records/version={version}")
    changes.write.mode("overwrite").parquet(f"{store}/manifest/version={version}")
    counts = {r["state"]: r["count"] for r in changes.groupBy("state").count().collect()}
    return {state: counts.get(state, 0) for state in (NEW, EDITED, DELETED)}


def current_records(spark: SparkSession, store: str) -> DataFrame:
    """Records of the latest version of every note that is still there."""
    stored = spark.read.parquet(f"{store}/records")
    latest = current_notes(spark, store).select("_note_file", "version")
    found = stored.join(latest, ["_note_file", "version"], "left_semi")
    return found.select(*RECORD_COLUMNS, *[c for c in stored.columns if c.startswith("_key_")])
