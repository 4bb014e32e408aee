"""Full text through an inverted index of character trigrams.

Texts are folded to lower case, as the plain search folds them.  The index holds, for each trigram, the notes that have it, partitioned by a
hash of the trigram; a text of fewer than three characters is its own entry.  A term of three characters or more asks for all its trigrams, and
candidates are the notes that have every one; a shorter term asks for every entry of the dictionary that contains it.
Candidates are verified on their text, so the result is that of the plain search.

Texts are stored in order of their note's number: few candidates reach the scan as a list of numbers, which prunes row groups and pages;
many are joined.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlake.functions.text import contains_ignoring_case, is_note

GRAM, BUCKETS = 3, 64
LISTED = 10_000  # so many candidates at most become a list in the scan's filter
_BLOCK_BYTES = 8 << 20
_EACH_GRAM = rf"(?s)(?=(.{{{GRAM}}}))."  # the characters ahead, then one step: by code points, and no call for each place


def note_number(path: Column) -> Column:
    return F.xxhash64(path)


def with_grams(texts: DataFrame) -> DataFrame:
    """``note, gram``: the distinct trigrams of each folded text; a shorter text itself, and none of an empty one."""
    folded = texts.select("note", F.lower("content").alias("text"))
    grams = F.array_distinct(F.regexp_extract_all("text", F.lit(_EACH_GRAM), F.lit(1)))
    of_text = F.when(F.length("text") >= GRAM, grams).when(F.col("text") != "", F.array("text"))
    return folded.select("note", F.explode(of_text).alias("gram"))


def write_text_index(corpus: DataFrame, path: str) -> None:
    """Write ``grams`` (trigram to notes) and ``texts`` of the notes of a corpus."""
    notes = corpus.filter(is_note(F.col("_note_file")) & F.col("content").isNotNull()).select(note_number(F.col("_note_file")).alias("note"), "_note_file", "content")
    texts = notes.repartitionByRange("note").sortWithinPartitions("note")
    texts.write.mode("overwrite").option("parquet.block.size", _BLOCK_BYTES).parquet(f"{path}/texts")
    stored = notes.sparkSession.read.parquet(f"{path}/texts")
    grams = with_grams(stored).withColumn("bucket", _bucket(F.col("gram")))
    # A bucket is dealt over as many tasks as its share of the shuffle, so neither a bucket nor a frequent trigram is one task's.
    tasks = int(notes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = grams.repartition("bucket", F.pmod("note", F.lit(-(-tasks // BUCKETS)))).sortWithinPartitions("bucket", "gram", "note")
    dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def candidate_notes(spark: SparkSession, path: str, term: str) -> DataFrame:
    """Numbers of the notes that can contain a term; reads postings only."""
    folded = term.strip().lower()
    postings = spark.read.parquet(f"{path}/grams")
    if len(folded) < GRAM:
        return postings.filter(F.contains("gram", F.lit(folded))).select("note").distinct()
    grams = sorted({folded[i : i + GRAM] for i in range(len(folded) - GRAM + 1)})
    buckets = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"))).distinct().collect()]
    held = postings.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(grams))
    return held.groupBy("note").agg(F.count_distinct("gram").alias("grams")).filter(F.col("grams") == len(grams)).select("note")


def matching_notes_indexed(spark: SparkSession, path: str, term: str, listed: int = LISTED) -> DataFrame:
    """``_note_file, content`` of the notes that contain a term."""
    texts = spark.read.parquet(f"{path}/texts")
    wanted = candidate_notes(spark, path, term)
    first = [r["note"] for r in wanted.limit(listed + 1).collect()]  # bounded; more of them are joined
    found = texts.filter(F.col("note").isin(first)) if len(first) <= listed else texts.join(wanted, "note", "left_semi")
    return found.filter(contains_ignoring_case(F.col("content"), term.strip())).select("_note_file", "content")


def filter_fulltext_indexed(records: DataFrame, path: str, term: str) -> DataFrame:
    """Records whose note contains the term, as ``filter_fulltext``; a blank term keeps all."""
    if not term.strip():
        return records
    notes = matching_notes_indexed(records.sparkSession, path, term).select("_note_file")
    return records.join(notes, "_note_file", "left_semi").select(*records.columns)
