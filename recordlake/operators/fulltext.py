"""Case-insensitive search in the whole text of a record's note."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordlake.functions.text import contains_ignoring_case, is_note

FULLTEXT_FLAG = "_fulltext"


def matching_notes(corpus: DataFrame, term: str) -> DataFrame:
    """Markdown and typst notes whose text contains the term."""
    return corpus.filter(is_note(F.col("_note_file")) & contains_ignoring_case(F.col("content"), term.strip()))


def filter_fulltext(records: DataFrame, corpus: DataFrame, term: str) -> DataFrame:
    """Records whose note contains the term; a blank term keeps all.

    Records without a note text, such as JSON lines, drop out.  Spark broadcasts the
    matching paths when their size allows, and joins by shuffle otherwise.
    """
    if not term.strip():
        return records
    return records.join(matching_notes(corpus, term).select("_note_file"), "_note_file", "left_semi").select(
        *records.columns
    )


def mark_fulltext(corpus: DataFrame, term: str) -> DataFrame:
    """Add ``_fulltext``: whether the note contains the term.

    Carried through ``extract_records(keep=["_fulltext"])`` it filters records without
    a join, and both counts, before and after, come from one pass.
    """
    return corpus.withColumn(FULLTEXT_FLAG, contains_ignoring_case(F.col("content"), term.strip()))
