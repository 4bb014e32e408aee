"""Records as text: forms, cells, source columns."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.text import base_name
from recordlake.functions.values import cell_text, is_null, list_text


def record_form(fields: Column, note_file: Column | None = None) -> Column:
    """One line ``key  value`` per field, sorted by key, and the source last."""
    keys = F.array_sort(F.map_keys(F.map_filter(fields, lambda k, v: ~k.startswith("_") & ~is_null(v))))
    lines = F.transform(keys, lambda k: F.concat(k, F.lit("  "), list_text(fields[k])))
    form = F.array_join(lines, "\n")
    if note_file is not None:
        source = F.when(note_file != "", F.concat(F.lit("\nsource  "), note_file))
        form = F.concat_ws("\n", F.when(F.size(keys) > 0, form), source)
    return F.when(form == "", "(empty record)").otherwise(form)


def source_column(note_file: Column) -> Column:
    """Base name of the source, shown as the leading column."""
    return base_name(note_file).alias("source")


def select_columns(records: DataFrame, columns: Sequence[str], lead: bool = True) -> DataFrame:
    """The given fields as cell texts, led by the source."""
    cells = [F.coalesce(cell_text(F.col("fields")[c]), F.lit("")).alias(c) for c in columns]
    return records.select(*([source_column(F.col("_note_file"))] if lead else []), *cells)
