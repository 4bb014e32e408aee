"""Record layers: fan out list fields, union, merge annotations with their index."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.barrier import computed_once
from recordlake.functions.values import is_null, items, text_form
from recordlake.operators.extract import RECORD_COLUMNS, overlay
from recordlake.operators.skew import MIN_ROWS, hot_keys, spread_many, spread_one
from recordlake.sources.columns import without_flags

MERGE_KEYS = ("id", "binder")


def explode_field(records: DataFrame, field: str) -> DataFrame:
    """One record per element of a list field.

    Records where the field is a scalar, missing or an empty list stay one record.
    """
    value = F.col("fields")[field]
    elements = F.coalesce(items(value), F.array(value))
    rest = [c for c in records.columns if c != "fields"]
    fanned = records.select(*rest, "fields", F.explode_outer(elements).alias("_element"))
    fields = F.transform_values("fields", lambda k, v: F.when(k == field, F.col("_element")).otherwise(v))
    return computed_once(fanned, "fields", fields).select(*records.columns)


def normalize_arrays(records: DataFrame, names: Sequence[str]) -> DataFrame:
    """Make the named fields lists: a scalar becomes a list of one; null and missing stay."""
    if not names:
        return records

    def as_list(k: Column, v: Column) -> Column:
        is_list = F.schema_of_variant(v).startswith("ARRAY")
        return F.when(k.isin(*names) & ~is_null(v) & ~is_list, F.to_variant_object(F.array(v))).otherwise(v)

    return computed_once(records, "fields", F.transform_values("fields", as_list))


def union_layers(*layers: DataFrame) -> DataFrame:
    """All records of all layers; field sets may differ."""
    return reduce(DataFrame.unionByName, [without_flags(layer.select(*RECORD_COLUMNS)) for layer in layers])


def first_per_key(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first record of every key, by source and position.

    Each task reduces its rows to one per key before the shuffle, so copies of one key
    do not gather in one task.
    """
    row = F.struct(*[c for c in records.columns if c not in keys])
    first = F.min_by(row, F.struct("_note_file", "_pos")).alias("_row")
    return records.groupBy(*keys).agg(first).select(*keys, "_row.*")


def merge_names(keys: Sequence[str]) -> list[str]:
    return [f"_merge_{i}" for i in range(len(keys))]


def with_merge_keys(records: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Records with the text form of their keys."""
    found = {n: text_form(F.col("fields")[k]) for k, n in zip(keys, merge_names(keys))}
    return records.select(*RECORD_COLUMNS, *keep).withColumns(found)


def has_all(names: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])


def merge_layers(
    annotations: DataFrame,
    index: DataFrame,
    keys: Sequence[str] = MERGE_KEYS,
    hot_key_rows: int = MIN_ROWS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Annotations back-filled with their index record, and the index records without one.

    Layers meet on all ``keys``, compared as text.  The annotation keeps its source and
    its non-null fields; several annotations of one key are each kept; of several index
    records of one key the first is used.  A record that lacks a key meets nothing and is
    kept as it is.

    ``keep`` names columns of the annotations to carry; index records have NULL there.

    Annotations of a key with ``hot_key_rows`` or more are dealt over as many tasks as they fill.
    ``annotations`` is read twice; pass stored records when it is costly to compute.
    """
    names = merge_names(keys)
    annotations = with_merge_keys(annotations, keys, keep)
    index = with_merge_keys(index, keys)
    complete = has_all(names)

    per_key = annotations.filter(complete).groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    hot = hot_keys(per_key, names, hot_key_rows)
    unique = first_per_key(index.filter(complete), names)

    # A row that lacks a key gets no key at all and a salt of its own: it matches nothing,
    # the outer join keeps it, and the salts spread such rows over the tasks.
    many = spread_many(annotations, hot, names, ["_note_file", "_pos"])
    lone_salt = F.xxhash64("_note_file", "_pos")
    many = many.withColumn("_salt", F.when(complete, F.col("_salt")).otherwise(lone_salt))
    many = many.withColumns({n: F.when(complete, F.col(n)) for n in names})
    one = spread_one(unique, hot, names)
    one = one.select(*names, "_salt", F.col("fields").alias("_index_fields"))
    joined = many.join(one, [*names, "_salt"], "left")
    merged = computed_once(joined, "fields", overlay(F.col("fields"), F.col("_index_fields"), fill_nulls=True))
    # Every key has rows; the test keeps the counted table the same as above, so Spark
    # shuffles it once.
    alone = unique.join(per_key.filter(F.col("rows") > 0), names, "left_anti")
    alone = union_layers(alone, index.filter(~complete))
    return without_flags(merged.select(*RECORD_COLUMNS, *keep)).unionByName(alone, allowMissingColumns=True)
