"""Columns that a store holds beside the map of all fields, and what is known of its fields.

A stored table carries the kinds of its fields as metadata of its ``fields`` column.  Any operator that computes ``fields`` anew drops that
metadata, and with it the use of these columns, so they never answer for values they were not made from.
"""

import json
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.values import typed_value

KEY_PREFIX, TYPED_PREFIX = "_key_", "_typed_"
# Types that a stored column can have; objects and mixed lists stay in the map alone.
COLUMN_TYPES = ("bigint", "boolean", "date", "double", "string", "array<string>")
# The best filled fields get a column; the others are read from the map.
TYPED_FIELDS = 200
_FLAGS = "field_flags"


def with_flags(records: DataFrame, flags: Mapping[str, int]) -> DataFrame:
    return records.withMetadata("fields", {_FLAGS: json.dumps(flags)})


def stored_flags(records: DataFrame) -> dict[str, int] | None:
    """Kinds of the fields of a stored table; None for any other."""
    if "fields" not in records.columns:
        return None
    found = records.schema["fields"].metadata.get(_FLAGS)
    return None if found is None else json.loads(found)


def without_flags(records: DataFrame) -> DataFrame:
    return records if stored_flags(records) is None else records.withMetadata("fields", {})


def stored_column(records: DataFrame, field: str, column_type: str) -> Column | None:
    """The column that holds a field as this type, if the table has one."""
    name = TYPED_PREFIX + field
    if stored_flags(records) is None or name not in records.columns or records.schema[name].dataType.simpleString() != column_type:
        return None
    return F.col("`" + name.replace("`", "``") + "`")


def typed_columns(types: Mapping[str, str]) -> dict[str, Column]:
    """Columns of the named fields; of names that differ in case only, the first."""
    out, taken = {}, set()
    for field, column_type in types.items():
        if column_type in COLUMN_TYPES and field.lower() not in taken:
            taken.add(field.lower())
            out[TYPED_PREFIX + field] = typed_value(F.col("fields")[field], column_type)
    return out
