"""Text and array forms of VARIANT values."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_form(value: Column) -> Column:
    """Scalar as text, array or object as JSON text, null as NULL."""
    return F.try_variant_get(value, "$", "string")


def text_items(value: Column) -> Column:
    """Array elements as text; NULL when the value is no array."""
    return F.try_variant_get(value, "$", "array<string>")


def items(value: Column) -> Column:
    """Array elements; NULL when the value is no array."""
    return F.try_variant_get(value, "$", "array<variant>")


def is_null(value: Column) -> Column:
    """True for an absent value and for a JSON null."""
    return value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(False))


def number_text(value: Column) -> Column:
    """Text of a scalar; a whole double prints without its fraction."""
    text = text_form(value)
    return F.when(F.schema_of_variant(value) == "DOUBLE", F.regexp_replace(text, r"\.0$", "")).otherwise(text)


def display_text(value: Column) -> Column:
    """Scalar as shown in a record form: ``None``, ``True``/``False``, whole numbers as ``5.0``."""
    kind = F.schema_of_variant(value)
    text = text_form(value)
    is_number = (kind == "BIGINT") | (kind == "DOUBLE") | kind.startswith("DECIMAL")
    return (
        F.when(is_null(value), "None")
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(is_number & text.rlike(r"^-?\d+$"), F.concat(text, F.lit(".0")))
        .otherwise(text)
    )


def list_text(value: Column) -> Column:
    """Scalar or list as shown in a record form; list elements are joined by a comma."""
    elements = items(value)
    joined = F.array_join(F.transform(elements, display_text), ", ")
    return F.when(elements.isNotNull(), joined).otherwise(display_text(value))


def cell_text(value: Column) -> Column:
    """Value as one table cell: null is empty, a list is ``[a b]``, text with line ends is flattened."""
    elements = items(value)
    members = F.try_variant_get(value, "$", "map<string,variant>")
    empty = F.lit("<nil>")
    list_form = F.concat(
        F.lit("["),
        F.array_join(F.transform(elements, lambda x: F.when(is_null(x), empty).otherwise(number_text(x))), " "),
        F.lit("]"),
    )
    map_form = F.concat(
        F.lit("map["),
        F.array_join(
            F.transform(
                F.array_sort(F.map_keys(members)),
                lambda k: F.concat(
                    k, F.lit(":"), F.when(is_null(members[k]), empty).otherwise(number_text(members[k]))
                ),
            ),
            " ",
        ),
        F.lit("]"),
    )
    text = (
        F.when(is_null(value), "")
        .when(elements.isNotNull(), list_form)
        .when(members.isNotNull(), map_form)
        .otherwise(number_text(value))
    )
    one_line = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return F.when(F.contains(text, F.lit("\n")), one_line).otherwise(text)


def typed_value(value: Column, column_type: str) -> Column:
    """VARIANT as the given column type; a value that does not convert gives NULL."""
    if column_type == "date":
        return F.try_variant_get(value, "$", "string").try_cast("date")
    return F.try_variant_get(value, "$", column_type)
