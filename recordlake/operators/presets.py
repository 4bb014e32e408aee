"""Preset expressions ``field=value``, ``field~value``, ``field^value``, ``field!value``."""

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.kinds import ANY_LIST, OBJECT
from recordlake.functions.values import text_form, text_items
from recordlake.sources.columns import KEY_PREFIX, stored_column, stored_flags

_EXPRESSION = re.compile(r"([^=~^!]+)([=~^!])(.*)", re.DOTALL)


def parse_preset(expression: str) -> tuple[str, str, str]:
    """``(field, operator, value)`` of an expression."""
    match = _EXPRESSION.fullmatch(expression.strip())
    if match is None:
        raise ValueError(f"not a preset expression: {expression!r}")
    field, op, value = (part.strip() for part in match.groups())
    if not field:
        raise ValueError(f"preset expression without a field: {expression!r}")
    return field, op, value


def preset_condition(expression: str, records: DataFrame | None = None) -> Column:
    """Condition on records.  A list matches when one of its elements does.

    ``!`` is the opposite of ``=``; records without the field pass it.  With ``records`` from a store, a field that never holds a list
    is tested on its stored column alone, and other fields get a test that the scan can use beside the full one.
    """
    field, op, value = parse_preset(expression)
    flags = None if records is None else stored_flags(records)
    if flags is not None:
        if field not in flags:
            return F.lit(op == "!")
        text = _stored_text(records, field)
        if text is not None and not flags[field] & (ANY_LIST | OBJECT):
            return _test(op, text, value)
    stored = F.col(f"`{KEY_PREFIX}{field}`") if records is not None and KEY_PREFIX + field in records.columns else None
    found = F.col("fields")[field]
    text = text_form(found)
    elements = F.when(text.startswith("["), text_items(found))  # the text of a list does; only those are taken apart
    if op in "=!":
        equal = F.coalesce(F.array_contains(elements, value), text == value)
        if op == "!":
            return ~F.coalesce(equal, F.lit(False))
        return equal if stored is None else ((stored == value) | stored.startswith("[")) & equal
    if op == "~":
        return F.coalesce(F.exists(elements, lambda x: F.contains(x, F.lit(value))), F.contains(text, F.lit(value)))
    starts = F.coalesce(F.exists(elements, lambda x: x.startswith(value)), text.startswith(value))
    return starts if stored is None else (stored.startswith(value) | stored.startswith("[")) & starts


def _stored_text(records: DataFrame, field: str) -> Column | None:
    """Column that holds the text form of a scalar field."""
    if KEY_PREFIX + field in records.columns:
        return F.col(f"`{KEY_PREFIX}{field}`")
    for column_type in ("string", "date", "bigint", "boolean"):  # these print as their values were written
        column = stored_column(records, field, column_type)
        if column is not None:
            return column if column_type == "string" else column.cast("string")
    return None


def _test(op: str, text: Column, value: str) -> Column:
    if op == "!":
        return ~F.coalesce(text == value, F.lit(False))
    return text == value if op == "=" else F.contains(text, F.lit(value)) if op == "~" else text.startswith(value)


def active_expressions(presets: Mapping[str, Sequence[str]], active: Iterable[str]) -> list[str]:
    """Expressions of the active presets, flattened in the order of ``presets``."""
    wanted = set(active)
    unknown = wanted - set(presets)
    if unknown:
        raise KeyError(f"no such preset: {sorted(unknown)}")
    return [e for label, expressions in presets.items() if label in wanted for e in expressions]


def apply_presets(records: DataFrame, expressions: Sequence[str]) -> DataFrame:
    """Records that meet every expression; no expression keeps all."""
    if not expressions:
        return records
    conditions = [preset_condition(e, records) for e in expressions]
    return records.filter(reduce(lambda a, b: a & b, conditions))
